"""The option surface as a frozen dataclass with checks; names and defaults are those of the method."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields


def parse_size(text: str) -> int:
    """A genome size with a mandatory suffix k, m or g; -2 if it has none or is no number."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([kKmMgG])", text.strip())
    return round(float(m[1]) * {"k": 10**3, "m": 10**6, "g": 10**9}[m[2].lower()]) if m else -2


@dataclass(frozen=True)
class Options:
    # scan
    k: int = 51
    w: int = 51
    adapter_len: int = 0
    min_read_len: int = 1000
    min_mean_quality: int = 10
    ont: bool = False
    # counting
    min_hist_count: int = 5
    high_factor: float = 5.0
    max_kmer_count: int = 2000
    hom_cov: int = -1
    genome_size: int = -1
    # overlaps and correction
    rounds: int = 3
    max_chains: int = 100
    max_diff_ec: float = 0.04
    max_diff_final: float = 0.03
    chimera_cov: int = 1
    chimera_flank: int = 256
    # graph
    clean_rounds: int = 4
    max_drop: float = 0.8
    min_drop: float = 0.2
    max_tip: int = 3
    max_hang: int = 1000
    hang_rate: float = 0.8
    min_overlap: int = 50
    fuzz: int = 1000
    small_bubble: int = 0
    large_bubble: int = 10_000_000
    # trio, purge, phase, scaffold
    min_cnt: int = 2
    mid_cnt: int = 5
    trio_occ: int = 60
    purge_level: int = 3
    purge_similarity: float = 0.75
    purge_similarity_high: float = 0.55
    seed: int = 11
    perturb: int = 10_000
    perturb_rate: float = 0.1
    haplotypes: int = 2
    misjoin_len: int = 500_000
    scaffold_gap: int = 3_000_000
    low_quality: int = 70
    telomere: str | None = None
    ul_error: float = 0.2
    dp_density: float = 0.0025

    def __post_init__(self):
        bad = []

        def need(ok: bool, what: str) -> None:
            if not ok:
                bad.append(what)

        need(1 <= self.k <= 63, "k must be 1 to 63")
        need(self.w > 0, "w must be positive")
        need(self.adapter_len >= 0, "adapter_len must not be negative")
        need(self.min_read_len >= 0, "min_read_len must not be negative")
        need(self.rounds >= 0 and self.clean_rounds >= 0, "rounds must not be negative")
        need(self.max_chains >= 0, "max_chains must not be negative")
        need(0 <= self.min_drop < 1 and 0 <= self.max_drop < 1 and self.min_drop <= self.max_drop, "0 <= min_drop <= max_drop < 1")
        need(0 < self.max_diff_ec < 1 and 0 < self.max_diff_final < 1, "difference rates lie between 0 and 1")
        need(0 <= self.purge_level <= 3, "purge_level is 0 to 3")
        need(0 <= self.purge_similarity <= 1 and 0 <= self.purge_similarity_high <= 1, "similarities lie between 0 and 1")
        need(self.min_cnt <= self.mid_cnt, "min_cnt must not exceed mid_cnt")
        need(self.haplotypes >= 1, "haplotypes must be positive")
        need(self.perturb >= 0 and 0 <= self.perturb_rate <= 1, "perturbation settings out of range")
        need(0 <= self.low_quality <= 100, "low_quality is a percentage")
        need(self.max_tip >= 0 and self.max_hang >= 0 and self.fuzz >= 0, "graph limits must not be negative")
        if bad:
            raise ValueError("; ".join(bad))

    @classmethod
    def of(cls, **given) -> Options:
        """Options from keywords; unknown names are an error, not ignored."""
        known = {f.name for f in fields(cls)}
        if extra := set(given) - known:
            raise ValueError(f"unknown options: {', '.join(sorted(extra))}")
        return cls(**given)

    def max_chains_for(self, hom: int) -> int:
        """The cap on chains raised to the coverage; it is never lowered."""
        return max(self.max_chains, round(hom * self.high_factor))


def read_list(arg: str) -> list[str]:
    """An inline comma list, or the lines of a file named after @."""
    if arg.startswith("@"):
        with open(arg[1:]) as f:
            return [x.strip() for x in f if x.strip()]
    return [x for x in arg.split(",") if x]
