"""Problem 8: evaluation texts leaking into training text.

A document leaks an item if it repeats a stretch of at least 20 consecutive words of the
item, beginning and ending with a kept word, with at most one word in six changed, dropped
or added.

Every 20-word window of the items and of the documents gets a 64-bit SimHash; words that no
item has weigh nothing. The unit that leaks is a stretch of 20 words, not the whole item, so
that is the size of an item's windows. The item fingerprints (a fixed query set, handled in
blocks of bounded size) are indexed by three blocks of bits: two fingerprints within Hamming
radius 8 differ by at most 2 bits in one of the blocks, so a table per block that holds every
item fingerprint under all its variants of up to 2 bits finds all of them with one look-up a
block. Window pairs within the radius are verified by the exact similarity of their weighted
two-word shingles, and what is left by exact edit distance over all starts at once, which
decides.

The corpus is read and cut into words once for GROUP_CHARS characters of items: workers
hold a stretch of the corpus as word numbers and pass it by one block of items after another.

Of a leak, one window with few edits is enough. ``exhaustive`` candidates, which share a run
of four words (every leak has one), exist to measure what the radius loses.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

RUN = 4
MIN_WORDS = 20
PER_EDIT = 6
#: A stretch of 2 * MIN_WORDS or more has a part of at least MIN_WORDS that is no worse, give or take the edits at the cut.
MAX_WORDS = 2 * MIN_WORDS + PER_EDIT + 2
#: Words that the kept runs of any leak cover at least: 17 kept words in 4 runs, three of them under RUN.
LEAST_COVER = 8
#: Of the first or the last MIN_WORDS words of any leak up to 2 * MIN_WORDS long at most 5 are lost, so this many occur near by.
LEAST_PRESENT = MIN_WORDS - 5
#: Characters of item text held in one index; larger sets are handled in blocks, one after another.
BLOCK_CHARS = 500_000
#: Characters of item text that reach the driver and the workers for one scan of the corpus (compressed, a third of it or less).
GROUP_CHARS = 64_000_000
#: Words of the corpus that a worker holds while the blocks pass by, 4 bytes each.
HELD_WORDS = 4_000_000
#: Hamming radius that the bit blocks guarantee: 2 bits in one of three blocks.
RADIUS = 8
BIT_BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Words of a document window that must occur in the items at all, and the weighted similarity of two-word shingles that a
#: window pair needs: three edits in 20 words leave 13 of 19 shingles, a shift of the window by as much again leaves 10.
LEAST_KNOWN = 14
SIMILARITY = 0.35


class ItemIndex:
    """4-word runs of a set of items, as sorted codes with their places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = []
        for _, text in items:
            self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int64))
        code, item, at = [], [], []
        for k, w in enumerate(self.words):
            c = run_codes(w)
            code.append(c)
            item.append(np.full(len(c), k, np.int32))
            at.append(np.arange(len(c), dtype=np.int32))
        code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.size = len(self.vocab) + 1
        self.first = np.append(first, len(code))
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int32)


def word_vectors(vocab: dict[str, int]) -> np.ndarray:
    """64 signs a word, from its hash; row 0 (unknown words) is zero."""
    out = np.zeros((len(vocab) + 1, 64), np.int8)
    for word, i in vocab.items():
        h = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=8).digest(), np.uint8)
        out[i] = 2 * np.unpackbits(h).astype(np.int8) - 1
    return out


def fingerprints(w: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """SimHash of every window of MIN_WORDS words."""
    if len(w) < MIN_WORDS:
        return np.zeros(0, np.uint64)
    # a window's sums lie within MIN_WORDS of 0, so running sums may wrap around in 8 bits
    s = np.zeros((len(w) + 1, 64), np.int8)
    np.cumsum(vectors[w], axis=0, dtype=np.int8, out=s[1:])
    return np.packbits((s[MIN_WORDS:] - s[:-MIN_WORDS]) > 0, axis=1).view(np.uint64).ravel()


class SimIndex(ItemIndex):
    """Fingerprints of all item windows under their variants in each block of bits."""

    def __init__(self, items: list[tuple[int, str]]):
        super().__init__(items)
        self.vectors = word_vectors(self.vocab)
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int64)])
        at = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        n = np.maximum(np.diff(at) - MIN_WORDS + 1, 0)
        self.win_item = np.repeat(np.arange(len(self.words)), n)
        self.win_pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.win_flat = self.win_pos + at[self.win_item]
        every = np.concatenate([*(fingerprints(w, self.vectors) for w in self.words), np.zeros(0, np.uint64)])
        # items share passages: one entry a distinct fingerprint, and the windows that have it
        self.prints, which = np.unique(every, return_inverse=True)
        self.of_print = np.argsort(which, kind="stable")
        self.first_of = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.prints)))])
        # rarer words weigh more
        df = np.bincount(np.concatenate([*(np.unique(w) for w in self.words), np.zeros(0, np.int64)]), minlength=len(self.vocab) + 1)
        self.weight = np.log1p(len(self.words) / np.maximum(df, 1))
        self._tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}  # the tables are made where they are used: they are the larger part

    @property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block of bits: where a key's entries begin, and the fingerprints under it."""
        if self._tables is None:
            self._tables = [self._table(shift, bits) for shift, bits in BIT_BLOCKS]
        return self._tables

    def _table(self, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        one = np.uint32(1) << np.arange(bits, dtype=np.uint32)
        variants = np.unique(np.concatenate([[np.uint32(0)], (one[:, None] | one[None, :]).ravel()]))
        key = ((self.prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        # key above, fingerprint number below: one sort of 64-bit numbers
        both = ((key[None, :] ^ variants[:, None]).astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)[None, :]
        both = np.sort(both.ravel())
        first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=1 << bits), out=first[1:])
        return first, both.astype(np.uint32).astype(np.int32)


def run_codes(w: np.ndarray) -> np.ndarray:
    """64-bit codes of all 4-word runs (a code collision costs a verification, not a result)."""
    if len(w) < RUN:
        return np.zeros(0, np.uint64)
    u = w.astype(np.uint64)
    c = u[: len(u) - RUN + 1].copy()
    for j in range(1, RUN):
        c = c * np.uint64(0x9E3779B97F4A7C15) + u[j : len(u) - RUN + 1 + j]
    return c


def leaks(doc: np.ndarray, item: np.ndarray, d_lo: int, d_hi: int, i_lo: int, i_hi: int) -> bool:
    """Does doc[d_lo:d_hi] repeat a stretch of item that starts in [i_lo, i_hi)? Exact, all starts at once."""
    d = doc[max(0, d_lo) : d_hi]
    i_lo, i_hi = max(0, i_lo), min(i_hi, len(item) - MIN_WORDS + 1)
    if i_lo >= i_hi or len(d) < MIN_WORDS * 2 // 3:
        return False
    # windows of the item with enough words that occur in this part of the document at all
    there = np.zeros(max(int(item.max()), int(d.max())) + 1, bool)
    there[d] = True
    there[0] = False
    seen = np.concatenate([[0], np.cumsum(there[item[i_lo : i_hi + MAX_WORDS]])])
    good = np.flatnonzero(seen[MIN_WORDS:] - seen[:-MIN_WORDS] >= LEAST_PRESENT) + i_lo
    if not len(good):
        return False
    starts = np.arange(max(i_lo, int(good[0]) - MAX_WORDS + MIN_WORDS), min(i_hi, int(good[-1]) + 1))
    if not len(starts):
        return False
    big = 10_000
    cols = np.arange(len(d) + 1)
    prev = np.zeros((len(starts), len(d) + 1), np.int32)
    for step in range(min(MAX_WORDS, len(item) - int(starts[0]))):
        pos = starts + step
        inside = pos < len(item)
        w = np.where(inside, item[np.minimum(pos, len(item) - 1)], -1)
        eq = w[:, None] == d[None, :]
        kept = np.where(eq, prev[:, :-1], big)
        if step + 1 >= MIN_WORDS and (kept.min(axis=1) * PER_EDIT <= step + 1).any():
            return True
        if step == 0:  # a stretch begins with a kept word
            cur = np.full_like(prev, big)
            cur[:, 1:] = kept
        else:
            cur = prev + 1
            cur[:, 1:] = np.minimum(cur[:, 1:], np.minimum(kept, prev[:, :-1] + 1))
        prev = np.minimum(np.minimum.accumulate(cur - cols, axis=1) + cols, big)
        if step + 1 >= MIN_WORDS // 2:
            # no start can still come within its allowance: give up
            ok = prev.min(axis=1) * PER_EDIT <= MAX_WORDS
            if not ok.any():
                return False
            starts, prev = starts[ok], prev[ok]
    return False


def cut_words(texts: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of a batch of documents one after the other, their offsets, and the words."""
    local: dict[str, int] = {}
    number = local.setdefault
    lists = [words(t) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.fromiter((number(x, len(local)) for ws in lists for x in ws), np.int32, int(off[-1]))
    return flat, off, list(local)


def near_windows(index: SimIndex, w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, item, place in it) of window pairs within the radius and alike by weighted words."""
    none = (np.zeros(0, np.int64),) * 4
    if len(w) < MIN_WORDS or not len(index.prints):
        return none
    f = fingerprints(w, index.vectors)
    known = np.concatenate([[0], np.cumsum(w > 0)])
    at = np.flatnonzero(known[MIN_WORDS:] - known[:-MIN_WORDS] >= LEAST_KNOWN)
    d = np.searchsorted(off, at, "right") - 1
    inside = at + MIN_WORDS <= off[d + 1]
    at, d = at[inside], d[inside]
    f = f[at]
    left, right = [], []
    for (shift, bits), (first, entry) in zip(BIT_BLOCKS, index.tables):
        key = ((f >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        n = (first[key + 1] - first[key]).astype(np.int64)
        a = np.repeat(np.arange(len(f)), n)
        b = entry[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[key].astype(np.int64), n)]
        ok = np.bitwise_count(f[a] ^ index.prints[b]) <= RADIUS
        left.append(a[ok])
        right.append(b[ok].astype(np.int64))
    pair = np.unique(np.concatenate(left) * len(index.prints) + np.concatenate(right))
    a, b = pair // len(index.prints), pair % len(index.prints)
    n = index.first_of[b + 1] - index.first_of[b]
    b = index.of_print[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first_of[b], n)]
    a = np.repeat(a, n)
    keep = np.zeros(len(a), bool)
    span = np.arange(MIN_WORDS)
    for lo in range(0, len(a), 16384):
        x, y = w[at[a[lo : lo + 16384], None] + span], index.flat[index.win_flat[b[lo : lo + 16384], None] + span]
        weight = index.weight[y[:, 1:]] + index.weight[y[:, :-1]]
        x = np.where((x[:, 1:] > 0) & (x[:, :-1] > 0), x[:, 1:] * index.size + x[:, :-1], -1)
        y = y[:, 1:] * index.size + y[:, :-1]
        there = (x[:, None, :] == y[:, :, None]).any(axis=2)
        keep[lo : lo + 16384] = (weight * there).sum(axis=1) >= SIMILARITY * weight.sum(axis=1)
    a, b = a[keep], b[keep]
    return d[a], at[a] - off[d[a]], index.win_item[b], index.win_pos[b]


def shared_runs(index: ItemIndex, w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, item, place in it) of all shared 4-word runs: exhaustive candidates."""
    none = (np.zeros(0, np.int64),) * 4
    if len(w) < RUN or not len(index.code):
        return none
    live = np.flatnonzero((w[:-3] > 0) & (w[1:-2] > 0) & (w[2:-1] > 0) & (w[3:] > 0))
    d = np.searchsorted(off, live, "right") - 1
    inside = live + RUN <= off[d + 1]
    live, d = live[inside], d[inside]
    code = run_codes(w)[live]
    c = np.minimum(np.searchsorted(index.code, code), len(index.code) - 1)
    good = index.code[c] == code
    d, p, c = d[good], live[good] - off[d[good]], c[good]
    n = index.first[c + 1] - index.first[c]
    src = np.repeat(index.first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(d, n), np.repeat(p, n), index.item[src].astype(np.int64), index.at[src].astype(np.int64)


def _search(index: ItemIndex, doc_ids: list, texts: list, exhaustive: bool = False) -> tuple[list, list]:
    """(doc, item) pairs of a batch of documents."""
    return _search_words(index, doc_ids, *cut_words(texts), exhaustive)


def _search_words(index: ItemIndex, doc_ids: list, flat: np.ndarray, off: np.ndarray, vocab: list[str], exhaustive: bool = False) -> tuple[list, list]:
    known = index.vocab.get
    w = np.fromiter((known(x, 0) for x in vocab), np.int64, len(vocab))[flat]
    d, p, item, q = shared_runs(index, w, off) if exhaustive else near_windows(index, w, off)
    if not len(d):
        return [], []
    doc_words = [w[a:b] for a, b in zip(off[:-1], off[1:])]
    size = RUN if exhaustive else MIN_WORDS
    # bands: candidates of one (document, item) on near diagonals and near each other
    reach = MAX_WORDS + MAX_WORDS // PER_EDIT
    drift = MAX_WORDS // PER_EDIT + 1
    diag = p - q
    o = np.lexsort((diag, item, d))
    d, p, item, q, diag = d[o], p[o], item[o], q[o], diag[o]
    band = np.cumsum(np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (np.diff(diag) > drift)])
    o = np.lexsort((p, band))
    d, p, item, q, band = d[o], p[o], item[o], q[o], band[o]
    band = np.cumsum(np.r_[True, (band[1:] != band[:-1]) | (np.diff(p) > reach)]) - 1
    # item words covered in a band
    o = np.lexsort((q, band))
    bq, qq = band[o], q[o]
    step = np.full(len(bq), size)
    step[:-1] = np.where(bq[1:] == bq[:-1], np.minimum(np.diff(qq), size), size)
    cover = np.bincount(bq, weights=step)
    first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    p_lo, p_hi = p[first], np.maximum.reduceat(p, first) + size
    q_lo, q_hi = np.minimum.reduceat(q, first), np.maximum.reduceat(q, first) + size
    done = set()
    for g in np.flatnonzero(cover >= LEAST_COVER):
        k, i = int(d[first[g]]), int(item[first[g]])
        if (k, i) not in done and leaks(doc_words[k], index.words[i], int(p_lo[g]) - reach, int(p_hi[g]) + reach, int(q_lo[g]) - MAX_WORDS, int(q_hi[g]) + 1):
            done.add((k, i))
    return [doc_ids[k] for k, _ in done], [int(index.ids[i]) for _, i in done]


def pack_items(rows: list[tuple[int, str]]) -> list[bytes]:
    """Items in blocks of about BLOCK_CHARS characters, compressed; an item is never cut."""
    blocks, held, size = [], [], 0
    for i, t in rows:
        if held and size + len(t) > BLOCK_CHARS:
            blocks.append(held)
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    return [zlib.compress(pickle.dumps(b)) for b in [*blocks, held] if b]


def unpack_items(block: bytes) -> list[tuple[int, str]]:
    return pickle.loads(zlib.decompress(block))


#: The index that this worker used last: with one block it is made once a worker.
_LAST: dict[tuple, ItemIndex] = {}


def _index(blocks: list[bytes], n: int, exhaustive: bool) -> ItemIndex:
    key = (len(blocks), hash(blocks[n]), exhaustive)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = (ItemIndex if exhaustive else SimIndex)(unpack_items(blocks[n]))
    return _LAST[key]


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", exhaustive: bool = False) -> DataFrame:
    """doc_id, item_id of every document that leaks an item, once each.

    Case, punctuation, spacing, line breaks, hidden characters, markup and character form
    don't count. Items that share a passage are each reported. Null and empty texts, texts
    under 20 words, null ids and empty tables give no rows.
    """
    spark = docs.sparkSession
    it = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null")
    chars = it.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // GROUP_CHARS))
    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null and length(t) >= 20")
    out = None
    for g in range(groups):
        part = it.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()  # about GROUP_CHARS at most
        packed = pack_items([(r["item_id"], r["t"]) for r in part])
        if not packed:
            continue
        blocks = spark.sparkContext.broadcast(packed)

        def run(batches, blocks=blocks):
            held, size = [], 0

            def search():
                for n in range(len(blocks.value)):
                    index = _index(blocks.value, n, exhaustive)
                    for ids, *cut in held if len(index.code) else ():
                        d, i = _search_words(index, ids, *cut, exhaustive)
                        if d:
                            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["doc_id", "item_id"])

            for x in batches:
                for lo in range(0, x.num_rows, 512):
                    y = x.slice(lo, 512)
                    held.append((y.column(0).to_pylist(), *cut_words(y.column(1).to_pylist())))
                    size += len(held[-1][1])
                    if size >= HELD_WORDS or len(blocks.value) == 1:  # nothing is gained by holding words for a single block
                        yield from search()
                        held, size = [], 0
            yield from search()

        found = src.mapInArrow(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long") if out is None else out.distinct()


def recall(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: pairs found, pairs found by exhaustive candidates, and the share of the latter that is found."""
    a = leaked_items(docs, items).withColumn("a", F.lit(1))
    b = leaked_items(docs, items, exhaustive=True).withColumn("b", F.lit(1))
    n = a.join(b, ["doc_id", "item_id"], "full").agg(F.count("a").alias("n_found"), F.count("b").alias("n_exhaustive"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    return n.select("n_found", "n_exhaustive", F.when(F.col("n_exhaustive") > 0, F.col("both") / F.col("n_exhaustive")).otherwise(F.lit(1.0)).alias("recall"))
