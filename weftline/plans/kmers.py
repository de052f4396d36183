"""k-mer, minimizer and seed queries (KMR, SEED, AGG-01 to AGG-07)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..kernels import peaks
from ..operators import kmers as K
from ..options import Options
from .common import OVERLAPS, READS, RUNS, SEEDS, Registry, overlaps, reads, runs, seeds, table
from .scalar import _sql_hash64

q = Registry()
KLEN = 21
MAX_OCC = 30  # SEED-06 only: buckets of which all pairs are made
HOM = 20
HIGH = round(HOM * Options().high_factor)  # places of a key that the index keeps: the coverage peak times the factor of the options

_ALL = f"""{READS}, kmers AS (SELECT rid, pos, k, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (
SELECT rid, pos::INTEGER AS pos, substr(seq, pos::INTEGER + 1, {KLEN}) AS k FROM (SELECT rid, seq, unnest(range(0, greatest(len - {KLEN - 1}, 0))) AS pos FROM reads)) WHERE NOT regexp_matches(k, '[^ACGT]'))"""
_COUNTS = f"{_ALL}, counts AS (SELECT kmer, least(count(*), 4095)::BIGINT AS cnt FROM kmers GROUP BY kmer)"


def counts(spark, d):
    return K.kmer_counts(reads(spark, d), KLEN)


def named(t):
    return t.withColumn("kmer", K.decode(F.col("code"), KLEN)).drop("code")


@q(f"WITH {_ALL} SELECT rid, count(*)::BIGINT AS n_kmers, count(DISTINCT kmer)::BIGINT AS n_distinct, count_if(k > kmer)::BIGINT AS n_rev FROM kmers GROUP BY rid")
def kmr01_enumerate(spark, d):
    p = K.kmer_positions(reads(spark, d), KLEN)
    return p.groupBy("rid").agg(F.count(F.lit(1)).alias("n_kmers"), F.countDistinct("code").alias("n_distinct"), F.sum("rev").alias("n_rev"))


@q(f"WITH {_COUNTS} SELECT * FROM counts")
def agg01_kmer_count(spark, d):
    return named(counts(spark, d)).select("kmer", "cnt")


_LONG = Options().k


@q(f"WITH {READS} SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, least(count(*), 4095)::BIGINT AS cnt FROM (SELECT substr(seq, pos::INTEGER + 1, {_LONG}) AS k FROM (SELECT seq, unnest(range(0, greatest(len - {_LONG - 1}, 0))) AS pos FROM reads)) WHERE NOT regexp_matches(k, '[^ACGT]') GROUP BY 1")
def agg01_long_kmers(spark, d):
    """Counts at the default length of the options (51)."""
    t = K.long_kmer_counts(reads(spark, d), _LONG)
    return t.select(K.decode_long(F.col("hi"), F.col("lo"), _LONG).alias("kmer"), "cnt")


@q(f"WITH {_COUNTS} SELECT kmer, cnt FROM counts WHERE cnt >= 2")
def kmr02_repeated(spark, d):
    return named(counts(spark, d).where("cnt >= 2")).select("kmer", "cnt")


@q(f"WITH {_COUNTS} SELECT cnt::INTEGER AS cnt, count(*)::BIGINT AS n FROM counts GROUP BY 1")
def agg03_histogram(spark, d):
    return K.histogram(counts(spark, d))


@q(f"WITH {_COUNTS} SELECT kmer, cnt FROM counts WHERE cnt BETWEEN 5 AND 20")
def agg04_shrink(spark, d):
    return named(counts(spark, d).where("cnt between 5 and 20")).select("kmer", "cnt")


@q(f"WITH {_COUNTS} SELECT kmer, cnt, CASE WHEN cnt > 24 THEN 'drop' ELSE 'rescue' END AS cls FROM counts WHERE cnt >= 15")
def agg05_filter_table(spark, d):
    return named(K.filter_table(counts(spark, d), 15, 24)).select("kmer", "cnt", "cls")


@q(f"WITH {_ALL}, {RUNS}, keys AS (SELECT DISTINCT kmer FROM kmers JOIN runs USING (rid) WHERE place = 1) SELECT kmer, count(*)::BIGINT AS n FROM kmers SEMI JOIN keys USING (kmer) GROUP BY kmer")
def agg02_recount(spark, d):
    """Counts over all records of the k-mers known from the largest run."""
    r = reads(spark, d)
    known = K.kmer_counts(r.join(runs(spark, d).where("place = 1"), "rid", "left_semi"), KLEN).select("code")
    n = K.kmer_counts(r, KLEN, saturate=1 << 60).withColumnRenamed("cnt", "n")
    return named(n.join(known, "code", "left_semi")).select("kmer", "n")


@q(f"WITH {_ALL}, b AS (SELECT kmer, list(rid * 134217728 + pos ORDER BY rid, pos) AS places FROM kmers GROUP BY kmer HAVING count(*) BETWEEN 2 AND {HIGH}) SELECT kmer, len(places)::INTEGER AS n, places[1]::BIGINT AS first_place, places[-1]::BIGINT AS last_place FROM b")
def agg06_position_index(spark, d):
    """The position index, without k-mers seen once or above the frequency rule; a place is record and position in one number."""
    p = K.kmer_positions(reads(spark, d), KLEN)
    few = p.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(f"n between 2 and {HIGH}")
    p = p.join(few, "code").withColumn("place", F.col("rid") * 134217728 + F.col("pos"))
    b = p.groupBy("code").agg(F.sort_array(F.collect_list("place")).alias("places"))
    t = b.select("code", F.size("places").alias("n"), F.element_at("places", 1).alias("first_place"), F.element_at("places", -1).alias("last_place"))
    return named(t).select("kmer", "n", "first_place", "last_place")


_PEAKS = f"""{_COUNTS}, hist AS (SELECT cnt, count(*) AS n FROM counts GROUP BY cnt), d AS MATERIALIZED (SELECT i, coalesce(n, 0) AS h, lag(coalesce(n, 0)) OVER (ORDER BY i) AS a, lead(coalesce(n, 0), 1, 0) OVER (ORDER BY i) AS b FROM (SELECT unnest(range(0, (SELECT max(cnt) + 1 FROM counts))) AS i) LEFT JOIN hist ON cnt = i),
t AS (SELECT min(i) AS t FROM d WHERE i >= 5 AND b > h), m AS (SELECT i AS m, h AS mh FROM d, t WHERE i > t ORDER BY h DESC, i LIMIT 1), loc AS (SELECT i, h FROM d WHERE h > 0 AND h >= a AND h >= b),
l AS (SELECT i, h FROM loc, t, m WHERE i > t AND i < m ORDER BY h DESC, i DESC LIMIT 1), r AS (SELECT i, h FROM loc, m WHERE i > m ORDER BY h DESC, i LIMIT 1),
lo AS (SELECT i FROM l, m WHERE h >= 0.05 * mh AND (SELECT min(d.h) FROM d WHERE d.i BETWEEN l.i AND m.m) < 0.95 * h), hi AS (SELECT i FROM r, m WHERE i <= 2.5 * m AND h >= 0.05 * mh AND (SELECT min(d.h) FROM d WHERE d.i BETWEEN m.m AND r.i) < 0.95 * h)"""


@q(f"WITH {_PEAKS} SELECT coalesce(t, -1)::INTEGER AS trough, (CASE WHEN t IS NULL THEN -1 ELSE coalesce((SELECT i FROM hi), (SELECT m FROM m)) END)::INTEGER AS hom, (CASE WHEN t IS NULL THEN -1 WHEN EXISTS (SELECT 1 FROM hi) THEN (SELECT m FROM m) ELSE coalesce((SELECT i FROM lo), -1) END)::INTEGER AS het FROM t")
def agg07_peaks(spark, d):
    """Peaks of the k-mer histogram; the histogram has at most 4,095 rows, which is what reaches the driver."""
    hist = {r["cnt"]: r["n"] for r in agg03_histogram(spark, d).collect()}
    p = peaks.find_peaks(hist)
    return spark.createDataFrame([(p.trough, p.hom, p.het)], "trough int, hom int, het int")


_W = 10
_CODE = f"list_sum(list_transform(range(0, {KLEN}), lambda i: (instr('ACGT', kmer[i + 1]) - 1)::BIGINT * (1::BIGINT << (2 * ({KLEN - 1} - i)))))"
_HASHED = f"""{_ALL}, coded AS (SELECT kmer, ({_CODE})::BIGINT AS code FROM (SELECT DISTINCT kmer FROM kmers)), hashed AS ({_sql_hash64('code', 'coded', 2 * KLEN)}),
runs AS (SELECT rid, pos, kmer, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS run, k > kmer AS rev, k = reverse(translate(k, 'ACGT', 'TGCA')) AS own FROM kmers),
keyed AS (SELECT r.*, CASE WHEN own THEN NULL ELSE h.k END AS h, count(*) OVER (PARTITION BY rid, run) AS run_n FROM runs r JOIN hashed h USING (kmer)),
wins AS (SELECT *, min(h) OVER (PARTITION BY rid, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS m, count(*) OVER (PARTITION BY rid, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS m_n FROM keyed),
mins AS (SELECT rid, run, pos, m FROM wins WHERE m_n = least({_W}, run_n) AND m IS NOT NULL),
mz AS (SELECT DISTINCT k.rid, k.pos, k.h, k.rev::INTEGER AS rev, k.kmer FROM keyed k JOIN mins w ON k.rid = w.rid AND k.run = w.run AND k.h = w.m AND k.pos BETWEEN w.pos AND w.pos + {_W - 1})"""


@q(f"WITH {_HASHED} SELECT rid, pos, h, rev FROM mz")
def kmr03_minimizers(spark, d):
    return K.minimizers(reads(spark, d), KLEN, _W).select("rid", "pos", "h", "rev")


_MZC = "mzc AS (SELECT DISTINCT rid, pos, x, rev, span FROM minimizers WHERE x IS NOT NULL AND rid IS NOT NULL), occ AS (SELECT x, count(*)::BIGINT AS cnt FROM mzc GROUP BY x)"


def placed(spark, d):
    return table(spark, d, "minimizers").where("x is not null and rid is not null").select("rid", "pos", "x", "rev", "span").distinct()


def occurrences(mz):
    return mz.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))


@q(f"""WITH {_MZC}, p AS (SELECT rid, pos, min(cnt) AS cnt FROM mzc JOIN occ USING (x) GROUP BY rid, pos), h AS (SELECT *, cnt >= 50 AS hot FROM p),
e AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS streak FROM (SELECT *, lag(hot) OVER (PARTITION BY rid ORDER BY pos) AS before FROM h)),
r AS (SELECT *, least(16, round((max(pos) OVER s - min(pos) OVER s) / 100.0)) AS n_keep, row_number() OVER (PARTITION BY rid, streak, hot ORDER BY cnt, pos) AS rank FROM e WINDOW s AS (PARTITION BY rid, streak, hot))
SELECT rid, pos, cnt, hot FROM r WHERE NOT hot OR rank <= n_keep""")
def kmr04_rescue(spark, d):
    mz = placed(spark, d)
    p = mz.join(occurrences(mz), "x").groupBy("rid", "pos").agg(F.min("cnt").alias("cnt"))
    return K.rescue_frequent(p, 50, gap=100)


@q(f"WITH {SEEDS} SELECT qid, tid, count(*)::BIGINT AS n_seeds, count_if(rev = 1)::BIGINT AS n_rev, sum(CASE WHEN cnt > 6 AND cnt < 33 THEN 1 WHEN cnt <= 6 THEN 2 ELSE floor(pow(1 + ceil(cnt / 66.0), 1.1)) END)::BIGINT AS weight FROM seeds WHERE cnt IS NOT NULL GROUP BY qid, tid")
def seed01_seed_weight(spark, d):
    s = seeds(spark, d).where("cnt is not null").withColumn("wt", S.seed_weight(F.col("cnt"), HOM))
    return s.groupBy("qid", "tid").agg(F.count(F.lit(1)).alias("n_seeds"), F.sum(F.col("rev").cast("long")).alias("n_rev"), F.sum("wt").cast("long").alias("weight"))


def _hits_sql(most: int) -> str:
    return f"""{_MZC}, few AS (SELECT x FROM occ WHERE cnt BETWEEN 2 AND {most}), sel AS (SELECT * FROM mzc SEMI JOIN few USING (x)),
hits AS (SELECT a.rid AS qid, b.rid AS tid, (a.rev <> b.rev)::INTEGER AS rev, a.pos AS qpos, b.pos AS tpos, a.x FROM sel a JOIN sel b ON a.x = b.x AND a.rid < b.rid)"""


_HITS = _hits_sql(HIGH)


def seed_hits(spark, d, most=HIGH):
    """Pairs of records sharing a minimizer seen 2 to ``most`` times: at most that many partners a row."""
    mz = placed(spark, d)
    few = occurrences(mz).where(f"cnt between 2 and {most}").select("x")
    sel = mz.join(few, "x", "left_semi")
    a = sel.select("x", F.col("rid").alias("qid"), F.col("pos").alias("qpos"), F.col("rev").alias("r1"))
    b = sel.select("x", F.col("rid").alias("tid"), F.col("pos").alias("tpos"), F.col("rev").alias("r2"))
    return a.join(b, "x").where("qid < tid").select("qid", "tid", (F.col("r1") != F.col("r2")).cast("int").alias("rev"), "qpos", "tpos", "x")


@q(f"WITH {_hits_sql(MAX_OCC)} SELECT qid, tid, rev, count(*)::BIGINT AS n, min(qpos) AS q_lo, max(qpos) AS q_hi FROM hits GROUP BY qid, tid, rev")
def seed06_bucket_pairs(spark, d):
    return seed_hits(spark, d, MAX_OCC).groupBy("qid", "tid", "rev").agg(F.count(F.lit(1)).alias("n"), F.min("qpos").alias("q_lo"), F.max("qpos").alias("q_hi"))


@q(f"WITH {_MZC}, {OVERLAPS}, known AS (SELECT DISTINCT least(qn, tn) AS qid, greatest(qn, tn) AS tid FROM ovl WHERE qn <> tn) SELECT k.qid, k.tid, (a.rev <> b.rev)::INTEGER AS rev, a.pos AS qpos, b.pos AS tpos, a.x FROM known k JOIN mzc a ON a.rid = k.qid JOIN mzc b ON b.rid = k.tid AND b.x = a.x")
def seed03_reseed(spark, d):
    """All seeds of known pairs, frequent ones too: records bring their minimizers to their pairs, so no bucket of a minimizer is squared."""
    known = overlaps(spark, d).where("qn <> tn").select(F.least("qn", "tn").alias("qid"), F.greatest("qn", "tn").alias("tid")).distinct()
    mz = placed(spark, d)
    a = known.join(mz.select(F.col("rid").alias("qid"), "x", F.col("pos").alias("qpos"), F.col("rev").alias("r1")), "qid")
    b = mz.select(F.col("rid").alias("tid"), "x", F.col("pos").alias("tpos"), F.col("rev").alias("r2"))
    return a.join(b, ["tid", "x"]).select("qid", "tid", (F.col("r1") != F.col("r2")).cast("int").alias("rev"), "qpos", "tpos", "x")


@q(f"WITH {_HITS} SELECT qid, tid, rev, n, n_distinct FROM (SELECT qid, tid, rev, count(*)::BIGINT AS n, count(DISTINCT x)::BIGINT AS n_distinct, max(count(*)) OVER (PARTITION BY qid, tid) AS best FROM hits GROUP BY qid, tid, rev) WHERE n_distinct >= 2 AND n = best")
def seed04_candidates(spark, d):
    """Candidate pairs: at least two distinct shared minimizers, on the strand that has the most."""
    p = seed_hits(spark, d).groupBy("qid", "tid", "rev").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("n_distinct"))
    best = F.max("n").over(Window.partitionBy("qid", "tid"))
    return p.withColumn("best", best).where("n_distinct >= 2 and n = best").drop("best")


QUERIES, SQL = q.queries, q.sql
