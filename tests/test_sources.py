import gzip

import pytest

from weftline.options import Options, parse_size, read_list
from weftline.sources import checkpoints, fastx, sinks
from weftline.streaming import ingest


def test_fasta_and_fastq_in_ranges(spark, tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(200)]
    (tmp_path / "a.fa").write_text("".join(f">{n} c{i}\n{s[:5]}\n{s[5:]}\n" for i, (n, s) in enumerate(want)))
    (tmp_path / "b.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in want))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in want))
    for name in ("a.fa", "b.fq", "c.fq.gz"):
        for size in (64 << 20, 700, 97):
            got = fastx.read_fastx(spark, str(tmp_path / name), split_bytes=size).orderBy("rid").collect()
            assert [(r["name"], r["seq"]) for r in got] == want, (name, size)
            assert [r["rid"] for r in got] == list(range(200))
    cut = fastx.read_fastx(spark, str(tmp_path / "b.fq"), adapter=2, min_len=8, min_mean_quality=31)
    assert {r["seq"] for r in cut.collect()} == {("ACGT" * k)[2:-2] for k in range(3, 8)}
    assert fastx.read_fastx(spark, str(tmp_path / "c.fq.gz"), min_mean_quality=41).count() == 0


def test_runs_mates_and_stages(spark, tmp_path):
    a = spark.createDataFrame([(0, "a", "AC"), (1, "b", "GT")], "rid long, name string, seq string")
    both = fastx.append_runs(a, a)
    assert sorted(r["rid"] for r in both.collect()) == [0, 1, 2, 3]
    assert fastx.paired(a, a).count() == 2
    with pytest.raises(ValueError):
        fastx.paired(a, both)
    checkpoints.save(a, str(tmp_path / "st"), adapter_len=0)
    assert checkpoints.load(spark, str(tmp_path / "st"), adapter_len=0).count() == 2
    with pytest.raises(ValueError):
        checkpoints.load(spark, str(tmp_path / "st"), adapter_len=5)
    keys = spark.createDataFrame([(1,), (2,), (3,)], "code long")
    counts = spark.createDataFrame([(1, 4095), (2, 7)], "code long, cnt long")
    assert {r["code"]: r["cnt"] for r in checkpoints.lookup(keys, counts, 4095).collect()} == {1: -1, 2: 7, 3: 0}


def test_fasta_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", None)], "name string, seq string, qual string")
    sinks.write_text(sinks.fasta(r), str(tmp_path / "o"))
    got = spark.read.text(str(tmp_path / "o"))
    assert sorted(x[0] for x in got.collect()) == sorted([">a", "ACGT", ">b", "GG"])
    assert [x[0] for x in sinks.fastq(r).collect()] == ["@a\nACGT\n+\nHHHH", "@b\nGG\n+\nHH"]


def test_options():
    assert parse_size("3g") == 3 * 10**9 and parse_size("1.5M") == 1_500_000 and parse_size("12") == -2
    assert read_list("a,b,,c") == ["a", "b", "c"]
    assert Options.of(k=31).k == 31 and Options().max_chains_for(200) == 1000 and Options().max_chains_for(1) == 100
    for bad in ({"k": 0}, {"k": 64}, {"min_drop": 0.9}, {"nonsense": 1}, {"min_cnt": 9}, {"purge_level": 4}):
        with pytest.raises(ValueError):
            Options.of(**bad)


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from weftline.operators.kmers import kmer_counts

    df = spark.createDataFrame([(i, "ACGTTGCAAC" * (i % 3 + 1)) for i in range(30)], "rid long, seq string")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    s = ingest.stream(spark, str(tmp_path / "in"), df.schema, 2)
    q = ingest.count_into(s, 5, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r["code"], r["cnt"]) for r in ingest.totals(spark, str(tmp_path / "out"), 4095).collect()}
    assert got == {(r["code"], r["cnt"]) for r in kmer_counts(df, 5).collect()}


def test_streamed_windows(spark, tmp_path):
    df = spark.sql("select id as rid, timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 600) as at, 'r' || (id % 2) as run from range(12)")
    df = df.unionByName(df.where("rid < 3"))
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.stream(spark, str(tmp_path / "in"), df.schema)
    q = ingest.first_deliveries(s, ["rid"], "at").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 12
    q = ingest.arrivals(s, "at", "run").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").agg({"n": "sum"}).first()[0] == 15
