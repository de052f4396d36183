"""Problem 2: frequency of every distinct value, from vertical record bitmaps.

Vertical layout: per term one bitmap over record ids, compressed by storing only its
non-empty 64-bit words, with an occurrence counter beside each word. Words merge by union
(``bit_or``) and counters by addition, both inside whole-stage code generation and combined
on the map side; document frequency is the cardinality (``bit_count``) of the merged words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_words(df: DataFrame, term: str, record: str) -> DataFrame:
    """Bitmap words per term: val, word (record id div 64), bits, n. Null terms are left out.

    A null record gives a null word with no bits, so it counts as an occurrence only.
    """
    t = df.select(F.col(term).cast("long").alias("val"), F.col(record).cast("long").alias("rec"))
    bit = F.expr("shiftleft(1L, cast(rec & 63 as int))")
    return (
        t.where("val is not null")
        .groupBy("val", F.expr("shiftright(rec, 6)").alias("word"))
        .agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    )


def term_frequencies(tables: dict[str, tuple[DataFrame, str, str]], rare: int = 1, common: int = 20) -> DataFrame:
    """Occurrences and record frequency of every distinct value.

    ``tables`` maps a field name to (table, term column, record column). Output:
    field_name, val, n_rows, n_records, mark; mark is ``rare`` if the value is in at most
    ``rare`` (and at least one) distinct records, ``common`` if in more than ``common``,
    else null. Repeated rows count as occurrences, once per record as records. Null terms
    have no result; empty tables give no rows.
    """
    words = []
    for name, (df, term, rec) in tables.items():
        words.append(term_words(df, term, rec).select(F.lit(name).alias("field_name"), "val", "bits", "n"))
    both = reduce(DataFrame.unionByName, words)
    n = both.groupBy("field_name", "val").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n_records")
    )
    mark = F.when((F.col("n_records") <= rare) & (F.col("n_records") > 0), F.lit("rare")).when(F.col("n_records") > common, F.lit("common"))
    return n.select("field_name", "val", "n_rows", "n_records", mark.alias("mark"))
