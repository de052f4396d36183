"""Problem 5: consolidating pairwise matches into groups.

The giant component is peeled first: breadth-first from the vertex of highest degree, one
frontier join a round, its vertices then anti-joined away. The components left are labelled
by minimum propagation with contraction: each vertex hangs itself under its smallest
neighbour, edges are rewritten to the labels, and rounds end when no edge is left, after about
log(diameter) of them. Vertices, edges and labels stay in tables; only counts reach the driver.
Edges of hub vertices meet their (bounded) labels by broadcast, all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import contract, relabel
from ..operators.skew import hot_keys, join_unique
from ..scratch import Scratch

#: Breadth-first rounds before the rest of a long component is left to the contraction.
MAX_FRONTIERS = 30


def link_groups(pairs: DataFrame, a: str, b: str, max_frontiers: int = MAX_FRONTIERS) -> DataFrame:
    """group_id, rid for every record in a group of two or more; group_id is the smallest record of the group.

    Rows with a null on either side and rows that link a record to itself link nothing;
    repeated and reversed pairs count once. No links give no rows.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    once = pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), x.isNotNull().alias("p"), y.isNotNull().alias("q")).where("p and q and u <> v").select("u", "v").distinct()
    both, both_path = scratch.write(once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    degrees = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    top = degrees.orderBy(F.desc("d"), "u").first()
    if top is None:
        return spark.createDataFrame([], "group_id long, rid long")
    n_edges = both.count()
    hubs = hot_keys(both, "u", n_edges)

    # breadth-first from the vertex of highest degree; each frontier is written once and never again
    frontier, path = scratch.write(spark.createDataFrame([(top["u"],)], "u long"), "frontier")
    paths, schema, complete = [path], frontier.schema, False
    for _ in range(max_frontiers):
        reached = join_unique(both, frontier, "u", hubs, "left_semi").select(F.col("v").alias("u")).distinct()
        frontier, path = scratch.write(reached.join(scratch.union(paths, schema), "u", "left_anti"), "frontier")
        if frontier.isEmpty():
            complete = True
            break
        paths.append(path)
    seen = scratch.union(paths, schema)
    low = seen.agg(F.min("u")).first()[0]
    giant = seen.select(F.lit(low).cast("long").alias("group_id"), F.col("u").alias("rid"))

    if complete:
        # whole components leave, so one side of an edge decides for both
        rest = join_unique(both, seen, "u", hubs, "left_anti").where("u < v")
    else:
        # what was reached so far becomes one vertex and its remaining edges stay
        tag = seen.select("u", F.lit(low).cast("long").alias("to"))
        rest = relabel(both.where("u < v"), tag, hubs)
    labels = contract(rest, scratch, n_edges)
    if complete:
        return giant.unionByName(labels)
    # the contracted vertex may have found a smaller label
    head = labels.where(F.col("rid") == low).select("group_id").first()
    giant = seen.select(F.lit(head[0] if head else low).cast("long").alias("group_id"), F.col("u").alias("rid"))
    return giant.unionByName(labels.where(F.col("rid") != low))
