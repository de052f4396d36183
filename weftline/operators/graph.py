"""String-graph operators as joins and driver loops whose state lives in written tables.

An arc table has u, v (record * 2 + strand), len and ol; the mirror of u -> v is v^1 -> u^1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import hot_keys, join_unique

c = F.col


def flip(node: Column) -> Column:
    """The other strand of a node."""
    return node.bitwiseXOR(F.lit(1).cast("long"))


def distinct_arcs(arcs: DataFrame) -> DataFrame:
    """One arc per (u, v): the longest overlap, then the shorter arc."""
    best = F.max_by(F.struct("len", "ol"), F.struct("ol", -c("len"))).alias("b")
    return arcs.groupBy("u", "v").agg(best).select("u", "v", "b.len", "b.ol")


def without(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs less those in ``gone`` (u, v) and their mirrors."""
    both = gone.select("u", "v").unionByName(gone.select(flip(c("v")).alias("u"), flip(c("u")).alias("v"))).distinct()
    return arcs.join(both, ["u", "v"], "left_anti")


def degrees(arcs: DataFrame) -> DataFrame:
    """node, n_out, n_in (0 where there is none)."""
    t = arcs.select(c("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(arcs.select(c("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return t.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def reducible(arcs: DataFrame, fuzz: int) -> DataFrame:
    """(u, v) of arcs that a path of two arcs replaces to within ``fuzz`` letters."""
    a = arcs.select("u", c("v").alias("m"), c("len").alias("l1"))
    b = arcs.select(c("u").alias("m"), "v", c("len").alias("l2"))
    two = a.join(b, "m").where("u <> v").groupBy("u", "v").agg(F.min(c("l1") + c("l2")).alias("by"))
    return arcs.join(two, ["u", "v"]).where(c("by") <= c("len") + fuzz).select("u", "v")


def tips(arcs: DataFrame, longest: int = 3) -> DataFrame:
    """Nodes (both strands) on dead ends of at most ``longest`` nodes that hang on a branching node.

    One bounded walk: from every node without incoming arcs along single outgoing arcs until a
    node with another way in is met. Repeated by the caller until nothing is found.
    """
    deg = degrees(arcs)
    walk = deg.where("n_in = 0 and n_out = 1").select(c("node").alias("head"), c("node").alias("at"), F.array("node").alias("path"))
    found = None
    for step in range(longest):
        nxt = walk.join(arcs.select(c("u").alias("at"), c("v").alias("to")), "at").join(deg.select(c("node").alias("to"), "n_in", "n_out"), "to")
        hit = nxt.where("n_in > 1").select("head", F.explode("path").alias("node"))
        found = hit if found is None else found.unionByName(hit)
        walk = nxt.where("n_in = 1 and n_out = 1").select("head", c("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    t = found.select("node").distinct()
    return t.unionByName(t.select(flip(c("node")).alias("node"))).distinct()


def drop_nodes(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return arcs.join(n.withColumnRenamed("node", "u"), "u", "left_anti").join(n.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v", "len", "ol")


def clean_tips(arcs: DataFrame, longest: int = 3) -> DataFrame:
    """Arcs after removing tips until there are none; every round but the last takes nodes away, so this ends."""
    scratch = Scratch(arcs.sparkSession, "tips")
    arcs, path = scratch.write(arcs, "arcs")
    while True:
        t, gone = scratch.write(tips(arcs, longest), "gone")
        if t.isEmpty():
            return arcs
        arcs, new = scratch.write(drop_nodes(arcs, t), "arcs")
        scratch.drop(path)
        scratch.drop(gone)
        path = new


def weak_arcs(arcs: DataFrame, ratio: float) -> DataFrame:
    """(u, v) of arcs with an overlap under ``ratio`` of the best at both their ends (one set-based round)."""
    best = F.max("ol").over(Window.partitionBy("u"))
    back = F.max("ol").over(Window.partitionBy("v"))
    return arcs.withColumn("b", best).withColumn("r", back).where((c("ol") < ratio * c("b")) & (c("ol") < ratio * c("r"))).select("u", "v")


def simple_bubbles(arcs: DataFrame) -> DataFrame:
    """source, sink, a, b: two inner nodes with one way in and one way out between the same ends (a < b)."""
    deg = degrees(arcs)
    inner = deg.where("n_in = 1 and n_out = 1").select(c("node").alias("m"))
    i = arcs.select(c("u").alias("source"), c("v").alias("m")).join(inner, "m").join(arcs.select(c("u").alias("m"), c("v").alias("sink")), "m")
    x, y = i.select("source", "sink", c("m").alias("a")), i.select("source", "sink", c("m").alias("b"))
    return x.join(y, ["source", "sink"]).where("a < b")


def unitigs(arcs: DataFrame) -> DataFrame:
    """head, tail, n_nodes, len of every maximal path without branches, by pointer jumping in log rounds.

    len adds the arc lengths of the path. Circles have no head and are left out (``circles``).
    """
    spark = arcs.sparkSession
    scratch = Scratch(spark, "unitigs")
    arcs = scratch.table(arcs, "arcs")
    deg = scratch.table(degrees(arcs), "degrees")
    one_out, one_in = deg.where("n_out = 1").select(c("node").alias("u")), deg.where("n_in = 1").select(c("node").alias("v"))
    link = arcs.join(one_out, "u").join(one_in, "v").where("u <> v").select("u", "v", "len")
    link = scratch.table(link, "link")
    nodes = deg.select("node")
    # jump: node -> the furthest node known ahead, nodes and letters passed
    ahead = nodes.join(link.select(c("u").alias("node"), c("v").alias("to"), c("len").cast("long").alias("len")), "node", "left")
    ahead = scratch.table(ahead.select("node", "to", F.when(c("to").isNotNull(), 1).otherwise(0).alias("n"), F.coalesce("len", F.lit(0)).alias("len")), "jump")
    heads = nodes.join(link.select(c("v").alias("node")), "node", "left_anti")
    heads = scratch.table(heads, "heads")
    size = 1
    total = nodes.count()
    while size < total:
        nxt = ahead.select(c("node").alias("to"), c("to").alias("t2"), c("n").alias("n2"), c("len").alias("l2"))
        j = ahead.join(nxt, "to", "left").select("node", F.coalesce("t2", "to").alias("to"), (c("n") + F.coalesce("n2", F.lit(0))).alias("n"), (c("len") + F.coalesce("l2", F.lit(0))).alias("len"), c("t2").isNotNull().alias("moved"))
        j = scratch.table(j, "jump")
        ahead = j.drop("moved")
        size *= 2
        # heads end somewhere; nodes of circles never stop moving, so ask the heads only
        if j.join(heads, "node", "left_semi").where("moved").isEmpty():
            break
    done = ahead.join(heads, "node", "left_semi")
    return done.select(c("node").alias("head"), F.coalesce("to", "node").alias("tail"), (c("n") + 1).cast("long").alias("n_nodes"), "len")


def circles(arcs: DataFrame, paths: DataFrame) -> DataFrame:
    """node: nodes with one way in and out that lie on no open path, hence on a circle without branches.

    ``paths``: node of every node that a unitig covers.
    """
    return degrees(arcs).where("n_in = 1 and n_out = 1").select("node").join(paths, "node", "left_anti")


def levels(arcs: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """node, level: least number of arcs from the start nodes, up to ``most`` or until no node is new; one frontier join a level.

    With a column ``start`` in ``starts`` every start is searched by itself and named in the result.
    """
    scratch = Scratch(arcs.sparkSession, "levels")
    keys = [x for x in ("start", "node") if x in starts.columns]
    arcs = scratch.table(arcs.select("u", "v"), "arcs")
    new, path = scratch.write(starts.select(*keys).distinct().withColumn("level", F.lit(0)), "new")
    paths, schema, k = [path], new.schema, 0
    while most is None or k < most:
        k += 1
        to = new.withColumnRenamed("node", "u").drop("level").join(arcs, "u").withColumnRenamed("v", "node").select(*keys).distinct()
        new, path = scratch.write(to.join(scratch.union(paths, schema), keys, "left_anti").withColumn("level", F.lit(k)), "new")
        if new.isEmpty():
            break
        paths.append(path)
    return scratch.union(paths, schema)


def components(edges: DataFrame) -> DataFrame:
    """group_id, rid: connected components of undirected edges (u, v); the label is the smallest vertex."""
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    return contract(e, scratch, e.count())


def relabel(edges: DataFrame, to: DataFrame, hubs: list) -> DataFrame:
    """Edges with both ends replaced by their label (u, to), loops dropped, once each."""
    e = edges
    for end in ("u", "v"):
        t = to.select(F.col("u").alias(end), "to")
        e = join_unique(e, t, end, hubs, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def contract(edges: DataFrame, scratch: Scratch, n_edges: int) -> DataFrame:
    """Minimum propagation by contraction: group_id, rid of every vertex of ``edges`` (u < v)."""
    work, work_path = scratch.write(edges, "work")
    parents: list[DataFrame] = []
    while not work.isEmpty():
        sym = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to"))
        # hang each vertex under the label of its label: two steps of propagation in a round
        hubs = hot_keys(least, "to", n_edges)
        up = least.select(F.col("u").alias("to"), F.col("to").alias("top"))
        step = join_unique(least, up, "to", hubs, "left").select("u", F.coalesce("top", "to").alias("to"))
        step = scratch.table(step, "step")
        parents.append(step)
        nxt, nxt_path = scratch.write(relabel(work, step, hot_keys(sym, "u", n_edges)), "work")
        scratch.drop(work_path)
        work, work_path = nxt, nxt_path
    if not parents:
        return scratch.spark.createDataFrame([], "group_id long, rid long")
    # vertices of round i carry on under their label in round i + 1
    out = parents[-1]
    for p in reversed(parents[:-1]):
        nxt = out.select(F.col("u").alias("to"), F.col("to").alias("top"))
        out = join_unique(p, nxt, "to", hot_keys(p, "to", n_edges), "left").select("u", F.coalesce("top", "to").alias("to"))
        out = scratch.table(out, "labels")
    return out.select(F.col("to").alias("group_id"), F.col("u").alias("rid"))
