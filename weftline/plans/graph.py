"""String-graph queries (GRA) over the arcs of the overlap table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import graph as G
from ..scratch import Scratch
from .common import EDGES, OVERLAPS, Registry, edges, overlaps
from .relational import _CONT, _SWEEP, containers, depth
from .scalar import ARC_SQL

q = Registry()
c = F.col
RATE, FUZZ = 0.3, 10

_ARCS = f"""{OVERLAPS}, sym AS (SELECT qn,ql,qs,qe,tn,tl,ts,te,rev FROM ovl WHERE qn <> tn UNION SELECT tn,tl,ts,te,qn,ql,qs,qe,rev FROM ovl WHERE qn <> tn),
raw_arcs AS (SELECT u, v, len, ol FROM ({ARC_SQL.format(src='sym').replace('0.8 *', f'{RATE} *')}) WHERE kind = 'ARC'),
arcs AS (SELECT u, v, len, ol FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY ol DESC, len) AS k FROM raw_arcs) WHERE k = 1),
deg AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT u AS node, 1 AS o, 0 AS i FROM arcs UNION ALL SELECT v, 0, 1 FROM arcs) GROUP BY node)"""


def arcs(spark, d):
    """The arc table, written once so that the steps of a query share it."""
    return Scratch(spark, "arcs").table(_arcs(spark, d), "arcs")


def _arcs(spark, d):
    o = overlaps(spark, d).where("qn <> tn").drop("ml", "bl")
    swapped = o.select(c("tn").alias("qn"), c("tl").alias("ql"), c("ts").alias("qs"), c("te").alias("qe"), c("qn").alias("tn"), c("ql").alias("tl"), c("qs").alias("ts"), c("qe").alias("te"), "rev")
    s = o.unionByName(swapped)
    f = S.arc_fields(*[c(n) for n in ("qn", "tn", "qs", "qe", "ql", "ts", "te", "tl", "rev")], rate=RATE)
    return G.distinct_arcs(s.withColumn("a", f).where("a.kind = 'ARC'").select("a.u", "a.v", "a.len", "a.ol"))


@q(f"WITH {_ARCS} SELECT u, v, len, ol FROM arcs")
def gra01_arcs(spark, d):
    return arcs(spark, d)


@q(f"WITH {_ARCS}, gone AS (SELECT u, v FROM arcs WHERE ol < 100), b AS (SELECT u, v FROM gone UNION SELECT xor(v, 1), xor(u, 1) FROM gone) SELECT u, v, len, ol FROM arcs ANTI JOIN b USING (u, v)")
def gra02_delete_arcs(spark, d):
    a = arcs(spark, d)
    return G.without(a, a.where("ol < 100"))


@q(f"WITH {_ARCS} SELECT * FROM deg")
def gra03_degree(spark, d):
    return G.degrees(arcs(spark, d))


@q(f"""WITH {OVERLAPS}, {_SWEEP}, hi AS (SELECT rid, s, e, CASE WHEN s = lag(e) OVER (PARTITION BY rid ORDER BY s) THEN 0 ELSE 1 END AS new FROM depth WHERE depth >= 2),
isl AS (SELECT rid, s, e, sum(new) OVER (PARTITION BY rid ORDER BY s) AS g FROM hi), runs AS (SELECT rid, min(s) AS s, max(e) AS e FROM isl GROUP BY rid, g)
SELECT rid, s, e FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY e - s DESC, s) AS k FROM runs) WHERE k = 1""")
def gra04_clip(spark, d):
    """The longest stretch of each record with depth 2 or more."""
    from pyspark.sql import Window

    w = Window.partitionBy("rid").orderBy("s")
    hi = depth(spark, d).where("depth >= 2")
    hi = hi.withColumn("new", F.when(c("s") == F.lag("e").over(w), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    runs = hi.groupBy("rid", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("rid").agg(F.max_by(F.struct("s", "e"), F.struct(c("e") - c("s"), -c("s"))).alias("b")).select("rid", "b.s", "b.e")


@q(f"WITH {_ARCS}, {_CONT} SELECT u, v, len, ol FROM arcs WHERE (u // 2) NOT IN (SELECT rid FROM held) AND (v // 2) NOT IN (SELECT rid FROM held)")
def gra05_without_contained(spark, d):
    h = containers(overlaps(spark, d)).select("rid")
    nodes = h.select((c("rid") * 2).alias("node")).unionByName(h.select((c("rid") * 2 + 1).alias("node")))
    return G.drop_nodes(arcs(spark, d), nodes)


_RED = f"{_ARCS}, two AS (SELECT a.u, b.v, min(a.len + b.len) AS via FROM arcs a JOIN arcs b ON a.v = b.u WHERE a.u <> b.v GROUP BY ALL), red AS (SELECT u, v FROM arcs JOIN two USING (u, v) WHERE via <= len + {FUZZ})"


@q(f"WITH {_RED} SELECT u, v, len, ol FROM arcs ANTI JOIN red USING (u, v)")
def gra06_transitive_reduction(spark, d):
    a = arcs(spark, d)
    return a.join(G.reducible(a, FUZZ), ["u", "v"], "left_anti").select("u", "v", "len", "ol")


@q(f"""WITH RECURSIVE {_ARCS}, walk(head, node, spot, k) AS (SELECT node, node, node, 1 FROM deg WHERE n_in = 0 AND n_out = 1
UNION ALL SELECT w.head, a.v, a.v, w.k + 1 FROM walk w JOIN arcs a ON a.u = w.spot JOIN deg g ON g.node = a.v WHERE w.k < 3 AND g.n_in = 1 AND g.n_out = 1),
hit AS (SELECT DISTINCT w.head, w.k FROM walk w JOIN arcs a ON a.u = w.spot JOIN deg g ON g.node = a.v WHERE g.n_in > 1), t AS (SELECT DISTINCT w.node FROM walk w JOIN hit h ON h.head = w.head AND w.k <= h.k)
SELECT node FROM t UNION SELECT xor(node, 1) FROM t""")
def gra07_tips(spark, d):
    return G.tips(arcs(spark, d))


@q()
def gra07_clean_tips(spark, d):
    return G.clean_tips(arcs(spark, d))


@q(f"WITH {_ARCS} SELECT u, v FROM (SELECT *, max(ol) OVER (PARTITION BY u) AS b, max(ol) OVER (PARTITION BY v) AS r FROM arcs) WHERE ol < 0.7 * b AND ol < 0.7 * r")
def gra08_weak_arcs(spark, d):
    return G.weak_arcs(arcs(spark, d), 0.7)


_BUB = "inn AS (SELECT a.u AS source, a.v AS m, b.v AS sink FROM arcs a JOIN deg g ON g.node = a.v AND g.n_in = 1 AND g.n_out = 1 JOIN arcs b ON b.u = a.v)"


@q(f"WITH {_ARCS}, {_BUB} SELECT x.source, x.sink, x.m AS a, y.m AS b FROM inn x JOIN inn y ON x.source = y.source AND x.sink = y.sink AND x.m < y.m")
def gra09_bubbles(spark, d):
    return G.simple_bubbles(arcs(spark, d))


_LINK = "link AS (SELECT a.u, a.v, a.len FROM arcs a JOIN deg x ON x.node = a.u AND x.n_out = 1 JOIN deg y ON y.node = a.v AND y.n_in = 1 WHERE a.u <> a.v)"
_PATHS = f"{_ARCS}, {_LINK}, path(head, spot, n, len) AS (SELECT node, node, 1, 0::BIGINT FROM deg WHERE node NOT IN (SELECT v FROM link) UNION ALL SELECT p.head, l.v, p.n + 1, p.len + l.len FROM path p JOIN link l ON l.u = p.spot)"


@q(f"WITH RECURSIVE {_PATHS} SELECT head, spot AS tail, n::BIGINT AS n_nodes, len FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY n DESC) AS k FROM path) WHERE k = 1")
def gra13_unitigs(spark, d):
    return G.unitigs(arcs(spark, d))


@q(f"WITH RECURSIVE {_ARCS}, lv(node, level) AS (SELECT node, 0 FROM (SELECT min(node) AS node FROM deg WHERE n_out = (SELECT max(n_out) FROM deg)) UNION SELECT a.v, l.level + 1 FROM lv l JOIN arcs a ON a.u = l.node WHERE l.level < 200) SELECT node, min(level)::INTEGER AS level FROM lv GROUP BY node")
def gra15_levels(spark, d):
    """Breadth-first levels of every node that the node with most outgoing arcs reaches."""
    a = arcs(spark, d)
    start = G.degrees(a).agg(F.max_by("node", F.struct("n_out", -c("node"))).alias("node"))
    return G.levels(a, start)


@q(f"""WITH RECURSIVE {EDGES}, e AS (SELECT u, v FROM edges WHERE w >= 100 UNION SELECT v, u FROM edges WHERE w >= 100), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT least(min(v), u) AS group_id, u AS rid FROM r GROUP BY u""")
def gra16_components(spark, d):
    return G.components(edges(spark, d).where("w >= 100"))


@q(f"WITH {EDGES}, top AS (SELECT x, y, w FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS k FROM (SELECT u AS x, v AS y, w FROM edges UNION ALL SELECT v, u, w FROM edges)) WHERE k <= 2) SELECT least(x, y) AS u, greatest(x, y) AS v, max(w) AS w FROM top GROUP BY ALL HAVING count(*) = 2")
def gra17_strong_edges(spark, d):
    """Edges among the two heaviest of both their ends: one round of the weak-edge cut."""
    from pyspark.sql import Window

    e = edges(spark, d)
    b = e.select(c("u").alias("x"), c("v").alias("y"), "w").unionByName(e.select(c("v").alias("x"), c("u").alias("y"), "w"))
    top = b.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y"))).where("k <= 2")
    return top.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@q(f"WITH RECURSIVE {_PATHS}, big AS (SELECT head FROM path GROUP BY head HAVING max(n) >= 2), keep AS (SELECT DISTINCT (spot // 2) AS rid FROM path SEMI JOIN big USING (head)) SELECT qn, tn, qs, qe FROM ovl WHERE qn IN (SELECT rid FROM keep) AND tn IN (SELECT rid FROM keep)")
def gra18_by_unitigs(spark, d):
    """Matches between records that lie at the ends of unitigs of two nodes or more, or inside them."""
    a = arcs(spark, d)
    deg = G.degrees(a)
    link = a.join(deg.where("n_out = 1").select(c("node").alias("u")), "u").join(deg.where("n_in = 1").select(c("node").alias("v")), "v").where("u <> v")
    u = G.unitigs(a).where("n_nodes >= 2")
    # a node on an open path of two or more nodes is an end of a link; nodes of circles are not on a path
    on = link.select(c("u").alias("node")).unionByName(link.select(c("v").alias("node"))).distinct()
    loops = loop_nodes(link, u)
    keep = on.join(loops, "node", "left_anti").select(F.floor(c("node") / 2).alias("rid")).distinct()
    o = overlaps(spark, d)
    return o.join(keep.withColumnRenamed("rid", "qn"), "qn", "left_semi").join(keep.withColumnRenamed("rid", "tn"), "tn", "left_semi").select("qn", "tn", "qs", "qe")


def loop_nodes(link, paths):
    """Nodes of components of the link graph that hold no head of a path: circles."""
    comp = G.components(link.select("u", "v"))
    with_head = comp.join(paths.select(c("head").alias("rid")), "rid", "left_semi").select("group_id").distinct()
    return comp.join(with_head, "group_id", "left_anti").select(c("rid").alias("node"))


@q(f"WITH RECURSIVE {_ARCS}, {_LINK}, r(s, spot, n) AS (SELECT u, v, 1 FROM link UNION ALL SELECT r.s, l.v, r.n + 1 FROM r JOIN link l ON l.u = r.spot WHERE r.spot <> r.s AND r.n < 2000) SELECT s AS node, n::BIGINT AS n_nodes FROM r WHERE spot = s")
def gra11_circles(spark, d):
    """Nodes on circles without branches, with the size of the circle."""
    a = arcs(spark, d)
    deg = G.degrees(a)
    link = a.join(deg.where("n_out = 1").select(c("node").alias("u")), "u").join(deg.where("n_in = 1").select(c("node").alias("v")), "v").where("u <> v")
    comp = G.components(link.select("u", "v"))
    loops = loop_nodes(link, G.unitigs(a)).withColumnRenamed("node", "rid")
    members = comp.join(loops, "rid", "left_semi")
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return members.join(n, "group_id").select(c("rid").alias("node"), "n_nodes")


@q(f"WITH RECURSIVE {EDGES}, e AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), h(start, rid, k) AS (SELECT rid, rid, 0 FROM reads WHERE rid % 50 = 0 UNION SELECT h.start, e.v, h.k + 1 FROM h JOIN e ON e.u = h.rid WHERE h.k < 2) SELECT start, rid, min(k)::INTEGER AS level FROM h GROUP BY start, rid")
def gra20_neighbourhood(spark, d):
    """Records within two matches of each record of the query set (ids divisible by 50), searched among all."""
    from .common import reads

    e = edges(spark, d)
    b = e.select("u", "v").unionByName(e.select(c("v").alias("u"), c("u").alias("v")))
    start = reads(spark, d).where("rid % 50 = 0").select(c("rid").alias("start"), c("rid").alias("node"))
    return G.levels(b, start, 2).select("start", c("node").alias("rid"), "level")


QUERIES, SQL = q.queries, q.sql
