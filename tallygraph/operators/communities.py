"""Communities and connected groups, in rounds of joins.

No task holds the graph, whatever its size: a round of local moving is two
aggregations and two equi-joins, with labels cut to the checkpoint folder.  Where
a sequential search moves one node at a time, here a random half of the nodes
moves at once, so that neighbours do not swap places for ever; membership may
thus differ, and what is promised is the modularity and that every node has a
community.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import spark_sql, view
from .graph import _cut, blast_radius, numbered


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of undirected edges (a, b); ``component`` is the least
    node that can be reached.  Labels fall to the least of the neighbours and
    then to their label's label, which halves the distance left."""
    pairs = edges.select("a", "b").where("a <> b")
    both = _cut(pairs.union(pairs.select("b", "a")).distinct())
    own = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = _cut(own.select("node", F.col("node").alias("c")))
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = labels.select(F.col("node").alias("at"), F.col("c").alias("up"))
        step = _cut(step.join(jump, step.n == jump.at, "left").select("node", "c", F.least("n", F.coalesce("up", "n")).alias("n")))
        moved = not step.where("c <> n").isEmpty()
        labels = step.select("node", F.col("n").alias("c"))
        if not moved:
            return labels.select("node", F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


#: Directed pairs to a part of a level that is kept, unless that takes more parts than a shuffle has.
PAIRS = 250_000


def _sweeps(e: DataFrame, rows: int, total: float, sweeps: int, salt: int) -> DataFrame:
    """(node, c): labels after local moving on ``rows`` directed pairs (a, b, w).

    The pairs of a level are laid out by ``b`` once and kept, each with the
    degree of ``a``, and a pair of a node with itself stands for staying where it
    is.  A sweep thus moves the labels, by community and by node, and the offers,
    once to their node; nothing is broadcast, so nothing passes the driver."""
    degree = e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
    labels = _cut(degree.select("node", "d", F.col("node").alias("c")))
    away = e.where("a <> b").join(labels.select(F.col("node").alias("a"), "d").hint("merge"), "a").select("a", "d", "b", "w")
    most = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = away.union(labels.select("node", "d", "node", F.lit(0.0))).repartition(min(most, 1 + rows // PAIRS), "b").sortWithinPartitions("b").persist()
    for turn in range(sweeps):
        sums = labels.groupBy("c").agg(F.sum("d").alias("t"))
        held = labels.select(F.col("node").alias("b"), "c").join(sums.hint("merge"), "c")
        offers = laid.join(held.hint("merge"), "b").select("a", "d", F.col("c").alias("to"), "t", "w", (F.col("a") == F.col("b")).alias("own"))
        offers = offers.repartition("a").groupBy("a", "d", "to").agg(F.sum("w").alias("k"), F.max("t").alias("t"), F.max("own").alias("own"))
        gain = F.col("k") - (F.col("t") - F.when(F.col("own"), F.col("d")).otherwise(0.0)) * F.col("d") / total
        scored = offers.select(F.col("a").alias("node"), "d", "own", "to", F.round(gain, 9).alias("gain"))
        best = scored.groupBy("node", "d").agg(F.max("gain").alias("top"), F.max(F.when(F.col("own"), F.struct("gain", "to"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("best"))
        wants = F.col("top") > F.col("stay.gain")
        goes = wants & (F.pmod(F.xxhash64("node", F.lit(salt * 101 + turn)), F.lit(2)) == 0)
        labels = _cut(best.select("node", "d", F.when(goes, F.col("best.to")).otherwise(F.col("stay.to")).alias("c"), wants.alias("wants")))
        if labels.where("wants").isEmpty():
            break
        labels = labels.drop("wants")
    laid.unpersist()
    return labels.select("node", "c")


def louvain(edges: DataFrame, nodes: DataFrame | None = None, sweeps: int = 6, levels: int = 3, resolution: float = 1.0) -> DataFrame:
    """(node, community) of undirected weighted edges (a, b, w); ``nodes``
    (node) adds those without an edge, each a community of its own.  Null ends
    and weights of 0 or less are left out; a larger ``resolution`` gives smaller
    communities.  What is promised is the modularity, not the membership."""
    e = edges.where("a is not null and b is not null and w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    # each edge in both directions; a self edge once, at twice its weight
    there, back = F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    twice = F.struct("a", "b", (2 * F.col("w")).alias("w"))
    e = _cut(e.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(twice)).otherwise(F.array(there, back)))))
    total, rows = e.agg(F.sum("w"), F.count("*")).first()
    out = e.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community"))
    alone = None if nodes is None else nodes.select("node").where("node is not null").distinct().join(out.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("community"))
    if not total:
        return out if alone is None else out.union(alone)
    for level in range(levels):
        labels = _sweeps(e, rows, total / resolution, sweeps, level)
        out = _cut(out.join(labels.select(F.col("node").alias("community"), "c").hint("merge"), "community").select("node", F.col("c").alias("community")))
        a, b = labels.select(F.col("node").alias("a"), F.col("c").alias("ca")), labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        merged = _cut(e.join(a.hint("merge"), "a").join(b.hint("merge"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        if merged.select("a").distinct().count() == e.select("a").distinct().count():
            break
        e, rows = merged, merged.count()
    return out if alone is None else out.union(alone)


def name_communities(members: DataFrame, edges: DataFrame, dirs: DataFrame) -> DataFrame:
    """(community, size, name, hub, place): the commonest directory of the
    members (ties to the first in order), a number behind a name that is taken,
    the hub of the most incident weight, largest community first."""
    ends = edges.select(F.col("a").alias("node"), "w").union(edges.select("b", "w")).groupBy("node").agg(F.sum("w").alias("weight"))
    m = members.join(dirs.hint("merge"), "node", "left").join(ends.hint("merge"), "node", "left").fillna({"dir": "", "weight": 0.0})
    d = m.groupBy("community", "dir").agg(F.count("*").alias("n"))
    top = d.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("k"), "dir"))["dir"].alias("base"), F.sum("n").alias("size"))
    hub = m.groupBy("community").agg(F.min(F.struct((-F.col("weight")).alias("k"), "node"))["node"].alias("hub"))
    named = top.join(hub.hint("merge"), "community").withColumn("__by", F.struct((-F.col("size")).alias("size"), "community"))
    named = numbered(named, "__by").drop("__by").withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("size"), "community")))
    name = F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col("r").cast("string")))
    return named.select("community", "size", name.alias("name"), "hub", (F.col("idx") + 1).alias("place"))


def work_groups(impact: DataFrame, transforms: DataFrame) -> DataFrame:
    """(unit, grp, place) of units (long) that share a file of ``impact`` (unit,
    file) or a transform of ``transforms`` (unit, op, symbol), directly or
    through others.  A group goes by its least unit, and ``place`` numbers the
    groups from 1 in that order.  Units of one table only, and those that share
    nothing, are groups too; an empty operation or symbol is no transform."""
    named = transforms.where("coalesce(op, '') <> '' and coalesce(symbol, '') <> ''")
    edges = impact.select("unit", F.struct(F.lit("").alias("op"), F.col("file").alias("name")).alias("edge")).union(named.select("unit", F.struct("op", F.col("symbol").alias("name"))))
    # every unit of a file or transform is tied to its least unit: as many links as rows
    first = edges.groupBy("edge").agg(F.min("unit").alias("a"))
    links = edges.join(first, "edge").select("a", F.col("unit").alias("b")).union(transforms.select("unit", "unit"))
    groups = _cut(components(links).select(F.col("node").alias("unit"), F.col("component").alias("grp")))
    placed = numbered(groups.select("grp").distinct(), "grp").select("grp", (F.col("idx") + 1).alias("place"))
    return groups.join(placed, "grp").select("unit", "grp", "place")


def work_plan(impact: DataFrame, transforms: DataFrame) -> DataFrame:
    """(place, grp, units, files, why), one row per group: how many units and
    files it has and why they are one: a file that two of them share, else one
    transform, else the unit is alone."""
    groups = _cut(work_groups(impact, transforms))
    held = impact.join(groups, "unit").groupBy("grp", "file").agg(F.count_distinct("unit").alias("n"))
    files = held.groupBy("grp").agg(F.count("*").alias("files"), F.max("n").alias("most"))
    sized = groups.groupBy("grp", "place").agg(F.count("*").alias("units")).join(files, "grp", "left")
    why = F.when(F.col("most") > 1, "shared impact").when(F.col("units") > 1, "same transform").otherwise("independent")
    return sized.select("place", "grp", "units", F.coalesce("files", F.lit(0)).alias("files"), why.alias("why"))


def forward_slice(edges: DataFrame, start: str, refs: int = 20, dependents: int = 25) -> DataFrame:
    """(node, hops, side): what ``start`` uses within two hops, nearest first
    and ``refs`` at most, and ``dependents`` of its direct users."""
    ahead = blast_radius(edges, start, 2, back=False).orderBy("hops", "node").limit(refs).select("node", "hops", F.lit("uses").alias("side"))
    behind = blast_radius(edges, start, 1).orderBy("node").limit(dependents).select("node", "hops", F.lit("used_by").alias("side"))
    return ahead.unionByName(behind)


def _part_graph(s, d):
    return spark_sql(s, d, "SELECT src AS a, dst AS b, CAST(count(*) AS DOUBLE) AS w FROM dep WHERE src <> dst GROUP BY src, dst")


#: Declared intents of the ledger as units of work; some name a transform.
_TRANSFORMS = "SELECT seq AS unit, CASE WHEN k % 3 = 0 THEN CASE k % 4 WHEN 0 THEN 'rename' WHEN 1 THEN 'extract' ELSE 'delete' END ELSE '' END AS op, CASE WHEN tokens % 4 = 1 THEN '' ELSE 'sym' || ((k * 7 + tokens) % 400) END AS symbol FROM act WHERE kind = 'intent_declared'"
#: The file that a unit names, by month of the stored time, and one that depends on it.
_IMPACT = """WITH u AS (SELECT seq, k, @INT[floor(seq / 900)] AS era FROM act WHERE kind = 'intent_declared' AND k % 5 < 4)
SELECT seq AS unit, 'f' || k || '@' || era AS file FROM u UNION ALL SELECT u.seq AS unit, 'f' || substr(dep.src, 2) || '@' || u.era AS file FROM u JOIN dep ON dep.dst = 'p' || u.k AND dep.src <> dep.dst WHERE dep.kind = 'inherits'"""


def _work(s, d) -> tuple[DataFrame, DataFrame]:
    return spark_sql(s, d, _IMPACT), spark_sql(s, d, _TRANSFORMS)


def _part_nodes(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))


def _named(s, d):
    g = _cut(_part_graph(s, d))
    dirs = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("dir"))
    return name_communities(louvain(g, _part_nodes(s, d)), g, dirs)


QUERIES = {
    "g9_louvain": lambda s, d: louvain(_part_graph(s, d), _part_nodes(s, d)),
    "g10_named_communities": _named,
    "g14_work_groups": lambda s, d: work_groups(*_work(s, d)),
    "g14_work_plan": lambda s, d: work_plan(*_work(s, d)),
    "g18_forward_slice": lambda s, d: forward_slice(view(s, d, "dep"), "p120"),
}
#: Reachability by definition: what a unit reaches through what it shares.
_REACH = f"""WITH RECURSIVE i AS ({_IMPACT.replace("WITH u AS", "WITH u AS MATERIALIZED")}), t AS ({_TRANSFORMS}), l AS MATERIALIZED (SELECT DISTINCT a.unit AS a, b.unit AS b FROM i a JOIN i b ON a.file = b.file WHERE a.unit <> b.unit UNION SELECT a.unit, b.unit FROM t a JOIN t b ON a.op = b.op AND a.symbol = b.symbol AND a.op <> '' AND a.symbol <> '' AND a.unit <> b.unit),
r AS (SELECT unit AS n, unit AS m FROM t UNION SELECT r.n, l.b AS m FROM r JOIN l ON l.a = r.m), g AS (SELECT n AS unit, min(m) AS grp FROM r GROUP BY n)"""
ORACLE = {
    "g14_work_groups": f"{_REACH} SELECT g.unit, g.grp, p.place FROM g JOIN (SELECT grp, row_number() OVER (ORDER BY grp) AS place FROM (SELECT DISTINCT grp FROM g) x) p ON p.grp = g.grp",
    "g14_work_plan": f"""{_REACH}, z AS (SELECT g.grp, i.file, count(DISTINCT g.unit) AS n FROM g JOIN i ON i.unit = g.unit GROUP BY g.grp, i.file), s AS (SELECT grp, count(*) AS units FROM g GROUP BY grp), f AS (SELECT grp, count(*) AS files, max(n) AS most FROM z GROUP BY grp)
SELECT row_number() OVER (ORDER BY s.grp) AS place, s.grp, s.units, coalesce(f.files, 0) AS files, CASE WHEN f.most > 1 THEN 'shared impact' WHEN s.units > 1 THEN 'same transform' ELSE 'independent' END AS why FROM s LEFT JOIN f ON f.grp = s.grp""",
    "g18_forward_slice": "SELECT * FROM (SELECT b.dst AS node, 1 AS hops, 'uses' AS side FROM dep b WHERE b.src = 'p120' UNION ALL SELECT c.dst, 2, 'uses' FROM dep b JOIN dep c ON c.src = b.dst WHERE b.src = 'p120') t UNION ALL SELECT * FROM (SELECT src AS node, 1 AS hops, 'used_by' AS side FROM dep WHERE dst = 'p120' ORDER BY src LIMIT 25) u",
}
