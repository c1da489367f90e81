"""Graph operators that need rounds or a fold: blast radius, shortest path,
co-change, and similar tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import removed, shared_folder, spark_sql, view
from .folds import ordered_fold


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.  A checkpoint keeps
    the orderings of its plan, which multiply from round to round."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Nodes of a blast radius after which it ends, in the middle of a level.
BLAST_LIMIT = 200


def blast_radius(edges: DataFrame, start: str, depth: int, back: bool = True, limit: int = BLAST_LIMIT) -> DataFrame:
    """(node, hops, through): nodes that depend on ``start``, by level.

    A level is one join of at most ``limit`` nodes, whose rows the driver may
    therefore hold, with the edges.  ``through`` is the first finder in the
    order of the level before, which is by id; nodes count in the order of their
    finders, then by id, until ``limit``.  Depth is held to 1..6."""
    near, far = ("dst", "src") if back else ("src", "dst")
    edges = edges.where("src <> dst").select(F.col(near).alias("near"), F.col(far).alias("far"))
    spark = edges.sparkSession
    level, out, seen = [start], [], {start}
    for hop in range(1, max(1, min(6, depth)) + 1):
        front = spark.createDataFrame(list(enumerate(level)), "rank int, node string")
        known = spark.createDataFrame([(x,) for x in seen], "far string")
        found = edges.join(F.broadcast(front), F.col("near") == F.col("node")).join(F.broadcast(known), "far", "left_anti")
        found = found.groupBy("far").agg(F.min(F.struct("rank", "node")).alias("p")).orderBy("p.rank", "far").limit(limit - len(out))
        rows = [(r.far, hop, r.p.node) for r in found.collect()]  # at most ``limit``
        out += rows
        level = sorted(r[0] for r in rows)
        seen.update(level)
        if not rows or len(out) >= limit:
            break
    return spark.createDataFrame(out, "node string, hops int, through string")


def blast_view(edges: DataFrame, nodes: DataFrame, start: str, depth: int, limit: int = BLAST_LIMIT) -> DataFrame:
    """One row on a blast radius: node, depth, total, files, owners, absent_in
    (folders without a hit), truncated, verdict.  ``nodes``: (node, path,
    owner)."""
    depth = max(1, min(6, depth))
    hit = blast_radius(edges, start, depth, limit=limit)
    near = nodes.join(F.broadcast(hit.select("node")), "node").select("path", "owner")
    top = F.substring_index("path", "/", 1)
    dirs = nodes.select(top.alias("dir")).distinct()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    absent = dirs.join(near.select(top.alias("dir")).distinct(), "dir", "left_anti").agg(joined(F.col("dir")).alias("absent_in"))
    seen = near.agg(F.count_distinct("path").alias("files"), joined(F.when(F.col("owner") != "", F.col("owner"))).alias("owners"))
    total = hit.agg(F.count("*").alias("total"))
    row = total.crossJoin(seen).crossJoin(absent)  # one row each
    verdict = F.when(F.col("total") == 0, "nothing depends on it").otherwise(F.concat(F.col("total").cast("string"), F.lit(" dependents in "), F.col("files").cast("string"), F.lit(" files")))
    return row.select(F.lit(start).alias("node"), F.lit(depth).alias("depth"), "total", "files", "owners", "absent_in", (F.col("total") >= limit).alias("truncated"), verdict.alias("verdict"))


def neighbours(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, side, via, hops): what ``start`` depends on and what depends on
    it, to a depth of 1..3.

    One set of seen nodes serves both sides; the nodes of a level claim theirs
    in order, successors before predecessors, each by id.  The order is carried
    as the trail of claims, so that no level is ranked as a whole.  The least
    claim counts, so edges may come repeated and are not made distinct."""
    e = edges.where("src <> dst").select("src", "dst")
    both = _cut(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit("0").alias("way")).union(e.select("dst", "src", F.lit("1"))))
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, [], None, None, 0)], "node string, trail array<string>, side string, via string, hops int")
    seen = front
    for hop in range(1, max(1, min(3, depth)) + 1):
        claim = F.min(F.struct("trail", "way", "node")).alias("c")
        near = F.broadcast(front) if hop == 1 else front  # one row
        found = near.join(both, front.node == both["at"]).groupBy("to").agg(claim).join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        step = F.concat("c.way", "to")
        front = _cut(found.select(F.col("to").alias("node"), F.concat("c.trail", F.array(step)).alias("trail"), F.when(F.col("c.way") == "0", "depends_on").otherwise("dependents").alias("side"), F.col("c.node").alias("via"), F.lit(hop).alias("hops")))
        seen = seen.unionByName(front)
    return seen.where("hops > 0").select("node", "side", F.when(F.col("hops") > 1, F.col("via")).otherwise("").alias("via"), "hops")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, node) of the first shortest undirected path; neighbours are tried
    in the order of their ids, parents in the order they were queued, which gives
    the least of the shortest paths as a list of ids.  No path, no rows.

    The search goes from both ends, a whole level of the smaller front at a time,
    until the fronts meet.  A node carries the least list of ids from its end; of
    the nodes where the fronts meet, that of the least list from ``start`` is on
    the path.  A level of an undirected graph has neighbours in itself and the two
    beside it only, so two levels are kept of each side, however long the path."""
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/path-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def first(node: str) -> DataFrame:
        return spark.createDataFrame([(node, [node])], "node string, trail array<string>")

    try:
        e = edges.where("src <> dst").select("src", "dst")
        both = kept(e.union(e.select("dst", "src")).toDF("at", "to"), "edges")
        sides = [[first(start), None, 1], [first(end), None, 1]]  # front, the level before it, size of the front
        answer, turn = [start] if start == end else [], 0
        while not answer and all(side[2] for side in sides):
            i = 0 if sides[0][2] <= sides[1][2] else 1
            front, before, _ = sides[i]
            found = front.join(both, F.col("node") == F.col("at")).groupBy("to").agg(F.min("trail").alias("t"))
            for known in (front, before):
                found = found if known is None else found.join(known.select(F.col("node").alias("to")), "to", "left_anti")
            here = F.array("to")
            new = kept(found.select(F.col("to").alias("node"), F.concat("t", here) if i == 0 else F.concat(here, "t")).toDF("node", "trail"), f"level{turn}")
            other = sides[1 - i][0].select(F.col("node").alias("met"), F.col("trail").alias("rest"))
            pair = F.struct("trail", "rest") if i == 0 else F.struct(F.col("rest").alias("trail"), F.col("trail").alias("rest"))
            state = new.join(other, F.col("node") == F.col("met"), "left").agg(F.count("*").alias("n"), F.min(F.when(F.col("met").isNotNull(), pair)).alias("path")).first()
            if state.path:
                answer = [*state.path.trail, *state.path.rest[1:]]
            sides[i], turn = [new, front, state.n], turn + 1
    finally:
        removed(spark, folder)
    return spark.createDataFrame(list(enumerate(answer)), "step int, node string")


def co_change(ledger: DataFrame, span: float = 1800.0, least: int = 2, most: int = 60) -> DataFrame:
    """(a, b, n): paths edited in one episode of rows (skey, seq, ts, path,
    intent_id).  An episode is the edits of one intent, else of one agent's
    bucket of ``span`` from its first edit (not from the last); episodes of
    ``least`` to ``most`` paths count, so a path meets no more than ``most``
    others for each row."""

    def step(state: list, row: tuple) -> list[tuple]:
        ts, path = row
        if state[0] is None or ts - state[0] > span:
            state[0] = ts
        return [(path, state[0])]

    timed = ordered_fold(ledger.where("intent_id = ''"), ["skey"], ["seq"], ["ts", "path"], lambda: [None], step, "skey string, path string, start double")
    eps = timed.select(F.concat("skey", F.lit("@"), F.col("start").cast("string")).alias("ep"), "path")
    eps = eps.union(ledger.where("intent_id <> ''").select(F.concat(F.lit("#"), "intent_id"), "path"))
    # one row per episode, of a bounded list; its pairs are made where it is
    sets = eps.groupBy("ep").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths").between(least, most))
    a = sets.select("paths", F.posexplode("paths").alias("i", "a"))
    pairs = a.select("a", F.explode(F.expr("slice(paths, i + 2, size(paths))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


#: What a relation weighs in the projection; a shared episode
#: weighs 2.  All are halved.
WEIGHTS = {"inherits": 6, "calls": 4, "uses_type": 3, "references": 2}
EPISODE = 2


def projection(dep: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, w): the weighted undirected graph of edges (src, dst, kind) and
    co-changes (a, b, n), a < b; a node of ``nodes`` (node) without an edge is a
    row with an empty b."""
    kind = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    e = dep.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), kind[F.col("kind")].cast("long").alias("w"))
    e = e.union(changes.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b"), F.col("n") * EPISODE))
    p = e.groupBy("a", "b").agg((F.sum("w").cast("double") / 2).alias("w"))
    ends = e.select(F.explode(F.array("a", "b")).alias("node"))
    return p.union(nodes.select("node").join(ends, "node", "left_anti").select("node", F.lit(""), F.lit(0.0)))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in the order of ``by``: range
    partitions are counted and their offsets added, so no task ranks them all."""
    at = F.monotonically_increasing_id()
    dealt = _cut(rows.repartitionByRange(by).sortWithinPartitions(by).select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND((1 << 33) - 1).alias("__pos")))
    offsets, total = [], 0
    for r in sorted(dealt.groupBy("__part").count().collect()):  # one row per partition
        offsets.append((r["__part"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    return dealt.join(F.broadcast(before), "__part").withColumn("idx", F.col("__pos") + F.col("__before")).drop("__part", "__pos", "__before")


def grid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sort, a, b): nodes (id, flags) as their sorted place and flags, links as
    the places of their ends."""
    coded = _cut(numbered(nodes, "id"))
    ids = coded.select("id", "idx")
    links = edges.where("src <> dst").select("src", "dst").distinct()
    links = links.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.lit("link").alias("sort"), "a", "b")
    return coded.select(F.lit("node").alias("sort"), F.col("idx").alias("a"), F.col("flags").alias("b")).union(links)


#: Rows of a block of examples or of queries that meet in one task.
BLOCK = 2048


def similar_tasks(examples: DataFrame, asks: str, cosine: float = 0.8, scored: int = 3, share: float = 0.5, limit: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, place, vec_id, score): for each example that ``asks`` holds
    for, the best ``limit`` others, best first, the smaller id on a tie: cosine
    at ``cosine`` or more, the same code (label), not stale, and not poor: with
    ``scored`` outcomes or more at least ``share`` of them good.  ``examples``:
    (vec_id, embedding, label, fresh, good, bad).

    All queries go in one pass: the examples and the queries of a label are dealt
    out in blocks, a task multiplies two blocks and keeps the best of each query,
    and these few rows are ranked again.  Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows without a label."""
    import numpy as np
    import pandas as pd

    v = F.col("embedding").cast("array<double>")
    sound = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = examples.where("label is not null").withColumn("embedding", v).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", "embedding", F.struct("label", F.size("embedding").alias("width")).alias("code"), F.expr(asks).alias("asks"), (F.col("fresh") & ((F.col("good") + F.col("bad") < scored) | (F.col("good") >= share * (F.col("good") + F.col("bad"))))).alias("offered"))
    sizes = rows.groupBy("code").agg(F.ceil(F.count_if("offered") / block).cast("int").alias("po"), F.ceil(F.count_if("asks") / block).cast("int").alias("pq")).where("po > 0 and pq > 0")
    dealt = rows.join(sizes, "code")
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    offered = dealt.where("offered").withColumn("o", cell("po")).withColumn("q", every("pq")).select("code", "o", "q", "vec_id", "embedding").toDF("c1", "o1", "q1", "vec_id", "embedding")
    asked = dealt.where("asks").withColumn("q", cell("pq")).withColumn("o", every("po")).select("code", "o", "q", "vec_id", "embedding").toDF("c2", "o2", "q2", "vec_id", "embedding")

    def unit(x) -> np.ndarray:
        m = np.array(x.tolist(), dtype=float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, others = a.vec_id.to_numpy(), b.vec_id.to_numpy()
            score = unit(a.embedding) @ unit(b.embedding).T
            for i, q in enumerate(ids):
                at = np.flatnonzero((score[i] >= cosine) & (others != q))
                near = at[np.lexsort((others[at], -np.round(score[i][at], 9)))][:limit]
                out += [(q, others[j], score[i][j]) for j in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = asked.groupBy("c2", "o2", "q2").cogroup(offered.groupBy("c1", "o1", "q1")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "vec_id", "score")


def _nodes(s, d) -> DataFrame:
    """Nodes of the dependency view with a path and the owner of its edits."""
    owner = "(SELECT k, max_by(usr, n) AS owner FROM (SELECT k, usr, count(*) * 100000 - min(seq) AS n FROM act WHERE kind = 'edit_reported' GROUP BY k, usr) t GROUP BY k) o"
    return spark_sql(s, d, f"SELECT 'p' || p.p_partkey AS node, 'd' || (p.p_partkey % 8) || '/f' || p.p_partkey || '.py' AS path, coalesce(o.owner, '') AS owner FROM part p LEFT JOIN {owner} ON o.k = p.p_partkey")


#: Outcomes and age of an example are not in the tables and come from its id.
_EXAMPLES = "SELECT vec_id, embedding, label, vec_id % 7 <> 3 AS fresh, vec_id % 5 AS good, vec_id % 3 AS bad FROM embeddings"
_FLAGS = "SELECT path AS id, max(CASE WHEN kind = 'edit_reported' THEN 1 ELSE 0 END) + 2 * max(CASE WHEN kind = 'gate_block' THEN 1 ELSE 0 END) + 4 * max(CASE WHEN kind = 'intent_declared' THEN 1 ELSE 0 END) AS flags FROM act WHERE k % 3 > 0 GROUP BY path"
_LINKS = "SELECT DISTINCT a.path AS src, b.path AS dst FROM dep JOIN (SELECT DISTINCT path, 'p' || k AS node FROM act) a ON a.node = dep.src JOIN (SELECT DISTINCT path, 'p' || k AS node FROM act) b ON b.node = dep.dst"
_EDITS = "SELECT usr || ':' || CASE WHEN session <> '' THEN session WHEN agent <> '' THEN agent ELSE 'work' END AS skey, seq, ts, path, intent_id FROM act WHERE kind = 'edit_reported'"
_BOTH = "SELECT src, dst FROM bought UNION ALL SELECT dst, src FROM bought"
#: Parts of one order, the smaller of every other pair depending on the larger.
_TRIANGLES = "SELECT DISTINCT 'p' || CASE WHEN (a.l_partkey + b.l_partkey) % 2 = 0 THEN a.l_partkey ELSE b.l_partkey END AS src, 'p' || CASE WHEN (a.l_partkey + b.l_partkey) % 2 = 0 THEN b.l_partkey ELSE a.l_partkey END AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_partkey > a.l_partkey"


def _co_nodes(s, d) -> DataFrame:
    """Co-changes of files as those of their nodes."""
    node = lambda c: F.concat(F.lit("p"), F.regexp_extract(c, "/f([0-9]+)[.]", 1))
    return co_change(spark_sql(s, d, _EDITS)).select(node("a").alias("a"), node("b").alias("b"), "n")


QUERIES = {
    "g5_blast_radius": lambda s, d: blast_radius(view(s, d, "dep"), "p1", 3),
    "g6_blast_view": lambda s, d: blast_view(view(s, d, "dep"), _nodes(s, d), "p3", 9),
    "g7_neighbours": lambda s, d: neighbours(view(s, d, "dep"), "p20", 3),
    "g8_shortest_path": lambda s, d: shortest_path(view(s, d, "dep"), "p120", "p61"),
    "g16_grid": lambda s, d: grid(spark_sql(s, d, _FLAGS), spark_sql(s, d, _LINKS)),
    "g8_path_in_cycles": lambda s, d: shortest_path(view(s, d, "bought"), "p120", "p61"),
    "g5_blast_in_cycles": lambda s, d: blast_radius(spark_sql(s, d, _BOTH), "p12", 2),
    "g7_neighbours_in_cycles": lambda s, d: neighbours(spark_sql(s, d, _TRIANGLES.replace("DISTINCT ", "", 1)), "p20", 2),
    "a11_co_change": lambda s, d: co_change(spark_sql(s, d, _EDITS)),
    "a14_projection": lambda s, d: projection(view(s, d, "dep"), _co_nodes(s, d), spark_sql(s, d, "SELECT 'p' || p_partkey AS node FROM part")),
    "j21_similar": lambda s, d: similar_tasks(spark_sql(s, d, _EXAMPLES), "vec_id % 20 = 0"),
    # the given vectors are far apart, so the rule's own threshold lets few through
    "j21_similar_wide": lambda s, d: similar_tasks(spark_sql(s, d, _EXAMPLES), "vec_id % 20 = 0", cosine=0.1),
}
_DEEP = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM dep WHERE src <> dst), b AS (SELECT CAST('{start}' AS VARCHAR) AS node, 0 AS hops, CAST(NULL AS VARCHAR) AS through UNION ALL SELECT e.src AS node, b.hops + 1 AS hops, b.node AS through FROM b JOIN e ON e.dst = b.node WHERE b.hops < {depth}),
r AS (SELECT *, row_number() OVER (ORDER BY hops, through, node) AS place FROM b WHERE hops > 0), h AS (SELECT node, hops, through FROM r WHERE place <= 200)"""
ORACLE = {
    # every node has one parent in the view, so a walk meets no node twice
    "g5_blast_radius": _DEEP.format(start="p1", depth=3) + " SELECT node, hops, through FROM h",
    "g6_blast_view": _DEEP.format(start="p3", depth=6) + """, ow AS (SELECT k, arg_max(usr, (n, -first)) AS owner FROM (SELECT k, usr, count(*) AS n, min(seq) AS first FROM act WHERE kind = 'edit_reported' GROUP BY k, usr) t GROUP BY k),
n AS (SELECT CAST(substr(node, 2) AS BIGINT) AS k FROM h) SELECT 'p3' AS node, 6 AS depth, (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n) AS files, (SELECT coalesce(string_agg(DISTINCT owner, ',' ORDER BY owner), '') FROM n JOIN ow ON ow.k = n.k) AS owners,
(SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT 'd' || (p_partkey % 8) AS x FROM part WHERE p_partkey % 8 NOT IN (SELECT k % 8 FROM n)) t) AS absent_in, (SELECT count(*) >= 200 FROM n) AS truncated,
(SELECT CASE WHEN count(*) = 0 THEN 'nothing depends on it' ELSE count(*) || ' dependents in ' || count(*) || ' files' END FROM n) AS verdict""",
    # in a tree no node is found twice, so claims do not collide
    "g7_neighbours": """WITH RECURSIVE e AS (SELECT src, dst FROM dep WHERE src <> dst), b AS (SELECT 'p20' AS node, '' AS side, '' AS via, 0 AS hops, ['p20'] AS seen UNION ALL
SELECT x.node, x.side, CASE WHEN b.hops = 0 THEN '' ELSE b.node END, b.hops + 1, list_append(b.seen, x.node) FROM b JOIN (SELECT src AS at_node, dst AS node, 'depends_on' AS side FROM e UNION ALL SELECT dst, src, 'dependents' FROM e) x ON x.at_node = b.node AND NOT list_contains(b.seen, x.node) WHERE b.hops < 3)
SELECT node, side, via, hops FROM b WHERE hops > 0""",
    "g8_shortest_path": """WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM dep WHERE src <> dst UNION SELECT dst, src FROM dep WHERE src <> dst), w AS (SELECT ['p120'] AS trail UNION ALL SELECT list_append(w.trail, e.b) FROM w JOIN e ON e.a = w.trail[-1] AND NOT list_contains(w.trail, e.b) WHERE w.trail[-1] <> 'p61' AND len(w.trail) < 9),
t AS (SELECT trail FROM w WHERE trail[-1] = 'p61' ORDER BY len(trail), trail LIMIT 1) SELECT CAST(i - 1 AS INTEGER) AS step, trail[i] AS node FROM t, unnest(range(1, len(trail) + 1)) r(i)""",
    "g16_grid": f"""WITH n AS ({_FLAGS}), c AS (SELECT id, flags, row_number() OVER (ORDER BY id) - 1 AS idx FROM n) SELECT 'node' AS sort, idx AS a, CAST(flags AS BIGINT) AS b FROM c UNION ALL SELECT 'link', x.idx, y.idx FROM ({_LINKS}) l JOIN c x ON x.id = l.src JOIN c y ON y.id = l.dst WHERE l.src <> l.dst""",
    "a11_co_change": f"""WITH RECURSIVE e AS ({_EDITS}), f AS (SELECT skey, min(ts) AS start FROM e WHERE intent_id = '' GROUP BY skey UNION ALL SELECT f.skey, (SELECT min(n.ts) FROM e n WHERE n.intent_id = '' AND n.skey = f.skey AND n.ts - f.start > 1800) AS start FROM f WHERE f.start IS NOT NULL),
b AS (SELECT e.seq, e.path, e.skey, max(f.start) AS start FROM e JOIN f ON f.skey = e.skey AND f.start <= e.ts WHERE e.intent_id = '' GROUP BY e.seq, e.path, e.skey), p AS (SELECT DISTINCT skey || '@' || start AS ep, path FROM b UNION SELECT DISTINCT '#' || intent_id, path FROM e WHERE intent_id <> ''),
z AS (SELECT ep FROM p GROUP BY ep HAVING count(*) BETWEEN 2 AND 60) SELECT x.path AS a, y.path AS b, count(*) AS n FROM p x JOIN z ON z.ep = x.ep JOIN p y ON y.ep = x.ep AND x.path < y.path GROUP BY x.path, y.path""",
    "j21_similar": f"""WITH x AS ({_EXAMPLES}), r AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM x q JOIN x v ON v.vec_id <> q.vec_id AND v.label = q.label WHERE q.vec_id % 20 = 0 AND v.fresh AND (v.good + v.bad < 3 OR v.good >= v.bad)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM r WHERE score >= 0.8) SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, score FROM n WHERE place <= 10""",
}
ORACLE["j21_similar_wide"] = ORACLE["j21_similar"].replace("score >= 0.8", "score >= 0.1")
#: A walk over a graph with cycles: distances from the end, then the least step.
ORACLE["g8_path_in_cycles"] = """WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM bought UNION SELECT dst, src FROM bought), far AS (SELECT 'p61' AS node, 0 AS d UNION SELECT e.b, far.d + 1 FROM far JOIN e ON e.a = far.node WHERE far.d < 6),
near AS MATERIALIZED (SELECT node, min(d) AS d FROM far GROUP BY node), w AS (SELECT 'p120' AS node, 0 AS step, (SELECT d FROM near WHERE node = 'p120') AS left_over UNION ALL SELECT (SELECT min(e.b) FROM e JOIN near ON near.node = e.b WHERE e.a = w.node AND near.d = w.left_over - 1), w.step + 1, w.left_over - 1 FROM w WHERE w.left_over > 0)
SELECT CAST(step AS INTEGER) AS step, node FROM w WHERE left_over IS NOT NULL"""
ORACLE["g5_blast_in_cycles"] = f"""WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({_BOTH}) x), a AS (SELECT src AS node FROM e WHERE dst = 'p12'), p AS (SELECT node, row_number() OVER (ORDER BY node) AS place FROM a), b AS (SELECT e.src AS node, min(a.node) AS through FROM e JOIN a ON e.dst = a.node WHERE e.src <> 'p12' AND e.src NOT IN (SELECT node FROM a) GROUP BY e.src),
h AS (SELECT node, 1 AS hops, 'p12' AS through, place FROM p UNION ALL SELECT node, 2, through, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY through, node) FROM b) SELECT node, hops, through FROM h WHERE place <= 200"""
ORACLE["g7_neighbours_in_cycles"] = f"""WITH e AS MATERIALIZED ({_TRIANGLES}), one AS (SELECT node, min(way) AS way FROM (SELECT dst AS node, 0 AS way FROM e WHERE src = 'p20' UNION ALL SELECT src, 1 FROM e WHERE dst = 'p20') x GROUP BY node),
c AS (SELECT dst AS node, (o.way, o.node, 0) AS claim FROM one o JOIN e ON e.src = o.node UNION ALL SELECT e.src, (o.way, o.node, 1) FROM one o JOIN e ON e.dst = o.node), two AS (SELECT node, min(claim) AS claim FROM c WHERE node <> 'p20' AND node NOT IN (SELECT node FROM one) GROUP BY node)
SELECT node, CASE way WHEN 0 THEN 'depends_on' ELSE 'dependents' END AS side, '' AS via, 1 AS hops FROM one UNION ALL SELECT node, CASE claim[3] WHEN 0 THEN 'depends_on' ELSE 'dependents' END, claim[2], 2 FROM two"""
#: Co-changes by definition, then the projection over them.
ORACLE["a14_projection"] = f"""WITH RECURSIVE co AS (SELECT 'p' || regexp_extract(a, '/f([0-9]+)[.]', 1) AS a, 'p' || regexp_extract(b, '/f([0-9]+)[.]', 1) AS b, n FROM ({ORACLE['a11_co_change']}) x),
e AS (SELECT src AS a, dst AS b, CASE kind WHEN 'inherits' THEN 6 WHEN 'calls' THEN 4 WHEN 'uses_type' THEN 3 ELSE 2 END AS w FROM dep WHERE src <> dst UNION ALL SELECT a, b, 2 * n FROM co WHERE a <> b), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(w) / 2 AS w FROM e GROUP BY 1, 2)
SELECT a, b, CAST(w AS DOUBLE) AS w FROM p UNION ALL SELECT node, '', 0.0 FROM (SELECT 'p' || p_partkey AS node FROM part) s WHERE node NOT IN (SELECT a FROM e UNION SELECT b FROM e)"""
