"""Communities, groups and graph files against brute force and round trips."""

import random

import pytest

from tallygraph.operators import communities, graph, modules
from tallygraph.sources import graphio


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def modularity(edges, of):
    m = sum(w for _, _, w in edges)
    inner, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0) + w
        if of[a] == of[b]:
            inner[of[a]] = inner.get(of[a], 0) + w
    return sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def test_louvain_finds_planted_groups(spark):
    rng = random.Random(3)
    edges = {(a, b): 1.0 for a in range(60) for b in range(a) if rng.random() < (0.7 if a // 10 == b // 10 else 0.01)}
    rows = [(f"n{a}", f"n{b}", w) for (a, b), w in edges.items()]
    got = {r.node: r.community for r in communities.louvain(spark.createDataFrame(rows, "a string, b string, w double"), spark.createDataFrame([("alone",), ("n3",), (None,)], "node string")).collect()}
    assert got.pop("alone") == "alone"
    planted = {f"n{i}": i // 10 for i in range(60)}
    assert set(got) == {x for a, b, _ in rows for x in (a, b)}
    assert modularity(rows, got) >= modularity(rows, planted) - 0.03
    fine = {r.node: r.community for r in communities.louvain(spark.createDataFrame(rows, "a string, b string, w double"), resolution=8.0).collect()}
    assert len(set(fine.values())) > len(set(got.values()))


def test_louvain_broadcasts_nothing(spark):
    shown = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = shown().size()
    rows = [(f"n{a}", f"n{b}", 1.0) for a in range(12) for b in range(a) if a // 4 == b // 4 or a - b == 4]
    edges, nodes = spark.createDataFrame(rows, "a string, b string, w double"), spark.createDataFrame([("alone",)], "node string")
    assert len(communities.louvain(edges, nodes).collect()) == 13
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [shown().apply(i).physicalPlanDescription() for i in range(before, shown().size())]
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_louvain_of_nothing(spark):
    assert communities.louvain(spark.createDataFrame([], "a string, b string, w double")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1090)] + [(7, 7)]
    root = {x: x for r in rows for x in r}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in communities.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_groups_by_shared_files_and_transforms(spark):
    impact = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "d"), (7, "z"), (9, "q")], "unit long, file string")
    transforms = spark.createDataFrame([(0, "", ""), (1, "rename", ""), (2, "rename", "x"), (3, "rename", "x"), (4, "delete", "x"), (5, "", "x"), (6, None, None), (8, "delete", "y"), (7, "delete", "y")], "unit long, op string, symbol string")
    got = {r.unit: (r.grp, r.place) for r in communities.work_groups(impact, transforms).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 2), 3: (2, 2), 4: (4, 3), 5: (5, 4), 6: (6, 5), 7: (7, 6), 8: (7, 6), 9: (9, 7)}
    plan = [tuple(r) for r in communities.work_plan(impact, transforms).orderBy("place").collect()]
    assert plan == [(1, 0, 2, 3, "shared impact"), (2, 2, 2, 1, "same transform"), (3, 4, 1, 0, "independent"), (4, 5, 1, 0, "independent"), (5, 6, 1, 0, "independent"), (6, 7, 2, 1, "same transform"), (7, 9, 1, 1, "independent")]
    assert communities.work_groups(impact.limit(0), transforms.limit(0)).count() == 0


def test_names_are_unique(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "2")], "node string, community string")
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("d", "e", 1.0)], "a string, b string, w double")
    d = spark.createDataFrame([(x, "lib") for x in "abcde"], "node string, dir string")
    got = {r.community: (r["size"], r["name"], r.hub, r.place) for r in communities.name_communities(m, e, d).collect()}
    assert got == {"1": (3, "lib", "b", 1), "2": (2, "lib 2", "d", 2)}


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("x.py::f",), ("y'\"<&.py",)], "id string")
    edges = spark.createDataFrame([("x.py::f", "y'\"<&.py", "Extends", "extracted", 1.0), ("z.py#g", "x.py::f", "co_change", "inferred", 3.0)], "src string, dst string, kind string, confidence string, weight double")
    graphio.write_graph(nodes, edges, str(tmp_path / "g"), "JSON ")
    got = graphio.read_graph(spark.read.text(str(tmp_path / "g")), spark.createDataFrame([("z.py",)], "path string")).collect()
    assert sorted((r.src, r.dst, r.kind, r.src_path, r.skipped) for r in got) == [("x.py::f", "y'\"<&.py", "inherits", "x.py", False), ("z.py#g", "x.py::f", "co_change", "z.py", True)]
    text = [r.value for r in graphio.lines(nodes, edges, "cypher").collect()]
    assert "MERGE (:Node {id: 'y\\'\"<&.py'});" in text
    assert '<node id="y\'&quot;&lt;&amp;.py"/>' in [r.value for r in graphio.lines(nodes, edges, "graphml").collect()]
    with pytest.raises(ValueError):
        graphio.lines(nodes, edges, "dot")


def test_transcript_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"usage": 1}\n{"x": 2}\n{"usage": 3}\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"usage": 9, "pad": "' + "x" * graphio.TAIL + '"}\n{"y": 1}\n')
    got = graphio.last_usage(spark, str(tmp_path)).collect()
    assert [r.line for r in got] == ['{"usage": 3}']


def random_edges(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)})
    return rows, spark.createDataFrame(rows, "src string, dst string")


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_equal_plain_searches(spark, seed):
    rows, df = random_edges(spark, seed)
    out, back = {}, {}
    for a, b in rows:
        if a != b:
            out.setdefault(a, set()).add(b)
            back.setdefault(b, set()).add(a)
    # blast radius, with its cap in the middle of a level
    for limit in (5, 200):
        want, seen, level = [], {"n1"}, ["n1"]
        for hop in range(1, 5):
            found = []
            for node in level:
                for x in sorted(back.get(node, ())):
                    if x not in seen and len(want) + len(found) < limit:
                        seen.add(x)
                        found.append((x, hop, node))
            want += found
            level = sorted(x for x, _, _ in found)
            if not found or len(want) >= limit:
                break
        assert sorted(map(tuple, graph.blast_radius(df, "n1", 4, limit=limit).collect())) == sorted(want)
    # both sides with one seen set, successors first
    want, seen, front = [], {"n1"}, ["n1"]
    for hop in (1, 2, 3):
        after = []
        for node in front:
            for side, near in (("depends_on", out), ("dependents", back)):
                for x in sorted(near.get(node, ())):
                    if x not in seen:
                        seen.add(x)
                        after.append(x)
                        want.append((x, side, "" if hop == 1 else node, hop))
        front = after
    assert sorted(map(tuple, graph.neighbours(df, "n1", 3).collect())) == sorted(want)
    # breadth first in queue order
    both = {x: out.get(x, set()) | back.get(x, set()) for x in {*out, *back}}
    parent, queue = {"n1": None}, ["n1"]
    for node in queue:
        for x in sorted(both[node]):
            if x not in parent:
                parent[x] = node
                queue.append(x)
    for end in queue[-3:]:
        path, node = [], end
        while node:
            path.append(node)
            node = parent[node]
        assert [r.node for r in graph.shortest_path(df, "n1", end).orderBy("step").collect()] == path[::-1]
    assert graph.shortest_path(df, "n1", "nowhere").count() == 0


def test_places_by_range_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS v", "'x' AS idy").repartition(7)
    got = graph.numbered(df, "v").collect()
    assert sorted(r.idx for r in got) == list(range(1000)) and all(r.idx == r.v for r in got)


def test_modules_by_hand(spark):
    known = ["src/a/x.py", "src/a/__init__.py", "lib/a/x.py", "src/b/y.ts", "src/b/z/index.ts", "core/src/m/mod.rs", "core/src/n.rs", "java/org/acme/K.java", "go/svc/main.go", "inc/d.h", "rb/e.rb"]
    asked = [
        ("src/a/q.py", "python", "a.x", "src/a/x.py"), ("lib/q.py", "python", "a.x", "lib/a/x.py"), ("src/a/q.py", "python", ".x", "src/a/x.py"), ("src/b/q.py", "python", "..a.x", "src/a/x.py"), ("src/a/q.py", "python", ".", "src/a/__init__.py"),
        ("src/b/q.ts", "typescript", "./y.js", "src/b/y.ts"), ("src/b/q.ts", "typescript", "./z", "src/b/z/index.ts"), ("web/q.ts", "typescript", "@/b/y", "src/b/y.ts"), ("src/b/q.ts", "typescript", "react", None), ("src/c/q.tsx", "tsx", "../b/./y", "src/b/y.ts"), ("web/a.ts", "typescript", "../../src/b/y", None), ("web/a.ts", "typescript", "../src/b/y", "src/b/y.ts"), ("top.ts", "typescript", "../src/b/y", None),
        ("core/src/lib.rs", "rust", "crate::m", "core/src/m/mod.rs"), ("core/src/m/mod.rs", "rust", "super::n", "core/src/n.rs"), ("core/src/lib.rs", "rust", "self::n", "core/src/n.rs"), ("core/src/lib.rs", "rust", "n", "core/src/n.rs"),
        ("x/Q.java", "java", "org.acme.K", "java/org/acme/K.java"), ("x/Q.java", "java", "org.Acme", "java/org/acme/"), ("m.go", "go", "host.io/x/svc", "go/svc/"), ("m.go", "go", "fmt", None), ("src/q.c", "c", "../inc/d.h", "inc/d.h"), ("rb/q.rb", "ruby", "./e", "rb/e.rb"), ("q.py", "python", "  ", None),
    ]
    df = spark.createDataFrame([a[:3] for a in asked], "from_path string, language string, module string")
    got = {tuple(r[:3]): r.path for r in modules.resolve_modules(df, spark.createDataFrame([(k,) for k in known], "path string")).collect()}
    assert got == {a[:3]: a[3] for a in asked}


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_similar_tasks_guards(spark, block):
    rows = [(0, [1.0, 0.0], 1, True, 0, 0), (1, [1.0, 0.1], 1, True, 0, 2), (2, [1.0, 0.2], 1, True, 1, 3), (3, [1.0, 0.0], 2, True, 9, 0), (4, [1.0, 0.0], 1, False, 9, 0), (5, [0.0, 1.0], 1, True, 9, 0), (6, [1.0, 0.05], 1, True, 2, 2)]
    rows += [(7, None, 1, True, 0, 0), (8, [0.0, 0.0], 1, True, 0, 0), (9, [1.0, float("nan")], 1, True, 0, 0), (10, [1.0, 0.0, 0.0], 1, True, 0, 0), (11, [1.0, 0.0], None, True, 0, 0), (12, [5e200, 5e199], 1, True, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, fresh boolean, good int, bad int")
    got = {}
    for r in graph.similar_tasks(df, "vec_id in (0, 5, 99)", block=block, limit=2).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id))
    assert got == {0: [(1, 6), (2, 1)]}
    every = graph.similar_tasks(df, "true", block=block).collect()
    assert {r.vec_id for r in every if r.query_id == 4} == {0, 1, 6, 12} and all(r.score >= 0.8 for r in every)
    assert graph.similar_tasks(df, "vec_id = 99").count() == 0
    assert graph.similar_tasks(df.limit(0), "true").count() == 0


def test_shortest_path_on_random_graphs(spark):
    """Cycles, ties and parts without a way between them."""
    for seed in range(4):
        rng = random.Random(seed)
        pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(45 + 10 * seed)}
        df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "src string, dst string")
        near = {}
        for a, b in pairs:
            if a != b:
                near.setdefault(f"n{a:02}", set()).add(f"n{b:02}")
                near.setdefault(f"n{b:02}", set()).add(f"n{a:02}")
        ends = [f"n{rng.randrange(40):02}" for _ in range(2)]
        queue, seen, want = [[ends[0]]], {ends[0]}, []
        while queue and not want:
            trail = queue.pop(0)
            if trail[-1] == ends[1]:
                want = trail
            for x in sorted(near.get(trail[-1], ())):
                if x not in seen:
                    seen.add(x)
                    queue.append([*trail, x])
        assert [r.node for r in graph.shortest_path(df, *ends).orderBy("step").collect()] == want


def test_path_of_many_hops(spark):
    df = spark.createDataFrame([(f"m{i:02}", f"m{i + 1:02}") for i in range(31)], "src string, dst string")
    assert [r.node for r in graph.shortest_path(df, "m31", "m00").orderBy("step").collect()] == [f"m{i:02}" for i in range(31, -1, -1)]
    assert [r.node for r in graph.shortest_path(df, "m04", "m04").collect()] == ["m04"]


def test_co_change_bounds_its_episodes(spark):
    rows = [("a", i, float(i), f"p{i % 5}", "") for i in range(5)] + [("b", 100 + i, 0.0, f"q{i}", "") for i in range(61)] + [("a", 10, 2000.0, "p9", ""), ("a", 11, 2000.0, "p0", "i1"), ("c", 12, 9.0, "p1", "i1")]
    df = spark.createDataFrame(rows, "skey string, seq long, ts double, path string, intent_id string")
    got = {(r.a, r.b): r.n for r in graph.co_change(df).collect()}
    assert got == {(f"p{i}", f"p{j}"): 1 + ((i, j) == (0, 1)) for i in range(5) for j in range(i + 1, 5)}
    dep = spark.createDataFrame([("p1", "p0", "calls"), ("p0", "p0", "calls"), ("p7", "p8", "inherits")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("p0",), ("p7",), ("lonely",)], "node string")
    rows = {(r.a, r.b): r.w for r in graph.projection(dep, graph.co_change(df), nodes).collect()}
    assert rows["p0", "p1"] == (4 + 2 * 2) / 2 and rows["p7", "p8"] == 3.0 and rows["lonely", ""] == 0.0 and len(rows) == 12


def test_neighbours_hold_no_set_of_all_edges(spark, monkeypatch):
    """Edges are written as they come; only what a level finds is grouped."""
    plans, cut = [], graph._cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "_cut", seen)
    graph.QUERIES["g7_neighbours_in_cycles"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and "Aggregate" not in plans[0]
    edges = [("a", "b"), ("c", "a"), ("b", "d"), ("c", "d")]
    once, twice = [sorted(map(tuple, graph.neighbours(spark.createDataFrame(edges * n, "src string, dst string"), "a", 2).collect())) for n in (1, 2)]
    assert once == twice == [("b", "depends_on", "", 1), ("c", "dependents", "", 1), ("d", "depends_on", "b", 2)]
