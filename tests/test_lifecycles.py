"""Text functions, operations and lifecycles on hand-made rows and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallygraph.functions import operations, text
from tallygraph.operators import aliases as lc_aliases
from tallygraph.operators import lifecycles as lc


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


@pytest.mark.parametrize(
    "prompt, names",
    [
        ("Fix src/app/main.py, see https://x.org/a.py", ["src/app/main.py"]),
        ("call compute_tax and ToolSearch but not Likely or JSON", ["compute_tax", "ToolSearch"]),
        ("`recap` and `Bash` and `run` and `PM`", ["recap"]),
        ("`a.b_c::LoadFile x`", ["b_c", "LoadFile"]),
        ("pkg/util.py then util.py then UTIL.PY", ["pkg/util.py"]),
        ("a deadbeef12 commit, some_slug/part, foo-bar_baz", []),
        (".github/run_all.sh (and `.x`)", [".github/run_all.sh"]),
        ("x.tar.json-old.md.", ["x.tar.json-old.md"]),
        ("é_name naïve_x", ["_name", "ve_x"]),
        (None, []),
    ],
)
def test_prompt(prompt, names):
    assert text.names_in_prompt(prompt) == names


def test_prompt_is_bounded_and_linear():
    assert len(text.names_in_prompt(" ".join(f"name_{i}" for i in range(100)))) == text.MOST_IN_PROMPT
    assert text.names_in_prompt("a/" * 200_000) == []


def test_search_and_patch(spark):
    rows = [("cd x && rg -n 'load_file|save' src", ["load_file", "save"]), ("git grep --all find_me -- x", ["find_me"]), ("ls grep", []), ("grep -r a/b ./c Name Name", ["Name"]), (None, [])]
    df = spark.createDataFrame([(a,) for a, _ in rows], "c string")
    got = [r[0] for r in df.select(text.search_identifiers(F.col("c"))).collect()]
    assert got == [b for _, b in rows]
    patch = "*** Begin Patch\n*** Update File: a.py\n+*** Add File: no\n  *** Move to:  b c.py \r\n*** Delete File:\n*** Add File: a.py"
    assert spark.createDataFrame([(patch,)], "c string").select(text.patch_paths(F.col("c"))).first()[0] == ["a.py", "b c.py"]


@pytest.mark.parametrize(
    "x, name, key, owner, machine",
    [
        ("https://GitHub.com/Acme/App.git", "app", "github.com/acme/app", "acme", False),
        ("git@github.com:acme/app", "app", "github.com/acme/app", "acme", False),
        ("C:\\src\\app", "app", "c:\\src\\app", "", True),
        ("app#main", "app#main", "app", "", False),
        ("local/x", "x", "local/x", "local", True),
        (" /home/u/app/ ", "app", "/home/u/app", "u", True),
    ],
)
def test_repository_keys(spark, x, name, key, owner, machine):
    df = spark.createDataFrame([(x,)], "id string")
    got = df.selectExpr(text.repo_name("id"), text.repo_key("id"), text.repo_owner("id"), text.machine_folder("id")).first()
    assert tuple(got) == (name, key, owner, machine)


def test_operations(spark):
    rows = ['[{"op":"rename","symbol":" a ","new_name":"b","x":1}]', '[{"op":"delete","symbol":"b"}, {"op":"add_param","symbol":"c","name":"n","default":3}]', "[]", "{}", None, "[1]", '[{"op":"add","symbol":"a"},{"op":"extract","symbol":"b"}]']
    got = [r.v for r in spark.createDataFrame([(r,) for r in rows], "j string").select(operations.validated(F.col("j")).alias("v")).collect()]
    assert got[0].ops == [{"op": "rename", "symbol": "a", "new_name": "b"}] and got[0].error is None
    assert got[1].ops[1] == {"op": "add_param", "symbol": "c", "name": "n", "default": "3"}
    assert all(g.ops is None and g.error for g in got[2:]) and got[6].error == "operations[1]: extract needs 'new_name'"
    ops = spark.createDataFrame([("s", 1, "u", got[0].ops[0]), ("s", 2, "v", got[1].ops[0]), ("s", 3, "v", got[1].ops[1]), ("t", 4, "v", got[1].ops[0]), ("s", 5, "w", {"op": "rename", "symbol": "b", "new_name": "a"}), ("s", 6, "w", {"op": "extract", "symbol": "c", "new_name": "d"})], "scope string, id long, owner string, op map<string,string>")
    found = {(r.mine, r.theirs): r.verdict for u in "uvw" for r in operations.conflicts(ops, u).collect()}
    assert {k: v for k, v in found.items() if k[0] < k[1]} == {(1, 2): "CONFLICT", (1, 5): "CONFLICT", (2, 5): "CONFLICT", (3, 6): "UNKNOWN"}
    a, b = ops.where("id = 1").selectExpr("op AS a"), ops.where("id in (2, 5)").selectExpr("id", "op AS b")
    assert {r.id: r.u for r in b.join(a).select("id", operations.undoes(F.col("b"), F.col("a")).alias("u")).collect()} == {2: False, 5: True}


def test_claims_equal_a_plain_fold(spark):
    rnd = random.Random(5)
    claims, writes, want = [], [], []
    state, counter, high = {}, {}, {}
    for seq in range(400):
        ts, usr, ses, d = seq * 2000.0, rnd.choice("ab"), rnd.choice(["", "1", "2"]), rnd.choice("de")
        if rnd.random() < 0.3:
            counter[d] = n = max(counter.get(d, 0), high.get(d, 0)) + 1
            claims.append(("s", d, seq, ts, usr, ses))
            state[d, n] = {"usr": usr, "ses": ses, "ts": ts, "path": None, "told": set()}
            continue
        n = max(1, counter.get(d, 0) - rnd.randrange(4) + 1)
        path = f"{d}/{n}{rnd.choice('xy')}"
        writes.append(("s", d, n, seq, ts, usr, ses, path))
        x = state.get((d, n))
        high[d] = max(high.get(d, 0), n)
        if x is None or x["path"] == path:
            continue
        live = x["path"] is None and ts - x["ts"] < lc.OPEN_SPAN
        if live and usr == x["usr"] and (not ses or not x["ses"] or ses == x["ses"]):
            x["path"] = path
            want.append((d, n, seq, usr, "filled"))
        elif (live or x["path"] is not None) and path not in x["told"]:
            x["told"].add(path)
            want.append((d, n, seq, usr, "conflict"))
    c = spark.createDataFrame(claims, "scope string, dir string, seq long, ts double, usr string, session string")
    w = spark.createDataFrame(writes, "scope string, dir string, number long, seq long, ts double, usr string, session string, path string")
    numbered = lc.number_claims(c, w)
    assert sorted((r.dir, r.number) for r in numbered.collect()) == sorted(state)
    got = [(r.dir, r.number, r.seq, r.usr, r.status) for r in lc.claim_outcomes(numbered, w).collect()]
    assert {g[4] for g in got} == {"filled", "conflict"} and sorted(got) == sorted(want)


def test_reconcile():
    stale = {"symbol": "f", "rule": "stale_name", "change_ts": 1, "fix": "judgment"}
    drift = {"symbol": "g", "rule": "signature_drift", "change_ts": 2, "fix": "judgment"}
    rid = lc.reconciliation_id("p", "g", "signature_drift", "u")
    got = lc.reconcile({}, "p", "u", [(1, 0.0, [stale, drift]), (2, 1.0, [drift]), (3, 2.0, rid), (4, 3.0, [drift]), (5, 4.0, [drift, stale]), (6, 5.0, [drift | {"change_ts": 9}]), (7, 9e4, [stale | {"fix": "safe"}])])
    assert got == [
        (1, "f", "stale_name", "delivered"), (1, "g", "signature_drift", "delivered"),
        (2, "g", "signature_drift", "delivered"), (2, "f", "stale_name", "resolved"),
        (4, "g", "signature_drift", "delivered"), (4, "g", "signature_drift", "resolved"),
        (6, "g", "signature_drift", "delivered"),
        (7, "f", "stale_name", "delivered"), (7, "g", "signature_drift", "resolved"),
    ]


def test_blocks(spark):
    rows = [("a", 1, 0, "x" * 50), ("a", 1, 1, "y"), ("a", 2, 0, "abc"), ("a", 2, 1, "de"), ("a", 2, 2, "f" * 9), ("a", 2, 3, "g"), ("a", 3, 0, "h" * 8), ("b", 1, 0, "i")]
    got = {(r.listing, r.place): (r.block, r.shown) for r in lc.blocks(spark.createDataFrame(rows, "listing string, place int, line_no int, line string"), 8, 20).collect()}
    assert got["a", 1] == ("x" * 50 + "\n  ...", True)
    assert got["a", 2] == ("abc\nde\n  ...", False) and got["b", 1] == ("i", True)


def test_patched_equals_a_full_build(spark):
    rnd = random.Random(3)
    files = [f"d{i % 5}/{'x' * (i % 3)}{i}.py" for i in range(40)]
    before = [(f, f"n{rnd.randrange(60)}") for f in files for _ in range(3)]
    gone = set(files[:4])
    after = [x for x in before if x[0] not in gone] + [(f, f"n{rnd.randrange(60)}") for f in files[1:4]]
    lookups = [(f, f"n{rnd.randrange(60)}") for f in files for _ in range(4)]
    df = lambda rows, c: spark.createDataFrame(rows, c)
    b, a, q = (df(x, "path string, name string") for x in (before, after, lookups))
    got = lc.patched(lc.resolve(q, b), b, a, q, df([(g,) for g in gone], "path string"))
    full = lc.resolve(q, a)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))


def test_structure_travels(spark):
    sent = '{"status":"clean","symbols":[{"name":"f","hash":"1"},{"name":"","hash":"2"},{"name":"g"}],"imports":[],"doc":"d"}'
    rows = [("a/b.PY", sent), ("a.sql", sent), ("b.py", sent.replace("clean", "odd")), ("b.py", None), ("b.py", "{}")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, s string").select(lc.from_structure(F.col("p"), F.col("s"))).collect()]
    assert [s.name for s in got[0].symbols] == ["f"] and got[0].doc == "d" and got[1:] == [None] * 4


def test_reconciliations_stream_and_are_bounded(spark, monkeypatch):
    import json

    rnd = random.Random(3)
    rows = []
    for i in range(300):
        found = [{"symbol": f"s{rnd.randrange(5)}", "rule": rnd.choice(["signature_drift", "stale_name"]), "change_ts": rnd.randrange(3), "fix": rnd.choice(["judgment", "judgment", "safe"])} for _ in range(rnd.randrange(4))]
        body = rnd.choice([json.dumps(found), json.dumps(found), json.dumps(lc.reconciliation_id("p", "s1", "signature_drift", "u")), None])
        rows.append(("s", rnd.choice("pq"), rnd.choice("uv"), i, float(i * 700), body))
    df = spark.createDataFrame(rows, "scope string, path string, usr string, seq long, ts double, body string")
    for most in (2, 100):
        want = []
        for key in {r[:3] for r in rows}:
            reports = [(q, t, json.loads(b) if b else []) for *k, q, t, b in rows if tuple(k) == key]
            state = {}
            want += [(*key, *x) for x in lc.reconcile(state, key[1], key[2], reports, most)]
            assert len(state) <= most
        assert sorted(tuple(r) for r in lc.reconciliations(df, most).collect()) == sorted(want)
    told = {}
    for scope, path, usr, seq, symbol, rule, what in sorted(want, key=lambda r: r[3]):
        told[scope, path, usr, symbol, rule] = (what, seq)
    assert {tuple(r)[:5]: r.since for r in lc.pending(df).collect()} == {k: seq for k, (what, seq) in told.items() if what == "delivered"}


def test_aliases_equal_a_plain_fold(spark):
    rnd = random.Random(9)
    parts = ["", "acme/", "other/", "host/acme/", "https://host/acme/", "git@host:acme/"]
    ids = [rnd.choice(parts) + rnd.choice(["app", "api", "web"]) + rnd.choice(["", "", ".git", "#dev"]) for _ in range(60)]
    seen = [(w, x, i) for i, (w, x) in enumerate((rnd.choice("pqrst"), x) for x in ids[:30])]
    renames = [("p", "old", "acme/app#dev"), ("p", "api", "web"), ("q", "acme/web", "gone")]

    def name(x):
        for s in ("https://", "git@"):
            x = x.removeprefix(s)
        return x.replace(":", "/").removesuffix(".git").rsplit("/", 1)[-1]

    def key(x):
        x = x.removeprefix("https://")
        x = x[4:].replace(":", "/", 1) if x.startswith("git@") else x
        return x.split("#")[0].removesuffix(".git")

    best, unsure = {}, set()
    for w, x, _ in seen:
        k = (w, name(x))
        if k in unsure or best.get(k) == x:
            continue
        if k not in best or x.count("/") > best[k].count("/"):
            best[k] = x
        elif x.count("/") == best[k].count("/"):
            unsure.add(k)
            del best[k]
    to = {(w, a): b for w, a, b in renames}

    def find(w, x, depth=0):
        x = to.get((w, x), x)
        if "#" in x and (w, name(x.split("#")[0])) in best:
            return find(w, x.split("#")[0], depth + 1)
        c = best.get((w, name(x)))
        return x if c is None or (c != x and "/" in c and "/" in x and key(c) != key(x)) else c

    asked = sorted({(w, x) for w in "pqrst" for x in [*ids, "old", "unknown"]})
    df = lambda rows, c: spark.createDataFrame(rows, c)
    got = lc_aliases.resolve_ids(df(asked, "ws string, id string"), lc_aliases.seed_aliases(df(seen, "ws string, id string, seq int")), df(renames, "ws string, id string, new_id string"))
    assert {(r.ws, r.id): r.canonical for r in got.collect()} == {(w, x): find(w, x) for w, x in asked}
