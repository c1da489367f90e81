"""Claims on numbers, reconciliations, blocks under a budget, the incremental
graph and structure that travels in place of source."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import STRUCTURE
from ..functions.operations import conflicts, validated
from ..functions.scanners import LANGUAGES
from ..functions.text import patch_paths, prompt_identifiers, search_identifiers
from ..sources.adapters import view
from .folds import fit_budget, ordered_fold
from .modules import parsed

#: Seconds for which a claim that nobody filled holds its number.
OPEN_SPAN = 3 * 86400.0
#: Seconds for which a settled reconciliation is remembered.
SETTLED_SPAN = 6 * 3600.0
#: Fixed value of the rule: records kept of a path and user.
MOST_RECORDS = 100


def number_claims(claims: DataFrame, ask: DataFrame) -> DataFrame:
    """``claims`` (scope, dir, seq, ...) with ``number``: the next one that no
    claim and no file written before it has.  ``ask``: (scope, dir, seq, number)
    of written files.

    A counter that is lifted to a floor f and raised by one at each claim stands
    at i + max(f_j - j + 1) over the claims j up to i, so a running maximum gives
    it.  One (scope, dir) is ordered in a task."""
    keys = ["scope", "dir"]
    both = claims.withColumn("used", F.lit(0)).withColumn("_c", F.lit(True)).unionByName(ask.select(*keys, "seq", F.col("number").alias("used"), F.lit(False).alias("_c")), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("seq", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floor = both.withColumn("floor", F.max("used").over(upto)).where("_c").drop("used", "_c")
    order = Window.partitionBy(*keys).orderBy("seq")
    ranked = floor.withColumn("i", F.row_number().over(order))
    return ranked.withColumn("number", (F.col("i") + F.max(F.col("floor") - F.col("i") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).cast("long")).drop("floor", "i")


def claim_outcomes(claims: DataFrame, writes: DataFrame, span: float = OPEN_SPAN) -> DataFrame:
    """(scope, dir, number, owner, usr, path, seq, status): what writes do to
    numbered claims.  The claimer's first write while the claim is open fills
    it; another's write of the number, or of another file once it is filled, is
    a clash, told once per path.  A claim that ran out unfilled says nothing.

    ``claims``: scope, dir, number, seq, ts, usr, session; ``writes``: the same
    and path.  A session that is empty fits any of its user's."""
    c = claims.select("scope", "dir", "number", F.col("seq").alias("claimed"), F.col("ts").alias("since"), F.col("usr").alias("owner"), F.col("session").alias("own_session"))
    met = writes.join(c, ["scope", "dir", "number"]).where("seq > claimed")
    met = met.withColumn("open", F.col("ts") - F.col("since") < span)
    own = (F.col("usr") == F.col("owner")) & ((F.col("session") == "") | (F.col("own_session") == "") | (F.col("session") == F.col("own_session")))
    key = ["scope", "dir", "number", "claimed"]
    filled = met.where(F.col("open") & own).groupBy(*key).agg(F.min(F.struct("seq", "path")).alias("fill"))
    told = met.join(filled, key, "left")
    status = F.when(F.col("seq") == F.col("fill.seq"), "filled").when(F.col("seq") > F.col("fill.seq"), F.when(F.col("path") != F.col("fill.path"), "conflict")).when(F.col("open"), "conflict")
    told = told.withColumn("status", status).where("status is not null")
    first = told.groupBy(*key, "owner", "path", "status").agg(F.min(F.struct("seq", "usr")).alias("w"))
    return first.select("scope", "dir", "number", "owner", "w.usr", "path", "w.seq", "status")


def reconcile(state: dict, path: str, usr: str, reports, most: int | None = None) -> list[tuple]:
    """Folds the reports of one (path, usr) into ``state`` {id: record}.  A report
    is (seq, ts, findings), a finding {symbol, rule, change_ts, fix}, or (seq, ts,
    id) for a claim of the record ``id``; returns (seq, symbol, rule, what), what
    being delivered or resolved.

    What needs judgment is open until a report no longer shows its symbol; a
    drifted signature is settled by the next report after its claim.  A settled
    record keeps the same change quiet, and is forgotten after a span; of more
    than ``most`` records those of the first ids are kept, so that a state is
    bounded."""
    most = MOST_RECORDS if most is None else most
    out: list[tuple] = []
    for seq, ts, body in reports:
        if isinstance(body, str):
            if state.get(body, {}).get("status") == "open":
                state[body]["claimed"] = ts
            continue
        for rid in [r for r, x in state.items() if x["status"] == "resolved" and ts - x["at"] >= SETTLED_SPAN]:
            del state[rid]
        shown = set()
        for f in body:
            if f.get("fix") == "judgment":
                rid = reconciliation_id(path, f["symbol"], f["rule"], usr)
                old = state.get(rid)
                if old and old["status"] == "resolved" and old["change_ts"] == f["change_ts"]:
                    continue
                if old is None or old["status"] == "resolved":
                    state[rid] = {"symbol": f["symbol"], "rule": f["rule"], "change_ts": f["change_ts"], "status": "open", "claimed": None, "at": ts}
                shown.add(f["symbol"])
            out.append((seq, f["symbol"], f["rule"], "delivered"))
        for rid in sorted(state):
            x = state[rid]
            acted = x["rule"] == "signature_drift" and x["claimed"] is not None and ts > x["claimed"]
            if x["status"] == "open" and (acted or x["symbol"] not in shown):
                x |= {"status": "resolved", "at": ts}
                out.append((seq, x["symbol"], x["rule"], "resolved"))
        for rid in sorted(state)[most:]:
            del state[rid]
    return out


def reconciliation_id(path: str, symbol: str, rule: str, usr: str) -> str:
    return hashlib.sha1(f"{path}|{symbol}|{rule}|{usr}".encode()).hexdigest()[:12]


def reconciliations(reports: DataFrame, most: int | None = None) -> DataFrame:
    """``reconcile`` per (scope, path, usr) of rows (scope, path, usr, seq, ts,
    body), body being the findings as JSON, or a JSON string for a claim.  Rows
    pass one by one in the order of ``seq``, so a task holds one key's records
    and not its reports.  A null body is a report without findings."""

    def step(state: dict, row: tuple) -> list[tuple]:
        path, usr, seq, ts, body = row
        return reconcile(state, path, usr, [(seq, ts, json.loads(body) if isinstance(body, str) else [])], most)

    named = reports.withColumns({"of_path": F.col("path"), "of_usr": F.col("usr")})
    return ordered_fold(named, ["scope", "path", "usr"], ["seq"], ["of_path", "of_usr", "seq", "ts", "body"], dict, step, "scope string, path string, usr string, seq long, symbol string, rule string, what string")


def pending(reports: DataFrame) -> DataFrame:
    """(scope, path, usr, symbol, rule, since): what was delivered and not
    resolved since."""
    told = reconciliations(reports).groupBy("scope", "path", "usr", "symbol", "rule")
    last = told.agg(F.max(F.when(F.col("what") == "resolved", F.col("seq"))).alias("done"), F.max(F.when(F.col("what") == "delivered", F.col("seq"))).alias("since"))
    return last.where(F.col("since").isNotNull() & (F.coalesce("done", F.lit(-1)) < F.col("since"))).drop("done")


def blocks(lines: DataFrame, cap: int, budget: int) -> DataFrame:
    """(listing, place, block, shown): the lines of a module as a block of at
    most ``cap`` bytes, cut at a whole line, and which blocks fit the budget.

    ``lines``: listing, place, line_no, line.  The first line of a block and the
    first block of a listing always stay; a block that does not fit is passed
    over, and those after it are still tried."""
    order = Window.partitionBy("listing", "place").orderBy("line_no")
    size = F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    sized = lines.withColumn("upto", size).withColumn("n", F.row_number().over(order)).withColumn("kept", (F.col("n") == 1) | (F.col("upto") <= cap))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line")))), lambda x: x["line"]))
    made = sized.groupBy("listing", "place").agg(text.alias("block"), (~F.bool_and("kept")).alias("cut"))
    made = made.withColumn("block", F.concat("block", F.when(F.col("cut"), "\n  ...").otherwise("")))
    first = made.groupBy("listing").agg(F.min(F.struct("place", F.octet_length("block").alias("bytes"))).alias("f"))
    sizes = made.join(first, "listing").select("listing", "place", F.when(F.col("place") == F.col("f.place"), F.least(F.octet_length("block"), F.lit(budget))).otherwise(F.octet_length("block")).alias("bytes"))
    fit = fit_budget(sizes, "listing", budget).withColumn("shown", F.lit(True))
    return made.join(fit, ["listing", "place"], "left").select("listing", "place", "block", F.coalesce("shown", F.lit(False)).alias("shown"))


def resolve(lookups: DataFrame, declared: DataFrame) -> DataFrame:
    """(src, name, dst): each name that a file looks up and the file it is from:
    its own, else the shortest path of its directory, else of all, that declares
    it.  ``lookups``, ``declared``: path, name."""
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    best = F.min(F.struct(F.length("path"), F.col("path").alias("p")))["p"]
    own = declared.select("path", "name").distinct().withColumn("own", F.col("path"))
    near = declared.groupBy(folder.alias("dir"), "name").agg(best.alias("near"))
    everywhere = declared.groupBy("name").agg(best.alias("any"))
    x = lookups.select("path", "name").distinct().withColumn("dir", folder)
    x = x.join(own, ["path", "name"], "left").join(near, ["dir", "name"], "left").join(everywhere, "name", "left")
    return x.select(F.col("path").alias("src"), "name", F.coalesce("own", "near", "any").alias("dst")).where("dst is not null")


def patched(edges: DataFrame, before: DataFrame, after: DataFrame, lookups: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges of ``resolve(lookups, after)`` from those that ``before`` gave:
    only changed files, and files that look up a name whose declarations moved,
    are resolved again.  ``changed``: path of each file with a new parse, gone
    ones included."""
    moved = before.select("path", "name").exceptAll(after.select("path", "name")).union(after.select("path", "name").exceptAll(before.select("path", "name"))).select("name").distinct()
    redo = lookups.join(moved, "name", "left_semi").select("path").union(changed.select("path")).distinct()
    kept = edges.join(redo.withColumnRenamed("path", "src"), "src", "left_anti")
    asked = lookups.join(redo, "path", "left_semi")
    wanted = after.join(asked.select("name").distinct(), "name", "left_semi")
    return kept.select("src", "name", "dst").union(resolve(asked, wanted))


#: Extensions of the one language parsed here.
PARSED = ["pyi", *LANGUAGES]


def from_structure(path: Column, sent: Column) -> Column:
    """Column typed as ``STRUCTURE`` of JSON that a client sent in place of the
    source; null if no parser reads such a path or the status is none of a
    parser's.  Symbols without a name or a hash are left out."""
    s = F.from_json(sent, STRUCTURE)
    whole = F.filter(s["symbols"], lambda x: (F.coalesce(x["name"], F.lit("")) != "") & (F.coalesce(x["hash"], F.lit("")) != ""))
    known = F.lower(F.substring_index(path, ".", -1)).isin(*PARSED) & s["status"].isin("clean", "partial") & s["symbols"].isNotNull()
    return F.when(known, s.withField("symbols", whole))


def claim_paths(outcomes: DataFrame, claims: DataFrame) -> DataFrame:
    """(scope, dir, sort, n, items): paths that fill a claim and paths that
    clash with one, sorted, and the numbers still open, by sequence."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    done = outcomes.groupBy("scope", "dir", F.when(F.col("status") == "filled", "filled").otherwise("clash").alias("sort")).agg(F.count_distinct("path").alias("n"), listed("path").alias("items"))
    left = claims.join(outcomes.where("status = 'filled'").select("scope", "dir", "number").distinct(), ["scope", "dir", "number"], "left_anti")
    left = left.groupBy("scope", "dir").agg(F.count_distinct("number").alias("n"), listed(F.lpad(F.col("number").cast("string"), 6, "0")).alias("items"))
    return done.union(left.select("scope", "dir", F.lit("open"), "n", "items"))


def _claims(s, d):
    led = view(s, d, "ledger").selectExpr("scope", "root AS dir", "seq", "ts", "model AS usr", "'' AS session", "kind", "k AS number", "concat(root, '/', CAST(k AS STRING), CASE WHEN seq % 2 = 0 THEN '' ELSE '_b' END) AS path")
    wrote = led.where("kind = 'edit_reported'")
    claims = number_claims(led.where("kind = 'intent_declared'").drop("kind", "number", "path"), wrote.where("number < 5").select("scope", "dir", "seq", "number"))
    return claims, wrote.drop("kind")


def _ops(s, d):
    op = "CASE k % 5 WHEN 0 THEN concat('{\"op\":\"rename\",\"symbol\":\"', path, '\",\"new_name\":\"n', root, '\"}') WHEN 1 THEN concat('{\"op\":\"delete\",\"symbol\":\"', path, '\"}') WHEN 2 THEN '{\"op\":\"refactor\"}' WHEN 3 THEN '{\"op\":\"move\",\"symbol\":\"x\"}' ELSE concat('{\"op\":\"extract\",\"symbol\":\"', path, '\",\"new_name\":\"y\"}') END"
    return view(s, d, "ledger").selectExpr("seq", "scope", "usr", "ts", f"concat('[', {op}, ']') AS sent").withColumn("v", validated(F.col("sent")))


def _reports(s, d):
    finding = 'concat(\'[{"symbol":"s\', CAST(tokens % 3 AS STRING), \'","rule":"\', CASE WHEN tokens % 2 = 0 THEN \'signature_drift\' ELSE \'stale_name\' END, \'","change_ts":\', CAST(tokens % 4 AS STRING), \',"fix":"\', CASE WHEN k % 7 = 0 THEN \'safe\' ELSE \'judgment\' END, \'"}]\')'
    return view(s, d, "ledger").selectExpr("scope", "path", "model AS usr", "seq", "ts", f"CASE WHEN kind = 'check_performed' THEN '[]' ELSE {finding} END AS body")


def _graph(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    new = F.expr("concat(p_brand, '/', p_partkey % 97, '.py')")
    before = part.select(new.alias("path"), F.col("p_type").alias("name"))
    after = before.where("path not like '%/13.py'")
    lookups = part.select(new.alias("path"), F.expr("element_at(array('PROMO BURNISHED COPPER', p_type), CAST(p_partkey % 2 AS INT) + 1)").alias("name"))
    changed = before.where("path like '%/13.py'").select("path").distinct()
    return before, after, lookups, changed


def _patched(s, d):
    before, after, lookups, changed = _graph(s, d)
    return patched(resolve(lookups, before), before, after, lookups, changed)


_TEXTS = "SELECT conv_id, turn, text FROM parquet.`{}/conversations.parquet`"
QUERIES = {
    "m13_claims": lambda s, d: claim_outcomes(*_claims(s, d)),
    "a35_clashes": lambda s, d: claim_paths(claim_outcomes(*_claims(s, d)), _claims(s, d)[0]),
    "m13_numbers": lambda s, d: _claims(s, d)[0].select("seq", "number"),
    "m14_reconciliations": lambda s, d: reconciliations(_reports(s, d)),
    "o12_blocks": lambda s, d: blocks(view(s, d, "line").selectExpr("doc_id % 20 AS listing", "doc_id AS place", "pos AS line_no", "l AS line"), 400, 2000),
    "g3_patched": _patched,
    "s18_round_trip": lambda s, d: parsed(s, d).select("path", from_structure(F.col("path"), F.to_json("s")).alias("t")).selectExpr("path", "t.status AS status", "size(t.symbols) AS symbols", "get(t.symbols, 0).name AS first", "size(t.imports) AS imports"),
    "x2_validated": lambda s, d: _ops(s, d).selectExpr("seq", "size(v.ops) AS n", "v.error AS error"),
    "x2_conflicts": lambda s, d: conflicts(_ops(s, d).where("v.error is null").selectExpr("scope", "seq AS id", "usr AS owner", "v.ops[0] AS op"), "u3"),
    "f24_prompt_names": lambda s, d: s.sql(_TEXTS.format(d)).select("conv_id", "turn", prompt_identifiers("text").alias("names")),
    "f25_search_names": lambda s, d: view(s, d, "ledger").select("seq", F.array_join(search_identifiers(F.expr("concat(CASE k % 3 WHEN 0 THEN 'cd x && rg -n ' WHEN 1 THEN 'git grep ' ELSE 'ls ' END, kind, ' ', root)")), ",").alias("names")),
    "f28_patch_paths": lambda s, d: view(s, d, "ledger").select("seq", F.array_join(patch_paths(F.expr("concat('*** Begin Patch\\n*** Update File: ', path, '\\n+x\\n*** Move to: ', root, '\\n*** Add File: ', path)")), ",").alias("paths")),
}
_NUMBERED = """WITH w AS (SELECT scope, root AS dir, seq, ts, model AS usr, k AS number, concat(root, '/', k, CASE WHEN seq % 2 = 0 THEN '' ELSE '_b' END) AS path FROM ledger WHERE kind = 'edit_reported'),
f AS (SELECT c.scope, c.root AS dir, c.seq, c.ts, c.model AS usr, coalesce(max(w.number), 0) AS floor, row_number() OVER (PARTITION BY c.scope, c.root ORDER BY c.seq) AS i
FROM ledger c LEFT JOIN w ON w.scope = c.scope AND w.dir = c.root AND w.seq < c.seq AND w.number < 5 WHERE c.kind = 'intent_declared' GROUP BY c.scope, c.root, c.seq, c.ts, c.model),
c AS (SELECT scope, dir, seq, ts, usr, CAST(i + max(floor - i + 1) OVER (PARTITION BY scope, dir ORDER BY seq) AS BIGINT) AS number FROM f)"""
ORACLE = {
    "m13_numbers": _NUMBERED + " SELECT seq, number FROM c",
    "m13_claims": _NUMBERED + """, met AS (SELECT w.*, c.seq AS claimed, c.usr AS owner, w.ts - c.ts < 259200 AS opened FROM w JOIN c ON c.scope = w.scope AND c.dir = w.dir AND c.number = w.number AND w.seq > c.seq),
fl AS (SELECT scope, dir, number, min(seq) AS seq, arg_min(path, seq) AS path FROM met WHERE opened AND usr = owner GROUP BY scope, dir, number),
t AS (SELECT met.*, CASE WHEN met.seq = fl.seq THEN 'filled' WHEN met.seq > fl.seq THEN CASE WHEN met.path <> fl.path THEN 'conflict' END WHEN opened THEN 'conflict' END AS status FROM met LEFT JOIN fl ON fl.scope = met.scope AND fl.dir = met.dir AND fl.number = met.number)
SELECT scope, dir, number, owner, arg_min(usr, seq) AS usr, path, min(seq) AS seq, status FROM t WHERE status IS NOT NULL GROUP BY scope, dir, number, owner, path, status""",
    "f25_search_names": "SELECT seq, CASE WHEN k % 3 = 2 THEN '' ELSE kind END AS names FROM ledger",
    "f28_patch_paths": "SELECT seq, path || ',' || root AS paths FROM ledger",
    "s18_round_trip": """SELECT 'src/f' || p_partkey || ['.py', '.ts', '.go', '.java', '.rs', '.txt'][p_partkey % 6 + 1] AS path, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 10 = 9 THEN 'partial' ELSE 'clean' END AS status, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 10 = 9 THEN 0 ELSE 3 END AS symbols,
CASE WHEN p_partkey % 6 = 5 OR p_partkey % 10 = 9 THEN NULL ELSE 'L' || p_partkey END AS first, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 END AS imports FROM part""",
    "x2_conflicts": """WITH o AS (SELECT seq, scope, usr, path, k % 5 AS c, unnest(CASE k % 5 WHEN 0 THEN [path, 'n' || root] WHEN 1 THEN [path] WHEN 4 THEN [path, 'y'] END) AS name FROM ledger)
SELECT DISTINCT a.scope, a.seq AS mine, b.seq AS theirs, CASE WHEN a.c = 4 OR b.c = 4 THEN 'UNKNOWN' ELSE 'CONFLICT' END AS verdict FROM o a JOIN o b ON a.scope = b.scope AND a.name = b.name WHERE a.usr = 'u3' AND b.usr <> 'u3'""",
    "x2_validated": """SELECT seq, CAST(CASE WHEN k % 5 IN (2, 3) THEN NULL ELSE 1 END AS INTEGER) AS n, CASE k % 5 WHEN 2 THEN 'operations[0]: no operation named ''refactor''' WHEN 3 THEN 'operations[0]: move needs ''new_path''' END AS error FROM ledger""",
    "g3_patched": """WITH b AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 97) || '.py' AS path, p_brand AS dir, p_type AS name FROM part WHERE p_partkey % 97 <> 13),
l AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 97) || '.py' AS path, p_brand AS dir, CASE WHEN p_partkey % 2 = 0 THEN 'PROMO BURNISHED COPPER' ELSE p_type END AS name FROM part),
nr AS (SELECT dir, name, arg_min(path, (length(path), path)) AS path FROM b GROUP BY dir, name), an AS (SELECT name, arg_min(path, (length(path), path)) AS path FROM b GROUP BY name)
SELECT l.path AS src, l.name, coalesce(b.path, nr.path, an.path) AS dst FROM l LEFT JOIN b ON b.path = l.path AND b.name = l.name LEFT JOIN nr ON nr.dir = l.dir AND nr.name = l.name LEFT JOIN an ON an.name = l.name WHERE coalesce(b.path, nr.path, an.path) IS NOT NULL""",
}
ORACLE["a35_clashes"] = _NUMBERED + f""", o AS ({ORACLE["m13_claims"].replace(_NUMBERED + ", met AS", "WITH met AS")})
SELECT scope, dir, CASE WHEN status = 'filled' THEN 'filled' ELSE 'clash' END AS sort, count(DISTINCT path) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS items FROM o GROUP BY 1, 2, 3
UNION ALL SELECT c.scope, c.dir, 'open', count(DISTINCT c.number), string_agg(DISTINCT lpad(CAST(c.number AS VARCHAR), 6, '0'), ',' ORDER BY lpad(CAST(c.number AS VARCHAR), 6, '0')) FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scope = c.scope AND o.dir = c.dir AND o.number = c.number AND o.status = 'filled') GROUP BY c.scope, c.dir"""
