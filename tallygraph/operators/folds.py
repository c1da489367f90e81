"""Folds over a key's rows in the order of ``seq``.

Rows are dealt by key, sorted by Spark and folded one by one, so a task holds
one key's state and never its rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import canonical_json, chain_hash, exact_round, line_diff, redact_json
from ..sources.adapters import view

#: Seconds after which a symbol that went and one that came are no rename.
RENAME_GAP = 6 * 3600.0


def _shape(name: str, signature: str) -> tuple[str, str]:
    found = re.search(rf"\b{re.escape(name.rpartition('.')[2])}\b", signature)
    return (signature[: found.start()], signature[found.end() :]) if found else (signature, "")


def same_declaration(old: tuple[str, str], new: tuple[str, str]) -> bool:
    """Whether (name, signature) pairs are one declaration under two names:
    the same lead and at least half of the old identifiers kept."""
    (a, rest_a), (b, rest_b) = _shape(*old), _shape(*new)
    if a != b:
        return False
    ids_a, ids_b = ({*re.findall(r"[A-Za-z_]\w*", r)} for r in (rest_a, rest_b))
    return rest_a == rest_b if not ids_a else 2 * len(ids_a & ids_b) >= len(ids_a)


def parse_step(state: dict, parse: tuple) -> list[tuple]:
    """Events (seq, symbol, kind, confidence, detail) of one more parse of a
    file, (seq, ts, status, {name: (signature, hash)}).

    A partial parse says nothing.  A symbol that is gone is ``unknown`` at the
    first clean parse without it and ``removed`` at the second."""
    seq, ts, status, now = parse
    if status == "partial":
        return []
    out: list[tuple] = []
    last, waiting = state.get("last"), state.setdefault("waiting", {})
    if last is not None:
        gone = [n for n in last if n not in now]
        came = [n for n in now if n not in last]
        for n in sorted(waiting):
            if n in now:
                waiting.pop(n)
            elif n not in gone:
                out.append((seq, n, "removed", "certain", waiting.pop(n)))
        if len(gone) == len(came) == 1 and ts - state["ts"] <= RENAME_GAP and same_declaration((gone[0], last[gone[0]][0]), (came[0], now[came[0]][0])):
            out.append((seq, gone[0], "renamed", "certain", came[0]))
        else:
            for n in sorted(gone):
                waiting[n] = last[n][0]
                out.append((seq, n, "unknown", "unconfirmed", ""))
            out += [(seq, n, "added", "certain", now[n][0]) for n in sorted(came)]
        for n in sorted(now):
            if n in last and last[n][1] != now[n][1]:
                out.append((seq, n, "modified", "certain", now[n][0] if last[n][0] != now[n][0] else ""))
    state["last"], state["ts"] = now, ts
    return out


def fold_parses(parses) -> list[tuple]:
    """``parse_step`` over all parses of one file."""
    state: dict = {}
    return [event for parse in parses for event in parse_step(state, parse)]


def parse_events(parses: DataFrame) -> DataFrame:
    """``parse_step`` per (usr, path) of rows (usr, path, seq, ts, status,
    symbols as JSON {name: [signature, hash]})."""

    def step(state: dict, row: tuple) -> list[tuple]:
        seq, ts, status, symbols = row
        return parse_step(state, (seq, ts, status, {k: tuple(v) for k, v in json.loads(symbols or "{}").items()}))

    return ordered_fold(parses, ["usr", "path"], ["seq"], ["seq", "ts", "status", "symbols"], dict, step, "usr string, path string, seq long, symbol string, kind string, confidence string, detail string")


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start, step, schema: str) -> DataFrame:
    """What ``step(state, row)`` returns for each row of a key, in the order of
    ``order``; ``start()`` is a key's first state and a list of tuples is kept.

    Rows are sorted by Spark and pass one by one, so a task holds one state and
    never a key's rows."""
    names = [*keys, *columns]

    def run(batches):
        held, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in names)):
                key = row[: len(keys)]
                if key != held:
                    held, state = key, start()
                out += [(*key, *x) for x in step(state, row[len(keys) :])]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    dealt = rows.select(*names, *[o for o in order if o not in names]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def _typed(rows: DataFrame, keys: list[str]) -> str:
    """The keys and their types, as a schema."""
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)


def cooldown(alerts: DataFrame, keys: list[str], span: float = 900.0) -> DataFrame:
    """Alerts (keys, seq, ts) left when each silences its key for ``span``."""

    def step(state: list, row: tuple) -> list[tuple]:
        seq, ts = row
        if state[0] is not None and ts < state[0]:
            return []
        state[0] = ts + span
        return [(seq,)]

    return ordered_fold(alerts, keys, ["seq"], ["seq", "ts"], lambda: [None], step, _typed(alerts, keys) + ", seq long")


def fit_budget(items: DataFrame, key: str, budget: int) -> DataFrame:
    """Items (key, place, bytes) taken in order of place while they fit; what
    does not fit is passed over and the search goes on."""

    def step(state: list, row: tuple) -> list[tuple]:
        place, size = row
        if state[0] + size > budget:
            return []
        state[0] += size
        return [(place,)]

    return ordered_fold(items, [key], ["place"], ["place", "bytes"], lambda: [0], step, f"{_typed(items, [key])}, place long")


def buckets(rows: DataFrame, key: str, span: float = 1800.0) -> DataFrame:
    """(key, seq, start): the bucket of each row (key, seq, ts).  A bucket opens
    at a row and holds the rows up to ``span`` after that opening, however long
    the silence between them."""

    def step(state: list, row: tuple) -> list[tuple]:
        seq, ts = row
        if state[0] is None or ts - state[0] > span:
            state[0] = ts
        return [(seq, state[0])]

    return ordered_fold(rows, [key], ["seq"], ["seq", "ts"], lambda: [None], step, f"{_typed(rows, [key])}, seq long, start double")


def chained(rows: DataFrame, key: str) -> DataFrame:
    """(key, seq, payload, prev_hash, hash): rows (key, seq, payload) as an
    append-only chain, each hash over the one before and the payload."""

    def step(state: list, row: tuple) -> list[tuple]:
        seq, payload = row
        before, state[0] = state[0], chain_hash(state[0], payload)
        return [(seq, payload, before, state[0])]

    return ordered_fold(rows, [key], ["seq"], ["seq", "payload"], lambda: [""], step, f"{_typed(rows, [key])}, seq long, payload string, prev_hash string, hash string")


def broken_links(chain: DataFrame, key: str) -> DataFrame:
    """(key, seq, why): rows whose hash is not that of their content, or whose
    link is not the hash of the row before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy("seq")), F.lit(""))
    content = F.col("hash") != F.sha2(F.concat("prev_hash", "payload"), 256)
    rows = chain.withColumn("why", F.when(content, "content").when(F.col("prev_hash") != before, "link"))
    return rows.where("why is not null").select(key, "seq", "why")


def common_dir(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, dir): the deepest directory that holds all paths of a key.  It is
    that of the least and the greatest path, so no list of paths is held."""
    ends = paths.groupBy(key).agg(F.split(F.min(path), "/").alias("a"), F.split(F.max(path), "/").alias("b"))
    zero = F.struct(F.lit(True).alias("on"), F.lit("").alias("dir"))

    def step(acc, x):
        on = acc["on"] & (x["a"] == x["b"])
        return F.struct(F.coalesce(on, F.lit(False)).alias("on"), F.when(on, F.concat(acc["dir"], x["a"], F.lit("/"))).otherwise(acc["dir"]).alias("dir"))

    inner = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return ends.select(key, F.aggregate(F.arrays_zip(inner(F.col("a")).alias("a"), inner(F.col("b")).alias("b")), zero, step)["dir"].alias("dir"))


def _parses(ledger: DataFrame) -> DataFrame:
    on = lambda bit: F.col("tokens").bitwiseAND(1 << bit) > 0
    entry = lambda bit: F.when(on(bit), F.concat(F.lit(f'"f{bit}":["def f{bit}(x, y)","'), F.col("k").cast("string"), F.lit('"]')))
    body = F.concat(F.lit("{"), F.concat_ws(",", *(entry(b) for b in range(3))), F.lit("}"))
    return ledger.select("usr", "path", "seq", "ts", F.when(F.col("kind") == "gate_block", "partial").otherwise("clean").alias("status"), body.alias("symbols"))


def _chain(s, d) -> DataFrame:
    """A stored chain per folder in which one row's payload was changed later
    and one row was taken out."""
    rows = chained(view(s, d, "ledger").selectExpr("root", "seq", "concat(kind, ':', usr, ':', path) AS payload"), "root")
    return rows.where("seq <> 500").withColumn("payload", F.expr("CASE WHEN seq = 777 THEN 'forged' ELSE payload END"))


def _nested(column: str = "") -> str:
    """JSON with hidden keys at several depths, and what is left without."""
    return """concat('{"user": "', usr, '", "token": "t', k, '", "items": [{"path": "', path, '", "secret": {"k": ', k, '}}, [{"token": null}], ', tokens, '], "deep": {"secret": [1], "kind": "', kind, '"}}')"""


#: Rows of whole texts that are in a Python worker at once.
TEXT_ROWS = 512


#: Stretches of rows that are dealt out for each partition of a shuffle.
STRETCHES = 2


def with_before(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: ``value`` of the row before it of its key, in the
    order of ``order``, then of ``value``.

    Keys may be few and large, so rows are dealt by stretches of (key, order) that
    hold about as many each.  The last row of a stretch also goes to the next one,
    where it is the row before the first and is not returned."""
    n = STRETCHES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(key, order)
    parts = rows.select(key, order).repartitionByRange(n, key, order).select(F.spark_partition_id().alias("part"), place.alias("place"))
    ends = parts.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")).orderBy("first").collect()  # one row per stretch
    if not ends:
        return rows.withColumn("before", F.col(value))
    known = lambda r: F.struct(*[F.lit(r[c]).cast(rows.schema[c].dataType).alias(c) for c in (key, order)])
    firsts, lasts = (F.array(*[known(r[end]) for r in ends]) for end in ("first", "last"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(ends).bit_length())))])
    # stretches that begin at the row or before it, by halving
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(firsts, a + s - 1) <= place, a + s).otherwise(a))
    own, next_one = (F.struct(s.alias("at"), F.lit(mine).alias("own")) for s, mine in ((F.col("__at"), True), (F.col("__at") + 1, False)))
    dealt = rows.withColumn("__at", at).withColumn("__to", F.explode(F.when(F.get(lasts, F.col("__at") - 1).eqNullSafe(place), F.array(own, next_one)).otherwise(F.array(own))))
    beside = dealt.withColumn("before", F.lag(value).over(Window.partitionBy(key, "__to.at").orderBy(order, value)))
    return beside.where("__to.own").drop("__at", "__to")


def _versions(spark, sf_dir):
    """Each document beside the one before it of its source, by id.  Batches of
    two whole texts a row are kept short for the session."""
    own = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if own <= 0 or own > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return with_before(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "source", "doc_id", "text")


QUERIES = {
    "m1_parse_fold": lambda s, d: parse_events(_parses(view(s, d, "ledger"))),
    "w8_cooldown": lambda s, d: cooldown(view(s, d, "act").where("kind in ('watchdog', 'tripwire_fired')"), ["usr", "kind"]),
    "w2_buckets": lambda s, d: buckets(view(s, d, "act").where("kind = 'edit_reported'"), "usr"),
    "w9_chain": lambda s, d: broken_links(_chain(s, d), "root"),
    "o9_budget": lambda s, d: fit_budget(view(s, d, "ledger").where("kind = 'edit_reported'").selectExpr("path", "seq AS place", "tokens AS bytes"), "path", 200),
    "u2_common_dir": lambda s, d: common_dir(view(s, d, "ledger").where("ts >= 1706000000"), "usr"),
    "m4_line_diff": lambda s, d: _versions(s, d).select("doc_id", line_diff("before", "text").alias("hunks")),
    "f4_exact_round": lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", exact_round(F.col("l_extendedprice") / 7, F.lit(2)).alias("rounded")),
    "f16_canonical_json": lambda s, d: view(s, d, "ledger").select("seq", canonical_json("props").alias("props")),
    "p10_redacted": lambda s, d: view(s, d, "ledger").select("seq", redact_json(F.expr(_nested()), ["token", "secret"]).alias("props")),
}
ORACLE = {
    # symbols are bits, so each clean parse is compared with the two before it
    "m1_parse_fold": """WITH c AS (SELECT usr, path, seq, ts, CAST(tokens & 7 AS INTEGER) AS b, lag(CAST(tokens & 7 AS INTEGER)) OVER w AS p, lag(CAST(tokens & 7 AS INTEGER), 2) OVER w AS q, ts - lag(ts) OVER w AS gap, lag(ts) OVER w - lag(ts, 2) OVER w AS gap_before FROM ledger WHERE kind <> 'gate_block' WINDOW w AS (PARTITION BY usr, path ORDER BY seq)),
r AS (SELECT *, bit_count(p & ~b) = 1 AND bit_count(b & ~p) = 1 AND gap <= 21600 AS renames, coalesce(bit_count(q & ~p) = 1 AND bit_count(p & ~q) = 1 AND gap_before <= 21600, false) AS renamed_before FROM c WHERE p IS NOT NULL), n AS (SELECT unnest([0, 1, 2]) AS i),
x AS (SELECT r.*, 'f' || n.i AS symbol, 'def f' || n.i || '(x, y)' AS sig, (p >> n.i) & 1 AS was, (b >> n.i) & 1 AS now, coalesce((q >> n.i) & 1, 0) AS had FROM r CROSS JOIN n)
SELECT usr, path, seq, symbol, 'removed' AS kind, 'certain' AS confidence, sig AS detail FROM x WHERE had = 1 AND was = 0 AND now = 0 AND NOT renamed_before UNION ALL SELECT usr, path, seq, symbol, 'unknown', 'unconfirmed', '' FROM x WHERE was = 1 AND now = 0 AND NOT renames UNION ALL SELECT usr, path, seq, symbol, 'added', 'certain', sig FROM x WHERE was = 0 AND now = 1 AND NOT renames
UNION ALL SELECT usr, path, seq, symbol, 'renamed', 'certain', CASE b & ~p WHEN 1 THEN 'f0' WHEN 2 THEN 'f1' ELSE 'f2' END FROM x WHERE was = 1 AND now = 0 AND renames""",
    "u2_common_dir": "SELECT usr, CASE WHEN min(root) = max(root) THEN min(root) || '/' ELSE '' END AS dir FROM ledger WHERE ts >= 1706000000 GROUP BY usr",
    "f16_canonical_json": "SELECT seq, replace(props, ' ', '') AS props FROM ledger",
    "p10_redacted": """SELECT seq, '{"deep":{"kind":"' || kind || '"},"items":[{"path":"' || path || '"},[{}],' || tokens || '],"user":"' || usr || '"}' AS props FROM ledger""",
    "w8_cooldown": """WITH RECURSIVE a AS (SELECT usr, kind, seq, ts FROM act WHERE kind IN ('watchdog', 'tripwire_fired')), f AS (SELECT usr, kind, min(seq) AS seq FROM a GROUP BY usr, kind UNION ALL
SELECT f.usr, f.kind, (SELECT min(n.seq) FROM a n WHERE n.usr = f.usr AND n.kind = f.kind AND n.seq > f.seq AND n.ts >= o.ts + 900) AS seq FROM f JOIN a o ON o.seq = f.seq) SELECT usr, kind, seq FROM f WHERE seq IS NOT NULL""",
    "w2_buckets": """WITH RECURSIVE e AS (SELECT usr, seq, ts FROM act WHERE kind = 'edit_reported'), f AS (SELECT usr, min(ts) AS start FROM e GROUP BY usr UNION ALL SELECT f.usr, (SELECT min(n.ts) FROM e n WHERE n.usr = f.usr AND n.ts - f.start > 1800) AS start FROM f WHERE f.start IS NOT NULL)
SELECT e.usr, e.seq, max(f.start) AS start FROM e JOIN f ON f.usr = e.usr AND f.start <= e.ts GROUP BY e.usr, e.seq""",
    "w9_chain": """WITH n AS (SELECT root, seq, lead(seq) OVER (PARTITION BY root ORDER BY seq) AS after FROM ledger) SELECT root, seq, 'content' AS why FROM ledger WHERE seq = 777 UNION ALL SELECT root, after, 'link' FROM n WHERE seq = 500 AND after IS NOT NULL""",
    "o9_budget": """WITH RECURSIVE i AS (SELECT path, seq, tokens, row_number() OVER (PARTITION BY path ORDER BY seq) AS n FROM ledger WHERE kind = 'edit_reported'), f AS (SELECT path, n, seq, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used, tokens <= 200 AS took FROM i WHERE n = 1
UNION ALL SELECT i.path, i.n, i.seq, CASE WHEN f.used + i.tokens <= 200 THEN f.used + i.tokens ELSE f.used END AS used, f.used + i.tokens <= 200 AS took FROM f JOIN i ON i.path = f.path AND i.n = f.n + 1) SELECT path, seq AS place FROM f WHERE took""",
    "f4_exact_round": "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice / 7 AS DECIMAL(38, 15)), 2) AS DOUBLE) AS rounded FROM lineitem",
}
