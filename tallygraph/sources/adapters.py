"""The ledger, graph and workspace views over the driver's tables, in Spark and
DuckDB SQL.

``spark_sql`` puts a query's views before it as common table expressions that
read Parquet by path, so nothing is registered in the session.  Columns that a
query does not use are not read.  Filters on a view's computed ``ts`` and
``kind`` would stay above the scan, so ``pushed`` adds what they imply for the
stored columns, and these reach Parquet.
"""

from __future__ import annotations

import re
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: view: (Spark SQL, DuckDB SQL, views it needs)
VIEWS: dict[str, tuple[str, str]] = {
    "ledger": (
        """SELECT event_id AS seq, concat('ws:r', CAST(user_id % 4 AS STRING)) AS scope,
  unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS ts,
  CASE event_type WHEN 'purchase' THEN 'edit_reported' WHEN 'view' THEN 'check_performed' WHEN 'click' THEN 'intent_declared'
    WHEN 'signup' THEN 'intent_completed' ELSE 'gate_block' END AS kind,
  concat('u', CAST(user_id AS STRING)) AS usr, concat('s', CAST(CAST(floor(event_id / 50) AS BIGINT) AS STRING)) AS turn_id,
  concat('d', CAST(CAST(get_json_object(props, '$.k') AS BIGINT) % 8 AS STRING)) AS root,
  concat('d', CAST(CAST(get_json_object(props, '$.k') AS BIGINT) % 8 AS STRING), '/f', get_json_object(props, '$.k'), '.py') AS path,
  CASE CAST(get_json_object(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'beta-2' ELSE '' END AS model,
  CAST(floor(value) AS BIGINT) AS tokens, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, date_format(ts, 'yyyy-MM-dd') AS day, props, ts AS ets, event_type AS etype
FROM events""",
        """SELECT event_id AS seq, 'ws:r' || (user_id % 4) AS scope, epoch_us(ts) / 1e6 AS ts,
  CASE event_type WHEN 'purchase' THEN 'edit_reported' WHEN 'view' THEN 'check_performed' WHEN 'click' THEN 'intent_declared'
    WHEN 'signup' THEN 'intent_completed' ELSE 'gate_block' END AS kind,
  'u' || user_id AS usr, 's' || (event_id // 50) AS turn_id, 'd' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 8) AS root,
  'd' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 8) || '/f' || json_extract_string(props, '$.k') || '.py' AS path,
  CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'beta-2' ELSE '' END AS model,
  CAST(floor(value) AS BIGINT) AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day, props, ts AS ets, event_type AS etype
FROM events""",
    ),
    # The same events as rows of a busy half day: time runs 64 times faster and
    # 24 users take part, so that rules with spans of minutes have work to do.
    "act": (
        """SELECT seq, scope, ts, kind, usr, model, tokens, k, ets, etype,
  CASE WHEN k % 3 = 0 THEN '' ELSE 's' || (seq div 40) END AS session, CASE k % 5 WHEN 0 THEN 'ag1' WHEN 1 THEN 'ag2' ELSE '' END AS agent,
  CASE WHEN k % 7 = 0 THEN '' ELSE 't' || (seq div 6) END AS turn_id, CASE WHEN k % 4 = 1 THEN '' ELSE 'i' || (seq div 25) END AS intent_id,
  'd' || (k % 8) AS root, 'd' || (k % 8) || '/f' || k || CASE WHEN k % 4 = 3 THEN '.ts' ELSE '.py' END AS path,
  CASE tokens % 5 WHEN 0 THEN 'getValue' WHEN 1 THEN 'load_all' WHEN 2 THEN 'Ledger' WHEN 3 THEN 'f3' ELSE 'compute_tax' END AS symbol,
  CASE tokens % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END AS what,
  CASE WHEN tokens % 6 = 2 THEN 'new_' || (tokens % 4) ELSE '' END AS new_name, CASE WHEN tokens % 4 = 3 THEN 'unconfirmed' ELSE 'certain' END AS confidence,
  CASE WHEN tokens % 6 = 0 THEN '' ELSE '(a, b' || (k % 2) || ')' END AS sig_before, CASE WHEN tokens % 6 = 1 THEN '' ELSE '(a, b' || (tokens % 2) || ')' END AS sig_after,
  'h' || (k % 3) AS hash_before, 'h' || (tokens % 3) AS hash_after, CASE k % 11 WHEN 0 THEN 'partial' WHEN 1 THEN 'unsupported' ELSE 'clean' END AS parse, k % 13 = 0 AS auto,
  tokens % 50 AS lines_added, tokens % 7 AS lines_removed, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS c1, CASE WHEN k % 2 = 0 THEN tokens ELSE 0 END AS c2, CASE WHEN k % 2 = 0 THEN 3 * k ELSE 0 END AS c3, 0 AS c4,
  CASE WHEN k % 9 < 3 THEN 'because of ' || k ELSE '' END AS why
FROM (SELECT event_id AS seq, ts AS ets, event_type AS etype, concat('ws:r', CAST(user_id % 4 AS STRING)) AS scope, 1704067200 + (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 64e6 AS ts,
  CASE event_type WHEN 'purchase' THEN 'edit_reported' WHEN 'view' THEN 'check_performed'
    WHEN 'click' THEN CASE n % 4 WHEN 0 THEN 'intent_declared' WHEN 1 THEN 'intent_completed' WHEN 2 THEN 'intent_abandoned' ELSE 'rationale' END
    WHEN 'signup' THEN CASE n % 4 WHEN 0 THEN 'collision_returned' WHEN 1 THEN 'override' WHEN 2 THEN 'interface_verified' ELSE 'landed' END
    ELSE CASE n % 5 WHEN 0 THEN 'watchdog' WHEN 1 THEN 'tripwire_fired' ELSE 'gate_block' END END AS kind,
  concat('u', CAST(user_id % 24 AS STRING)) AS usr, CASE k % 3 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'beta-2' ELSE '' END AS model, n AS tokens, k
  FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS n FROM events) e) f""",
        """SELECT seq, scope, ts, kind, usr, model, tokens, k, ets, etype,
  CASE WHEN k % 3 = 0 THEN '' ELSE 's' || (seq // 40) END AS session, CASE k % 5 WHEN 0 THEN 'ag1' WHEN 1 THEN 'ag2' ELSE '' END AS agent,
  CASE WHEN k % 7 = 0 THEN '' ELSE 't' || (seq // 6) END AS turn_id, CASE WHEN k % 4 = 1 THEN '' ELSE 'i' || (seq // 25) END AS intent_id,
  'd' || (k % 8) AS root, 'd' || (k % 8) || '/f' || k || CASE WHEN k % 4 = 3 THEN '.ts' ELSE '.py' END AS path,
  CASE tokens % 5 WHEN 0 THEN 'getValue' WHEN 1 THEN 'load_all' WHEN 2 THEN 'Ledger' WHEN 3 THEN 'f3' ELSE 'compute_tax' END AS symbol,
  CASE tokens % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END AS what,
  CASE WHEN tokens % 6 = 2 THEN 'new_' || (tokens % 4) ELSE '' END AS new_name, CASE WHEN tokens % 4 = 3 THEN 'unconfirmed' ELSE 'certain' END AS confidence,
  CASE WHEN tokens % 6 = 0 THEN '' ELSE '(a, b' || (k % 2) || ')' END AS sig_before, CASE WHEN tokens % 6 = 1 THEN '' ELSE '(a, b' || (tokens % 2) || ')' END AS sig_after,
  'h' || (k % 3) AS hash_before, 'h' || (tokens % 3) AS hash_after, CASE k % 11 WHEN 0 THEN 'partial' WHEN 1 THEN 'unsupported' ELSE 'clean' END AS parse, k % 13 = 0 AS auto,
  tokens % 50 AS lines_added, tokens % 7 AS lines_removed, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS c1, CASE WHEN k % 2 = 0 THEN tokens ELSE 0 END AS c2, CASE WHEN k % 2 = 0 THEN 3 * k ELSE 0 END AS c3, 0 AS c4,
  CASE WHEN k % 9 < 3 THEN 'because of ' || k ELSE '' END AS why
FROM (SELECT event_id AS seq, ts AS ets, event_type AS etype, 'ws:r' || (user_id % 4) AS scope, 1704067200 + (epoch_us(ts) - 1704067200000000) / 64e6 AS ts,
  CASE event_type WHEN 'purchase' THEN 'edit_reported' WHEN 'view' THEN 'check_performed'
    WHEN 'click' THEN CASE n % 4 WHEN 0 THEN 'intent_declared' WHEN 1 THEN 'intent_completed' WHEN 2 THEN 'intent_abandoned' ELSE 'rationale' END
    WHEN 'signup' THEN CASE n % 4 WHEN 0 THEN 'collision_returned' WHEN 1 THEN 'override' WHEN 2 THEN 'interface_verified' ELSE 'landed' END
    ELSE CASE n % 5 WHEN 0 THEN 'watchdog' WHEN 1 THEN 'tripwire_fired' ELSE 'gate_block' END END AS kind,
  'u' || (user_id % 24) AS usr, CASE k % 3 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'beta-2' ELSE '' END AS model, n AS tokens, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS n FROM events) e) f""",
    ),
    "dep": (
        """SELECT concat('p', CAST(p_partkey AS STRING)) AS src, concat('p', CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING)) AS dst,
  CASE p_size % 4 WHEN 0 THEN 'inherits' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses_type' ELSE 'references' END AS kind FROM part WHERE p_partkey > 0""",
        """SELECT 'p' || p_partkey AS src, 'p' || (p_partkey // 7) AS dst,
  CASE p_size % 4 WHEN 0 THEN 'inherits' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses_type' ELSE 'references' END AS kind FROM part WHERE p_partkey > 0""",
    ),
    "ps": ("SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)) AS src, concat('s', CAST(l_suppkey AS STRING)) AS dst FROM lineitem", "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"),
    # parts and the orders that hold them, a graph with many cycles
    "bought": ("SELECT concat('p', CAST(l_partkey AS STRING)) AS src, concat('o', CAST(l_orderkey AS STRING)) AS dst FROM lineitem", "SELECT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst FROM lineitem"),
    "kv": ("SELECT event_type AS bucket, concat('k', CAST(user_id AS STRING)) AS key, props AS value, unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS updated, event_id AS seq FROM events", "SELECT event_type AS bucket, 'k' || user_id AS key, props AS value, epoch_us(ts) / 1e6 AS updated, event_id AS seq FROM events"),
    "ws": ("SELECT CAST(o_custkey % 2 AS STRING) AS usr, CAST(o_custkey AS STRING) AS path, o_orderpriority AS symbol, o_orderstatus AS hash, o_orderkey AS seq FROM orders", "SELECT CAST(o_custkey % 2 AS VARCHAR) AS usr, CAST(o_custkey AS VARCHAR) AS path, o_orderpriority AS symbol, o_orderstatus AS hash, o_orderkey AS seq FROM orders"),
    "word": ("SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) x AS pos, w", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents) t, unnest(range(1, len(l) + 1)) r(i)"),
    "sent": (
        r"SELECT conv_id, turn, si, s FROM conversations LATERAL VIEW posexplode(regexp_extract_all(lower(text), '[^.!?\n]*[.!?\n]|[^.!?\n]+$', 0)) x AS si, s WHERE role = 'user'",
        r"SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS si, l[i] AS s FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[^.!?\n]*[.!?\n]|[^.!?\n]+$') AS l FROM conversations WHERE role = 'user') t, unnest(range(1, len(l) + 1)) r(i)",
    ),
    "sword": (
        r"SELECT conv_id, turn, si, wi, w FROM (SELECT conv_id, turn, si, wi, regexp_replace(w, '[^a-z0-9]', '') AS w FROM sent LATERAL VIEW posexplode(regexp_extract_all(s, '[^ \t\n]+', 0)) x AS wi, w) v WHERE w <> ''",
        r"SELECT conv_id, turn, si, wi, w FROM (SELECT conv_id, turn, si, CAST(i - 1 AS INTEGER) AS wi, regexp_replace(l[i], '[^a-z0-9]', '', 'g') AS w FROM (SELECT conv_id, turn, si, regexp_extract_all(s, '[^ \t\n]+') AS l FROM sent) t, unnest(range(1, len(l) + 1)) r(i)) v WHERE w <> ''",
    ),
    "line": ("SELECT doc_id, pos, l FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, l", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) t, unnest(range(1, len(l) + 1)) r(i)"),
}

#: Shorthands of both dialects: sorted list, sorted set, and SHA-256.
_SPARK = {"SL": r"array_join(array_sort(collect_list(\1)), ',')", "SS": r"array_join(array_sort(collect_set(\1)), ',')", "SHA": r"sha2(\1, 256)", "NL": r"array_join(array_sort(collect_list(\1)), chr(10))", "INT": r"CAST(\1 AS BIGINT)"}
_DUCK = {"SL": r"coalesce(string_agg(\1, ',' ORDER BY \1), '')", "SS": r"coalesce(string_agg(DISTINCT \1, ',' ORDER BY \1), '')", "SHA": r"sha256(\1)", "NL": r"coalesce(string_agg(\1, chr(10) ORDER BY \1), '')", "INT": r"CAST(\1 AS BIGINT)"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as set in spark.checkpoint.dir; a
    local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, on whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _expand(sql: str, marks: dict[str, str]) -> str:
    for name, text in marks.items():
        sql = re.sub(rf"@{name}\[([^\]]*)\]", text, sql)
    return sql


def _with(sql: str, views: dict[str, str]) -> str:
    named = {v for v in views if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql, re.I)}
    while more := {v for v in views if v not in named and any(re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", views[n], re.I) for n in named)}:
        named |= more
    used = [f"{v} AS ({text})" for v, text in views.items() if v in named]
    if not used:
        return sql
    head = "WITH " + ",\n".join(used)
    body = re.sub(r"^\s*WITH\s+", "", sql, flags=re.I)
    deep = re.sub(r"^RECURSIVE\s+", "", body)
    if deep != body:
        head = head.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{head}{',' if body != sql else ''}\n{deep}"


#: Kinds of a view and the stored event types that they come from.
_STORED = {
    "ledger": {"edit_reported": "purchase", "check_performed": "view", "intent_declared": "click", "intent_completed": "signup", "gate_block": "error"},
    "act": {"edit_reported": "purchase", "check_performed": "view", "gate_block": "error", "watchdog": "error", "tripwire_fired": "error"}
    | dict.fromkeys(("intent_declared", "intent_completed", "intent_abandoned", "rationale"), "click") | dict.fromkeys(("collision_returned", "override", "interface_verified", "landed"), "signup"),
}
#: Seconds of a view's time to seconds of stored time, from the same origin.
_ORIGIN, _RATE = 1704067200, {"ledger": 1, "act": 64}
_ENDS = re.compile(r"\b(GROUP|ORDER|UNION|WINDOW|LIMIT|HAVING|WHERE|JOIN|LEFT|CROSS)\b")


def _condition(sql: str, start: int) -> tuple[list[str], bool]:
    """The conjuncts of the condition at ``start``, and whether it is one."""
    depth, i, parts, at, plain, quoted = 0, start, [], start, True, False
    while i < len(sql):
        c = sql[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if depth < 0 or (depth == 0 and _ENDS.match(sql, i)):
                break
            if depth == 0 and sql.startswith(" AND ", i):
                parts.append(sql[at:i])
                at = i + 5
            plain = plain and not (depth == 0 and sql.startswith(" OR ", i))
        i += 1
    return [*parts, sql[at:i]], plain


def _implied(view: str, part: str) -> str | None:
    """What a conjunct on ``kind`` or ``ts`` says of the stored columns."""
    m = re.fullmatch(r"\s*((?:\w+\.)?)kind (?:= ('\w+')|IN \(([^()]*)\))\s*", part)
    if m:
        types = sorted({_STORED[view].get(k.strip(" '"), "") for k in (m[2] or m[3]).split(",")})
        return f"{m[1]}etype IN ({', '.join(repr(t) for t in types)})" if "" not in types else None
    m = re.fullmatch(r"\s*((?:\w+\.)?)ts (>=|>|<=|<) ([\d.]+(?: [-+] [\d.]+)*)\s*", part)
    if m:
        seconds = sum(float(x.replace(" ", "")) for x in re.findall(r"[-+]? ?[\d.]+", m[3]))
        slack = -1 if m[2][0] == ">" else 1
        seconds = _ORIGIN + (seconds - _ORIGIN) * _RATE[view] + slack
        if abs(seconds) > 7e9:  # beyond what a date in use can be
            return None
        at = datetime(1970, 1, 1) + timedelta(seconds=seconds)
        return f"{m[1]}ets {m[2][0]}= TIMESTAMP_NTZ '{at:%Y-%m-%d %H:%M:%S}'"
    return None


def pushed(sql: str) -> str:
    """``sql`` with conditions on ``ledger`` and ``act`` repeated for the stored
    columns behind them."""
    out, last = [], 0
    for m in re.finditer(r"\bFROM (ledger|act)(?: (?!WHERE)[a-z]\w*)? WHERE ", sql):
        parts, plain = _condition(sql, m.end())
        more = [x for x in (_implied(m[1], part) for part in parts) if x] if plain else []
        if more:
            out += [sql[last : m.end()], " AND ".join(more), " AND "]
            last = m.end()
    return "".join(out) + sql[last:]


def duck_sql(sql: str) -> str:
    return _with(_expand(sql, _DUCK), {v: d for v, (_, d) in VIEWS.items()})


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = _with(_expand(pushed(sql), _SPARK), {v: s for v, (s, _) in VIEWS.items()})
    named = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(?!\.)", re.I)
    return spark.sql(named.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}" if not re.match(r"\s+(AS\s+)?(?!WHERE|JOIN|GROUP|ORDER|LEFT|LATERAL|ON|LIMIT|UNION|CROSS|USING)[a-z]\w*", text[m.end():], re.I) else f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
