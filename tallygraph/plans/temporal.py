"""Rules that join by time, and runs of checks.

A join by time puts both sides into one sorted stream per key and stretch of time
and carries the last value along, so its work is that of a sort: no row meets all
rows of its key.  A stretch that has to know of what lies before or behind it gets
one number, or a copy of its neighbour's rows.  Each rule has a DuckDB text that
says it by definition, as a join of all with all.
"""

from __future__ import annotations

from .rules import _KNOWS, _OPEN, pair

# --- as-of ---------------------------------------------------------------------
# Cursors and events of a scope in one stream, counted within stretches of time;
# the stretches' totals, one row each, are added up on their own.
pair("a22_known_unseen", f"""WITH v AS (SELECT scope, usr, ts FROM act WHERE {_KNOWS}), c AS (SELECT scope, usr, max(ts) AS ts FROM act WHERE kind = 'check_performed' GROUP BY scope, usr),
u AS (SELECT scope, usr, ts, 0 AS asks, @INT[floor(ts / $bin)] AS bin FROM v UNION ALL SELECT scope, usr, ts, 1 AS asks, @INT[floor(ts / $bin)] AS bin FROM c),
p AS (SELECT scope, bin, sum(n) OVER (PARTITION BY scope ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS earlier, sum(n) OVER (PARTITION BY scope) AS total FROM (SELECT scope, bin, sum(1 - asks) AS n FROM u GROUP BY scope, bin) b),
r AS (SELECT scope, usr, asks, bin, sum(1 - asks) OVER (PARTITION BY scope, bin ORDER BY ts, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here FROM u),
own AS (SELECT v.scope, v.usr, count(*) AS n, count_if(v.ts <= c.ts) AS seen FROM v JOIN c ON c.scope = v.scope AND c.usr = v.usr GROUP BY v.scope, v.usr),
k AS (SELECT r.scope, r.usr, p.earlier + r.here - coalesce(own.seen, 0) AS seen, p.total - coalesce(own.n, 0) AS total FROM r JOIN p ON p.scope = r.scope AND p.bin = r.bin LEFT JOIN own ON own.scope = r.scope AND own.usr = r.usr WHERE r.asks = 1)
SELECT scope, usr, @INT[seen] AS seen, @INT[total] AS total, @INT[least($most, total - seen)] AS shown FROM k""",
    f"""WITH v AS (SELECT scope, usr, ts FROM act WHERE {_KNOWS}), c AS (SELECT scope, usr, max(ts) AS ts FROM act WHERE kind = 'check_performed' GROUP BY scope, usr),
k AS (SELECT c.scope, c.usr, count(*) FILTER (v.usr <> c.usr AND v.ts <= c.ts) AS seen, count(*) FILTER (v.usr <> c.usr) AS total FROM c LEFT JOIN v ON v.scope = c.scope GROUP BY c.scope, c.usr)
SELECT scope, usr, seen, total, least($most, total - seen) AS shown FROM k""", bin=3600, most=50)

# The first live intent of the author on the file or the symbol.  An edit asks,
# ``life`` before its time, for the next intent; stretches are as long as a life,
# so the answer lies in the asking row's stretch or the next, whose intents are
# laid in both.  Time runs backwards, so that the last intent carried is the next.
pair("j16_covering_intent", """WITH a AS (SELECT seq, usr, path, symbol, ts, kind FROM act WHERE kind IN ('intent_declared', 'edit_reported')),
x AS (SELECT seq, usr, 'p' || path AS name, ts, kind FROM a UNION ALL SELECT seq, usr, 's' || symbol AS name, ts, kind FROM a WHERE symbol <> ''),
u AS (SELECT seq, usr, name, ts, ts AS at, 0 AS asks, @INT[floor(ts / $life)] AS bin FROM x WHERE kind = 'intent_declared' UNION ALL SELECT seq, usr, name, ts, ts AS at, 0 AS asks, @INT[floor(ts / $life)] - 1 AS bin FROM x WHERE kind = 'intent_declared'
UNION ALL SELECT seq, usr, name, ts, ts - $life AS at, 1 AS asks, @INT[floor((ts - $life) / $life)] AS bin FROM x WHERE kind = 'edit_reported'),
r AS (SELECT seq, ts, asks, last_value(CASE WHEN asks = 0 THEN struct(at, seq AS intent) END) IGNORE NULLS OVER (PARTITION BY usr, name, bin ORDER BY at DESC, asks, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM u)
SELECT seq, min(f).intent AS intent FROM r WHERE asks = 1 AND f.at <= ts GROUP BY seq""",
    """WITH i AS (SELECT * FROM act WHERE kind = 'intent_declared'), e AS (SELECT * FROM act WHERE kind = 'edit_reported')
SELECT e.seq, arg_min(i.seq, (i.ts, i.seq)) AS intent FROM e JOIN i ON i.usr = e.usr AND (i.path = e.path OR (i.symbol = e.symbol AND e.symbol <> '')) AND i.ts <= e.ts AND i.ts >= e.ts - $life GROUP BY e.seq""", life=7200)

# --- operations of intents --------------------------------------------------------
# Names that a typed operation claims; an intent without one is prose.
_NAMES = """nm AS (SELECT DISTINCT seq, owner, op, symbol AS name FROM intents WHERE symbol <> '' UNION SELECT DISTINCT seq, owner, op, new_name AS name FROM intents WHERE op IN ('rename', 'extract') AND new_name <> '')"""
pair("j5_predicted", f"""WITH {_OPEN}, {_NAMES}, mine AS (SELECT * FROM nm WHERE owner = $me AND op <> ''),
sh AS (SELECT mine.seq AS mine, t.seq AS theirs, mine.op AS op1, t.op AS op2, array_join(array_sort(collect_set(mine.name)), ',') AS shared FROM mine JOIN nm t ON t.name = mine.name AND t.owner <> $me AND t.op <> '' GROUP BY mine.seq, t.seq, mine.op, t.op),
pr AS (SELECT t.seq AS theirs, array_join(array_sort(collect_set(t.name)), ',') AS shared FROM nm t JOIN (SELECT DISTINCT name FROM mine) m ON m.name = t.name WHERE t.owner <> $me AND t.op = '' GROUP BY t.seq)
SELECT mine, theirs, shared, CASE WHEN op1 = 'extract' OR op2 = 'extract' THEN 'UNKNOWN' ELSE 'CONFLICT' END AS verdict, '' AS why FROM sh UNION ALL SELECT CAST(NULL AS BIGINT), theirs, shared, 'UNKNOWN', 'prose' FROM pr""",
    f"""WITH {_OPEN}, o AS (SELECT seq, owner, op, list_distinct([x for x in CASE WHEN op IN ('rename', 'extract') THEN [symbol, new_name] ELSE [symbol] END if x <> '']) AS names FROM intents),
m AS (SELECT * FROM o WHERE owner = $me AND op <> ''), al AS (SELECT list_distinct(flatten(list(names))) AS names FROM m)
SELECT m.seq AS mine, t.seq AS theirs, array_to_string(list_sort(list_intersect(m.names, t.names)), ',') AS shared, CASE WHEN 'extract' IN (m.op, t.op) THEN 'UNKNOWN' ELSE 'CONFLICT' END AS verdict, '' AS why FROM m, o t WHERE t.owner <> $me AND t.op <> '' AND list_has_any(m.names, t.names)
UNION ALL SELECT NULL, t.seq, array_to_string(list_sort(list_intersect(al.names, t.names)), ','), 'UNKNOWN', 'prose' FROM al, o t WHERE t.owner <> $me AND t.op = '' AND list_has_any(al.names, t.names)""", me="u9", life=7200)
# Pairs of disjoint names commute; they are told by number, as all pairs less those that meet.
pair("j5_table", f"""WITH {_OPEN}, {_NAMES}, ops AS (SELECT owner, count(*) AS n FROM intents WHERE op <> '' GROUP BY owner), mine AS (SELECT * FROM nm WHERE owner = $me AND op <> ''),
sh AS (SELECT DISTINCT t.owner, mine.seq AS mine, t.seq AS theirs, CASE WHEN mine.op = 'extract' OR t.op = 'extract' THEN 1 ELSE 0 END AS unsure FROM mine JOIN nm t ON t.name = mine.name AND t.owner <> $me AND t.op <> ''),
s AS (SELECT owner, count(*) AS meet, @INT[sum(unsure)] AS unsure FROM sh GROUP BY owner)
SELECT ops.owner, @INT[m.n * ops.n - coalesce(s.meet, 0)] AS commute, @INT[coalesce(s.meet - s.unsure, 0)] AS conflict, coalesce(s.unsure, 0) AS unknown FROM ops CROSS JOIN (SELECT coalesce(max(n), 0) AS n FROM ops WHERE owner = $me) m LEFT JOIN s ON s.owner = ops.owner WHERE ops.owner <> $me""",
    f"""WITH {_OPEN}, o AS (SELECT seq, owner, op, list_distinct([x for x in CASE WHEN op IN ('rename', 'extract') THEN [symbol, new_name] ELSE [symbol] END if x <> '']) AS names FROM intents WHERE op <> ''),
p AS (SELECT t.owner, m.seq IS NOT NULL AS paired, list_has_any(m.names, t.names) AS meet, 'extract' IN (m.op, t.op) AS unsure FROM o t LEFT JOIN o m ON m.owner = $me WHERE t.owner <> $me)
SELECT owner, count(*) FILTER (paired AND NOT meet) AS commute, count(*) FILTER (paired AND meet AND NOT unsure) AS conflict, count(*) FILTER (paired AND meet AND unsure) AS unknown FROM p GROUP BY owner""", me="u9", life=7200)

# --- runs of checks ------------------------------------------------------------------
#: How runners name a test that failed, and how much of the output
#: a signature covers.
FAILING = (r"(?m)^FAILED (\S+)", r"(?m)^ERROR (\S+)", r"(?m)^(?:FAIL|ERROR): (\S+)", r"(?m)^test (\S+) \.\.\. FAILED", r"(?m)^--- FAIL: (\S+)", r"(?m)^\s*[✕×✗] (.+)$")
TAIL_CHARS = 2000
#: Results of a test that alternation is looked for in.
LAST = 8
_OUTPUT = """concat_ws(chr(10), '=== run of ' || path, CASE WHEN tokens % 2 = 1 THEN 'FAILED tests/test_' || k % 3 || '.py::one' END, CASE WHEN floor(tokens / 2) % 2 = 1 THEN 'test pkg::two ... FAILED' END, CASE WHEN floor(tokens / 4) % 2 = 1 THEN '--- FAIL: TestThree' END,
CASE WHEN tokens % 5 = 1 THEN '  ✗ shows the list' END, CASE WHEN tokens % 3 = 0 THEN 'ended   early' ELSE 'ended early' END)"""
_CHECKS = f"t AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq) AS run, tokens % 8 = 0 AS ok, {_OUTPUT} AS output FROM act WHERE kind IN ('interface_verified', 'check_performed'))"
_IDS = "concat(" + ", ".join(f'regexp_extract_all(output, r"{p}", 1)' for p in FAILING) + ")"
_DUCK_IDS = " || ".join(f"regexp_extract_all(output, '{p}', 1)" for p in FAILING)
# The first run is the baseline.  A test has a result where it fails and in the
# run after that.
pair("a32_failures", f"""WITH {_CHECKS}, r AS (SELECT path, run, ok, substr(sha2(concat(CASE WHEN ok THEN 'ok' ELSE 'fail' END, trim(regexp_replace(right(output, {TAIL_CHARS}), r"\\s+", ' '))), 256), 1, 12) AS sig, CASE WHEN ok THEN array() ELSE array_distinct({_IDS}) END AS ids FROM t),
f AS (SELECT path, run, explode(CASE WHEN NOT ok AND size(ids) = 0 THEN array('check') ELSE ids END) AS id FROM r),
b AS (SELECT path, id, run, 1 AS bad FROM f UNION ALL SELECT f.path, f.id, f.run + 1 AS run, 0 AS bad FROM f JOIN r ON r.path = f.path AND r.run = f.run + 1 LEFT ANTI JOIN f g ON g.path = f.path AND g.id = f.id AND g.run = f.run + 1),
h AS (SELECT *, coalesce(lag(bad) OVER w = 1 AND lag(run) OVER w = run - 1, false) AS failed, CASE WHEN lag(bad) OVER w <> bad THEN 1 ELSE 0 END AS moved, min(run) OVER (PARTITION BY path, id) = 1 AS base FROM b WINDOW w AS (PARTITION BY path, id ORDER BY run)),
k AS (SELECT *, sum(moved) OVER (PARTITION BY path, id ORDER BY run ROWS BETWEEN {LAST - 2} PRECEDING AND CURRENT ROW) AS flips FROM h),
s AS (SELECT path, run, ok, lag(sig) OVER (PARTITION BY path ORDER BY run) = sig AND NOT ok AS same FROM r)
SELECT s.path, s.run, s.ok, s.same, @SS[CASE WHEN bad = 1 AND NOT failed AND NOT base THEN id END] AS newly, @SS[CASE WHEN bad = 1 AND base THEN id END] AS pre_existing, @SS[CASE WHEN bad = 0 AND failed THEN id END] AS fixed, @SS[CASE WHEN bad = 1 AND flips >= 2 THEN id END] AS alternating
FROM s LEFT JOIN k ON k.path = s.path AND k.run = s.run WHERE s.run > 1 GROUP BY s.path, s.run, s.ok, s.same""",
    f"""WITH {_CHECKS}, r AS (SELECT path, run, ok, sha256(CASE WHEN ok THEN 'ok' ELSE 'fail' END || trim(regexp_replace(right(output, {TAIL_CHARS}), '\\s+', ' ', 'g')))[:12] AS sig, CASE WHEN ok THEN [] ELSE list_distinct({_DUCK_IDS}) END AS found FROM t),
i AS (SELECT path, run, ok, sig, CASE WHEN NOT ok AND len(found) = 0 THEN ['check'] ELSE found END AS ids FROM r),
p AS (SELECT *, coalesce(lag(ids) OVER w, []) AS before, first_value(ids) OVER w AS base, lag(sig) OVER w = sig AND NOT ok AS same FROM i WINDOW w AS (PARTITION BY path ORDER BY run)),
x AS (SELECT path, run, id, list_contains(ids, id) AS bad FROM (SELECT path, run, ids, unnest(list_distinct(ids || before)) AS id FROM p) y),
h AS (SELECT path, run, id, bad, list(bad) OVER (PARTITION BY path, id ORDER BY run) AS hs FROM x),
z AS (SELECT path, run, list_sort(list(id)) AS ids FROM (SELECT path, run, id, bad, hs[-{LAST}:] AS l FROM h) y WHERE bad AND len([j for j in range(2, len(l) + 1) if l[j] <> l[j - 1]]) >= 2 GROUP BY path, run)
SELECT p.path, p.run, p.ok, p.same, array_to_string(list_sort([a for a in p.ids if NOT list_contains(p.before, a) AND NOT list_contains(p.base, a)]), ',') AS newly, array_to_string(list_sort([a for a in p.ids if list_contains(p.base, a)]), ',') AS pre_existing,
array_to_string(list_sort([a for a in p.before if NOT list_contains(p.ids, a)]), ',') AS fixed, coalesce(array_to_string(z.ids, ','), '') AS alternating FROM p LEFT JOIN z ON z.path = p.path AND z.run = p.run WHERE p.run > 1""")
