"""DuckDB texts of rules by their definition, written apart from the Spark texts:
joins of all with all where those use windows, lists where those use joins, as-of
joins where those carry values along.
"""

from __future__ import annotations

from .rules import _BOUNDS, _KEY, _USED, TWINS

_IN = "ts >= $now - least(90, greatest(0.02, $days)) * 86400"
_SESSIONS = f"""m AS (SELECT *, {_KEY} AS skey, {_USED} AS used FROM act WHERE {_IN}), o AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY skey ORDER BY seq) > $gap, true) AS opens FROM m),
s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY skey ORDER BY seq) AS sid FROM o)"""
_EDIT = "FILTER (kind = 'edit_reported')"

TWINS |= {
    "w1_sessions": f"WITH {_SESSIONS} SELECT skey, sid AS session, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM s GROUP BY skey, sid",
    "a1_journal": f"""WITH {_SESSIONS}, firsts AS (SELECT min(seq) AS seq FROM m WHERE kind = 'edit_reported' AND turn_id <> '' GROUP BY turn_id), p AS (SELECT skey, sid, list(path ORDER BY n DESC, first) AS paths FROM (SELECT skey, sid, path, count(*) AS n, min(seq) AS first FROM s WHERE kind = 'edit_reported' GROUP BY ALL) t GROUP BY ALL)
SELECT s.skey, s.sid AS session, min(usr) AS usr, arg_min(agent, seq) AS agent, coalesce(arg_max(model, seq) FILTER (kind = 'edit_reported' AND model <> ''), arg_min(model, seq)) AS model, min(ts) AS started, max(ts) AS ended, count(*) {_EDIT} AS edits,
CAST(coalesce(sum(used) FILTER (kind = 'edit_reported' AND (turn_id = '' OR seq IN (FROM firsts))), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(lines_added) {_EDIT}, 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(lines_removed) {_EDIT}, 0) AS BIGINT) AS lines_removed,
count(*) FILTER (kind = 'edit_reported' AND parse = 'partial') AS parse_failures, count(*) FILTER (kind = 'intent_completed') AS intents_completed, count(*) FILTER (kind = 'intent_completed' AND why <> '') AS rationales, count(*) FILTER (kind = 'watchdog') AS watchdog,
coalesce(array_to_string(any_value(p.paths)[:4], '|'), '') AS top_paths FROM s LEFT JOIN p ON p.skey = s.skey AND p.sid = s.sid GROUP BY s.skey, s.sid""",
    "a4_savings": """WITH n AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) AS day FROM act WHERE kind IN ('gate_block', 'collision_returned', 'override', 'tripwire_fired') QUALIFY row_number() OVER (PARTITION BY scope ORDER BY seq DESC) <= $newest),
g AS (SELECT 0 AS g1, 1 AS g2, 1 AS g3, kind, NULL AS scope, CAST(NULL AS BIGINT) AS day, list(tokens) AS t, list(k) AS ks FROM n GROUP BY kind UNION ALL SELECT 1, 0, 1, NULL, scope, NULL, list(tokens), list(k) FROM n GROUP BY scope
UNION ALL SELECT 1, 1, 0, NULL, NULL, day, list(tokens), list(k) FROM n GROUP BY day UNION ALL SELECT 1, 1, 1, NULL, NULL, NULL, list(tokens), list(k) FROM n)
SELECT g1, g2, g3, kind, scope, day, len(t) AS n, CAST(list_sum(t) AS BIGINT) AS saved, len([x for x in ks if x % 2 = 0]) / len(t) AS answered FROM g""",
    "a7_compliance": """WITH c AS (SELECT * FROM act WHERE ts >= $now - $since), w AS (SELECT e.usr, CASE WHEN e.agent = '' THEN '(unattributed)' ELSE e.agent END AS agent, EXISTS (SELECT 1 FROM c p WHERE p.kind = 'check_performed' AND p.usr = e.usr AND p.seq < e.seq AND (p.session = e.session OR p.path = e.path)) AS ok FROM c e WHERE e.kind = 'edit_reported' AND NOT e.auto),
u AS (SELECT unnest([{'per': 'usr', 'who': usr}, {'per': 'agent', 'who': agent}], recursive := true), ok FROM w) SELECT per, who, count(*) AS writes, count(*) FILTER (ok) AS checked, avg(CAST(ok AS INTEGER)) AS rate FROM u GROUP BY per, who""",
    "a12_coedit": f"""WITH e AS (SELECT seq, ts, path, {_KEY} AS skey FROM act WHERE kind = 'edit_reported'), h AS (SELECT DISTINCT x.seq, x.path AS a, y.path AS b FROM e x JOIN e y ON y.skey = x.skey AND y.seq < x.seq AND x.ts - y.ts <= $span AND y.path <> x.path)
SELECT s.a, s.b, count(*) AS n FROM h, unnest([{{'a': h.a, 'b': h.b}}, {{'a': h.b, 'b': h.a}}]) t(s) GROUP BY s.a, s.b""",
    "a21_histogram": f"""WITH v AS (SELECT kind, list_sort(list(CAST(tokens * tokens AS DOUBLE) / 4)) AS ms FROM act GROUP BY kind), b AS (SELECT CAST({list(_BOUNDS)} AS DOUBLE[]) AS bounds),
q AS (SELECT kind, ms[-1] AS top, ms[CAST(ceil(0.5 * len(ms)) AS BIGINT)] AS half, ms[CAST(ceil(0.95 * len(ms)) AS BIGINT)] AS most FROM v)
SELECT kind, coalesce([x for x in bounds if x >= half][1], top) AS p50, coalesce([x for x in bounds if x >= most][1], top) AS p95, top FROM q, b""",
    "a26_usage_index": f"""WITH x AS (SELECT *, {_USED} AS used FROM act WHERE kind = 'edit_reported'), y AS (SELECT * FROM x WHERE used > 0), l AS (SELECT 'session' AS per, usr || ':' || session AS who, usr, session, max(seq) AS seq FROM y WHERE session <> '' GROUP BY usr, session UNION ALL SELECT 'usr', usr, usr, NULL, max(seq) FROM y GROUP BY usr)
SELECT l.per, l.who, y.c1 + y.c3 AS context, y.model, l.seq FROM l JOIN y ON y.seq = l.seq""",
    "m2_serve": """WITH e AS (SELECT * FROM act WHERE kind = 'edit_reported'), c AS (SELECT usr, path, seq, ts FROM e WHERE parse = 'clean')
SELECT e.seq, e.usr, e.path, CASE WHEN e.seq = c.seq THEN 'live' ELSE 'stale' END AS freshness, c.seq AS served, round(e.ts - c.ts, 1) AS age FROM e ASOF JOIN c ON c.usr = e.usr AND c.path = e.path AND c.seq <= e.seq""",
    "m12_replay": """WITH a AS MATERIALIZED (SELECT * FROM act WHERE scope = $scope AND ts BETWEEN $at - $window AND $at AND ts <> $at - $window), st AS (SELECT path || '::' || symbol AS item, CASE what WHEN 'removed' THEN '' ELSE hash_after END AS hash FROM a WHERE kind = 'edit_reported' QUALIFY row_number() OVER (PARTITION BY path, symbol ORDER BY seq DESC) = 1),
op AS (SELECT intent_id, usr, ts, max(ts) OVER (PARTITION BY intent_id) AS newest FROM a WHERE kind = 'intent_declared' AND intent_id <> '' AND intent_id NOT IN (SELECT intent_id FROM a WHERE kind IN ('intent_completed', 'intent_abandoned')) QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY seq DESC) = 1),
nt AS (SELECT seq, path || '::' || symbol AS item, hash_before FROM a WHERE kind = 'rationale' QUALIFY row_number() OVER (ORDER BY ts DESC, seq) <= $notes)
SELECT 'symbol' AS part, item, hash AS detail FROM st WHERE hash <> '' UNION ALL SELECT 'intent', intent_id, usr FROM op WHERE $at - newest <= $life UNION ALL SELECT 'note', CAST(seq AS VARCHAR), CASE WHEN hash_before = ANY (SELECT hash FROM st WHERE st.item = nt.item AND hash <> '') OR NOT EXISTS (SELECT 1 FROM st WHERE st.item = nt.item AND hash <> '') THEN 'firm' ELSE 'drifted' END FROM nt
UNION ALL SELECT 'count', kind, CAST(len(list(seq)) AS VARCHAR) FROM a WHERE kind = 'check_performed' OR kind = 'collision_returned' OR kind = 'gate_block' GROUP BY kind""",
    "a23_latest_change": """WITH l AS (SELECT path, ts, CASE WHEN what = 'renamed' AND new_name <> '' THEN concat(symbol, ' renamed to ', new_name) WHEN what = 'removed' THEN concat(symbol, ' removed') WHEN sig_before <> '' AND sig_after <> '' AND sig_before <> sig_after THEN concat(sig_before, ' to ', sig_after) WHEN what = 'added' AND sig_after <> '' THEN concat('+ ', sig_after) END AS line
FROM act WHERE kind = 'edit_reported' AND usr <> $me AND ts >= $now - $since QUALIFY seq = max(seq) OVER (PARTITION BY path, symbol, what)) SELECT path, array_to_string(list_sort(list(line)), ',') AS changes, max(ts) AS newest FROM l WHERE line IS NOT NULL GROUP BY path""",
    "g2_full_build": """WITH d AS (SELECT p_partkey AS k, p_brand || '/' || (p_partkey % 97) || '.py' AS path, p_type AS name, p_size FROM part), r AS (SELECT d.path, d.name, CASE WHEN d.k % 11 = 0 THEN 'missing ' || d.p_size ELSE u.name END AS target FROM d JOIN d u ON u.k = d.k // 7 WHERE d.k > 0),
e AS (SELECT DISTINCT path || '::' || name AS a, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.path = r.path AND d.name = r.target) THEN path || '::' || target ELSE coalesce((SELECT arg_min(d.path, (length(d.path), d.path)) FROM d WHERE d.name = r.target) || '::' || target, 'ext:' || target) END AS b FROM r)
SELECT DISTINCT 'file' AS sort, path AS a, '' AS b FROM d UNION ALL SELECT DISTINCT 'symbol', path || '::' || name, path FROM d UNION ALL SELECT 'edge', a, b FROM e WHERE a <> b UNION ALL SELECT DISTINCT 'placeholder', b, '' FROM e WHERE b LIKE 'ext:%'""",
    "o13_roster": """SELECT usr, arg_max(path, seq) AS path, round($now - max(ts), 1) AS age FROM act WHERE scope = $scope AND usr <> $me GROUP BY usr HAVING $now - max(ts) <= $live ORDER BY max(ts) DESC, usr LIMIT $most""",
    "o15_inbox": """WITH c AS (SELECT path, max(seq) AS seq FROM act WHERE kind = 'check_performed' AND usr = $me GROUP BY path) SELECT g.seq, g.scope, g.usr FROM act g LEFT JOIN c ON c.path = g.path WHERE g.kind = 'gate_block' AND g.usr = $me AND coalesce(c.seq, -1) <= g.seq ORDER BY g.scope <> $scope, g.seq LIMIT $limit""",
    "j20_waiting": """SELECT w.usr, w.path, w.symbol, m.seq AS satisfied, m.usr AS made_by FROM (SELECT usr, path, symbol, min(seq) AS since FROM act WHERE kind = 'intent_declared' GROUP BY ALL) w, LATERAL (SELECT seq, usr FROM act m WHERE m.kind = 'edit_reported' AND m.what = 'added' AND m.path = w.path AND m.symbol = w.symbol ORDER BY seq LIMIT 1) m WHERE m.seq > w.since AND m.usr <> w.usr""",
    "m24_examples": """WITH u AS (SELECT source AS example, list(coalesce(l.toxic = 0 AND l.quality = 1, false)) AS good FROM documents d JOIN labels l USING (doc_id) GROUP BY source), n AS (SELECT example, len([x for x in good if x]) AS good, len([x for x in good if NOT x]) AS bad FROM u)
SELECT example, good, bad, good + bad >= $scored AND good / (good + bad) < $share AS retired FROM n""",
}

# --- declared queries ------------------------------------------------------------
TWINS |= {
    "a9_ownership": "SELECT path, arg_min(usr, (-n, first)) AS usr, max(n) AS n FROM (SELECT path, usr, count(*) AS n, min(seq) AS first FROM ledger WHERE kind = 'edit_reported' GROUP BY path, usr) t GROUP BY path",
    "a10_touches": "SELECT node, count(*) AS n FROM (SELECT unnest(CASE WHEN model <> '' THEN [path, path || '::' || model] ELSE [path] END) AS node FROM ledger WHERE kind = 'edit_reported') t GROUP BY node",
    "a15_salience": "SELECT path, CAST(coalesce(sum(w), 0) AS BIGINT) AS score FROM ledger LEFT JOIN (VALUES ('intent_declared', 3), ('intent_completed', 4), ('gate_block', 2)) v(kind, w) USING (kind) GROUP BY path",
    "a16_hot_list": "SELECT path, CAST(coalesce(sum(w), 0) AS BIGINT) AS score FROM ledger LEFT JOIN (VALUES ('intent_declared', 3), ('intent_completed', 4), ('gate_block', 2)) v(kind, w) USING (kind) GROUP BY path ORDER BY score DESC, path LIMIT $limit",
    "a20_daily": "SELECT day, len(list_distinct(list(usr))) AS agents, len(list_distinct(list(scope))) AS repos, len([x for x in list(kind) if x = 'edit_reported']) AS changes, len([x for x in list(kind) if x = 'gate_block']) AS messages FROM ledger GROUP BY day",
    "a28_modularity": """WITH e AS (SELECT CAST(right(src, 1) AS INT) AS a, CAST(right(dst, 1) AS INT) AS b FROM dep WHERE src <> dst), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e), c AS (SELECT unnest(range(10)) AS c), t AS (SELECT c.c, (SELECT count(*) FROM e WHERE a = c.c) + (SELECT count(*) FROM e WHERE b = c.c) AS deg, (SELECT count(*) FROM e WHERE a = c.c AND b = c.c) AS inn FROM c)
SELECT CAST(c AS BIGINT) AS community, deg AS degree, inn AS inner_edges, inn / m - pow(deg / (2 * m), 2) AS part FROM t, m WHERE deg > 0""",
    "a29_turn_counter": """WITH e AS (SELECT usr, list(turn_id ORDER BY seq) AS t, list(tokens ORDER BY seq) AS n FROM ledger WHERE kind = 'edit_reported' GROUP BY usr) SELECT usr, CAST(list_sum([CASE WHEN i = 1 OR t[i] <> t[i - 1] THEN n[i] ELSE 0 END for i in range(1, len(t) + 1)]) AS BIGINT) AS tokens FROM e""",
    "a30_file_hash": "WITH s AS (SELECT path, symbol, max(hash) AS h FROM ws GROUP BY ALL) SELECT path, sha256(array_to_string(list_sort(list(symbol || ':' || h)), chr(10))) AS hash FROM s GROUP BY path",
    "w4_rank_first_seen": "WITH n AS (SELECT kind, path, count(*) AS n, min(seq) AS first FROM ledger GROUP BY ALL), l AS (SELECT kind, list({'path': path, 'n': n} ORDER BY n DESC, first)[:5] AS t FROM n GROUP BY kind) SELECT kind, t[i].path AS path, t[i].n AS n, CAST(i AS INTEGER) AS r FROM l, unnest(range(1, len(t) + 1)) u(i)",
    "w5_lag_edits": "WITH e AS (SELECT seq, path, usr FROM ledger WHERE kind = 'edit_reported') SELECT e.seq, e.path, e.usr, b.usr AS before_usr FROM e ASOF LEFT JOIN e b ON b.path = e.path AND b.seq < e.seq",
    "w6_rewrites": """WITH l AS (SELECT usr, symbol, list({'seq': seq, 'hash': hash} ORDER BY seq) AS t FROM ws GROUP BY usr, symbol), c AS (SELECT usr, symbol, [t[i] for i in range(1, len(t) + 1) if i = 1 OR t[i].hash <> t[i - 1].hash] AS t FROM l)
SELECT usr, symbol, x.seq, x.hash, len(t) AS total FROM (SELECT usr, symbol, t, unnest(t[-20:]) AS x FROM c) u""",
    "w7_streak_alerts": """WITH b AS (SELECT usr, seq FROM ledger WHERE kind = 'gate_block'), c AS (SELECT usr, seq FROM ledger WHERE kind = 'check_performed')
SELECT b.usr, b.seq FROM b WHERE (SELECT count(*) FROM b x WHERE x.usr = b.usr AND x.seq <= b.seq AND x.seq > coalesce((SELECT max(c.seq) FROM c WHERE c.usr = b.usr AND c.seq < b.seq), -1)) = 3""",
    "j11_attribution": "SELECT path, arg_max(usr, (ts, seq)) AS usr, max(ts) AS ts FROM ledger WHERE kind = 'edit_reported' AND (root = $root OR root = $root2) GROUP BY path",
    "j12_freshest": "SELECT path, arg_min(usr, (-ts, seq)) AS usr, max(ts) AS ts FROM ledger WHERE kind <> 'gate_block' GROUP BY path",
    "j13_symbol_index": "SELECT symbol, list_sort(list(path))[1] AS path FROM ws GROUP BY symbol",
    "j22_gate": """WITH e AS (SELECT seq, usr, path FROM ledger WHERE kind = 'edit_reported') SELECT seq FROM e WHERE EXISTS (SELECT 1 FROM ledger m WHERE m.kind = 'gate_block' AND m.path = e.path AND m.seq < e.seq AND m.usr <> e.usr) AND NOT EXISTS (SELECT 1 FROM ledger c WHERE c.kind = 'check_performed' AND c.path = e.path AND c.usr = e.usr AND c.seq < e.seq)""",
    "j27_stakeholders": "SELECT path, count(DISTINCT usr) AS others FROM ledger WHERE kind IN ('gate_block', 'intent_declared') AND usr <> $usr GROUP BY path",
    "u3_absent_dirs": "SELECT root FROM ledger GROUP BY root HAVING count(*) FILTER (kind = 'gate_block' AND usr = $usr) = 0",
    "u4_roster": """SELECT usr, CASE WHEN bool_or(ts >= $at) THEN 'live' WHEN bool_or(kind = 'intent_declared') THEN 'intent' WHEN bool_or(kind = 'edit_reported') THEN 'edit' ELSE 'member' END AS origin FROM ledger GROUP BY usr""",
    "u5_distinct_breaking": "SELECT DISTINCT ON (path, kind, usr) path, kind, usr, seq FROM ledger WHERE kind = 'gate_block' OR kind = 'intent_completed' ORDER BY path, kind, usr, seq",
    "u6_symbol_sets": """WITH x AS (SELECT path || '/' || kind AS name, max(tokens) FILTER (ts < $at) AS a, max(tokens) FILTER (ts >= $at) AS b FROM ledger GROUP BY path, kind) SELECT name, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'modified' END AS what FROM x WHERE a IS DISTINCT FROM b""",
    "u7_uncovered": "SELECT dst AS node, CASE WHEN bool_or(kind = 'uses_type') THEN 'tested' ELSE 'uncovered' END AS what FROM dep GROUP BY dst HAVING bool_or(kind = 'calls' AND src <> dst)",
    "m7_upsert": "SELECT bucket, key, arg_max(value, seq) AS value FROM kv GROUP BY bucket, key",
    "m21_supersession": "WITH n AS (SELECT seq, path, usr FROM ledger WHERE kind = 'intent_completed') SELECT n.seq, min(m.seq) AS superseded_by FROM n LEFT JOIN n m ON m.path = n.path AND m.usr = n.usr AND m.seq > n.seq GROUP BY n.seq",
    "m23_stamps": "SELECT l.seq, (SELECT max(c.ts) FROM ledger c WHERE c.kind = 'check_performed' AND c.k % 2 = 0 AND c.path = l.path HAVING max(c.ts) >= l.ts) AS verified FROM ledger l WHERE l.kind = 'edit_reported'",
    "f30_last_reply": "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "f15_known_paths": "SELECT usr, sha256(array_to_string(list_sort(list_distinct(list(path))), chr(10)) || chr(10)) AS fingerprint FROM ledger GROUP BY usr",
    "j14_stale_notes": """WITH note AS (SELECT seq AS id, path, CASE WHEN seq % 11 <> 0 THEN hash END AS hash FROM ws WHERE seq % 3 = 0), k AS (SELECT path, len(list_distinct(list(coalesce(hash, '')))) > 1 AS conflicted FROM note GROUP BY path)
SELECT id, (SELECT arg_max(hash, seq) FROM ws WHERE ws.path = note.path) IS DISTINCT FROM note.hash AS stale, conflicted FROM note JOIN k USING (path)""",
    "j6_notes_near": """WITH n AS (SELECT seq AS id, ts, tokens % 10 AS conf, ['/', root || '/', path, path || '::' || scope][k % 4 + 1] AS anchor, usr FROM ledger WHERE kind = 'intent_completed'), keep AS (SELECT arg_max(n, id) AS n FROM n GROUP BY usr, anchor),
t AS (SELECT path, list_distinct(flatten(list([path || '::' || scope, path, root || '/', '/']))) AS keys FROM ledger WHERE path IN ($path, $path2) GROUP BY path), h AS (SELECT path, list(n ORDER BY n.conf DESC, n.ts DESC, n.id) AS l FROM t JOIN keep ON list_contains(t.keys, n.anchor) GROUP BY path)
SELECT path, l[i].id AS id, l[i].anchor AS anchor, i AS place FROM h, unnest(range(1, len(l) + 1)) u(i)""",
    "g4_dependents": "SELECT dst, len(list(src)) AS n, list_min(list(src)) AS first FROM dep WHERE src <> dst GROUP BY dst",
    "j4_collisions": """WITH x AS (SELECT o_custkey % 3 AS usr, o_custkey // 3 % 230 AS path, o_orderkey % 3 AS parse, o_orderpriority AS symbol, {'h': max(o_orderstatus), 'g': max(o_orderkey % 4)} AS v FROM orders GROUP BY ALL),
f AS (SELECT usr, path, list(parse ORDER BY parse DESC) AS parses FROM (SELECT DISTINCT usr, path, parse FROM x) y GROUP BY ALL), s AS (SELECT f.usr, f.path, map_from_entries(list((x.symbol, x.v)) FILTER (x.parse = parses[1])) AS now, map_from_entries(list((x.symbol, x.v)) FILTER (x.parse = parses[2])) AS old, len(parses) > 1 AS had FROM f JOIN x ON x.usr = f.usr AND x.path = f.path GROUP BY f.usr, f.path, parses),
p AS (SELECT o.usr AS author, o.path, m.now AS mine, o.now AS theirs, o.old, o.had, [k for k in map_keys(m.now) if NOT list_contains(map_keys(o.now), k)] AS gone, [k for k in map_keys(o.now) if NOT list_contains(map_keys(m.now), k)] AS come FROM s m JOIN s o ON o.path = m.path AND o.usr <> m.usr WHERE m.usr = $me),
d AS (SELECT *, len(gone) = 1 AND len(come) = 1 AS swap FROM p), u AS (SELECT *, unnest(list_distinct(map_keys(mine) || map_keys(theirs))) AS symbol FROM d),
k AS (SELECT *, list_contains(gone, symbol) AS is_gone, list_contains(come, symbol) AS is_new, mine[symbol] AS a, theirs[symbol] AS b FROM u)
SELECT author, path, symbol, CASE WHEN is_gone AND swap THEN 'renamed' WHEN is_gone AND had AND NOT list_contains(map_keys(old), symbol) THEN 'removed' WHEN is_gone THEN 'unknown' WHEN is_new THEN 'added' ELSE 'modified' END AS kind,
CASE WHEN is_gone AND NOT swap AND NOT (had AND NOT list_contains(map_keys(old), symbol)) THEN 'unconfirmed' ELSE 'certain' END AS confidence, CASE WHEN is_gone AND swap THEN come[1] END AS new_name, CASE WHEN NOT is_gone AND NOT is_new THEN a.g <> b.g END AS signature_change
FROM k WHERE CASE WHEN is_new THEN NOT swap WHEN is_gone THEN true ELSE a.h <> b.h END""",
    "j7_merge": """WITH x AS (SELECT o_custkey % 3 AS usr, o_custkey // 3 % 230 AS path, o_orderkey % 3 AS parse, o_orderpriority AS symbol, max(o_orderstatus) AS hash, 's' || max(o_orderkey % 4) AS sig FROM orders GROUP BY ALL), cur AS (SELECT * FROM x WHERE parse = (SELECT max(parse) FROM x y WHERE y.usr = x.usr AND y.path = x.path)),
l AS (SELECT path, symbol, list_distinct(list(usr)) AS us, list_distinct(list(hash)) AS hs, list_sort(list_distinct(list(sig))) AS gs FROM cur GROUP BY path, symbol)
SELECT path, symbol, len(us) AS holders, len(hs) AS hashes, CASE WHEN len(gs) > 1 THEN 'signature' ELSE 'implementation' END AS kind, array_to_string(gs, ',') AS signatures FROM l WHERE len(us) > 1 AND len(hs) > 1""",
}
