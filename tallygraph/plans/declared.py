"""Queries declared once in SQL that Spark and DuckDB both read.

The text is the logical plan; Catalyst picks the physical one.  "Newest" and
"first seen" are by ``seq``; every rank has a full key, so ties are fixed.
"""

from __future__ import annotations

Q: dict[str, str] = {}

# --- scans -----------------------------------------------------------------
Q["s1_scan_since"] = "SELECT seq, scope, ts, kind, usr, path FROM ledger WHERE scope = 'ws:r1' AND ts >= 1704800000 ORDER BY seq"
Q["s2_scan_kinds"] = "SELECT seq, ts, kind, usr FROM ledger WHERE scope = 'ws:r1' AND ts >= 1704800000 AND kind IN ('edit_reported', 'gate_block') ORDER BY seq"
Q["s3_scan_containing"] = """SELECT seq, kind, props FROM ledger WHERE scope = 'ws:r0' AND (instr(props, ' 1') > 0 OR instr(props, '77') > 0) ORDER BY seq"""
Q["s4_after_seq"] = "SELECT seq, kind, usr FROM ledger WHERE scope = 'ws:r2' AND seq > 500 ORDER BY seq"
Q["s5_tail"] = "SELECT * FROM (SELECT seq, kind, usr FROM ledger WHERE scope = 'ws:r0' AND seq < 900 ORDER BY seq DESC LIMIT 50) t ORDER BY seq"
Q["s6_count"] = "SELECT scope, count(*) AS n FROM ledger GROUP BY scope UNION ALL SELECT '' AS scope, count(*) AS n FROM ledger"
Q["s7_active_scopes"] = "SELECT scope FROM ledger WHERE ts >= 1705000000 GROUP BY scope"
Q["s7_scopes_like"] = "SELECT count(DISTINCT scope) AS n FROM ledger WHERE scope LIKE 'ws_r%'"
Q["s8_scopes_prefix"] = "SELECT DISTINCT scope FROM ledger WHERE left(scope, 4) = 'ws:r'"
Q["s9_kv_get"] = "SELECT key, value, updated FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM kv WHERE bucket = 'view' AND key = 'k17') t WHERE rn = 1"
Q["s10_kv_list"] = "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM kv WHERE bucket = 'click' AND left(key, 2) = 'k1') t WHERE rn = 1 ORDER BY key"
Q["s11_kv_recent"] = "SELECT key, value, updated FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM kv WHERE bucket = 'click') t WHERE rn = 1 ORDER BY updated DESC, key LIMIT 20"
Q["s12_kv_since"] = "SELECT key, value, updated FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM kv WHERE bucket = 'view') t WHERE rn = 1 AND updated >= 1706000000"
Q["s13_kv_stat"] = "SELECT count(*) AS n, coalesce(max(updated), 0) AS newest FROM (SELECT key, max(updated) AS updated FROM kv WHERE bucket = 'view' AND left(key, 2) = 'k2' GROUP BY key) t"
Q["s14_ttl_scan"] = "SELECT seq, usr, expires FROM (SELECT seq, usr, CASE WHEN k % 5 = 0 THEN NULL ELSE ts + k * 3600 END AS expires FROM ledger) t WHERE expires IS NULL OR expires > 1706000000"
Q["s15_file_states"] = "SELECT usr, path, symbol, hash FROM (SELECT *, row_number() OVER (PARTITION BY usr, path, symbol ORDER BY seq DESC) AS rn FROM ws) t WHERE rn = 1 AND path IN ('7', '8', '11')"
Q["s16_workspaces"] = "SELECT usr, count(DISTINCT path) AS files, max(seq) AS newest FROM ws GROUP BY usr"
Q["s20_export"] = """WITH c AS (SELECT scope, max(seq) - 40 AS seq FROM ledger GROUP BY scope)
SELECT scope, seq, kind, more FROM (SELECT l.scope, l.seq, l.kind, row_number() OVER (PARTITION BY l.scope ORDER BY l.seq) AS rn, count(*) OVER (PARTITION BY l.scope) > 25 AS more
FROM ledger l JOIN c ON l.scope = c.scope AND l.seq > c.seq) t WHERE rn <= 25"""

# --- roll-ups --------------------------------------------------------------
_COST = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY usr, turn_id ORDER BY seq DESC) AS nth FROM ledger WHERE kind = 'edit_reported' AND tokens > 0), d AS (SELECT * FROM e WHERE nth = 1)"""
_PRICE = "CASE WHEN left(lower(model), 5) = 'alpha' THEN 15 WHEN left(lower(model), 4) = 'beta' THEN 5 ELSE 3 END"
for _k in ("day", "model", "usr", "kind"):
    Q[f"a2_costs_by_{_k}"] = _COST + f" SELECT {_k}, count(*) AS turns, @INT[sum(tokens)] AS tokens, @INT[sum(tokens * {_PRICE})] AS micro_usd FROM d GROUP BY {_k}"
Q["a2_costs_by_root"] = _COST + " SELECT root, count(*) AS turns, @INT[sum(tokens)] AS tokens FROM d GROUP BY root ORDER BY tokens DESC, root LIMIT 8"
Q["a5_tally"] = "SELECT scope, usr, count(*) AS messages, @INT[sum(tokens)] AS tokens FROM ledger WHERE kind = 'gate_block' GROUP BY scope, usr"
Q["a9_ownership"] = "SELECT path, usr, n FROM (SELECT path, usr, count(*) AS n, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, min(seq)) AS r FROM ledger WHERE kind = 'edit_reported' GROUP BY path, usr) t WHERE r = 1"
Q["a10_touches"] = "SELECT node, count(*) AS n FROM (SELECT path AS node FROM ledger WHERE kind = 'edit_reported' UNION ALL SELECT path || '::' || model FROM ledger WHERE kind = 'edit_reported' AND model <> '') t GROUP BY node"
_SAL = "3 * count_if(kind = 'intent_declared') + 4 * count_if(kind = 'intent_completed') + 2 * count_if(kind = 'gate_block')"
Q["a15_salience"] = f"SELECT path, {_SAL} AS score FROM ledger GROUP BY path"
Q["a16_hot_list"] = f"SELECT path, {_SAL} AS score FROM ledger GROUP BY path ORDER BY score DESC, path LIMIT 15"
Q["a20_daily"] = "SELECT day, count(DISTINCT usr) AS agents, count(DISTINCT scope) AS repos, count_if(kind = 'edit_reported') AS changes, count_if(kind = 'gate_block') AS messages FROM ledger GROUP BY day"
Q["a27_highest_number"] = "SELECT root, max(CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT)) AS highest, count(DISTINCT path) AS files FROM ledger GROUP BY root"
Q["a28_modularity"] = """WITH e AS (SELECT CAST(substr(src, 2) AS BIGINT) % 10 AS cs, CAST(substr(dst, 2) AS BIGINT) % 10 AS cd FROM dep WHERE src <> dst), m AS (SELECT count(*) AS m FROM e),
i AS (SELECT cs AS c, count(*) AS n FROM e WHERE cs = cd GROUP BY cs), t AS (SELECT c, count(*) AS n FROM (SELECT cs AS c FROM e UNION ALL SELECT cd AS c FROM e) x GROUP BY c)
SELECT t.c AS community, t.n AS degree, coalesce(i.n, 0) AS inner_edges, CAST(coalesce(i.n, 0) AS DOUBLE) / m.m - (CAST(t.n AS DOUBLE) / (2 * m.m)) * (CAST(t.n AS DOUBLE) / (2 * m.m)) AS part
FROM t CROSS JOIN m LEFT JOIN i ON t.c = i.c"""
Q["a29_turn_counter"] = "WITH e AS (SELECT *, lag(turn_id) OVER (PARTITION BY usr ORDER BY seq) AS pt FROM ledger WHERE kind = 'edit_reported') SELECT usr, @INT[coalesce(sum(CASE WHEN pt IS NULL OR pt <> turn_id THEN tokens END), 0)] AS tokens FROM e GROUP BY usr"
Q["a30_file_hash"] = "SELECT path, @SHA[x] AS hash FROM (SELECT path, @NL[entry] AS x FROM (SELECT path, symbol || ':' || max(hash) AS entry FROM ws GROUP BY path, symbol) t GROUP BY path) u"
Q["a34_seats"] = "SELECT c_mktsegment AS access, count(*) AS seats, count_if(c_acctbal > 0) AS active FROM customer GROUP BY c_mktsegment"

# --- windows ---------------------------------------------------------------
Q["w4_rank_first_seen"] = "SELECT kind, path, n, r FROM (SELECT kind, path, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min(seq)) AS r FROM ledger GROUP BY kind, path) t WHERE r <= 5"
Q["w5_lag_edits"] = "SELECT seq, path, usr, lag(usr) OVER (PARTITION BY path ORDER BY seq) AS before_usr FROM ledger WHERE kind = 'edit_reported'"
Q["w6_rewrites"] = """WITH h AS (SELECT *, lag(hash) OVER (PARTITION BY usr, symbol ORDER BY seq) AS ph FROM ws), c AS (SELECT * FROM h WHERE ph IS DISTINCT FROM hash),
r AS (SELECT *, row_number() OVER (PARTITION BY usr, symbol ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY usr, symbol) AS total FROM c)
SELECT usr, symbol, seq, hash, total FROM r WHERE rn <= 20"""
Q["w7_streak_alerts"] = """WITH g AS (SELECT *, sum(CASE WHEN kind = 'check_performed' THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM ledger WHERE kind IN ('check_performed', 'gate_block')),
s AS (SELECT usr, seq, kind, sum(CASE WHEN kind = 'gate_block' THEN 1 ELSE 0 END) OVER (PARTITION BY usr, isle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM g)
SELECT usr, seq FROM s WHERE kind = 'gate_block' AND streak = 3"""
Q["w10_claim_age"] = """WITH e AS (SELECT usr, path, max(ts) AS ts FROM ledger WHERE kind = 'edit_reported' GROUP BY usr, path)
SELECT c.seq, 1707000000 - coalesce(greatest(e.ts, c.ts), c.ts) AS age FROM ledger c LEFT JOIN e ON c.usr = e.usr AND c.path = e.path WHERE c.kind = 'intent_declared'"""

# --- order and limits ------------------------------------------------------
_DEG = "WITH d AS (SELECT node, @INT[sum(i)] AS dependents, @INT[sum(o)] AS depends_on FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM dep WHERE src <> dst UNION ALL SELECT src AS node, 0 AS i, 1 AS o FROM dep WHERE src <> dst) t GROUP BY node)"
Q["o1_hubs"] = _DEG + " SELECT node, dependents, depends_on, 2 * dependents + depends_on AS by_total FROM d ORDER BY by_total DESC, node LIMIT 20"
Q["o3_node_cap"] = _DEG + ", k AS (SELECT node FROM (SELECT node FROM d ORDER BY dependents + depends_on DESC, node LIMIT 50) t UNION SELECT node FROM d WHERE node IN ('p3', 'p190')) SELECT e.src, e.dst, e.kind FROM dep e JOIN k a ON e.src = a.node JOIN k b ON e.dst = b.node"
Q["o4_newest_cap"] = "SELECT kind, count(*) AS n FROM (SELECT kind FROM ledger ORDER BY seq DESC LIMIT 4000) t GROUP BY kind"
Q["o6_search"] = """WITH l AS (SELECT 'ledger' AS origin, seq AS id, ts FROM ledger WHERE instr(lower(kind || ' ' || usr || ' ' || path), 'f42.py') > 0 ORDER BY seq DESC LIMIT 40),
n AS (SELECT 'note' AS origin, doc_id AS id, CAST(doc_id AS DOUBLE) AS ts FROM documents WHERE instr(lower(text), 'f42.py') > 0 ORDER BY doc_id DESC LIMIT 40) SELECT * FROM l UNION ALL SELECT * FROM n"""
Q["o10_recipes"] = "SELECT seq, scope FROM ledger WHERE kind = 'intent_completed' ORDER BY CASE WHEN scope = 'ws:r1' THEN 0 ELSE 1 END, seq DESC LIMIT 3"

# --- joins and sets --------------------------------------------------------
_CUR = "WITH c AS (SELECT usr, path, symbol, hash, seq FROM (SELECT *, row_number() OVER (PARTITION BY usr, path, symbol ORDER BY seq DESC) AS rn FROM ws) t WHERE rn = 1)"
Q["j9_callers"] = "SELECT src AS caller, kind FROM dep WHERE dst = 'p3' AND src <> dst"
Q["j11_attribution"] = "SELECT path, usr, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS r FROM ledger WHERE kind = 'edit_reported' AND root IN ('d1', 'd5')) t WHERE r = 1"
Q["j12_freshest"] = "SELECT path, usr, ts FROM (SELECT path, usr, ts, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq) AS r FROM ledger WHERE kind <> 'gate_block') t WHERE r = 1"
Q["j13_symbol_index"] = "SELECT symbol, min(path) AS path FROM ws GROUP BY symbol"
Q["j22_gate"] = """SELECT seq FROM (SELECT seq, usr, kind, min(CASE WHEN kind = 'gate_block' THEN usr END) OVER p AS u1, max(CASE WHEN kind = 'gate_block' THEN usr END) OVER p AS u2, max(CASE WHEN kind = 'check_performed' THEN 1 ELSE 0 END) OVER m AS checked FROM ledger
WINDOW p AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m AS (PARTITION BY path, usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t
WHERE kind = 'edit_reported' AND (u1 <> usr OR u2 <> usr) AND coalesce(checked, 0) = 0"""
Q["j27_stakeholders"] = "SELECT path, count(DISTINCT usr) AS others FROM (SELECT path, usr FROM ledger WHERE kind = 'gate_block' UNION SELECT path, usr FROM ledger WHERE kind = 'intent_declared') t WHERE usr <> 'u1' GROUP BY path"
Q["u1_diverging"] = """WITH a AS (SELECT o_orderpriority || '/' || (o_custkey % 1499) AS path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderpriority || '/' || (o_custkey % 1499) AS path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, a.hash AS mine, b.hash AS theirs FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash"""
Q["u3_absent_dirs"] = "SELECT DISTINCT l.root FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger h WHERE h.root = l.root AND h.kind = 'gate_block' AND h.usr = 'u7')"
Q["u5_distinct_breaking"] = "SELECT path, kind, usr, seq FROM (SELECT *, row_number() OVER (PARTITION BY path, kind, usr ORDER BY seq) AS r FROM ledger WHERE kind IN ('gate_block', 'intent_completed')) t WHERE r = 1"

# --- graph -----------------------------------------------------------------
Q["g1_name_index"] = "SELECT name, count(*) AS n FROM (SELECT p_type AS name FROM part UNION ALL SELECT regexp_extract(p_type, '([A-Z]+)$', 1) AS name FROM part WHERE p_type LIKE '% %') t GROUP BY name"
Q["g4_dependents"] = "SELECT dst, count(*) AS n, min(src) AS first FROM dep WHERE src <> dst GROUP BY dst"

# --- folds that windows express, hashes and text ---------------------------
Q["m6_merkle"] = """WITH f AS (SELECT root, path, @SHA[path || ':' || n] AS h FROM (SELECT root, path, count(*) AS n FROM ledger GROUP BY root, path) t), l AS (SELECT root, path || ':' || h AS entry FROM f),
d AS (SELECT root, @NL[entry] AS x FROM l GROUP BY root) SELECT root, @SHA[x] AS h FROM d"""
Q["m7_upsert"] = "SELECT bucket, key, value FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM kv) t WHERE rn = 1"
Q["f1_prices"] = f"SELECT model, {_PRICE} AS usd, count(*) AS n FROM ledger GROUP BY model"
Q["f6_age_text"] = "SELECT seq, CASE WHEN age < 120 THEN 'now' WHEN age < 7200 THEN (@INT[floor(age / 60)]) || 'm' ELSE (@INT[floor(age / 3600)]) || 'h' END AS age FROM (SELECT seq, 1706745600 - ts AS age FROM ledger) t"
Q["f7_truncate"] = "SELECT doc_id, substr(text, 1, 40) AS head, length(text) AS n FROM documents"
Q["f10_path_key"] = "SELECT DISTINCT path, substr(sha1(path), 1, 16) AS key FROM ledger"
Q["f11_line_hashes"] = "SELECT doc_id, pos, substr(sha1(l), 1, 8) AS h FROM line"
Q["f20_numbers"] = "SELECT DISTINCT path, CAST(regexp_extract(path, '([0-9]+)[.]', 1) AS BIGINT) AS number, length(regexp_extract(path, '([0-9]+)[.]', 1)) AS width FROM ledger"
Q["f30_last_reply"] = "SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') t WHERE r = 1"
Q["p15_live_claims"] = "SELECT seq, usr FROM ledger WHERE (kind = 'intent_declared' AND ts >= 1706600000) OR (kind = 'intent_completed' AND ts >= 1706500000)"
