"""Declared queries on anchors, visibility, roster, edge resolution, notes and
verification.  Like ``declared``, each text is read by Spark and DuckDB.

Joins that the semantics state as "symbol or file or ancestor" are written as
equi-joins on exploded keys, and "best candidate anywhere" as a join to one
pre-aggregated row per name, so no name that many files share multiplies rows.
"""

from __future__ import annotations

from ..functions.text import machine_folder, repo_key, repo_name, repo_owner
from .rules import TWINS, backwards

Q: dict[str, str] = {}

# --- predicates and projections -------------------------------------------
_NODES = "(SELECT path || '::' || kind AS node FROM ledger UNION SELECT 'ext:' || usr AS node FROM ledger UNION SELECT path AS node FROM ledger) t"
Q["p1_node_parts"] = f"""SELECT node, left(node, 4) = 'ext:' AS external, CASE WHEN instr(node, '::') > 0 THEN substr(node, 1, instr(node, '::') - 1) ELSE node END AS path,
CASE WHEN instr(node, '::') > 0 THEN substr(node, instr(node, '::') + 2) ELSE '' END AS symbol FROM {_NODES}"""
_URLPATH = "(SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages) u"
#: Directory names that hold tests.
TEST_DIRS = "tests|test|__tests__|spec|specs|testing"
Q["p2_test_paths"] = f"""SELECT page_id, path, regexp_extract(path, '((^|/)({TEST_DIRS})/)', 1) <> '' OR name = 'conftest.py' OR regexp_extract(stem, '(^test[_-]|[_-](test|spec)$|(Test|Tests|Spec|Specs)$)', 1) <> ''
OR instr(name, '.test.') > 0 OR instr(name, '.spec.') > 0 AS is_test FROM (SELECT *, regexp_extract(name, '^([^.]*)', 1) AS stem FROM (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM {_URLPATH}) v) w"""
Q["p4_naming"] = """SELECT path, name, CASE WHEN ext = 'py' THEN regexp_extract(name, '^([a-z]+[A-Z])', 1) <> '' WHEN ext IN ('ts', 'tsx') THEN regexp_extract(name, '^([a-z]+_[a-z])', 1) <> '' ELSE false END AS misnamed
FROM (SELECT DISTINCT path, kind AS name, 'py' AS ext FROM ledger UNION SELECT DISTINCT path, kind AS name, 'ts' AS ext FROM ledger UNION SELECT DISTINCT path, 'getValue' AS name, 'py' AS ext FROM ledger) t"""
Q["p7_anchors"] = """SELECT anchor, CASE WHEN trim(anchor) = '' THEN NULL WHEN instr(anchor, '::') > 0 THEN CASE WHEN left(trim(anchor), 2) = '::' OR right(trim(anchor), 2) = '::' THEN NULL ELSE 'symbol' END WHEN right(trim(anchor), 1) = '/' THEN 'dir' ELSE 'file' END AS sort
FROM (SELECT DISTINCT CASE k % 6 WHEN 0 THEN root || '/' WHEN 1 THEN path WHEN 2 THEN path || '::' || kind WHEN 3 THEN path || '::' WHEN 4 THEN '  ' ELSE '::' || kind END AS anchor FROM ledger) t"""
_ACL = "a AS (SELECT DISTINCT usr, scope FROM ledger WHERE kind = 'intent_completed' UNION SELECT 'u9' AS usr, '*' AS scope)"
Q["p9_visible"] = f"WITH {_ACL} SELECT l.seq, l.scope FROM ledger l WHERE EXISTS (SELECT 1 FROM a WHERE a.usr = 'u9' AND a.scope = l.scope) OR EXISTS (SELECT 1 FROM a WHERE a.usr = 'u9' AND a.scope = '*')"
Q["p11_history"] = "SELECT l.seq FROM ledger l CROSS JOIN (SELECT max(ts) AS newest FROM ledger) m WHERE l.ts >= m.newest - least(30, 7) * 86400"
Q["p16_intent_match"] = """WITH i AS (SELECT DISTINCT path, model FROM ledger WHERE kind = 'intent_declared' AND usr = 'u3')
SELECT e.seq FROM ledger e WHERE e.kind = 'edit_reported' AND (EXISTS (SELECT 1 FROM i WHERE i.path = e.path) OR (e.model <> '' AND EXISTS (SELECT 1 FROM i WHERE i.model = e.model AND i.path <> e.path)))"""

# --- sets ------------------------------------------------------------------
Q["u4_roster"] = """WITH s AS (SELECT DISTINCT usr, 0 AS pri, 'live' AS origin FROM ledger WHERE ts >= 1706600000 UNION SELECT DISTINCT usr, 1 AS pri, 'intent' AS origin FROM ledger WHERE kind = 'intent_declared'
UNION SELECT DISTINCT usr, 2 AS pri, 'edit' AS origin FROM ledger WHERE kind = 'edit_reported' UNION SELECT DISTINCT usr, 3 AS pri, 'member' AS origin FROM ledger)
SELECT usr, origin FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY pri) AS r FROM s) t WHERE r = 1"""
_HALVES = "a AS (SELECT path || '/' || kind AS name, max(tokens) AS hash FROM ledger WHERE ts < 1705400000 GROUP BY path, kind), b AS (SELECT path || '/' || kind AS name, max(tokens) AS hash FROM ledger WHERE ts >= 1705400000 GROUP BY path, kind)"
Q["u6_symbol_sets"] = f"WITH {_HALVES} SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'added' ELSE 'modified' END AS what FROM a FULL OUTER JOIN b ON a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash"
Q["u7_uncovered"] = """WITH c AS (SELECT DISTINCT dst AS node FROM dep WHERE kind = 'calls' AND src <> dst), t AS (SELECT DISTINCT dst AS node FROM dep WHERE kind = 'uses_type')
SELECT node, 'tested' AS what FROM c WHERE EXISTS (SELECT 1 FROM t WHERE t.node = c.node) UNION ALL SELECT node, 'uncovered' AS what FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.node = c.node)"""

# --- edge resolution and lookups ------------------------------------------
_DECL = """decl AS (SELECT DISTINCT p_brand AS dir, p_brand || '/' || (p_partkey % 97) || '.py' AS path, p_type AS name FROM part),
raw AS (SELECT DISTINCT a.p_brand AS dir, a.p_brand || '/' || (a.p_partkey % 97) || '.py' AS path, b.p_type AS name, CASE a.p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rk,
  CASE WHEN a.p_partkey % 3 = 0 THEN b.p_brand || '/' || (b.p_partkey % 97) || '.py' END AS bound, CASE WHEN a.p_partkey % 3 = 1 THEN b.p_brand || '/' || (b.p_partkey % 97) || '.py' END AS star
  FROM part a JOIN part b ON b.p_partkey = CAST(floor(a.p_partkey / 7) AS BIGINT) WHERE a.p_partkey > 0),
near AS (SELECT dir, name, path FROM (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY length(path), path) AS r FROM decl) t WHERE r = 1),
anyw AS (SELECT name, path, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(path), path) AS r, count(*) OVER (PARTITION BY name) AS n FROM decl) t WHERE r = 1)"""
Q["j1_resolve"] = f"""WITH {_DECL}, x AS (SELECT raw.path AS src, raw.name, raw.rk, coalesce(own.path, raw.bound, raw.star, near.path, anyw.path) AS dst,
CASE WHEN own.path IS NOT NULL OR raw.bound IS NOT NULL THEN 'extracted' WHEN raw.star IS NOT NULL OR near.path IS NOT NULL OR anyw.n = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence
FROM raw LEFT JOIN decl own ON own.path = raw.path AND own.name = raw.name LEFT JOIN near ON near.dir = raw.dir AND near.name = raw.name LEFT JOIN anyw ON anyw.name = raw.name)
SELECT src, dst, CASE rk WHEN 0 THEN 'inherits' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses_type' ELSE 'references' END AS kind, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY rk, confidence, name) AS r FROM x WHERE dst IS NOT NULL AND src <> dst) t WHERE r = 1"""
Q["j3_node_lookup"] = """WITH n AS (SELECT DISTINCT p_brand AS path, p_type AS name FROM part), q AS (SELECT DISTINCT p_brand AS path, upper(p_type) AS name, regexp_extract(p_type, '([A-Za-z]+)$', 1) AS bare FROM part WHERE p_size % 3 = 0),
b AS (SELECT path, regexp_extract(name, '([A-Za-z]+)$', 1) AS bare, min(name) AS name, count(*) AS n FROM n GROUP BY path, regexp_extract(name, '([A-Za-z]+)$', 1)), g AS (SELECT bare, min(path || '::' || name) AS id, count(*) AS n FROM (SELECT path, name, regexp_extract(name, '([A-Za-z]+)$', 1) AS bare FROM n) t GROUP BY bare)
SELECT q.path, q.name, coalesce(n.path || '::' || n.name, b.path || '::' || b.name, g.id) AS node FROM q LEFT JOIN n ON n.path = q.path AND n.name = q.name LEFT JOIN b ON b.path = q.path AND b.bare = q.bare AND b.n = 1 LEFT JOIN g ON g.bare = q.bare AND g.n = 1"""
_NOTES = """n AS (SELECT seq AS id, usr, ts AS created, tokens % 10 AS conf, path, root, kind, CASE k % 4 WHEN 0 THEN '/' WHEN 1 THEN root || '/' WHEN 2 THEN path ELSE path || '::' || scope END AS anchor FROM ledger WHERE kind = 'intent_completed')"""
Q["j6_notes_near"] = f"""WITH {_NOTES}, keep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr, anchor ORDER BY id DESC) AS v FROM n) t WHERE v = 1),
tg AS (SELECT DISTINCT path, root, scope FROM ledger WHERE path IN ('d2/f42.py', 'd1/f9.py')), ky AS (SELECT path, path || '::' || scope AS anchor FROM tg UNION SELECT path, path AS anchor FROM tg UNION SELECT path, root || '/' AS anchor FROM tg UNION SELECT path, '/' AS anchor FROM tg)
SELECT ky.path, keep.id, keep.anchor, @INT[row_number() OVER (PARTITION BY ky.path ORDER BY keep.conf DESC, keep.created DESC, keep.id)] AS place FROM ky JOIN keep ON keep.anchor = ky.anchor"""
Q["p8_note_matches"] = f"WITH {_NOTES} SELECT id, anchor FROM n WHERE anchor IN ('/', 'd2/', 'd2/f42.py', 'd2/f42.py::ws:r1')"
Q["j14_stale_notes"] = """WITH cur AS (SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM ws) t WHERE r = 1), note AS (SELECT seq AS id, path, CASE WHEN seq % 11 = 0 THEN NULL ELSE hash END AS hash FROM ws WHERE seq % 3 = 0),
kinds AS (SELECT path, count(DISTINCT coalesce(hash, '')) AS n FROM note GROUP BY path) SELECT note.id, note.hash IS DISTINCT FROM cur.hash AS stale, kinds.n > 1 AS conflicted FROM note LEFT JOIN cur ON cur.path = note.path JOIN kinds ON kinds.path = note.path"""
Q["j23_acknowledge"] = """WITH ch AS (SELECT symbol, path, seq, CASE seq % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'removed' ELSE 'signature' END AS what, hash FROM ws WHERE usr = '0'), mine AS (SELECT path, symbol, max(hash) AS hash FROM ws WHERE usr = '1' GROUP BY path, symbol)
SELECT ch.seq, CASE ch.what WHEN 'removed' THEN m.symbol IS NULL WHEN 'renamed' THEN m.symbol IS NOT NULL ELSE coalesce(m.hash = ch.hash, false) END AS acknowledged FROM ch LEFT JOIN mine m ON CAST(m.path AS BIGINT) = CAST(ch.path AS BIGINT) + 1 AND m.symbol = ch.symbol"""
Q["j24_aliases"] = """WITH raw AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS id FROM pages), ky AS (SELECT id, lower(regexp_extract(id, '([^/]+/[^/]*)$', 1)) AS k2, length(id) - length(replace(id, '/', '')) AS q FROM raw),
top AS (SELECT *, rank() OVER (PARTITION BY k2 ORDER BY q DESC) AS r FROM ky WHERE k2 <> ''), best AS (SELECT k2, min(id) AS id, count(*) AS n FROM top WHERE r = 1 GROUP BY k2)
SELECT ky.id, CASE WHEN best.n = 1 THEN best.id ELSE ky.id END AS canonical FROM ky LEFT JOIN best ON best.k2 = ky.k2"""
Q["j30_helpers"] = """WITH ch AS (SELECT DISTINCT dst AS node FROM dep WHERE kind = 'inherits') SELECT DISTINCT e.src AS node, e.dst AS callee, p.p_name AS signature FROM dep e JOIN ch ON ch.node = e.src JOIN part p ON 'p' || p.p_partkey = e.dst WHERE e.src <> e.dst AND NOT EXISTS (SELECT 1 FROM ch c2 WHERE c2.node = e.dst)"""

# --- outcomes, ranks, verification ----------------------------------------
Q["o11_scars"] = "SELECT seq, path, usr FROM ledger WHERE kind = 'gate_block' ORDER BY ts DESC, seq DESC LIMIT 8"
Q["o14_recipe"] = "SELECT seq, scope FROM ledger WHERE kind = 'intent_completed' AND k = 42 ORDER BY CASE WHEN scope = 'ws:r2' THEN 0 ELSE 1 END, seq DESC LIMIT 1"
Q["s29_index_plan"] = """WITH rec AS (SELECT path, max(tokens) AS sha FROM ledger WHERE seq % 2 = 0 GROUP BY path), now AS (SELECT path, root, max(tokens) AS sha, max(CASE WHEN kind = 'edit_reported' THEN ts END) AS touched FROM ledger GROUP BY path, root), folder AS (SELECT root, count(*) AS n FROM ledger GROUP BY root)
SELECT n.path, n.touched, act.n AS activity FROM now n JOIN folder act ON act.root = n.root WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.path = n.path AND rec.sha = n.sha)
ORDER BY CASE WHEN n.touched IS NULL THEN 1 ELSE 0 END, n.touched DESC, act.n DESC, n.path LIMIT 60"""
_SCARS = """WITH v AS (SELECT seq, usr, path, kind, tokens % 4 AS hash, CASE WHEN kind = 'edit_reported' THEN lag(tokens % 4) OVER (PARTITION BY path, kind ORDER BY seq) END AS before FROM ledger WHERE kind IN ('intent_declared', 'edit_reported')),
k AS (SELECT *, min(CASE WHEN kind = 'edit_reported' AND hash = 0 THEN seq END) OVER f AS n0, min(CASE WHEN kind = 'edit_reported' AND hash = 1 THEN seq END) OVER f AS n1, min(CASE WHEN kind = 'edit_reported' AND hash = 2 THEN seq END) OVER f AS n2, min(CASE WHEN kind = 'edit_reported' AND hash = 3 THEN seq END) OVER f AS n3
  FROM v WINDOW f AS (PARTITION BY path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, CASE WHEN kind = 'edit_reported' AND before <> hash THEN CASE before WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END END AS reverted FROM k),
m AS (SELECT *, min(reverted) OVER (PARTITION BY path, usr ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first FROM b) SELECT seq AS intent, path, first AS reverted FROM m WHERE kind = 'intent_declared' AND first IS NOT NULL"""
Q["m11_scars"], TWINS["m11_scars"] = backwards(_SCARS), _SCARS
Q["m20_draft_diff"] = "WITH " + _HALVES + """, d AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS what FROM a FULL OUTER JOIN b ON a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash)
SELECT what, name FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY name) AS r FROM d) t WHERE r <= CASE what WHEN 'changed' THEN 20 ELSE 10 END"""
Q["m21_supersession"] = "WITH n AS (SELECT seq, path, usr, lag(seq) OVER (PARTITION BY path, usr ORDER BY seq) AS replaces FROM ledger WHERE kind = 'intent_completed') SELECT o.seq, n.seq AS superseded_by FROM n o LEFT JOIN n ON n.replaces = o.seq"
Q["m23_stamps"] = "WITH v AS (SELECT path, max(ts) AS verified FROM ledger WHERE kind = 'check_performed' AND k % 2 = 0 GROUP BY path) SELECT l.seq, CASE WHEN v.verified >= l.ts THEN v.verified END AS verified FROM ledger l LEFT JOIN v ON v.path = l.path WHERE l.kind = 'edit_reported'"
Q["f3_day"] = "SELECT day, count(*) AS n FROM ledger GROUP BY day"
_AGG = "SELECT doc_id, @INT[min(pos)] AS pos, substr(sha1(l), 1, 8) AS h FROM line GROUP BY doc_id, l"
Q["f13_fingerprint"] = f"SELECT doc_id, substr(@SHA[x], 1, 24) AS fingerprint FROM (SELECT doc_id, @SL[h] AS x FROM ({_AGG}) t GROUP BY doc_id) u"
Q["f15_known_paths"] = "SELECT usr, @SHA[x] AS fingerprint FROM (SELECT usr, @NL[path] || chr(10) AS x FROM (SELECT DISTINCT usr, path FROM ledger) t GROUP BY usr) u"
Q["f19_escapes"] = "SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages"
Q["f21_settled_id"] = "SELECT seq, regexp_extract(note, '^.settled ([0-9a-f]+).', 1) AS id FROM (SELECT seq, CASE WHEN k % 3 = 0 THEN '[settled ' || substr(sha1(path), 1, 12) || '] done' ELSE 'open ' || path END AS note FROM ledger) t"

# --- overlays on the graph and live state ----------------------------------
_CROWD = """c AS (SELECT 'p' || k AS node, usr, max(1706745600 - ts) AS age FROM ledger WHERE kind = 'intent_declared' GROUP BY k, usr), cn AS (SELECT DISTINCT node FROM c),
d1 AS (SELECT DISTINCT src, dst FROM dep WHERE src <> dst), h AS (SELECT node, node AS other, 0 AS hop FROM cn UNION ALL SELECT cn.node, d1.src AS other, 1 AS hop FROM cn JOIN d1 ON d1.dst = cn.node
UNION ALL SELECT cn.node, y.src AS other, 2 AS hop FROM cn JOIN d1 x ON x.dst = cn.node JOIN d1 y ON y.dst = x.src)"""
Q["g11_breaking_overlay"] = f"""WITH {_CROWD}, b AS (SELECT 'p' || k AS node, seq, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS verified FROM ledger WHERE kind = 'gate_block'),
r AS (SELECT h.other AS node, h.hop, b.seq, row_number() OVER (PARTITION BY h.other ORDER BY h.hop, b.seq) AS rn FROM b JOIN h ON h.node = b.node WHERE b.verified = 0) SELECT node, hop, seq FROM r WHERE rn = 1"""
Q["g12_pressure"] = f"""WITH {_CROWD}, a AS (SELECT h.node, c.usr, min(h.hop) AS hop FROM h JOIN c ON c.node = h.other GROUP BY h.node, c.usr),
w AS (SELECT node, sum(CASE hop WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 3 END) - 10 AS crowd FROM a GROUP BY node), o AS (SELECT node, max(age) AS age FROM c GROUP BY node), s AS (SELECT 'p' || k AS node, count(*) AS n FROM ledger WHERE kind = 'gate_block' GROUP BY k)
SELECT w.node, round(1 - exp(-(CAST(w.crowd AS DOUBLE) / 10) * (1 + least(o.age / 900, 1)) * (1 + least(CAST(coalesce(s.n, 0) AS DOUBLE) / 4, 1)) / 2), 2) AS pressure FROM w JOIN o ON o.node = w.node LEFT JOIN s ON s.node = w.node WHERE w.crowd > 0"""

# --- repository keys and the traffic gate -----------------------------------
REPO_IDS = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'git@Host.com:' || regexp_extract(url, '://([^?#]*)', 1) || '.git/' WHEN 2 THEN '  ' || upper(url) || '#main ' WHEN 3 THEN 'local/App' WHEN 4 THEN 'C:' || chr(92) || 'src' || chr(92) || 'App'
WHEN 5 THEN regexp_extract(url, '://[^/]*(/[^?#]*)', 1) ELSE 'ssh://' || regexp_extract(url, '://([^?#]*)', 1) END AS id FROM pages) t"""
Q["f9_repo_keys"] = f"SELECT page_id, {repo_name('id')} AS name, {repo_key('id')} AS rkey, {repo_owner('id')} AS owner, {machine_folder('id')} AS machine FROM {REPO_IDS}"
_GATE = """g AS (SELECT DISTINCT scope, root AS grp, path FROM ledger WHERE usr = 'u3' AND kind = 'edit_reported'), live AS (SELECT DISTINCT scope, usr, path, ts >= 1706700000 AS late FROM ledger
WHERE usr <> 'u3' AND kind IN ('intent_declared', 'gate_block') AND ts >= 1706600000), b AS (SELECT DISTINCT g.scope, g.grp, live.usr, live.late FROM g JOIN live ON live.scope = g.scope AND live.path = g.path)"""
Q["g15_gate"] = f"""WITH {_GATE}, w AS (SELECT * FROM b WHERE late) SELECT n.scope, n.grp, CASE WHEN count(w.usr) = 0 THEN 'run_now' ELSE 'hold' END AS verdict, @SL[w.usr] AS blocked_by
FROM (SELECT DISTINCT scope, grp FROM g) n LEFT JOIN w ON w.scope = n.scope AND w.grp = n.grp GROUP BY n.scope, n.grp"""
Q["g15_released"] = f"WITH {_GATE} SELECT scope, grp, @SS[usr] AS freed_by FROM b GROUP BY scope, grp HAVING count_if(late) = 0"
