"""Rules with all their conditions, on the ``act`` view.

A rule is a text with ``$name`` parameters and their defaults; ``sql`` fills
them in.  Spans, limits and thresholds stand at the values of the rule.  Ranks
have a full key.  A rule of two texts (``pair``) is written once for Spark and
once, independently, for DuckDB.
"""

from __future__ import annotations

import re

RULES: dict[str, tuple[str, dict]] = {}
#: Rules whose DuckDB text is not the Spark text.
TWINS: dict[str, str] = {}
#: The instant at which a rule is asked, an hour after the last row or so.
NOW = 1704107700


def literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(map(literal, value)) + ")"
    return "'" + str(value).replace("'", "''") + "'"


def rule(name: str, text: str, **params) -> None:
    RULES[name] = text, params


def pair(name: str, spark: str, duck: str, **params) -> None:
    RULES[name] = spark, params
    TWINS[name] = duck


def backwards(text: str) -> str:
    """``text`` with windows over all that follows a row as windows over all
    that precedes it in the opposite order, which Spark fills in one pass; it
    fills the former anew for every row.  ``seq`` is without ties."""
    return text.replace("ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")


def _filled(text: str, known: dict, given: dict) -> str:
    unknown = set(given) - set(known)
    if unknown:
        raise TypeError(f"no parameter {sorted(unknown)}")
    values = {"now": NOW} | known | given
    return re.sub(r"\$([a-z]\w*)", lambda m: literal(values[m[1]]) if m[1] in values else m[0], text)


def sql(name: str, **params) -> str:
    """The rule's text with its parameters; an unknown one is a TypeError."""
    text, known = RULES[name]
    return _filled(text, known, params)


def twin(name: str, **params) -> str:
    text, known = RULES[name]
    return _filled(TWINS.get(name, text), known, params)


#: Literals of a declared query that stand for who, where and when is asked.
_LIFTED = (("scope", r"'ws:r\d+'"), ("usr", r"'u\d+'"), ("node", r"'p\d+'"), ("path", r"'d\d+/[^']*'"), ("root", r"'d\d+/?'"), ("at", r"\b17\d{8}\b"), ("limit", r"(?<=LIMIT )\d+"))


def lifted(text: str) -> tuple[str, dict]:
    """A declared query with such literals as parameters, which they default to:
    the first of a sort by its name, others with a number behind it."""
    params: dict = {}
    for name, pattern in _LIFTED:
        seen: dict[str, str] = {}

        def put(m: re.Match) -> str:
            if m[0] not in seen:
                seen[m[0]] = name if not seen else f"{name}{len(seen) + 1}"
                params[seen[m[0]]] = m[0].strip("'") if m[0][0] == "'" else int(m[0])
            return f"${seen[m[0]]}"

        text = re.sub(pattern, put, text)
    return text, params


# --- journal, costs, activity ------------------------------------------------
_KEY = "usr || ':' || CASE WHEN session <> '' THEN session WHEN agent <> '' THEN agent ELSE 'work' END"
_USED = "CASE WHEN c1 <> 0 OR c2 <> 0 OR c3 <> 0 OR c4 <> 0 THEN c1 + c2 + c3 + c4 ELSE tokens END"
_WINDOW = "ts >= $now - least(90, greatest(0.02, $days)) * 86400"
_SESSIONS = f"""m AS (SELECT *, {_KEY} AS skey, {_USED} AS used FROM act WHERE {_WINDOW}),
b AS (SELECT *, max(ts) OVER (PARTITION BY skey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM m),
o AS (SELECT *, high IS NULL OR ts - high > $gap AS opens, CASE WHEN kind = 'edit_reported' THEN row_number() OVER (PARTITION BY kind, turn_id, CASE WHEN turn_id = '' OR kind <> 'edit_reported' THEN seq END ORDER BY seq) END AS nth FROM b),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY skey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)"""
_JOURNAL = f"""{_SESSIONS}, p AS (SELECT skey, sid, path, row_number() OVER (PARTITION BY skey, sid ORDER BY count(*) DESC, min(seq)) AS place FROM s WHERE kind = 'edit_reported' GROUP BY skey, sid, path),
t AS (SELECT skey, sid, concat_ws('|', max(CASE WHEN place = 1 THEN path END), max(CASE WHEN place = 2 THEN path END), max(CASE WHEN place = 3 THEN path END), max(CASE WHEN place = 4 THEN path END)) AS top_paths FROM p GROUP BY skey, sid),
g AS (SELECT skey, sid, min(usr) AS usr, min_by(agent, seq) AS agent, max_by(model, CASE WHEN kind = 'edit_reported' AND model <> '' THEN seq + 1 WHEN opens THEN 0 ELSE -1 END) AS model, min(ts) AS started, max(ts) AS ended,
  count_if(kind = 'edit_reported') AS edits, @INT[coalesce(sum(CASE WHEN nth = 1 THEN used END), 0)] AS tokens, @INT[coalesce(sum(CASE WHEN kind = 'edit_reported' THEN lines_added END), 0)] AS lines_added,
  @INT[coalesce(sum(CASE WHEN kind = 'edit_reported' THEN lines_removed END), 0)] AS lines_removed, count_if(kind = 'edit_reported' AND parse = 'partial') AS parse_failures,
  count_if(kind = 'intent_completed') AS intents_completed, count_if(kind = 'intent_completed' AND why <> '') AS rationales, count_if(kind = 'watchdog') AS watchdog FROM s GROUP BY skey, sid)"""
rule("a1_journal", f"""WITH {_JOURNAL} SELECT g.skey, @INT[g.sid] AS session, usr, agent, model, started, ended, edits, tokens, lines_added, lines_removed, parse_failures, intents_completed, rationales, watchdog, coalesce(top_paths, '') AS top_paths
FROM g LEFT JOIN t ON t.skey = g.skey AND t.sid = g.sid""", days=90, gap=1800)
rule("w1_sessions", f"WITH {_SESSIONS} SELECT skey, @INT[sid] AS session, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM s GROUP BY skey, sid", days=90, gap=1800)
_BILLED = f"""e AS (SELECT *, {_USED} AS used, CASE WHEN left(lower(model), 5) = 'alpha' THEN 15 WHEN left(lower(model), 4) = 'beta' THEN 5 ELSE 3 END AS rate FROM act WHERE kind = 'edit_reported' AND {_WINDOW}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, CASE WHEN turn_id = '' THEN seq END ORDER BY seq DESC) AS nth FROM e WHERE used > 0) t WHERE nth = 1)"""
rule("a3_recap", f"""WITH {_JOURNAL}, {_BILLED}, r AS (SELECT root, sum(used) AS used FROM d GROUP BY root ORDER BY used DESC, root LIMIT 8)
SELECT 'sessions' AS part, usr AS item, count(*) AS n, @INT[sum(tokens)] AS tokens FROM g GROUP BY usr UNION ALL SELECT 'day', CAST(@INT[floor(ts / 86400)] AS VARCHAR(20)), count(*), @INT[sum(used)] FROM d GROUP BY @INT[floor(ts / 86400)]
UNION ALL SELECT 'model', model, count(*), @INT[sum(used)] FROM d GROUP BY model UNION ALL SELECT 'usr', usr, count(*), @INT[sum(used)] FROM d GROUP BY usr UNION ALL SELECT 'root', r.root, count(*), @INT[max(r.used)] FROM r GROUP BY r.root
UNION ALL SELECT 'usd_micro', '', count(*), @INT[sum(used * rate)] FROM d""", days=200, gap=1800)
rule("a4_savings", """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS r FROM act WHERE kind IN ('gate_block', 'collision_returned', 'override', 'tripwire_fired')) t WHERE r <= $newest)
SELECT grouping(kind) AS g1, grouping(scope) AS g2, grouping(day) AS g3, kind, scope, day, count(*) AS n, @INT[sum(tokens)] AS saved, count_if(k % 2 = 0) / count(*) AS answered
FROM (SELECT *, @INT[floor(ts / 86400)] AS day FROM n) u GROUP BY GROUPING SETS ((kind), (scope), (day), ())""", newest=4000)
_CHECKED = """c AS (SELECT *, max(CASE WHEN kind = 'check_performed' THEN 1 ELSE 0 END) OVER (PARTITION BY usr, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_session,
max(CASE WHEN kind = 'check_performed' THEN 1 ELSE 0 END) OVER (PARTITION BY usr, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_path FROM act WHERE ts >= $now - $since),
w AS (SELECT *, coalesce(by_session, 0) = 1 OR coalesce(by_path, 0) = 1 AS checked FROM c WHERE kind = 'edit_reported' AND NOT auto)"""
rule("a6_activity", """WITH a AS (SELECT * FROM act WHERE ts >= $now - $since), p AS (SELECT usr, path, row_number() OVER (PARTITION BY usr ORDER BY count(*) DESC, min(seq)) AS place FROM a WHERE kind = 'edit_reported' GROUP BY usr, path),
t AS (SELECT usr, concat_ws('|', max(CASE WHEN place = 1 THEN path END), max(CASE WHEN place = 2 THEN path END), max(CASE WHEN place = 3 THEN path END), max(CASE WHEN place = 4 THEN path END), max(CASE WHEN place = 5 THEN path END)) AS top_paths FROM p GROUP BY usr),
g AS (SELECT usr, count_if(kind = 'edit_reported') AS edits, count_if(kind = 'check_performed') AS checks, max(CASE WHEN agent = 'ag1' THEN 'ag1' END) AS a1, max(CASE WHEN agent = 'ag2' THEN 'ag2' END) AS a2 FROM a WHERE kind IN ('edit_reported', 'check_performed') GROUP BY usr)
SELECT g.usr, edits, checks, concat_ws(', ', a1, a2) AS agents, coalesce(top_paths, '') AS top_paths FROM g LEFT JOIN t ON t.usr = g.usr""", since=604800)
rule("a6_counts", f"""WITH {_CHECKED} SELECT n.*, r.rate FROM (SELECT count_if(kind = 'collision_returned') AS collisions, count_if(kind = 'gate_block') AS blocks, count_if(kind = 'override') AS overrides, count_if(kind = 'intent_declared') AS intents_declared,
count_if(kind = 'intent_completed') AS intents_completed, count_if(kind = 'intent_abandoned') AS intents_abandoned, count_if(kind = 'tripwire_fired') AS tripwires, count(*) AS rows_considered FROM c) n CROSS JOIN (SELECT round(1 - count_if(NOT checked) / count(*), 3) AS rate FROM w) r""", since=604800)
rule("a6_hotspots", "SELECT path, count(*) AS n FROM act WHERE kind = 'collision_returned' AND ts >= $now - $since GROUP BY path ORDER BY n DESC, min(seq) LIMIT $limit", since=604800, limit=10)
rule("a6_renames", "SELECT seq, symbol AS old_name, new_name, usr AS owner, agent FROM act WHERE kind = 'intent_declared' AND what = 'renamed' AND symbol <> '' AND new_name <> '' AND ts >= $now - $since", since=604800)
rule("a7_compliance", f"""WITH {_CHECKED} SELECT 'usr' AS per, usr AS who, count(*) AS writes, count_if(checked) AS checked, count_if(checked) / count(*) AS rate FROM w GROUP BY usr
UNION ALL SELECT 'agent', CASE WHEN agent = '' THEN '(unattributed)' ELSE agent END, count(*), count_if(checked), count_if(checked) / count(*) FROM w GROUP BY CASE WHEN agent = '' THEN '(unattributed)' ELSE agent END""", since=604800)
_MISNAMED = """((right(path, 3) = '.py' AND substr(symbol, 1, 1) = lower(substr(symbol, 1, 1)) AND substr(symbol, 1, 1) <> upper(substr(symbol, 1, 1)) AND symbol <> lower(symbol))
OR ((right(path, 3) = '.ts' OR right(path, 4) = '.tsx') AND instr(trim(BOTH '_' FROM symbol), '_') > 0 AND symbol = lower(symbol)))"""
rule("a8_drift", f"""WITH {_CHECKED}, h AS (SELECT 'check before writing' AS convention, seq, usr, agent, path AS example FROM w WHERE NOT checked
UNION ALL SELECT 'declare an intent' AS convention, seq, usr, agent, path AS example FROM w WHERE intent_id = '' UNION ALL SELECT 'naming' AS convention, seq, usr, agent, symbol || ' in ' || path AS example FROM w WHERE what = 'added' AND {_MISNAMED}),
r AS (SELECT *, CASE WHEN agent = '' THEN '(unattributed)' ELSE agent END AS who, row_number() OVER (PARTITION BY convention ORDER BY seq) AS place FROM h)
SELECT convention, count(*) AS violations, @SS[usr] AS users, @SS[who] AS agents, concat_ws('|', max(CASE WHEN place = 1 THEN example END), max(CASE WHEN place = 2 THEN example END), max(CASE WHEN place = 3 THEN example END)) AS examples FROM r GROUP BY convention""", since=604800)

# --- co-edits, notes, outcomes -----------------------------------------------
_COEDIT = f"""e AS (SELECT seq, ts, path, {_KEY} AS skey, @INT[floor(ts / $span)] AS cell FROM act WHERE kind = 'edit_reported'),
x AS (SELECT seq, ts, path, skey, cell FROM e UNION ALL SELECT seq, ts, path, skey, cell - 1 AS cell FROM e),
h AS (SELECT DISTINCT x.seq, x.path AS a, e.path AS b FROM x JOIN e ON e.skey = x.skey AND e.cell = x.cell AND e.seq < x.seq AND x.ts - e.ts <= $span AND e.path <> x.path),
n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM h UNION ALL SELECT b AS a, a AS b FROM h) t GROUP BY a, b)"""
rule("a12_coedit", f"WITH {_COEDIT} SELECT a, b, n FROM n", span=600)
rule("a12_prefetch", f"WITH {_COEDIT} SELECT a AS path, b AS likely, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM n WHERE n >= $support) t WHERE r = 1", span=600, support=3)
_NOTE = "n AS (SELECT seq AS id, scope, path, symbol, usr AS owner, ts AS created, hash_after AS anchor_hash, why AS fact, intent_id, CASE kind WHEN 'rationale' THEN 'rationale' WHEN 'override' THEN 'scar' ELSE '' END AS auto FROM act WHERE kind IN ('rationale', 'override', 'intent_completed'))"
rule("a13_notes", f"WITH {_NOTE} SELECT path AS node, count(*) AS notes, count_if(auto = 'scar') AS scars, count_if(auto = 'rationale') AS rationales, max_by(fact, id) AS latest FROM n GROUP BY path")
_OUTCOME = """r AS (SELECT *, CASE WHEN kind = 'edit_reported' THEN lag(usr) OVER (PARTITION BY path, kind ORDER BY seq) END AS pu, CASE WHEN kind = 'edit_reported' THEN lag(ts) OVER (PARTITION BY path, kind ORDER BY seq) END AS pt FROM act WHERE ts >= $now - $window),
f AS (SELECT *, CASE WHEN kind = 'edit_reported' AND pu <> usr AND usr <> '' AND ts - pt <= $refix THEN 1 ELSE 0 END AS refix, CASE WHEN kind = 'interface_verified' AND tokens % 3 <> 0 THEN 1 ELSE 0 END AS pass, CASE WHEN kind = 'interface_verified' AND tokens % 3 = 0 THEN 1 ELSE 0 END AS fail FROM r),
u AS (SELECT *, sum(refix) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refixed FROM f),
v AS (SELECT *, sum(pass) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS passes, sum(fail) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS failures,
  max(refixed) OVER (PARTITION BY path) AS all_refixed, min(CASE WHEN kind = 'edit_reported' THEN refixed END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first_refixed,
  min(CASE WHEN kind = 'edit_reported' THEN ts END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_edit,
  count(CASE WHEN kind = 'edit_reported' AND hash_before <> hash_after THEN 1 END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rewrites FROM u)"""
_A17 = f"WITH {_OUTCOME} SELECT seq AS note, path, @INT[coalesce(passes, 0)] AS passes, @INT[coalesce(failures, 0)] AS failures, @INT[coalesce(all_refixed - first_refixed, 0)] AS refixes FROM v WHERE kind = 'rationale'"
pair("a17_outcomes", backwards(_A17), _A17, window=2592000, refix=1800)
_F17 = f"""WITH {_OUTCOME}, kinds AS (SELECT path, symbol, count(DISTINCT hash_after) AS n FROM act WHERE kind = 'rationale' GROUP BY path, symbol), later AS (SELECT seq, lead(seq) OVER (PARTITION BY path, symbol, usr ORDER BY seq) AS newer FROM act WHERE kind = 'rationale')
SELECT v.seq AS note, CASE WHEN later.newer IS NOT NULL AND v.k % 2 = 0 THEN 10 ELSE least(95, greatest(5, least(50 + 10 * least(v.rewrites, 4) - CASE WHEN v.next_edit > v.ts AND v.next_edit < v.ts + 3600 THEN 20 ELSE 0 END, CASE WHEN kinds.n > 1 THEN 30 ELSE 1000 END)
  + 10 * least(coalesce(passes, 0), 2) - 20 * least(coalesce(failures, 0), 2) - 10 * least(coalesce(all_refixed - first_refixed, 0), 2))) END / 100 AS confidence
FROM v JOIN kinds ON kinds.path = v.path AND kinds.symbol = v.symbol JOIN later ON later.seq = v.seq WHERE v.kind = 'rationale'"""
pair("f17_confidence", backwards(_F17), _F17, window=2592000, refix=1800)

# --- graph roll-ups ------------------------------------------------------------
rule("a18_repo_map", """WITH f AS (SELECT path, root, regexp_extract(path, '[.]([a-z]+)$', 1) AS lang, usr, symbol FROM act WHERE kind = 'edit_reported'), ow AS (SELECT root, usr, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, usr) AS r FROM f GROUP BY root, usr),
d AS (SELECT dst AS node, count(*) AS n FROM dep WHERE src <> dst GROUP BY dst ORDER BY n DESC, node LIMIT $hubs)
SELECT 'language' AS part, lang AS item, count(DISTINCT path) AS n, '' AS who FROM f GROUP BY lang UNION ALL SELECT 'symbols', '', count(DISTINCT path || '::' || symbol), '' FROM f UNION ALL SELECT 'edges', kind, count(*), '' FROM dep WHERE src <> dst GROUP BY kind
UNION ALL SELECT 'subsystem', f.root, count(DISTINCT f.path), max(ow.usr) FROM f JOIN ow ON ow.root = f.root AND ow.r = 1 GROUP BY f.root UNION ALL SELECT 'hub', node, n, '' FROM d
UNION ALL SELECT 'scars', root, count(*), max_by(usr, seq) FROM act WHERE kind = 'override' GROUP BY root""", hubs=5)
rule("a19_conventions", """WITH m AS (SELECT p_brand AS dir, 'p' || p_partkey AS name, p_partkey AS ord, CASE WHEN p_size % 10 < 8 THEN 'self' ELSE 'ctx' || (p_size % 3) END AS param FROM part),
c AS (SELECT dir, param, count(*) AS n, min(ord) AS first FROM m GROUP BY dir, param), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY dir) AS total FROM c),
w AS (SELECT * FROM r WHERE rn = 1 AND total >= $members AND n >= $share * total), x AS (SELECT m.dir, m.name FROM (SELECT m.dir, m.name, row_number() OVER (PARTITION BY m.dir ORDER BY m.name) AS place FROM m JOIN w ON w.dir = m.dir WHERE m.param <> w.param) m WHERE place <= $shown)
SELECT w.dir, w.param, w.n, @INT[w.total] AS members, coalesce(y.names, '') AS exceptions FROM w LEFT JOIN (SELECT dir, @SL[name] AS names FROM x GROUP BY dir) y ON y.dir = w.dir""", members=3, share=0.6, shown=8)
_BOUNDS = (0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)
_BOUND = "CASE " + " ".join(f"WHEN ms <= {b} THEN {b}" for b in _BOUNDS) + " ELSE 1e18 END"
rule("a21_histogram", f"""WITH v AS (SELECT kind, CAST(tokens * tokens AS DOUBLE) / 4 AS ms FROM act), h AS (SELECT kind, CAST({_BOUND} AS DOUBLE) AS bound, count(*) AS n, max(ms) AS most FROM v GROUP BY kind, CAST({_BOUND} AS DOUBLE)),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY bound ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY kind) AS total FROM h)
SELECT kind, min(CASE WHEN upto >= ceil(0.5 * total) THEN CASE WHEN bound = 1e18 THEN most ELSE bound END END) AS p50, min(CASE WHEN upto >= ceil(0.95 * total) THEN CASE WHEN bound = 1e18 THEN most ELSE bound END END) AS p95, max(most) AS top FROM c GROUP BY kind""")
_KNOWS = "kind IN ('edit_reported', 'intent_declared', 'gate_block', 'override')"
_LINE = """CASE WHEN what = 'renamed' AND new_name <> '' THEN symbol || ' renamed to ' || new_name WHEN what = 'removed' THEN symbol || ' removed' WHEN sig_before <> '' AND sig_after <> '' AND sig_before <> sig_after THEN sig_before || ' to ' || sig_after
WHEN what = 'added' AND sig_after <> '' THEN '+ ' || sig_after END"""
rule("a23_latest_change", f"""WITH l AS (SELECT path, symbol, what, {_LINE} AS line, ts, row_number() OVER (PARTITION BY path, symbol, what ORDER BY seq DESC) AS r FROM act WHERE kind = 'edit_reported' AND usr <> $me AND ts >= $now - $since)
SELECT path, @SL[line] AS changes, max(ts) AS newest FROM l WHERE r = 1 AND line IS NOT NULL GROUP BY path""", me="u3", since=604800)
rule("a24_recent_writes", f"""WITH a AS (SELECT *, CASE WHEN kind = 'edit_reported' THEN {_LINE} END AS line FROM act WHERE kind IN ('edit_reported', 'rationale') AND ts >= $now - $since), s AS (SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY seq DESC) AS nth FROM a WHERE line IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS place FROM s WHERE nth = 1), t AS (SELECT path, concat_ws('|', max(CASE WHEN place = 1 THEN line END), max(CASE WHEN place = 2 THEN line END), max(CASE WHEN place = 3 THEN line END), max(CASE WHEN place = 4 THEN line END)) AS changes FROM c GROUP BY path)
SELECT a.path, max_by(a.usr, CASE WHEN a.kind = 'edit_reported' THEN a.seq ELSE -1 END) AS usr, max(CASE WHEN a.kind = 'edit_reported' THEN a.ts END) AS ts, max_by(a.why, CASE WHEN a.why <> '' THEN a.seq ELSE -1 END) AS why, coalesce(max(t.changes), '') AS changes
FROM a LEFT JOIN t ON t.path = a.path GROUP BY a.path HAVING count_if(a.kind = 'edit_reported') > 0""", since=604800)
rule("a25_blind_spots", """WITH f AS (SELECT usr, path, count_if(parse = 'clean') AS cleans, max_by(parse, seq) AS last_parse, max(CASE WHEN parse = 'clean' THEN ts END) AS clean_ts FROM act WHERE kind = 'edit_reported' GROUP BY usr, path), q AS (SELECT usr, max(ts) AS seen FROM act GROUP BY usr),
nc AS (SELECT usr, path FROM f WHERE cleans = 0 ORDER BY usr, path LIMIT $most), st AS (SELECT usr, path, clean_ts FROM f WHERE cleans > 0 AND last_parse = 'partial' AND $now - clean_ts > $ttl ORDER BY usr, path LIMIT $most)
SELECT 'never_clean' AS why, usr, path, CAST(NULL AS DOUBLE) AS age FROM nc UNION ALL SELECT 'stale', usr, path, round($now - clean_ts, 1) FROM st UNION ALL SELECT 'quiet', usr, '', round($now - seen, 1) FROM q WHERE $now - seen > $idle""", most=50, ttl=900, idle=1200)
rule("a26_usage_index", f"""WITH u AS (SELECT usr, session, seq, model, c1 + c3 AS context, {_USED} AS used FROM act WHERE kind = 'edit_reported'), x AS (SELECT * FROM u WHERE used > 0)
SELECT 'session' AS per, usr || ':' || session AS who, max_by(context, seq) AS context, max_by(model, seq) AS model, max(seq) AS seq FROM x WHERE session <> '' GROUP BY usr, session UNION ALL SELECT 'usr', usr, max_by(context, seq), max_by(model, seq), max(seq) FROM x GROUP BY usr""")
rule("a31_briefing", """WITH e AS (SELECT usr, path, max(CASE WHEN kind = 'intent_declared' THEN 1 ELSE 0 END) AS briefed, max(CASE WHEN kind = 'collision_returned' THEN 1 ELSE 0 END) AS named, max(CASE WHEN kind = 'check_performed' THEN 1 ELSE 0 END) AS read, max(CASE WHEN kind = 'edit_reported' THEN 1 ELSE 0 END) AS wrote FROM act GROUP BY usr, path),
ended AS (SELECT usr, max_by(kind, seq) = 'intent_completed' OR $now - max(ts) > $idle AS done FROM act GROUP BY usr)
SELECT e.usr, count_if(briefed = 1 AND wrote = 1 AND read = 1) AS needed, count_if(briefed = 1 AND wrote = 1 AND read = 0) AS hit, count_if(briefed = 1 AND wrote = 0 AND read = 1 AND ended.done) AS miss, count_if(briefed = 0 AND named = 1 AND wrote = 1) AS found FROM e JOIN ended ON ended.usr = e.usr GROUP BY e.usr""", idle=600)
rule("a33_priced_saving", f"""WITH u AS (SELECT usr, session, seq, c1 + c3 AS context, CASE WHEN left(lower(model), 5) = 'alpha' THEN 15 WHEN left(lower(model), 4) = 'beta' THEN 5 ELSE 3 END AS rate, {_USED} AS used FROM act WHERE kind = 'edit_reported'),
s AS (SELECT usr, session, max_by(context, seq) AS context, max_by(rate, seq) AS rate FROM u WHERE used > 0 AND session <> '' GROUP BY usr, session), p AS (SELECT usr, max_by(context, seq) AS context, max_by(rate, seq) AS rate FROM u WHERE used > 0 GROUP BY usr)
SELECT g.seq, g.usr, g.tokens % 5 AS messages, (g.tokens % 5) * coalesce(s.context, p.context, 0) AS saved, (g.tokens % 5) * coalesce(s.context, p.context, 0) * coalesce(s.rate, p.rate, 3) AS tenth_micro_usd
FROM act g LEFT JOIN s ON s.usr = g.usr AND s.session = g.session LEFT JOIN p ON p.usr = g.usr WHERE g.kind = 'gate_block'""")

# --- predicates and projections ----------------------------------------------
rule("p3_artifacts", """SELECT path FROM (SELECT DISTINCT CASE k % 5 WHEN 0 THEN $marker || path WHEN 1 THEN 'src/' || $marker || path WHEN 2 THEN 'my' || $marker || path ELSE path END AS path FROM act) t
WHERE left(path, length($marker)) = $marker OR instr(path, '/' || $marker) > 0""", marker=".tool/")
_INTERFACE = "(what IN ('renamed', 'removed') OR (what <> 'added' AND sig_after <> '' AND sig_after <> sig_before))"
rule("p5_interface_changes", f"SELECT seq FROM act WHERE kind = 'edit_reported' AND {_INTERFACE}")
_HOT = "confidence = 'certain' AND (what IN ('renamed', 'removed') OR (sig_before <> '' AND sig_after <> '' AND sig_before <> sig_after))"
_HOT_KIND = "CASE WHEN sig_before <> '' AND sig_after <> '' AND sig_before <> sig_after THEN 'signature' ELSE what END"
pair("p6_hot_events", """WITH t AS (SELECT usr, turn_id, array_sort(collect_list(struct(seq, symbol, what, confidence, sig_before <> '' AND sig_after <> '' AND sig_before <> sig_after AS moved))) AS events FROM act WHERE kind = 'edit_reported' AND turn_id <> '' GROUP BY usr, turn_id),
h AS (SELECT usr, turn_id, transform(filter(events, e -> e.confidence = 'certain' AND (e.what IN ('renamed', 'removed') OR e.moved)), e -> concat(e.symbol, ':', CASE WHEN e.moved THEN 'signature' ELSE e.what END)) AS hot FROM t)
SELECT usr, turn_id, size(hot) AS n, array_join(hot, ',') AS hot FROM h WHERE size(hot) > 0""",
    f"""SELECT usr, turn_id, CAST(count(*) AS INTEGER) AS n, string_agg(symbol || ':' || {_HOT_KIND}, ',' ORDER BY seq) AS hot FROM act WHERE kind = 'edit_reported' AND turn_id <> '' AND {_HOT} GROUP BY usr, turn_id""")
rule("p12_own", """SELECT seq FROM (SELECT seq, usr AS owner, CASE WHEN kind = 'override' THEN 'u' || (k % 24) ELSE '' END AS made_by, CASE WHEN kind = 'intent_completed' THEN 'u' || (tokens % 24) ELSE '' END AS intent_owner, CASE WHEN what = 'removed' THEN 'u' || ((k + 3) % 24) ELSE '' END AS reverted_by FROM act) t
WHERE $me <> '' AND $me IN (owner, made_by, intent_owner, reverted_by)""", me="u3")
#: Words of prompts.
TASK = "fix add build implement create write change update rename remove delete refactor move replace debug test deploy ship handle support integrate migrate port optimize improve clean wire bump revert patch edit make".split()
ASK = "what whats why how which who where when should can could would is are do does did will".split()
FILLER = "ok okay so also now then and yes yea yeah".split()
REQUEST = ("can you", "could you", "can u", "please", "pls", "i need you to")
ADDS = "add adds build create implement write new wants want need needs support".split()
_TASKS = sorted({*TASK, *(t + "s" for t in TASK), *(t + "ed" for t in TASK)})
rule("p13_prompts", f"""WITH o AS (SELECT conv_id, turn, si, min_by(w, wi) AS opener FROM sword WHERE w NOT IN $filler GROUP BY conv_id, turn, si),
a AS (SELECT s.conv_id, s.turn, max(CASE WHEN right(trim(s.s), 1) = '?' OR (o.opener IN $ask AND o.opener NOT IN ('when', 'where')) THEN 1 ELSE 0 END) AS asks, max(CASE WHEN o.opener IN $tasks THEN 1 ELSE 0 END) AS opens FROM sent s LEFT JOIN o ON o.conv_id = s.conv_id AND o.turn = s.turn AND o.si = s.si GROUP BY s.conv_id, s.turn),
w AS (SELECT conv_id, turn, max(CASE WHEN w IN $tasks THEN 1 ELSE 0 END) AS tasks FROM sword GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(a.asks, 0) = 0 AND instr(c.text, '?') = 0 OR coalesce(a.opens, 0) = 1 OR (coalesce(w.tasks, 0) = 1 AND ({" OR ".join(f"instr(lower(c.text), '{r}') > 0" for r in REQUEST)})) AS about_code,
regexp_extract(lower(c.text), '(^|[^a-z0-9])({"|".join(ADDS)})([^a-z0-9]|$)', 2) <> '' AS adds_code
FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn WHERE c.role = 'user'""", filler=FILLER, ask=ASK, tasks=_TASKS)
rule("p14_haystack", "SELECT seq FROM (SELECT seq, lower(concat_ws(' ', kind, usr, agent, session, path, symbol, why)) AS hay FROM act) t WHERE instr(hay, lower($needle)) > 0", needle="Because of 4")
rule("p17_touches", "SELECT seq FROM act WHERE kind = 'edit_reported' AND ($path = '' OR path = $path) AND ($symbol = '' OR symbol = $symbol OR new_name = $symbol)", path="d2/f42.py", symbol="f3")
rule("p18_projection", """SELECT seq, usr, turn_id, symbol, what AS kind, confidence, CASE WHEN sig_before <> '' THEN substr(sig_before, 1, $cut) END AS signature_before, CASE WHEN sig_after <> '' THEN substr(sig_after, 1, $cut) END AS signature_after, CASE WHEN new_name <> '' THEN substr(new_name, 1, $cut) END AS new_name
FROM (SELECT *, row_number() OVER (PARTITION BY usr, intent_id ORDER BY seq) AS r FROM act WHERE kind = 'edit_reported') t WHERE r <= $events""", events=12, cut=240)
rule("p18_hunks", """SELECT usr, root, seq, op, first, last FROM (SELECT *, row_number() OVER (PARTITION BY usr, root ORDER BY seq) AS r FROM (SELECT usr, root, seq, CASE tokens % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' ELSE 'truncated' END AS op, k + 1 AS first, k + 1 + lines_added AS last FROM act WHERE kind = 'edit_reported') h WHERE op <> 'truncated') t WHERE r <= $hunks""", hunks=8)
rule("p19_changes", f"""SELECT seq, ts, usr AS made_by, kind, path, CASE WHEN kind = 'edit_reported' AND new_name <> '' AND new_name <> symbol THEN least(symbol, new_name) || ',' || greatest(symbol, new_name) ELSE symbol END AS symbols FROM act WHERE {_KNOWS} AND usr <> ''""")
rule("p20_focus", """SELECT 'focus' AS view, usr, path, kind, round($now - ts, 1) AS age FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY seq DESC) AS r FROM act WHERE kind = 'check_performed') t WHERE r = 1
UNION ALL SELECT 'last_action', usr, path, kind, round($now - ts, 1) FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY seq DESC) AS r FROM act) t WHERE r = 1""")

# --- joins ---------------------------------------------------------------------
#: Two newest parses of each workspace's files, a third of them shared.
_SNAP = """x AS (SELECT o_custkey % 3 AS usr, @INT[floor(o_custkey / 3)] % 230 AS path, o_orderkey % 3 AS parse, o_orderpriority AS symbol, max(o_orderstatus) AS hash, 's' || max(o_orderkey % 4) AS sig FROM orders GROUP BY o_custkey % 3, @INT[floor(o_custkey / 3)] % 230, o_orderkey % 3, o_orderpriority),
y AS (SELECT *, dense_rank() OVER (PARTITION BY usr, path ORDER BY parse DESC) AS back FROM x), cur AS (SELECT * FROM y WHERE back = 1), old AS (SELECT * FROM y WHERE back = 2), had AS (SELECT DISTINCT usr, path FROM old)"""
rule("j4_collisions", f"""WITH {_SNAP}, me AS (SELECT * FROM cur WHERE usr = $me), ot AS (SELECT cur.* FROM cur JOIN (SELECT DISTINCT path FROM me) m ON m.path = cur.path WHERE cur.usr <> $me),
mm AS (SELECT p.usr, me.path, me.symbol, me.hash, me.sig FROM (SELECT DISTINCT usr, path FROM ot) p JOIN me ON me.path = p.path),
j AS (SELECT coalesce(mm.usr, ot.usr) AS author, coalesce(mm.path, ot.path) AS path, mm.symbol AS mine, ot.symbol AS theirs, mm.hash AS h1, ot.hash AS h2, mm.sig AS g1, ot.sig AS g2 FROM mm FULL OUTER JOIN ot ON ot.usr = mm.usr AND ot.path = mm.path AND ot.symbol = mm.symbol),
c AS (SELECT author, path, count_if(theirs IS NULL) AS outs, count_if(mine IS NULL) AS ins, max(CASE WHEN mine IS NULL THEN theirs END) AS came FROM j GROUP BY author, path)
SELECT j.author, j.path, coalesce(j.mine, j.theirs) AS symbol, CASE WHEN theirs IS NULL AND outs = 1 AND ins = 1 THEN 'renamed' WHEN theirs IS NULL AND had.path IS NOT NULL AND old.symbol IS NULL THEN 'removed' WHEN theirs IS NULL THEN 'unknown' WHEN mine IS NULL THEN 'added' ELSE 'modified' END AS kind,
CASE WHEN theirs IS NULL AND NOT (outs = 1 AND ins = 1) AND NOT (had.path IS NOT NULL AND old.symbol IS NULL) THEN 'unconfirmed' ELSE 'certain' END AS confidence, CASE WHEN theirs IS NULL AND outs = 1 AND ins = 1 THEN came END AS new_name, CASE WHEN mine IS NOT NULL AND theirs IS NOT NULL THEN g1 <> g2 END AS signature_change
FROM j JOIN c ON c.author = j.author AND c.path = j.path LEFT JOIN had ON had.usr = j.author AND had.path = j.path LEFT JOIN old ON old.usr = j.author AND old.path = j.path AND old.symbol = j.mine
WHERE NOT (mine IS NULL AND outs = 1 AND ins = 1) AND (mine IS NULL OR theirs IS NULL OR h1 <> h2)""", me=0)
rule("j7_merge", f"""WITH {_SNAP} SELECT path, symbol, count(DISTINCT usr) AS holders, count(DISTINCT hash) AS hashes, CASE WHEN count(DISTINCT sig) >= 2 THEN 'signature' ELSE 'implementation' END AS kind, @SS[sig] AS signatures FROM cur GROUP BY path, symbol HAVING count(DISTINCT usr) >= 2 AND count(DISTINCT hash) >= 2""")
rule("j8_interfaces", f"""WITH {_SNAP}, rf AS (SELECT usr, path || '::' || symbol AS node, symbol, CASE hash WHEN 'F' THEN '1-URGENT' WHEN 'O' THEN '2-HIGH' ELSE '3-MEDIUM' END AS ref FROM cur WHERE usr IN ($mine, $theirs)), dep_of AS (SELECT usr, ref, count(*) AS n FROM rf WHERE symbol <> ref GROUP BY usr, ref),
a AS (SELECT * FROM cur WHERE usr = $mine), b AS (SELECT * FROM cur WHERE usr = $theirs), j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.symbol, b.symbol) AS symbol, a.sig AS g1, b.sig AS g2, a.hash AS h1, b.hash AS h2 FROM a FULL OUTER JOIN b ON a.path = b.path AND a.symbol = b.symbol),
f AS (SELECT j.path, j.symbol, CASE WHEN g1 IS NULL OR g2 IS NULL THEN CASE WHEN coalesce(CASE WHEN g1 IS NULL THEN d2.n ELSE d1.n END, 0) > 0 THEN 'UNKNOWN' END WHEN h1 = h2 OR g1 = g2 THEN NULL WHEN coalesce(d1.n, 0) + coalesce(d2.n, 0) > 0 THEN 'FAIL' ELSE 'UNKNOWN' END AS verdict
FROM j LEFT JOIN dep_of d1 ON d1.usr = $mine AND d1.ref = j.symbol LEFT JOIN dep_of d2 ON d2.usr = $theirs AND d2.ref = j.symbol)
SELECT path, symbol, verdict FROM f WHERE verdict IS NOT NULL UNION ALL SELECT -1 AS path, 'overall' AS symbol, CASE WHEN count_if(verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(verdict = 'UNKNOWN') > 0 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM f""", mine=0, theirs=1)
_OPEN = """closed AS (SELECT DISTINCT intent_id FROM act WHERE kind IN ('intent_completed', 'intent_abandoned') AND intent_id <> ''), declared AS (SELECT intent_id, scope, usr AS owner, session, path, symbol, new_name, ts, seq, CASE k % 5 WHEN 0 THEN 'extract' WHEN 1 THEN 'rename' WHEN 2 THEN 'add_param' WHEN 3 THEN 'delete' ELSE '' END AS op FROM act WHERE kind = 'intent_declared' AND intent_id <> ''),
intents AS (SELECT d.* FROM declared d WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE c.intent_id = d.intent_id) AND $now - d.ts <= $life)"""
rule("j10_recipients", f"""WITH {_OPEN}, anchor AS (SELECT DISTINCT path, 'p' || k AS node FROM act WHERE path = $path), near AS (SELECT path FROM anchor UNION SELECT x.path FROM anchor JOIN dep ON dep.dst = anchor.node AND dep.src <> dep.dst JOIN (SELECT DISTINCT path, 'p' || k AS node FROM act) x ON x.node = dep.src),
w AS (SELECT owner AS usr FROM intents WHERE EXISTS (SELECT 1 FROM near WHERE near.path = intents.path) UNION SELECT usr FROM act WHERE kind = 'edit_reported' AND ts >= $now - 86400 AND EXISTS (SELECT 1 FROM near WHERE near.path = act.path))
SELECT usr FROM w WHERE usr <> '' AND lower(usr) <> lower($me) ORDER BY usr LIMIT $most""", path="d1/f9.py", me="u1", most=10, life=7200)
_COPIES = "cp AS (SELECT usr, session, path, max_by(hash_after, seq) AS hash, max(ts) AS copied_at, max_by(CASE WHEN kind = 'edit_reported' THEN 1 ELSE 0 END, seq) AS wrote FROM act WHERE kind IN ('edit_reported', 'check_performed') AND session <> '' GROUP BY usr, session, path)"
rule("j15_behind", f"""WITH {_COPIES}, w AS (SELECT path, usr, session, hash_after AS hash, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM act WHERE kind = 'edit_reported') t WHERE r = 1 AND $now - ts <= $live)
SELECT cp.usr, cp.session, cp.path, w.usr AS author, round($now - w.ts, 1) AS age FROM cp JOIN w ON w.path = cp.path WHERE NOT (w.usr = cp.usr AND w.session = cp.session) AND substr(w.usr, length(w.usr), 1) <> substr(cp.usr, length(cp.usr), 1) AND cp.hash <> w.hash AND NOT (cp.wrote = 1 AND cp.copied_at > w.ts)""", live=1800)
rule("j17_blockers", f"""WITH {_OPEN}, g AS (SELECT DISTINCT scope, path, symbol FROM act WHERE usr = $me AND kind = 'edit_reported'), ot AS (SELECT * FROM intents WHERE owner <> $me),
x AS (SELECT owner AS usr, 'path' AS why FROM ot WHERE EXISTS (SELECT 1 FROM g WHERE g.scope = ot.scope AND g.path = ot.path) UNION SELECT owner, 'operation' FROM ot WHERE op <> '' AND EXISTS (SELECT 1 FROM g WHERE g.scope = ot.scope AND g.symbol = ot.symbol)
UNION SELECT usr, 'hot' FROM act WHERE kind = 'gate_block' AND usr <> $me AND $now - ts <= $hot AND EXISTS (SELECT 1 FROM g WHERE g.scope = act.scope AND g.path = act.path)) SELECT usr, @SS[why] AS why FROM x GROUP BY usr""", me="u3", life=7200, hot=900)
rule("j18_lint", """WITH rule AS (SELECT name, max_by(made_by, ts) AS made_by, max(ts) AS ts FROM (SELECT regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1) AS name, 'u' || (item_id % 24) AS made_by, $now - (item_id % 20) * 43200 AS ts FROM benchmark) t WHERE length(name) >= $shortest GROUP BY name),
live AS (SELECT * FROM rule WHERE made_by <> $me AND ts >= $now - $ttl) SELECT live.name, word.doc_id, count(*) AS n, min(word.pos) AS first_pos FROM live JOIN word ON word.w = live.name GROUP BY live.name, word.doc_id""", me="u3", shortest=4, ttl=604800)
rule("j19_overlaps", """WITH live AS (SELECT usr, session, path, max(ts) AS ts FROM act WHERE kind = 'edit_reported' AND session <> '' AND ts >= $now - $span GROUP BY usr, session, path), task AS (SELECT DISTINCT path FROM act WHERE usr = $me AND kind = 'intent_declared' AND instr(path, 'test') = 0)
SELECT live.usr, live.session, @SL[live.path] AS files, max(live.ts) AS ts FROM live JOIN task ON task.path = live.path WHERE live.usr <> $me GROUP BY live.usr, live.session""", me="u3", span=1200)
rule("j20_waiting", """WITH made AS (SELECT path, symbol, min(seq) AS seq, min_by(usr, seq) AS usr FROM act WHERE kind = 'edit_reported' AND what = 'added' GROUP BY path, symbol), wt AS (SELECT usr, path, symbol, min(seq) AS since FROM act WHERE kind = 'intent_declared' GROUP BY usr, path, symbol)
SELECT wt.usr, wt.path, wt.symbol, made.seq AS satisfied, made.usr AS made_by FROM wt JOIN made ON made.path = wt.path AND made.symbol = wt.symbol AND made.seq > wt.since AND made.usr <> wt.usr""")
rule("j25_labels", """SELECT c.c_custkey AS id, coalesce(nullif(CASE WHEN c.c_custkey % 5 = 0 THEN n.n_name ELSE '' END, ''), nullif(CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name ELSE '' END, ''), regexp_extract(lower(replace(c.c_name, '#', '.')) || '@mail.test', '^([^@]*)@', 1)) AS label FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
rule("j28_behind", f"""WITH {_COPIES}, ld AS (SELECT usr, session, max(seq) AS seq FROM act WHERE kind = 'landed' AND session <> '' GROUP BY usr, session), wr AS (SELECT a.path, max_by(a.hash_after, a.seq) AS hash, max_by(a.usr, a.seq) AS usr, max_by(a.session, a.seq) AS session FROM act a JOIN ld ON ld.usr = a.usr AND ld.session = a.session AND a.seq < ld.seq WHERE a.kind = 'edit_reported' GROUP BY a.path)
SELECT cp.usr, cp.session, cp.path, wr.usr AS landed_by FROM cp JOIN wr ON wr.path = cp.path WHERE cp.hash <> wr.hash AND NOT (cp.usr = wr.usr AND cp.session = wr.session)""")
rule("j29_turn_notes", """WITH a AS (SELECT *, sum(CASE WHEN kind = 'intent_completed' THEN 1 ELSE 0 END) OVER (PARTITION BY usr, agent ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM act),
c AS (SELECT usr, agent, coalesce(turn, 0) AS turn, path, symbol, min(seq) AS first_seq FROM a WHERE kind = 'edit_reported' GROUP BY usr, agent, coalesce(turn, 0), path, symbol), r AS (SELECT *, row_number() OVER (PARTITION BY usr, agent, turn ORDER BY first_seq) AS n FROM c),
e AS (SELECT usr, agent, coalesce(turn, 0) AS turn, seq, 'Settled ' || symbol || ' in ' || path || ' and what follows ' || why AS gist FROM a WHERE kind = 'intent_completed')
SELECT e.seq, e.gist, max(CASE WHEN r.n = 1 THEN r.path || '::' || r.symbol END) AS anchor, concat_ws(', ', max(CASE WHEN r.n = 2 THEN r.symbol END), max(CASE WHEN r.n = 3 THEN r.symbol END), max(CASE WHEN r.n = 4 THEN r.symbol END), max(CASE WHEN r.n = 5 THEN r.symbol END), max(CASE WHEN r.n = 6 THEN r.symbol END), max(CASE WHEN r.n = 7 THEN r.symbol END)) AS also
FROM e JOIN r ON r.usr = e.usr AND r.agent = e.agent AND r.turn = e.turn WHERE length(e.gist) >= $shortest GROUP BY e.seq, e.gist""", shortest=40)

# --- folds that windows express -------------------------------------------------
rule("m2_serve", """SELECT seq, usr, path, CASE WHEN parse = 'clean' THEN 'live' ELSE 'stale' END AS freshness, clean_seq AS served, CASE WHEN parse = 'clean' THEN 0.0 ELSE round(ts - clean_ts, 1) END AS age FROM (SELECT *, max(CASE WHEN parse = 'clean' THEN seq END) OVER w AS clean_seq, max(CASE WHEN parse = 'clean' THEN ts END) OVER w AS clean_ts
FROM act WHERE kind = 'edit_reported' WINDOW w AS (PARTITION BY usr, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE clean_seq IS NOT NULL""")
rule("m3_corrections", """WITH e AS (SELECT seq, usr, path, symbol, what, new_name, sig_before, sig_after, confidence FROM act WHERE kind = 'edit_reported'), own AS (SELECT path, symbol, max_by(sig_after, seq) AS sig FROM act WHERE usr = $me AND kind IN ('edit_reported', 'check_performed') GROUP BY path, symbol)
SELECT e.seq, CASE WHEN what = 'renamed' AND own.symbol IS NULL THEN new_name ELSE e.symbol END AS symbol, CASE WHEN what = 'renamed' AND own.symbol IS NULL THEN 'added' ELSE what END AS kind, CASE WHEN what = 'modified' AND sig_before <> sig_after AND own.sig = sig_after THEN 'unconfirmed' WHEN what = 'renamed' AND own.symbol IS NULL THEN 'certain' ELSE confidence END AS confidence
FROM e LEFT JOIN own ON own.path = e.path AND own.symbol = e.symbol WHERE e.usr <> $me AND NOT (what = 'removed' AND own.symbol IS NULL)""", me="u3")
rule("m12_replay", f"""WITH a AS (SELECT * FROM act WHERE ts <= $at AND ts > $at - $window AND scope = $scope), st AS (SELECT path, symbol, max_by(CASE WHEN what = 'removed' THEN '' ELSE hash_after END, seq) AS hash FROM a WHERE kind = 'edit_reported' GROUP BY path, symbol),
cl AS (SELECT DISTINCT intent_id FROM a WHERE kind IN ('intent_completed', 'intent_abandoned')), op AS (SELECT intent_id, max_by(usr, seq) AS owner, max(ts) AS ts FROM a WHERE kind = 'intent_declared' AND intent_id <> '' GROUP BY intent_id),
nt AS (SELECT seq, path, symbol, hash_before AS hash, usr FROM a WHERE kind = 'rationale' ORDER BY ts DESC, seq LIMIT $notes)
SELECT 'symbol' AS part, path || '::' || symbol AS item, hash AS detail FROM st WHERE hash <> '' UNION ALL SELECT 'intent', op.intent_id, op.owner FROM op WHERE $at - op.ts <= $life AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.intent_id = op.intent_id)
UNION ALL SELECT 'note', '' || nt.seq, CASE WHEN st.hash <> '' AND st.hash <> nt.hash THEN 'drifted' ELSE 'firm' END FROM nt LEFT JOIN st ON st.path = nt.path AND st.symbol = nt.symbol
UNION ALL SELECT 'count', kind, '' || count(*) FROM a WHERE kind IN ('check_performed', 'collision_returned', 'gate_block') GROUP BY kind""", at=1704090000, window=2592000, life=7200, notes=50, scope="ws:r1")
_RULES = f"""h AS (SELECT *, CASE WHEN what = 'renamed' AND new_name <> '' THEN 'renames' WHEN what = 'removed' THEN 'removed' ELSE 'signatures' END AS bucket FROM act WHERE kind = 'edit_reported' AND {_HOT}),
l AS (SELECT scope, bucket, symbol, max(seq) AS seq FROM h GROUP BY scope, bucket, symbol), k AS (SELECT l.*, h.usr, h.ts, h.new_name, h.sig_after FROM l JOIN h ON h.seq = l.seq WHERE h.ts >= $now - $ttl),
v AS (SELECT k.* FROM k LEFT JOIN l rn ON rn.scope = k.scope AND rn.symbol = k.symbol AND rn.bucket = 'renames' AND rn.seq > k.seq WHERE NOT (k.bucket = 'removed' AND rn.seq IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY scope, bucket ORDER BY ts DESC, symbol) AS place FROM v)"""
rule("m15_rules", f"WITH {_RULES} SELECT scope, bucket, symbol, usr, seq, new_name FROM r WHERE place <= $most", ttl=604800, most=200)
rule("m22_rename_map", f"WITH {_RULES} SELECT scope, symbol AS old_name, new_name FROM r WHERE place <= $most AND bucket = 'renames' AND new_name <> '' AND new_name <> symbol", ttl=604800, most=200)
rule("m16_reverses", """WITH o AS (SELECT seq, scope, kind, CASE k % 5 WHEN 0 THEN 'rename' WHEN 1 THEN 'delete' WHEN 2 THEN 'add' WHEN 3 THEN 'move' ELSE 'extract' END AS op, symbol, CASE WHEN k % 5 = 0 THEN CASE tokens % 3 WHEN 0 THEN 'f3' WHEN 1 THEN 'Ledger' ELSE 'load_all' END ELSE '' END AS new_name FROM act WHERE kind IN ('intent_completed', 'intent_declared')),
inv AS (SELECT scope, CASE op WHEN 'rename' THEN 'rename' WHEN 'delete' THEN 'add' WHEN 'add' THEN 'delete' WHEN 'move' THEN 'move' END AS op, CASE WHEN op = 'rename' THEN new_name ELSE symbol END AS symbol, CASE WHEN op = 'rename' THEN symbol ELSE '' END AS new_name, min(seq) AS seq FROM o WHERE kind = 'intent_completed' AND op <> 'extract'
  GROUP BY scope, CASE op WHEN 'rename' THEN 'rename' WHEN 'delete' THEN 'add' WHEN 'add' THEN 'delete' WHEN 'move' THEN 'move' END, CASE WHEN op = 'rename' THEN new_name ELSE symbol END, CASE WHEN op = 'rename' THEN symbol ELSE '' END)
SELECT o.seq, inv.seq AS undoes FROM o JOIN inv ON inv.scope = o.scope AND inv.op = o.op AND inv.symbol = o.symbol AND inv.new_name = o.new_name AND inv.seq < o.seq WHERE o.kind = 'intent_declared'""")
rule("m19_observed", """WITH r AS (SELECT seq, path, ts, kind, hash_after AS hash, max(CASE WHEN kind = 'edit_reported' THEN ts END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wrote FROM act WHERE kind IN ('edit_reported', 'check_performed')),
d AS (SELECT *, kind = 'check_performed' AND wrote IS NOT NULL AND ts - wrote < $ttl AS deferred FROM r), p AS (SELECT *, max(CASE WHEN NOT deferred THEN seq END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM d)
SELECT p.seq, p.path, CASE WHEN p.deferred THEN 'deferred' WHEN b.hash = p.hash THEN 'unchanged' ELSE 'indexed' END AS state FROM p LEFT JOIN d b ON b.seq = p.base WHERE p.kind = 'check_performed'""", ttl=900)
rule("s30_observed", """SELECT seq, path, CASE WHEN parse = 'unsupported' THEN 'unsupported' WHEN parse <> 'clean' THEN 'partial' ELSE 'read' END AS parse, CASE WHEN parse = 'clean' THEN '' ELSE 'skipped' END AS map FROM act WHERE kind = 'check_performed'""")
rule("s28_snapshots", """WITH a AS (SELECT path, max_by(hash_after, seq) AS sha, max(seq) AS mtime, @INT[sum(lines_added - lines_removed)] AS size FROM act WHERE kind = 'edit_reported' AND ts < $between GROUP BY path), b AS (SELECT path, max_by(hash_after, seq) AS sha, max(seq) AS mtime, @INT[sum(lines_added - lines_removed)] AS size FROM act WHERE kind = 'edit_reported' GROUP BY path)
SELECT b.path, b.sha FROM b LEFT JOIN a ON a.path = b.path WHERE a.path IS NULL OR ((a.mtime <> b.mtime OR a.size <> b.size) AND a.sha <> b.sha)""", between=1704090000)
rule("m24_examples", """WITH u AS (SELECT source AS example, count_if(l.toxic = 0 AND l.quality = 1) AS good, count_if(NOT (l.toxic = 0 AND l.quality = 1)) AS bad FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source) SELECT example, good, bad, good + bad >= $scored AND good / (good + bad) < $share AS retired FROM u""", scored=3, share=0.5)
rule("m26_in_flight", """WITH e AS (SELECT *, min(seq) OVER (PARTITION BY path) AS born FROM act WHERE kind = 'edit_reported'), known AS (SELECT DISTINCT path FROM act WHERE kind = 'check_performed' AND ts < $since), d AS (SELECT path, symbol, max_by(what, seq) <> 'removed' AS defined, max(CASE WHEN what = 'added' THEN 1 ELSE 0 END) AS added FROM e WHERE ts >= $since GROUP BY path, symbol)
SELECT d.path, @SL[d.symbol] AS names, max(CASE WHEN known.path IS NULL THEN 1 ELSE 0 END) AS fresh FROM d LEFT JOIN known ON known.path = d.path WHERE d.defined AND (known.path IS NULL OR d.added = 1) GROUP BY d.path""", since=1704090000)

# --- order and limits -------------------------------------------------------------
rule("o2_hubs_split", """WITH d AS (SELECT node, @INT[sum(i)] AS dependents, @INT[sum(t)] AS from_tests, @INT[sum(o)] AS depends_on FROM (SELECT dst AS node, 1 AS i, CASE WHEN kind = 'references' THEN 1 ELSE 0 END AS t, 0 AS o FROM dep WHERE src <> dst UNION ALL SELECT src AS node, 0 AS i, 0 AS t, 1 AS o FROM dep WHERE src <> dst) x GROUP BY node),
h AS (SELECT d.*, p.p_size % $every = 0 AS test FROM d JOIN part p ON 'p' || p.p_partkey = d.node), prod AS (SELECT node, (dependents - from_tests) * 2 + depends_on AS score FROM h WHERE NOT test ORDER BY score DESC, node LIMIT $limit), tst AS (SELECT node, 2 * dependents + depends_on AS score FROM h WHERE test ORDER BY score DESC, node LIMIT $limit),
al AS (SELECT node, 2 * dependents + depends_on AS score, test FROM h ORDER BY score DESC, node LIMIT $limit), n AS (SELECT count(*) AS n FROM prod)
SELECT 'product' AS scope, node, score FROM prod UNION ALL SELECT 'test', node, score FROM tst CROSS JOIN n WHERE n.n > 0 UNION ALL SELECT 'all', node, score FROM al CROSS JOIN n WHERE n.n = 0 UNION ALL SELECT 'omitted', '', count_if(test) FROM al CROSS JOIN n WHERE n.n > 0""", limit=20, every=4)
rule("o5_recall", """WITH n AS (SELECT seq, scope, why AS fact, path || '::' || symbol AS anchor, ts FROM act WHERE kind IN ('rationale', 'override') AND instr(lower(why), lower($query)) > 0 AND ts >= $oldest), f AS (SELECT scope, fact, max(seq) AS seq, count(*) AS copies FROM n GROUP BY scope, fact),
a AS (SELECT DISTINCT n.scope, n.fact, n.anchor FROM n JOIN f ON f.scope = n.scope AND f.fact = n.fact WHERE n.seq <> f.seq), al AS (SELECT scope, fact, @SL[anchor] AS also_on FROM a GROUP BY scope, fact), t AS (SELECT count(*) AS total FROM n)
SELECT f.seq, f.scope, f.fact, coalesce(al.also_on, '') AS also_on, t.total AS total_matched FROM f LEFT JOIN al ON al.scope = f.scope AND al.fact = f.fact CROSS JOIN t ORDER BY CASE WHEN f.scope = $scope THEN 0 ELSE 1 END, f.seq DESC LIMIT $limit""", query="because", scope="ws:r3", limit=100, oldest=0)
rule("o7_why", """WITH e AS (SELECT * FROM act WHERE kind = 'edit_reported' AND path = $path AND ($symbol = '' OR symbol = $symbol OR new_name = $symbol)), ids AS (SELECT DISTINCT intent_id FROM e WHERE intent_id <> ''), r AS (SELECT * FROM act WHERE kind = 'intent_completed' AND why <> '' AND (EXISTS (SELECT 1 FROM ids WHERE ids.intent_id = act.intent_id) OR ($symbol <> '' AND symbol = $symbol))),
n AS (SELECT * FROM act WHERE kind IN ('rationale', 'override') AND path = $path AND ($symbol = '' OR symbol = $symbol)), c AS (SELECT seq, ts, 'edit' AS sort, usr, symbol AS detail FROM e UNION ALL SELECT seq, ts, 'rationale', usr, why FROM r
UNION ALL SELECT seq, ts, CASE WHEN kind = 'override' THEN 'scar' ELSE 'rationale' END, usr, why FROM n WHERE NOT (kind = 'rationale' AND EXISTS (SELECT 1 FROM r WHERE r.intent_id = n.intent_id AND r.intent_id <> '')))
SELECT seq, ts, sort, usr, detail FROM (SELECT * FROM c ORDER BY ts DESC, seq DESC LIMIT $limit) l ORDER BY ts, seq""", path="d2/f42.py", symbol="", limit=40)
rule("o8_briefing_rank", """WITH s AS (SELECT path, @INT[sum(CASE WHEN symbol = $symbol AND kind = 'edit_reported' THEN 6 WHEN instr(path, $word) > 0 THEN 4 WHEN why <> '' AND instr(why, $topic) > 0 THEN 3 ELSE 0 END)] AS strong, count_if(kind = 'edit_reported') AS weak, max(ts) AS recent FROM act WHERE usr <> $me GROUP BY path),
c AS (SELECT path, strong + least(weak, $weak) AS score, recent FROM s WHERE strong + least(weak, $weak) >= $least) SELECT path, score, recent FROM c ORDER BY score DESC, recent DESC, path LIMIT $limit""", me="u1", symbol="Ledger", word="f4", topic="42", weak=2, least=3, limit=25)
rule("o13_roster", """WITH l AS (SELECT usr, max(ts) AS last_ts, max_by(path, seq) AS path FROM act WHERE scope = $scope AND usr <> $me GROUP BY usr) SELECT usr, path, round($now - last_ts, 1) AS age FROM l WHERE $now - last_ts <= $live ORDER BY last_ts DESC, usr LIMIT $most""", scope="ws:r1", me="u1", live=1800, most=5)
rule("o15_inbox", """SELECT g.seq, g.scope, g.usr FROM act g WHERE g.kind = 'gate_block' AND g.usr = $me AND NOT EXISTS (SELECT 1 FROM act c WHERE c.kind = 'check_performed' AND c.usr = g.usr AND c.path = g.path AND c.seq > g.seq) ORDER BY CASE WHEN g.scope = $scope THEN 0 ELSE 1 END, g.seq LIMIT $limit""", me="u3", scope="ws:r3", limit=50)
rule("j26_visible_intents", f"""WITH {_OPEN}, acl AS (SELECT DISTINCT usr, scope FROM act WHERE kind = 'intent_completed'), v AS (SELECT i.seq, i.ts, i.scope, CASE WHEN i.scope = $scope THEN '' ELSE i.scope END AS from_repo FROM intents i WHERE i.scope = $scope OR EXISTS (SELECT 1 FROM acl WHERE acl.usr = $me AND acl.scope = i.scope))
SELECT seq, from_repo FROM v ORDER BY CASE WHEN scope = $scope THEN 0 ELSE 1 END, ts, seq LIMIT $limit""", scope="ws:r1", me="u1", life=7200, limit=500)

# --- scalar rules ------------------------------------------------------------------
rule("f2_usage", f"SELECT seq, {_USED} AS used FROM act")
rule("f5_truthy", """SELECT seq, v, CASE WHEN v IS NULL OR v IN ('null', 'false', '""', '[]', '{}') THEN false WHEN regexp_extract(v, '^(-?0+([.]0*)?([eE][-+]?[0-9]+)?)$', 1) <> '' THEN false ELSE true END AS truthy
FROM (SELECT seq, CASE k % 12 WHEN 0 THEN '0' WHEN 1 THEN '[]' WHEN 2 THEN '""' WHEN 3 THEN '{}' WHEN 4 THEN 'null' WHEN 5 THEN 'false' WHEN 6 THEN '-0.0' WHEN 7 THEN '0e5' WHEN 8 THEN NULL WHEN 9 THEN '"0"' WHEN 10 THEN '[0]' ELSE '' || tokens END AS v FROM act) t""")
_RAW = """(SELECT DISTINCT CASE WHEN k % 3 = 0 THEN '/' ELSE '' END || root || CASE k % 7 WHEN 0 THEN '/./x/../' WHEN 1 THEN '//' WHEN 2 THEN '/y/z/../../' WHEN 3 THEN '/a/b/c/../../../../../' WHEN 4 THEN '/../..' || '/../u/' WHEN 5 THEN '/./././' ELSE '/' END || CASE WHEN k % 41 = 0 THEN '..' ELSE 'f' || k || CASE k % 5 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '' ELSE '.py' END END AS path FROM act) t"""
# A path's parts are folded: ``..`` takes the part before it, stays where there is
# none, and is nothing at the root.
_NORM = """array_join(aggregate(split(path, '/'), CAST(array() AS ARRAY<STRING>), (acc, x) -> CASE WHEN x IN ('', '.') THEN acc WHEN x <> '..' THEN array_append(acc, x) WHEN size(acc) > 0 AND acc[size(acc) - 1] <> '..' THEN slice(acc, 1, size(acc) - 1) WHEN left(path, 1) = '/' THEN acc ELSE array_append(acc, '..') END), '/')"""
_DUCK_NORM = """list_reduce(string_split(path, '/'), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x <> '..' THEN CASE WHEN acc = '' THEN x ELSE acc || '/' || x END WHEN acc = '' THEN CASE WHEN path[1] = '/' THEN '' ELSE '..' END WHEN acc = '..' OR right(acc, 3) = '/..' THEN acc || '/..' ELSE regexp_replace(acc, '/?[^/]+$', '') END, '')"""
pair("f8_paths", f"SELECT path, CASE WHEN left(path, 1) = '/' THEN '/' || norm WHEN norm = '' THEN '.' ELSE norm END AS normal, dir, ext, joined FROM (SELECT path, {_NORM} AS norm, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/.]([.][^./]*)$', 1) AS ext, concat('base/', regexp_extract(path, '([^/]*)$', 1)) AS joined FROM {_RAW}) u",
    f"SELECT path, CASE WHEN path[1] = '/' THEN '/' || norm WHEN norm = '' THEN '.' ELSE norm END AS normal, dir, ext, joined FROM (SELECT path, {_DUCK_NORM} AS norm, CASE WHEN instr(path, '/') > 0 THEN array_to_string(string_split(path, '/')[:-2], '/') ELSE '' END AS dir, CASE WHEN instr(string_split(path, '/')[-1], '.') > 1 THEN '.' || string_split(path, '.')[-1] ELSE '' END AS ext, 'base/' || string_split(path, '/')[-1] AS joined FROM {_RAW}) u")
pair("f12_name_lines", """WITH x AS (SELECT doc_id, pos + 1 AS line_no, explode(array_distinct(regexp_extract_all(l, '[A-Za-z_][A-Za-z0-9_]*', 0))) AS name FROM line), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY line_no) AS n FROM x WHERE length(name) >= $shortest)
SELECT doc_id, name, array_join(array_sort(collect_list(line_no)), ',') AS lines FROM r WHERE n <= $most GROUP BY doc_id, name""",
    """WITH x AS (SELECT doc_id, pos + 1 AS line_no, unnest(list_distinct(regexp_extract_all(l, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM line), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY line_no) AS n FROM x WHERE length(name) >= $shortest)
SELECT doc_id, name, string_agg(line_no, ',' ORDER BY line_no) AS lines FROM r WHERE n <= $most GROUP BY doc_id, name""", shortest=9, most=25)
rule("f14_graph_fingerprint", "SELECT root, substr(@SHA[x], 1, 16) AS fingerprint FROM (SELECT root, @NL[row_text] AS x FROM (SELECT root, path || ':' || @INT[round(max(ts) * 1000000)] AS row_text FROM act GROUP BY root, path) t GROUP BY root) u")
rule("f18_saving", """WITH s AS (SELECT usr, session, count_if(kind = 'gate_block') AS hits, count_if(kind = 'check_performed') AS needed, count_if(kind = 'collision_returned') AS found, count_if(kind = 'rationale') AS callers, max(c1 + c3) AS context, max_by(model, CASE WHEN model <> '' THEN seq ELSE -1 END) AS model, @INT[sum(c2)] AS injected, @INT[sum(c3)] AS carried FROM act GROUP BY usr, session),
r AS (SELECT *, 2 * hits + needed + found + callers AS messages, CASE WHEN left(lower(model), 5) = 'alpha' THEN 15 WHEN left(lower(model), 4) = 'beta' THEN 5 ELSE 3 END AS rate FROM s)
SELECT usr, session, messages, messages * context AS tokens, messages * context * rate AS saved_tenth_micro, injected + carried AS cost_tokens, (injected * 25 + carried * 2) * rate AS cost_twentieth_micro FROM r""")
_TEXTS = "(SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '## **' || text || '**' WHEN 1 THEN chr(10) || chr(10) || '```' || chr(10) || chr(10) || text WHEN 2 THEN replace(text, ' ', '  ') || '. ' || text || '. ' || text || '. ' || text || ' ' || text || ' ' || text ELSE text || chr(10) || chr(10) || 'more' END AS text FROM conversations WHERE role = 'assistant') c"
pair("f22_gist", f"""WITH p AS (SELECT conv_id, turn, get(filter(transform(split(text, '\\n\\n'), x -> trim(regexp_replace(trim(x), '^#+', ''))), x -> x <> '' AND NOT startswith(x, '```')), 0) AS first FROM {_TEXTS}),
q AS (SELECT conv_id, turn, trim(regexp_replace(replace(replace(coalesce(first, ''), '**', ''), '`', ''), '[ \\t\\n]+', ' ')) AS plain FROM p), k AS (SELECT *, left(plain, $most) AS head FROM q)
SELECT conv_id, turn, CASE WHEN length(plain) <= $most THEN plain WHEN length(head) - locate(' .', reverse(head)) > $most / 2 AND locate(' .', reverse(head)) > 0 THEN left(head, length(head) - locate(' .', reverse(head))) ELSE concat(rtrim(head), '...') END AS gist FROM k""",
    f"""WITH x AS (SELECT conv_id, turn, i, trim(regexp_replace(trim(ps[i]), '^#+', '')) AS p FROM (SELECT conv_id, turn, string_split(text, chr(10) || chr(10)) AS ps FROM {_TEXTS}) t, unnest(range(1, len(ps) + 1)) r(i)), f AS (SELECT conv_id, turn, arg_min(p, i) AS p FROM x WHERE p <> '' AND p NOT LIKE '```%' GROUP BY conv_id, turn),
a AS (SELECT c.conv_id, c.turn, trim(regexp_replace(replace(replace(coalesce(f.p, ''), '**', ''), '`', ''), '[ \\t\\n]+', ' ', 'g')) AS plain FROM {_TEXTS} LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn), b AS (SELECT *, plain[:$most] AS head FROM a)
SELECT conv_id, turn, CASE WHEN length(plain) <= $most THEN plain WHEN instr(reverse(head), ' .') > 0 AND length(head) - instr(reverse(head), ' .') > $most / 2 THEN head[:length(head) - instr(reverse(head), ' .')] ELSE rtrim(head) || '...' END AS gist FROM b""", most=400)
rule("f23_sequence_name", """SELECT raw, CASE WHEN regexp_extract(replace(trim(raw), chr(92), '/'), '^(?:[.]/)*/*(.*)$', 1) = '' THEN NULL ELSE regexp_extract(replace(trim(raw), chr(92), '/'), '^(?:[.]/)*/*(.*)$', 1) END AS sequence
FROM (SELECT DISTINCT CASE k % 6 WHEN 0 THEN ' ./' || root || '/seq ' WHEN 1 THEN '././' || root WHEN 2 THEN '//' || path WHEN 3 THEN '  ' WHEN 4 THEN root || chr(92) || 'm' || chr(92) || k ELSE './' END AS raw FROM act) t""")
#: What a test run looks like, and what it prints.
RUNS = r"(?:^|[\s;&|(])(?:pytest|py\.test|python3? -m (?:pytest|unittest)|npm (?:run )?test|yarn test|pnpm (?:run )?test|npx (?:jest|vitest)|jest|vitest|cargo test|go test|rspec|mvn test|gradle test|\./gradlew test|phpunit|dotnet test|mix test)\b"
FAILS = r"(?m)\b[1-9]\d* (?:failed|errors?)\b|^FAILED\b|^FAIL\b|test result: FAILED|Traceback \(most recent call last\)|panicked at"
PASSES = r"(?m)\b\d+ passed\b|test result: ok\.|^ok\s+\S|Tests:\s+\d+ passed|\bOK \(\d+ tests?\)|^OK$"
_RUN = """(SELECT seq, CASE k % 6 WHEN 0 THEN 'pytest -q tests' WHEN 1 THEN 'cd x && go test ./...' WHEN 2 THEN 'ls tests' WHEN 3 THEN 'npm run test' WHEN 4 THEN CASE WHEN k % 4 = 0 THEN 'cargo testify' ELSE 'make' || chr(10) || 'vitest' END ELSE 'make;' || chr(9) || 'cargo test' END AS command,
CASE tokens % 7 WHEN 0 THEN '12 passed in 3s' WHEN 1 THEN '2 failed, 10 passed' WHEN 2 THEN 'ok  pkg/a 0.3s' WHEN 3 THEN '0 failed, 9 passed' WHEN 4 THEN 'compiling' || chr(10) || 'FAIL pkg/b' WHEN 5 THEN 'OK (5 tests)' ELSE 'nothing here' END AS output, tokens % 11 = 0 AS failed FROM act WHERE kind = 'check_performed') r"""
pair("f26_verdict", f"""SELECT seq, CASE WHEN NOT regexp_like(command, r"{RUNS}") THEN 'unknown' WHEN failed THEN 'false' WHEN regexp_like(output, r"{FAILS}") THEN 'false' WHEN regexp_like(output, r"{PASSES}") THEN 'true' ELSE 'unknown' END AS verdict FROM {_RUN}""",
    f"""SELECT seq, CASE WHEN NOT regexp_matches(command, '{RUNS}') THEN 'unknown' WHEN failed THEN 'false' WHEN regexp_matches(output, '{FAILS}') THEN 'false' WHEN regexp_matches(output, '{PASSES}') THEN 'true' ELSE 'unknown' END AS verdict FROM {_RUN}""")
_NOTICES = "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Weekly limit reached, resets at ' || conv_id || 'pm' || chr(10) || 'bye' WHEN 1 THEN 'no limit here' WHEN 2 THEN text || ' usage limit reached ' || text || text ELSE 'You hit your 5-hour limit.' END AS text FROM conversations) n"
rule("f27_limit_notice", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {_NOTICES}), m AS (SELECT conv_id, turn, regexp_extract(text, '(?i)((session|usage|weekly|daily|monthly|5-hour|rate)[ -]limit' || '[^' || chr(10) || ']*)', 1) AS note FROM l
WHERE back <= $entries AND length(text) <= $longest AND (instr(lower(text), 'reset') > 0 OR instr(lower(text), 'reached') > 0 OR instr(lower(text), 'exceeded') > 0 OR instr(lower(text), 'hit your') > 0))
SELECT conv_id, trim(substr(max_by(note, turn), 1, 160)) AS note FROM m WHERE note <> '' GROUP BY conv_id""", entries=40, longest=300)

# --- graph overlays -------------------------------------------------------------------
_FILES = "decl AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 97) || '.py' AS path, p_type AS name FROM part)"
rule("g2_full_build", f"""WITH {_FILES}, raw AS (SELECT DISTINCT a.p_brand || '/' || (a.p_partkey % 97) || '.py' AS path, a.p_type AS name, CASE WHEN a.p_partkey % 11 = 0 THEN 'missing ' || a.p_size ELSE b.p_type END AS target FROM part a JOIN part b ON b.p_partkey = @INT[floor(a.p_partkey / 7)] WHERE a.p_partkey > 0),
best AS (SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY length(path), path) AS r FROM decl) t WHERE r = 1),
e AS (SELECT DISTINCT raw.path || '::' || raw.name AS src, coalesce(own.path || '::' || own.name, best.path || '::' || best.name, 'ext:' || raw.target) AS dst FROM raw LEFT JOIN decl own ON own.path = raw.path AND own.name = raw.target LEFT JOIN best ON best.name = raw.target)
SELECT 'file' AS sort, path AS a, '' AS b FROM (SELECT DISTINCT path FROM decl) f UNION ALL SELECT 'symbol', path || '::' || name, path FROM decl UNION ALL SELECT 'edge', src, dst FROM e WHERE src <> dst UNION ALL SELECT DISTINCT 'placeholder', dst, '' FROM e WHERE left(dst, 4) = 'ext:'""")
rule("g13_in_flight", f"""WITH {_OPEN}, x AS (SELECT path AS node, intent_id, owner, session, op, ts FROM intents UNION SELECT path || '::' || symbol AS node, intent_id, owner, session, op, ts FROM intents WHERE symbol <> '')
SELECT node, intent_id, owner, op, round($now - ts, 1) AS age FROM x""", life=7200)
rule("g17_status", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS back FROM act WHERE kind = 'interface_verified'), x AS (SELECT path, tokens % 13 = 0 AS timed_out, lines_added % 5 = 0 AS failed, lines_removed = 3 AS uncovered, k % 10 = 4 AS skipped, symbol FROM r WHERE back = 1)
SELECT path, CASE WHEN timed_out THEN 'unknown' WHEN failed THEN 'failing' WHEN uncovered OR skipped THEN 'partial' ELSE 'clear' END AS status FROM x""")
rule("g17_at_report", """WITH d AS (SELECT dst AS node, count(*) AS dependents, count_if(kind = 'references') AS tests FROM dep WHERE src <> dst GROUP BY dst) SELECT 'p' || p.p_partkey AS node, CASE WHEN coalesce(d.dependents, 0) = 0 THEN 'clear' WHEN d.tests = 0 THEN 'partial' ELSE 'pending' END AS status,
CASE WHEN coalesce(d.dependents, 0) = 0 THEN 'no dependents' WHEN d.tests = 0 THEN 'no tests' ELSE '' END AS reason FROM part p LEFT JOIN d ON d.node = 'p' || p.p_partkey""")
rule("g19_decorated", f"""WITH {_OPEN}, t AS (SELECT k, count_if(kind = 'edit_reported') AS touches, count_if(kind = 'gate_block') AS breaking, count_if(kind = 'override') AS scars FROM act GROUP BY k), ow AS (SELECT k, usr FROM (SELECT k, usr, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(seq)) AS r FROM act WHERE kind = 'edit_reported' GROUP BY k, usr) x WHERE r = 1),
f AS (SELECT path, count(*) AS n FROM intents GROUP BY path), fk AS (SELECT a.k, sum(f.n) AS n FROM f JOIN (SELECT DISTINCT path, k FROM act) a ON a.path = f.path GROUP BY a.k)
SELECT 'p' || p.p_partkey AS node, coalesce(t.touches, 0) AS touches, coalesce(ow.usr, '') AS owner, coalesce(t.breaking, 0) AS breaking, coalesce(t.scars, 0) AS scars, @INT[coalesce(fk.n, 0)] AS in_flight FROM part p LEFT JOIN t ON t.k = p.p_partkey LEFT JOIN ow ON ow.k = p.p_partkey LEFT JOIN fk ON fk.k = p.p_partkey""", life=7200)
rule("g20_miss", """WITH s AS (SELECT DISTINCT path, symbol FROM act WHERE kind = 'edit_reported'), f AS (SELECT path, @SL[symbol] AS names FROM s GROUP BY path), q AS (SELECT DISTINCT CASE WHEN seq % 3 = 0 THEN 'gone/' || path ELSE path END AS path, CASE seq % 4 WHEN 0 THEN symbol WHEN 1 THEN 'nothing' ELSE '' END AS symbol FROM act WHERE seq < $asked)
SELECT q.path, q.symbol, CASE WHEN f.path IS NULL THEN 'file is not in the graph' WHEN q.symbol <> '' AND s.symbol IS NULL THEN 'no such symbol in the file' ELSE '' END AS gap, CASE WHEN f.path IS NOT NULL AND q.symbol <> '' AND s.symbol IS NULL THEN f.names ELSE '' END AS known FROM q LEFT JOIN f ON f.path = q.path LEFT JOIN s ON s.path = q.path AND s.symbol = q.symbol""", asked=600)
#: Fixed value: bytes of a transcript's end that are read.
pair("s19_last_usage", """WITH t AS (SELECT conv_id, concat_ws('\n', transform(array_sort(collect_list(struct(turn, concat('{"role": "', role, '", ', CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN concat('"usage": ', turn * 10 + 5, ', ') ELSE '' END, '"text": "', replace(replace(text, '"', ' '), chr(10), ' '), '"}') AS row_text))), x -> x.row_text)) AS whole FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, length(whole) > $tail AS cut, right(whole, $tail + 1) AS last FROM t), l AS (SELECT conv_id, pos, row_text FROM (SELECT conv_id, cut, posexplode(split(last, '\n')) AS (pos, row_text) FROM c) x WHERE NOT (cut AND pos = 0))
SELECT conv_id, max_by(CAST(get_json_object(row_text, '$.usage') AS BIGINT), pos) AS used FROM l WHERE get_json_object(row_text, '$.usage') IS NOT NULL GROUP BY conv_id""",
    """WITH t AS (SELECT conv_id, turn, role, length('{"role": "' || role || '", ' || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '"usage": ' || (turn * 10 + 5) || ', ' ELSE '' END || '"text": "' || text || '"}') AS n FROM conversations),
u AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS from_end FROM t) SELECT conv_id, max(turn) * 10 + 5 AS used FROM u WHERE role = 'assistant' AND turn % 4 = 1 AND from_end <= $tail GROUP BY conv_id""", tail=2000)

# --- windows of a whole scope, in stretches ---------------------------------------------
#: A scope's rows are ranked within stretches of its sequence; what stands before
#: a stretch comes from one row per stretch.
pair("w3_running_max", """WITH b AS (SELECT seq, scope, ts, seq div $stretch AS bucket FROM ledger), p AS (SELECT scope, bucket, max(ts) AS top FROM b GROUP BY scope, bucket), q AS (SELECT scope, bucket, max(top) OVER (PARTITION BY scope ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM p),
r AS (SELECT *, max(ts) OVER (PARTITION BY scope, bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here FROM b) SELECT r.seq, r.scope, greatest(r.here, q.earlier) AS high FROM r JOIN q ON q.scope = r.scope AND q.bucket = r.bucket""",
    "SELECT seq, scope, max(ts) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM ledger", stretch=4096)
pair("st3_unseen_by_call", """WITH b AS (SELECT seq, scope, usr, kind, seq div $stretch AS bucket FROM ledger), p AS (SELECT scope, bucket, count(*) AS n FROM b GROUP BY scope, bucket), q AS (SELECT scope, bucket, coalesce(sum(n) OVER (PARTITION BY scope ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY scope, bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here, count(*) OVER (PARTITION BY scope, usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM b),
c AS (SELECT r.scope, r.usr, r.seq, q.earlier + r.here - r.own AS foreign_rows FROM r JOIN q ON q.scope = r.scope AND q.bucket = r.bucket WHERE r.kind = 'check_performed'), d AS (SELECT *, foreign_rows - lag(foreign_rows) OVER (PARTITION BY scope, usr ORDER BY seq) AS unseen FROM c)
SELECT scope, usr, seq, CASE WHEN unseen IS NULL THEN 0 ELSE least(unseen, $shown) END AS shown FROM d""",
    """WITH r AS (SELECT seq, scope, usr, kind, count(*) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY scope, usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS foreign_rows FROM ledger),
c AS (SELECT scope, usr, seq, foreign_rows - lag(foreign_rows) OVER (PARTITION BY scope, usr ORDER BY seq) AS unseen FROM r WHERE kind = 'check_performed') SELECT scope, usr, seq, CASE WHEN unseen IS NULL THEN 0 ELSE least(unseen, $shown) END AS shown FROM c""", stretch=4096, shown=15)

_HUNKS = "SELECT usr, root, seq, CASE tokens % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' ELSE 'truncated' END AS op, k + 1 AS old_start, k + lines_removed AS old_end, k + 1 AS new_start, k + lines_added AS new_end FROM act WHERE kind = 'edit_reported'"
pair("m5_hunk_totals", f"""WITH h AS (SELECT usr, root, collect_list(struct(op, old_start, old_end, new_start, new_end)) AS hunks FROM ({_HUNKS}) t GROUP BY usr, root),
a AS (SELECT usr, root, aggregate(hunks, named_struct('added', CAST(0 AS BIGINT), 'removed', CAST(0 AS BIGINT)), (acc, x) -> named_struct('added', acc.added + CASE WHEN x.op IN ('replace', 'insert') THEN x.new_end - x.new_start + 1 ELSE 0 END, 'removed', acc.removed + CASE WHEN x.op IN ('replace', 'delete') THEN x.old_end - x.old_start + 1 ELSE 0 END)) AS n FROM h)
SELECT usr, root, n.added AS added, n.removed AS removed FROM a""",
    """SELECT usr, root, CAST(coalesce(sum(lines_added) FILTER (tokens % 4 < 2), 0) AS BIGINT) AS added, CAST(coalesce(sum(lines_removed) FILTER (tokens % 4 IN (0, 2)), 0) AS BIGINT) AS removed FROM act WHERE kind = 'edit_reported' GROUP BY usr, root""")
