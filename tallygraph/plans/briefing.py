"""What an agent is told: modules ranked for a prompt, and what a note rests on.

The names of a prompt are a short list and are laid beside the records of a
module; a term is looked up in the record's path, its symbols and their notes,
each with a weight.  Guesses (a part of a name, a word of a note) count little
however many they are, and a module of nothing but guesses is left out.  What
depends on a matched symbol follows with weights of its own.
"""

from __future__ import annotations

from .rules import pair

# Records: a file's symbols, some rare and some common, the note on each, and the
# note on the file.
_RECORDS = """e AS (SELECT path, k, CASE WHEN tokens % 7 = 0 THEN 'Widget' || k WHEN tokens % 7 = 1 THEN 'load_' || (k % 30) ELSE symbol END AS name, lower(why) AS doc, ts, seq FROM act WHERE kind = 'edit_reported'),
sy AS (SELECT path, name, lower(name) AS low, max(doc) AS doc FROM e GROUP BY path, name), rec AS (SELECT path, min(k) AS k, lower(path) AS low, max(ts) AS ts, max(CASE WHEN seq % 9 = 0 THEN doc ELSE '' END) AS doc FROM e GROUP BY path)"""
#: Fixed values of the rule: weights and bounds.
_FIXED = {"path_hit": 6, "dotted": 4, "stem_hit": 3, "exact": 5, "common": 5, "weak": 2, "strong": 3, "caller": 4, "caller2": 3, "modules": 40, "names": 40, "longer": 4}
_ASKED = ("d2/f42.py", "./d3/f11.ts", "/home/me/repo/d5/f13.py", "d1.f9", "f20", "Widget14", "widget3", "load_7", "Ledger", "because of", "x", " f33 ", "compute")

pair("o8_briefing", f"""WITH {_RECORDS}, q AS (SELECT i, lower(trim(raw)) AS id FROM (SELECT posexplode(array$asked) AS (i, raw)) p WHERE length(trim(raw)) >= 2 AND i < $names),
defined AS (SELECT q.i, count(DISTINCT sy.path) AS n FROM q JOIN sy ON sy.low = q.id GROUP BY q.i),
p AS (SELECT rec.path, rec.k, q.i, q.id, CASE WHEN (instr(q.id, '/') > 0 OR instr(q.id, '.') > 0) AND (rec.low = bare OR endswith(rec.low, '/' || bare) OR endswith(bare, '/' || rec.low)) THEN $path_hit
  WHEN (instr(q.id, '/') > 0 OR instr(q.id, '.') > 0) AND (endswith(regexp_replace(rec.low, '([.]py)+$', ''), replace(q.id, '.', '/')) OR instr(rec.low, '/' || replace(q.id, '.', '/') || '/') > 0) THEN $dotted ELSE 0 END AS as_path,
  regexp_replace(element_at(split(rec.low, '/'), -1), '[.][^.]*$', '') = q.id AS stem, length(q.id) >= $longer AND instr(rec.doc, q.id) > 0 AS noted FROM rec JOIN (SELECT *, regexp_replace(id, '^([.]/)+', '') AS bare FROM q) q ON true),
s AS (SELECT q.i, sy.path, sy.name, CASE WHEN sy.low = q.id AND defined.n <= $common THEN 1 ELSE 0 END AS exact, CASE WHEN sy.low = q.id THEN 1 ELSE 0 END AS same, CASE WHEN (sy.low = q.id AND defined.n > $common) OR (sy.low <> q.id AND length(q.id) >= $longer AND instr(sy.low, q.id) > 0) THEN 1 ELSE 0 END + CASE WHEN length(q.id) >= $longer AND instr(sy.doc, q.id) > 0 THEN 1 ELSE 0 END AS weak
  FROM sy JOIN q ON true LEFT JOIN defined ON defined.i = q.i),
h AS (SELECT s.path, s.i, sum(exact) AS exact, sum(weak) AS weak FROM s WHERE exact + same + weak > 0 GROUP BY s.path, s.i),
t AS (SELECT p.path, p.i, as_path + CASE WHEN as_path > 0 THEN 0 ELSE CASE WHEN stem THEN $stem_hit ELSE 0 END + $exact * coalesce(h.exact, 0) END AS strong, CASE WHEN as_path > 0 THEN 0 ELSE coalesce(h.weak, 0) + CASE WHEN noted THEN 1 ELSE 0 END END AS weak, as_path FROM p LEFT JOIN h ON h.path = p.path AND h.i = p.i),
m AS (SELECT path, sum(strong) + least($weak, sum(weak)) AS score FROM t GROUP BY path HAVING sum(strong) + least($weak, sum(weak)) >= $strong),
sym AS (SELECT DISTINCT s.path, s.name, s.i FROM s JOIN m ON m.path = s.path JOIN t ON t.path = s.path AND t.i = s.i WHERE s.same = 1 AND t.as_path = 0), anchor AS (SELECT sym.path, sym.i, sym.name, 'p' || rec.k AS node FROM sym JOIN rec ON rec.path = sym.path),
one AS (SELECT anchor.path, anchor.i, anchor.name, anchor.node, dep.src, 1 AS hop FROM anchor JOIN dep ON dep.dst = anchor.node AND dep.src <> dep.dst), two AS (SELECT one.path, one.i, one.name, one.node, dep.src, 2 AS hop FROM one JOIN dep ON dep.dst = one.src AND dep.src <> dep.dst WHERE dep.src <> one.node),
d AS (SELECT u.path, u.i, u.name, rec.path AS far, min(u.hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) u JOIN rec ON 'p' || rec.k = u.src WHERE rec.path <> u.path GROUP BY u.path, u.i, u.name, rec.path),
c AS (SELECT far, row_number() OVER (ORDER BY min(struct(path, i, name, hop)), far) AS place FROM d GROUP BY far), x AS (SELECT d.far AS path, sum(CASE WHEN hop = 1 THEN $caller ELSE $caller2 END) AS score FROM d JOIN c ON c.far = d.far WHERE c.place <= $modules GROUP BY d.far),
al AS (SELECT path, sum(score) AS score FROM (SELECT path, score FROM m UNION ALL SELECT path, score FROM x) u GROUP BY path)
SELECT al.path, @INT[al.score] AS score, rec.ts AS recent FROM al JOIN rec ON rec.path = al.path ORDER BY score DESC, recent DESC, path""",
    f"""WITH {_RECORDS}, q AS (SELECT i - 1 AS i, lower(trim(l[i])) AS id FROM (SELECT list_value$asked AS l) a, unnest(range(1, len(l) + 1)) r(i) WHERE len(trim(l[i])) >= 2 AND i <= $names),
b AS (SELECT rec.path, rec.k, rec.low, rec.doc, list({{'n': sy.low, 'd': sy.doc}}) AS syms FROM rec JOIN sy ON sy.path = rec.path GROUP BY ALL),
g AS (SELECT b.path, b.k, q.i, q.id, regexp_replace(q.id, '^([.]/)+', '') AS bare, q.id LIKE '%/%' OR q.id LIKE '%.%' AS pathy, replace(q.id, '.', '/') AS dotted, b.low, b.doc, syms, (SELECT count(DISTINCT path) FROM sy WHERE sy.low = q.id) AS n FROM b, q),
v AS (SELECT path, k, i, CASE WHEN pathy AND (low = bare OR suffix(low, '/' || bare) OR suffix(bare, '/' || low)) THEN $path_hit WHEN pathy AND (suffix(regexp_replace(low, '([.]py)+$', ''), dotted) OR contains(low, '/' || dotted || '/')) THEN $dotted ELSE 0 END AS as_path,
  regexp_extract(low, '([^/]*?)([.][^.]*)?$', 1) = id AS stem, len([y for y in syms if y.n = id]) AS same, n, len([y for y in syms if y.n <> id AND len(id) >= $longer AND contains(y.n, id)]) + len([y for y in syms if len(id) >= $longer AND contains(y.d, id)]) + CASE WHEN len(id) >= $longer AND contains(doc, id) THEN 1 ELSE 0 END AS guesses FROM g),
t AS (SELECT path, k, i, same, as_path, CASE WHEN as_path > 0 THEN as_path ELSE CASE WHEN stem THEN $stem_hit ELSE 0 END + CASE WHEN n <= $common THEN $exact * same ELSE 0 END END AS strong, CASE WHEN as_path > 0 THEN 0 ELSE guesses + CASE WHEN n > $common THEN same ELSE 0 END END AS weak FROM v),
m AS (SELECT path, k, sum(strong) + least($weak, sum(weak)) AS score FROM t GROUP BY path, k HAVING score >= $strong), a AS (SELECT m.path, m.k, t.i, sy.name FROM m JOIN t ON t.path = m.path AND t.same > 0 AND t.as_path = 0 JOIN q ON q.i = t.i JOIN sy ON sy.path = m.path AND sy.low = q.id),
w AS (SELECT a.path, a.i, a.name, x.src, 1 AS hop FROM a JOIN dep x ON x.dst = 'p' || a.k AND x.src <> x.dst UNION ALL SELECT a.path, a.i, a.name, y.src, 2 FROM a JOIN dep x ON x.dst = 'p' || a.k AND x.src <> x.dst JOIN dep y ON y.dst = x.src AND y.src <> y.dst AND y.src <> 'p' || a.k),
d AS (SELECT w.path, w.i, w.name, rec.path AS far, min(hop) AS hop FROM w JOIN rec ON 'p' || rec.k = w.src AND rec.path <> w.path GROUP BY ALL), c AS (SELECT far FROM d GROUP BY far ORDER BY min((path, i, name, hop)), far LIMIT $modules),
u AS (SELECT path, score FROM m UNION ALL SELECT far, CASE hop WHEN 1 THEN $caller ELSE $caller2 END FROM d WHERE far IN (SELECT far FROM c))
SELECT u.path, CAST(sum(u.score) AS BIGINT) AS score, max(rec.ts) AS recent FROM u JOIN rec ON rec.path = u.path GROUP BY u.path""", asked=_ASKED, **_FIXED)

# What a note on a part rests on: at most so many references of each node, two
# steps deep; a slice that has seen too much is silent.  Then what uses the part.
_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey AS src, 'p' || (l_partkey % 50) AS dst FROM lineitem)"
# The halves of the edges share no row, and what a node refers to travels as one
# list, so that a step is a row for each node met and not for each two steps.
pair("g18_slices", f"""WITH {_EDGES.replace(" UNION ", " UNION ALL ")}, r AS (SELECT src, dst, place FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM e) x WHERE place <= $refs),
l AS (SELECT src, array_sort(collect_list(dst)) AS dsts FROM r GROUP BY src), a AS (SELECT src AS anchor, filter(dsts, x -> x <> src) AS one, filter(slice(dsts, 1, $frontier), x -> x <> src) AS front FROM l WHERE left(src, 1) = 'p'),
b AS (SELECT x.anchor, array_distinct(flatten(collect_list(l.dsts))) AS far FROM (SELECT anchor, explode(front) AS node FROM a) x JOIN l ON l.src = x.node GROUP BY x.anchor),
c AS (SELECT a.anchor, a.one, filter(array_except(b.far, a.one), x -> x <> a.anchor) AS two FROM a LEFT JOIN b ON b.anchor = a.anchor),
back AS (SELECT dst AS anchor, src AS node, row_number() OVER (PARTITION BY dst ORDER BY src) AS place FROM e WHERE left(dst, 1) = 'p' AND src <> dst)
SELECT anchor, inline(concat(transform(one, x -> struct(x AS node, 1 AS hops)), transform(coalesce(two, array()), x -> struct(x AS node, 2 AS hops)))), 'uses' AS side FROM c WHERE size(one) + coalesce(size(two), 0) <= $seen
UNION ALL SELECT anchor, node, 1 AS hops, 'used_by' AS side FROM back WHERE place <= $dependents""",
    f"""WITH {_EDGES}, l AS MATERIALIZED (SELECT src, list(dst ORDER BY dst)[:$refs] AS dsts FROM e GROUP BY src), a AS (SELECT src AS anchor, [x for x in dsts if x <> src] AS one FROM l WHERE src LIKE 'p%'),
b AS (SELECT a.anchor, list_distinct(flatten(list(l.dsts))) AS far FROM a, unnest(a.one[:$frontier]) t(node) JOIN l ON l.src = t.node GROUP BY a.anchor),
c AS (SELECT a.anchor, a.one, [x for x in coalesce(b.far, []) if x <> a.anchor AND NOT list_contains(a.one, x)] AS two FROM a LEFT JOIN b ON b.anchor = a.anchor), s AS (SELECT * FROM c WHERE len(one) + len(two) <= $seen)
SELECT anchor, unnest(one) AS node, 1 AS hops, 'uses' AS side FROM s UNION ALL SELECT anchor, unnest(two), 2, 'uses' FROM s
UNION ALL SELECT anchor, unnest(back), 1, 'used_by' FROM (SELECT dst AS anchor, list(src ORDER BY src)[:$dependents] AS back FROM e WHERE dst LIKE 'p%' AND src <> dst GROUP BY dst) z""", refs=20, frontier=25, seen=50, dependents=25)
