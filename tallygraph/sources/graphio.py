"""Sinks and sources of graphs and transcripts: JSON lines, GraphML, Cypher.

Lines are made by column expressions and written by Spark's text sink, part by
part; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import view

#: Relation names of other tools and the kinds they stand for.
ALIASES = {"imports": "references", "depends_on": "references", "extends": "inherits", "implements": "inherits", "subclasses": "inherits", "invokes": "calls", "uses": "references"}
ITEM = "type string, id string, src string, dst string, kind string, confidence string, weight double"
#: Bytes of a transcript's end that are read.
TAIL = 256 * 1024


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(value): lines of nodes (id) and edges (src, dst, kind, confidence,
    weight) as ``json``, ``graphml`` or ``cypher``; the name of the form is
    trimmed and lower-cased, another one is a ValueError.  Confidence is in
    capitals; only co-change edges carry a weight."""
    form = form.strip().lower()
    weight = F.when(F.col("kind") == "co_change", F.col("weight"))
    if form == "json":
        n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), "id")).alias("value"))
        e = edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), "src", "dst", "kind", F.upper("confidence").alias("confidence"), weight.alias("weight"))).alias("value"))
    elif form == "graphml":
        n = nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('"/>')).alias("value"))
        e = edges.select(F.concat(F.lit('<edge source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('"><data key="kind">'), xml(F.col("kind")), F.lit("</data></edge>")).alias("value"))
    elif form == "cypher":
        n = nodes.select(F.concat(F.lit("MERGE (:Node {id: '"), cypher(F.col("id")), F.lit("'});")).alias("value"))
        e = edges.select(F.concat(F.lit("MATCH (a:Node {id: '"), cypher(F.col("src")), F.lit("'}), (b:Node {id: '"), cypher(F.col("dst")), F.lit("'}) MERGE (a)-[:"), F.upper("kind"), F.lit("]->(b);")).alias("value"))
    else:
        raise ValueError(f"unknown graph format: {form}")
    return n.union(e)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str) -> None:
    lines(nodes, edges, form).write.text(path)


def read_graph(text: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, kind, src_path, skipped) from JSON lines (value).  Kinds
    go through ``ALIASES``; an id's file is what stands before ``::``, ``#`` or
    ``:``; ``skipped`` marks edges of files in ``parsed`` (path).  Lines that are
    no edges are left out."""
    e = text.select(F.from_json("value", ITEM).alias("x")).select("x.*").where("type = 'edge' and src is not null and dst is not null")
    alias = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    kind = F.lower("kind")
    e = e.select("src", "dst", F.coalesce(alias[kind], kind).alias("kind"), F.regexp_extract("src", "^([^:#]*)", 1).alias("src_path"))
    if parsed is None:
        return e.withColumn("skipped", F.lit(False))
    known = parsed.select(F.col("path").alias("src_path"), F.lit(True).alias("known")).distinct()
    return e.join(known, "src_path", "left").select("src", "dst", "kind", "src_path", F.coalesce("known", F.lit(False)).alias("skipped"))


def import_graph(text: DataFrame, stored: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an import of JSON lines (value) does to a graph: the edges (src,
    dst, kind, origin) of ``stored`` (src, dst, kind) and the new ones, and the
    counts (what, n) of ``edges`` in the lines, those ``skipped`` because the
    file of their source is in ``parsed`` (path), those ``known``, that is
    already stored or named twice, the ``added`` and the ``lines`` that are no
    edges.  Files that were parsed are better known than an import tells."""
    found = read_graph(text, parsed)
    fresh = found.where("not skipped").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    have = stored.select("src", "dst", "kind").distinct()
    new = fresh.join(have, ["src", "dst", "kind"], "left_anti")
    merged = have.select("src", "dst", "kind", F.lit("stored").alias("origin")).union(new.select("src", "dst", "kind", F.lit("imported")))
    seen = found.agg(F.count("*").alias("edges"), F.count_if("skipped").alias("skipped"))
    total, added = text.agg(F.count("*").alias("lines")), new.agg(F.count("*").alias("added"))
    one = seen.crossJoin(total).crossJoin(added)  # one row each
    counts = one.select(F.inline(F.array(*[F.struct(F.lit(what).alias("what"), n.alias("n")) for what, n in (
        ("edges", F.col("edges")), ("skipped", F.col("skipped")), ("known", F.col("edges") - F.col("skipped") - F.col("added")), ("added", F.col("added")), ("lines", F.col("lines") - F.col("edges")),
    )])))
    return merged, counts


def last_usage(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the last line with a ``usage`` entry among the final
    ``TAIL`` characters of each JSON-lines transcript; a first line that the cut
    went through is not read.  A file is one row, so it must fit in a task."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    cut = F.length("value") > TAIL
    rows = files.select("file", cut.alias("cut"), F.posexplode(F.split(F.when(cut, F.expr(f"right(value, {TAIL})")).otherwise(F.col("value")), "\n")).alias("pos", "line"))
    rows = rows.where("not (cut and pos = 0)").where(F.get_json_object("line", "$.usage").isNotNull())
    order = Window.partitionBy("file").orderBy(F.desc("pos"))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("file", "line")


def _graph(s, d):
    dep = view(s, d, "dep")
    edges = dep.select("src", "dst", "kind", F.lit("extracted").alias("confidence"), F.lit(1.0).alias("weight"))
    return dep.select(F.col("src").alias("id")).union(dep.select("dst")).distinct(), edges


def _dispatched(s, d, forms) -> DataFrame:
    """Lines of each form, by its name as it was asked for."""
    nodes, edges = _graph(s, d)
    out = None
    for form in forms:
        rows = lines(nodes, edges, form).withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    return out


def _offered(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An export of all edges with names of symbols, a graph that holds every
    third of them, and the files whose number ends in 4."""
    dep = view(s, d, "dep").withColumn("k", F.substring("src", 2, 20).cast("long"))
    file = F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".py"))
    src = F.concat(file, F.when(F.col("k") % 3 == 0, "::").when(F.col("k") % 3 == 1, "#").otherwise(":"), "src")
    other = F.when(F.col("kind") == "references", F.when(F.col("k") % 2 == 0, "Imports").otherwise("uses")).when(F.col("kind") == "inherits", "EXTENDS").otherwise(F.col("kind"))
    edges = dep.select(src.alias("src"), "dst", other.alias("kind"), F.lit("extracted").alias("confidence"), F.lit(1.0).alias("weight"), "k", F.col("kind").alias("known"))
    text = lines(edges.select(F.col("src").alias("id")), edges.select("src", "dst", "kind", "confidence", "weight"), "json")
    text = text.union(edges.where("k % 10 = 0").select(F.lit("not a line of JSON"))).union(lines(edges.limit(0).select(F.col("src").alias("id")), edges.where("k % 5 = 1").select("src", "dst", "kind", "confidence", "weight"), "json"))
    return text, edges.where("k % 3 = 0").select("src", "dst", F.col("known").alias("kind")), edges.where("k % 10 = 4").select(file.alias("path"))


def _imported(s, d) -> DataFrame:
    return import_graph(*_offered(s, d))[0]


def _import_counts(s, d) -> DataFrame:
    return import_graph(*_offered(s, d))[1]


QUERIES = {
    "s24_import": _imported,
    "s24_import_counts": _import_counts,
    "s21_graph_json": lambda s, d: lines(*_graph(s, d), "json"),
    "s22_graphml": lambda s, d: lines(*_graph(s, d), "graphml"),
    "s23_cypher": lambda s, d: lines(*_graph(s, d), " Cypher "),
    "s25_export_dispatch": lambda s, d: _dispatched(s, d, (" JSON ", "GraphML", "cypher\t")),
    "s24_graph_import": lambda s, d: read_graph(lines(*_graph(s, d), "json")).select("src", "dst", "kind"),
}
_N = "SELECT DISTINCT node FROM (SELECT src AS node FROM dep UNION ALL SELECT dst AS node FROM dep) t"
ORACLE = {
    "s21_graph_json": f"""SELECT '{{"type":"node","id":"' || node || '"}}' AS value FROM ({_N}) n UNION ALL SELECT '{{"type":"edge","src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '","confidence":"EXTRACTED"}}' AS value FROM dep""",
    "s22_graphml": f"""SELECT '<node id="' || node || '"/>' AS value FROM ({_N}) n UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="kind">' || kind || '</data></edge>' AS value FROM dep""",
    "s23_cypher": f"""SELECT 'MERGE (:Node {{id: ''' || node || '''}});' AS value FROM ({_N}) n UNION ALL SELECT 'MATCH (a:Node {{id: ''' || src || '''}}), (b:Node {{id: ''' || dst || '''}}) MERGE (a)-[:' || upper(kind) || ']->(b);' AS value FROM dep""",
    "s24_graph_import": "SELECT src, dst, kind FROM dep",
    "s24_import": """SELECT 'f' || k || '.py' || CASE k % 3 WHEN 0 THEN '::' WHEN 1 THEN '#' ELSE ':' END || src AS src, dst, kind, CASE WHEN k % 3 = 0 THEN 'stored' ELSE 'imported' END AS origin FROM (SELECT *, CAST(substr(src, 2) AS BIGINT) AS k FROM dep) d WHERE k % 3 = 0 OR k % 10 <> 4""",
    "s24_import_counts": """WITH d AS (SELECT CAST(substr(src, 2) AS BIGINT) AS k FROM dep), n AS (SELECT count(*) + count(*) FILTER (k % 5 = 1) AS edges, count(*) FILTER (k % 10 = 4) AS skipped, count(*) FILTER (k % 10 <> 4 AND k % 3 <> 0) AS added, count(*) + count(*) FILTER (k % 10 = 0) AS lines FROM d)
SELECT 'edges' AS what, edges AS n FROM n UNION ALL SELECT 'skipped', skipped FROM n UNION ALL SELECT 'known', edges - skipped - added FROM n UNION ALL SELECT 'added', added FROM n UNION ALL SELECT 'lines', lines FROM n""",
}
ORACLE["s25_export_dispatch"] = f"""SELECT value, ' JSON ' AS form FROM ({ORACLE['s21_graph_json']}) a UNION ALL SELECT value, 'GraphML' AS form FROM ({ORACLE['s22_graphml']}) b UNION ALL SELECT value, 'cypher' || chr(9) AS form FROM ({ORACLE['s23_cypher']}) c"""
