"""Source structure of files, and modules to the files that they name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import parse_file
from ..sources.adapters import spark_sql

#: What a language adds to a module's name, in order.
CANDIDATES = {
    "python": (".py", "/__init__.py", ".pyi"),
    "typescript": (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", ".js", ".jsx", "/index.js"),
    "tsx": (".tsx", ".ts", "/index.tsx", "/index.ts", ".js", ".jsx"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx", ".ts", ".tsx", "/index.ts"),
    "rust": (".rs", "/mod.rs"), "ruby": (".rb",), "php": (".php",), "java": (".java",), "c_sharp": (".cs",),
}
SCRIPTS = ("typescript", "tsx", "javascript")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def joined(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def normal(path: Column) -> Column:
    """``path`` without empty parts and ``.``, ``..`` taken back; a ``..`` with
    nothing left to take back stays, so that such a path is outside."""

    def step(acc: Column, x: Column) -> Column:
        own = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        back = F.when(own, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))
        return F.when((x == "") | (x == "."), acc).when(x == "..", back).otherwise(F.array_append(acc, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def suffixes(path: Column) -> Column:
    """Every tail of a path that starts at one of its parts."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def resolve_modules(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(from_path, language, module, path): the file or folder (with a slash at
    its end) of ``known`` (path) that each import (from_path, language, module)
    names, null if outside.

    Three equi-joins: exact candidates, the first that exists; files by their
    tail, the one that shares most leading folders with the importer, then the
    shortest, then the least; folders by their tail, the shortest, then the
    least.  No path is compared with another by a pattern."""
    known = known.select("path").distinct()
    folders = known.select(parent(F.col("path")).alias("dir")).distinct()
    src = folders.where((F.col("dir") == "src") | F.col("dir").endswith("/src")).orderBy(F.length("dir"), "dir").limit(1)
    rows = imports.select("from_path", "language", "module").distinct().crossJoin(src.agg(F.max("dir").alias("src")))  # one row
    lang, raw, here = F.col("language"), F.trim("module"), parent(F.col("from_path"))
    ext = F.create_map(*[x for k, v in CANDIDATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    exts = F.coalesce(ext[lang], F.array(F.lit("")))
    with_ext = lambda stem: F.transform(exts, lambda e: normal(F.concat(stem, e)))
    none = F.array().cast("array<string>")
    # python
    dots = F.length(F.regexp_extract(raw, "^([.]*)", 1))
    rest = F.replace(F.expr("substring(trim(module), length(regexp_extract(trim(module), '^([.]*)', 1)) + 1)"), F.lit("."), F.lit("/"))
    up = lambda path, n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), path, lambda acc, i: F.when(i < n, parent(acc)).otherwise(acc))
    py_stem = F.when(rest == "", up(here, dots)).otherwise(joined(up(here, dots), rest))
    # scripts
    bare = lambda p: F.regexp_replace(p, "[.](js|jsx|ts|tsx|mjs|cjs)$", "")
    js_stem = bare(normal(joined(here, raw)))
    js_tail = F.regexp_replace(F.regexp_replace(raw, "^[@~]/", ""), "[.][^./]*$", "")
    # rust
    parts = F.filter(F.split(raw, "::"), lambda x: x != "")
    supers = F.size(parts) - F.size(F.expr("regexp_extract_all(concat('', regexp_replace(trim(module), '^(super::|super$)+', '')), '[^:]+', 0)"))
    inner = F.array_join(F.when(parts[0].isin("crate", "self"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.slice(parts, supers + 1, F.greatest(F.size(parts) - supers, F.lit(0)))), "/")
    base = F.when(parts[0] == "crate", F.coalesce("src", F.lit(""))).when(parts[0] == "self", here).otherwise(up(here, supers + 1))
    rs_stem = F.when(inner == "", base).otherwise(joined(base, inner))
    rs_near = parts[0].isin("crate", "self", "super")
    dotted = F.replace(raw, F.lit("."), F.lit("/"))
    tail = F.when((lang == "python") & (dots == 0), dotted).when(lang.isin(*SCRIPTS) & raw.rlike("^([@~]/|src/)"), js_tail).when((lang == "rust") & ~rs_near, F.array_join(parts, "/"))
    tail = tail.when(lang.isin("java", "c_sharp"), dotted).when(lang == "php", F.replace(raw, F.lit("\\"), F.lit("/"))).when(lang.isin("c", "cpp"), raw).when(lang == "ruby", F.regexp_replace(raw, "[.]rb$", ""))
    exact = F.when((lang == "python") & (dots > 0), with_ext(py_stem)).when(lang.isin(*SCRIPTS) & raw.startswith("."), F.concat(with_ext(js_stem), F.array(js_stem))).when((lang == "rust") & rs_near, with_ext(rs_stem))
    exact = exact.when(lang.isin("c", "cpp"), F.array(raw, normal(joined(here, raw)))).when(lang == "ruby", F.concat(with_ext(tail), with_ext(joined(here, tail)))).otherwise(none)
    slash = F.element_at(F.split(F.regexp_replace(raw, "/+$", ""), "/"), -1)
    dirs = F.when((lang == "python") & (dots > 0) & (rest == ""), F.array(py_stem)).when((lang == "rust") & rs_near, F.array(rs_stem)).when((lang == "go") & (F.split(raw, "/")[0].contains(".") | raw.contains("/")), F.array(slash))
    dirs = dirs.when(lang == "java", F.array(F.lower(dotted), dotted)).when(lang.isin("c_sharp", "php"), F.array(tail)).otherwise(none)
    clean = F.trim(F.coalesce(tail, F.lit("")), F.lit("/"))
    rows = rows.where(raw != "").select("from_path", "language", "module", exact.alias("exact"), F.when(clean == "", none).otherwise(with_ext(clean)).alias("tails"), F.transform(dirs, lambda x: F.trim(x, F.lit("/"))).alias("dirs"))
    key = ["from_path", "language", "module"]
    found = rows.select(*key, F.posexplode("exact").alias("pos", "path")).join(known, "path").groupBy(*key).agg(F.min(F.struct("pos", "path"))["path"].alias("exact_path"))
    by_tail = known.select("path", F.explode(suffixes(F.col("path"))).alias("tail"))
    folder = lambda p: F.split(p, "/")
    shared = F.aggregate(F.zip_with(folder(F.col("path")), folder(F.col("from_path")), lambda a, b: a == b), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["on"] & F.coalesce(x, F.lit(False))).alias("on"), F.when(acc["on"] & F.coalesce(x, F.lit(False)), acc["n"] + 1).otherwise(acc["n"]).alias("n")))["n"]
    tails = rows.select(*key, F.explode("tails").alias("tail")).join(by_tail, "tail")
    tails = tails.groupBy(*key).agg(F.min(F.struct((-shared).alias("far"), F.length("path").alias("size"), "path"))["path"].alias("tail_path"))
    by_dir = folders.where("dir <> ''").select("dir", F.explode(suffixes(F.col("dir"))).alias("tail"))
    dirs = rows.select(*key, F.posexplode("dirs").alias("pos", "tail")).join(by_dir, "tail").groupBy(*key).agg(F.min(F.struct("pos", F.length("dir").alias("size"), "dir"))["dir"].alias("dir_path"))
    out = imports.select(*key).distinct().join(found, key, "left").join(tails, key, "left").join(dirs, key, "left")
    return out.select(*key, F.coalesce("exact_path", "tail_path", F.concat("dir_path", F.lit("/"))).alias("path"))


_KNOWN = """SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'src/pkg' || (p_partkey % 9) || '/m' || (p_partkey % 50) || '.py' WHEN 1 THEN 'web/c' || (p_partkey % 7) || '/w' || (p_partkey % 40) || '.ts' WHEN 2 THEN 'web/c' || (p_partkey % 7) || '/d' || (p_partkey % 20) || '/index.ts'
WHEN 3 THEN 'core/src/r' || (p_partkey % 5) || '/x' || (p_partkey % 30) || '.rs' WHEN 4 THEN 'java/org/acme' || (p_partkey % 4) || '/K' || (p_partkey % 25) || '.java' ELSE 'go/svc' || (p_partkey % 8) || '/main' || (p_partkey % 3) || '.go' END AS path FROM part UNION SELECT 'core/src/lib.rs' AS path FROM region"""
_IMPORTS = """SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'src/pkg' || (p_partkey % 9) || '/m' || (p_partkey % 50) || '.py' WHEN 1 THEN 'web/c' || (p_partkey % 7) || '/w1.ts' WHEN 2 THEN 'web/c3/w2.ts' WHEN 3 THEN 'core/src/r' || (p_partkey % 5) || '/x1.rs' WHEN 4 THEN 'java/org/acme1/K1.java' ELSE 'go/svc1/main1.go' END AS from_path,
CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'rust' WHEN 4 THEN 'java' ELSE 'go' END AS language,
CASE p_partkey % 6 WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN 'pkg' || (p_size % 9) || '.m' || (p_partkey % 50) WHEN 1 THEN '.m' || (p_size % 50) ELSE '..pkg' || (p_size % 9) || '.m' || (p_partkey % 50) END
WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN './w' || (p_size % 40) || '.js' WHEN 1 THEN '../c' || (p_size % 7) || '/d' || (p_partkey % 20) ELSE 'react' END WHEN 2 THEN '@/c' || (p_size % 7) || '/w' || (p_partkey % 40)
WHEN 3 THEN CASE p_size % 3 WHEN 0 THEN 'crate::r' || (p_size % 5) || '::x' || (p_partkey % 30) WHEN 1 THEN 'super::r' || (p_size % 5) || '::x' || (p_partkey % 30) ELSE 'self::x' || (p_size % 30) END
WHEN 4 THEN 'org.acme' || (p_size % 5) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.K' || (p_partkey % 25) END ELSE CASE p_size % 2 WHEN 0 THEN 'host.io/x/svc' || (p_size % 9) ELSE 'fmt' END END AS module FROM part"""
_SOURCE = """SELECT p_partkey AS id, 'src/f' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.java' WHEN 4 THEN '.rs' ELSE '.txt' END AS path, CASE p_partkey % 6
WHEN 0 THEN 'from base import Base' || chr(10) || 'class L' || p_partkey || '(Base):' || chr(10) || '    def add(self, o, n=1):' || chr(10) || '        return total' || p_partkey || '(o)' || chr(10) || 'def total' || p_partkey || '(o: L' || p_partkey || '):' || chr(10) || '    return o'
WHEN 1 THEN 'import { Base } from "./base";' || chr(10) || 'export class L' || p_partkey || ' extends Base { add(o: L' || p_partkey || ', n): number { return total' || p_partkey || '(o); } }' || chr(10) || 'export function total' || p_partkey || '(o: L' || p_partkey || '): number { return 1; }'
WHEN 2 THEN 'package p' || chr(10) || 'import "fmt"' || chr(10) || 'type L' || p_partkey || ' struct { n int }' || chr(10) || 'func (l *L' || p_partkey || ') add(o, n int) int { return total' || p_partkey || '(o) }' || chr(10) || 'func total' || p_partkey || '(o int) int { fmt.Println("}", o); return o }'
WHEN 3 THEN 'import base.Base;' || chr(10) || 'class L' || p_partkey || ' extends Base { int add(int o, int n) { return total' || p_partkey || '(o); } }' || chr(10) || 'class total' || p_partkey || ' { L' || p_partkey || ' o; }'
WHEN 4 THEN 'use base::Base;' || chr(10) || 'pub struct L' || p_partkey || ' { n: i32 }' || chr(10) || 'impl Base for L' || p_partkey || ' { fn add(o: &L' || p_partkey || ', n: i32) -> i32 { total' || p_partkey || '(o) } }' || chr(10) || '// a comment {' || chr(10) || 'pub fn total' || p_partkey || '(o: &L' || p_partkey || ') -> i32 { 1 }'
ELSE 'plain text {' END || CASE WHEN p_partkey % 10 = 9 THEN chr(10) || 'x = (' ELSE '' END AS source FROM part"""


def parsed(s, d) -> DataFrame:
    """(path, s): the files of the part table with their structure.  A few
    megabytes of keys are millions of files, so the keys are dealt to all cores
    before a file is made."""
    n = max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    dealt = f"FROM (SELECT /*+ REPARTITION({n}, p_partkey) */ p_partkey FROM part) part"
    return spark_sql(s, d, re.sub(r"FROM part$", dealt, _SOURCE)).select("path", parse_file(F.col("path"), F.col("source")).alias("s"))


QUERIES = {
    "s17_parse_source": lambda s, d: parsed(s, d).selectExpr("path", "s.status AS status", "array_join(transform(s.symbols, x -> x.name), ',') AS names", "array_join(transform(s.imports, x -> concat(x[0], ':', x[1])), ',') AS imports"),
    "s26_name_edges": lambda s, d: parsed(s, d).selectExpr("path", "explode(s.symbols) AS x").selectExpr("path", "x.name AS symbol", "explode(x.edges) AS e").selectExpr("path", "symbol", "e[0] AS target", "e[1] AS kind"),
    "s27_symbols": lambda s, d: parsed(s, d).selectExpr("path", "explode(s.symbols) AS x").selectExpr("path", "x.name AS symbol", "x.kind AS kind", "array_join(x.params, ',') AS params"),
    "j2_modules": lambda s, d: resolve_modules(spark_sql(s, d, _IMPORTS), spark_sql(s, d, _KNOWN)),
}
_P = "p AS (SELECT p_partkey AS k, p_partkey % 6 AS l, 'src/f' || p_partkey || ['.py', '.ts', '.go', '.java', '.rs', '.txt'][p_partkey % 6 + 1] AS path, p_partkey % 10 = 9 AS broken FROM part)"
ORACLE = {
    "s17_parse_source": f"""WITH {_P} SELECT path, CASE WHEN l = 5 THEN 'unsupported' WHEN broken THEN 'partial' ELSE 'clean' END AS status, CASE WHEN l = 5 OR broken THEN '' ELSE 'L' || k || ',L' || k || '.add,total' || k END AS names,
CASE WHEN l = 5 OR broken THEN '' ELSE ['base:Base', './base:Base', 'fmt:fmt', 'base:Base', 'base:Base'][l + 1] END AS imports FROM p""",
    "s26_name_edges": f"""WITH {_P}, c AS (SELECT * FROM p WHERE l < 5 AND NOT broken) SELECT path, 'L' || k AS symbol, 'Base' AS target, 'inherits' AS kind FROM c WHERE l <> 2 UNION ALL SELECT path, 'L' || k, 'total' || k, 'calls' FROM c WHERE l IN (0, 1, 3) UNION ALL SELECT path, 'L' || k || '.add', 'total' || k, 'calls' FROM c
UNION ALL SELECT path, 'L' || k || '.add', 'L' || k, 'uses_type' FROM c WHERE l IN (1, 2, 4) UNION ALL SELECT path, 'total' || k, 'L' || k, 'uses_type' FROM c WHERE l IN (0, 1, 3, 4) UNION ALL SELECT path, 'total' || k, 'fmt', 'calls' FROM c WHERE l = 2""",
    "s27_symbols": f"""WITH {_P}, c AS (SELECT * FROM p WHERE l < 5 AND NOT broken) SELECT path, 'L' || k AS symbol, 'class' AS kind, '' AS params FROM c UNION ALL SELECT path, 'L' || k || '.add', 'method', CASE l WHEN 0 THEN 'self,o,n' ELSE 'o,n' END FROM c
UNION ALL SELECT path, 'total' || k, CASE l WHEN 3 THEN 'class' ELSE 'function' END, CASE l WHEN 3 THEN '' ELSE 'o' END FROM c""",
    # the same rules, each language with the patterns that its imports have here
    "j2_modules": f"""WITH kn AS ({_KNOWN}), im AS ({_IMPORTS}), h AS (SELECT *, regexp_extract(from_path, '^(.*)/', 1) AS here FROM im),
c AS (SELECT *, CASE WHEN language = 'python' AND module LIKE '..%' THEN regexp_extract(here, '^(.*)/', 1) || '/' || replace(module[3:], '.', '/') || '.py' WHEN language = 'python' AND module LIKE '.%' THEN here || '/' || module[2:] || '.py' WHEN module LIKE './%' THEN here || '/' || replace(module[3:], '.js', '.ts')
  WHEN module LIKE '../%' THEN 'web/' || module[4:] || '/index.ts' WHEN module LIKE 'crate::%' THEN 'core/src/' || replace(module[8:], '::', '/') || '.rs' WHEN module LIKE 'super::%' THEN 'core/src/' || replace(module[8:], '::', '/') || '.rs' WHEN module LIKE 'self::%' THEN here || '/' || module[7:] || '.rs' END AS exact,
  CASE WHEN language = 'python' AND module NOT LIKE '.%' THEN '/' || replace(module, '.', '/') || '.py' WHEN module LIKE '@/%' THEN '/' || module[3:] || '.ts' WHEN language = 'java' THEN '/' || replace(module, '.', '/') || '.java' END AS tail,
  CASE WHEN language = 'java' THEN '/' || lower(replace(module, '.', '/')) WHEN language = 'go' AND contains(module, '/') THEN '/' || string_split(module, '/')[-1] END AS dir FROM h),
d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir FROM kn)
SELECT c.from_path, c.language, c.module, coalesce((SELECT kn.path FROM kn WHERE kn.path = c.exact), (SELECT arg_min(kn.path, (CASE WHEN split_part(kn.path, '/', 1) <> split_part(c.from_path, '/', 1) THEN 0 WHEN split_part(kn.path, '/', 2) <> split_part(c.from_path, '/', 2) THEN -1 WHEN split_part(kn.path, '/', 3) <> split_part(c.from_path, '/', 3) THEN -2 ELSE -3 END, length(kn.path), kn.path)) FROM kn WHERE ends_with('/' || kn.path, c.tail)),
(SELECT arg_min(d.dir, (length(d.dir), d.dir)) || '/' FROM d WHERE ends_with('/' || d.dir, c.dir))) AS path FROM c""",
}
