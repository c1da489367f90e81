"""Scalar functions that Spark's built-ins cannot express, as Arrow UDFs."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .scanners import LANGUAGES, scan

#: Hunks after which a list of changes is cut, lines quoted of each hunk, and
#: characters quoted of a line.
MOST_HUNKS, QUOTED_LINES, QUOTED_CHARS = 8, 4, 160


@F.pandas_udf(DoubleType())
def exact_round(x: pd.Series, places: pd.Series) -> pd.Series:
    """Half-even rounding of the exact binary value: 2.675 to 2 places is 2.67.
    Null, NaN and infinities come back unchanged."""
    return pd.Series([v if pd.isna(v) or v in (float("inf"), float("-inf")) else round(float(v), int(p)) for v, p in zip(x, places)], dtype=float)


def canonical(text: str | None) -> str | None:
    """Compact JSON with sorted keys and ASCII escapes; null if not JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")


def chain_hash(before: str, payload: str) -> str:
    return hashlib.sha256((before + payload).encode()).hexdigest()


def redacted(value, hidden: frozenset[str]):
    """A JSON value without the hidden keys, at every depth."""
    if isinstance(value, dict):
        return {k: redacted(v, hidden) for k, v in value.items() if k not in hidden}
    return [redacted(v, hidden) for v in value] if isinstance(value, list) else value


def redact_json(column, keys: list[str]):
    """Column: JSON text without ``keys`` at any depth; null if not JSON."""
    hidden = frozenset(keys)

    @F.pandas_udf(StringType())
    def redact(text: pd.Series) -> pd.Series:
        clean = text.map(canonical, na_action="ignore")
        return clean.map(lambda t: json.dumps(redacted(json.loads(t), hidden), sort_keys=True, separators=(",", ":")), na_action="ignore")

    return redact(column)


HUNKS = "array<struct<op: string, old_start: int, old_end: int, new_start: int, new_end: int, lines: array<string>>>"


def hunks(old: list[str], new: list[str], lines: list[str]) -> list[tuple]:
    """Changed ranges from old to new line hashes, 1-based and inclusive, with
    a quotation of the new lines.  Nothing for a file not seen before."""
    if not len(old):
        return []
    out: list[tuple] = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, list(old), list(new), autojunk=False).get_opcodes():
        if op == "equal":
            continue
        quote = [x.rstrip()[:QUOTED_CHARS] for x in lines[j1:j2][:QUOTED_LINES]]
        out.append((op, i1 + 1, i2, j1 + 1, j2, quote))
        if len(out) == MOST_HUNKS:
            out.append(("truncated", None, None, None, None, []))
            break
    return out


@F.pandas_udf(StringType())
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """JSON list of ``hunks`` between two texts; a null text has no lines."""
    keys = ("op", "old_start", "old_end", "new_start", "new_end", "lines")

    def one(a, b):
        a, b = [x.split("\n") if isinstance(x, str) and x else [] for x in (a, b)]
        digest = lambda rows: [hashlib.sha1(r.encode("utf-8", "replace")).hexdigest()[:8] for r in rows]
        return json.dumps([dict(zip(keys, h)) for h in hunks(digest(a), digest(b), b)])

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def _signature(node) -> str:
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}({', '.join(ast.unparse(b) for b in node.bases)})"
    lead = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{lead} {node.name}({ast.unparse(node.args)}){back}"


def _uses(node, known: set[str]) -> list[tuple[str, str]]:
    """(name, kind) of what a declaration refers to, the strongest kind each."""
    rank = {"inherits": 0, "calls": 1, "uses_type": 2, "references": 3}
    best: dict[str, str] = {}

    def put(name, kind):
        if name in known and name != node.name and (name not in best or rank[kind] < rank[best[name]]):
            best[name] = kind

    def head(x):
        while isinstance(x, ast.Attribute):
            x = x.value
        return x.id if isinstance(x, ast.Name) else None

    for base in getattr(node, "bases", []):
        put(head(base), "inherits")
    for x in ast.walk(node):
        if isinstance(x, ast.Call):
            put(head(x.func), "calls")
        elif isinstance(x, ast.AnnAssign):
            put(head(x.annotation), "uses_type")
        elif isinstance(x, ast.arg) and x.annotation is not None:
            put(head(x.annotation), "uses_type")
        elif isinstance(x, ast.Name):
            put(x.id, "references")
    return sorted(best.items())


def structure(source: str | None) -> dict:
    """Symbols, imports and doc of Python source.  One syntax error makes the
    status ``partial`` and leaves no symbol; null is an empty file."""
    empty = {"status": "partial", "symbols": [], "imports": [], "doc": ""}
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return empty
    imports, bound = [], set()
    for x in tree.body:
        if isinstance(x, ast.Import):
            imports += [[a.name, a.asname or a.name.split(".")[0], ""] for a in x.names]
            bound |= {a.asname or a.name.split(".")[0] for a in x.names}
        elif isinstance(x, ast.ImportFrom):
            imports += [["." * x.level + (x.module or ""), a.asname or a.name, a.name] for a in x.names]
            bound |= {a.asname or a.name for a in x.names}
    defs = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    top = [x for x in tree.body if isinstance(x, defs)]
    known, symbols = bound | {x.name for x in top}, []

    def add(x, name):
        body = hashlib.sha256(ast.dump(x).encode()).hexdigest()[:24]
        params = [a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs)] if not isinstance(x, ast.ClassDef) else []
        kind = "class" if isinstance(x, ast.ClassDef) else "method" if "." in name else "function"
        symbols.append({"name": name, "kind": kind, "signature": _signature(x), "params": params, "hash": body, "doc": (ast.get_docstring(x) or "").split("\n")[0], "edges": _uses(x, known)})

    for x in top:
        add(x, x.name)
        for y in x.body if isinstance(x, ast.ClassDef) else []:
            if isinstance(y, defs[:2]):
                add(y, f"{x.name}.{y.name}")
    return {"status": "clean", "symbols": symbols, "imports": imports, "doc": (ast.get_docstring(tree) or "").split("\n")[0]}


STRUCTURE = "struct<status: string, symbols: array<struct<name: string, kind: string, signature: string, params: array<string>, hash: string, doc: string, edges: array<array<string>>>>, imports: array<array<string>>, doc: string>"


@F.pandas_udf(StringType())
def _parse(source: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(structure(s if isinstance(s, str) else None)) for s in source], dtype=object)


def structure_of(path: str | None, source: str | None) -> dict:
    """Structure of a file by its extension; of other files ``unsupported``."""
    language = LANGUAGES.get((path or "").rpartition(".")[2].lower())
    if language is None:
        return {"status": "unsupported", "symbols": [], "imports": [], "doc": ""}
    return structure(source) if language == "python" else scan(source or "", language)


@F.pandas_udf(StringType())
def _parse_file(path: pd.Series, source: pd.Series) -> pd.Series:
    text = lambda x: x if isinstance(x, str) else None
    return pd.Series([json.dumps(structure_of(text(p), text(s))) for p, s in zip(path, source)], dtype=object)


def parse_file(path, source):
    """Column: the structure of source in the language of its path."""
    return F.from_json(_parse_file(path, source), STRUCTURE)


def parse_source(column):
    """Column: the structure of Python source, typed as ``STRUCTURE``."""
    return F.from_json(_parse(column), STRUCTURE)


def register(spark) -> None:
    """Makes the functions callable from SQL."""
    for name, f in {"exact_round": exact_round, "canonical_json": canonical_json, "line_diff": line_diff, "parse_source_json": _parse}.items():
        spark.udf.register(name, f)
