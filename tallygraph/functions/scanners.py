"""Declarations of source in languages with braces or ``end``, by scanning.

Comments and strings are blanked, brackets are matched, and declarations are
read at the top level and one level inside a type.  Source whose brackets do
not match, or whose string or comment does not end, is ``partial`` and has no
symbols.  What a declaration refers to is kept if it is declared in the file or
imported, with the strongest kind.
"""

from __future__ import annotations

import hashlib
import re

#: Extension to language.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust",
    "cs": "c_sharp", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "py": "python",
}
_SCRIPT = ("javascript", "typescript", "tsx")
_NAME = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|export|default|pub(?:\([^)]*\))?|unsafe|const|inline|extern|readonly|partial|synchronized)\s+)*"
_TYPES = {
    "javascript": r"(?:class|interface|enum)", "typescript": r"(?:class|interface|enum|type)", "tsx": r"(?:class|interface|enum|type)", "go": r"type", "java": r"(?:class|interface|enum|record)",
    "rust": r"(?:struct|enum|trait|impl|union)", "c_sharp": r"(?:class|interface|enum|struct|record)", "php": r"(?:class|interface|trait|enum)", "c": r"(?:struct|enum|union)", "cpp": r"(?:class|struct|enum|union)", "ruby": r"(?:class|module)",
}
_FUNCTION = {
    "go": rf"func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<of>{_NAME})[^)]*\)\s*)?(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*(?P<params>\()",
    "rust": rf"{_MODS}fn\s+(?P<name>{_NAME})\s*(?:<[^>]*>)?\s*(?P<params>\()", "php": rf"{_MODS}function\s+&?(?P<name>{_NAME})\s*(?P<params>\()",
    "ruby": r"def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)\s*(?P<params>\(?)",
}
_FUNCTION |= dict.fromkeys(_SCRIPT, rf"{_MODS}(?:function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>]*>)?\s*(?P<params>\()|(?:const|let|var)\s+(?P<arrow>{_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?P<params2>\()(?=[^;{{]*=>))")
_FUNCTION |= dict.fromkeys(("java", "c_sharp", "c", "cpp"), rf"{_MODS}(?:[\w<>\[\],.:?*&\s]+?[\s*&])(?P<name>{_NAME})\s*(?P<params>\()")
_METHOD = {k: rf"{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>{_NAME})\s*(?:<[^>]*>)?\s*(?P<params>\()" for k in _SCRIPT}
_IMPORT = {
    "go": r"""^\s*(?:import\s+)?(?:(?P<as>[\w.]+)\s+)?"(?P<module>[^"]+)"\s*$""", "java": r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+?)(?:\.(?P<name>\w+|\*))?\s*;", "rust": r"^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+?)(?:::(?P<name>\w+|\*|\{[^}]*\}))?(?:\s+as\s+(?P<as>\w+))?\s*;",
    "c_sharp": r"^\s*using\s+(?P<module>[\w.]+)\s*;", "php": r"^\s*use\s+(?P<module>[\w\\]+?)(?:\\(?P<name>\w+))?(?:\s+as\s+(?P<as>\w+))?\s*;", "c": r"""^\s*#\s*include\s+["<](?P<module>[^">]+)[">]""", "cpp": r"""^\s*#\s*include\s+["<](?P<module>[^">]+)[">]""", "ruby": r"""^\s*require(?:_relative)?\s*\(?['"](?P<module>[^'"]+)['"]""",
}
_IMPORT |= dict.fromkeys(_SCRIPT, rf"""^\s*import\s+(?:type\s+)?(?:(?P<default>{_NAME})\s*,?\s*)?(?:\*\s+as\s+(?P<star>{_NAME})|\{{(?P<names>[^}}]*)\}})?\s*(?:from\s+)?['"](?P<module>[^'"]+)['"]""")
_NOT_NAMES = frozenset("if for while switch catch return new else do try throw await typeof sizeof function fn func match loop super this".split())
_WORDS = re.compile(r"[\w$]*")
_RANK = {"inherits": 0, "calls": 1, "uses_type": 2, "references": 3}


class Broken(ValueError):
    """Source that does not close what it opens."""


def blanked(source: str, language: str) -> str:
    """``source`` with comments and strings as blanks, line ends kept."""
    hashes = language in ("ruby", "php")
    out, i, n = list(source), 0, len(source)

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two, c = source[i : i + 2], source[i]
        if two == "//" and language != "ruby" or c == "#" and hashes and source[i + 1 : i + 2] != "[":
            end = source.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
        elif two == "/*" and language != "ruby":
            end = source.find("*/", i + 2)
            if end < 0:
                raise Broken("comment")
            end += 2
            blank(i, end)
        elif c == '"' or c == "`" and language in (*_SCRIPT, "go") or c == "'" and language in (*_SCRIPT, "php", "ruby"):
            end = i + 1
            while end < n and source[end] != c:
                if source[end] == "\n" and c != "`" and language not in ("php", "ruby", "rust"):
                    raise Broken("string")
                end += 2 if source[end] == "\\" and not (c == "`" and language == "go") else 1
            if end >= n:
                raise Broken("string")
            end += 1
            blank(i, end)
        elif c == "'" and (m := re.match(r"'(?:\\.[^']*|[^'\\])'", source[i : i + 12])):  # a character, not a lifetime
            end = i + m.end()
            blank(i, end)
        else:
            end = i + 1
        i = end
    return "".join(out)


def matched(code: str) -> dict[int, int]:
    """Place of each opening bracket to that of its end."""
    pairs, open_, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, c in enumerate(code):
        if c in "([{":
            open_.append(i)
        elif c in ")]}":
            if not open_ or code[open_[-1]] != pairs[c]:
                raise Broken("bracket")
            out[open_.pop()] = i
    if open_:
        raise Broken("bracket")
    return out


def _ruby_end(code: str, start: int) -> int:
    depth = 0
    for m in re.finditer(r"(?m)^\s*(class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|\n]*\|)?\s*$|\bend\b", code[start:]):
        depth += -1 if m[0].strip() == "end" else 1
        if depth == 0:
            return start + m.end()
    raise Broken("end")


def _params(text: str, language: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            part = part.split("=")[0].strip()
            if language in ("java", "c_sharp", "c", "cpp"):
                name = re.findall(r"[A-Za-z_]\w*", part)[-1:] if " " in part or "*" in part else []
            else:
                name = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"^(?:mut|&|\.\.\.|public|private|protected|readonly|\s)+", "", part.split(":")[0]))[:1]
                if language == "php":
                    name = [re.findall(r"\$(\w+)", part)[0]] if "$" in part else []
            out += name
            part = ""
        else:
            part += c
    return out


def _doc(source: str, start: int) -> str:
    """First line of the comment that ends right before ``start``."""
    before = source[:start].rstrip(" \t")
    lines, text = before.split("\n")[:-1], []
    while lines and re.match(r"\s*(///?|#(?!\[|include)|\*|/\*)", lines[-1]):
        text.append(lines.pop())
    for line in reversed(text):
        clean = re.sub(r"^\s*(/\*+|\*/|\*|///?!?|#)\s?|\*/\s*$", "", line).strip()
        if clean:
            return clean
    return ""


def _imports(source: str, language: str) -> tuple[list[list[str]], set[str]]:
    out, bound = [], set()
    inside = re.sub(r"(?s)import\s*\((.*?)\)", lambda m: m[1], source) if language == "go" else source
    for m in re.finditer(_IMPORT[language], inside, re.M):
        g, module = m.groupdict(), m["module"]
        if language in _SCRIPT:
            pairs = [(g["default"], "default")] * bool(g["default"]) + [(g["star"], "*")] * bool(g["star"])
            for x in filter(None, (y.strip() for y in (g["names"] or "").split(","))):
                a, _, b = x.removeprefix("type ").partition(" as ")
                pairs.append((b.strip() or a.strip(), a.strip()))
        elif g.get("name", "") and g["name"].startswith("{"):
            pairs = [(x.split(" as ")[-1].strip(), x.split(" as ")[0].strip()) for x in g["name"][1:-1].split(",") if x.strip()]
        else:
            last = g.get("name") or re.split(r"[/.:\\]", module)[-1]
            pairs = [(g.get("as") or last, g.get("name") or "")]
        out += [[module, local, original] for local, original in pairs or [("", "")]]
        bound |= {local for local, _ in pairs if local and local != "*"}
    return out, bound


def _bases(language: str, head: str) -> list[str]:
    if language == "rust":
        m = re.match(rf"impl\s*(?:<[^>]*>)?\s*({_NAME})[^{{]*?\bfor\b", head)
        return [m[1]] if m else re.findall(_NAME, head.split(":", 1)[1]) if head.startswith("trait") and ":" in head else []
    if language in ("c_sharp", "cpp"):
        return [x for x in re.findall(_NAME, head.split(":", 1)[1]) if x not in ("public", "private", "protected", "virtual")] if ":" in head else []
    if language == "ruby":
        return re.findall(r"<\s*([A-Z]\w*)", head)
    m = re.search(r"\b(?:extends|implements)\b(.*)", head, re.S)
    return [x for x in re.findall(_NAME, re.sub(r"<[^>]*>", "", m[1])) if x not in ("extends", "implements")] if m else []


def _edges(name: str, head: str, body: str, bases: list[str], known: set[str], language: str) -> list[list[str]]:
    best: dict[str, str] = {}

    def put(x: str, kind: str) -> None:
        if x in known and x != name and (x not in best or _RANK[kind] < _RANK[best[x]]):
            best[x] = kind

    for x in bases:
        put(x, "inherits")
    text = head + body
    for m in re.finditer(rf"(?<![\w$.])({_NAME})((?:\.|::)({_NAME}))?\s*\(", text):
        put(m[1], "calls")
    for m in re.finditer(rf"(?:[:<,(&*]|->|\bnew\b|\bas\b)\s*({_NAME})\b", head):
        put(m[1], "uses_type")
    for m in re.finditer(rf"(?m)(?:^|[;{{(,])\s*(?:final\s+|const\s+|let\s+)?({_NAME})(?:<[^>;]*>)?\s+{_NAME}\s*[=;,)]", text):
        put(m[1], "uses_type")
    if language == "go":  # a name stands before its type
        for m in re.finditer(rf"(?m)\b{_NAME}\s+\*?(?:\[\])?\*?({_NAME})\s*(?=[,;)}}]|$)", text):
            put(m[1], "uses_type")
    if language == "rust":
        for m in re.finditer(rf"&\s*(?:'\w+\s+)?(?:mut\s+)?({_NAME})", text):
            put(m[1], "uses_type")
    for m in re.finditer(rf"(?:^|[^:]):\s*({_NAME})\b", text):
        put(m[1], "uses_type")
    for x in re.findall(_NAME, text):
        put(x, "references")
    return [list(x) for x in sorted(best.items())]


def scan(source: str, language: str) -> dict:
    """Structure of ``source``: status, symbols, imports and doc, shaped like
    that of Python source."""
    try:
        code = blanked(source, language)
        ends = {} if language == "ruby" else matched(code)
    except Broken:
        return {"status": "partial", "symbols": [], "imports": [], "doc": ""}
    imports, bound = _imports(source, language)
    found: list[tuple] = []

    def body_of(at: int, stop: int) -> tuple[int, int]:
        """Start and end of what a declaration from ``at`` holds."""
        if language == "ruby":
            return at, _ruby_end(code, at)
        i = at
        while i < stop and code[i] not in "{;":
            i = ends.get(i, i) + 1 if code[i] in "([" else i + 1
        return (i, ends[i] + 1) if i < stop and code[i] == "{" else (i, min(i + 1, stop))

    def read(lo: int, hi: int, owner: str) -> None:
        types = re.compile(rf"{_MODS}(?P<type>{_TYPES[language]})\s+(?:<[^>]*>\s*)?(?P<name>{_NAME})")
        funcs = re.compile(_METHOD[language] if owner and language in _SCRIPT else _FUNCTION[language])
        i = lo
        while i < hi:
            if code[i] in "([{" and language != "ruby":
                i = ends[i] + 1
                continue
            if not (code[i].isalpha() or code[i] in "_$*~") or i and (code[i - 1].isalnum() or code[i - 1] in "_$."):
                i += 1
                continue
            m = types.match(code, i, hi)
            if m:
                a, b = body_of(i if language == "ruby" else m.end(), hi)
                head, name, kind = code[i : a if a > i else code.find("\n", i)], m["name"], m["type"]
                bases = _bases(language, head.strip())
                if kind == "impl":
                    target = re.search(rf"\bfor\s+({_NAME})", head)
                    read(a + 1, b - 1, target[1] if target else name)
                    found.append((None, name if not target else target[1], head, "", bases, [], i))
                else:
                    found.append(("class" if kind != "type" or language == "go" else "type", name, " ".join(source[i : i + len(head)].split()), code[a:b], bases, [], i))
                    if not owner:
                        start = code.find("\n", i) if language == "ruby" else a + 1
                        read(start, b - 3 if language == "ruby" else b - 1, name)
                i = max(b, i + 1)
                continue
            m = funcs.match(code, i, hi)
            g = m.groupdict() if m else {}
            name = (g.get("name") or g.get("arrow") or "") if m else ""
            if m and name not in _NOT_NAMES:
                at = m.start("params") if g.get("params") else m.start("params2") if g.get("params2") else -1
                close = ends.get(at, m.end()) if at >= 0 else m.end()
                if language == "ruby" and at >= 0 and code[at : at + 1] == "(":
                    close = code.find(")", at)
                a, b = body_of(i if language == "ruby" else close, hi)
                head = source[i:a] if language != "ruby" else source[i : source.find("\n", i)]
                held = owner or g.get("of") or ""
                found.append(("method" if held else "function", f"{held}.{name}" if held else name, " ".join(head.split()).rstrip(" ={"), code[a:b], [], _params(source[at + 1 : close], language) if at >= 0 else [], i))
                i = max(b, close + 1)
                continue
            i = max(i + 1, _WORDS.match(code, i).end())

    try:
        read(0, len(code), "")
    except Broken:
        return {"status": "partial", "symbols": [], "imports": [], "doc": ""}
    known = bound | {name for kind, name, *_ in found if kind and "." not in name}
    extra = {}
    for kind, name, _, _, bases, _, _ in found:
        if kind is None:
            extra.setdefault(name, []).extend(bases)
    symbols = []
    for kind, name, signature, body, bases, params, at in sorted((f for f in found if f[0]), key=lambda f: f[6]):
        digest = hashlib.sha256(" ".join((signature + body).split()).encode()).hexdigest()[:24]
        symbols.append({"name": name, "kind": kind, "signature": signature, "params": params, "hash": digest, "doc": _doc(source, at), "edges": _edges(name, signature, body, bases + extra.get(name, []), known, language)})
    return {"status": "clean", "symbols": symbols, "imports": imports, "doc": _doc(source, len(source) - len(source.lstrip())) or (re.sub(r"^\s*(//+|/\*+|#)\s?", "", source.split("\n")[0]).strip() if re.match(r"\s*(//|/\*|#(?!include))", source) else "")}
