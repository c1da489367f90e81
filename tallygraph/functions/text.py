"""Identifiers in prompts and search commands, paths in patches, and keys of
repository names.  All but the prompt scan are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Identifiers taken from a prompt, and from a search command.
MOST_IN_PROMPT, MOST_IN_SEARCH = 40, 5

# File extensions that make a path, and words that are no names.
EXTENSIONS = (
    "py|pyi|ts|tsx|js|jsx|mjs|cjs|go|rs|java|cs|rb|c|h|cc|cpp|hpp|php"
    "|md|txt|json|jsonl|toml|yaml|yml|sql|html|css|scss|sh|lock|cfg|ini|rst|xml|proto|graphql|env"
)
NO_NAMES = frozenset(
    """
    e.g i.e etc vs python3 python node npm npx git cd ls pytest cargo tests.check readme.md package.json
    add added all also and any are as at awk be been bool build but by can cat change changed clone commit curl debug
    delete dict did diff do does done echo else error false fetch fix fixed for from grep had has have he help her
    his if in info int into is it its just kill len list log make me merge must my new no none not now null of
    off ok okay old on one only open or our out over per print pull push rebase remove removed return run sed self set
    she should start stash status still stop str test tests that the them then these they this those to true two type
    under up update updated via warn was we wget when while will with yes you your
    """.split()
)

_RUN, _ENDS = re.compile(r"[\w./-]+", re.A), re.compile(rf"(?<=[\w-])\.(?:{EXTENSIONS})\b", re.A)
# Patterns whose matches are part of the rules on prompts and
# search commands.
URL = r"(?:https?://|www\.)\S+"
TICKED = r"`([^`\n]{1,200})`"
TICKED_TOKEN = r"[A-Za-z_][\w./:-]*"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
SEARCHES = r"(?:^|[;&|(]\s*)(?:git\s+grep|rg|grep|ag|ack)\b"
SEARCHED = r"(?:git\s+grep|rg|grep|ag|ack)\b([^\n]*)\z"
SEARCH_NAME = r"[A-Za-z_]\w{2,}"

_URL, _TICKED, _TOKEN, _WORD = re.compile(URL), re.compile(TICKED), re.compile(TICKED_TOKEN, re.A), re.compile(WORD)
_CAMEL = re.compile(r"(?=.*[a-z])(?=(?:.*[A-Z]){2})[A-Za-z0-9]{4,}")
_SNAKE = re.compile(r"(?=.*_)(?=.*[A-Za-z])\w{3,}", re.A)
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{7,}", re.I | re.A)
_SHAPE = re.compile(r"(?![-\\])[\w./:-]*[\w:]", re.A)


def _paths(text: str) -> Iterator[str]:
    """Each run of path characters up to its last known extension.  A run is
    read twice at most, however long it is."""
    for run in _RUN.finditer(text):
        ends = [m.end() for m in _ENDS.finditer(run[0])]
        if ends:
            yield run[0][: ends[-1]]


def _coded(word: str) -> bool:
    return bool(_SNAKE.fullmatch(word) or _CAMEL.fullmatch(word))


def _ticked(text: str) -> Iterator[str]:
    """What an author marked: a lone token may be any name, of several each
    must look like code; dotted tokens that are neither are taken apart."""
    for m in _TICKED.finditer(text):
        tokens = _TOKEN.findall(m[1])
        lone = tokens == [m[1].strip()]
        for t in tokens:
            if _coded(t) or next(_paths(t), None) == t or (lone and _named(t)):
                yield t
            else:
                yield from filter(_coded, re.split(r"::|\.", t))


def _named(word: str) -> bool:
    """No acronym, and no word that only begins with a capital."""
    capitals = sum(c.isupper() for c in word)
    small = any(c.islower() for c in word)
    return len(word) >= 3 and bool(_WORD.fullmatch(word)) and (small or not capitals) and not (word[0].isupper() and capitals < 2)


def _prose(text: str) -> Iterator[str]:
    for m in _WORD.finditer(text):
        beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if _coded(m[0]) and not set(beside) & set("/-\\"):
            yield m[0]


def _cleaned(token: str) -> str | None:
    t = token.strip().strip(",;:()").rstrip(".")
    t = t if "/" in t else t.lstrip(".")
    long = len(t) > 128 or (len(t) > 32 and not set(t) & set("_/."))
    if long or "://" in t or not _SHAPE.fullmatch(t) or _HEX.fullmatch(t) or t.lower() in NO_NAMES:
        return None
    return t


def names_in_prompt(prompt: str | None) -> list[str]:
    """Names that a prompt mentions and none of its prose: paths, then marked
    tokens, then words that look like code.  A name that a path before it ends
    in is not repeated; case does not count."""
    text = _URL.sub(" ", prompt or "")
    out, seen = [], set()
    for source in (_paths, _ticked, _prose):
        for t in map(_cleaned, source(text)):
            if t is None or t.lower() in seen:
                continue
            out.append(t)
            if len(out) == MOST_IN_PROMPT:
                return out
            low = t.lower()
            seen |= {low} | {low[i + 1 :] for i, c in enumerate(low) if c == "/"}
    return out


@F.pandas_udf(ArrayType(StringType()))
def prompt_identifiers(prompt: pd.Series) -> pd.Series:
    return pd.Series([names_in_prompt(p) for p in prompt], dtype=object)


_QUOTED = "'[^']+'|\"[^\"]+\""


def search_identifiers(command: Column) -> Column:
    """Names of the first pattern of a search command, quoted before bare; an
    empty list if the command searches nothing."""
    rest = F.regexp_extract(command, SEARCHED, 1)
    bare = F.filter(F.split(F.trim(rest), r"\s+"), lambda t: (t != "") & ~t.rlike(r"^[-.]|/") & ~t.isin("|", "&&", ";"))
    quoted = F.regexp_extract_all(rest, F.lit(_QUOTED), 0)
    pattern = F.coalesce(F.get(quoted, 0), F.get(bare, 0), F.lit(""))
    names = F.slice(F.array_distinct(F.regexp_extract_all(pattern, F.lit(SEARCH_NAME), 0)), 1, MOST_IN_SEARCH)
    return F.when(command.rlike(SEARCHES), names).otherwise(F.array().cast("array<string>"))


#: Line heads of a patch that name a file.
PATCH_HEADS = "Add File:|Update File:|Delete File:|Move to:"


def patch_paths(patch: Column) -> Column:
    """Paths that a patch touches, in the order of first mention."""
    heads = F.transform(F.split(patch, "\n"), lambda line: F.trim(F.regexp_extract(line, rf"^\s*\*\*\* (?:{PATCH_HEADS})(.*?)\s*$", 1)))
    return F.array_distinct(F.filter(heads, lambda p: p != ""))


_BARE_ID = "regexp_replace(lower(trim({x})), '^(https://|http://|ssh://|git://)', '')"


def repo_name(x: str) -> str:
    """SQL of either dialect: the short name that forms of a repository share."""
    s = f"regexp_replace(regexp_replace(replace(replace(regexp_replace({_BARE_ID.format(x=x)}, '^git@', ''), ':', '/'), chr(92), '/'), '/+$', ''), '[.]git$', '')"
    return f"CASE WHEN right({s}, 1) = '/' THEN {s} ELSE regexp_extract({s}, '([^/]*)$', 1) END"


def repo_key(x: str) -> str:
    """SQL of either dialect: host, owner and name, without scheme or branch."""
    s = _BARE_ID.format(x=x)
    tail = f"substr({s}, 5)"
    s = f"CASE WHEN left({s}, 4) <> 'git@' THEN {s} WHEN instr({tail}, ':') = 0 THEN {tail} ELSE concat(substr({tail}, 1, instr({tail}, ':') - 1), '/', substr({tail}, instr({tail}, ':') + 1)) END"
    return f"regexp_replace(regexp_replace(split_part({s}, '#', 1), '/+$', ''), '[.]git$', '')"


def repo_owner(x: str) -> str:
    """SQL of either dialect: the segment before a repository's name, or ''."""
    return f"regexp_extract({repo_key(x)}, '([^/]*)/[^/]*$', 1)"


def machine_folder(x: str) -> str:
    """SQL of either dialect: whether an id is a folder of one machine."""
    return f"(left(trim({x}), 6) = 'local/' OR left(trim({x}), 1) IN ('/', '~', chr(92)) OR regexp_extract(trim({x}), '^([A-Za-z]:)', 1) <> '')"
