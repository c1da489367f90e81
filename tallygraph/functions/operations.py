"""The closed set of typed operations: checks, names, and what commutes.

Everything is a built-in expression over ``map<string, string>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation, operands it needs, operands it may have.
OPERATIONS = {
    "rename": (["symbol", "new_name"], []),
    "add_param": (["symbol", "name"], ["type", "default"]),
    "remove_param": (["symbol", "name"], []),
    "change_return": (["symbol", "type"], []),
    "extract": (["symbol", "new_name"], ["range"]),
    "move": (["symbol", "new_path"], []),
    "delete": (["symbol"], []),
    "add": (["symbol"], ["signature"]),
    "modify": (["symbol"], []),
}
#: Operations that bring in a name beside the one they work on.
NAMING = ["rename", "extract"]


def _field(item: Column, name: str) -> Column:
    return F.trim(F.get_json_object(item, f"$.{name}"))


def _problem(item: Column, at: Column) -> Column:
    place = F.concat(F.lit("operations["), at.cast("string"), F.lit("]"))
    op = F.coalesce(_field(item, "op"), F.lit(""))
    out = F.when(~F.coalesce(item.startswith("{"), F.lit(False)), F.concat(place, F.lit(": not an object")))
    out = out.when(~op.isin(*OPERATIONS), F.concat(place, F.lit(": no operation named '"), op, F.lit("'")))
    for name, (needed, _) in OPERATIONS.items():
        for field in needed:
            missing = F.coalesce(_field(item, field), F.lit("")) == ""
            out = out.when((op == name) & missing, F.concat(place, F.lit(f": {name} needs '{field}'")))
    return out


def _normal(item: Column) -> Column:
    fields = sorted({f for need, may in OPERATIONS.values() for f in need + may})
    op = _field(item, "op")
    uses = lambda f: op.isin(*[n for n, (need, may) in OPERATIONS.items() if f in need + may])
    entries = [F.struct(F.lit("op").alias("key"), op.alias("value"))]
    entries += [F.struct(F.lit(f).alias("key"), F.when(uses(f), _field(item, f)).alias("value")) for f in fields]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def validated(json: Column) -> Column:
    """struct<ops: array<map<string, string>>, error: string> of a JSON list;
    the first problem makes the error, and then there are no ops."""
    items = F.from_json(json, "array<string>")
    error = F.when(~F.coalesce(F.ltrim(json).startswith("["), F.lit(False)) | F.coalesce(F.size(items) < 1, F.lit(True)), F.lit("operations: not a list with items"))
    error = error.otherwise(F.get(F.filter(F.transform(items, _problem), lambda e: e.isNotNull()), 0))
    return F.struct(F.when(error.isNull(), F.transform(items, _normal)).alias("ops"), error.alias("error"))


def names_touched(op: Column) -> Column:
    """The names that an operation lays claim to."""
    both = F.array(op["symbol"], F.when(op["op"].isin(*NAMING), op["new_name"]))
    return F.array_distinct(F.filter(both, lambda n: n.isNotNull() & (n != "")))


def verdict(a: Column, b: Column) -> Column:
    """COMMUTE if no name is shared; else CONFLICT, or UNKNOWN where ranges
    decide or an operation is not of the set."""
    known = F.coalesce(a["op"].isin(*OPERATIONS) & b["op"].isin(*OPERATIONS), F.lit(False))
    shared = F.arrays_overlap(names_touched(a), names_touched(b))
    ranges = (a["op"] == "extract") | (b["op"] == "extract")
    return F.when(~known, "UNKNOWN").when(~shared, "COMMUTE").when(ranges, "UNKNOWN").otherwise("CONFLICT")


def undoes(later: Column, settled: Column) -> Column:
    """Whether ``later`` takes ``settled`` back: a rename the other way, delete
    for add, add for delete, or any move of the same symbol."""
    same = later["symbol"] == settled["symbol"]
    pair = lambda x, y: (later["op"] == x) & (settled["op"] == y)
    swapped = (later["symbol"] == settled["new_name"]) & (later["new_name"] == settled["symbol"])
    back = (pair("rename", "rename") & swapped) | ((pair("add", "delete") | pair("delete", "add") | pair("move", "move")) & same)
    return F.coalesce(back, F.lit(False))


def conflicts(intents: DataFrame, owner: str, by: str = "scope") -> DataFrame:
    """(scope, mine, theirs, verdict): ids of intents of ``owner`` and of others
    whose operations do not commute.  ``intents``: scope, id, owner, op (map).
    Only rows that share a name meet, so no scope is compared at large."""
    named = intents.select(by, "id", "owner", "op", F.explode(names_touched(F.col("op"))).alias("name"))
    a, b = named.alias("a"), named.alias("b")
    met = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.owner") == owner) & (F.col("b.owner") != owner))
    return met.select(F.col(f"a.{by}").alias(by), F.col("a.id").alias("mine"), F.col("b.id").alias("theirs"), verdict(F.col("a.op"), F.col("b.op")).alias("verdict")).distinct()
