"""Near copies from a Jaccard similarity on: what ``simhash.keep_one`` does if
a similarity is asked for.

SimHash fingerprints of the shingle sets propose links by pigeonhole blocks.  Bits
of 64 reach the nearer copies only (a similarity of 0.8 differs in ten bits or so),
so the minima of the sets propose the rest, in bands that miss a near pair with a
probability of (1 - similarity ** BAND_ROWS) ** BANDS, 3 in a million at 0.8.
Within a component of proposals all pairs are compared by their whole shingle
sets, and only a spanning forest of the pairs that are similar enough leaves it.
Texts with equal sets are collapsed before any join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
SEED = 42
#: Largest component that one task compares as a whole, in texts and in
#: characters; larger ones are dealt out as pairs of chunks of this size.
GROUP, GROUP_CHARS = 1024, 1 << 23
#: Shingles hashed, and postings counted, at a time.
SPAN, POSTINGS = 1 << 12, 1 << 20


def shingle_set(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the text's word shingles, of all its
    words if there are fewer; words as in ``simhash.fingerprint``."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        ends.append(at + len(w))
        at += len(w) + 1
    n = min(shingle, len(words)) - 1
    return np.unique(np.array([xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[n:])], dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_fingerprint(found) -> int:
    """Signed 64-bit SimHash of a shingle set; 0 for an empty one."""
    import numpy as np

    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(found), SPAN):
        ones += np.unpackbits(found[lo : lo + SPAN].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(found)).astype(np.uint8)).view(np.int64)[0])


def band_keys(found) -> list[int]:
    """A key for each band of the set's minima; none for an empty set."""
    import numpy as np
    import xxhash

    if not len(found):
        return []
    rng = np.random.default_rng(SEED)
    mul = rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(found), SPAN):
        x = (found[lo : lo + SPAN] ^ add[:, None]) * mul[:, None]
        least = np.minimum(least, x.min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(rows)]


def _signatures(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in batches:
            out = []
            for i, k, t in zip(part["id"].tolist(), part["k"].tolist(), part["text"].tolist()):
                found = shingle_set(t, shingle)
                out.append((i, k, _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)), set_fingerprint(found), band_keys(found), len(t)))
            yield pd.DataFrame(out, columns=["id", "k", "g", "fp", "keys", "chars"])

    return run


def similar(sets: list, similarity: float):
    """Boolean matrix of the pairs of sorted sets with that Jaccard similarity."""
    import numpy as np

    n, size = len(sets), np.array([len(x) for x in sets])
    _, gid = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(gid, kind="stable")]
    count = np.bincount(gid)
    first, bounds = np.cumsum(count) - count, np.concatenate(([0], np.cumsum(size)))
    near, step = np.zeros((n, n), dtype=bool), max(1, POSTINGS // n)
    for i in range(n):
        both = np.zeros(n, dtype=np.int64)
        for lo in range(bounds[i], bounds[i + 1], step):
            g = gid[lo : min(lo + step, bounds[i + 1])]
            c = count[g]
            at = np.repeat(first[g] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            both += np.bincount(owner[at], minlength=n)
        near[i] = both / np.maximum(size[i] + size - both, 1) >= similarity
    np.fill_diagonal(near, False)
    return near


def _verified(shingle: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        keys = ["component", "c", "d"]
        def once() -> Iterator[pd.DataFrame]:  # of repeated rows one, so that a group is no longer than its classes
            last = None
            for b in batches:
                x = b[[*keys, "g"]].to_numpy()
                new = np.ones(len(x), dtype=bool)
                new[1:] = (x[1:] != x[:-1]).any(axis=1)
                if len(x):
                    new[0] = last is None or (x[0] != last).any()
                    last = x[-1]
                yield b[new]

        for part in common.whole_groups(once(), keys, rows=GROUP_CHARS, size=lambda b: int(b["text"].str.len().sum())):
            out = []
            for _, x in part.groupby(keys, sort=False):
                if len(x) > 1:
                    g = x["g"].tolist()
                    near = similar([shingle_set(t, shingle) for t in x["text"]], similarity)
                    out += [(g[a], g[b]) for a, b in common.forest(near, np.arange(len(g)))]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """(id, k, first), one row per input row with an id: the hash of its text
    and the least (id, k) of the component of texts linked by a similarity of
    ``similarity`` or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null").withColumn("k", F.xxhash64("text"))
    base = common.cut(rows.mapInPandas(_signatures(shingle), "id long, k long, g long, fp long, keys array<long>, chars long"))
    classes = common.cut(base.groupBy("g").agg(F.min(F.struct("id", "k")).alias("f"), F.count("*").alias("many"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.max("chars").alias("chars")))
    keyed = classes.select("g", F.explode("keys").alias("key"))
    least = common.cut(keyed.groupBy("key").agg(F.min("g").alias("m"), F.max("g").alias("l"), F.count("*").alias("n")).where("m <> l").select("key", "m", "n"))
    by_bands = common.keyed_join(keyed, least, ["key"], "n").select(F.col("g").alias("a"), F.col("m").alias("b"))
    # sets of one fingerprint go by the least of them
    marks = common.cut(classes.where(F.size("keys") > 0).groupBy("fp").agg(F.min("g").alias("m"), F.count("*").alias("n")))
    same = common.keyed_join(classes.where(F.size("keys") > 0).select("fp", "g"), marks, ["fp"], "n").select(F.col("g").alias("a"), F.col("m").alias("b"))
    links = simhash.hamming_links(marks.select("fp")).toDF("x", "y")
    near = links.join(marks.select(F.col("fp").alias("x"), F.col("m").alias("a")), "x").join(marks.select(F.col("fp").alias("y"), F.col("m").alias("b")), "y").select("a", "b")
    proposed = common.connected_components(by_bands.union(same).union(near))
    member = common.cut(proposed.join(classes, F.col("node") == F.col("g")).select("g", "component", "chars", F.col("f.id").alias("id"), F.col("f.k").alias("k")))
    parts = member.groupBy("component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    parts = common.cut(parts.select("component", "n", F.ceil(F.greatest(F.col("n") / group, F.col("chars") / GROUP_CHARS)).cast("int").alias("p")))
    own = F.pmod(F.xxhash64("g"), F.col("p")).cast("int")
    dealt = common.keyed_join(member, parts, ["component"], "n").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    dealt = dealt.select("id", "k", "g", "component", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"))
    # a class sends the text of one row to each of its chunks
    asked = dealt.groupBy("id", "k").agg(F.collect_list(F.struct("component", "c", "d", "g")).alias("to"))
    texts = rows.join(asked, ["id", "k"]).select(F.explode("to").alias("x"), "text").select("x.*", "text")
    texts = texts.repartition("component", "c", "d").sortWithinPartitions("component", "c", "d", "g")
    comp = common.connected_components(texts.mapInPandas(_verified(shingle, similarity), "a long, b long"))
    named = common.cut(classes.join(comp, classes.g == comp.node, "left").select("g", "many", "f", F.coalesce("component", "g").alias("root")))
    by_root = common.cut(named.groupBy("root").agg(F.min("f").alias("first"), F.count("*").alias("size")))
    by_set = common.cut(common.keyed_join(named.select("g", "many", "root"), by_root, ["root"], "size").select("g", "many", "first"))
    return common.keyed_join(base.select("id", "k", "g"), by_set, ["g"], "many").select("id", "k", "first")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id), one row per input row with an id; ``options`` as of
    ``linked``.  Null and wordless texts are one class."""
    return linked(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))
