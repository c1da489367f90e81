"""Byte-level BPE with a hierarchical-bitmap rank queue.

Adjacent pairs of a pre-token wait in one bucket per merge rank, a heap of
places in a linked list of tokens.  A bitmap in two levels marks the ranks
whose buckets hold entries; find-first-set on each level gives the next rank.
Entries whose pair has changed since are skipped.  A pre-token of n bytes takes
O(n log n) steps, so very long ones do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappush
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers in each of two generations, and their
#: longest length; memory only, no result depends on it.
REMEMBERED, SHORT = 400_000, 64
#: Pre-tokens handled at a time, and characters of a text that may be cut into
#: pre-tokens at once.
SPAN, WHOLE = 1 << 17, 1 << 20
#: Ranks per bitmap word, as a power of two, and the bits of a word.
WORD = 8
_BIT = [1 << i for i in range(1 << WORD)]


def load_ranks(name: str = RANKS) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Places by merge rank; the least rank first, then the least place.

    ``buckets`` holds a heap of places per rank, ``words`` a bitmap of the ranks
    with entries per 256 of them, ``top`` a bitmap of the words in use."""

    __slots__ = ("top", "words", "buckets")

    def __init__(self) -> None:
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        w = rank >> WORD
        self.words[w] = self.words.get(w, 0) | _BIT[rank & 255]
        self.top |= 1 << w

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and all its places, in order."""
        top = self.top
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        word ^= low
        self.words[w] = word
        if not word:
            self.top = top ^ (1 << w)
        rank = w << WORD | low.bit_length() - 1
        places = self.buckets.pop(rank)
        if len(places) > 1:
            places.sort()
        return rank, places

    def __bool__(self) -> bool:
        return self.top != 0


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    A bucket is taken whole: what a merge forms is pushed with ranks of its
    own, and a place of the bucket whose pair is gone by then is stale.  Should
    a rank below the bucket's come up, or its own again, the rest waits."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    after.append(n)
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    pair += (-1, -1)
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, r in enumerate(pair):
        if r >= 0:
            push(r, i)
    while queue.top:
        rank, places = pop()
        least = rank + 1
        for at, i in enumerate(places):
            if pair[i] != rank:
                continue  # stale
            if least <= rank:
                for rest in places[at:]:
                    push(rank, rest)
                break
            j = after[i]
            k = after[j]
            after[i], before[k], pair[j] = k, i, -1
            r = pair[i] = get(piece[i : after[k]], -1) if k < n else -1
            if r >= 0:
                push(r, i)
                if r < least:
                    least = r
            p = before[i]
            if p >= 0:
                r = pair[p] = get(piece[p:k], -1)
                if r >= 0:
                    push(r, p)
                    if r < least:
                        least = r
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class _Memory(dict):
    """Pre-token to its ids as text.  At ``REMEMBERED`` entries the memory
    becomes the older of two generations; what is used again moves back."""

    def __init__(self, ranks: dict[bytes, int], texts: dict[int, str]) -> None:
        super().__init__()
        self.ranks, self.texts, self.older = ranks, texts, {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = " ".join(map(self.texts.__getitem__, merge(piece.encode("utf-8", "replace"), self.ranks)))
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Decoded(dict):
    """Ids as text, of one pre-token, to the bytes that they stand for."""

    def __init__(self, bytes_of: dict[str, bytes]) -> None:
        super().__init__()
        self.bytes_of = bytes_of

    def __missing__(self, ids: str) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids.split(" ")))
        if len(out) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[ids] = out
        return out


class Codec:
    """Encodes and decodes whole texts in spans of bounded size."""

    def __init__(self, name: str = RANKS, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex

        self.ranks = load_ranks(name)
        texts = {r: str(r) for r in self.ranks.values()}
        self.memory = _Memory(self.ranks, texts)
        self.bytes_of = {texts[v]: k for k, v in self.ranks.items()}
        self.decoded = _Decoded(self.bytes_of)
        # \s as the tokenizer library reads it: the White_Space property
        text = (pattern or public_tokenizers.PATTERN).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The ids of the text's pre-tokens, decimal, one space between those
        of a pre-token, in spans."""
        ids = self.memory.__getitem__
        if len(text) <= WHOLE:
            if text:
                yield list(map(ids, self.pattern.findall(text)))
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while block := list(islice(found, SPAN)):
            yield list(map(ids, block))

    def encode(self, text: str) -> list[int]:
        return [int(i) for span in self.pieces(text) for piece in span for i in piece.split(" ")]

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by spaces, SHA-256 of what
        the ids decode to."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for span in self.pieces(text):
            if n:
                ids.update(b" ")
            joined = " ".join(span)
            ids.update(joined.encode())
            n += joined.count(" ") + 1
            decoded.update(b"".join(map(self.decoded.__getitem__, span)))
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def shared_codec(name: str = RANKS) -> Codec:
    """One codec per worker process and rank file: later tasks start with what
    earlier ones remember."""
    return Codec(name)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]), one row per
    input row.

    A null text is empty: no tokens, digests of nothing.  Texts are encoded
    whole, however long, and decode to themselves.  Repeated rows give repeated
    rows, a null id keeps its row, other columns are ignored, an empty table
    gives no rows."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(ranks)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            out = pd.DataFrame([codec.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].astype("Int64").to_numpy())
            if with_ids:
                out["ids"] = [codec.encode(t) for t in texts]
                out["decoded"] = [codec.decode(x) for x in out["ids"]]
            yield out

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
