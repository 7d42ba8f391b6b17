"""Byte-level BPE by a rank queue.

Every pair of neighbouring parts waits in the bucket of its merge rank. A hierarchical bitmap marks the buckets that hold something, so the lowest
rank is a few find-first-set steps away whatever the length of the text; a bucket gives its leftmost position first. Parts are a linked list over
byte positions. A merge changes the pairs on both sides; their old entries stay behind in their buckets and are skipped when they come up.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_blocks

LISTED = 1 << 12   # from this length on a piece's list is held in arrays of 8 bytes a place: slower a step, a quarter of the memory
KEPT, KEPT_CHARS = 3 << 17, 32   # how many encodings a generation of a worker's memory holds (about 200 bytes each), and of pieces how long


def _packed(numbers) -> array:
    return array("q", numbers)


class Kept(dict):
    """The encodings (bytes of 32-bit ids) of pieces met before; others are encoded as they are asked for. Short pieces are kept in two generations
    of ``KEPT`` each: when the younger one is full it takes the older one's place, so frequent pieces stay and memory is bounded."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encodes and decodes by a rank file (base64 of a token's bytes, its rank). ``pattern`` splits texts into pieces."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # The queue: a bucket of positions a rank, a bit a bucket, and a bit for each word of those bits. With words of half the bits of a
        # rank, two levels do for any vocabulary. The queue is empty after each piece, so one serves all.
        self.half = max(1, (len(self.tokens).bit_length() + 1) // 2)
        self.bits = [1 << k for k in range(1 << self.half)]
        self.buckets: list[list[int]] = [[] for _ in self.tokens]
        self.words = [0] * (1 << self.half)
        self.kept = Kept(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: a whole token as it is, else the leftmost pair of lowest rank is merged until none is left."""
        rank_of, n = self.ranks.get, len(piece)
        if (whole := rank_of(piece)) is not None:
            return [whole]
        buckets, words, bits, half = self.buckets, self.words, self.bits, self.half
        low, top = (1 << half) - 1, 0
        held = list if n < LISTED else _packed
        after, before = held(range(1, n + 2)), held(range(-1, n))   # the place n ends the list
        waits = held([-1]) * (n + 1)   # the rank under which the pair that begins here waits; -1: none
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                waits[i] = rank
                buckets[rank].append(i)   # rising positions are a heap
                words[rank >> half] |= bits[rank & low]
                top |= bits[rank >> half]
        at = -1
        while top:
            if at < 0:
                at = (top & -top).bit_length() - 1   # find first set: the word, then the rank in it
            word = words[at]
            rank = at << half | ((word & -word).bit_length() - 1)
            bucket, lowest = buckets[rank], rank
            while bucket and lowest == rank:   # a merge can make a pair of lower rank, which then goes first
                i = heappop(bucket)
                if waits[i] != rank:
                    continue   # stale: a neighbour was merged since
                middle = after[i]
                after[i] = end = after[middle]
                before[end] = i
                waits[middle] = -1
                left = before[i]
                if left >= 0:
                    new = rank_of(piece[left:end])
                    if new is None:
                        waits[left] = -1
                    else:
                        waits[left] = new
                        heappush(buckets[new], left)
                        words[new >> half] |= bits[new & low]
                        top |= bits[new >> half]
                        if new < lowest:
                            lowest = new
                new = rank_of(piece[i:after[end]]) if end < n else None
                if new is None:
                    waits[i] = -1
                else:
                    waits[i] = new
                    heappush(buckets[new], i)
                    words[new >> half] |= bits[new & low]
                    top |= bits[new >> half]
                    if new < lowest:
                        lowest = new
            if not bucket:
                words[at] ^= bits[rank & low]
                if not words[at]:
                    top ^= bits[at]
                    at = -1
            if lowest < rank:
                at = -1   # the lowest rank may stand in an earlier word
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i:after[i]]))
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Its pieces and ids are held together, so memory grows with this text alone."""
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.pattern.findall(text))), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_bytes(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, without special tokens; with ``decoded`` also the bytes (binary) that the ids stand
    for, looked up from the ids alone.

    ``ranks`` is a rank file that every executor has at that path. Null and empty texts have no ids and no bytes; equal rows give equal rows, a null
    doc_id stays null; an empty table gives an empty one; other columns are not read. A row needs memory in proportion to its own text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(ranks, pattern)
        for part, texts in text_blocks(batches):
            ids = [tool.encode(t or "") for t in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)   # a block's ids are fewer than 2**31
            columns = [part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))]
            if decoded:
                columns.append(pa.array([tool.decode(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode_bytes(ids: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids of each row stand for; no ids (or null) give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(ranks, pattern)
        for batch in batches:
            # A slice of the batch for about a million ids bounds what is held of the decoded bytes.
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(np.cumsum(sizes) >> 20, prepend=-1))
            for start, end in zip(first, [*first[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                found = [tool.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the whole texts: ids joined by one space, and the bytes they decode to."""
    import public_tokenizers
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_bytes(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True).selectExpr(
        "doc_id", "cast(size(ids) AS BIGINT) AS n_tokens", "sha2(array_join(ids, ' '), 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
