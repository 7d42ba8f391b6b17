"""Token ids in a canonical, length-limited Huffman code.

Counts of all ids give code lengths (coin collector, at most ``LIMIT`` bits), the lengths give the canonical code. A file is a set of
independent blocks: whole documents, their id counts, the packed bits, and the bit offset of every ``STEP``-th id. A reader starts at all
offsets of a block at once and takes one id per table look-up.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut
from .common import table, text_blocks

LIMIT, STEP, BLOCK_IDS = 18, 128, 1 << 16
WORD = re.compile(r"[^ \t\n\r]+")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code without lengths over ``limit``; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this limit")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.int64)
    levels, row, leaf = [], coins, np.ones(len(coins), bool)
    for _ in range(limit):
        levels.append(leaf)
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packs])
        order = np.argsort(both, kind="stable")
        row, leaf = both[order], order < len(coins)
    take = 2 * len(coins) - 2
    for leaf in reversed(levels):
        coins_taken = int(leaf[:take].sum())
        out[used[:coins_taken]] += 1
        take = 2 * (take - coins_taken)
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, ties by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.bits = max(1, int(lengths.max(initial=0)))
        widths = 1 << (self.bits - lengths[order])
        first = np.cumsum(widths) - widths
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = first >> (self.bits - lengths[order])
        self.ids = np.zeros(1 << self.bits, np.int64)
        self.ids[: widths.sum()] = np.repeat(order, widths)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(packed bits, bit counts of each run of STEP ids). Codes are added into 64-bit words; one that does not fit gives its rest to the next."""
        n = self.lengths[ids]
        if not len(n):
            return b"", b""
        ends = np.cumsum(n)
        runs = np.add.reduceat(n, np.arange(0, len(n), STEP)).astype("<u2").tobytes()
        at = ends - n
        word, free = at >> 6, 64 - (at & 63) - n   # bits left in the word behind the code; negative: so many go on
        codes = self.codes[ids].astype(np.uint64)
        total = int(ends[-1])
        out = np.zeros((total + 63 >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))   # every word has a code that begins in it, as codes are shorter than words
        head = np.where(free >= 0, codes << np.maximum(free, 0).astype(np.uint64), codes >> np.maximum(-free, 0).astype(np.uint64))
        out[word[first]] = np.add.reduceat(head, first)
        over = np.flatnonzero(free < 0)
        out[word[over] + 1] += codes[over] << (64 + free[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[:total + 7 >> 3], runs

    def decode(self, packed: bytes, runs: bytes, n: int) -> np.ndarray:
        data = np.frombuffer(packed + b"\0\0\0\0", np.uint8).astype(np.int64)
        words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        sizes = np.frombuffer(runs, "<u2").astype(np.int64)
        at = np.cumsum(sizes) - sizes
        out = np.zeros((len(at), STEP), np.int64)
        full = len(at) - (n % STEP > 0)
        for k in range(min(STEP, n)):
            lanes = len(at) if k < (n % STEP or STEP) else full
            p = at[:lanes]
            ids = self.ids[(words[p >> 3] >> (32 - self.bits - (p & 7))) & ((1 << self.bits) - 1)]
            out[:lanes, k] = ids
            at[:lanes] = p + self.lengths[ids]
        return out.ravel()[:n]


class WordIds:
    """Ids of texts by a tokenizers file whose pieces never reach over a space, tab or line end: the words between these are encoded by the library,
    each distinct one of a block once, and remembered in two generations of ``KEPT`` words, so frequent words stay and memory is bounded."""

    KEPT, KEPT_CHARS = 1 << 17, 48

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [WORD.findall(t) for t in texts]
        kept, todo = self.kept, []
        for w in set().union(*words).difference(kept):
            if (ids := self.older.get(w)) is None:
                todo.append(w)
            else:
                kept[w] = ids
        for w, found in zip(todo, self.tool.encode_batch_fast(todo, add_special_tokens=False)):
            kept[w] = array("I", found.ids).tobytes()
        out = [b"".join(map(kept.__getitem__, ws)) for ws in words]
        for w in todo:
            if len(w) > self.KEPT_CHARS:
                del kept[w]
        if len(kept) > self.KEPT:
            self.older, self.kept = kept, {}
        return out


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_ids(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """(doc_id, ids binary): little-endian 32-bit ids of every whole text, ``end`` appended; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, tail = word_ids(tokenizer), b"" if end is None else end.to_bytes(4, "little")
        for part, texts in text_blocks(batches):
            found = tool.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + tail for x in found], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """Occurrences of each id over all rows: partial counts in tasks, one row per id of the vocabulary at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                part = np.bincount(np.frombuffer(x, "<u4"), minlength=len(total))
                part[: len(total)] += total
                total = part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


_FORMAT = "shard int, block int, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, packed binary, runs binary"


def write_ids(ids: DataFrame, path: str) -> np.ndarray:
    """Writes the blocks in ascending doc_id order (rows without doc_id first, ties by their ids) and the code lengths, which it returns.

    A shard is a range of doc_id; ``first`` is the number of ids before a block in its shard. An empty table gives no blocks.
    """
    lengths = code_lengths(id_counts(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, block, first = Code(lengths), TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def close():
            all_ids = np.concatenate(parts)
            packed, runs = code.encode(all_ids)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "n_ids": len(all_ids), "doc_ids": names, "doc_sizes": [len(p) for p in parts],
                                                "packed": packed, "runs": runs}], schema)

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(name)
                parts.append(np.frombuffer(raw, "<u4"))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    block, first, names, parts, held = block + 1, first + held, [], [], 0
        if names:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("doc_sizes", pa.list_(pa.int64())), ("packed", pa.binary()), ("runs", pa.binary())])
    ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, _FORMAT).write.option("compression", "none").parquet(f"{path}/blocks")
    spark = ids.sparkSession
    spark.createDataFrame([(lengths.astype("<u1").tobytes(),)], "lengths binary").write.parquet(f"{path}/code")
    return lengths


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary) from the files: start counts the ids of all documents before it."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], "<u1").astype(np.int64)
    blocks = spark.read.schema(_FORMAT).parquet(f"{path}/blocks")
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())   # one row for each file of the writer
    before, starts = 0, {}
    for shard, n in totals:
        starts[shard] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            for r in b.to_pylist():
                found = code.decode(r["packed"], r["runs"], r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["doc_sizes"])
                at = ends - r["doc_sizes"]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(at + starts[r["shard"]] + r["first"], pa.int64()),
                                                  pa.array([found[s:e].tobytes() for s, e in zip(at, ends)], pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def digests(ids: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in raw], pa.int64()),
                                              pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return ids.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(cut(token_ids(table(spark, sf_dir, "documents"), tokenizer), "token-ids"), path)
    return digests(read_ids(spark, path))
