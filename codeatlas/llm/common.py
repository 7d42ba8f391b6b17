"""Shared pieces of the training-data operators: tables, word and shingle hashes, small codecs, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, is_empty

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240501)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end): differences of a running polynomial, shifted back to place 0."""
    up, down = powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts, A-Z lower-cased: their hashes in order, and where each text's begin."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
        white = WHITE[data]
        before = np.ones(len(data), bool)
        before[1:] = white[:-1]
        self.starts = np.flatnonzero(~white & before)
        self.ends = np.flatnonzero(white & ~before)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.raw, self.offsets = raw, offsets

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the k-word shingles of each text in order; a text of fewer words has one, its whole sequence."""
        h, counts = self.hashes, np.diff(self.bounds)
        n = max(0, len(h) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += h[j:j + n] * _PLACE[j]
        rolled = mix(rolled)
        per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        bounds = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=bounds[1:])
        out = np.empty(bounds[-1], np.uint64)
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], per)
        long = np.repeat(counts >= k, per)
        out[long] = rolled[at[long]]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            s, e = self.bounds[i], self.bounds[i + 1]
            out[bounds[i]] = mix(np.array([(h[s:e] * _PLACE[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s)], np.uint64))[0]
        return out, bounds


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = Words(texts).shingles(k)
    return [np.unique(h[bounds[i]:bounds[i + 1]]) for i in range(len(texts))]


def blocks(lengths: list[int], most: int = 1 << 18) -> Iterator[slice]:
    """Consecutive rows holding about ``most`` characters together, at least one row each: bounds memory, not results."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts) in blocks of about ``most`` characters."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        for s in blocks([len(t or "") for t in texts], most):
            yield batch.slice(s.start, s.stop - s.start), texts[s]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of neighbouring rows with equal keys; batches must be sorted by them. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield current, pa.Table.from_batches(held)
                held, start, current = [], i, key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): connected components of edges (a, b), component being the smallest node.

    Distributed union-find by contraction: in each round every node hooks to the neighbour (or itself) of smallest random
    rank, chains are shortened once, and the edges move to the hooks. Rounds grow with the logarithm of the longest path.
    Each round is a table in the checkpoint folder. Nulls and self-loops link nothing; an empty table gives an empty one.
    """
    left = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), label)
    maps, k = [], 0
    while not is_empty(left):
        near = left.union(left.select("b", "a")).toDF("node", "next")
        hook = near.groupBy("node").agg(F.min(F.struct(F.xxhash64("next", F.lit(k)).alias("rank"), "next")).alias("m")).select(
            "node", F.when(F.col("m.rank") < F.xxhash64("node", F.lit(k)), F.col("m.next")).otherwise(F.col("node")).alias("hook"))
        hook = cut(hook, label)
        jump = hook.join(hook.select(F.col("node").alias("hook"), F.col("hook").alias("up")), "hook").select("node", F.col("up").alias("hook"))
        jump = cut(jump, label)
        maps.append(jump)
        to = lambda side: jump.select(F.col("node").alias(side), F.col("hook").alias(f"{side}2"))  # noqa: E731, B023
        left = cut(left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), label)
        k += 1
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].toDF("node", "component")
    for m in maps[1:]:
        out = (out.join(m.select(F.col("node").alias("component"), "hook"), "component", "left")
               .select("node", F.coalesce("hook", "component").alias("component")))
    out = cut(out, label)
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select("node", F.col("least").alias("component"))
