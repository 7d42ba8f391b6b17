"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity of weighted shingles.

A window similar enough to an item holds most of its shingles in benchmark shingles, so only such windows are fingerprinted: an exact
bound, not a sample. A fingerprint within ``RADIUS`` of an item's agrees with it up to RADIUS // 8 bits in one of eight bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, table, text_blocks

K, PERCENT, RADIUS, ITEMS = 5, 80, 23, 20_000


def simhash(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Items:
    """Items of one word count: shingle counts, fingerprints, and for each byte place which items lie near each value."""

    def __init__(self, ids: list, hashes: list[np.ndarray]):
        self.ids, self.bags = ids, [Counter(h.tolist()) for h in hashes]
        self.prints = np.concatenate([simhash(_signs(h).sum(axis=0, keepdims=True)) for h in hashes])
        flips = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        self.near = [flips[:, self.prints[:, b]] <= RADIUS // 8 for b in range(8)]

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs within the radius."""
        found = np.zeros((len(prints), len(self.ids)), bool)
        for b in range(8):
            found |= self.near[b][prints[:, b]]
        w, i = np.nonzero(found)
        close = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return np.column_stack([w[close], i[close]])


def _index(rows: list[tuple]) -> dict[int, tuple[np.ndarray, dict[int, Items]]]:
    """By shingle length: all benchmark shingles, and the items by word count."""
    words = Words([t for _, t in rows])
    by: dict[int, dict[int, list]] = {}
    counts = np.diff(words.bounds)
    for k in {min(K, int(n)) for n in counts if n}:
        h, bounds = words.shingles(k)
        for i, n in enumerate(counts.tolist()):
            if n and min(K, n) == k:
                by.setdefault(k, {}).setdefault(n, []).append((rows[i][0], h[bounds[i]:bounds[i + 1]]))
    return {k: (np.unique(np.concatenate([h for items in sizes.values() for _, h in items])), {n: Items([i for i, _ in items], [h for _, h in items]) for n, items in sizes.items()})
            for k, sizes in by.items()}


def _search(texts: list, index) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item id, similarity, first word, words): the best window of each text and item."""
    words = Words(texts)
    counts = np.diff(words.bounds)
    for k, (known, sizes) in index.items():
        h, bounds = words.shingles(k)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hits = np.concatenate([[0], np.cumsum(known[at] == h)])
        for d in np.flatnonzero((hits[bounds[1:]] > hits[bounds[:-1]]) & (counts >= k)).tolist():
            own, run = h[bounds[d]:bounds[d + 1]], hits[bounds[d]:bounds[d + 1] + 1]
            total = None
            for n, items in sizes.items():
                m = n - k + 1
                size = min(m, len(own))   # a text shorter than the item is one window
                starts = np.flatnonzero((100 + PERCENT) * (run[size:] - run[:-size]) >= PERCENT * (size + m))
                if not len(starts):
                    continue
                if total is None:
                    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(own), axis=0, dtype=np.int32)])
                best: dict[int, tuple] = {}
                for w, i in items.candidates(simhash(total[starts + size] - total[starts])).tolist():
                    s = int(starts[w])
                    bag, other = Counter(own[s:s + size].tolist()), items.bags[i]
                    common = (bag & other).total()
                    both = size + m - common
                    if 100 * common >= PERCENT * both and common / both > best.get(i, (0,))[0]:
                        best[i] = (common / both, s)
                for i, (sim, s) in best.items():
                    yield d, items.ids[i], sim, s, size + k - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): benchmark items that a text holds at 0.8 or more over counted 5-word shingles
    (items of fewer words: the whole sequence), with the best window of each; a text shorter than the item is its one window. The benchmark is searched in blocks of about ``most_items``.

    Null and empty texts and items match nothing; repeated rows give repeated rows; rows without doc_id keep a null one; an empty table on
    either side gives no rows; other columns are not read.
    """
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    parts = max(1, -(-rows.count() // most_items))
    out = None
    for part in range(parts):
        index = _index([tuple(r) for r in rows.where(f"pmod(xxhash64(item_id, text), {parts}) = {part}").collect()])

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b, texts in text_blocks(batches):
                ids = b.column(0).to_pylist()
                found = list(_search(texts, index))
                yield pa.RecordBatch.from_arrays([pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                                  pa.array([f[2] for f in found], pa.float64()), *[pa.array([f[k] for f in found], pa.int64()) for k in (3, 4)]],
                                                 ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark item; rows without doc_id stay."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
