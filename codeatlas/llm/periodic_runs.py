"""Periodic runs of words, found by recursive frequency splitting.

A run repeats its period at least four times, so each of its words occurs at least four times in any segment that holds the run. Words that are
rarer than that within their segment split it; the parts have fewer words again, and so on until nothing more splits. Few segments survive. These
are scanned lag by lag: a run of period q holds three equal neighbouring blocks that begin at multiples of q, so a lag needs only one block hash
for each multiple, and all lags of a segment of m words need about m log m. What a lag finds is then compared and extended word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix, powers, table, text_blocks

REPEATS, SHORTEST = 4, 6   # a run's length in periods, and in words, at least


def splits(words: Sequence, repeats: int = REPEATS, shortest: int = SHORTEST) -> Iterator[tuple[int, int]]:
    """[start, end) of the segments, of ``shortest`` words or more, in which every word occurs ``repeats`` times or more.

    Of a split segment the longest part keeps the counts, less those of the other parts, and those are counted anew: each word is counted
    again only when its segment has at most halved, so the whole takes about n log n steps however deep the splitting goes.
    """
    counts = Counter(words)
    cuts = [i for i, w in enumerate(words) if counts[w] < repeats]
    work, where = [(0, len(words), counts, cuts)], None
    while work:
        start, end, counts, cuts = work.pop()
        if not cuts:
            if end - start >= shortest:
                yield start, end
            continue
        edges = [start - 1, *cuts, end]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a > shortest]
        if not parts:
            continue
        if where is None:
            where = defaultdict(list)
            for a, b in parts:
                for i in range(a, b):
                    where[words[i]].append(i)
        longest = max(parts, key=lambda p: p[1] - p[0])
        for a, b in parts:
            if (a, b) != longest:
                fresh = Counter(words[a:b])
                work.append((a, b, fresh, [i for i in range(a, b) if fresh[words[i]] < repeats]))
        a, b = longest
        if 2 * (b - a) < end - start:
            counts = Counter(words[a:b])
            rare = [w for w, n in counts.items() if n < repeats]
        else:
            touched = set()
            for s, e in ((start, a), (b, end)):
                for w in words[s:e]:
                    counts[w] -= 1
                    touched.add(w)
            rare = [w for w in touched if 0 < counts[w] < repeats]
        work.append((a, b, counts, sorted(i for w in rare for i in where[w][bisect_left(where[w], a):bisect_left(where[w], b)])))


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on are equal in a row, forwards (step 1) or backwards (-1); b is the later place."""
    most = len(x) - b if step > 0 else a + 1
    done, look = 0, 16
    while done < most:
        look = min(look, most - done)
        if step > 0:
            equal = x[a + done:a + done + look] == x[b + done:b + done + look]
        else:
            equal = (x[a - done - look + 1:a - done + 1] == x[b - done - look + 1:b - done + 1])[::-1]
        if not equal.all():
            return done + int(equal.argmin())
        done, look = done + look, look * 2
    return done


def lag_scan(x: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment of word numbers, by period."""
    m, out = len(x), []
    up, down = powers(m + 1)
    running = np.zeros(m + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * up[:m], out=running[1:])
    far, root = np.zeros(m, np.int64), np.ones(m, np.int64)   # of the known run over each place that ends last: its end and period
    for q in range(1, m // repeats + 1):
        at = running[::q]
        block = (at[1:] - at[:-1]) * down[:m:q][:len(at) - 1]
        equal = block[1:] == block[:-1]
        equal = equal[1:] & equal[:-1]
        if not equal.any():
            continue
        found = np.flatnonzero(equal) * q
        # Three periods of q within a known run whose period divides q are that run again, not one of smallest period q.
        found = found[(far[found] < found + 3 * q) | (q % root[found] != 0)]
        end = 0
        for i in found.tolist():
            if i + 3 * q <= end:
                continue
            start = i - _same(x, i - 1, i + q - 1, -1) if i else 0
            end = i + q + _same(x, i, i + q, 1)
            if end - start >= max(shortest, repeats * q):
                out.append((start, end - start, q))
                later = far[start:end] < end
                far[start:end][later], root[start:end][later] = end, q
    return out


def word_runs(words: Sequence) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    out = []
    for a, b in splits(words):
        names: dict = {}
        x = np.array([names.setdefault(w, len(names)) for w in words[a:b]], np.int64)
        out += [(a + s, n, q) for s, n, q in lag_scan(x)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: Sequence, runs: list[tuple[int, int, int]]) -> Sequence:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def repeated(words: list, key: str | None) -> list:
    """The words, for a tenth of the keys with a stretch at the end replaced by repetitions of its first words."""
    n, h = len(words), zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a:a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[:n - a]


RUNS = "doc_id long, n_runs long, runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string"


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, runs, n_words, collapsed): all runs of every whole text, and its kept words joined by one space.

    A run is a stretch of words with smallest period q, at least 4 * q and 6 words long, that neither neighbour extends. Words are
    ``[^\\x20\\x09-\\x0D]+``. ``plant`` first replaces the ends of a tenth of the texts by repetitions, chosen by doc_id; texts without doc_id stay.
    Null and empty texts have no words; equal rows give equal rows; an empty table gives an empty one; other columns are not read. A row needs
    memory in proportion to its own text.
    """
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            names, found, sizes, kept = part.column(0).to_pylist(), [], [], []
            for name, text in zip(names, texts):
                words = (text or "").encode("utf-8", "surrogatepass").split()   # bytes split at these six characters alone
                if plant:
                    words = repeated(words, None if name is None else str(name))
                runs = word_runs(words)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                sizes.append(len(words))
                kept.append(b" ".join(kept_words(words, runs)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(found, kinds), pa.array(sizes, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_runs", "runs", "n_words", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def strongest(runs: str) -> str:
    """SQL of the run with the greatest exact length / period; ties go to the smallest start, then the smallest period."""
    better = "r.length * m.period > m.length * r.period"   # the runs come by start and period, so the first of equal ones stays
    return f"aggregate({runs}, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (m, r) -> CASE WHEN m IS NULL OR {better} THEN r ELSE m END)"


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the whole texts."""
    found = document_runs(table(spark, sf_dir, "documents"), plant=True).selectExpr("*", f"{strongest('runs')} AS best")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.selectExpr("doc_id", "n_runs", "best.start", "best.length", "best.period", "1000 * best.length div best.period AS exponent_milli",
                            f"sha2({lines}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256")
