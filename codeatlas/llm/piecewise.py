"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last ``WINDOW`` bytes ends a chunk where it is -1 modulo the block size; each chunk gives one sign. A fingerprint holds
``LEVELS`` signatures, at its block size and its doublings, so texts of somewhat different lengths share one. A signature describes the whole
text: where boundaries come in clusters, so that no block size leaves about ``LONGEST`` signs, it is longer. Likeness is one minus
the edit distance of two signatures of equal block size over the longer one's length, at the best such size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, span_hashes, table

WINDOW, LONGEST, LEAST, LEVELS = 7, 64, 3, 3
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGN = np.frombuffer(SIGNS.encode(), np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """``size:signature:signature:signature`` of each text; the empty text's signatures are empty."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint64), data.astype(np.uint64) + np.uint64(1)])
    rolling = np.zeros(len(data), np.uint64)
    for k in range(WINDOW):
        rolling = rolling * np.uint64(0x100000001B3) + wide[k:k + len(data)]
    rolling = mix(rolling) >> np.uint64(32)
    ends_of, spans, plans = [], [], []
    for i in range(len(raw)):
        s, e = int(offsets[i]), int(offsets[i + 1])
        size = LEAST
        while size * LONGEST < e - s:
            size *= 2
        roll = rolling[s + WINDOW - 1:e]   # windows inside the text only
        while True:
            ends = np.flatnonzero(roll % np.uint64(size) == size - 1)
            if size == LEAST or len(ends) >= LONGEST // 2:
                break
            size //= 2
        while len(ends) >= LONGEST and np.count_nonzero(fewer := roll[ends] % np.uint64(2 * size) == 2 * size - 1) >= LONGEST // 2:
            size, ends = 2 * size, ends[fewer]
        plans.append(size)
        for level in range(LEVELS):
            if level:
                w = np.uint64(size << level)
                ends = ends[roll[ends] % w == w - np.uint64(1)]
            stops = ends + s + WINDOW
            if e > s and (not len(stops) or stops[-1] < e):
                stops = np.append(stops, e)
            ends_of.append(len(stops))
            spans.append((np.concatenate([[s], stops[:-1]]) if len(stops) else stops, stops))
    starts, stops = (np.concatenate([x[k] for x in spans]).astype(np.int64) if spans else np.zeros(0, np.int64) for k in (0, 1))
    signs = _SIGN[(span_hashes(data, starts, stops) >> np.uint64(58)).astype(np.int64)].tobytes().decode() if len(starts) else ""
    at = np.cumsum([0, *ends_of])
    parts = [signs[at[k]:at[k + 1]] for k in range(len(ends_of))]
    return [":".join([str(plans[i]), *parts[LEVELS * i:LEVELS * (i + 1)]]) for i in range(len(raw))]


def _edit_distance(left: str, right: str) -> int:
    """The edit distance of two signatures of any length: bit-parallel in one long number."""
    if not left:
        return len(right)
    peq: dict[str, int] = {}
    for i, c in enumerate(left):
        peq[c] = peq.get(c, 0) | 1 << i
    every, top, score = (1 << len(left)) - 1, 1 << len(left) - 1, len(left)
    up, down = every, 0
    for c in right:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & every
        ph, mh = down | (every & ~(xh | up)), up & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph, mh = (ph << 1 | 1) & every, mh << 1 & every
        up, down = mh | (every & ~(xv | ph)), ph & xv
    return score


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs of signatures: bit-parallel, all pairs of at most 64 signs in step, longer ones each by itself."""
    long = np.array([max(len(x), len(y)) > 64 for x, y in zip(left, right)], bool)
    if long.any():
        out = np.zeros(len(left), np.int64)
        out[long] = [_edit_distance(left[i], right[i]) for i in np.flatnonzero(long)]
        short = np.flatnonzero(~long)
        out[short] = edit_distances([left[i] for i in short], [right[i] for i in short])
        return out
    n = len(left)
    code = np.zeros(256, np.int64)
    code[_SIGN] = np.arange(64)
    peq = np.zeros((n, 64), np.uint64)
    for i, s in enumerate(left):
        for j, c in enumerate(code[np.frombuffer(s.encode(), np.uint8)].tolist()):
            peq[i, c] |= np.uint64(1 << j)
    m = np.array([len(s) for s in left], np.int64)
    k = np.array([len(s) for s in right], np.int64)
    signs = np.zeros((n, max(1, int(k.max(initial=0)))), np.int64)
    for i, s in enumerate(right):
        signs[i, :k[i]] = code[np.frombuffer(s.encode(), np.uint8)]
    one, top = np.uint64(1), np.uint64(1) << np.maximum(m - 1, 0).astype(np.uint64)
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy()
    for t in range(int(k.max(initial=0))):
        eq = peq[np.arange(n), signs[:, t]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        live = t < k
        score += (live & ((ph & top) != 0)).astype(np.int64) - (live & ((mh & top) != 0))
        ph, mh = ph << one | one, mh << one
        up, down = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, k, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 1 for equal ones, 0 if they share no block size."""
    owner, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        (p, *s), (q, *t) = x.split(":"), y.split(":")
        sizes = {int(q) << k: v for k, v in enumerate(t)}
        for k, v in enumerate(s):
            other = sizes.get(int(p) << k)
            if other and v:
                owner.append(i)
                a.append(v)
                b.append(other)
    out = np.zeros(len(left))
    if owner:
        longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
        np.maximum.at(out, np.array(owner), 1 - edit_distances(a, b) / longer)
    out[[x == y for x, y in zip(left, right)]] = 1.0
    return out


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """(ids, texts, next texts) in blocks, from rows sorted by (part, head, doc_id descending); a row with head = 1 only closes its part."""
    ids, texts, nexts, held, chars = [], [], [], None, 0
    for batch in batches:
        cols = {n: batch.column(k).to_pylist() for k, n in enumerate(["part", "head", "doc_id", "text"])}
        for part, head, doc_id, text in zip(*cols.values()):
            if held is not None and held[0] == part:
                ids.append(held[1])
                texts.append(held[2])
                nexts.append(text)
                chars += len(held[2])
            held = None if head else (part, doc_id, text)
            if chars > 1 << 19:
                yield ids, texts, nexts
                ids, texts, nexts, chars = [], [], [], 0
    if ids:
        yield ids, texts, nexts


def document_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) with the next document by descending doc_id.

    Documents are dealt to ranges of doc_id; the first of each range is also sent to the range before it, so every text is shuffled once.
    Null texts count as empty; rows without doc_id come last; rows of equal doc_id follow each other in a fixed order of their texts' hashes (one
    doc_id's rows share a range); the last document's next is the first; a single document is its own next; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted({int(b) for b in rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.002)}, reverse=True)
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.expr("cast(array() AS array<long>)")
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(edges, lambda b: F.col("doc_id") < b)))
    first = rows.select("doc_id", part.alias("part"), F.xxhash64("text").alias("x")).groupBy("part").agg(F.max(F.struct("doc_id", "x")).alias("m"))
    heads = sorted((r["part"], r["m"]["doc_id"], r["m"]["x"]) for r in first.collect())   # one row for each range
    before = {h[0]: heads[k - 1][0] for k, h in enumerate(heads)}
    lists = spark.createDataFrame([(p, before[p], d, x) for p, d, x in heads], "part int, previous int, head_id long, head_x long")
    placed = rows.withColumn("part", part).withColumn("x", F.xxhash64("text")).join(F.broadcast(lists), "part")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("x") == F.col("head_x"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("head"))
    both = placed.withColumn("to", F.explode(F.when(is_head, F.array(own, F.struct(F.col("previous").alias("part"), F.lit(1).alias("head")))).otherwise(F.array(own))))
    dealt = both.select("to.part", "to.head", "doc_id", "text", "x").repartition(n, "part").sortWithinPartitions("part", "head", F.desc_nulls_last("doc_id"), F.desc("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _neighbours(batches):
            changed = [edited(t, f) for t, f in zip(texts, nexts)]
            own, new, after = fingerprints(texts), fingerprints(changed), fingerprints(nexts)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(own), pa.array(new),
                pa.array(likeness(own, new)), pa.array(likeness(own, after))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.select("part", "head", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
