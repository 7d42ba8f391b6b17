"""Toxicity by a weighted finite-state pattern grammar.

Words are read clause by clause. Transducers for insults, threats, targets, negation and reported speech run side by side: each holds a
small state, and a clause's weight is its heaviest insult or threat, raised by a target, lowered by a negation shortly before it or by a
verb of speech before it. Insult weights (words, and word beginnings of five letters) are log odds, and
the factors of target, negation and speech are learned too, from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import table
from .jaccard_trees import jaccard_components

TARGETS = frozenset("you your youre they them he she him her tu vous du ihr sie usted ustedes".split())
NEGATIONS = frozenset("not never no isnt arent dont without ne pas jamais nicht kein keine nie nunca".split())
REPORTS = frozenset("said says called quoted wrote claimed dit appelle sagte nannte dijo".split())
THREATS = {"kill": 4.0, "murder": 4.0, "hurt": 2.0, "destroy": 2.0, "tuer": 4.0, "umbringen": 4.0, "matar": 4.0}
TARGETED, NEGATED, REPORTED, REST, REACH = 1.15, 0.3, 0.6, 0.25, 3
SAMPLE, STEM, SMOOTH, SURE, STATED = 100_000, 5, 2.0, 3.5, 20.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """(weights, prior) from rows (doc_id, text, toxic): at most ``sample`` rows (lowest hash of doc_id; all rows of the last doc_id), each class of
    near copies once. The sample is chosen without texts.

    A class's label for a term is the mean of its texts that hold it. Every term whose smoothed log odds exceed the prior's by ``SURE`` standard errors
    has the difference as its weight. The factors of the clause patterns are under "+target", "+negated" and "+reported". Rows with a null text or
    label teach nothing."""
    rows = labelled.where("text IS NOT NULL AND toxic IS NOT NULL")
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    last = rows.select(place.alias("p")).orderBy("p").limit(sample).agg(F.max("p").alias("p")).first().p
    if last is not None:
        rows = rows.where(place <= F.struct(F.lit(last.h).alias("h"), F.lit(last.doc_id).cast("long").alias("doc_id")))
    rows = rows.groupBy(F.xxhash64("text").alias("x")).agg(F.max("toxic").alias("y"), F.first("text").alias("text")).persist()
    near = jaccard_components(rows.select(F.col("x").alias("doc_id"), "text")).select(F.col("doc_id").alias("x"), F.col("component_id").alias("c"))
    near = cut(near.join(near.groupBy("c").agg(F.count("*").alias("size")), "c"), "near")
    rows = rows.join(near, "x")
    n, p = rows.agg(F.countDistinct("c"), F.coalesce(F.sum(F.col("y") / F.col("size")), F.lit(0.0))).first()
    rate = (p + 0.5) / (n + 1)
    prior = math.log(rate / (1 - rate))
    words = rows.select("c", "size", "y", F.expr(r"array_distinct(regexp_extract_all(lower(text), '\\p{L}+', 0))").alias("w"))
    stems = F.transform(F.filter("w", lambda w: F.length(w) >= STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    terms = words.select("c", "size", "y", F.explode(F.array_distinct(F.concat("w", stems))).alias("t"))
    alone = terms.where("size = 1").groupBy("t").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("p"))
    joint = terms.where("size > 1").groupBy("t", "c").agg(F.avg("y").alias("p")).select("t", F.lit(1).cast("long").alias("n"), "p")
    counts = alone.unionByName(joint).groupBy("t").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    toxic, clean = F.col("p") + SMOOTH * rate, F.col("n") - F.col("p") + SMOOTH * (1 - rate)
    weight = F.log(toxic / clean) - prior
    good = counts.select("t", weight.alias("w")).where(weight > SURE * F.sqrt(1 / toxic + 1 / clean)).collect()
    weights = {r.t: r.w for r in good}
    weights |= _factors(rows, weights, prior)
    rows.unpersist()
    return weights, prior


def _factors(rows: DataFrame, weights: dict[str, float], prior: float) -> dict[str, float]:
    """How much a target, negation or verb of speech raises or lowers the log odds of a plain insult or threat: from the heaviest clause of each
    text, a class of near copies counting once, held to the stated factor like ``STATED`` texts that agree with it."""
    plain = {**weights, "+target": 1.0, "+negated": 1.0, "+reported": 1.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [max(clause_weights(t, plain), default=(0.0, None))[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), b.column(1), b.column(2)], ["pattern", "y", "share"])

    found = rows.select("text", F.col("y").cast("double").alias("y"), (1 / F.col("size")).alias("share")).mapInArrow(run, "pattern string, y double, share double")
    seen = [(set(r.pattern.split("+")[1:]), r.n, r.p) for r in found.where("pattern IS NOT NULL").groupBy("pattern").agg(
        F.sum("share").alias("n"), F.sum(F.col("y") * F.col("share")).alias("p")).collect()]
    rate = 1 / (1 + math.exp(-prior))

    def lift(mark: set[str]) -> tuple[float, float]:
        n, p = (sum(s[k] for s in seen if s[0] == mark) for k in (1, 2))
        return n, math.log((p + SMOOTH * rate) / (n - p + SMOOTH * (1 - rate))) - prior

    _, base = lift(set())
    out = {}
    for name, stated in (("target", TARGETED), ("negated", NEGATED), ("reported", REPORTED)):
        n, up = lift({name})
        out["+" + name] = (n * min(2.0, max(0.0, up / base)) + STATED * stated) / (n + STATED) if base > 0 else stated
    return out


def clause_weights(text: str, weights: dict[str, float]) -> list[tuple[float, str]]:
    """(weight, pattern) of each clause that an insult or threat transducer accepts."""
    out, best, kind = [], 0.0, ""
    target = report = False
    since = REACH + 1
    for token in [*_TOKEN.findall(text.lower()), "."]:
        if token in ".!?;:\n":
            if best > 0:
                out.append((best * (weights.get("+target", TARGETED) if target else 1.0), kind + ("+target" if target else "")))
            best, kind, target, report, since = 0.0, "", False, False, REACH + 1
            continue
        since += 1
        if token in NEGATIONS:
            since = 0
        elif token in REPORTS:
            report = True
        elif token in TARGETS:
            target = True
        insult = max(weights.get(token, 0.0), weights.get(token[:STEM] + "*", 0.0) if len(token) >= STEM else 0.0)
        w = max(insult, THREATS.get(token, 0.0))
        if w:
            name = "insult" if insult >= w else "threat"
            if since <= REACH:
                w, name = w * weights.get("+negated", NEGATED), name + "+negated"
            if report:
                w, name = w * weights.get("+reported", REPORTED), name + "+reported"
            if w > best:
                best, kind = w, name
    return out


def score(text: str | None, weights: dict[str, float], prior: float) -> tuple[float, int, str | None]:
    clauses = sorted(clause_weights(text or "", weights), reverse=True)
    z = prior + (clauses[0][0] + REST * sum(w for w, _ in clauses[1:]) if clauses else 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(clauses), clauses[0][1] if clauses else None


def score_toxicity(docs: DataFrame, weights: dict[str, float], prior: float) -> DataFrame:
    """(doc_id, score, n_clauses, pattern) of every whole text. Null and empty texts score the prior; equal rows give equal rows; an empty
    table gives an empty one; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [score(t, weights, prior) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.string())], ["doc_id", "score", "n_clauses", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_clauses long, pattern string")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], float]:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return learn(table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), *fitted(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses", "pattern")


def keep_clean(docs: DataFrame, weights: dict[str, float], prior: float, limit: float = 0.7) -> DataFrame:
    """Documents scoring below ``limit``; rows without doc_id stay."""
    bad = score_toxicity(docs, weights, prior).where(F.col("score") >= limit).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
