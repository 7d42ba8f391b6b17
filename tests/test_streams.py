"""Streams give the batch answer however their input is cut into files and batches, replayed or interrupted."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeatlas.streaming import jobs

FILES = "rev STRING, slice STRING, path STRING, sha STRING"
ROWS = f"{FILES}, files BIGINT"


def listings(spark, rng, revs=4):
    rows = []
    for r in range(revs):
        for s in range(5):
            for f in range(rng.randint(1, 9)):
                # Contents change in some slices only, so most slices of a later revision are known.
                rows.append((f"r{r}", f"s{s}", f"s{s}/f{f}", f"sha{f}-{r if s == r else 0}"))
    return spark.createDataFrame(rows, FILES)


def record(fresh):
    return fresh.withColumn("record", F.concat_ws(":", "slice", "fingerprint"))


def cached(spark, cache):
    return sorted(tuple(r) for r in jobs.records(spark, cache).collect())


def deal(spark, rows, folder, rng, pieces):
    """The rows in random pieces, some rows in two of them."""
    rows = [tuple(r) for r in rows.collect()]
    rows += rng.sample(rows, len(rows) // 3)
    rng.shuffle(rows)
    for k in range(pieces):
        spark.createDataFrame(rows[k::pieces], ROWS).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", range(2))
def test_incremental_map_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = listings(spark, rng)
    want = sorted(tuple(r) for r in jobs.map_once(files, record).collect())
    folder, cache, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "checkpoint"))
    deal(spark, jobs.listing(files), folder, rng, rng.randint(2, 6))
    for per_batch in (1, 3):
        jobs.incremental_map(jobs.file_stream(spark, folder, ROWS, "parquet", "*.parquet", per_batch), cache, record, checkpoint)
        assert cached(spark, cache) == want
        deal(spark, jobs.listing(files), folder, rng, 2)   # all of it once more: nothing is new
    jobs.incremental_map(jobs.file_stream(spark, folder, ROWS, "parquet", "*.parquet", 4), cache, record, checkpoint + "-2")
    assert cached(spark, cache) == want   # another stream over the same files, the same cache


def test_incremental_map_waits_for_whole_listings(spark, tmp_path):
    files = listings(spark, random.Random(9), revs=2)
    folder, cache, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "checkpoint"))
    rows = jobs.listing(files)
    late = "rev = 'r1' AND path = 's2/f0'"
    for part in (rows.where("path IS NULL"), rows.where(f"path IS NOT NULL AND NOT ({late})"), rows.where(late)):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, ROWS, "parquet", "*.parquet")
        jobs.incremental_map(stream, cache, record, checkpoint)
        seen, all_of = (df.where("path IS NOT NULL").groupBy("rev").count() for df in (spark.read.schema(ROWS).parquet(folder), rows))
        whole = [r.rev for r in seen.join(all_of, ["rev", "count"]).collect()]
        assert cached(spark, cache) == sorted(tuple(r) for r in jobs.map_once(files.where(F.col("rev").isin(whole)), record).collect())


def test_incremental_map_after_a_failure(spark, tmp_path):
    """The mapper fails after part of its records were written; the next run takes the batch again."""
    files = listings(spark, random.Random(5))
    folder, cache, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "checkpoint"))
    deal(spark, jobs.listing(files), folder, random.Random(6), 3)
    calls = []

    def failing(fresh):
        calls.append(1)
        if len(calls) == 2:
            return record(fresh).withColumn("record", F.expr("if(slice = 's3', raise_error('lost'), record)"))
        return record(fresh)

    def run(mapper):
        jobs.incremental_map(jobs.file_stream(spark, folder, ROWS, "parquet", "*.parquet"), cache, mapper, checkpoint)

    try:
        run(failing)
    except Exception as e:
        assert "lost" in str(e)
    run(record)
    assert cached(spark, cache) == sorted(tuple(r) for r in jobs.map_once(files, record).collect())


def lines(rng, n=400):
    out = []
    for k in range(n):
        blocks = [{"type": rng.choice(["tool_use", "text"]), "name": rng.choice(["Read", "Grep"])} for _ in range(rng.randint(0, 3))]
        kind = rng.choice(["assistant", "assistant", "user", "result"])
        event = {"job": f"j{rng.randint(0, 5)}", "ts": k, "type": kind, "message": {"content": blocks}, "is_error": rng.random() < 0.5,
                 "finished": rng.randint(0, 9), "total": 9}
        out.append(json.dumps(event) if rng.random() < 0.9 else "broken {" + str(k))
    return out


def test_progress_in_batches_and_replayed(spark, tmp_path):
    rng = random.Random(1)
    text = lines(rng)
    want = {tuple(r) for r in jobs.progress(spark.createDataFrame([(x,) for x in text], "value string")).collect()}
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    pieces = [text[k::5] for k in range(5)]
    for piece in pieces:
        spark.createDataFrame([(x,) for x in piece], "value string").coalesce(1).write.mode("append").text(folder)
    stream = jobs.file_stream(spark, folder, "value STRING", "text", "*.txt")
    jobs.run_available(stream, out, jobs.progress_parts, checkpoint)
    now = lambda place: {tuple(r) for r in jobs.progress_of(jobs.read_parts(spark, place, jobs.merge_progress)).collect()}
    assert now(out) == want and spark.read.parquet(out).select("batch").distinct().count() == 5
    # As if the stream had been lost after writing its last batch and before noting so: that batch runs again.
    rows = spark.read.parquet(f"{out}/batch=4").count()
    for name in ("4", ".4.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    jobs.run_available(stream, out, jobs.progress_parts, checkpoint)
    assert now(out) == want and spark.read.parquet(f"{out}/batch=4").count() == rows


def test_a_batch_writes_its_own_keys_only_and_can_run_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "rev string, id string")
    batches = [frame([("r", "a"), ("r", "b"), ("r", "a")]), frame([("r", "b")]), frame([("q", "a"), ("r", "b")])]
    for n, batch in enumerate(batches):
        for _ in range(2):
            jobs.merge_batch(out, jobs.toggle_parts, batch, n)
    state = lambda place: {tuple(r) for r in jobs.reviewed_of(jobs.read_parts(spark, place, jobs.merge_toggles)).collect()}
    assert spark.read.parquet(f"{out}/batch=1").count() == 1
    whole = {tuple(r) for r in jobs.reviewed_state(batches[0].union(batches[1]).union(batches[2])).collect()}
    assert state(out) == whole == {("r", "a", False), ("r", "b", True), ("q", "a", True)}
    into = str(tmp_path / "into")
    jobs.fold(spark, out, into, jobs.merge_toggles, keep="rev <> 'q'")   # settled revisions expire
    jobs.merge_batch(into, jobs.toggle_parts, frame([("r", "b")]), 3)
    assert state(into) == {("r", "a", False), ("r", "b", False)} and spark.read.parquet(f"{into}/batch=-1").count() == 2


def test_progress_expires_with_finished_jobs(spark, tmp_path):
    out, into = str(tmp_path / "out"), str(tmp_path / "into")
    rows = [json.dumps({"job": j, "ts": t, "type": k}) for j, t, k in (("old", 1, "result"), ("old", 0, "user"), ("open", 2, "user"), ("new", 90, "result"))]
    jobs.merge_batch(out, jobs.progress_parts, spark.createDataFrame([(r,) for r in rows], "value string"), 0)
    jobs.fold(spark, out, into, jobs.merge_progress, keep="outcome IS NULL OR last > 50")
    assert {r.job for r in jobs.progress_of(jobs.read_parts(spark, into, jobs.merge_progress)).collect()} == {"open", "new"}
