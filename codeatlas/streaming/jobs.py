"""Streams: progress of running jobs, incremental mapping, review marks.

No stream holds its result in memory or rewrites it. A micro-batch leaves one mergeable row for each key it touches, in a folder named by
the batch's id, which a replay of that batch overwrites with the same rows; the current result is the merge of all such rows. Operators are
plain DataFrame functions (a part of the result from rows, and the result from parts), so a batch job over all rows gives the same answer.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.change import FINGERPRINT, fingerprint_sums
from ..session import checkpoint_folder, cut
from ..sources.sinks import cache_misses

Step = Callable[[DataFrame], DataFrame]

# one line of a job's event stream
EVENT = ("job STRING, ts DOUBLE, type STRING, message STRUCT<content: ARRAY<STRUCT<type: STRING, name: STRING>>>, "
         "result STRING, is_error BOOLEAN, finished INT, total INT")


# ---- progress of jobs ---------------------------------------------------------------------------------
def progress_parts(lines: DataFrame) -> DataFrame:
    """One row a job of what some JSON lines (column value) say: (job, calls, reads, finished, total, first, last, outcome). Lines that do
    not parse are skipped. ``outcome`` is the time of the last result event and whether it was an error."""
    e = lines.select(F.from_json("value", EVENT).alias("e")).where("e.job IS NOT NULL").select("e.*")
    used = "filter(coalesce(message.content, array()), c -> c.type = 'tool_use')"
    e = e.withColumn("tools", F.expr(f"CASE WHEN type = 'assistant' THEN {used} ELSE slice({used}, 1, 0) END"))
    return e.groupBy("job").agg(
        F.sum(F.size("tools")).alias("calls"), F.sum(F.expr("size(filter(tools, c -> c.name = 'Read'))")).alias("reads"),
        F.max("finished").alias("finished"), F.max("total").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.expr("max(CASE WHEN type = 'result' AND ts IS NOT NULL THEN struct(ts, coalesce(is_error, false) AS failed) END)").alias("outcome"))


def merge_progress(parts: DataFrame) -> DataFrame:
    """Rows of ``progress_parts`` put together: one a job."""
    return parts.groupBy("job").agg(F.sum("calls").alias("calls"), F.sum("reads").alias("reads"), *[
        f(c).alias(c) for c, f in (("finished", F.max), ("total", F.max), ("first", F.min), ("last", F.max), ("outcome", F.max))])


def progress_of(parts: DataFrame) -> DataFrame:
    """(job, calls, reads, finished, total, elapsed, failed) from merged parts; ``failed`` is null while a job has no result."""
    return parts.selectExpr("job", "calls", "reads", "finished", "total", "last - first AS elapsed", "outcome.failed AS failed")


def progress(lines: DataFrame) -> DataFrame:
    """The progress of all jobs of a table of lines."""
    return progress_of(merge_progress(progress_parts(lines)))


# ---- review marks --------------------------------------------------------------------------------------
def toggle_parts(toggles: DataFrame) -> DataFrame:
    """(rev, id, n): how often each mark was toggled."""
    return toggles.groupBy("rev", "id").agg(F.count("*").alias("n"))


def merge_toggles(parts: DataFrame) -> DataFrame:
    return parts.groupBy("rev", "id").agg(F.sum("n").alias("n"))


def reviewed_of(parts: DataFrame) -> DataFrame:
    return parts.selectExpr("rev", "id", "n % 2 = 1 AS done")


def reviewed_state(toggles: DataFrame) -> DataFrame:
    """(rev, id, done): a mark is on after an odd number of toggles, per head revision."""
    return reviewed_of(merge_toggles(toggle_parts(toggles)))


# ---- a keyed result as a log of parts -------------------------------------------------------------------
def merge_batch(out: str, parts: Step, batch: DataFrame, batch_id: int) -> None:
    """Writes one row for each key of a micro-batch and nothing else. The folder is the batch's own, so running it again changes nothing."""
    parts(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_parts(spark: SparkSession, out: str, merge: Step) -> DataFrame:
    """The merged parts of all batches: one row a key."""
    return merge(spark.read.option("basePath", out).parquet(out).drop("batch"))


def fold(spark: SparkSession, out: str, into: str, merge: Step, keep: str = "true") -> None:
    """Starts a new log ``into`` with one row a key of the old one, without the keys that ``keep`` (SQL over a merged part) lets go: the
    state of settled keys expires here. Run it between two runs of a stream, which then goes on in ``into`` under the same checkpoint."""
    read_parts(spark, out, merge).where(keep).write.mode("overwrite").parquet(f"{into}/batch=-1")


def run_available(stream: DataFrame, out: str, parts: Step, checkpoint: str | None = None) -> str:
    """Runs a stream over everything that has arrived; each micro-batch adds its parts to the log ``out``, which is returned."""
    place = checkpoint or f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True)
             .foreachBatch(lambda batch, batch_id: merge_batch(out, parts, batch, batch_id)).start())
    query.awaitTermination()
    return out


# ---- retention -------------------------------------------------------------------------------------------
def retain(entries: DataFrame, now, ttl_days: int = 7, kept: Sequence[str] = ("part", "label")) -> DataFrame:
    """The cache entries (key, kind, tree, used) to keep at ``now``: used within the time to live, of a kind always kept, or a
    tree that a living map still needs. Uses are reduced to the last one per entry first."""
    last = entries.groupBy("key", "kind", "tree").agg(F.max("used").alias("used"))
    alive = last.withColumn("_live", F.col("kind").isin(*kept) | (F.col("used") >= F.lit(now) - F.expr(f"INTERVAL {ttl_days} DAYS")))
    needed = alive.where("_live AND kind = 'map'").select("tree").distinct().withColumn("_needed", F.lit(True))
    return alive.join(needed, "tree", "left").where("_live OR (kind = 'tree' AND _needed)").select("key", "kind", "tree", "used")


# ---- incremental mapping ----------------------------------------------------------------------------------
BUCKETS = 64
RECORD = "fingerprint STRING, slice STRING, record STRING"
LISTED = "rev STRING, slice STRING, n BIGINT, a DECIMAL(38, 0), b DECIMAL(38, 0), files BIGINT"


def listing(files: DataFrame, by: Sequence[str] = ("rev",)) -> DataFrame:
    """Rows (by, slice, path, sha) with one row more for each revision, which has no path but the number of its files: only with it can a
    reader tell that a listing is whole, in whatever order and pieces its rows arrive."""
    none = F.lit(None).cast("string")
    marks = files.groupBy(*by).agg(F.countDistinct("path").alias("files")).select(
        *by, none.alias("slice"), none.alias("path"), none.alias("sha"), "files")
    return files.select(*by, "slice", "path", "sha", F.lit(None).cast("bigint").alias("files")).unionByName(marks)


def slice_parts(rows: DataFrame) -> DataFrame:
    """(rev, slice, n, a, b, files, bucket): sums over the files of each slice; a mark stands alone, under no slice."""
    sums = fingerprint_sums(rows.where("path IS NOT NULL"), ["rev"]).withColumn("files", F.lit(None).cast("bigint"))
    marks = rows.where("path IS NULL").groupBy("rev").agg(F.max("files").alias("files")).selectExpr(
        "rev", "cast(null AS STRING) AS slice", "0L AS n", "cast(0 AS DECIMAL(38, 0)) AS a", "cast(0 AS DECIMAL(38, 0)) AS b", "files")
    return sums.selectExpr("rev", "slice", "n", "cast(a AS DECIMAL(38, 0)) AS a", "cast(b AS DECIMAL(38, 0)) AS b", "files").unionByName(
        marks).withColumn("bucket", F.expr(f"pmod(xxhash64(rev), {BUCKETS})"))


def whole_slices(parts: DataFrame) -> DataFrame:
    """(slice, fingerprint) of every revision all of whose files are there, each once."""
    whole = parts.groupBy("rev").agg(F.sum("n").alias("n"), F.max("files").alias("files")).where("n = files").select("rev")
    sums = parts.where("slice IS NOT NULL").join(whole, "rev", "left_semi").groupBy("rev", "slice").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.selectExpr("slice", f"{FINGERPRINT} AS fingerprint").distinct()


def first_listed(rows: DataFrame, arrived: str | None = None, keep: str = "30 days") -> DataFrame:
    """Each (rev, path) once, however often it arrives: on a stream, what was seen is Spark's keyed state. With a column ``arrived`` that
    state expires after ``keep``; a row that comes again later is taken for a new one then."""
    if arrived is None:
        return rows.dropDuplicates(["rev", "path"])
    return rows.withWatermark(arrived, keep).dropDuplicatesWithinWatermark(["rev", "path"]).drop(arrived)


def incremental_map(stream: DataFrame, cache: str, mapper: Step, checkpoint: str, arrived: str | None = None) -> None:
    """Maps only what is new: file lists of revisions arrive as rows of ``listing`` in any order, pieces and repetitions; a revision is
    looked at in the batch that completes it. Slices whose fingerprint the cache (parquet folder: fingerprint, slice, record) lacks are
    mapped by ``mapper`` (slice, fingerprint -> fingerprint, slice, record), the others are reused.

    A batch adds the sums of its own rows to a log beside the checkpoint and reads the parts of the buckets of its revisions only. All it
    writes lies in folders of its own, so a batch that failed half way and runs again leaves what one run leaves.
    """
    spark, log = stream.sparkSession, f"{checkpoint}-parts"
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]   # several streams may share a cache
    spark.createDataFrame([], RECORD).write.mode("append").parquet(f"{cache}/batch=none")

    def apply(batch: DataFrame, batch_id: int) -> None:
        session, own = batch.sparkSession, f"{name}-{batch_id}"
        slice_parts(batch).write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch={batch_id}")
        everything = session.read.schema(f"{LISTED}, batch BIGINT, bucket INT").option("basePath", log).parquet(log)
        touched = everything.where(F.col("batch") == batch_id).select("rev", "bucket").distinct()
        parts = cut(everything.join(touched, ["rev", "bucket"], "left_semi"), "listed")
        known = session.read.schema(f"{RECORD}, batch STRING").option("basePath", cache).parquet(cache).where(F.col("batch") != own)
        fresh = cut(cache_misses(whole_slices(parts), known), "fresh")
        mapper(fresh).select("fingerprint", "slice", "record").write.mode("overwrite").parquet(f"{cache}/batch={own}")

    (first_listed(stream, arrived).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def records(spark: SparkSession, cache: str) -> DataFrame:
    """(fingerprint, slice, record) of a cache that ``incremental_map`` filled."""
    return spark.read.option("basePath", cache).schema(f"{RECORD}, batch STRING").parquet(cache).drop("batch")


def map_once(files: DataFrame, mapper: Step) -> DataFrame:
    """What ``incremental_map`` leaves in an empty cache, as one batch job over whole listings (rev, slice, path, sha)."""
    prints = whole_slices(slice_parts(first_listed(listing(files))))
    return mapper(prints).select("fingerprint", "slice", "record")


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", glob: str = "*", per_batch: int = 1) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).format(fmt).load(folder)
