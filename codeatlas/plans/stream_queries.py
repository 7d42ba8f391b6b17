"""Queries over streams: the driver's tables are written as stream files, or streamed as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpoint_folder
from ..streaming import jobs
from .registry import query


def scratch(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("l1_progress", "", """
    WITH e AS (SELECT 'job' || user_id % 4 AS job, event_id, event_type, user_id FROM events WHERE event_id % 10 <> 9)
    SELECT job, CAST(coalesce(sum(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END), 0) AS BIGINT) AS calls,
      count(*) FILTER (event_type = 'view') AS reads, max(event_id % 7) AS finished, 7 AS total, CAST(max(event_id) - min(event_id) AS BIGINT) AS elapsed,
      arg_max(event_id % 3 = 0, event_id) FILTER (event_type = 'purchase') AS failed FROM e GROUP BY job""")
def progress(t):
    """Events as a job's JSON lines, every tenth of them broken, read as a text stream."""
    folder = scratch(t, "lines")
    blocks = ("CASE event_type WHEN 'view' THEN '[{\"type\": \"tool_use\", \"name\": \"Read\"}, {\"type\": \"tool_use\", \"name\": \"Grep\"}]' "
              "WHEN 'click' THEN '[{\"type\": \"text\"}, {\"type\": \"tool_use\", \"name\": \"Glob\"}]' ELSE '[]' END")
    t.events.selectExpr(
        f"CASE WHEN event_id % 10 = 9 THEN concat('oops {{', event_id) ELSE concat('{{\"job\": \"job', user_id % 4, '\", \"ts\": ', event_id, ', \"type\": \"', "
        f"CASE WHEN event_type = 'purchase' THEN 'result' ELSE 'assistant' END, '\", \"message\": {{\"content\": ', {blocks}, '}}, \"is_error\": ', event_id % 3 = 0, "
        "', \"finished\": ', event_id % 7, ', \"total\": 7}') END AS value").repartition(4).write.text(folder)
    stream = jobs.file_stream(t.spark, folder, "value STRING", "text", "*.txt", per_batch=2)
    out = jobs.run_available(stream, scratch(t, "progress"), jobs.progress_parts)
    return jobs.progress_of(jobs.read_parts(t.spark, out, jobs.merge_progress)).withColumn("elapsed", F.col("elapsed").cast("bigint"))


@query("l2_incremental_map", "base head", """
    WITH b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS slice, count(*) AS n, bit_xor(hash(path || sha)) AS h FROM base GROUP BY 1),
    h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS slice, count(*) AS n, bit_xor(hash(path || sha)) AS h FROM head GROUP BY 1)
    SELECT slice, count(*) AS records FROM (SELECT * FROM b UNION SELECT * FROM h) GROUP BY slice""")
def incremental_map(t):
    """Two revisions arrive in pieces of both, then everything once more: the cache holds one record per distinct slice content."""
    folder, cache, checkpoint = scratch(t, "files"), scratch(t, "cache"), scratch(t, "checkpoint")
    both = [df.selectExpr(f"'{rev}' AS rev", f"{S.folder_of('path')} AS slice", "path", "sha") for rev, df in (("base", t.base), ("head", t.head))]
    rows = jobs.listing(both[0].unionByName(both[1]))
    mapper = lambda fresh: fresh.withColumn("record", F.concat(F.lit("part "), "slice"))
    for _ in range(2):
        rows.repartition(4, F.xxhash64("path")).write.mode("append").parquet(folder)
        stream = jobs.file_stream(t.spark, folder, "rev STRING, slice STRING, path STRING, sha STRING, files BIGINT", "parquet", "*.parquet", per_batch=2)
        jobs.incremental_map(stream, cache, mapper, checkpoint)
    return jobs.records(t.spark, cache).groupBy("slice").agg(F.count("*").alias("records"))


@query("l3_retain", "", """
    WITH e AS (SELECT 'k' || user_id AS key, ['map', 'tree', 'part', 'note'][user_id % 4 + 1] AS kind, 't' || user_id // 8 AS tree, ts + INTERVAL (-(user_id % 20)) DAY AS used FROM events),
    l AS (SELECT key, kind, tree, max(used) AS used FROM e GROUP BY 1, 2, 3), a AS (SELECT *, kind = 'part' OR used >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS live FROM l)
    SELECT key, kind, tree FROM a WHERE live OR (kind = 'tree' AND tree IN (SELECT tree FROM a WHERE live AND kind = 'map'))""")
def retain(t):
    entries = t.events.selectExpr("concat('k', user_id) AS key", "get(array('map', 'tree', 'part', 'note'), cast(user_id % 4 AS INT)) AS kind", "concat('t', user_id div 8) AS tree",
                                  "ts - make_dt_interval(cast(user_id % 20 AS INT)) AS used")
    now = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    return jobs.retain(entries, now).select("key", "kind", "tree")


@query("l4_reviewed_state", "", """
    SELECT event_type AS rev, 'fn' || user_id AS id, count(*) % 2 = 1 AS done FROM events GROUP BY 1, 2""")
def reviewed_state(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).selectExpr("event_type AS rev", "concat('fn', user_id) AS id")
    out = jobs.run_available(stream, scratch(t, "marks"), jobs.toggle_parts)
    return jobs.reviewed_of(jobs.read_parts(t.spark, out, jobs.merge_toggles))
