"""Session helpers: a local session for tests, and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("codeatlas")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


STATIC_BROADCAST = 16 << 10   # bytes by files; rows read from columnar files and laid out can be a thousand times that


def measured_joins(spark: SparkSession) -> None:
    """Joins of the session broadcast a side for its measured size, not for its files'.

    Before a query runs Spark knows only the sizes of files, and a compressed file of 5 MB may hold a million rows that become a gigabyte on the
    driver. So only very small files are broadcast at once; other sides are shuffled first, and Spark turns a join into a broadcast one
    if the shuffled rows turn out to be fewer bytes than the limit set by the session's owner.
    """
    limit, running = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(running, None) is None:
        spark.conf.set(running, spark.conf.get(limit))
        # a limit below this one, or none (-1), stays
        if spark.conf.get(limit).strip() != "-1":
            spark.conf.set(limit, str(STATIC_BROADCAST))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local session without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="codeatlas-")
            context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written to the checkpoint folder and read back: computed once, without lineage, safe when
    executors are lost. Written as a table, so later joins see its size and can broadcast it when small."""
    path = f"{checkpoint_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_paths = [path]
    return out


@contextmanager
def small_tables(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind when they end, and their tables are packed tighter: for jobs that write what they go on with."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def once(df: DataFrame, label: str = "once") -> DataFrame:
    """``df`` itself when it is a written table already, else cut: for inputs an operator reads several times."""
    return df if getattr(df, "cut_paths", None) else cut(df, label)


def together(frames: list[DataFrame]) -> DataFrame:
    """The union of frames; written ones of the same columns are read as one table, so plans stay small however
    many rounds a loop takes."""
    first = frames[0]
    if all(getattr(f, "cut_paths", None) and f.schema == first.schema for f in frames):
        paths = [p for f in frames for p in f.cut_paths]
        out = first.sparkSession.read.schema(first.schema).parquet(*paths)
        out.cut_paths = paths
        return out
    out = first
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
