"""Source files, their lines and their contents (files table: path, content, size, sha)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"   # without the line feed


def below(root: str, place: str = "_metadata.file_path") -> str:
    """SQL: a file's path relative to ``root``. Needs the file's metadata only, so a filter on it is decided when folders are listed."""
    start = "/" + re.sub(r"^[A-Za-z][\w+.-]*:/*", "", root).strip("/") + "/"
    plain = f"url_decode(replace({place}, '+', '%2B'))"
    return f"substring({plain}, instr({plain}, {S.text(start)}) + {len(start)})"


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files below ``root``: path relative to it, size, blob hash, content; files in ignored folders are listed but never opened.

    Without ``content`` no file is held in a cell: files are read in blocks and hashed piece by piece, so they may be of any size.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = raw.where(f"NOT {S.is_ignored(below(root))}").withColumn("path", F.expr(below(root)))
    if content:
        return listed.select("path", F.col("length").alias("size"), blob_sha(F.col("content")).alias("sha"), "content")
    # files that readers of lines would unpack are hashed whole
    packed = f"path rlike {S.text(PACKED)}"
    whole = listed.where(packed).select("path", F.col("length").alias("size"), blob_sha(F.col("content")).alias("sha"))
    plain = listed.where(f"NOT {packed}").select("path", F.col("length").alias("size")).join(blob_hashes(spark, root), "path", "left")
    # readers of lines find no row in a file that is empty or holds a byte order mark only
    rowless = F.expr("CASE size " + " ".join(f"WHEN {n} THEN '{hashlib.sha1(b'blob %d' % n + bytes(1) + MARK[:n]).hexdigest()}'" for n in (0, len(MARK))) + " END")
    return plain.select("path", "size", F.coalesce("sha", rowless).alias("sha")).union(whole)


MARK = b"\xef\xbb\xbf"   # byte order mark
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|bgz|passthrough)$"


def blob_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha) of every file below ``root`` that is not empty or packed, as ``blob_sha`` gives it, without holding a file in a cell: its rows are
    read in blocks by many tasks and come in order to the task that hashes it. What stands between two line feeds must fit a task."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).where(f"NOT {S.is_ignored(below(root))}")
    rows = raw.selectExpr(f"{below(root)} AS path", "_metadata.file_block_start AS _block", "_metadata.file_size AS _size",
                          "monotonically_increasing_id() AS _id", "cast(value AS BINARY) AS _row").where(f"NOT path rlike {S.text(PACKED)}")
    return rows.repartition("path").sortWithinPartitions("path", "_block", "_id").mapInArrow(_hash_rows, "path STRING, sha STRING")


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a file from its rows in order. The reader drops line feeds and a byte order mark at the start; the size tells whether there
    were a mark and a last line feed, so both beginnings are hashed."""
    path, hashes, size, fed = None, [], 0, 0

    def ended() -> pa.RecordBatch:
        marked, feed = divmod(size - fed, len(MARK))
        if feed > 1 or marked > 1:
            raise ValueError(f"{path}: {fed} bytes read of {size}")
        h = hashes[marked]
        h.update(b"\n" * feed)
        return pa.RecordBatch.from_pydict({"path": [path], "sha": [h.hexdigest()]})

    for batch in batches:
        for p, n, row in zip(batch.column("path").to_pylist(), batch.column("_size").to_pylist(), batch.column("_row")):
            row = row.as_buffer()
            if p != path:
                if path is not None:
                    yield ended()
                path, size, fed = p, n, 0
                hashes = [hashlib.sha1(b"blob %d\0" % n + start) for start in (b"", MARK)]
            else:
                fed += 1
                for h in hashes:
                    h.update(b"\n")
            fed += len(row)
            for h in hashes:
                h.update(row)
    if path is not None:
        yield ended()


def read_lines(spark: SparkSession, root: str, probe: int = 8000) -> DataFrame:
    """(path, line_no, text) of every text file below ``root``, as ``explode_lines`` gives them, without holding a file in a cell: a large file
    is read in blocks by many tasks, lines are numbered inside blocks and shifted by the counts of earlier ones. One line must fit a task.

    Rows end at line feeds; what other line breaks a row holds divides it further. Files with a NUL byte near the start yield no lines.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).where(f"NOT {S.is_ignored(below(root))}")
    rows = raw.selectExpr(f"{below(root)} AS path", "_metadata.file_block_start AS _block", "_metadata.file_size AS _size", "value AS _row",
                          "monotonically_increasing_id() AS _id", "cast(octet_length(value) + 1 AS BIGINT) AS _bytes")   # ids rise along a block
    pieces = lambda row: f"split({row}, {S.text(OTHER_BREAK)})"
    # A line feed takes a carriage return before it along; a last row without line feed keeps its own and adds no empty line behind it.
    fed = r"regexp_replace(_row, '\\r\\z', '')"
    split_row = rows.withColumn("_lines", F.expr(pieces(fed)))
    block = split_row.groupBy("path", "_block").agg(F.sum(F.size("_lines")).alias("_n"), F.sum("_bytes").alias("_b"), F.max("_size").alias("_size"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)   # a row a block, not a line
    whole = Window.partitionBy("path")
    shifts = block.select("path", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"), F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_start"),
                          (F.sum("_b").over(whole) > F.col("_size")).alias("_open"), (F.max("_block").over(whole) == F.col("_block")).alias("_last"))
    inside = Window.partitionBy("path", "_block").orderBy("_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (split_row.withColumn("_line", F.coalesce(F.sum(F.size("_lines")).over(before), F.lit(0)))
              .withColumn("_at", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).withColumn("_end", F.lead("_id").over(inside).isNull())
              .join(shifts, ["path", "_block"]).withColumn("_at", F.col("_at") + F.col("_start")))
    marked = placed.withColumn("_nul", F.expr(f"_at < {probe} AND instr(left(_row, {probe} - _at), '\0') > 0"))
    binary = marked.where("_nul").select("path").distinct()
    kept = F.expr("CASE WHEN _open AND _last AND _end THEN " + S.bind(pieces("_row"), "ls", "CASE WHEN size(ls) > 1 AND element_at(ls, -1) = '' THEN "
                                                                      "slice(ls, 1, size(ls) - 1) ELSE ls END") + " ELSE _lines END")
    return (marked.join(binary, "path", "left_anti").select("path", "_shift", "_line", F.posexplode(kept).alias("_k", "text"))
            .select("path", (F.col("_shift") + F.col("_line") + F.col("_k") + 1).cast("int").alias("line_no"), "text"))


def blob_sha(content):
    """The content hash of a file as version control computes it: sha1 over 'blob <size>\\0<content>'."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(raw).cast("string"), F.lit("\0")).cast("binary"), raw))


def is_binary(content, probe: int = 8000):
    """A NUL byte near the start."""
    return F.instr(F.substring(content.cast("binary"), 1, probe).cast("string"), "\0") > 0


def split_lines(content: str = "content") -> str:
    """SQL: the array of lines of a text; a final line break adds no empty line."""
    return S.bind(f"split({content}, {S.text(LINE_BREAK)})", "ls",
                  "CASE WHEN element_at(ls, -1) = '' THEN slice(ls, 1, size(ls) - 1) ELSE ls END")


def explode_lines(files: DataFrame, content: str = "content", keep: Sequence[str] = ("path",)) -> DataFrame:
    """(path, line_no, text) of every text file, however large; binary files yield no lines."""
    body = F.col(content).cast("string")
    readable = files.where(~is_binary(F.col(content)))
    return (readable.select(*keep, body.alias("_content"))
            .select(*keep, F.posexplode(F.expr(split_lines("_content"))).alias("_pos", "text"))
            .select(*keep, (F.col("_pos") + 1).alias("line_no"), "text"))


def count_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Per file: non-blank lines, and physical lines (an unterminated last line counts); 0 for binary files."""
    body = F.col(content).cast("string")
    flagged = files.select("path", body.alias("_c"), is_binary(F.col(content)).alias("_bin"))
    return flagged.selectExpr(
        "path",
        "cast(CASE WHEN _bin THEN 0 ELSE size(filter(" + split_lines("_c") + r", l -> l rlike '\\S')) END AS BIGINT) "
        "AS code_lines",
        "cast(CASE WHEN _bin OR _c = '' THEN 0 ELSE length(_c) - length(replace(_c, '\n', '')) + "
        "CASE WHEN endswith(_c, '\n') THEN 0 ELSE 1 END END AS BIGINT) AS total_lines")


def read_texts(shas: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents by hash: each wanted hash once, missing ones skipped. Spark broadcasts the wanted hashes when
    they are small; otherwise both sides are hashed on sha, which is unique per blob and cannot skew."""
    return blobs.join(shas.select("sha").distinct(), "sha", "left_semi")


def excerpt(refs: DataFrame, lines: DataFrame, before: int = fx.CODE_CONTEXT, after: int = fx.CODE_CONTEXT,
            block: int = 64) -> DataFrame:
    """The lines around each reference (ref, path, line): ref, start, line_no, text.

    Lines and references meet on (path, block of lines), so a file with very many references spreads over
    its blocks. The first and last line of the file clip the window by themselves.
    """
    wanted = refs.selectExpr(
        "ref", "path AS _path", "line", f"greatest(1, line - {before}) AS start", f"line + {after} AS stop",
        f"explode(sequence(greatest(1, line - {before}) div {block}, (line + {after}) div {block})) AS _block")
    return (lines.withColumn("_line_block", F.expr(f"line_no div {block}"))
            .join(wanted, F.expr("path = _path AND _line_block = _block AND line_no BETWEEN start AND stop"))
            .select("ref", "start", "line_no", "text"))
