"""Version control exports as tables. The texts are the NUL-separated forms ('-z') of the export commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: the record forms of the exports
NAME_STATUS = r"[RC]\d*\x00[^\x00]*\x00[^\x00]*\x00|[A-QS-Z]\d*\x00[^\x00]*\x00"
NUMSTAT = r"(?:\d+|-)\t(?:\d+|-)\t(?:\x00[^\x00]*\x00[^\x00]*|[^\x00]+)\x00"
TREE_ROW = r"^(\d+) (\w+) ([0-9a-f]+)\s+(\d+|-)\t(.*)$"


def parse_name_status(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(status, path, old) from texts in column ``raw``: renames keep the old path, copies are additions."""
    entries = raw.select(*by, F.explode(F.expr(f"regexp_extract_all(raw, {S.text(NAME_STATUS)}, 0)")).alias("e"))
    token = entries.select(*by, F.split("e", "\0").alias("t"))
    return token.selectExpr(
        *by,
        "CASE left(t[0], 1) WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'added' WHEN 'A' THEN 'added' "
        "WHEN 'D' THEN 'deleted' ELSE 'modified' END AS status",
        "CASE WHEN left(t[0], 1) IN ('R', 'C') THEN t[2] ELSE t[1] END AS path",
        "CASE WHEN left(t[0], 1) = 'R' THEN t[1] END AS old")


def parse_numstat(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(path, added, removed) from texts in column ``raw``; '-' (binary) counts as 0; a rename counts for its
    new path."""
    entries = raw.select(*by, F.explode(F.expr(f"regexp_extract_all(raw, {S.text(NUMSTAT)}, 0)")).alias("e"))
    t = entries.selectExpr(*by, "split(e, '\t', 3) AS t")
    return t.selectExpr(
        *by, "element_at(filter(split(t[2], '\0'), p -> p <> ''), -1) AS path",
        "coalesce(try_cast(t[0] AS BIGINT), 0) AS added", "coalesce(try_cast(t[1] AS BIGINT), 0) AS removed")


def changed_files(statuses: DataFrame, counts: DataFrame, untracked: DataFrame | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """(status, path, old, added, removed); untracked files (path, lines) are additions."""
    out = statuses.join(counts, [*by, "path"], "left").select(
        *by, "status", "path", "old", F.coalesce("added", F.lit(0)).alias("added"),
        F.coalesce("removed", F.lit(0)).alias("removed"))
    if untracked is not None:
        out = out.unionByName(untracked.select(
            *by, F.lit("added").alias("status"), "path", F.lit(None).cast("string").alias("old"),
            F.col("lines").alias("added"), F.lit(0).alias("removed")))
    return out


def parse_ls_tree(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(path, sha, size) of the files in a tree listing; ignored folders are dropped."""
    rows = raw.select(*by, F.explode(F.split("raw", "\0")).alias("row"))
    part = lambda g: f"regexp_extract(row, {S.text(TREE_ROW)}, {g})"
    return (rows.where(f"row rlike {S.text(TREE_ROW)}")
            .selectExpr(*by, f"{part(5)} AS path", f"{part(2)} AS kind", f"{part(3)} AS sha",
                        f"coalesce(try_cast({part(4)} AS BIGINT), 0) AS size")
            .where(f"kind = 'blob' AND NOT {S.is_ignored('path')}").drop("kind"))
