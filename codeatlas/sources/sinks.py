"""Writing maps and the part cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_records(sections: dict[str, DataFrame], by: Sequence[str] = ("repo",)) -> DataFrame:
    """All sections of maps as one relation (by, section, record): one JSON record per row. A map document is its
    rows, so a repository of any size is written by many tasks."""
    out = None
    for name, df in sections.items():
        rows = df.select(*by, F.lit(name).alias("section"),
                         F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_map(sections: dict[str, DataFrame], out: str, by: Sequence[str] = ("repo",), mode: str = "overwrite") -> None:
    """One folder of JSON lines per repository, and one parquet table per section for querying."""
    map_records(sections, by).write.mode(mode).partitionBy(*by).json(f"{out}/map")
    for name, df in sections.items():
        df.write.mode(mode).partitionBy(*by).parquet(f"{out}/tables/{name}")


def cache_hits(fingerprints: DataFrame, cache: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slices whose content is already mapped."""
    return fingerprints.join(cache.select(*by, "fingerprint"), [*by, "fingerprint"], "left_semi")


def cache_misses(fingerprints: DataFrame, cache: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slices still to be mapped."""
    return fingerprints.join(cache.select(*by, "fingerprint"), [*by, "fingerprint"], "left_anti")


def read_cache(fingerprints: DataFrame, cache: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cached records of the slices that have one. The cache holds one row per fingerprint."""
    return fingerprints.join(cache, [*by, "fingerprint"])


def write_cache(fresh: DataFrame, path: str) -> None:
    """Append freshly mapped records (fingerprint, record); call with cache misses only."""
    fresh.dropDuplicates(["fingerprint"]).write.mode("append").parquet(path)
