"""Order-dependent steps that do not put a whole group into one task.

A window over a key sorts that key's rows in a single task. These helpers split each key by a monotone bucket
(day, block of lines), work inside buckets in parallel, and pass one row per bucket on to the next ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def carry_forward(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str,
                  current: bool = True) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the key up to this row (before it, unless ``current``).

    ``bucket`` must not decrease along ``order``. Equal to ``last(value, ignorenulls)`` over the key's whole
    order, but each (key, bucket) is its own window and only one row per bucket crosses between them.
    """
    scope = [*keys, bucket]
    inside = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    tails = df.groupBy(*scope).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*scope, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    return (df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
            .join(carried, scope)
            .withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried"))


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str,
                out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows up to this one, bucket by bucket."""
    scope = [*keys, bucket]
    inside = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = (df.groupBy(*scope).agg(F.sum(value).alias("_sum"))
               .select(*scope, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    return (df.withColumn("_inside", F.sum(value).over(inside)).join(carried, scope)
            .withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given order. An aggregate with partial results on the map side, so a hot
    key shrinks before the shuffle (a ``row_number`` window would sort it in one task)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = [F.expr(o) if isinstance(o, str) else o for o in order]
    picked = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their rank. The rank filter lets Spark cut every partition to ``k`` rows
    per key before the shuffle. ``k=None`` ranks every row, range by range."""
    if k is None:
        return ranked(df, keys, order, rank)
    order = [F.expr(o) if isinstance(o, str) else o for o in order]
    window = Window.partitionBy(*keys or [F.lit(1)]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ordered_text(value, order: Sequence, separator: str):
    """Aggregate: the group's texts joined in order."""
    order = [F.expr(o) if isinstance(o, str) else o for o in order]
    value = F.expr(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                                                value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def asof(points: DataFrame, marks: DataFrame, keys: Sequence[str], on: str, value: str, block: int = 256) -> DataFrame:
    """(keys, on, value): for each distinct point the value of the last mark at or before it, if any.

    ``on`` is an integer position; blocks of positions keep a key's rows in many tasks.
    """
    u = (points.select(*keys, on).distinct()
         .select(*keys, on, F.lit(1).alias("_side"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
         .unionByName(marks.select(*keys, on, F.lit(0).alias("_side"), F.col(value).alias("_value")))
         .withColumn("_block", F.expr(f"{on} div {block}")))
    filled = carry_forward(u, keys, "_block", [on, "_side"], "_value", "_found")
    return filled.where("_side = 1").select(*keys, on, F.col("_found").alias(value))


def bucket_rank(df: DataFrame, keys: Sequence[str], buckets: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds ``out``: the 1-based rank within each key. ``buckets`` are leading expressions of the order (coarser is fine, as long
    as they never decrease along it): rows are ranked inside (key, buckets) and shifted by the sizes of earlier buckets."""
    names = [f"_b{i}" for i in range(len(buckets))]
    b = df.select("*", *[F.expr(e).alias(n) for e, n in zip(buckets, names)])
    inside = Window.partitionBy(*keys, *names).orderBy(*[F.expr(o) for o in order])
    before = Window.partitionBy(*keys or [F.lit(1)]).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = b.groupBy(*keys, *names).agg(F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (b.withColumn("_r", F.row_number().over(inside)).join(sizes, [*keys, *names])
            .withColumn(out, (F.col("_r") + F.col("_shift")).cast("int")).drop("_r", "_shift", *names))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rank") -> DataFrame:
    """Adds ``out``: the 1-based rank within each key in the given order (SQL or columns; ties come in any order).

    No window holds a key: rows are dealt by ranges of (keys, order), for which Spark takes a sample, ranked inside (key, range) and shifted by
    what the key has in earlier ranges. So a key of any size, or a whole table without keys, is ranked by as many tasks as there are ranges. The
    rows are written once in between, so that both passes see the same ranges.
    """
    order = [F.expr(o) if isinstance(o, str) else o for o in order]
    dealt = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys or [F.lit(1)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # a row a range
    shift = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))   # null is a key like others
    return dealt.withColumn("_r", F.row_number().over(inside)).join(shift, same).withColumn(out, (F.col("_r") + F.col("_shift")).cast("int")).select(*df.columns, out)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int = 1 << 20) -> DataFrame:
    """The inner join of two tables on ``keys`` where keys may be hot on either or both sides.

    Rows are counted per key on both sides. A key with more than ``pairs`` meetings is dealt out: the side with more rows of it is salted and the
    other one copied once a salt, so that no task gets more than about ``pairs`` meetings of a key. Other keys join as they are. Null keys meet nothing.
    """
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    hot = cut(a.join(b, keys).where(f"cast(_a AS DOUBLE) * _b > {pairs}").select(
        *keys, F.expr(f"cast(least(ceil(cast(_a AS DOUBLE) * _b / {pairs}), greatest(_a, _b)) AS INT) AS _salts"), (F.col("_a") >= F.col("_b")).alias("_left")), "hot")

    def side(df: DataFrame, salted: str) -> DataFrame:
        marked = df.withColumn("_own", F.xxhash64(*df.columns)).join(hot, keys, "left")
        salts = f"CASE WHEN _salts IS NULL THEN array(0) WHEN {salted} THEN array(cast(pmod(_own, _salts) AS INT)) ELSE sequence(0, _salts - 1) END"
        return marked.withColumn("_salt", F.explode(F.expr(salts))).drop("_own", "_salts", "_left")

    return side(left, "_left").join(side(right, "NOT _left"), [*keys, "_salt"]).drop("_salt")
