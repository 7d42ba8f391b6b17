"""Ranking, batching, naming and stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from .ordered import carry_forward, first_per, ranked, running_sum, top_k


def rank_entries(exposed: DataFrame, roots: DataFrame, by: Sequence[str] = ("part",), cap: int | None = None) -> DataFrame:
    """(by, line_id, label, kind, node, reach, hidden): exposed handlers first, then call roots reaching at least two by
    reach; the first entry of a node stands. All entries, or the first ``cap`` and the number hidden.

    exposed: (by, pos, label, kind, node, reach); roots: (by, label, node, reach) of uncalled functions.
    """
    e = exposed.selectExpr(*by, "label", "kind", "node", "reach", "0 AS class", "cast(pos AS BIGINT) AS k1", "0L AS k2")
    r = roots.where("reach >= 2").selectExpr(*by, "label", "'function' AS kind", "node", "reach", "1 AS class",
                                             "cast(-reach AS BIGINT) AS k1", "cast(node AS BIGINT) AS k2")
    unique = first_per(e.unionByName(r), [*by, "node"], ["class", "k1", "k2"])
    total = unique.groupBy(*by).agg(F.count("*").alias("_n"))
    kept = top_k(unique, by, ["class", "k1", "k2"], cap)
    return kept.join(total, [*by]).selectExpr(*by, "concat('L', rank - 1) AS line_id", "label", "kind", "node", "reach",
                                              "0L AS hidden" if cap is None else f"greatest(_n - {cap}, 0) AS hidden")


def assign_batches(items: DataFrame, n: int, by: Sequence[str] = (), chunk: int = 10_000) -> DataFrame:
    """(by, id, size, batch): biggest item first into the lightest of ``n`` batches, the lowest on ties.

    The greedy rule is a fold over items in size order, so it runs chunk by chunk: equal-ranked chunks of all scopes
    together, each chunk of at most ``chunk`` items folded in one row starting from the loads the one before left.
    Batches hold 'slices of one repository', so nearly every scope is a single chunk.
    """
    from ..session import cut, is_empty
    scope = list(by) or ["_all"]
    src = items if by else items.withColumn("_all", F.lit(1))
    in_order = ranked(src, scope, ["-cast(size AS BIGINT)", "id"])
    chunks = in_order.withColumn("chunk", F.expr(f"(rank - 1) div {chunk}"))
    packed = cut(chunks.groupBy(*scope, "chunk").agg(
        F.expr("array_sort(collect_list(struct(rank, id, cast(size AS BIGINT) AS size)))").alias("xs")), "batches")
    used = src.groupBy(*scope).agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("_k"))
    loads = used.select(*scope, F.expr("array_repeat(cast(0 AS BIGINT), _k)").alias("loads"))
    out, k = None, 0
    fold = ("aggregate(xs, named_struct('loads', loads, 'got', cast(array() AS ARRAY<INT>)), (a, x) -> "
            "get(transform(array(cast(array_position(a.loads, array_min(a.loads)) - 1 AS INT)), b -> named_struct("
            "'loads', transform(a.loads, (l, i) -> CASE WHEN i = b THEN l + x.size ELSE l END), "
            "'got', concat(a.got, array(b)))), 0))")
    while True:
        todo = packed.where(F.col("chunk") == k)
        if is_empty(todo):
            return out.select(*by, "id", "size", "batch")
        done = cut(todo.join(loads, scope).select(*scope, "xs", F.expr(fold).alias("r")), "loads")
        rows = done.select(*scope, F.posexplode(F.expr("arrays_zip(xs, r.got)")).alias("i", "z")).selectExpr(
            *scope, "z.xs.id AS id", "z.xs.size AS size", "z.got AS batch")
        out = rows if out is None else out.unionByName(rows)
        loads, k = done.select(*scope, F.col("r.loads").alias("loads")), k + 1


def unique_ids(df: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """(by, path, id): the last path component when unique, else the path with dashes; 'root' for an empty path."""
    named = df.select(*by, path).distinct().selectExpr(
        *by, path, f"coalesce(nullif(element_at(split(`{path}`, '/'), -1), ''), 'root') AS _name")
    counts = named.groupBy(*by, "_name").agg(F.count("*").alias("_n"))
    return named.join(counts, [*by, "_name"]).selectExpr(
        *by, path, f"CASE WHEN _n = 1 THEN _name ELSE replace(`{path}`, '/', '-') END AS id")


def function_ids(functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, id): file::name, qualified by the parent when the file has the name more than once; ids that still
    collide get their start line."""
    shared = functions.groupBy(*by, "path", "name").agg(F.count("*").alias("_n"))
    plain = functions.join(shared, [*by, "path", "name"]).selectExpr(
        *by, "fn_id", "start", "concat(path, '::', CASE WHEN _n > 1 AND parent IS NOT NULL THEN concat(parent, '.', name) ELSE name END) AS id")
    first = plain.groupBy(*by, "id").agg(F.min(F.struct("start", "fn_id")).alias("_first"))
    return plain.join(first, [*by, "id"]).selectExpr(
        *by, "fn_id", "CASE WHEN fn_id = _first.fn_id THEN id ELSE concat(id, '@', start) END AS id")


def shared_stations(trunks: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """(by, node, lines): nodes on at least two routes. trunks: (by, line_id, pos, node)."""
    return trunks.select(*by, "line_id", "node").distinct().groupBy(*by, "node").agg(F.count("*").alias("lines")).where("lines >= 2")


def shared_segments(trunks: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """(by, a, b, line_id, slot, lines): unordered trunk segments, the routes sharing each and every route's slot."""
    nxt = trunks.selectExpr(*by, "line_id", "pos - 1 AS pos", "node AS next_node")
    seg = trunks.join(nxt, [*by, "line_id", "pos"]).selectExpr(*by, "line_id", "least(node, next_node) AS a", "greatest(node, next_node) AS b").distinct()
    n = seg.groupBy(*by, "a", "b").agg(F.count("*").alias("lines"))
    slot = F.row_number().over(Window.partitionBy(*by, "a", "b").orderBy(F.expr("cast(substring(line_id, 2) AS INT)"))) - 1
    return seg.withColumn("slot", slot).join(n, [*by, "a", "b"])


# fixed values: branches tried as the default base, in this order
DEFAULT_BRANCHES = "main master dev origin/main origin/master origin/dev".split()


def default_ref(refs: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """(by, name): what origin/HEAD points to, else the first existing usual branch; scopes without one are absent.
    refs: (by, name, target)."""
    rank = ("CASE WHEN name = 'origin/HEAD' AND target IS NOT NULL THEN 0 " +
            " ".join(f"WHEN name = '{b}' THEN {i + 1}" for i, b in enumerate(DEFAULT_BRANCHES)) + " END")
    ranked = refs.selectExpr(*by, "name", "target", f"{rank} AS r").where("r IS NOT NULL")
    return ranked.groupBy(*by).agg(F.expr("min_by(CASE WHEN r = 0 THEN target ELSE name END, r)").alias("name"))


def hunks(line_ops: DataFrame, keys: Sequence[str] = ("path",), pos: str = "pos", bucket: str | None = None) -> DataFrame:
    """(keys, hunk, base_start, base_lines, head_start, head_lines): stretches of changed lines between equal ones.

    line_ops: (keys, pos, op, base_line, head_line); op is '=', '-' or '+'. Gaps and islands, bucket by bucket.
    """
    df = line_ops
    if bucket is None:
        bucket, df = "_bucket", df.withColumn("_bucket", F.expr(f"{pos} div 4096"))
    prev = carry_forward(df, keys, bucket, [pos], "op", "_prev", current=False)
    marked = prev.withColumn("_start", F.expr("CASE WHEN op <> '=' AND coalesce(_prev, '=') = '=' THEN 1 ELSE 0 END"))
    numbered = running_sum(marked, keys, bucket, [pos], "_start", "hunk")
    return numbered.where("op <> '='").groupBy(*keys, "hunk").agg(
        F.min("base_line").alias("base_start"), F.count_if(F.expr("op = '-'")).alias("base_lines"),
        F.min("head_line").alias("head_start"), F.count_if(F.expr("op = '+'")).alias("head_lines"))
