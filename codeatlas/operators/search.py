"""Filters and search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from ..sources.files import explode_lines
from .joins import enclosing
from .ordered import spread_join, top_k


def in_folder(path: str, folder: str) -> str:
    """SQL: whether a path is the folder or lies below it; '' and '.' hold everything."""
    if folder in ("", "."):
        return "true"
    return f"({path} = {S.text(folder)} OR startswith({path}, {S.text(folder.rstrip('/') + '/')}))"


def grep(lines: DataFrame, name: str, folder: str = "", limit: int | None = None) -> DataFrame:
    """(ref, text, is_def): whole-word hits of an identifier, with the whole line; an invalid identifier has none. All hits in no
    order, or the first ``limit``: definitions first, then by path and line."""
    if not re.fullmatch(r"[A-Za-z_][\w.]{0,80}", name):
        return lines.where("false").selectExpr("path AS ref", "text", "false AS is_def")
    word = rf"\b{re.escape(name)}\b"
    define = fx.DEFINITION + re.escape(name.split(".")[-1]) + r"\b"
    hits = lines.where(f"contains(text, {S.text(name)}) AND text rlike {S.text('(?U)' + word)} AND {in_folder('path', folder)}")
    out = hits.selectExpr("path", "line_no", "trim(text) AS text", f"text rlike {S.text(define)} AS is_def")
    if limit is not None:
        out = out.orderBy(F.desc("is_def"), "path", "line_no").limit(limit)
    return out.selectExpr("concat(path, ':', line_no) AS ref", "text", "is_def")


def grep_files(files: DataFrame, name: str, folder: str = "", limit: int | None = None) -> DataFrame:
    """``grep`` over files (path, content): files that do not contain the name are dropped before lines are split."""
    return grep(explode_lines(files.where(f"contains(content, {S.text(name)}) AND {in_folder('path', folder)}")), name, folder, limit)


def list_tree(files: DataFrame, folder: str = "", limit: int | None = None) -> DataFrame:
    """All paths in a folder, or the first ``limit`` in order."""
    out = files.where(in_folder("path", folder)).select("path")
    return out if limit is None else out.orderBy("path").limit(limit)


def search(catalog: DataFrame, queries: Sequence[str], k: int = 9, by: Sequence[str] = ()) -> DataFrame:
    """(by, query, rank, pos, name, score): the best ``k`` catalog rows (pos, name, sub) per query text. The few query
    texts ride along with each row, so there is no join."""
    asked = [q.strip().lower() for q in queries if q.strip()]
    rows = catalog.select("*", F.explode(F.array(*[F.lit(q) for q in asked])).alias("query"))
    score = f"greatest({S.fuzzy_score('query', 'name')}, {S.fuzzy_score('query', 'sub')} * cast(0.4 AS DOUBLE))"
    scored = rows.withColumn("score", F.expr(score)).where("score > 0")
    return top_k(scored, [*by, "query"], [F.col("score").desc(), "pos"], k).select(*by, "query", "rank", "pos", "name", "score")


def find_files(files: DataFrame, queries: Sequence[str], k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by, query, rank, path, score): the best ``k`` paths per query by name, then whole path; an empty query gives the
    first paths."""
    rows = files.select(*by, "path", F.explode(F.array(*[F.lit(q.strip().lower()) for q in queries])).alias("query"))
    score = (f"CASE WHEN query = '' THEN cast(1 AS DOUBLE) ELSE greatest({S.fuzzy_score('query', S.base_name('path'))} * cast(2 AS DOUBLE), "
             f"{S.fuzzy_score('query', 'path')}) END")
    scored = rows.withColumn("score", F.expr(score)).where("score > 0")
    return top_k(scored, [*by, "query"], [F.col("score").desc(), "path"], k).select(*by, "query", "rank", "path", "score")


def filter_words(df: DataFrame, text: str, columns: Sequence[str], mode: str = "all") -> DataFrame:
    """Rows where every word of ``text`` occurs in the columns ('all'), or the whole text in any column ('any')."""
    q = text.strip().lower()
    if not q:
        return df
    if mode == "any":
        return df.where(" OR ".join(f"contains(lower(cast({c} AS STRING)), {S.text(q)})" for c in columns))
    joined = "lower(concat_ws(' ', " + ", ".join(columns) + "))"
    return df.where(" AND ".join(f"contains({joined}, {S.text(w)})" for w in q.split()))


def resolve_suffix(refs: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ref, path): a bare file name means the first path in order that equals it or ends in '/' and it; names with a
    folder stay as they are."""
    bare = refs.select(*by, "ref").distinct().withColumn("name", F.expr(r"regexp_replace(ref, ':\\d+$', '')"))
    first = files.withColumn("name", F.expr(S.base_name("path"))).groupBy(*by, "name").agg(F.min("path").alias("_hit"))
    return bare.join(first, [*by, "name"], "left").selectExpr(
        *by, "ref", "CASE WHEN contains(name, '/') OR _hit IS NULL THEN ref ELSE concat(_hit, substring(ref, length(name) + 1)) END AS path")


def steps_at(steps: DataFrame, functions: DataFrame, places: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    """(by, place_id, flow_id, pos, score): flow steps related to places (place_id, path, line, word), best ``k`` each, part
    flows before system flows (owner null).

    With a word: steps naming it, 3 in the same file and 2 elsewhere. Without: steps in the same file inside the
    place's function, nearer ones higher; around places outside functions within three lines; steps naming the
    function at either end 1.
    """
    last = lambda c: rf"element_at(split({c}, '\\.'), -1)"
    s = steps.withColumn("r", F.expr(S.parse_ref("ref"))).selectExpr(
        *by, "flow_id", "owner", "pos", "fn", f"{last('`from`')} AS a", f"{last('`to`')} AS b", "r.path AS s_path", "coalesce(r.line, 0) AS s_line")
    fn = places.join(enclosing(places, functions, [*by, "path"], take=("name", "start", "end"), order=("start",)), [*by, "path", "line"], "left")
    # A place wants few of the steps that name its word, so each word keeps its first k steps, and its first k in each file, and places meet only those.
    # Elsewhere-steps of a place are the word's steps seen in any other file: at most as many of the word's first k fail that as are in the place's
    # file, and those are taken from the file's own.
    file = [F.coalesce("path", F.lit("")).alias("_file"), F.col("path").isNull().alias("_none")]
    words = fn.where("word IS NOT NULL").select(*by, "place_id", "word", "path", *file)
    ends = s.withColumnRenamed("s_path", "path").select("*", F.explode(F.expr("array_distinct(filter(array(fn, a, b), w -> w IS NOT NULL))")).alias("word"))
    step, first = ["owner", "flow_id", "pos"], [F.expr("owner IS NULL"), "flow_id", "pos"]
    named = ends.select(*by, "word", "path", *file, *step).distinct()
    own = top_k(named.drop("path"), [*by, "word", "_file", "_none"], first, k).drop("rank")
    any_file = top_k(named.groupBy(*by, "word", *step).agg(F.min(F.struct("path")).alias("_lo"), F.max(F.struct("path")).alias("_hi")),
                     [*by, "word"], first, k).drop("rank")
    same = spread_join(words.drop("path"), own, [*by, "word", "_file", "_none"]).withColumn("score", F.lit(3.0))
    other = spread_join(words.drop("_file", "_none"), any_file, [*by, "word"]).where("NOT (_lo = _hi AND _lo.path <=> path)").withColumn("score", F.lit(2.0))
    by_word = same.select(*by, "place_id", "flow_id", "pos", "owner", "score").union(other.select(*by, "place_id", "flow_id", "pos", "owner", "score")).distinct()
    here = fn.where("word IS NULL").join(s.withColumn("path", F.col("s_path")), [*by, "path"])
    near = ("CASE WHEN start IS NOT NULL THEN CASE WHEN s_line >= start AND s_line < `end` THEN 3 - least(2D, abs(s_line - line) / 50D) "
            "WHEN a = name OR b = name THEN 1D END WHEN abs(s_line - line) <= 3 THEN 3 - least(2D, abs(s_line - line) / 50D) END")
    by_place = here.selectExpr(*by, "place_id", "flow_id", "pos", "owner", f"{near} AS score").where("score > 0")
    return top_k(by_word.unionByName(by_place), [*by, "place_id"], [F.col("score").desc(), F.expr("owner IS NULL"), "flow_id", "pos"], k).select(
        *by, "place_id", "flow_id", "pos", F.round("score", 4).alias("score"))
