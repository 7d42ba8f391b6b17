"""Checks on records from outside before they are used: unknown ids, kinds and references are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S


def valid_clusters(claims: DataFrame, parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, cluster): each known part in one cluster: the first claim (pos) wins, unclaimed parts go to "other".
    claims: (pos, cluster, part). A cluster left without members has no rows."""
    known = claims.where("cluster <> ''").join(parts.select(*by, F.col("id").alias("part")), [*by, "part"], "left_semi")
    won = known.groupBy(*by, "part").agg(F.min_by("cluster", "pos").alias("cluster"))
    return parts.select(*by, F.col("id").alias("part")).join(won, [*by, "part"], "left").select(
        *by, "part", F.coalesce("cluster", F.lit("other")).alias("cluster"))


def valid_colors(clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters (pos, id, color) with a colour outside the palette replaced by the palette's at their position."""
    ok = f"array_contains({S.texts(fx.PALETTE)}, color)"
    return clusters.withColumn("color", F.expr(f"CASE WHEN {ok} THEN color ELSE get({S.texts(fx.PALETTE)}, cast(pos % {len(fx.PALETTE)} AS INT)) END"))


def valid_flows(steps: DataFrame, actors: DataFrame, refs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flow steps (flow_id, title, pos, from, to, text, ref) whose both ends are known actors (id); unknown refs become
    null; flows need a title and at least two steps."""
    ids = actors.select(*by, "id").distinct()
    known = steps.where("title <> ''").join(ids.withColumnRenamed("id", "from"), [*by, "from"], "left_semi").join(
        ids.withColumnRenamed("id", "to"), [*by, "to"], "left_semi")
    good = refs.select(*by, "ref").distinct().withColumn("_ok", F.lit(True))
    checked = known.join(good, [*by, "ref"], "left").withColumn("ref", F.expr("CASE WHEN _ok THEN ref END")).drop("_ok")
    long = checked.groupBy(*by, "flow_id").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return checked.join(long, [*by, "flow_id"], "left_semi").select(*steps.columns)


def valid_kinds(externals: DataFrame, claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, kind): a claimed kind when it is one of the known ones, else the kind its name suggests."""
    ok = claims.where(F.col("kind").isin(*fx.EXTERNAL_KINDS, "other")).groupBy(*by, "id").agg(F.min("kind").alias("kind"))
    return externals.select(*by, "id").join(ok, [*by, "id"], "left").withColumn(
        "kind", F.expr(f"coalesce(kind, {S.external_kind('id')})"))


def valid_actions(actions: DataFrame, entities: DataFrame, parts: DataFrame, flows: DataFrame, files: DataFrame,
                  by: Sequence[str] = ()) -> DataFrame:
    """Actions (action_id, type, id, flow, part, ids, kinds, ref) kept per type when what they name exists; lists are
    narrowed to known members. entities: (id); parts: (id); flows: (flow_id); files: (path)."""
    mark = lambda df, c, k, out: df.select(*by, F.col(c).alias(k)).distinct().withColumn(out, F.lit(True))
    a = actions.withColumn("_path", F.expr(r"regexp_extract(coalesce(ref, ''), '^(.+):\\d+$', 1)"))
    a = (a.join(mark(entities, "id", "id", "id_ok"), [*by, "id"], "left")
         .join(mark(flows, "flow_id", "flow", "flow_ok"), [*by, "flow"], "left")
         .join(mark(parts, "id", "part", "part_ok"), [*by, "part"], "left")
         .join(mark(files, "path", "_path", "ref_ok"), [*by, "_path"], "left"))
    members = actions.where("type = 'highlight'").select(*by, "action_id", F.posexplode("ids").alias("pos", "id")).join(
        entities.select(*by, "id").distinct(), [*by, "id"], "left_semi")
    kept = members.groupBy(*by, "action_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, id))), r -> r.id)").alias("_ids"))
    a = a.join(kept, [*by, "action_id"], "left")
    kinds = f"array_intersect(kinds, {S.texts(fx.PART_KINDS)})"
    ok = ("CASE type WHEN 'focus' THEN id_ok WHEN 'play' THEN flow_ok WHEN 'feature' THEN coalesce(flow_ok, part_ok) "
          "WHEN 'highlight' THEN ids IS NOT NULL AND (_ids IS NOT NULL OR size(ids) = 0) "
          f"WHEN 'filter' THEN size({kinds}) > 0 WHEN 'overview' THEN true WHEN 'code' THEN ref_ok END")
    empty = "cast(array() AS ARRAY<STRING>)"
    return a.where(ok).selectExpr(
        *by, "action_id", "type", "CASE type WHEN 'focus' THEN id WHEN 'play' THEN flow WHEN 'feature' THEN "
        "CASE WHEN flow_ok THEN flow ELSE part END WHEN 'code' THEN ref END AS name",
        f"CASE type WHEN 'highlight' THEN coalesce(_ids, {empty}) WHEN 'filter' THEN {kinds} END AS names")


def valid_labels(labels: DataFrame, steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, step_id, label): labels of known steps, whitespace squashed, cut to 80 characters, blank ones dropped."""
    cleaned = labels.withColumn("label", F.expr(S.clip("label", str(fx.MAX_LABEL)))).where("label <> ''")
    return cleaned.join(steps.select(*by, "step_id"), [*by, "step_id"], "left_semi").select(*by, "step_id", "label")
