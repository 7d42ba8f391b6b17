"""The map of a repository as one job: from mapping replies and source files to parts, links, domains, outside systems, flows and checked references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from ..sources import records
from ..sources.files import explode_lines, is_binary, split_lines
from . import rollup
from .joins import verify_refs
from .ordered import first_per
from .validate import valid_clusters, valid_flows, valid_kinds


def accepted_parts(replies: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected) of mapping replies (by, source, raw), broken ones salvaged: of records with one id the first by source and place stands;
    records without an id and later ones of a taken id are rejected."""
    found = cut(records.salvage_parts(replies, [*by, "source"]), "records")
    named = found.where("id <> ''")
    place = [*by, "id", "source", "pos"]
    first = first_per(named.select(*place), [*by, "id"], ["source", "pos"])
    rejected = found.where("coalesce(id, '') = ''").unionByName(named.join(first, place, "left_anti"))
    return cut(named.join(first, place, "left_semi").drop("source", "pos"), "parts"), rejected.select(*by, "source", "pos", "id", "path")


def build_map(replies: DataFrame, files: DataFrame, claims: DataFrame | None = None, kinds: DataFrame | None = None, flows: DataFrame | None = None,
              changed: DataFrame | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The sections of a map, each a table; ``sources.sinks.write_map`` writes them.

    parts (the record without its lists, with cluster and size); rejected; clusters (id, name, color, members); externals (id, kind); links (src, dst,
    how, weight); streams between domains; flows (steps of parts' own flows) and system_flows (checked steps of flows over parts); code (ref, verified);
    changes (part, changes), if changed files are given; overview (key), by which an overview can be reused.

    replies: (by, source, raw); files: (by, path, content). What an overview told is optional: claims (pos, cluster, part), kinds (id, kind) and
    flows (flow_id, title, pos, from, to, text, ref); without claims a part's first folder is its domain. Outside systems are what parts say they use;
    spellings of one system become one name everywhere.
    """
    parts, rejected = accepted_parts(replies, by)
    ids = parts.select(*by, "id")
    uses = cut(records.uses_of(parts, by), "uses")
    named = uses.where("target <> ''").select(*by, F.col("target").alias("name")).distinct().join(ids.withColumnRenamed("id", "name"), [*by, "name"], "left_anti")
    told = None if kinds is None else valid_kinds(named.withColumnRenamed("name", "id"), kinds, by).withColumnRenamed("id", "name")
    renames, externals = rollup.merge_externals(named, uses, told, by)
    renames, externals = cut(renames, "renames"), cut(externals, "externals")
    uses = rollup.rename_targets(uses, renames, "target", by)
    topics = lambda c: parts.select(*by, F.col("id").alias("part"), F.explode(c).alias("topic"))
    links = cut(rollup.all_links(uses, topics("publishes"), topics("subscribes"), by), "links")

    if claims is None:
        members, clusters = rollup.cluster_members(parts, by), rollup.folder_clusters(parts, by)
    else:
        members = valid_clusters(claims, parts, by)
        clusters = rollup.folder_clusters(members.select(*by, F.col("part").alias("id"), F.col("cluster").alias("path")), by)
    members = cut(members, "members")

    code = files.where(f"{S.is_source('path')} AND NOT {S.is_test('path')}")
    lines = F.expr(f"cast(size(filter({split_lines('content')}, l -> l rlike '\\\\S')) AS BIGINT)")
    sized = code.where(~is_binary(F.col("content"))).select(*by, "path", lines.alias("code_lines"))
    sizes = rollup.part_sizes(sized, parts.select(*by, "id", "path"), by)

    renamed = lambda df: rollup.rename_targets(rollup.rename_targets(df, renames, "from", by), renames, "to", by)
    steps = renamed(records.flow_steps_of(parts, by))
    refs = cut(records.refs_of(parts, by), "refs")
    sections = {
        "parts": parts.select(*by, "id", "path", "kind", "name", "summary").join(members.withColumnRenamed("part", "id"), [*by, "id"], "left").join(
            sizes.withColumnRenamed("part", "id"), [*by, "id"], "left"),
        "rejected": rejected, "clusters": clusters, "externals": externals, "links": links,
        "streams": rollup.domain_streams(links, members, externals, by), "flows": steps, "overview": rollup.overview_key(parts, by),
    }
    pairs = refs.select(*by, "ref", "fn")
    if flows is not None:
        actors = ids.unionByName(externals.select(*by, "id"))
        sections["system_flows"] = cut(valid_flows(renamed(flows), actors, refs, by), "system-flows")
        pairs = pairs.unionByName(sections["system_flows"].where("ref <> ''").select(*by, "ref", F.lit(None).cast("string").alias("fn")))
    sections["code"] = verify_refs(pairs.distinct(), explode_lines(files, keep=(*by, "path")), by)
    if changed is not None:
        sections["changes"] = rollup.changes_per_part(changed, parts.select(*by, "id", "path"), by)
    return sections
