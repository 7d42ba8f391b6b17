"""Part records: reading, salvaging, flattening, and compact text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import first_per


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected) from {"parts": [...]} files below ``path``; files are ordered by name."""
    raw = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw"))
    return parts_from_json(raw)


def parts_from_json(raw: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected) of raw texts (source, raw): the first record of an id wins; records without an id, and
    later ones of a taken id, are rejected."""
    records = (raw.select(*by, "source", F.from_json("raw", schemas.PARTS_FILE).alias("doc"))
               .select(*by, "source", F.posexplode("doc.parts").alias("pos", "part"))
               .select(*by, "source", "pos", "part.*"))
    named = records.where("id <> ''")
    first = first_per(named.select(*by, "id", "source", "pos"), [*by, "id"], ["source", "pos"])
    keys = [*by, "id", "source", "pos"]
    parts = named.join(first, keys, "left_semi")
    rejected = records.where("coalesce(id, '') = ''").unionByName(named.join(first, keys, "left_anti"))
    return parts, rejected


# a stretch of a text up to and with its next quote, brace or backslash; a backslash takes a quote or backslash behind it along
_TOKEN = r"""[^{}"\\]+(?:\\["\\]|[{}"\\])?|\\["\\]|[{}"\\]"""


def braced(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, raw, _start, _stop): each opening brace of the texts (keys, raw; distinct rows) with the brace that closes it, places from 1.

    Braces inside strings do not count, and what is a string depends on where reading starts: behind an even or an odd number of quotes. So there are
    two readings of a text; the braces of each nest by themselves, and a brace is closed by the next one of its reading at its depth.
    """
    parts = texts.select(*keys, "raw", F.posexplode(F.regexp_extract_all("raw", F.lit(_TOKEN), F.lit(0))).alias("_k", "_token"))
    one = [*keys, F.xxhash64("raw")]
    so_far = Window.partitionBy(*one).orderBy("_k")
    escaped = r"""_token rlike '\\\\["\\\\]\\z'"""
    marks = parts.withColumn("_mark", F.expr(f"CASE WHEN {escaped} THEN '' ELSE right(_token, 1) END")).withColumn(
        "_at", F.sum(F.length("_token")).over(so_far)).withColumn("_reading", F.count_if(F.expr("_mark = '\"'")).over(so_far) % 2)
    braces = marks.where("_mark IN ('{', '}')")
    depth = F.sum(F.expr("CASE _mark WHEN '{' THEN 1 ELSE -1 END")).over(Window.partitionBy(*one, "_reading").orderBy("_k"))
    level = braces.withColumn("_level", depth + F.expr("CASE _mark WHEN '}' THEN 1 ELSE 0 END"))
    closing = F.lead("_at").over(Window.partitionBy(*one, "_reading", "_level").orderBy("_k"))
    return level.withColumn("_stop", closing).where("_mark = '{' AND _stop IS NOT NULL").select(*keys, "raw", F.col("_at").alias("_start"), "_stop")


def salvage_parts(raw: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Part records of reply texts (keys, raw). Text around the outermost braces is ignored. Of a reply that does not parse, every object is
    kept that parses by itself, has an id and a path, and does not begin inside one kept before."""
    body = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    parsed = raw.select(*keys, "raw", body.alias("_body"), F.from_json(body, f"{schemas.PARTS_FILE[:-1]}, _bad: STRING>",
                                                  {"columnNameOfCorruptRecord": "_bad"}).alias("doc"))
    sound = "doc._bad IS NULL AND coalesce(try_parse_json(concat('[', _body, ']')) IS NOT NULL, false)"   # in brackets: nothing may follow the object
    good = (parsed.where(sound).select(*keys, F.posexplode("doc.parts").alias("pos", "part"))
            .select(*keys, "pos", "part.*"))
    columns = [f.name for f in good.schema.fields if f.name not in (*keys, "pos")]
    broken = parsed.where(f"NOT ({sound})").groupBy(*keys, "raw").agg(F.count("*").cast("int").alias("_copies"))
    texts = braced(broken, keys).withColumn("_text", F.expr("substring(raw, _start, _stop - _start + 1)")).where("try_parse_json(_text) IS NOT NULL")
    whole = texts.withColumn("_part", F.from_json("_text", schemas.PART)).where("_part.id <> '' AND _part.path <> ''")
    in_order = whole.groupBy(*keys, "raw").agg(F.array_sort(F.collect_list(F.struct("_start", "_stop", "_part"))).alias("_found"))
    kept = F.expr("aggregate(_found, slice(_found, 1, 0), (acc, x) -> CASE WHEN x._start > coalesce(try_element_at(acc, -1)._stop, 0) THEN concat(acc, array(x)) ELSE acc END)")
    salvaged = (in_order.join(broken, [*keys, "raw"]).select(*keys, F.explode(F.expr("sequence(1, _copies)")).alias("_copy"), kept.alias("kept"))
                .select(*keys, F.posexplode("kept").alias("pos", "x")).select(*keys, "pos", "x._part.*"))
    return good.select(*keys, "pos", *columns).unionByName(salvaged.select(*keys, "pos", *columns))


# ---- flat views of part records --------------------------------------------------------------------
def uses_of(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return parts.select(*by, F.col("id").alias("src"), F.posexplode("uses").alias("pos", "u")).select(
        *by, "src", "pos", "u.target", "u.how", "u.ref")


def exposes_of(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return parts.select(*by, F.col("id").alias("part"), F.posexplode("exposes").alias("pos", "e")).select(
        *by, "part", "pos", "e.type", "e.what", "e.ref")


def flow_steps_of(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(flow_id, owner, title, trigger, pos, from, to, text, fn, ref); flow_id = part#index."""
    return (parts.select(*by, F.col("id").alias("owner"), F.posexplode("flows").alias("k", "f"))
            .select(*by, "owner", F.concat_ws("#", "owner", "k").alias("flow_id"), "f.title", "f.trigger",
                    F.posexplode("f.steps").alias("pos", "s"))
            .select(*by, "flow_id", "owner", "title", "trigger", "pos", "s.*"))


def refs_of(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every (part, ref, fn) a part states: exposes and uses name no function, flow steps may."""
    plain = [d.where("ref <> ''").select(*by, F.col(p).alias("part"), "ref", F.lit(None).cast("string").alias("fn"))
             for d, p in ((exposes_of(parts, by), "part"), (uses_of(parts, by), "src"))]
    steps = flow_steps_of(parts, by).where("ref <> ''").select(*by, F.col("owner").alias("part"), "ref", "fn")
    return plain[0].unionByName(plain[1]).unionByName(steps)


def digest(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One compact line of JSON per part: the document's lines in part order make up the digest of a repo, so no
    repository is ever gathered into one value."""
    d = parts.select(
        *by, "id", "kind", "summary",
        F.expr("transform(uses, u -> concat(coalesce(u.target, 'None'), ': ', coalesce(u.how, '')))").alias("uses"),
        F.expr("transform(exposes, e -> coalesce(e.what, ''))").alias("exposes"),
        F.expr("transform(filter(flatten(transform(flows, f -> f.steps)), s -> s.ref <> ''), "
               "s -> concat(s.`from`, ' -> ', s.`to`, ' @ ', s.ref))").alias("flowSteps"),
        "publishes", "subscribes")
    some = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("publishes", "subscribes")]
    return d.select(*by, "id", F.to_json(F.struct("id", "kind", "summary", "uses", *some, "exposes", "flowSteps"))
                    .alias("line"))


def map_digest(parts: DataFrame, clusters: DataFrame, externals: DataFrame, flows: DataFrame,
               by: Sequence[str] = ()) -> DataFrame:
    """The map as text lines (section, key, pos, line): sort by them to read it in order."""
    from ..operators.joins import distinct_refs
    cluster_lines = clusters.select(
        *by, F.lit(1).alias("section"), F.col("id").alias("key"), F.lit(0).alias("pos"),
        F.expr("concat('- ', id, ': ', coalesce(name, ''), ' — ', coalesce(summary, ''))").alias("line"))
    part_lines = parts.select(
        *by, F.lit(2).alias("section"), F.col("id").alias("key"), F.lit(0).alias("pos"),
        F.expr("concat('- ', id, ' [', coalesce(kind, 'None'), ', ', coalesce(cluster, 'None'), '] ', path, ': ', "
               "coalesce(summary, ''))").alias("line"))
    flow_lines = parts.select(*by, "id", F.posexplode("flows").alias("k", "f")).select(
        *by, F.lit(2).alias("section"), F.col("id").alias("key"), (F.col("k") + 1).alias("pos"),
        F.expr("concat('  - flow ', id, '#', k, ': ', f.title)").alias("line"))
    ref_lines = distinct_refs(parts, by).select(
        *by, F.lit(2).alias("section"), F.col("part").alias("key"), F.lit(1_000_000).alias("pos"),
        F.expr("concat('  - refs: ', array_join(refs, ' '))").alias("line"))
    external_lines = externals.select(
        *by, F.lit(3).alias("section"), F.col("id").alias("key"), F.lit(0).alias("pos"),
        F.expr("concat('- external ', id)").alias("line"))
    system_lines = flows.select(
        *by, F.lit(4).alias("section"), F.col("flow_id").alias("key"), F.lit(0).alias("pos"),
        F.expr("concat('- ', flow_id, ': ', title)").alias("line"))
    out = cluster_lines
    for more in (part_lines, flow_lines, ref_lines, external_lines, system_lines):
        out = out.unionByName(more)
    return out


def read_structure(spark: SparkSession, nodes: str, edges: str, fmt: str = "parquet",
                   options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(functions, calls) of an exported structure database (parquet folders, or any format Spark reads)."""
    options = options or {}
    read = lambda p: spark.read.format(fmt).options(**options).load(p)
    return structure_tables(read(nodes), read(edges))


def structure_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only function-like nodes and call edges, only the needed columns: both reach the scan."""
    functions = nodes.where(F.col("kind").isin("Class", "Function", "Test")).select(
        "fn_id", "kind", "name", "parent", "path", "start", "end", "is_test")
    calls = edges.where("kind = 'CALLS'").select("src", "dst")
    return functions, calls
