"""Aggregations over links, parts, changes, gates and structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from .joins import owner_of, topic_links
from .ordered import first_per, ordered_text, ranked, top_k


# ---- links -----------------------------------------------------------------------------------------
def use_links(uses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst, how, weight): one edge per part and target, ``how`` of the first use, self-use dropped."""
    return (uses.where("target <> '' AND target <> src").groupBy(*by, "src", F.col("target").alias("dst"))
            .agg(F.min_by(F.coalesce("how", F.lit("")), "pos").alias("how"), F.count("*").alias("weight")))


def all_links(uses: DataFrame, publishes: DataFrame, subscribes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return use_links(uses, by).unionByName(topic_links(publishes, subscribes, by))


def folder_clusters(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, name, color, members): parts grouped by first folder; the palette repeats in name order."""
    top = parts.selectExpr(*by, "id AS part", "CASE WHEN coalesce(path, '') = '' THEN id ELSE split_part(path, '/', 1) END AS id")
    groups = top.groupBy(*by, "id").agg(F.count("*").alias("members"))
    return (ranked(groups, by, ["id"], "i").withColumn("i", F.col("i") - 1)
            .selectExpr(*by, "id", "initcap(translate(id, '-_', '  ')) AS name", "'' AS summary",
                        f"get({S.texts(fx.PALETTE)}, i % {len(fx.PALETTE)}) AS color", "members"))


def cluster_members(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return parts.selectExpr(*by, "id AS part", "CASE WHEN coalesce(path, '') = '' THEN id ELSE split_part(path, '/', 1) END AS cluster")


def domain_streams(links: DataFrame, clusters: DataFrame, externals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst, to_ext, weight, links): links rolled up per ordered pair of domains; outside systems count
    under their kind. Links are summed per pair of parts before any join, so heavy pairs shrink first."""
    pairs = links.groupBy(*by, "src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    a = clusters.select(*by, F.col("part").alias("src"), F.col("cluster").alias("src_domain"))
    b = clusters.select(*by, F.col("part").alias("dst"), F.col("cluster").alias("dst_domain"))
    e = externals.select(*by, F.col("id").alias("dst"), F.col("kind").alias("ext_kind"))
    return (pairs.join(a, [*by, "src"]).join(b, [*by, "dst"], "left").join(e, [*by, "dst"], "left")
            .where("dst_domain IS NOT NULL OR ext_kind IS NOT NULL")
            .selectExpr(*by, "src_domain AS src", "coalesce(dst_domain, ext_kind) AS dst", "dst_domain IS NULL AS to_ext",
                        "weight", "n").where("to_ext OR src <> dst")
            .groupBy(*by, "src", "dst", "to_ext").agg(F.sum("weight").alias("weight"), F.sum("n").alias("links")))


def stream_kind(links: DataFrame, keys: Sequence[str], kind: str = "kind") -> DataFrame:
    """(keys, kind): what most links of a stream are; ties go to call, async beats data on a tie over call."""
    n = links.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in ("call", "async", "data")])
    return n.selectExpr(*keys, "CASE WHEN n_async > n_call AND n_async >= n_data THEN 'async' "
                        "WHEN n_data > n_call THEN 'data' ELSE 'call' END AS kind")


def stream_label(links: DataFrame, keys: Sequence[str], kind: str = "stream_kind") -> DataFrame:
    """(keys, label): a short name for each stream. links: (keys, pos, dst, how, to_ext, stream_kind).

    Everything needed from the texts is reduced per row (protocol rank, topic, first words) before grouping.
    """
    topic = r"coalesce(nullif(regexp_extract(how, '(?i)PubSub:\\s*([\\w.-]+)|([\\w.-]+) topic', 1), ''), " \
            r"nullif(regexp_extract(how, '(?i)PubSub:\\s*([\\w.-]+)|([\\w.-]+) topic', 2), ''))"
    proto = "CASE " + " ".join(f"WHEN how rlike {S.text(f'(?i){chr(92)}b{p}{chr(92)}b')} THEN {i}"
                               for i, p in enumerate(fx.PROTOCOL_LABELS)) + " END"
    few = (r"array_join(slice(split(split(how, '\\s(?:via|with|for|from|and|using|by|to|in|on|of|after)\\b|[,(:;]')[0], "
           "' '), 1, 4), ' ')")
    rows = links.selectExpr(*keys, "pos", "dst", "to_ext", f"{kind} AS k", "coalesce(how, '') AS how")
    rows = rows.selectExpr("*", f"{topic} AS topic", f"{proto} AS proto", f"{few} AS few")
    per_dst = rows.groupBy(*keys, "dst").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n"), F.max("to_ext").alias("to_ext"), F.max("k").alias("k"),
        F.expr("min_by(topic, CASE WHEN topic IS NOT NULL THEN pos END)").alias("topic"),
        F.expr("min(CASE WHEN topic IS NOT NULL THEN pos END)").alias("topic_pos"),
        F.min("proto").alias("proto"), F.min_by("few", "pos").alias("few"))
    g = per_dst.groupBy(*keys).agg(
        F.min_by("dst", "pos").alias("dst"), F.count("*").alias("dsts"), F.sum("n").alias("n"),
        F.max("to_ext").alias("to_ext"), F.max("k").alias("k"), F.min_by("topic", "topic_pos").alias("topic"),
        F.min("proto").alias("proto"), F.min_by("few", "pos").alias("few"))
    return g.selectExpr(*keys, "CASE WHEN to_ext THEN concat('→ ', dst, CASE WHEN dsts > 1 THEN concat(' +', dsts - 1) ELSE '' END) "
                        "WHEN k = 'async' THEN CASE WHEN topic IS NOT NULL THEN concat(topic, ' events') ELSE 'events' END "
                        "WHEN n = 1 AND few <> '' THEN few "
                        f"ELSE concat(n, ' calls', coalesce(concat(' · ', get({S.texts(fx.PROTOCOL_LABELS)}, proto)), '')) END AS label")


def domain_exits(links: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, domain, other, arrow): per pair of domains whether links go out, come in or both."""
    pairs = links.select(*by, "src", "dst").distinct()
    a = clusters.select(*by, F.col("part").alias("src"), F.col("cluster").alias("a"))
    b = clusters.select(*by, F.col("part").alias("dst"), F.col("cluster").alias("b"))
    d = pairs.join(a, [*by, "src"]).join(b, [*by, "dst"]).where("a <> b").select(*by, "a", "b").distinct()
    both = d.selectExpr(*by, "a AS domain", "b AS other", "true AS o").unionByName(
        d.selectExpr(*by, "b AS domain", "a AS other", "false AS o"))
    return both.groupBy(*by, "domain", "other").agg(F.max("o").alias("out"), F.max(~F.col("o")).alias("inn")).selectExpr(
        *by, "domain", "other", "CASE WHEN out AND inn THEN '↔' WHEN out THEN '→' ELSE '←' END AS arrow")


# ---- outside systems ---------------------------------------------------------------------------------
def external_groups(externals: DataFrame, links: DataFrame, uses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, id, users, rank): per kind the systems ranked by number of distinct users, then id."""
    users = links.select(*by, F.col("dst").alias("id"), "src").union(
        uses.select(*by, F.col("target").alias("id"), "src")).distinct().groupBy(*by, "id").agg(F.count("*").alias("users"))
    counted = externals.join(users, [*by, "id"], "left").select(*by, "kind", "id", F.coalesce("users", F.lit(0)).alias("users"))
    return ranked(counted, [*by, "kind"], ["-users", "id"])


def merge_externals(externals: DataFrame, uses: DataFrame, kinds: DataFrame | None = None, by: Sequence[str] = (),
                    key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(renames, merged): one name per outside system: the most used, then longest, then first spelling.

    renames: (by, name, best); merged: (by, id, kind), where a specific kind beats "other". ``key`` is SQL over
    ``name`` giving the merge key.
    """
    key = key or S.external_key("name")
    used = uses.groupBy(*by, F.col("target").alias("name")).agg(F.count("*").alias("n"))
    named = externals.select(*by, "name").distinct().join(used, [*by, "name"], "left").withColumn("k", F.expr(key))
    best = named.groupBy(*by, "k").agg(F.expr("min_by(name, struct(-coalesce(n, 0), -length(name), name))").alias("best"))
    renames = named.join(best, [*by, "k"]).select(*by, "name", "best")
    told = renames if kinds is None else renames.join(kinds.select(*by, "name", "kind"), [*by, "name"], "left")
    kind = "cast(NULL AS STRING)" if kinds is None else "kind"
    merged = told.selectExpr(*by, "best AS id", "name", f"{kind} AS kind").groupBy(*by, "id").agg(
        F.expr("coalesce(min_by(kind, CASE WHEN kind <> 'other' THEN name END), min(kind))").alias("kind"))
    return renames, merged.withColumn("kind", F.expr(f"coalesce(kind, {S.external_kind('id')})"))


def rename_targets(df: DataFrame, renames: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    r = renames.where("name <> best").select(*by, F.col("name").alias(column), F.col("best").alias("_best"))
    return df.join(r, [*by, column], "left").withColumn(column, F.coalesce("_best", column)).select(*df.columns)


# ---- parts ---------------------------------------------------------------------------------------------
def part_sizes(files: DataFrame, parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, size): non-blank lines of source, non-test files per deepest part. files: (path, code_lines)."""
    code = files.where(f"{S.is_source('path')} AND NOT {S.is_test('path')}").select(*by, "path", "code_lines")
    return _owned(code, parts, by).groupBy(*by, F.col("owner").alias("part")).agg(F.sum("code_lines").alias("size"))


def _owned(files: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    own = owner_of(files, parts.select(*by, F.col("id").alias("owner"), F.col("path").alias("folder")), by)
    return files.join(own.where("owner IS NOT NULL"), [*by, "path"])


def changes_per_part(changed: DataFrame, parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, changes): changed files per deepest owning part."""
    placed = parts.where("path <> ''")
    own = owner_of(changed, placed.select(*by, F.col("id").alias("owner"), F.col("path").alias("folder")), by)
    return own.where("owner IS NOT NULL").groupBy(*by, F.col("owner").alias("part")).agg(F.count("*").alias("changes"))


def estimate_tokens(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tokens): bytes of non-test source files of any size, divided by four."""
    kept = files.where(f"{S.is_source('path')} AND NOT {S.is_test('path')}")
    return kept.groupBy(*by).agg(F.expr("coalesce(sum(size), 0) div 4").alias("tokens"))


def overview_key(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key): changes only when a part's id, kind, targets or topics change. Each part is hashed in its own
    row; the repository key is taken over order-free sums of 120 bits of those hashes, so no repository is gathered."""
    one = ("sha1(to_json(struct(id, kind, array_sort(array_distinct(transform(uses, u -> u.target))) AS t, "
           "array_sort(publishes) AS p, array_sort(subscribes) AS s)))")
    half = lambda at: F.expr(f"cast(conv(substring(h, {at}, 15), 16, 10) AS DECIMAL(20, 0))")
    sums = parts.select(*by, F.expr(one).alias("h")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"))
    return sums.selectExpr(*by, "left(sha1(concat_ws(':', cast(n AS STRING), cast(a AS STRING), cast(b AS STRING))), 20) AS key")


def refresh_cost(plan: DataFrame, tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, parts_total, parts_changed, min_tokens, max_tokens, min_seconds, max_seconds) of an update plan
    (by, slice, action) and the tokens (by, tokens) of the slices to map; needs_model in ``plan`` marks an overview
    that is not cached."""
    if not by:
        one = F.lit(1).alias("_all")
        return refresh_cost(plan.select("*", one), tokens.select("*", one), ["_all"]).drop("_all")
    p = plan.groupBy(*by).agg(F.count("*").alias("parts_total"), F.count_if(F.expr("action = 'map'"))
                              .alias("parts_changed"), F.max("needs_overview").alias("needs_overview"))
    joined = p.join(tokens, [*by], "left")
    return joined.selectExpr(
        *by, "parts_total", "parts_changed",
        "CASE WHEN parts_changed > 0 THEN coalesce(tokens, 0) * 3 div 10 ELSE 0 END AS min_tokens",
        "CASE WHEN parts_changed > 0 THEN coalesce(tokens, 0) ELSE 0 END AS max_tokens",
        "CASE WHEN parts_changed > 0 THEN 60 WHEN needs_overview THEN 20 ELSE 2 END AS min_seconds",
        "CASE WHEN parts_changed > 0 THEN 240 WHEN needs_overview THEN 90 ELSE 30 END AS max_seconds")


def entry_of(parts: DataFrame, links: DataFrame, externals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, entry): where traffic enters: users, HTTP or CLI; null elsewhere."""
    targets = links.select(*by, F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    inner = links.join(externals.select(*by, F.col("id").alias("dst")), [*by, "dst"], "left_anti")
    outgoing = inner.select(*by, F.col("src").alias("id")).distinct().withColumn("calls", F.lit(True))
    linked = parts.join(targets, [*by, "id"], "left").join(outgoing, [*by, "id"], "left")
    return linked.selectExpr(
        *by, "id AS part", f"CASE WHEN {S.is_user_facing('kind')} OR exists(exposes, e -> e.type = 'http' AND "
        r"coalesce(e.what, '') rlike '^GET /(\\s|\\(|$)') THEN 'users' WHEN called THEN NULL "
        "WHEN exists(exposes, e -> e.type = 'http') THEN 'HTTP' "
        "WHEN exists(exposes, e -> e.type = 'cli') OR (kind = 'tool' AND calls) THEN 'CLI' END AS entry")


def domain_entries(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, label): "users ×2 · HTTP" per domain, in a fixed order. entries: (cluster, entry)."""
    names = ("users", "HTTP", "CLI")
    n = entries.where("entry IS NOT NULL").groupBy(*by, "cluster").agg(*[F.count_if(F.col("entry") == e).alias(e) for e in names])
    shown = ", ".join(f"CASE WHEN {e} > 1 THEN concat('{e} ×', {e}) WHEN {e} = 1 THEN '{e}' END" for e in names)
    return n.selectExpr(*by, "cluster", f"concat_ws(' · ', {shown}) AS label")


# ---- review --------------------------------------------------------------------------------------------
def function_risk(functions: DataFrame, changes: DataFrame, outside: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, risk): the highest severity; added and removed functions at least low; a changed signature with
    a caller outside the file is high. functions: (fn_id, status); outside: (fn_id) with such callers."""
    out = outside.select(*by, "fn_id").distinct().withColumn("called_outside", F.lit(True))
    top = changes.groupBy(*by, "fn_id").agg(F.max(F.expr(S.risk_rank("severity"))).alias("top"),
                                            F.max(F.expr("kind = 'signature'")).alias("signature"))
    joined = functions.join(top, [*by, "fn_id"], "left").join(out, [*by, "fn_id"], "left")
    rank = ("greatest(coalesce(top, 0), CASE WHEN status <> 'modified' THEN 1 ELSE 0 END, "
            "CASE WHEN signature AND called_outside THEN 3 ELSE 0 END)")
    return joined.selectExpr(*by, "fn_id", f"{S.risk_name(rank)} AS risk")


def part_risk(functions: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, risk, functions, lines): per part the top risk, number of functions and of distinct entry routes.
    functions: (part, fn_id, risk); entries: (part, line_id)."""
    f = functions.where("part IS NOT NULL").groupBy(*by, "part").agg(
        F.max(F.expr(S.risk_rank("risk"))).alias("r"), F.count("*").alias("functions"))
    lines = entries.select(*by, "part", "line_id").distinct().groupBy(*by, "part").agg(F.count("*").alias("lines"))
    return f.join(lines, [*by, "part"], "left").selectExpr(*by, "part", f"{S.risk_name('r')} AS risk", "functions",
                                                           "coalesce(lines, 0) AS lines")


def part_members(functions: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, what, id): what ``part_risk`` counts, row by row: the functions of each part under review and the distinct entry routes that
    they lie on. functions: (part, fn_id); entries: (part, line_id)."""
    f = functions.where("part IS NOT NULL")
    lines = entries.select(*by, "part", F.col("line_id").cast("string").alias("id")).distinct().join(f.select(*by, "part").distinct(), [*by, "part"], "left_semi")
    return f.select(*by, "part", F.lit("function").alias("what"), F.col("fn_id").cast("string").alias("id")).unionByName(
        lines.select(*by, "part", F.lit("line").alias("what"), "id"))


def review_stats(files: DataFrame, functions: DataFrame, changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, stat, n): files, functions by status, changes by severity."""
    out = files.groupBy(*by).agg(F.count("*").alias("n")).selectExpr(*by, "'files' AS stat", "n")
    f = functions.groupBy(*by, "status").agg(F.count("*").alias("n")).selectExpr(*by, "status AS stat", "n")
    c = changes.where("severity IN ('high', 'medium', 'low')").groupBy(*by, "severity").agg(F.count("*").alias("n")).selectExpr(
        *by, "severity AS stat", "n")
    return out.unionByName(f).unionByName(c)


def merge_gates(file_gates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, op, refs): one row per gate over files; the op stands when all files agree, else "changed"."""
    return file_gates.groupBy(*by, "gate").agg(
        F.expr("CASE WHEN min(op) = max(op) THEN min(op) ELSE 'changed' END").alias("op"), F.count("ref").alias("refs"))


def gate_refs(file_gates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, op, ref): the references of the gates that ``merge_gates`` counts, each with its gate's op over all files."""
    op = merge_gates(file_gates, by).select(*by, "gate", "op")
    return file_gates.where("ref IS NOT NULL").select(*by, "gate", "ref").join(op, [*by, "gate"]).select(*by, "gate", "op", "ref")


def change_chips(changes: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """(by, fn_id, rank, why, severity, times, more): repeated reasons folded, riskiest first, the first ``k`` with the
    number left out. changes: (fn_id, pos, why, severity)."""
    folded = changes.groupBy(*by, "fn_id", "why").agg(
        F.count("*").alias("times"), F.min("pos").alias("pos"), F.min_by("severity", "pos").alias("severity"))
    total = folded.groupBy(*by, "fn_id").agg(F.count("*").alias("_all"))
    top = top_k(folded, [*by, "fn_id"], [f"-{S.risk_rank('severity')}", "pos"], k)
    return top.join(total, [*by, "fn_id"]).selectExpr(*by, "fn_id", "rank", "why", "severity", "times",
                                                      f"greatest(_all - {k}, 0) AS more")


def effect_summary(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, op, targets): one row per operation of a function, its distinct targets in order; the text
    "writes a, b · reads c" is these rows joined. effects: (fn_id, pos, op, target)."""
    first = effects.groupBy(*by, "fn_id", "op", "target").agg(F.min("pos").alias("pos"))
    return first.groupBy(*by, "fn_id", "op").agg(ordered_text("target", ["pos"], ", ").alias("targets"))


def dedupe_effects(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, kind, target, op, line): one row per effect of a function, at its first line."""
    return effects.groupBy(*by, "fn_id", "kind", "target", "op").agg(F.min_by("line", "pos").alias("line"))


def review_progress(functions: DataFrame, marks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, total, done, percent): reviewed functions, one decimal."""
    done = marks.select(*by, "fn_id").distinct().withColumn("done", F.lit(True))
    return functions.join(done, [*by, "fn_id"], "left").groupBy(*by).agg(
        F.count("*").alias("total"), F.count("done").alias("done")).withColumn(
        "percent", F.expr("round(100.0D * done / total, 1)"))


def folder_change_counts(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, folder, files): changed files below every folder, tests and generated files left out."""
    kept = files.where(f"NOT {S.is_test('path')} AND NOT {S.is_generated('path')}").select(*by, "path").distinct()
    above = f"filter({S.ancestors('path')}, a -> a <> path AND a <> '')"
    return kept.select(*by, F.explode(F.expr(above)).alias("folder")).groupBy(*by, "folder").agg(F.count("*").alias("files"))


# ---- gates and states --------------------------------------------------------------------------------
def assemble_gates(reads: DataFrame, checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, reads, checks, default): distinct reads and checks of each gate and its default, kept only when all
    stated defaults agree. The lists themselves stay rows (``gate_rows``)."""
    r = reads.groupBy(*by, "gate").agg(F.countDistinct("ref").alias("reads"), F.min("default").alias("lo"), F.max("default").alias("hi"))
    c = checks.groupBy(*by, "gate").agg(F.countDistinct("ref").alias("checks"))
    return r.join(c, [*by, "gate"], "full").selectExpr(
        *by, "gate", "coalesce(reads, 0) AS reads", "coalesce(checks, 0) AS checks", "CASE WHEN lo = hi THEN lo END AS default")


def gate_rows(reads: DataFrame, checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, what, ref, part, text): distinct reads and checks, the first text of each reference."""
    r = reads.groupBy(*by, "gate", "ref").agg(F.min("part").alias("part")).selectExpr(
        *by, "gate", "'read' AS what", "ref", "part", "cast(NULL AS STRING) AS text")
    c = first_per(checks.select(*by, "gate", "ref", "part", "text"), [*by, "gate", "ref"], ["text"]).selectExpr(
        *by, "gate", "'check' AS what", "ref", "part", "text")
    return r.unionByName(c)


def rank_gates(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, score): 3 per check, 2 per distinct part, 1 per read. Sort by score descending, then gate."""
    ref = rows.select(*by, "gate", "what", "ref").distinct().groupBy(*by, "gate").agg(
        F.count_if(F.expr("what = 'check'")).alias("c"), F.count_if(F.expr("what = 'read'")).alias("r"))
    part = rows.select(*by, "gate", "part").distinct().groupBy(*by, "gate").agg(F.count("part").alias("p"))
    return ref.join(part, [*by, "gate"]).selectExpr(*by, "gate", "3 * c + 2 * p + r AS score")


def transition_edges(transitions: DataFrame, by: Sequence[str] = ("subject", "field"), fn: str = "fn") -> DataFrame:
    """(by, from, to, names, more): transitions folded per edge: the first two distinct functions and the rest's
    number. A null ``from`` is an edge of its own. transitions: (by, from, to, fn, pos)."""
    f = transitions.select(*by, F.col("from").alias("a"), F.coalesce("from", F.lit("\0")).alias("a_key"), F.col("to").alias("b"),
                           F.coalesce(fn, F.lit("?")).alias("name"), "pos")
    distinct = f.groupBy(*by, "a", "a_key", "b", "name").agg(F.min("pos").alias("pos"))
    key = [*by, "a_key", "b"]
    total = distinct.groupBy(*key).agg(F.count("*").alias("n"))
    two = top_k(distinct, key, ["pos", "name"], 2).groupBy(*key).agg(
        F.first("a").alias("from"), ordered_text("name", ["rank"], ", ").alias("names"))
    return two.join(total, key).select(*by, "from", F.col("b").alias("to"), "names", F.expr("greatest(n - 2, 0)").alias("more"))


def common_prefix(names: DataFrame, by: Sequence[str], name: str = "name") -> DataFrame:
    """(by, prefix): the leading words all names of a group share, cut at '_', '.' or a camelCase hump, only if every
    name is longer. The prefix of a set is the prefix of its smallest and largest member."""
    ends = names.groupBy(*by).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.min(F.length(name)).alias("shortest"))
    same = S.same_length("split(lo, '')", "split(hi, '')")
    p = ends.selectExpr(*by, "shortest", f"left(lo, least({same}, length(lo))) AS p", "hi", "lo")
    # camelCase: the names split right after the prefix when all of them go on with a capital there
    next_up = names.join(p.select(*by, "p"), [*by]).groupBy(*by).agg(
        F.min(F.expr(f"substring({name}, length(p) + 1, 1) rlike '[A-Z]'")).alias("hump_at_end"))
    mark = "greatest(length(p) - length(substring_index(p, '_', -1)), length(p) - length(substring_index(p, '.', -1)))"
    hump = ("CASE WHEN hump_at_end THEN length(p) ELSE "
            r"coalesce(array_max(filter(sequence(1, greatest(length(p) - 1, 1)), i -> i < length(p) AND "
            r"substring(p, i + 1, 1) rlike '[A-Z]')), 0) END")
    cut = p.join(next_up, [*by]).selectExpr(*by, "p", "shortest", f"CASE WHEN {mark} > 0 THEN {mark} WHEN p = '' THEN 0 ELSE {hump} END AS cut")
    return cut.selectExpr(*by, "CASE WHEN cut > 1 AND shortest > cut THEN left(p, cut) ELSE '' END AS prefix")


# ---- structure -----------------------------------------------------------------------------------------
def degree(functions: DataFrame, calls: DataFrame, part_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, fanin, outside): distinct callers inside the function's part, and calls from other parts.
    part_of: (fn_id, part). Self calls are dropped."""
    own = part_of.select(*by, F.col("fn_id").alias("dst"), F.col("part").alias("dst_part"))
    src = part_of.select(*by, F.col("fn_id").alias("src"), F.col("part").alias("src_part"))
    n = (calls.where("src <> dst").select(*by, "src", "dst").distinct().join(src, [*by, "src"]).join(own, [*by, "dst"])
         .groupBy(*by, F.col("dst").alias("fn_id")).agg(F.count_if(F.expr("src_part = dst_part")).alias("fanin"),
                                                        F.count_if(F.expr("src_part <> dst_part")).alias("outside")))
    return functions.select(*by, "fn_id").join(n, [*by, "fn_id"], "left").select(
        *by, "fn_id", F.coalesce("fanin", F.lit(0)).alias("fanin"), F.coalesce("outside", F.lit(0)).alias("outside"))


def structure_stats(functions: DataFrame, by: Sequence[str] = ("part",), tests: bool = False) -> DataFrame:
    """(by, types, methods, functions) per part; tests only when asked for."""
    kept = functions if tests else functions.where("NOT is_test AND kind <> 'Test'")
    return kept.groupBy(*by).agg(F.count_if(F.expr("kind = 'Class'")).alias("types"),
                                 F.count_if(F.expr("kind <> 'Class' AND parent IS NOT NULL")).alias("methods"),
                                 F.count_if(F.expr("kind <> 'Class' AND parent IS NULL")).alias("functions"))


def unused(functions: DataFrame, calls: DataFrame, uses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id): functions with no call in or out, no type use either way."""
    edges = calls.where("src <> dst").select(*by, "src", "dst").unionByName(uses.select(*by, "src", "dst"))
    busy = edges.select(*by, F.col("src").alias("fn_id")).union(edges.select(*by, "dst"))
    return functions.select(*by, "fn_id").join(busy, [*by, "fn_id"], "left_anti")


def method_members(functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, type_id, fn_id): the methods of each type in the same folder."""
    f = functions.withColumn("folder", F.expr(S.folder_of("path")))
    types = f.where("kind = 'Class'").select(*by, "folder", F.col("name").alias("parent"), F.col("fn_id").alias("type_id"))
    methods = f.where("kind <> 'Class' AND parent IS NOT NULL").select(*by, "folder", "parent", "fn_id")
    return methods.join(types, [*by, "folder", "parent"]).select(*by, "type_id", "fn_id")


# ---- flows ---------------------------------------------------------------------------------------------
def flow_driver(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, flow_id, driver): the actor making most of a flow's calls, at least two and at least half of its steps;
    placeholder names are ignored; ties go to the first one seen."""
    n = steps.groupBy(*by, "flow_id").agg(F.count("*").alias("n"))
    made = steps.where(f"NOT `from` rlike {S.text(fx.GENERIC_ACTOR)}").groupBy(*by, "flow_id", "from").agg(
        F.count("*").alias("made"), F.min("pos").alias("first"))
    most = made.groupBy(*by, "flow_id").agg(F.expr("max_by(struct(`from` AS driver, made), struct(made, -first))").alias("m"))
    return most.join(n, [*by, "flow_id"]).where("m.made >= 2 AND m.made * 2 >= n").select(*by, "flow_id", "m.driver")


def slice_entities(members: DataFrame, externals: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, keys, id, role, pos): what a flow or part touches in first-use order, as part, store (db, storage, queue) or
    service. members: (by, keys, id, pos)."""
    first = members.where("id IS NOT NULL").groupBy(*by, *keys, "id").agg(F.min("pos").alias("pos"))
    e = externals.select(*by, "id", "kind")
    return first.join(e, [*by, "id"], "left").selectExpr(
        *by, *keys, "id", "CASE WHEN kind IS NULL THEN 'part' WHEN kind IN ('db', 'storage', 'queue') THEN 'store' "
        "ELSE 'service' END AS role", "pos")


def flow_slice(steps: DataFrame, entities: DataFrame, externals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, flow_id, id, role, pos) of every flow; an inner actor of a part's flow stands for the part.
    entities: (id) of all parts and outside systems."""
    own = steps.groupBy(*by, "flow_id").agg(F.min("owner").alias("id")).withColumn("pos", F.lit(-1).cast("bigint"))
    ends = steps.selectExpr(*by, "flow_id", "owner", "explode(array(struct(pos * 2 AS pos, `from` AS id), struct(pos * 2 + 1 AS pos, `to` AS id))) AS e")
    ends = ends.selectExpr(*by, "flow_id", "owner", "cast(e.pos AS BIGINT) AS pos", "e.id AS id")
    known = entities.select(*by, "id").distinct().withColumn("known", F.lit(True))
    named = ends.join(known, [*by, "id"], "left").selectExpr(*by, "flow_id", "CASE WHEN known THEN id ELSE owner END AS id", "pos")
    return slice_entities(named.unionByName(own.select(*named.columns)), externals, ["flow_id"], by)


def flow_code(steps: DataFrame, keys: Sequence[str] = ("flow_id",), by: Sequence[str] = ()) -> DataFrame:
    """(by, keys, name, ref): the code a flow runs through: one entry per function, or file when none is named."""
    named = steps.selectExpr(*by, *keys, "pos", r"coalesce(nullif(fn, ''), "
                             + S.base_name(r"regexp_replace(coalesce(ref, ''), ':\\d+$', '')") + ") AS name", "coalesce(ref, '') AS ref")
    return first_per(named.where("name <> ''"), [*by, *keys, "name"], ["pos"]).select(*by, *keys, "name", "ref")


def part_slice(parts: DataFrame, uses: DataFrame, links: DataFrame, externals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, id, role, pos): what each part uses, in first-use order, and its callers (role caller)."""
    told = uses.selectExpr(*by, "src AS part", "target AS id", "cast(pos AS BIGINT) AS pos")
    linked = links.selectExpr(*by, "src AS part", "dst AS id", "1000000L AS pos")
    universe = parts.select(*by, "id").unionByName(externals.select(*by, "id")).distinct()
    used = slice_entities(told.unionByName(linked).join(universe, [*by, "id"], "left_semi").where("part <> id"), externals, ["part"], by)
    callers = links.selectExpr(*by, "dst AS part", "src AS id").distinct().join(
        parts.select(*by, F.col("id").alias("part")), [*by, "part"], "left_semi").selectExpr(
        *by, "part", "id", "'caller' AS role", "-1L AS pos")
    return used.select(*by, "part", "id", "role", "pos").unionByName(callers)
