"""Queries over maps: owners, links, domains, outside systems, snapshots, search, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from ..operators import joins, rank, rollup, search, sets, validate
from ..operators.change import fingerprint
from ..sources import records
from .registry import query
from .scalar_queries import sql_list


def uses(t):
    return records.uses_of(t.part_records)


def topics(t, column):
    return t.part_records.selectExpr("id AS part", f"explode({column}) AS topic")


def links(t):
    return rollup.all_links(uses(t), topics(t, "publishes"), topics(t, "subscribes"))


KIND_BY_LENGTH = "element_at(array('db', 'queue', 'storage', 'saas'), cast(length(id) % 4 + 1 AS INT))"
KIND_BY_LENGTH_SQL = "['db', 'queue', 'storage', 'saas'][len(id) % 4 + 1]"


def externals(t):
    ids = uses(t).selectExpr("target AS id").distinct().join(t.part_records.select("id"), "id", "left_anti")
    return ids.selectExpr("id", f"{KIND_BY_LENGTH} AS kind")


def steps(t):
    return records.flow_steps_of(t.part_records)


def changed(t):
    return sets.snapshot_diff(t.base, t.head)


# ---- sets --------------------------------------------------------------------------------------------
DIFF = """WITH gone AS (SELECT b.path, b.sha, row_number() OVER (PARTITION BY b.sha ORDER BY b.path) AS k FROM base b
      WHERE b.path NOT IN (SELECT path FROM head)),
    new AS (SELECT h.path, h.sha, row_number() OVER (PARTITION BY h.sha ORDER BY h.path) AS k FROM head h
      WHERE h.path NOT IN (SELECT path FROM base)),
    diff AS (SELECT 'modified' AS status, h.path, NULL AS old FROM base b JOIN head h ON b.path = h.path WHERE b.sha <> h.sha
    UNION ALL SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END,
      coalesce(n.path, g.path), CASE WHEN n.path IS NOT NULL THEN g.path END
      FROM gone g FULL JOIN new n ON g.sha = n.sha AND g.k = n.k) """


@query("g2_snapshot_diff", "base head", DIFF + "SELECT * FROM diff")
def snapshot_diff(t):
    return changed(t)


@query("g3_update_plan", "base head", DIFF + """,
    slices AS (SELECT regexp_replace(path, '/[^/]*$', '') AS slice, count(*) AS n, bit_xor(hash(path || sha)) AS h FROM head GROUP BY 1),
    known AS (SELECT regexp_replace(path, '/[^/]*$', '') AS slice, count(*) AS n, bit_xor(hash(path || sha)) AS h FROM base GROUP BY 1),
    touched AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS slice FROM diff WHERE status <> 'deleted')
    SELECT s.slice, CASE WHEN k.slice IS NOT NULL THEN 'cached' WHEN s.slice IN (SELECT slice FROM touched) THEN 'map' ELSE 'reuse' END AS action
    FROM slices s LEFT JOIN known k ON s.slice = k.slice AND s.n = k.n AND s.h = k.h
    WHERE k.slice IS NOT NULL OR s.slice IN (SELECT slice FROM touched) OR s.slice IN (SELECT slice FROM known)""")
def update_plan(t):
    prints = lambda df: fingerprint(df.selectExpr(f"{S.folder_of('path')} AS slice", "path", "sha"))
    old = prints(t.base)
    return sets.update_plan(prints(t.head), old, changed(t).where("status <> 'deleted'"), old).select("slice", "action")


@query("g4_entity_universe", "parts part_uses", """
    SELECT id, false AS external FROM parts UNION ALL SELECT DISTINCT target, true FROM part_uses WHERE target NOT IN (SELECT id FROM parts)""")
def entity_universe(t):
    return sets.entity_universe(t.part_records, uses(t))


@query("g6_overlay", "base head", """
    SELECT coalesce(h.path, b.path) AS path, coalesce(h.sha, b.sha) AS sha FROM base b FULL JOIN head h ON b.path = h.path""")
def overlay(t):
    return sets.overlay(t.base, t.head)


CATALOG = """SELECT kind AS "type", name, id || ' · ' || split_part(path, '/', 1) || ' — ' || summary AS sub FROM parts
    UNION ALL SELECT DISTINCT 'domain', upper(split_part(path, '/', 1)[1]) || split_part(path, '/', 1)[2:], '' FROM parts
    UNION ALL SELECT {kind}, id, 'external · used by ' || (SELECT count(DISTINCT src) FROM part_uses WHERE target = id) FROM part_externals
    UNION ALL SELECT DISTINCT 'flow', title, owner || ' · ' || "trigger" FROM part_steps
    UNION ALL SELECT 'func', name, path FROM functions
    UNION ALL SELECT DISTINCT 'env', gate, 'gate' FROM marks""".format(kind=KIND_BY_LENGTH_SQL)
CATALOG_VIEWS = "parts part_uses part_externals part_steps functions marks"


def catalog(t):
    parts = t.part_records.join(rollup.cluster_members(t.part_records).withColumnRenamed("part", "id"), "id")
    users = uses(t).groupBy(F.col("target").alias("id")).agg(F.countDistinct("src").alias("users"))
    flows = steps(t).selectExpr("title", "concat(owner, ' · ', trigger) AS sub").distinct()
    return sets.search_catalog(parts, rollup.folder_clusters(t.part_records), externals(t).join(users, "id"), flows,
                               t.functions.selectExpr("name", "path AS sub"),
                               t.marks.selectExpr("'env' AS kind", "gate AS name", "'gate' AS sub").distinct())


@query("g1_search_catalog", CATALOG_VIEWS, CATALOG)
def search_catalog(t):
    return catalog(t)


# ---- search --------------------------------------------------------------------------------------------
@query("c1_grep", "corpus_lines", """
    SELECT path || ':' || line_no AS ref, trim(text) AS text, false AS is_def FROM corpus_lines
    WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])')""")
def grep(t):
    return search.grep_files(t.corpus, "the")


@query("c1_grep_definitions", "functions", """
    SELECT path || ':' || "start" AS ref, 'class ' || name || ':' AS text, true AS is_def FROM functions WHERE name = 'ring1'
    UNION ALL SELECT path || ':' || "end", 'return ring1(' || fn_id || ')', false FROM functions""")
def grep_definitions(t):
    lines = t.functions.selectExpr("path", "start AS line_no", "concat('  class ', name, ':') AS text").unionByName(
        t.functions.selectExpr("path", "end AS line_no", "concat('  return ring1(', fn_id, ')') AS text"))
    return search.grep(lines, "ring1", limit=None)


@query("c2_list_tree", "head", """
    SELECT path FROM head WHERE path LIKE 'moved/%'""")
def list_tree(t):
    return search.list_tree(t.head, "moved")


FUZZY = """list_reduce(list_prepend({{'c': '', 'i': 0, 'score': 0.0, 'last': -2, 'j': 0, 'prev': ''}},
      list_transform(string_split(lower({s}), ''), lambda x: {{'c': x, 'i': 0, 'score': 0.0, 'last': 0, 'j': 0, 'prev': ''}})),
    lambda a, b: CASE WHEN a.i < len({q}) AND b.c = {q}[a.i + 1] THEN {{'c': b.c, 'i': a.i + 1, 'score': a.score + CASE WHEN a.last = a.j - 1
      THEN 3.0 ELSE 1.0 END + CASE WHEN a.j = 0 OR regexp_matches(a.prev, '[\\s._/·:-]') THEN 2.0 ELSE 0.0 END, 'last': a.j, 'j': a.j + 1, 'prev': b.c}}
      ELSE {{'c': b.c, 'i': a.i, 'score': a.score, 'last': a.last, 'j': a.j + 1, 'prev': b.c}} END)"""


def fuzzy_sql(q: str, s: str) -> str:
    f = FUZZY.format(q=q, s=s)
    return (f"(CASE WHEN ({f}).i = len({q}) THEN ({f}).score + CASE WHEN starts_with(lower({s}), {q}) THEN 6 ELSE 0 END - len({s}) * 0.01 "
            "ELSE -1 END)")


@query("c3_fuzzy_score", "", f"""
    SELECT DISTINCT p_name AS name, q, round(CAST({fuzzy_sql('q', 'p_name')} AS DOUBLE), 4) AS score FROM part, (SELECT unnest(['sr', 'blue g', 'wid', 'zz']) AS q)""")
def fuzzy(t):
    rows = t.external_names.select("name", F.explode(F.array(*[F.lit(q) for q in ("sr", "blue g", "wid", "zz")])).alias("q"))
    return rows.selectExpr("name", "q", f"round({S.fuzzy_score('q', 'name')}, 4) AS score")


@query("c4_search", CATALOG_VIEWS, f"""
    WITH cat AS ({CATALOG}), qs AS (SELECT unnest(['ring', 'p1', 'purchase']) AS q),
    s AS (SELECT q, name, sub, greatest({fuzzy_sql('q', 'name')}, {fuzzy_sql('q', 'sub')} * 0.4) AS score FROM cat, qs),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(CAST(score AS DOUBLE), 6) DESC, name, sub) AS rank FROM s WHERE score > 0)
    SELECT q AS query, rank, name, round(CAST(score AS DOUBLE), 4) AS score FROM r WHERE rank <= 9""")
def search_query(t):
    rows = catalog(t).withColumn("pos", F.struct("name", "sub"))
    return search.search(rows, ["Ring ", "p1", "purchase"]).select("query", "rank", "name", F.round("score", 4).alias("score"))


@query("c5_find_files", "site_paths", f"""
    WITH qs AS (SELECT unnest(['fr82', 'example', '']) AS q), p AS (SELECT DISTINCT path, split_part(path, '/', -1) AS base FROM site_paths),
    s AS (SELECT q, path, CASE WHEN q = '' THEN 1 ELSE greatest({fuzzy_sql('q', 'base')} * 2, {fuzzy_sql('q', 'path')}) END AS score FROM p, qs),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(CAST(score AS DOUBLE), 6) DESC, path) AS rank FROM s WHERE score > 0)
    SELECT q AS query, rank, path, round(CAST(score AS DOUBLE), 4) AS score FROM r WHERE rank <= 20""")
def find_files(t):
    return search.find_files(t.site_paths.select("path").distinct(), ["fr82", "example", ""]).select(
        "query", "rank", "path", F.round("score", 4).alias("score"))


@query("c6_filter_words", "", """
    SELECT p_partkey, 'all' AS mode FROM part WHERE lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%ring%'
      AND lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%eco%'
    UNION ALL SELECT p_partkey, 'any' FROM part WHERE lower(p_name) LIKE '%d ring%' OR lower(p_brand) LIKE '%d ring%'""")
def filter_words(t):
    every = search.filter_words(t.part, "Ring eco", ["p_name", "p_brand", "p_type"])
    any_ = search.filter_words(t.part, "d Ring", ["p_name", "p_brand"], mode="any")
    return every.selectExpr("p_partkey", "'all' AS mode").unionByName(any_.selectExpr("p_partkey", "'any' AS mode"))


@query("c7_resolve_suffix", "corpus", """
    SELECT ref, CASE WHEN i % 3 = 0 THEN ref WHEN hit IS NULL THEN ref ELSE hit || ':' || i END AS path FROM (
      SELECT doc_id AS i, CASE doc_id % 3 WHEN 0 THEN 'x/' || doc_id || '.txt:' || doc_id WHEN 1 THEN doc_id || '.txt:' || doc_id ELSE 'no' || doc_id || '.md:1' END AS ref,
        CASE WHEN doc_id % 3 = 1 THEN (SELECT min(path) FROM corpus d WHERE split_part(d.path, '/', 3) = c.doc_id || '.txt') END AS hit FROM corpus c)""")
def resolve_suffix(t):
    refs = t.corpus.selectExpr("CASE doc_id % 3 WHEN 0 THEN concat('x/', doc_id, '.txt:', doc_id) WHEN 1 THEN concat(doc_id, '.txt:', doc_id) "
                               "ELSE concat('no', doc_id, '.md:1') END AS ref")
    return search.resolve_suffix(refs, t.corpus)


@query("c10_steps_at", "parts part_steps", """
    WITH pl AS (SELECT id AS place_id, path || '/main.py' AS path, k % 30 + 1 AS line, CASE WHEN k % 3 = 0 THEN 'run' || k % 13 END AS word, k FROM parts),
    fns AS (SELECT path || '/main.py' AS path, 'run' AS name, 10 AS s, 20 AS e FROM parts),
    st AS (SELECT *, regexp_extract(ref, '^(.+):([0-9]+)$', 1) AS p, CAST(regexp_extract(ref, ':([0-9]+)$', 1) AS INT) AS l FROM part_steps),
    w AS (SELECT place_id, flow_id, pos, CASE WHEN p = path THEN 3.0 ELSE 2.0 END AS score FROM pl JOIN st
      ON fn = word OR split_part("from", '.', -1) = word OR split_part("to", '.', -1) = word),
    h AS (SELECT place_id, flow_id, st.pos, CASE WHEN s IS NOT NULL THEN CASE WHEN l >= s AND l < e THEN 3 - least(2, abs(l - line) / 50.0)
        WHEN split_part("from", '.', -1) = 'run' OR split_part("to", '.', -1) = 'run' THEN 1 END
      WHEN abs(l - line) <= 3 THEN 3 - least(2, abs(l - line) / 50.0) END AS score
      FROM pl JOIN st ON p = pl.path LEFT JOIN fns ON fns.path = pl.path AND line BETWEEN s AND e WHERE word IS NULL)
    SELECT place_id, flow_id, pos, round(CAST(score AS DOUBLE), 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, flow_id, pos) AS r FROM
        (SELECT * FROM w UNION ALL SELECT * FROM h WHERE score > 0)) WHERE r <= 12""")
def steps_at(t):
    k = "cast(substring(id, 2) AS BIGINT)"
    places = t.part_records.selectExpr("id AS place_id", "concat(path, '/main.py') AS path", f"{k} % 30 + 1 AS line",
                                       f"CASE WHEN {k} % 3 = 0 THEN concat('run', {k} % 13) END AS word")
    fns = t.part_records.selectExpr("concat(path, '/main.py') AS path", "'run' AS name", "10L AS start", "20L AS end")
    return search.steps_at(steps(t), fns, places)


# ---- owners --------------------------------------------------------------------------------------------
@query("d1_owner_of", "site_paths site_owners", """
    SELECT DISTINCT p.path, coalesce(s.owner, h.owner) AS owner FROM site_paths p
    LEFT JOIN site_owners h ON h.folder = split_part(p.path, '/', 1)
    LEFT JOIN site_owners s ON s.owner LIKE 'section:%' AND s.folder = split_part(p.path, '/', 1) || '/' || split_part(p.path, '/', 2)""")
def owner_of(t):
    return joins.owner_of(t.site_paths, t.site_owners)


@query("d1_below_any", "site_paths", """
    SELECT DISTINCT path FROM site_paths WHERE split_part(path, '/', 1) IN (
      SELECT split_part(path, '/', 1) FROM site_paths WHERE page_id % 7 = 0)""")
def below_any(t):
    folders = t.site_paths.where("page_id % 7 = 0").selectExpr("substring_index(path, '/', 1) AS folder")
    return joins.below_any(t.site_paths, folders)


@query("e9_changes_per_part", "base head", DIFF + """
    SELECT split_part(path, '/', 1) || CASE WHEN path LIKE 'moved/%' OR split_part(path, '/', 2) <> 'en' THEN '' ELSE '/en' END AS part, count(*) AS changes
    FROM diff GROUP BY 1""")
def changes_per_part(t):
    """Parts are the top folders and their English subfolders; changed files count for the deepest one."""
    top = t.corpus.selectExpr("substring_index(path, '/', 1) AS id", "substring_index(path, '/', 1) AS path")
    english = t.corpus.selectExpr("concat(substring_index(path, '/', 1), '/en') AS id", "concat(substring_index(path, '/', 1), '/en') AS path")
    parts = top.union(english).union(t.corpus.selectExpr("'moved' AS id", "'moved' AS path")).distinct()
    return rollup.changes_per_part(changed(t), parts)


@query("e8_part_sizes", "parts part_uses functions", """
    SELECT 'app/k' || p_partkey // 20 % 7 AS part, sum(p_size) AS size FROM part GROUP BY 1""")
def part_sizes(t):
    files = t.functions.selectExpr("fn_id", "path").join(t.part.selectExpr("p_partkey AS fn_id", "p_size"), "fn_id").groupBy("path").agg(
        F.sum("p_size").alias("code_lines"))
    parts = t.functions.selectExpr(f"{S.folder_of('path')} AS id", f"{S.folder_of('path')} AS path").distinct()
    root = parts.selectExpr("substring_index(id, '/', 1) AS id", "substring_index(id, '/', 1) AS path").distinct()
    return rollup.part_sizes(files, parts.unionByName(root))


@query("e28_folder_change_counts", "site_paths", """
    WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM site_paths)
    SELECT folder, count(*) AS files FROM (SELECT path, array_to_string(parts[1:i], '/') AS folder FROM (
      SELECT path, parts, unnest(range(1, len(parts))) AS i FROM p)) GROUP BY folder""")
def folder_change_counts(t):
    return rollup.folder_change_counts(t.site_paths)


# ---- links -----------------------------------------------------------------------------------------------
@query("d3_topic_links", "part_publishes part_subscribes", """
    SELECT DISTINCT p.part AS src, s.part AS dst, 'PubSub: ' || p.topic AS how, 1 AS weight FROM part_publishes p
    JOIN part_subscribes s ON p.topic = s.topic AND p.part <> s.part""")
def topic_links(t):
    return joins.topic_links(topics(t, "publishes"), topics(t, "subscribes"))


@query("e1_use_links", "external_uses", """
    SELECT src, target AS dst, arg_min(how, pos) AS how, count(*) AS weight FROM (
      SELECT src, target, pos, l_linenumber || ' calls' AS how FROM external_uses) GROUP BY src, target""")
def use_links(t):
    first = t.external_uses.selectExpr("src", "target", "concat(l_linenumber, ' calls') AS how", "pos")
    return rollup.use_links(first)


@query("e1_all_links", "part_links", "SELECT * FROM part_links")
def all_links(t):
    return links(t)


@query("e2_folder_clusters", "site_paths", f"""
    SELECT id, translate(id, '-_', '  ') AS name, '' AS summary, {sql_list(fx.PALETTE)}[(row_number() OVER (ORDER BY id) - 1) % 8 + 1] AS color, members FROM (
      SELECT split_part(path, '/', 1) AS id, count(*) AS members FROM site_paths GROUP BY 1)""")
def folder_clusters(t):
    parts = t.site_paths.selectExpr("cast(page_id AS STRING) AS id", "path")
    return rollup.folder_clusters(parts).withColumn("name", F.expr("lower(name)"))


DOMAINS = "SELECT n_nationkey AS part, r_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey"


def trade_domains(t):
    return t.nation.join(t.region, F.expr("n_regionkey = r_regionkey")).selectExpr("n_nationkey AS part", "r_name AS cluster")


@query("e3_domain_streams", "trade", f"""
    WITH d AS ({DOMAINS}), l AS (SELECT src, dst, count(*) AS weight FROM trade GROUP BY src, dst)
    SELECT a.cluster AS src, b.cluster AS dst, false AS to_ext, sum(weight) AS weight, count(*) AS links
    FROM l JOIN d a ON l.src = a.part JOIN d b ON l.dst = b.part WHERE a.cluster <> b.cluster GROUP BY 1, 2
    UNION ALL SELECT a.cluster, 'db', true, sum(weight), count(*) FROM (SELECT src, flag, count(*) AS weight FROM trade GROUP BY src, flag) l
      JOIN d a ON l.src = a.part GROUP BY 1""")
def domain_streams(t):
    inner = t.trade.selectExpr("cast(src AS STRING) AS src", "cast(dst AS STRING) AS dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    outer = t.trade.selectExpr("cast(src AS STRING) AS src", "concat('x', flag) AS dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    ext = t.trade.selectExpr("concat('x', flag) AS id", "'db' AS kind").distinct()
    clusters = trade_domains(t).selectExpr("cast(part AS STRING) AS part", "cluster")
    return rollup.domain_streams(inner.unionByName(outer), clusters, ext)


@query("e4_stream_kind", "trade", """
    SELECT src, dst, CASE WHEN a > c AND a >= d THEN 'async' WHEN d > c THEN 'data' ELSE 'call' END AS kind FROM (
      SELECT src, dst, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'R') AS d, count(*) FILTER (flag = 'N') AS c
      FROM trade GROUP BY src, dst)""")
def stream_kind(t):
    kinds = t.trade.selectExpr("src", "dst", "CASE flag WHEN 'A' THEN 'async' WHEN 'R' THEN 'data' ELSE 'call' END AS kind")
    return rollup.stream_kind(kinds, ["src", "dst"])


@query("e5_stream_label", "part_links parts", """
    WITH l AS (SELECT src, dst, how, dst NOT IN (SELECT id FROM parts) AS to_ext, row_number() OVER (ORDER BY src, dst, how) AS pos,
        CAST(substring(src, 2) AS BIGINT) % 40 AS stream FROM part_links),
    g AS (SELECT stream, to_ext, count(*) AS n, count(DISTINCT dst) AS dsts, arg_min(dst, pos) AS first, string_agg(how, ' ' ORDER BY pos) AS text,
        arg_min(how, pos) AS how FROM l GROUP BY stream, to_ext)
    SELECT stream, to_ext, CASE WHEN to_ext THEN '→ ' || first || CASE WHEN dsts > 1 THEN ' +' || (dsts - 1) ELSE '' END
      WHEN stream % 2 = 0 THEN CASE WHEN text LIKE '%PubSub: %' THEN regexp_extract(text, 'PubSub: ([a-z0-9]+)', 1) || ' events' ELSE 'events' END
      WHEN n = 1 THEN array_to_string(string_split(regexp_replace(how, '( via|[:]| to ).*$', ''), ' ')[1:4], ' ')
      ELSE n || ' calls' || CASE WHEN text LIKE '%gRPC%' THEN ' · gRPC' WHEN text LIKE '%HTTP%' THEN ' · HTTP' ELSE '' END END AS label FROM g""")
def stream_label(t):
    inner = t.part_records.selectExpr("id AS dst", "true AS known")
    l = links(t).join(inner, "dst", "left").selectExpr(
        "src", "dst", "how", "known IS NULL AS to_ext", "struct(src, dst, how) AS pos", "cast(substring(src, 2) AS BIGINT) % 40 AS stream",
        "CASE WHEN cast(substring(src, 2) AS BIGINT) % 40 % 2 = 0 THEN 'async' ELSE 'call' END AS stream_kind")
    return rollup.stream_label(l.withColumn("ext", F.col("to_ext")), ["stream", "ext"]).withColumnRenamed("ext", "to_ext")


@query("e31_domain_exits", "part_links parts", """
    WITH d AS (SELECT id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS cluster FROM parts),
    p AS (SELECT DISTINCT a.cluster AS a, b.cluster AS b FROM part_links l JOIN d a ON l.src = a.id JOIN d b ON l.dst = b.id WHERE a.cluster <> b.cluster),
    u AS (SELECT a AS domain, b AS other, 1 AS o FROM p UNION ALL SELECT b, a, 2 FROM p)
    SELECT domain, other, ['→', '←', '↔'][CAST(sum(o) AS INT)] AS arrow FROM u GROUP BY domain, other""")
def domain_exits(t):
    clusters = t.part_records.selectExpr("id AS part", "substring_index(path, '/', 2) AS cluster")
    return rollup.domain_exits(links(t), clusters)


# ---- outside systems -----------------------------------------------------------------------------------
@query("e6_external_groups", "external_uses", """
    SELECT id[1] AS kind, id, users, row_number() OVER (PARTITION BY id[1] ORDER BY users DESC, id) AS rank FROM (
      SELECT target AS id, count(DISTINCT src) AS users FROM external_uses GROUP BY target)""")
def external_groups(t):
    ext = t.external_names.selectExpr("name AS id", "left(name, 1) AS kind")
    half = t.external_uses
    return rollup.external_groups(ext, half.where("l_linenumber <= 3").selectExpr("src", "target AS dst"), half.where("l_linenumber > 3"))


MERGED = """WITH n AS (SELECT name, array_to_string(list_filter(string_split(name, ' '), lambda w: w NOT IN
      ('big', 'blue', 'fast', 'green', 'old', 'red', 'slow', 'small')), '') AS k, (SELECT count(*) FROM external_uses WHERE target = name) AS n FROM external_names),
    r AS (SELECT name, k, first_value(name) OVER (PARTITION BY k ORDER BY n DESC, len(name) DESC, name) AS best FROM n) """


@query("e7_merge_externals", "external_names external_uses", MERGED + "SELECT name, best FROM r")
def merge_externals(t):
    key = S.external_key_of({}, t.GENERIC).replace("@name", "name")
    return rollup.merge_externals(t.external_names, t.external_uses, key=key)[0]


@query("e7_merged_kinds", "external_names external_uses", MERGED + """
    SELECT best AS id, coalesce(arg_min(kind, name) FILTER (kind <> 'other'), 'other') AS kind FROM (
      SELECT *, ['db', 'other', 'queue'][len(name) % 3 + 1] AS kind FROM r) GROUP BY best""")
def merged_kinds(t):
    key = S.external_key_of({}, t.GENERIC).replace("@name", "name")
    kinds = t.external_names.selectExpr("name", "get(array('db', 'other', 'queue'), cast(length(name) % 3 AS INT)) AS kind")
    return rollup.merge_externals(t.external_names, t.external_uses, kinds, key=key)[1]


@query("e7_rename_targets", "external_names external_uses", MERGED + """
    SELECT src, best AS target, count(*) AS n FROM external_uses JOIN r ON target = name GROUP BY 1, 2""")
def rename_targets(t):
    key = S.external_key_of({}, t.GENERIC).replace("@name", "name")
    renames, _ = rollup.merge_externals(t.external_names, t.external_uses, key=key)
    return rollup.rename_targets(t.external_uses, renames, "target").groupBy("src", "target").agg(F.count("*").alias("n"))


@query("d21_external_usage", "external_uses", """
    SELECT target AS id, src, count(*) AS times, min(pos) AS first_pos FROM external_uses GROUP BY 1, 2""")
def external_usage(t):
    u = t.external_uses.withColumn("ref", F.col("pos"))
    return joins.external_usage(u, t.external_names.selectExpr("name AS id")).withColumnRenamed("first_ref", "first_pos")


# ---- parts and domains -----------------------------------------------------------------------------------
@query("e19_domain_entries", "parts part_exposes part_links", """
    WITH e AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS cluster, CASE
      WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'http' AND what = 'GET /') THEN 'users'
      WHEN id IN (SELECT dst FROM part_links) THEN NULL
      WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'http') THEN 'HTTP'
      WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'cli') OR
        (kind = 'tool' AND EXISTS (SELECT 1 FROM part_links l WHERE l.src = p.id AND l.dst IN (SELECT id FROM parts))) THEN 'CLI' END AS entry FROM parts p),
    n AS (SELECT cluster, entry, count(*) AS n FROM e WHERE entry IS NOT NULL GROUP BY 1, 2)
    SELECT cluster, string_agg(entry || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ' · ' ORDER BY CASE entry WHEN 'users' THEN 0 WHEN 'HTTP' THEN 1 ELSE 2 END) AS label
    FROM n GROUP BY cluster""")
def domain_entries(t):
    e = rollup.entry_of(t.part_records, links(t), externals(t))
    clusters = t.part_records.selectExpr("id AS part", "substring_index(path, '/', 2) AS cluster")
    return rollup.domain_entries(e.join(clusters, "part"))


@query("e22_flow_driver", "", """
    WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 AND event_type <> 'view' THEN 'ctl' ELSE event_type END AS event_type FROM events),
    c AS (SELECT user_id, event_type, count(*) AS made, min(event_id) AS first, sum(count(*)) OVER (PARTITION BY user_id) AS n FROM e
      GROUP BY 1, 2)
    SELECT 'u' || user_id AS flow_id, event_type AS driver FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY made DESC, first) AS r FROM c WHERE event_type <> 'view')
    WHERE r = 1 AND made >= 2 AND made * 2 >= n""")
def flow_driver(t):
    s = t.events.selectExpr("concat('u', user_id) AS flow_id", "CASE WHEN event_type = 'view' THEN 'Caller' WHEN user_id % 2 = 0 THEN 'ctl' ELSE event_type END AS `from`", "event_id AS pos")
    return rollup.flow_driver(s)


@query("e23_flow_slice", "parts part_externals part_steps", f"""
    WITH u AS (SELECT id FROM parts UNION SELECT id FROM part_externals),
    e AS (SELECT flow_id, owner, pos * 2 AS pos, "from" AS id FROM part_steps UNION ALL SELECT flow_id, owner, pos * 2 + 1, "to" FROM part_steps),
    w AS (SELECT flow_id, CASE WHEN id IN (SELECT id FROM u) THEN id ELSE owner END AS id, pos FROM e
      UNION ALL SELECT DISTINCT flow_id, owner, -1 FROM part_steps)
    SELECT flow_id, id, CASE WHEN id IN (SELECT id FROM parts) THEN 'part' WHEN {KIND_BY_LENGTH_SQL} = 'saas' THEN 'service' ELSE 'store' END AS role,
      min(pos) AS pos FROM w GROUP BY flow_id, id""")
def flow_slice(t):
    ext = externals(t)
    return rollup.flow_slice(steps(t), t.part_records.select("id").unionByName(ext.select("id")), ext)


@query("e23_part_slice", "parts part_externals part_uses part_links", f"""
    WITH u AS (SELECT src AS part, target AS id, pos FROM part_uses UNION ALL SELECT src, dst, 1000000 FROM part_links)
    SELECT part, id, CASE WHEN id IN (SELECT id FROM parts) THEN 'part' WHEN {KIND_BY_LENGTH_SQL} = 'saas' THEN 'service' ELSE 'store' END AS role,
      min(pos) AS pos FROM u WHERE part <> id AND (id IN (SELECT id FROM parts) OR id IN (SELECT id FROM part_externals)) GROUP BY 1, 2
    UNION ALL SELECT DISTINCT dst, src, 'caller', -1 FROM part_links WHERE dst IN (SELECT id FROM parts)""")
def part_slice(t):
    return rollup.part_slice(t.part_records, uses(t), links(t), externals(t))


@query("e23_flow_code", "part_steps", """
    SELECT flow_id, name, arg_min(ref, pos) AS ref FROM (SELECT flow_id, pos, coalesce(fn, 'main.py') AS name, ref FROM part_steps) GROUP BY 1, 2""")
def flow_code(t):
    return rollup.flow_code(steps(t))


@query("d18_flows_through", "part_steps", """
    WITH a AS (SELECT DISTINCT flow_id, "from" AS id FROM part_steps UNION SELECT flow_id, "to" FROM part_steps),
    s AS (SELECT DISTINCT flow_id AS seed, owner AS id FROM part_steps)
    SELECT seed, flow_id, count(*) AS shared FROM s JOIN a USING (id) WHERE seed <> flow_id GROUP BY 1, 2""")
def flows_through(t):
    return joins.flows_through(steps(t), steps(t).selectExpr("flow_id AS seed", "owner AS id"))


@query("e24_refresh_cost", "repo_paths", """
    SELECT CAST(k % 5 AS BIGINT) AS repo, count(*) AS parts_total, count(*) FILTER (k % 5 <> 0 AND k % 3 = 0) AS parts_changed,
      CASE WHEN k % 5 = 0 THEN 0 ELSE sum(size) // 4 * 3 // 10 END AS min_tokens, CASE WHEN k % 5 = 0 THEN 0 ELSE sum(size) // 4 END AS max_tokens,
      CASE WHEN k % 5 = 0 THEN 20 ELSE 60 END AS min_seconds, CASE WHEN k % 5 = 0 THEN 90 ELSE 240 END AS max_seconds
    FROM repo_paths GROUP BY k % 5""")
def refresh_cost(t):
    p = t.repo_paths.selectExpr("k % 5 AS repo", "path AS slice", "CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'map' ELSE 'cached' END AS action",
                                "k % 10 = 0 AS needs_overview")
    tokens = t.repo_paths.selectExpr("k % 5 AS repo", "size").groupBy("repo").agg(F.expr("sum(size) div 4").alias("tokens"))
    return rollup.refresh_cost(p, tokens, ["repo"])


@query("e25_overview_key", "parts part_uses", """
    WITH r AS (SELECT 'p' || k % 50 AS grp, md5(string_agg(kind || summary, ',' ORDER BY kind || summary)) AS a,
      md5(string_agg(kind || CASE WHEN k % 50 % 2 = 0 THEN kind ELSE 'x' END, ',' ORDER BY kind || k)) AS b FROM parts GROUP BY 1)
    SELECT grp, CAST(substring(grp, 2) AS INT) % 2 = 0 AS same FROM r""")
def overview_key(t):
    """Even groups change only summaries between two maps, odd ones change a part's kind."""
    before = t.part_records.selectExpr("concat('p', cast(substring(id, 2) AS BIGINT) % 50) AS grp", "*")
    after = before.withColumn("summary", F.lit("new")).withColumn(
        "kind", F.expr("CASE WHEN cast(substring(grp, 2) AS INT) % 2 = 0 THEN kind ELSE 'x' END"))
    a = rollup.overview_key(before, ["grp"]).withColumnRenamed("key", "a")
    b = rollup.overview_key(after, ["grp"]).withColumnRenamed("key", "b")
    return a.join(b, "grp").selectExpr("grp", "a = b AS same")


# ---- ranks ---------------------------------------------------------------------------------------------
@query("f2_assign_batches", "repo_paths")
def assign_batches(t):
    """The greedy batches of five repositories, with every batch's load."""
    items = t.repo_paths.selectExpr("k % 5 AS repo", "path AS id", "size")
    return rank.assign_batches(items, 16, ["repo"]).groupBy("repo", "batch").agg(F.count("*").alias("items"), F.sum("size").alias("load"))


@query("f3_unique_ids", "", """
    WITH p AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') || p_partkey % 3 AS path FROM part),
    n AS (SELECT path, split_part(path, '/', 2) AS name, count(*) OVER (PARTITION BY split_part(path, '/', 2)) AS n FROM p)
    SELECT path, CASE WHEN n = 1 THEN name ELSE replace(path, '/', '-') END AS id FROM n""")
def unique_ids(t):
    return rank.unique_ids(t.part.selectExpr("concat(lower(p_type), '/', replace(p_name, ' ', '_'), p_partkey % 3) AS path"))


@query("f3_function_ids", "functions", """
    WITH n AS (SELECT fn_id, "start", path || '::' || CASE WHEN count(*) OVER (PARTITION BY path, name) > 1 AND parent IS NOT NULL
        THEN parent || '.' || name ELSE name END AS id FROM functions)
    SELECT fn_id, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY "start", fn_id) = 1 THEN id ELSE id || '@' || "start" END AS id FROM n""")
def function_ids(t):
    return rank.function_ids(t.functions)


@query("f4_first_per", "", """
    SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def first_per(t):
    from ..operators.ordered import first_per as first
    return first(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("f10_default_ref", "", f"""
    WITH r AS (SELECT o_custkey AS repo, CASE o_orderkey % 4 WHEN 0 THEN 'master' WHEN 1 THEN 'feature' WHEN 2 THEN 'origin/dev' ELSE 'origin/HEAD' END AS name,
      CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'origin/trunk' END AS target FROM orders)
    SELECT repo, CASE WHEN bool_or(target IS NOT NULL) THEN 'origin/trunk' WHEN bool_or(name = 'master') THEN 'master' ELSE 'origin/dev' END AS name FROM r
    WHERE name IN ('master', 'origin/dev') OR target IS NOT NULL GROUP BY repo""")
def default_ref(t):
    refs = t.orders.selectExpr(
        "o_custkey AS repo", "get(array('master', 'feature', 'origin/dev', 'origin/HEAD'), cast(o_orderkey % 4 AS INT)) AS name",
        "CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'origin/trunk' END AS target")
    return rank.default_ref(refs)


@query("f11_hunks", "", """
    WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN '-' WHEN 'click' THEN '+' ELSE '=' END AS op FROM events),
    p AS (SELECT *, lag(op, 1, '=') OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM e),
    h AS (SELECT *, sum(CASE WHEN op <> '=' AND prev = '=' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS hunk FROM p)
    SELECT user_id, hunk, min(event_id) AS base_start, count(*) FILTER (op = '-') AS base_lines, min(event_id) AS head_start, count(*) FILTER (op = '+') AS head_lines
    FROM h WHERE op <> '=' GROUP BY 1, 2""")
def hunks(t):
    ops = t.events.selectExpr("user_id", "event_id AS pos", "CASE event_type WHEN 'error' THEN '-' WHEN 'click' THEN '+' ELSE '=' END AS op",
                              "event_id AS base_line", "event_id AS head_line")
    return rank.hunks(ops, ["user_id"])


# ---- validation ------------------------------------------------------------------------------------------
@query("k1_valid_clusters", "parts", """
    WITH c AS (SELECT o_orderkey AS pos, 'c' || o_custkey % 20 AS cluster, 'p' || (o_custkey % 7 * 300 + o_orderkey % 211) AS part FROM orders)
    SELECT id AS part, coalesce(arg_min(cluster, pos), 'other') AS cluster FROM parts LEFT JOIN c ON c.part = id GROUP BY id""")
def valid_clusters(t):
    claims = t.orders.selectExpr("o_orderkey AS pos", "concat('c', o_custkey % 20) AS cluster", "concat('p', o_custkey % 7 * 300 + o_orderkey % 211) AS part")
    return validate.valid_clusters(claims, t.part_records)


@query("k1_valid_colors", "", f"""
    SELECT p_partkey AS pos, 'c' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '#38bdf8' ELSE {sql_list(fx.PALETTE)}[p_partkey % 8 + 1] END AS color FROM part""")
def valid_colors(t):
    c = t.part.selectExpr("p_partkey AS pos", "concat('c', p_partkey) AS id", "CASE WHEN p_partkey % 2 = 0 THEN '#38bdf8' ELSE p_brand END AS color")
    return validate.valid_colors(c)


@query("k2_valid_flows", "parts part_externals part_steps part_exposes", """
    WITH u AS (SELECT id FROM parts UNION SELECT id FROM part_externals UNION SELECT id || '.run' FROM parts),
    s AS (SELECT * FROM part_steps WHERE "from" IN (SELECT id FROM u) AND "to" IN (SELECT id FROM u))
    SELECT flow_id, pos, CASE WHEN ref IN (SELECT ref FROM part_exposes) THEN ref END AS ref FROM s
    WHERE flow_id IN (SELECT flow_id FROM s GROUP BY 1 HAVING count(*) >= 2)""")
def valid_flows(t):
    actors = t.part_records.select("id").unionByName(externals(t).select("id")).unionByName(
        t.part_records.selectExpr("concat(id, '.run') AS id"))
    return validate.valid_flows(steps(t), actors, records.exposes_of(t.part_records)).select("flow_id", "pos", "ref")


@query("k3_valid_kinds", "external_names", """
    SELECT name AS id, CASE WHEN len(name) % 3 = 0 THEN 'queue' ELSE 'other' END AS kind FROM external_names""")
def valid_kinds(t):
    ext = t.external_names.selectExpr("name AS id")
    claims = t.external_names.selectExpr("name AS id", "get(array('queue', 'banana', 'service'), cast(length(name) % 3 AS INT)) AS kind")
    return validate.valid_kinds(ext, claims)


@query("k4_valid_actions", "parts part_steps corpus", """
    WITH e AS (SELECT event_id AS k, user_id AS u FROM events)
    SELECT k AS action_id, 'focus' AS "type", 'p' || u * 20 AS name, NULL AS names FROM e WHERE k % 7 = 0 AND 'p' || u * 20 IN (SELECT id FROM parts)
    UNION ALL SELECT k, 'play', 'p' || u || '#0', NULL FROM e WHERE k % 7 = 1 AND 'p' || u || '#0' IN (SELECT flow_id FROM part_steps)
    UNION ALL SELECT k, 'feature', 'p' || u * 20, NULL FROM e WHERE k % 7 = 2 AND 'p' || u * 20 IN (SELECT id FROM parts)
    UNION ALL SELECT k, 'highlight', NULL, CASE WHEN u * 20 < (SELECT count(*) FROM parts) THEN ['p' || u * 20, 'p1'] ELSE ['p1'] END FROM e WHERE k % 7 = 3
    UNION ALL SELECT k, 'filter', NULL, ['job'] FROM e WHERE k % 7 = 4 AND u % 2 = 0
    UNION ALL SELECT k, 'overview', NULL, NULL FROM e WHERE k % 7 = 5
    UNION ALL SELECT k, 'code', c.path || ':3', NULL FROM e JOIN corpus c ON c.doc_id = u * 10 WHERE k % 7 = 6""".replace(
    "SELECT k AS action_id", "SELECT action_id, \"type\", name, array_to_string(names, ',') AS names FROM (SELECT k AS action_id", 1) + ")")
def valid_actions(t):
    e = t.events.join(t.corpus.selectExpr("doc_id", "path"), F.expr("doc_id = user_id * 10"), "left")
    a = e.selectExpr(
        "event_id AS action_id", "get(array('focus', 'play', 'feature', 'highlight', 'filter', 'overview', 'code'), cast(event_id % 7 AS INT)) AS type",
        "concat('p', user_id * 20) AS id", "CASE WHEN event_id % 7 = 1 THEN concat('p', user_id, '#0') END AS flow", "concat('p', user_id * 20) AS part",
        "array(concat('p', user_id * 20), 'nobody', 'p1') AS ids", "CASE WHEN user_id % 2 = 0 THEN array('job', 'planet') ELSE array('planet') END AS kinds",
        "concat(coalesce(path, 'gone.txt'), ':3') AS ref")
    out = validate.valid_actions(a, t.part_records, t.part_records, steps(t), t.corpus)
    return out.withColumn("names", F.array_join("names", ","))


@query("k5_valid_labels", "steps", r"""
    SELECT d.doc_id AS step_id, CASE WHEN len(s) <= 80 THEN s ELSE s[:79] || '…' END AS label FROM (
      SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) d WHERE s <> '' AND doc_id IN (SELECT pos FROM steps)""")
def valid_labels(t):
    labels = t.documents.selectExpr("doc_id AS step_id", "text AS label")
    return validate.valid_labels(labels, t.steps.selectExpr("pos AS step_id"))
