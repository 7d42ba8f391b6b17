"""Queries over sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.change import fingerprint
from ..operators.mapping import build_map
from ..operators.rollup import cluster_members, folder_clusters
from ..session import checkpoint_folder
from ..sources import exports, files, records, sinks
from .registry import query


@query("a1_read_tree")
def read_tree(t):
    return files.read_tree(t.spark, t.folder, content=False).select("path", "size", "sha")


@query("a1_blob_sha", "corpus", """
    SELECT path, sha1(encode('blob ' || size) || '\\x00'::BLOB || encode(content)) AS sha FROM corpus""")
def blob_sha(t):
    return t.corpus.select("path", files.blob_sha(F.col("content")).alias("sha"))


@query("a1_ignored", "repo_paths", """
    SELECT path FROM repo_paths WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|[.]venv|[.]git|__pycache__)/')""")
def ignored(t):
    return t.repo_paths.where(f"NOT {S.is_ignored('path')}").select("path")


@query("a2_explode_lines", "corpus_lines", "SELECT path, line_no, text FROM corpus_lines")
def explode_lines(t):
    return t.corpus_lines


@query("a3_count_lines", "corpus corpus_lines", """
    SELECT c.path, coalesce(l.n, 0) AS code_lines, len(content) - len(replace(content, chr(10), ''))
      + CASE WHEN content = '' OR content[-1] = chr(10) THEN 0 ELSE 1 END AS total_lines
    FROM corpus c LEFT JOIN (SELECT path, count(*) AS n FROM corpus_lines WHERE regexp_matches(text, '\\S') GROUP BY path) l
    ON c.path = l.path""")
def count_lines(t):
    return files.count_lines(t.corpus)


def part_replies(t):
    """Reply texts: each holds its own part, every third also repeats the part before, every fourth has a record
    without an id."""
    return t.part.selectExpr(
        "concat('r', lpad(p_partkey, 9, '0')) AS source",
        "concat('{\"parts\": [{\"id\": \"p', p_partkey, '\", \"path\": \"x/', p_partkey, '\", \"kind\": \"service\", \"name\": \"', p_name, '\", "
        "\"uses\": [{\"target\": \"', p_brand, '\", \"how\": \"calls\"}]}', "
        "CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN concat(', {\"id\": \"p', p_partkey - 1, '\", \"path\": \"again\"}') ELSE '' END, "
        "CASE WHEN p_partkey % 4 = 0 THEN ', {\"path\": \"no/id\"}' ELSE '' END, ']}') AS raw")


@query("a4_read_parts", "", """
    SELECT 'p' || p_partkey AS id, 'x/' || p_partkey AS path, p_name AS name, p_brand AS target FROM part""")
def read_parts(t):
    parts, _ = records.parts_from_json(part_replies(t))
    return parts.selectExpr("id", "path", "name", "uses[0].target AS target")


@query("a4_rejected_parts", "", """
    SELECT 'r' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS source, 'p' || (p_partkey - 1) AS id, 'again' AS path FROM part
    WHERE p_partkey % 3 = 0 AND p_partkey > 0
    UNION ALL SELECT 'r' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), NULL, 'no/id' FROM part WHERE p_partkey % 4 = 0""")
def rejected_parts(t):
    return records.parts_from_json(part_replies(t))[1].select("source", "id", "path")


@query("a5_salvage_parts", "", """
    SELECT p_partkey AS k, 'a' || p_partkey AS id, p_name AS path FROM part
    UNION ALL SELECT p_partkey, 'c' || p_partkey, p_brand FROM part""")
def salvage_parts(t):
    """A fifth of the replies has an unescaped quote in its second part."""
    raw = t.part.selectExpr(
        "p_partkey AS k",
        "concat('Here it is: {\"parts\": [{\"id\": \"a', p_partkey, '\", \"path\": \"', p_name, '\", \"uses\": [{\"target\": \"x\"}]}, ', "
        "CASE WHEN p_partkey % 5 = 0 THEN '{\"id\": \"b\", \"path\": \"say \"hi\" }, ' ELSE '' END, "
        "'{\"id\": \"c', p_partkey, '\", \"path\": \"', p_brand, '\"}]} Done.') AS raw")
    return records.salvage_parts(raw, ["k"]).select("k", "id", "path")


def status_export(t):
    """One export per order: a modified, a renamed, a copied, an added and a deleted file."""
    return t.orders.selectExpr(
        "o_orderkey AS k",
        "concat_ws('\0', 'M', concat('m', o_orderkey), 'R097', concat('old', o_custkey), concat('new', o_custkey), 'C080', 'src', "
        "concat('copy', o_orderkey), 'A', 'add.py', 'D', 'del/x.py', '') AS raw",
        "concat('3\t', o_custkey, '\tm', o_orderkey, '\0', '7\t1\t\0old', o_custkey, '\0new', o_custkey, '\0', "
        "'-\t-\tadd.py\0') AS counts")


@query("a6_parse_name_status", "", """
    WITH s AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
    SELECT k, 'modified' AS status, 'm' || k AS path, NULL AS old, 3 AS added, c AS removed FROM s
    UNION ALL SELECT k, 'renamed', 'new' || c, 'old' || c, 7, 1 FROM s
    UNION ALL SELECT k, 'added', 'copy' || k, NULL, 0, 0 FROM s
    UNION ALL SELECT k, 'added', 'add.py', NULL, 0, 0 FROM s
    UNION ALL SELECT k, 'deleted', 'del/x.py', NULL, 0, 0 FROM s""")
def parse_name_status(t):
    raw = status_export(t)
    statuses = exports.parse_name_status(raw.select("k", "raw"), ["k"])
    counts = exports.parse_numstat(raw.selectExpr("k", "counts AS raw"), ["k"])
    return exports.changed_files(statuses, counts, by=["k"])


@query("a7_parse_ls_tree", "repo_paths", """
    SELECT path, sha1(path) AS sha, size FROM repo_paths
    WHERE k % 6 <> 0 AND NOT regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|[.]venv|[.]git|__pycache__)/')""")
def parse_ls_tree(t):
    raw = t.repo_paths.selectExpr(
        "concat('100644 ', CASE WHEN k % 6 = 0 THEN 'tree ' ELSE 'blob ' END, sha1(path), ' ', lpad(size, 7, ' '), '\t', path, "
        "'\0', '160000 commit ', sha1('x'), '       -\tsub', k, '\0') AS raw")
    return exports.parse_ls_tree(raw)


@query("a8_read_structure", "", """
    SELECT 'function' AS what, p_partkey AS a, p_partkey % 10 AS b FROM part WHERE p_size % 4 <> 0
    UNION ALL SELECT 'call', l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")
def read_structure(t):
    nodes = t.part.selectExpr("p_partkey AS fn_id", "element_at(array('File', 'Class', 'Function', 'Test'), p_size % 4 + 1) AS kind",
                              "p_name AS name", "p_brand AS parent", "p_type AS path", "p_partkey % 10 AS start", "p_size AS end",
                              "p_size % 4 = 3 AS is_test")
    edges = t.lineitem.selectExpr("CASE WHEN l_returnflag = 'R' THEN 'CALLS' ELSE 'IMPORTS' END AS kind", "l_partkey AS src",
                                  "l_suppkey AS dst")
    functions, calls = records.structure_tables(nodes, edges)
    return functions.selectExpr("'function' AS what", "fn_id AS a", "start AS b").unionByName(
        calls.selectExpr("'call' AS what", "src AS a", "dst AS b"))


@query("a9_write_map", "parts part_uses", """
    SELECT 'repo' || k % 3 AS repo, 'parts' AS section, id AS key FROM parts
    UNION ALL SELECT 'repo' || CAST(substring(src, 2) AS BIGINT) % 3, 'uses', src || '.' || pos FROM part_uses""")
def write_map(t):
    """Writes the maps of three repositories and reads the documents back."""
    out = f"{checkpoint_folder(t.spark)}/map-{uuid.uuid4().hex}"
    repo = "concat('repo', cast(substring(id, 2) AS BIGINT) % 3) AS repo"
    parts = t.part_records.selectExpr(repo, "id AS key", "path", "uses", "flows")
    uses = records.uses_of(t.part_records).selectExpr(repo.replace("(id", "(src"), "concat(src, '.', pos) AS key", "target", "how")
    sinks.write_map({"parts": parts, "uses": uses}, out)
    return t.spark.read.schema("section STRING, record STRING, repo STRING").json(f"{out}/map").selectExpr(
        "repo", "section", "get_json_object(record, '$.key') AS key")


def slice_prints(t, side):
    df = getattr(t, side).selectExpr(f"{S.folder_of('path')} AS slice", "path", "sha")
    return fingerprint(df)


PRINTS = """SELECT slice, count(*) AS n, bit_xor(hash(path || sha)) AS h FROM (
    SELECT regexp_replace(path, '/[^/]*$', '') AS slice, path, sha FROM {}) GROUP BY slice"""


@query("a10_cache_split", "base head", f"""
    WITH b AS ({PRINTS.format('base')}), h AS ({PRINTS.format('head')})
    SELECT slice, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.slice = h.slice AND b.n = h.n AND b.h = h.h) THEN 'hit' ELSE 'miss' END AS state FROM h""")
def cache_split(t):
    cache, now = slice_prints(t, "base"), slice_prints(t, "head")
    return sinks.cache_hits(now, cache).selectExpr("slice", "'hit' AS state").unionByName(
        sinks.cache_misses(now, cache).selectExpr("slice", "'miss' AS state"))


def corpus_refs(t):
    return t.corpus.selectExpr("concat(path, ':', doc_id % 12 + 1) AS ref", "path", "doc_id % 12 + 1 AS line")


@query("a11_excerpt", "corpus corpus_lines", """
    SELECT c.path || ':' || (doc_id % 12 + 1) AS ref, greatest(1, doc_id % 12 + 1 - 6) AS start, line_no, text
    FROM corpus c JOIN corpus_lines l ON c.path = l.path AND line_no BETWEEN doc_id % 12 + 1 - 6 AND doc_id % 12 + 1 + 6""")
def excerpt(t):
    return files.excerpt(corpus_refs(t), t.corpus_lines)


@query("a12_digest", "parts part_uses part_exposes part_steps", """
    SELECT p.id, '{"id":"' || p.id || '","kind":"' || kind || '","summary":"' || summary || '","uses":["' || u.t || '"]'
      || CASE WHEN k % 10 IN (0, 3) THEN ',"publishes":["t' || k // 10 || '"]' ELSE '' END
      || CASE WHEN k % 10 IN (1, 3, 7) THEN ',"subscribes":["t' || k // 10 || '"]' ELSE '' END
      || ',"exposes":["' || e.t || '"],"flowSteps":[' || coalesce('"' || s.t || '"', '') || ']}' AS line
    FROM parts p
    JOIN (SELECT src, string_agg(target || ': ' || how, '","' ORDER BY pos) AS t FROM part_uses GROUP BY src) u ON u.src = p.id
    JOIN (SELECT part, string_agg(what, '","' ORDER BY pos) AS t FROM part_exposes GROUP BY part) e ON e.part = p.id
    LEFT JOIN (SELECT owner, string_agg("from" || ' -> ' || "to" || ' @ ' || ref, '","' ORDER BY pos) AS t FROM part_steps GROUP BY owner) s
      ON s.owner = p.id""")
def digest(t):
    return records.digest(t.part_records)


@query("a12_map_digest", "parts part_uses part_exposes part_steps part_externals", """
    SELECT 1 AS section, split_part(path, '/', 1) AS key, 0 AS pos, '- ' || split_part(path, '/', 1) || ': '
        || upper(split_part(path, '/', 1)[1]) || split_part(path, '/', 1)[2:] || ' — ' AS line FROM (SELECT DISTINCT split_part(path, '/', 1) AS path FROM parts)
    UNION ALL SELECT 2, id, 0, '- ' || id || ' [' || kind || ', ' || split_part(path, '/', 1) || '] ' || path || ': ' || summary FROM parts
    UNION ALL SELECT DISTINCT 2, owner, 1, '  - flow ' || flow_id || ': ' || title FROM part_steps
    UNION ALL SELECT 2, part, 1000000, '  - refs: ' || string_agg(ref, ' ' ORDER BY ref) FROM (
        SELECT part, ref FROM part_exposes UNION SELECT src, ref FROM part_uses WHERE ref IS NOT NULL
        UNION SELECT owner, ref FROM part_steps) GROUP BY part
    UNION ALL SELECT 3, id, 0, '- external ' || id FROM part_externals
    UNION ALL SELECT DISTINCT 4, flow_id, 0, '- ' || flow_id || ': ' || title FROM part_steps""")
def map_digest(t):
    parts = t.part_records.join(cluster_members(t.part_records).withColumnRenamed("part", "id"), "id")
    externals = records.uses_of(t.part_records).selectExpr("target AS id").distinct().join(
        t.part_records.select("id"), "id", "left_anti")
    flows = records.flow_steps_of(t.part_records).select("flow_id", "title").distinct()
    return records.map_digest(parts, folder_clusters(t.part_records), externals, flows)


@query("a13_read_texts", "base head", """
    SELECT sha, content FROM (SELECT DISTINCT sha, content FROM base) WHERE sha IN (SELECT sha FROM head)""")
def read_texts(t):
    blobs = t.base.select("sha", "content").dropDuplicates(["sha"])
    return files.read_texts(t.head, blobs)


@query("a14_refs_of", "part_uses part_exposes part_steps", """
    SELECT part, ref, NULL AS fn FROM part_exposes WHERE ref <> '' UNION ALL SELECT src, ref, NULL FROM part_uses WHERE ref <> ''
    UNION ALL SELECT owner, ref, fn FROM part_steps WHERE ref <> ''""")
def refs_of(t):
    return records.refs_of(t.part_records)


@query("map_job", "", """
    WITH p AS (SELECT p_partkey AS k, * FROM part)
    SELECT 'part' AS section, 'p' || k AS id, 'x 2' AS value FROM p
    UNION ALL SELECT 'rejected', CASE WHEN n = 0 THEN 'p' || (k - 1) END, CASE WHEN n = 0 THEN 'again' ELSE 'no/id' END FROM p, (VALUES (0), (1)) v(n)
      WHERE CASE WHEN n = 0 THEN k % 3 = 0 AND k > 0 ELSE k % 4 = 0 END
    UNION ALL SELECT 'cluster', 'x', CAST(count(*) AS VARCHAR) FROM p
    UNION ALL SELECT DISTINCT 'external', p_brand, '' FROM p
    UNION ALL SELECT 'link', 'p' || k, p_brand || ' calls' FROM p
    UNION ALL SELECT 'change', 'p' || k, '1' FROM p WHERE k % 5 = 0""")
def map_job(t):
    """Every part has a file of two lines with code; every fifth file changed."""
    files = t.part.selectExpr("concat('x/', p_partkey, '/main.py') AS path", "concat('def run():\n\n    return \"', p_name, '\"\n') AS content")
    changed = t.part.where("p_partkey % 5 = 0").selectExpr("concat('x/', p_partkey, '/main.py') AS path")
    m = build_map(part_replies(t), files, changed=changed)
    rows = lambda name, section, *e: m[name].selectExpr(f"'{section}' AS section", *e)
    out = rows("parts", "part", "id", "concat(cluster, ' ', size) AS value")
    for more in (rows("rejected", "rejected", "nullif(id, '') AS id", "path AS value"), rows("clusters", "cluster", "id", "cast(members AS STRING) AS value"),
                 rows("externals", "external", "id", "'' AS value"), rows("links", "link", "src AS id", "concat(dst, ' ', how) AS value"),
                 rows("changes", "change", "part AS id", "cast(changes AS STRING) AS value")):
        out = out.unionByName(more)
    return out
