"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from ..operators.rollup import common_prefix, entry_of, estimate_tokens
from ..sources import records
from .registry import query


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("b1_path_flags", "repo_paths", f"""
    SELECT path, regexp_matches(path, {rx(fx.SOURCE)}) AS source, regexp_matches(path, {rx(fx.TESTS)}) AS test,
           regexp_matches(path, {rx(fx.GENERATED)}) AS generated FROM repo_paths""")
def path_flags(t):
    return t.repo_paths.selectExpr("path", f"{S.is_source('path')} AS source", f"{S.is_test('path')} AS test",
                                   f"{S.is_generated('path')} AS generated")


@query("b2_machine_made", "", """
    SELECT doc_id, doc_id % 9 = 0 OR (doc_id % 9 = 1 AND strlen(text) < 4080) AS made FROM documents""")
def machine_made(t):
    """A header before the whole text, or a mark after it, which counts only when it starts early enough."""
    made = t.documents.selectExpr(
        "doc_id", "CASE doc_id % 9 WHEN 0 THEN concat('// Code generated by x. DO NOT EDIT.\n', text) "
        "WHEN 1 THEN concat(text, ' @Generated') ELSE text END AS content")
    return made.selectExpr("doc_id", f"{S.machine_made('content')} AS made")


ROLES = ("code test code test code test generated generated generated deploy deploy deps deps docs config config code code "
         "other code code code deploy other other code code code test code generated docs code").split()


@query("b3_file_role", "repo_paths", f"SELECT path, {sql_list(ROLES)}[k % {len(ROLES)} + 1] AS role FROM repo_paths")
def file_role(t):
    return t.repo_paths.selectExpr("path", f"{S.file_role('path', S.is_generated('path'), S.is_test('path'))} AS role")


@query("b4_lang", "repo_paths", f"""
    SELECT path, map {{{", ".join(f"'{k}': '{v}'" for k, v in fx.LANGUAGES.items())}}}[lower(regexp_extract(path, '[^/]([.][^./]+)$', 1))] AS lang,
      CASE WHEN regexp_matches(path, '[.](tsx?|jsx?|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(path, '[.](c|h|cc|cpp|hpp)$') THEN 'cpp'
      ELSE map {{'.go': 'go', '.py': 'python', '.rs': 'rust', '.kt': 'kotlin'}}[regexp_extract(path, '[^/]([.][^./]+)$', 1)] END AS family
    FROM repo_paths""")
def lang(t):
    return t.repo_paths.selectExpr("path", f"{S.lang('path')} AS lang", f"{S.lang_family('path')} AS family")


SYSTEMS = ["Postgres Replica", "My Kafka", "S3 archive", "Cloud Run job", "Stripe", "Weather feed", "ElasticSearch", "Blob", "GitHub", "PubSub"]
SYSTEM_KINDS = "db queue storage cloud saas other db storage saas queue".split()


@query("b5_external_kind", "", f"""
    SELECT p_partkey AS k, {sql_list(SYSTEM_KINDS)}[p_partkey % 10 + 1] AS kind FROM part""")
def external_kind(t):
    named = t.part.selectExpr("p_partkey AS k", f"concat(get({S.texts(SYSTEMS)}, cast(p_partkey % 10 AS INT)), ' ', p_partkey) AS name")
    return named.selectExpr("k", f"{S.external_kind('name')} AS kind")


@query("b6_external_key", "external_names", """
    SELECT name, array_to_string(list_filter(string_split(name, ' '), lambda w: w NOT IN
      ('big', 'blue', 'fast', 'green', 'old', 'red', 'slow', 'small')), '') AS key FROM external_names""")
def external_key(t):
    return t.external_names.selectExpr("name", f"{S.external_key_of({}, t.GENERIC).replace('@name', 'name')} AS key")


@query("b7_effect_kind", "steps", """
    SELECT pos, CASE WHEN pos % 4 = 0 THEN 'payment' WHEN target IS NOT NULL THEN 'db' WHEN pos % 4 = 1 THEN 'network'
      WHEN pos % 4 = 2 THEN 'queue' ELSE 'outside' END AS kind FROM steps""")
def effect_kind(t):
    s = t.steps.withColumn("code", F.expr("concat(get(array('go stripeApi.', 'http_client.', 'event_broker.', 'x.'), cast(pos % 4 AS INT)), callee, '(a)')"))
    s = s.withColumn("aim", F.expr("CASE WHEN pos % 4 = 0 AND target IS NOT NULL THEN 'Paddle Billing' ELSE target END"))
    return s.selectExpr("pos", f"{S.effect_kind('aim', 'code', 'callee')} AS kind")


@query("b8_effect_op", "", """
    SELECT p_partkey AS k, ['writes', 'reads', 'calls', 'reads', 'writes', 'calls'][p_partkey % 6 + 1] AS op FROM part""")
def effect_op(t):
    verb = t.part.selectExpr("p_partkey AS k", "concat(get(array('Update', 'get', 'do', 'ListAll', 'enqueue', 'process'), cast(p_partkey % 6 AS INT)), "
                             "initcap(split_part(p_name, ' ', 2))) AS callee")
    return verb.selectExpr("k", f"{S.effect_op('callee')} AS op")


@query("b9_clip", "", r"""
    SELECT doc_id, CASE WHEN len(s) <= 120 THEN s ELSE s[:119] || '…' END AS clip, CASE WHEN len(s) <= 60 THEN s ELSE s[:59] || '…' END AS short
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""")
def clip(t):
    return t.documents.selectExpr("doc_id", f"{S.clip('text', '120')} AS clip", f"{S.shorten('text')} AS short")


@query("b10_words", "", r"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(
      regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\1|\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w)))), ' ') AS words
    FROM documents""")
def words(t):
    return t.documents.selectExpr("doc_id", f"array_join(array_sort({S.words('text')}), ' ') AS words")


@query("b11_unparen", "", """
    SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name || ' && x' WHEN 1 THEN '(' || p_name || ') && (x)'
      WHEN 2 THEN '(' || p_name || ')' ELSE p_name END AS s FROM part""")
def unparen(t):
    src = t.part.selectExpr("p_partkey AS k", "CASE p_partkey % 4 WHEN 0 THEN concat(' (', p_name, ' && x) ') WHEN 1 THEN concat('(', p_name, ') && (x)') "
                            "WHEN 2 THEN concat('((', p_name, '))') ELSE p_name END AS s")
    return src.selectExpr("k", f"{S.unparen('s')} AS s")


@query("b12_parse_ref", "corpus", """
    SELECT path AS p, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN path || ':x' ELSE path END END AS path,
      CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS line FROM corpus""")
def parse_ref(t):
    refs = t.corpus.selectExpr("path AS p", "CASE WHEN doc_id % 5 = 0 THEN concat(path, ':', doc_id, 'a') WHEN doc_id % 7 = 0 THEN "
                               "concat(path, ':x:', doc_id) ELSE concat(path, ':', doc_id) END AS ref")
    return refs.select("p", F.expr(S.parse_ref("ref")).alias("r")).select("p", "r.path", "r.line")


OPERATORS = "== != < >= > <= === !==".split()
FLIPS = "!= == >= < <= > !== ===".split()


@query("b13_negate", "", f"""
    SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey AS p, CASE l_suppkey % 4
      WHEN 0 THEN 'qty ' || {sql_list(FLIPS)}[l_partkey % 8 + 1] || ' ' || l_partkey
      WHEN 1 THEN 'isOpen(' || l_partkey || ')' WHEN 2 THEN 'not: a && b' || l_partkey ELSE 'not: flag' || l_partkey END AS s FROM lineitem""")
def negate(t):
    src = t.lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS k", "l_partkey AS p",
        f"CASE l_suppkey % 4 WHEN 0 THEN concat('qty ', get({S.texts(OPERATORS)}, cast(l_partkey % 8 AS INT)), ' ', l_partkey) "
        "WHEN 1 THEN concat('!isOpen(', l_partkey, ')') WHEN 2 THEN concat('a && b', l_partkey) ELSE concat('flag', l_partkey) END AS c")
    return src.selectExpr("k", "p", f"{S.negate('c')} AS s")


@query("b14_inversion", "", f"""
    SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey AS p, CASE l_suppkey % 5
      WHEN 0 THEN {sql_list(OPERATORS)}[l_partkey % 8 + 1] || ' → ' || {sql_list(FLIPS)}[l_partkey % 8 + 1]
      WHEN 1 THEN 'added !' WHEN 2 THEN 'removed not' WHEN 3 THEN 'removed !' END AS s FROM lineitem""")
def inversion(t):
    op = lambda names: f"concat('qty ', get({S.texts(names)}, cast(l_partkey % 8 AS INT)), ' ', l_partkey)"
    src = t.lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS k", "l_partkey AS p",
        f"CASE l_suppkey % 5 WHEN 0 THEN {op(OPERATORS)} WHEN 1 THEN 'ready' WHEN 2 THEN 'a and not b' WHEN 3 THEN '!(a && b)' ELSE 'a + b' END AS a",
        f"CASE l_suppkey % 5 WHEN 0 THEN {op(FLIPS)} WHEN 1 THEN '!ready' WHEN 2 THEN 'a and b' WHEN 3 THEN 'a && b' ELSE 'a + c' END AS b")
    return src.selectExpr("k", "p", f"{S.inversion('a', 'b')} AS s")


@query("b15_mask_literals", "", """
    SELECT event_id, '{#: #} x' || user_id || ' = # + #' AS s FROM events""")
def mask_literals(t):
    src = t.events.selectExpr("event_id", "concat(props, ' x', user_id, ' = \\'', event_type, '\\'  + ', event_id) AS s")
    return src.selectExpr("event_id", f"{S.mask_literals('s')} AS s")


@query("b16_doc_sentences", "", r"""
    SELECT doc_id, 'Loads the ' || lang || ' text ' || doc_id || '. It comes from ' || source || '.' AS s FROM documents""")
def doc_sentences(t):
    """The whole text follows the summary as a second paragraph and must not show."""
    doc = t.documents.selectExpr("doc_id", "concat('/** fetchDoc loads the ', lang, ' text ', doc_id, '. It comes\n *  from ', source, "
                                 "'. A third sentence.\n *\n * ', text, ' */') AS doc")
    return doc.selectExpr("doc_id", f"{S.doc_sentences('doc', chr(39) + 'fetchDoc' + chr(39))} AS s")


@query("b17_link_kind", "part_uses parts", """
    SELECT src, pos, CASE WHEN target LIKE 'p%' AND target IN (SELECT id FROM parts) THEN
        CASE WHEN how LIKE 'publishes%' THEN 'async' ELSE 'call' END
      WHEN CAST(substring(src, 2) AS BIGINT) % 5 = 0 THEN 'data' WHEN CAST(substring(src, 2) AS BIGINT) % 5 = 1 OR how LIKE 'publishes%'
      THEN 'async' ELSE 'call' END AS kind FROM part_uses""")
def link_kind(t):
    uses = records.uses_of(t.part_records)
    known = t.part_records.selectExpr("id AS target", "true AS inner")
    rows = uses.join(known, "target", "left").withColumn(
        "ext", F.expr("CASE cast(substring(src, 2) AS BIGINT) % 5 WHEN 0 THEN 'storage' WHEN 1 THEN 'queue' ELSE 'saas' END"))
    return rows.selectExpr("src", "pos", f"{S.link_kind('how', 'ext', 'inner IS NULL')} AS kind")


@query("b18_entry_of", "parts part_exposes part_links", """
    SELECT id AS part, CASE WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'http' AND what = 'GET /') THEN 'users'
      WHEN id IN (SELECT dst FROM part_links) THEN NULL
      WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'http') THEN 'HTTP'
      WHEN EXISTS (SELECT 1 FROM part_exposes e WHERE e.part = p.id AND "type" = 'cli') OR
        (kind = 'tool' AND EXISTS (SELECT 1 FROM part_links l WHERE l.src = p.id AND l.dst IN (SELECT id FROM parts))) THEN 'CLI' END AS entry
    FROM parts p""")
def entries(t):
    from .map_queries import externals, links
    return entry_of(t.part_records, links(t), externals(t))


@query("b19_redact", "", """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '•••' ELSE event_type || event_id END AS value FROM events""")
def redact(t):
    kv = t.events.selectExpr("event_id", "get(array('API_TOKEN', 'MODE', 'region'), cast(user_id % 3 AS INT)) AS key",
                             "concat('\"', event_type, event_id, '\"') AS value")
    return kv.selectExpr("event_id", f"{S.redact('key', 'value')} AS value")


@query("b21_common_prefix", "", """
    SELECT p_brand AS grp, CASE CAST(substring(p_brand, 7) AS BIGINT) % 3 WHEN 0 THEN 'JOB_STATE_' WHEN 1 THEN 'JobState' ELSE '' END AS prefix
    FROM part GROUP BY p_brand""")
def prefixes(t):
    """Upper-case names with underscores, camelCase names, and names without anything in common."""
    kind = "cast(substring(p_brand, 7) AS BIGINT) % 3"
    names = t.part.selectExpr("p_brand AS grp", f"CASE {kind} WHEN 0 THEN concat('JOB_STATE_', upper(hex(p_partkey)), 'X') "
                              f"WHEN 1 THEN concat('JobState', chr(65 + p_partkey % 26), 'x', p_partkey) "
                              "ELSE concat(chr(97 + p_partkey % 26), 'q', p_partkey) END AS name")
    both = names.unionByName(names.selectExpr("grp", f"CASE WHEN name LIKE 'JOB_STATE_%' THEN 'JOB_STATE_ZZ' WHEN name LIKE 'JobState%' THEN 'JobStateZz' "
                                              "ELSE '0other' END AS name"))
    return common_prefix(both, ["grp"])


@query("b22_estimate_tokens", "repo_paths", f"""
    SELECT CAST(sum(size) // 4 AS BIGINT) AS tokens FROM repo_paths WHERE regexp_matches(path, {rx(fx.SOURCE)})
    AND NOT regexp_matches(path, {rx(fx.TESTS)})""")
def tokens(t):
    return estimate_tokens(t.repo_paths)


@query("b24_identifiers", "", r"""
    SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{N}_]*'))) AS name FROM documents""")
def identifiers(t):
    return t.documents.select("doc_id", F.explode(F.expr(S.identifiers("text"))).alias("name"))


@query("b24_qualified_names", "functions", """
    SELECT fn_id, unnest([{'q': NULL, 'n': 'return'}, {'q': NULL, 'n': 'self'}, {'q': 'self', 'n': name}, {'q': '', 'n': 'x' || fn_id},
      {'q': NULL, 'n': parent_}]) AS r FROM (SELECT *, coalesce(parent, 'None') AS parent_ FROM functions)""".replace(
    "SELECT fn_id, unnest", "SELECT fn_id, r.q AS qualifier, r.n AS name FROM (SELECT fn_id, unnest") + ")")
def qualified(t):
    body = t.functions.selectExpr("fn_id", "concat('return self.', name, '().x', fn_id, '(', coalesce(parent, 'None'), ')') AS body")
    return body.select("fn_id", F.explode(F.expr(S.qualified_names("body"))).alias("q")).select("fn_id", "q.qualifier", "q.name")


@query("b25_strip_strings_comments", "", """
    SELECT event_id, 'x' || user_id || ' =   + y' || chr(10) || 'z' || ' ' AS s FROM events""")
def strip(t):
    src = t.events.selectExpr("event_id", "concat('x', user_id, ' = \"', event_type, ' // \\\\\" #\" + y\nz # ', props) AS s")
    return src.selectExpr("event_id", f"{S.strip_strings_comments('s')} AS s")


@query("b26_has_error", "", """
    SELECT event_id, event_id % 6 IN (0, 3, 4) AS error FROM events""")
def has_error(t):
    src = t.events.selectExpr(
        "event_id", "CASE WHEN event_id % 6 < 3 THEN 'go' ELSE 'python' END AS language",
        "get(array(concat('return v', user_id, ', err'), 'return v, nil', concat('return v', user_id), "
        "concat('raise ValueError(', user_id, ')'), 'return status(500)', 'return okay'), cast(event_id % 6 AS INT)) AS s")
    return src.selectExpr("event_id", f"{S.has_error('s', 'language')} AS error")


@query("b27_limit_word", "", """
    SELECT event_id, ['Timeout', 'Limit', NULL, 'Retries', 'Duration'][event_id % 5 + 1] AS word FROM events""")
def limit_word(t):
    src = t.events.selectExpr(
        "event_id", "get(array(concat('http.Timeout = ', user_id), 'pageSize, maxRows := 1, 2', concat('x', user_id, ' = y'), "
        "'cfg.retries = 3', concat('sleep(', user_id, ' * backoff)')), cast(event_id % 5 AS INT)) AS s")
    return src.selectExpr("event_id", f"{S.limit_word('s')} AS word")


@query("b28_inline_diff", "", """
    SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey AS p, 'if total ' AS prefix,
      CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '< ' || l_suppkey END AS removed,
      CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '>= ' || (l_suppkey + 1) END AS added,
      CASE WHEN l_suppkey % 3 = 0 THEN '< ' || l_suppkey ELSE '' END || ' {' || l_partkey || '}' AS suffix FROM lineitem""")
def inline_diff(t):
    src = t.lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS k", "l_partkey AS p", "concat('if total < ', l_suppkey, ' {', l_partkey, '}') AS a",
        "CASE WHEN l_suppkey % 3 = 0 THEN concat('if total < ', l_suppkey, ' {', l_partkey, '}') ELSE "
        "concat('if total >= ', l_suppkey + 1, ' {', l_partkey, '}') END AS b")
    d = src.select("k", "p", F.expr(S.inline_diff("a", "b")).alias("d")).select("k", "p", "d.*")
    # equal texts are all prefix: cut it at the same place the SQL does
    return d.selectExpr("k", "p", "'if total ' AS prefix", "removed", "added", "substring(concat(prefix, suffix), 10) AS suffix")


@query("m2_sql_functions", "", """
    SELECT p_partkey AS k, 'file' || p_partkey || '.py' AS name, 'python' AS lang FROM part""")
def sql_functions(t):
    """The scalars called by name from SQL."""
    S.register_functions(t.spark)
    return t.part.selectExpr("p_partkey AS k", "concat('a/', p_type, '/file', p_partkey, '.py') AS path").selectExpr(
        "k", "base_name(path) AS name", "lang(path) AS lang")
