"""Scalars as SQL functions: one positive, one near miss, one edge each."""

import pytest

from codeatlas.functions import scalars as S

CASES = [
    ("clip('  a  b   c ', 5)", "a b c"), ("clip('abcdefgh', 5)", "abcd…"), ("clip(NULL, 5)", None), ("unparen('(a && b)')", "a && b"),
    ("unparen('(a) && (b)')", "(a) && (b)"), ("unparen('')", ""), ("negate('!ok')", "ok"), ("negate('x == 1')", "x != 1"), ("negate('a not in b')", "a in b"),
    ("negate('a && b')", "not: a && b"), ("negate('a < b')", "a >= b"), ("negate('x -> y')", "not: x -> y"), ("inversion('a == b', 'a != b')", "== → !="),
    ("inversion('ok', '!ok')", "added !"), ("inversion('!(a && b)', 'a && b')", "removed !"), ("inversion('a', 'b')", None), ("inversion('not x', 'x')", "removed not"),
    ("mask_literals('x = \"a b\" + 12')", "x = # + #"), ("parse_ref('zz')", None), ("parse_ref('a:b:7').line", 7),
    ("doc_sentences('// fooBar does X. And y. And Z. More', 'fooBar')", "Does X. And y."), ("doc_sentences('', 'x')", None), ("doc_sentences('# TODO later\\n# Real text', 'x')", "Real text"),
    ("doc_sentences('Head\\nArgs: x', 'f')", "Head"), ("external_kind('My Postgres')", "db"), ("external_kind('zzz')", "other"), ("external_key('OTel Collector')", "opentelemetry"),
    ("external_key('Pub/Sub')", "pubsub"), ("external_key('api')", "api"), ("external_key('GCS')", "googlecloudstorage"), ("effect_kind('Stripe API', 'x', 'y')", "payment"),
    ("effect_kind(NULL, 'db.query(x)', 'query')", "db"), ("effect_kind('Foo', 'x', 'y')", "outside"), ("effect_kind(NULL, 'http.Get(u)', 'Get')", "network"),
    ("file_role('a/go.mod', false, false)", "deps"), ("file_role('.github/workflows/x.yml', false, false)", "deploy"), ("file_role('zz', false, false)", "other"),
    ("lang_family('a/b.tsx')", "javascript"), ("lang('Makefile')", None), ("lang('.py')", None), ("limit_word('timeoutSeconds := 5')", "Duration"), ("limit_word('x')", None),
    ("redact('API_KEY', '\"abc\"')", "•••"), ("redact('API_KEY', '')", ""), ("has_error('return nil, err', 'go')", True), ("has_error('return err, nil', 'go')", False),
    ("has_error('return x', 'python')", False), ("is_ignored('a/node_modules/b.js')", True), ("is_ignored('a/b/build')", False), ("is_ignored('build')", False),
    ("fuzzy_score('zz', 'small ring')", -1.0), ("folder_of('a/b/c')", "a/b"), ("folder_of('c')", ""), ("file_stem('a/b.c.py')", "b.c"), ("link_kind('publishes events', NULL, false)", "async"),
    ("link_kind('x', 'db', true)", "data"), ("link_kind('x', 'db', false)", "call"), ("strip_strings_comments('x = \"a\" // c')", "x =   "), ("state_value('JobStateReady', 'State')", "JobStateReady"),
    ("state_value('job.State', 'State')", None), ("state_value('JobState_JOB_STATE_LOST', 'state')", "JOB_STATE_LOST"), ("state_value('Job_JOB_LOST', 'state')", None), ("state_family('db.JobStateReady')", "db.JobState"), ("array_join(ancestors('a/b'), '|')", "|a|a/b"),
]


@pytest.fixture(scope="module")
def registered(spark):
    return S.register_functions(spark)


@pytest.mark.parametrize("expression,want", CASES)
def test_scalar(spark, registered, expression, want):
    assert spark.sql("SELECT " + expression).first()[0] == want


def test_expansion_equals_sql_function(spark, registered):
    text = "get(array('a == b', '!x'), 0)"
    assert spark.sql(f"SELECT {S.negate(text)} = negate({text})").first()[0]
