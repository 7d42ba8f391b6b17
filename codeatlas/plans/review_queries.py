"""Queries over reviews: alignment, classification, risk, gates, config, SQL files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import change, joins, rollup, sqlreview
from .map_queries import changed
from .registry import query
from .structure_queries import tree_steps


# ---- fingerprints and lines ------------------------------------------------------------------------------
@query("i1_fingerprint", "head", """
    WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS slice, sha1(path || chr(0) || sha) AS h FROM head)
    SELECT slice, sha1(slice || ':' || count(*) || ':' || sum(CAST('0x' || h[1:15] AS HUGEINT)) || ':' || sum(CAST('0x' || h[16:30] AS HUGEINT)))[1:20] AS fingerprint FROM f GROUP BY slice""")
def fingerprint(t):
    return change.fingerprint(t.head.selectExpr(f"{S.folder_of('path')} AS slice", "path", "sha"))


def corpus_diff(t):
    return change.diff_lines(t.base, t.head)


@query("i2_diff_lines")
def diff_lines(t):
    return corpus_diff(t).groupBy("path").agg(F.count_if(F.expr("op = '='")).alias("same"), F.count_if(F.expr("op = '-'")).alias("removed"),
                                              F.count_if(F.expr("op = '+'")).alias("added"))


LINE_TOTALS = """SELECT path, sum(b) AS base_lines, sum(h) AS head_lines FROM (
      SELECT path, CASE WHEN content = '' THEN 0 ELSE len(string_split(rtrim(content, chr(10)), chr(10))) END AS b, 0 AS h FROM base
      UNION ALL SELECT path, 0, CASE WHEN content = '' THEN 0 ELSE len(string_split(rtrim(content, chr(10)), chr(10))) END FROM head) GROUP BY path"""


@query("i2_diff_totals", "base head", f"""
    SELECT path, base_lines, head_lines, CASE WHEN s THEN base_lines ELSE 0 END AS same_texts FROM ({LINE_TOTALS}) t
    JOIN (SELECT coalesce(b.path, h.path) AS path, coalesce(b.sha = h.sha, false) AS s FROM base b FULL JOIN head h ON b.path = h.path) USING (path)""")
def diff_totals(t):
    """Every line of both versions is accounted for, and unchanged files align whole."""
    same = t.base.selectExpr("path", "sha AS a").join(t.head.selectExpr("path", "sha AS b"), "path", "full").selectExpr("path", "coalesce(a = b, false) AS s")
    n = corpus_diff(t).groupBy("path").agg(F.count_if(F.expr("base_line > 0")).alias("base_lines"), F.count_if(F.expr("head_line > 0")).alias("head_lines"),
                                           F.count_if(F.expr("op = '='")).alias("e"))
    return n.join(same, "path").selectExpr("path", "base_lines", "head_lines", "CASE WHEN s THEN e ELSE 0 END AS same_texts")


@query("d12_carry_lines", "base head", f"""
    SELECT path, base_lines AS line, 'T' || base_lines AS target FROM ({LINE_TOTALS}) t WHERE path IN (SELECT b.path FROM base b JOIN head h ON b.path = h.path AND b.sha = h.sha) AND base_lines > 0""")
def carry_lines(t):
    ops = corpus_diff(t)
    same = t.base.join(t.head.selectExpr("path", "sha AS h"), "path").where("sha = h").select("path")
    last = ops.join(same, "path", "left_semi").groupBy("path").agg(F.max("head_line").alias("line")).selectExpr("path", "line", "concat('T', line) AS target")
    return joins.carry_lines(last, ops)


@query("d24_old_path", "head", "SELECT path, path AS old FROM head WHERE path NOT LIKE 'moved/%'")
def old_path(t):
    stay = t.head.where("NOT startswith(path, 'moved/')")
    return joins.old_path(stay, changed(t).where("startswith(path, 'moved/')"))


@query("d24_renamed_paths", "base head", """
    WITH gone AS (SELECT b.path, b.sha, row_number() OVER (PARTITION BY b.sha ORDER BY b.path) AS k FROM base b WHERE b.path NOT IN (SELECT path FROM head)),
    new AS (SELECT h.path, h.sha, row_number() OVER (PARTITION BY h.sha ORDER BY h.path) AS k FROM head h WHERE h.path NOT IN (SELECT path FROM base))
    SELECT h.path, coalesce(g.path, h.path) AS old FROM head h LEFT JOIN new n ON n.path = h.path LEFT JOIN gone g ON g.sha = n.sha AND g.k = n.k""")
def renamed_paths(t):
    return joins.old_path(t.head, changed(t))


# ---- functions of two versions -----------------------------------------------------------------------------
def versions(t):
    """Each order is a file; its line numbers are functions. The head drops, renames and edits some."""
    base = t.order_steps.selectExpr("fn_id AS path", "n AS fn_id", "CASE WHEN s % 4 = 0 THEN 'T' END AS parent", "concat('f', p % 3) AS name", "n AS start", "cast(s AS STRING) AS norm")
    head = t.order_steps.where("s % 7 <> 0").selectExpr(
        "fn_id AS path", "n AS fn_id", "CASE WHEN s % 4 = 0 AND s % 3 <> 0 THEN 'T' END AS parent", "concat('f', p % 3) AS name", "n AS start",
        "CASE WHEN s % 5 = 0 THEN 'edited' ELSE cast(s AS STRING) END AS norm")
    return base, head


PAIRS = """WITH b AS (SELECT fn_id AS path, n AS id, CASE WHEN s % 4 = 0 THEN 'T' ELSE '' END AS parent, 'f' || p % 3 AS name, CAST(s AS VARCHAR) AS norm FROM order_steps),
    h AS (SELECT fn_id AS path, n AS id, CASE WHEN s % 4 = 0 AND s % 3 <> 0 THEN 'T' ELSE '' END AS parent, 'f' || p % 3 AS name,
      CASE WHEN s % 5 = 0 THEN 'edited' ELSE CAST(s AS VARCHAR) END AS norm FROM order_steps WHERE s % 7 <> 0),
    kb AS (SELECT *, row_number() OVER (PARTITION BY path, parent, name ORDER BY id) AS k FROM b), kh AS (SELECT *, row_number() OVER (PARTITION BY path, parent, name ORDER BY id) AS k FROM h),
    one AS (SELECT kb.path, kb.id AS base_id, kh.id AS head_id FROM kb JOIN kh USING (path, parent, name, k)),
    lb AS (SELECT * FROM b WHERE (path, id) NOT IN (SELECT (path, base_id) FROM one)), lh AS (SELECT * FROM h WHERE (path, id) NOT IN (SELECT (path, head_id) FROM one)),
    two AS (SELECT x.path, x.id AS base_id, y.id AS head_id FROM (SELECT path, name, min(id) AS id FROM lb GROUP BY 1, 2 HAVING count(*) = 1) x
      JOIN (SELECT path, name, min(id) AS id FROM lh GROUP BY 1, 2 HAVING count(*) = 1) y USING (path, name)),
    pairs AS (SELECT * FROM one UNION ALL SELECT * FROM two
      UNION ALL SELECT path, id, NULL FROM lb WHERE (path, id) NOT IN (SELECT (path, base_id) FROM two)
      UNION ALL SELECT path, NULL, id FROM lh WHERE (path, id) NOT IN (SELECT (path, head_id) FROM two)) """


@query("d7_match_functions", "order_steps", PAIRS + "SELECT path, base_id, head_id FROM pairs")
def match_functions(t):
    return joins.match_functions(*versions(t))


@query("i19_changed_functions", "order_steps", PAIRS + """
    SELECT p.path, base_id, head_id, CASE WHEN base_id IS NULL THEN 'added' WHEN head_id IS NULL THEN 'removed' ELSE 'modified' END AS status
    FROM pairs p LEFT JOIN b ON b.path = p.path AND b.id = base_id LEFT JOIN h ON h.path = p.path AND h.id = head_id WHERE b.norm IS DISTINCT FROM h.norm""")
def changed_functions(t):
    return change.changed_functions(*versions(t))


@query("i8_signature_changes", "order_steps", """
    SELECT fn_id, n, CASE WHEN p % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN p % 3 = 0 THEN 'Signature changed, called from other files' ELSE 'Signature changed' END AS why
    FROM order_steps WHERE s % 4 = 0""")
def signature_changes(t):
    pairs = t.order_steps.selectExpr("struct(fn_id, n) AS fn_id", "array('def', cast(s AS STRING)) AS base_sig", "array('def', CASE WHEN s % 4 = 0 THEN 'x' ELSE cast(s AS STRING) END) AS head_sig")
    outside = t.order_steps.where("p % 3 = 0").selectExpr("struct(fn_id, n) AS fn_id")
    return change.signature_changes(pairs, outside).select("fn_id.fn_id", "fn_id.n", "severity", "why")


# ---- steps -------------------------------------------------------------------------------------------------
@query("i3_flatten_steps", "order_steps", """
    SELECT fn_id, n AS pos, n = 1 AND EXISTS (SELECT 1 FROM order_steps y WHERE y.fn_id = x.fn_id AND y.n > 1 AND y.n % 2 = 1 AND y.s % 3 = 0 AND y.s % 2 = 0) AS "check",
      n > 1 AND n % 2 = 1 AND s % 3 = 0 AND s % 2 = 0 AND EXISTS (SELECT 1 FROM order_steps z WHERE z.fn_id = x.fn_id AND z.n = 1) AS absorbed FROM order_steps x""")
def flatten_steps(t):
    return change.flatten_steps(tree_steps(t)).select("fn_id", "pos", "check", "absorbed")


def step_versions(t):
    base = t.order_steps.selectExpr("fn_id", "n AS pos", "'call' AS kind", "concat('go', n, '(x', s % 10, ', ', p % 5, ')') AS text", "concat('go', n) AS callee")
    head = t.order_steps.where("s % 7 <> 0").selectExpr(
        "fn_id", "n AS pos", "'call' AS kind", "concat('go', n, '(x', s % 10, ', ', CASE WHEN s % 5 = 0 THEN 99 ELSE p % 5 END, ')') AS text", "concat('go', n) AS callee")
    return base, head


@query("i4_align_steps", "order_steps", """
    SELECT fn_id, n AS base_pos, CASE WHEN s % 7 <> 0 THEN n END AS head_pos FROM order_steps""")
def align_steps(t):
    """Every call has its own name, so it aligns with itself whether only its literals changed or not."""
    return change.align_steps(*step_versions(t))


@query("d14_pair_steps", "order_steps", """
    WITH o AS (SELECT *, s % 7 = 0 AS gone, s % 5 = 0 AND s % 7 <> 0 AS chg, sum(CASE WHEN s % 7 <> 0 AND s % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY fn_id ORDER BY n) AS gap FROM order_steps),
    b AS (SELECT *, row_number() OVER (PARTITION BY fn_id, gap, s % 2 ORDER BY n) AS k FROM o WHERE gone OR chg),
    h AS (SELECT *, row_number() OVER (PARTITION BY fn_id, gap, s % 2 ORDER BY n) AS k FROM o WHERE chg),
    j AS (SELECT b.fn_id, b.n AS base_id, h.n AS head_id, b.s <> h.s OR b.chg AS differ FROM b LEFT JOIN h ON b.fn_id = h.fn_id AND b.gap = h.gap AND b.s % 2 = h.s % 2 AND b.k = h.k)
    SELECT fn_id, n AS base_id, n AS head_id, NULL AS mark FROM o WHERE NOT gone AND NOT chg
    UNION ALL SELECT fn_id, base_id, head_id, CASE WHEN head_id IS NULL THEN 'del' ELSE 'chg' END FROM j""")
def pair_steps(t):
    o = t.order_steps
    kind = "CASE WHEN s % 2 = 0 THEN 'call' ELSE 'loop' END AS kind"
    base = o.selectExpr("fn_id", "n AS id", "n AS pos", kind, "concat('s', s) AS text", "n AS line")
    head = o.where("s % 7 <> 0").selectExpr("fn_id", "n AS id", "n AS pos", kind, "CASE WHEN s % 5 = 0 THEN concat('new', n) ELSE concat('s', s) END AS text", "n AS line")
    ops = o.selectExpr("fn_id", "explode(CASE WHEN s % 7 = 0 THEN array(struct(n * 2 AS pos, '-' AS op, n AS base_line, 0L AS head_line)) "
                       "WHEN s % 5 = 0 THEN array(struct(n * 2 AS pos, '-' AS op, n AS base_line, 0L AS head_line), struct(n * 2 + 1 AS pos, '+' AS op, 0L AS base_line, n AS head_line)) "
                       "ELSE array(struct(n * 2 AS pos, '=' AS op, n AS base_line, n AS head_line)) END) AS o").select("fn_id", "o.*")
    none = o.where("false").selectExpr("fn_id", "n AS pos", "'call' AS kind", "n AS base_line", "n AS head_line")
    return change.pair_steps(base, head, none, ops)


@query("d13_attach_changes", "order_steps", """
    WITH st AS (SELECT fn_id, n AS pos, n * 3 AS line, s % 2 = 0 AS is_call FROM order_steps),
    c AS (SELECT fn_id, n AS change_id, p % 25 AS line FROM order_steps WHERE p % 25 > 0)
    SELECT c.fn_id, change_id, coalesce((SELECT max(pos) FROM st WHERE st.fn_id = c.fn_id AND st.line <= c.line), (SELECT min(pos) FROM st WHERE st.fn_id = c.fn_id)) AS pos FROM c""")
def attach_changes(t):
    steps = t.order_steps.selectExpr("fn_id", "n AS pos", "CASE WHEN s % 2 = 0 THEN 'call' ELSE 'loop' END AS kind", "n * 3 AS line", "cast(NULL AS BIGINT) AS base_line", "false AS removed")
    changes = t.order_steps.where("p % 25 > 0").selectExpr("fn_id", "n AS change_id", "'call' AS kind", "p % 25 AS head_line", "cast(NULL AS BIGINT) AS base_line")
    return joins.attach_changes(changes, steps, steps.where("false").selectExpr("fn_id", "base_line", "line AS head_line"))


@query("d13_attach_removed", "order_steps", """
    SELECT fn_id, n AS change_id, n AS pos FROM order_steps WHERE s % 2 = 0
    UNION ALL SELECT x.fn_id, n, coalesce((SELECT max(n) FROM order_steps y WHERE y.fn_id = x.fn_id AND y.n < x.n AND y.s % 2 = 0),
      n) FROM order_steps x WHERE s % 2 = 1""")
def attach_removed(t):
    """Changes of removed lines: to the removed step on the line, to the closest removed one above, or through the line map."""
    steps = t.order_steps.selectExpr("fn_id", "n AS pos", "'call' AS kind", "CASE WHEN s % 2 = 0 THEN NULL ELSE n * 10 END AS line",
                                     "CASE WHEN s % 2 = 0 THEN n END AS base_line", "s % 2 = 0 AS removed")
    changes = t.order_steps.selectExpr("fn_id", "n AS change_id", "'call' AS kind", "cast(NULL AS BIGINT) AS head_line", "n AS base_line")
    lines = t.order_steps.where("s % 2 = 1").selectExpr("fn_id", "n AS base_line", "n * 10 AS head_line")
    return joins.attach_changes(changes, steps, lines)


@query("i5_classify_pairs", "", """
    WITH e AS (SELECT event_id AS k, user_id AS u FROM events)
    SELECT k, CASE k % 8 WHEN 0 THEN 'error_check' WHEN 1 THEN 'condition' WHEN 2 THEN 'condition' WHEN 3 THEN 'condition' WHEN 4 THEN 'loop' WHEN 5 THEN 'return' WHEN 6 THEN 'effect' END AS kind,
      CASE k % 8 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 5 THEN 'high' WHEN 6 THEN 'low' ELSE 'medium' END AS severity,
      CASE k % 8 WHEN 0 THEN 'Error check inverted' WHEN 1 THEN 'Condition inverted: < → >=' WHEN 2 THEN 'Condition changed' WHEN 3 THEN 'Switch subject changed' WHEN 4 THEN 'Loop changed'
        WHEN 5 THEN 'Error return replaced' ELSE 'Arguments changed (db.save' || u || ')' END AS why FROM e WHERE k % 8 < 7""")
def classify_pairs(t):
    pick = lambda *v: "get(array(" + ", ".join(v) + "), cast(event_id % 8 AS INT))"
    pairs = t.events.selectExpr(
        "event_id AS k", pick("'decision'", "'decision'", "'decision'", "'switch'", "'loop'", "'return'", "'effect'", "'call'") + " AS step_kind",
        pick("'err != nil'", "concat('n < ', user_id)", "concat('a', user_id)", "'job.kind'", "'for x in y'", "'return err'", "concat('db.save', user_id, '(a)')", "'go(1)'") + " AS before",
        pick("'err == nil'", "concat('n >= ', user_id)", "'b or c'", "'job.state'", "'for z in w'", "'return nil'", "concat('db.save', user_id, '(b)')", "'go(2)'") + " AS after",
        "event_id % 8 = 0 AS base_check", "false AS head_check", "event_id % 8 = 5 AS base_error", "false AS head_error", "'save' AS callee", "cast(NULL AS STRING) AS target")
    return change.classify_pairs(pairs).select("k", "kind", "severity", "why")


ONE_SIDED = """SELECT pos, fn_id, CASE WHEN kind = 'decision' AND "check" THEN 'error_check' WHEN kind = 'decision' THEN 'condition' ELSE kind END AS kind_of_change,
    CASE WHEN kind = 'decision' AND "check" THEN CASE WHEN op = 'added' THEN 'low' ELSE 'high' END WHEN kind IN ('decision', 'loop') THEN 'medium'
      WHEN kind = 'return' THEN CASE WHEN error AND op = 'removed' THEN 'high' ELSE 'low' END
      WHEN kind = 'effect' THEN CASE WHEN target IS NOT NULL THEN 'high' ELSE 'medium' END ELSE 'low' END AS severity,
    CASE WHEN kind = 'decision' AND "check" THEN 'Error check ' || op WHEN kind = 'decision' THEN CASE WHEN op = 'added' THEN 'New condition' ELSE 'Condition removed' END
      WHEN kind = 'loop' THEN CASE WHEN op = 'added' THEN 'New loop' ELSE 'Loop removed' END
      WHEN kind = 'return' THEN CASE WHEN error THEN 'Error return ' || op ELSE 'Return ' || op END
      WHEN kind = 'effect' THEN CASE WHEN op = 'added' THEN 'New ' || coalesce(target, 'outside') || ' call (purchase)' ELSE coalesce(target, 'Outside') || ' call removed (purchase)' END
      ELSE CASE WHEN op = 'added' THEN 'New call: click' ELSE 'Call removed: click' END END AS why FROM steps"""


def one_sided(t):
    return change.classify_one_sided(t.steps.withColumn("absorbed", F.lit(False)))


@query("i6_classify_one_sided", "steps", ONE_SIDED)
def classify_one_sided(t):
    return one_sided(t).select("pos", "fn_id", "kind_of_change", "severity", "why")


@query("i7_literal_changes", "order_steps", """
    SELECT fn_id, n, CAST(s AS VARCHAR) AS before, CAST(s + 1 AS VARCHAR) AS after, CASE WHEN p % 3 < 2 THEN 'medium' ELSE 'low' END AS severity,
      CASE p % 3 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'Condition value' ELSE 'Value' END || ' changed: ' || s || ' → ' || (s + 1) AS why FROM order_steps WHERE s % 2 = 0""")
def literal_changes(t):
    token = lambda e: f"struct({e} AS text, 1 AS line, CASE WHEN p % 3 = 0 THEN 'timeout = x' ELSE 'value = x' END AS statement, p % 3 = 1 AS in_condition)"
    fns = t.order_steps.selectExpr(
        "fn_id", "n", f"array({token(chr(39) + 'f' + chr(39))}, {token(chr(39) + '=' + chr(39))}, {token('cast(s AS STRING)')}, {token(chr(39) + 'y' + chr(39))}) AS base_tokens",
        f"array({token(chr(39) + 'f' + chr(39))}, {token(chr(39) + '=' + chr(39))}, {token('cast(CASE WHEN s % 2 = 0 THEN s + 1 ELSE s END AS STRING)')}, {token(chr(39) + 'y' + chr(39))}) AS head_tokens")
    return change.literal_changes(fns, ["fn_id", "n"]).select("fn_id", "n", "before", "after", "severity", "why")


# ---- gates, config -------------------------------------------------------------------------------------------
def gate_items(t):
    both = t.order_steps.selectExpr("fn_id AS file", "concat('env:', s % 6) AS gate", "n AS line", "'read' AS text", "CASE WHEN n % 4 <> 0 THEN concat('g', n % 2) END AS fn_id", "s", "p")
    return both.where("p % 3 <> 0").drop("s", "p"), both.where("p % 4 <> 0").drop("s", "p")


ITEMS = """WITH i AS (SELECT fn_id AS file, 'env:' || s % 6 AS gate, n AS line, CASE WHEN n % 4 <> 0 THEN 'g' || n % 2 END AS fn, p % 3 <> 0 AS b, p % 4 <> 0 AS h FROM order_steps),
    f AS (SELECT file, gate, fn, bool_or(b) AS b, bool_or(h) AS h FROM i WHERE b OR h GROUP BY 1, 2, 3),
    g AS (SELECT file, gate, CASE WHEN NOT bool_or(b) THEN 'added' WHEN NOT bool_or(h) THEN 'removed' ELSE 'changed' END AS op FROM f GROUP BY 1, 2 HAVING bool_or(fn IS NOT NULL AND b <> h)) """


@query("i9_file_gate_changes", "order_steps", ITEMS + """
    SELECT g.file, g.gate, op, count(DISTINCT line) FILTER (fn IS NOT NULL AND CASE WHEN op = 'removed' THEN b ELSE h END) AS refs FROM g JOIN i ON i.file = g.file AND i.gate = g.gate GROUP BY 1, 2, 3""")
def file_gate_changes(t):
    return change.file_gate_changes(*gate_items(t))


@query("i9_file_gate_refs", "order_steps", ITEMS + """
    SELECT DISTINCT g.file, g.gate, op, line FROM g JOIN i ON i.file = g.file AND i.gate = g.gate WHERE fn IS NOT NULL AND CASE WHEN op = 'removed' THEN b ELSE h END""")
def file_gate_refs(t):
    return change.file_gate_refs(*gate_items(t))


@query("i9_function_gate_changes", "order_steps", ITEMS + """
    SELECT f.file, f.gate, fn AS fn_id, CASE WHEN h THEN 'added' ELSE 'removed' END AS op, CASE WHEN b AND g.op = 'removed' THEN 'high' ELSE 'medium' END AS severity
    FROM f JOIN g ON f.file = g.file AND f.gate = g.gate WHERE fn IS NOT NULL AND b <> h""")
def function_gate_changes(t):
    b, h = gate_items(t)
    name = lambda df: df.withColumn("fn_id", F.expr("CASE WHEN fn_id IS NOT NULL THEN concat(file, '|', fn_id) END"))
    return change.function_gate_changes(name(b), name(h)).selectExpr("cast(split_part(fn_id, '|', 1) AS BIGINT) AS file", "gate", "split_part(fn_id, '|', 2) AS fn_id", "op", "severity")


@query("e13_merge_gates", "marks", """
    SELECT gate, CASE WHEN count(DISTINCT what) = 1 THEN CASE WHEN min(what) = 'read' THEN 'added' ELSE 'removed' END ELSE 'changed' END AS op, count(*) AS refs FROM marks GROUP BY gate""")
def merge_gates(t):
    return rollup.merge_gates(t.marks.selectExpr("gate", "CASE WHEN what = 'read' THEN 'added' ELSE 'removed' END AS op", "ref"))


@query("e13_gate_refs", "marks", """
    SELECT gate, CASE WHEN r AND c THEN 'changed' WHEN r THEN 'added' ELSE 'removed' END AS op, ref FROM marks
    JOIN (SELECT gate, bool_or(what = 'read') AS r, bool_or(what = 'check') AS c FROM marks GROUP BY gate) USING (gate)""")
def gate_refs(t):
    return rollup.gate_refs(t.marks.selectExpr("gate", "CASE WHEN what = 'read' THEN 'added' ELSE 'removed' END AS op", "ref"))


@query("e17_assemble_gates", "marks", """
    SELECT gate, count(DISTINCT ref) FILTER (what = 'read') AS reads, count(DISTINCT ref) FILTER (what = 'check') AS checks,
      CASE WHEN min(text[4:4]) FILTER (what = 'read') = max(text[4:4]) FILTER (what = 'read') THEN min(text[4:4]) FILTER (what = 'read') END AS "default" FROM marks GROUP BY gate""")
def assemble_gates(t):
    reads = t.marks.where("what = 'read'").selectExpr("gate", "ref", "substring(text, 4, 1) AS default")
    return rollup.assemble_gates(reads, t.marks.where("what = 'check'"))


@query("e17_gate_rows", "marks", """
    SELECT gate, 'read' AS what, ref, min(part) AS part, NULL AS text FROM marks WHERE what = 'read' GROUP BY 1, 3
    UNION ALL SELECT gate, 'check', ref, min(part), min(text) FROM marks WHERE what = 'check' GROUP BY 1, 3""")
def gate_rows(t):
    return rollup.gate_rows(t.marks.where("what = 'read'"), t.marks.where("what = 'check'"))


@query("e18_rank_gates", "marks", """
    SELECT gate, count(DISTINCT ref) FILTER (what = 'check') * 3 + count(DISTINCT part) * 2 + count(DISTINCT ref) FILTER (what = 'read') AS score FROM marks GROUP BY gate""")
def rank_gates(t):
    return rollup.rank_gates(t.marks)


@query("i10_config_changes", "", """
    WITH d AS (SELECT p_partkey AS k, p_name, p_brand FROM part), c AS (
      SELECT k, 'MODE' AS key, 'changed' AS op, p_name || ' x' AS value FROM d WHERE k % 3 = 0 UNION ALL SELECT k, 'API_TOKEN', 'changed', '•••' FROM d WHERE k % 2 = 0
      UNION ALL SELECT k, 'FRESH', 'added', p_brand FROM d WHERE k % 5 = 0 UNION ALL SELECT k, 'GONE', 'removed', 'bye' FROM d WHERE k % 7 = 0)
    SELECT 'conf' || k || '/.env' AS path, key, op, value FROM c""")
def config_changes(t):
    p = t.part.withColumn("path", F.expr("concat('conf', p_partkey, '/.env')"))
    base = p.selectExpr("path", "concat('# x\nMODE=first\nexport MODE = \"', p_name, '\"\nAPI_TOKEN=abc\n', CASE WHEN p_partkey % 7 = 0 THEN 'GONE=bye\n' ELSE '' END) AS content")
    head = p.selectExpr("path", "concat('MODE=', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END, '\nAPI_TOKEN=', CASE WHEN p_partkey % 2 = 0 THEN 'def' ELSE 'abc' END, '\n', "
                        "CASE WHEN p_partkey % 5 = 0 THEN concat('FRESH=', p_brand) ELSE '' END) AS content")
    # the quoted and the plain spelling differ as text; only rows whose value changed otherwise are compared here
    return change.config_changes(base, head).where("NOT (key = 'MODE' AND NOT endswith(value, ' x'))")


# ---- roll-ups --------------------------------------------------------------------------------------------------
def changes(t):
    return one_sided(t).selectExpr("fn_id", "pos", "kind_of_change AS kind", "severity", "why", "text AS before", "cast(NULL AS STRING) AS after", "line AS head_line")


STATUSES = "SELECT 'fn' || user_id AS fn_id, ['modified', 'added', 'removed'][user_id % 3 + 1] AS status, 'part' || user_id % 10 AS part FROM events GROUP BY user_id"


def reviewed(t):
    return t.events.select("user_id").distinct().selectExpr("concat('fn', user_id) AS fn_id", "get(array('modified', 'added', 'removed'), cast(user_id % 3 AS INT)) AS status",
                                                            "concat('part', user_id % 10) AS part")


RISK = f"""WITH o AS ({ONE_SIDED}), f AS ({STATUSES}), r AS (SELECT f.fn_id, part, greatest(coalesce(max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), 0),
      CASE WHEN any_value(status) <> 'modified' THEN 1 ELSE 0 END, CASE WHEN bool_or(kind_of_change = 'loop') AND CAST(substring(f.fn_id, 3) AS INT) % 4 = 0 THEN 3 ELSE 0 END) AS r
      FROM f LEFT JOIN o ON o.fn_id = f.fn_id AND o.kind_of_change IN ('loop', 'call') GROUP BY f.fn_id, part) """


def risks(t):
    """Loops stand for signature changes here: a quarter of the functions has callers outside."""
    ch = changes(t).where("kind IN ('loop', 'call')").withColumn("kind", F.expr("CASE WHEN kind = 'loop' THEN 'signature' ELSE kind END"))
    return rollup.function_risk(reviewed(t), ch, reviewed(t).where("cast(substring(fn_id, 3) AS INT) % 4 = 0"))


@query("e10_function_risk", "steps", RISK + "SELECT fn_id, ['none', 'low', 'medium', 'high'][r + 1] AS risk FROM r")
def function_risk(t):
    return risks(t)


@query("e11_part_risk", "steps", RISK + """
    SELECT part, ['none', 'low', 'medium', 'high'][max(r) + 1] AS risk, count(*) AS functions, (SELECT count(DISTINCT event_type) FROM events WHERE 'part' || user_id % 10 = part) AS lines FROM r GROUP BY part""")
def part_risk(t):
    entries = t.events.selectExpr("concat('part', user_id % 10) AS part", "event_type AS line_id")
    return rollup.part_risk(reviewed(t).join(risks(t), "fn_id"), entries)


@query("e11_part_members", "steps", f"""
    WITH f AS ({STATUSES}) SELECT part, 'function' AS what, fn_id AS id FROM f
    UNION SELECT 'part' || user_id % 10, 'line', event_type FROM events WHERE 'part' || user_id % 10 IN (SELECT part FROM f)""")
def part_members(t):
    return rollup.part_members(reviewed(t), t.events.selectExpr("concat('part', user_id % 10) AS part", "event_type AS line_id"))


@query("e12_review_stats", "steps base head", f"""
    WITH o AS ({ONE_SIDED}), f AS ({STATUSES})
    SELECT 'files' AS stat, (SELECT count(*) FROM head) AS n UNION ALL SELECT status, count(*) FROM f GROUP BY 1 UNION ALL SELECT severity, count(*) FROM o GROUP BY 1""")
def review_stats(t):
    return rollup.review_stats(t.head, reviewed(t), changes(t))


@query("e14_change_chips", "steps", f"""
    WITH o AS ({ONE_SIDED}), g AS (SELECT fn_id, why, count(*) AS times, min(pos) AS pos, any_value(severity) AS severity FROM o GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos) AS rank, count(*) OVER (PARTITION BY fn_id) AS n FROM g)
    SELECT fn_id, rank, why, severity, times, greatest(n - 3, 0) AS more FROM r WHERE rank <= 3""")
def change_chips(t):
    return rollup.change_chips(changes(t))


@query("e15_effect_summary", "steps", """
    SELECT fn_id, op, string_agg(target, ', ' ORDER BY pos) AS targets FROM (SELECT fn_id, ['reads', 'writes'][pos % 2 + 1] AS op, text AS target, min(pos) AS pos FROM steps GROUP BY ALL) GROUP BY 1, 2""")
def effect_summary(t):
    return rollup.effect_summary(t.steps.selectExpr("fn_id", "pos", "get(array('reads', 'writes'), cast(pos % 2 AS INT)) AS op", "text AS target"))


@query("e29_dedupe_effects", "steps", """
    SELECT fn_id, kind, text AS target, op, arg_min(line, pos) AS line FROM steps GROUP BY fn_id, kind, text, op""")
def dedupe_effects(t):
    return rollup.dedupe_effects(t.steps.selectExpr("fn_id", "pos", "kind", "text AS target", "op", "line"))


@query("e30_review_progress", "", f"""
    WITH f AS ({STATUSES}), d AS (SELECT DISTINCT 'fn' || user_id AS fn_id FROM events WHERE value > 60)
    SELECT count(*) AS total, count(d.fn_id) AS done, round(100.0 * count(d.fn_id) / count(*), 1) AS percent FROM f LEFT JOIN d USING (fn_id)""")
def review_progress(t):
    return rollup.review_progress(reviewed(t), t.events.where("value > 60").selectExpr("concat('fn', user_id) AS fn_id"))


@query("e33_transition_edges", "moves", """
    WITH d AS (SELECT subject, field, "from", "to", 'f' || event_id % 4 AS fn, min(event_id) AS pos FROM moves GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject, field, "from", "to" ORDER BY pos) AS r, count(*) OVER (PARTITION BY subject, field, "from", "to") AS n FROM d)
    SELECT subject, field, "from", "to", string_agg(fn, ', ' ORDER BY r) FILTER (r <= 2) AS names, greatest(any_value(n) - 2, 0) AS more FROM r GROUP BY 1, 2, 3, 4""")
def transition_edges(t):
    return rollup.transition_edges(t.moves.selectExpr("subject", "field", "`from`", "to", "concat('f', event_id % 4) AS fn", "event_id AS pos"))


@query("d19_resource_edges", "", """
    WITH e AS (SELECT user_id AS u, CASE event_type WHEN 'purchase' THEN 'db' WHEN 'click' THEN 'queue' ELSE 'network' END AS kind, 't' || event_id % 5 AS target, event_type = 'purchase' AND event_id % 3 = 0 AS w FROM events)
    SELECT 'fn' || u AS fn_id, kind, target, bool_or(w) AS is_write FROM e WHERE kind <> 'network' AND NOT (kind = 'db' AND u % 5 <> 0 AND u % 2 = 0) GROUP BY 1, 2, 3""")
def resource_edges(t):
    """Every fifth function is a query; even ones call one."""
    users = t.events.select("user_id").distinct()
    fns = users.selectExpr("concat('fn', user_id) AS fn_id", "CASE WHEN user_id % 5 = 0 THEN 'query' END AS kind")
    effects = t.events.selectExpr("concat('fn', user_id) AS fn_id", "CASE event_type WHEN 'purchase' THEN 'db' WHEN 'click' THEN 'queue' ELSE 'network' END AS kind", "concat('t', event_id % 5) AS target",
                                  "CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'writes' ELSE 'reads' END AS op")
    calls = users.where("user_id % 2 = 0").selectExpr("concat('fn', user_id) AS src", "concat('fn', user_id div 10 * 10) AS dst")
    return joins.resource_edges(fns, effects, calls)


@query("i18_blast_radius", "", """
    WITH r AS (SELECT DISTINCT o_custkey % 50 AS part, 'L' || o_orderkey % 9 AS line_id, 'f' || o_orderkey % 60 AS station FROM orders),
    f AS (SELECT c_custkey AS fn_id, c_custkey % 50 AS part, 'f' || c_custkey % 60 AS name FROM customer),
    n AS (SELECT fn_id, part, name FROM f UNION SELECT fn_id, part, 'f' || (fn_id + i) % 60 FROM f, (SELECT unnest([7, 11]) AS i))
    SELECT DISTINCT fn_id, line_id, 'route' AS label FROM n JOIN r ON r.part = n.part AND r.station = n.name""")
def blast_radius(t):
    routes = t.orders.selectExpr("o_custkey % 50 AS part", "concat('L', o_orderkey % 9) AS line_id", "'route' AS label", "concat('f', o_orderkey % 60) AS station").distinct()
    fns = t.customer.selectExpr("c_custkey AS fn_id", "c_custkey % 50 AS part", "concat('f', c_custkey % 60) AS name")
    callers = t.customer.selectExpr("c_custkey AS fn_id", "explode(array(7, 11)) AS i").selectExpr("fn_id", "concat('f', (fn_id + i) % 60) AS caller")
    return change.blast_radius(fns, callers, routes)


@query("i20_ref_filter", "corpus corpus_lines", """
    SELECT 'i' || doc_id % 9 AS item, c.path || ':' || (doc_id % 12) AS ref FROM corpus c JOIN (SELECT path, max(line_no) AS n FROM corpus_lines GROUP BY path) l ON l.path = c.path
    WHERE doc_id % 12 BETWEEN 1 AND n AND doc_id % 4 <> 0""")
def ref_filter(t):
    items = t.corpus.selectExpr("concat('i', doc_id % 9) AS item", "concat(path, ':', doc_id % 12) AS ref")
    lines = t.corpus_lines.groupBy("path").agg(F.max("line_no").alias("head_lines"))
    return joins.ref_filter(items, lines.join(t.corpus.where("doc_id % 4 <> 0").select("path"), "path", "left_semi"))


@query("a15_review_facts", "steps", f"""
    WITH o AS ({ONE_SIDED}), f AS ({STATUSES}), c AS (SELECT DISTINCT 'fn' || user_id AS fn_id, 'c' || event_id % 20 AS caller FROM events),
    e AS (SELECT fn_id, string_agg(caller, ', ' ORDER BY caller) AS callers FROM c GROUP BY 1)
    SELECT 0 AS section, fn_id AS key, -1 AS pos, 'a.py::' || fn_id || ' ' || status || ', risk low, callers ' || callers AS line FROM f JOIN e USING (fn_id)
    UNION ALL SELECT 0, o.fn_id, o.pos, '  - ' || severity || ': ' || why || CASE WHEN line > 0 THEN ' @ a.py:' || line ELSE '' END FROM o JOIN steps s ON s.pos = o.pos
    UNION ALL SELECT 1, 'env:' || part, 0, 'gate env:' || part || ' added' FROM (SELECT DISTINCT part FROM f)""")
def review_facts(t):
    fns = reviewed(t).selectExpr("fn_id", "'a.py' AS file", "fn_id AS name", "status", "'low' AS risk")
    callers = t.events.selectExpr("concat('fn', user_id) AS fn_id", "concat('c', event_id % 20) AS caller")
    gates = reviewed(t).selectExpr("concat('env:', part) AS gate", "'added' AS op").distinct()
    return change.review_facts(fns, callers, changes(t), gates)


# ---- SQL files --------------------------------------------------------------------------------------------------
def sql_files(t):
    """(base, head): a file of named queries or a migration per part row."""
    k = "p_partkey"
    p = t.part.withColumn("path", F.expr(f"concat('db/q', {k}, '.sql')"))
    get_b = f"'-- name: Get', {k}, ' :one\n-- Loads ', p_name, '. Fast.\nSELECT * FROM t', {k} % 7, ' WHERE id = $1 AND state = \\'open\\' ORDER BY id;\n\n'"
    get_h = f"'-- name: Get', {k}, ' :one\n-- Loads ', p_name, '. Fast.\nSELECT * FROM t', {k} % 7, ' JOIN u ON u.id = t.id WHERE id = $1 AND state = \\'open\\' AND EXISTS (SELECT 1 FROM z);\n\n'"
    set_ = lambda to, more: f"'-- name: Set', {k}, ' :exec\nUPDATE orders', {k} % 5, ' SET status = \\'{to}\\', n = $2\n WHERE id = $1 AND status = \\'new\\'{more};\n'"
    base = p.where(f"{k} % 3 = 0").selectExpr("path", f"concat({get_b}, {set_('paid', ' AND (b IS NULL OR c = 1)')}, '-- name: Old', {k}, ' :exec\nINSERT INTO log (a) VALUES (1) ON CONFLICT DO NOTHING;\n') AS content")
    head = p.where(f"{k} % 3 = 0").selectExpr("path", f"concat(CASE WHEN {k} % 2 = 0 THEN concat({get_h}) ELSE concat({get_b}) END, {set_('done', '')}, '-- name: Fresh', {k}, ' :exec\nDELETE FROM log WHERE a = \\'x\\';\n') AS content")
    enum = f"'CREATE TYPE mood', {k}, ' AS ENUM (\\'a\\', \\'b\\');\n'"
    m_base = p.where(f"{k} % 3 <> 0").selectExpr("path", f"CASE WHEN {k} % 2 = 0 THEN concat({enum}) ELSE '' END AS content")
    m_head = p.where(f"{k} % 3 <> 0").selectExpr("path", f"concat({enum}, 'CREATE TABLE tab', {k}, ' (\n id bigint, -- it; is\n mood mood', {k}, ' DEFAULT \\'a\\',\n price numeric(10, 2), PRIMARY KEY (id, mood));\n"
                                                f"CREATE INDEX ix ON tab', {k}, ' (id);ALTER TABLE tab', {k}, ' DROP COLUMN c;\nDROP TABLE old', {k}, ';\n') AS content")
    return base.unionByName(m_base), head.unionByName(m_head)


FILES = """SELECT p_partkey AS k, 'db/q' || p_partkey || '.sql' AS path, p_name FROM part"""


def unit_rows(*rows) -> str:
    return "\nUNION ALL ".join(f"SELECT {cols} FROM ({FILES}) WHERE {cond}" for cond, cols in rows)


@query("i11_sql_units", "", unit_rows(
    ("k % 3 = 0", """path, true AS named, 'Get' || k AS name, 'Loads ' || p_name || '. Fast.' AS doc, 1 AS "start", 4 AS "end" """), ("k % 3 = 0", "path, true, 'Set' || k, '', 5, 7"),
    ("k % 3 = 0", "path, true, 'Fresh' || k, '', 8, 9"), ("k % 3 <> 0", "path, false, 'CREATE TYPE mood' || k || ' AS ENUM ', '', 1, 1"),
    ("k % 3 <> 0", "path, false, 'CREATE TABLE tab' || k || ' ', '', 2, 5"), ("k % 3 <> 0", "path, false, 'CREATE INDEX ix ON tab' || k || ' ', '', 6, 6"),
    ("k % 3 <> 0", "path, false, 'ALTER TABLE tab' || k || ' DROP COLUMN c', '', 6, 6"), ("k % 3 <> 0", "path, false, 'DROP TABLE old' || k, '', 7, 7")))
def sql_units(t):
    return sqlreview.sql_units(sql_files(t)[1]).select("path", "named", "name", "doc", "start", "end")


def facts(t):
    return tuple(sqlreview.sql_facts(sqlreview.sql_units(f)) for f in sql_files(t))


@query("i12_sql_facts", "", unit_rows(
    ("k % 3 = 0", "path, 'Get' || k AS name, 'SELECT' AS verb, 't' || k % 7 AS tables, 'state = ''open''' AS guards, '' AS sets, false AS conflict"),
    ("k % 3 = 0", "path, 'Set' || k, 'UPDATE', 'orders' || k % 5, 'status = ''new'' | (b IS NULL OR c = 1)', 'status=''paid''', false"), ("k % 3 = 0", "path, 'Old' || k, 'INSERT', 'log', '', '', true")))
def sql_facts(t):
    return facts(t)[0].where("named").selectExpr("path", "name", "verb", "array_join(tables, ',') AS tables", "array_join(guards, ' | ') AS guards", "array_join(sets, ',') AS sets", "conflict")


@query("i13_query_effects", "", unit_rows(
    ("k % 3 = 0", "path, 'Get' || k AS name, 't' || k % 7 AS target, 'reads' AS op, 1 AS line"), ("k % 3 = 0 AND k % 2 = 0", "path, 'Get' || k, 'u', 'reads', 1"),
    ("k % 3 = 0 AND k % 2 = 0", "path, 'Get' || k, 'z', 'reads', 1"), ("k % 3 = 0", "path, 'Set' || k, 'orders' || k % 5, 'writes', 5"), ("k % 3 = 0", "path, 'Fresh' || k, 'log', 'writes', 8")))
def query_effects(t):
    return sqlreview.query_effects(facts(t)[1].where("named"))


@query("i14_query_changes", "", unit_rows(
    ("k % 6 = 0", "path, 'Get' || k AS name, 'condition' AS kind, 'added' AS op, 'medium' AS severity, 'New guard: EXISTS (…)' AS why"),
    ("k % 6 = 0", "path, 'Get' || k, 'effect', 'changed', 'high', 'Now selects t' || k % 7 || ', u, z'"),
    ("k % 3 = 0", "path, 'Set' || k, 'condition', 'removed', 'high', 'Guard removed: (b IS NULL OR c = 1)'"), ("k % 3 = 0", "path, 'Set' || k, 'literal', 'changed', 'high', 'Sets status to done (was paid)'"),
    ("k % 3 = 0", "path, 'Old' || k, 'effect', 'removed', 'medium', 'Query removed'"), ("k % 3 = 0", "path, 'Fresh' || k, 'effect', 'added', 'medium', 'Writes log'"),
    ("k % 3 = 0", "path, 'Fresh' || k, 'condition', 'added', 'low', 'Only when a = ''x'''")))
def query_changes(t):
    b, h = facts(t)
    return sqlreview.query_changes(b.where("named"), h.where("named"))


@query("i15_schema_changes", "", unit_rows(
    ("k % 3 <> 0 AND k % 2 = 1", "path, 'enum' AS kind, 'added' AS op, 'mood' || k AS name, 'a, b' AS detail, path || ':1' AS ref"), ("k % 3 <> 0", "path, 'table', 'added', 'tab' || k, '3 columns; key: id, mood', path || ':2'"),
    ("k % 3 <> 0", "path, 'index', 'added', 'ix', 'on tab' || k || ' (id)', path || ':6'"), ("k % 3 <> 0", "path, 'column', 'removed', 'tab' || k || '.c', '', path || ':6'"),
    ("k % 3 <> 0", "path, 'table', 'removed', 'old' || k, '', path || ':7'")))
def schema_changes(t):
    b, h = (sqlreview.sql_units(f).where("NOT named") for f in sql_files(t))
    return sqlreview.schema_changes(b, h)


@query("i16_column_facts", "", unit_rows(
    ("k % 3 <> 0", """'tab' || k AS "table", 'id' AS "column", 'bigint' AS "type", NULL AS "default" """), ("k % 3 <> 0", "'tab' || k, 'mood', 'mood' || k, 'a'"), ("k % 3 <> 0", "'tab' || k, 'price', 'numeric', NULL")))
def column_facts(t):
    return sqlreview.column_facts(sqlreview.sql_units(sql_files(t)[1]))


@query("i17_lifecycles", "", unit_rows(
    ("k % 3 = 0", """'orders' || k % 5 AS "table", 'status' AS "column", 'new' AS "from", 'done' AS "to", 'Set' || k AS via, path || ':5' AS ref, NULL AS "start" """)))
def lifecycles(t):
    units = sqlreview.sql_units(sql_files(t)[1])
    enums = sqlreview.schema_changes(units.where("false"), units.where("NOT named")).where("kind = 'enum'")
    return sqlreview.lifecycles(sqlreview.sql_facts(units), sqlreview.column_facts(units), enums)


@query("i17_lifecycle_callers", "", "SELECT 'Set' || p_partkey AS via, p_partkey AS fn_id FROM part WHERE p_partkey % 3 = 0")
def lifecycle_callers(t):
    units = sqlreview.sql_units(sql_files(t)[1])
    moves = sqlreview.lifecycles(sqlreview.sql_facts(units), sqlreview.column_facts(units), units.where("false").select("name"))
    return sqlreview.lifecycle_callers(moves, t.part.selectExpr("p_partkey AS fn_id", "explode(array(concat('Set', p_partkey), 'get')) AS name"))
