"""Queries over corpus scans. The expected facts are stated per language form, not found by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from ..operators.ordered import ordered_text
from ..operators.review import review
from ..operators.statements import statements
from .registry import query


def sql_text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    return "replace(replace('" + v.replace("'", "''") + "', '@', CAST(k AS VARCHAR)), '%', CAST(m AS VARCHAR))"


def expected(columns: str, *rows, files: str = "code_files") -> str:
    """SQL: for each file of a language (first value) the given rows."""
    names = columns.split()
    return "\nUNION ALL ".join(
        "SELECT path, " + ", ".join(f'{sql_text(v)} AS "{n}"' for n, v in zip(names, row[1:])) + f" FROM {files} WHERE k % 4 = {row[0]}" for row in rows)


def reads(t):
    return scan.scan_env_reads(t.code_lines).unionByName(scan.scan_flag_reads(t.code_lines))


@query("j1_scan_env_reads", "code_files", expected(
    "line_no name default bound", (0, 4, "MODE_%", '"fast"', None), (0, 11, "TOKEN_%", None, None), (0, 16, "LIMIT_%", None, None),
    (1, 4, "ADDR_%", None, None), (2, 1, "API_%", '"dev"', "API_%"), (2, 1, "HOST", None, "host"), (2, 3, "DEBUG_%", None, None), (3, 3, "JAVA_%", None, None)))
def env_reads(t):
    return scan.scan_env_reads(t.code_lines).select("path", "line_no", "name", "default", "bound")


@query("j2_scan_flag_reads", "code_files", expected(
    "line_no name default", (0, 17, "flag_%", None), (1, 11, "go-flag-%", "true"), (2, 13, "js_flag_%", None), (3, 8, "java-flag-%", None)))
def flag_reads(t):
    return scan.scan_flag_reads(t.code_lines).select("path", "line_no", "name", "default")


@query("j3_bind_constants", "code_files", expected("name value", (0, "KEY_NAME", "LIMIT_%"), (1, "addr", "localhost")))
def constants(t):
    return scan.bind_constants(t.code_lines)


@query("j4_bind_reads", "code_files", expected(
    "line_no name what bound default", (0, 4, "MODE_%", "var", "mode", '"fast"'), (0, 11, "TOKEN_%", "var", "token", None), (0, 16, "LIMIT_%", "field", "limit", None),
    (0, 17, "flag_%", None, None, None), (1, 4, "ADDR_%", "var", "addr", '"localhost"'), (1, 11, "go-flag-%", "var", "on", "true"), (2, 1, "API_%", "var", "API_%", '"dev"'),
    (2, 1, "HOST", "var", "host", None), (2, 3, "DEBUG_%", "var", "debug", '"off"'), (2, 13, "js_flag_%", None, None, None), (3, 3, "JAVA_%", "var", "v", None),
    (3, 8, "java-flag-%", None, None, None)))
def bindings(t):
    return scan.bind_reads(reads(t), t.code_lines).select("path", "line_no", "name", "what", "bound", "default")


# A field read in one file of a part is checked in every file of the part that decides on a field of that name.
CHECKS = [(0, 5, "env:MODE_%", 'if mode == "slow"'), (0, 17, "flag:flag_%", 'if flags.is_enabled("flag_%")'), (1, 5, "env:ADDR_%", 'if addr == ""'),
          (1, 12, "flag:go-flag-%", "if on"), (2, 8, "env:HOST", "if host"), (2, 7, "env:DEBUG_%", "debug ?"), (3, 4, "env:JAVA_%", "if v != null")]
FIELD_CHECKS = """SELECT DISTINCT b.path, 19 AS line_no, 'env:LIMIT_' || a.m AS gate, 'if self.limit > 9' AS text FROM code_files a JOIN code_files b
    ON a.k % 4 = 0 AND b.k % 4 = 0 AND a.k % 20 = b.k % 20"""


@query("j4_wrapped_reads", "effect_files", expected(
    "line_no name what bound default", (0, 9, "PORT_%", "var", "port", '"80"'), (1, 6, "SIZE_%", "var", "size", None), (1, 7, "RATE_%", "var", "rate", None),
    (2, 5, "NAME_%", "var", "n", None), files="effect_files"))
def wrapped_reads(t):
    lines = t.effect_lines
    return scan.bind_reads(scan.scan_env_reads(lines), lines).select("path", "line_no", "name", "what", "bound", "default")


@query("j5_scan_checks", "code_files", expected("line_no gate text", *CHECKS) + " UNION ALL " + FIELD_CHECKS)
def checks(t):
    return scan.scan_checks(scan.bind_reads(reads(t), t.code_lines), t.code_lines, t.code_functions, t.code_parts).select("path", "line_no", "gate", "text")


READS = [(0, 4, "env:MODE_%", '"fast"'), (0, 11, "env:TOKEN_%", None), (0, 16, "env:LIMIT_%", None), (0, 17, "flag:flag_%", None), (1, 4, "env:ADDR_%", '"localhost"'),
         (1, 11, "flag:go-flag-%", "true"), (2, 1, "env:API_%", '"dev"'), (2, 1, "env:HOST", None), (2, 3, "env:DEBUG_%", '"off"'), (2, 13, "flag:js_flag_%", None),
         (3, 3, "env:JAVA_%", None), (3, 8, "flag:java-flag-%", None)]


@query("j6_gates", "code_files", f"""
    WITH r AS ({expected("line_no gate d", *READS)}), c AS ({expected("line_no gate text", *CHECKS)} UNION ALL {FIELD_CHECKS})
    SELECT gate, reads, coalesce(checks, 0) AS checks, "default" FROM (SELECT gate, count(DISTINCT path || ':' || line_no) AS reads, max(d) AS "default" FROM r GROUP BY gate)
    LEFT JOIN (SELECT gate, count(DISTINCT path || ':' || line_no) AS checks FROM c GROUP BY gate) USING (gate)""")
def gates(t):
    return scan.gates(t.code_lines, t.code_functions, t.code_parts)[0]


@query("j6_gate_rows", "code_files", f"""
    SELECT gate, 'read' AS what, path || ':' || line_no AS ref, split_part(path, '/', 1) AS part, NULL AS fn FROM ({expected("line_no gate", *[r[:3] for r in READS if r[1] == 1])})
    UNION ALL SELECT gate, 'read', path || ':' || line_no, split_part(path, '/', 1), fn FROM ({expected("line_no gate fn", *[(*r[:3], {(0, 4): "load_@", (0, 11): "load_@", (0, 16): "put", (0, 17): "put"}.get(r[:2], ("", "Run@", "show@", "J@")[r[0]])) for r in READS if r[1] != 1])})
    UNION ALL SELECT gate, 'check', path || ':' || line_no, split_part(path, '/', 1), fn FROM ({expected("line_no gate fn", *[(*r[:3], {(0, 5): "load_@", (0, 17): "put"}.get(r[:2], ("", "Run@", "show@", "J@")[r[0]])) for r in CHECKS])})
    UNION ALL SELECT gate, 'check', path || ':' || line_no, split_part(path, '/', 1), 'put' FROM ({FIELD_CHECKS})""")
def gate_rows(t):
    return scan.gates(t.code_lines, t.code_functions, t.code_parts)[1].select("gate", "what", "ref", "part", "fn")


@query("j6_gate_routes", "code_files", """
    SELECT DISTINCT 'env:MODE_' || m AS gate, split_part(path, '/', 1) AS part, 'L' || k % 3 AS line_id FROM code_files WHERE k % 4 = 0""")
def gate_routes(t):
    rows = scan.gates(t.code_lines, t.code_functions, t.code_parts)[1]
    routes = t.code_lines.where("k % 4 = 0").selectExpr("split_part(path, '/', 1) AS part", "concat('L', k % 3) AS line_id", "'x' AS label", "concat('load_', k) AS station").distinct()
    return scan.gate_routes(rows, routes)


def assignments(t):
    return scan.scan_state_assignments(t.code_lines, t.code_functions)


@query("j7_scan_state_assignments", "code_files", expected(
    "line_no field receiver family value", (0, 9, "status", "item", "string", "running"), (0, 20, "status", "x", "string", "done"), (1, 9, "State", "job", "JobState", "JobStateBusy"),
    (1, 20, "State", "job", "JobState", "JobStateDone"), (3, 5, "state", "order", "string", "OPEN"), (3, 7, "state", "order", "string", "SHUT")))
def state_assignments(t):
    return assignments(t).select("path", "line_no", "field", "receiver", "family", "value")


FROMS = [(0, 9, "queued", "running"), (0, 20, None, "done"), (1, 9, "JobStateReady", "JobStateBusy"), (1, 20, "JobStateBusy", "JobStateDone"), (3, 5, None, "OPEN"), (3, 7, None, "SHUT")]


@query("j8_infer_from", "code_files", expected("line_no from value", *FROMS))
def infer_from(t):
    return scan.infer_from(assignments(t), t.code_lines).select("path", "line_no", "from", "value")


@query("j9_state_machines", "moves", """
    WITH d AS (SELECT DISTINCT subject, "from", "to" FROM moves), s AS (SELECT subject, "to" AS s FROM moves UNION SELECT subject, "from" FROM moves WHERE "from" IS NOT NULL)
    SELECT 'event_state' AS field, d.subject AS family, any_value(n) AS states, count(*) AS transitions FROM d JOIN (SELECT subject, count(DISTINCT s) AS n FROM s GROUP BY 1) USING (subject)
    GROUP BY d.subject HAVING count(*) >= 2 AND any_value(n) >= 3""")
def state_machines(t):
    rows = t.moves.selectExpr("'log' AS path", "event_id AS line_no", "'f' AS fn_id", "field", "subject AS receiver", "subject AS family", "to AS value", "`from`")
    return scan.state_machines(rows)[0].select("field", "family", "states", "transitions")


@query("j9_machine_subjects", "code_files", """
    SELECT 'State' AS field, 'job.State' AS id, 3 AS states, (SELECT count(*) FROM code_files WHERE k % 4 = 1) * 2 AS transitions
    UNION ALL SELECT 'status', 'item.status', 3, (SELECT count(*) FROM code_files WHERE k % 4 = 0) * 2""")
def machine_subjects(t):
    return scan.state_machines(scan.infer_from(assignments(t), t.code_lines))[0].select("field", "id", "states", "transitions")


@query("j10_scan_steps", "code_files", expected(
    "line_no kind text error depth", (0, 4, "call", 'mode = os.getenv("MODE_%", "fast")', False, 0), (0, 5, "decision", 'if mode == "slow"', False, 0),
    (0, 6, "return", "return helper_@(cfg)", False, 1), (0, 7, "loop", "for item in cfg.items()", False, 0), (0, 8, "decision", 'if item.status == "queued"', False, 1),
    (0, 10, "call", "db.save(item)", False, 1), (0, 12, "return", "return token", False, 0), (0, 16, "call", "self.limit = int(os.environ.get(KEY_NAME))", False, 0),
    (0, 17, "decision", 'if flags.is_enabled("flag_%")', False, 0), (0, 18, "call", "client.send(x)", False, 1), (0, 19, "decision", "if self.limit > 9", False, 0),
    (1, 4, "call", 'addr := os.Getenv("ADDR_%")', False, 0), (1, 5, "decision", 'if addr == ""', False, 0), (1, 8, "decision", "if job.State == JobStateReady", False, 0),
    (1, 11, "call", 'on, _ := client.BooleanValue(ctx, "go-flag-%", true, evalCtx)', False, 0), (1, 12, "decision", "if on", False, 0), (1, 13, "return", "return start@(addr)", False, 1),
    (1, 15, "decision", "if err != nil", False, 0), (1, 16, "return", 'return fmt.Errorf("x", err)', True, 1), (1, 18, "switch", "switch job.State", False, 0), (1, 22, "return", "return nil", False, 0),
    (2, 4, "decision", "if (!x)", False, 0), (2, 5, "return", "return null", False, 1), (2, 8, "decision", "if (host)", False, 0), (2, 9, "call", "fetch(x)", False, 1),
    (2, 11, "call", "other.draw(x)", False, 1), (2, 13, "return", 'return checkFeatureFlag("js_flag_%")', False, 0),
    (3, 3, "call", 'String v = System.getenv("JAVA_%")', False, 0), (3, 4, "decision", "if (v != null)", False, 0), (3, 8, "call", 'ld.boolVariation("java-flag-%", user, false)', False, 0),
    (3, 9, "throw", 'throw new Error("bad")', True, 0)))
def scan_steps(t):
    return scan.scan_steps(t.code_lines, t.code_functions).selectExpr("path", "line_no", "kind", "text", "error", "cast(size(block_path) AS BIGINT) AS depth")


@query("j10_statements", "long_files", expected(
    "line_no last_line text", (0, 1, 1, "def send_@(x):"), (0, 2, 3, "    if (x.a  # why (not and x.b):"), (0, 4, 6, '        return client.send( "a ) b", [1, %])'),
    (0, 7, 8, '    text = """if y: ( more"""'), (0, 9, 9, "    return text"), (1, 1, 1, "export function go@(xs) {"), (1, 2, 3, "  const q = `select ( 1 from t%`"),
    (1, 4, 4, "  xs.map((x) => {"), (1, 5, 6, "    db.save( x)"), (1, 7, 7, "  })"), (1, 8, 9, "  /* if ( */ return q"), (1, 10, 10, "}"),
    (2, 1, 1, "func Up@(c Conn) error {"), (2, 2, 4, '\tif err := c.Exec( "q%", 1, ); err != nil {'), (2, 5, 5, "\t\treturn err"), (2, 6, 6, "\t}"), (2, 7, 7, "\treturn nil"), (2, 8, 8, "}"),
    (3, 1, 1, "class V@ {"), (3, 2, 3, "  void run(int a, int b) {"), (3, 4, 5, "    call(a, // first ( b);"), (3, 6, 6, "  }"), (3, 7, 7, "}"), files="long_files"))
def joined_statements(t):
    return statements(t.long_lines).select("path", "line_no", "last_line", "text")


@query("j10_stops_and_loops", "effect_files", expected(
    "line_no kind error depth", (0, 2, "decision", False, 0), (0, 3, "throw", True, 1), (0, 5, "loop", False, 0), (0, 6, "call", False, 1), (0, 8, "call", False, 0),
    (0, 9, "call", False, 0), (0, 10, "call", False, 0), (1, 2, "loop", False, 0), (1, 3, "call", False, 1), (1, 5, "call", False, 0), (1, 6, "call", False, 0), (1, 7, "call", False, 0),
    (1, 8, "return", False, 0), (2, 2, "loop", False, 0), (2, 3, "call", False, 1), (2, 5, "call", False, 0), (2, 6, "decision", False, 0), (2, 7, "call", False, 1), (2, 9, "throw", True, 0),
    (3, 2, "loop", False, 0), (3, 3, "call", False, 1), (3, 5, "throw", True, 0), files="effect_files"))
def stops_and_loops(t):
    lines = t.effect_lines
    return scan.scan_steps(lines, scan.scan_functions(lines).withColumn("fn_id", F.col("path"))).selectExpr(
        "path", "line_no", "kind", "error", "cast(size(block_path) AS BIGINT) AS depth")


@query("j10_effects", "effect_files", expected(
    "line_no kind callee target", (0, 2, "effect", "find", None), (0, 6, "effect", "save", None), (0, 8, "effect", "size", None), (0, 9, "effect", "var", "Config"), (0, 10, "call", "helper_@", None),
    (1, 3, "effect", "send", None), (1, 5, "effect", "get", None), (1, 5, "effect", "close", None), (1, 8, "effect", "query", None), (2, 3, "effect", "Exec", None),
    (2, 3, "call", "helper_@", None), (2, 7, "call", "helper_@", None), (3, 3, "effect", "set", None), files="effect_files"))
def effects(t):
    """The helpers are known functions; those whose result is only logged are no step. One line has a reference to an outside system."""
    lines = t.effect_lines
    known = t.part.selectExpr("concat('helper_', p_partkey) AS name")
    refs = lines.where("endswith(path, '.rs') AND line_no = 9").selectExpr("path", "line_no AS line", "'Config' AS target")
    return scan.scan_effects(lines, scan.scan_functions(lines).withColumn("fn_id", F.col("path")), known, refs).select("path", "line_no", "kind", "callee", "target")


@query("j11_classify_calls", "code_files", """
    SELECT k, CASE k % 6 WHEN 0 THEN 'effect' WHEN 1 THEN 'effect' WHEN 2 THEN 'call' WHEN 3 THEN 'effect' END AS kind FROM code_files WHERE k % 6 < 4""")
def classify_calls(t):
    calls = t.part.selectExpr(
        "p_partkey AS k", "get(array('save', 'publish', 'helper', 'Get', 'NewThing', 'Info'), cast(p_partkey % 6 AS INT)) AS callee",
        "get(array('s._db', 'bus', 'self', 'x', 'sqlClient', 'app.logger'), cast(p_partkey % 6 AS INT)) AS receiver",
        "p_partkey % 6 <> 4 AS known", "CASE WHEN p_partkey % 6 = 3 THEN p_brand END AS target")
    return scan.classify_calls(calls).select("k", "kind")


SITES = [(0, 4, "getenv", "os", None, None), (0, 6, "helper_@", "", 'mode == "slow"', None), (0, 7, "items", "cfg", 'mode != "slow"', None),
         (0, 10, "save", "db", 'mode != "slow"', "for item in cfg.items()"), (0, 16, "int", "", None, None), (0, 16, "get", "environ", None, None), (0, 17, "is_enabled", "flags", None, None),
         (0, 18, "send", "client", 'flags.is_enabled("flag_%")', None), (1, 4, "Getenv", "os", None, None), (1, 11, "BooleanValue", "client", None, None), (1, 13, "start@", "", "on", None),
         (2, 9, "fetch", "", "host", None), (2, 11, "draw", "other", "not: host", None), (2, 13, "checkFeatureFlag", "", None, None),
         (3, 3, "getenv", "System", None, None), (3, 8, "boolVariation", "ld", None, None)]


@query("j12_scan_call_sites", "code_files", expected("line_no name recv", *[s[:4] for s in SITES]))
def call_sites(t):
    return scan.scan_call_sites(t.code_lines, t.code_functions).select("path", "line_no", "name", "recv")


@query("j13_call_guards", "code_files", expected("line_no name when loop", *[(*s[:3], *s[4:]) for s in SITES]))
def call_guards(t):
    return scan.call_guards(scan.scan_call_sites(t.code_lines, t.code_functions), t.code_lines, t.code_functions).select("path", "line_no", "name", "when", "loop")


@query("j13_connected_guards", "code_files", expected("line_no name when loop", (0, 7, "items", None, None), (0, 10, "save", None, "for item in cfg.items()"), (1, 13, "start@", "on", None)))
def connected_guards(t):
    """Of the calls that lead to a reviewed function, two share a guard: it says nothing about their order. Alone, a call keeps its guard."""
    return scan.call_guards(scan.scan_call_sites(t.code_lines, t.code_functions), t.code_lines, t.code_functions, connected="name IN ('items', 'save') OR name LIKE 'start%'").select(
        "path", "line_no", "name", "when", "loop")


@query("j14_scan_functions", "code_files", expected(
    "name start end", (0, "load_@", 2, 13), (0, "Store_@", 14, 22), (0, "put", 15, 22), (1, "Run@", 3, 23), (2, "show@", 2, 14), (3, "J@", 1, 11)))
def scan_functions(t):
    return scan.scan_functions(t.code_lines)


@query("j15_scan_docs", "code_files", expected("start doc", (0, 2, "Load things for @. Returns cfg."), (1, 3, "Starts job @.")))
def scan_docs(t):
    return scan.scan_docs(t.code_functions, t.code_lines)


@query("review_job", "code_files", """
    WITH c AS (SELECT *, split_part(path, '/', 1) AS part FROM code_files)
    SELECT 'file' AS section, path AS id, 'modified' AS a, part AS b FROM c WHERE k % 4 = 0 UNION ALL SELECT 'file', path, 'deleted', part FROM c WHERE k % 8 = 1
    UNION ALL SELECT 'function', path || '::load_' || k, 'modified', 'high' FROM c WHERE k % 4 = 0 UNION ALL SELECT 'function', path || '::Run' || k, 'removed', 'high' FROM c WHERE k % 8 = 1
    UNION ALL SELECT 'change', path || '::load_' || k, 'Condition inverted: == → !=', 'high' FROM c WHERE k % 4 = 0
    UNION ALL SELECT 'change', path || '::Run' || k, 'Gate removed: ' || g || m, 'high' FROM c, (VALUES ('env:ADDR_'), ('flag:go-flag-')) v(g) WHERE k % 8 = 1
    UNION ALL SELECT 'gate', g || m, 'removed', CAST(count(*) AS VARCHAR) FROM c, (VALUES ('env:ADDR_'), ('flag:go-flag-')) v(g) WHERE k % 8 = 1 GROUP BY g, m
    UNION ALL SELECT 'part', part, 'high', CAST(count(*) AS VARCHAR) FROM c WHERE k % 4 = 0 OR k % 8 = 1 GROUP BY part""")
def review_job(t):
    """In every Python file one condition is inverted, every other Go file is deleted; the rest stays."""
    side = lambda text: t.code_lines.groupBy("path", "k").agg(ordered_text(F.expr(text), ["line_no"], "\n").alias("content"))
    base, head = side("text"), side("replace(text, 'mode == \"slow\"', 'mode != \"slow\"')").where("k % 8 <> 1")
    with_sha = lambda df: df.selectExpr("path", "sha1(content) AS sha", "content")
    s = review(with_sha(base), with_sha(head), t.code_parts)
    rows = lambda name, section, *e: s[name].selectExpr(f"'{section}' AS section", *e)
    out = rows("files", "file", "path AS id", "status AS a", "part AS b")
    for more in (rows("functions", "function", "fn_id AS id", "status AS a", "risk AS b"), rows("changes", "change", "fn_id AS id", "why AS a", "severity AS b"),
                 rows("gates", "gate", "gate AS id", "op AS a", "cast(refs AS STRING) AS b"), rows("parts", "part", "part AS id", "risk AS a", "cast(functions AS STRING) AS b")):
        out = out.unionByName(more)
    return out
