"""Corpus scans: facts from source lines by regular expressions, indentation and joins.

Input everywhere: lines (by, path, line_no, text). Fidelity is that of lines: expressions over several lines,
shadowed names and reassignments are not seen; no fact is better than a wrong one. Block structure comes from
indentation. Windows run per file, so one task holds the lines of one file at a time and spills beyond its memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from ..session import cut, once
from .joins import enclosing, entries_through, owner_of
from .ordered import first_per, spread_join
from .rollup import assemble_gates, gate_rows

_STRING = r"""(?:"([^"]*)"|\x27([^\x27]*)\x27)"""
_LITERAL = r"""("[^"]*"|\x27[^\x27]*\x27|-?\d[\d.]*|true|false|True|False|None|null|nil)"""
_NOT_CALLS = "if for while switch catch return func def function elif elsif match when unless and or not in await go defer new else".split()
_BARE = r"ltrim(' \t\n\u000B\u000C\r', text)"   # without the white space before it
INDENT = rf"length(replace(left(text, length(text) - length({_BARE})), '\t', '    '))"


def _holds(*words: str, text: str = "text") -> str:
    """SQL: ``text`` holds one of the words. A cheap test that every match of a pattern passes; stands before the pattern, never for it."""
    return "(" + " OR ".join(f"contains({text}, {S.text(w)})" for w in words) + ")"


_ANY_CASE = "lower(text)"


def _at(column: str, pattern: str, group: int) -> str:
    return f"regexp_extract({column}, {S.text(pattern)}, {group})"


def _quoted(column: str) -> str:
    """SQL: a literal with its strings in double quotes, so equal defaults compare equal; null when empty."""
    return f"nullif(regexp_replace({column}, {S.text(chr(94) + chr(39) + '(.*)' + chr(39) + '$')}, '\"$1\"'), '')"


def _finds(lines: DataFrame, pattern: str, by: Sequence[str], holds: str = "true") -> DataFrame:
    """(by, path, line_no, text, m): every match of the pattern, lines without one filtered out before matching. ``holds`` (SQL) is a
    cheaper test that every match passes."""
    return lines.where(f"{holds} AND text rlike {S.text(pattern)}").select(
        *by, "path", "line_no", "text", F.explode(F.expr(f"regexp_extract_all(text, {S.text(pattern)}, 0)")).alias("m"))


def _computed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns (SQL ``e AS name``) that are computed once a row: Spark copies plain columns into all filters and columns that
    use them, and patterns are what the scans spend their time on."""
    return df.select("*", F.explode(F.expr(f"array(struct({', '.join(columns)}))")).alias("_c")).select(*df.columns, "_c.*")


# ---- environment variables and flags ----------------------------------------------------------------
def bind_constants(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, name, value): identifiers bound to exactly one string constant in a file."""
    rows = lines.where(f"contains(text, '=') AND {_holds(chr(34), chr(39))} AND text rlike {S.text(fx.CONSTANT_DEF)}").selectExpr(
        *by, "path", f"{_at('text', fx.CONSTANT_DEF, 1)} AS name", f"{_at('text', fx.CONSTANT_DEF, 2)} AS value")
    return rows.groupBy(*by, "path", "name").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")


def scan_env_reads(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, kind, name, default, bound): environment variables read: by call, subscript, member or
    destructuring. ``bound`` is the variable a destructuring names."""
    columns = [*by, "path", "line_no"]
    env = _holds("env", text=_ANY_CASE)   # every form of reading one names it
    call = rf"(?<![\w.:]){fx.ENV_CALL}\(\s*(?:{_STRING}|([A-Za-z_]\w*))\s*(?:,\s*{_LITERAL})?"
    calls = _finds(lines, call, by, env).selectExpr(
        *columns, f"{_at('m', call, 1)} AS callee", f"coalesce(nullif({_at('m', call, 2)}, ''), {_at('m', call, 3)}) AS lit",
        f"{_at('m', call, 4)} AS ident", f"{_quoted(_at('m', call, 5))} AS def")
    named = calls.join(bind_constants(lines, by).select(*by, "path", F.col("name").alias("ident"), "value"), [*by, "path", "ident"], "left")
    out = named.selectExpr(*columns, "coalesce(nullif(lit, ''), value) AS name", "CASE WHEN callee rlike 'getenv|environ|ENV' THEN def END AS default", "cast(NULL AS STRING) AS bound")
    item = rf"(?<![\w.]){fx.ENV_OBJECT}\[\s*{_STRING}\s*\]"
    out = out.unionByName(_finds(lines, item, by, env).selectExpr(
        *columns, f"coalesce(nullif({_at('m', item, 2)}, ''), {_at('m', item, 3)}) AS name", "cast(NULL AS STRING) AS default", "cast(NULL AS STRING) AS bound"))
    member = r"(?<![\w.])(?:process\.env|import\.meta\.env)\.([A-Za-z_$][\w$]*)(?!\s*=(?!=))(?![\w$])"
    out = out.unionByName(_finds(lines, member, by, env).selectExpr(
        *columns, f"{_at('m', member, 1)} AS name", "cast(NULL AS STRING) AS default", "cast(NULL AS STRING) AS bound"))
    whole = r"\b(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:process\.env|import\.meta\.env)\s*;?\s*$"
    one = rf"^\s*([A-Za-z_$][\w$]*)\s*(?::\s*([A-Za-z_$][\w$]*)|=\s*{_LITERAL})?\s*$"
    taken = _finds(lines, whole, by, env).select(*columns, F.explode(F.expr(f"split({_at('m', whole, 1)}, ',')")).alias("i")).where(f"i rlike {S.text(one)}")
    out = out.unionByName(taken.selectExpr(
        *columns, f"{_at('i', one, 1)} AS name", f"{_quoted(_at('i', one, 3))} AS default",
        f"coalesce(nullif({_at('i', one, 2)}, ''), {_at('i', one, 1)}) AS bound"))
    return out.where(f"name rlike {S.text('^' + fx.ENV_NAME + '$')}").select(*columns, F.lit("env").alias("kind"), "name", "default", "bound")


def scan_flag_reads(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, kind, name, default, bound): feature flags read through flag libraries or an application's wrappers;
    general method names count only on a receiver that looks like a flag client."""
    chain = r"[A-Za-z_$][\w$]*(?:(?:\??\.|::|->)[A-Za-z_$][\w$]*)*"
    call = rf"(?<![\w.$])({chain})\(\s*(?:{_STRING}|([A-Za-z_]\w*))\s*(?:,\s*(?:{_STRING}|([A-Za-z_]\w*)))?(?:,\s*{_LITERAL})?"
    hint = r"(?i)flag|feature|variation|is_?on|is_?off|is_?enabled|_?value|_?details|eval|Boolean|Float|Object"
    rows = _computed(
        _finds(lines, call, by, f"contains(text, '(') AND text rlike {S.text(hint)}").select(*by, "path", "line_no", "m"), f"{_at('m', call, 1)} AS callee", f"coalesce(nullif({_at('m', call, 2)}, ''), {_at('m', call, 3)}) AS a1", f"{_at('m', call, 4)} AS i1",
        f"coalesce(nullif({_at('m', call, 5)}, ''), {_at('m', call, 6)}) AS a2", f"{_at('m', call, 7)} AS i2", f"{_quoted(_at('m', call, 8))} AS d3",
        f"{_quoted(_at('m', rf'^{chain}{chr(92)}([^,]*,{chr(92)}s*{_LITERAL}', 1))} AS d2")
    rows = _computed(rows, r"element_at(split(callee, '\\??\\.|::|->'), -1) AS last").withColumn("key", F.expr("lower(replace(last, '_', ''))"))
    go = f"(endswith(path, '.go') AND last rlike '^{fx.GO_FLAG}$' AND i1 rlike '(?i)ctx|context' AND d3 IS NOT NULL)"
    sdk = f"last rlike {S.text('^' + fx.FLAG_SDK + '$')}"
    general = f"last rlike {S.text('^' + fx.FLAG_GENERIC + '$')}"
    flag = (f"CASE WHEN {sdk} THEN true WHEN {general} THEN left(callee, length(callee) - length(last)) rlike {S.text(fx.FLAG_RECEIVER)} "
            "WHEN contains(key, 'flag') THEN key rlike 'get|check|is|value|enabled|eval|variant' AND key <> 'getflags' "
            "ELSE contains(key, 'feature') AND key rlike 'enabled|active|featureon|value' END")
    consts = bind_constants(lines, by).select(*by, "path", F.col("name").alias("ident"), "value")
    named = rows.where(f"{go} OR {flag}").withColumn("is_go", F.expr(go)).withColumn("ident", F.expr("CASE WHEN is_go THEN i2 ELSE i1 END")).join(
        consts, [*by, "path", "ident"], "left")
    return named.selectExpr(
        *by, "path", "line_no", "'flag' AS kind", "coalesce(nullif(CASE WHEN is_go THEN a2 ELSE a1 END, ''), value) AS name",
        f"CASE WHEN is_go THEN d3 WHEN {sdk} THEN d2 END AS default", "cast(NULL AS STRING) AS bound").where(f"name rlike {S.text('^' + fx.FLAG_NAME + '$')}")


def bind_reads(reads: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """reads with ``what`` (var or field), ``bound`` and ``default``: the name each read is stored in, through wrappers that keep the
    value, and the default stated around it: ``or "d"``, ``orElse("d")``, or an emptiness check on the next line."""
    text = reads.join(lines.select(*by, "path", "line_no", "text"), [*by, "path", "line_no"])
    keep = rf"(?:\w+(?:\.|::))*(?i:{fx.VALUE_KEEPING}|boolean)\("
    target = r"^\s*(?:export\s+)?(?:(?:const|let|var|val|final|static|private|public)\s+)*(?:[A-Z]\w*(?:<[^>]*>)?\s+)?((?:\w+(?:\.|->))*\w+)(?:\s*,\s*\w+)?(?:\s*:\s*[\w.<>\[\]]+)?\s*(?::=|=)(?!=)\s*"
    keyed = r"^\s*(\w+):\s+"
    assigned = rf"{target}(?:{keep})*(?:(?:os|syscall|System|std|Deno|process|import|ENV|env|getenv|environ)\b|[\w.>-]*(?:\w+)\()"
    b = _computed(text, f"nullif({_at('text', assigned, 1)}, '') AS _t", f"CASE WHEN endswith(path, '.go') THEN nullif({_at('text', keyed, 1)}, '') END AS _k")
    after = rf"(?:\|\||\?\?|\?:|\bor\b)\s*{_LITERAL}"
    method = rf"\.(?:{fx.DEFAULT_METHOD})\(\s*(?:\|_\|\s*)?{_LITERAL}(?:\.to_string\(\)|\.into\(\)|\.to_owned\(\))?\s*\)"
    b = b.selectExpr(
        *by, "path", "line_no", "kind", "name", "text",
        "CASE WHEN bound IS NOT NULL THEN 'var' WHEN _t rlike '[.>]' THEN 'field' WHEN _t IS NOT NULL THEN 'var' WHEN _k IS NOT NULL THEN 'field' END AS what",
        r"coalesce(bound, element_at(split(_t, '\\.|->'), -1), _k) AS bound",
        f"coalesce(default, {_quoted(_at('text', method, 1))}, {_quoted(_at('text', after, 1))}) AS default")
    # only texts that can be the check and the assignment below are carried
    ahead = lines.selectExpr(*by, "path", "line_no - 1 AS line_no", "CASE WHEN contains(text, 'if') THEN text END AS next1").join(
        lines.selectExpr(*by, "path", "line_no - 2 AS line_no", "CASE WHEN contains(text, '=') THEN text END AS next2"), [*by, "path", "line_no"])
    b = b.join(ahead, [*by, "path", "line_no"], "left")
    empty = "concat('^\\\\s*if\\\\s+\\\\(?(?:', bound, '\\\\s*(?:==|===|is)\\\\s*(?:\"\"|nil|None|null|undefined|NULL|nullptr)|!', bound, '|not ', bound, ')\\\\)?\\\\s*[:{]?\\\\s*$')"
    fill = r"concat('^\\s*', bound, '\\s*=\\s*(\"[^\"]*\"|\\x27[^\\x27]*\\x27|-?\\d[\\d.]*|true|false)\\s*;?\\s*$')"
    fallback = f"CASE WHEN kind = 'env' AND what = 'var' AND next1 rlike {empty} THEN {_quoted(f'regexp_extract(next2, {fill}, 1)')} END"
    return b.selectExpr(*by, "path", "line_no", "kind", "name", "what", "bound", f"coalesce(default, {fallback}) AS default")


def decisions(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, keyword, cond, text): lines deciding something; text as shown, at most 120 characters."""
    head = r"^\s*(?:\}\s*)?(?:else\s+)?(if|elif|elsif|unless|switch|match|when|case)\b\s*(.*?)\s*(?:\{|:|then)?\s*$"
    ternary = r"(?:=|return|\()\s*([^=?:]*[^=?:\s])\s+\?\s+\S.*\s:\s"
    opens = r"text rlike '^\\s*(?:\\}\\s*)?(?:else\\s+)?(?:if|elif|elsif|unless|switch|match|when|case)\\b'"
    likely = lines.where(f"{opens} OR (contains(text, '?') AND contains(text, ':'))")
    rows = _computed(likely.select(*by, "path", "line_no", "text"), f"{_at('text', head, 1)} AS keyword", f"{_at('text', head, 2)} AS c", f"{_at('text', ternary, 1)} AS q").where(
        "(keyword <> '' AND NOT (keyword = 'case' AND c rlike ':')) OR q <> ''")
    rows = rows.where("keyword <> 'case'")
    cond = S.squash(S.unparen("CASE WHEN keyword <> '' THEN c ELSE q END"))
    return _computed(rows, f"{cond} AS cond").selectExpr(
        *by, "path", "line_no", "keyword", "cond", "left(CASE WHEN keyword <> '' THEN concat(keyword, ' ', cond) ELSE concat(cond, ' ?') END, 120) AS text")


def _owners(lines: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return owner_of(lines.select(*by, "path"), parts.select(*by, F.col("id").alias("owner"), F.col("path").alias("folder")), by)


def scan_checks(bindings: DataFrame, lines: DataFrame, functions: DataFrame, parts: DataFrame, by: Sequence[str] = (),
                owners: DataFrame | None = None) -> DataFrame:
    """(by, gate, path, line_no, text): decisions that mention a gate: the read itself, its variable after the assignment in the
    same function, or its field anywhere in the same part. functions: (fn_id, path, start, end); parts: (id, path); ``owners``:
    (path, owner) of the lines' files, if known."""
    b = once(bindings, "bindings").withColumn("gate", F.concat_ws(":", "kind", "name"))
    d = cut(decisions(lines, by), "decisions")   # it and the words are used several times below
    direct = b.select(*by, "gate", "path", "line_no").join(d, [*by, "path", "line_no"]).select(*by, "gate", "path", "line_no", "text")
    wanted = b.where("bound IS NOT NULL").selectExpr(*by, "bound AS word").distinct()
    words = cut(d.select("*", F.explode(F.expr(S.identifiers("cond"))).alias("word")).join(wanted, [*by, "word"], "left_semi"), "words")
    fn_of = lambda df: df.join(enclosing(df.withColumnRenamed("line_no", "line"), functions, [*by, "path"]).withColumnRenamed("line", "line_no"),
                               [*by, "path", "line_no"], "left").withColumn("fn_id", F.coalesce(F.col("fn_id").cast("string"), F.lit("")))
    var = fn_of(b.where("what = 'var'")).selectExpr(*by, "gate", "path", "fn_id", "bound AS word", "line_no AS _from")
    # of one variable bound to a gate several times in a function the first binding decides
    var = var.groupBy(*by, "gate", "path", "fn_id", "word").agg(F.min("_from").alias("_from"))
    # a variable bound outside functions is seen in the whole file
    by_var = fn_of(words).join(var.withColumnRenamed("fn_id", "_fn"), [*by, "path", "word"]).where(
        "line_no > _from AND (_fn = '' OR _fn = fn_id)").select(*by, "gate", "path", "line_no", "text")
    own = cut(_owners(lines, parts, by), "owners") if owners is None else owners
    place = own.select(*by, "path", F.coalesce("owner", "path").alias("_part"))
    field = b.where("what = 'field'").join(place, [*by, "path"]).selectExpr(*by, "gate", "_part", "bound AS word").distinct()
    dotted = words.where(r"cond rlike concat('(\\.|->|::)', word, '\\b')").join(place, [*by, "path"])
    by_field = spread_join(dotted, field, [*by, "_part", "word"]).select(*by, "gate", "path", "line_no", "text")
    return direct.unionByName(by_var).unionByName(by_field).distinct()


def gates(lines: DataFrame, functions: DataFrame, parts: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(gates, rows): every gate with its default, and its reads and checks (ref, part, text, fn_id)."""
    reads = scan_env_reads(lines, by).unionByName(scan_flag_reads(lines, by))
    bound = cut(bind_reads(reads, lines, by), "bindings")
    owners = cut(_owners(lines, parts, by), "owners")
    checks = cut(scan_checks(bound, lines, functions, parts, by, owners), "checks")
    own = owners.withColumnRenamed("owner", "part")
    r = bound.join(own, [*by, "path"]).selectExpr(*by, "concat(kind, ':', name) AS gate", "concat(path, ':', line_no) AS ref", "part", "default")
    c = checks.join(own, [*by, "path"]).selectExpr(*by, "gate", "concat(path, ':', line_no) AS ref", "part", "text")
    rows = gate_rows(r, c, by)
    at = rows.withColumn("r", F.expr(S.parse_ref("ref"))).withColumn("path", F.col("r.path")).withColumn("line", F.col("r.line")).drop("r")
    return assemble_gates(r, c, by), at.join(enclosing(at, functions, [*by, "path"], take=("fn_id", "name")), [*by, "path", "line"], "left").select(
        *by, "gate", "what", "ref", "part", "text", "fn_id", F.col("name").alias("fn"))


def gate_routes(rows: DataFrame, routes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gate, part, line_id): routes with a station that is a function checking the gate."""
    checking = rows.where("what = 'check' AND fn IS NOT NULL AND part IS NOT NULL").select(*by, "gate", "part", F.col("fn").alias("name")).distinct()
    return checking.join(entries_through(routes, checking, [*by, "part"]), [*by, "part", "name"]).select(*by, "gate", "part", "line_id").distinct()


# ---- blocks ---------------------------------------------------------------------------------------------
def with_indent(lines: DataFrame) -> DataFrame:
    return lines.where(f"{_BARE} <> ''").withColumn("indent", F.expr(INDENT))


def until_dedent(rows: DataFrame, heads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, indent, next_line): for each head row the next of ``rows`` in its file with the same or a smaller
    indent. Rows meet each indent level of their file once, so there is no comparison of all lines with all."""
    levels = heads.select(*by, "path", F.col("indent").alias("level")).distinct()
    seen = rows.select(*by, "path", "line_no", "indent").join(levels, [*by, "path"]).where("indent <= level")
    nxt = F.lead("line_no").over(Window.partitionBy(*by, "path", "level").orderBy("line_no"))
    return heads.join(seen.withColumn("next_line", nxt).where("indent = level").select(*by, "path", "line_no", "next_line"),
                      [*by, "path", "line_no"], "left").select(*by, "path", "line_no", "indent", "next_line")


def scan_functions(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, name, start, end): definitions; each ends before the next one at the same or a smaller indent."""
    likely = f"({_holds('func', 'def', 'class', 'fn', 'interface', 'impl')} OR (contains(text, '(') AND contains(text, '{{')))"
    d = cut(with_indent(lines.select(*by, "path", "line_no", "text").where(f"{likely} AND text rlike {S.text(fx.DEFINITION_LINE)}")), "definitions")   # used several times below
    named = (r"coalesce(nullif(regexp_extract(text, '^\\s*func\\b\\s*(?:\\([^)]*\\)\\s*)?([A-Za-z_]\\w*)', 1), ''), "
             r"nullif(regexp_extract(text, '\\b(?:def|class|function\\*?|fn|interface|impl)\\s+([A-Za-z_$][\\w$]*)', 1), ''), "
             r"nullif(regexp_extract(text, '^\\s*(?:async\\s+)?([A-Za-z_$][\\w$]*)\\s*\\(', 1), ''))")
    last = lines.groupBy(*by, "path").agg(F.max("line_no").alias("_last"))
    ends = until_dedent(d, d, by).join(last, [*by, "path"])
    return d.withColumn("name", F.expr(named)).select(*by, "path", "line_no", "name").join(ends, [*by, "path", "line_no"]).selectExpr(
        *by, "path", "name", "cast(line_no AS BIGINT) AS start", "cast(coalesce(next_line - 1, _last) AS BIGINT) AS end")


def scan_docs(functions: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, start, doc): first sentences of a Python function's docstring, else of the comment block right above it.
    functions: (path, name, start, end)."""
    comment = lines.where(r"text rlike '^\\s*(//|#|/\\*|\\*|--)'").select(*by, "path", "line_no", "text")
    island = comment.withColumn("_g", F.col("line_no") - F.row_number().over(Window.partitionBy(*by, "path").orderBy("line_no")))
    block = island.groupBy(*by, "path", "_g").agg(
        (F.max("line_no") + 1).cast("bigint").alias("start"), F.expr("array_join(transform(array_sort(collect_list(struct(line_no, text))), r -> r.text), '\n')").alias("above"))
    opens = lines.where(r"""text rlike '^\\s*[rRuUbB]*("|\\x27)' AND endswith(path, '.py')""").selectExpr(*by, "path", "cast(line_no - 1 AS BIGINT) AS start")
    doc_fns = functions.join(opens, [*by, "path", "start"], "left_semi")
    body = (doc_fns.withColumn("_block", F.explode(F.expr("sequence(start div 256, `end` div 256)")))
            .join(lines.withColumn("_block", F.expr("line_no div 256")), [*by, "path", "_block"]).where("line_no > start AND line_no <= `end`")
            .groupBy(*by, "path", "start").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_no, text))), r -> r.text), '\n')").alias("body")))
    quote = r"""(?s)^\s*[rRuUbB]*(?:\"\"\"(.*?)\"\"\"|\x27\x27\x27(.*?)\x27\x27\x27|"([^"\n]*)"|\x27([^\x27\n]*)\x27)"""
    inside = "coalesce(" + ", ".join(f"nullif({_at('body', quote, g)}, '')" for g in (1, 2, 3, 4)) + ")"
    return (functions.select(*by, "path", "name", "start").join(block.select(*by, "path", "start", "above"), [*by, "path", "start"], "left")
            .join(body.selectExpr(*by, "path", "start", f"{inside} AS inside"), [*by, "path", "start"], "left")
            .selectExpr(*by, "path", "start", f"{S.doc_sentences('coalesce(inside, above)', 'name')} AS doc").where("doc IS NOT NULL"))


# fixed values: the word opening a block (group 1), its condition (group 2), and the kind of block
_OPENER = (r"^\s*(?:\}\s*)?(if|elif|elsif|else\s+if|else|for|while|switch|match|select|case|default|try|except|catch|rescue)\b"
           r"\s*(.*?)\s*[:{]?\s*$")
_BLOCK_KINDS = {"if": "if", "elif": "elif", "elsif": "elif", "else": "else", "for": "loop", "while": "loop", "switch": "switch", "match": "switch",
                "select": "switch", "case": "case", "default": "case", "try": "try", "except": "catch", "catch": "catch", "rescue": "catch"}


def blocks(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, indent, kind, cond, start, end, chain): indented blocks; ``chain`` is the line of the if an elif or else
    belongs to."""
    # a case label may stand as far left as its switch: it closes earlier cases but not the switch
    rows = with_indent(lines).withColumn("indent", F.expr(r"indent * 2 + CASE WHEN text rlike '^\\s*(case\\b|default\\b)' THEN 1 ELSE 0 END"))
    opened = _computed(rows.where(f"text rlike {S.text(_OPENER)}"),
                       rf"regexp_replace({_at('text', _OPENER, 1)}, 'else\\s+if', 'elif') AS word", f"{_at('text', _OPENER, 2)} AS c")
    heads = opened.selectExpr(*by, "path", "line_no", "indent", f"element_at({S.table(_BLOCK_KINDS)}, word) AS kind", f"{S.squash(S.unparen('c'))} AS cond")
    heads = cut(heads.unionByName(rows.where(f"{_MAY_ITERATE} AND text rlike {S.text(_ITERATED)} AND NOT text rlike {S.text(_OPENER)}").selectExpr(
        *by, "path", "line_no", "indent", "'loop' AS kind", "'' AS cond")), "heads")   # used several times below
    last = lines.groupBy(*by, "path").agg((F.max("line_no") + 1).alias("_stop"))
    ends = until_dedent(rows, heads, by).join(last, [*by, "path"]).selectExpr(*by, "path", "line_no", "line_no + 1 AS start", "coalesce(next_line, _stop) - 1 AS end")
    if_line = F.last(F.expr("CASE WHEN kind = 'if' THEN line_no END"), ignorenulls=True).over(Window.partitionBy(*by, "path", "indent").orderBy("line_no"))
    chained = heads.withColumn("chain", F.when(F.col("kind").isin("elif", "else"), if_line))
    return chained.join(ends, [*by, "path", "line_no"]).where("`end` >= start").select(
        *by, "path", "line_no", "indent", "kind", "cond", "start", "end", "chain")


def _holding(points: DataFrame, spans: DataFrame, by: Sequence[str], block: int = 64) -> DataFrame:
    """Each point (by, path, line_no, ...) with every span (by, path, start, end, ...) holding its line."""
    p = points.withColumn("_block", F.expr(f"line_no div {block}"))
    s = spans.withColumn("_block", F.explode(F.expr(f"sequence(start div {block}, `end` div {block})")))
    return p.join(s, [*by, "path", "_block"]).where("line_no BETWEEN start AND `end`").drop("_block")


# a call with a closure behind it: a bracket or brace that opens one, do, or an arrow
_CLOSURE = r"\b\s*(?:\([^()]*\))?\s*(?:\(\s*(?:async\s+)?(?:\([^()]*\)|\w*)\s*(?:=>|->)|\(\s*(?:move\s+)?\||\(\s*func(?:tion)?\b|\{|do\b)"
_ITERATED = rf"(?:^\s*|[.:])(?:{'|'.join(fx.ITERATOR_CALLS)}){_CLOSURE}"
_SCOPED = rf"(?:^\s*|[.:])(?:{'|'.join(fx.SCOPE_CALLS)}){_CLOSURE}"
_MAY_ITERATE = f"({_holds('each', text=_ANY_CASE)} OR {_holds('times', 'fold', 'repeat')})"   # of every name in ITERATOR_CALLS
_MACRO = rf"^\s*(?:\w+::)*(?:{'|'.join(fx.PANIC_MACROS)})!\s*[(\[{{]"


# ---- steps and calls --------------------------------------------------------------------------------------
def scan_steps(lines: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, path, line_no, kind, text, error, block_path): control steps, one per line, inside their function. block_path:
    the enclosing decisions, loops, switches and tries, outermost first, as ARRAY<STRUCT<head, branch>>."""
    stop = "|".join(fx.PANIC_CALLS)
    leave = "|".join(fx.EXIT_CALLS)
    kind = (r"CASE WHEN text rlike '^\\s*(?:\\}\\s*)?(?:else\\s+)?(?:if|elif|elsif|unless)\\b' THEN 'decision' WHEN text rlike '^\\s*(?:for|while)\\b' THEN 'loop' "
            r"WHEN text rlike '^\\s*(?:switch|match|select)\\b' THEN 'switch' WHEN text rlike '^\\s*try\\b' THEN 'try' "
            r"WHEN text rlike '^\\s*return\\b' THEN 'return' "
            f"WHEN text rlike {S.text(rf'^{chr(92)}s*(?:(?:raise|throw){chr(92)}b|(?:{stop}){chr(92)}(|(?:{chr(92)}w+{chr(92)}.)?(?:{leave}){chr(92)}()')} THEN 'throw' "
            f"WHEN contains(text, '!') AND text rlike {S.text(_MACRO)} AND {S.lang('path')} = 'rust' THEN 'throw' "
            f"WHEN {_MAY_ITERATE} AND text rlike {S.text(_ITERATED)} THEN 'loop' WHEN {_holds(*fx.SCOPE_CALLS)} AND text rlike {S.text(_SCOPED)} THEN NULL "
            r"WHEN text rlike '^\\s*(?:func|def|class|function|fn)\\b|^\\s*(?:public|private|protected|internal|static|override)\\b.*\\{\\s*$' THEN NULL WHEN contains(text, '(') AND text rlike '[A-Za-z_$][\\w$]*\\(' THEN 'call' END")
    rows = cut(lines.select(*by, "path", "line_no", "text", F.expr(kind).alias("kind")).where("kind IS NOT NULL"), "kinds")
    inside = enclosing(rows.withColumnRenamed("line_no", "line"), functions, [*by, "path"]).withColumnRenamed("line", "line_no")
    placed = cut(rows.join(inside, [*by, "path", "line_no"]), "placed")
    shown = S.clip(r"regexp_replace(text, '[;{:]\\s*$', '')", str(fx.MAX_CLIP))
    error = f"kind = 'throw' AND NOT endswith(trim(text), '(0)') OR (kind = 'return' AND {S.has_error('text', S.lang('path'))})"
    steps = placed.selectExpr(*by, "fn_id", "path", "line_no", "kind", f"{shown} AS text", f"coalesce({error}, false) AS error")
    around = _holding(placed.select(*by, "path", "line_no"), blocks(lines, by).selectExpr(
        *by, "path", "start", "end", "coalesce(chain, line_no) AS head", "CASE kind WHEN 'if' THEN 'then' WHEN 'elif' THEN 'else' ELSE kind END AS branch"), by)
    paths = around.groupBy(*by, "path", "line_no").agg(F.expr("transform(array_sort(collect_list(struct(start, head, branch))), r -> struct(r.head AS head, r.branch AS branch))").alias("block_path"))
    return steps.join(paths, [*by, "path", "line_no"], "left").withColumn(
        "block_path", F.expr("coalesce(block_path, cast(array() AS ARRAY<STRUCT<head: INT, branch: STRING>>))"))


_CALL = r"((?:[A-Za-z_$][\w$]*\s*(?:\??\.|::|->)\s*)*)([A-Za-z_$][\w$]*)\("


def line_calls(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, pos, callee, receiver, in_log): every call of each line in order, with the chain before its name, and whether it
    stands among the arguments of a logging call."""
    bare = lines.where(r"contains(text, '(') AND text rlike '[\\w$]\\('").selectExpr(
        *by, "path", "line_no", r"""regexp_replace(regexp_replace(text, '"(?:\\\\.|[^"\\\\])*"|\x27(?:\\\\.|[^\x27\\\\])*\x27', '""'), '^\\s*(?:func|def|function|fn)\\b.*$', '') AS text""")
    found = lambda group: f"regexp_extract_all(text, {S.text('.*?' + _CALL)}, {group})"
    split = bare.selectExpr(*by, "path", "line_no", f"{found(0)} AS segs", f"{found(1)} AS chains", f"{found(2)} AS names").withColumn(
        "logs", F.expr(f"transform(chains, c -> arrays_overlap({S.words('c')}, {S.texts(fx.NOISE_WORDS)}))"))
    # of the brackets between a logging call and a later one, the logging call's own is open while the sum never falls below none
    between = "regexp_extract_all(array_join(slice(segs, a + 2, pos - a), ''), '[()]', 0)"
    lowest = (f"aggregate({between}, struct(0 AS b, 0 AS low), (s, p) -> CASE WHEN p = '(' THEN struct(s.b + 1 AS b, s.low AS low) "
              "ELSE struct(s.b - 1 AS b, least(s.low, s.b - 1) AS low) END, s -> s.low)")
    calls = split.select("*", F.posexplode("names").alias("pos", "callee"))
    return calls.selectExpr(*by, "path", "line_no", "pos", "callee", "get(chains, pos) AS receiver",
                            f"pos > 0 AND exists(sequence(0, greatest(pos - 1, 0)), a -> get(logs, a) AND {lowest} >= 0) AS in_log").where(
        f"NOT array_contains({S.texts(_NOT_CALLS)}, callee)")


def scan_effects(lines: DataFrame, functions: DataFrame, known: DataFrame, targets: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, path, line_no, pos, kind, callee, receiver, target): the calls inside functions that are steps: effects on outside systems, and
    calls of known functions unless they only feed a logging call. Every call counts, also in conditions, arguments and returned values.

    known: (by, name); targets: (by, path, line, target) of references to outside systems: the first call of such a line has that effect.
    """
    calls = line_calls(lines, by)
    inside = enclosing(calls.withColumnRenamed("line_no", "line"), functions, [*by, "path"]).withColumnRenamed("line", "line_no")
    placed = calls.join(inside, [*by, "path", "line_no"]).join(
        known.select(*by, F.col("name").alias("callee")).distinct().withColumn("_known", F.lit(True)), [*by, "callee"], "left")
    marked = placed.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
    if targets is None:
        marked = marked.withColumn("target", F.lit(None).cast("string"))
    else:
        first = marked.groupBy(*by, "path", "line_no").agg(F.min("pos").alias("pos"))
        named = targets.groupBy(*by, "path", F.col("line").alias("line_no")).agg(F.min("target").alias("target"))
        marked = marked.join(first.join(named, [*by, "path", "line_no"]), [*by, "path", "line_no", "pos"], "left")
    return classify_calls(marked).where("NOT (kind = 'call' AND in_log)").select(
        *by, "fn_id", "path", "line_no", "pos", "kind", "callee", "receiver", "target")


def classify_calls(calls: DataFrame) -> DataFrame:
    """Calls (callee, receiver, known, target) with ``kind``: effect when a reference names it or its receiver or name tells of an
    outside system, call when it is a known function; adapters, logging and anything else are dropped."""
    plain = S.bind(r"""regexp_extract_all(regexp_replace(receiver, '"[^"]*"|\\x27[^\\x27]*\\x27', ''), '[A-Za-z_]\\w*', 0)""", "ns",
                   f"struct({S.words('array_join(ns, ' + chr(39) + ' ' + chr(39) + ')')} AS parts, transform(ns, n -> lower(trim(BOTH '_' FROM n))) AS wholes)")
    df = calls.withColumn("_r", F.expr(plain))
    has = lambda a, ws: f"arrays_overlap({a}, {S.texts(ws)})"
    outside = f"({has('_r.parts', fx.EFFECT_PART_WORDS)} OR {has('_r.wholes', fx.EFFECT_WHOLE_WORDS)})"
    kind = (f"CASE WHEN target IS NOT NULL THEN 'effect' WHEN callee IN ({', '.join(S.text(a) for a in fx.ADAPTER_CALLS)}) THEN NULL "
            f"WHEN ({outside} AND NOT callee rlike '^[Nn]ew') OR array_contains({S.texts(fx.EFFECT_CALLEES)}, callee) THEN 'effect' "
            f"WHEN known AND NOT array_contains({S.texts(fx.PROTOCOL_NAMES)}, callee) AND NOT {has('_r.parts', fx.NOISE_WORDS)} THEN 'call' END")
    return df.withColumn("kind", F.expr(kind)).where("kind IS NOT NULL").drop("_r")


def scan_call_sites(lines: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, path, line_no, pos, name, recv): calls inside functions with the receiver's last word; protocol methods and logging
    are left out."""
    call = r"((?:[A-Za-z_$][\w$]*\s*(?:\??\.|::|->)\s*)*)([A-Za-z_$][\w$]*)\("
    bare = lines.where(r"contains(text, '(') AND text rlike '[\\w$]\\('").selectExpr(
        *by, "path", "line_no", r"""regexp_replace(regexp_replace(text, '"(?:\\\\.|[^"\\\\])*"', '""'), '^\\s*(?:func|def|function|fn)\\b.*$', '') AS text""")
    rows = _computed(bare.select(*by, "path", "line_no", F.posexplode(F.expr(f"regexp_extract_all(text, {S.text(call)}, 0)")).alias("pos", "m")),
                     f"{_at('m', call, 2)} AS name", f"{_at('m', call, 1)} AS chain").drop("m")
    recv = r"coalesce(get(reverse(regexp_extract_all(chain, '\\w+', 0)), 0), '')"
    kept = cut(rows.where(f"NOT array_contains({S.texts([*_NOT_CALLS, *fx.PROTOCOL_NAMES])}, name) AND NOT arrays_overlap({S.words('chain')}, {S.texts(fx.NOISE_WORDS)})"), "calls")
    inside = enclosing(kept.withColumnRenamed("line_no", "line"), functions, [*by, "path"]).withColumnRenamed("line", "line_no")
    return kept.join(inside, [*by, "path", "line_no"]).selectExpr(*by, "fn_id", "path", "line_no", "pos", "name", f"{recv} AS recv")


def call_guards(sites: DataFrame, lines: DataFrame, functions: DataFrame, by: Sequence[str] = (), connected: str = "true") -> DataFrame:
    """sites (fn_id, path, line_no, name, ...) with ``when`` (the two innermost conditions around each call, outer first, at most 60
    characters) and ``loop`` (the innermost loop). Conditions come from enclosing branches, earlier arms of the same if,
    cases, error handlers, and guard clauses before the call; one shared by all calls of a function is dropped. With ``connected`` (SQL over
    sites) only such calls are given, and only they must share a condition for it to be dropped."""
    sites = cut(sites.where(connected), "sites")   # used several times below, as the blocks are
    b = cut(blocks(lines, by), "blocks")   # used several times below
    spans = b.where("kind IN ('if', 'elif')").selectExpr(*by, "path", "start", "end", "cond AS guard", "line_no * 1000L AS rank")
    spans = spans.unionByName(b.where("kind = 'catch'").selectExpr(*by, "path", "start", "end", "'on error' AS guard", "line_no * 1000L AS rank"))
    arms = b.where("kind IN ('if', 'elif')").selectExpr(*by, "path", "coalesce(chain, line_no) AS chain", "line_no AS arm", "cond")
    later = b.where("kind IN ('elif', 'else')").selectExpr(*by, "path", "chain", "line_no", "start", "end").join(arms, [*by, "path", "chain"]).where("arm < line_no")
    spans = spans.unionByName(later.selectExpr(*by, "path", "start", "end", f"{S.negate('cond')} AS guard", "line_no * 1000L - line_no + arm - 1 AS rank"))
    switch = b.where("kind = 'switch'").selectExpr(*by, "path", "line_no AS s_line", "start", "end", "cond AS subject")
    cases = b.where("kind = 'case'").selectExpr(*by, "path", "line_no", "start AS c_start", "end AS c_end", "cond AS label")
    cased = _holding(cases, switch, by).groupBy(*by, "path", "line_no", "c_start", "c_end", "label").agg(F.max_by("subject", "s_line").alias("subject"))
    spans = spans.unionByName(cased.selectExpr(*by, "path", "c_start AS start", "c_end AS end", "CASE WHEN subject <> '' THEN concat(subject, ': ', nullif(label, '')) "
                                               "ELSE coalesce(nullif(label, ''), 'default') END AS guard", "line_no * 1000L AS rank"))
    # guard clauses: an if without else whose last line leaves; it holds from its end to the end of the block around it
    tail = lines.selectExpr(*by, "path", "line_no AS end", r"text rlike '^\\s*(return|raise|throw|continue|break)\\b' AS leaves")
    braced = b.where("kind = 'if'").join(later.selectExpr(*by, "path", "chain AS line_no").distinct(), [*by, "path", "line_no"], "left_anti")
    guards = braced.join(tail.where("leaves"), [*by, "path", "end"]).where(f"NOT cond rlike {S.text(fx.ERROR_CONDITION)}").selectExpr(
        *by, "path", "line_no", "end AS g_end", "cond")
    outer = b.selectExpr(*by, "path", "start", "end").unionByName(functions.selectExpr(*by, "path", "start + 1 AS start", "end"))
    around = _holding(guards, outer, by).groupBy(*by, "path", "line_no", "g_end", "cond").agg(F.max_by("end", "start").alias("o_end"))
    spans = spans.unionByName(around.where("o_end > g_end").selectExpr(*by, "path", "g_end + 1 AS start", "o_end AS end", f"{S.negate('cond')} AS guard", "line_no * 1000L AS rank"))
    call_lines = sites.select(*by, "fn_id", "path", "line_no").distinct()
    own = functions.select(*by, F.col("fn_id"), F.col("start").alias("f_start"))
    found = cut(_holding(call_lines, spans, by).join(own, [*by, "fn_id"]).where("start > f_start").select(*by, "fn_id", "path", "line_no", "guard", "rank").distinct(), "found")
    total = sites.groupBy(*by, "fn_id").agg(F.count("*").alias("_sites"))
    per = sites.groupBy(*by, "fn_id", "path", "line_no").agg(F.count("*").alias("_w"))
    shared = (found.select(*by, "fn_id", "path", "line_no", "guard").distinct().join(per, [*by, "fn_id", "path", "line_no"])
              .groupBy(*by, "fn_id", "guard").agg(F.sum("_w").alias("_n")).join(total, [*by, "fn_id"]).where("_n = _sites AND _sites > 1").select(*by, "fn_id", "guard"))
    kept = found.join(shared, [*by, "fn_id", "guard"], "left_anti")
    two = kept.groupBy(*by, "fn_id", "path", "line_no").agg(F.expr("slice(sort_array(collect_list(struct(rank, guard)), false), 1, 2)").alias("g"))
    when = two.selectExpr(*by, "fn_id", "path", "line_no", S.shorten("array_join(transform(reverse(g), x -> x.guard), ' · ')") + " AS `when`")
    text = lines.where(f"({_holds('for', 'while')} OR {_MAY_ITERATE}) AND {_BARE} <> ''").selectExpr(*by, "path", "line_no", "text AS head")   # lines that can open a loop
    loops = b.where("kind = 'loop'").join(text, [*by, "path", "line_no"]).selectExpr(
        *by, "path", "line_no AS l_line", "start", "end", S.shorten(r"regexp_replace(head, '[\\s{:(]+$', '')") + " AS loop")
    inner = _holding(call_lines, loops, by).groupBy(*by, "fn_id", "path", "line_no").agg(F.max_by("loop", "l_line").alias("loop"))
    key = [*by, "fn_id", "path", "line_no"]
    return sites.join(when, key, "left").join(inner, key, "left")


# ---- states ---------------------------------------------------------------------------------------------
_STATE_VALUE = r"""("[^"]+"|\x27[^\x27]+\x27|:\w+|[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*)"""
_SET = rf"^\s*((?:[A-Za-z_]\w*(?:\[[^\]]*\])?(?:\.|->|::))+)(\w*(?i:state|status|phase|stage))\s*=(?!=)\s*{_STATE_VALUE}\s*[;,]?\s*$"
_KEYED = rf"(?<![\w.])(\w*(?i:state|status|phase|stage)):\s*{_STATE_VALUE}\s*[,}}]"


def scan_state_assignments(lines: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, line_no, fn_id, field, receiver, family, value, from_literal): constants assigned to fields named state, status, phase or
    stage. Test files, lookups, tables outside functions and non-constant values are left out."""
    code = lines.where(f"{_holds('stat', 'phase', 'stage', text=_ANY_CASE)} AND text rlike '(?i)(state|status|phase|stage)' AND NOT path rlike {S.text(fx.STATE_TEST_FILE)}")
    a = code.where(f"text rlike {S.text(_SET)}").selectExpr(
        *by, "path", "line_no", f"{_at('text', _SET, 2)} AS field", f"get(reverse(regexp_extract_all({_at('text', _SET, 1)}, '[A-Za-z_]\\\\w*(?=\\\\W*(?:\\\\[|\\\\.|->|::|$))', 0)), 0) AS receiver",
        f"{_at('text', _SET, 3)} AS v", "cast(NULL AS STRING) AS prev")
    before = rf"(?i:prev|previous|old|from)\w*:\s*\w*\{{[^}}]*?{_KEYED}"
    k = _finds(code.where("endswith(path, '.go')"), _KEYED, by).where(r"NOT text rlike '(?i)\\b(?:get|list|find|count|select|query|search|filter|fetch|load|read)\\w*[({]'")
    k = k.selectExpr(*by, "path", "line_no", f"{_at('m', _KEYED, 1)} AS field", "cast(NULL AS STRING) AS receiver", f"{_at('m', _KEYED, 2)} AS v", f"nullif({_at('text', before, 2)}, '') AS prev")
    rows = cut(a.unionByName(k.where("prev IS NULL OR v <> prev")), "assigned")
    inside = enclosing(rows.withColumnRenamed("line_no", "line"), functions, [*by, "path"]).withColumnRenamed("line", "line_no")
    return rows.join(inside, [*by, "path", "line_no"]).selectExpr(
        *by, "path", "line_no", "fn_id", "field", "receiver", f"{S.state_family('v')} AS family", f"{S.state_value('v', 'field')} AS value",
        f"{S.state_value('prev', 'field')} AS from_literal").where("value IS NOT NULL AND length(value) <= 60")


def infer_from(assignments: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """assignments with ``from``: the constant the nearest enclosing if or case compares the same field with, else the literal of
    the previous state next to it; null when unknown or equal to the new value."""
    b = cut(blocks(lines, by), "blocks")   # used several times below
    assignments = once(assignments, "assignments")
    test = rf"(?:\.|->|::|^|\s)(\w+)\s*(?:===?|\bis\b)\s*{_STATE_VALUE}"
    ifs = b.where(r"kind IN ('if', 'elif') AND NOT cond rlike '\\|\\||\\bor\\b'").where(f"size(regexp_extract_all(cond, {S.text(test)}, 0)) = 1").selectExpr(
        *by, "path", "line_no AS g_line", "start", "end", f"{_at('cond', test, 1)} AS field", f"{_at('cond', test, 2)} AS v")
    switch = b.where("kind = 'switch'").selectExpr(*by, "path", "start", "end", r"element_at(split(cond, '\\.|->|::'), -1) AS field")
    cases = b.where("kind = 'case'").selectExpr(*by, "path", "line_no", "line_no AS g_line", "start AS c_start", "end AS c_end", "cond AS v")
    labels = _holding(cases, switch, by).selectExpr(*by, "path", "g_line", "c_start AS start", "c_end AS end", "field", "v")
    guards = ifs.unionByName(labels.where(f"v rlike {S.text('^' + _STATE_VALUE + '$')}")).selectExpr(
        *by, "path", "start", "end", "field", f"{S.state_value('v', 'field')} AS value", "g_line").where("value IS NOT NULL")
    near = enclosing(assignments.withColumnRenamed("line_no", "line"), guards.withColumnRenamed("value", "guard"), [*by, "path", "field"], take=("guard",), order=("g_line",))
    return assignments.join(near.withColumnRenamed("line", "line_no"), [*by, "path", "field", "line_no"], "left").withColumn(
        "from", F.expr("nullif(coalesce(guard, from_literal), value)")).drop("guard", "from_literal")


def state_machines(rows: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(machines, transitions) from rows (path, line_no, fn_id, field, receiver, family, value, from): per field and constant family
    with at least two transitions and three states. machines: (field, family, subject, id, states, transitions)."""
    key = [*by, "field", "family"]
    distinct = rows.select(*key, "path", "line_no", "fn_id", "receiver", "from", F.col("value").alias("to")).distinct()
    first = cut(first_per(distinct.withColumn("_f", F.coalesce("from", F.lit("\0"))), [*key, "path", "fn_id", "_f", "to"],
                          ["line_no", "receiver"]).drop("_f"), "transitions")
    # every state with the place it first shows at
    states = first.select(*key, F.explode(F.expr("filter(array(struct(`from` AS s, 0 AS o), struct(`to` AS s, 1 AS o)), x -> x.s IS NOT NULL)")).alias("x"), "path", "line_no")
    seen = states.groupBy(*key, "x.s").agg(F.min(F.struct("path", "line_no", "x.o")).alias("at"))
    n = first.groupBy(*key).agg(F.count("*").alias("transitions"))
    m = seen.groupBy(*key).agg(F.count("*").alias("states"), F.max_by("s", "at").alias("last_state")).join(n, key).where("transitions >= 2 AND states >= 3")
    who = first.where("length(receiver) > 1 AND receiver NOT IN ('self', 'this', 'cls')").groupBy(*key, "receiver").agg(
        F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("at"))
    subject = who.groupBy(*key).agg(F.expr("min_by(receiver, struct(-n, at))").alias("subject"))
    named = m.join(subject, key, "left").withColumn("_id", F.expr("CASE WHEN subject IS NULL THEN field ELSE concat(subject, '.', field) END"))
    same = named.groupBy(*by, "_id").agg(F.count("*").alias("_same"))
    machines = named.join(same, [*by, "_id"]).selectExpr(*key, "subject", "CASE WHEN _same > 1 THEN concat(_id, '#', last_state) ELSE _id END AS id", "states", "transitions")
    return machines, first.join(machines.select(*key, "id"), key)
