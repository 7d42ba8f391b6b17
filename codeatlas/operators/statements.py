"""Statements over several lines: a scanner of strings, comments and brackets that works on all lines at once.

What a line does to a scanner is a function of the mode it starts in (code, two kinds of triple quotes, block comment, raw string), written as five
letters: where each mode leads. Such functions compose, so they are folded inside blocks of lines and then over the blocks of a file; no task
holds a file. Brackets outside strings and comments then have a depth by a running sum, and the innermost bracket open at a line is the last one of
its depth before it. A line continues a statement if a string, a comment or a round or square bracket is open where it starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .ordered import asof, carry_forward, running_sum

MODES = "cdsbr"   # code, """, ''', /* */, `
ENDS = {"d": '"""', "s": "'''", "b": "*/", "r": "`"}
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'"
# What is no code is dropped, but for the beginning of what does not end on the line. Lines of hash languages (Python, Ruby) and of the others.
HASH = rf"""\"\"\".*?\"\"\"|'''.*?'''|(\"\"\").*$|(''').*$|{_DOUBLE}|{_SINGLE}|#.*$"""
SLASH = rf"""{_DOUBLE}|{_SINGLE}|`[^`]*`|/\*.*?\*/|//.*$|(`).*$|(/\*).*$"""
HASH_LANGUAGES = ("python", "ruby")


def _code(text: str) -> str:
    """SQL: the code of a text that starts in code, with the mark of what it leaves open at its end."""
    drop = lambda p: f"regexp_replace({text}, {S.text(p)}, '$1$2')"
    return f"CASE WHEN _hash THEN {drop(HASH)} ELSE {drop(SLASH)} END"


def _mode(code: str) -> str:
    """SQL: the mode in which code ends."""
    return (f"CASE WHEN _hash AND endswith({code}, {S.text(ENDS['d'])}) THEN 'd' WHEN _hash AND endswith({code}, {S.text(ENDS['s'])}) THEN 's' "
            f"WHEN NOT _hash AND endswith({code}, '/*') THEN 'b' WHEN NOT _hash AND endswith({code}, '`') THEN 'r' ELSE 'c' END")


def _after(mode: str) -> str:
    """SQL: what follows the end of a string or comment on this line; null if it goes on."""
    end = S.text(ENDS[mode])
    return f"CASE WHEN instr(text, {end}) > 0 THEN substring(text, instr(text, {end}) + {len(ENDS[mode])}) END"


def start_modes(lines: DataFrame, by: Sequence[str] = (), block: int = 256) -> DataFrame:
    """lines (by, path, line_no, text) with ``mode``, the mode each line starts in."""
    key = [*by, "path"]
    marked = lines.withColumn("_hash", F.expr(f"coalesce({S.lang('path')}, '') IN ({', '.join(S.text(x) for x in HASH_LANGUAGES)})"))
    able = " OR ".join(f"contains(text, {S.text(t)})" for t in (*ENDS.values(), "/*"))
    ends = lambda text: S.bind(_code(text), "rest", _mode("rest"))
    leads = [ends("text")] + [f"CASE WHEN contains(text, {S.text(ENDS[m])}) THEN {ends(_after(m))} ELSE '{m}' END" for m in MODES[1:]]
    events = marked.where(able).select(*key, "line_no", F.expr(f"line_no div {block}").alias("_block"), F.expr(f"concat({', '.join(leads)})").alias("f"))
    fold = lambda xs, start: f"aggregate({xs}, {start}, (m, x) -> translate(m, '{MODES}', x.f))"
    blocks = events.groupBy(*key, "_block").agg(F.array_sort(F.collect_list(F.struct("line_no", "f"))).alias("xs")).withColumn("f", F.expr(fold("xs", f"'{MODES}'")))
    files = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_block", "f"))).alias("bs"))
    starts = files.select(*key, F.posexplode("bs").alias("i", "b"), "bs").selectExpr(*key, "b._block AS _block", f"{fold('slice(bs, 1, i)', chr(39) + 'c' + chr(39))} AS m")
    inside = blocks.join(starts, [*key, "_block"]).select(*key, "m", "xs", F.posexplode("xs").alias("i", "x"))
    marks = inside.selectExpr(*key, "x.line_no + 1 AS line_no", f"{fold('slice(xs, 1, i + 1)', 'm')} AS mode")
    found = asof(lines.select(*key, "line_no"), marks, key, "line_no", "mode")
    return marked.join(found, [*key, "line_no"], "left").withColumn("mode", F.coalesce("mode", F.lit("c")))


def open_brackets(scanned: DataFrame, by: Sequence[str] = (), block: int = 256) -> DataFrame:
    """(by, path, line_no, bracket): for lines inside brackets the innermost one open at their start. scanned: the rows of ``start_modes``."""
    key = [*by, "path"]
    rest = "CASE mode " + " ".join(f"WHEN '{m}' THEN {_after(m)}" for m in MODES[1:]) + " ELSE text END"
    tokens = scanned.withColumn("_rest", F.expr(rest)).select(*key, "line_no", F.posexplode(F.expr(f"regexp_extract_all({_code('_rest')}, '[(){{}}\\\\[\\\\]]', 0)")).alias("i", "bracket"))
    opening = "bracket IN ('(', '[', '{')"
    stepped = tokens.withColumn("_d", F.expr(f"CASE WHEN {opening} THEN 1 ELSE -1 END")).withColumn("_block", F.expr(f"line_no div {block}"))
    depth = running_sum(stepped, key, "_block", ["line_no", "i"], "_d", "depth").withColumn("level", F.expr(f"CASE WHEN {opening} THEN depth ELSE depth + 1 END"))
    last = lambda value, *more: depth.groupBy(*key, *more, "line_no").agg(F.max_by(value, "i").alias(value)).withColumn("line_no", F.col("line_no") + 1)
    at = asof(scanned.select(*key, "line_no"), last("depth"), key, "line_no", "depth").withColumn("level", F.coalesce("depth", F.lit(0).cast("bigint"))).drop("depth")
    # of all brackets of that depth before the line the last one tells: an opening one is still open
    found = asof(at, last("bracket", "level"), [*key, "level"], "line_no", "bracket")
    return found.where(opening).select(*key, "line_no", "bracket")


def statements(lines: DataFrame, by: Sequence[str] = (), block: int = 256) -> DataFrame:
    """(by, path, line_no, last_line, text): lines (by, path, line_no, text) with those that continue a statement joined to its first line by
    single spaces. Braces open blocks, so what stands in them is statements of its own, also inside the arguments of a call."""
    key = [*by, "path"]
    scanned = cut(start_modes(lines, by, block), "scanned")   # read three times
    inside = open_brackets(scanned, by, block)
    joined = scanned.join(inside, [*key, "line_no"], "left").withColumn("_first", F.expr("CASE WHEN mode = 'c' AND coalesce(bracket, '{') = '{' THEN line_no END"))
    placed = carry_forward(joined.withColumn("_block", F.expr(f"line_no div {block}")), key, "_block", ["line_no"], "_first", "_start")
    placed = placed.withColumn("_start", F.coalesce("_start", "line_no")).select(*key, "line_no", "_start", "text")
    piece = F.expr(r"struct(line_no, regexp_replace(text, CASE WHEN line_no = _start THEN '\\s+\\z' ELSE '^\\s+|\\s+\\z' END, '') AS t)")
    out = placed.groupBy(*key, "_start").agg(F.max("line_no").alias("last_line"), F.array_sort(F.collect_list(piece)).alias("_xs")).select(
        *key, F.col("_start").alias("line_no"), "last_line", F.expr("array_join(filter(transform(_xs, x -> x.t), t -> t <> ''), ' ')").alias("text"))
    return cut(out, "statements")   # scans read their lines several times
