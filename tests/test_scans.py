"""Scans read the lines once for each kind of fact, not once for each table made from it."""

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import scan
from codeatlas.session import cut

PY = ['def load(cfg):', '    mode = os.getenv("MODE", "fast")', '    if mode == "slow":', '        db.save(cfg)', '    for item in cfg:', '        if item.status == "queued":',
      '            item.status = "running"', '    return mode']


def sources(spark):
    lines = cut(spark.createDataFrame([(f"svc/{f}.py", i + 1, t) for f in "ab" for i, t in enumerate(PY)], "path string, line_no int, text string"), "source-lines")
    functions = cut(scan.scan_functions(lines).withColumn("fn_id", F.concat_ws(":", "path", "start")), "functions")
    return lines, functions, cut(spark.createDataFrame([("svc", "svc")], "id string, path string"), "parts")


def reads_lines(df, lines):
    return any("source-lines" in f for f in df.inputFiles())


def test_gates_do_not_scan_the_lines_again(spark):
    lines, functions, parts = sources(spark)
    assert reads_lines(lines, lines)
    gates, rows = scan.gates(lines, functions, parts)
    assert not reads_lines(gates, lines) and not reads_lines(rows, lines)
    assert {tuple(r) for r in gates.collect()} == {("env:MODE", 2, 2, '"fast"')}
    assert {(r.what, r.ref, r.part, r.fn) for r in rows.collect()} == {
        (w, f"svc/{f}.py:{n}", "svc", "load") for f in "ab" for w, n in (("read", 2), ("check", 3))}


def test_states_and_calls_do_not_scan_the_lines_again(spark):
    lines, functions, _ = sources(spark)
    states = scan.infer_from(scan.scan_state_assignments(lines, functions), lines)
    assert not reads_lines(states, lines)
    assert [(r["from"], r["value"]) for r in states.collect()] == [("queued", "running")] * 2
    sites = scan.scan_call_sites(lines, functions)
    assert not reads_lines(sites, lines)
    guarded = scan.call_guards(sites, lines, functions).where("path = 'svc/a.py'").select("line_no", "name", "when", "loop").collect()
    assert {tuple(r) for r in guarded} == {(2, "getenv", None, None), (4, "save", 'mode == "slow"', None)}


@pytest.mark.parametrize("text", ["", "  ", "x", "\t\tx y", " \x0b\x0c\r\n z\t", "\xa0 q", "Bf0x", "  \tf(", None])
def test_indent_is_white_space_of_patterns(spark, text):
    row = spark.createDataFrame([(text,)], "text string")
    old = row.where(r"text rlike '\\S'").selectExpr("length(replace(regexp_extract(text, '^\\\\s*', 0), '\t', '    ')) AS indent").collect()
    assert scan.with_indent(row).select("indent").collect() == old
