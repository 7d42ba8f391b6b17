"""Statements over several lines against a scanner that reads a file letter by letter."""

import random
import re

import pytest

from codeatlas.operators import scan, statements

HASHED = re.compile(statements.HASH)
SLASHED = re.compile(statements.SLASH)


def slow(path, lines):
    """Joined lines: modes line by line, brackets on a stack."""
    hashed = path.endswith((".py", ".rb"))
    mode, stack, out = "c", [], []
    for n, text in enumerate(lines, 1):
        goes_on = mode != "c" or (stack and stack[-1] in "([")
        if goes_on and out:
            out[-1][1] = n
            out[-1][2].append(text.strip())
        else:
            out.append([n, n, [text.rstrip()]])
        rest = text
        if mode != "c":
            end = statements.ENDS[mode]
            if end not in rest:
                continue
            rest = rest[rest.index(end) + len(end):]
            mode = "c"
        code = (HASHED if hashed else SLASHED).sub(lambda m: m[1] or m[2] or "", rest)
        for mark, to in (('"""', "d"), ("'''", "s")) if hashed else (("/*", "b"), ("`", "r")):
            if code.endswith(mark):
                mode = to
        for c in code:
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and stack:
                stack.pop()
    return {(path, n, last, " ".join(t for t in texts if t)) for n, last, texts in out}


PIECES = ['"""', "'''", '"a ( b"', "'('", "# x (", "// x {", "/*", "*/", "`", "(", ")", "[", "]", "{", "}", "foo", "bar(1, 2)", " ", "x = ", "\\", '"', "=> {"]


@pytest.mark.parametrize("block", [256, 3])
def test_statements_equal_a_scanner(spark, block):
    rng = random.Random(block)
    files = {f"d/f{i}.{rng.choice(['py', 'js', 'go', 'rb', 'rs', 'txt'])}": ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 25))]
             for i in range(250)}
    rows = [(p, n, t) for p, ls in files.items() for n, t in enumerate(ls, 1)]
    got = [tuple(r) for r in statements.statements(spark.createDataFrame(rows, "path string, line_no int, text string"), block=block).select("path", "line_no", "last_line", "text").collect()]
    want = set().union(*(slow(p, ls) for p, ls in files.items()))
    assert set(got) == want and len(got) == len(want)


def test_steps_of_statements_over_several_lines(spark):
    code = {"a.py": ['def f(x):', '    if (x.a', '            and x.b):', '        return client.send(', '            x,', '            [1,', '             2])', '    """if y: (', '    text"""', '    return x'],
            "b.js": ["function g(xs) {", "  run(xs, (x) => {", "    if (x) {", "      db.save(", "        x)", "    }", "  })", "  /* if (", "  */ return xs", "}"]}
    lines = statements.statements(spark.createDataFrame([(p, n, t) for p, ls in code.items() for n, t in enumerate(ls, 1)], "path string, line_no int, text string"))
    steps = scan.scan_steps(lines, scan.scan_functions(lines).selectExpr("*", "path AS fn_id")).collect()
    assert {(r.path, r.line_no, r.kind, r.text) for r in steps} == {
        ("a.py", 2, "decision", "if (x.a and x.b)"), ("a.py", 4, "return", "return client.send( x, [1, 2])"), ("a.py", 10, "return", "return x"),
        ("b.js", 2, "call", "run(xs, (x) =>"), ("b.js", 3, "decision", "if (x)"), ("b.js", 4, "call", "db.save( x)")}
    assert statements.statements(lines.where("false")).count() == 0
