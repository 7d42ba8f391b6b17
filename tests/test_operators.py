"""Operators against brute force on small data, with cycles, ties and hot keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.operators import change, graph, joins, ordered, rank, rollup, sets
from codeatlas.sources import files, records


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_calls(seed, n=14, m=30):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


def reach_of(calls, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in calls:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_carry_forward_equals_one_window(spark):
    rows = [(k, i, i // 7, None if i % 3 else i) for k in ("hot", "x") for i in range(60 if k == "hot" else 5)]
    df = frame(spark, rows, "k string, i int, b int, v int")
    for current in (True, False):
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        want = df.select("k", "i", F.last("v", True).over(w).alias("o"))
        got = ordered.carry_forward(df, ["k"], "b", ["i"], "v", "o", current=current).select("k", "i", "o")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ranks_by_ranges_equal_one_window(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), r.choice([None, *range(40)]), i) for i in range(3000)]
    df = frame(spark, rows, "k string, v int, i int")
    for keys in (["k"], []):
        w = Window.partitionBy(*keys or [F.lit(1)]).orderBy(F.col("v").desc(), "i")
        want = df.withColumn("rank", F.row_number().over(w))
        got = ordered.ranked(df, keys, [F.col("v").desc(), "i"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_whole_table_is_ranked_by_many_tasks(spark):
    n = 2_000_000
    got = ordered.ranked(spark.range(n).selectExpr("(id * 7919) % 2000003 AS v"), [], ["v"])
    per_range = got.groupBy(F.expr("rank div 1000 AS thousand")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    checked = per_range.orderBy("thousand").collect()
    assert all(a.hi < b.lo for a, b in zip(checked, checked[1:])) and sum(c.n for c in checked) == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and got.rdd.getNumPartitions() > 1
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("_range" in line for line in windows)   # no window without a range


def test_hot_keys_are_dealt_out(spark):
    """One key holds nine tenths of both sides: every meeting comes once, and no task gets far more of them than the others."""
    left = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 'hot' ELSE concat('k', id) END AS k", "id AS a").union(spark.sql("SELECT NULL, -1L"))
    right = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 'hot' ELSE concat('k', id) END AS k", "id AS b").union(spark.sql("SELECT NULL, -1L"))
    want = {(x.k, x.a, x.b) for x in left.join(right, "k").collect()}
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = ordered.spread_join(left, right, ["k"], pairs=1 << 12)
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(rows) == len(want) and {(x.k, x.a, x.b) for x in rows} == want
    sizes = sorted(sum(x.task == t for x in rows) for t in range(8))
    assert sizes[-1] <= 4 * sizes[4]


def test_number_copies_is_the_rank(spark):
    df = frame(spark, [("hot", f"p{i:03d}" * 20) for i in range(50)] + [("x", "a")], "sha string, path string")
    got = {(r.sha, r.path): r.k for r in sets.number_copies(df, ["sha"], "path").collect()}
    assert [got["hot", f"p{i:03d}" * 20] for i in range(50)] == list(range(1, 51)) and got["x", "a"] == 1


@pytest.mark.parametrize("seed", [1])
def test_reach_and_levels_with_cycles(spark, seed):
    calls = random_calls(seed)
    e = frame(spark, calls, "src long, dst long")
    got = {(r.src, r.node) for r in graph.reach(e).collect()}
    nodes = {x for c in calls for x in c}
    assert got == {(a, b) for a in nodes for b in reach_of(calls, a)}
    kept = [(a, b) for a, b in calls if a not in reach_of(calls, b)]
    def level(x):
        return max((level(a) + 1 for a, b in kept if b == x), default=0)
    assert {(r.node, r.level) for r in graph.dag_levels(e).collect()} == {(x, level(x)) for x in nodes}


@pytest.mark.parametrize("seed", [2])
def test_flow_order_equals_a_depth_first_walk(spark, seed):
    calls = [(0 if i % 2 else 1, a, b, i) for i, (a, b) in enumerate(random_calls(seed, 12, 40))]
    fns = frame(spark, [(r, i, f"f{i}", "a.py", i % 4, "function") for r in (0, 1) for i in range(12)], "repo int, fn_id long, name string, file string, start long, kind string")
    c = frame(spark, calls, "repo int, src long, dst long, pos long")
    roots = graph.flow_roots(fns, c, ["repo"])
    rank = {(r.repo, r.fn_id): r["rank"] for r in roots.collect()}
    want = []
    for repo in (0, 1):
        seen = []

        def visit(f, depth, via):
            if f not in seen:
                seen.append(f)
                want.append((repo, len(seen) - 1, f, depth, via))
                for _, b in sorted({(min(p for r, a, b, p in calls if (r, a, b) == (repo, f, x)), x) for r, a, x, _ in calls if (r, a) == (repo, f)}):
                    visit(b, depth + 1, f)

        for f in sorted(range(12), key=lambda i: ((repo, i) not in rank, rank.get((repo, i), 0), i % 4, i)):
            visit(f, 0, None)
    assert sorted((r.repo, r.pos, r.fn_id, r.depth, r.via) for r in graph.flow_order(fns, c, roots, ["repo"]).collect()) == sorted(want)


def rounds_of(monkeypatch, name, run):
    """How many tables ``run`` writes under a label: the rounds of a loop."""
    count, whole = [0], graph.cut

    def counted(df, label="cut"):
        count[0] += label == name
        return whole(df, label)

    monkeypatch.setattr(graph, "cut", counted)
    out = run()
    monkeypatch.setattr(graph, "cut", whole)
    return out, count[0]


@pytest.mark.parametrize("seed", [1, 3])
def test_levels_of_graphs_with_circles(spark, seed):
    r = random.Random(seed)
    n = 24
    calls = {(0, *c) for c in random_calls(seed, n, r.choice([20, 40, 90]))} | {(1, i, (i + 1) % 9) for i in range(9)} | {(1, 3, 20), (1, 20, 21), (1, 22, 4)}
    got = {(x.part, x.node): x.level for x in graph.dag_levels(frame(spark, sorted(calls), "part int, src long, dst long"), ["part"]).collect()}
    for part in (0, 1):
        own = [(a, b) for p, a, b in calls if p == part]
        kept = [(a, b) for a, b in own if a not in reach_of(own, b)]
        level = {}
        for _ in range(n + 1):
            for x in {y for c in own for y in c}:
                level[x] = max((level.get(a, 0) + 1 for a, b in kept if b == x), default=0)
        assert {x: v for (p, x), v in got.items() if p == part} == level


def test_components_of_a_dense_core(spark):
    """Three complete graphs of four, each with ways to the next: no node has one edge on a side."""
    own = [(g * 4 + i, g * 4 + j) for g in range(3) for i in range(4) for j in range(4) if i != j] + [(g * 4 + i, g * 4 + 4 + i) for g in range(2) for i in range(4)]
    e = frame(spark, own, "src long, dst long")
    rounds, core, _ = graph.eliminate(e, graph.nodes_of(e))
    assert not rounds and core.count() == len(own)
    assert {(r.node, r.component) for r in graph.dense_components(core).collect()} == {(x, x // 4 * 4) for x in range(12)}
    assert {(r.node, r.level) for r in graph.dag_levels(e).collect()} == {(x, x // 4) for x in range(12)}


def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    e = spark.range(3000).selectExpr("(id * 7919) % 3001 AS src", "((id + 1) * 7919) % 3001 AS dst")   # numbers in no order
    levels, rounds = rounds_of(monkeypatch, "gone", lambda: graph.dag_levels(e))
    assert rounds <= 30
    assert levels.join(spark.range(3001).selectExpr("(id * 7919) % 3001 AS node", "id"), "node").where("level = id").count() == 3001


def commits_of(spark, seed, n):
    """A history with branches and merges: (sha, parent)."""
    r = random.Random(seed)
    rows = [(0, None)]
    for i in range(1, n):
        rows += [(i, p) for p in {max(0, i - r.choice([1, 1, 1, 2, 5])) for _ in range(r.choice([1, 1, 2]))}]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_merge_base_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = commits_of(spark, seed, 60)
    parents = {}
    for a, b in rows:
        if b is not None:
            parents.setdefault(a, set()).add(b)
    up = {i: reach_of([(a, b) for a, bs in parents.items() for b in bs], i) for i in range(60)}
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(25)} | {(7, 7), (3, 999)}   # a commit with itself, and one nobody knows
    commits, asked = frame(spark, rows, "sha long, parent long"), frame(spark, sorted(pairs), "a long, b long")
    up[999] = {999}
    want = {}
    for a, b in pairs:
        both = up[a] & up[b]
        lowest = [x for x in both if not any(x in up[y] and x != y for y in both)]
        if lowest:
            want[a, b] = min(lowest)
    assert {(x.a, x.b): x.base for x in graph.merge_base(commits, asked).collect()} == want
    assert {(x.a, x.b): (x.ahead, x.behind) for x in graph.ahead_behind(commits, asked).collect()} == {(a, b): (len(up[a] - up[b]), len(up[b] - up[a])) for a, b in pairs}


def test_merge_base_of_a_long_history_takes_few_rounds(spark, monkeypatch):
    """5,000 commits in a line with a side branch every hundred, merged forty commits later."""
    main = spark.range(1, 5000).selectExpr("id AS sha", "id - 1 AS parent")
    side = spark.range(50).selectExpr("explode(array(struct(10000 + id AS sha, id * 100 AS parent), struct(id * 100 + 40 AS sha, 10000 + id AS parent))) AS c").select("c.*")
    asked = frame(spark, [(4999, 10049), (10049, 10010), (2500, 4000)], "a long, b long")
    found, lines = rounds_of(monkeypatch, "lines", lambda: graph.merge_base(main.union(side), asked))
    assert {(r.a, r.b): r.base for r in found.collect()} == {(4999, 10049): 10049, (10049, 10010): 10010, (2500, 4000): 2500}
    found, reached = rounds_of(monkeypatch, "line-reach", lambda: graph.merge_base(main.union(side), asked))
    assert (lines - 2) / 2 + reached / 2 <= 18   # two tables a round of doubling and a round of reach
    only, lines = rounds_of(monkeypatch, "lines", lambda: graph.merge_base(main, frame(spark, [(4999, 17)], "a long, b long")))
    assert only.first().base == 17 and (lines - 2) / 2 <= 13


def brute_nest(cand):
    """Flows choose in order; a choice that closes a circle with earlier ones is skipped."""
    under = {}
    for flow in sorted({f for f, *_ in cand}):
        for _, k, i in sorted((r, k, i) for f, r, k, i in cand if f == flow):
            at = k
            while at in under and at != flow:
                at = under[at][0]
            if at != flow:
                under[flow] = (k, i)
                break
    return {(f, *u) for f, u in under.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_nest_flows_equals_choosing_in_order(spark, seed):
    r = random.Random(seed)
    parts, flows, names, cand = range(4), [], [], []
    for p in parts:
        n = r.choice([6, 9, 14])
        calls = {(f, i, f"fn{r.randrange(n)}") for f in range(n) for i in range(3)}
        names += [(p, f, i, c) for f, i, c in calls]
        for f in range(n):
            words, actor = sorted({f"fn{r.randrange(n)}" for _ in range(2)}), f"fn{r.randrange(n)}"
            flows.append((p, f, f"Title {f}", " ".join(words), actor))
            best = {}
            for rule, wanted in ((0, words), (1, [actor])):
                for k, i, c in calls:
                    if c in wanted and k != f:
                        best[k] = min(best.get(k, (9,)), (rule, k, i))
            cand += [(p, f, *o) for o in best.values()]
    got = graph.nest_flows(frame(spark, flows, "part int, flow int, title string, trigger string, first_actor string"),
                           frame(spark, [x[:3] for x in names], "part int, flow int, pos int"), frame(spark, names, "part int, flow int, pos int, name string"),
                           frame(spark, [], "part int, flow int, driver string"), "^nobody$", "fails").collect()
    for p in parts:
        assert {(x.flow, x.under_flow, x.under_step) for x in got if x.part == p} == brute_nest([c[1:] for c in cand if c[0] == p])


def test_two_flows_without_a_circle(spark):
    """One pointer is no circle, however few there are."""
    flows = frame(spark, [(0, 0, "T", "x", "x"), (0, 1, "T", "go", "x")], "part int, flow int, title string, trigger string, first_actor string")
    names = frame(spark, [(0, 0, 0, "go")], "part int, flow int, pos int, name string")
    none = frame(spark, [], "part int, flow int, driver string")
    assert [(x.flow, x.under_flow) for x in graph.nest_flows(flows, names, names, none, "^x$", "fails").collect()] == [(1, 0)]


def test_nested_flows_of_a_long_chain_choose_at_once(spark, monkeypatch):
    """Each of 40 flows details a step of the next, the last one of the first: one choice is skipped."""
    n = 40
    flows = frame(spark, [(0, f, "T", f"fn{f}", "x") for f in range(n)], "part int, flow int, title string, trigger string, first_actor string")
    names = frame(spark, [(0, f, 0, f"fn{(f - 1) % n}") for f in range(n)], "part int, flow int, pos int, name string")
    none = frame(spark, [], "part int, flow int, driver string")
    got, rounds = rounds_of(monkeypatch, "pick", lambda: graph.nest_flows(flows, names, names, none, "^x$", "fails").collect())
    assert {(x.flow, x.under_flow) for x in got} == {(f, f + 1) for f in range(n - 1)} and rounds == 2


def test_trunks_of_long_chains_take_few_rounds(spark, monkeypatch):
    e = spark.range(400).selectExpr("0 AS part", "id AS src", "id + 1 AS dst")
    weight = spark.range(401).selectExpr("0 AS part", "id AS node", "401 - id AS reach")
    entries = frame(spark, [(0, "L0", 0), (0, "L1", 390)], "part int, line_id string, node long")
    (trunk, _), rounds = rounds_of(monkeypatch, "trunk", lambda: graph.routes(e, entries, weight))
    assert rounds <= 13 and {(r.line_id, r.pos, r.node) for r in trunk.collect()} == {("L0", i, i) for i in range(401)} | {("L1", i, 390 + i) for i in range(11)}


def brute_routes(calls, entry):
    out = {}
    for a, b in sorted(calls):
        out.setdefault(a, []).append(b)
    weight = {x: len(reach_of(calls, x)) for c in calls for x in c}
    best = lambda i, seen: sorted((j for j in out.get(i, []) if j not in seen), key=lambda j: (-weight[j], j))
    trunk, seen, spurs = [entry], {entry}, []
    while nxt := best(trunk[-1], seen):
        trunk.append(nxt[0])
        seen.add(nxt[0])
    for pos, s in enumerate(trunk):
        for j in best(s, seen):
            if j not in seen:
                second = best(j, seen | {j})[:1]
                seen.update([j, *second])
                spurs.append((pos, j, second[0] if second else None))
    return trunk, spurs


@pytest.mark.parametrize("seed", [5])
def test_routes_equal_brute_force(spark, seed):
    calls = random_calls(seed, 16, 45)
    e = frame(spark, [(0, *c) for c in calls], "part int, src long, dst long")
    entries = frame(spark, [(0, f"L{n}", n) for n in (0, 3)], "part int, line_id string, node long")
    trunk, spurs = graph.routes(e, entries, graph.reach_count(e, ["part"]))
    t, s = trunk.collect(), spurs.collect()
    for n in (0, 3):
        want_trunk, want_spurs = brute_routes(calls, n)
        assert [r.node for r in sorted((r for r in t if r.line_id == f"L{n}"), key=lambda r: r.pos)] == want_trunk
        assert sorted((r.pos, r.node, r.second or -1) for r in s if r.line_id == f"L{n}") == sorted((p, j, k or -1) for p, j, k in want_spurs)


def test_batches_equal_greedy(spark):
    r = random.Random(7)
    items = [(g, f"s{i:03d}", r.randrange(1, 50)) for g in (0, 1) for i in range(40)]
    df = frame(spark, items, "repo int, id string, size long")
    for chunk in (10_000, 7):
        got = {(x.repo, x.id): x.batch for x in rank.assign_batches(df, 5, ["repo"], chunk=chunk).collect()}
        for g in (0, 1):
            load = [0] * 5
            for _, i, size in sorted((x for x in items if x[0] == g), key=lambda x: (-x[2], x[1])):
                b = load.index(min(load))
                load[b] += size
                assert got[g, i] == b


def test_aligned_steps_equal_a_search_in_order(spark):
    """Random edits of steps; which texts are versions of each other is asked of Spark pair by pair, the rest is a plain search."""
    import difflib
    from codeatlas.functions import scalars as S
    r = random.Random(4)
    texts = ["if a < b", "if a >= b", "if !(a < b)", "x = f(1)", "x = f(2)", "x = f(y, z)", "return g(a) + 1", "return h", "call(a, b, c, d)", "call(a, b, c, e)", "zz"]
    step = lambda: (r.choice(["decision", "call"]), r.choice(texts), r.choice(["f", "g", None]))
    base, head = [], []
    for fn in range(40):
        old = [step() for _ in range(r.randint(0, 9))]
        new = [step() if r.random() < 0.4 else x for x in old if r.random() < 0.8] + [step() for _ in range(r.randint(0, 2))]
        base += [(fn, 10 + 2 * i, *x) for i, x in enumerate(old)]
        head += [(fn, 5 + 3 * i, *x) for i, x in enumerate(new)]
    schema = "fn_id int, pos int, kind string, text string, callee string"
    alike = {(x.a, x.b) for x in frame(spark, [(a, b) for a in texts for b in texts], "a string, b string").selectExpr(
        "a", "b", f"{S.mask_literals('a')} = {S.mask_literals('b')} OR {S.inversion('a', 'b')} IS NOT NULL AS near", f"{S.operator_tokens('a')} AS x", f"{S.operator_tokens('b')} AS y").collect()
        if x.near or difflib.SequenceMatcher(None, list(x.x), list(x.y)).ratio() >= 0.6}
    want = set()
    for fn in range(40):
        old, new = [x[1:] for x in base if x[0] == fn], [x[1:] for x in head if x[0] == fn]
        matched = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [x[1:3] for x in old], [x[1:3] for x in new], autojunk=False).get_opcodes():
            if op == "equal":
                matched += zip(range(i1, i2), range(j1, j2))
            else:
                free = j1
                for i in range(i1, i2):
                    hits = [j for j in range(free, j2) if old[i][1] == new[j][1] and old[i][3] == new[j][3] and (old[i][2], new[j][2]) in alike]
                    if hits:
                        matched.append((i, hits[0]))
                        free = hits[0] + 1
        want |= {(fn, old[i][0], new[j][0]) for i, j in matched}
        want |= {(fn, x[0], None) for i, x in enumerate(old) if i not in {i for i, _ in matched}} | {(fn, None, x[0]) for j, x in enumerate(new) if j not in {j for _, j in matched}}
    got = [tuple(x) for x in change.align_steps(frame(spark, base, schema), frame(spark, head, schema)).collect()]
    assert set(got) == want and len(got) == len(want) and sum(None not in w for w in want) > 60


def test_diff_rebuilds_both_files(spark):
    a, b = "x\ny\nz\nw\n", "x\nq\nz\nw\nv"
    base = frame(spark, [("f", a), ("gone", "1\n2"), ("same", "k\n")], "path string, content string")
    head = frame(spark, [("f", b), ("new", "3"), ("same", "k\n")], "path string, content string")
    rows = change.diff_lines(base, head).orderBy("path", "pos").collect()
    for path, old, new in (("f", a, b), ("gone", "1\n2", ""), ("new", "", "3"), ("same", "k\n", "k\n")):
        mine = [r for r in rows if r.path == path]
        assert [r.base_line for r in mine if r.op in "=-"] == list(range(1, len(old.splitlines()) + 1))
        assert [r.head_line for r in mine if r.op in "=+"] == list(range(1, len(new.splitlines()) + 1))
        assert all(old.splitlines()[r.base_line - 1] == new.splitlines()[r.head_line - 1] for r in mine if r.op == "=")
    assert [(r.op, r.base_line, r.head_line) for r in rows if r.path == "f"][1:3] == [("-", 2, 0), ("+", 0, 2)]


def test_steps_pair_inside_changed_stretches(spark):
    base = [(1, 0, "decision", "if err != nil", None), (1, 1, "call", "save(a, 1)", "save"), (1, 2, "call", "drop(x)", "drop")]
    head = [(1, 0, "decision", "if err == nil", None), (1, 1, "call", "log(x)", "log"), (1, 2, "call", "save(a, 2)", "save")]
    schema = "fn_id long, pos long, kind string, text string, callee string"
    got = {(r.base_pos, r.head_pos) for r in change.align_steps(frame(spark, base, schema), frame(spark, head, schema)).collect()}
    assert got == {(0, 0), (1, 2), (2, None), (None, 1)}


def test_change_records_pair_steps(spark):
    steps = "fn_id long, id string, pos long, kind string, text string, line long"
    base = frame(spark, [(1, "a", 0, "entry", "f()", 1), (1, "b", 1, "call", "go(1)", 2), (1, "c", 2, "call", "run()", 5)], steps)
    head = frame(spark, [(1, "A", 0, "entry", "f(x)", 1), (1, "B", 1, "call", "go(2)", 9), (1, "C", 2, "call", "other()", 12)], steps)
    changes = frame(spark, [(1, 0, "call", 2, 9)], "fn_id long, pos long, kind string, base_line long, head_line long")
    ops = frame(spark, [(1, 0, "-", 5, 0), (1, 1, "=", 6, 6), (1, 2, "+", 0, 12)], "fn_id long, pos long, op string, base_line long, head_line long")
    got = {(r.base_id, r.head_id, r.mark) for r in change.pair_steps(base, head, changes, ops).collect()}
    assert got == {("a", "A", "chg"), ("b", "B", "chg"), ("c", None, "del"), (None, "C", "add")}


def test_enclosing_ties_and_blocks(spark):
    fns = frame(spark, [("f", 1, 1, 1000), ("f", 2, 300, 310), ("f", 3, 300, 310), ("g", 4, 1, 5)], "path string, fn_id long, start long, end long")
    points = frame(spark, [("f", 305), ("f", 700), ("f", 2000), ("g", 5)], "path string, line long")
    got = {(r.path, r.line): r.fn_id for r in joins.enclosing(points, fns, ["path"], order=("fn_id",)).collect()}
    assert got == {("f", 305): 2, ("f", 700): 1, ("g", 5): 4}


def test_owner_root_ties_and_missing(spark):
    paths = frame(spark, [("r1", "a/b/c.py"), ("r1", "z.py"), ("r2", "a/b")], "repo string, path string")
    owners = frame(spark, [("r1", "root", "."), ("r1", "two", "a/b/"), ("r1", "also", "a/b")], "repo string, owner string, folder string")
    got = {(r.repo, r.path): r.owner for r in joins.owner_of(paths, owners, ["repo"]).collect()}
    assert got == {("r1", "a/b/c.py"): "also", ("r1", "z.py"): "root", ("r2", "a/b"): None}


def test_lines_binary_large_and_breaks(spark):
    df = frame(spark, [("a", "x\r\ny\n"), ("b", ""), ("c", "q\0w\nz"), ("d", "k"), ("e", "a\n\nb")], "path string, content string")
    assert sorted((r.path, r.line_no, r.text) for r in files.explode_lines(df).collect()) == [
        ("a", 1, "x"), ("a", 2, "y"), ("d", 1, "k"), ("e", 1, "a"), ("e", 2, ""), ("e", 3, "b")]
    assert {r.path: (r.code_lines, r.total_lines) for r in files.count_lines(df).collect()} == {"a": (2, 2), "b": (0, 0), "c": (0, 0), "d": (1, 1), "e": (2, 3)}


def test_defaults_keep_every_row(spark):
    from codeatlas.operators import search
    big = "word number\n" * 200_000   # over two million bytes
    df = frame(spark, [("a", big), ("b", "word")], "path string, content string")
    assert {r.path: r["count"] for r in files.explode_lines(df).groupBy("path").count().collect()} == {"a": 200_000, "b": 1}
    assert search.grep_files(df, "word").count() == 200_001
    assert search.list_tree(frame(spark, [(f"x/{i}",) for i in range(5_100)], "path string"), "x").count() == 5_100
    roots = frame(spark, [(1, f"f{i}", i, 2 + i) for i in range(30)], "part int, label string, node long, reach long")
    none = roots.where("false").selectExpr("part", "0 AS pos", "label", "'http' AS kind", "node", "reach")
    lines = rank.rank_entries(none, roots).collect()
    assert len(lines) == 30 and {r.hidden for r in lines} == {0} and {r.hidden for r in rank.rank_entries(none, roots, cap=12).collect()} == {18}
    branches = frame(spark, [("r", f"b{i}", i) for i in range(60)], "repo string, name string, updated int")
    assert joins.branch_list(branches, branches.where("false"), ["repo"]).count() == 60


def test_blob_hash_matches_version_control(spark):
    import hashlib
    body = "héllo\n"
    want = hashlib.sha1(b"blob %d\0" % len(body.encode()) + body.encode()).hexdigest()
    assert frame(spark, [(body,)], "c string").select(files.blob_sha(F.col("c"))).first()[0] == want


def test_read_parts_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"parts": [{"id": "a", "path": "x"}, {"path": "no id"}]}')
    (tmp_path / "2.json").write_text('{"parts": [{"id": "a", "path": "later"}, {"id": "b", "path": "y"}]}')
    parts, rejected = records.read_parts(spark, str(tmp_path))
    assert sorted((r.id, r.path) for r in parts.collect()) == [("a", "x"), ("b", "y")] and rejected.count() == 2


def test_risk_of_signature_with_outside_callers(spark):
    fns = frame(spark, [(1, "modified"), (2, "added"), (3, "modified")], "fn_id long, status string")
    changes = frame(spark, [(1, "signature", "medium"), (3, "call", "low")], "fn_id long, kind string, severity string")
    got = {r.fn_id: r.risk for r in rollup.function_risk(fns, changes, frame(spark, [(1,)], "fn_id long")).collect()}
    assert got == {1: "high", 2: "low", 3: "low"}


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from codeatlas import session
    assert session.checkpoint_folder(spark)
    df = session.cut(spark.range(3))
    assert df.count() == 3 and session.once(df) is df
    assert session.together([df, session.cut(spark.range(2))]).count() == 5


def test_connect_equals_brute_force(spark):
    """Few names over many files, so most names have several definitions in and around the caller's folder."""
    import os
    r = random.Random(11)
    fns, sites, local = [], set(), set()
    for i in range(70):
        suffix = r.choice(["py", "py", "go", "ts", "js", "txt"])
        file = f"d{r.randrange(3)}/sub{r.randrange(2)}/m{r.randrange(3)}.{suffix}"
        fns.append((i, f"n{r.randrange(9)}" if r.random() < 0.8 else "get", r.choice([None, None, "T"]), file, "query" if r.random() < 0.08 else None))
    for i, *_ in fns:
        for _ in range(3):
            sites.add((i, r.choice(["get"] + [f"n{k}" for k in range(9)]), r.choice(["", "", "self", "obj", "m1", "sub0"]), r.randrange(50)))
    local = {(f[3], f[1]) for f in fns if r.random() < 0.3}
    family = lambda p: {"py": "python", "go": "go", "ts": "js", "js": "js"}.get(p.rsplit(".", 1)[1])
    by_id = {f[0]: f for f in fns}

    def reaches(name, recv, f, g):
        if g[4] == "query" or g[3] == f[3]:
            return True
        if family(f[3]) is None or family(g[3]) != family(f[3]) or (f[3], name) in local or name == "get":
            return False
        if g[2]:
            return recv not in ("", "self", "this", "cls")
        return not recv or family(g[3]) == "go" or recv in (os.path.basename(g[3]).rsplit(".", 1)[0], os.path.basename(os.path.dirname(g[3])))

    want = set()
    for s in sites:
        f = by_id[s[0]]
        found = [g for g in fns if g[1] == s[1] and g[0] != s[0] and reaches(s[1], s[2], f, g)]
        if len(found) > 1:
            found = [g for g in found if os.path.dirname(g[3]) == os.path.dirname(f[3])]
        if len(found) == 1:
            want.add((*s, found[0][0]))
    got = joins.connect(frame(spark, sorted(sites), "fn_id long, name string, recv string, line long"),
                        frame(spark, fns, "fn_id long, name string, parent string, file string, kind string"), frame(spark, sorted(local), "file string, name string"))
    assert {(x.fn_id, x.name, x.recv, x.line, x.to) for x in got.collect()} == want and want
