"""Steps that must not grow faster than their input: what they hand to Python, meet in joins and repeat."""

from codeatlas.operators import change, graph


def token(text, statement="value = x", condition=False):
    return (text, 1, statement, condition)


def test_literal_changes_hand_only_texts_to_python(spark):
    words = lambda *ws: [token(w, "timeout = x") for w in ws]
    rows = [(1, words("f", "=", "1", "y"), words("f", "=", "2", "y")), (2, words("a", "1", "b", "2"), words("a", "3", "b", "4")),
            (3, words("a"), words("a")), (4, words("1", "2"), words("x")), (None, words("5"), words("6")), (6, None, words("6")), (1, words("7"), words("8"))]
    one = "array<struct<text: string, line: int, statement: string, in_condition: boolean>>"
    found = change.literal_changes(spark.createDataFrame(rows, f"fn_id long, base_tokens {one}, head_tokens {one}"))
    assert sorted(((r.fn_id or 0, r.before, r.after) for r in found.collect())) == [(0, "5", "6"), (1, "1", "2"), (1, "7", "8"), (2, "1", "3"), (2, "2", "4")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan


def test_flow_roots_walk_from_roots_alone(spark, monkeypatch):
    walked, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda e, seeds=None, by=(): walked.append(seeds and {r.node for r in seeds.collect()}) or reach(e, seeds, by))
    fns = spark.createDataFrame([(i, f"f{i}", "a.py", "function", i) for i in range(12)] + [(5, "f5", "b.py", "function", 1)], "fn_id long, name string, file string, kind string, start long")
    calls = spark.createDataFrame([(i, i // 2) for i in range(1, 10)] + [(8, 9), (9, 8), (10, 3), (10, 3), (None, 4), (4, None)], "src long, dst long")
    assert sorted((r.fn_id, r.reach) for r in graph.flow_roots(fns, calls).collect()) == [(5, 4), (5, 4), (6, 4), (7, 4), (10, 4), (11, 1)]
    assert walked == [{5, 6, 7, 10, 11}]


def test_pair_steps_read_their_inputs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "fn_id long, id long, pos long, kind string, text string, line long"
    once = lambda rows, schema: spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    base = once([(1, i, i, "call", f"s{i}", i) for i in range(1, 7)], kinds)
    head = once([(1, i, i, "call", f"s{i}" if i != 3 else "new", i) for i in range(1, 6)], kinds)
    ops = [(1, 2 * i, "=", i, i) for i in (1, 2, 4, 5)] + [(1, 6, "-", 3, 0), (1, 7, "+", 0, 3), (1, 12, "-", 6, 0)]
    none = spark.createDataFrame([], "fn_id long, pos long, kind string, base_line long, head_line long")
    found = change.pair_steps(base, head, none, once(ops, "fn_id long, pos long, op string, base_line long, head_line long"))
    assert sorted((r.base_id, r.head_id, r.mark or "") for r in found.collect()) == [(1, 1, ""), (2, 2, ""), (3, 3, "chg"), (4, 4, ""), (5, 5, ""), (6, None, "del")]
    assert seen.value == 6 + 5 + 7
