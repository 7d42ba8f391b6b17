"""Joins chosen by measured sizes, and places that meet few of the steps naming their word."""

import random

from codeatlas.operators import search
from codeatlas.session import measured_joins


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    session = spark.newSession()
    session.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    session.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    session.range(600_000).selectExpr("id % 1000 AS k", "'some longer text of a row' AS v").write.parquet(str(tmp_path / "t"))

    def plan():
        t = session.read.parquet(str(tmp_path / "t"))
        return t.alias("a").join(t.alias("b"), "k").groupBy("a.v").count()._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    measured_joins(session)
    assert "BroadcastHashJoin" not in plan()
    measured_joins(session)   # again: nothing changes
    small = session.read.parquet(str(tmp_path / "t")).limit(5).groupBy("k").count()
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10485760b" and small.join(small, "k").count() == 5


def test_steps_of_a_word_named_by_all(spark):
    """Equal to the plain join: every place against every step of its word, the best k by score, owner, flow and position."""
    rng = random.Random(3)
    paths = ["a.py", "b.py", "c.py", None]
    steps = [(f"f{i % 40}", None if i % 40 % 5 == 0 else f"o{i % 40 % 3}", i // 40, rng.choice(["run", "stop"]), "x.run", "y", rng.choice(["a.py:3", "b.py:4", "c.py:9", None]))
             for i in range(300)]
    steps += [(f, o, p, fn, a, b, "a.py:77") for f, o, p, fn, a, b, _ in steps[:60]]   # the same step in two files
    places = [(i, rng.choice(paths), i % 7, rng.choice(["run", "stop", "none"])) for i in range(60)]
    places += [(i, "a.py", 1, "run") for i in range(0, 60, 7)]   # a place twice
    s = spark.createDataFrame(steps, "flow_id string, owner string, pos int, fn string, `from` string, `to` string, ref string")
    p = spark.createDataFrame(places, "place_id int, path string, line int, word string")
    fns = spark.createDataFrame([], "path string, name string, start int, end int")
    for k in (2, 12, 200):
        want = []
        for place in {x[0] for x in places}:
            found = set()
            for _, path, _, word in [x for x in places if x[0] == place]:
                for f, o, pos, fn, a, b, ref in steps:
                    if word in (fn, a.split(".")[-1], b.split(".")[-1]):
                        found.add((-3.0 if (ref.split(":")[0] if ref else None) == path else -2.0, o is None, f, pos))
            want += [(place, f, pos, -score) for score, _, f, pos in sorted(found)[:k]]
        assert sorted(tuple(r) for r in search.steps_at(s, fns, p, k=k).collect()) == sorted(want)
