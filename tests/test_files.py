"""Trees and lines read from files, against Python on odd contents; ignored folders and large files."""

import gzip
import hashlib
import os
import random

from codeatlas.sources import files, records


def write(root, path, data):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_ignored_folders_are_never_opened(spark, tmp_path):
    root = tmp_path / "re po+1"
    write(root, "src/a b.py", "x = 1\n")
    write(root, "src/c+d%20.py", "y = 2\n")
    for folder in ("node_modules/big", ".git"):
        write(root, f"{folder}/pack.txt", "")
        os.truncate(root / folder / "pack.txt", 3 << 30)   # no reader of whole files could take it
    got = {r.path: (r.size, bytes(r.content)) for r in files.read_tree(spark, str(root)).collect()}
    assert got == {"src/a b.py": (6, b"x = 1\n"), "src/c+d%20.py": (6, b"y = 2\n")}
    assert {r.path for r in files.read_lines(spark, str(root)).collect()} == set(got)


BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def test_lines_equal_python_on_odd_texts(spark, tmp_path):
    rng, texts = random.Random(1), {}
    for i in range(150):
        texts[f"d{i % 5}/f{i}.txt"] = "".join(rng.choice(["", "a", "é b", "x" * 30, *BREAKS]) for _ in range(rng.randint(0, 12)))
    texts |= {"one": "\n", "two": "\r\n", "three": "a\r\r", "four": "a\x0b", "five": "a\x0b\n", "six": "no end", "seven": "a\r\r\n", "empty": ""}
    for path, text in texts.items():
        write(tmp_path, path, text)
    write(tmp_path, "binary", b"ab\n\0c\nd")
    write(tmp_path, "late-nul", b"a" * 9000 + b"\n\0b\n")
    want = {(p, k, line) for p, t in texts.items() for k, line in enumerate(t.splitlines(), 1)} | {("late-nul", 1, "a" * 9000), ("late-nul", 2, "\0b")}
    rows = [tuple(r) for r in files.read_lines(spark, str(tmp_path)).collect()]
    assert set(rows) == want and len(rows) == len(want)
    whole = spark.createDataFrame(list(texts.items()), "path string, content string")
    assert {tuple(r) for r in files.explode_lines(whole).collect()} == {w for w in want if w[0] != "late-nul"}


def test_a_large_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    write(tmp_path, "large.txt", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        blocks = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_block_start AS b").distinct().count()
        got = [tuple(r) for r in files.read_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 10 and sorted(got) == [("large.txt", k, line) for k, line in enumerate(lines, 1)]


def slow_salvage(text):
    """A text whose outermost braces parse gives its parts. Else every place in order: the object that begins there is taken if it parses and is a
    part, and reading goes on behind it."""
    import json
    out, at = [], 0
    try:
        return [(p["id"], p["path"]) for p in json.loads(text[text.find("{"):text.rfind("}") + 1]).get("parts", [])]
    except ValueError:
        pass
    while (at := text.find("{", at)) >= 0:
        try:
            part, end = json.JSONDecoder().raw_decode(text, at)
            if part.get("id") and part.get("path"):
                out.append((part["id"], part["path"]))
                at = end
                continue
        except ValueError:
            pass
        at += 1
    return out


def test_salvaged_parts_equal_a_parse_at_every_brace(spark):
    rng, rows = random.Random(3), []
    pieces = ['{"id": "a", "path": "x"}', '{"id": "b{", "path": "y}", "uses": [{"target": "q\\"{"}]}', '{"id": "c"}', '{"id": "d", "path": "say "hi" }', "{", "}", '"', "\\",
              '{"id": "e", "path": "p", "flows": [{"title": "t"}]}', '{"z": {"id": "f", "path": "in"}}', '{"id": "", "path": "n"}', "[1, 2], ", "text ", '{"id": "g\\\\", "path": "h"}', "\n"]
    for k in range(300):
        rows.append((k, "bad " + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) + ' {"id": "last", "path": "z"} "{'))
    rows += [(1000, None), (1001, ""), (1002, "no braces"), (7, rows[7][1])]   # one text twice
    got = {}
    for r in records.salvage_parts(spark.createDataFrame(rows, "k int, raw string"), ["k"]).collect():
        got.setdefault(r.k, []).append((r.pos, r.id, r.path))
    for k, text in rows[:300]:
        want = [(i, *p) for i, p in enumerate(slow_salvage(text))]
        assert sorted(got.get(k, [])) == sorted(want * (2 if k == 7 else 1)), (k, text)
    assert not {1000, 1001, 1002} & set(got)


def test_salvage_runs_in_the_jvm(spark):
    raw = spark.createDataFrame([(1, "{")], "k int, raw string")
    plan = records.salvage_parts(raw, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "NestedLoop" not in plan


def test_trees_are_hashed_without_holding_files(spark, tmp_path):
    rng = random.Random(5)
    odd = {"empty": b"", "feed": b"\n", "feeds": b"\n\n", "mark": b"\xef\xbb\xbfa\n", "mark-only": b"\xef\xbb\xbf", "no-end": b"a\nb", "cr": b"a\r\nb\r",
           "bytes": bytes(rng.randrange(256) for _ in range(30_000)), "packed.gz": gzip.compress(b"a\nb\n"), "node_modules/x": b"no",
           "long": bytes(rng.choice(b"ab\n\xff\0") for _ in range(400_000))}
    for path, data in odd.items():
        write(tmp_path, path, data)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "50000")   # blocks of the long file are read by several tasks
    out = files.read_tree(small, str(tmp_path), content=False)
    want = {p: (len(d), hashlib.sha1(b"blob %d\0" % len(d) + d).hexdigest()) for p, d in odd.items() if not p.startswith("node_modules/")}
    del want["empty"]   # Spark's readers list no empty file, with contents or without
    assert {r.path: (r.size, r.sha) for r in out.collect()} == want
    assert {r.path: (r.size, r.sha) for r in files.read_tree(small, str(tmp_path)).collect()} == want


def test_huge_files_are_hashed(spark, tmp_path):
    line = b"x" * 1023 + b"\n"
    with open(tmp_path / "huge", "wb") as f:
        f.write(line * (300 << 10))   # 300 MB
    plan = files.read_tree(spark, str(tmp_path), content=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" in plan.lower() and plan.count("sha1(") == 1   # only the cells of packed files
    want = hashlib.sha1(b"blob %d\0" % (300 << 20))
    for _ in range(300):
        want.update(line * 1024)
    assert [(r.size, r.sha) for r in files.read_tree(spark, str(tmp_path), content=False).collect()] == [(300 << 20, want.hexdigest())]
