"""Toxicity, pseudonyms, fuzzy lines, benchmark windows, pieces and the pipeline, against brute force on small tables."""

import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ara", "eto", "inu", "ombe", "usti")]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")


ODD = [(1, None), (2, ""), (None, "no id at all"), (3, "x"), (3, "x"), (4, "word " * 20000)]


def test_toxicity(spark):
    from codeatlas.llm import toxicity as t
    rows = [(i, text(i, 30) + (" grumpf " if i % 3 == 0 else " ") + text(-i, 5), int(i % 3 == 0)) for i in range(120)] + [(None, None, 1), (500, "a", None)]
    weights, prior = t.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert weights["grumpf"] == max(weights.values()) and not set(WORDS) & set(weights)
    plain, negated, reported, target = (t.score(x, weights, prior)[0] for x in ("a grumpf", "not a grumpf", "he said: x. said a grumpf", "you grumpf"))
    assert negated < reported < plain < target and t.score("you kill", weights, prior)[2] == "threat+target"
    got = t.score_toxicity(docs(spark, ODD), weights, prior).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert t.score_toxicity(docs(spark, []), weights, prior).count() == 0
    assert t.keep_clean(docs(spark, [*ODD, (9, "you grumpf"), (None, "grumpf")]), weights, prior).count() == len(ODD) + 1


def test_toxicity_learns_used_words_and_not_copies(spark):
    from codeatlas.llm import toxicity as t
    rows = [(i, f"{text(i, 30)}{' a grumpf' if i % 3 == 0 else ' not a grumpf' if i % 9 == 1 else ''}", int(i % 3 == 0)) for i in range(300)]   # a quarter negated and clean
    rows += [(1000 + i, f"{text('copy', 80)} unusual ordinary {WORDS[i % 50]}", 1) for i in range(60)]
    weights, prior = t.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert weights["grumpf"] > 0 and not {"unusual", "ordinary"} & set(weights) and weights["+negated"] < t.NEGATED
    assert t.score("not a grumpf", weights, prior)[0] < t.score("a grumpf", weights, prior)[0]


def test_toxicity_chooses_its_sample_without_texts(spark):
    from codeatlas.llm import toxicity as t
    rows = [(i, f"{text(i, 30)}{' grumpf' if i % 2 else ''}", i % 2) for i in range(160)] + [(None, "no id at all", 1), (500, None, 1), (501, "a", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    order = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").selectExpr("*", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").drop("h").collect()
    seen = []
    near = t.jaccard_components
    t.jaccard_components = lambda found: seen.append(found) or near(found)
    try:
        assert t.learn(labelled, 100) == t.learn(spark.createDataFrame(order[:100], labelled.schema))
    finally:
        t.jaccard_components = near
    plan = seen[0]._jdf.queryExecution().toString()
    assert "GlobalLimit" not in plan and "TakeOrdered" not in plan
    assert t.learn(labelled.limit(0))[0].keys() == {"+target", "+negated", "+reported"}


def test_pseudonyms(spark):
    from codeatlas.llm import pseudonyms as p
    rows = [(11, "Card 4111 1111 1111 1111, born 1984-02-29; call +1 (017) 555-7713 at 10.0.0.255."), (12, "4111-1111-1111-1111 or 4111111111111112, 2023-02-30, 999.1.1.1, 1899-12-31, 2099-12-31"), *ODD]
    got = {r.doc_id: r for r in p.pseudonymise(docs(spark, rows)).collect()}
    card = lambda s: "".join(c for c in s if c.isdigit())
    one, two = got[11].text, got[12].text
    assert one != rows[0][1] and len(one) <= len(rows[0][1]) + 7 and card(one[5:24]) == card(two[:19]) and two[4] == "-" and one[9] == " "
    digits = [int(c) for c in card(one[5:24])][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert "4111111111111112, 2023-02-30, 999.1.1.1, 1899-12-31" in two and "2099-12-31" not in two
    assert got[4].text == ODD[-1][1] and got[11].n_found == 4 and got[None].text == "no id at all" and got[12].n_changed == 2
    for a, b, tag in ((250, 292, "date"), (7, 7, "late"), (10, 100, "x")):
        n = spark.range(a * b).selectExpr(p.feistel("k", "id", f"{a}L", f"{b}L", f"'{tag}'") + " AS v").agg({"v": "min"}).first()[0]
        values = spark.range(a * b).selectExpr(p.feistel("k", "id", f"{a}L", f"{b}L", f"'{tag}'") + " AS v").distinct()
        assert n == 0 and values.count() == a * b and values.agg({"v": "max"}).first()[0] == a * b - 1
    assert p.pseudonymise(docs(spark, [])).count() == 0


def test_pseudonyms_beside_other_digits(spark):
    from codeatlas.llm import pseudonyms as p
    card, phone, date, address = "4111 1111 1111 1111", "+1 (017) 555-7713", "1984-02-29", "10.0.0.255"
    alone = {r.doc_id: r for r in p.pseudonymise(docs(spark, list(enumerate([card, phone, date, address, card.replace(" ", "")])))).collect()}
    new = {x: alone[i].text for i, x in enumerate([card, phone, date, address, card.replace(" ", "")])}
    assert all(x != y for x, y in new.items()) and all(r.n_found == r.n_changed == 1 for r in alone.values())
    cases = [[card, " 123"], ["123 ", card], [card.replace(" ", ""), " 12/27"], [phone, " ", date], [phone, " ", card], [phone, " 42"], [phone, " ", phone], [card, " ", date, " ", address],
             [date, "T10:00:00 ", card, "."], [card, " ", card, " 77 5 ", card], ["7 ", address, " ", phone, ", ", date], ["(", phone, ") 1.5 ", card, "-12"], ["1 " * 3000, card, " 9" * 3000]]
    got = {r.doc_id: r for r in p.pseudonymise(docs(spark, [(i, "".join(c)) for i, c in enumerate(cases)])).collect()}
    for i, c in enumerate(cases):
        if i < len(cases) - 1:
            assert got[i].text == "".join(new.get(x, x) for x in c), c
            assert got[i].n_found == sum(x in new for x in c), c
    assert len(got[12].text) == len("".join(cases[12])) and card not in got[12].text
    for kept in ("4111111111111111a", "a4111111111111111", "1984-02-29x", "1984-02-29-1", "1.4111111111111111", "10.0.0.255.1", "41111111111111110000"):
        assert p.pseudonymise(docs(spark, [(1, kept)])).first().text == kept


def test_fuzzy_lines(spark):
    from codeatlas.llm import line_dedup as d
    base = [text(k, 14) for k in range(12)]
    lines = base + [b.replace("ara", "arx", 1) for b in base[:6]] + ["", "  ", "A.", "a."] + [base[0].upper()]
    for k in range(90):   # one group of near copies beyond the size up to which all pairs are compared
        lines.append(text("hot", 30) + f" {WORDS[k % 50]}")
    rows = [(i, "\n".join(lines[i::7])) for i in range(7)] + [(70 + i, t) for i, t in ODD if i]
    out = {(r.doc_id): r.text for r in d.drop_repeated_lines(docs(spark, rows)).collect()}
    norm = lambda s: " ".join(s.lower().split())
    sets = lambda s: {s[i:i + 5] for i in range(max(1, len(s) - 4))}
    every = sorted({(i, k): x for i, t in rows for k, x in enumerate((t or "").split("\n")) if norm(x)}.items())
    names = [norm(x) for _, x in every]
    up = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a):
            x, y = sets(names[a]), sets(names[b])
            if 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = [new if u == old else u for u in up]
    gone = {every[a][0] for a in range(len(every)) if up[a] != a}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert out[i] == want, i
    assert d.drop_repeated_lines(docs(spark, [])).count() == 0
    assert d.drop_repeated_lines(docs(spark, [(None, "a\na")])).first().text == "a\na"


def test_fuzzy_lines_between_short_and_long(spark):
    from codeatlas.llm import line_dedup as d
    norm = lambda s: " ".join(s.lower().split())
    sets = lambda s: {s[i:i + 5] for i in range(max(1, len(s) - 4))}
    lines = []
    for k in range(60):   # 90 to 300 shingles, copies with a word changed, cut short or drawn out, beyond the basic plane too
        words = text(f"border{k}", 16 + k // 2).split()
        lines += [" ".join(words), " ".join(words[:-2] + ["x😀y"]), " ".join(words[:len(words) - 3]), "  ".join([*words, text(f"more{k}", 3)]), " ".join(words[::-1])]
    lines += ["😀😀😀", "😀😀😀😀😀", "😀😀😀😀😀😀", "ab", "aaaaaa", "aaaaaaa", "x\u2028y z w", "x\u2028y\tz  w"]
    names = [norm(x) if "\u2028" not in x else x.replace("\t", " ").replace("  ", " ") for x in lines]
    up = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            x, y = sets(names[a]), sets(names[b])
            if 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = [new if u == old else u for u in up]
    got = {r.doc_id for r in d.drop_repeated_lines(docs(spark, list(enumerate(lines)))).where("n_dropped = 1").collect()}
    assert got == {a for a in range(len(names)) if up[a] != a} and 100 < len(got) < 240


def test_fuzzy_lines_move_only_what_may_be_alike(spark, monkeypatch):
    import glob
    import os

    from codeatlas.llm import line_dedup as d
    letters = lambda seed: "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz ", k=400)).strip()
    rows = [(i, "\n".join(letters(f"{i}-{k}") for k in range(5))) for i in range(300)] + [(1000 + i, letters(f"{i}-1") + " more") for i in range(10)]
    written = {}
    cut = d.cut

    def noted(df, label="cut"):
        out = cut(df, label)
        written[label] = written.get(label, 0) + sum(os.path.getsize(f) for p in out.cut_paths for f in glob.glob(f"{p.removeprefix('file:')}/*.parquet"))
        if "norm" in out.columns:
            written["texts"] = written.get("texts", 0) + out.count()
        return out

    monkeypatch.setattr(d, "cut", noted)
    assert d.drop_repeated_lines(docs(spark, rows)).agg({"n_dropped": "sum"}).first()[0] == 10
    assert written["texts"] <= 60   # of 1,510 lines, 20 are like another
    assert sum(written.values()) < 1.2 * sum(len(t) for _, t in rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false" and spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_benchmark_windows(spark):
    from collections import Counter

    from codeatlas.llm import decontaminate as d
    items = [(k, text(f"i{k}", 15 + k)) for k in range(40)] + [(90, None), (91, ""), (92, "three words only")]
    rows = [*ODD]
    for k in range(40):
        w = items[k][1].split()
        if k % 3 == 1:
            w[1] = "changed"
        if k % 3 == 2:
            w[::4] = ["other"] * len(w[::4])
        rows.append((100 + k, f"{text(k, 50)} {' '.join(w)} {text(-k, 40)}"))
    rows.append((200, "it has three words only here"))
    spark_items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(docs(spark, rows), spark_items).collect()}
    want = {}
    for i, t in rows:
        words = (t or "").lower().split()
        for j, s in items:
            w = (s or "").lower().split()
            k = min(5, len(w))
            bag = lambda x: Counter(tuple(x[a:a + k]) for a in range(len(x) - k + 1))  # noqa: B023, E731
            for a in range(len(words) - len(w) + 1 if w else 0):
                if i != 4:
                    x, y = bag(words[a:a + len(w)]), bag(w)
                    sim = (x & y).total() / (x | y).total()
                    if sim >= 0.8:
                        want[i, j] = max(sim, want.get((i, j), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and (200, 92) in got
    assert d.find_leaks(docs(spark, []), spark_items).count() == 0 == d.find_leaks(docs(spark, rows), spark_items.limit(0)).count()
    assert d.find_leaks(docs(spark, rows), spark_items, 10).count() == len(want)
    assert d.keep_unleaked(docs(spark, rows), spark_items).count() == len(rows) - len({i for i, _ in want})


def test_benchmark_item_longer_than_the_text(spark):
    from codeatlas.llm import decontaminate as d
    item = text("long", 40).split()
    rows = [(1, " ".join(item[:38])), (2, " ".join(item[1:39])), (3, " ".join(item[:30])), (4, " ".join(item))]
    got = {r.doc_id: (r.similarity, r.n_words) for r in d.find_leaks(docs(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (34 / 36, 38), 2: (34 / 36, 38), 4: (1.0, 40)}


def test_lines_of_texts_sharing_a_doc_id(spark):
    from codeatlas.llm import jaccard_trees
    from codeatlas.llm import line_dedup as d
    rows = [(1, f"{text(1, 20)}\n{text(2, 20)}"), (2, f"{text(1, 20)}\n{text(3, 20)}"), (2, f"{text(4, 20)}\n{text(5, 20)}")]
    got = sorted(r.text for r in d.drop_repeated_lines(docs(spark, rows)).collect())
    assert got == sorted([rows[0][1], text(3, 20), rows[2][1]])
    kept = jaccard_trees.keep_one(docs(spark, [*rows[1:], rows[1], (3, rows[1][1]), (4, rows[0][1])]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([*rows[1:], (4, rows[0][1])])


def test_pieces_equal_the_reference_library(spark):
    from codeatlas.llm import pieces as p
    tool = sentencepiece.SentencePieceProcessor(model_file=p.default_model())
    rows = [*ODD, (7, "  two   spaces " + " " * 45 + "z "), (8, "ü€😀 梦\n\t▁a ▁"), (9, "<s> </s> <0x41> <unk>"), (10, text(1, 200))]
    got = p.encode_pieces(docs(spark, rows), p.default_model()).collect()
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in got))) == sorted(map(str, ((i, tool.encode(t or "")) for i, t in rows)))
    assert all(r.round_trip for r in got if r.doc_id not in (8, 9))
    assert p.encode_pieces(docs(spark, []), p.default_model()).count() == 0


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline as c
    folder = "/root/testdata/sf0.001"
    read = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, read, folder).columns == read.columns, name


def test_ids_are_part_of_the_result(spark):
    import corpus_pipeline as c
    from codeatlas.llm import pieces as p
    folder = "/root/testdata/sf0.001"
    read = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    tool = sentencepiece.SentencePieceProcessor(model_file=p.default_model())
    want = {r.doc_id: tool.encode(r.text or "") for r in read.collect()}
    assert {r.doc_id: r.ids for r in c.encode(spark, read, folder).collect()} == want
    assert "ids" in p.op9(spark, folder).columns


def test_texts_with_a_common_passage_do_not_meet_in_one_large_group(spark, monkeypatch):
    from codeatlas.llm import jaccard_trees as j
    passage = text("passage", 40)
    rows = [(i, f"{passage} {text(i, 22)}") for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} {WORDS[i % 50]}") for i in range(0, 60, 4)] + [(200 + i, f"{text('copy', 70)} {WORDS[i % 50]}") for i in range(40)]
    rows += [rows[3], (3, text("other", 30)), (7, None), (300, ""), (None, passage)]
    compared = []
    linked = j._linked
    monkeypatch.setattr(j, "_linked", lambda found, *rest: compared.append(found.count()) or linked(found, *rest))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in j.jaccard_components(docs(spark, rows), k=4, percent=85, bins=40, rows=5, block_rows=8).collect()}
    sets = [(i, {tuple(w[s:s + 4]) for s in range(max(1, len(w) - 3))} if (w := (t or "").split()) else set()) for i, t in rows if i is not None]
    names = sorted({i for i, _ in sets})
    up = dict(zip(names, names))
    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 85 * len(x | y) and up[a] != up[b]:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {i: new if u == old else u for i, u in up.items()}
    assert all(got[i, len(x)] == (up[i] if x else i) for i, x in sets)
    assert sum(compared) < 2.5 * len(rows)
