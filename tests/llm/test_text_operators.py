"""Operators on single texts against brute force on small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [(3, "An odd text, with some words in it."), (None, "no id"), (7, None), (1, ""), (5, "x"), (5, "x"), (9, "long " * 30000), (4, "ü€😀 \n\t a"), (8, "An odd text, with some words in it!")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, n_tokens int")


def test_piecewise_neighbours_and_likeness(spark):
    from codeatlas.llm import piecewise as p
    rows = [(i, f"{'ab' * (i % 7)} text {i} " * (i % 40)) for i in range(300)] + [(777, None)]
    got = {r.doc_id: r for r in p.document_fingerprints(docs(spark, rows), 6).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == p.fingerprints([text])[0] and got[i].edited_fingerprint == p.fingerprints([new])[0]
        assert 0 <= got[i].near_next <= 1
    assert p.document_fingerprints(docs(spark)).count() == len(ODD)
    assert p.document_fingerprints(docs(spark, [])).count() == 0
    assert p.document_fingerprints(docs(spark, [(1, "one")])).first().near_next == 1.0


def test_edit_distance_brute_force():
    from codeatlas.llm import piecewise as p

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ABCa/"), n)) for n in [*rng.integers(0, 65, 200), 64, 64, 0, 0]]
    left, right = words, words[::-1]
    assert p.edit_distances(left, right).tolist() == [slow(a, b) for a, b in zip(left, right)]


def test_piecewise_signatures_cover_the_whole_text():
    from codeatlas.llm import piecewise as p
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    text = "".join(rng.choice(list("ab"), 6000)) + "the same line of junk\n" * 400 + draw(4000)
    other = text[:len(text) - 4000] + draw(4000)
    one, two = p.fingerprints([text, other])
    assert all(x != y for x, y in zip(one.split(":")[1:], two.split(":")[1:]))
    assert 0 < p.likeness([one], [two])[0] < 1
    row = lambda a, b: p.edit_distances([a], [b])[0]
    words = ["".join(rng.choice(list("ABCa/"), n)) for n in (0, 3, 64, 65, 130, 400)]
    for a in words:
        for b in words:
            last = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                now = [i]
                for j, y in enumerate(b, 1):
                    now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
                last = now
            assert row(a, b) == last[-1]


def test_huffman_round_trip(spark, tmp_path):
    from codeatlas.llm import huffman_ids as h
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    for rows in (ODD, []):
        place = f"{tmp_path}/{len(rows)}"
        h.write_ids(h.cut(h.token_ids(docs(spark, rows), path)), place)
        want, at = [], 0
        for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
            ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = [tuple(r) for r in h.digests(h.read_ids(spark, place)).orderBy("start").collect()]
        assert got == want


def test_code_lengths_are_optimal_and_bounded():
    from codeatlas.llm import huffman_ids as h
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0])
    assert h.code_lengths(counts).tolist() == [8, 8, 7, 6, 5, 4, 3, 2, 1, 0]
    short = h.code_lengths(counts, 4)
    assert short.max() <= 4 and sum(2.0 ** -x for x in short[:-1]) == 1
    big = np.random.default_rng(2).zipf(1.3, 49408) % 10**9
    assert h.code_lengths(big).max() <= h.LIMIT
    assert h.code_lengths(np.zeros(3, np.int64)).tolist() == [0, 0, 0]


def test_urls(spark):
    from codeatlas.llm import url_filter as u
    urls = ["http://A.Example.ORG/en/12?x#y", "https://example.org/es/a", "http://notexample.org/es/", "http://org", "http://x.com/DE/", "http://x.com/de/", "ftp://x.net/ads/1",
            "http://x.net/about/login", "http://x.net/loads/1", None, "", "no url", "http://", "http://x.net?q=/ads/", "http://badexample.org/en/1", "http://x.com/fr/" + "a" * 50000]
    pages = spark.createDataFrame([(i, x, "h", 0) for i, x in enumerate(urls)], "page_id long, url string, html string, rule int")
    got = {r.page_id: tuple(r)[1:] for r in u.filter_urls(pages).collect()}
    assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block", None)
    assert got[1][2:4] == ("example.org/es/", "block") and got[2][2:4] == ("org/", "allow") and got[3] == ("org", "", None, "allow", None)
    assert got[4] == ("x.com", "/DE/", None, "allow", None) and got[5][3] == "block" and got[6][3:] == ("block", "^ads^")
    assert got[7][3:] == ("allow", "^about^login^") and got[8][3:] == ("allow", None) and got[9] == got[10] == got[11] == ("", "", None, "allow", None)
    assert got[13] == ("x.net", "", None, "block", "^ads^") and got[14][2] == "org/" and got[15][2] == "com/fr/"
    assert u.filter_urls(pages.limit(0)).count() == 0
    rules = u._rules(u.HOST_RULES, u.PATTERNS)
    for i, x in enumerate(urls):   # every rule run on every url, without the index
        host, path = u.split_url(x)
        fits = [r for r in rules if x is not None and r[3].search(host + path if r[0] == "host" else x.lower())]
        best = max((r for r in fits if r[0] == "host"), key=lambda r: len(r[2]), default=None)
        assert got[i][2] == (best and best[2])


def test_secrets_against_regular_expressions(spark):
    import re
    from codeatlas.llm import secrets as s
    texts = ['Password = "abcdefg" tokenX:=1 api_key:\'abcdef', "AKIA" + "A" * 16 + " AKIA12", "f" * 24 + "g" + "0" * 23, "ü token=aaaaa secret=é", None, "", "secret:secret:abcdef token=token=token=", "x" * 100000 + " passwd: abc.def"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in s.find_secrets(docs(spark, rows)).collect()}
    rules = [("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24)]
    for i, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
    assert s.find_secrets(docs(spark, [])).count() == 0
    assert docs(spark).where(F.lit(False)).count() == 0
