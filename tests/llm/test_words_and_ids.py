"""Rank-queue BPE against the tiktoken library, periodic runs and spelling variants against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = "".join(random.Random(5).choice("etaoinsrh") for _ in range(60000))
ODD = [(3, "The words, the words  and 12345 more's words\n\n\tof it."), (None, "no id at all"), (7, None), (1, ""), (5, "x"), (5, "x"), (9, "long " * 30000), (10, LONG),
       (4, "ü€😀 \n\t a ©Ãß ×÷ ÀÉÎ"), (8, "\u0085   \x1c x"), (11, "   "), (12, "a b a b a b a b c " * 3)]


def docs(spark, rows=ODD):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "w") for i, t in rows], "doc_id long, text string, ids string, n long, key int, word string")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    from codeatlas.llm import rank_queue
    return rank_queue.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_the_queue_is_empty_after_every_piece(bpe, library):
    rng = random.Random(1)
    for n in (2, 3, 17, 400, 5000, 30000):   # lists, and arrays from 4,096 on
        for letters in (b"ab", b"etaoin", bytes(range(256))):
            piece = bytes(rng.choices(letters, k=n))
            ids = bpe.merge(piece)
            assert b"".join(bpe.tokens[i] for i in ids) == piece and not any(bpe.words) and not any(bpe.buckets)
            if letters != bytes(range(256)):
                assert ids == library.encode_ordinary(piece.decode())


def test_bpe_equals_library_on_every_code_point_and_long_pieces(bpe, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 5000):
        text = "".join(f"a {c}{c} 1{c}." for c in points[start:start + 5000])
        ids = bpe.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and bpe.decode(ids).decode() == text
    rng = random.Random(2)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aéü😀", "  \n", "0123456789abcdef", "."):
        for n in (1, 2, 3, 40, 3000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_lower_ranks_made_by_a_merge(tmp_path):
    """A vocabulary in which a merged pair ranks below the pair that made it: the leftmost pair of lowest rank still goes first."""
    from codeatlas.llm.rank_queue import ByteBpe
    import tiktoken
    rng = random.Random(4)
    for _ in range(40):
        tokens = [bytes([c]) for c in range(256)] + list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(30)})
        merges = tokens[256:]
        rng.shuffle(merges)
        ranks = {t: i for i, t in enumerate(tokens[:256] + merges)}
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        mine, other = ByteBpe(str(path), public_tokenizers.PATTERN), tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(20):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
            assert mine.encode(text).tolist() == other.encode_ordinary(text)


def test_bpe_keeps_frequent_pieces_within_its_bound(monkeypatch):
    from codeatlas.llm import rank_queue
    monkeypatch.setattr(rank_queue, "KEPT", 8)
    tool = rank_queue.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = " ".join(f"qx{i}zz word" for i in range(100))
    assert tool.decode(tool.encode(text)).decode() == text and len(tool.kept) <= 8 and len(tool.kept.older) <= 8


def test_bpe_query(spark, library):
    from codeatlas.llm import rank_queue
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = rank_queue.encode_bytes(docs(spark), path, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id or -1), list(r.ids)) for r in ids.collect()) == sorted((i or -1, library.encode_ordinary(t or "")) for i, t in ODD)
    back = rank_queue.decode_bytes(ids, path, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in back.collect()) == sorted((i or -1, t or "") for i, t in ODD)
    assert rank_queue.encode_bytes(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0
    assert rank_queue.decode_bytes(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path, public_tokenizers.PATTERN).first().decoded == b""
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        found = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = rank_queue.op11(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    from codeatlas.llm import periodic_runs as p
    rng, total = random.Random(1), 0
    for _ in range(1500):
        words = []
        for _ in range(rng.randint(0, 6)):
            period = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            words += (period * rng.randint(1, 9))[:rng.randint(1, 60)]
            if rng.random() < 0.4:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]
        want = slow_runs(words)
        total += len(want)
        assert p.word_runs(words) == want
        dropped = {k for s, n, q in want for k in range(s + q, s + n)}
        assert list(p.kept_words(words, want)) == [w for k, w in enumerate(words) if k not in dropped]
    assert total > 1000


def test_segments_hold_frequent_words_only_and_are_maximal():
    from codeatlas.llm import periodic_runs as p

    def slow(words, start):
        rare = [i for i, w in enumerate(words) if Counter(words)[w] < 4]
        if not rare:
            return [(start, start + len(words))] if len(words) >= 6 else []
        edges = [-1, *rare, len(words)]
        return [x for a, b in zip(edges, edges[1:]) for x in slow(words[a + 1:b], start + a + 1)]

    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcdefghijkl"[:rng.randint(2, 12)]) for _ in range(rng.randint(0, 90))]
        assert sorted(p.splits(words)) == slow(words, 0)


def test_long_texts_and_deep_splitting_end_soon():
    import time
    from codeatlas.llm import periodic_runs as p
    start = time.time()
    assert p.word_runs(["a"] * 300000) == [(0, 300000, 1)]
    assert p.word_runs([str(i % 700) for i in range(300000)]) == [(0, 300000, 700)]
    peeled = [w for k in range(40000) for w in (f"w{k}", f"w{k + 1}", f"w{k + 2}", f"w{k + 3}")]   # each level takes a few words off the ends
    assert p.word_runs(peeled) == []
    assert time.time() - start < 60


def slow_row(name, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(name).encode())
    if name is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(words)
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_runs_query(spark, tmp_path):
    from codeatlas.llm import periodic_runs as p
    rows = [(i, t) for i, t in ODD if i not in (9, 10)] + [(100 + i, f"w{i % 3} b c d e f g h i {i % 4} " * (i % 6)) for i in range(300)] + [
        (r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2000").collect()]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = p.op12(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"),
                          ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [(i, *slow_row(i, t)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 30
    found = {r.doc_id: r for r in p.document_runs(docs(spark)).collect()}
    assert [tuple(r) for r in found[9].runs] == [(0, 30000, 1)] and found[9].collapsed == "long" and found[9].n_words == 30000
    assert found[7].n_runs == 0 and found[7].collapsed == "" and found[11].n_words == 0 and [tuple(r) for r in found[12].runs] == [(0, 8, 2), (9, 8, 2), (18, 8, 2)]
    assert p.document_runs(docs(spark, [])).count() == 0


def slow_variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return slow_forms({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def slow_forms(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    groups = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            groups[w[:k] + w[k + 1:]].add(w)
        groups[w].add(w)
    found = {w: {v for k in [w, *(w[:k] + w[k + 1:] for k in range(len(w)))] for v in groups[k] if near(w, v)} for w in words}
    forms = {w: m for w, n in words.items() if found[w] and words[m := min(found[w], key=lambda v: (-words[v], v))] >= 10 * n}
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(found[w]), words.get(forms.get(w))))
    return out


def test_variants_equal_brute_force(spark):
    """Words made of few letters, so that bigrams repeat, tie and overlap; counts that make chains of forms."""
    from codeatlas.llm import spelling as s
    rng, words = random.Random(3), {}
    for _ in range(400):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        words[w] = words.get(w) or 10 ** rng.randint(1, 5)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abéz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1:]])
            if len(v) >= 7:
                words.setdefault(v, rng.randint(1, 10 ** rng.randint(1, 5)))
    words |= {"a" * n: 10 ** (n - 6) for n in range(7, 16)}   # eight steps to the last form
    got = s.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = slow_forms(words)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(w != r and f != r for w, f, r, *_ in want) and ("a" * 7, "a" * 8, "a" * 15, 10, 1, 100) in want


def test_variants_query(spark, tmp_path):
    from codeatlas.llm import spelling as s
    rows = ODD + [(i + 50, "receive recieve Receive reÇeive receives " * 3 + " ".join(rng for rng in ("necessary", "neccessary"))) for i in range(60)] + [
        (r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = s.op13(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == slow_variants(rows) and len(found) == len(set(found))
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert s.op13(spark, str(tmp_path / "none")).count() == 0
    assert s.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_counting_words_passes_on_what_it_holds(spark, monkeypatch):
    from codeatlas.llm import spelling as s
    rows = [(i, f"alphabet alphabet {'q' * (7 + i % 5)}") for i in range(50)]
    whole = {tuple(r) for r in s.word_counts(docs(spark, rows)).collect()}
    monkeypatch.setattr(s, "HELD", 1)
    assert {tuple(r) for r in s.word_counts(docs(spark, rows)).collect()} == whole and ("alphabet", 100) in whole


def test_meetings_stay_few(spark):
    """A thousand words with one beginning meet by half of what follows too, not all with all."""
    from codeatlas.llm import spelling as s
    rng = random.Random(8)
    words = {"inter" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1000)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    ranks = s.gram_ranks(frame)
    look, found = Counter(), Counter()
    for w in words:
        _, a, b = s.index_keys(w, ranks)
        look.update(a)
        found.update(b)
    assert sum(n * found[k] for k, n in look.items()) < 20 * len(words)
    assert s.near_pairs(frame).where(F.levenshtein("a", "b") != 1).count() == 0
