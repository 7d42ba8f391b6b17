"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered by how few words hold them. Its prefix is the three rarest (with all that tie with the third): one edit destroys
two bigrams at most. Of the prefix two disjoint bigrams, the pivots, are chosen by dynamic programming so that they are rarest together. One edit
destroys at most one of two disjoint bigrams, so of two near words the one whose prefix ends earlier has a pivot in the other's prefix.

Position limits make the look-ups exact on most of a word. Either the first pivot stands with the edit behind it, so both words begin alike up to the
end of that pivot; or the second stands with the edit before it, so both end alike from there. The other side of the pivot is halved: the edit is in
one half, so the other is equal too. An index key is therefore a pivot with all that stands on its far side and half of what stands on the near one,
not a bigram alone, and words meet only if they are equal in more than half of their letters. Spark's bounded edit distance verifies each meeting.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, is_empty
from .common import table

SHORTEST, LEAST, RATIO = 7, 2, 10   # letters and occurrences of a word, and the factor by which its form is more frequent
PREFIX = 3   # bigrams: two that an edit can destroy and one more
HELD = 1 << 18   # words that a task counts before it passes them on: bounds its memory


def word_counts(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """(word, n): occurrences, in all whole texts, of the words of ``shortest`` or more code points: maximal runs
    ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased. Counted in each task before the shuffle, so a frequent word is one row a task.

    ``plant`` takes one letter from every 31st word, chosen by document and word. Null and empty texts hold no words; equal rows count each;
    a null doc_id is written as nothing; an empty table gives an empty one; other columns are not read.
    """
    letters = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % shortest)

    def planted(name: int | None, counts: Counter) -> Counter:
        seed = zlib.crc32(f"{'' if name is None else name}:".encode())
        out = Counter()
        for word, n in counts.items():
            h = zlib.crc32(word.encode(), seed)
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < shortest:
                    continue
            out[word] += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    # Lower-casing bytes changes A-Z only.
                    counts = Counter(letters.findall(text.encode("utf-8", "replace").lower().decode()))
                    held.update(planted(name, counts) if plant else counts)
                    if len(held) >= HELD:
                        yield rows()
                        held.clear()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Each bigram's place when ordered by the number of words that hold it, rarest first, ties by the bigram. Words have 90 letters in all, so
    there are at most 8,100 rows whatever the table."""
    grams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))"))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("words")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["words"], r["gram"])))}


def pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """The two disjoint bigrams, of those at ``places`` (ascending), that cost least together: from left to right, the best one that ends
    before each place is carried along. Ties go to the leftmost."""
    best, pair, carried, k = None, (places[0], places[-1]), None, 0
    for at, cost in zip(places, costs):
        while places[k] <= at - 2:
            if carried is None or costs[k] < carried[0]:
                carried = (costs[k], places[k])
            k += 1
        if carried is not None and (best is None or carried[0] + cost < best):
            best, pair = carried[0] + cost, (carried[1], at)
    return pair


def _halves(word: str, near: int, other: int, front: bool) -> tuple[str, str]:
    """The two keys of a bigram that ends (``front``: the edit is behind it) or begins at ``near``, for a word of ``other`` letters. The words are
    equal on the far side of the bigram and in one half of the rest, which is as long as in that word."""
    if front:
        rest = other - near
        first = rest // 2
        return f"<{near}|{word[:near + first]}", f">{near}|{word[:near]}|{word[len(word) - (rest - first):]}"
    # Counted from the end; ``near`` is the length of the equal ending.
    rest = other - near
    last = rest // 2
    end = word[len(word) - near:]
    return f"[{near}|{word[len(word) - near - last:]}", f"]{near}|{end}|{word[:rest - last]}"


def index_keys(word: str, ranks: dict[str, int]) -> tuple[int, list[str], list[str]]:
    """(last rank of the prefix, keys the pivots look up, keys the prefix is found by)."""
    n = len(word)
    order = [ranks[word[i:i + 2]] for i in range(n - 1)]
    last = sorted(order)[min(PREFIX, n - 1) - 1]
    places = [i for i, r in enumerate(order) if r <= last]
    first, second = pivots(places, [order[i] for i in places])
    look = [*_halves(word, first + 2, n, True), *_halves(word, n - second, n, False)]
    found = set()
    for at in places:
        for other in (n - 1, n, n + 1):   # lengths that a near word can have
            if at + 2 <= min(n, other):
                found.update(_halves(word, at + 2, other, True))
            if n - at <= min(n, other):
                found.update(_halves(word, n - at, other, False))
    return last, look, sorted(found)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of different words of the column ``word`` (distinct, each of four letters or more) that one inserted, deleted or replaced
    letter tells apart, each in both directions."""
    ranks = words.sparkSession.sparkContext.broadcast(gram_ranks(words))   # at most 8,100 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = []
                for word in batch.column(0).slice(start, 4096).to_pylist():
                    last, look, found = index_keys(word, ranks.value)
                    rows += [(key, word, last, True) for key in look] + [(key, word, last, False) for key in found]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["key", "word", "last", "pivot"]).astype({"last": np.int32}), preserve_index=False)

    keys = words.select("word").mapInArrow(run, "key string, word string, last int, pivot boolean")
    keys = cut(keys.withColumn("key", F.xxhash64("key")), "spelling-keys")   # words that meet by chance fail the verification, so a hash will do
    look = keys.where("pivot").select("key", F.col("word").alias("a"), F.col("last").alias("a_last"))
    found = keys.where("NOT pivot").select("key", F.col("word").alias("b"), F.col("last").alias("b_last"))
    met = look.join(found, "key").where("a_last <= b_last AND a <> b AND abs(length(a) - length(b)) <= 1").where(F.levenshtein("a", "b", 1) == 1)
    return met.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): forms are followed to the last, twice as far in each round. Each form occurs ten times as often as
    its word, so chains are short: five rounds reach 32 forms, more than any count of 64 bits allows."""
    root = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = root.join(root.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        step = cut(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        root = step.select("word", "root")
        if is_empty(step.where("moved")):
            return root


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the rows (word, n), words being distinct and of seven letters or more: how many words are near, the
    most frequent of them (ties: the smallest) if it occurs ``ratio`` times as often, and where following such forms ends."""
    words = cut(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    out = words.join(best.withColumnRenamed("a", "word"), "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"if(-best.minus >= {ratio} * n, best.form, null) AS form",
        f"if(-best.minus >= {ratio} * n, -best.minus, null) AS form_n")
    out = cut(out, "spelling-forms")
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of seven letters and two occurrences or more in all whole texts."""
    return variants(word_counts(table(spark, sf_dir, "documents"), plant=True).where(F.col("n") >= LEAST))
