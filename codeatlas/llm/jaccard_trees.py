"""N-gram Jaccard join by signature trees.

Texts meet in candidate groups, found by the smallest hashes of hash-range bins; inside a group a tree of OR-combined token
bitmaps and size ranges is joined with itself: a pair of nodes is followed only if the largest overlap its texts can have
reaches the threshold. Surviving pairs are compared exactly. Groups too large for one tree are dealt anew by the rarest members of their
texts, and what is still too large then is split into blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import _PLACE, components, is_empty, mix, runs, shingle_sets, table, text_blocks

BITS, FANOUT, SLOTS = 2048, 8, 1 << 18
BLOCK_CHARS, BLOCK_ROWS = 6_000_000, 2048


def bin_keys(sets: list[np.ndarray], bins: int, rows: int) -> list[np.ndarray]:
    """For each set one key per non-empty hash range: a hash of the range's ``rows`` smallest members."""
    sizes = [len(s) for s in sets]
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = owner * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rank = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))
    small = rank < rows
    place, terms = place[small], (h[small] + np.uint64(1)) * _PLACE[rank[small]]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    keys = mix(np.add.reduceat(terms, first) + (place[first] % bins).astype(np.uint64)) if len(first) else terms
    at = np.searchsorted(place[first] // bins, np.arange(len(sets) + 1))
    return [keys[at[i]:at[i + 1]] for i in range(len(sets))]


def _fingerprints(k: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            sets = shingle_sets(texts, k)
            keys = [x.astype(np.int64) for x in bin_keys(sets, bins, rows)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()),
                pa.array([int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()),
                pa.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5555))).astype(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "chars", "d1", "d2", "keys"])
    return run


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


class SignatureTree:
    """Sets ordered by size, with their bitmaps; level above level: OR of ``FANOUT`` nodes, their size range and label range."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
        self.sets = [sets[i] for i in self.order]
        self.percent = percent
        flags = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(self.sets):
            flags[i, (s % np.uint64(BITS)).astype(np.int64)] = True
        self.maps = [np.packbits(flags, axis=1).view(np.uint64)]
        size = np.array([len(s) for s in self.sets], np.int64)
        self.low, self.high = [size], [size]
        self.slack = [size - np.bitwise_count(self.maps[0]).sum(axis=1, dtype=np.int64)]
        while len(self.maps[-1]) > 1:
            at = np.arange(0, len(self.maps[-1]), FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.slack.append(np.maximum.reduceat(self.slack[-1], at))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Can a text below node i and one below node j be similar? Their overlap is at most the common bits and the members
        of one side that share a bit; it has to reach percent/(100+percent) of both sizes together."""
        p, low, high = self.percent, self.low[level], self.high[level]
        fits = (100 * high[i] >= p * low[j]) & (100 * high[j] >= p * low[i])
        out = np.zeros(len(i), bool)
        at = np.flatnonzero(fits)
        for s in range(0, len(at), 1 << 15):
            a = at[s:s + (1 << 15)]
            common = np.bitwise_count(self.maps[level][i[a]] & self.maps[level][j[a]]).sum(axis=1, dtype=np.int64)
            most = common + np.minimum(self.slack[level][i[a]], self.slack[level][j[a]])
            out[a] = (100 + p) * most >= p * (low[i[a]] + low[j[a]])
        return out

    def similar(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[at] == a).sum())
        return 100 * common >= self.percent * (len(a) + len(b) - common)

    def links(self, labels: list, sides: list[int] | None = None) -> Iterator[tuple[int, int]]:
        """Pairs of row numbers that are similar and were not in one component before: a spanning forest of all links.

        Rows of equal label are one component already. With ``sides`` only pairs with a row of side 1 are looked for.
        """
        n, order = len(self.sets), self.order
        forest, first = Forest(n), {}
        for i in range(n):
            forest.join(i, first.setdefault(labels[order[i]], i))
        side = np.array([sides[o] for o in order], bool) if sides else np.ones(n, bool)

        def check(i: int, j: int) -> bool:
            return forest.find(i) != forest.find(j) and self.similar(i, j) and forest.join(i, j)

        left = np.arange(n)
        for _ in range(4):   # a few texts against all: large components close here, and the traversal passes them by
            if len(left) < 2:
                break
            hub, rest = left[0], left[1:]
            good = rest[self.possible(0, np.full(len(rest), hub), rest) & (side[hub] | side[rest])]
            for j in good.tolist():
                if check(int(hub), j):
                    yield order[hub], order[j]
            left = np.array([j for j in rest.tolist() if forest.find(j) != forest.find(int(hub))], np.int64)
        root = np.array([forest.find(i) for i in range(n)], np.int64)
        low, high, any_side = [root], [root], [side]
        for level in range(1, len(self.maps)):
            at = np.arange(0, len(low[-1]), FANOUT)
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
            any_side.append(np.logical_or.reduceat(any_side[-1], at))
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.maps) - 1, -1, -1):
            one = (low[level][i] == high[level][i]) & (low[level][j] == high[level][j]) & (low[level][i] == low[level][j])
            open_ = ~one & (any_side[level][i] | any_side[level][j])
            i, j = i[open_], j[open_]
            ok = self.possible(level, i, j)
            i, j = i[ok], j[ok]
            if level:
                below = len(self.maps[level - 1])
                step = np.arange(FANOUT * FANOUT)
                i, j = (i[:, None] * FANOUT + step // FANOUT).ravel(), (j[:, None] * FANOUT + step % FANOUT).ravel()
                keep = (i <= j) & (j < below)
                i, j = i[keep], j[keep]
        for a, b in zip(i.tolist(), j.tolist()):
            if a != b and check(a, b):
                yield order[a], order[b]


def _link(k: int, percent: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, keys):
            ids, labels = group.column("doc_id").to_pylist(), group.column("label").to_pylist()
            sides = group.column("side").to_pylist()
            tree = SignatureTree(shingle_sets(group.column("text").to_pylist(), k), percent)
            pairs = [(ids[i], ids[j]) for i, j in tree.links(labels, None if all(sides) else sides) if ids[i] != ids[j]]
            yield pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], ["a", "b"])
    return run


def _held(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, texts in text_blocks(batches):
            for s in shingle_sets(texts, k):
                np.add.at(total, (s % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])
    return run


def _rarest(k: int, percent: int, held: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            sets = shingle_sets(texts, k)
            first = [s[np.lexsort((s, held[(s % np.uint64(SLOTS)).astype(np.int64)]))[:len(s) + 1 - -(-percent * len(s) // 100)]] for s in sets]
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(f) for f in first]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(np.concatenate(first).astype(np.int64))],
                                             ["grp", "doc_id", "member"])
    return run


def _by_rare_members(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, grp): groups cut into smaller ones without parting similar texts; rows: grp, doc_id, text.

    With members in any one order, two similar texts share one of their first n - ceil(percent * n / 100) + 1 members. The order is by the number of
    members in a member's slot, counted over all rows, so a common passage comes last and texts that have no more than it in common fall apart. The
    ``SLOTS`` counts are all that passes the driver; members that share a slot make groups larger at most. Texts that share no such member are left out.
    """
    counts = rows.select("text").mapInArrow(_held(k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(SLOTS, np.int64)
    held[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    rare = cut(rows.select("grp", "doc_id", "text").mapInArrow(_rarest(k, percent, held), "grp long, doc_id long, member long"), "rare")
    hubs = rare.groupBy("grp", "member").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").drop("last")
    pairs = rare.join(hubs, ["grp", "member"]).where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    return components(pairs, "rare-groups").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))


def _linked(rows: DataFrame, k: int, percent: int, keys: list[str]) -> DataFrame:
    """Links inside the groups named by ``keys``; rows: keys, doc_id, label, side, text."""
    grouped = rows.select(*keys, "doc_id", "label", "side", "text").repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_link(k, percent, keys), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, bins: int = 48, rows: int = 5,
                       block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_shingles, component_id): texts linked when 100 * |A and B| >= percent * |A or B| over distinct ``k``-word
    shingles (64-bit hashes); component_id is the smallest doc_id reachable.

    Two texts meet when one of ``bins`` hash ranges has the same ``rows`` smallest members: at a similarity s a pair is missed
    with probability (1 - s**rows)**bins (5e-9 at 0.8, 3e-13 at 0.85 for the defaults); small texts meet for certain while
    they differ in fewer members than they have ranges. No group, partner or candidate is capped: equal sets are one
    representative, a group beyond the block size is first dealt anew by rare members, which parts no similar texts, and one still beyond it is
    compared block by block, with what is already one component left out.

    Null or empty texts have no shingles and stay alone (component_id is their own doc_id); fewer than ``k`` words are one
    shingle; equal rows fall together; rows without doc_id get no component unless an equal text has one; other columns are not read.
    """
    prints = cut(docs.select("doc_id", "text").mapInArrow(
        _fingerprints(k, bins, rows), "doc_id long, n_shingles long, chars long, d1 long, d2 long, keys array<long>"), "prints")
    equal = ["n_shingles", "d1", "d2"]
    first = cut(prints.where("n_shingles > 0").groupBy(*equal).agg(F.min("doc_id").alias("rep")), "classes")
    named = prints.where("n_shingles > 0 AND doc_id IS NOT NULL").join(first.select("rep", *equal), equal).where("doc_id = rep")
    keyed = cut(named.select("doc_id", F.explode("keys").alias("key")), "keys")
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("key", "hub")
    pairs = keyed.join(hubs, "key").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    groups = cut(components(pairs, "candidates").select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "groups")
    chars = prints.groupBy("doc_id").agg(F.max("chars").alias("chars"))

    def in_blocks(groups: DataFrame) -> DataFrame:
        sizes = groups.join(chars, "doc_id").groupBy("grp").agg(
            F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("chars") / block_chars)).cast("int").alias("blocks"))
        return cut(groups.join(sizes, "grp").withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) AS int)")), "placed")

    # at every size one shuffle of all texts, and only of them: what follows reads the texts that have a candidate
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").hint("merge")
    texts = cut(texts.join(groups.select("doc_id"), "doc_id"), "candidate-texts")
    placed = in_blocks(groups)
    large = placed.where("blocks > 1")
    if not is_empty(large):
        placed = cut(placed.where("blocks = 1").unionByName(in_blocks(_by_rare_members(texts.join(large.select("doc_id", "grp"), "doc_id"), k, percent))), "placed")
    links = cut(_linked(texts.join(placed, "doc_id").withColumn("label", F.col("doc_id")).withColumn("side", F.lit(1)),
                        k, percent, ["grp", "block"]), "links")
    large = placed.where("blocks > 1")
    found = components(links, "linked")
    if not is_empty(large):
        found = _across(texts, large, found, k, percent, block_rows)
    classes = first.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", *equal).join(classes, equal, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", F.col("doc_id")).alias("component_id"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) of ``found`` once ``links`` are added: only the components that these join are gone through again."""
    to = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}2"))
    edges = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
    more = components(edges, "joined")
    moved = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return cut(moved.select("node", F.coalesce("least", "component").alias("component")).union(more.join(found, "node", "left_anti")), "joined")


def _across(texts: DataFrame, large: DataFrame, found: DataFrame, k: int, percent: int, block_rows: int) -> DataFrame:
    """Components (node, component) after linking across the blocks of groups that have several: first one text of each component with another,
    then every text outside its group's largest component with all blocks, so that no pair of different components is left unchecked."""
    for heads_only in (True, False):
        labels = found.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        known = cut(large.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "known")
        sizes = known.groupBy("grp", "label").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
        several = sizes.groupBy("grp").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"),
                                           F.sum("n").alias("all"), F.max("n").alias("most")).where("labels > 1")
        if is_empty(several):
            break
        if heads_only:
            heads = sizes.join(several, "grp").withColumn("part", F.expr(f"cast(pmod(xxhash64(head, 7L), ceil(labels / {block_rows})) AS int)"))
            rows = texts.join(heads.select(F.col("head").alias("doc_id"), "grp", "part", "label"), "doc_id").withColumn("side", F.lit(1))
            found = _joined(found, cut(_linked(rows, k, percent, ["grp", "part"]), "links"))
            continue
        open_ = known.join(several.withColumn("parts", F.expr(f"cast(ceil((all - most) / {block_rows}) AS int)")), "grp")
        rest = open_.where("label <> main").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id, 9L), parts) AS int)"))
        one = rest.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(1))
        other = open_.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("side", F.lit(0))
        cols = ["grp", "part", "block", "doc_id", "label", "side"]
        rows = texts.join(one.select(cols).union(other.select(cols)), "doc_id")
        found = _joined(found, cut(_linked(rows, k, percent, ["grp", "part", "block"]), "links"))
    return found


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """Documents without near copies: of each component the smallest doc_id stays, once. Rows without doc_id stay.

    A doc_id with different texts keeps each of them once, also one that has a near copy, so no text is lost with another one's component.
    """
    known = docs.where("doc_id IS NOT NULL").withColumn("_x", F.xxhash64("text"))
    shared = known.groupBy("doc_id").agg(F.min("_x").alias("low"), F.max("_x").alias("high")).where("low <> high").select("doc_id")
    drop = jaccard_components(docs, **settings).where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    kept = known.join(drop.join(shared, "doc_id", "left_anti"), "doc_id", "left_anti").dropDuplicates(["doc_id", "_x"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85, bins=40, rows=5)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*)))
"""
ORACLE_SQL = ORACLE.replace("WITH words", "WITH RECURSIVE words") + """,
reach AS (SELECT doc_id AS src, doc_id AS node FROM documents UNION SELECT r.src, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.node) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.src = d.doc_id GROUP BY d.doc_id, s.n
"""
