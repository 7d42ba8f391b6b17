"""Graph operators as frontier loops.

Each round is a join of the frontier with the edges and an anti-join with what is known, written to the checkpoint
folder, so lineage stays flat and a lost executor costs one round. Rounds equal the longest shortest path (or the
depth named per operator); the only driver action inside is the test for an empty frontier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut, is_empty, together
from .ordered import ranked, running_sum


def nodes_of(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.select(*by, F.col("src").alias("node")).union(edges.select(*by, F.col("dst").alias("node"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, node): nodes reachable from each seed (column node; default every node), itself included.

    Output grows with the number of reachable pairs: seed it, or scope it with ``by`` (a part, a review).
    """
    e = cut(edges.where("src <> dst").select(*by, "src", "dst").distinct(), "edges")
    start = seeds.select(*by, "node").distinct() if seeds is not None else nodes_of(edges, by)
    frontier = cut(start.select(*by, F.col("node").alias("src"), "node"), "reach")
    known = [frontier]
    step = e.select(*by, F.col("src").alias("node"), F.col("dst").alias("_next"))
    while True:
        new = (frontier.join(step, [*by, "node"]).select(*by, "src", F.col("_next").alias("node")).distinct()
               .join(together(known), [*by, "src", "node"], "left_anti"))
        frontier = cut(new, "reach")
        if is_empty(frontier):
            return together(known)
        known.append(frontier)


def reach_count(edges: DataFrame, by: Sequence[str] = (), seeds: DataFrame | None = None) -> DataFrame:
    """(by, node, reach): how many nodes each node (or each of ``seeds``, column node) reaches, itself included."""
    return reach(edges, seeds, by).groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("reach"))


def up_down(edges: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, node, side): everything downstream and upstream of the seeds, walked separately."""
    down = reach(edges, seeds, by).withColumn("side", F.lit("down"))
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return down.unionByName(reach(back, seeds, by).withColumn("side", F.lit("up")))


def routes(edges: DataFrame, entries: DataFrame, reach_of: DataFrame, by: Sequence[str] = ("part",)) -> tuple[DataFrame, DataFrame]:
    """(trunk, spurs) of each entry (by, line_id, node).

    Trunk: from the entry, again and again the unvisited callee reaching most (smallest node on ties).
    Spurs: along the trunk, every unvisited callee with its own best unvisited callee. trunk: (by, line_id, pos, node);
    spurs: (by, line_id, pos, node, second) in drawing order, second may be null.

    The best callee of a function is the same on every trunk until one comes back to itself, so trunks are drawn by doubled jumps along best
    callees: rounds grow with the logarithm of their length. Only trunks that met a circle go on station by station, past what they visited.
    """
    key = [*by, "line_id"]
    weight = reach_of.select(*by, F.col("node").alias("dst"), "reach")
    e = cut(edges.where("src <> dst").select(*by, "src", "dst").distinct().join(weight, [*by, "dst"]), "callees")
    jump = cut(e.groupBy(*by, F.col("src").alias("node")).agg(F.expr("min_by(dst, struct(-reach, dst))").alias("to")), "jump")
    trunk, span = [cut(entries.select(*key, F.lit(0).alias("pos"), "node"), "trunk")], 1
    while True:
        known = together(trunk)
        ahead = known.join(jump, [*by, "node"]).select(*key, (F.col("pos") + span).alias("pos"), F.col("to").alias("node"))
        new = cut(ahead.groupBy(*key, "node").agg(F.min("pos").alias("pos")).join(known.select(*key, "node"), [*key, "node"], "left_anti")
                  .select(*key, "pos", "node"), "trunk")
        if is_empty(new):
            break
        trunk.append(new)
        on = jump.select(*by, F.col("node").alias("to"), F.col("to").alias("_to"))
        jump = cut(jump.join(on, [*by, "to"]).select(*by, "node", F.col("_to").alias("to")), "jump")
        span *= 2
    last = together(trunk).groupBy(*key).agg(F.max_by("node", "pos").alias("node"), F.max("pos").alias("pos"))
    while True:
        seen = together(trunk).select(*key, F.col("node").alias("dst"))
        nxt = (last.withColumnRenamed("node", "src").join(e, [*by, "src"]).join(seen, [*key, "dst"], "left_anti")
               .groupBy(*key, "pos").agg(F.expr("min_by(dst, struct(-reach, dst))").alias("node")))
        last = cut(nxt.select(*key, (F.col("pos") + 1).alias("pos"), "node"), "trunk")
        if is_empty(last):
            break
        trunk.append(last)
    drawn = together(trunk)
    # spur candidates in drawing order; a candidate may be decided when no earlier undecided one shares a node with it
    cand = drawn.withColumnRenamed("node", "src").join(e, [*by, "src"]).groupBy(*key, F.col("dst").alias("node")).agg(
        F.min(F.struct("pos", -F.col("reach"), "dst")).alias("order"))
    todo = cut(cand.join(drawn.select(*key, "node"), [*key, "node"], "left_anti"), "spurs")
    seen, spurs = [drawn.select(*key, "node")], []
    callee = e.select(*by, F.col("src").alias("node"), F.col("dst").alias("callee"), "reach")
    while not is_empty(todo):
        taken = together(seen)
        free = (todo.join(callee, [*by, "node"]).where("callee <> node")
                .join(taken.withColumnRenamed("node", "callee"), [*key, "callee"], "left_anti"))
        touch = todo.select(*key, "node", "order", F.col("node").alias("touched")).unionByName(
            free.select(*key, "node", "order", F.col("callee").alias("touched")))
        first = touch.groupBy(*key, "touched").agg(F.min("order").alias("_first"))
        ready = touch.join(first, [*key, "touched"]).groupBy(*key, "node", "order").agg(
            F.min(F.expr("order = _first")).alias("ok")).where("ok").drop("ok")
        second = free.groupBy(*key, "node").agg(F.expr("min_by(callee, struct(-reach, callee))").alias("second"))
        done = cut(ready.join(second, [*key, "node"], "left"), "spurs")
        spurs.append(done)
        seen.append(done.select(*key, "node"))
        seen.append(done.where("second IS NOT NULL").select(*key, F.col("second").alias("node")))
        todo = cut(todo.join(together(seen[-2:]), [*key, "node"], "left_anti"), "spurs")
    out = together(spurs) if spurs else todo.withColumn("second", F.col("node"))
    return drawn, out.select(*key, F.col("order.pos").alias("pos"), "node", "second")


def route_rows(trunk: DataFrame, spurs: DataFrame, reach_of: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """(by, line_id, entry, stations, drawn, reach, more): one row per route; ``more`` = reach not drawn."""
    key = [*by, "line_id"]
    t = trunk.groupBy(*key).agg(F.count("*").alias("stations"), F.min_by("node", "pos").alias("entry"))
    s = spurs.groupBy(*key).agg((F.count("node") + F.count("second")).alias("off"))
    r = reach_of.select(*by, F.col("node").alias("entry"), "reach")
    return t.join(s, key, "left").join(r, [*by, "entry"]).selectExpr(
        *key, "entry", "stations", "stations + coalesce(off, 0) AS drawn", "reach", "reach - stations - coalesce(off, 0) AS more")


def min_label(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, label): the smallest label among the nodes a node is reachable from, itself included.
    labels: (by, node, label). Only improved nodes go into the next round."""
    e = cut(edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("_next")).distinct(), "edges")
    best = cut(labels.groupBy(*by, "node").agg(F.min("label").alias("label")), "labels")
    frontier = best
    while True:
        offer = frontier.join(e, [*by, "node"]).groupBy(*by, F.col("_next").alias("node")).agg(F.min("label").alias("_offer"))
        better = cut(offer.join(best, [*by, "node"], "left").where("label IS NULL OR _offer < label").select(
            *by, "node", F.col("_offer").alias("label")), "offers")
        if is_empty(better):
            return best
        best = cut(best.unionByName(better).groupBy(*by, "node").agg(F.min("label").alias("label")), "labels")
        frontier = better


# ---- orders -------------------------------------------------------------------------------------------
def entry_class(functions: DataFrame) -> DataFrame:
    """Adds ``entry``: 0 main, cmd/, handlers; 1 exported; 2 private; 3 query. functions: (name, file, kind)."""
    rule = ("CASE WHEN kind <=> 'query' THEN 3 WHEN name = 'main' OR contains(concat('/', file), '/cmd/') OR "
            "name rlike '(?i)^(handle|serve)' OR (contains(name, '(') AND NOT startswith(name, '(closure')) THEN 0 "
            "WHEN startswith(name, '_') OR (endswith(file, '.go') AND NOT left(name, 1) rlike '^\\\\p{Lu}') THEN 2 ELSE 1 END")
    return functions.withColumn("entry", F.expr(rule))


def flow_roots(functions: DataFrame, calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, entry, reach, rank): functions no reviewed function calls, entry points first, then the ones reaching most,
    then by place. calls: (src, dst)."""
    called = calls.select(*by, F.col("dst").alias("fn_id")).distinct()
    roots = entry_class(functions).join(called, [*by, "fn_id"], "left_anti")
    roots = cut(roots, "roots")
    counts = reach_count(calls, by, roots.select(*by, F.col("fn_id").alias("node"))).withColumnRenamed("node", "fn_id")
    r = roots.join(counts, [*by, "fn_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(1)))
    in_order = ranked(r, by, ["entry", "-reach", "file", "start", "fn_id"])
    return in_order.select(*by, "fn_id", "entry", "reach", "rank")


def flow_order(functions: DataFrame, calls: DataFrame, roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, depth, via, pos): every function once, depth first along calls from the roots, then the rest by place;
    ``depth`` and ``via`` (the caller that first reaches it), ``pos`` the reading position. calls: (src, dst, pos), pos = order of the calls in src.

    A depth-first walk visits below its first child everything reachable from it, below the next one what is left,
    and so on: so one level of the walk is a smallest-label propagation, done for all subtrees of all reviews at
    once, restricted to each subtree without its top. Levels repeat to the depth of the walk. Nothing is gathered:
    a review of any size is spread over all tasks, and subtrees are numbered in buckets of their order.
    """
    fns = functions.select(*by, "fn_id", "file", "start")
    placed_first = fns.join(roots.select(*by, "fn_id", F.col("rank").alias("_root")), [*by, "fn_id"], "left")
    edges = cut(calls.where("src <> dst").groupBy(*by, "src", "dst").agg(F.min("pos").alias("pos")), "calls")
    # level 0: every function is a child of the review itself; roots come first, then places
    first = placed_first.select(*by, "fn_id", F.struct(F.col("_root").isNull().alias("a"), F.coalesce("_root", F.lit(0)).alias("b"),
                                                 "file", "start", F.col("fn_id").alias("id")).alias("label"))
    group = cut(first.select(*by, F.lit(None).cast(functions.schema["fn_id"].dataType).alias("top"),
                             F.lit(0).cast("bigint").alias("offset"), "fn_id", "label"), "level")
    out, depth = [], 0
    while True:
        members = group.select(*by, "top", "offset", "fn_id")
        inside = (edges.join(group.select(*by, F.col("fn_id").alias("src"), F.col("top").alias("_t")), [*by, "src"])
                  .join(group.select(*by, F.col("fn_id").alias("dst"), F.col("top").alias("_u")), [*by, "dst"])
                  .where("_t <=> _u").select(*by, "src", "dst", "pos"))
        # groups are divided further level by level, so later levels need only the edges inside this one's
        inside = edges = cut(inside.distinct(), "inside")
        label = min_label(inside.select(*by, "src", "dst"), group.where("label IS NOT NULL").select(*by, F.col("fn_id").alias("node"), "label"), by)
        claimed = members.join(label.withColumnRenamed("node", "fn_id"), [*by, "fn_id"])
        # the owner of a label is the child that carries it; its subtree starts after the earlier ones'
        # (the tops of a level are numbered per top by counting, label by label)
        sizes = claimed.groupBy(*by, "top", "offset", "label").agg(F.count("*").alias("size"))
        # coarser than the labels and never falling along them: roots and calls have a number each, the rest only a place
        bucket = F.struct("label.a", F.expr("label.b div 1024"), F.expr("if(label.a, coalesce(left(label.file, 24), ''), '')"))
        summed = running_sum(sizes.withColumn("_bucket", bucket).withColumn("_top", F.coalesce(F.col("top").cast("string"), F.lit(""))),
                             [*by, "_top"], "_bucket", ["label"], "size", "upto")
        placed = cut(summed.withColumn("start_at", F.col("offset") + F.col("upto") - F.col("size"))
                     .select(*by, "top", "label", "start_at", F.col("label.id").alias("owner")), "placed")
        out.append(placed.select(*by, F.col("owner").alias("fn_id"), F.lit(depth).alias("depth"), F.col("top").alias("via"),
                                 F.col("start_at").alias("pos")))
        below = claimed.select(*by, "fn_id", "label").join(placed.select(*by, "label", "owner", "start_at"), [*by, "label"]).where(
            "fn_id <> owner").select(*by, F.col("owner").alias("top"), (F.col("start_at") + 1).alias("offset"), "fn_id")
        kids = edges.select(*by, F.col("src").alias("top"), F.col("dst").alias("fn_id"), F.struct(
            F.lit(False).alias("a"), F.col("pos").cast("int").alias("b"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"),
            F.col("dst").alias("id")).alias("label"))
        group = cut(below.join(kids, [*by, "top", "fn_id"], "left").select(*by, "top", "offset", "fn_id", "label"), "level")
        depth += 1
        if is_empty(group):
            return together(out)


Pass = list[tuple[DataFrame, DataFrame, DataFrame]]


def eliminate(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> tuple[Pass, DataFrame, bool]:
    """Takes the nodes of a graph away in rounds, so that longest paths and ways between those left stay as they were.

    A node with one edge in or one out can go if its neighbours' edges are joined: their number does not grow. In a round all nodes without
    edges in go, and of the others with at most one on a side those that come before their neighbours in a random order. So rounds are never more than the
    longest path has nodes, and on chains, trees and rings they grow with the logarithm of the size.

    Returns the rounds as (nodes (by, node, base), edges in (by, node, other, w), edges out), base being the longest path that ends there among
    nodes taken before; the edges left, between nodes with two or more on both sides; and whether a circle was met.
    """
    e = cut(edges.where("src <> dst").select(*by, "src", "dst").distinct().withColumn("w", F.lit(1)), "edges")
    left = cut(nodes.select(*by, "node", F.lit(0).alias("base")), "nodes")
    rounds, made = [], []
    while True:
        into = e.groupBy(*by, F.col("dst").alias("node")).agg(F.count("*").alias("_in"))
        outof = e.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("_out"))
        able = left.join(into, [*by, "node"], "left").join(outof, [*by, "node"], "left").where("_in IS NULL OR _in = 1 OR coalesce(_out, 0) <= 1").select(
            *by, "node", "base", F.struct(F.col("_in").isNotNull().alias("a"), F.xxhash64("node", F.lit(len(rounds))).alias("h"), "node").alias("turn"))
        able = cut(able, "able")
        ends = lambda side: able.select(*by, F.col("node").alias(side), F.col("turn").alias(f"_{side}"))
        late = e.join(ends("src"), [*by, "src"]).join(ends("dst"), [*by, "dst"]).select(*by, F.greatest("_src", "_dst").alias("turn")).select(
            *by, "turn.node").distinct()
        gone = cut(able.drop("turn").join(late, [*by, "node"], "left_anti"), "gone")
        if is_empty(gone):
            return rounds, e, bool(made) and not is_empty(together(made).where("src = dst"))
        ins = e.withColumnRenamed("dst", "node").join(gone.select(*by, "node"), [*by, "node"], "left_semi").select(*by, "node", F.col("src").alias("other"), "w")
        outs = e.withColumnRenamed("src", "node").join(gone.select(*by, "node"), [*by, "node"], "left_semi").select(*by, "node", F.col("dst").alias("other"), "w")
        rounds.append((gone, ins, outs))
        joined = ins.select(*by, "node", F.col("other").alias("src"), F.col("w").alias("_w")).join(outs, [*by, "node"]).select(
            *by, "src", F.col("other").alias("dst"), (F.col("_w") + F.col("w")).alias("w"))
        rest = e.join(gone.select(*by, F.col("node").alias("src")), [*by, "src"], "left_anti").join(gone.select(*by, F.col("node").alias("dst")), [*by, "dst"], "left_anti")
        made.append(cut(rest.unionByName(joined).groupBy(*by, "src", "dst").agg(F.max("w").alias("w")), "edges"))
        e = made[-1].where("src <> dst")
        passed = outs.join(gone, [*by, "node"]).groupBy(*by, F.col("other").alias("node")).agg(F.max(F.col("base") + F.col("w")).alias("_base"))
        left = cut(left.join(gone.select(*by, "node"), [*by, "node"], "left_anti").join(passed, [*by, "node"], "left").select(
            *by, "node", F.greatest("base", F.coalesce("_base", F.lit(0))).alias("base")), "nodes")


def dense_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, component): strongly connected components, named by a node of them. Every node takes the smallest node that reaches it, what also
    reaches that node is its component, and the rest goes on; many components are found in each round."""
    found, e = [], cut(edges.select(*by, "src", "dst"), "core")
    left = cut(nodes_of(e, by), "core-nodes")
    while not is_empty(left):
        label = cut(min_label(e, left.withColumn("label", F.col("node")), by), "colour")
        side = lambda s: label.select(*by, F.col("node").alias(s), F.col("label").alias(f"_{s}"))  # noqa: E731, B023
        inner = e.join(side("src"), [*by, "src"]).join(side("dst"), [*by, "dst"]).where("_src = _dst").select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = min_label(cut(inner, "inner"), label.where("node = label"), by)
        found.append(cut(back.select(*by, "node", F.col("label").alias("component")), "component"))
        rest = lambda df, s: df.join(found[-1].select(*by, F.col("node").alias(s)), [*by, s], "left_anti")
        left = cut(rest(left, "node"), "core-nodes")
        e = cut(rest(rest(e, "src"), "dst"), "core")
    return together(found)


def strong_components(rounds: Pass, core: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, component) from the rounds of ``eliminate``: the core's components first, then the nodes taken last to first. A node belongs to the
    component that holds one of its neighbours on each side, else it stands alone."""
    parts = [] if is_empty(core) else [dense_components(core, by)]
    for gone, ins, outs in reversed(rounds):
        alone = gone.select(*by, "node", F.col("node").alias("component"))
        if parts:
            known = together(parts).withColumnRenamed("node", "other")
            side = lambda df: df.join(known, [*by, "other"]).select(*by, "node", "component").distinct()  # noqa: E731, B023
            both = side(ins).join(side(outs), [*by, "node", "component"])
            alone = gone.select(*by, "node").join(both, [*by, "node"], "left").select(*by, "node", F.coalesce("component", "node").alias("component"))
        parts.append(cut(alone, "parts"))
    return together(parts)


def dag_levels(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, level): the longest path from the roots. Edges whose ends reach each other are dropped first.

    The graph is taken apart by ``eliminate`` and levels are set from the nodes taken last to the first. Only if a circle was met, strongly connected
    components are looked for, and the graph without the edges inside them is taken apart again.
    """
    e = cut(edges.where("src <> dst").select(*by, "src", "dst").distinct(), "edges")
    nodes = cut(nodes_of(e, by), "nodes")
    rounds, core, circle = eliminate(e, nodes, by)
    if circle or not is_empty(core):
        part = strong_components(rounds, core, by)
        side = lambda s: part.select(*by, F.col("node").alias(s), F.col("component").alias(f"_{s}"))
        open_ = e.join(side("src"), [*by, "src"]).join(side("dst"), [*by, "dst"]).where("_src <> _dst").select(*by, "src", "dst")
        rounds, _, _ = eliminate(open_, nodes, by)
    levels = []
    for gone, ins, _ in reversed(rounds):
        at = gone.select(*by, "node", F.col("base").alias("level"))
        if levels:
            offers = ins.join(together(levels).withColumnRenamed("node", "other"), [*by, "other"]).groupBy(*by, "node").agg(F.max(F.col("level") + F.col("w")).alias("_level"))
            at = at.join(offers, [*by, "node"], "left").select(*by, "node", F.greatest("level", F.coalesce("_level", F.lit(0))).alias("level"))
        levels.append(cut(at, "levels"))
    return together(levels) if levels else nodes.withColumn("level", F.lit(0))


def lanes(functions: DataFrame, edges: DataFrame, tops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, lane): changed functions head lane 0 ("changed"); each other function belongs to the first lane that reaches
    it; isolated ones have no lane (null, "other"). functions: (fn_id, status); tops: (fn_id, rank) of the roots that
    call anything, rank from 1."""
    changed = functions.where("status <> 'added'").select(*by, F.col("fn_id").alias("node"))
    open_edges = edges.where("src <> dst").join(changed.withColumnRenamed("node", "dst"), [*by, "dst"], "left_anti").select(*by, "src", "dst")
    start = changed.withColumn("label", F.lit(0)).unionByName(
        tops.join(changed.withColumnRenamed("node", "fn_id"), [*by, "fn_id"], "left_anti").select(
            *by, F.col("fn_id").alias("node"), F.col("rank").cast("int").alias("label")))
    lane = min_label(open_edges, start, by)
    return functions.select(*by, "fn_id").join(lane.select(*by, F.col("node").alias("fn_id"), F.col("label").alias("lane")), [*by, "fn_id"], "left")


def state_levels(transitions: DataFrame, starts: DataFrame, by: Sequence[str] = ("subject", "field")) -> DataFrame:
    """(by, state, level): a rank per state: passes over the transitions in order (pos), a state gets its predecessor's rank
    plus one the first time a transition from a ranked state reaches it; unreached states have 0.

    The time a state is first set, (pass, pos), is an earliest-arrival time, so rounds of relaxation over all
    machines at once find it. starts: (by, state).
    """
    t = cut(transitions.where("`from` IS NOT NULL").select(*by, F.col("from").alias("state"), F.col("to").alias("_to"),
                                                           F.col("pos").cast("bigint").alias("_at")), "moves")
    first = starts.select(*by, "state", F.struct(F.lit(0).alias("turn"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("level")).alias("t"))
    best = cut(first, "states")
    while True:
        arrive = ("named_struct('turn', CASE WHEN _at > t.at THEN t.turn ELSE t.turn + 1 END, 'at', _at, 'level', t.level + 1)")
        offer = best.join(t, [*by, "state"]).groupBy(*by, F.col("_to").alias("state")).agg(F.min(F.expr(arrive)).alias("_offer"))
        better = offer.join(best, [*by, "state"], "left").where("t IS NULL OR _offer < t").select(*by, "state", F.col("_offer").alias("t"))
        better = cut(better, "states")
        if is_empty(better):
            break
        best = cut(best.unionByName(better).groupBy(*by, "state").agg(F.min("t").alias("t")), "states")
    states = transitions.selectExpr(*by, "explode(array(`from`, `to`)) AS state").where("state IS NOT NULL").distinct().unionByName(
        starts.select(*by, "state")).distinct()
    return states.join(best, [*by, "state"], "left").select(*by, "state", F.coalesce("t.level", F.lit(0)).alias("level"))


# ---- commits --------------------------------------------------------------------------------------------
SALTS = 16   # a line with very many edges is read in that many pieces


def lines_of(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, line, pos): the nodes of an acyclic graph on disjoint lines along its edges. A line is named by its last node; ``pos``
    counts the nodes behind on the line, so that a node reaches every node of its line with a smaller ``pos``.

    Each node goes on to its smallest dst, and of several that go on to one node the smallest does. Places come from pointer doubling:
    rounds grow with the logarithm of the longest line. Within a line the nodes so and so many steps on differ, so no key is hot.
    """
    one = edges.where("src <> dst").groupBy(*by, "src").agg(F.min("dst").alias("dst")).groupBy(*by, "dst").agg(F.min("src").alias("src"))
    on = nodes.select(*by, "node").distinct().join(one.select(*by, F.col("src").alias("node"), F.col("dst").alias("line")), [*by, "node"], "left")
    ends = on.where("line IS NULL").select(*by, "node", F.col("node").alias("line"), F.lit(0).cast("bigint").alias("pos"))
    done = [cut(ends, "lines")]
    rest = cut(on.where("line IS NOT NULL").withColumn("pos", F.lit(1).cast("bigint")), "lines")
    turn = 0
    while not is_empty(rest):
        if turn > 62:
            raise ValueError("the edges form a cycle")
        known = together(done).withColumn("_end", F.lit(True)).unionByName(rest.withColumn("_end", F.lit(False)))
        further = known.select(*by, F.col("node").alias("line"), F.col("line").alias("_line"), F.col("pos").alias("_pos"), "_end")
        step = cut(rest.join(further, [*by, "line"]).select(*by, "node", F.col("_line").alias("line"), (F.col("pos") + F.col("_pos")).alias("pos"), "_end"), "lines")
        done.append(cut(step.where("_end").drop("_end"), "lines"))
        rest = step.where("NOT _end").drop("_end")
        turn += 1
    return together(done)


def line_edges(edges: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, line, pos, to_line, to_pos): the edges between different lines; those within a line say nothing new."""
    src = lines.select(*by, F.col("node").alias("src"), "line", "pos")
    dst = lines.select(*by, F.col("node").alias("dst"), F.col("line").alias("to_line"), F.col("pos").alias("to_pos"))
    return edges.select(*by, "src", "dst").join(src, [*by, "src"]).join(dst, [*by, "dst"]).where("line <> to_line").select(
        *by, "line", "pos", "to_line", "to_pos").distinct()


def line_reach(crossing: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, seed, line, pos): what each seed reaches, as the highest place on each line; it reaches all lower ones too.

    starts: (by, seed, line, pos). A round follows the edges that leave the newly reached stretches; rounds equal the changes of line on the way,
    whatever the length of the lines. Rows are seeds times lines reached, not nodes.
    """
    step = cut(crossing.withColumn("_salt", F.expr(f"pmod(hash(pos), {SALTS})")).withColumnRenamed("pos", "_from"), "crossing")
    best = cut(starts.groupBy(*by, "seed", "line").agg(F.max("pos").alias("pos")), "line-reach")
    new = best.withColumn("_before", F.lit(-1).cast("bigint"))
    while True:
        spread = new.withColumn("_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        offers = spread.join(step, [*by, "line", "_salt"]).where("_from <= pos AND _from > _before").groupBy(
            *by, "seed", F.col("to_line").alias("line")).agg(F.max("to_pos").alias("pos"))
        old = best.select(*by, "seed", "line", F.col("pos").alias("_before"))
        new = cut(offers.join(old, [*by, "seed", "line"], "left").withColumn("_before", F.coalesce("_before", F.lit(-1).cast("bigint"))).where(
            "pos > _before").select(*by, "seed", "line", "pos", "_before"), "line-reach")
        if is_empty(new):
            return best
        best = cut(best.unionByName(new.drop("_before")).groupBy(*by, "seed", "line").agg(F.max("pos").alias("pos")), "line-reach")


def ancestor_lines(commits: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, edges between lines, places reached by each a, by each b) for pairs (by, a, b) of commits (by, sha, parent)."""
    edges = commits.select(*by, F.col("sha").alias("src"), F.col("parent").alias("dst")).where("dst IS NOT NULL")
    ends = pairs.select(*by, F.col("a").alias("node")).union(pairs.select(*by, F.col("b"))).distinct()
    lines = lines_of(edges, nodes_of(edges, by).union(ends), by)
    crossing = cut(line_edges(edges, lines, by), "crossing")
    reached = line_reach(crossing, ends.join(lines, [*by, "node"]).withColumnRenamed("node", "seed"), by)
    side = lambda s: pairs.select(*by, "a", "b").distinct().join(reached.select(*by, F.col("seed").alias(s), "line", F.col("pos").alias(f"{s}_pos")), [*by, s])
    return lines, crossing, side("a"), side("b")


def merge_base(commits: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, base): the common ancestor of two commits that no other common ancestor descends from (the smallest id when
    there are several). commits: (sha, parent); pairs: (a, b). Histories are read as lines, so a long one takes few rounds."""
    lines, crossing, a, b = ancestor_lines(commits, pairs, by)
    common = cut(a.join(b, [*by, "a", "b", "line"]).select(*by, "a", "b", "line", F.least("a_pos", "b_pos").alias("pos")), "common")
    # On each line the highest common place stands for those below. Common ancestors are closed under parents, so it has a common descendant
    # only if one is its child, on another line.
    child = crossing.select(*by, F.col("line").alias("_line"), F.col("pos").alias("_pos"), F.col("to_line").alias("line"), F.col("to_pos").alias("pos"))
    held = common.select(*by, "a", "b", F.col("line").alias("_line"), F.col("pos").alias("_top"))
    above = common.join(child, [*by, "line", "pos"]).join(held, [*by, "a", "b", "_line"]).where("_pos <= _top").select(*by, "a", "b", "line").distinct()
    lowest = common.join(above, [*by, "a", "b", "line"], "left_anti").join(lines, [*by, "line", "pos"])
    return lowest.groupBy(*by, "a", "b").agg(F.min("node").alias("base"))


def ahead_behind(commits: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, ahead, behind): commits only below a, and only below b. pairs: (a, b). Counted as lengths of lines, not commit by commit."""
    _, _, a, b = ancestor_lines(commits, pairs, by)
    both = a.join(b, [*by, "a", "b", "line"], "full").select(*by, "a", "b", (F.coalesce("a_pos", F.lit(-1)) - F.coalesce("b_pos", F.lit(-1))).alias("_more"))
    return both.groupBy(*by, "a", "b").agg(F.sum(F.greatest("_more", F.lit(0))).alias("ahead"), F.sum(F.greatest(-F.col("_more"), F.lit(0))).alias("behind"))


# ---- flows and steps ------------------------------------------------------------------------------------
def nest_flows(flows: DataFrame, steps: DataFrame, names: DataFrame, drivers: DataFrame, generic: str, fails: str,
               by: Sequence[str] = ("part",)) -> DataFrame:
    """(by, flow, under_flow, under_step): the step each sub-flow details.

    flows: (flow, title, trigger, first_actor); steps: (flow, pos); names: (flow, pos, name) what a step calls; drivers:
    (flow, driver). Flow b hangs under the first step (flow order, step order) whose call its trigger names, else
    under the first one landing where b starts; failure flows and steps entering a flow's own driver are out. Flows
    choose in order, and a choice that would close a cycle with earlier ones is skipped.

    All flows choose at once. Where choices run in a circle, every flow on it but the last in order has chosen rightly (a smaller circle
    would have to run along the same choices), so the last one's choice is the one to skip, and circles of one round have no flow in common.
    Rounds equal the longest row of skipped choices, not the number of flows.
    """
    ok = flows.where(f"NOT concat_ws(' ', title, `trigger`) rlike {S.text(fails)}")
    named = names.join(drivers.select(*by, "flow", "driver"), [*by, "flow"], "left")
    entering = named.where("name = driver").select(*by, "flow", "pos").distinct()
    usable = named.join(entering, [*by, "flow", "pos"], "left_anti").where("name <> ''").select(
        *by, F.col("flow").alias("k"), F.col("pos").alias("i"), "name").distinct()
    by_word = ok.select(*by, "flow", F.explode(F.expr(r"array_distinct(split(coalesce(`trigger`, ''), '[^\\w.]+'))")).alias("name")).join(
        usable, [*by, "name"]).withColumn("rule", F.lit(0))
    by_start = ok.where(f"NOT first_actor rlike {S.text(generic)}").select(*by, "flow", F.col("first_actor").alias("name")).join(
        usable, [*by, "name"]).withColumn("rule", F.lit(1))
    cand = by_word.unionByName(by_start).where("k <> flow").groupBy(*by, "flow", "k").agg(F.min(F.struct("rule", "k", "i")).alias("order"))
    cand = cut(cand, "nest")
    while True:
        pick = cut(cand.groupBy(*by, "flow").agg(F.min("order").alias("o")).select(*by, "flow", F.col("o.k").alias("k"), F.col("o.i").alias("i")), "pick")
        last = circles(pick.select(*by, F.col("flow").alias("src"), F.col("k").alias("dst")), by)
        if last is None:
            return pick.select(*by, "flow", F.col("k").alias("under_flow"), F.col("i").alias("under_step"))
        skipped = pick.join(last.select(*by, F.col("node").alias("flow")), [*by, "flow"], "left_semi").select(*by, "flow", "k")
        cand = cut(cand.join(skipped, [*by, "flow", "k"], "left_anti"), "nest")


def circles(pointers: DataFrame, by: Sequence[str] = ()) -> DataFrame | None:
    """(by, node): the largest node of each circle of a graph in which every node points to one other at most; None without circles.
    pointers: (src, dst).

    Pointer doubling: after more steps than there are pointers, whoever still points somewhere points into a circle, the nodes pointed
    at are those on circles, and the largest node met on the way is that of the whole circle. Paths that end drop out as they are found.
    """
    size = pointers.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jump = pointers.select(*by, "src", "dst", F.col("src").alias("most"))
    steps = 1
    while not is_empty(jump):
        if steps > size:
            rings = jump.select(*by, F.col("dst").alias("src")).distinct()
            return cut(jump.join(rings, [*by, "src"], "left_semi").select(*by, F.col("most").alias("node")).distinct(), "circles")
        on = jump.select(*by, F.col("src").alias("dst"), F.col("dst").alias("_dst"), F.col("most").alias("_most"))
        jump = cut(jump.join(on, [*by, "dst"]).select(*by, "src", F.col("_dst").alias("dst"), F.greatest("most", "_most").alias("most")), "circles")
        steps *= 2
    return None


def step_paths(steps: DataFrame, by: Sequence[str] = ("fn_id",)) -> DataFrame:
    """(by, id, on_path): for each step the steps on its way from the entry: itself, the enclosing headers, and the steps
    before it (or before its headers) in the same block.

    steps: (by, pos, id, path ARRAY<STRUCT<head, branch>>). Each step looks once per enclosing block, with the
    position of its own ancestor in that block, so the join is on (function, block).
    """
    block = "array_join(transform(slice(path, 1, {n}), p -> concat(p.head, ':', p.branch)), '/')"
    own = steps.selectExpr(*by, "id AS on_path", "pos AS o_pos", block.format(n="size(path)") + " AS block")
    heads = steps.selectExpr(*by, "id AS head", "pos AS h_pos")
    look = steps.select(*by, "id", "pos", "path", F.explode(F.expr("sequence(0, size(path))")).alias("n")).selectExpr(
        *by, "id", "pos", block.format(n="n") + " AS block", "CASE WHEN n < size(path) THEN get(path, n).head END AS head")
    bound = look.join(heads, [*by, "head"], "left").selectExpr(*by, "id", "block", "coalesce(h_pos, pos) AS upto")
    return bound.join(own, [*by, "block"]).where("o_pos <= upto").select(*by, "id", "on_path").distinct()


def block_stats(steps: DataFrame, by: Sequence[str] = ("fn_id",), collapse: int = 8) -> DataFrame:
    """(by, head, branch, steps, collapsible, ends): per block the steps inside (nested ones too), whether it may be collapsed (more
    than 8 and at most 60% of the function), and whether its last own step returns or throws."""
    inner = steps.select(*by, F.explode("path").alias("p")).groupBy(*by, F.col("p.head").alias("head"), F.col("p.branch").alias("branch")).agg(
        F.count("*").alias("steps"))
    total = steps.groupBy(*by).agg(F.count("*").alias("_all"))
    last = steps.where("size(path) > 0").withColumn("p", F.expr("element_at(path, -1)")).groupBy(
        *by, F.col("p.head").alias("head"), F.col("p.branch").alias("branch")).agg(F.max_by("kind", "pos").alias("last"))
    return inner.join(total, [*by]).join(last, [*by, "head", "branch"], "left").selectExpr(
        *by, "head", "branch", "steps", f"steps > {collapse} AND steps <= _all * 0.6 AS collapsible",
        "coalesce(last IN ('return', 'throw'), false) AS ends")


def changed_only(steps: DataFrame, by: Sequence[str] = ("fn_id",)) -> DataFrame:
    """Steps (by, id, kind, path, changed) that changed or hold a changed step; entry and exit stay."""
    above = steps.where("changed").select(*by, F.explode(F.expr("concat(transform(path, p -> p.head), array(id))")).alias("id")).distinct()
    kept = above.withColumn("_keep", F.lit(True))
    return steps.join(kept, [*by, "id"], "left").where("_keep OR kind IN ('entry', 'exit')").select(*steps.columns)


# ---- slices ---------------------------------------------------------------------------------------------
def find_slices(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, slice): project folders of each repository: outermost folders with a project marker and source inside; a repository
    without any is sliced by its code folders."""
    from ..functions import fixed as fx
    from .joins import ancestor_rows
    marked = files.where(f"array_contains({S.texts(fx.PROJECT_MARKERS)}, {S.base_name('path')}) OR " +
                         " OR ".join(f"endswith(path, '{s}')" for s in fx.MARKER_SUFFIXES))
    projects = marked.selectExpr(*by, f"{S.folder_of('path')} AS path").where("path <> ''").distinct()
    up = ancestor_rows(projects, by).where("folder <> path").select(*by, "path", "folder")
    nested = up.join(projects.select(*by, F.col("path").alias("folder")), [*by, "folder"], "left_semi").select(*by, "path").distinct()
    outer = projects.join(nested, [*by, "path"], "left_anti")
    source = ancestor_rows(files.where(S.is_source("path")), by).select(*by, F.col("folder").alias("path")).distinct()
    found = cut(outer.join(source, [*by, "path"], "left_semi"), "slices")
    code = files.where(f"{S.is_source('path')} AND NOT {S.is_test('path')} AND NOT {S.is_generated('path')} AND NOT startswith(path, '.')")
    if by:
        code = code.join(found.select(*by).distinct(), [*by], "left_anti")
    elif not is_empty(found):
        return found.select(F.col("path").alias("slice"))
    return found.select(*by, F.col("path").alias("slice")).unionByName(code_slices(code, by))


def code_slices(code: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, slice): a single project's parts: its root (when it has code files of its own, or nothing else) and its code subfolders
    of at least three files; a subfolder with most of its parent's code and at least 15 files is split the same way.

    Files are counted per folder once; the splitting walks down these counts, one level a round. '' is written '.'.
    """
    folder_rows = code.select(*by, "path", F.expr(S.folder_of("path")).alias("own")).selectExpr(
        *by, "path", "own", f"explode({S.ancestors('path')}) AS folder").where("folder <> path")
    counts = cut(folder_rows.groupBy(*by, "folder").agg(F.count("*").alias("n"), F.count_if(F.expr("own = folder")).alias("here"))
                 .withColumn("parent", F.expr(f"CASE WHEN folder <> '' THEN {S.folder_of('folder')} END")), "folders")
    level = counts.where("folder = ''").select(*by, "folder", "n", "here")
    out = []
    while not is_empty(level):
        level = cut(level, "split")
        subs = counts.where("n >= 3").select(*by, F.col("folder").alias("sub"), F.col("n").alias("sub_n"), F.col("here").alias("sub_here"),
                                             F.col("parent").alias("folder")).join(level, [*by, "folder"])
        has_subs = subs.select(*by, "folder").distinct().withColumn("_subs", F.lit(True))
        out.append(level.join(has_subs, [*by, "folder"], "left").where("here > 0 OR _subs IS NULL").selectExpr(
            *by, "CASE WHEN folder = '' THEN '.' ELSE folder END AS slice"))
        deep = "sub_n * 2 > n AND sub_n >= 15"
        out.append(subs.where(f"NOT ({deep})").select(*by, F.col("sub").alias("slice")))
        level = subs.where(deep).select(*by, F.col("sub").alias("folder"), F.col("sub_n").alias("n"), F.col("sub_here").alias("here"))
    return together(out) if out else counts.selectExpr(*by, "folder AS slice")
