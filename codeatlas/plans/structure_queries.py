"""Queries over code structure: intervals, name resolution, graphs, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from ..operators import graph, joins, rank, rollup
from .map_queries import externals, steps, uses
from .registry import query


# ---- intervals -----------------------------------------------------------------------------------------
@query("d2_enclosing", "intervals points", """
    SELECT grp, pos, arg_min(id, ("end" - "start", id)) AS id FROM (SELECT DISTINCT grp, pos FROM points) JOIN intervals USING (grp)
    WHERE pos BETWEEN "start" AND "end" GROUP BY grp, pos""")
def enclosing(t):
    return joins.enclosing(t.points, t.intervals, ["grp"], line="pos", take=("id",), order=("id",))


@query("d8_verify_refs", "corpus corpus_lines", """
    WITH c AS (SELECT doc_id, path, path || ':' || (doc_id % 12 + 1) AS ref, doc_id % 12 + 1 AS line, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'the' ELSE 'ent' END AS w FROM corpus),
    v AS (SELECT ref, count(*) FILTER (l.line_no = c.line) > 0 AND (any_value(w) IS NULL OR bool_or(contains(l.text, w))) AS ok
      FROM c LEFT JOIN corpus_lines l ON l.path = c.path AND l.line_no BETWEEN c.line - 5 AND c.line + 5 GROUP BY ref)
    SELECT ref, coalesce(ok, false) AS verified FROM v UNION ALL SELECT 'bad' || doc_id, false FROM corpus""")
def verify_refs(t):
    claims = t.corpus.selectExpr("concat(path, ':', doc_id % 12 + 1) AS ref", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x.the()' ELSE 'ent' END AS fn")
    return joins.verify_refs(claims.unionByName(t.corpus.selectExpr("concat('bad', doc_id) AS ref", "cast(NULL AS STRING) AS fn")), t.corpus_lines)


@query("d25_pick_calls", "intervals points", """
    WITH p AS (SELECT DISTINCT grp, pos FROM points)
    SELECT grp, pos AS line, arg_min(id, CASE WHEN "start" = pos THEN (0, "start" * 10, -"end" * 10, id) ELSE (1, ("end" - "start") * 10, 0, id) END) AS call_id
    FROM p JOIN intervals USING (grp) WHERE pos BETWEEN "start" AND "end" GROUP BY grp, pos""")
def pick_calls(t):
    spans = t.intervals.selectExpr("grp", "id AS call_id", "start", "end", "start * 10 AS first_byte", "end * 10 AS last_byte")
    return joins.pick_calls(t.points.selectExpr("grp", "pos AS line"), spans, ["grp"])


# ---- names ---------------------------------------------------------------------------------------------
@query("d4_resolve_calls", "functions mentions", """
    WITH own AS (SELECT * FROM functions WHERE kind <> 'Class'), m AS (SELECT DISTINCT * FROM mentions),
    c AS (SELECT m.fn_id AS src, m.qualifier AS q, m.name, o.fn_id AS dst, o.parent, regexp_replace(o.path, '/[^/]*$', '') AS folder,
        f.parent AS caller_parent, regexp_replace(f.path, '/[^/]*$', '') AS caller_folder FROM m JOIN own o ON o.name = m.name AND o.fn_id <> m.fn_id
        JOIN functions f ON f.fn_id = m.fn_id),
    t AS (SELECT *, parent IS NOT NULL AND (parent IS NOT DISTINCT FROM caller_parent OR EXISTS (SELECT 1 FROM m x WHERE x.fn_id = c.src AND x.name = c.parent)
        OR (len(q) > 2 AND (ends_with(lower(parent), q) OR ends_with(q, lower(parent))))) AS typed, folder = caller_folder AS near FROM c),
    n AS (SELECT *, count(*) OVER w AS n, count(parent) OVER w AS methods, count(*) FILTER (typed) OVER w AS n_typed, count(*) FILTER (near) OVER w AS n_near
        FROM t WINDOW w AS (PARTITION BY src, q, name))
    SELECT DISTINCT src, dst FROM n WHERE n <= 3 AND CASE
      WHEN methods > 0 THEN q IS NOT NULL AND parent IS NOT NULL AND CASE WHEN n_typed > 0 THEN typed ELSE methods = 1 END
      WHEN q <> '' THEN split_part(folder, '/', -1) = q WHEN n_near > 0 THEN near ELSE n = 1 END""")
def resolve_calls(t):
    return joins.resolve_calls(joins.mentions_of(t.bodies), t.functions)


@query("d5_type_usage", "functions mentions", """
    WITH ty AS (SELECT name, fn_id FROM functions WHERE kind = 'Class' AND name IN (SELECT name FROM functions WHERE kind = 'Class' GROUP BY name HAVING count(*) <= 3))
    SELECT DISTINCT m.fn_id AS src, ty.fn_id AS dst FROM mentions m JOIN ty ON ty.name = m.name JOIN functions f ON f.fn_id = m.fn_id AND f.kind <> 'Class'
    WHERE ty.name IS DISTINCT FROM f.parent""")
def type_usage(t):
    return joins.type_usage(joins.mentions_of(t.bodies), t.functions)


@query("d6_connect", "functions calls", """
    WITH r AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM functions),
    s AS (SELECT src AS fn_id, g.name, CASE dst % 3 WHEN 0 THEN '' WHEN 1 THEN 'obj' ELSE 'm' || dst // 40 END AS recv, dst AS line FROM calls JOIN functions g ON g.fn_id = dst),
    c AS (SELECT s.*, g.fn_id AS "to", g.folder = f.folder AS near FROM s JOIN r f USING (fn_id) JOIN r g ON g.name = s.name AND g.fn_id <> f.fn_id
      WHERE g.fn_id % 17 = 0 OR g.path = f.path OR (NOT EXISTS (SELECT 1 FROM functions l WHERE l.path = f.path AND l.name = s.name)
        AND CASE WHEN g.parent IS NOT NULL THEN s.recv <> '' ELSE s.recv = '' OR s.recv = 'm' || g.fn_id // 40 OR s.recv = split_part(g.folder, '/', -1) END)),
    n AS (SELECT fn_id, name, recv, line, count(*) AS n, count(*) FILTER (near) AS k, min("to") AS a, min("to") FILTER (near) AS b FROM c GROUP BY ALL)
    SELECT fn_id, name, recv, line, CASE WHEN n = 1 THEN a ELSE b END AS "to" FROM n WHERE n = 1 OR k = 1""")
def connect(t):
    names = t.functions.selectExpr("fn_id AS dst", "name")
    sites = t.calls.join(names, "dst").selectExpr("src AS fn_id", "name", "CASE dst % 3 WHEN 0 THEN '' WHEN 1 THEN 'obj' ELSE concat('m', dst div 40) END AS recv", "dst AS line")
    reviewed = t.functions.selectExpr("fn_id", "name", "parent", "path AS file", "CASE WHEN fn_id % 17 = 0 THEN 'query' END AS kind")
    return joins.connect(sites, reviewed, t.functions.selectExpr("path AS file", "name"))


@query("d9_callers", "functions calls", """
    SELECT DISTINCT g.path, g.name, f.name AS caller FROM calls JOIN functions f ON f.fn_id = src JOIN functions g ON g.fn_id = dst""")
def callers(t):
    return joins.callers(t.functions, t.calls)


@query("d10_known_names", "functions", """
    WITH p AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS id FROM functions)
    SELECT DISTINCT id AS part, name FROM functions JOIN p ON path LIKE id || '/%' WHERE kind <> 'Class'
    UNION SELECT NULL, name FROM functions WHERE kind <> 'Class' AND path LIKE 'app/k3/%'""")
def known_names(t):
    parts = t.functions.selectExpr(f"{S.folder_of('path')} AS id").distinct().selectExpr("id", "id AS path", "CASE WHEN id = 'app/k3' THEN 'library' ELSE 'service' END AS kind")
    return joins.known_names(t.functions, parts)


@query("d11_touch_externals", "parts part_uses part_steps part_externals", """
    WITH r AS (SELECT DISTINCT target, ref FROM part_uses UNION SELECT "to", ref FROM part_steps),
    p AS (SELECT target, ref, CAST(regexp_extract(ref, '([0-9]+)$', 1) AS INT) AS line, CAST(regexp_extract(ref, '/p([0-9]+)/main', 1) AS BIGINT) AS k FROM r
      WHERE target IN (SELECT id FROM part_externals) AND ref IS NOT NULL),
    f AS (SELECT target, ref, k * 10 + CASE WHEN line BETWEEN 5 AND 12 THEN 2 ELSE 1 END AS fn_id FROM p WHERE line <= 20)
    SELECT fn_id, target, min(ref) AS ref FROM f GROUP BY 1, 2""")
def touch_externals(t):
    k = "cast(substring(id, 2) AS BIGINT)"
    fns = t.part_records.selectExpr(f"{k} * 10 + 1 AS fn_id", "concat(path, '/main.py') AS path", "1L AS start", "20L AS end").unionByName(
        t.part_records.selectExpr(f"{k} * 10 + 2 AS fn_id", "concat(path, '/main.py') AS path", "5L AS start", "12L AS end"))
    return joins.touch_externals(fns, uses(t), steps(t), externals(t)).select("fn_id", "target", "ref")


@query("d15_entries_through", "edges_down", """
    WITH RECURSIVE tr AS (SELECT 'L' || p_partkey AS line_id, p_partkey AS node FROM part WHERE p_partkey < 64
      UNION ALL SELECT line_id, dst FROM tr JOIN edges_down ON src = node)
    SELECT DISTINCT line_id, 'route' AS label, 'n' || node % 50 AS station FROM tr WHERE node % 50 < 9""")
def entries_through(t):
    entries = t.part.where("p_partkey < 64").selectExpr("p_partkey AS node")
    r = graph.reach(t.edges_down, entries)
    routes = r.selectExpr("0 AS part", "concat('L', src) AS line_id", "'route' AS label", "concat('n', node % 50) AS station")
    names = t.part.where("p_partkey % 50 < 9").selectExpr("0 AS part", "concat('n', p_partkey % 50) AS name")
    return joins.entries_through(routes, names).select("line_id", "label", F.col("name").alias("station"))


@query("d16_mentioned_in_tests", "", r"""
    WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{N}_]*')) AS name FROM benchmark),
    f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{N}_]*')) AS name FROM documents)
    SELECT name AS fn_id, 'test' || item_id AS test FROM f JOIN w USING (name)""")
def mentioned_in_tests(t):
    names = t.documents.select(F.explode(F.expr(S.identifiers("text"))).alias("name")).distinct().selectExpr("name AS fn_id", "name")
    return joins.mentioned_in_tests(names, t.benchmark.selectExpr("concat('test', item_id) AS path", "text AS content"))


@query("d17_branch_list", "", """
    WITH l AS (SELECT o_custkey % 40 AS repo, 'b' || o_orderkey % 300 AS name, max(o_orderdate) AS updated FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
    r AS (SELECT o_custkey % 40 AS repo, 'origin/b' || o_orderkey % 400 AS name, max(o_orderdate) AS updated FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
    b AS (SELECT *, false AS remote FROM l UNION ALL SELECT *, true FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.repo = r.repo AND l.name = substring(r.name, 8)))
    SELECT repo, name, remote, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY remote, updated DESC, name) AS rank FROM b)""")
def branch_list(t):
    side = lambda rest, name: t.orders.where(f"o_orderkey % 2 = {rest}").selectExpr("o_custkey % 40 AS repo", name, "o_orderdate AS updated").groupBy("repo", "name").agg(
        F.max("updated").alias("updated"))
    out = joins.branch_list(side(0, "concat('b', o_orderkey % 300) AS name"), side(1, "concat('origin/b', o_orderkey % 400) AS name"), ["repo"])
    return out.select("repo", "name", "remote", "rank")


@query("d20_handler_of", "parts", """
    WITH e AS (SELECT k, CASE k % 4 WHEN 0 THEN k * 10 + 2 WHEN 1 THEN k * 10 + 1 WHEN 2 THEN k * 10 + 3 ELSE k * 10 + 1 END AS fn_id FROM parts)
    SELECT k AS entry_id, fn_id FROM e""")
def handler_of(t):
    """Four registration forms: a receiver's handler over two lines, no handler named, a plain function, and an inner call."""
    k = "cast(substring(id, 2) AS BIGINT)"
    parts = t.part_records.selectExpr(f"{k} AS k", "concat(path, '/main.py') AS path")
    lines = parts.selectExpr("path", "stack(4, 1L, 'func setup() {', 2L, CASE k % 4 WHEN 0 THEN concat('r.Handle(\"/x\", orders', k, '.get', k, ',') "
                             "WHEN 1 THEN 'r.Handle(\"/x\", other)' WHEN 2 THEN concat('r.Handle(\"/y\", get', k, ')') ELSE concat('r.Use(get', k, '.x)') END, "
                             "3L, CASE WHEN k % 4 = 0 THEN 'wrap)' ELSE concat('get', k) END, 4L, '}') AS (line_no, text)")
    fns = parts.selectExpr("k", "path", "stack(3, 1L, 'setup', NULL, 1L, 4L, 2L, concat('get', k), concat('Orders', k), 10L, 12L, "
                           "3L, concat('get', k), concat('Users', k), 20L, 22L) AS (i, name, parent, start, end)").selectExpr(
        "k * 10 + i AS fn_id", "'Function' AS kind", "name", "parent", "path", "start", "end", "false AS is_test")
    reach = fns.selectExpr("fn_id", "CASE WHEN fn_id % 10 = 3 THEN 5L ELSE 1L END AS reach")
    return joins.handler_of(parts.selectExpr("k AS entry_id", "path", "2L AS line"), lines, fns, reach)


@query("d23_gates_of_part", "marks", "SELECT DISTINCT gate FROM marks WHERE part = 'part3'")
def gates_of_part(t):
    return joins.gates_of_part(t.marks, "part3")


# ---- structure -----------------------------------------------------------------------------------------
@query("e16_degree", "functions calls", """
    WITH p AS (SELECT fn_id, regexp_replace(path, '/[^/]*$', '') AS part FROM functions),
    c AS (SELECT dst, a.part = b.part AS same FROM calls JOIN p a ON a.fn_id = src JOIN p b ON b.fn_id = dst WHERE src <> dst)
    SELECT fn_id, (SELECT count(*) FROM c WHERE dst = fn_id AND same) AS fanin, (SELECT count(*) FROM c WHERE dst = fn_id AND NOT same) AS outside FROM functions""")
def degree(t):
    return rollup.degree(t.functions, t.calls, t.functions.selectExpr("fn_id", f"{S.folder_of('path')} AS part"))


@query("e20_structure_stats", "functions", """
    SELECT regexp_replace(path, '/[^/]*$', '') AS part, count(*) FILTER (kind = 'Class') AS types, count(*) FILTER (kind <> 'Class' AND parent IS NOT NULL) AS methods,
      count(*) FILTER (kind <> 'Class' AND parent IS NULL) AS functions FROM functions WHERE NOT is_test GROUP BY 1""")
def structure_stats(t):
    return rollup.structure_stats(t.functions.withColumn("part", F.expr(S.folder_of("path"))))


@query("e21_unused", "functions calls", """
    WITH c AS (SELECT src - src % 3 AS src, dst - dst % 3 AS dst FROM calls)
    SELECT fn_id FROM functions WHERE NOT EXISTS (SELECT 1 FROM c WHERE src <> dst AND (src = fn_id OR dst = fn_id)) AND fn_id % 5 <> 0 AND fn_id % 5 <> 1""")
def unused(t):
    """Every call ends at functions whose number three divides."""
    calls = t.calls.selectExpr("src - src % 3 AS src", "dst - dst % 3 AS dst")
    type_uses = t.functions.where("fn_id % 5 = 0").selectExpr("fn_id AS src", "fn_id + 1 AS dst")
    return rollup.unused(t.functions, calls, type_uses)


@query("e27_method_members", "functions", """
    SELECT t.fn_id AS type_id, m.fn_id FROM functions m JOIN functions t ON t.kind = 'Class' AND t.name = m.parent AND m.kind <> 'Class'
      AND regexp_replace(t.path, '/[^/]*$', '') = regexp_replace(m.path, '/[^/]*$', '')""")
def method_members(t):
    return rollup.method_members(t.functions)


# ---- graphs --------------------------------------------------------------------------------------------
@query("h1_reach", "edges_tree", """
    WITH RECURSIVE r AS (SELECT src, src AS node FROM (SELECT src FROM edges_tree UNION SELECT dst FROM edges_tree)
      UNION SELECT r.src, e.dst FROM r JOIN edges_tree e ON e.src = r.node) SELECT src, node FROM r""")
def reach(t):
    return graph.reach(t.edges_tree)


@query("h1_reach_count_cyclic", "edges_cyclic", """
    WITH RECURSIVE r AS (SELECT src, src AS node FROM (SELECT src FROM edges_cyclic UNION SELECT dst FROM edges_cyclic)
      UNION SELECT r.src, e.dst FROM r JOIN edges_cyclic e ON e.src = r.node) SELECT src AS node, count(*) AS reach FROM r GROUP BY src""")
def reach_count(t):
    return graph.reach_count(t.edges_cyclic)


TRUNKS = """WITH RECURSIVE rc AS (SELECT src AS root, src AS node FROM (SELECT src FROM edges_down UNION SELECT dst FROM edges_down)
      UNION SELECT rc.root, e.dst FROM rc JOIN edges_down e ON e.src = rc.node),
    w AS (SELECT root AS node, count(*) AS reach FROM rc GROUP BY root),
    best AS (SELECT src, arg_min(dst, (-reach, dst)) AS dst FROM edges_down JOIN w ON w.node = dst GROUP BY src),
    roots AS (SELECT node, reach FROM w WHERE node < 64 AND reach >= 2),
    ranked AS (SELECT node % 4 AS part, node, reach, row_number() OVER (PARTITION BY node % 4 ORDER BY reach DESC, node) AS r,
      count(*) OVER (PARTITION BY node % 4) AS n FROM roots),
    tr AS (SELECT part, 'L' || (r - 1) AS line_id, 0 AS pos, node FROM ranked
      UNION ALL SELECT part, line_id, pos + 1, best.dst FROM tr JOIN best ON best.src = tr.node) """


def drawn_routes(t):
    weight = graph.reach_count(t.edges_down)
    roots = weight.where("node < 64").selectExpr("node % 4 AS part", "concat('f', node) AS label", "node", "reach")
    none = roots.where("false").selectExpr("part", "0 AS pos", "label", "'http' AS kind", "node", "reach")
    lines = rank.rank_entries(none, roots)
    part_of = lambda df, *c: df.selectExpr("explode(array(0L, 1L, 2L, 3L)) AS part", *c)
    trunk, spurs = graph.routes(part_of(t.edges_down, "src", "dst"), lines, part_of(weight, "node", "reach"))
    return lines, trunk, spurs, part_of(weight, "node", "reach")


@query("f1_rank_entries", "", """
    WITH e AS (SELECT c_nationkey AS part, c_custkey AS node, c_custkey % 37 AS reach, 'f' || c_custkey AS label, c_custkey % 9 = 0 AS exposed FROM customer),
    u AS (SELECT part, node, reach, CASE WHEN exposed THEN 'GET /' || node ELSE label END AS label, CASE WHEN exposed THEN 'http' ELSE 'function' END AS kind,
      CASE WHEN exposed THEN (0, node, 0) ELSE (1, -reach, node) END AS k FROM e WHERE exposed OR reach >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) AS r, count(*) OVER (PARTITION BY part) AS n FROM u)
    SELECT part, 'L' || (r - 1) AS line_id, label, kind, node, reach, 0 AS hidden FROM r""")
def rank_entries(t):
    roots = t.customer.selectExpr("c_nationkey AS part", "concat('f', c_custkey) AS label", "c_custkey AS node", "c_custkey % 37 AS reach")
    exposed = t.customer.where("c_custkey % 9 = 0").selectExpr("c_nationkey AS part", "c_custkey AS pos", "concat('GET /', c_custkey) AS label", "'http' AS kind",
                                                               "c_custkey AS node", "c_custkey % 37 AS reach")
    return rank.rank_entries(exposed, roots)


@query("h2_trunks", "edges_down", TRUNKS + "SELECT part, line_id, pos, node FROM tr")
def trunks(t):
    return drawn_routes(t)[1]


@query("h2_spurs", "edges_down", TRUNKS + """SELECT part, line_id, pos, dst AS node, best.dst_ AS second FROM (
      SELECT tr.part, tr.line_id, tr.pos, e.dst FROM tr JOIN edges_down e ON e.src = tr.node ANTI JOIN tr x ON x.part = tr.part AND x.line_id = tr.line_id AND x.node = e.dst) s
    LEFT JOIN (SELECT src, dst AS dst_ FROM best) best ON best.src = s.dst""")
def spurs(t):
    return drawn_routes(t)[2]


@query("h2_route_rows", "edges_down", TRUNKS + """, sp AS (SELECT s.part, s.line_id, count(*) + count(best.dst) AS off FROM (
      SELECT tr.part, tr.line_id, e.dst FROM tr JOIN edges_down e ON e.src = tr.node ANTI JOIN tr x ON x.part = tr.part AND x.line_id = tr.line_id AND x.node = e.dst) s
      LEFT JOIN best ON best.src = s.dst GROUP BY 1, 2)
    SELECT part, line_id, arg_min(tr.node, pos) AS entry, count(*) AS stations, count(*) + coalesce(any_value(off), 0) AS drawn, max(w.reach) AS reach,
      max(w.reach) - count(*) - coalesce(any_value(off), 0) AS more FROM tr LEFT JOIN sp USING (part, line_id) JOIN w ON w.node = tr.node GROUP BY 1, 2""")
def route_rows(t):
    lines, trunk, spur, weight = drawn_routes(t)
    return graph.route_rows(trunk, spur, weight)


@query("f7_shared_stations", "", """
    WITH t AS (SELECT DISTINCT l_orderkey % 40 AS part, 'L' || l_orderkey % 12 AS line_id, l_suppkey AS node FROM lineitem)
    SELECT part, node, count(*) AS lines FROM t GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_stations(t):
    return rank.shared_stations(t.lineitem.selectExpr("l_orderkey % 40 AS part", "concat('L', l_orderkey % 12) AS line_id", "l_linenumber AS pos", "l_suppkey AS node"))


@query("f7_shared_segments", "order_steps", """
    WITH t AS (SELECT fn_id % 40 AS part, fn_id AS o, n, s % 10 AS node FROM order_steps),
    g AS (SELECT DISTINCT a.part, 'L' || a.o AS line_id, least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM t a JOIN t b ON a.o = b.o AND b.n = a.n + 1)
    SELECT part, a, b, line_id, row_number() OVER (PARTITION BY part, a, b ORDER BY CAST(substring(line_id, 2) AS INT)) - 1 AS slot,
      count(*) OVER (PARTITION BY part, a, b) AS lines FROM g""")
def shared_segments(t):
    return rank.shared_segments(t.order_steps.selectExpr("fn_id % 40 AS part", "concat('L', fn_id) AS line_id", "n AS pos", "s % 10 AS node"))


WALK_FUNCTIONS = """SELECT fn_id, CASE WHEN fn_id % 50 = 0 THEN 'handle' || fn_id WHEN fn_id % 3 = 0 THEN '_' || name ELSE name END AS name, path AS file,
    "start", CASE WHEN fn_id % 17 = 0 THEN 'query' ELSE 'function' END AS kind FROM functions"""


def walk_functions(t):
    return t.functions.selectExpr("fn_id", "CASE WHEN fn_id % 50 = 0 THEN concat('handle', fn_id) WHEN fn_id % 3 = 0 THEN concat('_', name) ELSE name END AS name",
                                  "path AS file", "start", "CASE WHEN fn_id % 17 = 0 THEN 'query' ELSE 'function' END AS kind")


ROOTS = f"""WITH RECURSIVE fs AS ({WALK_FUNCTIONS}), rc AS (SELECT src AS root, src AS node FROM edges_tree UNION SELECT rc.root, e.dst FROM rc JOIN edges_tree e ON e.src = rc.node),
    w AS (SELECT root, count(*) AS reach FROM rc GROUP BY root),
    rt AS (SELECT fn_id, CASE WHEN kind = 'query' THEN 3 WHEN name LIKE 'handle%' THEN 0 WHEN name[1] = '_' THEN 2 ELSE 1 END AS entry, coalesce(reach, 1) AS reach, file, "start"
      FROM fs LEFT JOIN w ON w.root = fn_id WHERE fn_id NOT IN (SELECT dst FROM edges_tree)) """


@query("h3_flow_roots", "functions edges_tree", ROOTS + """
    SELECT fn_id, entry, reach, row_number() OVER (ORDER BY entry, reach DESC, file, "start", fn_id) AS rank FROM rt""")
def flow_roots(t):
    return graph.flow_roots(walk_functions(t), t.edges_tree)


@query("h3_flow_order", "functions edges_tree", ROOTS + """,
    rk AS (SELECT fn_id, row_number() OVER (ORDER BY entry, reach DESC, file, "start", fn_id) AS rank FROM rt),
    own AS (SELECT node, min(rank) AS rank FROM rc JOIN rk ON rk.fn_id = rc.root GROUP BY node),
    dp AS (SELECT fn_id AS node, 0 AS depth, rank, fn_id FROM rk UNION ALL SELECT e.dst, depth + 1, rank, fn_id FROM dp JOIN edges_tree e ON e.src = dp.node)
    SELECT o.node AS fn_id, d.depth, row_number() OVER (ORDER BY o.rank, d.depth) - 1 AS pos FROM own o JOIN dp d ON d.node = o.node AND d.rank = o.rank""")
def flow_order(t):
    """Every function calls the one at half its number: a walk is a chain down to the first taken function."""
    calls = t.edges_tree.withColumn("pos", F.lit(0))
    fns = walk_functions(t)
    return graph.flow_order(fns, calls, graph.flow_roots(fns, calls)).select("fn_id", "depth", "pos")


@query("h4_entry_class", "functions", f"""
    SELECT fn_id, CASE WHEN kind = 'query' THEN 3 WHEN name LIKE 'handle%' THEN 0 WHEN name[1] = '_' THEN 2 ELSE 1 END AS entry FROM ({WALK_FUNCTIONS})""")
def entry_class(t):
    return graph.entry_class(walk_functions(t)).select("fn_id", "entry")


@query("h5_up_down", "edges_tree", """
    WITH RECURSIVE d AS (SELECT p_partkey AS src, p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT d.src, e.dst FROM d JOIN edges_tree e ON e.src = d.node),
    u AS (SELECT p_partkey AS src, p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT u.src, e.src FROM u JOIN edges_tree e ON e.dst = u.node)
    SELECT src, node, 'down' AS side FROM d UNION ALL SELECT src, node, 'up' FROM u""")
def up_down(t):
    return graph.up_down(t.edges_tree, t.part.where("p_size = 7").selectExpr("p_partkey AS node"))


LAYERED = """SELECT DISTINCT p_partkey AS src, p_partkey // 2 - p_size % 2 AS dst FROM part WHERE p_partkey // 2 - p_size % 2 > 0 AND p_partkey > 3
    UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 > 0"""


def layered(t):
    return t.part.where("p_partkey div 2 - p_size % 2 > 0 AND p_partkey > 3").selectExpr("p_partkey AS src", "p_partkey div 2 - p_size % 2 AS dst").union(
        t.part.where("p_partkey div 3 > 0").selectExpr("p_partkey AS src", "p_partkey div 3 AS dst")).distinct()


@query("h6_dag_levels", "", f"""
    WITH RECURSIVE e AS ({LAYERED}), l AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)
      UNION SELECT e.dst, level + 1 FROM l JOIN e ON e.src = l.node)
    SELECT node, max(level) AS level FROM l GROUP BY node""")
def dag_levels(t):
    return graph.dag_levels(layered(t))


@query("h6_levels_cyclic", "", """
    SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS level FROM part WHERE p_partkey // 3 * 3 + 2 < (SELECT count(*) FROM part)""")
def levels_cyclic(t):
    """Threes: the first two call each other, the first also calls the third."""
    whole = t.part.where("p_partkey % 3 = 2").selectExpr("p_partkey div 3 AS g")
    edges = whole.selectExpr("stack(3, g * 3, g * 3 + 1, g * 3 + 1, g * 3, g * 3, g * 3 + 2) AS (src, dst)")
    return graph.dag_levels(edges)


@query("h7_lanes", "", f"""
    WITH RECURSIVE e AS (SELECT * FROM ({LAYERED}) WHERE dst % 31 <> 0),
    tops AS (SELECT p_partkey AS node, 0 AS label FROM part WHERE p_partkey % 31 = 0
      UNION ALL SELECT src, src + 1 FROM (SELECT DISTINCT src FROM ({LAYERED})) WHERE src % 31 <> 0 AND src NOT IN (SELECT dst FROM ({LAYERED}))),
    r AS (SELECT node, label FROM tops UNION SELECT e.dst, label FROM r JOIN e ON e.src = r.node)
    SELECT p_partkey AS fn_id, min(label) AS lane FROM part LEFT JOIN r ON node = p_partkey GROUP BY 1""")
def lanes(t):
    fns = t.part.selectExpr("p_partkey AS fn_id", "CASE WHEN p_partkey % 31 = 0 THEN 'modified' ELSE 'added' END AS status")
    e = layered(t)
    tops = e.selectExpr("src AS fn_id").distinct().join(e.selectExpr("dst AS fn_id"), "fn_id", "left_anti").selectExpr("fn_id", "fn_id + 1 AS rank")
    return graph.lanes(fns, e, tops)


@query("h8_reading_depth", "edges_down", """
    WITH RECURSIVE d AS (SELECT node AS fn_id, 0 AS depth, CAST(NULL AS BIGINT) AS via FROM (SELECT src AS node FROM edges_down EXCEPT SELECT dst FROM edges_down)
      UNION ALL SELECT e.dst, depth + 1, e.src FROM d JOIN edges_down e ON e.src = d.fn_id)
    SELECT fn_id, depth, via FROM d""")
def reading_depth(t):
    calls = t.edges_down.withColumn("pos", F.col("dst"))
    fns = graph.nodes_of(t.edges_down).selectExpr("node AS fn_id", "concat('f', node) AS name", "'a.py' AS file", "node AS start", "'function' AS kind")
    return graph.flow_order(fns, calls, graph.flow_roots(fns, calls)).select("fn_id", "depth", "via")


def relax(i: int) -> str:
    return f"""r{i} AS (SELECT subject, state, min(k) AS k FROM (SELECT * FROM r{i - 1} UNION ALL SELECT r.subject, m."to",
      CASE WHEN m.event_id > r.k[2] THEN (r.k[1], m.event_id, r.k[3] + 1) ELSE (r.k[1] + 1, m.event_id, r.k[3] + 1) END FROM r{i - 1} r
      JOIN moves m ON m.subject = r.subject AND m."from" = r.state) GROUP BY 1, 2)"""


@query("h9_state_levels", "moves", f"""
    WITH r0 AS (SELECT subject, 'view' AS state, CAST((0, -1, 0) AS STRUCT(a BIGINT, b BIGINT, c BIGINT)) AS k FROM moves GROUP BY 1),
    {", ".join(relax(i) for i in range(1, 6))}, s AS (SELECT DISTINCT subject, "to" AS state FROM moves UNION SELECT subject, 'view' FROM moves)
    SELECT subject, state, coalesce(k.c, 0) AS level FROM s LEFT JOIN r5 USING (subject, state)""".replace("r.k[1]", "r.k.a").replace("r.k[2]", "r.k.b").replace("r.k[3]", "r.k.c"))
def state_levels(t):
    moves = t.moves.withColumnRenamed("event_id", "pos")
    return graph.state_levels(moves, t.moves.selectExpr("subject", "field", "'view' AS state").distinct()).select("subject", "state", "level")


@query("h10_nest_flows", "", """
    WITH o AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS part, 1 AS flow, 0 AS under_flow, 1 AS under_step FROM o WHERE k % 4 <> 3
    UNION ALL SELECT k, 0, 2, 0 FROM o WHERE k % 4 = 2
    UNION ALL SELECT k, 2, 1, 0 FROM o WHERE k % 4 = 0
    UNION ALL SELECT k, 2, 0, 0 FROM o WHERE k % 4 IN (1, 3)""")
def nest_flows(t):
    """Three flows to a part: the second details a step of the first (unless it is a failure flow), the third one of the second or
    the first; in every fourth part the first starts where the third lands, and the third may then not hang below it."""
    o = t.orders.selectExpr("o_orderkey AS part")
    flows = o.selectExpr("part", "stack(3, 0, 'Main', 'GET /', CASE WHEN part % 4 = 2 THEN 'c0' ELSE 'zz' END, "
                         "1, CASE WHEN part % 4 = 3 THEN 'It fails' ELSE 'Second' END, 'on save()', 'x', "
                         "2, 'Third', CASE WHEN part % 4 = 0 THEN 'after check' ELSE 'later' END, CASE WHEN part % 4 = 0 THEN 'y' ELSE 'load' END) "
                         "AS (flow, title, trigger, first_actor)")
    names = o.selectExpr("part", "stack(4, 0, 0, 'load', 0, 1, 'save', 1, 0, CASE WHEN part % 4 = 0 THEN 'check' ELSE 'nothing' END, 2, 0, 'c0') AS (flow, pos, name)")
    drivers = o.selectExpr("part", "0 AS flow", "'boss' AS driver")
    return graph.nest_flows(flows, names, names, drivers, fx.GENERIC_ACTOR, fx.FAILURE_WORDS)


COMMITS = """SELECT p_partkey AS sha, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_size % 5 = 0"""


def commits(t):
    return t.part.where("p_partkey > 0").selectExpr("p_partkey AS sha", "p_partkey div 2 AS parent").union(
        t.part.where("p_partkey > 0 AND p_size % 5 = 0").selectExpr("p_partkey AS sha", "p_partkey div 3 AS parent"))


def commit_pairs(t):
    return t.part.where("p_partkey > 1").selectExpr("p_partkey AS a", "p_partkey - 1 AS b")


ANCESTORS = f"""WITH RECURSIVE c AS ({COMMITS}), r AS (SELECT p_partkey AS src, p_partkey AS node FROM part UNION SELECT r.src, c.parent FROM r JOIN c ON c.sha = r.node),
    p AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey > 1) """


@query("h11_merge_base", "", ANCESTORS + """,
    m AS (SELECT a, b, x.node FROM p JOIN r x ON x.src = a JOIN r y ON y.src = b AND y.node = x.node)
    SELECT a, b, min(node) AS base FROM m WHERE NOT EXISTS (SELECT 1 FROM m n JOIN c ON c.sha = n.node WHERE n.a = m.a AND n.b = m.b AND c.parent = m.node) GROUP BY a, b""")
def merge_base(t):
    return graph.merge_base(commits(t), commit_pairs(t))


@query("h11_ahead_behind", "", ANCESTORS + """,
    u AS (SELECT a, b, node, 1 AS x FROM p JOIN r ON src = a UNION ALL SELECT a, b, node, 2 FROM p JOIN r ON src = b),
    g AS (SELECT a, b, node, sum(x) AS x FROM u GROUP BY ALL)
    SELECT a, b, count(*) FILTER (x = 1) AS ahead, count(*) FILTER (x = 2) AS behind FROM g GROUP BY a, b""")
def ahead_behind(t):
    return graph.ahead_behind(commits(t), commit_pairs(t))


def tree_steps(t):
    """A function per order: step 1 is an if, odd lines are its then-branch, even ones follow it."""
    return t.order_steps.selectExpr(
        "fn_id", "n AS pos", "concat('n', n) AS id", "CASE WHEN n = 1 THEN 'decision' WHEN s % 3 = 0 THEN 'return' ELSE 'call' END AS kind",
        "s % 2 = 0 AS error", "s % 5 = 0 AS changed",
        "CASE WHEN n > 1 AND n % 2 = 1 THEN array(named_struct('head', 'n1', 'branch', 'then')) ELSE cast(array() AS ARRAY<STRUCT<head: STRING, branch: STRING>>) END AS path")


@query("h12_step_paths", "order_steps", """
    SELECT x.fn_id, 'n' || x.n AS id, 'n' || y.n AS on_path FROM order_steps x JOIN order_steps y ON x.fn_id = y.fn_id AND y.n <= x.n
    WHERE (x.n % 2 = 1 AND x.n > 1 AND y.n > 1 AND y.n % 2 = 1) OR (x.n % 2 = 1 AND x.n > 1 AND y.n = 1 AND EXISTS (SELECT 1 FROM order_steps z WHERE z.fn_id = x.fn_id AND z.n = 1))
      OR ((x.n = 1 OR x.n % 2 = 0) AND (y.n = 1 OR y.n % 2 = 0))
    UNION SELECT x.fn_id, 'n' || x.n, 'n' || y.n FROM order_steps x JOIN order_steps y ON x.fn_id = y.fn_id AND y.n <= x.n AND y.n % 2 = 0
    WHERE x.n % 2 = 1 AND x.n > 1 AND NOT EXISTS (SELECT 1 FROM order_steps z WHERE z.fn_id = x.fn_id AND z.n = 1)""")
def step_paths(t):
    return graph.step_paths(tree_steps(t))


@query("h13_block_stats", "order_steps", """
    SELECT fn_id, 'n1' AS head, 'then' AS branch, count(*) FILTER (n > 1 AND n % 2 = 1) AS steps, false AS collapsible,
      coalesce(arg_max(s, n) FILTER (n > 1 AND n % 2 = 1) % 3 = 0, false) AS ends FROM order_steps GROUP BY fn_id HAVING count(*) FILTER (n > 1 AND n % 2 = 1) > 0""")
def block_stats(t):
    return graph.block_stats(tree_steps(t))


@query("h15_changed_only", "order_steps", """
    SELECT fn_id, n AS pos FROM order_steps x WHERE s % 5 = 0 OR (n = 1 AND EXISTS (SELECT 1 FROM order_steps y WHERE y.fn_id = x.fn_id AND y.n > 1 AND y.n % 2 = 1 AND y.s % 5 = 0))""")
def changed_only(t):
    return graph.changed_only(tree_steps(t)).select("fn_id", "pos")


@query("h14_find_slices", "", """
    WITH f AS (SELECT o_custkey AS repo, CASE o_orderkey % 5 WHEN 0 THEN 'svc' || o_orderkey % 3 || '/go.mod' WHEN 1 THEN 'svc' || o_orderkey % 3 || '/in/package.json'
        WHEN 2 THEN 'svc' || o_orderkey % 3 || '/in/a' || o_orderkey || '.go' WHEN 3 THEN 'lib/x' || o_orderkey || '.py' ELSE 'm' || o_orderkey || '.py' END AS path FROM orders),
    p AS (SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', '') AS p FROM f WHERE path LIKE '%go.mod' OR path LIKE '%package.json'),
    o AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.repo = p.repo AND q.p <> p.p AND p.p LIKE q.p || '/%')),
    s AS (SELECT repo, p AS slice FROM o WHERE EXISTS (SELECT 1 FROM f WHERE f.repo = o.repo AND f.path LIKE o.p || '/%.go')),
    c AS (SELECT * FROM f WHERE (path LIKE '%.go' OR path LIKE '%.py') AND repo NOT IN (SELECT repo FROM s)),
    g AS (SELECT repo, split_part(path, '/', 1) AS sub, count(*) AS n FROM c WHERE path LIKE '%/%' GROUP BY 1, 2),
    r AS (SELECT repo, count(*) AS n, count(*) FILTER (path NOT LIKE '%/%') AS here FROM c GROUP BY 1)
    SELECT * FROM s UNION ALL SELECT repo, '.' FROM r WHERE here > 0 OR NOT EXISTS (SELECT 1 FROM g WHERE g.repo = r.repo AND g.n >= 3)
    UNION ALL SELECT g.repo, CASE WHEN sub LIKE 'svc%' AND g.n * 2 > r.n AND g.n >= 15 THEN sub || '/in' ELSE sub END FROM g JOIN r ON r.repo = g.repo WHERE g.n >= 3""")
def find_slices(t):
    files = t.orders.selectExpr(
        "o_custkey AS repo", "CASE o_orderkey % 5 WHEN 0 THEN concat('svc', o_orderkey % 3, '/go.mod') WHEN 1 THEN concat('svc', o_orderkey % 3, '/in/package.json') "
        "WHEN 2 THEN concat('svc', o_orderkey % 3, '/in/a', o_orderkey, '.go') WHEN 3 THEN concat('lib/x', o_orderkey, '.py') ELSE concat('m', o_orderkey, '.py') END AS path")
    return graph.find_slices(files, ["repo"])


@query("h14_code_slices", "", """
    WITH f AS (SELECT c_nationkey AS repo, c_custkey AS k FROM customer),
    n AS (SELECT repo, count(*) AS n, count(*) FILTER (k % 4 <> 0) AS app, count(*) FILTER (k % 4 = 0) AS lib, count(*) FILTER (k % 4 <> 0 AND k % 3 = 0) AS core,
      count(*) FILTER (k % 4 <> 0 AND k % 3 <> 0) AS web FROM f GROUP BY repo)
    SELECT repo, 'lib' AS slice FROM n WHERE lib >= 3 AND NOT (lib * 2 > n AND lib >= 15)
    UNION ALL SELECT repo, 'app' FROM n WHERE app >= 3 AND NOT (app * 2 > n AND app >= 15)
    UNION ALL SELECT repo, 'app/core' FROM n WHERE app * 2 > n AND app >= 15 AND core >= 3 AND NOT (core * 2 > app AND core >= 15)
    UNION ALL SELECT repo, 'app/web' FROM n WHERE app * 2 > n AND app >= 15 AND web >= 3
    UNION ALL SELECT repo, '.' FROM n WHERE lib < 3 AND app < 3""")
def code_slices(t):
    files = t.customer.selectExpr("c_nationkey AS repo", "CASE WHEN c_custkey % 4 = 0 THEN concat('lib/a', c_custkey, '.py') WHEN c_custkey % 3 = 0 THEN "
                                  "concat('app/core/b', c_custkey, '.py') ELSE concat('app/web/c', c_custkey, '.py') END AS path")
    return graph.code_slices(files, ["repo"])
