"""Joins: prefix, innermost interval, name resolution, pairing, as-of. All have an equality key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import scalars as S
from .ordered import asof, first_per, spread_join, top_k


# ---- prefix joins ----------------------------------------------------------------------------------
def ancestor_rows(paths: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """(by, path, folder): every folder holding the path and the path itself; '' is the root."""
    return paths.select(*by, path).distinct().select(*by, path, F.explode(F.expr(S.ancestors(path))).alias("folder"))


def folder_key(folder: str = "folder") -> str:
    """SQL: a folder name as it appears among ancestors."""
    return f"CASE WHEN {folder} = '.' THEN '' ELSE rtrim('/', {folder}) END"


def owner_of(paths: DataFrame, owners: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """(by, path, owner): the owner of the deepest folder holding each path; null when none.

    A longest-prefix join without a LIKE: paths are exploded into their few ancestors and joined on equality.
    Ties (two owners of one folder) go to the smaller owner id.
    """
    own = owners.selectExpr(*by, "owner", f"{folder_key()} AS folder", f"length({folder_key()}) AS depth")
    return (ancestor_rows(paths, by, path).join(own, [*by, "folder"], "left")
            .groupBy(*by, path).agg(F.expr("min_by(owner, CASE WHEN owner IS NOT NULL THEN struct(-depth, owner) END)")
                                    .alias("owner")))


def below_any(paths: DataFrame, folders: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """The distinct paths lying in (or being) any of the folders."""
    wanted = folders.selectExpr(*by, f"{folder_key()} AS folder")
    return ancestor_rows(paths, by, path).join(wanted, [*by, "folder"], "left_semi").select(*by, path).distinct()


# ---- interval joins --------------------------------------------------------------------------------
def enclosing(points: DataFrame, intervals: DataFrame, keys: Sequence[str], line: str = "line",
              take: Sequence[str] = ("fn_id",), order: Sequence[str] = ("start",), start: str = "start",
              end: str = "end", block: int = 256) -> DataFrame:
    """(keys, line, take): for each distinct point the smallest interval holding it; points outside are absent.

    Both sides meet on (keys, block of lines): a file or key with very many points and intervals is spread over
    its blocks, and inside one block only intervals touching it are compared. Ties go by ``order``.
    """
    p = points.select(*keys, line).distinct().withColumn("_block", F.expr(f"`{line}` div {block}"))
    spread = intervals.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"),
                              F.struct(*take).alias("_take"), F.struct(*order).alias("_order"),
                              F.explode(F.expr(f"sequence(`{start}` div {block}, `{end}` div {block})")).alias("_block"))
    return (p.join(spread, [*keys, "_block"]).where(f"`{line}` BETWEEN _start AND _end")
            .groupBy(*keys, line).agg(F.expr("min_by(_take, struct(_end - _start, _order))").alias("_t"))
            .select(*keys, line, "_t.*"))


def pick_calls(refs: DataFrame, spans: DataFrame, keys: Sequence[str], block: int = 256) -> DataFrame:
    """(keys, line, call_id): the call a reference line means. Of the calls starting on the line the outermost,
    otherwise the smallest one spanning it. spans: (keys, call_id, start, end, first_byte, last_byte)."""
    p = refs.select(*keys, "line").distinct().withColumn("_block", F.expr(f"line div {block}"))
    spread = spans.withColumn("_block", F.explode(F.expr(f"sequence(start div {block}, `end` div {block})")))
    order = ("struct(start <> line AS a, CASE WHEN start = line THEN first_byte ELSE last_byte - first_byte END AS b, "
             "CASE WHEN start = line THEN -last_byte ELSE 0 END AS c, call_id AS d)")
    return (p.join(spread, [*keys, "_block"]).where("line BETWEEN start AND `end`")
            .groupBy(*keys, "line").agg(F.expr(f"min_by(call_id, {order})").alias("call_id")))


# ---- topics ----------------------------------------------------------------------------------------
def topic_links(publishes: DataFrame, subscribes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Publisher to subscriber edges, one per topic, never to itself. Inputs: (by, part, topic)."""
    a = publishes.select(*by, F.col("part").alias("src"), "topic").distinct()
    b = subscribes.select(*by, F.col("part").alias("dst"), "topic").distinct()
    return a.join(b, [*by, "topic"]).where("src <> dst").select(
        *by, "src", "dst", F.concat(F.lit("PubSub: "), "topic").alias("how"), F.lit(1).cast("bigint").alias("weight"))


# ---- names -----------------------------------------------------------------------------------------
def few_owners(functions: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Functions whose name has at most ``limit`` owners; the count runs before any name join, so a name shared
    by thousands of functions never fans out."""
    rare = functions.groupBy(*by, "name").agg(F.count("*").alias("_n")).where(F.col("_n") <= limit).drop("_n")
    return functions.join(rare, [*by, "name"], "left_semi")


def mentions_of(bodies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, qualifier, name) of every identifier in each body (fn_id, body), strings and comments dropped."""
    return (bodies.select(*by, "fn_id", F.explode(F.expr(S.qualified_names(S.strip_strings_comments("body")))).alias("m"))
            .select(*by, "fn_id", "m.qualifier", "m.name"))


def resolve_calls(mentions: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst): functions a mention ``qualifier.name`` most likely means. A name with more than three
    candidates means nothing, so each mention meets at most four rows."""
    callers = functions.select(*by, F.col("fn_id").alias("src"), F.col("parent").alias("caller_parent"),
                               F.expr(S.folder_of("path")).alias("caller_folder"))
    owners = few_owners(functions.where("kind <> 'Class'"), 4, by).select(
        *by, "name", F.col("fn_id").alias("dst"), "parent", F.expr(S.folder_of("path")).alias("folder"))
    m = mentions.select(*by, F.col("fn_id").alias("src"), "qualifier", "name").distinct()
    found = m.join(owners, [*by, "name"]).where("src <> dst")
    # is the candidate's type mentioned by the caller?
    named = m.select(*by, "src", F.col("name").alias("parent")).distinct().withColumn("type_named", F.lit(True))
    found = found.join(named, [*by, "src", "parent"], "left").join(callers, [*by, "src"])
    rows = found.groupBy(*by, "src", "qualifier", "name", "caller_parent", "caller_folder").agg(
        F.collect_list(F.struct("dst", "parent", "folder", F.coalesce("type_named", F.lit(False)).alias("named")))
        .alias("cands")).where("size(cands) <= 3")
    methods = "filter(cands, c -> c.parent IS NOT NULL)"
    typed = (f"filter({methods}, c -> c.parent <=> caller_parent OR c.named OR (length(qualifier) > 2 AND "
             "(endswith(lower(c.parent), lower(qualifier)) OR endswith(lower(qualifier), lower(c.parent)))))")
    near = "filter(cands, c -> c.folder = caller_folder)"
    none = "slice(cands, 1, 0)"
    pick = (f"CASE WHEN size({methods}) > 0 THEN CASE WHEN qualifier IS NULL OR "
            f"array_contains({S.texts(fx.PROTOCOL_NAMES)}, name) THEN {none} "
            f"WHEN size({typed}) > 0 THEN {typed} WHEN size({methods}) = 1 THEN {methods} ELSE {none} END "
            f"WHEN qualifier <> '' THEN filter(cands, c -> {S.base_name('c.folder')} = qualifier) "
            f"WHEN size({near}) > 0 THEN {near} WHEN size(cands) = 1 THEN cands ELSE {none} END")
    return rows.select(*by, "src", F.explode(F.expr(pick)).alias("c")).select(*by, "src", "c.dst").distinct()


def type_usage(mentions: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst): function src mentions type dst (a name with at most three types), not its own parent."""
    types = few_owners(functions.where("kind = 'Class'"), 3, by).select(*by, "name", F.col("fn_id").alias("dst"))
    users = functions.where("kind <> 'Class'").select(*by, F.col("fn_id").alias("src"), "parent")
    named = mentions.select(*by, F.col("fn_id").alias("src"), "name").distinct()
    return (named.join(types, [*by, "name"]).join(users, [*by, "src"])
            .where("NOT (name <=> parent)").select(*by, "src", "dst").distinct())


def connect(sites: DataFrame, reviewed: DataFrame, local_names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Call sites (fn_id, name, recv, line) joined to the reviewed function each can only mean.

    reviewed: (fn_id, name, parent, file, kind). local_names: (file, name) defined in the head of each file. A query is
    reachable from anywhere and the own file always; another file only in the same language, for a name that is neither
    common nor defined in the caller's file: a method through an object, a plain function bare, in Go, or through its
    module or package. Of several candidates the one in the caller's folder is taken, if it is one.

    Only how many candidates there are, and one of them, matters. Candidates under a narrow key (own file, module name,
    queries) are joined; the wide ones, every method or plain function of a name, are counted per name, folder and file
    first and looked up, so a name defined in very many files never meets its call sites one by one.
    """
    f = reviewed.selectExpr(*by, "fn_id", "file AS f_file", f"{S.folder_of('file')} AS f_folder", f"{S.lang_family('file')} AS family")
    t = reviewed.selectExpr(
        *by, "fn_id AS `to`", "name", "file AS g_file", f"{S.folder_of('file')} AS g_folder", f"{S.lang_family('file')} AS family",
        "kind <=> 'query' AS is_query", "CASE WHEN parent IS NOT NULL THEN 'method' ELSE 'plain' END AS cls",
        f"array_distinct(array({S.file_stem('file')}, {S.base_name(S.folder_of('file'))})) AS modules")
    own = local_names.select(*by, F.col("file").alias("f_file"), "name").distinct().withColumn("is_local", F.lit(True))
    key = [*by, "fn_id", "name", "recv", "line"]
    site = sites.select(*key).distinct().join(f, [*by, "fn_id"]).join(own, [*by, "f_file", "name"], "left")
    wide = site.where(f"is_local IS NULL AND family IS NOT NULL AND NOT array_contains({S.texts(fx.COMMON_NAMES)}, name)")
    seen = lambda df: df.selectExpr(*key, "1L AS n", "`to`", "CASE WHEN g_folder = f_folder THEN 1L ELSE 0L END AS n_near",
                                    "CASE WHEN g_folder = f_folder THEN `to` END AS near")
    query = seen(site.join(t.where("is_query").drop("family"), [*by, "name"]).where("`to` <> fn_id"))
    same = seen(site.join(t.where("NOT is_query").drop("family").withColumn("f_file", F.col("g_file")), [*by, "name", "f_file"]).where("`to` <> fn_id"))
    module = t.where("NOT is_query AND cls = 'plain' AND family <> 'go'").withColumn("recv", F.explode("modules")).where("recv <> ''")
    named = seen(wide.join(module, [*by, "name", "family", "recv"]).where("g_file <> f_file"))

    # every method, or plain function, of a name outside the caller's file: totals less the own file's
    others = t.where("NOT is_query").groupBy(*by, "name", "family", "cls", "g_folder", "g_file").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    ends = [F.sum("n").alias("n"), F.min("g_file").alias("lo"), F.min_by("to", "g_file").alias("lo_to"), F.max_by("to", "g_file").alias("hi_to")]
    name = [*by, "name", "family", "cls"]
    total = others.groupBy(*name).agg(*ends)
    near = others.groupBy(*name, F.col("g_folder").alias("f_folder")).agg(*ends)
    mine = others.select(*name, F.col("g_file").alias("f_file"), F.col("n").alias("own"))
    classes = ("filter(array(CASE WHEN recv NOT IN ('', 'self', 'this', 'cls') THEN 'method' END, "
               "CASE WHEN recv = '' OR family = 'go' THEN 'plain' END), c -> c IS NOT NULL)")
    asked = wide.withColumn("cls", F.explode(F.expr(classes))).join(mine, [*name, "f_file"], "left")
    # with one candidate left, at most two files hold the name: the caller's and the candidate's
    left = lambda df: df.selectExpr(*key, "cls", "n - coalesce(own, 0) AS n", "CASE WHEN own IS NOT NULL AND lo = f_file THEN hi_to ELSE lo_to END AS `to`")
    counted = left(asked.join(total, name)).join(
        left(asked.join(near, [*name, "f_folder"])).withColumnRenamed("n", "n_near").withColumnRenamed("to", "near"), [*key, "cls"], "left")
    counted = counted.selectExpr(*key, "n", "CASE WHEN n > 0 THEN `to` END AS `to`", "coalesce(n_near, 0) AS n_near", "CASE WHEN n_near > 0 THEN near END AS near")
    one = query.unionByName(same).unionByName(named).unionByName(counted).groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("to").alias("any_to"), F.sum("n_near").alias("n_near"), F.min("near").alias("near_to"))
    return one.selectExpr(*key, "CASE WHEN n = 1 THEN any_to WHEN n_near = 1 THEN near_to END AS `to`").where("`to` IS NOT NULL")


def known_names(functions: DataFrame, parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, name): names callable as "ours" from each part: functions below its own folder or below any
    library's, generated files left out. Library names are shared rows (part null), not copied per part."""
    fns = functions.where(f"kind <> 'Class' AND NOT {S.is_generated('path')}").select(*by, "name", "path")
    rows = ancestor_rows(fns, by).join(
        parts.where("path <> ''").selectExpr(*by, "id AS part", "kind AS part_kind", f"{folder_key('path')} AS folder"),
        [*by, "folder"])
    placed = fns.join(rows.select(*by, "path", "part", "part_kind"), [*by, "path"])
    own = placed.select(*by, "part", "name")
    library = placed.where("part_kind = 'library'").select(*by, F.lit(None).cast("string").alias("part"), "name")
    return own.unionByName(library).distinct()


def callers(functions: DataFrame, calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, name, caller): distinct names of functions calling any definition of (path, name)."""
    target = functions.select(*by, F.col("fn_id").alias("dst"), "path", "name")
    source = functions.select(*by, F.col("fn_id").alias("src"), F.col("name").alias("caller"))
    return (calls.join(target, [*by, "dst"]).join(source, [*by, "src"])
            .select(*by, "path", "name", "caller").distinct())


def touch_externals(functions: DataFrame, uses: DataFrame, flow_steps: DataFrame, externals: DataFrame,
                    by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, target, kind, ref): outside systems each function touches, the first reference of each."""
    refs = uses.select(*by, "target", "ref").unionByName(flow_steps.select(*by, F.col("to").alias("target"), "ref"))
    placed = (refs.distinct().withColumn("r", F.expr(S.parse_ref("ref"))).where("r IS NOT NULL")
              .select(*by, "target", "ref", F.col("r.path").alias("path"), F.col("r.line").alias("line"))
              .join(externals.select(*by, F.col("id").alias("target"), "kind"), [*by, "target"]))
    inside = enclosing(placed, functions, [*by, "path"], take=("fn_id",), order=("fn_id",))
    hits = placed.join(inside, [*by, "path", "line"]).select(*by, "fn_id", "target", "kind", "ref")
    return first_per(hits, [*by, "fn_id", "target"], ["ref"])


def mentioned_in_tests(functions: DataFrame, test_files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, test): test files (path, content) whose identifiers include the function's name. Names that very many functions
    bear and very many tests mention are dealt out over tasks."""
    names = test_files.select(*by, F.col("path").alias("test"), F.explode(F.expr(S.identifiers("content"))).alias("name"))
    return spread_join(functions.select(*by, "fn_id", "name"), names, [*by, "name"]).select(*by, "fn_id", "test")


def entries_through(routes: DataFrame, names: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """(by, name, line_id, label): routes with a station of that name. routes: (by, line_id, label, station)."""
    stations = routes.select(*by, "line_id", "label", F.col("station").alias("name"))
    return stations.join(names.select(*by, "name").distinct(), [*by, "name"], "left_semi").distinct()


def handler_of(exposes: DataFrame, lines: DataFrame, functions: DataFrame, reach: DataFrame,
               by: Sequence[str] = (), window: int = 5) -> DataFrame:
    """(by, entry_id, fn_id): the function that serves each exposed entry (entry_id, path, line).

    The registration statement runs from the reference until its brackets close, at most five lines. The handler
    is the last function named in it as a value; of several, the one whose type is the named receiver, then the one
    reaching most. When none is named, the innermost function around the reference.
    """
    near = exposes.selectExpr(*by, "entry_id", "path", "line", f"explode(sequence(line, line + {window - 1})) AS line_no")
    statement = near.join(lines, [*by, "path", "line_no"]).groupBy(*by, "entry_id", "path", "line").agg(
        F.expr("transform(array_sort(collect_list(struct(line_no, text))), r -> r.text)").alias("ls"))
    opened = "(length(x) - length(replace(x, '(', '')) - length(x) + length(replace(x, ')', '')))"
    closed_at = ("coalesce(nullif(array_position(transform(ls, (t, i) -> aggregate(slice(ls, 1, i + 1), 0, (a, x) -> "
                 f"a + {opened}) <= 0), true), 0), size(ls))")
    text = statement.selectExpr(*by, "entry_id", "path", "line",
                                f"array_join(slice(ls, 1, cast({closed_at} AS INT)), '\n') AS text")
    values = text.select(*by, "entry_id", "text", F.posexplode(
        F.expr(r"regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\b(?!\\s*\\.)', 1)")).alias("at", "name"))
    live = functions.where("kind <> 'Class' AND NOT is_test AND NOT contains(lower(path), 'mock')").select(
        *by, "fn_id", "name", "parent")
    owned = values.join(live.select(*by, "name").distinct(), [*by, "name"], "left_semi")
    last = owned.groupBy(*by, "entry_id").agg(F.max_by(F.struct("name", "text"), "at").alias("v")).select(
        *by, "entry_id", "v.name", "v.text")
    receiver = (r"exists(regexp_extract_all(text, concat('(\\w+)\\s*\\.\\s*', name, '\\b'), 1), "
                "r -> lower(r) = lower(coalesce(parent, '')))")
    named = (last.join(live, [*by, "name"]).join(reach.select(*by, "fn_id", "reach"), [*by, "fn_id"], "left")
             .withColumn("hit", F.expr(receiver)).groupBy(*by, "entry_id")
             .agg(F.expr("max_by(fn_id, struct(hit, coalesce(reach, 1), -fn_id))").alias("named_fn")))
    around = exposes.join(enclosing(exposes, functions, [*by, "path"], order=("fn_id",)), [*by, "path", "line"]).select(
        *by, "entry_id", F.col("fn_id").alias("around_fn"))
    allowed = functions.where("NOT is_test AND NOT contains(lower(path), 'mock')").select(*by, "fn_id")
    return (text.select(*by, "entry_id").join(named, [*by, "entry_id"], "left").join(around, [*by, "entry_id"], "left")
            .select(*by, "entry_id", F.coalesce("named_fn", "around_fn").alias("fn_id")).where("fn_id IS NOT NULL")
            .join(allowed, [*by, "fn_id"], "left_semi").select(*by, "entry_id", "fn_id"))


# ---- references ------------------------------------------------------------------------------------
def verify_refs(claims: DataFrame, lines: DataFrame, by: Sequence[str] = (), window: int = fx.FN_WINDOW,
                block: int = 64) -> DataFrame:
    """(by, ref, verified): a reference holds when its line exists and, if a function is claimed, the function's
    last name occurs within five lines; all claims about a reference must hold."""
    c = claims.select(*by, "ref", "fn").distinct().withColumn("r", F.expr(S.parse_ref("ref")))
    name = r"trim(BOTH '()' FROM element_at(split(fn, '\\.'), -1))"
    placed = c.where("r IS NOT NULL").selectExpr(*by, "ref", "fn", "r.path AS path", "r.line AS line",
                                                 f"nullif({name}, '') AS _name")
    spread = placed.withColumn("_block", F.explode(F.expr(
        f"sequence(greatest(line - {window}, 0) div {block}, (line + {window}) div {block})")))
    hits = (lines.withColumn("_block", F.expr(f"line_no div {block}"))
            .join(spread, [*by, "path", "_block"]).where(f"line_no BETWEEN line - {window} AND line + {window}")
            .groupBy(*by, "ref", "fn").agg(F.max(F.expr("line_no = line")).alias("there"),
                                           F.max(F.expr("contains(text, coalesce(_name, ''))")).alias("named")))
    judged = c.alias("c").join(hits.alias("h"), [F.col(f"c.{k}") == F.col(f"h.{k}") for k in (*by, "ref")]
                               + [F.expr("c.fn <=> h.fn")], "left")
    return judged.groupBy(*[F.col(f"c.{k}").alias(k) for k in (*by, "ref")]).agg(
        F.bool_and(F.expr("coalesce(h.there AND (coalesce(c.fn, '') = '' OR h.named), false)")).alias("verified"))


def distinct_refs(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, part, refs): the sorted distinct references of each part record, read inside the record itself."""
    exprs = ("filter(concat(transform(exposes, e -> e.ref), transform(uses, u -> u.ref), "
             "transform(flatten(transform(flows, f -> f.steps)), s -> s.ref)), r -> r <> '')")
    return parts.select(*by, F.col("id").alias("part"), F.expr(f"array_sort(array_distinct({exprs}))").alias("refs")).where(
        "size(refs) > 0")


def ref_filter(items: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Narrative references (item, ref) kept only when the file is in the change and the line inside its head.
    files: (path, head_lines)."""
    placed = items.withColumn("r", F.expr(S.parse_ref("ref"))).where("r IS NOT NULL")
    placed = placed.withColumn("path", F.col("r.path")).withColumn("line", F.col("r.line")).drop("r")
    return placed.join(files.select(*by, "path", "head_lines"), [*by, "path"]).where(
        "line BETWEEN 1 AND head_lines").select(*items.columns)


# ---- revisions -------------------------------------------------------------------------------------
def match_functions(base: DataFrame, head: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Pairs functions (keys, parent, name, start, fn_id) of two versions: k-th with k-th of equal (parent, name),
    then leftovers by name when it is unique on both sides. Result: (keys, base_id, head_id)."""
    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "parent", "name").orderBy("start", "fn_id")
        return df.select(*keys, F.coalesce("parent", F.lit("")).alias("parent"), "name", "start", "fn_id").withColumn(
            "k", F.row_number().over(w))
    on = [*keys, "parent", "name", "k"]
    b = numbered(base).select(*on, F.col("fn_id").alias("base_id"))
    h = numbered(head).select(*on, F.col("fn_id").alias("head_id"))
    both = b.join(h, on, "full")
    paired = both.where("base_id IS NOT NULL AND head_id IS NOT NULL").select(*keys, "base_id", "head_id")
    def single(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min(side).alias(side)).where("n = 1").drop("n")
    left = both.where("head_id IS NULL").select(*keys, "name", "base_id")
    free = both.where("base_id IS NULL").select(*keys, "name", "head_id")
    second = single(left, "base_id").join(single(free, "head_id"), [*keys, "name"]).select(*keys, "base_id", "head_id")
    rest_b = left.join(second, [*keys, "base_id"], "left_anti").select(
        *keys, "base_id", F.lit(None).cast(head.schema["fn_id"].dataType).alias("head_id"))
    rest_h = free.join(second, [*keys, "head_id"], "left_anti").select(
        *keys, F.lit(None).cast(base.schema["fn_id"].dataType).alias("base_id"), "head_id")
    return paired.unionByName(second).unionByName(rest_b).unionByName(rest_h)


def carry_lines(targets: DataFrame, line_ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Values on head lines (path, line, target) carried to the equal base lines."""
    same = line_ops.where("op = '='").select(*by, "path", F.col("head_line").alias("line"), "base_line")
    return targets.join(same, [*by, "path", "line"]).select(*by, "path", F.col("base_line").alias("line"), "target")


def old_path(paths: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, old): the path at the base: a renamed file's old one, else itself."""
    moved = files.where("old <> ''").select(*by, "path", F.col("old").alias("_old"))
    return paths.join(moved, [*by, "path"], "left").select(*by, "path", F.coalesce("_old", "path").alias("old"))


def attach_changes(changes: DataFrame, steps: DataFrame, line_map: DataFrame, by: Sequence[str] = ("fn_id",)) -> DataFrame:
    """(by, change_id, pos): the step each change belongs to.

    steps: (by, pos, kind, line, base_line, removed). line_map: (by, base_line, head_line) of unchanged lines.
    On its line (same kind first), else the closest step above; a removed line goes to a removed step, else to the
    closest base line above, else to the head line it maps to; else to the first step.
    """
    want = f"element_at({S.table(fx.KIND_OF)}, c_kind)"
    c = changes.select(*by, "change_id", F.col("kind").alias("c_kind"), "head_line", "base_line")
    heads = steps.where("NOT removed AND kind <> 'exit'")
    ghosts = steps.where("removed")
    fit = f"min_by(pos, struct(CASE WHEN {want} IS NULL OR {want} = kind THEN 0 ELSE 1 END, pos))"
    def exact(c_side: str, nodes: DataFrame, line: str, out: str) -> DataFrame:
        n = nodes.select(*by, "pos", "kind", F.col(line).alias(c_side))
        return c.where(f"{c_side} > 0").join(n, [*by, c_side]).groupBy(*by, "change_id").agg(F.expr(fit).alias(out))
    def above(c_side: str, nodes: DataFrame, line: str, out: str) -> DataFrame:
        marks = nodes.where(f"{line} IS NOT NULL").groupBy(*by, F.col(line).alias(c_side)).agg(F.min("pos").alias(out))
        wanted = c.where(f"{c_side} > 0")
        return wanted.join(asof(wanted, marks, by, c_side, out), [*by, c_side]).select(*by, "change_id", out)
    mapped = c.where("base_line > 0").join(line_map.select(*by, "base_line", F.col("head_line").alias("line")), [*by, "base_line"])
    mapped = mapped.join(heads.select(*by, "line", "pos"), [*by, "line"]).groupBy(*by, "change_id").agg(F.min("pos").alias("p5"))
    first = steps.groupBy(*by).agg(F.min("pos").alias("p6"))
    key = [*by, "change_id"]
    return (c.join(exact("head_line", heads, "line", "p1"), key, "left")
            .join(above("head_line", heads, "line", "p2"), key, "left")
            .join(exact("base_line", ghosts, "base_line", "p3"), key, "left")
            .join(above("base_line", steps, "base_line", "p4"), key, "left")
            .join(mapped, key, "left").join(first, [*by], "left")
            .selectExpr(*by, "change_id", "coalesce(CASE WHEN head_line > 0 THEN coalesce(p1, p2) "
                        "WHEN base_line > 0 THEN coalesce(p3, p4, p5) END, p6) AS pos"))


# ---- small semi and anti joins -----------------------------------------------------------------------
def branch_list(local: DataFrame, remote: DataFrame, by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Branches (name, updated): local ones first, then remote ones without a local namesake, newest first; all of
    them, or k per scope."""
    short = F.expr("CASE WHEN instr(name, '/') > 0 THEN substring(name, instr(name, '/') + 1) ELSE name END")
    names = local.select(*by, F.col("name").alias("_short")).distinct()
    fresh = remote.withColumn("_short", short).join(names, [*by, "_short"], "left_anti").drop("_short")
    both = local.withColumn("remote", F.lit(False)).unionByName(fresh.withColumn("remote", F.lit(True)))
    return top_k(both, by, ["remote", F.col("updated").desc(), "name"], k)


def flows_through(flow_steps: DataFrame, touched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, seed, flow_id, shared): flows using any of the ids (seed, id), the seed flow itself left out. Sort by
    ``shared`` descending for the reading order."""
    actors = flow_steps.select(*by, "flow_id", F.col("from").alias("id")).union(
        flow_steps.select(*by, "flow_id", "to")).where("id IS NOT NULL").distinct()
    return (touched.select(*by, "seed", "id").distinct().join(actors, [*by, "id"]).where("seed <> flow_id")
            .groupBy(*by, "seed", "flow_id").agg(F.count("*").alias("shared")))


def resource_edges(functions: DataFrame, effects: DataFrame, calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fn_id, kind, target, is_write): function to table, queue or storage. Code calling a query gets no
    table edge of its own; a write wins over a read."""
    queries = functions.where("kind = 'query'").select(*by, F.col("fn_id").alias("dst"))
    via = calls.join(queries, [*by, "dst"], "left_semi").select(*by, F.col("src").alias("fn_id")).distinct().withColumn(
        "via_query", F.lit(True))
    e = effects.where(F.col("kind").isin("db", "queue", "storage")).join(
        functions.select(*by, "fn_id", F.col("kind").alias("fn_kind")), [*by, "fn_id"]).join(via, [*by, "fn_id"], "left")
    return (e.where("NOT (kind = 'db' AND NOT fn_kind <=> 'query' AND via_query IS NOT NULL)")
            .groupBy(*by, "fn_id", "kind", "target").agg(F.max(F.expr("op <> 'reads'")).alias("is_write")))


def external_usage(uses: DataFrame, externals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, src, times, first_ref): who uses each outside system, how often and where first."""
    return uses.join(externals.select(*by, F.col("id").alias("target")), [*by, "target"], "left_semi").groupBy(
        *by, F.col("target").alias("id"), "src").agg(F.count("*").alias("times"), F.min_by("ref", "pos").alias("first_ref"))


def gates_of_part(gate_rows: DataFrame, part: str, by: Sequence[str] = ()) -> DataFrame:
    """The gates read or checked in a part; gate_rows: (by, gate, part) of reads and checks."""
    return gate_rows.where(F.col("part") == part).select(*by, "gate").distinct()
