"""The driver's tables seen as operator inputs.

Each adapter is stated twice: as a DataFrame (method of ``Tables``) and as SQL (entry of ``VIEWS``), so that a
query and its oracle start from the same rows. Adapters use whole tables; where one splits rows (base and head
snapshots) the split is part of the derived data, not a sample.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import carry_forward
from ..session import cut
from ..sources.files import explode_lines


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # ---- documents -----------------------------------------------------------------------------
    @cached_property
    def corpus(self) -> DataFrame:
        return self.documents.selectExpr(
            "concat(source, '/', lang, '/', doc_id, '.txt') AS path", "text AS content",
            "cast(octet_length(text) AS BIGINT) AS size", "sha1(text) AS sha", "doc_id")

    @cached_property
    def corpus_lines(self) -> DataFrame:
        return explode_lines(self.corpus).select("path", "line_no", "text")

    @cached_property
    def base(self) -> DataFrame:
        return self.corpus.where("doc_id % 11 <> 0").select("path", "sha", "content")

    @cached_property
    def head(self) -> DataFrame:
        return self.corpus.where("doc_id % 13 <> 0").selectExpr(
            "CASE WHEN doc_id % 17 = 0 THEN concat('moved/', path) ELSE path END AS path",
            "CASE WHEN doc_id % 7 = 0 THEN concat(content, '\nedited') ELSE content END AS content",
        ).selectExpr("path", "sha1(content) AS sha", "content")

    # ---- pages ---------------------------------------------------------------------------------
    @cached_property
    def site_paths(self) -> DataFrame:
        return self.pages.selectExpr("page_id", "regexp_replace(url, '^https?://', '') AS path")

    @cached_property
    def site_owners(self) -> DataFrame:
        p = self.site_paths
        host = p.selectExpr("substring_index(path, '/', 1) AS folder").distinct().selectExpr(
            "concat('host:', folder) AS owner", "folder")
        section = p.selectExpr("substring_index(path, '/', 2) AS folder").distinct().selectExpr(
            "concat('section:', folder) AS owner", "folder")
        return host.unionByName(section)

    # ---- names of outside systems ----------------------------------------------------------------
    GENERIC = "big blue fast green old red slow small".split()

    @cached_property
    def external_names(self) -> DataFrame:
        return self.part.selectExpr("p_name AS name").distinct()

    @cached_property
    def external_uses(self) -> DataFrame:
        return (self.lineitem.join(self.part, F.expr("l_partkey = p_partkey"))
                .selectExpr("concat('s', l_suppkey) AS src", "p_name AS target",
                            "l_orderkey * 8 + l_linenumber AS pos", "l_orderkey", "l_linenumber"))

    # ---- trade links between nations -------------------------------------------------------------
    @cached_property
    def trade(self) -> DataFrame:
        """One row per line item: the supplier's nation uses the customer's nation."""
        li = self.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag")
        return (li.join(self.orders.select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
                .join(self.customer.select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
                .join(self.supplier.select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
                .selectExpr("s_nationkey AS src", "c_nationkey AS dst", "l_returnflag AS flag"))

    # ---- intervals and points ----------------------------------------------------------------------
    @cached_property
    def intervals(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_custkey AS grp", "o_orderkey AS id",
            "cast(datediff(cast(o_orderdate AS DATE), DATE'1990-01-01') AS BIGINT) AS start",
            "cast(datediff(cast(o_orderdate AS DATE), DATE'1990-01-01') + 30 + o_orderkey % 60 AS BIGINT) AS end")

    @cached_property
    def points(self) -> DataFrame:
        return self.lineitem.join(
            self.orders.select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).selectExpr(
            "o_custkey AS grp", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pid",
            "cast(datediff(cast(l_shipdate AS DATE), DATE'1990-01-01') AS BIGINT) AS pos").distinct()

    # ---- graphs ------------------------------------------------------------------------------------
    @cached_property
    def edges_tree(self) -> DataFrame:
        return self.part.where("p_partkey > 0").selectExpr("p_partkey AS src", "p_partkey div 2 AS dst")

    @cached_property
    def edges_down(self) -> DataFrame:
        """A forest of 64 trees, the first 64 rows being the roots: parent to child."""
        return self.part.where("p_partkey >= 64").selectExpr("p_partkey div 128 * 64 + p_partkey % 64 AS src", "p_partkey AS dst")

    @cached_property
    def edges_cyclic(self) -> DataFrame:
        """Rings of four; the first node of each ring also calls the ring at half its number."""
        ring = self.part.selectExpr("p_partkey AS src", "p_partkey - p_partkey % 4 + (p_partkey + 1) % 4 AS dst")
        up = self.part.where("p_partkey % 4 = 0 AND p_partkey > 0").selectExpr(
            "p_partkey AS src", "(p_partkey div 8) * 4 AS dst")
        return ring.unionByName(up)

    # ---- events ------------------------------------------------------------------------------------
    @cached_property
    def marks(self) -> DataFrame:
        return self.events.selectExpr(
            "CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'check' END AS what",
            "concat('env:U', user_id) AS gate", "concat('f', user_id % 10, '.py:', event_id % 500) AS ref",
            "concat('part', user_id % 10) AS part", "concat('if ', event_type, event_id % 7) AS text",
            "event_id").where("what IS NOT NULL")

    @cached_property
    def moves(self) -> DataFrame:
        e = self.events.selectExpr("concat('u', user_id) AS subject", "'event_state' AS field", "event_type AS to",
                                   "event_id", "ts", "cast(ts AS DATE) AS day")
        return carry_forward(e, ["subject"], "day", ["ts", "event_id"], "to", "from", current=False).selectExpr(
            "subject", "field", "`from`", "to", "concat('log:', event_id) AS ref", "event_id")

    @cached_property
    def steps(self) -> DataFrame:
        """Events as one-sided step records of a function per user."""
        return self.events.selectExpr(
            "concat('fn', user_id) AS fn_id", "event_id AS pos",
            "CASE event_type WHEN 'error' THEN 'decision' WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'effect' "
            "WHEN 'view' THEN 'return' ELSE 'loop' END AS kind",
            "concat(event_type, '(', event_id % 5, ')') AS text",
            "event_type = 'error' AND event_id % 2 = 0 AS `check`",
            "event_type = 'view' AND event_id % 3 = 0 AS error",
            "event_type AS callee",
            "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'Orders Database' END AS target",
            "cast(event_id % 200 AS BIGINT) AS line",
            "CASE WHEN event_id % 4 = 0 THEN 'removed' ELSE 'added' END AS op")

    # ---- code structure ------------------------------------------------------------------------------
    @cached_property
    def functions(self) -> DataFrame:
        """One function, test or type per part row, 40 to a file; up to three share a name."""
        return self.part.selectExpr(
            "p_partkey AS fn_id",
            "CASE WHEN p_size % 10 = 0 THEN 'Class' WHEN p_size % 10 = 1 THEN 'Test' ELSE 'Function' END AS kind",
            "CASE WHEN p_size % 10 = 0 THEN concat(replace(p_brand, '#', ''), '_', p_partkey div 60) "
            "ELSE concat(split_part(p_name, ' ', 2), p_partkey div 3) END AS name",
            "CASE WHEN p_size % 3 = 0 THEN concat(replace(p_brand, '#', ''), '_', p_partkey div 60) END AS parent",
            "concat('app/k', p_partkey div 20 % 7, '/m', p_partkey div 40, '.py') AS path",
            "(p_partkey % 40) * 10 + 1 AS start", "(p_partkey % 40) * 10 + 9 AS end",
            "p_size % 10 = 1 AS is_test")

    @cached_property
    def calls(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_partkey AS src", "l_partkey div 2 + l_suppkey % 5 AS dst").distinct()



    @cached_property
    def bodies(self) -> DataFrame:
        """Each function's body names the next three functions: as a method, through a folder, and bare."""
        f = self.functions.select("fn_id", "name", "parent")
        b, c, d = (f.selectExpr(f"fn_id - {i} AS fn_id", f"name AS n{i}", f"parent AS p{i}") for i in (1, 2, 3))
        return (f.select("fn_id").join(b, "fn_id").join(c, "fn_id").join(d, "fn_id")
                .selectExpr("fn_id", "concat('return ', lower(coalesce(p1, 'mod')), '.', n1, '(\"x.', n3, '\") + k', (fn_id + 2) div 20 % 7, "
                            "'.', n2, '(', n3, ') # ', n2) AS body"))

    @cached_property
    def order_steps(self) -> DataFrame:
        """One step per line number of an order (line numbers repeat, so they are reduced first)."""
        return self.lineitem.groupBy(F.col("l_orderkey").alias("fn_id"), F.col("l_linenumber").cast("bigint").alias("n")).agg(
            F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))

    def _code(self, paths, forms) -> DataFrame:
        bodies = "array(" + ", ".join("array(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t") + "'" for x in c) + ")" for c in forms) + ")"
        made = self.part.selectExpr(
            "p_partkey AS k", f"replace(get({_names(paths)}, cast(p_partkey % 4 AS INT)), '@', p_partkey) AS path",
            f"posexplode(get({bodies}, cast(p_partkey % 4 AS INT))) AS (pos, line)").selectExpr(
            "k", "path", "pos + 1 AS line_no", "replace(replace(line, '@', k), '%', k % 97) AS text").withColumn(
            "path", F.expr("replace(path, '#', k % 20)"))
        # a table of many files, as source lines would be
        return cut(made.repartition(self.spark.sparkContext.defaultParallelism, "path"), "code")

    @cached_property
    def code_lines(self) -> DataFrame:
        """Source files made from part rows, one per row in one of four languages; @ stands for the row's number, % for it modulo 97."""
        return self._code(CODE_PATHS, CODE_FORMS)

    @cached_property
    def effect_lines(self) -> DataFrame:
        """Four more languages or forms: outside systems, loops over closures, and ways to stop."""
        return self._code(EFFECT_PATHS, EFFECT_FORMS)

    @cached_property
    def long_lines(self) -> DataFrame:
        """Statements, strings and comments over several lines."""
        return self._code(LONG_PATHS, LONG_FORMS)

    @cached_property
    def code_functions(self) -> DataFrame:
        from ..operators.scan import scan_functions
        return cut(scan_functions(self.code_lines).withColumn("fn_id", F.concat_ws(":", "path", "start")), "functions")

    @cached_property
    def code_parts(self) -> DataFrame:
        return self.code_lines.selectExpr("split_part(path, '/', 1) AS id", "split_part(path, '/', 1) AS path").distinct()

    # ---- paths of a made-up repository -----------------------------------------------------------------
    @cached_property
    def repo_paths(self) -> DataFrame:
        names = "array(" + ", ".join(f"'{t}'" for t in PATH_FORMS) + ")"
        return self.part.selectExpr(
            "p_partkey AS k", f"replace(get({names}, cast(p_partkey % {len(PATH_FORMS)} AS INT)), '@', p_partkey) AS path",
            "cast(p_retailprice * 1000 AS BIGINT) AS size", "p_size AS code_lines")

    # ---- part records ------------------------------------------------------------------------------------
    @cached_property
    def part_records(self) -> DataFrame:
        """One part record per part row; nested lists are built inside the row."""
        hows = "array('HTTP calls', 'publishes events to queue', 'SQL via gRPC', 'reads files')"
        k = "p_partkey"
        base = self.part.selectExpr(
            k, f"concat('p', {k}) AS id", f"concat(lower(p_type), '/g', {k} % 9, '/p', {k}) AS path",
            f"element_at(array('service', 'job', 'library', 'tool'), cast({k} % 4 + 1 AS INT)) AS kind",
            "p_name AS name", "concat(p_brand, ' ', p_type) AS summary", "p_brand")
        return base.selectExpr(
            "id", "path", "kind", "name", "summary", "cast(NULL AS STRING) AS details",
            f"transform(sequence(0L, {k} % 2), j -> named_struct('type', element_at(array('http', 'cli', 'function', 'topic'), "
            f"cast(({k} div 2 + j) % 4 + 1 AS INT)), 'what', CASE WHEN {k} % 11 = 0 THEN 'GET /' ELSE concat('GET /', p_brand, j) END, "
            f"'ref', concat(path, '/main.py:', {k} % 25 + j + 1))) AS exposes",
            f"transform(sequence(0L, {k} % 3), j -> named_struct('target', CASE j WHEN 0 THEN name WHEN 1 THEN "
            f"concat('p', {k} div 2) ELSE id END, 'how', element_at({hows}, cast(({k} + j) % 4 + 1 AS INT)), 'ref', "
            f"CASE WHEN {k} % 5 = 0 AND j = 1 THEN NULL ELSE concat(path, '/main.py:', j * 7 + {k} % 30 + 1) END)) AS uses",
            f"CASE WHEN {k} % 10 IN (0, 3) THEN array(concat('t', {k} div 10)) ELSE cast(array() AS ARRAY<STRING>) END AS publishes",
            f"CASE WHEN {k} % 10 IN (1, 3, 7) THEN array(concat('t', {k} div 10)) ELSE cast(array() AS ARRAY<STRING>) END AS subscribes",
            f"CASE WHEN {k} % 2 = 0 THEN array(named_struct('title', concat('Flow ', {k}), 'trigger', concat('GET /', p_brand), 'steps', "
            f"transform(sequence(0L, {k} % 4), j -> named_struct('from', CASE WHEN {k} % 6 = 0 THEN 'caller' WHEN j % 2 = 0 THEN id ELSE concat(id, '.run') END, "
            f"'to', CASE WHEN j = 0 THEN concat('p', {k} div 3) WHEN j = 1 THEN name ELSE concat('helper', j) END, "
            f"'text', concat('step ', j), 'fn', CASE WHEN j % 2 = 1 THEN concat('run', {k} % 13) END, "
            f"'ref', concat(path, '/main.py:', j * 5 + {k} % 30 + 1))))) ELSE array() END AS flows").selectExpr(
            "id", "path", "kind", "name", "summary", "details", "exposes", "uses", "publishes", "subscribes",
            f"cast(flows AS {schemas.FLOWS}) AS flows")


# fixed values of the made-up repository: one path form per role, language and marker
PATH_FORMS = (
    "svc@/main.go", "svc@/main_test.go", "lib/a@/util.py", "lib/a@/test_util.py", "web/src/App@.tsx", "web/tests/x@.ts",
    "api/v@.pb.go", "api/generated/c@.ts", "proto/protos/m@.go", "k8s/deploy@.yaml", "svc@/Dockerfile", "svc@/go.mod",
    "web@/package.json", "docs/guide@.md", "conf/app@.toml", "conf/.env.p@", "db/q@.sql", "assets/s@.css", "misc/blob@.bin",
    "node_modules/p@/index.js", "svc@/vendor/dep.go", "build@/out.js", "terraform/main@.tf", "scripts/run@.sh", "README@",
    "lib/core/h@.rs", "lib/core/k@.kt", "src/c@.hpp", "src/t@.spec.js", "mocks/fake@.py", "x/mocks/fake@.py", "LICENSE@",
    "svc@/internal/store.go")


# fixed values: the made-up source files, one list of lines per language
CODE_PATHS = ("svc#/app@.py", "svc#/main@.go", "web#/ui@.js", "lib#/J@.java")
CODE_FORMS = (
    ("# Reads settings for worker @. Called at start.",
     "def load_@(cfg):",
     '    """Load things for @. Returns cfg. Third one."""',
     '    mode = os.getenv("MODE_%", "fast")',
     '    if mode == "slow":',
     "        return helper_@(cfg)",
     "    for item in cfg.items():",
     '        if item.status == "queued":',
     '            item.status = "running"',
     "        db.save(item)",
     '    token = os.environ["TOKEN_%"]',
     "    return token",
     "",
     "class Store_@:",
     "    def put(self, x):",
     "        self.limit = int(os.environ.get(KEY_NAME))",
     '        if flags.is_enabled("flag_%"):',
     "            client.send(x)",
     "        if self.limit > 9:",
     '            x.status = "done"',
     "",
     'KEY_NAME = "LIMIT_%"'),
    ("package main",
     "// Run@ starts job @.",
     "func Run@(ctx context.Context) error {",
     '\taddr := os.Getenv("ADDR_%")',
     '\tif addr == "" {',
     '\t\taddr = "localhost"',
     "\t}",
     "\tif job.State == JobStateReady {",
     "\t\tjob.State = JobStateBusy",
     "\t}",
     '\ton, _ := client.BooleanValue(ctx, "go-flag-%", true, evalCtx)',
     "\tif on {",
     "\t\treturn start@(addr)",
     "\t}",
     "\tif err != nil {",
     '\t\treturn fmt.Errorf("x", err)',
     "\t}",
     "\tswitch job.State {",
     "\tcase JobStateBusy:",
     "\t\tjob.State = JobStateDone",
     "\t}",
     "\treturn nil",
     "}"),
    ('const { API_% = "dev", HOST: host } = process.env',
     "function show@(x) {",
     '  const debug = process.env.DEBUG_% || "off"',
     "  if (!x) {",
     "    return null",
     "  }",
     "  const big = debug ? 1 : 2",
     "  if (host) {",
     "    fetch(x)",
     "  } else {",
     "    other.draw(x)",
     "  }",
     '  return checkFeatureFlag("js_flag_%")',
     "}"),
    ("public class J@ {",
     "  public void go(Order order) {",
     '    String v = System.getenv("JAVA_%");',
     "    if (v != null) {",
     '      order.state = "OPEN";',
     "    }",
     '    order.state = "SHUT";',
     '    ld.boolVariation("java-flag-%", user, false);',
     '    throw new Error("bad");',
     "  }",
     "}"),
)


EFFECT_PATHS = ("rs#/r@.rs", "js#/w@.js", "go#/g@.go", "rb#/b@.rb")
EFFECT_FORMS = (
    ("fn load_@(db: Db) -> i32 {",
     "    if db.find(key_@) {",
     '        panic!("lost @");',
     "    }",
     "    items.iter().for_each(|x| {",
     "        store_client.save(x);",
     "    });",
     "    log.info(helper_@(count(db.size())));",
     "    let port = env::var(\"PORT_%\").unwrap_or(\"80\");",
     "    helper_@(1)",
     "}"),
    ("function run@(xs) {",
     "  xs.forEach(x => {",
     "    kafkaProducer.send(x)",
     "  })",
     "  console.log(helper_@(db.get(1)), db.close())",
     "  const size = Math.max(parseFloat(process.env.SIZE_%), 1)",
     "  const rate = parseFloat(process.env.RATE_%)",
     "  return pool.query(other_@(xs))",
     "}"),
    ("func Go@(c Conn) {",
     "\tfor i := 0; i < 3; i++ {",
     '\t\tsqlClient.Exec("f(x)", helper_@(i))',
     "\t}",
     "\tn := strings.ToUpper(os.Getenv(\"NAME_%\"))",
     "\tif n != \"\" {",
     "\t\tlogger.Info(n); helper_@(n)",
     "\t}",
     "\tlog.Fatal(n)",
     "}"),
    ("def each_@(xs)",
     "  xs.each do |x|",
     "    redis.set(x)",
     "  end",
     "  raise Missing",
     "end"),
)


LONG_PATHS = ("svc#/s@.py", "web#/t@.ts", "go#/u@.go", "lib#/V@.java")
LONG_FORMS = (
    ("def send_@(x):",
     "    if (x.a  # why (not",
     "            and x.b):",
     "        return client.send(",
     '            "a ) b",',
     "            [1, %])",
     '    text = """if y: (',
     '    more"""',
     "    return text"),
    ("export function go@(xs) {",
     "  const q = `select (",
     "    1 from t%`",
     "  xs.map((x) => {",
     "    db.save(",
     "      x)",
     "  })",
     "  /* if (",
     "  */ return q",
     "}"),
    ("func Up@(c Conn) error {",
     "\tif err := c.Exec(",
     '\t\t"q%", 1,',
     "\t); err != nil {",
     "\t\treturn err",
     "\t}",
     "\treturn nil",
     "}"),
    ("class V@ {",
     "  void run(int a,",
     "           int b) {",
     "    call(a, // first (",
     "        b);",
     "  }",
     "}"),
)


def _names(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


# the same adapters as SQL
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
VIEWS: dict[str, tuple[str, str]] = {
    "corpus": ("", """SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content,
        CAST(strlen(text) AS BIGINT) AS size, sha1(text) AS sha, doc_id FROM documents"""),
    "corpus_lines": ("corpus", f"""SELECT path, unnest(range(1, n + 1)) AS line_no, unnest(l[1:n]) AS text FROM (
        SELECT path, l, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS n FROM (
          SELECT path, string_split_regex(content, '{LINE_BREAK}') AS l FROM corpus))"""),
    "base": ("corpus", "SELECT path, sha, content FROM corpus WHERE doc_id % 11 <> 0"),
    "head": ("corpus", """SELECT path, sha1(content) AS sha, content FROM (
        SELECT CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path,
               CASE WHEN doc_id % 7 = 0 THEN content || chr(10) || 'edited' ELSE content END AS content
        FROM corpus WHERE doc_id % 13 <> 0)"""),
    "site_paths": ("", "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"),
    "site_owners": ("site_paths", """SELECT DISTINCT 'host:' || split_part(path, '/', 1) AS owner,
          split_part(path, '/', 1) AS folder FROM site_paths
        UNION ALL SELECT DISTINCT 'section:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2),
          split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM site_paths"""),
    "external_names": ("", "SELECT DISTINCT p_name AS name FROM part"),
    "external_uses": ("", """SELECT 's' || l_suppkey AS src, p_name AS target, l_orderkey * 8 + l_linenumber AS pos,
        l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "trade": ("", """SELECT s_nationkey AS src, c_nationkey AS dst, l_returnflag AS flag FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey"""),
    "intervals": ("", """SELECT o_custkey AS grp, o_orderkey AS id,
        CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS "start",
        CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 + o_orderkey % 60 AS BIGINT) AS "end"
        FROM orders"""),
    "points": ("", """SELECT DISTINCT o_custkey AS grp,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pid,
        CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "edges_tree": ("", "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0"),
    "edges_down": ("", "SELECT p_partkey // 128 * 64 + p_partkey % 64 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 64"),
    "edges_cyclic": ("", """SELECT p_partkey AS src, p_partkey - p_partkey % 4 + (p_partkey + 1) % 4 AS dst FROM part
        UNION ALL SELECT p_partkey, (p_partkey // 8) * 4 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 0"""),
    "marks": ("", """SELECT * FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'read'
          WHEN event_type = 'purchase' THEN 'check' END AS what, 'env:U' || user_id AS gate,
        'f' || user_id % 10 || '.py:' || event_id % 500 AS ref, 'part' || user_id % 10 AS part,
        'if ' || event_type || event_id % 7 AS text, event_id FROM events) WHERE what IS NOT NULL"""),
    "moves": ("", """SELECT 'u' || user_id AS subject, 'event_state' AS field,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "from", event_type AS "to",
        'log:' || event_id AS ref, event_id FROM events"""),
    "steps": ("", """SELECT 'fn' || user_id AS fn_id, event_id AS pos,
        CASE event_type WHEN 'error' THEN 'decision' WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'effect'
          WHEN 'view' THEN 'return' ELSE 'loop' END AS kind,
        event_type || '(' || event_id % 5 || ')' AS text,
        event_type = 'error' AND event_id % 2 = 0 AS "check", event_type = 'view' AND event_id % 3 = 0 AS error,
        event_type AS callee,
        CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'Orders Database' END AS target,
        CAST(event_id % 200 AS BIGINT) AS line,
        CASE WHEN event_id % 4 = 0 THEN 'removed' ELSE 'added' END AS op FROM events"""),
    "functions": ("", """SELECT p_partkey AS fn_id,
        CASE WHEN p_size % 10 = 0 THEN 'Class' WHEN p_size % 10 = 1 THEN 'Test' ELSE 'Function' END AS kind,
        CASE WHEN p_size % 10 = 0 THEN replace(p_brand, '#', '') || '_' || p_partkey // 60
          ELSE split_part(p_name, ' ', 2) || p_partkey // 3 END AS name,
        CASE WHEN p_size % 3 = 0 THEN replace(p_brand, '#', '') || '_' || p_partkey // 60 END AS parent,
        'app/k' || p_partkey // 20 % 7 || '/m' || p_partkey // 40 || '.py' AS path,
        (p_partkey % 40) * 10 + 1 AS "start", (p_partkey % 40) * 10 + 9 AS "end", p_size % 10 = 1 AS is_test
        FROM part"""),
    "mentions": ("functions", """SELECT f.fn_id, m.q AS qualifier, m.n AS name FROM (SELECT a.fn_id, unnest([{'q': NULL, 'n': 'return'},
        {'q': NULL, 'n': lower(coalesce(b.parent, 'mod'))}, {'q': lower(coalesce(b.parent, 'mod')), 'n': b.name},
        {'q': NULL, 'n': 'k' || (a.fn_id + 2) // 20 % 7}, {'q': 'k' || (a.fn_id + 2) // 20 % 7, 'n': c.name}, {'q': NULL, 'n': d.name}]) AS m
        FROM functions a JOIN functions b ON b.fn_id = a.fn_id + 1 JOIN functions c ON c.fn_id = a.fn_id + 2
        JOIN functions d ON d.fn_id = a.fn_id + 3) f"""),
    "order_steps": ("", """SELECT l_orderkey AS fn_id, CAST(l_linenumber AS BIGINT) AS n, min(l_suppkey) AS s, min(l_partkey) AS p
        FROM lineitem GROUP BY ALL"""),
    "code_files": ("", f"""SELECT p_partkey AS k, p_partkey % 97 AS m, replace(replace([{", ".join(f"'{v}'" for v in CODE_PATHS)}][p_partkey % 4 + 1],
        '@', CAST(p_partkey AS VARCHAR)), '#', CAST(p_partkey % 20 AS VARCHAR)) AS path FROM part"""),
    "long_files": ("", f"""SELECT p_partkey AS k, p_partkey % 97 AS m, replace(replace([{", ".join(f"'{v}'" for v in LONG_PATHS)}][p_partkey % 4 + 1],
        '@', CAST(p_partkey AS VARCHAR)), '#', CAST(p_partkey % 20 AS VARCHAR)) AS path FROM part"""),
    "effect_files": ("", f"""SELECT p_partkey AS k, p_partkey % 97 AS m, replace(replace([{", ".join(f"'{v}'" for v in EFFECT_PATHS)}][p_partkey % 4 + 1],
        '@', CAST(p_partkey AS VARCHAR)), '#', CAST(p_partkey % 20 AS VARCHAR)) AS path FROM part"""),
    "calls": ("", "SELECT DISTINCT l_partkey AS src, l_partkey // 2 + l_suppkey % 5 AS dst FROM lineitem"),
    "repo_paths": ("", f"""SELECT p_partkey AS k, replace([{", ".join(f"'{t}'" for t in PATH_FORMS)}][p_partkey % {len(PATH_FORMS)} + 1],
        '@', CAST(p_partkey AS VARCHAR)) AS path, CAST(p_retailprice * 1000 AS BIGINT) AS size, p_size AS code_lines FROM part"""),
    "parts": ("", """SELECT p_partkey AS k, 'p' || p_partkey AS id, lower(p_type) || '/g' || p_partkey % 9 || '/p' || p_partkey AS path,
        ['service', 'job', 'library', 'tool'][p_partkey % 4 + 1] AS kind, p_name AS name, p_brand || ' ' || p_type AS summary,
        p_brand FROM part"""),
    "part_exposes": ("parts", """SELECT id AS part, j AS pos, ['http', 'cli', 'function', 'topic'][(k // 2 + j) % 4 + 1] AS "type",
        CASE WHEN k % 11 = 0 THEN 'GET /' ELSE 'GET /' || p_brand || j END AS what, path || '/main.py:' || (k % 25 + j + 1) AS ref
        FROM (SELECT *, unnest(range(0, k % 2 + 1)) AS j FROM parts)"""),
    "part_uses": ("parts", """SELECT id AS src, j AS pos, CASE j WHEN 0 THEN name WHEN 1 THEN 'p' || k // 2 ELSE id END AS target,
        ['HTTP calls', 'publishes events to queue', 'SQL via gRPC', 'reads files'][(k + j) % 4 + 1] AS how,
        CASE WHEN k % 5 = 0 AND j = 1 THEN NULL ELSE path || '/main.py:' || (j * 7 + k % 30 + 1) END AS ref
        FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS j FROM parts)"""),
    "part_publishes": ("parts", "SELECT id AS part, 't' || k // 10 AS topic FROM parts WHERE k % 10 IN (0, 3)"),
    "part_subscribes": ("parts", "SELECT id AS part, 't' || k // 10 AS topic FROM parts WHERE k % 10 IN (1, 3, 7)"),
    "part_steps": ("parts", """SELECT id || '#0' AS flow_id, id AS owner, 'Flow ' || k AS title, 'GET /' || p_brand AS "trigger", j AS pos,
        CASE WHEN k % 6 = 0 THEN 'caller' WHEN j % 2 = 0 THEN id ELSE id || '.run' END AS "from",
        CASE WHEN j = 0 THEN 'p' || k // 3 WHEN j = 1 THEN name ELSE 'helper' || j END AS "to", 'step ' || j AS text,
        CASE WHEN j % 2 = 1 THEN 'run' || k % 13 END AS fn, path || '/main.py:' || (j * 5 + k % 30 + 1) AS ref
        FROM (SELECT *, unnest(range(0, k % 4 + 1)) AS j FROM parts WHERE k % 2 = 0)"""),
    "part_externals": ("parts part_uses", "SELECT DISTINCT target AS id FROM part_uses WHERE target NOT IN (SELECT id FROM parts)"),
    "part_links": ("part_uses part_publishes part_subscribes", """SELECT src, target AS dst, arg_min(how, pos) AS how, count(*) AS weight
        FROM part_uses WHERE target <> src GROUP BY ALL
        UNION ALL SELECT DISTINCT p.part, s.part, 'PubSub: ' || p.topic, 1 FROM part_publishes p JOIN part_subscribes s
        ON p.topic = s.topic AND p.part <> s.part"""),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views, and what they need, as common table expressions."""
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for d in VIEWS[name][0].split():
                need(d)
            done.append(name)

    for n in names:
        need(n)
    if not done:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
