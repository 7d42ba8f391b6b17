"""Scalar functions as Spark SQL expressions.

Every scalar is one SQL expression over named arguments. Calling it with SQL fragments gives the expanded
expression text (usable in ``selectExpr``, ``F.expr`` and inside other scalars); ``register_functions`` makes
the same text available as SQL functions, which Catalyst inlines. Nothing here leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from . import fixed as fx

REGISTRY: dict[str, "Scalar"] = {}


def text(value: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values) -> str:
    return "array(" + ", ".join(text(v) for v in values) + ")"


def table(pairs: dict) -> str:
    """A constant lookup map."""
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs.items()) + ")"


class Scalar:
    def __init__(self, name: str, args: str, returns: str, body: str):
        self.name, self.returns, self.body = name, returns, body
        self.args = [a.split(" ", 1) for a in args.split(", ")]
        REGISTRY[name] = self

    def __call__(self, *fragments) -> str:
        """The expression for these arguments. An argument the body uses several times is computed once, unless it
        is a plain column or literal."""
        if len(fragments) != len(self.args):
            raise TypeError(f"{self.name} takes {len(self.args)} arguments")
        given, bound = {}, []
        for (arg, _), fragment in zip(self.args, fragments):
            plain = re.fullmatch(r"[\w.`]+|'[^']*'", fragment)
            if plain or len(re.findall(rf"@{arg}\b", self.body)) < 2:
                given[arg] = fragment if plain else f"({fragment})"
            else:
                given[arg] = f"{self.name}_{arg}"
                bound.append((fragment, given[arg]))
        names = "|".join(sorted(given, key=len, reverse=True))
        out = "(" + re.sub(rf"@({names})\b", lambda m: given[m[1]], self.body) + ")"
        for fragment, name in bound:
            out = bind(fragment, name, out)
        return out

    def create_statement(self) -> str:
        names = "|".join(sorted((a for a, _ in self.args), key=len, reverse=True))
        body = re.sub(rf"@({names})\b", lambda m: m[1], self.body)
        params = ", ".join(f"{a} {t}" for a, t in self.args)
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({params}) RETURNS {self.returns} RETURN {body}"


def register_functions(spark: SparkSession) -> list[str]:
    """Make every scalar callable from SQL in this session; returns their names."""
    for f in REGISTRY.values():
        spark.sql(f.create_statement())
    return sorted(REGISTRY)


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _matches(arg: str, pattern: str) -> str:
    return f"({arg} rlike {text(pattern)})"


# ---- paths ---------------------------------------------------------------------------------------
is_source = Scalar("is_source", "path STRING", "BOOLEAN", _matches("@path", fx.SOURCE))
is_test = Scalar("is_test", "path STRING", "BOOLEAN", _matches("@path", fx.TESTS))
is_generated = Scalar("is_generated", "path STRING", "BOOLEAN", _matches("@path", fx.GENERATED))
is_env_file = Scalar("is_env_file", "path STRING", "BOOLEAN", _matches("@path", fx.ENV_FILE))
machine_made = Scalar(
    "machine_made", "content STRING", "BOOLEAN",
    "coalesce(cast(substring(cast(@content AS BINARY), 1, 4096) AS STRING) rlike "
    f"{text(fx.MACHINE_MADE)}, false)")
is_ignored = Scalar("is_ignored", "path STRING", "BOOLEAN",
                    f"arrays_overlap(split({bind('@path', 'p', 'left(p, greatest(length(p) - length(element_at(split(p, chr(47)), -1)) - 1, 0))')}, '/'), "
                    f"{texts(fx.IGNORED_FOLDERS)})")
suffix = Scalar("suffix", "path STRING", "STRING", r"lower(regexp_extract(@path, '[^/](\\.[^./]+)$', 1))")
base_name = Scalar("base_name", "path STRING", "STRING", "element_at(split(@path, '/'), -1)")
folder_of = Scalar(
    "folder_of", "path STRING", "STRING",
    "CASE WHEN instr(@path, '/') = 0 THEN '' ELSE regexp_extract(@path, '^(.*)/[^/]*$', 1) END")
file_stem = Scalar("file_stem", "path STRING", "STRING",
                   r"regexp_replace(element_at(split(@path, '/'), -1), '(?<=.)\\.[^.]+$', '')")
# every folder holding the path, and the path itself; '' stands for the root
ancestors = Scalar(
    "ancestors", "path STRING", "ARRAY<STRING>",
    bind("split(@path, '/')", "ps", "concat(array(''), transform(ps, (p, k) -> array_join(slice(ps, 1, k + 1), '/')))"))
lang = Scalar("lang", "path STRING", "STRING", f"element_at({table(fx.LANGUAGES)}, {suffix('@path')})")
lang_family = Scalar(
    "lang_family", "path STRING", "STRING",
    f"coalesce(element_at({table(fx.LANGUAGE_FAMILIES)}, {lang('@path')}), {lang('@path')})")
file_role = Scalar(
    "file_role", "path STRING, generated BOOLEAN, test BOOLEAN", "STRING",
    "CASE WHEN @generated THEN 'generated' WHEN @test THEN 'test' "
    f"WHEN {_matches('@path', fx.DEPLOY)} THEN 'deploy' WHEN {_matches('@path', fx.DEPS)} THEN 'deps' "
    f"WHEN {_matches('@path', fx.DOCS)} THEN 'docs' "
    f"WHEN {lang('@path')} IS NOT NULL OR array_contains({texts(fx.WEB_SUFFIXES)}, {suffix('@path')}) THEN 'code' "
    f"WHEN {_matches('@path', fx.CONFIG)} THEN 'config' ELSE 'other' END")
parse_ref = Scalar(
    "parse_ref", "ref STRING", "STRUCT<path: STRING, line: BIGINT>",
    f"CASE WHEN {_matches('@ref', fx.REFERENCE)} THEN named_struct('path', "
    f"regexp_extract(@ref, {text(fx.REFERENCE)}, 1), 'line', "
    f"try_cast(regexp_extract(@ref, {text(fx.REFERENCE)}, 2) AS BIGINT)) END")

# ---- text ----------------------------------------------------------------------------------------
squash = Scalar("squash", "s STRING", "STRING", r"trim(regexp_replace(@s, '(?U)\\s+', ' '))")
clip = Scalar(
    "clip", "s STRING, n INT", "STRING",
    bind(squash("@s"), "sq", "CASE WHEN length(sq) <= @n THEN sq ELSE concat(left(sq, @n - 1), '…') END"))
shorten = Scalar("shorten", "s STRING", "STRING", clip("@s", str(fx.MAX_GUARD)))
words = Scalar(
    "words", "s STRING", "ARRAY<STRING>",
    f"array_distinct(transform(regexp_extract_all(@s, {text(fx.WORD_PIECES)}, 0), w -> lower(w)))")
identifiers = Scalar("identifiers", "s STRING", "ARRAY<STRING>",
                     f"array_distinct(regexp_extract_all(@s, {text(fx.IDENTIFIER)}, 0))")
_NAME_TOKENS = rf"regexp_extract_all(@s, {text(fx.IDENTIFIER + r'|\.|[^\sA-Za-z_.]')}, 0)"
# a name's qualifier: the plain name before its dot, '' when dotted after anything else, null when bare
qualified_names = Scalar(
    "qualified_names", "s STRING", "ARRAY<STRUCT<qualifier: STRING, name: STRING>>",
    bind(_NAME_TOKENS, "ts", "array_distinct(filter(transform(ts, (t, i) -> CASE WHEN t rlike '^[A-Za-z_]' THEN "
         "named_struct('qualifier', CASE WHEN i > 0 AND get(ts, i - 1) = '.' THEN "
         "CASE WHEN i > 1 AND get(ts, i - 2) rlike '^[A-Za-z_]' THEN get(ts, i - 2) ELSE '' END END, "
         "'name', t) END), q -> q IS NOT NULL))"))
strip_strings_comments = Scalar(
    "strip_strings_comments", "s STRING", "STRING",
    f"regexp_replace(@s, {text(fx.STRINGS_AND_COMMENTS)}, ' ')")
mask_literals = Scalar(
    "mask_literals", "s STRING", "STRING", squash(f"regexp_replace(@s, {text(fx.LITERAL_TEXT)}, '#')"))
_unparen = Scalar(
    "unparen_trimmed", "s STRING", "STRING",
    r"CASE WHEN @s rlike '(?s)^\\(.*\\)$' AND NOT aggregate("
    "split(left(@s, length(@s) - 1), ''), named_struct('depth', 0, 'early', false), "
    "(a, c) -> named_struct('depth', a.depth + CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, "
    "'early', a.early OR (c <> '' AND a.depth + CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END = 0)), "
    "a -> a.early) THEN trim(substring(@s, 2, length(@s) - 2)) ELSE @s END")
unparen = Scalar("unparen", "s STRING", "STRING", _unparen("trim(@s)"))
_CMP = text(fx.COMPARISON)
_CMP_OP = (f"coalesce(nullif(regexp_extract(@c, {_CMP}, 1), ''), regexp_extract(@c, {_CMP}, 2))")
negate = Scalar(
    "negate", "c STRING", "STRING",
    r"CASE WHEN @c rlike '&&|\\|\\||\\band\\b|\\bor\\b|\\?' THEN concat('not: ', @c) "
    r"WHEN @c rlike '^(?:!|not\\s+)\\s*([\\w.]+(?:\\(.*\\))?)$' THEN "
    r"regexp_extract(@c, '^(?:!|not\\s+)\\s*([\\w.]+(?:\\(.*\\))?)$', 1) "
    f"WHEN size(regexp_extract_all(@c, {_CMP}, 0)) = 1 THEN concat("
    f"left(@c, regexp_instr(@c, {_CMP}) - 1 + CASE WHEN regexp_extract(@c, {_CMP}, 1) <> '' THEN 1 ELSE 0 END), "
    f"element_at({table(fx.FLIPPED)}, {_CMP_OP}), "
    f"substring(@c, regexp_instr(@c, {_CMP}) + CASE WHEN regexp_extract(@c, {_CMP}, 1) <> '' THEN 1 ELSE 0 END "
    f"+ length({_CMP_OP}))) ELSE concat('not: ', @c) END")
_OPS = text(fx.OPERATOR_TOKEN)
operator_tokens = Scalar("operator_tokens", "s STRING", "ARRAY<STRING>", f"regexp_extract_all(@s, {_OPS}, 0)")
_PAIRS = [p for a, b in fx.INVERSE_OPERATORS for p in ((a, b), (b, a))]
# the negation that, taken out of the longer token list, leaves the shorter one
negation_between = Scalar(
    "negation_between", "longer ARRAY<STRING>, shorter ARRAY<STRING>", "STRING",
    "CASE WHEN size(@longer) - size(@shorter) = 1 THEN get(filter(transform(@longer, (t, i) -> "
    "CASE WHEN t IN ('!', 'not') AND concat(slice(@longer, 1, i), slice(@longer, i + 2, size(@longer))) = @shorter "
    "THEN t END), t -> t IS NOT NULL), 0) "
    "WHEN size(@longer) - size(@shorter) = 3 AND slice(@longer, 1, 2) = array('!', '(') AND "
    "element_at(@longer, -1) = ')' AND slice(@longer, 3, size(@shorter)) = @shorter THEN '!' END")
_DIFFS = ("filter(zip_with(o.x, o.y, (m, n) -> CASE WHEN m <> n THEN concat(m, ' → ', n) END), d -> d IS NOT NULL)")
inversion = Scalar(
    "inversion", "a STRING, b STRING", "STRING",
    bind(f"named_struct('x', {operator_tokens('@a')}, 'y', {operator_tokens('@b')})", "o",
         "CASE WHEN size(o.x) = size(o.y) THEN " +
         bind(_DIFFS, "ds", "CASE WHEN size(ds) = 1 AND "
              f"array_contains({texts(f'{a} → {b}' for a, b in _PAIRS)}, get(ds, 0)) THEN get(ds, 0) END") +
         f" WHEN size(o.y) > size(o.x) THEN concat('added ', {negation_between('o.y', 'o.x')}) "
         f"ELSE concat('removed ', {negation_between('o.x', 'o.y')}) END"))
_CLEAN_DOC = (f"transform(split(@doc, '\\\\r\\\\n|\\\\n|\\\\r'), l -> trim(regexp_replace(regexp_replace(l, "
              f"{text(fx.COMMENT_MARK)}, ''), {text(fx.COMMENT_END)}, '')))")
_PARA = (f"array_join(aggregate({_CLEAN_DOC}, named_struct('done', false, 'para', cast(array() AS ARRAY<STRING>)), "
         "(a, l) -> CASE WHEN a.done THEN a "
         f"WHEN l rlike {text(fx.DOC_END)} OR (l = '' AND size(a.para) > 0) THEN "
         "named_struct('done', true, 'para', a.para) "
         f"WHEN l <> '' AND NOT l rlike {text(fx.DIRECTIVE)} THEN "
         "named_struct('done', false, 'para', concat(a.para, array(l))) ELSE a END, a -> a.para), ' ')")
first_sentences = Scalar("first_sentences", "doc STRING", "STRING",
                         f"array_join(slice(split({_PARA}, {text(fx.SENTENCE_BREAK)}), 1, 2), ' ')")
_own_name_dropped = Scalar(
    "own_name_dropped", "s STRING, name STRING", "STRING",
    "CASE WHEN lower(substring_index(@s, ' ', 1)) IN (lower(@name), concat(lower(@name), '()')) "
    r"AND substring(@s, length(substring_index(@s, ' ', 1)) + 2, 1) rlike '^\\p{Ll}' "
    "THEN concat(upper(substring(@s, length(substring_index(@s, ' ', 1)) + 2, 1)), "
    "substring(@s, length(substring_index(@s, ' ', 1)) + 3)) ELSE @s END")
doc_sentences = Scalar(
    "doc_sentences", "doc STRING, name STRING", "STRING",
    bind(_own_name_dropped(first_sentences("@doc"), "@name"), "ds",
         "nullif(CASE WHEN length(ds) <= 240 THEN ds ELSE concat(left(ds, 239), '…') END, '')"))
has_error = Scalar(
    "has_error", "s STRING, language STRING", "BOOLEAN",
    "CASE WHEN @language = 'go' THEN "
    r"trim(element_at(split(regexp_replace(@s, '^\\s*return\\b', ''), ','), -1)) <> 'nil' AND "
    r"trim(element_at(split(regexp_replace(@s, '^\\s*return\\b', ''), ','), -1)) rlike '(?i)err' "
    f"ELSE {_matches('@s', fx.ERROR_TEXT)} END")
_LIMITS = table(fx.LIMIT_WORDS)
limit_word = Scalar(
    "limit_word", "s STRING", "STRING",
    f"element_at({_LIMITS}, get(filter(array_sort({words('@s')}), w -> map_contains_key({_LIMITS}, w)), 0))")
redact = Scalar(
    "redact", "name STRING, value STRING", "STRING",
    f"CASE WHEN {_matches('@name', fx.SECRET_KEY)} AND trim(BOTH '\\'\"' FROM @value) <> '' THEN '•••' "
    "ELSE " + clip("trim(BOTH '\\'\"' FROM @value)", str(fx.MAX_CLIP)) + " END")
_DT = text(fx.DIFF_TOKEN)
same_length = Scalar(
    "same_length", "x ARRAY<STRING>, y ARRAY<STRING>", "INT",
    bind("array_position(zip_with(@x, @y, (p, q) -> p <=> q), false)", "k",
         "cast(CASE WHEN k = 0 THEN size(@x) ELSE k - 1 END AS INT)"))
_TAIL_X, _TAIL_Y = "reverse(slice(o.x, n + 1, size(o.x)))", "reverse(slice(o.y, n + 1, size(o.y)))"
inline_diff = Scalar(
    "inline_diff", "a STRING, b STRING",
    "STRUCT<prefix: STRING, removed: STRING, added: STRING, suffix: STRING>",
    bind(f"named_struct('x', regexp_extract_all(@a, {_DT}, 0), 'y', regexp_extract_all(@b, {_DT}, 0))", "o",
         bind(same_length("o.x", "o.y"), "n", bind(
             same_length(_TAIL_X, _TAIL_Y), "m",
             "named_struct('prefix', array_join(slice(o.x, 1, n), ''), "
             "'removed', array_join(slice(o.x, n + 1, size(o.x) - n - m), ''), "
             "'added', array_join(slice(o.y, n + 1, size(o.y) - n - m), ''), "
             "'suffix', array_join(slice(o.x, size(o.x) - m + 1, m), ''))"))))

# ---- outside systems -----------------------------------------------------------------------------
external_kind = Scalar(
    "external_kind", "name STRING", "STRING",
    "CASE " + " ".join(f"WHEN exists({texts(ws)}, w -> contains(lower(@name), w)) THEN {text(k)}"
                       for k, ws in fx.EXTERNAL_KINDS.items()) + " ELSE 'other' END")


def external_key_of(aliases: dict, generic) -> str:
    """The merge key of a name as SQL over @name, for a given alias table and list of generic words."""
    spelled = "regexp_extract_all(lower(@name), '[a-z0-9]+', 0)"
    expanded = f"transform({spelled}, w -> coalesce(element_at({table(aliases)}, w), w))" if aliases else spelled
    kept = f"filter({expanded}, w -> NOT array_contains({texts(generic)}, w))"
    return (f"replace(array_join(CASE WHEN size({kept}) > 0 THEN {kept} ELSE {expanded} END, ''), ' ', '')")


external_key = Scalar("external_key", "name STRING", "STRING",
                      external_key_of(fx.EXTERNAL_ALIASES, fx.EXTERNAL_GENERIC))
callee_text = Scalar(
    "callee_text", "s STRING, callee STRING", "STRING",
    r"coalesce(nullif(regexp_replace(trim(substring_index(@s, '(', 1)), '^(defer|go|await)\\s+', ''), ''), "
    "@callee, 'call')")
_W = r"array_union(" + words("@s") + r", regexp_extract_all(@s, '\\w+', 0))"
effect_kind_of_text = Scalar(
    "effect_kind_of_text", "s STRING", "STRING",
    bind(_W, "ws", "CASE " + " ".join(
        f"WHEN arrays_overlap(ws, {texts(ks)}) THEN {text(k)}"
        for k, ks in [*fx.EXTERNAL_KINDS.items(), ("queue", fx.QUEUE_WORDS), ("db", fx.DB_WORDS),
                      ("network", fx.NETWORK_WORDS)]) + " ELSE 'outside' END"))
effect_kind = Scalar(
    "effect_kind", "target STRING, s STRING, callee STRING", "STRING",
    bind(f"lower(coalesce(@target, {callee_text('@s', '@callee')}))", "z",
         f"CASE WHEN z rlike {text(fx.PAYMENT)} THEN 'payment' "
         f"WHEN @target IS NOT NULL THEN replace({external_kind('z')}, 'other', 'outside') "
         f"ELSE {effect_kind_of_text('z')} END"))
effect_op = Scalar(
    "effect_op", "callee STRING", "STRING",
    f"CASE WHEN {_matches('@callee', fx.WRITE_VERB)} THEN 'writes' "
    f"WHEN {_matches('@callee', fx.READ_VERB)} THEN 'reads' ELSE 'calls' END")
link_kind = Scalar(
    "link_kind", "how STRING, ext_kind STRING, to_ext BOOLEAN", "STRING",
    "CASE WHEN @to_ext AND @ext_kind IN ('db', 'storage') THEN 'data' "
    f"WHEN (@to_ext AND @ext_kind = 'queue') OR coalesce(@how, '') rlike {text(fx.ASYNC_WORDS)} THEN 'async' "
    "ELSE 'call' END")
is_user_facing = Scalar("is_user_facing", "kind STRING", "BOOLEAN", _matches("coalesce(@kind, '')", fx.USER_FACING))

_LAST = r"element_at(split(@value, '\\.|::|->'), -1)"
# a constant's own name; null when the text is a variable or no constant
state_value = Scalar(
    "state_value", "value STRING, field STRING", "STRING",
    f"CASE WHEN @value rlike {text(r"""^["':]""")} THEN "
    f"nullif(trim(regexp_replace(@value, {text(r"""^["':]|["']$""")}, '')), '') ELSE " + bind(
        _LAST, "lv", "CASE WHEN lv IN ('True', 'False', 'None', 'TRUE', 'FALSE', 'NULL') THEN NULL "
        "WHEN lv rlike '^[A-Z][A-Z0-9_]+$' OR (lv rlike '^[A-Z]' AND "
        f"@value rlike {text(fx.STATE_WORD)} AND lv <> @field AND NOT right(lv, 6) rlike {text(fx.STATE_WORD)}) THEN "
        "coalesce(nullif(regexp_extract(lv, '^[A-Z]\\\\w*[a-z]\\\\w*?_([A-Z][A-Z0-9_]+)$', 1), ''), lv) END") + " END")
# the constant set a value comes from
state_family = Scalar(
    "state_family", "value STRING", "STRING",
    f"CASE WHEN @value rlike {text(r"""^["']""")} THEN 'string' WHEN startswith(@value, ':') THEN 'symbol' ELSE " + bind(
        _LAST, "lf", "concat(left(@value, length(@value) - length(lf)), "
        "regexp_extract(lf, '(?i)^.*?(state|status|phase|stage)', 0))") + " END")

# ---- search --------------------------------------------------------------------------------------
fuzzy_score = Scalar(
    "fuzzy_score", "q STRING, s STRING", "DOUBLE",
    "aggregate(filter(split(lower(@s), ''), c -> c <> ''), "
    "named_struct('i', 0, 'score', 0, 'last', -2, 'j', 0, 'prev', ''), (a, c) -> "
    "CASE WHEN a.i < length(@q) AND c = substring(@q, a.i + 1, 1) THEN named_struct('i', a.i + 1, "
    "'score', a.score + CASE WHEN a.last = a.j - 1 THEN 3 ELSE 1 END + "
    r"CASE WHEN a.j = 0 OR a.prev rlike '[\\s._\\-/·:]' THEN 2 ELSE 0 END, "
    "'last', a.j, 'j', a.j + 1, 'prev', c) "
    "ELSE named_struct('i', a.i, 'score', a.score, 'last', a.last, 'j', a.j + 1, 'prev', c) END, "
    "a -> CASE WHEN a.i = length(@q) THEN cast(a.score + CASE WHEN startswith(lower(@s), @q) THEN 6 ELSE 0 END "
    "AS DOUBLE) - length(@s) * cast(0.01 AS DOUBLE) ELSE cast(-1 AS DOUBLE) END)")
risk_rank = Scalar("risk_rank", "risk STRING", "INT",
                   f"cast(array_position({texts(fx.RISKS)}, @risk) - 1 AS INT)")
risk_name = Scalar("risk_name", "n INT", "STRING", f"get({texts(fx.RISKS)}, @n)")
