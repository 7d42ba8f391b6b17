"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions alone.

Card numbers (valid check digit), telephone numbers, dates and IPv4 addresses are permuted within their format: separators, length and check
digit hold, so equal values get equal pseudonyms in every document, and different values different ones. A stretch of digits and separators is read
token by token, so values are found beside other numbers; what fails its check (no such date, octet or check digit) stays as it is. A number beside
a card number is taken into it where both together have a valid check digit (one case in ten).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
DATE = r"\d{4}-\d{2}-\d{2}"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
PHONE = r"\+\d(?:[ ()-]{0,3}\d){6,14}(?!\d)"
CARD = r"\d(?:(?! \d{4}-\d{2}-\d{2}(?!\d))[ -]?\d){12,18}(?!\d)"
END = r"(?![\p{L}\d]|[.-]\d)"
STRETCH = r"(?<![\p{L}\d.+-])[+\d][\d ()+.-]*+\p{L}?"   # what a value can lie in, and the letter behind it
TOKEN = r"\+?\d+|[^\d+]+|\+"
SPAN, ENOUGH = 80, 11    # tokens that a value fits in; digits after which a blank ends a telephone number


def _round(key: str, i: str, n: str, x: str, size: str) -> str:
    return f"pmod(cast(conv(substr(sha2(concat_ws(':', '{key}', {i}, {n}, {x}), 256), 1, 15), 16, 10) AS bigint), {size})"


def feistel(key: str, value: str, a: str, b: str, tag: str) -> str:
    """SQL for a keyed permutation of the numbers below a * b: halves take turns at being shifted by a digest of the other."""
    start = f"named_struct('l', cast(({value}) DIV ({b}) AS bigint), 'r', cast(({value}) % ({b}) AS bigint))"
    left = f"pmod(f.l + {_round(key, 'i', tag, 'f.r', a)}, {a})"
    right = f"pmod(f.r + {_round(key, 'i', tag, 'f.l', b)}, {b})"
    step = f"IF(i % 2 = 0, named_struct('l', {left}, 'r', f.r), named_struct('l', f.l, 'r', {right}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (f, i) -> {step}, f -> f.l * ({b}) + f.r)"


def _power(n: str) -> str:
    return f"cast(concat('1', repeat('0', {n})) AS bigint)"


def digits(key: str, d: str, tag: str) -> str:
    """SQL for a permutation of the digit strings of d's length (at most 18): the value's halves as above."""
    n = f"length({d})"
    value = feistel(key, f"cast({d} AS bigint)", _power(f"({n} DIV 2)"), _power(f"({n} - {n} DIV 2)"), f"concat('{tag}', {n})")
    return f"lpad(cast({value} AS string), {n}, '0')"


def luhn(payload: str) -> str:
    """SQL for the check digit that follows a payload."""
    total = (f"aggregate(split(reverse({payload}), ''), named_struct('s', 0, 'two', true), (t, c) -> named_struct('s', t.s + IF(t.two, "
             f"cast(c AS int) * 2 - IF(cast(c AS int) > 4, 9, 0), cast(c AS int)), 'two', NOT t.two), t -> t.s)")
    return f"cast(pmod(10 - {total} % 10, 10) AS string)"


def refill(shape: str, d: str) -> str:
    """SQL for ``shape`` with its digits replaced, in order, by those of d."""
    return (f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (t, c) -> IF(c BETWEEN '0' AND '9', "
            f"named_struct('o', concat(t.o, substr({d}, t.k, 1)), 'k', t.k + 1), named_struct('o', concat(t.o, c), 'k', t.k)), t -> t.o)")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym(key: str, m: str) -> str:
    """SQL for the pseudonym of one valid value."""
    days = f"datediff(cast({m} AS date), DATE'1900-01-01')"
    day = f"cast(date_add(DATE'1900-01-01', cast(IF(n < 73000, {feistel(key, 'n', '250L', '292L', chr(39) + 'date' + chr(39))}, 73000 + {feistel(key, 'n - 73000', '7L', '7L', chr(39) + 'late' + chr(39))}) AS int)) AS string)"
    date = _let(days, "n", day)
    octets = f"transform(split({m}, '[.]'), x -> cast(x AS bigint))"
    whole = feistel(key, "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]", "65536L", "65536L", "'address'")
    address = _let(octets, "o", _let(whole, "v", "concat_ws('.', v DIV 16777216, v DIV 65536 % 256, v DIV 256 % 256, v % 256)"))
    phone = _let(_only_digits(m), "d", _let(digits(key, "d", "phone"), "p", refill(m, "p")))
    paid = _let("substr(d, 1, length(d) - 1)", "q", _let(digits(key, "q", "card"), "p", _let(f"concat(p, {luhn('p')})", "full", refill(m, "full"))))
    card = _let(_only_digits(m), "d", paid)
    return f"CASE WHEN {m} RLIKE {_text('^' + DATE + '$')} THEN {date} WHEN {m} RLIKE {_text('^' + ADDRESS + '$')} THEN {address} WHEN {m} LIKE '+%' THEN {phone} ELSE {card} END"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _card(w: str) -> str:
    """SQL for the longest card number that ``w`` starts with, or null: prefixes of 13 to 19 digits that end with a token, by check digit."""
    d = _only_digits("substr(c, 1, n)")
    good = _let(d, "d", f"length(d) >= 13 AND {_let('substr(d, 1, length(d) - 1)', 'q', luhn('q'))} = right(d, 1)")
    ends = f"substr({w}, n, 1) RLIKE '[0-9]' AND NOT substr({w}, n + 1, 2) RLIKE {_text(r'^(?:[\p{L}\d]|[.]\d)')} AND {good}"
    return _let(f"regexp_extract({w}, {_text('^' + CARD)}, 0)", "c", f"IF(c = '', NULL, get(transform(filter(sequence(length(c), 13, -1), n -> {ends}), n -> substr(c, 1, n)), 0))")


def _phone(w: str) -> str:
    """SQL for the telephone number that ``w`` starts with, or null: it goes on to the last token within 15 digits, but stops at a blank once it has
    ``ENOUGH`` digits, and at a date, address, card or other telephone number."""
    rest = f"substr({w}, n + 1)"
    other = f"r RLIKE {_text(rf'^ +(?:{DATE}|{ADDRESS}){END}')} OR {_card('ltrim(r)')} IS NOT NULL"
    count = f"length({_only_digits('substr(c, 1, n)')})"
    stops = _let(rest, "r", f"left(r, 1) IN (' ', ')') AND ({count} >= {ENOUGH} OR {other})")
    ends = f"substr(c, n, 1) RLIKE '[0-9]' AND NOT {rest} RLIKE {_text(r'^(?:[\p{L}\d]|[.-]\d)')} AND {count} >= 7"
    found = _let(f"filter(sequence(1, length(c)), n -> {ends})", "g", f"coalesce(get(filter(g, n -> {stops}), 0), get(g, size(g) - 1))")
    return _let(f"regexp_extract({w}, {_text('^' + PHONE)}, 0)", "c", f"IF(c = '', NULL, {_let(found, 'n', 'substr(c, 1, n)')})")


def _value(w: str, before: str) -> str:
    """SQL for the valid value that ``w`` starts with, or null; ``before`` is the character in front of it. Cards may follow a hyphen."""
    date = f"regexp_extract({w}, {_text(rf'^({DATE})(?:T|{END})')}, 1)"
    address = f"regexp_extract({w}, {_text(rf'^{ADDRESS}{END}')}, 0)"
    behind = f"regexp_replace({w}, '^0+[ -]', '')"   # zeros in front of a card number keep its check digit valid
    days = f"datediff(try_cast({date} AS date), DATE'1900-01-01')"
    return (f"CASE WHEN {before} RLIKE '[.+]' THEN NULL WHEN {before} = '-' THEN {_card(w)} WHEN {w} LIKE '+%' THEN {_phone(w)} "
            f"WHEN coalesce({days} BETWEEN 0 AND 73048, false) THEN {date} "
            f"WHEN {address} <> '' AND NOT exists(split({address}, '[.]'), x -> cast(x AS bigint) > 255) THEN {address} "
            f"WHEN {w} RLIKE '^0+[ -]' AND {_card(behind)} IS NOT NULL THEN NULL ELSE {_card(w)} END")


def _stretch(key: str, s: str) -> str:
    """SQL for (o, found, changed) of one stretch: from each token on the valid value, if any, is replaced, and the next one sought behind it."""
    w = f"array_join(slice(t, i, {SPAN}), '')"
    step = (f"IF(i <= a.past OR NOT t[i - 1] RLIKE '[0-9]', named_struct('o', IF(i <= a.past, a.o, concat(a.o, t[i - 1])), 'past', a.past, 'found', a.found, 'changed', a.changed), "
            + _let(_let(w, "w", _value("w", "IF(i = 1, '', right(t[i - 2], 1))")), "v",
                   "IF(v IS NULL, named_struct('o', concat(a.o, t[i - 1]), 'past', a.past, 'found', a.found, 'changed', a.changed), "
                   + _let(pseudonym(key, "v"), "new", f"named_struct('o', concat(a.o, new), 'past', i - 1 + size(regexp_extract_all(v, {_text(TOKEN)}, 0)), "
                          "'found', a.found + 1, 'changed', a.changed + IF(new <> v, 1, 0))") + ")") + ")")
    start = "named_struct('o', '', 'past', 0, 'found', 0, 'changed', 0)"
    return _let(f"regexp_extract_all({s}, {_text(TOKEN)}, 0)", "t", f"aggregate(sequence(1, size(t)), {start}, (a, i) -> {step})")


def pseudonymise(docs: DataFrame, key: str = "change this key") -> DataFrame:
    """(doc_id, text, n_found, n_changed): every whole text with its validated values permuted under ``key``.

    Null texts stay null with 0 and 0; empty texts stay empty; equal rows give equal rows; an empty table gives an empty one; other columns are
    not read. A permutation may map a value to itself.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key may hold no quote or backslash")
    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)).alias("ms"), F.split("text", STRETCH, -1).alias("gaps"))
    new = found.withColumn("new", F.expr(f"transform(ms, m -> {_stretch(key, 'm')})"))
    text = "IF(size(ms) > 0, array_join(flatten(transform(gaps, (g, i) -> IF(i < size(new), array(g, new[i].o), array(g)))), ''), text)"
    total = lambda f: F.coalesce(F.expr(f"aggregate(new, 0, (a, x) -> a + x.{f})"), F.lit(0))
    return new.select("doc_id", F.expr(text).alias("text"), total("found").alias("n_found"), total("changed").alias("n_changed"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
