"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path`` (the host and its subdomains, paths that start so) or a pattern with ``*`` for any text and ``^`` for one
separator or an end. Its literal tokens are the letter-digit runs that a fitting url must hold as whole runs. Each rule lies in the
index under the one of them that is rarest in the urls at hand; a url's own tokens fetch its candidates, and only those run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# (verdict, host, path): the longest that fits wins.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Patterns for urls that no host rule decides; the longest that fits wins.
PATTERNS = (("block", "^ads^"), ("block", "^adserver^"), ("block", "^banner^*^click^"), ("block", "^cgi-bin^"), ("block", "^casino^"), ("block", "^doubleclick^"),
            ("block", "^login^"), ("block", "^porn^"), ("block", "^tracker^"), ("block", "^xxx^"), ("allow", "^about^login^"))
WORD = re.compile(r"[A-Za-z0-9]+")


def host_regex(host: str, path: str) -> str:
    return r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)


def pattern_regex(pattern: str) -> str:
    return "".join({"*": ".*", "^": "(?:[^A-Za-z0-9%]|^|$)"}.get(c) or re.escape(c) for c in pattern)


def whole_tokens(text: str) -> list[str]:
    """Runs that stand between separators on both sides inside the rule, so also in every url that fits it."""
    return [m.group() for m in WORD.finditer(text) if m.end() < len(text) and text[m.end()] != "*" and (m.start() == 0 or text[m.start() - 1] != "*")]


def _rules(host_rules, patterns) -> list[tuple]:
    out = [("host", v, h + p, re.compile(host_regex(h, p), re.S), whole_tokens(h + p)) for v, h, p in host_rules]
    out += [("pattern", v, p, re.compile(pattern_regex(p), re.S), whole_tokens(p) if p[0] == "^" else whole_tokens("*" + p)) for v, p in patterns]
    return out


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url[url.index("://") + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), slash + path


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): what the rules say of every url.

    A host rule decides if one fits; else the longest pattern that fits (null if none), on the A-Z-lower-cased url; else ``default``.
    Null urls and urls without ``://`` have an empty host and path; such a null url fits nothing. Equal rows give equal rows; an
    empty table gives an empty one; other columns are not read. The rules are a parameter held in memory; urls of any number.
    """
    rules = _rules(host_rules, patterns)
    words = sorted({t for r in rules for t in r[4]})
    seen = dict.fromkeys(words, 0)
    if words:   # how often each rule token occurs, over all urls
        found = pages.select(F.explode(F.expr(r"regexp_extract_all(url, '[A-Za-z0-9]+', 0)")).alias("t"))
        found = found.select(F.explode(F.array_distinct(F.array("t", F.lower("t")))).alias("t"))
        seen |= {r["t"]: r["count"] for r in found.where(F.col("t").isin(words)).groupBy("t").count().collect()}
    index: dict[str | None, list[tuple]] = {}
    for r in rules:
        index.setdefault(min(r[4], key=lambda t: (seen[t], t), default=None), []).append(r)

    def judge(url: str | None) -> tuple:
        host, path = split_url(url)
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), url or "")
        best: dict[str, tuple] = {}
        for t in {None, *WORD.findall(host + path), *WORD.findall(low)}:
            for r in index.get(t, ()):
                if (url is not None and r[3].search(host + path if r[0] == "host" else low)) and (r[0] not in best or (len(r[2]), r[2]) > (len(best[r[0]][2]), best[r[0]][2])):
                    best[r[0]] = r
        rule, pattern = best.get("host"), best.get("pattern")
        return host, path, rule and rule[2], (rule or pattern or (0, default))[1], None if rule or not pattern else pattern[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.string()) for k in range(5)]],
                                             ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _case(items: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in items) + f" ELSE {otherwise} END"


_HOSTS = sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_PATTERNS = sorted(PATTERNS, key=lambda r: (-len(r[1]), r[1]))[::1]
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _HOSTS]
_HITS = [(f"regexp_matches(low, '{pattern_regex(p)}')", p, v) for v, p in _PATTERNS]
ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS low,
  regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages),
parts AS (SELECT page_id, low, {_LOWER.format("regexp_extract(rest, '^[^/]*')")} AS host, regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path FROM cut),
judged AS (SELECT *, {_case([(t, r) for t, r, _ in _FITS], 'NULL')} AS rule, {_case([(t, r) for t, r, _ in _HITS], 'NULL')} AS hit FROM parts)
SELECT page_id, host, path, rule, {_case([(f"rule = '{r}'", v) for _, r, v in _FITS] + [(f"hit = '{r}'", v) for _, r, v in _HITS], "'allow'")} AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern FROM judged"""
