"""Secret scans with one combined deterministic automaton.

All rule patterns are compiled together: Thompson construction, subset construction over byte classes, minimisation by
partition refinement, and one transition array. A scan follows all rules in a single pass over the UTF-8 bytes; many stretches of
text advance together, one numpy step per byte place. Where the automaton accepts, the spans of the accepting rule are read off.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, table

# Rules: kind, pattern, least length of the last group (0: no such test). The first three are the base kinds.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]{16}[A-Z0-9]*", 0),
    ("hex", r"[0-9a-f]{24}[0-9a-f]*", 0),
    ("private_key", r"-----BEGIN [A-Z]*( [A-Z]+)* ?PRIVATE KEY-----", 0),
    ("prefixed", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|(sk|rk|pk)_(live|test)_[A-Za-z0-9]{16}[A-Za-z0-9]*|xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*", 0),
)
BASE = 3
LANE = 512


class Fragments:
    """Thompson fragments of a small pattern language: literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``(?i:``."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def arc(self, a: int, symbols: frozenset[int] | None, b: int) -> None:
        self.moves[a].append((symbols, b))

    def build(self, pattern: str) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, False
        out = self._choice()
        if self.at < len(pattern):
            raise ValueError(f"unread pattern text at {self.at}: {pattern!r}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.arc(start, None, a)
            self.arc(b, None, end)
            if self._peek() != "|":
                return start, end
            self._take()

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self._repeated()
            if self._peek() == "{":
                stop = self.text.index("}", self.at)
                times, after, piece = int(self.text[self.at + 1:stop]), stop + 1, self.at
                for _ in range(times - 1):
                    self.at = begin
                    c, d = self._atom()
                    if self.at != piece:
                        raise ValueError("a count follows one atom")
                    self.arc(b, None, c)
                    b = d
                self.at = after
            self.arc(end, None, a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        a, b = self._atom()
        sign = self._peek()
        if sign and sign in "?*+":
            self._take()
            start, end = self.state(), self.state()
            self.arc(start, None, a)
            self.arc(b, None, end)
            if sign != "+":
                self.arc(start, None, end)
            if sign != "?":
                self.arc(b, None, a)
            return start, end
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._take()
        if c == "(":
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            out = self._choice()
            self._take()
            self.fold = fold
            return out
        if c == "[":
            symbols: set[int] = set()
            while self._peek() != "]":
                low = self._take()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self._take()
                    symbols.update(range(ord(low), ord(self._take()) + 1))
                else:
                    symbols.add(ord(low))
            self._take()
        else:
            symbols = {ord(self._take() if c == "\\" else c)}
        if self.fold:
            symbols |= {ord(x) for s in symbols for x in (chr(s).lower(), chr(s).upper())}
        a, b = self.state(), self.state()
        self.arc(a, frozenset(symbols), b)
        return a, b


class Automaton:
    """A minimal deterministic automaton: ``classes`` maps bytes to columns, ``step`` is the transition array (states x columns),
    ``accepts`` a bit mask of rules per state, state 0 the start."""

    def __init__(self, patterns: list[str], search: bool):
        nfa = Fragments()
        ends = {}
        starts = []
        for r, p in enumerate(patterns):
            a, b = nfa.build(p)
            starts.append(a)
            ends[b] = ends.get(b, 0) | 1 << r
        sets = {s for moves in nfa.moves for s, _ in moves if s is not None}
        marks: dict[tuple, list[int]] = {}
        for byte in range(256):
            marks.setdefault(tuple(byte in s for s in sets), []).append(byte)
        self.classes = np.zeros(256, np.uint8)
        columns = list(marks.values())
        for c, members in enumerate(columns):
            self.classes[members] = c

        @lru_cache(None)
        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for symbols, to in nfa.moves[todo.pop()]:
                    if symbols is None and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(seen)

        first = closure(frozenset(starts))
        index, rows, todo = {first: 0}, [], [first]
        while todo:
            now = todo.pop(0)
            row = []
            for members in columns:
                after = frozenset(to for s in now for symbols, to in nfa.moves[s] if symbols is not None and members[0] in symbols)
                after = closure(after | frozenset(starts)) if search else closure(after)
                if after not in index:
                    index[after] = len(index)
                    todo.append(after)
                row.append(index[after])
            rows.append(row)
        step = np.array(rows)
        accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in index], np.int64)
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:   # refinement: states stay together while all their successors do
            finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        count = 0
        for s in [0, *range(len(block))]:
            if order[block[s]] < 0:
                order[block[s]] = count
                count += 1
        block = order[block]
        one = np.zeros(count, np.int64)
        one[block] = np.arange(len(block))
        self.step, self.accepts = block[step[one]], accepts[one]
        self.dead = next((s for s in range(count) if not self.accepts[s] and (self.step[s] == s).all()), -1)

    def resets(self) -> np.ndarray:
        """Bytes after which every state is the start: no match reaches across them."""
        return (self.step == 0).all(axis=0)[self.classes]


class Scanner:
    """All rules at once for the pass, each alone to read its spans off."""

    def __init__(self, rules=RULES):
        self.rules = rules
        patterns = [p for _, p, _ in rules]
        self.all = Automaton([self.sign(p) for p in patterns], search=True)
        self.alone = [self._byte_table(Automaton([p], search=False)) for p in patterns]
        self.reset = self.all.resets()
        self.flat = self.all.step.astype(np.int32).ravel() * self.all.step.shape[1]
        self.width = self.all.step.shape[1]

    @staticmethod
    def sign(pattern: str) -> str:
        """What the common pass looks for: a rule that begins with fixed text is reported without its counts, since counters of several
        rules side by side would multiply the states; the rule's own automaton then reads the spans off with all counts."""
        return pattern if pattern[0] == "[" else re.sub(r"\{\d+\}", "", pattern)

    @staticmethod
    def _byte_table(a: Automaton) -> tuple[list[list[int]], list[bool], int]:
        return [a.step[s][a.classes].tolist() for s in range(len(a.step))], [bool(x) for x in a.accepts], a.dead

    def accepting(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rule masks) where the pass accepts. ``cuts``: places after which the automaton is at its start; lanes between
        cuts advance together, longest first, so a step touches only lanes that still have bytes."""
        want = np.arange(0, len(data), LANE)
        starts = np.unique(np.r_[0, cuts[np.minimum(np.searchsorted(cuts, want), len(cuts) - 1)] + 1])
        starts = starts[starts < len(data)]
        lengths = np.diff(starts, append=len(data))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left") if len(lengths) else []
        columns, state = self.all.classes[data], np.zeros(len(starts), np.int32)
        marks = np.repeat(self.all.accepts, self.width)
        places, masks = [], []
        for t, n in enumerate(alive):
            now = self.flat[state[:n] + columns[starts[:n] + t]]
            state[:n] = now
            hit = marks[now]
            if hit.any():
                at = np.flatnonzero(hit)
                places.append(starts[at] + t)
                masks.append(hit[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(masks)

    def spans(self, rule: int, data: bytes, start: int, stop: int) -> list[tuple[int, int]]:
        """Leftmost longest non-overlapping matches of one rule between two cuts."""
        rows, accepts, dead = self.alone[rule]
        out, p = [], start
        while p < stop:
            state, end = 0, -1
            for i in range(p, stop):
                state = rows[state][data[i]]
                if state == dead:
                    break
                if accepts[state]:
                    end = i + 1
            if end < 0:
                p += 1
            else:
                out.append((p, end))
                p = end
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in code points, in order."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
        cuts = np.flatnonzero(self.reset[data])
        places, masks = self.accepting(data, cuts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        after = np.searchsorted(cuts, places)
        pieces = {(int(c), r) for c, m in set(zip(after.tolist(), masks.tolist())) for r in range(len(self.rules)) if m >> r & 1}
        for c, r in sorted(pieces):
            start, stop = int(cuts[c - 1]) + 1 if c else 0, int(cuts[c])
            doc = int(np.searchsorted(offsets, start, side="right")) - 1
            base, text = int(offsets[doc]), raw[doc]
            least = self.rules[r][2]
            for a, b in self.spans(r, joined, start, stop):
                if least and self._value_length(joined[a:b]) < least:
                    continue
                before = len(text[:a - base].decode("utf-8", "surrogatepass"))
                out[doc].append((before, r, before + len(joined[a:b].decode("utf-8", "surrogatepass"))))
        return [sorted(x) for x in out]

    @staticmethod
    def _value_length(match: bytes) -> int:
        """Length of the value of an assignment: what follows the first sign, spaces and opening quote."""
        sign = min(i for i in (match.find(b"="), match.find(b":")) if i >= 0)
        value = match[sign + 1:].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'"))


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_other): secrets in every whole text.

    A span is kind:start:end in code points, end exclusive; base_sha256 covers the three base kinds. Null and empty texts have no
    spans (the digest of the empty string); equal rows give equal rows; doc_id may be null; other columns are not read.
    """

    find = scanner()   # compiled once; its arrays go out with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in blocks([len(t or "") for t in texts], 1 << 22):
                found = find.scan(texts[s])
                say = lambda spans: ",".join(f"{RULES[r][0]}:{a}:{b}" for a, r, b in spans)
                base = [say([x for x in f if x[1] < BASE]) for f in found]
                counts = [[sum(x[1] == r for x in f) for f in found] for r in range(BASE)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s.start, s.stop - s.start), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([say(f) for f in found]),
                    pa.array([sum(x[1] >= BASE for x in f) for f in found], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_other"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_other long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _kind_sql(kind: str, pattern: str, test: str) -> str:
    """Matches of one pattern with their places: pieces between matches and the matches themselves, added up."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, a AS start, a + length(m) AS stop FROM (
      SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM texts))) WHERE {test}"""


_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
# SQL for the base kinds; registered spans of the other kinds come from their patterns in the same way.
_OTHER = {"private_key": r"-----BEGIN [A-Z]*(?: [A-Z]+)* ?PRIVATE KEY-----",
          "prefixed": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16}[A-Za-z0-9]*|xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*",
          "web_token": r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*"}
_VALUE = "length(regexp_replace(m, '" + _ASSIGN.replace("'", "''").rsplit("[A-Za-z0-9+/", 1)[0] + "', '')) >= 6"
ORACLE_SQL = "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS (" + " UNION ALL ".join([
    _kind_sql("assign", _ASSIGN, _VALUE), _kind_sql("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    _kind_sql("hex", "[0-9a-f]+", "length(m) >= 24"), *[_kind_sql(k, p, "true") for k, p in _OTHER.items()]]) + """),
ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'private_key', 'prefixed', 'web_token'], kind) AS k, kind || ':' || start || ':' || stop AS s FROM spans)
SELECT t.doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (k <= 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, k), '') AS spans, count(*) FILTER (k > 3) AS n_other
FROM texts t LEFT JOIN ranked r ON r.doc_id = t.doc_id GROUP BY t.doc_id"""
