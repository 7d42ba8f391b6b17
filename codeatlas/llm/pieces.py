"""SentencePiece models run by the tokenizers library.

The model file is read as a protobuf; normaliser, white-space marker, scores (as a unigram model, or as the merge order of a BPE model) and
byte fallback are rebuilt. Pieces made of markers alone all share one lowest score, so ties go left to right: such runs are joined after the rest.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_blocks

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each protobuf field."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        yield key >> 3, value


class Pieces:
    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers
        data = open(path, "rb").read()
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.names = [p for p, _, _ in pieces]
        unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        runs = {p: i for p, i in ids.items() if len(p) > 1 and set(p) == {MARK}}
        self.runs, self.mark = {len(p): i for p, i in runs.items()}, ids.get(MARK)
        self.scores, self.cut = [x for _, x, _ in pieces], {}
        self.bpe = trainer.get(3, 1) == 2
        if self.bpe:
            usable = {p for p, _, kind in pieces if kind == NORMAL}
            merges = [(a, b) for _, p in sorted(((-s, i), p) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL and len(p) > 1 and p not in runs)
                      for k in range(1, len(p)) for a, b in [(p[:k], p[k:])] if a in usable and b in usable and a not in runs and b not in runs]
            model = models.BPE(vocab=ids, merges=merges, unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=bool(trainer.get(35, 0)))
        else:
            model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=bool(trainer.get(35, 0)))
        self.tool = Tokenizer(model)
        steps = [normalizers.Precompiled(normal[2])] if normal.get(2) else []
        if normal.get(4, 1):
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
        self.prefix = bool(normal.get(3, 1))
        steps += [normalizers.Prepend(" ")] if self.prefix else []
        self.tool.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.bpe and not any(MARK in p.lstrip(MARK) for p in self.names):   # no piece goes on past a marker: words can be cut there
            self.tool.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        self.pieces = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]

    def _run(self, n: int) -> list[int]:
        """Ids of n neighbouring markers: the pair of highest score joins first, the leftmost of equal ones."""
        if n not in self.cut:
            size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
            heap = []

            def offer(i: int, j: int) -> None:
                if i >= 0 and j >= 0 and (k := size[i] + size[j]) in self.runs:
                    heapq.heappush(heap, (-self.scores[self.runs[k]], i, j, k))

            for i in range(n - 1):
                offer(i, i + 1)
            while heap:
                _, i, j, k = heapq.heappop(heap)
                if size[i] and size[j] and size[i] + size[j] == k and after[i] == j:
                    size[i], size[j], after[i] = k, 0, after[j]
                    if after[i] >= 0:
                        before[after[i]] = i
                    offer(before[i], i)
                    offer(i, after[i])
            self.cut[n] = [self.mark if k == 1 else self.runs[k] for k in size if k]
        return self.cut[n]

    def _joined(self, ids: list[int]) -> list[int]:
        marks = np.flatnonzero(np.array(ids, np.int32) == self.mark)
        if not (np.diff(marks) == 1).any():   # single markers stay as they are
            return ids
        out, n = [], 0
        for i in [*ids, -1]:
            if i == self.mark:
                n += 1
                continue
            if n:
                out += self._run(n)
                n = 0
            out.append(i)
        return out[:-1]

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._joined(x) for x in found] if self.bpe and self.runs and self.mark is not None else found

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for, looked up piece by piece; the space that the normaliser put in front is taken off."""
        text = b"".join(map(self.pieces.__getitem__, ids))
        return text[1:] if self.prefix and text[:1] == b" " else text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.decode_bytes(x).decode("utf-8", "replace") for x in ids]


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip, ids): ids of every whole text, and whether decoding gives the text back.

    Null and empty texts have no ids; equal rows give equal rows; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(model)
        for part, texts in text_blocks(batches, most=1 << 20):
            texts = [t or "" for t in texts]
            ids = tool.encode(texts)
            arrays = [np.array(x, "<i4") for x in ids]
            ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)   # a block's ids are fewer than 2**31
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in arrays], pa.int64()),
                pa.array([tool.decode_bytes(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]),
                pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *arrays]))],
                ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), model or default_model())
