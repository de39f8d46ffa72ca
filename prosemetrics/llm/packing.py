"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens hold at once.

Each task packs the documents it reads, one sequence at a time, out of a bounded window: among the pieces that fit
whole, the one whose demand has the largest dot product with what is left of the limits goes in, each limit weighed
by the mean demand on it in the window. Where none fits whole, the best piece is cut. So tasks need no shuffle and
no memory beyond the window, and a lost task is repeated from the rows it read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _checked, letters
from .common import distinct, map_arrow, slices, table, utf8
from .tokens import _spans, normalized

#: Bytes of text that are tokenized at a time.
SLICE = 1 << 20
#: Documents and ids that wait in a task to be placed, at most; a longer document waits alone.
WINDOW, WINDOW_IDS = 256, 1 << 20


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most: tokens in all, segments, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Sequences of pieces, as ``rows``: key, start, length, loss, crc32 and ids of each, document tokens, sequence, offset."""

    def __init__(self, limits: Limits, first: int, split: bool, keep: bool):
        self.limits, self.next, self.split, self.keep = limits, first, split, keep
        self.items: list[tuple] = []  # key and ids of what waits
        self.start, self.end, self.prompt = (np.zeros(WINDOW + 1, np.int64) for _ in range(3))
        self.waiting, self.rows = 0, []

    def add(self, key, ids: np.ndarray, prompt: int = 0) -> None:
        """A document's ids, of which the first ``prompt`` bear no loss."""
        top, n, at = self.limits, len(ids), 0
        while n - at >= top.tokens and at + top.tokens - max(at, min(prompt, at + top.tokens)) <= top.loss:
            self._emit([(key, ids, at, top.tokens, prompt)])  # as good as full sequences get
            at += top.tokens
        if at == n:
            return
        k = len(self.items)
        self.items.append((key, ids[at:].copy(), at, n))
        self.start[k], self.end[k], self.prompt[k] = at, n, prompt
        self.waiting += n - at
        while len(self.items) > WINDOW or (self.waiting > WINDOW_IDS and self.items):
            self._fill()

    def finish(self) -> None:
        while self.items:
            self._fill()

    def _fill(self) -> None:
        top = self.limits
        tokens, segments, loss, chosen = top.tokens, top.segments, top.loss, []
        k = len(self.items)
        weights = (self.end[:k] - self.start[:k]).mean() / top.tokens, (self.end[:k] - np.maximum(self.start[:k], self.prompt[:k])).clip(0).mean() / max(1, top.loss)
        while tokens and segments and self.items:
            k = len(self.items)
            start, end, prompt = self.start[:k], self.end[:k], self.prompt[:k]
            size = end - start
            free = np.maximum(prompt - start, 0)
            bears = np.maximum(size - free, 0)
            fits = (size <= tokens) & (bears <= loss)
            if not fits.any():  # the part of each that fits
                size = np.minimum(np.minimum(size, tokens), free + loss)
                bears = np.maximum(size - free, 0)
                fits = size > 0
                if not fits.any():
                    break
            gain = weights[0] * tokens / top.tokens**2 * size + weights[1] * loss / max(1, top.loss) ** 2 * bears + segments / top.segments**2
            at = int(np.where(fits, gain, -1.0).argmax())
            taken = int(size[at])
            key, ids, first, total = self.items[at]
            chosen.append((key, ids, int(start[at]), taken, int(prompt[at]), first, total))
            tokens, segments, loss = tokens - taken, segments - 1, loss - int(bears[at])
            self.waiting -= taken
            self.start[at] += taken
            if self.start[at] == self.end[at]:  # the last one takes its place
                self.items[at] = self.items[-1]
                self.items.pop()
                for x in (self.start, self.end, self.prompt):
                    x[at] = x[k - 1]
        used = top.tokens - tokens
        if not chosen:
            raise ValueError("the limits leave no room for a token")
        if used == top.tokens or not self.split:
            self._emit(chosen)
            return
        for bit in range(used.bit_length() - 1, -1, -1):  # sequences of a power of two need no padding
            room, part = used & 1 << bit, []
            while room:
                head, size = chosen[0], min(room, chosen[0][3])
                part.append((*head[:3], size, *head[4:]))
                chosen[0] = (*head[:2], head[2] + size, head[3] - size, *head[4:])
                if not chosen[0][3]:
                    chosen.pop(0)
                room -= size
            if part:
                self._emit(part)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, ids, start, size, prompt, *held in pieces:
            first, total = held or (0, len(ids))
            own = ids[start - first : start - first + size]
            bears = size - min(size, max(0, prompt - start))
            self.rows.append((key, start, size, bears, zlib.crc32(own.astype("<u4").tobytes()), own.tolist() if self.keep else None, total, self.next, offset))
            offset += size
        self.next += 1

    def taken(self) -> pa.RecordBatch:
        """The rows since the last call, all of them of closed sequences."""
        columns = list(zip(*self.rows, strict=True)) or [()] * len(PIECES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.values(), strict=True)], list(PIECES))


PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "loss_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32()), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
SCHEMA = "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def _packed(stretches: Iterable[Iterable[tuple]], limits: Limits, split: bool, keep: bool) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits, TaskContext.get().partitionId() << 33, split, keep)
    for documents in stretches:
        for document in documents:
            packer.add(*document)
        if packer.rows:
            yield packer.taken()
    packer.finish()
    yield packer.taken()


def pack(rows: DataFrame, limits: Limits = Limits(), split: bool = True, keep: bool = True) -> DataFrame:
    """doc_id, start, length, loss_tokens, ids_crc32, ids, doc_tokens, sequence_id, offset of each piece of ``rows``.

    ``rows``: doc_id, ids and, if there, prompt: how many leading ids bear no loss, as those of an instruction; null
    is none. Documents are cut where that fills a sequence, a document of any length too; every id is in exactly one
    piece. A sequence that a limit keeps below ``limits.tokens`` is parted into powers of two if ``split``. Documents
    without ids (null or none) have no piece. Rows that repeat, or have a null id, are documents each. An empty table
    gives no rows. ``ids`` is null unless ``keep``. Raises ValueError if the limits leave room for no token.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 0:
        raise ValueError("the limits leave no room for a token")
    prompt = F.coalesce(F.col("prompt").cast("long"), F.lit(0)) if "prompt" in rows.columns else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents(batch: pa.RecordBatch) -> Iterator[tuple]:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(column).to_pylist())])
            for key, a, b, p in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], batch.column("prompt").to_pylist(), strict=True):
                yield key, flat[a:b], max(0, p)

        yield from _packed(map(documents, batches), limits, split, keep)

    return map_arrow(rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"), prompt.alias("prompt")), run, SCHEMA)


class Library:
    """Ids of the pieces of texts by the tokenizers library: each piece of a slice once, in one call, without its splitting."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _checked(spec) or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("the vocabulary does not part words")
        self.whole, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for x in (self.whole, self.pieces):
            x.no_truncation()
            x.no_padding()
        self.pieces.normalizer, self.pieces.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.last = np.zeros(1 + max(spec["model"]["vocab"].values(), default=0), bool)
        self.last[[k for x, k in spec["model"]["vocab"].items() if x.endswith("</w>")]] = True
        self.signs = letters() | {0x20: " "}  # a blank parts pieces; none lies within one

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [k for k, x in enumerate(texts) if not any(s in x for s in self.special)]
        raw = [normalized(texts[k]).encode() for k in plain]
        data = b"".join(raw)
        own, bounds = np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, raw)])
        first, last, at = _spans(own, bounds, False)
        where, back = distinct(own, first, last)
        joined = b" ".join([data[x:y] for x, y in zip(first[where].tolist(), last[where].tolist(), strict=True)])
        ids = np.array(self.pieces.encode_batch_fast([joined.decode("latin-1").translate(self.signs)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(where):
            raise ValueError("a piece does not end with its last token")
        begin = np.concatenate([[0], ends])[:-1]
        n = (ends - begin)[back]
        place = np.cumsum(n) - n
        ids = ids[np.repeat(begin[back] - place, n) + np.arange(int(n.sum()))]
        cuts, out = np.append(place, n.sum())[at], [np.zeros(0, np.int32)] * len(texts)
        for j, k in enumerate(plain):
            out[k] = ids[cuts[j] : cuts[j + 1]]
        for k in set(range(len(texts))).difference(plain):  # special strings are the library's matter
            out[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.int32)
        return out


@lru_cache(1)
def _library(path: str) -> Library:
    return Library(path)


def pack_texts(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = 1, split: bool = True, keep: bool = False) -> DataFrame:
    """``pack`` for whole texts, tokenized by the library as they are packed, each with the id ``end`` at its end.

    A null text is empty: its one piece is ``end``. The result is that of ``pack``. Raises ValueError for a tokenizer
    file whose words have no ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, stop = _library(path), np.array([end], np.int32)

        def stretches() -> Iterator[list[tuple]]:
            for batch in batches:
                _, offsets = utf8(batch.column("text"))
                for a, b in slices(offsets, SLICE):
                    part = batch.slice(a, b - a)
                    ids = library.encode([x or "" for x in part.column("text").to_pylist()])
                    yield [(key, np.concatenate([x, stop]), 0) for key, x in zip(part.column("doc_id").to_pylist(), ids, strict=True)]

        yield from _packed(stretches(), limits, split, keep)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of all documents, and loss_tokens.

    2048 tokens, 128 segments, all tokens bearing loss. Sequences are full or of a power of two. A null text is
    empty; a null or repeated doc_id stays as it is, each row a document of its own; an empty table gives no rows.
    """
    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
