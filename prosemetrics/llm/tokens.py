"""Token counts by a compiled transducer, and encoding and decoding by per-prefix dynamic programming.

The tokenizer file is a parameter; it is read where the work is done and must lie at the same path everywhere.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BLANK, END, SPACE, Counter, char_classes, pieces, vocabulary
from .common import distinct, map_arrow, slices, sums, table, utf8

#: Bytes of text that are counted at a time: pieces are looked up once in each such slice.
SLICE = 1 << 20
#: Bytes that pieces and their ids take in a worker's memory at most, as they are counted here.
MOST_KNOWN = 24 << 20


class Known:
    """Ids, as bytes of 32-bit numbers, by the bytes of a piece; all are forgotten when they outgrow the bound."""

    def __init__(self) -> None:
        self.ids, self.size = {}, 0

    def add(self, piece: bytes, ids: list[int]) -> bytes:
        held = array("i", ids).tobytes()
        size = 180 + len(piece) + len(held)
        if self.size + size > MOST_KNOWN:
            self.ids, self.size = {}, 0
        if size <= MOST_KNOWN:
            self.ids[piece] = held
            self.size += size
        return held


@lru_cache(1)
def _known(path: str) -> Known:
    return Known()


@lru_cache(1)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _spans(own: np.ndarray, bounds: np.ndarray, joined: bool, cut: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of the pieces in texts own[bounds[i]:bounds[i+1]], and the texts' bounds among them.

    ``cut``: byte spans that are no part of a piece.
    """
    points = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((own & 0xC0) != 0x80)
    kinds = char_classes()[points]
    for a, b in cut:
        kinds[np.searchsorted(lead, a) : np.searchsorted(lead, b)] = END
    at = np.searchsorted(lead, bounds[1:])
    kinds, places = np.insert(kinds, at, END), np.insert(lead, at, bounds[1:])
    starts = pieces(kinds, joined)
    first, last = places[starts], np.append(places[starts[1:]], len(own))
    real = kinds[starts] != END
    if not joined:
        real &= (kinds[starts] != SPACE) & (kinds[starts] != BLANK)
    owner = np.searchsorted(at + np.arange(len(at)), starts[real])
    return first[real], last[real], np.searchsorted(owner, np.arange(len(bounds)))


def _pattern(contents: Iterable[str]) -> re.Pattern | None:
    return re.compile(b"(" + b"|".join(re.escape(x.encode()) for x in sorted(contents, key=len, reverse=True)) + b")") if contents else None


def _specials(own: np.ndarray, bounds: np.ndarray, pattern: re.Pattern | None) -> list[tuple[int, int, int]]:
    """Text, first and last byte of each special string that lies within one text."""
    if pattern is None or not pattern.search(own.tobytes()):
        return []
    return [(k, int(bounds[k]) + m.start(), int(bounds[k]) + m.end()) for k in range(len(bounds) - 1) for m in pattern.finditer(own[bounds[k] : bounds[k + 1]].tobytes())]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_bytes and n_tokens of each whole text under a byte-level vocabulary; columns of these names are replaced.

    Special strings in a text are one token each, as the library has them by default. A null text is empty: 0 and
    0. A text of any length is handled whole, its pieces a bounded stretch at a time. Repeated rows get equal
    results; an empty table gives no rows. Raises ValueError for a file of another kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counter = vocabulary(path), _counter(path)
        if not vocab.joined:
            raise ValueError("the vocabulary is not byte-level")
        pattern = _pattern(vocab.special)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, SLICE):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                special = _specials(own, bounds, pattern)
                first, last, at = _spans(own, bounds, True, [x[1:] for x in special])
                where, back = distinct(own, first, last)
                total = sums(counter.count_all(own, first[where], last[where])[back], at) + np.bincount([x[0] for x in special], minlength=b - a).astype(np.int64)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), pa.array(total)], [*part.schema.names, "n_bytes", "n_tokens"])

    kept = docs.drop("n_bytes", "n_tokens")
    return map_arrow(kept, run, _schema(kept) + ", n_bytes long, n_tokens long")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def normalized(text: str) -> str:
    """Composed characters in lower case, one by one: a final sigma is like any other."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ids, the tokens of each whole text under a lower-casing vocabulary with word ends; a column ids is replaced.

    Special strings in a text are their own tokens. A null text is empty and has no ids. A text of any length is
    handled whole. Repeated rows get equal results; an empty table gives no rows. Raises ValueError for a file of
    another kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), _known(path)
        if vocab.joined:
            raise ValueError("the vocabulary does not part words")
        special = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                texts, fixed, owner = [], [], []  # stretches between special strings, in order
                for k, text in enumerate(part.column("text").to_pylist()):
                    for x in special.split(text) if text and special else (text or "",):
                        fixed.append(vocab.special.get(x, -1))
                        texts.append(b"" if fixed[-1] >= 0 else normalized(x).encode())
                        owner.append(k)
                raw = b"".join(texts)
                own, bounds = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
                first, last, at = _spans(own, bounds, False)
                where, back = distinct(own, first, last)
                found: list[bytes] = []
                for x, y in zip(first[where].tolist(), last[where].tolist(), strict=True):
                    piece = raw[x:y]
                    ids = known.ids.get(piece)
                    found.append(known.add(piece, vocab.encode(piece)) if ids is None else ids)
                lengths = np.array([len(x) for x in found], np.int64) // 4
                flat, begin = np.frombuffer(b"".join(found), np.int32), np.cumsum(lengths) - lengths
                n = lengths[back]
                place = np.cumsum(n) - n
                ids = flat[np.repeat(begin[back] - place, n) + np.arange(int(n.sum()))]
                ends = np.append(place, n.sum())[at]  # ids before each stretch
                fixed = np.array(fixed)
                if (fixed >= 0).any():
                    ids = np.insert(ids, ends[:-1][fixed >= 0], fixed[fixed >= 0])
                per = np.bincount(owner, np.diff(ends) + (fixed >= 0), b - a).astype(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "ids"])

    kept = docs.drop("ids")
    return map_arrow(kept, run, _schema(kept) + ", ids array<int>")


@lru_cache(1)
def _strings(path: str) -> np.ndarray:
    """The strings of all ids; None for ids that there are not."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["decoder"]:
        raise ValueError("files with a decoder are not decoded here")
    known = {k: x for x, k in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    out = np.full(max(known) + 1, None, object)
    out[list(known)] = list(known.values())
    return out


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with decoded: the tokens' strings, joined by blanks, as the library decodes a file without a decoder.

    A column decoded is replaced. Null ids decode to a null, none to the empty string. Raises KeyError for an id
    that the vocabulary lacks, ValueError for a file with a decoder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column("ids")
                ids = column.flatten().to_numpy()
                if len(ids) and not (0 <= ids.min() and ids.max() < len(strings)):
                    raise KeyError("an id is not in the vocabulary")
                words, ends = strings[ids], np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(column).to_pylist())])
                texts = [" ".join(words[a:b].tolist()) if good else None for a, b, good in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return map_arrow(kept, run, _schema(kept) + ", decoded string")


def op9_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text of documents; a null text has 0 bytes and tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_prefix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents; a null text is encoded as an empty one."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
