"""Encoding of texts with a public byte-level BPE (problem 7) and their sizes in tokens.

Texts of a batch are laid end to end as arrays of code points and bytes. Each code point gets a class
from a table; piece boundaries follow from comparing the classes of neighbouring code points, in place of
associative scans of a transition function, and contractions are patched by index, so no regular
expression is used. Pieces are keyed by their bytes, looked up once per distinct piece in a cache of
merged pieces, and the ids are gathered by offset; merging an unseen piece is pair merging over a heap. `token_offsets` gives the
place of each token in its text, `decode_corpus` the text of ids.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARIES = "/opt/tokenizers"
#: Code points that are encoded together; bounds the arrays a task holds beside its longest text.
CHUNK = 1 << 20
#: Merged pieces that a worker remembers.
CACHE = 400_000

LETTER, DIGIT, BLANK, SPACE, OTHER = 0, 1, 2, 3, 4  # SPACE: U+0020, BLANK: other white space
#: White space of the tokenizer's pattern beyond the separators of Unicode.
CONTROL_BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
#: The endings which the tokenizer's pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, and one more entry for the gap between texts."""
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "Z":
            table[c] = BLANK
    table[list(CONTROL_BLANKS)] = BLANK
    table[0x20] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece starts. points: code points of texts laid end to end; first: True at the first of each text."""
    n = len(points)
    kind = classes()[points]
    white = (kind == BLANK) | (kind == SPACE)
    kind = np.where(white, BLANK, kind)
    before = np.empty_like(kind)
    before[1:], before[0] = kind[:-1], OTHER
    start = first | (kind != before)
    # a contraction after the end of a piece: 's, 't, 're ...
    last = np.append(first[1:], True)
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        free = first[quote] | (points[quote - 1] != 0x20) | (quote == 0)
        quote = quote[free]
        for e in ENDINGS:
            at = quote[quote + len(e) < n]
            for k, letter in enumerate(e, 1):
                at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
            if not len(at):
                continue
            start[at + 1] = False
            end = at + len(e) + 1
            start[end[end < n]] = True
            quote = np.setdiff1d(quote, at, assume_unique=True)
    # white space: all but the last of a run is one piece, unless the run ends the text; the last joins
    # what follows if it is a plain space, and else stands alone
    final = white & ~last & ~np.append(white[1:], False)
    at = np.flatnonzero(final)
    start[at] = True
    joins = at[points[at] == 0x20]
    start[joins + 1] = False
    return start


def offsets8(points: np.ndarray) -> np.ndarray:
    """Byte offset in UTF-8 of every code point, and of the end."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate(([0], np.cumsum(width)))


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbouring parts those whose union has the lowest rank (the leftmost of equal ones) merge, until none has a rank."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # end of the part that starts at i (0: merged away), start of the part before it
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has merged with another part meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes batches of texts with the vocabulary of a .tiktoken file, and decodes ids."""

    def __init__(self, folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> None:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes: list[bytes] | None = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[object, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.where = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _learn(self, key: object, piece: bytes) -> int:
        rank = self.ranks.get(piece)
        ids = merge_pairs(piece, self.ranks) if rank is None else [rank]
        at, k = self.used, len(self.known)
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)))
        if k >= len(self.where):
            self.where, self.size = np.concatenate((self.where, np.zeros_like(self.where))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.ids[at : at + len(ids)] = ids
        self.where[k], self.size[k], self.used = at, len(ids), at + len(ids)
        self.known[key] = k
        return k

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number in the cache of each piece, its start in code points of the joined texts, and its text's number."""
        if len(self.known) > CACHE:
            self.forget()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(points), bool)
        starts_of = np.concatenate(([0], ends[:-1]))
        first[starts_of[starts_of < ends]] = True
        starts = np.flatnonzero(boundaries(points, first))
        raw = joined.encode()
        cut = starts if len(raw) == len(points) else offsets8(points)[starts]
        length = np.diff(np.append(cut, len(raw)))
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        # pieces of up to 7 bytes are keyed by one number (bytes and length), longer ones by their bytes
        number = np.lib.stride_tricks.as_strided(padded, (len(raw) + 8, 8), (1, 1))
        short = np.flatnonzero(length <= 7)
        key = np.ascontiguousarray(number[cut[short]]).view(np.uint64).ravel()
        key &= (np.uint64(1) << (length[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        key |= length[short].astype(np.uint64) << np.uint64(56)
        out = np.empty(len(starts), np.int64)
        codes, distinct = pd.factorize(key)
        known, learn = self.known, self._learn
        _, at = np.unique(codes, return_index=True)
        some = short[at]
        lo, hi = cut[some].tolist(), (cut[some] + length[some]).tolist()
        table = np.fromiter((k if (k := known.get(d)) is not None else learn(d, raw[a:b]) for d, a, b in zip(distinct.tolist(), lo, hi)), np.int64, len(distinct))
        out[short] = table[codes] if len(table) else 0
        long = np.flatnonzero(length > 7)
        lo, hi = cut[long].tolist(), (cut[long] + length[long]).tolist()
        out[long] = [k if (k := known.get(p)) is not None else learn(p, p) for p in (raw[a:b] for a, b in zip(lo, hi))]
        return out, starts, np.searchsorted(ends, starts, "right")

    def batches(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        some: list[str] = []
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if some and size + len(t) > CHUNK:
                yield some, held
                some, held, size = [], [], 0
            some.append(t)
            held.append(i)
            size += len(t)
        if some:
            yield some, held

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        counts, out = np.zeros(len(texts), np.int64), []
        for some, held in self.batches(texts):
            piece, _, text = self.pieces(some)
            size = self.size[piece]
            ends = np.cumsum(size)
            within = np.arange(ends[-1]) - np.repeat(ends - size, size)
            out.append(self.ids[np.repeat(self.where[piece], size) + within])
            counts[held] = np.bincount(text, weights=size, minlength=len(some))
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def offsets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the code point at which the piece of each token starts; tokens of one piece share it."""
        out = [np.zeros(0, np.int64) for _ in texts]
        for some, held in self.batches(texts):
            piece, starts, text = self.pieces(some)
            size = self.size[piece]
            begin = np.concatenate(([0], np.cumsum([len(t) for t in some])[:-1]))
            at, of = np.repeat(starts - begin[text], size), np.repeat(text, size)
            for k, i in enumerate(held):
                out[i] = at[of == k]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 (cut sequences of ids) become replacement characters."""
        if self.bytes is None:
            self.bytes = [b""] * (max(self.ranks.values()) + 1)
            for piece, rank in self.ranks.items():
                self.bytes[rank] = piece
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        for some, held in self.batches(texts):
            piece, _, text = self.pieces(some)
            counts[held] = np.bincount(text, weights=self.size[piece], minlength=len(some))
        return counts


@lru_cache(maxsize=1)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per document: its id and `ids`, the list of integers of its text without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text. Repeated rows
    come out as often as they come in; other columns are not read. The order of rows is kept within a
    partition. No shuffle.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            ids, counts = enc.encode(b.column(1).to_pylist())
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per row: its id and `text`, the text that its ids stand for; empty ids give an empty text, null ids null. No shuffle."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def token_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per document: its id and `starts`, the code point at which the piece of each token starts (as many as ids). No shuffle."""
    schema = T.StructType([docs.schema[id_col], T.StructField("starts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.offsets(b.column(1).to_pylist()), pa.list_(pa.int64()))], names=[id_col, "starts"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def token_sizes(docs: DataFrame, keep: list[str], text_col: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """The columns `keep` and `tokens`, the number of tokens of the text (0 for null and empty texts)."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(enc.sizes(b.column(len(keep)).to_pylist()))], names=[*keep, "tokens"])

    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(run, schema)
