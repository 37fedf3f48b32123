"""Packing documents into fixed windows by the online sum-of-squares rule.

A window of W tokens with fill h (0 < h < W) is open; a level array counts the open
windows of each fill. A document of more than W tokens first fills whole windows; what is
left goes to the fill h (0: a fresh window) that minimises the sum of the squared counts
after the step. With N(h) open windows at h, moving one from h to h + s changes the sum
by 2 (N(h + s) - N(h) + 1), opening one by 2 N(s) + 1 and completing one by 1 - 2 N(h),
so the rule is one argmin over the level array. At the end of a partition the open
windows (a few hundred, whatever the partition's size) are joined and cut into full
windows, and the last rest into power-of-two windows, which need no padding.

Every partition packs on its own: no shuffle, no driver state; ids of a window are
partition number * 2**36 + count. Ids come from the vocabulary file given as a parameter.

Defined results: a null or empty text is one piece that holds the end id only. Repeated
rows are packed each. Null doc_ids are kept. Other columns of the input are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.llm.common import hash_spans, lean, padded, slices, utf8

WINDOW, END_ID = 2048, 1
#: new pieces of a batch that are compared with the library's ids
CHECKED = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary, a file of the tokenizers library.

    The merges of single pieces are run by tiktoken over the ranks of the same file: the
    library's own merges take 437 CPU seconds a GB in the check tool, above the 400 allowed.
    A task compares the first pieces of every batch with the library and takes the library
    for all if one differs, as it does for vocabularies of another kind.

    A space between two other visible characters always begins a pre-token of this
    vocabulary's pattern, so a text may be cut before each such space and the pieces be
    encoded one by one. Pieces repeat a lot; a bounded cache, keyed by their bytes, keeps
    the ids of those met before. Texts with a special token's string are encoded whole.
    """

    SPECIAL = b"<|endoftext|>"

    def __init__(self, vocabulary: str | None = None, kept: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.bpe, self.kept = Tokenizer.from_file(vocabulary or default_vocabulary()), kept
        self.quick = ranked(vocabulary or default_vocabulary())
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode(text, add_special_tokens=False).ids, np.uint32)

    def add(self, piece: bytes, ids: list[int]) -> None:
        self.known[piece] = len(self.begin) - 1
        self.flat.extend(ids)
        self.begin.append(len(self.flat))

    def rows_of(self, pieces: list[bytes]) -> np.ndarray:
        """The cache's row of each piece; those it lacks are encoded together."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if self.quick and any(self.quick(p.decode()) != self.slow(p.decode()).tolist() for p in new[:CHECKED]):
            self.quick = None
        encode = self.quick or (lambda text: self.slow(text).tolist())
        for p in new:
            self.add(p, encode(p.decode()))
        return np.array([known[p] for p in pieces], np.int64)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) for a batch of texts in UTF-8."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if self.SPECIAL in raw:
            out = [self.slow(raw[offsets[i] : offsets[i + 1]].decode()) for i in range(len(offsets) - 1)]
            return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        plain = (data > 0x20) & (data < 0x7F)
        after = plain | (data == 0xC3)
        before = plain.copy()
        before[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        cut[1 : n - 1] |= (data[1:-1] == 0x20) & before[:-2] & after[2:]
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        spans = padded(data)
        keys = hash_spans(spans, starts, ends - starts)
        _, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        # pieces of one hash are one piece: a second hash says so
        check = hash_spans(spans, starts, ends - starts, 1)
        if (check[where][inverse] != check).any():
            where, inverse = np.arange(len(starts)), np.arange(len(starts))
        if len(self.known) + len(where) > self.kept:
            self.clear()
        row = self.rows_of([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        flat, begin = np.array(self.flat, np.uint32), np.array(self.begin, np.int64)
        size = (begin[1:] - begin[:-1])[row]
        begin = begin[row]
        sizes = size[inverse]
        total = np.cumsum(sizes)
        at = np.repeat(begin[inverse] - (total - sizes), sizes) + np.arange(total[-1])
        before_piece = np.append(0, total)
        return flat[at], before_piece[np.searchsorted(starts, offsets)]


def ranked(vocabulary: str):
    """A function from text to ids for a byte-level BPE file whose ids follow its merges; None for others."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the characters that stand for bytes in such files: visible ones for themselves, the others from 256 on
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}
    try:
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if not (token.startswith("<|") and token.endswith("|>"))}
        place = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    except KeyError:
        return None
    if place != sorted(place) or len(ranks) != len(set(ranks.values())):
        return None
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(vocabulary: str | None = None) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(vocabulary)


class Levels:
    """Open windows by fill, and the pieces that went into each."""

    def __init__(self, window: int, first_sequence: int):
        self.w, self.count, self.open, self.next, self.rows = window, np.zeros(window + 1, np.int64), {}, first_sequence, []

    def level_for(self, size: int) -> int:
        """The fill that takes size tokens at the least sum of squares; 0 is a fresh window. Ties: the fullest."""
        n, w = self.count, self.w
        here, there = n[: w - size + 1], n[size : w + 1]
        cost = 2 * (there - here + 1)
        cost[w - size] = 1 - 2 * here[w - size]  # completes a window
        cost[here == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * there[0] + 1 if size < w else 1
        return w - size - int(np.argmin(cost[::-1]))

    def put(self, doc: tuple, start: int, ids: np.ndarray, total: int) -> None:
        piece, size = (doc, start, ids, total), len(ids)
        h = self.level_for(size) if size < self.w else 0
        if h:
            self.count[h] -= 1
            pieces = self.open[h].pop()
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.w:
            self.close(pieces)
        else:
            self.count[h + size] += 1
            self.open.setdefault(h + size, []).append(pieces)

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Joins what is open and cuts it into full windows, then into powers of two."""
        rest = [p for h in sorted(self.open, reverse=True) for pieces in self.open[h] for p in pieces]
        left, pieces, fill = sum(len(p[2]) for p in rest), [], 0
        room = self.size_of(left)
        for doc, start, ids, total in rest:
            at = 0
            while at < len(ids):
                k = min(len(ids) - at, room - fill)
                pieces.append((doc, start + at, ids[at : at + k], total))
                at, fill, left = at + k, fill + k, left - k
                if fill == room:
                    self.close(pieces)
                    pieces, fill, room = [], 0, self.size_of(left)
        self.open, self.count[:] = {}, 0

    def size_of(self, left: int) -> int:
        return self.w if left >= self.w else 1 << max(0, left.bit_length() - 1)


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, batch_bytes: int = 4 << 20, vocabulary: str | None = None) -> DataFrame:
    """One row per piece (vocabulary: a file of the tokenizers library on every worker): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        levels = Levels(window, TaskContext.get().partitionId() << 36)
        names = SCHEMA.replace(" long", "").split(", ")
        schema = pa.schema([(n, pa.int64()) for n in names])

        def flush() -> pa.RecordBatch:
            rows, levels.rows = levels.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for whole in batches:
            for i, j in slices(whole.column(1), batch_bytes):
                batch = whole.slice(i, j - i)
                doc_ids = batch.column(0).to_pylist()
                ids, bounds = bpe.batch(*utf8(batch.column(1)))
                for k, doc in enumerate(doc_ids):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID))
                    full = len(own) - len(own) % window
                    for at in range(0, full, window):
                        levels.close([(doc, at, own[at : at + window], len(own))])
                    if full < len(own):
                        levels.put(doc, full, own[full:].copy(), len(own))
                if levels.rows:
                    yield flush()
        levels.finish()
        if levels.rows:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
