"""Repeated passages by shard suffix arrays: induced sorting and permuted common prefixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in the same
document or another; matches don't cross documents and are judged on the input.

How shards see all that repeats: of the hashes of the KEY-byte strings inside every window
of LENGTH bytes the least is its anchor. Equal windows have equal anchors, at the same
place. So:

1. A chunk of documents is stored with its anchors, and asks the anchors' shards which of
   them occur twice or more. Copies of whole documents are told apart by a digest: one of
   them represents the others, which are covered wholly.
2. Each chunk sends the text of its windows with a repeated anchor to the anchor's shard,
   overlapping pieces of a document joined into one.
3. A shard joins its pieces (with separators) and sorts their suffixes: suffixes are
   classified as smaller or larger than their right neighbours, leftmost-smaller (LMS)
   substrings are sorted by a first induction and named, the string of names is sorted
   recursively, and the order of LMS suffixes induces the shard's suffix array in linear
   scans. The common prefix with the preceding suffix is computed in text order
   (permuted), by comparison where the left characters differ and by one less than at the
   left neighbour elsewhere. Suffixes with a prefix of LENGTH in common are matches.
4. Each chunk joins the covered stretches and cuts them out.

Scans over at most ALPHABET characters are vectorised, a bucket of one character at once;
those over more names go suffix by suffix. Both are the same induction.

An anchor with more than HOT occurrences never meets in one shard: its windows are hashed
(128 bits), counted in shards of their hashes with one entry per chunk, and the answer
marks the windows. It finds the same matches.

Defined results: null texts are empty; nothing shorter than LENGTH bytes is removed.
Repeated rows are copies of each other. Extra columns are ignored. An empty table gives no
rows. Ids may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.llm.common import U, Tables, hash_spans, lean, lean_group, mix, pack, padded, shards, slices, unpack, utf8, windows8
from bagloom.llm.katz import BLOBS, NAMES, deltas, rows, shard_of, sums

LENGTH, KEY, HOT, CHUNK, ALPHABET = 200, 64, 20_000, 5 << 20, 512
TEXT, ASKED, ANSWER, PIECES, FOUND, WINDOWS, WINDOW_ANSWER = range(7)
#: parts of the pieces' exchange for each shard, so that a suffix array's working set stays small and in the caches
FINER = 20


# ---- suffix arrays -------------------------------------------------------------------


def bounds_of(chars: np.ndarray) -> list[tuple[int, int, int]]:
    """(character, from, to) of the runs of a sorted array."""
    if not len(chars):
        return []
    at = np.flatnonzero(np.diff(chars)) + 1
    return list(zip(chars[np.append(0, at)].tolist(), [0, *at.tolist()], [*at.tolist(), len(chars)], strict=True))


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, top: int) -> np.ndarray:
    """The suffix array that the given order of LMS positions induces (they are in order of first character at least)."""
    starts = [np.zeros(0, np.int64)] * (top + 1)
    for c, a, b in bounds_of(t[lms]):
        starts[c] = lms[a:b]
    empty = np.zeros(0, np.int64)
    large: list[list[np.ndarray]] = [[] for _ in range(top + 1)]

    def spread(source: np.ndarray, kind: bool, into: list[list[np.ndarray]], c: int) -> np.ndarray:
        """Deals the left neighbours of one kind to their buckets; gives those of bucket c."""
        j = source[source > 0] - 1
        j = j[smaller[j] == kind]
        if not len(j):
            return empty
        chars = t[j]
        order = np.argsort(chars, kind="stable")
        j, own = j[order], empty
        for d, a, b in bounds_of(chars[order]):
            if d == c:
                own = j[a:b]
            else:
                into[d].append(j[a:b])
        return own

    done: list[np.ndarray] = []
    for c in range(top + 1):
        front = np.concatenate(large[c]) if large[c] else empty
        pieces = [front]
        while len(front):
            front = spread(front, False, large, c)
            pieces.append(front)
        done.append(np.concatenate(pieces))
        spread(starts[c], False, large, c)
    small: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
    small[0].append(np.array([len(t) - 1], np.int64))
    out: list[np.ndarray] = []
    for c in range(top, -1, -1):
        front = np.concatenate(small[c]) if small[c] else empty
        pieces = [front]
        while len(front):
            front = spread(front, True, small, c)
            pieces.append(front)
        out.append(np.concatenate(pieces)[::-1])
        spread(done[c][::-1], True, small, c)
        out.append(done[c])
    return np.concatenate(out[::-1])


def induce_each(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, top: int) -> np.ndarray:
    """As induce, suffix by suffix: for alphabets with about as many characters as their text has places."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=top + 1))
    sa = np.full(n, n, np.int64)
    chars = t[lms].astype(np.int64)
    count = np.bincount(chars, minlength=top + 1)
    sa[(ends - count - (np.cumsum(count) - count))[chars] + np.arange(len(lms))] = lms
    left = np.full(n + 1, -1, np.int64)
    left[1:n] = t[:-1]
    sa, tail = sa.tolist(), (ends - 1).tolist()
    # the character to the left, -1 where it is of the other kind; entry n stands for none yet
    left[n] = -1
    of = left.copy()
    of[1:n][smaller[:-1]] = -1
    of, head = [*of.tolist()], np.append(0, ends[:-1]).tolist()
    for x in sa:
        c = of[x]
        if c >= 0:
            h = head[c]
            sa[h] = x - 1
            head[c] = h + 1
    left[1:n][~smaller[:-1]] = -1
    of = left.tolist()
    for x in reversed(sa):
        c = of[x]
        if c >= 0:
            h = tail[c]
            sa[h] = x - 1
            tail[c] = h - 1
    return np.array(sa, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of an array of small integers, in order (an end counts less than any character)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if text.dtype == np.uint8:
        used = np.bincount(text, minlength=256) > 0
        codes, top = (np.cumsum(used) - 1)[text], int(used.sum())
    else:
        values, codes = np.unique(text, return_inverse=True)
        top = len(values)
    scan = induce_each if top > ALPHABET else induce
    t = np.zeros(n + 1, np.uint8 if top < 256 else np.uint32)
    t[:n] = codes + 1
    # smaller than the right neighbour; equal characters take the neighbour's kind
    step = np.zeros(n + 1, np.int8)
    step[:n] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[n] = 1
    at = np.where(step != 0, np.arange(n + 1), n)
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    by_char = lms[np.argsort(t[lms], kind="stable")]
    rough = scan(t, smaller, by_char, top)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names of equal LMS substrings are equal
    length = np.ones(n + 1, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    wide = t.view(np.uint8) if t.itemsize == 1 else t.astype("<u4").view(np.uint8)
    keys = hash_spans(padded(wide), ordered * t.itemsize, length[ordered] * t.itemsize)
    names = np.empty(n + 1, np.int64)
    names[ordered] = np.cumsum(np.append(False, (keys[1:] != keys[:-1]) | (length[ordered][1:] != length[ordered][:-1])))
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        ordered = lms[suffix_array(reduced)]
    return scan(t, smaller, ordered, top)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, PHI): for each position the common prefix with the suffix before it in order, and that suffix (-1: none)."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    i = np.arange(n)
    reach = (phi > 0) & (i > 0)
    follows = np.zeros(n, bool)
    follows[reach] = text[i[reach] - 1] == text[phi[reach] - 1]
    # a position follows its left neighbour if that one has a predecessor as well
    follows[1:] &= phi[:-1] >= 0
    irreducible = np.flatnonzero(~follows & (phi >= 0))
    buffer = padded(text)
    view = windows8(buffer)
    live, at = irreducible, np.zeros(len(irreducible), np.int64)
    got = np.zeros(len(irreducible), np.int64)
    where = np.arange(len(irreducible))
    while len(live):
        a, b = live + at, phi[live] + at
        x = view[np.minimum(a, n)] ^ view[np.minimum(b, n)]
        low = x & (~x + U(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, U(1)).astype(np.float64)) // 8).astype(np.int64))
        room = n - np.maximum(a, b)
        same = np.minimum(same, room)
        got[where] += same
        on = (same == 8) & (room > 8)
        live, at, where = live[on], at[on] + 8, where[on]
    plcp[irreducible] = got
    base = np.maximum.accumulate(np.where(~follows, i, 0))
    return np.maximum(np.where(follows, plcp[base] - (i - base), plcp), 0), phi


def repeated(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position whether its `length` bytes also stand elsewhere in the array."""
    plcp, phi = common_prefixes(text, suffix_array(text))
    out = plcp >= length
    out[phi[out]] = True
    return out


# ---- anchors -------------------------------------------------------------------------


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over a[i : i + width] for each i that has so many."""
    have, span = a, 1
    while span * 2 <= width:
        have = pick(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


def key_hashes(buffer: np.ndarray) -> np.ndarray:
    """Hash of the KEY (64) bytes from each position of a padded buffer."""
    h, span = mix(windows8(buffer) + U(0x5851F42D4C957F2D)), 8
    with np.errstate(over="ignore"):
        while span < KEY:
            h = h[:-span] * U(0xD6E8FEB86659FD93) + h[span:]
            h ^= h >> U(29)
            span *= 2
    return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each anchor; first window, number of windows and hash of each run of windows with one anchor hash)."""
    n, width = len(data), LENGTH - KEY + 1
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z.astype(U)
    h = key_hashes(padded(data))[: n - KEY + 1] | U(1)
    least = sliding(h, width, np.minimum)  # of windows 0 to n - LENGTH
    ok = np.ones(n + 1, bool)
    size = np.diff(offsets)
    last = np.minimum(size, LENGTH - 1)
    at = np.repeat(offsets[1:] - last, last) + np.arange(last.sum()) - np.repeat(np.cumsum(last) - last, last)
    ok[at] = False
    ok = ok[: len(least)]
    least[~ok] = 0
    around = np.concatenate([np.zeros(width - 1, U), least, np.zeros(len(h) - len(least), U)])
    found = h[np.flatnonzero(sliding(around, width, np.maximum)[: len(h)] == h)]
    new = np.append(True, least[1:] != least[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    inside = ok[first]
    return found, first[inside], count[inside], least[first[inside]]


def window_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buffer, length = padded(data), np.full(len(places), LENGTH)
    return hash_spans(buffer, places, length, 1), hash_spans(buffer, places, length, 2)


# ---- exchanges -----------------------------------------------------------------------


def encode(docs: DataFrame, n_shards: int) -> DataFrame:
    """A TEXT row for each chunk, and ASKED rows: its anchors' hashes and its documents' digests by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            column = whole.column("text").combine_chunks()
            data, offsets = utf8(column)
            parts = []
            for i, j in slices(column, 256 << 10):
                found, first, count, least = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((found, first + offsets[i], count, least))
            hashes, first, windows, least = (np.concatenate(x) for x in zip(*parts, strict=True))
            raw = data.tobytes()
            o = offsets.tolist()
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[o[i] : o[i + 1]], digest_size=16).digest() for i in range(len(o) - 1)), np.uint64).reshape(-1, 2)
            unique, count = np.unique(hashes, return_counts=True)
            inverse = np.searchsorted(unique, least)
            to = shard_of(unique, n_shards)
            order = np.argsort(to, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            unique, count, to = unique[order], count[order], to[order]
            ids = whole.column("doc_id")
            known = ids.is_valid().to_numpy().astype(np.uint8)
            head = pack(ids.fill_null(0).to_numpy().view(U), known, np.diff(offsets).astype(np.uint64), np.diff(first, prepend=0).astype(np.uint64), windows.astype(np.uint64), rank[inverse])
            found = [(chunk, -1, TEXT, len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=1).compress(raw))]
            doc_to = shard_of(digest[:, 0], n_shards)
            doc_order = np.argsort(doc_to, kind="stable")
            doc_cut = np.searchsorted(doc_to[doc_order], np.arange(n_shards + 1))
            cut = np.searchsorted(to, np.arange(n_shards + 1))
            for s in range(n_shards):
                a, b, own = cut[s], cut[s + 1], doc_order[doc_cut[s] : doc_cut[s + 1]]
                if a < b or len(own):
                    found.append((chunk, s, ASKED, pack(deltas(unique[a:b]), count[a:b].astype(np.uint32), own.astype(np.uint32), digest[own, 0], digest[own, 1])))
            chunk += 1
            yield from rows(*found).to_batches()

        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                held.append(batch.slice(i, j - i))
                size += utf8(held[-1].column(1))[1][-1]
                if size >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(lean(run), BLOBS)


def answer(group: pa.Table, hot: int) -> pa.Table:
    """For each chunk: its anchors' kinds (0 unique, 1 repeated, 2 hot; above them the finer shard), and for its documents 0 sole, 1 first of copies, 2 another copy."""
    shard = group.column("shard")[0].as_py()
    found = sorted(zip(group.column("chunk").to_pylist(), group.column("blob").to_pylist(), strict=True))
    parts = [unpack(b) for _, b in found]
    keys = np.concatenate([sums(p[0]) for p in parts])
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[1] for p in parts])) if len(keys) else np.zeros(0)
    kind = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[inverse]
    kind |= (keys % U(61) % U(FINER)).astype(np.uint8) << np.uint8(2)
    digests = np.concatenate([np.column_stack([p[3].astype(U), p[4].astype(U)]) for p in parts])
    _, first, owner, copies = np.unique(digests, axis=0, return_index=True, return_inverse=True, return_counts=True)
    state = np.where(copies[owner.ravel()] > 1, 2, 0).astype(np.uint8)
    state[first[copies > 1]] = 1
    out, at, doc = [], 0, 0
    for (chunk, _), p in zip(found, parts, strict=True):
        out.append((chunk, shard, ANSWER, pack(kind[at : at + len(p[0])], p[2], state[doc : doc + len(p[2])])))
        at += len(p[0])
        doc += len(p[2])
    return rows(*out)


class Chunk:
    """A chunk's text with what its anchors' shards answered."""

    def __init__(self, group: pa.Table):
        self.chunk = group.column("chunk")[0].as_py()
        answers, self.found, self.windows = [], [], []
        for shard, kind, blob in zip(*(group.column(c).to_pylist() for c in NAMES[1:]), strict=True):
            if kind == TEXT:
                n = int.from_bytes(blob[:8], "little")
                ids, self.known, sizes, first, windows, rank = unpack(blob[8 : 8 + n])
                self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + n :]), np.uint8)
            elif kind == ANSWER:
                answers.append((shard, unpack(blob)))
            elif kind == FOUND:
                self.found.append(unpack(blob))
            else:
                self.windows.append((shard, unpack(blob)))
        answers.sort(key=lambda x: x[0])
        self.ids = ids.astype(U).view(np.int64)
        self.offsets = np.append(0, np.cumsum(sizes.astype(np.int64)))
        kinds = np.concatenate([a[0] for _, a in answers]) if answers else np.zeros(0, np.uint8)
        shard = np.repeat([s for s, _ in answers], [len(a[0]) for _, a in answers]) if answers else np.zeros(0, np.int64)
        self.state = np.zeros(len(sizes), np.uint8)
        for _, (_, own, state) in answers:
            self.state[own] = state
        first = np.cumsum(first.astype(np.int64))
        doc = np.searchsorted(self.offsets, first, "right") - 1
        own = kinds[rank] if len(rank) else np.zeros(0, np.uint8)
        keep = ((own & 3) > 0) & (self.state[doc] != 2)
        #: runs of windows with one repeated anchor, their documents, kinds and fine shards
        self.low, self.high, self.doc, self.kind = first[keep], first[keep] + windows.astype(np.int64)[keep] - 1, doc[keep], own[keep] & 3
        self.shard = (shard[rank[keep]] if len(rank) else np.zeros(0, np.int64)) * FINER + (own[keep] >> 2)

    def spans(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of text that the possible windows of anchors cover."""
        return self.low[which], self.high[which] + LENGTH

    def hot_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, first and second hash) of all windows around hot anchors, by place."""
        a, b = self.spans(np.flatnonzero(self.kind == 2))
        n = np.maximum(b - a - LENGTH + 1, 0)
        places = np.unique(np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return places, *window_hashes(self.data, places)

    def send(self, n_shards: int) -> pa.Table:
        """PIECES by fine shard, and WINDOWS of hot anchors by shard (shifted behind the fine ones)."""
        out = []
        which = np.flatnonzero(self.kind == 1)
        to = self.shard[which]
        a, b = self.spans(which)
        order = np.lexsort((a, to))
        a, b, to, d = a[order], b[order], to[order], self.doc[which][order]
        if len(a):
            new = np.append(True, (to[1:] != to[:-1]) | (d[1:] != d[:-1]) | (a[1:] > b[:-1]))
            head = np.flatnonzero(new)
            a, to = a[head], to[head]
            b = np.append(b[head[1:] - 1], b[-1]) if len(head) > 1 else b[-1:]
        cut = np.searchsorted(to, np.arange(n_shards * FINER + 1))
        for s in np.unique(to).tolist():
            x, y = a[cut[s] : cut[s + 1]], b[cut[s] : cut[s + 1]]
            body = b"".join(self.data[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist(), strict=True))
            head = pack(x.astype(np.uint64), (y - x).astype(np.uint64))
            out.append((self.chunk, s, PIECES, len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)))
        if (self.kind == 2).any():
            _, h1, h2 = self.hot_windows()
            pair, count = np.unique(np.column_stack([h1, h2]), axis=0, return_counts=True)
            to = shard_of(pair[:, 0], n_shards)
            for s in np.unique(to).tolist():
                own = to == s
                out.append((self.chunk, n_shards * FINER + s, WINDOWS, pack(pair[own, 0], pair[own, 1], count[own].astype(np.uint32))))
        return rows(*out)

    def result(self, n_shards: int) -> pa.Table:
        n = len(self.data)
        cover = np.zeros(n + 1, np.int32)
        for a, b in self.found:
            np.add.at(cover, a.astype(np.int64), 1)
            np.add.at(cover, b.astype(np.int64), -1)
        if self.windows:
            places, h1, h2 = self.hot_windows()
            pair, inverse = np.unique(np.column_stack([h1, h2]), axis=0, return_inverse=True)
            to = shard_of(pair[:, 0], n_shards)
            marks = np.zeros(len(pair), bool)
            for s, (found,) in self.windows:
                marks[np.flatnonzero(to == s - n_shards * FINER)] = found > 0
            hit = places[marks[inverse.ravel()]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + LENGTH, -1)
        size = np.diff(self.offsets)
        copies = (self.state > 0) & (size >= LENGTH)
        np.add.at(cover, self.offsets[:-1][copies], 1)
        np.add.at(cover, self.offsets[1:][copies], -1)
        gone = np.cumsum(cover[:n], dtype=np.int32) > 0
        del cover
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        head = gone.copy()
        if n:
            head[1:] &= ~gone[:-1] | first[1:n]
        before, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(head))
        removed, spans = np.diff(before[self.offsets]), np.diff(runs[self.offsets])
        o, sha = self.offsets.tolist(), []
        for i in range(len(size)):
            own = self.data[o[i] : o[i + 1]]
            sha.append(hashlib.sha256((own[~gone[o[i] : o[i + 1]]] if removed[i] else own).tobytes()).hexdigest())
        return pa.Table.from_arrays([pa.array(self.ids, mask=self.known == 0), pa.array(size), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def match(group: pa.Table, n_shards: int) -> pa.Table:
    """One shard: covered stretches of each chunk's pieces, or marks of its windows."""
    shard = group.column("shard")[0].as_py()
    chunks, blobs = group.column("chunk").to_pylist(), group.column("blob").to_pylist()
    out = []
    if shard >= n_shards * FINER:
        parts = [unpack(b) for b in blobs]
        pairs = np.concatenate([np.column_stack([p[0].astype(U), p[1].astype(U)]) for p in parts])
        _, inverse = np.unique(pairs, axis=0, return_inverse=True)
        total = np.bincount(inverse.ravel(), np.concatenate([p[2] for p in parts]))[inverse.ravel()] > 1
        at = 0
        for chunk, p in zip(chunks, parts, strict=True):
            out.append((chunk, shard, WINDOW_ANSWER, pack(total[at : at + len(p[0])].astype(np.uint8))))
            at += len(p[0])
        return rows(*out)
    begin, size, owner, content = [], [], [], []
    same: dict[bytes, int] = {}
    for k, blob in enumerate(blobs):
        n = int.from_bytes(blob[:8], "little")
        a, lengths = unpack(blob[8 : 8 + n])
        body = zstandard.ZstdDecompressor().decompress(blob[8 + n :])
        ends = np.cumsum(lengths.astype(np.int64)).tolist()
        at = 0
        for end in ends:
            content.append(same.setdefault(body[at:end], len(same)))
            at = end
        begin.append(a.astype(np.int64))
        size.append(lengths.astype(np.int64))
        owner.append(np.full(len(a), k))
    begin, owner, content = np.concatenate(begin), np.concatenate(owner), np.array(content)
    # equal pieces are matches as a whole; one of them stands for all in the suffix array
    copies = np.bincount(content) > 1
    size = np.array([len(x) for x in same], np.int64)
    text = np.frombuffer(b"\xff".join(same) + b"\xff", np.uint8)
    del same
    place = np.cumsum(size + 1) - size - 1
    found = repeated(text)
    piece = np.repeat(np.arange(len(size)), size + 1)
    found |= copies[piece]
    # windows that hold a separator are none
    found &= np.arange(len(text)) - place[piece] + LENGTH <= size[piece]
    starts = np.flatnonzero(found)
    if not len(starts):
        return rows()
    own = piece[starts]
    new = np.append(True, (own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(starts) - 1)
    # stretches of each distinct piece, then of every piece with that content
    own, a, b = own[first], starts[first] - place[own[first]], starts[last] - place[own[first]] + LENGTH
    count = np.bincount(own, minlength=len(size))
    base = np.cumsum(count) - count
    many = count[content]
    at = np.repeat(base[content] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    shift, who = np.repeat(begin, many), np.repeat(owner, many)
    a, b = a[at] + shift, b[at] + shift
    cut = np.searchsorted(who, np.arange(len(chunks) + 1))
    for k, chunk in enumerate(chunks):
        if cut[k] < cut[k + 1]:
            out.append((chunk, shard, FOUND, pack(a[cut[k] : cut[k + 1]].astype(np.uint64), b[cut[k] : cut[k + 1]].astype(np.uint64))))
    return rows(*out)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for docs (doc_id, text)."""
    spark = docs.sparkSession
    tables, n = Tables(spark, "suffixes"), shards(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = tables.write(encode(docs, n))
    text = encoded.filter(F.col("kind") == TEXT)
    answers = tables.write(encoded.filter(F.col("kind") == ASKED).groupBy("shard").applyInArrow(lean_group(lambda g: answer(g, hot)), BLOBS))
    both = text.unionByName(answers)
    sent = both.groupBy("chunk").applyInArrow(lean_group(lambda g: Chunk(g).send(n)), BLOBS)
    found = tables.write(sent.groupBy("shard").applyInArrow(lean_group(lambda g: match(g, n)), BLOBS))
    return both.unionByName(found).groupBy("chunk").applyInArrow(lean_group(lambda g: Chunk(g).result(n)), SCHEMA)
