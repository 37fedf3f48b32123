"""Katz back-off scores: Good-Turing discounted n-grams (of ORDER words, unless told) over each other.

Texts: lower-case A-Z, words are runs of other bytes than white space, then one end token.
Training documents are those with learn = true. The vocabulary has every training token
and one class for all others, which takes the words' discounted mass.

  P(w)     = d1(c) c / N                         for a known w, the rest of 1 for the class
  P(w | h) = dn(c(h, w)) c(h, w) / c(h)          for a seen n-gram
           = alpha(h) P(w | h without its first) otherwise (alpha is 1 for an unseen h)
  alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h without its first) over the w seen after h)

The first word's h is a start token, which longer contexts begin with; the k-th word has no
context beyond it. dn is Katz's discount of order n for counts up to K = 5; where the counts
of counts don't allow it, an absolute discount. A context without discounted mass counts
one more, so that alpha stays positive: every distribution adds up to 1.

The work is done in chunks of documents and in shards of keys, by numpy on packed arrays:

1. A chunk (some MB of text) becomes a token stream and its distinct word hashes with
   training counts; both are written to a table. A shard of word hashes adds up the counts
   of all chunks, gives each word a dense id and answers every chunk in the chunk's order.
2. For n = 2 to ORDER, each chunk asks the shard of a context h for its distinct (h, w), with
   training counts and the count one order below. The shard adds up, and answers with
   c(h, w), whether another chunk has it, and, for each h, the numbers of seen w by count 1
   to K and their probability one order below: all that alpha(h) needs besides dn. A context
   that no other chunk has is counted where it is; an n-gram whose context or lower n-gram
   is unseen isn't asked for. A context with more than a shard's share is salted by w; a
   chunk adds up the answers.
3. Each chunk evaluates its tokens, from words up.

So a key that holds a third of all tokens is one entry per chunk at most, shards are as
many as the session's shuffle partitions, and the driver gets a few counts per shard only.
Words and contexts of two words or more are named by 64-bit hashes.

Defined results: null texts count as empty (one end token). Null ids are not held out.
Repeated rows are scored, and learned from, each. Extra columns are ignored. An empty
table gives no rows; without training tokens every score is that of a sole class, 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.llm.common import LOWER, U, Tables, hash_spans, lean, lean_group, mix, pack, padded, shards, slices, unpack, utf8, words

K = 5
#: words of an n-gram. 3 was measured as well: its exchange outgrows the disk allowed (README)
ORDER = 2
CHUNK = 4 << 20
END = U(0x2545F4914F6CDD1D)
UNKNOWN, START, FIRST = 0, 1, 2
NEXT = U(0xD1342543DE82EF95)
BLOBS = "chunk long, shard int, kind int, blob binary"
NAMES = ["chunk", "shard", "kind", "blob"]
#: ANSWER + n: a shard's answer on n-grams
STREAM, WORDS, WORD_ANSWER, STATS, ANSWER = range(5)


def rows(*found: tuple[int, int, int, bytes]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*found, strict=True)) if found else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> U(32)) * U(n) >> U(32)).astype(np.int64)


def deltas(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=U(0)).astype(U)


def sums(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype(U), dtype=U)


class Discounts:
    """Katz's discount by count, from the counts of counts n[1..K+1]."""

    def __init__(self, n: list[int], k: int = K):
        self.d = np.ones(k + 1)
        n = [0, *n]
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        flat = min(0.9, n[1] / (n[1] + 2 * n[2])) if n[1] + n[2] else 0.0
        for r in range(1, k + 1):
            star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            d = (star / r - a) / (1 - a) if a < 1 else 0.0
            self.d[r] = d if 0 < d <= 1 else (r - flat) / r

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c < len(self.d), self.d[np.minimum(c, len(self.d) - 1)], 1.0)


class Unigrams:
    """P(w) of a known count, and of the class of unknown words (count 0)."""

    def __init__(self, total: int, n: list[int]):
        self.total, self.discounts = total, Discounts(n)
        kept = total - sum((1 - self.discounts.d[r]) * r * n[r - 1] for r in range(1, K + 1))
        # without discounted mass the class gets one token's share
        self.scale = max(total, 1) if kept < total - 1e-9 else total + 1
        self.unknown = (self.scale - kept) / self.scale if total else 1.0

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.of(c) * c / self.scale, self.unknown)


def encode(docs: DataFrame, n_shards: int) -> DataFrame:
    """A STREAM row for each chunk and WORDS rows for its shards. docs: doc_id, text, learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            data, offsets = utf8(whole.column("text").combine_chunks())
            starts, ends, counts = words(data, offsets)
            low = padded(LOWER[data])
            hashes = hash_spans(low, starts, ends - starts)
            hashes[hashes == END] ^= U(1)
            places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
            tokens = np.full(len(hashes) + len(counts), END, U)
            tokens[places] = hashes
            counts = counts + 1
            learn = whole.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)
            unique, inverse = np.unique(tokens, return_inverse=True)
            to = shard_of(unique, n_shards)
            order = np.argsort(to, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            unique, to = unique[order], to[order]
            stream = rank[inverse]
            trained = np.bincount(stream, np.repeat(learn, counts), len(unique)).astype(np.uint32)
            ids = whole.column("doc_id")
            known = ids.is_valid().to_numpy().astype(np.uint8)
            found = [(chunk, -1, STREAM, pack(stream, counts.astype(np.uint32), learn, ids.fill_null(0).to_numpy().view(U), known))]
            cut = np.searchsorted(to, np.arange(n_shards + 1))
            for s in range(n_shards):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    found.append((chunk, s, WORDS, pack(deltas(unique[a:b]), trained[a:b])))
            chunk += 1
            yield from rows(*found).to_batches()

        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                part = batch.slice(i, j - i)
                held.append(part)
                size += utf8(part.column(1))[1][-1]
                if size >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(lean(run), BLOBS)


def histogram(counts: np.ndarray) -> np.ndarray:
    """Keys by count 1 to K + 1."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]


def count_words(group: pa.Table, n_shards: int) -> pa.Table:
    """One shard of words: ids and counts for each chunk, in the chunk's order."""
    shard = group.column("shard")[0].as_py()
    chunks, parts = group.column("chunk").to_pylist(), [unpack(b) for b in group.column("blob").to_pylist()]
    keys = np.concatenate([sums(p[0]) for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    _, inverse = np.unique(keys, return_inverse=True)
    total, several = np.bincount(inverse, counts).astype(np.int64), np.bincount(inverse) > 1
    order = np.argsort(-total, kind="stable")
    ids = np.empty(len(total), np.uint64)
    ids[order] = np.arange(len(total), dtype=np.uint64) * U(n_shards) + U(shard + FIRST)
    ids[total == 0] = UNKNOWN
    out, at = [], 0
    for chunk, p in zip(chunks, parts, strict=True):
        own = inverse[at : at + len(p[0])]
        out.append((chunk, shard, WORD_ANSWER, pack(ids[own], (total * 2 + several)[own].astype(U))))
        at += len(own)
    out.append((-1, shard, STATS, pack(np.array([total.sum(), (total > 0).sum(), *histogram(total)], np.uint64))))
    return rows(*out)


@dataclass
class Level:
    """The distinct n-grams of one chunk at one order."""

    inverse: np.ndarray  # the n-gram that ends at each token, -1: the text is too short there
    key: np.ndarray  # the n-gram's name in all chunks
    count: np.ndarray  # in all training texts
    shared: np.ndarray  # whether another chunk may hold it
    p: np.ndarray
    scale: np.ndarray  # what its context's counts are divided by


class Chunk:
    """The decoded rows of one chunk; its level grows by an order with each settled answer."""

    def __init__(self, group: pa.Table, n_shards: int, total: int, n_docs: int, unigrams: Unigrams, discounts: list[Discounts]):
        answers: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        stream = None
        for shard, kind, blob in zip(*(group.column(c).to_pylist() for c in NAMES[1:]), strict=True):
            if kind == STREAM:
                stream = unpack(blob)
            else:
                answers[kind].append((shard, blob))
        self.chunk, self.n_shards, self.total = group.column("chunk")[0].as_py(), n_shards, total
        got = [unpack(b) for _, b in sorted(answers[WORD_ANSWER])]
        ids, found = np.concatenate([g[0] for g in got]).astype(U), np.concatenate([g[1] for g in got]).astype(np.int64)
        stream, sizes, self.learn, doc_ids, self.known = stream
        self.sizes, self.doc_ids = sizes.astype(np.int64), doc_ids.astype(U).view(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(stream)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        self.trained = np.repeat(self.learn, self.sizes)
        self.words, self.order = stream.astype(np.int32), 1
        # the last word is the start
        self.ids, counts = np.append(ids, U(START)), np.append(found >> 1, n_docs)
        self.count, p = counts[self.words], unigrams.of(counts)
        self.below = Level(self.words, self.ids, counts, np.append(found & 1, 1) > 0, p, np.ones(len(counts), np.int64))
        self.p = p[self.words]
        for order, d in enumerate(discounts, 2):
            self.extend()
            self.settle(d, sorted(answers[ANSWER + order]))

    def extend(self) -> None:
        """The n-grams of the next order, and what is asked of which shard for them."""
        below, n_words = self.below, len(self.ids)
        at = np.flatnonzero(self.place >= self.order - 1)
        heads = below.inverse[at - 1].astype(np.int64)
        if self.order == 1:
            heads[self.first] = n_words - 1
        heads *= n_words
        code, where, inverse = np.unique(heads + self.words[at], return_index=True, return_inverse=True)
        self.inverse = np.full(len(self.words), -1, np.int32)
        self.inverse[at] = inverse
        self.head, tail = code // n_words, code % n_words
        del code, heads
        self.lower = below.inverse[at[where]]
        self.tail = self.ids[tail]
        with np.errstate(over="ignore"):
            self.key = mix(below.key[self.head] * NEXT + self.tail)
        self.own = np.bincount(inverse, self.trained[at], len(where)).astype(np.int64)
        # an n-gram can only be seen if its context and its lower n-gram are
        known = below.count[self.head] > 0
        can, shared = known & (below.count[self.lower] > 0), below.shared[self.head]
        self.private = np.flatnonzero(can & ~shared)
        asked, sample = np.unique(self.head[known & shared], return_index=True)
        sample = np.flatnonzero(known & shared)[sample]
        by_key = np.argsort(below.key[asked], kind="stable")
        asked, sample = asked[by_key], sample[by_key]
        rank = np.zeros(len(below.key), np.int64)
        rank[asked] = np.arange(len(asked))
        # salts of contexts above a quarter of a shard's share
        salts = np.maximum(1, below.count[asked] * 4 * self.n_shards // max(1, self.total))
        entry = np.repeat(np.arange(len(asked)), salts)
        salt = np.arange(len(entry)) - np.repeat(np.cumsum(salts) - salts, salts)
        keys = np.flatnonzero(can & shared)
        of = rank[self.head[keys]]
        own_salt = (mix(self.tail[keys] + U(77)) % salts[of].astype(U)).astype(np.int64)

        def place(which: np.ndarray, salted: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                to = shard_of(below.key[asked[which]] * U(0x9E3779B1) + salted.astype(U), self.n_shards)
            return to * max(1, len(asked)) + which

        entries = np.unique(place(entry, salt))
        owner = np.searchsorted(entries, place(of, own_salt))
        self.keys = keys[np.argsort(owner, kind="stable")]
        self.numbers = np.bincount(owner, minlength=len(entries))
        self.entries, to = asked[entries % max(1, len(asked))], entries // max(1, len(asked))
        self.sample = sample[entries % max(1, len(asked))]
        self.entry_cut = np.searchsorted(to, np.arange(self.n_shards + 1))
        self.key_cut = np.append(0, np.cumsum(self.numbers))[self.entry_cut]

    def requests(self) -> pa.Table:
        self.extend()
        below, out = self.below, []
        for s in range(self.n_shards):
            (a, b), (i, j) = self.entry_cut[s : s + 2], self.key_cut[s : s + 2]
            if a < b:
                k = self.keys[i:j]
                scale = below.scale[self.lower[self.sample[a:b]]]
                out.append((self.chunk, s, WORDS, pack(*(x.astype(U) for x in (deltas(below.key[self.entries[a:b]]), self.numbers[a:b], scale, self.tail[k], self.own[k], below.count[self.lower[k]])))))
        mine = self.own[self.private]
        out.append((self.chunk, self.chunk % self.n_shards, STATS, pack(histogram(mine[mine > 0]).astype(U))))
        return rows(*out)

    def settle(self, d: Discounts, answers: list[tuple[int, bytes]]) -> None:
        """The level's counts and probabilities, from the answers and from contexts no other chunk has."""
        below = self.below
        count, shared, n = np.zeros(len(self.key), np.int64), np.zeros(len(self.key), bool), len(below.key)
        mine, weights = self.own[self.private], np.arange(K + 1) * (1 - np.append(1, d.d[1:]))
        count[self.private] = mine
        owner, lower = self.head[self.private], below.p[self.lower[self.private]]
        # spare tokens of each context, and what its seen words have one order below
        spare = np.bincount(owner, weights[np.where(mine <= K, mine, 0)], n).astype(float)
        mass = np.bincount(owner, np.where(mine > 0, lower, 0.0), n).astype(float)
        for shard, blob in answers:
            found, more, weight = unpack(blob)
            k, h = self.keys[self.key_cut[shard] : self.key_cut[shard + 1]], self.entries[self.entry_cut[shard] : self.entry_cut[shard + 1]]
            count[k], shared[k] = found.astype(np.int64) >> 1, found & 1
            spare[h] += weights[1:] @ more.reshape(K, len(h)).astype(float)
            mass[h] += weight
        # a context that spares none counts one more
        none = spare <= 1e-9
        scale = np.maximum(below.count, 1) + none
        alpha = np.where(below.count > 0, np.where(none, 1.0, spare) / scale / np.maximum(1 - mass, 1e-12), 1.0)
        p = np.where(count > 0, d.of(count) * count / scale[self.head], alpha[self.head] * below.p[self.lower])
        has = self.inverse >= 0
        self.p[has] = p[self.inverse[has]]
        self.below, self.order = Level(self.inverse, self.key, count, shared, p, scale[self.head]), self.order + 1

    def scores(self) -> tuple[np.ndarray, ...]:
        """For each document: tokens, known tokens, back-off sum."""
        doc, n = np.repeat(np.arange(len(self.sizes)), self.sizes), len(self.sizes)
        return self.sizes, np.bincount(doc, self.count > 0, n), np.bincount(doc, np.log10(np.maximum(self.p, 1e-300)), n)


def count_grams(group: pa.Table, order: int, unigrams: Unigrams, below: Discounts | None) -> pa.Table:
    """One shard of n-grams: counts for each chunk in its order, and what each context's alpha needs."""
    shard = group.column("shard")[0].as_py()
    asked, private = [], np.zeros(K + 1, np.int64)
    for chunk, kind, blob in zip(*(group.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True):
        if kind == STATS:
            private += unpack(blob)[0].astype(np.int64)
        else:
            asked.append((chunk, unpack(blob)))
    if not asked:
        return rows((-1, shard, STATS, pack(private.astype(U))))
    heads, first, which = np.unique(np.concatenate([sums(p[0]) for _, p in asked]), return_index=True, return_inverse=True)
    scale = np.concatenate([p[2] for _, p in asked])[first].astype(float)
    n_keys = np.concatenate([p[1] for _, p in asked]).astype(np.int64)
    owner = np.repeat(which, n_keys)
    tail = np.concatenate([p[3] for _, p in asked]).astype(U)
    if len(tail) and (int(tail.max()) + 1) * len(heads) >= 1 << 63:
        tail = np.unique(tail, return_inverse=True)[1].astype(U)
    width = int(tail.max()) + 1 if len(tail) else 1
    unique, at, inverse = np.unique(owner * width + tail.astype(np.int64), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[4] for _, p in asked]), len(unique)).astype(np.int64)
    several = np.bincount(inverse, minlength=len(unique)) > 1
    count = np.concatenate([p[5] for _, p in asked])[at].astype(np.int64)
    owner = unique // width
    lower = unigrams.of(count) if order == 2 else below.of(count) * count / scale[owner]
    n = len(heads)
    numbers = np.bincount(owner * (K + 1) + np.where(total <= K, total, 0), minlength=n * (K + 1)).reshape(n, K + 1)[:, 1:]
    mass = np.bincount(owner, np.where(total > 0, lower, 0.0), n).astype(float)
    out, i, j = [], 0, 0
    answer = (total * 2 + several).astype(U)
    for chunk, p in asked:
        h, k = which[i : i + len(p[0])], inverse[j : j + len(p[3])]
        out.append((chunk, shard, ANSWER + order, pack(answer[k], numbers[h].T.astype(U).ravel(), mass[h])))
        i, j = i + len(h), j + len(k)
    out.append((-1, shard, STATS, pack((private + histogram(total[total > 0])).astype(U))))
    return rows(*out)


def stats_of(table: DataFrame) -> list[np.ndarray]:
    """A fixed number of counts from each shard."""
    return [unpack(bytes(r[0])).pop().astype(np.int64) for r in table.filter(F.col("kind") == STATS).select("blob").collect()]


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score by n-grams of `order` words. docs: doc_id, text, learn."""
    spark = docs.sparkSession
    tables, n_shards = Tables(spark, "katz"), shards(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("learn", F.lit(True)).alias("learn"))
    encoded = tables.write(encode(docs, n_shards))
    stream = encoded.filter(F.col("kind") == STREAM)
    words_ = tables.write(encoded.filter(F.col("kind") == WORDS).groupBy("shard").applyInArrow(lean_group(lambda g: count_words(g, n_shards)), BLOBS))
    stats = stats_of(words_)
    sums_ = np.sum(stats, axis=0) if stats else np.zeros(K + 3, np.int64)
    total, vocabulary = int(sums_[0]), int(sums_[1])
    unigrams = Unigrams(total, sums_[2:].tolist())
    n_docs = docs.filter("learn").count()
    known = stream.unionByName(words_.filter(F.col("kind") == WORD_ANSWER))

    def ask(discounts: list[Discounts]):
        return lean_group(lambda g: Chunk(g, n_shards, total, n_docs, unigrams, discounts).requests())

    def answer(k: int, below: Discounts | None):
        return lean_group(lambda g: count_grams(g, k, unigrams, below))

    discounts: list[Discounts] = []
    for k in range(2, order + 1):
        asked = known.groupBy("chunk").applyInArrow(ask(list(discounts)), BLOBS)
        counted = tables.write(asked.groupBy("shard").applyInArrow(answer(k, discounts[-1] if discounts else None), BLOBS))
        stats = stats_of(counted)
        discounts.append(Discounts(np.sum(stats, axis=0).tolist() if stats else [0] * (K + 1)))
        known = known.unionByName(counted.filter(F.col("kind") == ANSWER + k))
        tables.sweep()

    def finish(group: pa.Table) -> pa.Table:
        own = Chunk(group, n_shards, total, n_docs, unigrams, discounts)
        sizes, n_known, logs = own.scores()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((own.count + 0.5) / (total + 0.5 * (vocabulary + 1)))
        base = np.bincount(doc, base, len(sizes))
        n = len(sizes)
        return pa.Table.from_arrays([pa.array(own.doc_ids, mask=own.known == 0), pa.array(own.learn == 0), pa.array(sizes), pa.array(n_known.astype(np.int64)), pa.array(np.full(n, total)), pa.array(base), pa.array(logs)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return known.groupBy("chunk").applyInArrow(lean_group(finish), SCHEMA)
