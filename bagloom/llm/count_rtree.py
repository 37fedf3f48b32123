"""N-gram Jaccard join: sets of word shingles, candidates by an R-tree over group counts.

A document's set holds the 64-bit hashes of its distinct shingles of `size` words (of its
whole word sequence if it has fewer). Two documents link if their Jaccard likeness is
num / den or more; components of links are returned. Equal sets are found by a digest
first, and one row represents the others, so copies add no work.

Points. A set becomes a point twice: as its counts in a number of groups of hashes that
grows with its size (points of two widths meet over the fewer groups), and as its counts in 2^64 groups, of which all but some coordinates are 0. The overlap of two sets is
at most the sum of the coordinates' minima, and below a node of the tree at most the sum of
minima with the node's upper corner.

The tree. Leaves are packed by size (bands of a factor of den / num) and by a coordinate:
of a set's four least hashes the one that most sets of its band have among their four, up
to what a leaf holds, so near copies share leaves. A leaf above `limit` shingles is split. Corners of leaves are
rows (coordinate, leaf). A set x can have a smaller partner y below a leaf only if the sum
of minima with the corner reaches num / (num + den) of both sizes, so among the
n - ceil(num n / den) + 1 coordinates of x that come first in any fixed order there is one
that the corner has from the first n - ceil(2 num n / (num + den)) + 1 of one of its
members. That is an equi-join of coordinates, which neither misses a leaf nor visits those
whose bound can't suffice, in place of a descent from one root: over dense groups the upper
corners of any sixteen texts of some hundred shingles already admit nearly every query of
that size (README has the figures). The order puts coordinates that a sample of texts holds
often last, so passages that many texts share route few of them; the coordinates that the
order knows are bounded, and only the speed depends on them.

A leaf with its queries (in parts of bounded size) is one R-tree over the dense points,
which drops the queries and members without a pair in reach. Texts are fetched for the
rest, the tree is searched again, and pairs are verified by exact intersection, each pair
once: y below x by (size, row). Where numbers of links are asked for, all pairs that the
bound leaves are verified and count as many documents as have the sets; else pairs already
connected are left out. No pair is written but the spanning links.

Links found become edges, whose components (large-star and small-star steps on tables,
nothing on the driver) end in the smallest doc_id.

Defined results: null texts and texts without words have an empty set, n_shingles 0 and
link with nothing. Repeated rows are copies. A null doc_id is never the smallest one
unless its component has no other. Extra columns are kept where rows are returned and
ignored elsewhere, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagloom.llm.common import LOWER, U, Tables, hash_spans, lean, mix, padded, slices, utf8, words

#: bytes of text at once; shingles of a leaf and of its queries in one task; least groups of a dense point, most hashes in one on average
CHUNK, LIMIT, WIDTH, FILL = 5 << 20, 2_000_000, 16, 8
#: of so many texts one has its coordinates counted for the order, and how many coordinates that leaves at most
SAMPLE, COMMON = 8, 1 << 18
#: least hashes by which a set may find its leaf; rows that may be broadcast
LEAST, BROADCAST = 4, 2_000_000


# ---- sets and points -----------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, sorted within texts; offsets by text)."""
    starts, ends, counts = words(data, offsets)
    h = hash_spans(padded(LOWER[data]), starts, ends - starts)
    n_docs = len(counts)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(n_docs), counts)
    place = np.arange(len(h)) - first[doc]
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h)), U)
        for k in range(size):
            at = np.minimum(np.arange(len(h)) + k, max(0, len(h) - 1))
            grams = mix(grams * U(0x9E3779B97F4A7C15) + h[at] + U(k))
        keep = place + size <= counts[doc]
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = []
        for i in short.tolist():
            x = U(len(h[first[i] : first[i] + counts[i]]))
            for y in h[first[i] : first[i] + counts[i]]:
                x = mix(np.array([x * U(0xD1342543DE82EF95) + y], U))[0]
            whole.append(x)
    grams = np.concatenate([grams[keep], np.array(whole, U)])
    doc = np.concatenate([doc[keep], short])
    order = np.argsort(grams)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(n_docs + 1))


def band_edges(top: int, num: int, den: int) -> np.ndarray:
    """Lower ends of the bands of set sizes: a set can link into its own band and the next only."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def query_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Coordinates of a set of size n that it looks for in corners."""
    return n + (-num * n // den) + 1


def ordered(sets: np.ndarray, bounds: np.ndarray, common: tuple[np.ndarray, np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, offsets): the first `length` of each set, those that `common` holds often last."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    often = np.zeros(len(sets), U)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], sets), len(common[0]) - 1)
        often = np.where(common[0][at] == sets, common[1][at], U(0)).astype(U)
    order = np.argsort((np.minimum(often, U(0xFFFF)) << U(48)) | (mix(sets) >> U(16)), kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    place = np.arange(len(sets)) - np.repeat(bounds[:-1], n)
    length = np.minimum(length, n)
    return sets[order][place < np.repeat(length, n)], np.append(0, np.cumsum(length))


#: no order but the hashes
NOTHING = (np.zeros(0, U), np.zeros(0, U))


def width_of(n: int) -> int:
    """Groups of a set of size n: a power of two that leaves FILL hashes a group at most, for in fuller ones all sets look alike."""
    return max(WIDTH, 1 << (-(-n // FILL) - 1).bit_length())


def point_of(one: np.ndarray, width: int) -> np.ndarray:
    """A set's counts in groups of hashes."""
    return np.bincount((one >> U(20) & U(width - 1)).astype(np.int64), minlength=width).astype(np.int32)


def point_bytes(one: np.ndarray) -> bytes:
    p = point_of(one, width_of(len(one)))
    return p.astype(np.uint8 if p.max() < 256 else "<u4").tobytes()


def points_from(blobs: list[bytes], n: list[int]) -> np.ndarray:
    """Points over the fewest groups that any of them has; wider ones are folded."""
    width = min(map(width_of, n))
    out = np.empty((len(n), width), np.int32)
    for k, (blob, size) in enumerate(zip(blobs, n, strict=True)):
        own = width_of(size)
        p = np.frombuffer(blob, np.uint8 if len(blob) == own else "<u4")
        out[k] = p if own == width else p.reshape(-1, width).sum(axis=0, dtype=np.int32)
    return out


def digest(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def common_coordinates(docs: DataFrame, size: int, sample: int, at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of texts) of shingles that one in `sample` distinct texts, chosen by hash, hold twice or more."""
    some = docs.select("text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(0), CHUNK):
                sets, _ = shingle_sets(*utf8(batch.column(0).slice(i, j - i)), size)
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64))], names=["h"])

    found = some.mapInArrow(lean(run), "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(at_most).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(U)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(np.int64).astype(U)[order]


# ---- tables --------------------------------------------------------------------------

SET = T.StructType([T.StructField("ref", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("point", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType()))])
SET_ARROW = pa.struct([("ref", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("band", pa.int32()), ("point", pa.binary()), ("first", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def fresh(taken: list[str]) -> str:
    """A column name that none of those taken resembles."""
    name = "__set"
    while name in {t.lower() for t in taken}:
        name += "_"
    return name


def with_sets(docs: DataFrame, name: str, size: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with a column of that name: row, size, digest, band, dense point and first coordinates of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            for i, j in slices(batch.column("text"), CHUNK):
                part = batch.slice(i, j - i)
                sets, bounds = shingle_sets(*utf8(part.column("text")), size)
                n, b = np.diff(bounds), bounds.tolist()
                marks = [digest(sets[b[k] : b[k + 1]]) for k in range(len(n))]
                new = np.array([n[k] > 0 and marks[k] not in seen and not seen.add(marks[k]) for k in range(len(n))], bool)  # a task's first copy only
                length = np.where(new, query_length(n, num, den), 0)
                first, upto = ordered(sets, bounds, common, length)
                low, low_upto = ordered(sets, bounds, NOTHING, np.where(new, LEAST, 0))
                edges = band_edges(int(n.max()), num, den)
                keys = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                arrays = [
                    pa.array(ref + np.arange(len(n))),
                    pa.array(n),
                    *(pa.array(keys[:, k], mask=n == 0) for k in (0, 1)),
                    pa.array((np.searchsorted(edges, n, "right") - 1).astype(np.int32)),
                    pa.array([point_bytes(sets[b[k] : b[k + 1]]) if new[k] else None for k in range(len(n))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(first.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(low_upto.astype(np.int32)), pa.array(low.view(np.int64))),
                ]
                ref += len(n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(arrays, fields=list(SET_ARROW))], names=[*part.schema.names, name])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(name, SET)]))


def by_key(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups of the first two columns, which the rows are sorted by; about `at_once` rows, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        turn = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        if held:
            last = held[-1]
            if (last.column(0)[-1], last.column(1)[-1]) != (batch.column(0)[0], batch.column(1)[0]):
                turn = np.append(0, turn)
        if len(turn) and sum(h.num_rows for h in held) + batch.num_rows >= at_once:
            cut = int(turn[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def groups(table: pa.Table) -> list[tuple[int, int]]:
    a, b = (table.column(k).to_numpy() for k in (0, 1))
    turn = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    return list(zip([0, *turn.tolist()], [*turn.tolist(), len(a)], strict=True))


def in_leaves(rows: DataFrame, run, schema: str) -> DataFrame:
    """run over whole groups (leaf, part): members (side 0), members that are queries (1), other queries (2)."""
    return rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "side", "n", "ref").mapInArrow(lean(run), schema)


# ---- R-tree --------------------------------------------------------------------------


class RTree:
    """Points in boxes, packed by size and then by coordinates; each level holds the upper corners and least sizes of its nodes."""

    def __init__(self, points: np.ndarray, size: np.ndarray, fan: int = 16):
        order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], size * 20 // max(1, int(size.max()))))
        self.order, self.fan = order, fan
        self.levels = [(points[order], size[order])]
        while len(self.levels[-1][0]) > fan:
            corner, least = self.levels[-1]
            at = np.arange(0, len(corner), fan)
            self.levels.append((np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at)))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the given order, bounds) of the points whose overlap with `point` may suffice."""
        found = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[level]
            bound = np.minimum(corner[found], point).sum(axis=1, dtype=np.int64)
            ok = bound * (num + den) >= num * (size + least[found])
            found, bound = found[ok], bound[ok]
            if level:
                found = (found[:, None] * self.fan + np.arange(self.fan)).ravel()
                found = found[found < len(self.levels[level - 1][0])]
        return self.order[found], bound


def linked(one: np.ndarray, sets: list[np.ndarray], near: np.ndarray, num: int, den: int, at_once: int = 1 << 20) -> np.ndarray:
    """Those of the sets at `near` whose likeness with `one` suffices; some at once, of `at_once` members in all."""
    size = np.array([len(sets[p]) for p in near.tolist()], np.int64)
    upto = np.cumsum(size)
    ok, i = np.zeros(len(near), bool), 0
    while i < len(near):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + at_once, "right")))
        joined = np.concatenate([sets[p] for p in near[i:j].tolist()])
        hit = np.append(0, np.cumsum(one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined))
        ends = upto[i:j] - (upto[i] - size[i])
        both = hit[ends] - hit[ends - size[i:j]]
        ok[i:j] = both * den >= num * (len(one) + size[i:j] - both)
        i = j
    return near[ok]


def reachable(table: pa.Table, num: int, den: int) -> np.ndarray:
    """Which rows of a table (leaf, part, side, n, ref, point) have a pair in their group that the bound leaves."""
    side, n, ref = (table.column(c).to_numpy() for c in ("side", "n", "ref"))
    blobs = table.column("point")
    keep = np.zeros(table.num_rows, bool)
    for i, j in groups(table):
        asks, m = (i + int(np.searchsorted(side[i:j], k)) for k in (1, 2))
        if m == i or asks == j:
            continue
        points = points_from(blobs.slice(i, j - i).to_pylist(), n[i:j].tolist())
        tree = RTree(points[: m - i], n[i:m])
        for q in range(asks, j):
            near = i + tree.search(points[q - i], int(n[q]), num, den)[0]
            near = near[(n[near] < n[q]) | ((n[near] == n[q]) & (ref[near] < ref[q]))]
            keep[near] = True
            keep[q] |= len(near) > 0
    return keep


def links_of(table: pa.Table, size: int, num: int, den: int, every: bool) -> pa.RecordBatch:
    """(a, b, links) of a table (leaf, part, side, n, ref, copies, text): spanning links, and with `every` (a, null, documents a's set links with)."""
    side, n, ref, copies = (table.column(c).to_numpy() for c in ("side", "n", "ref", "copies"))
    out_a, out_b, out_n = [], [], []
    for i, j in groups(table):
        asks, m = (i + int(np.searchsorted(side[i:j], k)) for k in (1, 2))
        if m == i or asks == j:
            continue
        text = table.column("text").slice(i, j - i)
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        sets, at = [], 0
        for x, y in slices(text, CHUNK):
            found, cut = shingle_sets(*utf8(text.slice(x, y - x)), size)
            at += y - x
            sets += np.split(found, cut[1:-1])
        own = n[i:j]
        width = width_of(int(own.min()))
        points = np.stack([point_of(s, width) for s in sets])
        tree = RTree(points[: m - i], own[: m - i])
        who, index = np.unique(ref[i:j], return_inverse=True)
        label, partners, same = np.arange(len(who)), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        same[index] = copies[i:j]

        def connect(a: int, b: int) -> None:
            if label[a] != label[b]:
                out_a.append(who[a])
                out_b.append(who[b])
                out_n.append(None)
                label[label == label[b]] = label[a]

        for q in range(asks - i, j - i):
            near, bound = tree.search(points[q], int(own[q]), num, den)
            ok = (own[near] < own[q]) | ((own[near] == own[q]) & (who[index[near]] < who[index[q]]))
            near, bound = near[ok], bound[ok]
            if every:
                near = linked(sets[q], sets, near, num, den)
                partners[index[q]] += same[index[near]].sum()
                partners[index[near]] += same[index[q]]
                for p in near.tolist():
                    connect(index[q], index[p])
                continue
            near = near[np.argsort(-bound, kind="stable")]
            while len(near := near[label[index[near]] != label[index[q]]]):
                # the likeliest first, until one links
                for at, p in enumerate(near.tolist(), 1):
                    a, b = sets[q], sets[p]
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    if both * den >= num * (len(a) + len(b) - both):
                        connect(index[q], index[p])
                        break
                near = near[at:]
        some = np.flatnonzero(partners)
        out_a += who[some].tolist()
        out_b += [None] * len(some)
        out_n += partners[some].tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b, out_n)], names=["a", "b", "links"])


# ---- the join ------------------------------------------------------------------------


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(a, b): the smallest member b of the component of each a that isn't it; by alternating large and small stars."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(both: DataFrame, large: bool) -> DataFrame:
        # written, so that adaptive execution can split the join of a hub's rows
        least = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        met = both.join(least, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()

    now = tables.write(edges.filter("a <> b"))
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = tables.write(star(both, True))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = tables.write(star(down, False))
        after = state(small)
        tables.drop(now)
        tables.drop(large)
        now = small
        if after == before:
            break
        before = after
    return now


def typed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))


def bounded(table: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has so few rows."""
    return F.broadcast(table) if table.count() <= rows else table


def parts_of(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """How many parts of about `limit` shingles each key's rows make."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).filter(f"c > 1 or w > {limit}").select(*keys, F.ceil(F.col("w") / limit).cast("int").alias("parts"), (F.col("c") > 1).alias("many"))


def solve(docs: DataFrame, name: str, size: int, num: int, den: int, limit: int, every: bool = False, sample: int = SAMPLE, at_most: int = COMMON) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs with sets, classes of equal sets, ref / least / least_id / links of the representatives that link)."""
    tables = Tables(docs.sparkSession, "rtree")
    whole = tables.write(with_sets(docs, name, size, num, den, common_coordinates(docs, size, sample, at_most)))
    sets = whole.select(f"{name}.*", F.col("doc_id").alias("id")).filter("n > 0")
    # a class's representative is the row of its smallest id; its point and coordinates are those of the first copy
    classes = tables.write(sets.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ref")).alias("least"), F.min(F.when(F.col("point").isNotNull(), F.col("ref"))).alias("ref"), F.count(F.lit(1)).alias("copies")))
    reps = sets.drop("k1", "k2", "id").join(bounded(classes.select("ref")), "ref", "leftsemi")
    # each set's leaf
    low = reps.select("ref", "n", "band", F.explode("low").alias("key"))
    kept = F.col("w") <= limit
    popular = low.groupBy("key", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).filter("c > 1")
    choice = low.join(popular, ["key", "band"], "left").withColumn("c", F.coalesce("c", F.lit(1))).groupBy("ref", "n", "band").agg(F.max(F.struct(F.coalesce(kept, F.lit(True)).alias("kept"), "c", "key")).alias("best"))
    choice = tables.write(choice.select("ref", "n", "band", F.col("best.key").alias("key")))
    sizes = tables.write(parts_of(choice, ["key", "band"], limit))
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("ref"), F.col("parts"))).otherwise(0)
    # the leaf's band is its last byte
    leaf = F.xxhash64("key", salt).bitwiseAND(F.lit(~255)).bitwiseOR(F.col("band").cast("long"))
    leaves = tables.write(choice.join(bounded(sizes), ["key", "band"], "left").select("ref", leaf.alias("leaf"), F.coalesce("many", F.lit(False)).alias("many")))
    placed = reps.join(bounded(leaves), "ref")
    if leaves.count() > BROADCAST:  # read more than once
        placed = tables.write(placed)

    index = F.expr(f"cast(n - ((n * {2 * num} + {num + den - 1}) div {num + den}) + 1 as int)")
    asked = placed.select("ref", "leaf", F.explode("first").alias("at"))
    single, shared = (placed.filter(F.col("many") == x).select(F.col("leaf").alias("to"), F.explode(F.slice("first", F.lit(1), index)).alias("at")) for x in (False, True))
    near = (F.col("leaf").bitwiseAND(F.lit(255)) - F.col("to").bitwiseAND(F.lit(255))).between(0, 1)
    met = asked.join(single.unionByName(shared.distinct()), "at").filter((F.col("leaf") != F.col("to")) & near).select("ref", "to").distinct()
    routes = tables.write(met.withColumnRenamed("to", "leaf"))
    points = placed.select("ref", "n", "point")
    queries = tables.write(routes.join(points, "ref"))
    own = placed.filter("many").select("leaf", "n")
    load = tables.write(parts_of(queries.select("leaf", "n").unionByName(own), ["leaf"], limit))
    parts = F.coalesce("parts", F.lit(1))
    # leaves that anything asks: those of several sets, and those that a route leads to
    asked_of = tables.write(queries.select("leaf").unionByName(own.select("leaf")).distinct())
    part = F.pmod(F.xxhash64("ref"), parts).cast("int")
    members = placed.join(bounded(asked_of), "leaf", "leftsemi").join(bounded(load.drop("many")), "leaf", "left").withColumn("own", part).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("many") & (F.col("own") == F.col("part")), 1).otherwise(0)
    queries_in = queries.join(bounded(load.drop("many")), "leaf", "left").withColumn("part", part)
    rows = members.select("leaf", "part", side.alias("side"), "n", "ref", "point").unionByName(queries_in.select("leaf", "part", F.lit(2).alias("side"), "n", "ref", "point"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches):
            yield from table.filter(pa.array(reachable(table, num, den))).drop_columns(["point"]).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, 1 << 11):
            yield links_of(table, size, num, den, every)

    left = tables.write(in_leaves(rows, prune, "leaf long, part int, side int, n long, ref long"))
    tables.drop(queries)
    counted = tables.write(left.join(classes.select("ref", "copies"), "ref"))
    texts = whole.select(F.col(f"{name}.ref").alias("ref"), "text").join(bounded(counted), "ref")
    links = tables.write(in_leaves(texts.select("leaf", "part", "side", "n", "ref", "copies", "text"), verify, "a long, b long, links long"))
    partners = links.filter("b is null").groupBy(F.col("a").alias("ref")).agg(F.sum("links").alias("links"))
    found = components(links.filter("b is not null").select("a", "b").distinct(), tables)
    member = found.unionByName(found.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "ref")
    named = member.join(classes, "ref")
    ends = named.groupBy("b").agg(F.min("least.id").alias("least_id"), F.min("least").alias("end"))
    component = member.join(ends, "b").select("ref", "least_id", F.col("end.ref").alias("end"))
    return whole, classes, component.join(partners, "ref", "left") if every else component


def join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, limit: int = LIMIT, links: bool = False, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_shingles, component_id for docs (doc_id, text): components of likeness num / den or more; with `links` also n_links, the other documents of that likeness."""
    docs = typed(docs).select("doc_id", "text")
    whole, classes, component = solve(docs, "__set", size, num, den, limit, links, sample)
    known = classes.join(component, "ref", "left").select("k1", "k2", F.coalesce("least_id", "least.id").alias("component_id"), *([(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")] if links else []))
    out = whole.select("doc_id", F.col("__set.n").alias("n_shingles"), F.col("__set.k1").alias("k1"), F.col("__set.k2").alias("k2")).join(known, ["k1", "k2"], "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component_id, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, limit: int = LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, but one only of each component: the one with the smallest doc_id."""
    name = fresh(docs.columns)
    whole, classes, component = solve(typed(docs), name, size, num, den, limit)
    keep = Tables(docs.sparkSession, "rtree").write(classes.join(component, "ref", "left").select(F.coalesce("end", "least.ref").alias("kept")).distinct())
    some = whole.filter(F.col(f"{name}.n") > 0).join(bounded(keep), F.col(f"{name}.ref") == F.col("kept"), "leftsemi")
    return whole.filter(F.col(f"{name}.n") == 0).unionByName(some).drop(name)
