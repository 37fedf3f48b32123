"""Mixing sources to target weights by pivotal dependent rounding.

Targets: weights share ratio * (all words); a target stops at twice its source's size and
the excess is shared again by weight until none is above. That is target = min(2 size,
t * weight) for one level t, found by adding up the capped and the open sources once a
round (a source once capped stays capped), so no list of sources reaches the driver.

Copies: every document of a source expects x = target / source size copies (0 to 2). The
whole part is taken as it is; the fraction p is rounded by pairs. A pair (a, b) with sizes
s_a, s_b moves mass m in words, p_a += m / s_a, p_b -= m / s_b, as far up or down as one of
them becomes 0 or 1, with odds that keep both expectations. Each step settles one of two
documents and keeps the source's expected words exactly; the survivors meet again in a
tree: within blocks of a source first, then the blocks' single survivors, level by level.
Pairs are neighbours by size, so little mass moves. The last survivor of a source is
rounded by itself, so a source misses its target by less than one document's size.

Defined results: null or blank texts have size 0 and are taken 0 times. A source of null
is one source and the last. Repeated rows and repeated ids are rounded each on its own
(equal rows may then differ in `taken`). The draws hash the seed and the block, blocks
follow a hash of the whole row (so rows of one id are spread), and rows are put in order by
size, id and that hash first, so reruns agree whatever the partitions. Rows that are equal
in all columns meet in one block. Extra columns take part in the hash where whole rows are
returned and are ignored elsewhere. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagloom.llm.common import Tables, lean, lean_group, slices, utf8, words

WEIGHTS, RATIO, CAP, BLOCK = (5.0, 2.0, 1.0), 1.5, 2.0, 2048
#: rows of two numbers that may be broadcast
BROADCAST = 2_000_000


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and size: the number of words."""
    kept = [c for c in docs.columns if c != text]
    source = docs.select(*kept, F.col(text).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(len(kept)), 8 << 20):
                part = whole.slice(i, j - i)
                n = words(*utf8(part.column(len(kept))))[2]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n, pa.int64())], names=[*kept, "size"])

    schema = source.select(*kept).schema.add("size", "long")
    return source.mapInArrow(lean(count), schema)


def targets(sized: DataFrame, ratio: float = RATIO, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target: one row per source."""
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # a source's weight follows its place in the order, which is counted range by range
    ranged = Tables(spark, "sources").write(per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")))
    # one row per range here
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = Tables(spark, "weights").write(ranged.join(before, "part").select("source", "source_size", "n_docs", weight.alias("weight")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the capped set only grows; it settles after a few rounds
        over = F.col("weight") * level >= cap * F.col("source_size")
        shut, open_weight, n = per.agg(F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
        if not open_weight or n == full:
            break
        level, full = (ratio * total - shut) / open_weight, n
    out = per.select("source", "source_size", "n_docs", F.least(cap * F.col("source_size"), level * F.col("weight") if level else F.lit(0.0)).alias("target"))
    return out if total else out.withColumn("target", F.lit(0.0))


def pair_down(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds p in place until one fraction is left, which is returned (-1: none). Neighbours meet first."""
    live = np.flatnonzero((p > 0) & (p < 1))
    while len(live) > 1:
        n = len(live) // 2 * 2
        a, b = live[:n:2], live[1:n:2]
        wa, wb = size[a], size[b]
        up = np.minimum((1 - p[a]) * wa, p[b] * wb)
        down = np.minimum(p[a] * wa, (1 - p[b]) * wb)
        rise = rng.random(len(a)) < down / (up + down)
        pa_, pb_ = p[a], p[b]
        first_up, first_down = (1 - pa_) * wa <= pb_ * wb, pa_ * wa <= (1 - pb_) * wb
        p[a] = np.where(rise, np.where(first_up, 1.0, pa_ + up / wa), np.where(first_down, 0.0, pa_ - down / wa))
        p[b] = np.where(rise, np.where(first_up, pb_ - up / wb, 0.0), np.where(first_down, pb_ + down / wb, 1.0))
        p[:] = np.where(np.abs(p - np.rint(p)) < 1e-12, np.rint(p), p)
        live = live[(p[live] > 0) & (p[live] < 1)]
    return int(live[0]) if len(live) else -1


def pivotal_copies(sized: DataFrame, wanted: DataFrame, seed: int = 0, block: int = BLOCK, fan_in: int = 4096) -> DataFrame:
    """Rows of sized (doc_id, source, size, ...; __tie, a hash of the row) with source_size, target, copies and taken."""
    tables = Tables(sized.sparkSession, "mix")
    keys = [c for c in sized.columns if c not in ("size", "__tie")]
    # blocks deal out a large source; they follow the rows alone, so a rerun makes the same ones
    sized = sized if "__tie" in sized.columns else sized.withColumn("__tie", F.xxhash64(*keys))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    spread = sized.join(wanted.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    spread = spread.withColumn("__block", F.pmod(F.xxhash64("doc_id", "__tie", F.lit(seed)), parts)).withColumn("__expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    spread = spread.withColumn("copies", F.when(F.col("size") > 0, F.floor("__expected")).otherwise(0).cast("long"))
    spread = spread.withColumn("__p", F.when(F.col("size") > 0, F.col("__expected") - F.floor("__expected")).otherwise(0.0)).drop("__expected").withColumn("__open", F.lit(True))
    schema = spread.schema
    names = schema.names

    def settle(last: bool):
        def run(group: pa.Table) -> pa.Table:
            order = [("size", "ascending"), ("doc_id", "ascending"), ("__tie", "ascending")]
            group = group.sort_by(order)
            p, size = group.column("__p").to_numpy().copy(), group.column("size").to_numpy().astype(float)
            name = f"{seed}|{group.column('source')[0].as_py()}|{group.column('__block')[0].as_py()}|{last}"
            import zlib

            rng = np.random.default_rng(zlib.crc32(name.encode()))
            keep = pair_down(p, size, rng)
            if last and keep >= 0:
                p[keep], keep = float(rng.random() < p[keep]), -1
            copies = group.column("copies").to_numpy() + (p >= 1)
            p = np.where(p >= 1, 0.0, p)
            still = np.zeros(len(p), bool)
            if keep >= 0:
                still[keep] = True
            for c, v in (("copies", pa.array(copies, pa.int64())), ("__p", pa.array(p)), ("__open", pa.array(still))):
                group = group.set_column(names.index(c), c, v)
            return group

        return run

    done, current = [], spread
    largest = wanted.agg(F.max("n_docs")).first()[0] or 0
    blocks = max(1, -(-largest // block))
    while True:
        # one block is left for every source: its survivor is rounded by itself
        last = blocks == 1
        level = tables.write(current.groupBy("source", "__block").applyInArrow(lean_group(settle(last)), schema))
        done.append(level.filter(~F.col("__open")))
        if last:
            break
        blocks = -(-blocks // fan_in)
        current = level.filter("__open").withColumn("__block", F.floor(F.col("__block") / fan_in))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*keys, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, ratio: float = RATIO, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source)."""
    tables = Tables(docs.sparkSession, "sizes")
    sized = tables.write(with_sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.xxhash64("doc_id", "source", "text").alias("__tie"))))
    return pivotal_copies(sized, targets(sized, ratio, weights, cap), seed)


def mixed(docs: DataFrame, ratio: float = RATIO, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """The rows of docs, with their columns, as often as the mix takes them (0 to 2 times)."""
    tables = Tables(docs.sparkSession, "mixed")
    row = "__row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    # rows are written with a number each; only the number, id, source and size are dealt about
    whole = tables.write(docs.withColumn(row, F.monotonically_increasing_id()))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    narrow = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", tie.alias("__tie"), F.col(row).alias("row"))
    sized = tables.write(with_sizes(narrow))
    taken = tables.write(pivotal_copies(sized, targets(sized, ratio, weights, cap), seed).filter("copies > 0").select(F.col("row").alias("__taken"), "copies"))
    few = F.broadcast(taken) if taken.count() <= BROADCAST else taken
    many = whole.join(few, F.col(row) == F.col("__taken"))
    return many.select(*[whole[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["copies"].cast("int"))).alias(row)).drop(row)
