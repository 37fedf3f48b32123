"""The algebra as functions over DataFrames: what a comprehension lowers to, for direct use.

Equality in bag operations is null-safe (null equals null). No function collects anything
but the sizes it checks; joins are left to Catalyst and adaptive execution unless a side is
marked small, and a mark holds only up to `limit` bytes by the optimizer's estimate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagloom.lang.tree import Rec, Select, Var
from bagloom.plans.lower import SMALL_BYTES, small
from bagloom.plans.product import Product, dense
from bagloom.sources.staging import staged


def flat_map(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """Each row once per item of an array; rows with none go."""
    return df.withColumn(name, F.explode(items))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Additive: multiplicities add up."""
    return a.union(b)


def _same(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[Column]]:
    new = [f"__{i}" for i in range(len(b.columns))]
    return b.toDF(*new).distinct(), [a[x].eqNullSafe(F.col(y)) for x, y in zip(a.columns, new, strict=True)]


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a (as often as in a) that equals some row of b."""
    right, on = _same(a, b)
    return a.join(right, on, "left_semi")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a that equals no row of b."""
    right, on = _same(a, b)
    return a.join(right, on, "left_anti")


def marked_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows it."""
    return F.broadcast(df) if small(df) and limit >= 0 else df


def join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], small_side: bool = False) -> DataFrame:
    """Inner equi-join on pairs of columns."""
    right = marked_small(b) if small_side else b
    return a.join(right, [a[x] == b[y] for x, y in on])


def cross(a: DataFrame, b: DataFrame, small_side: bool = False) -> DataFrame:
    return a.crossJoin(marked_small(b) if small_side else b)


def cogroup(a: DataFrame, b: DataFrame, keys: list[str], left: list[Column], right: list[Column]) -> DataFrame:
    """Full-outer grouping: the keys of both, with aggregates of each side (NULL where a side has no such key)."""
    x, y = a.groupBy(*keys).agg(*left), b.groupBy(*keys).agg(*right).withColumnsRenamed({k: f"__{k}" for k in keys})
    both = x.join(y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full_outer")
    return both.withColumns({k: F.coalesce(k, f"__{k}") for k in keys}).drop(*(f"__{k}" for k in keys))


def cogroup_small(large: DataFrame, small_side: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Each row of the small side whose keys the large side has, with the large side's aggregates (unmatched keys go)."""
    grouped = large.groupBy(*keys).agg(*aggregates)
    return grouped.join(marked_small(small_side), keys)


def nest_join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], name: str) -> DataFrame:
    """Every row of a with the bag of matching rows of b; an empty bag where there are none."""
    keys = [f"__{y}" for _, y in on]
    bags = b.groupBy(*[F.col(y).alias(k) for (_, y), k in zip(on, keys, strict=True)]).agg(F.collect_list(F.struct(*b.columns)).alias(name))
    kind = bags.schema[name].dataType
    return a.join(bags, [a[x] == F.col(k) for (x, _), k in zip(on, keys, strict=True)], "left").drop(*keys).withColumn(name, F.coalesce(name, F.array().cast(kind)))


def merge(old: DataFrame, new: DataFrame, keys: list[str], combine: Callable[[Column, Column], Column] | None = None, value: str = "v") -> DataFrame:
    """Array merge: cells of both are combined (or replaced by the new ones), all others stay."""
    right = new.withColumnsRenamed({k: f"__{k}" for k in keys} | {value: "__v"})
    both = old.join(right, [F.col(k) == F.col(f"__{k}") for k in keys], "full_outer")
    fresh, there = F.col("__v"), F.col(f"__{keys[0]}").isNotNull()
    cell = F.when(F.col(keys[0]).isNull(), fresh).when(there, combine(F.col(value), fresh) if combine else fresh).otherwise(F.col(value))
    return both.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), cell.alias(value))


def _packed(a: DataFrame, b: DataFrame, grid: int = 1) -> DataFrame | None:
    """The product of packed rows and columns, where that makes fewer rows than a join."""
    left, right = (Select(Rec(tuple((n, Var(n)) for n in (k, "j", "x"))), ()) for k in ("k0", "k1"))
    return dense(Product(left, right, ("i", "j", "v"), ("l.k0", "r.k1", "v")), a.select(F.col("i").alias("k0"), "j", F.col("v").alias("x")), b.select(F.col("j").alias("k1"), F.col("i").alias("j"), F.col("v").alias("x")), grid=grid)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrix product of (i, j, v) bags: join on the inner index, sum by the outer ones with map-side partial sums; dense ones are packed."""
    if (packed := _packed(a, b)) is not None:
        return packed
    right = b.toDF("__j", "k", "__v")
    return a.join(right, a["j"] == F.col("__j")).groupBy("i", "k").agg(F.sum(a["v"] * F.col("__v")).alias("v")).withColumnRenamed("k", "j")


def multiply_grid(a: DataFrame, b: DataFrame, rows: int = 10, columns: int = 10) -> DataFrame:
    """The product on a grid of cells: rows of a go to every column of their grid row, columns of b to every row.

    Where pairs of rows and columns meet more than once on average, packed rows and columns are
    paired in at least so many cells and each pair is one sum without an exchange. Elsewhere a row or
    column that holds a large part of all entries is spread over a grid row or column of cells; both
    sides are copied, and the sums have an exchange of their own as in multiply(), which moves less
    where no index is that frequent.
    """
    if (packed := _packed(a, b, max(rows, columns))) is not None:
        return packed
    x = a.withColumn("__r", F.pmod(F.xxhash64("i"), F.lit(rows))).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")))
    y = b.toDF("__j", "k", "__v").withColumn("__c", F.pmod(F.xxhash64("k"), F.lit(columns))).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))
    both = x.join(y.withColumnsRenamed({"__r": "__r2", "__c": "__c2"}), [F.col("__r") == F.col("__r2"), F.col("__c") == F.col("__c2"), F.col("j") == F.col("__j")])
    return both.groupBy("__r", "__c", "i", "k").agg(F.sum(F.col("v") * F.col("__v")).alias("v")).select("i", F.col("k").alias("j"), "v")


def repeat(start: DataFrame, step: Callable[[DataFrame], DataFrame], until: Callable[[DataFrame], bool] | None = None, limit: int | None = None) -> DataFrame:
    """Do-while over a bag: step runs at least once; `until` is asked about the state before the step. Each state is staged."""
    if until is None and limit is None:
        raise ValueError("a repeat needs until or limit")
    state, n = start, 0
    while True:
        new = staged(step(state))
        n += 1
        stop = (until is not None and until(state)) or n == limit
        state = new
        if stop:
            return state


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order; partitions send their own first n."""
    return df.orderBy(*order).limit(n)


def total(df: DataFrame, aggregate: Column, zero: object | None = None) -> object:
    """One aggregate's value; zero for nothing."""
    got = df.agg(aggregate).first()[0]
    return zero if got is None else got
