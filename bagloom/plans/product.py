"""Sums of products over an equal index, where most pairs of outer keys meet more than once.

`select (i, k, +/(x * y)) from (i, j, x) <- M, (l, k, y) <- N where j == l group by (i, k)` as a join
makes a row for every i, j and k and sends it to its sum. If that is more than the pairs of outer
keys, both sides are packed instead, one row for each outer key with a column for each inner index,
and the packed rows are paired in a grid of tasks: each pair is one sum and no sum is exchanged.
Whether it is more is counted first; sparse sides stay a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.lang.tree import Bin, Bind, Gen, PAny, Pred, PTup, PVar, Rec, Reduce, Select, Tup, Var, free, pattern_vars, substitute
from bagloom.plans.lower import conjuncts

INDICES = 4096  # inner indices of a packed row; with more the sides stay a join
COLUMNS = 64  # up to here columns, beyond an array
PAIRS = 4_000_000  # of a task


@dataclass(frozen=True)
class Product:
    left: Select  # heads are records: the outer keys, j, x
    right: Select
    names: tuple[str, ...]  # of the output
    items: tuple[str, ...]  # "l.<key>", "r.<key>", or "v" for the sum

    def keys(self, side: str) -> list[str]:
        return [n for n, _ in (self.left if side == "l" else self.right).head.items[:-2]]


def split(s: Select) -> Product | None:
    """The two sides of a sum of products; None for any other comprehension."""
    if s.group is None or s.other is not None or s.distinct or s.having is not None or s.order is not None:
        return None
    gens = [q for q in s.quals if isinstance(q, Gen)]
    if len(gens) != 2 or not all(isinstance(g.domain, Var) and isinstance(g.pattern, PTup) and all(isinstance(p, (PVar, PAny)) for p in g.pattern.items) for g in gens):
        return None
    sides = [set(pattern_vars(g.pattern)) for g in gens]
    if sides[0] & sides[1]:
        return None
    binds: dict[str, Any] = {}
    preds: list[Any] = []
    for q in s.quals:
        if isinstance(q, Bind):
            if not isinstance(q.pattern, PVar) or q.pattern.name in sides[0] | sides[1] | set(binds):
                return None
            binds[q.pattern.name] = substitute(q.value, binds)
        elif isinstance(q, Pred):
            preds += conjuncts(substitute(q.test, binds))

    def side(e: Any) -> int | None:
        at = [k for k in (0, 1) if free(e) & sides[k]]
        return at[0] if len(at) == 1 else None

    own: list[list[Any]] = [[], []]
    on = []
    for p in preds:
        if (k := side(p)) is not None:
            own[k].append(Pred(p))
        elif isinstance(p, Bin) and p.op == "==" and isinstance(p.left, Var) and isinstance(p.right, Var) and {side(p.left), side(p.right)} == {0, 1}:
            on.append((p.left, p.right) if side(p.left) == 0 else (p.right, p.left))
        else:
            return None
    keys = s.group.key.items if isinstance(s.group.key, Tup) else (s.group.key,)
    named = s.group.pattern.items if isinstance(s.group.pattern, PTup) else (s.group.pattern,)
    if len(on) != 1 or len(keys) != len(named) or not all(isinstance(p, PVar) for p in named):
        return None
    outer: list[list[tuple[str, Any]]] = [[], []]
    place: dict[str, str] = {}
    for p, e in zip(named, keys, strict=True):
        e = substitute(e, binds)
        if (k := side(e)) is None:
            return None
        outer[k].append((f"k{len(place)}", e))
        place[p.name] = f"{'lr'[k]}.k{len(place)}"
    if not outer[0] or not outer[1]:
        return None
    head = s.head.items if isinstance(s.head, Rec) else [(f"_{i + 1}", x) for i, x in enumerate(s.head.items)] if isinstance(s.head, Tup) else ()
    items, factors = [], None
    for _, x in head:
        match x:
            case Var(n) if n in place:
                items.append(place[n])
            case Reduce("+" | "sum", Var(n)) if factors is None and n in binds:
                z = binds[n]
                if not isinstance(z, Bin) or z.op != "*" or {side(z.left), side(z.right)} != {0, 1}:
                    return None
                factors = (z.left, z.right) if side(z.left) == 0 else (z.right, z.left)
                items.append("v")
            case _:
                return None
    if factors is None:
        return None
    left, right = (Select(Rec((*outer[k], ("j", on[0][k]), ("x", factors[k]))), (gens[k], *own[k])) for k in (0, 1))
    return Product(left, right, tuple(n for n, _ in head), tuple(items))


def met(left: DataFrame, right: DataFrame, most: int = INDICES) -> tuple[list, int] | None:
    """(inner indices of both sides, pairs of outer keys) if packing makes fewer rows than a join; else None."""
    if left.isStreaming or right.isStreaming or any(df.schema["x"].dataType.typeName() != "double" for df in (left, right)):
        return None
    if any(df.schema["j"].dataType.typeName() not in ("integer", "long") for df in (left, right)):
        return None
    a, b = (df.groupBy("j").agg(F.count(F.lit(1)).alias(f"{s}n"), F.count("x").alias(f"{s}x")) for s, df in (("l", left), ("r", right)))
    found = a.join(b, "j").limit(most + 1).collect()
    # a sum of nothing but nulls is a row of its own, which packed rows don't show
    if not found or len(found) > most or any(r["ln"] != r["lx"] or r["rn"] != r["rx"] for r in found):
        return None
    rows = [df.select(*df.columns[:-2]).distinct().count() for df in (left, right)]
    if rows[0] * rows[1] > sum(r["ln"] * r["rn"] for r in found):
        return None
    return sorted(r["j"] for r in found), rows[0] * rows[1]


def text(product: Product, left: str, right: str, indices: list, pairs: int, cores: int, fill: tuple | None = None, grid: int = 1) -> str:
    """The SQL of packed sides in a grid; left and right are FROM items.

    fill is ((low, high) of the left key, (low, high) of the right key, value): all these pairs are
    rows, and the value is added to each sum.
    """
    parts = max(math.ceil(math.sqrt(4 * cores)), math.ceil(math.sqrt(pairs / PAIRS)), grid)
    xs = [f"x{i}" for i in range(len(indices))]

    def packed(source: str, side: str, ends: tuple | None) -> str:
        keys = product.keys(side)
        names = ", ".join(keys)
        columns = ", ".join(f"p.{x}" for x in xs) if len(xs) <= COLUMNS else f"array({', '.join(f'p.{x}' for x in xs)}) AS x"
        pivot = f"(SELECT * FROM (SELECT {names}, j, x FROM {source}) PIVOT (sum(x) FOR j IN ({', '.join(f'{j} AS {x}' for j, x in zip(indices, xs, strict=True))}))) p"
        if ends is not None:
            k = keys[0]
            return f"(SELECT /*+ REPARTITION({parts}, {k}) */ g.{k}, {columns} FROM (SELECT id AS {k} FROM range({ends[0]}, {ends[1] + 1})) g LEFT JOIN {pivot} ON p.{k} = g.{k}) {side}"
        return f"(SELECT /*+ REPARTITION({parts}, {names}) */ {', '.join(f'p.{k}' for k in keys)}, {columns} FROM {pivot}) {side}"

    if len(xs) <= COLUMNS:
        products = [f"l.{x} * r.{x}" for x in xs]
        total, there = " + ".join(f"coalesce({p}, 0D)" for p in products), f"coalesce({', '.join(products)}) IS NOT NULL"
    else:
        products = "zip_with(l.x, r.x, (a, b) -> a * b)"
        total, there = f"aggregate({products}, 0D, (s, z) -> s + coalesce(z, 0D))", f"exists({products}, z -> z IS NOT NULL)"
    total = total if fill is None else f"{float(fill[2])!r}D + {total}"
    items = ", ".join(f"{total if x == 'v' else x} AS `{n}`" for x, n in zip(product.items, product.names, strict=True))
    sides = packed(left, "l", fill and fill[0]), packed(right, "r", fill and fill[1])
    return f"SELECT /*+ SHUFFLE_REPLICATE_NL(l) */ {items} FROM {sides[0]} CROSS JOIN {sides[1]}" + (f" WHERE {there}" if fill is None else "")


def dense(product: Product, left: DataFrame, right: DataFrame, fill: tuple | None = None, grid: int = 1) -> DataFrame | None:
    """The packed plan over DataFrames, or None where a join makes fewer rows."""
    found = met(left, right)
    if found is None:
        return None
    spark = left.sparkSession
    return spark.sql(text(product, "{left}", "{right}", *found, spark.sparkContext.defaultParallelism, fill, grid), left=left, right=right)
