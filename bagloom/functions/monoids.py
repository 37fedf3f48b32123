"""Monoids: how a reduction becomes a Spark aggregate, an array fold, and what it gives on nothing.

Zeros follow the algebra: + 0, * 1, && true, || false, count 0; max, min and avg of nothing
are NULL. A registered monoid combines two Columns; as an aggregate it folds the collected
values of a group, so `min`/`max`-like ones should be given `aggregate` as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    name: str
    aggregate: Callable[[Column], Column]
    fold: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column] | None = None
    zero: Any = None
    #: partial results can be merged, so a stream can keep them
    incremental: bool = True


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("double"), lambda x, y: x + y)


def folded(zero: Any, op: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.aggregate(a, F.lit(zero), op)


def generic(combine: Callable[[Column, Column], Column], zero: Any) -> Callable[[Column], Column]:
    """Left fold of an array; without a zero the first element begins (NULL for an empty array)."""
    if zero is not None:
        return lambda a: F.aggregate(a, F.lit(zero), lambda x, y: combine(x, y))
    return lambda a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda x, y: combine(x, y))


def user_monoid(name: str, combine: Callable[[Column, Column], Column], zero: Any = None, aggregate: Callable[[Column], Column] | None = None) -> Monoid:
    fold = generic(combine, zero)
    return Monoid(name, aggregate or (lambda c: fold(F.collect_list(c))), fold, combine, zero, aggregate is not None)


STANDARD = {
    "+": Monoid("+", F.sum, _sum, lambda a, b: a + b, 0),
    "*": Monoid("*", F.product, folded(1.0, lambda x, y: x * y), lambda a, b: a * b, 1),
    "&&": Monoid("&&", F.bool_and, folded(True, lambda x, y: x & y), lambda a, b: a & b, True),
    "||": Monoid("||", F.bool_or, folded(False, lambda x, y: x | y), lambda a, b: a | b, False),
    "count": Monoid("count", lambda c: F.count(F.lit(1)), lambda a: F.size(a).cast("long"), None, 0),
    "avg": Monoid("avg", F.avg, lambda a: F.when(F.size(a) > 0, _sum(a) / F.size(a)), None, None),
    "max": Monoid("max", F.max, F.array_max, F.greatest, None),
    "min": Monoid("min", F.min, F.array_min, F.least, None),
}
STANDARD |= {"sum": STANDARD["+"], "product": STANDARD["*"], "and": STANDARD["&&"], "or": STANDARD["||"], "++": Monoid("++", lambda c: F.flatten(F.collect_list(c)), F.flatten, F.concat, None)}
#: argmin: the pair with the least first component, as `^` on (key, value) pairs
STANDARD["argmin"] = Monoid("argmin", F.min, F.array_min, F.least, None)
STANDARD["argmax"] = Monoid("argmax", F.max, F.array_max, F.greatest, None)
