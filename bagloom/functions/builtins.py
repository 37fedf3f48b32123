"""Built-in functions and methods over Columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(i: Column, low: Column, high: Column, step: Column | int = 1) -> Column:
    """Whether i is one of low, low + step, ... up to high, both ends included."""
    return (i >= low) & (i <= high) & (((i - low) % step) == 0)


FUNCTIONS = {
    "sqrt": F.sqrt, "pow": F.pow, "abs": F.abs, "exp": F.exp, "log": F.log, "floor": F.floor, "ceil": F.ceil, "round": F.round,
    "toInt": lambda c: c.cast("int"), "toLong": lambda c: c.cast("long"), "toDouble": lambda c: c.cast("double"), "toString": lambda c: c.cast("string"),
    "lower": F.lower, "upper": F.upper, "length": F.length, "substring": F.substring, "trim": F.trim, "contains": F.contains,
    "least": F.least, "greatest": F.greatest, "coalesce": F.coalesce, "exists": lambda c: c.isNotNull(), "inRange": in_range,
    "year": F.year, "month": F.month, "concat": F.concat, "size": F.size, "array": F.array, "hash": F.xxhash64, "random": lambda: F.rand(0),
    "max2": F.greatest, "min2": F.least,
}

#: methods of a value: name -> (value, *arguments)
METHODS = {
    "toInt": lambda c: c.cast("int"), "toLong": lambda c: c.cast("long"), "toDouble": lambda c: c.cast("double"), "toFloat": lambda c: c.cast("float"), "toString": lambda c: c.cast("string"), "toList": lambda c: c,
    "split": lambda c, sep: F.split(c, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1), "words": lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != ""), "lower": F.lower, "upper": F.upper, "trim": F.trim, "startsWith": lambda c, p: F.startswith(c, p), "endsWith": lambda c, p: F.endswith(c, p), "matches": lambda c, p: F.regexp_like(c, p), "extractAll": lambda c, p, g=None: F.regexp_extract_all(c, p, F.lit(0) if g is None else g),
    "head": lambda a: F.get(a, F.lit(0)), "last": lambda a: F.element_at(a, -1), "tail": lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), "length": lambda a: F.size(a), "size": lambda a: F.size(a), "count": lambda a: F.size(a).cast("long"), "contains": F.array_contains, "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y), "distinct": F.array_distinct, "reverse": F.reverse, "take": lambda a, n: F.slice(a, 1, n), "sorted": F.sort_array, "apply": lambda a, i: F.get(a, i),
    "isEmpty": lambda a: F.size(a) == 0, "nonEmpty": lambda a: F.size(a) > 0, "zipWithIndex": lambda a: F.transform(a, lambda x, i: F.struct(x.alias("_1"), i.alias("_2"))),
}
