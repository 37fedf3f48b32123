"""The surface: q, qs, value, m, monoid, v, s, debug, debug_all, stream, explain.

    q("select (c.name, +/(select o.price from o <- orders where o.cid == c.id)) from c <- customers",
      customers=customers, orders=orders)

Names in a query are what the call binds: DataFrames (bags), lists and ranges (local bags),
scalars, Python functions over Columns, classes (constructors).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from bagloom.functions.monoids import Monoid, user_monoid
from bagloom.lang.parsing import parse_macros, parse_queries, parse_query
from bagloom.plans.lower import Lowering


class Session:
    """Macros, monoids and functions known to later queries. The module's functions use one shared session."""

    def __init__(self):
        self.macros: dict[str, tuple] = {}
        self.monoids: dict[str, Monoid] = {}
        self.functions: dict[str, Callable[..., Column]] = {}

    def lowering(self, bindings: dict[str, Any], lineage: bool = False) -> Lowering:
        spark = bindings.pop("spark", None) or next((x.sparkSession for x in bindings.values() if isinstance(x, DataFrame)), None) or SparkSession.getActiveSession()
        return Lowering(spark, bindings, self.macros, self.monoids, self.functions, lineage)

    def q(self, text: str, **bindings: Any) -> DataFrame:
        """A query's bag, or one row with column `value` (`_1`, `_2`, ... for tuples) of a scalar. A repeat whose state is several bags gives a tuple of them."""
        return self.lowering(bindings).run(parse_query(text, set(self.monoids)))

    def value(self, text: str, **bindings: Any) -> Any:
        """A scalar query's Python value; one action."""
        row = self.q(text, **bindings).first()
        return row[0] if row is not None and len(row) == 1 else row

    def qs(self, text: str, **bindings: Any) -> list[DataFrame]:
        """The results of several queries, separated by semicolons."""
        return [self.lowering(dict(bindings)).run(e) for e in parse_queries(text, set(self.monoids))]

    def m(self, text: str) -> None:
        """Defines macros: `def f(x: T) = body; ...`, used by substitution, also as `x.f(...)`."""
        self.macros |= parse_macros(text)

    def monoid(self, name: str, combine: Callable[[Column, Column], Column], zero: Any = None, aggregate: Callable[[Column], Column] | None = None) -> None:
        """A monoid for reductions `name/e`, and an infix operator if its name is a symbol. Without a zero, nothing gives NULL."""
        self.monoids[name] = user_monoid(name, combine, zero, aggregate)

    def function(self, name: str, body: Callable[..., Column]) -> None:
        """A function over Columns that queries may call."""
        self.functions[name] = body


SHARED = Session()
q, qs, value, m, monoid, function = SHARED.q, SHARED.qs, SHARED.value, SHARED.m, SHARED.monoid, SHARED.function


def v(text: str, **bindings: Any) -> dict[str, Any]:
    """Runs a loop program; gives its variables (arrays are DataFrames (i, v), (i, j, v) or (k, v))."""
    from bagloom.plans.loops import run_loops

    return run_loops(text, bindings, SHARED)


def s(text: str, **bindings: Any) -> dict[str, Any]:
    """Runs a loop program as Spark SQL texts over temporary views; gives its variables, and the texts under `sql`."""
    from bagloom.plans.sql import run_sql

    return run_sql(text, bindings, SHARED)


def debug(text: str, **bindings: Any) -> DataFrame:
    """A query's rows with `lineage`: the source rows (source, row as JSON) that each comes from."""
    return SHARED.lowering(bindings, lineage=True).run(parse_query(text, set(SHARED.monoids)))


def debug_all(text: str, **bindings: Any) -> DataFrame:
    """(source, row, status): every source row of a query, kept if it lies in some result's lineage, else erased."""
    from bagloom.operators.lineage import kept_and_erased

    return kept_and_erased(debug(text, **dict(bindings)), {k: x for k, x in bindings.items() if isinstance(x, DataFrame)}, text)


@dataclass(frozen=True)
class Explained:
    query: str
    tree: str
    expanded: str
    plan: str

    def __str__(self) -> str:
        return f"Query:\n{self.query}\n\nTree:\n{self.tree}\n\nExpanded:\n{self.expanded}\n\nPlan:\n{self.plan}"


def explain(text: str, **bindings: Any) -> Explained:
    """A query's text, its tree before and after macros, and Spark's plan."""
    from bagloom.lang.pretty import pretty

    low = SHARED.lowering(bindings)
    tree = parse_query(text, set(SHARED.monoids))
    df = low.run(tree)
    plan = df._jdf.queryExecution().explainString(low.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return Explained(text, pretty(tree), pretty(low.expand(tree)), plan)


def stream(text: str, **bindings: Any) -> DataFrame:
    """A query over streaming DataFrames, if it can be kept up incrementally; else ValueError says why."""
    from bagloom.streaming.incremental import incremental

    return incremental(text, bindings, SHARED)
