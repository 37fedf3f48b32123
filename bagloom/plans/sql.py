"""Loop programs as Spark SQL texts over temporary views.

The same comprehensions as the DataFrame back end's, printed: generators are FROM and JOIN
items, predicates ON and WHERE conditions, reductions aggregates with GROUP BY, merges FULL
OUTER JOINs. Each array is a view under its own name, registered again after each
assignment; scalars are literals. `while` stays with the driver.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bagloom.lang.loops import parse_loops
from bagloom.lang.tree import Bin, Bind, Call, Field, Gen, If, Lit, Method, PAny, Pred, PTup, PVar, QueryError, Rec, Reduce, Select, Tup, Un, Var, free, pattern_vars
from bagloom.plans.loops import ARRAYS, SCALARS, Array, Loops, simple
from bagloom.plans.lower import conjuncts, fresh
from bagloom.plans.product import met, split
from bagloom.plans.product import text as packed

AGGREGATES = {"+": "sum({})", "sum": "sum({})", "*": "product({})", "&&": "bool_and({})", "||": "bool_or({})", "max": "max({})", "min": "min({})", "avg": "avg({})", "count": "count(1)", "argmin": "min({})", "argmax": "max({})"}
MERGES = {"+": "{a} + {b}", "*": "{a} * {b}", "&&": "{a} AND {b}", "||": "{a} OR {b}", "max": "greatest({a}, {b})", "min": "least({a}, {b})", "argmin": "least({a}, {b})", "argmax": "greatest({a}, {b})"}
WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
METHODS = {"toInt": "CAST({} AS INT)", "toLong": "CAST({} AS BIGINT)", "toDouble": "CAST({} AS DOUBLE)", "toString": "CAST({} AS STRING)", "length": "length({})"}


class Texts(Loops):
    def __init__(self, spark: SparkSession, bindings: dict[str, Any], session: Any):
        super().__init__(spark, bindings, session)
        self.sql: list[str] = []
        self.prefix = fresh("view")

    # ---- views ----
    def view(self, name: str) -> str:
        v = self.vars[name]
        df = v.df if isinstance(v, Array) else v
        if not isinstance(df, DataFrame):
            raise QueryError(f"{name} is no array")
        out = f"{self.prefix}_{name}"
        df.createOrReplaceTempView(out)
        return out

    def send(self, text: str) -> DataFrame:
        self.sql.append(text)
        return self.spark.sql(text)

    # ---- expressions ----
    def literal(self, v: Any) -> tuple[str, T.DataType | None]:
        if isinstance(v, bool):
            return str(v).lower(), T.BooleanType()
        if isinstance(v, int):
            return (f"{v}", T.IntegerType()) if abs(v) < 1 << 31 else (f"{v}L", T.LongType())
        if isinstance(v, float):
            return f"{v!r}D", T.DoubleType()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'", T.StringType()
        raise QueryError(f"no SQL literal: {v!r}")

    def text(self, e: Any, env: dict[str, tuple]) -> tuple[str, T.DataType | None]:
        """(SQL, type where known)."""
        match e:
            case Lit(v):
                return self.literal(v)
            case Var(n):
                if n in env:
                    return env[n]
                if n in self.vars:
                    return self.literal(self.vars[n])
                raise QueryError(f"unknown name {n}")
            case Tup(items):
                return "named_struct(" + ", ".join(f"'_{i + 1}', {self.text(x, env)[0]}" for i, x in enumerate(items)) + ")", None
            case Rec(items):
                return "named_struct(" + ", ".join(f"'{n}', {self.text(x, env)[0]}" for n, x in items) + ")", None
            case Field(of, name):
                sql, kind = self.text(of, env)
                if isinstance(kind, T.StructType):
                    if name not in kind.names and name[1:].isdigit():
                        name = kind.names[int(name[1:]) - 1]
                    return f"{sql}.`{name}`", kind[name].dataType
                if name in METHODS:
                    return METHODS[name].format(sql), None
                return f"{sql}.`{name}`", None
            case Method(of, name, ()) if name in METHODS:
                return METHODS[name].format(self.text(of, env)[0]), None
            case Method(Var("Math" | "math"), name, args) | Call(name, args):
                name = {"toInt": "int", "toLong": "bigint", "toDouble": "double"}.get(name, name)
                return f"{name}({', '.join(self.text(a, env)[0] for a in args)})", None
            case Un("!", a):
                return f"NOT ({self.text(a, env)[0]})", T.BooleanType()
            case Un(op, a):
                sql, kind = self.text(a, env)
                return f"({op}{sql})", kind
            case If(t, a, b):
                x, kind = self.text(a, env)
                return f"CASE WHEN {self.text(t, env)[0]} THEN {x} ELSE {self.text(b, env)[0]} END", kind
            case Bin(op, a, b):
                (x, k), (y, l) = self.text(a, env), self.text(b, env)
                both = isinstance(k, WHOLE) and isinstance(l, WHOLE)
                if op == "+" and (isinstance(k, T.StringType) or isinstance(l, T.StringType)):
                    return f"concat({x}, {y})", T.StringType()
                if op == "/":
                    return (f"({x} div {y})", T.LongType()) if both else (f"try_divide(CAST({x} AS DOUBLE), {y})", T.DoubleType())
                if op in ("+", "-", "*", "%"):
                    return f"({x} {op} {y})", (T.LongType() if T.LongType() in (k, l) else T.IntegerType()) if both else T.DoubleType() if isinstance(k, T.DoubleType) or isinstance(l, T.DoubleType) else None
                sql = {"==": "=", "!=": "<>", "&&": "AND", "||": "OR"}.get(op, op)
                if sql not in ("=", "<>", "AND", "OR", "<", "<=", ">", ">="):
                    raise QueryError(f"no SQL for {op}")
                return f"({x} {sql} {y})", T.BooleanType()
        raise QueryError(f"no SQL for {e}")

    # ---- queries ----
    def source(self, q: Gen, env: dict[str, tuple]) -> tuple[str, str]:
        """(FROM item, its alias); binds the generator's pattern in env."""
        alias = fresh("t")
        if isinstance(q.domain, Call) and q.domain.name == "range":
            ends = [self.text(a, env)[0] for a in q.domain.args]
            env[q.pattern.name] = (f"{alias}.value", T.LongType())
            low, high, step = (simple(x, self.vars) for x in q.domain.args)
            if all(type(x) is int for x in (low, high, step)) and step:
                # dealt over tasks, where a sequence is an array in one of them
                return f"(SELECT id AS value FROM range({low}, {high + (1 if step > 0 else -1)}, {step})) {alias}", alias
            return f"(SELECT explode(sequence(CAST({ends[0]} AS BIGINT), CAST({ends[1]} AS BIGINT), CAST({ends[2]} AS BIGINT))) AS value) {alias}", alias
        name = self.view(q.domain.name)
        schema = self.spark.table(name).schema
        if isinstance(q.pattern, PTup):
            for p, c in zip(q.pattern.items, schema, strict=True):
                if isinstance(p, PVar):
                    env[p.name] = (f"{alias}.`{c.name}`", c.dataType)
                elif not isinstance(p, PAny):
                    raise QueryError("only variables are bound here")
        elif isinstance(q.pattern, PVar):
            env[q.pattern.name] = (f"{alias}.`{schema[0].name}`", schema[0].dataType) if schema.names == ["value"] else (alias, schema)
        return f"{name} {alias}", alias

    def clauses(self, quals: tuple) -> tuple[str, dict[str, tuple]]:
        env: dict[str, tuple] = {}
        todo = [q for q in quals if not isinstance(q, Pred)]
        preds = [c for q in quals if isinstance(q, Pred) for c in conjuncts(q.test)]
        known: set[str] = set()
        parts: list[str] = []
        where: list[str] = []

        def decidable() -> list[str]:
            waiting = {v for q in todo for v in pattern_vars(q.pattern)}
            out = [p for p in preds if not free(p) & waiting]
            for p in out:
                preds.remove(p)
            return [self.text(p, env)[0] for p in out]

        def linked(q: Gen) -> bool:
            own = set(pattern_vars(q.pattern))
            return any(isinstance(p, Bin) and p.op == "==" and free(p) & own and free(p) & known for p in preds)

        while todo:
            waiting = {v for q in todo for v in pattern_vars(q.pattern)}
            ready = [q for q in todo if not free(q.domain if isinstance(q, Gen) else q.value) & waiting]
            q = next((q for q in ready if isinstance(q, Bind)), None) or next((q for q in ready if parts and linked(q)), ready[0])
            todo.remove(q)
            if isinstance(q, Bind):
                env[q.pattern.name] = self.text(q.value, env)
                known |= set(pattern_vars(q.pattern))
                where += decidable()
                continue
            item, _ = self.source(q, env)
            known |= set(pattern_vars(q.pattern))
            on = decidable()
            if not parts:
                parts.append(f"FROM {item}")
                where += on
            else:
                parts.append(f"JOIN {item} ON {' AND '.join(on)}" if on else f"CROSS JOIN {item}")
        if not parts:
            parts.append("FROM (SELECT 1)")
        return " ".join(parts) + (f" WHERE {' AND '.join(where)}" if where else ""), env

    def render(self, s: Select) -> str:
        clauses, env = self.clauses(s.quals)
        if s.group is None:
            items = s.head.items if isinstance(s.head, Rec) else (("value", s.head),)
            return f"SELECT {', '.join(f'{self.text(x, env)[0]} AS `{n}`' for n, x in items)} {clauses}"
        keys = [self.text(k, env) for k in (s.group.key.items if isinstance(s.group.key, Tup) else (s.group.key,))]
        names = pattern_vars(s.group.pattern)
        bound = dict(zip(names, keys, strict=True))
        cols = []
        for n, x in s.head.items:
            if isinstance(x, Reduce):
                cols.append(f"{AGGREGATES[x.op].format(self.text(x.of, env)[0])} AS `{n}`")
            else:
                cols.append(f"{bound[x.name][0]} AS `{n}`")
        return f"SELECT {', '.join(cols)} {clauses} GROUP BY {', '.join(k for k, _ in keys)}"

    # ---- the back end's operations ----
    def query(self, s: Select) -> DataFrame:
        found = self.product(s)
        return self.send(self.render(s)) if found is None else found

    def product(self, s: Select, fill: tuple | None = None) -> DataFrame | None:
        found = split(s)
        if found is None or "+" in self.session.monoids or not all(isinstance(self.vars[q.domain.name], (Array, DataFrame)) for side in (found.left, found.right) for q in side.quals if isinstance(q, Gen)):
            return None
        left, right = self.render(found.left), self.render(found.right)
        known = met(self.spark.sql(left), self.spark.sql(right))
        if known is None:
            return None
        return self.send(packed(found, f"({left})", f"({right})", *known, self.spark.sparkContext.defaultParallelism, fill))

    def total(self, op: str, s: Select) -> Any:
        clauses, env = self.clauses(s.quals)
        return self.send(f"SELECT {AGGREGATES[op].format(self.text(s.head, env)[0])} AS value {clauses}").first()[0]

    def keyed(self, new: DataFrame, a: Array, part: str | None) -> DataFrame:
        text = self.sql.pop()
        keys = [f"CAST(`{k}` AS BIGINT) AS `{k}`" if a.kind != "map" else f"`{k}`" for k in a.names[:-1]]
        v = f"CAST(v AS {SCALARS[a.item[0]]}) AS v" if part is None and a.item and a.item[0] in SCALARS else "v"
        return self.send(f"SELECT {', '.join(keys)}, {v} FROM ({text})")

    def merged(self, a: Array, new: DataFrame, op: str | None, part: str | None, within: bool = False) -> DataFrame:
        if a.df is None or part is not None:
            return super().merged(a, new, op, part, within)
        text = self.sql.pop()
        old = fresh("old")
        a.df.createOrReplaceTempView(old)
        keys = a.names[:-1]
        on = " AND ".join(f"o.`{k}` = n.`{k}`" for k in keys)
        both = "n.v" if op is None else MERGES[op].format(a="o.v", b="n.v")
        value = f"CASE WHEN n.`{keys[0]}` IS NULL THEN o.v WHEN o.`{keys[0]}` IS NULL THEN n.v ELSE {both} END AS v"
        return self.send(f"SELECT {', '.join(f'coalesce(o.`{k}`, n.`{k}`) AS `{k}`' for k in keys)}, {value} FROM {old} o {'LEFT' if within else 'FULL OUTER'} JOIN ({text}) n ON {on}")

    def results(self) -> dict[str, Any]:
        return super().results() | {"sql": self.sql}


def run_sql(text: str, bindings: dict[str, Any], session: Any) -> dict[str, Any]:
    spark = bindings.pop("spark", None) or next((x.sparkSession for x in bindings.values() if isinstance(x, DataFrame)), None) or SparkSession.getActiveSession()
    texts = Texts(spark, bindings, session)
    texts.run(parse_loops(text, set(session.monoids)))
    return texts.results()


__all__ = ["ARRAYS", "Texts", "run_sql"]
