"""Comprehensions to DataFrame plans.

A frame is a DataFrame and an environment from variables to values over its columns. Each
generator over a relation is joined with all predicates that it makes decidable, so
Catalyst finds the keys; a generator over an array explodes. Nested queries become joins:

* correlated by equalities only: the inner query is grouped by its side of them and
  left-joined, with the monoid's zero for rows without a match;
* correlated otherwise, at any depth: the distinct values of the outer columns it uses
  are joined with the inner generators, aggregated by them, and joined back;
* uncorrelated: one row, joined to all;
* quantified predicates: semi- and anti-joins.

Columns get fresh names at each generator, so self-joins need no aliases. Lifted variables
after a group-by are bags: under a reduction they become one aggregate of the same
groupBy, elsewhere a collected array.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagloom.functions.builtins import FUNCTIONS, METHODS
from bagloom.functions.monoids import STANDARD, Monoid
from bagloom.lang.tree import (
    Bin, Bind, Call, Desc, Field, Fun, Gen, Group, If, Index, Let, Lit, Match, Method, PAny, PAs, PCons, PLit, PMake, Pred, PTup, PVar, Quant, QueryError, Rec, Reduce, Repeat, Select, Seq, Tup, Un, Var, children, free, pattern_vars, qual_vars, rebuilt, substitute,
)
from bagloom.sources.scans import lines, whole_files
from bagloom.sources.staging import heavy, staged

#: a small-side mark is a hint for sides that the optimizer estimates at this size or less
SMALL_BYTES = 256 << 20


@dataclass(frozen=True)
class Col:
    c: Column
    kind: T.DataType | None = None


@dataclass(frozen=True)
class Rowed:
    names: tuple[str, ...]
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Only(Rowed):
    """An element of a bag with one column: its value, which may also be reached by the column's name."""


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    name: str = ""


@dataclass(frozen=True)
class Py:
    value: Any


@dataclass
class Frame:
    df: DataFrame
    env: dict[str, Any]
    carry: list[str] = field(default_factory=list)
    outer: set[str] = field(default_factory=set)
    trail: list[str] = field(default_factory=list)


_fresh = itertools.count()


def fresh(name: str = "c") -> str:
    return f"{name}_{next(_fresh)}"


def conjuncts(e: Any) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Bin) and e.op in ("&&", "&") else [e]


def renamed(x: Any, names: dict[str, str]) -> Any:
    """x with variables renamed, in binders and uses."""
    match x:
        case PVar(n):
            return PVar(names.get(n, n))
        case Var(n):
            return Var(names.get(n, n))
        case PAs(n, p):
            return PAs(names.get(n, n), renamed(p, names))
        case PMake(n, ps, rest):
            return PMake(n, tuple(renamed(p, names) for p in ps), names.get(rest, rest) if rest else rest)
    return rebuilt(x, lambda c: renamed(c, names))


def binders(x: Any) -> set[str]:
    own = {x.name} if isinstance(x, (PVar, PAs)) else {x.rest} if isinstance(x, PMake) and x.rest else set()
    return own.union(*(binders(c) for c in children(x)))


def apart(x: Any) -> Any:
    """x with its own binders renamed, so that it can stand anywhere."""
    return renamed(x, {n: fresh(n) for n in binders(x)})


def leaves(v: Any) -> list[Column]:
    return [y for p in v.parts for y in leaves(p)] if isinstance(v, Rowed) else [v.c]


def relabel(v: Any, make: Callable[[Col], Col]) -> Any:
    return replace(v, parts=tuple(relabel(p, make) for p in v.parts)) if isinstance(v, Rowed) else make(v)


class Lowering:
    def __init__(self, spark: SparkSession, bindings: dict[str, Any], macros: dict | None = None, monoids: dict[str, Monoid] | None = None, functions: dict[str, Callable] | None = None, lineage: bool = False):
        self.spark, self.macros, self.lineage = spark, macros or {}, lineage
        self.monoids, self.functions = STANDARD | (monoids or {}), FUNCTIONS | (functions or {})
        self.globals = {k: self.bound(k, v) for k, v in bindings.items()}
        self.traced: list[str] = []
        #: names of the columns of one-column bags
        self.alone: set[str] = set()

    def bound(self, name: str, v: Any) -> Any:
        if isinstance(v, DataFrame):
            return Rel(v, name)
        if isinstance(v, (Col, Rowed, Rel, Py)):
            return v
        if isinstance(v, Column):
            return Col(v)
        return Py(v)

    # ---- macros ----
    def expand(self, e: Any, depth: int = 0) -> Any:
        """Macro calls by substitution; a method call passes its object as the first argument."""
        if depth > 50:
            raise QueryError("macros call each other without end")
        e = rebuilt(e, lambda c: self.expand(c, depth))
        name, args = (e.name, e.args) if isinstance(e, Call) else (e.name, (e.of, *e.args)) if isinstance(e, Method) else (None, ())
        if name in self.macros:
            params, body = self.macros[name]
            if len(params) != len(args):
                raise QueryError(f"{name} takes {len(params)} arguments")
            return self.expand(substitute(apart(body), dict(zip(params, args, strict=True))), depth + 1)
        return e

    # ---- types ----
    def kind(self, v: Any, f: Frame | None) -> T.DataType | None:
        if isinstance(v, Only):
            return self.kind(v.parts[0], f)
        if isinstance(v, Rowed):
            return T.StructType([T.StructField(n, self.kind(p, f) or T.NullType()) for n, p in zip(v.names, v.parts, strict=True)])
        if v.kind is None and f is not None:
            try:
                return f.df.select(v.c).schema[0].dataType
            except Exception:  # a lambda's variable has no type outside its function
                return None
        return v.kind

    def whole(self, v: Any, f: Frame | None) -> bool:
        return isinstance(self.kind(v, f), (T.IntegerType, T.LongType, T.ShortType, T.ByteType))

    # ---- elements ----
    def element(self, df: DataFrame) -> Any:
        parts = [Col(F.col(c.name), c.dataType) for c in df.schema]
        if df.columns == ["value"]:
            return parts[0]
        if len(parts) == 1:
            self.alone.add(df.columns[0])
            return Only(tuple(df.columns), tuple(parts))
        return Rowed(tuple(df.columns), tuple(parts))

    def column(self, v: Any) -> Column:
        if isinstance(v, Only):
            return self.column(v.parts[0])
        if isinstance(v, Rowed):
            return F.struct(*(self.column(p).alias(n) for n, p in zip(v.names, v.parts, strict=True)))
        if isinstance(v, Py):
            return self.literal(v.value)
        if isinstance(v, Rel):
            raise QueryError(f"the relation {v.name} is used as a value")
        return v.c

    def literal(self, v: Any) -> Column:
        if isinstance(v, (list, range)):
            return F.array(*map(self.literal, v))
        if isinstance(v, Row):
            return F.struct(*(self.literal(x).alias(n) for n, x in v.asDict().items()))
        if isinstance(v, tuple):
            names = getattr(v, "_fields", [f"_{i + 1}" for i in range(len(v))])
            return F.struct(*(self.literal(x).alias(n) for n, x in zip(names, v, strict=True)))
        return F.lit(v)

    def bind(self, p: Any, v: Any, env: dict, f: Frame | None, conds: list[Column]) -> None:
        """Adds a pattern's variables to env, and to conds what a refutable pattern demands."""
        match p:
            case PAny():
                return
            case PVar(n):
                env[n] = v
            case PAs(n, q):
                env[n] = v
                self.bind(q, v, env, f, conds)
            case PLit(x):
                conds.append(self.column(v) == F.lit(x))
            case PTup(ps) | PMake(_, ps, None) if not (isinstance(p, PMake) and p.name in ("List", "Array", "Seq")):
                parts = self.parts(v, f)
                if len(parts) != len(ps):
                    raise QueryError(f"a pattern of {len(ps)} parts meets {len(parts)} of {getattr(v, 'names', '')}")
                for q, part in zip(ps, parts, strict=True):
                    self.bind(q, part, env, f, conds)
            case PMake(_, ps, rest):
                a, item = self.column(v), getattr(self.kind(v, f), "elementType", None)
                conds.append(F.size(a) >= len(ps) if rest else F.size(a) == len(ps))
                for i, q in enumerate(ps):
                    self.bind(q, Col(F.get(a, F.lit(i)), item), env, f, conds)
                if rest and rest != "_":
                    env[rest] = Col(F.slice(a, len(ps) + 1, F.greatest(F.size(a) - len(ps), F.lit(0))), self.kind(v, f))
            case PCons(h, t):
                a, item = self.column(v), getattr(self.kind(v, f), "elementType", None)
                conds.append(F.size(a) >= 1)
                self.bind(h, Col(F.get(a, F.lit(0)), item), env, f, conds)
                self.bind(t, Col(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), self.kind(v, f)), env, f, conds)

    def parts(self, v: Any, f: Frame | None) -> list:
        if isinstance(v, Rowed):
            return list(v.parts)
        if isinstance(v, Py) and isinstance(v.value, (tuple, Row)):
            return [Py(x) for x in v.value]
        kind = self.kind(v, f)
        if not isinstance(kind, T.StructType):
            raise QueryError("a tuple pattern meets a value without parts")
        return [Col(v.c.getField(x.name), x.dataType) for x in kind.fields]

    # ---- classification ----
    def is_relation(self, e: Any, env: dict, top: bool = False) -> bool:
        """Whether e stands for a distributed bag (top: local lists count as one)."""
        match e:
            case Var(n):
                v = env.get(n, self.globals.get(n))
                return isinstance(v, Rel) or (top and isinstance(v, Py) and isinstance(v.value, (list, range)))
            case Select(_, quals):
                inner = {k: v for k, v in env.items() if k not in qual_vars(quals)}
                return top or any(self.is_relation(q.domain, inner) for q in quals if isinstance(q, Gen)) or e.group is not None
            case Seq() | Call("range", _):
                return top
            case Call("lines" | "parquet" | "wholeFiles" as name, (_,)):
                return self.scans(name)
            case Bin("union" | "intersect" | "minus" | "++", a, b):
                return self.is_relation(a, env, top) or self.is_relation(b, env, top)
            case Method(of, "map" | "filter" | "flatMap" | "distinct" | "take" | "toList" | "zipWithIndex", _):
                return self.is_relation(of, env, top)
            case Field(of, "toList" | "distinct"):
                return self.is_relation(of, env, top)
            case If(_, a, b):
                return self.is_relation(a, env, top) and self.is_relation(b, env, top)
            case Let(p, v, b):
                inner = {k: x for k, x in env.items() if k not in pattern_vars(p)}
                if isinstance(p, PVar) and self.is_relation(v, env):
                    inner[p.name] = Rel(None)
                return self.is_relation(b, inner, top)
            case Repeat(_, start, _, _, _):
                return self.is_relation(start, env, top)
        return False

    def nested(self, e: Any, env: dict) -> bool:
        """Whether e holds a query over a relation."""
        match e:
            case Select():
                if self.is_relation(e, env):
                    return True
            case Quant(_, quals, _):
                if any(self.is_relation(q.domain, env) for q in quals if isinstance(q, Gen)):
                    return True
            case Bin("member", _, b):
                if self.is_relation(b, env):
                    return True
            case Reduce(_, x):
                if self.is_relation(x, env):
                    return True
        return any(self.nested(c, env) for c in children(e))

    # ---- relations ----
    def relation(self, e: Any, env: dict | None = None) -> DataFrame:
        """The DataFrame of a closed bag expression, with its own column names."""
        env = env or {}
        match e:
            case Var(n):
                v = env.get(n, self.globals.get(n))
                if isinstance(v, Rel):
                    return v.df
                if isinstance(v, Py) and isinstance(v.value, range):
                    return self.spark.range(v.value.start, v.value.stop, v.value.step).toDF("value")
                if isinstance(v, Py) and isinstance(v.value, list):
                    return self.local(v.value)
                raise QueryError(f"unknown relation {n}")
            case Call("range", args):
                low, high, *step = (self.scalar(a, env) for a in args)
                return self.spark.range(int(low), int(high) + 1, int(step[0]) if step else 1).toDF("value")
            case Call("lines" | "parquet" | "wholeFiles" as name, (path,)) if self.scans(name):
                at = str(self.scalar(path, env))
                return whole_files(self.spark, at) if name == "wholeFiles" else lines(self.spark, at) if name == "lines" else self.spark.read.parquet(at)
            case Seq():
                frame = Frame(self.spark.range(1).toDF("one"), dict(env))
                return self.exploded(frame.df.select(F.explode(self.column(self.value(e, frame))).alias("value")))
            case Select():
                return self.select(e, env)
            case Bin("union" | "++", a, b):
                return self.relation(a, env).union(self.relation(b, env))
            case Bin("intersect" | "minus" as op, a, b):
                left, right = self.relation(a, env), self.relation(b, env)
                new = [fresh() for _ in right.columns]
                right = right.toDF(*new).distinct()
                on = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left.columns, new, strict=True)]
                return left.join(right, on, "left_semi" if op == "intersect" else "left_anti")
            case Method(of, "map", (Fun((p,), body),)):
                return self.relation(Select(body, (Gen(p, of),)), env)
            case Method(of, "filter", (Fun((p,), body),)):
                x = fresh("x")
                return self.relation(Select(Var(x), (Gen(PAs(x, p), of), Pred(body))), env)
            case Method(of, "flatMap", (Fun((p,), body),)):
                x = fresh("x")
                return self.relation(Select(Var(x), (Gen(p, of), Gen(PVar(x), body))), env)
            case Method(of, "take", (n,)):
                return self.relation(of, env).limit(int(self.scalar(n, env)))
            case Method(of, "distinct", ()) | Field(of, "distinct"):
                return self.relation(of, env).distinct()
            case Method(of, "toList", ()) | Field(of, "toList"):
                return self.relation(of, env)
            case Method(of, "zipWithIndex", ()):
                return indexed(self.relation(of, env))
            case Let(p, v, body):
                if self.is_relation(v, env, True):
                    if not isinstance(p, PVar):
                        raise QueryError("a bag is bound to a name")
                    return self.relation(body, env | {p.name: Rel(self.relation(v, env), p.name)})
                return self.relation(substitute(body, {p.name: v}) if isinstance(p, PVar) else body, env)
            case If(test, a, b):
                return self.relation(a if self.scalar(test, env) else b, env)
            case Repeat():
                out = self.repeat(e, env)
                return out if isinstance(out, DataFrame) else self.local(out)
        raise QueryError(f"not a bag: {e}")

    def scans(self, name: str) -> bool:
        """Whether a call of this name is a scan, and not a function that the session or the query brings."""
        return name not in self.globals and name not in self.functions

    def local(self, rows: list) -> DataFrame:
        if not rows:
            raise QueryError("an empty list has no type; give a DataFrame")
        if isinstance(rows[0], (tuple, Row)):
            names = list(rows[0].asDict()) if isinstance(rows[0], Row) else list(getattr(rows[0], "_fields", [f"_{i + 1}" for i in range(len(rows[0]))]))
            return self.spark.createDataFrame([tuple(r) for r in rows], names)
        return self.spark.createDataFrame([(r,) for r in rows], ["value"])

    def exploded(self, df: DataFrame) -> DataFrame:
        return df.select("value.*") if isinstance(df.schema["value"].dataType, T.StructType) else df

    def scalar(self, e: Any, env: dict | None = None) -> Any:
        """The Python value of a closed scalar expression; one action."""
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, Var):
            v = (env or {}).get(e.name, self.globals.get(e.name))
            if isinstance(v, Py):
                return v.value
        return self.total(e, env or {}).first()[0]

    # ---- comprehensions ----
    def flat(self, quals: tuple) -> list:
        """Qualifiers with plain nested selects spliced in."""
        out = []
        for q in quals:
            d = q.domain if isinstance(q, Gen) else None
            if isinstance(d, Select) and not (d.distinct or d.group or d.order or q.small):
                d = apart(d)
                out += [*self.flat(d.quals), Bind(q.pattern, d.head)]
            elif isinstance(d, Method) and d.name in ("map", "filter") and len(d.args) == 1 and isinstance(d.args[0], Fun) and len(d.args[0].params) == 1:
                fun = apart(d.args[0])
                x = fresh("x")
                if d.name == "map":
                    out += [*self.flat((Gen(fun.params[0], d.of, q.small),)), Bind(q.pattern, fun.body)]
                else:
                    out += [*self.flat((Gen(PAs(x, fun.params[0]), d.of, q.small),)), Pred(fun.body), Bind(q.pattern, Var(x))]
            else:
                out.append(q)
        return out

    def quals(self, quals: tuple, start: Frame | None, env: dict) -> Frame:
        quals = self.flat(quals)
        todo = [q for q in quals if not isinstance(q, Pred)]
        preds = [c for q in quals if isinstance(q, Pred) for c in conjuncts(q.test)]
        f = start or Frame(None, dict(env))
        while todo:
            waiting = set(qual_vars(tuple(todo)))
            ready = [q for q in todo if not free(q.domain if isinstance(q, Gen) else q.value) & waiting]
            if not ready:
                raise QueryError("qualifiers depend on each other in a circle")
            q = self.next_of(ready, todo, preds, f)
            todo.remove(q)
            self.step(q, f, preds, set(qual_vars(tuple(todo))))
        if f.df is None:
            f.df = self.spark.range(1).toDF(fresh("one"))
        for p in preds:
            self.where(p, f)
        return f

    def next_of(self, ready: list, todo: list, preds: list, f: Frame) -> Any:
        """The first qualifier, unless it is a relation that nothing links yet and a linked one exists."""
        first = ready[0]
        if f.df is None or not self.closed(first, f):
            return first
        have = set(f.env)
        for q in ready:
            if not self.closed(q, f):
                return q
            own = set(pattern_vars(q.pattern))
            for p in preds:
                if isinstance(p, Bin) and p.op == "==" and not self.nested(p, f.env):
                    a, b = free(p.left), free(p.right)
                    if (a & own and b & have and not (a - own - set(self.globals)) and b <= have | set(self.globals)) or (b & own and a & have and not (b - own - set(self.globals)) and a <= have | set(self.globals)):
                        return q
        return first

    def closed(self, q: Any, f: Frame) -> bool:
        return isinstance(q, Gen) and self.is_relation(q.domain, f.env, True) and not any(isinstance(f.env.get(n), (Col, Rowed)) for n in free(q.domain))

    def step(self, q: Any, f: Frame, preds: list, waiting: set[str]) -> None:
        conds: list[Column] = []
        if isinstance(q, Bind):
            if f.df is None:
                f.df = self.spark.range(1).toDF(fresh("one"))
            if self.is_relation(q.value, f.env) and isinstance(q.pattern, PVar) and not any(isinstance(f.env.get(n), (Col, Rowed)) for n in free(q.value)):
                f.env[q.pattern.name] = Rel(self.relation(q.value, f.env), q.pattern.name)
            else:
                self.bind(q.pattern, self.named(self.value(q.value, f), f), f.env, f, conds)
        elif self.closed(q, f):
            df = self.relation(q.domain, f.env)
            name = q.domain.name if isinstance(q.domain, Var) else "query"
            new = [fresh(c) for c in df.columns]
            v = self.element(df)
            df = df.toDF(*new)
            cols = iter(new)
            v = relabel(v, lambda c: Col(F.col(next(cols)), c.kind))
            if self.lineage:
                mark = fresh("lineage")
                df = df.withColumn(mark, F.struct(F.lit(name).alias("source"), F.to_json(F.struct(*self.output(v))).alias("row")))
                f.trail.append(mark)
            if q.small and small(df):
                df = F.broadcast(df)
            before = f.df
            probe = Frame(df, f.env)
            self.bind(q.pattern, v, f.env, probe, conds)
            for c in conds:
                df = df.filter(c)
            conds = []
            if before is None:
                f.df = df
            else:
                f.df = before.crossJoin(df)  # for the types of what follows; replaced below
                on = [self.column(self.value(p, f)) for p in self.decidable(preds, f, waiting)]
                f.df = before.join(df, on, "inner") if on else before.crossJoin(df)
        else:
            if f.df is None:
                f.df = self.spark.range(1).toDF(fresh("one"))
            v = self.value(q.domain, f)
            if isinstance(v, Rel):
                raise QueryError("a relation that depends on outer variables must be a query")
            kind, new = self.kind(v if not isinstance(v, Py) else Col(self.column(v)), f), fresh("item")
            if not isinstance(kind, T.ArrayType):
                raise QueryError(f"a generator ranges over {kind}, which is no bag")
            f.df = f.df.withColumn(new, F.explode(self.column(v)))
            self.bind(q.pattern, Col(F.col(new), kind.elementType), f.env, f, conds)
        for c in conds:
            f.df = f.df.filter(c)
        for p in self.decidable(preds, f, waiting):
            f.df = f.df.filter(self.column(self.value(p, f)))

    def named(self, v: Any, f: Frame) -> Any:
        """Computed parts as columns, so that later uses don't repeat the expression."""
        if not isinstance(v, (Col, Rowed)):
            return v

        def make(c: Col) -> Col:
            name = fresh("let")
            f.df = f.df.withColumn(name, c.c)
            return Col(F.col(name), c.kind)

        return relabel(v, make)

    def decidable(self, preds: list, f: Frame, waiting: set[str]) -> list:
        out = [p for p in preds if not free(p) & waiting and not self.nested(p, f.env)]
        for p in out:
            preds.remove(p)
        return out

    def where(self, p: Any, f: Frame) -> None:
        """A predicate with nested queries: a semi- or anti-join where it is a quantifier, else a filter on joined results."""
        negated = isinstance(p, Un) and p.op == "!"
        q = p.of if negated else p
        if isinstance(q, Quant) and self.nested(q, f.env):
            every, test = q.every, q.test
            if negated:
                every, test = not every, Un("!", test)
            if self.quantified(Quant(every, q.quals, test), f):
                return
        if isinstance(q, Bin) and q.op == "member" and self.is_relation(q.right, f.env) and not any(isinstance(f.env.get(n), (Col, Rowed)) for n in free(q.right)):
            right = self.relation(q.right, f.env)
            new = [fresh() for _ in right.columns]
            mine = self.value(q.left, f)
            on = [a.eqNullSafe(F.col(b)) for a, b in zip(leaves(mine), new, strict=True)]
            f.df = f.df.join(right.toDF(*new), on, "left_anti" if negated else "left_semi")
            return
        test = self.column(self.value(p, f))  # may join to the frame
        f.df = f.df.filter(test)

    def quantified(self, q: Quant, f: Frame) -> bool:
        flat = self.flat(q.quals)
        outer = {n for n, v in f.env.items() if isinstance(v, (Col, Rowed))}
        bound = set(qual_vars(tuple(flat)))
        tests = [c for x in flat if isinstance(x, Pred) for c in conjuncts(x.test)]
        if any(free(x.domain if isinstance(x, Gen) else x.value) & (outer - bound) for x in flat if not isinstance(x, Pred)):
            return False
        if any(self.nested(t, f.env) for t in [*tests, q.test] if free(t) & (outer - bound)):
            return False
        here = [t for t in tests if not free(t) & (outer - bound)]
        last = [Un("!", q.test)] if q.every else conjuncts(q.test)
        more = [t for t in tests if t not in here]
        if not q.every:
            here += [t for t in last if not free(t) & (outer - bound)]
            last = [t for t in last if free(t) & (outer - bound)]
        inner = self.quals((*[x for x in flat if not isinstance(x, Pred)], *map(Pred, here)), None, {k: v for k, v in f.env.items() if isinstance(v, (Rel, Py))})
        both = Frame(f.df.crossJoin(inner.df), {**f.env, **inner.env})
        on = [self.column(self.value(t, both)) for t in more]
        if q.every:  # an unknown test is no success
            on.append(~F.coalesce(self.column(self.value(q.test, both)), F.lit(False)))
        else:
            on += [self.column(self.value(t, both)) for t in last]
        f.df = f.df.join(inner.df, on or [F.lit(True)], "left_anti" if q.every else "left_semi")
        return True

    # ---- grouping ----
    def grouped(self, s: Select, f: Frame, after: list) -> tuple[Frame, list]:
        """The grouped frame, and the expressions `after` with reductions over lifted variables replaced by aggregates."""
        if s.other is not None:
            return self.cogrouped(s, f, after)
        key = self.value(s.group.key, f)
        g, aggs, new = self.keyed(s.group.pattern, key, f)
        out = [None if e is None else self.lift(e, g, f, aggs) for e in after]
        carry = [F.col(c) for c in f.carry]
        trail = [F.collect_set(F.col(t)).alias(t) for t in f.trail]
        made = f.df.groupBy(*carry, *[c.alias(n) for n, c in new])
        cols = [c.alias(n) for n, (c, _) in aggs.items()] + trail
        g.df = made.agg(*cols) if cols else f.df.select(*carry, *[c.alias(n) for n, c in new]).distinct()
        g.trail = list(f.trail)
        return g, out

    def keyed(self, pattern: Any, key: Any, f: Frame) -> tuple[Frame, dict, list]:
        new: list[tuple[str, Column]] = []

        def make(c: Col) -> Col:
            new.append((fresh("key"), c.c))
            return Col(F.col(new[-1][0]), c.kind or self.kind(c, f))

        keys = relabel(key, make)
        env = {k: v for k, v in f.env.items() if k in f.outer or isinstance(v, (Rel, Py))}
        self.bind(pattern, keys, env, None, [])
        g = Frame(None, env, list(f.carry), set(f.outer))
        pre = dict(f.env)
        self.bind(pattern, key, pre, f, [])
        g.pre = pre
        g.lifted = {k for k, v in f.env.items() if isinstance(v, (Col, Rowed)) and k not in f.outer and k not in pattern_vars(pattern)}
        return g, {}, new

    def lift(self, e: Any, g: Frame, f: Frame, aggs: dict) -> Any:
        pre = Frame(f.df, g.pre)

        def put(c: Column, kind: T.DataType | None = None) -> Var:
            for n, (old, _) in aggs.items():
                if str(old) == str(c):
                    return Var(n)
            n = fresh("agg")
            aggs[n] = (c, kind)
            g.env[n] = Col(F.col(n), kind)
            return Var(n)

        def walk(x: Any, hidden: frozenset = frozenset()) -> Any:
            match x:
                case Method(of, "size" | "length" | "count", ()) | Field(of, "size" | "length" | "count") if isinstance(of, Var) and of.name in g.lifted - hidden:
                    return put(F.count(F.lit(1)), T.LongType())
                case Reduce(op, of) if (found := self.over(of, g.lifted - hidden, pre)) is not None:
                    value, conds = found
                    c = self.column(value)
                    if op == "count":
                        c = F.count(F.lit(1)) if not conds else F.count(F.when(all_of(conds), F.lit(1)))
                        return put(c, T.LongType())
                    m = self.monoid(op)
                    c = m.aggregate(F.when(all_of(conds), c) if conds else c)
                    return put(F.coalesce(c, F.lit(m.zero)) if conds and m.zero is not None else c)
                case Var(n) if n in g.lifted - hidden:
                    v = pre.env[n]
                    return put(F.collect_list(self.column(v)), T.ArrayType(self.kind(v, pre)))
                case Fun(ps, _):
                    hidden |= {v for p in ps for v in pattern_vars(p)}
                case Select():
                    hidden |= set(qual_vars(x.quals))
                    # domains are seen outside; the rest inside
                    quals = tuple(Gen(q.pattern, walk(q.domain, hidden - set(qual_vars(x.quals))), q.small) if isinstance(q, Gen) else rebuilt(q, lambda c: walk(c, hidden)) for q in x.quals)
                    return replace(x, head=walk(x.head, hidden), quals=quals)
                case Quant(_, quals, _):
                    inside = hidden | set(qual_vars(quals))
                    quals = tuple(Gen(q.pattern, walk(q.domain, hidden), q.small) if isinstance(q, Gen) else rebuilt(q, lambda c: walk(c, inside)) for q in quals)
                    return Quant(x.every, quals, walk(x.test, inside))
            return rebuilt(x, lambda c: walk(c, hidden))

        return walk(e)

    def over(self, e: Any, lifted: set[str], pre: Frame) -> tuple | None:
        """(value of one row, conditions) of a bag expression over one lifted variable."""
        match e:
            case Var(n) if n in lifted:
                return pre.env[n], []
            case Field(of, name) if not isinstance(of, Field) and (found := self.over(of, lifted, pre)) is not None:
                inner = Frame(pre.df, {"_bag": found[0]})
                return self.value(Field(Var("_bag"), name), inner), found[1]
            case Method(of, "map", (Fun((p,), body),)):
                return self.over(Select(body, (Gen(p, of),)), lifted, pre)
            case Select(head, quals, False, None, None, None, None, None):
                gens = [q for q in quals if isinstance(q, Gen)]
                if len(gens) != 1 or (found := self.over(gens[0].domain, lifted, pre)) is None:
                    return None
                f = Frame(pre.df, dict(pre.env))
                conds = list(found[1])
                for q in quals:
                    match q:
                        case Gen(p, _):
                            self.bind(p, found[0], f.env, f, conds)
                        case Bind(p, v):
                            self.bind(p, self.value(v, f), f.env, f, conds)
                        case Pred(t):
                            if self.nested(t, f.env):
                                return None
                            conds.append(self.column(self.value(t, f)))
                return None if self.nested(head, f.env) else (self.value(head, f), conds)
        return None

    def cogrouped(self, s: Select, f: Frame, after: list) -> tuple[Frame, list]:
        """Full-outer grouping of two comprehensions; a side without a key is an empty bag there."""
        other = self.quals(s.other, None, {k: v for k, v in f.env.items() if isinstance(v, (Rel, Py))})
        sides, out = [], list(after)
        for frame, group in ((f, s.group), (other, s.other_group)):
            g, aggs, new = self.keyed(group.pattern, self.value(group.key, frame), frame)
            sides.append((frame, g, aggs, new))
            out = [None if e is None else self.lift(e, g, frame, aggs) for e in out]
        done = []
        for frame, _, aggs, new in sides:
            keys = [c.alias(n) for n, c in new]
            cols = [c.alias(n) for n, (c, _) in aggs.items()] or [F.lit(True).alias(fresh("there"))]
            done.append(frame.df.groupBy(*keys).agg(*cols))
        left, right = ([n for n, _ in x[3]] for x in sides)
        on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]
        df = done[0].join(done[1], on, "full_outer")
        zeros = {n: (str(c), k) for x in sides for n, (c, k) in x[2].items()}
        fills = {}
        for n, (said, kind) in zeros.items():
            if "collect_list" in said and kind is not None:
                fills[n] = F.coalesce(F.col(n), F.array().cast(kind))
            elif said.startswith("Column<'count(") or "sum(" in said:
                fills[n] = F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType))
        df = df.withColumns(fills | {a: F.coalesce(F.col(a), F.col(b)) for a, b in zip(left, right, strict=True)})
        g = Frame(df, {**sides[1][1].env, **sides[0][1].env}, list(f.carry), set(f.outer))
        renames = dict(zip(right, left, strict=True))
        g.env = {k: (relabel(v, lambda c: c) if not isinstance(v, Rowed) else v) for k, v in g.env.items()}
        del renames
        return g, out

    # ---- results ----
    def comprehend(self, s: Select, start: Frame | None, env: dict) -> tuple[Frame, Any, list]:
        """(frame, head value, order keys as (value, descending))."""
        f = self.quals(s.quals, start, env)
        head, order = s.head, s.order
        if s.group is not None:
            f, (head, order, having) = self.grouped(s, f, [s.head, s.order, s.having])
            if having is not None:
                for c in conjuncts(having):
                    self.where(c, f)
        keys = []
        for k in order.items if isinstance(order, Tup) else [] if order is None else [order]:
            down = isinstance(k, Desc)
            v = self.value(k.of if down else k, f)
            keys += [(c, down) for c in leaves(v)]
        return f, self.value(head, f), keys

    def output(self, head: Any) -> list[Column]:
        if isinstance(head, Rowed):
            return [self.column(p).alias(n) for n, p in zip(head.names, head.parts, strict=True)]
        return [self.column(head).alias("value")]

    def select(self, s: Select, env: dict | None = None) -> DataFrame:
        if (packed := self.product(s, env or {})) is not None:
            return packed
        f, head, keys = self.comprehend(s, None, env or {})
        cols = self.output(head)
        if self.lineage and f.trail:
            kinds = {c.name: c.dataType for c in f.df.schema}
            marks = [F.col(t) if isinstance(kinds[t], T.ArrayType) else F.array(F.col(t)) for t in f.trail]
            cols.append(F.array_sort(F.array_distinct(F.flatten(F.array(*marks)))).alias("lineage"))
        names = [fresh("order") for _ in keys]
        df = f.df.select(*cols, *[k.alias(n) for (k, _), n in zip(keys, names, strict=True)])
        if s.distinct:
            df = df.dropDuplicates([c for c in df.columns if c not in names])
        if keys:
            df = df.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for (_, d), n in zip(keys, names, strict=True)])
        return df.drop(*names)

    def product(self, s: Select, env: dict, fill: tuple | None = None) -> DataFrame | None:
        """A sum of products over packed rows, where that makes fewer rows than a join."""
        from bagloom.plans.product import dense, split

        if self.lineage or self.monoids["+"] is not STANDARD["+"] or self.monoids["sum"] is not STANDARD["sum"] or (found := split(s)) is None:
            return None
        if not all(isinstance(env.get(q.domain.name, self.globals.get(q.domain.name)), Rel) for side in (found.left, found.right) for q in side.quals if isinstance(q, Gen)):
            return None
        return dense(found, self.relation(found.left, env), self.relation(found.right, env), fill)

    def total(self, e: Any, env: dict | None = None) -> DataFrame:
        """A closed scalar expression as one row with column `value`."""
        frame = Frame(self.spark.range(1).toDF(fresh("one")), dict(env or {}))
        v = self.value(e, frame)
        return frame.df.select(*self.output(v))

    def run(self, e: Any) -> DataFrame:
        """A query's result: a bag, or one row of a scalar."""
        e = self.expand(e)
        if isinstance(e, Repeat):
            out = self.repeat(e, {})
            if isinstance(out, tuple) and any(isinstance(x, (DataFrame, list)) for x in out):
                return tuple(self.local(x) if isinstance(x, list) else x for x in out)
            return out if isinstance(out, DataFrame) else self.local(out) if isinstance(out, list) else self.spark.createDataFrame([out if isinstance(out, tuple) else (out,)], ["value"] if not isinstance(out, tuple) else None)
        if self.is_relation(e, {}, not isinstance(e, (Seq, Field, Method))) or (isinstance(e, Method) and self.is_relation(e, {})):
            return self.relation(e)
        if isinstance(e, Let) and self.is_relation(e.value, {}, True) and isinstance(e.pattern, PVar):
            self.globals = self.globals | {e.pattern.name: Rel(self.relation(e.value), e.pattern.name)}
            return self.run(e.body)
        return self.total(e)

    # ---- nested queries ----
    def hoist(self, e: Any, f: Frame) -> Any:
        """Joins the result of a nested query to the frame; gives its value."""
        mode, op, s = "bag", None, e
        match e:
            case Reduce(o, x):
                mode, op, s = "reduce", o, x
            case Quant(every, quals, test):
                mode, op, s = "reduce", "&&" if every else "||", Select(test, quals)
            case Method(x, "head" | "last" as which, ()) | Field(x, "head" | "last" as which):
                mode, s = which, x
        if not isinstance(s, Select):
            x = fresh("x")
            s = Select(Var(x), (Gen(PVar(x), s),))
        outer = {n for n in free(s) if isinstance(f.env.get(n), (Col, Rowed))}
        closed = {k: v for k, v in f.env.items() if isinstance(v, (Rel, Py))}
        name = fresh("nested")
        if not outer:
            g, head, keys = self.comprehend(s, None, closed)
            one = g.df.agg(self.gathered(mode, op, head, keys, s, g).alias(name))
            f.df = f.df.crossJoin(F.broadcast(one))  # one row
            return self.filled(mode, op, name, one, f)
        flat = self.flat(s.quals)
        tests = [c for q in flat if isinstance(q, Pred) for c in conjuncts(q.test)]
        rest = [q for q in flat if not isinstance(q, Pred)]
        pairs = []
        for t in tests:
            if free(t) & outer:
                match t:
                    case Bin("==", a, b) if free(a) & outer and not free(b) & outer and not free(a) & set(qual_vars(tuple(rest))):
                        pairs.append((t, a, b))
                    case Bin("==", a, b) if free(b) & outer and not free(a) & outer and not free(b) & set(qual_vars(tuple(rest))):
                        pairs.append((t, b, a))
        left = [t for t in tests if not any(t is p[0] for p in pairs)]
        pure = replace(s, quals=(*rest, *map(Pred, left)))
        if pairs and not free(pure) & outer:
            inner = self.quals(pure.quals, None, closed)
            keys = []
            for _, _, b in pairs:
                k = fresh("on")
                inner.df = inner.df.withColumn(k, self.column(self.value(b, inner)))
                keys.append(k)
            inner.carry = keys
            inner = self.finish(pure, inner, mode, op, name, keys)
            on = [self.column(self.value(a, f)) == F.col(k) for (_, a, _), k in zip(pairs, keys, strict=True)]
            f.df = f.df.join(inner, on, "left").drop(*keys)
            return self.filled(mode, op, name, inner, f)
        # the distinct outer values that the query depends on
        need = {n: self.used(s, n, f.env[n]) for n in sorted(outer)}
        start, env, back = [], {}, []
        for n, v in need.items():

            def make(c: Col) -> Col:
                k = fresh("outer")
                start.append(c.c.alias(k))
                back.append((c.c, k))
                return Col(F.col(k), c.kind or self.kind(c, f))

            env[n] = relabel(v, make)
        keys = [k for _, k in back]
        inner = Frame(f.df.select(*start).distinct(), {**closed, **env}, list(keys), set(env))
        inner = self.quals(s.quals, inner, {})
        done = self.finish(s, inner, mode, op, name, keys)
        again = [fresh("back") for _ in keys]
        done = done.withColumnsRenamed(dict(zip(keys, again, strict=True)))
        f.df = f.df.join(done, [c.eqNullSafe(F.col(b)) for (c, _), b in zip(back, again, strict=True)], "left").drop(*again)
        return self.filled(mode, op, name, done, f)

    def used(self, e: Any, name: str, v: Any) -> Any:
        """The parts of a row variable that e uses."""
        if not isinstance(v, Rowed):
            return v
        found: set[str] = set()

        def walk(x: Any) -> bool:
            match x:
                case Field(Var(n), part) if n == name:
                    found.add(part)
                    return True
                case Var(n) if n == name:
                    return False
            return all(walk(c) for c in children(x))

        if not walk(e):
            return v
        keep = [(n, p) for i, (n, p) in enumerate(zip(v.names, v.parts, strict=True)) if n in found or f"_{i + 1}" in found]
        return Rowed(tuple(n for n, _ in keep), tuple(p for _, p in keep)) if keep and all(n in v.names for n in found) else v

    def finish(self, s: Select, f: Frame, mode: str, op: str | None, name: str, keys: list[str]) -> DataFrame:
        head, order = s.head, s.order
        if s.group is not None:
            f, (head, order, having) = self.grouped(s, f, [s.head, s.order, s.having])
            if having is not None:
                self.where(having, f)
        sort = []
        for k in order.items if isinstance(order, Tup) else [] if order is None else [order]:
            sort += [(c, isinstance(k, Desc)) for c in leaves(self.value(k.of if isinstance(k, Desc) else k, f))]
        value = self.value(head, f)
        return f.df.groupBy(*keys).agg(self.gathered(mode, op, value, sort, s, f).alias(name))

    def gathered(self, mode: str, op: str | None, head: Any, keys: list, s: Select, f: Frame) -> Column:
        c = self.column(head)
        if mode == "reduce":
            return F.count(F.lit(1)) if op == "count" else self.monoid(op).aggregate(c)
        if mode in ("head", "last"):
            if not keys:
                return F.first(c) if mode == "head" else F.last(c)
            by = F.struct(*(k for k, _ in keys))
            down = {d for _, d in keys}
            if len(down) > 1:
                raise QueryError("head of a mixed order")
            return F.min_by(c, by) if (mode == "head") != down.pop() else F.max_by(c, by)
        if s.distinct:
            return F.collect_set(c)
        if keys:
            if len({d for _, d in keys}) > 1:
                raise QueryError("a nested bag in mixed order")
            made = F.collect_list(F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(keys)), c.alias("v")))
            return F.transform(F.sort_array(made, not keys[0][1]), lambda x: x.getField("v"))
        return F.collect_list(c)

    def filled(self, mode: str, op: str | None, name: str, inner: DataFrame, f: Frame) -> Col:
        kind, c = inner.schema[name].dataType, F.col(name)
        if mode == "bag":
            c = F.coalesce(c, F.array().cast(kind))
        elif mode == "reduce":
            zero = 0 if op == "count" else self.monoid(op).zero
            c = c if zero is None else F.coalesce(c, F.lit(zero).cast(kind))
        return Col(c, kind)

    def monoid(self, op: str) -> Monoid:
        if op not in self.monoids:
            raise QueryError(f"unknown monoid {op}")
        return self.monoids[op]

    # ---- values ----
    def value(self, e: Any, f: Frame) -> Any:
        match e:
            case Lit(v):
                return Col(F.lit(v), {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}[type(v)] if not (isinstance(v, int) and abs(v) >= 1 << 31) else T.LongType())
            case Var(n):
                v = f.env.get(n, self.globals.get(n))
                if v is None:
                    raise QueryError(f"unknown name {n}")
                if isinstance(v, Py) and isinstance(v.value, (bool, int, float, str)):
                    return self.value(Lit(v.value), f)
                return v
            case Tup(items):
                return Rowed(tuple(f"_{i + 1}" for i in range(len(items))), tuple(self.part(x, f) for x in items))
            case Rec(items):
                return Rowed(tuple(n for n, _ in items), tuple(self.part(x, f) for _, x in items))
            case Seq(items):
                return Col(F.array(*(self.column(self.value(x, f)) for x in items)))
            case Field(of, name):
                return self.field(of, name, f, e)
            case Method(of, name, args):
                return self.method(of, name, args, f, e)
            case Call(name, args):
                return self.call(name, args, f)
            case Bin(op, a, b):
                return self.binary(op, a, b, f)
            case Un("!", a):
                return Col(~self.column(self.value(a, f)), T.BooleanType())
            case Un(op, a):
                v = self.value(a, f)
                return Col(-self.column(v), v.kind) if op == "-" else v
            case If(test, a, b):
                return self.either(self.column(self.value(test, f)), self.value(a, f), self.value(b, f))
            case Let(p, v, body):
                inner = Frame(f.df, dict(f.env), f.carry, f.outer, f.trail)
                self.bind(p, self.value(v, inner), inner.env, inner, [])
                out = self.value(body, inner)
                f.df = inner.df
                return out
            case Match(of, cases):
                return self.matched(self.value(of, f), cases, f)
            case Reduce(op, of):
                if self.is_relation(of, f.env) or (isinstance(of, Select) and (self.nested(of, f.env) or not self.simple(of))):
                    return self.hoist(e, f)
                a = self.array(of, f)
                if op in ("+", "sum", "*", "product"):
                    kind = getattr(f.df.select(a).schema[0].dataType, "elementType", None)
                    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
                        plus = op in ("+", "sum")
                        return Col(F.aggregate(a, F.lit(0 if plus else 1).cast("long"), lambda x, y: x + y if plus else x * y), T.LongType())
                return Col(self.monoid(op).fold(a), T.LongType() if op == "count" else None)
            case Select():
                return Col(self.array(e, f)) if not self.nested(e, f.env) and self.simple(e) else self.hoist(e, f)
            case Quant(every, quals, test):
                gens = [q for q in quals if isinstance(q, Gen)]
                if self.nested(e, f.env) or len(gens) != 1:
                    return self.hoist(e, f)
                a = self.value(gens[0].domain, f)
                item = getattr(self.kind(a, f) if isinstance(a, Col) else None, "elementType", None)

                def inside(x: Column) -> Column:
                    g, conds = Frame(f.df, dict(f.env)), []
                    self.bind(gens[0].pattern, Col(x, item), g.env, g, conds)
                    conds += [self.column(self.value(q.test, g)) for q in quals if isinstance(q, Pred)]
                    t = self.column(self.value(test, g))
                    return (~all_of(conds) | t if conds else t) if every else all_of([*conds, t])

                c = self.column(a)
                return Col(F.forall(c, inside) if every else F.exists(c, inside), T.BooleanType())
        raise QueryError(f"no value: {e}")

    def part(self, e: Any, f: Frame) -> Any:
        v = self.value(e, f)
        return Col(self.column(v)) if isinstance(v, Py) else v

    def simple(self, s: Select) -> bool:
        return len([q for q in s.quals if isinstance(q, Gen)]) == 1 and not (s.group or s.order or s.distinct)

    def array(self, e: Any, f: Frame) -> Column:
        """An array-valued expression over values of the row, by higher-order functions."""
        if not isinstance(e, Select):
            return self.column(self.value(e, f))
        (gen,) = [q for q in e.quals if isinstance(q, Gen)]
        v = self.value(gen.domain, f)
        a = self.column(v)
        item = getattr(self.kind(v, f) if isinstance(v, Col) else f.df.select(a).schema[0].dataType, "elementType", None)

        def frame(x: Column) -> tuple[Frame, list]:
            g, conds = Frame(f.df, dict(f.env)), []
            for q in e.quals:
                match q:
                    case Gen(p, _):
                        self.bind(p, Col(x, item), g.env, g, conds)
                    case Bind(p, y):
                        self.bind(p, self.value(y, g), g.env, g, conds)
                    case Pred(t):
                        conds.append(self.column(self.value(t, g)))
            return g, conds

        plain = isinstance(gen.pattern, (PVar, PAny)) and not any(isinstance(q, Pred) for q in e.quals)
        kept = a if plain else F.filter(a, lambda x: all_of(frame(x)[1] or [F.lit(True)]))
        return F.transform(kept, lambda x: self.column(self.value(e.head, frame(x)[0])))

    def either(self, test: Column, a: Any, b: Any) -> Any:
        if isinstance(a, Rowed) and isinstance(b, Rowed) and a.names == b.names:
            return Rowed(a.names, tuple(self.either(test, x, y) for x, y in zip(a.parts, b.parts, strict=True)))
        return Col(F.when(test, self.column(a)).otherwise(self.column(b)), getattr(a, "kind", None))

    def matched(self, v: Any, cases: tuple, f: Frame) -> Any:
        """The first case that fits; NULL where none does."""
        out = None
        for p, guard, body in reversed(cases):
            g, conds = Frame(f.df, dict(f.env)), []
            self.bind(p, v, g.env, g, conds)
            if guard is not None:
                conds.append(self.column(self.value(guard, g)))
            b = self.value(body, g)
            out = b if not conds else Col(F.when(all_of(conds), self.column(b)), getattr(b, "kind", None)) if out is None else self.either(F.coalesce(all_of(conds), F.lit(False)), b, out)
        return out

    def field(self, of: Any, name: str, f: Frame, e: Any) -> Any:
        if isinstance(of, Select) and name in ("head", "last"):
            if self.nested(of, f.env):
                return self.hoist(e, f)
            return self.first_of(of, name, f)
        v = self.value(of, f)
        if isinstance(v, Rowed):
            if name in v.names:
                return v.parts[v.names.index(name)]
            if name[0] == "_" and name[1:].isdigit() and int(name[1:]) <= len(v.parts):
                return v.parts[int(name[1:]) - 1]
            raise QueryError(f"no field {name} among {v.names}")
        if isinstance(v, Py):
            if isinstance(v.value, (tuple, Row)) and name[0] == "_":
                return Py(v.value[int(name[1:]) - 1])
            if hasattr(v.value, name) and not isinstance(v.value, list):
                return self.bound(name, getattr(v.value, name))
        kind = self.kind(v, f) if isinstance(v, Col) else None
        if name in self.alone and isinstance(kind, T.AtomicType):
            return v
        if isinstance(kind, T.StructType):
            if name not in kind.names and name[0] == "_" and name[1:].isdigit():
                name = kind.names[int(name[1:]) - 1]
            if name in kind.names:
                return Col(v.c.getField(name), kind[name].dataType)
        if name in METHODS:
            return Col(METHODS[name](self.column(v)))
        return Col(self.column(v).getField(name))

    def first_of(self, s: Select, which: str, f: Frame) -> Col:
        """The element of a local bag with the least (or greatest) order key."""
        if s.order is None:
            return Col(METHODS[which](self.array(s, f)))
        keys = s.order.items if isinstance(s.order, Tup) else (s.order,)
        down = isinstance(keys[0], Desc)
        pair = replace(s, head=Rec((("k", Tup(tuple(k.of if isinstance(k, Desc) else k for k in keys))), ("v", s.head))), order=None)
        a = self.array(pair, f)
        least = F.array_min(a) if (which == "head") != down else F.array_max(a)
        return Col(least.getField("v"))

    def method(self, of: Any, name: str, args: tuple, f: Frame, e: Any) -> Any:
        if isinstance(of, Var) and of.name in ("Math", "math") and of.name not in f.env:
            return self.call({"max": "greatest", "min": "least"}.get(name, name), args, f)
        if name in ("head", "last") and not args:
            return self.field(of, name, f, Field(of, name))
        if self.is_relation(of, f.env):
            match name, args:
                case ("map", (Fun((p,), body),)):
                    return self.value(Select(body, (Gen(p, of),)), f)
                case ("filter", (Fun((p,), body),)):
                    x = fresh("x")
                    return self.value(Select(Var(x), (Gen(PAs(x, p), of), Pred(body))), f)
                case ("count" | "size" | "length", ()):
                    return self.value(Reduce("count", of), f)
                case ("sum", ()):
                    return self.value(Reduce("+", of), f)
            raise QueryError(f"a bag has no method {name}")
        v = self.value(of, f)
        if name in ("map", "filter", "exists", "forall", "reduce"):
            a = self.column(v)
            item = getattr(f.df.select(a).schema[0].dataType, "elementType", None)
            fun = args[0]

            def body(*xs: Column) -> Column:
                if not isinstance(fun, Fun):
                    return self.column(self.call(fun.name, tuple(xs), f))
                g = Frame(f.df, dict(f.env))
                for p, x in zip(fun.params, xs, strict=True):
                    self.bind(p, Col(x, item), g.env, g, [])
                return self.column(self.value(fun.body, g))

            if name == "reduce":
                rest = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
                step = body if isinstance(fun, Fun) else lambda x, y: FUNCTIONS[{"min": "least", "max": "greatest"}[fun.name]](x, y)
                return Col(F.aggregate(rest, F.get(a, F.lit(0)), lambda x, y: step(x, y)), item)
            made = {"map": F.transform, "filter": F.filter, "exists": F.exists, "forall": F.forall}[name]
            return Col(made(a, lambda x: body(x)))
        if isinstance(v, Py) and hasattr(v.value, name):
            return self.bound(name, getattr(v.value, name)(*(self.column(self.value(a, f)) for a in args)))
        if name not in METHODS:
            raise QueryError(f"unknown method {name}")
        return Col(METHODS[name](self.column(v), *(self.column(self.value(a, f)) for a in args)))

    def call(self, name: str, args: tuple, f: Frame) -> Any:
        if name == "trace":
            self.traced.append(str(args[0]))
            return self.value(args[0], f)
        if name == "range":
            return Col(F.sequence(*(self.column(self.value(a, f)) for a in args)))
        values = [Col(a) if isinstance(a, Column) else self.value(a, f) for a in args]
        bound = f.env.get(name, self.globals.get(name))
        if isinstance(bound, Py) and callable(bound.value):
            if isinstance(bound.value, type):  # a constructor
                names = getattr(bound.value, "_fields", None) or tuple(getattr(bound.value, "__dataclass_fields__", ()))
                return Rowed(tuple(names), tuple(values))
            return self.bound(name, bound.value(*(self.column(v) for v in values)))
        if name in self.functions:
            return self.bound(name, self.functions[name](*(self.column(v) for v in values)))
        if name in self.monoids and self.monoids[name].combine and len(values) == 2:
            return Col(self.monoids[name].combine(*(self.column(v) for v in values)))
        if name[0].isupper():
            return Rowed(tuple(f"_{i + 1}" for i in range(len(values))), tuple(values))
        raise QueryError(f"unknown function {name}")

    def binary(self, op: str, a: Any, b: Any, f: Frame) -> Any:
        if op == "member":
            if self.is_relation(b, f.env):
                x = fresh("x")
                return self.value(Quant(False, (Gen(PVar(x), b),), Bin("==", Var(x), a)), f)
            return Col(F.array_contains(self.column(self.value(b, f)), self.column(self.value(a, f))), T.BooleanType())
        x, y = (v.parts[0] if isinstance(v, Only) else v for v in (self.value(a, f), self.value(b, f)))
        if op in ("==", "!=") and isinstance(x, Rowed) and isinstance(y, Rowed) and len(x.parts) == len(y.parts):
            same = all_of([p == q for p, q in zip(leaves(x), leaves(y), strict=True)])
            return Col(same if op == "==" else ~same, T.BooleanType())
        c, d = self.column(x), self.column(y)
        text = lambda v: isinstance(v, Col) and isinstance(v.kind, T.StringType)
        match op:
            case "+" if text(x) or text(y) or isinstance(self.kind(x, f), T.StringType):
                return Col(F.concat(c.cast("string"), d.cast("string")), T.StringType())
            case "+":
                return Col(c + d)
            case "-":
                return Col(c - d)
            case "*":
                return Col(c * d)
            case "/":
                if self.whole(x, f) and self.whole(y, f):
                    kind = "int" if isinstance(self.kind(x, f), T.IntegerType) and isinstance(self.kind(y, f), T.IntegerType) else "long"
                    return Col(F.try_divide(c - F.try_mod(c, d), d).cast(kind))
                return Col(F.try_divide(c.cast("double"), d.cast("double")), T.DoubleType())
            case "%":
                return Col(c % d)
            case "==" | "=":
                return Col(c == d, T.BooleanType())
            case "!=":
                return Col(c != d, T.BooleanType())
            case "<" | "<=" | ">" | ">=":
                return Col({"<": c < d, "<=": c <= d, ">": c > d, ">=": c >= d}[op], T.BooleanType())
            case "&&" | "&":
                return Col(c & d, T.BooleanType())
            case "||" | "|":
                return Col(c | d, T.BooleanType())
            case "::":
                return Col(F.concat(F.array(c), d))
            case "++" | "union":
                return Col(F.concat(c, d))
            case "intersect":
                return Col(F.filter(c, lambda v: F.array_contains(d, v)))
            case "minus":
                return Col(F.filter(c, lambda v: ~F.array_contains(d, v)))
            case "^" if "^" in self.monoids:
                return Col(self.monoids["^"].combine(c, d))
            case "^":
                return Col((c | d) & ~(c & d), T.BooleanType())
        raise QueryError(f"unknown operator {op}")

    # ---- iteration ----
    def repeat(self, e: Repeat, env: dict) -> Any:
        """Do-while: the step runs at least once; `until` sees the state as it was before the step."""
        limit = int(self.scalar(e.limit, env)) if e.limit is not None else 1 << 31
        # what the steps read again is staged once, unless it is a plain scan
        for n in sorted(free(e)):
            if isinstance(v := env.get(n, self.globals.get(n)), Rel) and not self.lineage and heavy(v.df):
                env = env | {n: self.bound(n, staged(v.df))}
        parts = e.pattern.items if isinstance(e.pattern, PTup) else None
        starts = e.start.items if parts and isinstance(e.start, Tup) else (e.start,)
        names = [p.name for p in parts] if parts else [e.pattern.name]
        state = [self.state(x, env) for x in starts]
        local = [isinstance(s, list) for s in state]
        for _ in range(limit):
            now = env | {n: self.bound(n, s) for n, s in zip(names, state, strict=True)}
            steps = e.step.items if parts and isinstance(e.step, Tup) else (e.step,)
            new = [self.state(x, now, keep) for x, keep in zip(steps, local, strict=True)]
            stop = e.until is not None and bool(self.scalar(e.until, now))
            state = new
            if stop:
                break
        return tuple(state) if parts else state[0]

    def state(self, e: Any, env: dict, local: bool | None = None) -> Any:
        """A loop's state: a staged table, a local list (if it began as one), or a scalar."""
        if isinstance(e, Var) and isinstance(v := env.get(e.name, self.globals.get(e.name)), Py):
            return v.value
        if isinstance(e, Seq) or (local and not self.is_relation(e, env)):
            return [self.item(r) for r in self.exploded_rows(e, env)]
        if self.is_relation(e, env, True):
            df = self.relation(e, env)
            return [self.item(r) for r in df.collect()] if local else staged(df)
        return self.scalar(e, env)

    def exploded_rows(self, e: Any, env: dict) -> list:
        frame = Frame(self.spark.range(1).toDF(fresh("one")), dict(env))
        return self.exploded(frame.df.select(F.explode(self.column(self.value(e, frame))).alias("value"))).collect()

    @staticmethod
    def item(r: Row) -> Any:
        return r[0] if list(r.asDict()) == ["value"] else r


def all_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def indexed(df: DataFrame, start: int = 0) -> DataFrame:
    """(i, row columns): positions in the order of the rows' partitions.

    The rows are staged with Spark's ids (partition and place in it), so that a partition that is
    computed again keeps its numbers; one count per partition then gives the offsets.
    """
    mark, part, before = fresh("id"), fresh("part"), fresh("before")
    rows = staged(df.withColumn(mark, F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright(mark, 33).alias(part)).agg(F.count(F.lit(1)).alias(before))
    # one row per partition
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    place = F.col(before) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    return rows.join(F.broadcast(offsets), F.shiftright(mark, 33) == F.col(part)).select(place.alias("i"), *(rows[c] for c in df.columns))
