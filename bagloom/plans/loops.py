"""Loop programs as bulk operations on arrays.

A vector is a DataFrame (i, v), a matrix (i, j, v), a map (k, v); all are sparse, and a
missing cell drops the iterations that read it. An assignment under loops becomes one
comprehension over its generators: array reads are generators with equal indices, so
Catalyst joins them; loops over index ranges vanish where an array read has the index (or
an invertible function of it) as its own key, leaving a filter; equal reads share one
generator; a group-by whose key has all indices is dropped. Increments are merged into the
old array by a full outer join, updates win over old cells. A loop over a block runs the
block's statements one after the other, each in bulk.

Deviations from sequential loops, all by definition: two different values for one cell in
one bulk update give the greatest; integer division truncates; a `while` stages changed
arrays once a round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagloom.lang.loops import parse_loops
from bagloom.lang.tree import (
    Assign, Bin, Bind, Block, Call, Declare, Def, Do, Field, For, Foreach, Gen, Group, IfS, Index, Let, Lit, Method, PAny, Pred, PTup, PVar, QueryError, Rec, Reduce, Return, Select, Tup, Un, Var, While, children, free, rebuilt, substitute,
)
from bagloom.plans.lower import Lowering, fresh
from bagloom.sources.staging import heavy, staged

SCALARS = {"Int": "int", "Long": "bigint", "Double": "double", "Float": "float", "Boolean": "boolean", "String": "string"}
PYTHON = {"Int": int, "Long": int, "Double": float, "Float": float, "Boolean": bool, "String": str}
DEFAULTS = {"Int": 0, "Long": 0, "Double": 0.0, "Float": 0.0, "Boolean": False}
ARRAYS = {"vector": ("i", "v"), "matrix": ("i", "j", "v"), "map": ("k", "v")}


@dataclass
class Array:
    kind: str
    df: DataFrame | None  # None: empty, without a type so far
    item: tuple | None = None
    fill: tuple | None = None  # (ends of each index, value) of an array that has this value in all its cells
    cover: tuple | None = None  # ends of each index between which all cells are there
    origins: frozenset = frozenset()  # what its cells' keys come from: marks of statements, or None
    made: tuple | None = None  # the one statement that all its cells come from: (variables, ends, value, the arrays and scalars it has read)

    @property
    def names(self) -> tuple[str, ...]:
        return ARRAYS[self.kind]


@dataclass(frozen=True)
class Range:
    var: str
    low: Any
    high: Any
    step: Any


class Loops:
    """Runs statements; `query` gives the DataFrame of a comprehension and may be replaced by another back end."""

    def __init__(self, spark: SparkSession, bindings: dict[str, Any], session: Any):
        self.spark, self.session = spark, session
        self.vars: dict[str, Any] = {}
        self.kinds: dict[str, tuple] = {}
        self.defs: dict[str, tuple] = {}
        self.printed: list[Any] = []
        self.changed: set[str] = set()
        self.inside = False  # a while loop
        self.emptied = False  # an array was assigned whole, so that keys may have gone
        shapes = {names: kind for kind, names in ARRAYS.items()}
        for k, v in bindings.items():
            kind = shapes.get(tuple(v.columns)) if isinstance(v, DataFrame) else None
            self.vars[k] = Array(kind, v) if kind else v

    # ---- back end ----
    def lowering(self) -> Lowering:
        bound = {k: (v.df if isinstance(v, Array) else v) for k, v in self.vars.items() if not (isinstance(v, Array) and v.df is None)}
        return Lowering(self.spark, bound, self.session.macros, self.session.monoids, self.session.functions)

    def query(self, s: Select) -> DataFrame:
        return self.lowering().relation(s)

    def product(self, s: Select, fill: tuple) -> DataFrame | None:
        """A filled matrix after an increment by sums of products, without a join of the cells."""
        return self.lowering().product(s, {}, fill)

    def total(self, op: str, s: Select) -> Any:
        low = self.lowering()
        row = low.total(Reduce(op, s)).first()
        return row[0] if len(row) == 1 else tuple(row)

    def scalar(self, e: Any) -> Any:
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, Var) and not isinstance(self.vars.get(e.name), (Array, DataFrame)) and e.name in self.vars:
            return self.vars[e.name]
        found = simple(e, self.vars)
        if found is not None:
            return found
        row = self.lowering().total(e).first()
        return row[0] if len(row) == 1 else tuple(row)

    # ---- statements ----
    def run(self, s: Any, around: tuple = ()) -> None:
        match s:
            case Block(items):
                for x in items:
                    self.run(x, around)
            case Declare(n, kind, value, external):
                self.kinds[n] = kind
                self.emptied |= isinstance(self.vars.get(n), Array)
                if external:
                    self.adopt(n, kind)
                elif kind[0] in ARRAYS and (value is None or value == Call(kind[0], ())):
                    self.vars[n] = Array(kind[0], None, kind[-1])
                elif kind[0] in ARRAYS and isinstance(value, Call) and value.name == kind[0]:
                    rows = [[self.scalar(y) for y in (x.items[0].items if isinstance(x.items[0], Tup) else (x.items[0],))] + [self.scalar(y) for y in x.items[1:]] for x in value.args]
                    made = self.spark.createDataFrame([tuple(r) for r in rows], list(ARRAYS[kind[0]]))
                    keys = [F.col(c).cast("long").alias(c) if kind[0] != "map" else F.col(c) for c in ARRAYS[kind[0]][:-1]]
                    cast = SCALARS.get(kind[-1][0])
                    self.vars[n] = Array(kind[0], made.select(*keys, F.col("v").cast(cast).alias("v") if cast else F.col("v")), kind[-1])
                elif kind[0] in ARRAYS and isinstance(value, Var) and isinstance(self.vars.get(value.name), Array):
                    self.vars[n] = self.vars[value.name]
                else:
                    self.vars[n] = DEFAULTS.get(kind[0]) if value is None else self.typed(n, self.scalar(self.sized(self.inlined(value))))
            case For(v, low, high, step, body):
                self.run(body, (*around, Range(v, self.sized(self.inlined(low)), self.sized(self.inlined(high)), self.sized(self.inlined(step)))))
            case Foreach(v, domain, body):
                self.run(body, (*around, Foreach(v, self.inlined(domain), None)))
            case IfS(test, then, other):
                test = self.inlined(test)
                if around:
                    self.run(then, (*around, Pred(test)))
                    self.run(other, (*around, Pred(Un("!", test))))
                else:
                    self.run(then if self.scalar(test) else other)
            case While(test, body):
                if around:
                    raise QueryError("a while loop inside a bulk loop")
                self.prepare(body)
                outer, self.inside = self.inside, True
                while bool(self.scalar(self.sized(self.inlined(test)))):
                    self.changed = set()
                    self.run(body)
                    for n in sorted(self.changed):
                        if self.vars[n].made is None:
                            self.settled(n)
                self.inside = outer
            case Def(n, params, _, body):
                self.defs[n] = (tuple(p for p, _ in params), self.body(body))
            case Return():
                raise QueryError("return stands in functions only")
            case Do(e):
                self.do(e)
            case Assign(target, op, value):
                self.assign(self.inlined(target), op, self.sized(self.inlined(value)), around)

    def prepare(self, body: Any) -> None:
        """What a loop reads again in each round is staged once, unless it is a plain scan."""
        for n in sorted(names_in(body)):
            v = self.vars.get(n)
            df = v.df if isinstance(v, Array) else v
            if isinstance(df, DataFrame) and heavy(df):
                self.vars[n] = replace(v, df=staged(df)) if isinstance(v, Array) else staged(df)

    def settled(self, n: str) -> None:
        """Stages an array that this round has changed."""
        self.vars[n] = replace(self.vars[n], df=staged(self.vars[n].df))
        self.changed.discard(n)

    def do(self, e: Any) -> None:
        match e:
            case Call("println" | "print", args):
                self.printed += [self.vars[a.name].df if isinstance(a, Var) and isinstance(self.vars.get(a.name), Array) else self.scalar(self.inlined(a)) for a in args]
            case Method(Var(n), "foreach", _) if n in self.vars:
                v = self.vars[n]
                self.printed.append(v.df if isinstance(v, Array) else v)
            case _:
                self.printed.append(self.scalar(self.inlined(e)))

    def body(self, s: Any) -> Any:
        """A function's statements as one expression."""
        items = s.items if isinstance(s, Block) else (s,)
        if not items or not isinstance(items[-1], Return):
            raise QueryError("a function ends in return")
        out = items[-1].value
        for x in reversed(items[:-1]):
            match x:
                case Declare(n, _, value, False) if value is not None:
                    out = Let(PVar(n), value, out)
                case Assign(Var(n), op, value):
                    out = Let(PVar(n), value if op is None else Bin(op, Var(n), value), out)
                case _:
                    raise QueryError("a function has declarations, assignments of its own variables and return")
        return out

    def inlined(self, e: Any) -> Any:
        e = rebuilt(e, self.inlined)
        if isinstance(e, Call) and e.name in self.defs:
            params, body = self.defs[e.name]
            if len(params) != len(e.args):
                raise QueryError(f"{e.name} takes {len(params)} arguments")
            return self.inlined(substitute(body, dict(zip(params, e.args, strict=True))))
        return e

    def sized(self, e: Any) -> Any:
        """Lengths and counts of arrays as numbers."""
        match e:
            case Field(Var(n), "length" | "rows" | "cols" as what) if isinstance(self.array(n), Array):
                a = self.array(n)
                key = a.names[1] if what == "cols" else a.names[0]
                return Lit(int((a.df.agg(F.max(key)).first()[0] if a.df is not None else None) or -1) + 1 if a.df is not None else 0)
            case Method(Var(n), "count", ()) if isinstance(self.vars.get(n), (Array, DataFrame)):
                v = self.vars[n]
                return Lit((v.df if isinstance(v, Array) else v).count())
        return rebuilt(e, self.sized)

    def adopt(self, n: str, kind: tuple) -> None:
        v = self.vars.get(n)
        if kind[0] in ARRAYS and isinstance(v, DataFrame):
            self.vars[n] = Array(kind[0], flat_keys(v, kind[0]), kind[-1])

    def array(self, n: str, width: int | None = None) -> Any:
        v = self.vars.get(n)
        if isinstance(v, DataFrame) and width is not None:
            self.vars[n] = v = Array("matrix" if width == 2 else "vector", flat_keys(v, "matrix" if width == 2 else "vector"))
        return v

    # ---- comprehensions ----
    def comprehension(self, around: tuple, parts: list[Any]) -> tuple[tuple, list[Any], set[str]]:
        """(qualifiers, the parts with reads replaced, variables that determine an iteration)."""
        quals: list[Any] = []
        pending: dict[str, Range] = {}
        seen: dict[tuple, str] = {}
        indices: set[str] = set()
        many = False

        def settle(r: Range, at: Any) -> list[Any]:
            tests = [Bin(">=", at, r.low), Bin("<=", at, r.high)]
            if r.step != Lit(1):
                tests.append(Bin("==", Bin("%", Bin("-", at, r.low), r.step), Lit(0)))
            return [Pred(t) for t in tests]

        def invert(e: Any) -> tuple[str, Callable[[Any], Any], Callable[[Any], Any] | None] | None:
            """(range variable, its value from the index, a further test) of an invertible index."""
            match e:
                case Bin("+", Var(i), c) | Bin("+", c, Var(i)) if i in pending and not free(c) & (set(pending) | indices):
                    return i, lambda k: Bin("-", k, c), None
                case Bin("-", Var(i), c) if i in pending and not free(c) & (set(pending) | indices):
                    return i, lambda k: Bin("+", k, c), None
                case Bin("-", c, Var(i)) if i in pending and not free(c) & (set(pending) | indices):
                    return i, lambda k: Bin("-", c, k), None
                case Bin("*", Var(i), Lit(c)) | Bin("*", Lit(c), Var(i)) if i in pending and isinstance(c, int) and c:
                    return i, lambda k: Bin("/", k, Lit(c)), lambda k: Bin("==", Bin("%", k, Lit(c)), Lit(0))
            return None

        def read(a: str, at: tuple) -> Any:
            at = tuple(walk(x) for x in at)
            if (a, at) in seen:
                return Var(seen[a, at])
            array = self.array(a, len(at))
            if not isinstance(array, Array):
                raise QueryError(f"{a} is no array")
            if len(at) + 1 != len(array.names):
                raise QueryError(f"{a} has {len(array.names) - 1} indices")
            if array.df is None:
                raise QueryError(f"{a} is read before anything is stored in it")
            if (inner := self.definition(array, at)) is not None:
                v = fresh(f"{a}_v")
                inner, tests = walk(inner[0]), inner[1]
                quals.extend((Bind(PVar(v), inner), *map(Pred, tests)))
                seen[a, at] = v
                return Var(v)
            if self.inside and a in self.changed:
                self.settled(a)
            keys, more = [], []
            for e in at:
                if isinstance(e, Var) and e.name in pending:
                    r = pending.pop(e.name)
                    keys.append(PVar(e.name))
                    indices.add(e.name)
                    more += settle(r, e)
                elif (found := invert(e)) is not None:
                    i, back, test = found
                    k = fresh("k")
                    r = pending.pop(i)
                    keys.append(PVar(k))
                    indices.add(i)
                    if test:
                        more.append(Pred(test(Var(k))))
                    more += [Bind(PVar(i), back(Var(k))), *settle(r, Var(i))]
                else:
                    k = fresh("k")
                    keys.append(PVar(k))
                    more.append(Pred(Bin("==", Var(k), e)))
            v = fresh(f"{a}_v")
            quals.append(Gen(PTup((*keys, PVar(v))), Var(a)))
            quals.extend(more)
            seen[a, at] = v
            return Var(v)

        def cell(e: Any) -> Any:
            """The bag of a cell: one value or none."""
            a, at = e.of.name, tuple(walk(x) for x in e.at)
            if not isinstance(self.array(a, len(at)), Array):
                raise QueryError(f"{a} is no array")
            keys, v = [fresh("k") for _ in at], fresh("v")
            return Select(Var(v), (Gen(PTup((*map(PVar, keys), PVar(v))), Var(a)), *(Pred(Bin("==", Var(k), x)) for k, x in zip(keys, at, strict=True))))

        def walk(e: Any) -> Any:
            match e:
                case Call("exists", (Index(Var(a), _) as x,)):
                    return Lit(False) if self.array(a).df is None else Bin(">", Reduce("count", cell(x)), Lit(0))
                case Call("default", (Index(Var(a), _) as x, other)):
                    return walk(other) if self.array(a).df is None else Call("coalesce", (Method(cell(x), "head", ()), walk(other)))
            if isinstance(e, Index) and isinstance(e.of, Var):
                return read(e.of.name, e.at)
            return rebuilt(e, walk)

        def plain(e: Any) -> list[tuple[str, tuple]]:
            if isinstance(e, Call) and e.name in ("exists", "default"):
                return [y for c in e.args[1:] for y in plain(c)]
            out = [(e.of.name, e.at)] if isinstance(e, Index) and isinstance(e.of, Var) and all(isinstance(x, Var) and x.name in pending for x in e.at) else []
            return out + [y for c in children(e) for y in plain(c)]

        tests = []
        for x in around:
            match x:
                case Range():
                    pending[x.var] = x
                case Foreach(v, domain, _):
                    array = self.array(domain.name) if isinstance(domain, Var) else None
                    many = True
                    if isinstance(array, Array) and array.kind == "map":
                        k, w = fresh("k"), fresh("v")
                        quals += [Gen(PTup((PVar(k), PVar(w))), domain), Bind(PVar(v), Tup((Var(k), Var(w))))]
                    elif isinstance(array, Array):
                        quals.append(Gen(PTup((*[PAny()] * (len(array.names) - 1), PVar(v))), domain))
                    else:
                        quals.append(Gen(PVar(v), domain))
                case Pred(t):
                    tests.append(t)
        everything = [*tests, *parts]
        # reads that bind whole index tuples first, so that ranges vanish
        for a, at in sorted({y for e in everything for y in plain(e)}, key=lambda y: (-len(y[1]), str(y))):
            if all(x.name in pending for x in at) and len({x.name for x in at}) == len(at):
                read(a, at)
        tests = [walk(t) for t in tests]
        parts = [walk(p) for p in parts]
        for r in pending.values():
            quals.insert(0, Gen(PVar(r.var), Call("range", (r.low, r.high, r.step))))
            indices.add(r.var)
        # a range whose ends depend on other loop variables comes after them; the lowering orders generators
        return (*quals, *map(Pred, tests)), parts, indices | ({"*"} if many else set())

    def assign(self, target: Any, op: str | None, value: Any, around: tuple) -> None:
        loops = {x.var for x in around if isinstance(x, (Range, Foreach))}
        match target:
            case Var(n):
                if n in loops:
                    raise QueryError(f"the loop variable {n} can't be assigned")
                self.scalar_assign(n, op, value, around)
            case Index(Var(n), at):
                self.array_assign(n, at, None, op, value, around)
            case Field(Index(Var(n), at), part):
                self.array_assign(n, at, part, op, value, around)
            case Field(Var(n), part):
                if around and op is None:
                    raise QueryError("a scalar's part is updated outside of loops, or by an increment")
                old = self.vars[n]
                place = int(part[1:]) - 1 if part[1:].isdigit() else list(old).index(part) if isinstance(old, dict) else None
                new = self.reduced(op, value, around) if around else self.scalar(value)
                new = new if op is None else combine(op, old[place], new)
                self.vars[n] = tuple(new if i == place else x for i, x in enumerate(old))
            case _:
                raise QueryError("nested destinations have one index and one part")

    def scalar_assign(self, n: str, op: str | None, value: Any, around: tuple) -> None:
        if isinstance(self.vars.get(n), Array) and not around:
            self.emptied = True
            if isinstance(value, Var) and isinstance(self.vars.get(value.name), Array):
                self.vars[n] = self.vars[value.name]
            elif isinstance(value, Call) and value.name in ARRAYS:
                self.vars[n] = Array(value.name, None, self.vars[n].item)
            else:
                raise QueryError(f"{n} is an array")
            return
        if around and op is None:
            raise QueryError(f"{n} would depend on the order of iterations; use an increment")
        if around:
            new = self.reduced(op, value, around)
            if new is None:
                return
        else:
            reads = any(isinstance(x, Index) for x in walk_all(value))
            new = self.first(value) if reads else self.scalar(value)
        self.vars[n] = self.typed(n, new if op is None else combine(op, self.vars[n], new, self.session))

    def reduced(self, op: str, value: Any, around: tuple) -> Any:
        quals, (v,), _ = self.comprehension(around, [value])
        return self.total(op, Select(v, quals))

    def first(self, value: Any) -> Any:
        quals, (v,), _ = self.comprehension((), [value])
        row = self.query(Select(v, quals)).first()
        return None if row is None else row[0] if len(row) == 1 else tuple(row)

    def typed(self, n: str, x: Any) -> Any:
        kind = self.kinds.get(n, (None,))[0]
        return PYTHON[kind](x) if kind in PYTHON and x is not None else x

    def array_assign(self, n: str, at: tuple, part: str | None, op: str | None, value: Any, around: tuple) -> None:
        a = self.array(n, len(at))
        if not isinstance(a, Array):
            raise QueryError(f"{n} is no array")
        if len(at) + 1 != len(a.names):
            raise QueryError(f"{n} has {len(a.names) - 1} indices")
        mark, given = self.mark(at, value, around), value
        quals, found, indices = self.comprehension(around, [*at, value])
        at, v = tuple(found[:-1]), found[-1]
        a = self.vars[n]
        unique = indices <= {x.name for x in at if isinstance(x, Var)}
        keys = [fresh("key") for _ in at]
        if unique:
            s = Select(Rec(tuple(zip(a.names, (*at, v), strict=True))), quals)
        else:
            x = fresh("x")
            s = Select(Rec((*zip(a.names[:-1], map(Var, keys), strict=True), ("v", Reduce(op or "max", Var(x))))), (*quals, Bind(PVar(x), v)), group=Group(PTup(tuple(map(PVar, keys))), Tup(at)))
        self.changed.add(n)
        ends = self.ends(at, around)
        if op == "+" and part is None and ends and len(ends) == 2 and a.fill and a.fill[0] == ends and a.item == ("Double",) and (whole := self.product(s, (*ends, a.fill[1]))) is not None:
            self.vars[n] = replace(a, df=self.keyed(whole, a, part), fill=None, made=None)
            return
        new = self.keyed(self.query(s), a, part)
        if op is None and part is None and (a.df is None or (mark is not None and a.origins <= {mark})):
            # the same statement has made all cells there are, and what it reads has lost none since
            plain = unique and ends is not None and all(isinstance(x, Range) for x in around) and len(around) == len(at)
            full = plain and isinstance(value, Lit) and isinstance(value.value, (int, float)) and all(isinstance(q, Gen) for q in quals)
            made = (tuple(x.name for x in at), ends, given, self.read_of(given)) if plain and self.inside and a.item == ("Double",) else None
            self.vars[n] = Array(a.kind, new, a.item, (ends, value.value) if full else None, ends if full else None, frozenset({mark}), made)
            return
        within = ends is not None and a.cover == ends
        origins = a.origins if within or part is not None else a.origins | {mark}
        self.vars[n] = replace(a, df=self.merged(a, new, op, part, within), fill=None, made=None, origins=origins)

    def read_of(self, value: Any) -> dict[str, Any]:
        """The tables and scalars that an expression names, as they are now."""
        return {n: (v.df if isinstance(v, Array) else v) for n in names_in(value) if (v := self.vars.get(n)) is not None}

    def mark(self, at: tuple, value: Any, around: tuple) -> tuple | None:
        """Equal for two runs of a statement if the second stores at least the first's cells; None where that isn't known.

        Cells are only added to arrays as long as none is assigned whole, so reads drop no more iterations than before.
        """
        reads = [x for x in walk_all(value) if isinstance(x, Index)]
        if self.emptied or not all(isinstance(x, (Range, Foreach)) for x in around) or any(isinstance(y, Index) for e in (*at, *(e for r in reads for e in r.at)) for y in walk_all(e)):
            return None
        domains = [x.domain for x in around if isinstance(x, Foreach)]
        ends = [e for x in around if isinstance(x, Range) for e in (x.low, x.high, x.step)]
        if not all(isinstance(d, Var) for d in domains) or any(isinstance(y, Index) for e in ends for y in walk_all(e)):
            return None
        loops = {x.var for x in around}
        names = sorted(names_in((at, ends, domains, [r.at for r in reads])) - loops)
        known = [self.vars.get(n) for n in names]
        known = [v.df if isinstance(v, Array) else v for v in known]
        if not all(isinstance(v, (DataFrame, bool, int, float, str)) for v in known):
            return None
        return (repr(at), repr(reads), repr(around), tuple(names), tuple(known))

    def definition(self, array: Array, at: tuple) -> tuple | None:
        """(a cell's value, tests) by the statement that made it, if what that has read is still the same."""
        if not self.inside or array.made is None:
            return None
        names, ends, value, read = array.made
        now = self.read_of(value)
        if now.keys() != read.keys() or any(now[k] is not x if isinstance(x, DataFrame) else now[k] != x for k, x in read.items()):
            return None
        tests = [Bin(op, x, Lit(e)) for x, pair in zip(at, ends, strict=True) for op, e in zip((">=", "<="), pair, strict=True)]
        return Method(substitute(value, dict(zip(names, at, strict=True))), "toDouble", ()), tests

    def ends(self, at: tuple, around: tuple) -> tuple | None:
        """The ends of the loops over the indices of a cell, where each index is a loop's variable with known ends."""
        loops = {x.var: x for x in around if isinstance(x, Range)}
        if not all(isinstance(x, Var) and x.name in loops for x in at) or len({x.name for x in at}) < len(at):
            return None
        out = tuple((simple(loops[x.name].low, self.vars), simple(loops[x.name].high, self.vars)) for x in at)
        return out if all(type(e) is int for pair in out for e in pair) and all(loops[x.name].step == Lit(1) for x in at) else None

    def keyed(self, new: DataFrame, a: Array, part: str | None) -> DataFrame:
        keys = [F.col(k).cast("long").alias(k) if a.kind != "map" else F.col(k) for k in a.names[:-1]]
        v = F.col("v")
        if part is None and a.item and a.item[0] in SCALARS:
            v = v.cast(SCALARS[a.item[0]])
        elif part is None and a.item and a.item[0] == "tuple" and all(x[0] in SCALARS for x in a.item[1:]):
            v = F.struct(*(v.getField(f"_{i + 1}").cast(SCALARS[x[0]]).alias(f"_{i + 1}") for i, x in enumerate(a.item[1:])))
        return new.select(*keys, v.alias("v"))

    def merged(self, a: Array, new: DataFrame, op: str | None, part: str | None, within: bool = False) -> DataFrame:
        """The array after an increment (op) or update of the new cells; within: all of them are there already."""
        keys = a.names[:-1]
        if a.df is None:
            if part is not None:
                raise QueryError("a part is assigned before its cell")
            return new
        renamed = new.toDF(*(f"__{k}" for k in keys), "__v")
        on = [F.col(k) == F.col(f"__{k}") for k in keys]
        both = a.df.join(renamed, on, "left" if part is not None or within else "full_outer")
        old, fresh_ = F.col("v"), F.col("__v")
        there = F.col(f"__{keys[0]}").isNotNull()
        if part is not None:
            names = a.df.schema["v"].dataType.names
            name = part if part in names else names[int(part[1:]) - 1]
            kind = a.df.schema["v"].dataType[name].dataType
            now = fresh_ if op is None else merge_of(op, self.session)(old.getField(name), fresh_)
            value = F.when(there, old.withField(name, now.cast(kind))).otherwise(old)
        elif op is None:
            value = F.when(there, fresh_).otherwise(old)
        else:
            value = F.when(F.col(keys[0]).isNull(), fresh_).when(there, merge_of(op, self.session)(old, fresh_)).otherwise(old)
        return both.select(*(F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys), value.alias("v"))

    def results(self) -> dict[str, Any]:
        return {k: (v.df if isinstance(v, Array) else v) for k, v in self.vars.items()} | {"printed": self.printed}


def names_in(x: Any) -> set[str]:
    """All names in statements or expressions, bound ones too."""
    if isinstance(x, (tuple, list)):
        return {n for y in x for n in names_in(y)}
    if isinstance(x, Var):
        return {x.name}
    return {n for f in fields(x) for n in names_in(getattr(x, f.name))} if is_dataclass(x) else set()


def walk_all(e: Any) -> list:
    return [e, *(y for c in children(e) for y in walk_all(c))]


def simple(e: Any, env: dict[str, Any]) -> Any:
    """The value of a scalar expression that Python computes as the language does, else None."""
    match e:
        case Lit(v):
            return v
        case Var(n) if isinstance(env.get(n), (bool, int, float, str)):
            return env[n]
        case Un("-", x) if isinstance(v := simple(x, env), (int, float)):
            return -v
        case Un("!", x) if isinstance(v := simple(x, env), bool):
            return not v
        case Bin(op, x, y) if (a := simple(x, env)) is not None and (b := simple(y, env)) is not None:
            if op == "/" and isinstance(a, int) and isinstance(b, int):
                return int(a / b) if b and abs(a) < 1 << 53 else None
            if op == "/":
                return a / b if b else None
            ops = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b, "&&": lambda: a and b, "||": lambda: a or b}
            return ops[op]() if op in ops and type(a) in (bool, int, float) and type(b) in (bool, int, float) else None
    return None


def combine(op: str, a: Any, b: Any, session: Any = None) -> Any:
    """Two scalars of the driver by a monoid."""
    if b is None or a is None:
        return a if b is None else b
    ops = {"+": lambda: a + b, "*": lambda: a * b, "&&": lambda: a and b, "||": lambda: a or b, "max": lambda: max(a, b), "min": lambda: min(a, b)}
    if op not in ops:
        raise QueryError(f"{op} doesn't combine scalars")
    return ops[op]()


def merge_of(op: str, session: Any) -> Callable[[Column, Column], Column]:
    from bagloom.functions.monoids import STANDARD

    m = (STANDARD | session.monoids).get(op)
    if m is None or m.combine is None:
        raise QueryError(f"{op} doesn't merge cells")
    if op == "+":
        return lambda a, b: a + b
    return m.combine


def flat_keys(df: DataFrame, kind: str) -> DataFrame:
    """An array DataFrame in standard columns; a struct key of a matrix is opened."""
    names = ARRAYS[kind]
    first = df.schema[0]
    if kind == "matrix" and len(df.columns) == 2 and isinstance(first.dataType, T.StructType):
        k = F.col(df.columns[0])
        a, b = first.dataType.names
        return df.select(k.getField(a).alias("i"), k.getField(b).alias("j"), F.col(df.columns[1]).alias("v"))
    if len(df.columns) == len(names):
        return df.toDF(*names)
    keys = len(names) - 1
    return df.select(*(F.col(c).alias(k) for c, k in zip(df.columns[:keys], names, strict=False)), F.struct(*df.columns[keys:]).alias("v"))


def run_loops(text: str, bindings: dict[str, Any], session: Any) -> dict[str, Any]:
    spark = bindings.pop("spark", None) or next((x.sparkSession for x in bindings.values() if isinstance(x, DataFrame)), None) or SparkSession.getActiveSession()
    loops = Loops(spark, bindings, session)
    loops.run(parse_loops(text, set(session.monoids)))
    return loops.results()
