"""The one syntax tree of both front ends: expressions, patterns, qualifiers, statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class QueryError(ValueError):
    """A text that can't be read, or a meaning that can't be given to it."""


# ---- patterns ----
@dataclass(frozen=True)
class PAny:
    pass


@dataclass(frozen=True)
class PVar:
    name: str


@dataclass(frozen=True)
class PLit:
    value: Any


@dataclass(frozen=True)
class PTup:
    items: tuple


@dataclass(frozen=True)
class PAs:
    name: str
    inner: Any


@dataclass(frozen=True)
class PCons:
    head: Any
    tail: Any


@dataclass(frozen=True)
class PMake:
    """A constructor pattern; rest is the name of a trailing `xs@_*`, or None."""

    name: str
    items: tuple
    rest: str | None = None


# ---- expressions ----
@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Tup:
    items: tuple


@dataclass(frozen=True)
class Rec:
    items: tuple  # of (name, expression)


@dataclass(frozen=True)
class Seq:
    items: tuple


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Method:
    of: Any
    name: str
    args: tuple


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Un:
    op: str
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Fun:
    params: tuple  # of patterns
    body: Any


@dataclass(frozen=True)
class Match:
    of: Any
    cases: tuple  # of (pattern, guard or None, expression)


@dataclass(frozen=True)
class Let:
    pattern: Any
    value: Any
    body: Any


@dataclass(frozen=True)
class Desc:
    of: Any


@dataclass(frozen=True)
class Reduce:
    op: str
    of: Any


@dataclass(frozen=True)
class Group:
    pattern: Any
    key: Any


@dataclass(frozen=True)
class Gen:
    pattern: Any
    domain: Any
    small: bool = False


@dataclass(frozen=True)
class Bind:
    pattern: Any
    value: Any


@dataclass(frozen=True)
class Pred:
    test: Any


@dataclass(frozen=True)
class Select:
    head: Any
    quals: tuple
    distinct: bool = False
    group: Group | None = None
    other: tuple | None = None  # of a co-grouping: its qualifiers
    other_group: Group | None = None
    having: Any = None
    order: Any = None


@dataclass(frozen=True)
class Quant:
    every: bool
    quals: tuple
    test: Any


@dataclass(frozen=True)
class Repeat:
    pattern: Any
    start: Any
    step: Any
    until: Any = None
    limit: Any = None


# ---- statements of the loop language ----
@dataclass(frozen=True)
class Declare:
    name: str
    kind: Any
    value: Any = None
    external: bool = False


@dataclass(frozen=True)
class Assign:
    target: Any
    op: str | None  # None: update
    value: Any


@dataclass(frozen=True)
class For:
    var: str
    low: Any
    high: Any
    step: Any
    body: Any


@dataclass(frozen=True)
class Foreach:
    var: str
    domain: Any
    body: Any


@dataclass(frozen=True)
class While:
    test: Any
    body: Any


@dataclass(frozen=True)
class IfS:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Block:
    items: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Def:
    name: str
    params: tuple  # of (name, type)
    kind: Any
    body: Any


@dataclass(frozen=True)
class Return:
    value: Any


@dataclass(frozen=True)
class Do:
    value: Any


def children(x: Any) -> list:
    """Direct subtrees, looking through tuples."""
    if is_dataclass(x):
        out = []
        for f in fields(x):
            out += children_of_value(getattr(x, f.name))
        return out
    return children_of_value(x)


def children_of_value(v: Any) -> list:
    if is_dataclass(v):
        return [v]
    if isinstance(v, tuple):
        return [y for x in v for y in children_of_value(x)]
    return []


def rebuilt(x: Any, change: Callable[[Any], Any]) -> Any:
    """x with change applied to each direct subtree."""

    def value(v: Any) -> Any:
        if is_dataclass(v):
            return change(v)
        return tuple(value(y) for y in v) if isinstance(v, tuple) else v

    return replace(x, **{f.name: value(getattr(x, f.name)) for f in fields(x)}) if is_dataclass(x) else x


def pattern_vars(p: Any) -> list[str]:
    """Names that a pattern binds, in order."""
    match p:
        case PVar(n):
            return [n]
        case PAs(n, q):
            return [n, *pattern_vars(q)]
        case PTup(ps):
            return [v for q in ps for v in pattern_vars(q)]
        case PMake(_, ps, rest):
            return [v for q in ps for v in pattern_vars(q)] + ([rest] if rest else [])
        case PCons(h, t):
            return pattern_vars(h) + pattern_vars(t)
    return []


def pattern_expr(p: Any) -> Any:
    """The expression that rebuilds what a pattern matched."""
    match p:
        case PVar(n) | PAs(n, _):
            return Var(n)
        case PTup(ps):
            return Tup(tuple(map(pattern_expr, ps)))
        case PLit(v):
            return Lit(v)
        case PMake(n, ps, None):
            return Call(n, tuple(map(pattern_expr, ps)))
    raise QueryError(f"this pattern has no value: {p}")


def qual_vars(quals: tuple) -> list[str]:
    return [v for q in quals if isinstance(q, (Gen, Bind)) for v in pattern_vars(q.pattern)]


def free(x: Any) -> set[str]:
    """Names used in x that x doesn't bind."""
    match x:
        case Var(n):
            return {n}
        case Fun(ps, body):
            return free(body) - {v for p in ps for v in pattern_vars(p)}
        case Let(p, e, body):
            return free(e) | (free(body) - set(pattern_vars(p)))
        case Match(e, cases):
            out = free(e)
            for p, g, b in cases:
                out |= ((free(g) if g is not None else set()) | free(b)) - set(pattern_vars(p))
            return out
        case Quant(_, quals, test):
            return free_quals(quals, [test])
        case Repeat(p, start, step, until, limit):
            inner = free(step) | (free(until) if until is not None else set())
            return free(start) | (inner - set(pattern_vars(p))) | (free(limit) if limit is not None else set())
        case Select():
            rest = [y for y in (x.head, x.having, x.order) if y is not None]
            keys = [g.key for g in (x.group,) if g is not None]
            bound = set(pattern_vars(x.group.pattern)) if x.group else set()
            if x.other is not None:
                second = free_quals(x.other, [x.other_group.key])
                rest_free = set().union(*(free(y) for y in rest)) - bound - set(qual_vars(x.other))
                return free_quals(x.quals, keys) | second | (rest_free - set(qual_vars(x.quals)))
            after = set().union(*(free(y) for y in rest)) - bound
            return free_quals(x.quals, keys) | (after - set(qual_vars(x.quals)))
        case Call(n, args):
            return {n} | set().union(set(), *(free(a) for a in args))
    return set().union(set(), *(free(c) for c in children(x)))


def free_quals(quals: tuple, after: list) -> set[str]:
    out, bound = set(), set()
    for q in quals:
        e = q.domain if isinstance(q, Gen) else q.value if isinstance(q, Bind) else q.test
        out |= free(e) - bound
        if not isinstance(q, Pred):
            bound |= set(pattern_vars(q.pattern))
    for e in after:
        out |= free(e) - bound
    return out


def substitute(x: Any, by: dict[str, Any]) -> Any:
    """x with free names replaced; binders that would capture hide the replacement."""
    if not by:
        return x
    less = lambda names: {k: v for k, v in by.items() if k not in names}
    match x:
        case Var(n):
            return by.get(n, x)
        case Fun(ps, body):
            return Fun(ps, substitute(body, less({v for p in ps for v in pattern_vars(p)})))
        case Let(p, e, body):
            return Let(p, substitute(e, by), substitute(body, less(set(pattern_vars(p)))))
        case Match(e, cases):
            return Match(substitute(e, by), tuple((p, None if g is None else substitute(g, less(set(pattern_vars(p)))), substitute(b, less(set(pattern_vars(p))))) for p, g, b in cases))
        case Quant(every, quals, test):
            quals, rest = substitute_quals(quals, by)
            return Quant(every, quals, substitute(test, rest))
        case Repeat(p, start, step, until, limit):
            inner = less(set(pattern_vars(p)))
            return Repeat(p, substitute(start, by), substitute(step, inner), None if until is None else substitute(until, inner), None if limit is None else substitute(limit, by))
        case Select():
            quals, rest = substitute_quals(x.quals, by)
            group = x.group and Group(x.group.pattern, substitute(x.group.key, rest))
            other, other_rest = substitute_quals(x.other, by) if x.other is not None else (None, by)
            other_group = x.other_group and Group(x.other_group.pattern, substitute(x.other_group.key, other_rest))
            last = {k: v for k, v in rest.items() if k in other_rest and (group is None or k not in pattern_vars(group.pattern))}
            some = lambda e: None if e is None else substitute(e, last)
            return Select(some(x.head), quals, x.distinct, group, other, other_group, some(x.having), some(x.order))
    return rebuilt(x, lambda c: substitute(c, by))


def substitute_quals(quals: tuple, by: dict[str, Any]) -> tuple[tuple, dict[str, Any]]:
    out, by = [], dict(by)
    for q in quals:
        match q:
            case Gen(p, e, s):
                out.append(Gen(p, substitute(e, by), s))
            case Bind(p, e):
                out.append(Bind(p, substitute(e, by)))
            case Pred(e):
                out.append(Pred(substitute(e, by)))
        if not isinstance(q, Pred):
            for v in pattern_vars(q.pattern):
                by.pop(v, None)
    return tuple(out), by
