"""Which queries a stream can keep up, and how.

A query over one streaming bag is incremental if what it keeps is a homomorphism: stateless
steps (projection, filter, unnesting, joins with static bags) may be followed by one
group-by, or one total, whose reductions are all by monoids that merge partial results.
The state is then one value per key and reduction, in Spark's streaming aggregation; what
the head and `having` compute from them is stateless again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from bagloom.functions.monoids import STANDARD
from bagloom.lang.parsing import parse_query
from bagloom.lang.tree import Gen, PVar, Quant, Reduce, Repeat, Select, Var, children, free, pattern_vars, qual_vars


@dataclass(frozen=True)
class Analysis:
    """mode: append (stateless) or update (keyed state); monoids: of the state; reasons: why not, if any."""

    mode: str
    monoids: tuple[str, ...]
    reasons: tuple[str, ...]

    @property
    def incremental(self) -> bool:
        return not self.reasons


def whole(bag: Var) -> Select:
    """A bag's name as the comprehension of its elements."""
    return Select(Var("x"), (Gen(PVar("x"), bag),))


def analyse(e: Any, streams: set[str], monoids: dict) -> Analysis:
    known = STANDARD | monoids
    reasons: list[str] = []
    used: list[str] = []
    if isinstance(e, Reduce) and isinstance(e.of, (Select, Var)):
        used.append(e.op)
        body = e.of if isinstance(e.of, Select) else whole(e.of)
    else:
        body = e
    if not isinstance(body, Select):
        return Analysis("append", (), ("only a select, or a reduction of one, is incremental",))
    over = [q for q in body.quals if isinstance(q, Gen) and free(q.domain) & streams]
    if len(over) != 1:
        reasons.append(f"{len(over)} generators range over streams; there must be one")
    if body.order is not None:
        reasons.append("an order needs the whole result")
    if body.distinct:
        reasons.append("distinct rows need every row as state")
    if body.other is not None:
        reasons.append("a co-grouping joins two states")
    lifted = set(qual_vars(body.quals)) - (set(pattern_vars(body.group.pattern)) if body.group else set())

    def walk(x: Any, reduced: bool) -> None:
        match x:
            case Repeat():
                reasons.append("a repeat needs the whole result in each step")
            case Reduce(op, of):
                if free(of) & lifted and body.group is not None:
                    used.append(op)
                    return
            case Select() | Quant() if free(x) & streams:
                reasons.append("a nested query over a stream")
            case Var(n) if n in lifted and body.group is not None and not reduced:
                reasons.append(f"the bag of {n} would grow without end; reduce it")
        for c in children(x):
            walk(c, reduced)

    for x in (body.head, body.having):
        if x is not None:
            walk(x, False)
    for op in used:
        if op not in known or not known[op].incremental:
            reasons.append(f"partial results of {op} can't be merged")
    return Analysis("update" if body.group is not None or isinstance(e, Reduce) else "append", tuple(dict.fromkeys(used)), tuple(dict.fromkeys(reasons)))


def incremental(text: str, bindings: dict[str, Any], session: Any) -> DataFrame:
    streams = {k for k, x in bindings.items() if isinstance(x, DataFrame) and x.isStreaming}
    e = parse_query(text, set(session.monoids))
    low = session.lowering(dict(bindings))
    e = low.expand(e)
    found = analyse(e, streams, session.monoids)
    if not found.incremental:
        raise ValueError("not incremental: " + "; ".join(found.reasons))
    if isinstance(e, Reduce):
        body = e.of if isinstance(e.of, Select) else whole(e.of)
        frame, head, _ = low.comprehend(Select(body.head, body.quals, group=None), None, {})
        m = low.monoid(e.op)
        return frame.df.agg(m.aggregate(low.column(head)).alias("value"))
    return low.run(e)


def drained(text: str, bindings: dict[str, Any], session: Any = None) -> DataFrame:
    """The result after all that a stream has so far: a complete in-memory table (small results only, as all memory sinks)."""
    from bagloom.api import Session

    session = session or Session()
    out = incremental(text, bindings, session)
    name = "drained_" + uuid.uuid4().hex
    mode = "complete" if analyse(session.lowering(dict(bindings)).expand(parse_query(text)), {k for k, x in bindings.items() if isinstance(x, DataFrame) and x.isStreaming}, session.monoids).mode == "update" else "append"
    run = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return out.sparkSession.table(name)
