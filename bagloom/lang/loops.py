"""The statements of the loop language."""

from __future__ import annotations

from bagloom.lang.parsing import Parser
from bagloom.lang.tree import Assign, Bin, Block, Call, Declare, Def, Do, Field, For, Foreach, IfS, Index, Lit, QueryError, Return, Var, While

INCREMENTS = {"+=": "+", "*=": "*", "&&=": "&&", "||=": "||"}


class LoopParser(Parser):
    def __init__(self, text: str, monoids: set[str] = frozenset()):
        super().__init__(text, loops=True)
        self.monoids = Parser.monoids | set(monoids)

    def program(self) -> Block:
        out = []
        while self.now.kind != "end":
            out.append(self.stmt())
            if not self.take(";") and self.now.kind != "end":
                raise self.wrong("';' expected")
        return Block(tuple(out))

    def stmt(self):
        if self.take("var"):
            n = self.name()
            self.need(":")
            kind = self.kind()
            return Declare(n, kind, self.expr() if self.take("=") else None)
        if self.take("external"):
            n = self.name()
            self.need(":")
            return Declare(n, self.kind(), None, True)
        if self.take("{"):
            out = []
            while not self.take("}"):
                out.append(self.stmt())
                if not self.take(";") and not self.at("}"):
                    raise self.wrong("';' expected")
            return Block(tuple(out))
        if self.take("for"):
            n = self.name()
            if self.take("in"):
                domain = self.expr()
                self.need("do")
                return Foreach(n, domain, self.stmt())
            self.need("=")
            low = self.expr()
            self.need(",")
            high = self.expr()
            step = self.expr() if self.take(",") else Lit(1)
            self.need("do")
            return For(n, low, high, step, self.stmt())
        if self.take("while"):
            self.need("(")
            (test,) = self.many(self.expr, ")")
            return While(test, self.stmt())
        if self.at("if"):
            return self.choice()
        if self.take("def"):
            n = self.name()
            self.need("(")
            params = self.many(self.param, ")")
            self.need(":")
            kind = self.kind()
            return Def(n, params, kind, self.stmt())
        if self.take("return"):
            return Return(self.expr())
        e = self.expr()
        if self.take(":="):
            return self.assign(e, None, self.expr())
        for text, op in INCREMENTS.items():
            if self.take(text):
                return self.assign(e, op, self.expr())
        return Do(e)

    def postfix(self, e):
        e = super().postfix(e)
        if isinstance(e, Index) and self.at(":"):  # a cell with a default
            self.need(":")
            return Call("default", (e, self.unary()))
        return e

    def choice(self) -> IfS:
        self.need("if")
        self.need("(")
        (test,) = self.many(self.expr, ")")
        then = self.stmt()
        if self.at("else") or (self.at(";") and self.peek().text == "else"):
            self.take(";")
            self.need("else")
            return IfS(test, then, self.stmt())
        return IfS(test, then, Block())

    def assign(self, target, op, value):
        base = target
        while isinstance(base, (Field, Index)):
            base = base.of
        if not isinstance(base, Var):
            raise self.wrong("this can't be assigned")
        if op is None and isinstance(value, Bin) and value.left == target and value.op in self.combining():
            return Assign(target, value.op, value.right)  # x := x op e is an increment
        return Assign(target, op, value)

    def combining(self) -> set[str]:
        return {"+", "*", "&&", "||", "^"} | (self.monoids - {"count", "avg"})

    def param(self):
        n = self.name()
        self.need(":")
        return n, self.kind()

    def kind(self):
        """Types as nested tuples: ("vector", T), ("matrix", T), ("map", K, V), ("tuple", ...), ("record", (name, T), ...), ("Int",)."""
        if self.take("("):
            items = self.many(self.kind, ")")
            out = items[0] if len(items) == 1 else ("tuple", *items)
        elif self.take("<"):
            out = [self.param()]
            while self.take(","):
                out.append(self.param())
            self.need(">")
            out = ("record", *out)
        else:
            n = self.name()
            out = (n, *self.many(self.kind, "]")) if self.take("[") else (n,)
        if self.take("->"):
            return ("function", out, self.kind())
        return out


def parse_loops(text: str, monoids: set[str] = frozenset()) -> Block:
    return LoopParser(text, monoids).program()


__all__ = ["LoopParser", "QueryError", "parse_loops"]
