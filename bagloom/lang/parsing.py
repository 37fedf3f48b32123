"""Lexer, and the expression grammar that both languages share.

Precedence is the usual one, from low to high: || |, ^, && &, == != =, relations, + -, * / %,
other infix symbols, ::. Unary operators bind tightest.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from bagloom.lang.tree import (
    Bin, Bind, Call, Desc, Field, Fun, Gen, Group, If, Index, Let, Lit, Match, Method, PAny, PAs, PCons, PLit, PMake, Pred, PTup, PVar, Quant, QueryError, Rec, Reduce, Repeat, Select, Seq, Tup, Un, Var, pattern_expr,
)

WORDS = {"select", "distinct", "from", "where", "group", "by", "having", "order", "some", "all", "repeat", "step", "until", "limit", "let", "in", "if", "else", "match", "case", "new", "true", "false", "desc", "asc", "member", "union", "intersect", "minus", "trace"}
LOOP_WORDS = {"var", "external", "for", "do", "while", "def", "return"}
LEVELS = [("||", "|"), ("^",), ("&&", "&"), ("==", "!=", "="), ("<=", ">=", "<", ">"), ("+", "-", "++"), ("*", "/", "%")]
KNOWN = {x for level in LEVELS for x in level}
TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<number>\d+\.\d+(?:[eE][-+]?\d+)?[dD]?|(?<![\w)\]])\.\d+(?:[eE][-+]?\d+)?[dD]?|\d+[eE][-+]?\d+|\d+[dD]\b|\d+[lL]\b|\d+)
  | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*)
  | (?P<string>"(?:[^"\\]|\\.)*")
  | (?P<char>'(?:[^'\\]|\\.)')
  | (?P<op><--|<-|=>|->|:=|::|&&=|\|\|=|\+=|\*=|==|!=|<=|>=|&&|\|\||\+\+|/|[-+*%<>=!&|^@~?]+|[()\[\]{},;:.\#])""",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    at: int


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)


def tokens(text: str, words: set[str]) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {place(text, at)}")
        kind = m.lastgroup
        if kind == "op" and len(m[0]) > 1 and m[0] not in {"<--", "<-", "=>", "->", ":=", "::", "&&=", "||=", "+=", "*=", "==", "!=", "<=", ">=", "&&", "||", "++"}:
            # a symbol run is one operator unless it ends in a unary sign of its own or begins a reduction
            m2 = re.match(r"(?:<=|>=|==|!=|&&|\|\||[-+*%<>=|&^])(?=[-+!]$)|[-+*%^&|<>]+(?=/)|&&(?=/)|\|\|(?=/)", m[0])
            if m2 and m2[0] != m[0]:
                out.append(Token("op", m2[0], at))
                at += len(m2[0])
                continue
        if kind != "space":
            out.append(Token("word" if kind == "name" and m[0] in words else kind, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def place(text: str, at: int) -> str:
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}"


class Parser:
    """Recursive descent; loops switch on the extras of the loop language."""

    def __init__(self, text: str, loops: bool = False):
        self.text, self.loops = text, loops
        self.all = tokens(text, LOOP_WORDS | {"if", "else", "true", "false", "in"} if loops else WORDS)
        self.i = 0

    # ---- tokens ----
    @property
    def now(self) -> Token:
        return self.all[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.all[min(self.i + k, len(self.all) - 1)]

    def at(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in ("op", "word")

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.wrong(f"{text!r} expected")

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.wrong("a name expected")
        self.i += 1
        return self.all[self.i - 1].text

    def wrong(self, what: str) -> QueryError:
        return QueryError(f"{what} at {place(self.text, self.now.at)}, found {self.now.text!r}")

    def many(self, item, close: str) -> tuple:
        out, held = [], self.depth
        self.depth = 0
        if not self.take(close):
            out.append(item())
            while self.take(","):
                out.append(item())
            self.need(close)
        self.depth = held
        return tuple(out)

    # ---- expressions ----
    def expr(self):
        if self.now.kind == "name" and self.peek().text == "=>":
            p = self.name()
            self.need("=>")
            return Fun((PAny() if p == "_" else PVar(p),), self.expr())
        if self.at("(") and self.is_function():
            self.need("(")
            ps = self.many(self.pattern, ")")
            self.need("=>")
            return Fun(ps, self.expr())
        return self.placeholder(self.sets())

    def is_function(self) -> bool:
        depth, k = 0, 0
        while self.peek(k).kind != "end":
            depth += (self.peek(k).text == "(") - (self.peek(k).text == ")")
            k += 1
            if not depth:
                return self.peek(k).text == "=>"
        return False

    def placeholder(self, e):
        """`_ + 1` is a function of its underscores."""
        if self.loops:
            return e
        names: list[str] = []

        def walk(x):
            from bagloom.lang.tree import rebuilt

            if isinstance(x, Var) and x.name == "_":
                names.append(f"_p{len(names)}")
                return Var(names[-1])
            return x if isinstance(x, (Fun, Select, Quant)) else rebuilt(x, walk)

        found = walk(e)
        return Fun(tuple(map(PVar, names)), found) if names and not isinstance(e, Var) else e

    def sets(self):
        e = self.level(0)
        if self.now.kind == "name" and self.now.text == "to":
            self.i += 1
            e = Call("range", (e, self.level(0)))
        while self.at("union", "intersect", "minus", "member"):
            op = self.now.text
            self.i += 1
            e = Bin(op, e, self.level(0))
        return e

    def level(self, n: int):
        if n == len(LEVELS):
            return self.infix()
        e = self.level(n + 1)
        while self.now.kind == "op" and self.now.text in LEVELS[n] and not (self.loops and self.now.text == "=" and n == 3) and not self.ends_record(n):
            op = self.now.text
            self.i += 1
            e = Bin("==" if op == "=" else op, e, self.level(n + 1))
        return e

    def ends_record(self, n: int) -> bool:
        return n == 4 and self.now.text == ">" and self.depth > 0

    depth = 0

    def infix(self):
        e = self.cons()
        while self.now.kind == "op" and re.fullmatch(r"[-+*/%<>=!&|^@~?]+", self.now.text) and self.now.text not in KNOWN | {"<-", "<--", "=>", "->", ":=", "+=", "*=", "&&=", "||=", "@", "!"}:
            op = self.now.text
            self.i += 1
            e = Call(op, (e, self.cons()))
        return e

    def cons(self):
        e = self.matched()
        if self.take("::"):
            return Bin("::", e, self.cons())
        return e

    def matched(self):
        e = self.unary()
        while self.take("match"):
            e = Match(e, self.cases())
        return e

    def cases(self) -> tuple:
        self.need("{")
        out = []
        while not self.take("}"):
            self.need("case")
            p = self.pattern()
            guard = self.expr() if self.take("by") else None
            self.need("=>")
            out.append((p, guard, self.expr()))
            self.take(";")
        return tuple(out)

    def unary(self):
        if self.now.kind in ("op", "name") and self.peek().text == "/" and not self.peek().at - self.now.at - len(self.now.text) and self.is_reduction():
            op = self.now.text
            self.i += 2
            e = self.unary()
            return self.postfix(Desc(Reduce(op, e.of)) if isinstance(e, Desc) else Reduce(op, e))
        for op in ("-", "+", "!"):
            if self.at(op):
                self.i += 1
                e = self.unary()
                return Desc(Un(op, e.of)) if isinstance(e, Desc) else Un(op, e)
        return self.postfix(self.term())

    def is_reduction(self) -> bool:
        if self.now.kind == "op":
            return self.now.text not in (")", "]", "}", "(", "[", "{", ",", ";", ":", ".", "#")
        # name/expr: a reduction by a named monoid, unless a plain division of a variable
        return self.now.text in self.monoids

    monoids = {"count", "sum", "avg", "max", "min", "product", "and", "or", "argmin", "argmax"}

    def postfix(self, e):
        while True:
            if self.take("."):
                n = self.name()
                e = Method(e, n, self.many(self.expr, ")")) if self.take("(") else Field(e, n)
            elif self.take("#"):
                e = Field(e, f"_{self.now.text}")
                self.i += 1
            elif self.at("[") and self.loops:
                self.need("[")
                e = Index(e, self.many(self.expr, "]"))
            elif self.take("desc"):
                e = Desc(e)
            elif self.take("asc"):
                pass
            else:
                return e

    def literal(self):
        t = self.now
        if t.kind == "number":
            self.i += 1
            s = t.text.rstrip("dDlL")
            return int(s) if re.fullmatch(r"\d+", s) and t.text[-1] not in "dD" else float(s)
        if t.kind in ("string", "char"):
            self.i += 1
            return unescaped(t.text[1:-1])
        if t.text in ("true", "false") and t.kind == "word":
            self.i += 1
            return t.text == "true"
        return None

    def term(self):
        found = self.literal()
        if found is not None:
            return Lit(found)
        if self.at("select"):
            return self.select()
        if self.at("some", "all"):
            every = self.now.text == "all"
            self.i += 1
            quals = self.quals()
            self.need(":")
            return Quant(every, quals, self.expr())
        if self.take("repeat"):
            return self.repeat()
        if self.take("let"):
            found = []
            while True:
                p = self.pattern()
                self.need("=")
                found.append((p, self.expr()))
                if not self.take(","):
                    break
            self.need("in")
            e = self.expr()
            for p, v in reversed(found):
                e = Let(p, v, e)
            return e
        if self.take("if"):
            self.need("(")
            (test,) = self.many(self.expr, ")")
            then = self.expr()
            self.need("else")
            return If(test, then, self.expr())
        if self.take("trace"):
            self.need("(")
            e = self.expr()
            self.need(")")
            return Call("trace", (e,))
        self.take("new")
        if self.take("("):
            items = self.many(self.expr, ")")
            return items[0] if len(items) == 1 else Tup(items)
        if self.take("["):
            return Seq(self.many(self.expr, "]"))
        if self.at("{") and self.peek().text == "case":
            return Fun((PVar("_m"),), Match(Var("_m"), self.cases()))
        if self.at("{") and self.loops:
            self.need("{")
            return Seq(self.many(self.expr, "}"))
        if self.take("<"):
            self.depth += 1
            items = [self.named()]
            while self.take(","):
                items.append(self.named())
            self.depth -= 1
            self.need(">")
            return Rec(tuple(items))
        if self.now.kind == "name":
            n = self.name()
            if self.take("("):
                args = self.many(self.expr, ")")
                return Seq(args) if n in ("List", "Array", "Seq") else Call(n, args)
            return Var(n)
        raise self.wrong("an expression expected")

    def named(self) -> tuple:
        n = self.name()
        self.need("=")
        return n, self.level(0)

    def select(self):
        self.need("select")
        distinct = self.take("distinct")
        head = self.expr()
        self.need("from")
        quals = self.filtered()
        group = other = other_group = having = order = None
        if self.take("group"):
            self.need("by")
            group = self.key()
            if self.take("from"):
                other = self.filtered()
                self.need("group")
                self.need("by")
                other_group = self.key()
            if self.take("having"):
                having = self.expr()
        if self.take("order"):
            self.need("by")
            order = self.expr()
        return Select(head, quals, distinct, group, other, other_group, having, order)

    def filtered(self) -> tuple:
        quals = self.quals()
        return (*quals, Pred(self.expr())) if self.take("where") else quals

    def key(self) -> Group:
        p = self.pattern()
        return Group(p, self.expr() if self.take(":") else pattern_expr(p))

    def quals(self) -> tuple:
        out = [self.qual()]
        while self.take(","):
            out.append(self.qual())
        return tuple(out)

    def qual(self):
        p = self.pattern()
        if self.take("<--"):
            return Gen(p, self.expr(), True)
        if self.take("<-") or self.take("in"):
            return Gen(p, self.expr())
        self.need("=")
        return Bind(p, self.expr())

    def repeat(self):
        p = self.pattern()
        self.need("=")
        start = self.expr()
        self.need("step")
        step = self.expr()
        until = self.expr() if self.take("until") else None
        limit = self.expr() if self.take("limit") else None
        if until is None and limit is None:
            raise self.wrong("a repeat needs until or limit")
        return Repeat(p, start, step, until, limit)

    # ---- patterns ----
    def pattern(self):
        p = self.simple_pattern()
        if self.take("::"):
            return PCons(p, self.pattern())
        return p

    def simple_pattern(self):
        sign = -1 if self.at("-") and self.peek().kind == "number" else 1
        self.i += sign < 0
        found = self.literal()
        if found is not None:
            return PLit(sign * found if sign < 0 else found)
        if self.take("("):
            items = self.many(self.pattern, ")")
            return items[0] if len(items) == 1 else PTup(items)
        n = self.name()
        if self.take("@"):
            inner = self.pattern()
            return inner if n == "_" else PAs(n, inner)
        if self.take("("):
            items, rest = [], None
            while not self.take(")"):
                if self.now.kind == "name" and self.peek().text in ("@", "*") and self.starred():
                    rest = self.name() if self.peek().text == "@" else "_"
                    while not self.at(")", ","):
                        self.i += 1
                else:
                    items.append(self.pattern())
                self.take(",")
            return PMake(n, tuple(items), rest)
        return PAny() if n == "_" else PVar(n)

    def starred(self) -> bool:
        k = 0
        while self.peek(k).text not in (",", ")", ""):
            if self.peek(k).text == "*":
                return True
            k += 1
        return False

    def end(self) -> None:
        if self.now.kind != "end":
            raise self.wrong("the end expected")


def parse_query(text: str, monoids: set[str] = frozenset()):
    p = Parser(text)
    p.monoids = Parser.monoids | set(monoids)
    e = p.expr()
    p.take(";")
    p.end()
    return e


def parse_queries(text: str, monoids: set[str] = frozenset()) -> list:
    p = Parser(text)
    p.monoids = Parser.monoids | set(monoids)
    out = []
    while p.now.kind != "end":
        out.append(p.expr())
        if not p.take(";") and p.now.kind != "end":
            raise p.wrong("';' expected")
    return out


def parse_macros(text: str) -> dict[str, tuple[tuple[str, ...], object]]:
    """name -> (parameters, body) of `def f(x: T, ...) = body; ...`."""
    p, out = Parser(text), {}
    while p.now.kind != "end":
        if p.now.text != "def":
            raise p.wrong("'def' expected")
        p.i += 1
        n = p.now.text
        p.i += 1
        p.need("(")
        params = []
        while not p.take(")"):
            params.append(p.name())
            if p.take(":"):
                skip_type(p)
            p.take(",")
        p.need("=")
        out[n] = (tuple(params), p.expr())
        p.take(";")
    return out


def skip_type(p: Parser) -> None:
    if p.take("("):
        p.many(lambda: skip_type(p), ")")
    else:
        p.name()
        if p.take("["):
            p.many(lambda: skip_type(p), "]")
