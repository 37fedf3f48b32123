"""Trees as indented text of at most `width` columns."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any


def flat(x: Any) -> str:
    if is_dataclass(x):
        return f"{type(x).__name__}({', '.join(flat(getattr(x, f.name)) for f in fields(x) if getattr(x, f.name) is not None)})"
    if isinstance(x, tuple):
        return f"[{', '.join(map(flat, x))}]"
    return repr(x)


def pretty(x: Any, width: int = 80, indent: int = 0) -> str:
    one = flat(x)
    if len(one) + indent <= width or not (is_dataclass(x) or isinstance(x, tuple)):
        return one
    items = [(f"{f.name}=", getattr(x, f.name)) for f in fields(x) if getattr(x, f.name) is not None] if is_dataclass(x) else [("", y) for y in x]
    head, tail = (f"{type(x).__name__}(", ")") if is_dataclass(x) else ("[", "]")
    pad = " " * (indent + 2)
    return head + "\n" + ",\n".join(pad + n + pretty(y, width, indent + 2 + len(n)) for n, y in items) + tail
