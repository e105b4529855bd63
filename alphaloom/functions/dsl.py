"""The factor-expression language: text to formulas.

    expr is terms joined by + or -, a term is signed primaries joined by * or /, a primary a number, a column, a call or a
    parenthesised expr; names of functions ignore case. All rolling functions look backwards and skip non-finite values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.collect import with_vwap
from .expr import Node, call, col, finite, node, when
from .kernel import with_kernels


class ExpressionError(ValueError):
    pass


#: Function -> (canonical name, number of arguments); the second of two is a window.
FUNCTIONS = {
    "abs": ("abs", 1), "log": ("log", 1), "sqrt": ("sqrt", 1), "delay": ("delay", 2), "ts_delay": ("delay", 2), "ref": ("delay", 2), "delta": ("delta", 2), "ts_delta": ("delta", 2),
    "ts_mean": ("ts_mean", 2), "mean": ("ts_mean", 2), "ts_sum": ("ts_sum", 2), "sum": ("ts_sum", 2), "ts_std": ("ts_std", 2), "std": ("ts_std", 2),
    "ts_min": ("ts_min", 2), "min": ("ts_min", 2), "ts_max": ("ts_max", 2), "max": ("ts_max", 2), "ts_rank": ("ts_rank", 2),
}
_AHEAD = {"lead", "ts_lead", "future", "shift"}
_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/(),]))")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Tree:
    """kind: number, column, negative, binary (sign in name) or call."""

    kind: str
    name: str = ""
    value: float = 0.0
    parts: tuple["Tree", ...] = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at:].lstrip()[:1]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Tree:
    todo = [*tokens(text), ("end", "")][::-1]

    def take(sign: str) -> None:
        kind, value = todo.pop()
        if value != sign or kind != "sign":
            raise ExpressionError(f"expected {sign!r}, found {value or 'the end'!r}")

    def chain(signs: str, part) -> Tree:
        tree = part()
        while todo[-1][0] == "sign" and todo[-1][1] in signs:
            tree = Tree("binary", todo.pop()[1], parts=(tree, part()))
        return tree

    def expr() -> Tree:
        return chain("+-", term)

    def term() -> Tree:
        return chain("*/", signed)

    def signed() -> Tree:
        if todo[-1] in (("sign", "-"), ("sign", "+")):
            sign = todo.pop()[1]
            inner = signed()
            return Tree("negative", parts=(inner,)) if sign == "-" else inner
        return primary()

    def primary() -> Tree:
        kind, value = todo.pop()
        if kind == "number":
            return Tree("number", value=float(value))
        if kind == "sign" and value == "(":
            tree = expr()
            take(")")
            return tree
        if kind != "name":
            raise ExpressionError(f"unexpected {value or 'end'!r}")
        if todo[-1] != ("sign", "("):
            return Tree("column", value)
        todo.pop()
        parts = []
        while todo[-1] != ("sign", ")"):
            parts.append(expr())
            if todo[-1] != ("sign", ")"):
                take(",")
        todo.pop()
        return Tree("call", value.lower(), parts=tuple(parts))

    tree = expr()
    if todo[-1][0] != "end":
        raise ExpressionError(f"unexpected {todo[-1][1]!r}")
    check(tree)
    return tree


def _window(tree: Tree) -> int:
    if tree.kind != "number" or tree.value != int(tree.value) or tree.value < 1:
        raise ExpressionError("a window must be a positive whole number")
    return int(tree.value)


def check(tree: Tree) -> None:
    if tree.kind == "call":
        if tree.name in _AHEAD:
            raise ExpressionError(f"{tree.name} looks ahead and is not allowed")
        if tree.name == "rank":
            raise ExpressionError("rank is cross-sectional; use ts_rank")
        if tree.name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {tree.name}")
        n = FUNCTIONS[tree.name][1]
        if len(tree.parts) != n:
            raise ExpressionError(f"{tree.name} takes {n} arguments, not {len(tree.parts)}")
        if n == 2:
            _window(tree.parts[1])
    for part in tree.parts:
        check(part)


def summary(trees: list[Tree]) -> dict:
    """Columns, canonical functions, the largest single window, and the stage, over all expressions."""
    columns, functions, longest = set(), set(), 0
    todo = list(trees)
    while todo:
        t = todo.pop()
        if t.kind == "column":
            columns.add(t.name)
        if t.kind == "call":
            functions.add(FUNCTIONS[t.name][0])
            if FUNCTIONS[t.name][1] == 2:
                longest = max(longest, _window(t.parts[1]))
        todo += t.parts
    return {"columns": sorted(columns), "functions": sorted(functions), "max_lookback": longest, "stage": "time_series"}


def projection(trees: list[Tree]) -> tuple[list[str], bool]:
    """Source columns to read for some expressions, and whether vwap must be derived."""
    need = {"date", "symbol", "open", "volume", "amount", *summary(trees)["columns"]}
    derived = "vwap" in need
    return sorted((need | {"close", "amount", "volume"}) - {"vwap"} if derived else need), derived


def formula(tree: Tree) -> Node:
    if tree.kind == "number":
        return node(tree.value)
    if tree.kind == "column":
        return col(tree.name)
    if tree.kind == "negative":
        return -formula(tree.parts[0])
    if tree.kind == "binary":
        a, b = map(formula, tree.parts)
        if tree.name == "/":
            b = finite(b)
            return when(call("abs", b) > 1e-12, a / b)
        return a + b if tree.name == "+" else a - b if tree.name == "-" else a * b
    x = formula(tree.parts[0])
    name, n = FUNCTIONS[tree.name]
    if n == 1:
        return call({"abs": "abs", "log": "ln", "sqrt": "sqrt"}[name], x)
    w = _window(tree.parts[1])
    if name == "delay":
        return x.lag(w)
    if name == "delta":
        return x - x.lag(w)
    x = finite(x)
    return {"ts_mean": x.mean, "ts_sum": x.sum, "ts_std": x.std, "ts_min": x.min, "ts_max": x.max, "ts_rank": x.rank}[name](w)


def profile(document: dict) -> dict[str, Tree]:
    """Checked factors of a profile document: {"name": ..., "factors": [{"name": ..., "expr": ...}, ...]}."""
    found: dict[str, Tree] = {}
    for entry in document.get("factors") or []:
        name = entry.get("name", "")
        if name != name.strip():
            raise ExpressionError(f"whitespace around the factor name {name!r}")
        if not _NAME.fullmatch(name) or name in ("date", "symbol", "label") or name.startswith("label_"):
            raise ExpressionError(f"{name!r} can't name a factor")
        if name in found:
            raise ExpressionError(f"two factors are named {name}")
        found[name] = parse(entry["expr"])
    if not found:
        raise ExpressionError("a profile needs at least one factor")
    return found


def compute(panel: DataFrame, document: dict, keep: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The panel's keys and a column for each factor of a profile."""
    trees = profile(document)
    absent = set(summary(list(trees.values()))["columns"]) - set(panel.columns) - {"vwap"}
    if absent:
        raise ExpressionError(f"unknown columns: {', '.join(sorted(absent))}")
    if "vwap" not in panel.columns and any("vwap" in summary([t])["columns"] for t in trees.values()):
        panel = with_vwap(panel)
    return with_kernels(panel, {k: formula(t) for k, t in trees.items()}, keep=list(keep))
