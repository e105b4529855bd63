"""Formulas over a symbol's time series, as small trees that become layered Spark selects (or SQL text of another engine).

Missing values are NULL. Rolling functions look at the last n rows of a symbol, skip missing values and need a minimum of
observed ones. Division follows IEEE rules except that 0/0 is missing. A tree may nest rolling functions freely: `layers`
cuts it into projections that alternate with window steps, shares equal parts by their text, and so leaves Spark one
exchange and one sort for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame

EPS = 1e-12


class Node:
    """A formula. Operators build larger ones; equal formulas have equal keys."""

    __slots__ = ("op", "args", "key")

    def __init__(self, op: str, *args):
        self.op, self.args = op, args
        self.key = f"{op}({','.join(a.key if isinstance(a, Node) else repr(a) for a in args)})"

    def __add__(self, o):
        return Node("+", self, node(o))

    def __radd__(self, o):
        return Node("+", node(o), self)

    def __sub__(self, o):
        return Node("-", self, node(o))

    def __rsub__(self, o):
        return Node("-", node(o), self)

    def __mul__(self, o):
        return Node("*", self, node(o))

    def __rmul__(self, o):
        return Node("*", node(o), self)

    def __truediv__(self, o):
        return Node("/", self, node(o))

    def __rtruediv__(self, o):
        return Node("/", node(o), self)

    def __neg__(self):
        return Node("neg", self)

    def __lt__(self, o):
        return Node("<", self, node(o))

    def __le__(self, o):
        return Node("<=", self, node(o))

    def __gt__(self, o):
        return Node(">", self, node(o))

    def __ge__(self, o):
        return Node(">=", self, node(o))

    def __and__(self, o):
        return Node("and", self, o)

    # Rolling functions.
    def lag(self, n: int):
        return self if n == 0 else Node("lag", self, n)

    def lead(self, n: int):
        return self if n == 0 else Node("lead", self, n)

    def count(self, n: int):
        return Node("count", self, n)

    def mean(self, n: int, least: int = 1):
        return gated(Node("mean", self, n), self, n, least)

    def sum(self, n: int, least: int = 1):
        return gated(Node("sum", self, n), self, n, least)

    def std(self, n: int, least: int = 2):
        return gated(Node("std", self, n), self, n, least if least > 2 else 1)

    def max(self, n: int, least: int = 1):
        return gated(Node("max", self, n), self, n, least)

    def min(self, n: int, least: int = 1):
        return gated(Node("min", self, n), self, n, least)

    def quantile(self, n: int, q: float):
        return Node("quantile", self, n, q)

    def rank(self, n: int):
        """(smaller + (equal + 1) / 2) / observed, of the current value."""
        return Node("rank", self, n)

    def place_of(self, n: int, highest: bool):
        """1-based place of the extreme in the frame; the first of ties; a missing value in the frame is the extreme."""
        return Node("place", self, n, highest)

    def since(self, n: int, highest: bool):
        """Rows since the extreme of a full frame; the oldest of ties."""
        return Node("since", self, n, highest)

    def deviation(self, n: int):
        """Mean absolute deviation of a full frame."""
        return Node("deviation", self, n)

    def slope(self, n: int):
        return Node("slope", self, self.ordinal(), n)

    def fit(self, n: int):
        """R squared of the line through the frame, missing for a constant one."""
        return Node("fit", self, self.ordinal(), n)

    def residual(self, n: int):
        """The last observed value less the line through the frame."""
        k = self.ordinal()
        return Node("last", self, n) - (Node("intercept", self, k, n) + self.slope(n) * Node("last", k, n))

    def ordinal(self):
        """1, 2, ... over observed rows."""
        return when(known(self), Node("running", self))

    def change(self, n: int):
        return self / self.lag(n) - 1.0

    def diff(self, n: int = 1):
        return self - self.lag(n)

    def age(self):
        """Rows since the last positive value; missing before the first."""
        row = Node("row")
        return row - Node("peak", when(self > 0.0, row))

    def streak(self):
        """Consecutive positive values up to here."""
        row = Node("row")
        return row - fill(Node("peak", when(Node("not", fill_false(self > 0.0)), row)), 0.0)


def node(x) -> Node:
    return x if isinstance(x, Node) else Node("number", float(x))


def col(name: str) -> Node:
    return Node("column", name)


def when(condition: Node, value, otherwise=None) -> Node:
    return Node("when", condition, node(value)) if otherwise is None else Node("when", condition, node(value), node(otherwise))


def known(x: Node) -> Node:
    return Node("known", x)


def fill(x: Node, value: float) -> Node:
    return Node("fill", x, float(value))


def fill_false(x: Node) -> Node:
    return Node("fill_false", x)


def flag(condition: Node) -> Node:
    """1 or 0, missing where the condition is."""
    return Node("flag", condition)


def sure(condition: Node) -> Node:
    """1 where the condition holds, else 0."""
    return Node("flag", fill_false(condition))


def call(name: str, *args) -> Node:
    return Node(name, *(node(a) for a in args))


def gated(value: Node, x: Node, n: int, least: int) -> Node:
    return value if least <= 1 else when(Node("count", x, n) >= float(least), value)


def nonzero(x: Node) -> Node:
    return Node("nonzero", x)


def finite(x: Node) -> Node:
    return Node("finite", x)


def corr(x: Node, y: Node, n: int) -> Node:
    """Pearson correlation of the rows where both are known, from centred values; missing below two rows or where either is constant."""
    return Node("corr", when(known(y), x), when(known(x), y), n)


def undefined(c: Node) -> Node:
    """Whether a `corr` has rows but no value, since there is one only or a side is constant; without rows it is missing."""
    return (Node("count", c.args[0], c.args[2]) > 0.0) & Node("not", known(c))


def blend(parts: Iterable[tuple[float, Node]], share: float = 0.5) -> Node:
    """Weighted sum of the known parts, missing unless their absolute weights reach a share of all; not renormalised."""
    parts = list(parts)
    total = seen = None
    for w, x in parts:
        term, weight = fill(x * w, 0.0), when(known(x), abs(w), 0.0)
        total = term if total is None else total + term
        seen = weight if seen is None else seen + weight
    return when(seen >= share * sum(abs(w) for w, _ in parts), total)


def bounded(x: Node, scale: float = 1.0) -> Node:
    return call("tanh", x / scale)


ROLLING = {"lag", "lead", "count", "mean", "sum", "std", "max", "min", "quantile", "rank", "place", "since", "deviation", "slope", "fit", "intercept", "corr", "last", "running", "row", "peak"}


class Spark:
    """SQL text for Spark."""

    name = "spark"
    quote = "`"

    def number(self, x: float) -> str:
        return f"{x!r}D"

    def frame(self, n: int) -> str:
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def __init__(self, by: str = "symbol", order: str = "date"):
        self.by, self.order = by, order

    def clean(self, x: str) -> str:
        return f"nanvl({x}, CAST(NULL AS DOUBLE))"

    infinity = "DOUBLE('Infinity')"

    def last(self, x: str, n: int) -> str:
        return f"last_value({x}) IGNORE NULLS {self.frame(n)}"

    def quantile(self, x: str, n: int, q: float) -> str:
        return f"percentile({x}, {q!r}D) {self.frame(n)}"

    def rank(self, x: str, n: int) -> str:
        l = f"collect_list({x}) {self.frame(n)}"
        return f"CASE WHEN {x} IS NOT NULL THEN aggregate({l}, 0D, (a, v) -> a + CASE WHEN v < {x} THEN 1D WHEN v = {x} THEN 0.5D ELSE 0D END, a -> a + 0.5D) / count({x}) {self.frame(n)} END"

    def place(self, x: str, n: int, highest: bool) -> str:
        l, ext = f"transform(collect_list(struct({x} AS x)) {self.frame(n)}, e -> e.x)", "array_max" if highest else "array_min"
        miss = f"array_position(transform({l}, e -> e IS NULL), true)"
        return f"CAST(CASE WHEN count({x}) {self.frame(n)} > 0 THEN CASE WHEN {miss} > 0 THEN {miss} ELSE array_position({l}, {ext}({l})) END END AS DOUBLE)"

    def since(self, x: str, n: int, highest: bool) -> str:
        l, ext = f"collect_list({x}) {self.frame(n)}", "array_max" if highest else "array_min"
        return f"CASE WHEN count({x}) {self.frame(n)} = {n} THEN CAST({n} - array_position({l}, {ext}({l})) AS DOUBLE) END"

    def deviation(self, x: str, n: int) -> str:
        return f"CASE WHEN count({x}) {self.frame(n)} = {n} THEN aggregate(collect_list({x}) {self.frame(n)}, 0D, (a, v) -> a + abs(v - avg({x}) {self.frame(n)})) / {n}D END"


class Duck(Spark):
    """SQL text for DuckDB, for differential tests."""

    name = "duckdb"
    quote = '"'
    infinity = "CAST('Infinity' AS DOUBLE)"

    def number(self, x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    def clean(self, x: str) -> str:
        return x

    def last(self, x: str, n: int) -> str:
        return f"last_value({x} IGNORE NULLS) {self.frame(n)}"

    def quantile(self, x: str, n: int, q: float) -> str:
        return f"quantile_cont({x}, {q!r}) {self.frame(n)}"

    def _list(self, x: str, n: int) -> str:
        return f"(list({x}) {self.frame(n)})"

    def rank(self, x: str, n: int) -> str:
        l = f"list_filter({self._list(x, n)}, lambda v: v IS NOT NULL)"
        return f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter({l}, lambda v: v < {x})) + (len(list_filter({l}, lambda v: v = {x})) + 1) * 0.5::DOUBLE) / len({l}) END"

    def place(self, x: str, n: int, highest: bool) -> str:
        l, ext = self._list(x, n), "list_max" if highest else "list_min"
        miss = f"list_position(list_transform({l}, lambda v: v IS NULL), true)"
        return f"CAST(CASE WHEN count({x}) {self.frame(n)} > 0 THEN CASE WHEN {miss} > 0 THEN {miss} ELSE list_position({l}, {ext}({l})) END END AS DOUBLE)"

    def since(self, x: str, n: int, highest: bool) -> str:
        l, ext = self._list(x, n), "list_max" if highest else "list_min"
        return f"CASE WHEN count({x}) {self.frame(n)} = {n} THEN CAST({n} - list_position({l}, {ext}({l})) AS DOUBLE) END"

    def deviation(self, x: str, n: int) -> str:
        m = f"(avg({x}) {self.frame(n)})"
        return f"CASE WHEN count({x}) {self.frame(n)} = {n} THEN list_sum(list_transform({self._list(x, n)}, lambda v: abs(v - {m}))) / {n}.0::DOUBLE END"


class _Compiler:
    def __init__(self, outputs: dict[str, Node], dialect: Spark):
        self.outputs, self.d = outputs, dialect
        self.level: dict[str, int] = {}
        self.users: dict[str, int] = {}
        self.nodes: dict[str, Node] = {}
        self.feeds: set[str] = set()
        for out in outputs.values():
            self._visit(out)
        held = lambda n: n.op in ROLLING or (n.op not in ("column", "number") and (n.key in self.feeds or self.users[n.key] > 1) and n.op not in ("<", "<=", ">", ">=", "and", "known", "not", "fill_false"))
        self.held = {k: f"_{hashlib.md5(k.encode()).hexdigest()[:16]}" for k, n in self.nodes.items() if held(n)}

    def _visit(self, n: Node) -> int:
        self.users[n.key] = self.users.get(n.key, 0) + 1
        if n.key in self.level:
            return self.level[n.key]
        kids = [a for a in n.args if isinstance(a, Node)]
        depth = max((self._visit(a) for a in kids), default=0)
        if n.op in ROLLING:
            depth += 1
            self.feeds.update(a.key for a in kids)
        self.level[n.key] = depth
        self.nodes[n.key] = n
        return depth

    def text(self, n: Node, inside: bool = True) -> str:
        if inside and n.key in self.held:
            return self.held[n.key]
        d, a = self.d, [self.text(x) if isinstance(x, Node) else x for x in n.args]
        op = n.op
        if op == "column":
            return f"{d.quote}{a[0]}{d.quote}"
        if op == "number":
            return d.number(a[0])
        if op in ("+", "-", "*", "<", "<=", ">", ">="):
            return f"({a[0]} {op} {a[1]})"
        if op == "and":
            return f"({a[0]} AND {a[1]})"
        if op == "/":
            if n.args[1].op == "number" and n.args[1].args[0] != 0:
                return f"({a[0]} / {a[1]})"
            return f"(CASE WHEN {a[1]} = 0 THEN CASE WHEN {a[0]} > 0 THEN {d.infinity} WHEN {a[0]} < 0 THEN -{d.infinity} END ELSE {a[0]} / {a[1]} END)"
        simple = {
            "neg": "(-{0})", "known": "({0} IS NOT NULL)", "not": "(NOT {0})", "fill_false": "coalesce({0}, false)", "nonzero": "nullif({0}, 0)", "abs": "abs({0})",
            "exp": "exp({0})", "tanh": "tanh({0})", "ln": "CASE WHEN {0} > 0 THEN ln({0}) END", "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "sign": "CAST(sign({0}) AS DOUBLE)",
            "higher": "CASE WHEN {0} >= {1} THEN {0} WHEN {1} > {0} THEN {1} END", "lower": "CASE WHEN {0} <= {1} THEN {0} WHEN {1} < {0} THEN {1} END", "highest": "greatest({0}, {1})",
            "float": "CAST(CAST({0} AS FLOAT) AS DOUBLE)", "pow": "power({0}, {1})", "floor": "CAST(floor({0}) AS DOUBLE)",
        }
        if op in simple:
            return simple[op].format(*a)
        if op == "float_sum3":
            return "CAST(CAST(CAST(CAST({0} AS FLOAT) + CAST({1} AS FLOAT) + CAST({2} AS FLOAT) AS DOUBLE) / 3 AS FLOAT) AS DOUBLE)".format(*a)
        if op == "flag":
            return f"CASE WHEN {a[0]} THEN {d.number(1.0)} WHEN NOT {a[0]} THEN {d.number(0.0)} END"
        if op == "fill":
            return f"coalesce({a[0]}, {d.number(a[1])})"
        if op == "finite":
            return f"CASE WHEN abs({a[0]}) < {d.infinity} THEN {a[0]} END"
        if op == "when":
            return f"CASE WHEN {a[0]} THEN {a[1]}" + (f" ELSE {a[2]}" if len(a) > 2 else "") + " END"
        over = f"OVER (PARTITION BY {d.by} ORDER BY {d.order})"
        past = f"OVER (PARTITION BY {d.by} ORDER BY {d.order} ROWS UNBOUNDED PRECEDING)"
        if op == "row":
            return f"CAST(row_number() {over} AS DOUBLE)"
        if op in ("lag", "lead"):
            return f"{op}({a[0]}, {a[1]}) {over}"
        if op == "running":
            return f"CAST(count({a[0]}) {past} AS DOUBLE)"
        if op == "peak":
            return f"max({a[0]}) {past}"
        if op == "count":
            return f"CAST(count({a[0]}) {d.frame(a[1])} AS DOUBLE)"
        if op in ("mean", "sum", "max", "min"):
            return f"{'avg' if op == 'mean' else op}({a[0]}) {d.frame(a[1])}"
        if op == "std":
            return f"CASE WHEN count({a[0]}) {d.frame(a[1])} >= 2 THEN {d.clean(f'stddev_samp({a[0]}) {d.frame(a[1])}')} END"
        if op in ("slope", "intercept"):
            return f"CASE WHEN count({a[0]}) {d.frame(a[2])} >= 2 THEN {d.clean(f'regr_{op}({a[0]}, {a[1]}) {d.frame(a[2])}')} END"
        if op == "fit":
            f = d.frame(a[2])
            return f"CASE WHEN count({a[0]}) {f} >= 2 AND min({a[0]}) {f} < max({a[0]}) {f} THEN least({d.number(1.0)}, greatest({d.number(0.0)}, regr_r2({a[0]}, {a[1]}) {f})) END"
        if op == "corr":
            f = d.frame(a[2])
            return f"CASE WHEN min({a[0]}) {f} < max({a[0]}) {f} AND min({a[1]}) {f} < max({a[1]}) {f} THEN {d.clean(f'covar_samp({a[0]}, {a[1]}) {f} / (stddev_samp({a[0]}) {f} * stddev_samp({a[1]}) {f})')} END"
        return getattr(d, op)(*a)

    def stages(self) -> list[dict[str, str]]:
        """Selects in order: name -> SQL text of what each adds."""
        steps: dict[tuple[int, int], dict[str, str]] = {}
        inner: dict[str, int] = {}

        def depth(n: Node) -> int:
            """Place of a held scalar among those of its level."""
            if n.key not in inner:
                same = [x for x in self._below(n) if x.op not in ROLLING and self.level[x.key] == self.level[n.key]]
                inner[n.key] = 1 + max((depth(x) for x in same), default=0)
            return inner[n.key]

        for key, name in self.held.items():
            n = self.nodes[key]
            place = (self.level[key], 0 if n.op in ROLLING else depth(n))
            text = self.text(n, inside=False)
            # Frames skip what is missing, so infinity times 0 must be missing before one sees it.
            steps.setdefault(place, {})[name] = self.d.clean(text) if n.op in ("+", "-", "*", "/") else text
        return [steps[k] for k in sorted(steps)]

    def _below(self, n: Node) -> list[Node]:
        """The nearest held nodes under n."""
        out, todo = [], [a for a in n.args if isinstance(a, Node)]
        while todo:
            x = todo.pop()
            if x.key in self.held:
                out.append(x)
            else:
                todo += [a for a in x.args if isinstance(a, Node)]
        return out


def with_formulas(panel: DataFrame, formulas: dict[str, Node], by: str = "symbol", order: str = "date", keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns by default) of the panel, and a column for each formula."""
    c = _Compiler(formulas, Spark(by, order))
    keep = panel.columns if keep is None else keep
    df = panel
    for step in c.stages():
        df = df.selectExpr("*", *(f"{text} AS {name}" for name, text in step.items()))
    return df.selectExpr(*(f"`{k}`" for k in keep), *(f"{c.text(f)} AS `{name}`" for name, f in formulas.items()))


def duck_sql(source: str, formulas: dict[str, Node], keep: list[str], digits: int = 6, by: str = "symbol", order: str = "date", ctes: str = "") -> str:
    """A DuckDB query for the same formulas over a table, rounded."""
    d = Duck(by, order)
    c = _Compiler(formulas, d)
    parts, last = [ctes] if ctes else [], source
    for k, step in enumerate(c.stages()):
        parts.append(f"_s{k} AS (SELECT *, {', '.join(f'{t} AS {n}' for n, t in step.items())} FROM {last})")
        last = f"_s{k}"
    parts.append(f"_out AS (SELECT {', '.join([*keep, *(f'{c.text(f)} AS {n}' for n, f in formulas.items())])} FROM {last})")
    final = ", ".join([*keep, *(f"CASE WHEN abs({n}) < {d.infinity} THEN round({n}, {digits}) + 0.0 END AS {n}" for n in formulas)])
    return f"WITH {', '.join(parts)} SELECT {final} FROM _out"


def rounded(df: DataFrame, names: Iterable[str], digits: int = 6) -> DataFrame:
    """df with the named columns rounded, non-finite values as missing and no negative zero."""
    names = set(names)
    return df.selectExpr(*(f"CASE WHEN abs(`{c}`) < DOUBLE('Infinity') THEN round(`{c}`, {digits}) + 0D END AS `{c}`" if c in names else f"`{c}`" for c in df.columns))
