"""Formulas on Arrow batches of whole symbols: what makes factors, one or all of them.

A sliding SQL frame is aggregated anew for each row and function, one value at a time. Here a rolling function is one numpy expression over
all rows of a batch: frames are strided views of the concatenated symbols, cut off where a symbol begins. Formulas, order of rows and
results are those of `with_formulas`, which tests hold against it; labels and the few lags that other operators need are made by SQL windows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .expr import Node

#: Rows of a frame matrix that one pass holds, in elements.
CELLS = 4_000_000


class Batch:
    """Columns of whole symbols in order, and what has been computed of them."""

    def __init__(self, columns: dict[str, np.ndarray], begins: np.ndarray):
        self.columns, self.n = columns, len(begins)
        #: Row number within the symbol, from 0.
        first = np.flatnonzero(begins)
        self.first = np.repeat(first, np.diff(np.append(first, self.n)))
        self.row = np.arange(self.n) - self.first
        self.left = np.repeat(np.append(first[1:], self.n), np.diff(np.append(first, self.n))) - np.arange(self.n) - 1
        self.made: dict[str, np.ndarray] = {}

    def value(self, n: Node) -> np.ndarray:
        found = self.made.get(n.key)
        if found is None:
            args = [self.value(a) if isinstance(a, Node) else a for a in n.args]
            found = getattr(self, _NAMES.get(n.op, n.op))(*args)
            if n.op not in ("number", "column"):
                self.made[n.key] = found
        return found

    # Scalars. NaN is missing; conditions are 1, 0 or NaN.
    def column(self, name):
        return self.columns[name]

    def number(self, x):
        return np.float64(x)

    def add(self, a, b):
        return a + b

    def sub(self, a, b):
        return a - b

    def mul(self, a, b):
        return a * b

    def div(self, a, b):
        return np.where(b == 0, np.where(a > 0, np.inf, np.where(a < 0, -np.inf, np.nan)), a / b)

    def neg(self, a):
        return -a

    def _compare(self, test, a, b):
        return np.where(np.isnan(a) | np.isnan(b), np.nan, test)

    def lt(self, a, b):
        return self._compare(a < b, a, b)

    def le(self, a, b):
        return self._compare(a <= b, a, b)

    def gt(self, a, b):
        return self._compare(a > b, a, b)

    def ge(self, a, b):
        return self._compare(a >= b, a, b)

    def both(self, a, b):
        return np.where((a == 0) | (b == 0), 0.0, a + b - 1)

    def known(self, a):
        return np.where(np.isnan(a), 0.0, 1.0)

    def negated(self, a):
        return 1 - a

    def fill_false(self, a):
        return np.where(np.isnan(a), 0.0, a)

    def flag(self, a):
        return a

    def when(self, c, a, b=np.float64(np.nan)):
        return np.where(c == 1, a, b)

    def fill(self, a, x):
        return np.where(np.isnan(a), x, a)

    def nonzero(self, a):
        return np.where(a == 0, np.nan, a)

    def finite(self, a):
        return np.where(np.abs(a) < np.inf, a, np.nan)

    def abs(self, a):
        return np.abs(a)

    def exp(self, a):
        return np.exp(a)

    def tanh(self, a):
        return np.tanh(a)

    def ln(self, a):
        return np.where(a > 0, np.log(np.where(a > 0, a, 1.0)), np.nan)

    def sqrt(self, a):
        return np.where(a >= 0, np.sqrt(np.where(a >= 0, a, 0.0)), np.nan)

    def sign(self, a):
        return np.sign(a)

    def higher(self, a, b):
        return np.maximum(a, b)

    def lower(self, a, b):
        return np.minimum(a, b)

    def highest(self, a, b):
        return np.fmax(a, b)

    def float(self, a):
        return a.astype(np.float32).astype(np.float64)

    def float_sum3(self, a, b, c):
        total = a.astype(np.float32) + b.astype(np.float32) + c.astype(np.float32)
        return (total.astype(np.float64) / 3).astype(np.float32).astype(np.float64)

    def pow(self, a, b):
        return np.power(a, b)

    def floor(self, a):
        return np.floor(a)

    # Along the rows of a symbol.
    def _full(self, x):
        return np.broadcast_to(x, self.n) if np.ndim(x) == 0 else x

    def lag(self, x, n):
        out = np.full(self.n, np.nan)
        if n < self.n:
            out[n:] = self._full(x)[:-n]
        return np.where(self.row >= n, out, np.nan)

    def lead(self, x, n):
        out = np.full(self.n, np.nan)
        if n < self.n:
            out[:-n] = self._full(x)[n:]
        return np.where(self.left >= n, out, np.nan)

    def row_number(self):
        return self.row + 1.0

    def running(self, x):
        total = np.cumsum(~np.isnan(self._full(x)))
        before = np.where(self.first > 0, total[self.first - 1], 0)
        return (total - before).astype(float)

    def peak(self, x):
        """Running maximum; row numbers only grow, so a global one per symbol is found by offsetting symbols."""
        x = self._full(x)
        low, high = np.nanmin(x, initial=0.0), np.nanmax(x, initial=0.0)
        width = high - low + 1
        place = np.cumsum(self.row == 0) * 2 * width
        best = np.maximum.accumulate(np.where(np.isnan(x), -np.inf, x - low + place))
        value = best - place + low
        return np.where(value >= low - 0.5, value, np.nan)

    def _frames(self, work, x, n, *more):
        """work over the frames of the last n rows, NaN where they begin before the symbol."""
        columns = [np.concatenate([np.full(n - 1, np.nan), self._full(c)]) for c in (x, *more)]
        out = np.full(self.n, np.nan)
        step = max(1, CELLS // n)
        place = np.arange(n - 1, -1, -1)  # rows before the current one
        for a in range(0, self.n, step):
            b = min(self.n, a + step)
            own = place[None, :] > self.row[a:b, None]
            views = [np.where(own, np.nan, np.lib.stride_tricks.sliding_window_view(c[a : b + n - 1], n)) for c in columns]
            out[a:b] = work(*views, ~own)
        return out

    def _rolled(self, x, n, kind):
        """Sum or count of known values in the last n rows, by doubling partial sums: no cancellation, log n passes."""
        x = self._full(x)
        base = np.where(np.isnan(x), 0.0, x if kind == "sum" else 1.0)
        power, size, out, at = base, 1, np.zeros(self.n), 0
        while True:
            if n & size:
                # The frame is put together of blocks of powers of two, the nearest first.
                out = out + self._moved(power, at)
                at += size
            if 2 * size > n:
                return out
            power = power + self._moved(power, size)
            size *= 2

    def _moved(self, x, n):
        if n == 0:
            return x
        out = np.zeros(self.n)
        if n < self.n:
            out[n:] = x[:-n]
        return np.where(self.row >= n, out, 0.0)

    def count(self, x, n):
        return self._rolled(x, n, "count")

    def sum(self, x, n):
        return np.where(self._rolled(x, n, "count") > 0, self._rolled(x, n, "sum"), np.nan)

    def mean(self, x, n):
        c = self._rolled(x, n, "count")
        return np.where(c > 0, self._rolled(x, n, "sum") / np.maximum(c, 1), np.nan)

    def _extreme(self, x, n, f, empty):
        base = np.where(np.isnan(self._full(x)), empty, self._full(x))
        power, size, out, at = base, 1, np.full(self.n, empty), 0

        def moved(v, k):
            if k == 0:
                return v
            shifted = np.full(self.n, empty)
            if k < self.n:
                shifted[k:] = v[:-k]
            return np.where(self.row >= k, shifted, empty)

        while True:
            if n & size:
                out = f(out, moved(power, at))
                at += size
            if 2 * size > n:
                break
            power = f(power, moved(power, size))
            size *= 2
        return np.where(self._rolled(x, n, "count") > 0, out, np.nan)

    def max(self, x, n):
        return self._extreme(x, n, np.maximum, -np.inf)

    def min(self, x, n):
        return self._extreme(x, n, np.minimum, np.inf)

    def std(self, x, n):
        def work(v, _):
            c = (~np.isnan(v)).sum(1)
            mean = np.nansum(v, 1) / np.maximum(c, 1)
            return np.where(c >= 2, np.sqrt(np.nansum((v - mean[:, None]) ** 2, 1) / np.maximum(c - 1, 1)), np.nan)

        return self._frames(work, x, n)

    def quantile(self, x, n, q):
        def work(v, _):
            c = (~np.isnan(v)).sum(1)
            s = np.sort(v, axis=1)
            at = q * np.maximum(c - 1, 0)
            a = np.floor(at).astype(int)
            lo, hi = (np.take_along_axis(s, np.minimum(k, n - 1)[:, None], 1)[:, 0] for k in (a, np.ceil(at).astype(int)))
            return np.where(c > 0, lo + (hi - lo) * (at - a), np.nan)

        return self._frames(work, x, n)

    def rank(self, x, n):
        def work(v, _):
            last = v[:, -1:]
            c = (~np.isnan(v)).sum(1)
            return np.where(np.isnan(last[:, 0]), np.nan, ((v < last).sum(1) + ((v == last).sum(1) + 1) * 0.5) / np.maximum(c, 1))

        return self._frames(work, x, n)

    def place(self, x, n, highest):
        def work(v, inside):
            known = ~np.isnan(v)
            missing = inside & ~known
            low = np.where(known, v if highest else -v, -np.inf)
            at = np.where(missing.any(1), missing.argmax(1), np.where(known, low, -np.inf).argmax(1))
            # Frames of only minus infinities would name a row before the symbol.
            at = np.maximum(at, inside.argmax(1))
            return np.where(known.any(1), at - inside.argmax(1) + 1.0, np.nan)

        return self._frames(work, x, n)

    def since(self, x, n, highest):
        def work(v, _):
            full = ~np.isnan(v).any(1)
            return np.where(full, n - 1.0 - np.where(np.isnan(v), 0.0, v if highest else -v).argmax(1), np.nan)

        return self._frames(work, x, n)

    def deviation(self, x, n):
        return self._frames(lambda v, _: np.abs(v - v.mean(1, keepdims=True)).mean(1), x, n)

    def last(self, x, n):
        def work(v, _):
            known = ~np.isnan(v)
            at = n - 1 - known[:, ::-1].argmax(1)
            return np.where(known.any(1), np.take_along_axis(v, at[:, None], 1)[:, 0], np.nan)

        return self._frames(work, x, n)

    def _line(self, y, k, n, kind):
        def work(v, t, _):
            ok = ~np.isnan(v)
            c = ok.sum(1)
            m = np.maximum(c, 1)
            my, mt = np.nansum(v, 1) / m, np.where(ok, t, 0.0).sum(1) / m
            dy, dt = np.where(ok, v - my[:, None], 0.0), np.where(ok, t - mt[:, None], 0.0)
            sty, stt = (dy * dt).sum(1), (dt * dt).sum(1)
            slope = sty / np.where(stt > 0, stt, np.nan)
            if kind == "slope":
                return np.where(c >= 2, slope, np.nan)
            if kind == "intercept":
                return np.where(c >= 2, my - slope * mt, np.nan)
            lo, hi = np.where(ok, v, np.inf).min(1), np.where(ok, v, -np.inf).max(1)
            return np.where((c >= 2) & (lo < hi), np.clip(sty * sty / (stt * (dy * dy).sum(1)), 0, 1), np.nan)

        return self._frames(work, y, n, k)

    def corr(self, x, y, n):
        """x and y are known on the same rows."""

        def work(v, t, _):
            ok = ~np.isnan(v)
            m = np.maximum(ok.sum(1), 1)
            dv, dt = (np.where(ok, a - (np.nansum(a, 1) / m)[:, None], 0.0) for a in (v, t))
            # Means are rounded, so what is constant is told by its extremes.
            vary = [np.where(ok, a, np.inf).min(1) < np.where(ok, a, -np.inf).max(1) for a in (v, t)]
            return np.where(vary[0] & vary[1], (dv * dt).sum(1) / (np.sqrt((dv * dv).sum(1)) * np.sqrt((dt * dt).sum(1))), np.nan)

        return self._frames(work, x, n, y)

    def ewm(self, x, alpha, least):
        """Recursive mean seeded with the first known value, all symbols of the batch a row at a time; missing rows show nothing and change nothing."""
        x = self._full(x)
        starts = np.flatnonzero(self.row == 0)
        length = np.diff(np.append(starts, self.n))
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        level, seen, out = np.full(len(starts), np.nan), np.zeros(len(starts)), np.full(self.n, np.nan)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t))
            at = starts[:live] + t
            v, now = x[at], level[:live]
            known = ~np.isnan(v)
            now = np.where(known, np.where(np.isnan(now), v, alpha * v + (1 - alpha) * now), now)
            level[:live] = now
            seen[:live] += known
            out[at] = np.where(known & (seen[:live] >= least), now, np.nan)
        return out

    def slope(self, y, k, n):
        return self._line(y, k, n, "slope")

    def intercept(self, y, k, n):
        return self._line(y, k, n, "intercept")

    def fit(self, y, k, n):
        return self._line(y, k, n, "fit")


_NAMES = {"+": "add", "-": "sub", "*": "mul", "/": "div", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "and": "both", "not": "negated", "row": "row_number"}


def _columns(n: Node) -> set[str]:
    return {n.args[0]} if n.op == "column" else set().union(*(_columns(a) for a in n.args if isinstance(a, Node)))


def with_kernels(panel: DataFrame, formulas: dict[str, Node], by: str = "symbol", order: str = "date", keep: list[str] | None = None, floats: bool = False) -> DataFrame:
    """`with_formulas`, in one pass over Arrow batches: one exchange and sort by symbol, no SQL windows."""
    keep = panel.columns if keep is None else keep
    needed = sorted(set().union(*(_columns(f) for f in formulas.values())))
    first = list(dict.fromkeys([by, *keep]))
    source = panel.select(*first, *(panel[c].cast("double").alias(f"_in_{c}") for c in needed))
    kind = pa.float32() if floats else pa.float64()
    types = dict(panel.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"`{n}` {'float' if floats else 'double'}" for n in formulas)])

    def made(table: pa.Table) -> pa.RecordBatch:
        names = table.column(by).to_pandas().to_numpy()
        begins = np.ones(len(names), bool)
        begins[1:] = names[1:] != names[:-1]
        columns = {c: table.column(f"_in_{c}").to_pandas().to_numpy(np.float64) for c in needed}
        with warnings.catch_warnings(), np.errstate(all="ignore"):
            warnings.simplefilter("ignore")
            batch = Batch(columns, begins)
            out = [pa.array(np.ascontiguousarray(batch._full(batch.value(f))).astype(kind.to_pandas_dtype()), kind, from_pandas=True) for f in formulas.values()]
        return pa.record_batch([*(table.column(k).combine_chunks() for k in keep), *out], names=[*keep, *formulas])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols are kept whole: the last of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held)
            names = table.column(by).to_pandas().to_numpy()
            end = int(np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))[-1])
            if end:
                yield made(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
        if rows:
            yield made(pa.Table.from_batches(held))

    dealt = source.repartition(by).sortWithinPartitions(by, order) if order in first else panel.select(*first, order, *(panel[c].cast("double").alias(f"_in_{c}") for c in needed)).repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInArrow(run, schema)
