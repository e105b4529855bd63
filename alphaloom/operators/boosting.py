"""Boosted regression trees on histograms, for one walk-forward window at a time.

Features become at most BINS ordered codes (missing is a code of its own); a tree grows leaf by leaf, the best split first, from sums of
gradients and curvatures per code. After each round the mean daily rank correlation (or another metric) of the validation rows decides
whether it was the best so far; after `patience` rounds without a better one the trees behind the best are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

#: Codes of a feature, the missing one aside.
BINS = 255


@dataclass(frozen=True)
class Boosting:
    objective: str = "l2"  # l2, l1, huber, binary or ranking
    rate: float = 0.05
    rounds: int = 200
    leaves: int = 31
    depth: int = 8
    least_rows: int = 20
    ridge: float = 1.0
    lasso: float = 0.0
    rows: float = 0.9  # share of rows that a tree sees
    columns: float = 0.9  # share of features that a tree sees
    huber: float = 0.9  # quantile of the residuals' size where huber turns linear
    metric: str = "daily_rank_ic"  # daily_rank_ic, daily_ic, valid_topk_label_mean, valid_topk_excess_mean or loss
    topk: int = 10
    patience: int = 50
    least_rounds: int = 0
    least_gain: float = 0.0
    seed: int = 42


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    binary: bool
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    importance: np.ndarray | None = None

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return self.base + sum((tree_values(t, codes) for t in self.trees), np.zeros(len(codes)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.raw(coded(x, self.edges))
        return 1 / (1 + np.exp(-out)) if self.binary else out


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the codes of each feature: its distinct values, or quantiles of them."""
    out = []
    for c in x.T:
        known = np.unique(c[np.isfinite(c)])
        out.append((known[:-1] + known[1:]) / 2 if len(known) <= bins else np.unique(np.quantile(known, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Codes from 1; 0 is missing."""
    return np.column_stack([np.where(np.isfinite(c), np.searchsorted(e, c, side="left") + 1, 0) for c, e in zip(x.T, edges)]).astype(np.int32) if x.shape[1] else np.zeros((len(x), 0), np.int32)


def tree_values(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """Leaf values of rows: nodes are (feature, last code to the left, left, right, value), a leaf's feature being -1."""
    feature, last, left, right, value = tree
    at = np.zeros(len(codes), np.int32)
    rows = np.arange(len(codes))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return value[at]
        to_left = codes[rows[inner], f[inner]] <= last[at[inner]]
        at[inner] = np.where(to_left, left[at[inner]], right[at[inner]])


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, s: Boosting, gains: np.ndarray) -> tuple[np.ndarray, ...]:
    width = int(codes.max(initial=0)) + 1
    shrunk = lambda x: np.sign(x) * np.maximum(np.abs(x) - s.lasso, 0.0)
    worth = lambda a, b: shrunk(a) ** 2 / (b + s.ridge)
    nodes: list[list] = []

    def best(at: np.ndarray):
        """(gain, feature, last code to the left) of the best split of some rows."""
        index = (codes[np.ix_(at, features)] + np.arange(len(features)) * width).ravel()
        size = len(features) * width
        sums = [np.bincount(index, np.repeat(v[at], len(features)) if v is not None else None, minlength=size).reshape(-1, width) for v in (g, h, None)]
        left = [np.cumsum(x, axis=1)[:, :-1] for x in sums]
        total = [x.sum(axis=1, keepdims=True) for x in sums]
        gain = worth(left[0], left[1]) + worth(total[0] - left[0], total[1] - left[1]) - worth(total[0], total[1])
        gain = np.where((left[2] >= s.least_rows) & (total[2] - left[2] >= s.least_rows), gain, -np.inf)
        if not gain.size:
            return -np.inf, 0, 0
        k = int(gain.argmax())
        return float(gain.ravel()[k]), int(features[k // (width - 1)]), k % (width - 1)

    def leaf(at: np.ndarray) -> int:
        nodes.append([-1, 0, 0, 0, float(-s.rate * shrunk(g[at].sum()) / (h[at].sum() + s.ridge))])
        return len(nodes) - 1

    open_ = [(leaf(rows), rows, 0, best(rows))] if width > 1 and len(features) else []
    if not open_:
        leaf(rows)
    grown = 1
    while open_ and grown < s.leaves:
        k = max(range(len(open_)), key=lambda i: open_[i][3][0])
        node, at, depth, (gain, f, last) = open_.pop(k)
        if not gain > 1e-12:
            break
        gains[f] += gain
        to_left = codes[at, f] <= last
        parts = at[to_left], at[~to_left]
        nodes[node][:4] = [f, last, leaf(parts[0]), leaf(parts[1])]
        grown += 1
        if depth + 1 < s.depth:
            for child, part in zip(nodes[node][2:4], parts):
                open_.append((child, part, depth + 1, best(part)))
    return tuple(np.array(c, float if k == 4 else np.int32) for k, c in enumerate(zip(*nodes)))


def _slopes(s: Boosting, y: np.ndarray, score: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by score."""
    r = score - y
    if s.objective == "l2":
        return r, np.ones(len(y))
    if s.objective == "l1":
        return np.sign(r), np.ones(len(y))
    if s.objective == "huber":
        at = np.quantile(np.abs(r), s.huber)
        return np.clip(r, -at, at), np.ones(len(y))
    if s.objective == "binary":
        p = 1 / (1 + np.exp(-score))
        return p - y, np.maximum(p * (1 - p), 1e-6)
    if s.objective == "ranking":  # listwise: softmax of scores against softmax of relevance, within a date
        p, q = (_softmax(x, groups) for x in (score, y))
        return p - q, np.maximum(p * (1 - p), 1e-6)
    raise ValueError(f"unknown objective {s.objective}")


def _softmax(x: np.ndarray, groups: np.ndarray) -> np.ndarray:
    top = np.full(groups.max(initial=-1) + 1, -np.inf)
    np.maximum.at(top, groups, x)
    e = np.exp(x - top[groups])
    return e / np.bincount(groups, e)[groups]


def _ranks(v: np.ndarray) -> np.ndarray:
    return pd.Series(v).rank().to_numpy()


def metric(s: Boosting, score: np.ndarray, y: np.ndarray, groups: np.ndarray) -> float:
    """Mean over dates, higher being better; of equal scores at the border of the k best the earlier rows count."""
    if s.metric == "loss":
        return -float(np.mean((score - y) ** 2))
    found = []
    for at in np.split(np.arange(len(y)), np.flatnonzero(np.diff(groups)) + 1) if len(y) else []:
        a, b = score[at], y[at]
        if s.metric in ("daily_ic", "daily_rank_ic"):
            if s.metric == "daily_rank_ic":
                a, b = _ranks(a), _ranks(b)
            if len(a) > 1 and a.min() < a.max() and b.min() < b.max():
                found.append(np.corrcoef(a, b)[0, 1])
        else:
            top = np.argsort(-a, kind="stable")[: s.topk]
            found.append(b[top].mean() - (b.mean() if s.metric == "valid_topk_excess_mean" else 0.0))
    return float(np.mean(found)) if found else float("-inf")


def fit(train: pd.DataFrame, valid: pd.DataFrame, features: list[str], settings: Boosting = Boosting(), date: str = "date") -> Model:
    """Trees from rows in date order with label (and sample_weight); validation rows stop it early, if there are any."""
    s = settings
    x, y = train[features].to_numpy(float), train["label"].to_numpy(float)
    weight = train["sample_weight"].to_numpy(float) if "sample_weight" in train else np.ones(len(y))
    groups, vgroups = (pd.factorize(f[date])[0] for f in (train, valid))
    edges = edges_of(x)
    codes, vcodes = coded(x, edges), coded(valid[features].to_numpy(float), edges)
    vy = valid["label"].to_numpy(float)
    mean = float(np.average(y, weights=weight)) if len(y) else 0.0
    base = mean
    if s.objective == "binary":
        base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    elif s.objective == "ranking":
        base = 0.0
    elif s.objective == "l1" and len(y):
        base = float(np.median(y))
    model = Model(edges, base, s.objective == "binary")
    gains, rng = np.zeros(len(features)), np.random.default_rng(s.seed)
    score, vscore = np.full(len(y), base), np.full(len(vy), base)
    best, best_round, best_gains = float("-inf"), 0, gains.copy()
    for k in range(s.rounds if len(y) else 0):
        g, h = _slopes(s, y, score, groups)
        rows = np.sort(rng.choice(len(y), max(1, int(len(y) * s.rows)), replace=False))
        chosen = np.sort(rng.choice(len(features), max(1, int(len(features) * s.columns)), replace=False)) if features else np.zeros(0, int)
        tree = _grow(codes, g * weight, h * weight, rows, chosen, s, gains)
        model.trees.append(tree)
        score += tree_values(tree, codes)
        if not len(vy):
            continue
        vscore += tree_values(tree, vcodes)
        model.history.append(metric(s, vscore, vy, vgroups))
        if model.history[-1] > best + s.least_gain or not k:
            best, best_round, best_gains = model.history[-1], k, gains.copy()
        elif s.patience and k + 1 > s.least_rounds and k - best_round >= s.patience:
            break
    if len(vy):
        model.trees = model.trees[: best_round + 1]
        gains = best_gains
    model.importance = gains
    return model


def learner(settings: Boosting = Boosting()) -> Callable:
    """A learner for `training.walk_forward`."""

    def learn(train: pd.DataFrame, valid: pd.DataFrame, features: list[str]):
        model = fit(train, valid, features, settings)
        predict = lambda f: model(f[features].to_numpy(float))
        predict.importance = dict(zip(features, model.importance.tolist()))
        predict.history = list(model.history)
        return predict

    return learn
