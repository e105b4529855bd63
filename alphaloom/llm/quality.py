"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each document becomes a fixed vector of surface statistics of its whole text. A preference pair is a labelled good
document over a labelled bad one; the Bradley-Terry model P(a over b) = sigmoid(w.(f(a) - f(b))) is fitted by Newton
steps on the logistic loss of feature differences. The decision threshold is a quantile of the scores: the share of bad
labels in the training rows. The published score is a logistic curve through that quantile at `cut`.

Every training row takes part in the scales, the pairs, the threshold and the curve. Pairs of all rows would grow with
their square, so rows are dealt to blocks of about BLOCK by a hash of doc_id, and each good row of a block is preferred over
each of its bad ones; up to BLOCK rows these are all pairs. A class too rare for all blocks is repeated in several, for
the pairs only. Blocks are written once; tasks send sums of them, whose size doesn't depend on the rows.

Defined results: null and empty texts have the same (all-zero count) features and get a score as any other text; rows
with a null or unknown label teach nothing; very long texts are read whole; repeated rows are scored each, and of rows that repeat a labelled
id the one whose text's digest sorts first teaches; with one label class or no labels at all every score is the share of good labels (0.5 without
labels); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, held_out, saved, scratch, split

#: Training rows of a block, about.
BLOCK = 4096
#: Rows of either class that a block should have, about; a class with fewer is repeated.
RARE = 32
#: Pairs that a task holds at once.
CELLS = 1 << 20
#: Ranges that a pass counts to find a value by its rank, and most values that it then looks at one by one.
BINS, FEW = 4096, 10_000

_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyz", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789",
    "stops": b".,;:'\"-()?", "marks": b"!", "signs": b"#$%&*+/<=>@[\\]^_`{|}~", "spaces": b" \t\r\x0b\x0c", "lines": b"\n",
}
_BYTE_CLASS = np.zeros(256, dtype=np.int64)
for _n, _members in enumerate(_CLASSES.values(), 1):
    _BYTE_CLASS[list(_members)] = _n
_SIGNS = set("#$%&*+/<=>@[\\]^_`{|}~!")

FEATURES = [
    *(f"share_{name}" for name in ("other", *_CLASSES)), "log_words", "log_bytes", "word_length", "distinct_words",
    "top_word", "repeated_next", "log_longest_repeat", "signed_words", "capital_words", "sign_only_words", "short_words", "long_words",
    "log_lines", "words_per_line", "distinct_lines", "ended_lines", "short_lines", "distinct_pairs", "any_signs", "any_repeat",
]


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text, in the order of FEATURES."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    size = max(1, len(data))
    shares = np.bincount(_BYTE_CLASS[data], minlength=len(_CLASSES) + 1) / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    run = longest = repeated = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        repeated += a == b
        longest = max(longest, run)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    signed = sum(w[-1] in _SIGNS for w in words) / n
    return [
        *shares.tolist(), math.log1p(len(words)), math.log1p(len(data)), sum(map(len, words)) / n, len(counts) / n,
        max(counts.values(), default=0) / n, (repeated - 1) / n, math.log(longest), signed, sum(len(w) > 1 and w.isupper() for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n, sum(len(w) <= 2 for w in words) / n, sum(len(w) > 12 for w in words) / n,
        math.log1p(len(lines)), math.log1p(len(words) / k), len(set(lines)) / k, sum(x.rstrip()[-1] in ".!?" for x in lines) / k, sum(len(x) < 20 for x in lines) / k,
        len(set(zip(words, words[1:]))) / n, float(signed > 0.02), float(longest > 2),
    ]


def _vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, a digest of the text (null texts sort last) and the features' bytes."""
    texts = batch.column(1).to_pylist()
    digests = [b"\xff" * 17 if t is None else hashlib.md5(t.encode()).digest() for t in texts]
    rows = [np.array(features(t)).tobytes() for t in texts]
    return pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "digest", "f"])


def _block(t: pa.Table) -> pa.Table:
    """A block's rows as one: its good and its bad features, of each class the rows that are no repetitions first."""
    order = sorted(range(t.num_rows), key=lambda k, c=t["copy"].to_pylist(), d=t["doc_id"].to_pylist(): (c[k] > 0, d[k]))
    f, copy, label = t["f"].to_pylist(), t["copy"].to_pylist(), t["label"].to_pylist()
    out = {"block": pa.array(t["block"].to_pylist()[:1], pa.int64())}
    for name, value in (("good", 1), ("bad", 0)):
        out[name] = pa.array([b"".join(f[k] for k in order if label[k] == value)], pa.binary())
        out[f"own_{name}"] = pa.array([sum(label[k] == value and copy[k] == 0 for k in order)], pa.int64())
    return pa.table(out)


def _total(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """The sum over blocks of work(good rows, bad rows, how many of either are no repetitions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                good, bad = (np.frombuffer(row[k]).reshape(-1, len(FEATURES)) for k in ("good", "bad"))
                part = work(good, bad, row["own_good"], row["own_bad"])
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([np.asarray(total, float).tobytes()], pa.binary())], names=["part"])

    return sum(np.frombuffer(r["part"]) for r in blocks.mapInArrow(run, "part binary").collect())


def _slopes(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs of each good with each bad row, first and negative second derivatives of their log-likelihood, in one row."""
    n = len(w)
    grad, hess = np.zeros(n), np.zeros((n, n))
    step = max(1, CELLS // max(1, len(bad)))
    for a in range(0, len(good) if len(bad) else 0, step):
        g = good[a : a + step]
        p = 1 / (1 + np.exp(-np.clip((g @ w)[:, None] - (bad @ w)[None, :], -35, 35)))
        v = p * (1 - p)
        cross = g.T @ (v @ bad)
        grad += g.T @ (1 - p).sum(1) - bad.T @ (1 - p).sum(0)
        hess += (g * v.sum(1)[:, None]).T @ g + (bad * v.sum(0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[len(good) * len(bad)], grad, hess.ravel()])


def _newton(slopes: Callable[[np.ndarray], np.ndarray], n: int, ridge: float, steps: int) -> np.ndarray:
    """n weights where the mean log-likelihood of the pairs, less a ridge, has no slope."""
    w = np.zeros(n)
    for _ in range(steps):
        out = slopes(w)
        pairs, grad, hess = out[0], out[1 : n + 1], out[n + 1 :].reshape(n, n)
        step = np.linalg.solve(hess / pairs + ridge * np.eye(n), grad / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int | None = None, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights w of the Bradley-Terry model, from rows preferred over other rows: from all pairs, or from so many drawn ones."""
    if pairs is None:
        return _newton(lambda w: _slopes(good, bad, w), good.shape[1], ridge, steps)
    rng = np.random.default_rng(7)
    diff = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    return _newton(lambda w: _slopes(diff, np.zeros((1, diff.shape[1])), w), diff.shape[1], ridge, steps)


def _ranked(blocks: DataFrame, strength: Callable[[np.ndarray], np.ndarray], rank: int, edge: float) -> tuple[float, float]:
    """The strengths of ranks `rank` and rank + 1 (from 0) of all training rows, which lie within `edge` of 0: ranges are narrowed until few are left."""

    def own(good, bad, n_good, n_bad):
        return np.concatenate([strength(good[:n_good]), strength(bad[:n_bad])])

    low, high, before = -edge, edge, 0
    for _ in range(8):
        edges = np.linspace(low, high, BINS + 1)
        counts = _total(blocks, lambda *b, e=edges: np.histogram(own(*b), e)[0]).astype(np.int64)
        k = int(np.searchsorted(before + np.cumsum(counts), rank, side="right"))
        low, high, before = edges[k], edges[k + 1], before + int(counts[:k].sum())
        if counts[k] <= FEW or not low < (low + high) / 2 < high:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different strengths from low to high with their numbers, and the first one beyond."""
        for batch in batches:
            for row in batch.to_pylist():
                good, bad = (np.frombuffer(row[k]).reshape(-1, len(FEATURES)) for k in ("good", "bad"))
                z = own(good, bad, row["own_good"], row["own_bad"])
                values, n = np.unique(z[(z >= low) & (z <= high)], return_counts=True)
                beyond = z[z > high]
                if len(beyond):
                    values, n = np.append(values, beyond.min()), np.append(n, 1)
                yield pa.record_batch([pa.array(values, pa.float64()), pa.array(n, pa.int64())], names=["z", "n"])

    found = blocks.mapInArrow(run, "z double, n long").groupBy("z").agg(F.sum("n").alias("n")).toPandas().sort_values("z")
    ends = before + found["n"].to_numpy().cumsum()
    at = np.searchsorted(ends, [rank, rank + 1], side="right")
    first, second = found["z"].to_numpy()[at]
    return float(first), float(second)


def _curve(blocks: DataFrame, strength: Callable[[np.ndarray], np.ndarray], at: float, steps: int = 60) -> float:
    """Slope of a slightly ridged logistic curve of the label over the strength, less `at`, of all training rows."""
    a = b = 0.0
    for _ in range(steps):

        def sums(good, bad, n_good, n_bad, a=a, b=b):
            x = np.concatenate([strength(good[:n_good]), strength(bad[:n_bad])]) - at
            y = np.repeat([1.0, 0.0], [n_good, n_bad])
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
            r, v = y - p, p * (1 - p) + 1e-9
            return np.array([(r * x).sum(), r.sum(), (v * x * x).sum(), (v * x).sum(), v.sum()])

        gx, g, hxx, hx, h = _total(blocks, sums)
        da, db = np.linalg.solve(np.array([[hxx + 1e-2, hx], [hx, h + 1e-6]]), np.array([gx - 1e-2 * a, g]))
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -4, 4)
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a)


class Model:
    """Standardised features -> Bradley-Terry strength -> score in 0..1 that is `cut` at the threshold quantile."""

    def __init__(self, mean, scale, w, at: float, slope: float, cut: float, constant: float | None = None):
        self.mean, self.scale, self.w, self.at, self.slope, self.cut, self.constant = mean, scale, w, at, slope, cut, constant

    def standard(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.mean) / self.scale, -8, 8)

    def strength(self, f: np.ndarray) -> np.ndarray:
        return self.standard(f) @ self.w

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(f), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(f) - self.at) + math.log(self.cut / (1 - self.cut)), -35, 35)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.7, block: int = BLOCK) -> Model:
    """Learns from all labelled rows that aren't held out."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select(doc_id, F.col(label).cast("int").alias("label"))
    with scratch(documents.sparkSession):
        # Texts stay where they are: only features of rows that may be labelled are dealt by id, one for each.
        may, _ = split(documents.select(doc_id, "text"), known, "doc_id")
        vectors = may.mapInArrow(by_slices(_vectors), "doc_id long, digest binary, f binary").groupBy("doc_id").agg(F.min_by("f", "digest").alias("f"))
        rows = saved(vectors.join(known.distinct(), "doc_id"), "quality-rows")
        n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
            return Model(None, None, None, 0, 0, cut, total.get(1, 0) / sum(total.values()) if total else 0.5)
        every = sum(n.values())
        n_blocks = math.ceil(every / block)
        copies = {k: min(n_blocks, math.ceil(RARE * n_blocks / n[k])) for k in n}
        last = F.when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1)
        apart = F.when(F.col("label") == 1, n_blocks / copies[1]).otherwise(n_blocks / copies[0])
        dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
        dealt = dealt.withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)) + F.floor(F.col("copy") * apart), F.lit(n_blocks)).cast("long"))
        blocks = saved(dealt.groupBy("block").applyInArrow(_block, "block long, good binary, own_good long, bad binary, own_bad long"), "quality-blocks")

        mean = _total(blocks, lambda good, bad, i, j: good[:i].sum(0) + bad[:j].sum(0)) / every
        scale = np.sqrt(_total(blocks, lambda good, bad, i, j: ((good[:i] - mean) ** 2).sum(0) + ((bad[:j] - mean) ** 2).sum(0)) / every) + 1e-6
        model = Model(mean, scale, None, 0, 0, cut)
        model.w = _newton(lambda w: _total(blocks, lambda good, bad, i, j: _slopes(model.standard(good), model.standard(bad), w)), len(FEATURES), 1e-3, 25)
        # The bad labels' share of the strengths lies below the middle of these two.
        model.at = sum(_ranked(blocks, model.strength, n[0] - 1, 8 * float(np.abs(model.w).sum()) + 1)) / 2
        model.slope = max(_curve(blocks, model.strength, model.at), 1e-3)
        return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text, in one pass and without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = np.array([features(t) for t in batch.column(1).to_pylist()])
        return pa.record_batch([batch.column(0), pa.array(model.score(f), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(by_slices(work), "doc_id long, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = fit(documents, table(spark, sf_dir, "labels"), "quality", 0.7)
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
