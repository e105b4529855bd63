"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Texts are lower-cased, homoglyphs and digit or sign substitutions are folded to letters, and everything else between words
becomes one space; letters that signs or spaces part one by one become a word. The lexicon holds word starts and whole words with log-odds
weights, learned from the labelled rows that are not held out (or given). Exception phrases (words, and pairs of words, that start with a lexicon
entry but are rather said in clean rows, or given ones) take precedence over the entries inside them and count nothing. One automaton
pass yields, for a whole text, the summed, the largest and the length-normalised weight; a logistic curve makes a score of them.

Defined results: null and empty texts have no match and get the score of a clean text; null or unknown labels teach nothing;
very long texts are read whole; of entries that start together the longest counts, and equal weights go by the entry's text; repeated rows are
scored each, and of rows that repeat a labelled id the one that sorts first teaches; without labels of both classes the score is the share
of toxic labels (0 without labels); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, held_out, saved, table

#: Most labelled rows of either class that lexicon and curve are fitted on; chosen by a hash of doc_id.
SAMPLE_PER_CLASS = 6000
#: Parts in which the sample is read.
PARTS = 16
#: Word starts of these lengths are candidates, besides whole words.
STARTS = (4, 5, 6, 7, 8)

# Characters that look like Latin letters, and the letters they stand for.
_LOOKALIKE = str.maketrans(
    "абвгезікмнорстухуѕјһԁԛԝαβεηικνορτυχѵ０１３４５７",
    "abbre3ikmhopctyxysjhdqwabenikvoptuxv013457",
)
_HAS_LOOKALIKE = re.compile("[Ͱ-ԯ０-～​-‍­]")
_INVISIBLE = re.compile("[​-‍­]")
_FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF21, 0xFF5F)}
# Digits and signs written for letters inside a word.
_SUBSTITUTE = str.maketrans("01345789@$!|", "oieastbgasil")
# A sign that stands for a letter is one before or between letters or digits; after the last one it is punctuation.
_WORD = re.compile(r"[@$]?[^\W_]+(?:(?:[@$]+|[!|])[^\W_]+)*")
_MIXED = re.compile(r"[01345789@$!|]")
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:([ .,*~+/=_-])[^\W_](?![^\W_]))(?:\1[^\W_](?![^\W_])){2,}")


def fold(text: str | None) -> str:
    """' word word ... ' with lookalikes and substitutions undone; a pure number stays one."""
    text = (text or "").lower()
    if not text.isascii() and _HAS_LOOKALIKE.search(text):
        text = _INVISIBLE.sub("", text).translate(_FULLWIDTH).lower().translate(_LOOKALIKE)
    text = _SPELT.sub(lambda m: m[0].replace(m[1], ""), text)
    words = _WORD.findall(text)
    if _MIXED.search(text):
        words = [_unmixed(w) if _MIXED.search(w) else w for w in words]
    return f" {' '.join(words)} "


def _unmixed(word: str) -> str:
    """A word with its substitutions undone; what holds no letter is a number and loses its signs."""
    if not any(c.isalpha() for c in word):
        return "".join(c for c in word if c not in "@$!|")
    # A stop without a space after it looks the same: both readings stand.
    parts = re.split(r"[!|]", word)
    return " ".join(x.translate(_SUBSTITUTE) for x in ([word, *parts] if len(parts) > 1 else parts))


def candidates(folded: str) -> set[str]:
    """Possible lexicon entries of one text: ' start' for word starts, ' word ' for whole words."""
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for n in STARTS:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


class Lexicon:
    """Entries with weights and exception phrases, as an automaton; at each word the longest match counts."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.entries, self.exceptions = dict(entries), tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            machine = ahocorasick.Automaton()
            for text, weight in self.entries.items():
                machine.add_word(text, (len(text), weight))
            for text in self.exceptions:
                machine.add_word(text, (len(text), 0.0))
            machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def match(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, length, weight) of the counted matches: per start the longest, none inside an exception phrase."""
        if not self.entries and not self.exceptions:
            return []
        best: dict[int, tuple[int, float]] = {}
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if start not in best or best[start][0] < length:
                best[start] = (length, weight)
        out, covered = [], -1
        for start in sorted(best):
            length, weight = best[start]
            if start < covered:
                continue
            if weight == 0.0:
                covered = start + length - 1
            else:
                out.append((start, length, weight))
        return out


def signals(text: str | None, lexicon: Lexicon) -> list[float]:
    """Summed, largest and length-normalised weight of a whole text, and its length."""
    folded = fold(text)
    weights = [w for _, _, w in lexicon.match(folded)]
    n = max(1, folded.count(" ") - 1)
    total = sum(weights)
    return [math.log1p(max(0.0, total)), max(weights, default=0.0), 100 * total / (n + 20), math.log1p(len(weights)), total / math.sqrt(n + 20), math.log1p(n)]


def learn(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> Lexicon:
    """A lexicon from the numbers of toxic and of clean rows that hold each candidate, n1 and n0 being the classes' sizes."""
    weight = {}
    for text, (p, q) in counts.items():
        if p >= 3:
            odds = math.log((p + 0.1) / (n1 + 0.2)) - math.log((q + 0.4) / (n0 + 0.8))
            if odds > 2.0 and p * odds - 2.0 * math.sqrt(p) > 2.5:
                weight[text] = odds
    kept: dict[str, float] = {}
    for text in sorted(weight, key=lambda t: (-weight[t] * math.sqrt(counts[t][0]), t)):
        shorter = [text[:n] for n in range(4, len(text)) if text[:n] in kept]
        if not any(weight[s] >= weight[text] - 0.7 for s in shorter):
            kept[text] = weight[text]
    return Lexicon(kept)


def phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """The words that entries match in a text, and the pairs of words that begin there, as possible exceptions."""
    found = set()
    for start, _, _ in lexicon.match(folded):
        end = folded.index(" ", start + 1) + 1
        found.add(folded[start:end])
        if end < len(folded):
            found.add(folded[start : folded.index(" ", end) + 1])
    return found - set(lexicon.entries)


class Model:
    def __init__(self, lexicon: Lexicon, mean=None, scale=None, w=None, constant: float | None = None):
        self.lexicon, self.mean, self.scale, self.w, self.constant = lexicon, mean, scale, w, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.c_[z, np.ones(len(z))] @ self.w, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w, r = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + r, x.T @ (weight * (y - p)) - r @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _counts(found):
    """A mapInArrow function over (doc_id, text, label): how many of a task's rows of each label hold what `found` gives of a folded text."""

    def run(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for entry in found(fold(text)):
                    seen[entry][label] += 1
            if len(seen) > 400_000:
                yield from _emit(seen)
                seen.clear()
        yield from _emit(seen)

    return run


def _emit(seen):
    keys = list(seen)
    for k in range(0, len(keys), 50_000):
        part = keys[k : k + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([seen[x][1] for x in part], pa.int64()), pa.array([seen[x][0] for x in part], pa.int64())], names=["entry", "p", "q"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, extra: dict[str, float] | None = None, exceptions: tuple[str, ...] = ()) -> Model:
    """Lexicon and curve from the labelled rows that aren't held out, at most `per_class` of each label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.0
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # One row for each id, so that the sample is bounded however often ids repeat.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = saved(texts.select("doc_id", "text", "label").repartition(PARTS), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(Lexicon(extra or {}, exceptions), constant=float(share))

    def counted(found) -> DataFrame:
        return rows.mapInArrow(_counts(found), "entry string, p long, q long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))

    # Of the bounded sample: entries that say something, and what clean rows say with them.
    strong = {r["entry"]: (r["p"], r["q"]) for r in counted(candidates).where((F.col("p") >= 3) & (F.col("p") * n0 > 4 * F.col("q") * n1)).collect()}
    learned = learn(strong, n1, n0)
    against = counted(lambda folded: phrases(folded, learned)).where((F.col("q") >= 3) & (F.col("q") * n1 > 2 * F.col("p") * n0))
    lexicon = Lexicon(learned.entries | (extra or {}), tuple(sorted({*exceptions, *(r["entry"] for r in against.collect())})))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(2), pa.array([signals(t, lexicon) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])

    seen = rows.mapInArrow(by_slices(work), "label int, x array<double>").toPandas()
    x, y = np.array(seen["x"].tolist()), seen["label"].to_numpy()
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return Model(lexicon, mean, scale, _logistic(np.clip((x - mean) / scale, -8, 8), y, weight))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and n_matches of every whole text, in one pass and without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([signals(t, model.lexicon) for t in batch.column(1).to_pylist()])
        n = np.rint(np.expm1(x[:, 3])).astype(np.int64)
        return pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64()), pa.array(n)], names=["doc_id", "score", "n_matches"])

    return documents.select("doc_id", "text").mapInArrow(by_slices(work), "doc_id long, score double, n_matches long")


def keep(documents: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of `documents`, with all their columns, whose score is below `cut`; in one pass and without a shuffle."""
    names = documents.columns
    text = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([signals(t, model.lexicon) for t in batch.column(text).to_pylist()])
        return batch.filter(pa.array(model.score(x) < cut))

    return documents.mapInArrow(by_slices(work, text), documents.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")
