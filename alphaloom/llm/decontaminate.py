"""Benchmark decontamination: q-gram lemma filtering with overlapping diagonal bands, then banded alignment.

Documents and benchmark items are folded (lower case, everything but letters and digits one space) to UTF-8 bytes. Items are cut
into overlapping windows of at most WINDOW bytes. A window of length L matches where a document holds it with at most
k = floor(L * rate) edits, or fewer if fewer than LEAST shared q-grams would be left. By the q-gram lemma such a place shares at least
L - q + 1 - k * q of the window's q-grams, on diagonals that lie within k of each other, so in one of the overlapping bands of 2(k + 1)
diagonals. Bands with fewer of them are dropped, the others are aligned (semi-global, banded) and kept if the distance is within k.

Documents are read once, whole, and without a shuffle. Texts of benchmark items travel to the tasks, which make the index of their q-grams
themselves (about 40 bytes for each byte of an item); a benchmark of more than BLOCK bytes is dealt in blocks of that size, each matched in a pass of its own.

Defined results: null and empty texts match nothing; an item of fewer than q folded bytes says too little to be found within a text and
matches the documents that consist of nothing else; very long texts are searched whole; of a band's places with equal distance the first is
reported; equal items are each reported; items without an item_id are matched like any other and each reported with a null item_id;
repeated document rows are each reported; empty tables give no leaks; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Length of a q-gram in bytes: as many as fit a machine word.
Q = 8
WINDOW, STRIDE = 96, 48
#: Edits a byte of a window: 9 in a whole one, a word replaced by another.
RATE = 0.1
#: Q-grams that a place within the edits must share at least, if the window has so many.
LEAST = 4
#: Most bytes of benchmark text that one pass holds in memory.
BLOCK = 4 << 20
#: Alignments that run side by side.
TOGETHER = 4096
_GAP = 64

_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = re.compile("[\xa0-\xbf -⁯　-〃]")
_U = np.uint64


def fold(text: str | None) -> bytes:
    text = (text or "").lower().replace("ς", "σ")
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return b" ".join(text.encode().translate(_KEEP).split())


def fold_places(text: str) -> np.ndarray:
    """For each byte of fold(text), the code point of text that it comes from."""
    places, last = [], True
    for k, c in enumerate(text):
        c = c.lower().replace("ς", "σ")
        if not c.isascii():
            c = _MARKS.sub(" ", c)
        for b in c.encode().translate(_KEEP):
            if b != 32:
                places.append(k)
            elif not last:
                places.append(k)
            last = b == 32
    return np.array(places + [len(text)])


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each place as a 64-bit number; data is uint8 and padded by at least Q."""
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(_U) | (four[4:].astype(_U) << _U(32))


def budget(length: int, rate: float = RATE) -> int:
    """Edits within which a window of `length` bytes matches."""
    return max(0, min(int(length * rate), (length - Q + 1 - LEAST) // Q))


class Index:
    """The windows of some benchmark items and their q-grams. It travels as the items' texts."""

    def __init__(self, texts: list[tuple[int | None, str]], rate: float = RATE):
        self.texts, self.rate = texts, rate
        self.items, self.windows = [], []
        self.short: dict[bytes, list[tuple[bool, int]]] = {}
        for number, (item, text) in enumerate(texts):
            data = fold(text)
            if len(data) < Q:
                if data:
                    self.short.setdefault(data, []).append((item is None, number if item is None else item))
                continue
            starts = [0] if len(data) <= WINDOW else [*range(0, len(data) - WINDOW, STRIDE), len(data) - WINDOW]
            for s in starts:
                # Items without an id are told apart by their number.
                self.items.append(((item is None, number if item is None else item), len(data), s))
                self.windows.append(data[s : s + WINDOW])
        self.length = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.edits = np.array([budget(n, rate) for n in self.length.tolist()], dtype=np.int64)
        self.least = np.maximum(1, self.length - Q + 1 - self.edits * Q)
        gram, window, place = [], [], []
        for k, w in enumerate(self.windows):
            g = grams(np.frombuffer(w + bytes(Q), np.uint8))[: len(w) - Q + 1]
            gram.append(g)
            window.append(np.full(len(g), k, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        self.gram, self.bits = np.zeros(0, _U), np.zeros(1 << 22, bool)
        if not gram:
            return
        gram, window, place = map(np.concatenate, (gram, window, place))
        order = np.argsort(gram, kind="stable")
        gram, self.window, self.place = gram[order], window[order], place[order]
        self.gram, self.begin = np.unique(gram, return_index=True)
        self.need = np.minimum.reduceat(self.least[self.window], self.begin)
        self.begin = np.append(self.begin, len(gram))
        self.bits[self._slot(self.gram)] = True

    def __reduce__(self):
        return Index, (self.texts, self.rate)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * _U(0x9E3779B97F4A7C15)) >> _U(42)

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of the bands with enough shared q-grams."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = grams(data)
        hit = np.flatnonzero(self.bits[self._slot(g)])
        if not len(hit):
            return none
        at = np.minimum(np.searchsorted(self.gram, g[hit]), len(self.gram) - 1)
        real = self.gram[at] == g[hit]
        hit, at = hit[real], at[real]
        # From the first hit of a place on, a stretch as long as a window with its edits has as many hits as the least of the hit's windows needs.
        ends = np.searchsorted(hit, hit + int((self.length + self.edits).max()))
        dense = np.flatnonzero(ends - np.arange(len(hit)) >= self.need[at])
        cover = np.zeros(len(hit) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, ends[dense], -1)
        kept = np.cumsum(cover)[:-1] > 0
        hit, at = hit[kept], at[kept]
        if not len(hit):
            return none
        n = self.begin[at + 1] - self.begin[at]
        entry = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, place = self.window[entry].astype(np.int64), self.place[entry]
        diagonal = np.repeat(hit, n) - place + WINDOW
        band = diagonal // (self.edits[window] + 1)
        key, place = np.concatenate([window * (1 << 40) + band, window * (1 << 40) + band - 1]), np.concatenate([place, place])
        found, often = np.unique(key, return_counts=True)
        found = found[often >= self.least[found >> 40]]
        if not len(found):
            return none
        # A q-gram of the window counts once for a band, however often a repetitive text has it there.
        inside = found[np.minimum(np.searchsorted(found, key), len(found) - 1)] == key
        key, place = key[inside], place[inside]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        key, often = np.unique(key[np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])], return_counts=True)
        window = key >> 40
        enough = often >= self.least[window]
        window, band = window[enough], (key & ((1 << 40) - 1))[enough]
        return window, band * (self.edits[window] + 1) - WINDOW

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) of the verified places in folded data; the best place of each band."""
        window, low = self.regions(data)
        out, rest = [], []
        raw = data.tobytes()
        for w, d in zip(window.tolist(), low.tolist()):
            k, n = int(self.edits[w]), int(self.length[w])
            a, b = max(0, d - k), min(len(raw), d + 2 * (k + 1) + n + k)
            at = raw.find(self.windows[w], a, b)
            if at >= 0:
                out.append((w, at, at + n, 0))
            else:
                rest.append((w, a, b))
        for size in sorted({int(self.length[w]) for w, _, _ in rest}):
            every = [x for x in rest if self.length[x[0]] == size]
            for k in range(0, len(every), TOGETHER):
                same = every[k : k + TOGETHER]
                out += [(w, a + s, a + e, x) for (w, a, _), (s, e, x) in zip(same, aligned([self.windows[w] for w, _, _ in same], [raw[a:b] for _, a, b in same])) if x <= self.edits[w]]
        return out


def aligned(patterns: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the best place of each pattern in its text, text ends being free; patterns are equally long.

    All alignments run side by side, a row of the matrix at a time; texts are as narrow as their bands.
    """
    wide, n = max(map(len, texts)), len(patterns[0])
    p = np.array([list(x) for x in patterns])
    t = np.full((len(texts), wide), -1)
    for k, x in enumerate(texts):
        t[k, : len(x)] = list(x)
    place = np.arange(wide + 1)
    # Distance and start of the place are minimised together: distance first, then the later start.
    unit = 1 << 20
    best = np.tile(unit // 2 - place, (len(texts), 1))
    for i in range(n):
        step = np.full_like(best, 1 << 60)
        step[:, 1:] = best[:, :-1] + (t != p[:, i : i + 1]) * unit
        step = np.minimum(step, best + unit)
        best = np.minimum.accumulate(step - place * unit, axis=1) + place * unit
    beyond = place[None, :] > np.array([len(x) for x in texts])[:, None]
    best = np.where(beyond, 1 << 60, best)
    end = best.argmin(axis=1)
    value = best[np.arange(len(texts)), end]
    return [(int(unit // 2 - v % unit), int(e), int(v // unit)) for v, e in zip(value, end)]


def _search(index: Index):
    """A mapInArrow function over (doc_id, text): a row for each document and item with a verified window."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(1).to_pylist()
        folded = [fold(t) for t in texts]
        starts = np.cumsum([0, *(len(x) + _GAP for x in folded)]) + _GAP
        data = np.frombuffer(bytes(_GAP) + bytes(_GAP).join(folded) + bytes(_GAP), np.uint8)
        found: dict[tuple[int, tuple[bool, int]], list] = {}
        for w, s, e, x in index.matches(data):
            row = int(np.searchsorted(starts, s, side="right")) - 1
            item, size, at = index.items[w]
            found.setdefault((row, item), []).append((s - starts[row], e - starts[row], x, at, size, int(index.length[w])))
        for row, text in enumerate(folded):
            for item in index.short.get(text, []):
                found.setdefault((row, item), []).append((0, len(text), 0, 0, len(text), len(text)))
        if not found:
            return None
        places = {row: fold_places(texts[row]) for row, _ in found}
        rows = []
        for (row, item), hits in sorted(found.items()):
            low, high = min(h[0] for h in hits), max(h[1] for h in hits)
            covered = np.zeros(hits[0][4], bool)
            for h in hits:
                covered[h[3] : h[3] + h[5]] = True
            p = places[row]
            rows.append((row, None if item[0] else item[1], int(p[min(max(low, 0), len(p) - 1)]), int(p[min(high, len(p) - 1) - 1]) + 1, min(h[2] for h in hits), float(covered.mean())))
        rows_, items, s, e, edits, share = zip(*rows)
        return pa.record_batch([batch.column(0).take(pa.array(rows_)), pa.array(items, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(edits, pa.int64()), pa.array(share)], names=["doc_id", "item_id", "start", "end", "edits", "coverage"])

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1), 1 << 20):
                out = one(batch.slice(low, high - low))
                if out is not None:
                    yield out

    return run


def _indexes(benchmark: DataFrame, rate: float, block: int):
    """Indexes of the benchmark in blocks: about `block` bytes on the driver at once, whatever its size."""
    benchmark = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block))
    for k in range(parts):
        items = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        index = Index([(r["item_id"], r["text"]) for r in items], rate)
        if len(index.gram) or index.short:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits and coverage (share of the item) of every leak."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in _indexes(benchmark, rate, block):
        found = docs.mapInArrow(_search(index), "doc_id long, item_id long, start long, end long, edits long, coverage double")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.where("false").selectExpr("doc_id", "0L AS item_id", "0L AS start", "0L AS end", "0L AS edits", "0D AS coverage")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, with all their columns, that leak no item; a pass for each block of the benchmark, without a shuffle."""
    text = docs.columns.index("text")
    for index in _indexes(benchmark, rate, block):

        def run(batches, find=_search(index)):
            for batch in batches:
                for low, high in slices(batch.column(text), 1 << 20):
                    part = batch.slice(low, high - low)
                    numbered = pa.record_batch([pa.array(np.arange(part.num_rows)), part.column(text)], names=["doc_id", "text"])
                    leaks = {r for found in find([numbered]) for r in found.column(0).to_pylist()}
                    yield part.filter(pa.array([k not in leaks for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
