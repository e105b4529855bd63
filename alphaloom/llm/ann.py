"""Approximate nearest neighbours by cross-polytope hashing.

A hash function is a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and the nearest signed
axis. Some functions make a table's bucket, as many as the logarithm of the number of vectors asks for (about LEAF vectors a bucket); TABLES
tables are used, and a query looks into the PROBES buckets of each table that lose least against its own. Vectors are hashed once and stay
where they are: queries are sent round in blocks of bounded size, each task looks up which of its vectors' buckets a query probes, reranks
these candidates exactly and keeps the nearest of each query. Queries whose probes reach fewer than `nearest` vectors are compared with all vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as candidates;
a vector is compared with those of its own length only, so mixed lengths are searched side by side; with fewer candidates than `nearest`
in the table all are returned; ties go to the smaller id; of rows that repeat a query's id the least vector (by components) is the query, and
none of them is a candidate of it; repeated rows of another id are candidates each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

TABLES, PROBES = 32, 128
#: Vectors a bucket, about, that decide how many functions a table has.
LEAF = 64
#: Queries that are sent round together.
BLOCK = 4096
#: Pairs of a vector and a query that a task looks at together.
PAIRS = 1 << 22
#: By how much a matrix product may differ from the exact cosine, and more.
SLACK = 1e-9
#: Best axes of each function that probe sequences are made of.
_AXES = 24


def _small(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of rows whose length is a power of two: by factors of up to 16, one axis after the other."""
    rows, n = x.shape
    left = n
    while left > 1:
        r = min(16, left)
        # The first axis is transformed and goes to the end; after all factors the axes stand as before.
        x = (x.reshape(rows, r, n // r).swapaxes(1, 2).reshape(-1, r) @ _small(r)).reshape(rows, n)
        left //= r
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    wide = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def _signed(y: np.ndarray) -> np.ndarray:
    """Closeness to each signed axis: axis 2j is -e_j, 2j + 1 is +e_j."""
    return np.stack([-y, y], axis=2).reshape(len(y), -1)


def functions_for(vectors: int, length: int) -> int:
    """Hash functions of a table: their number grows with the logarithm of the number of vectors."""
    axes, n = 2 * _padded(np.zeros((1, length))).shape[1], 1
    while LEAF * axes**n < vectors:
        n += 1
    return n


def bucket(x: np.ndarray, t: int, functions: int) -> np.ndarray:
    """Buckets of unit rows in table t."""
    code = np.zeros(len(x), np.int64)
    for f in range(functions):
        y = rotated(x, 1000 * t + f)
        code = code * (2 * x.shape[1]) + _signed(y).argmax(axis=1)
    return code


def _first(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values of each row, in order."""
    if values.shape[1] <= n:
        return np.argsort(values, axis=1, kind="stable")
    some = np.argpartition(values, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(values, some, axis=1), axis=1, kind="stable"), axis=1)


def probed(x: np.ndarray, t: int, functions: int, probes: int = PROBES) -> np.ndarray:
    """The buckets of table t that each unit row probes, its own first."""
    code, lost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for f in range(functions):
        near = _signed(rotated(x, 1000 * t + f))
        axes = _first(-near, _AXES)
        value = np.take_along_axis(near, axes, axis=1)
        gap = (value[:, :1] - value) ** 2
        code = (code[:, :, None] * near.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        lost = (lost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        keep = _first(lost, probes)
        code, lost = np.take_along_axis(code, keep, axis=1), np.take_along_axis(lost, keep, axis=1)
    return code


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products in double precision, added up in component order whatever the batch."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _rows(batch: pa.RecordBatch):
    """(row numbers, vectors) of a batch of (id, vector, ...), by length."""
    size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        flat = batch.column(1).take(pa.array(at)).flatten()
        yield at, np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), length)


def hashed(vectors: DataFrame, functions: dict[int, int], tables: int = TABLES) -> DataFrame:
    """vec_id, embedding and codes (its bucket of each table) of vectors whose length is a key of `functions`."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                codes = np.zeros((part.num_rows, tables), np.int64)
                for at, x in _rows(part):
                    unit = _padded(x / np.sqrt(summed(x, x))[:, None])
                    codes[at] = np.stack([bucket(unit, t, functions[x.shape[1]]) for t in range(tables)], axis=1)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * tables)
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["vec_id", "embedding", "codes"])

    known = vectors.where(F.size("embedding").isin(list(functions)))
    return known.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, codes array<long>")


class Asked:
    """Queries of one length, their norms, and the buckets that they probe."""

    def __init__(self, places: np.ndarray, rows: np.ndarray, functions: int, tables: int, probes: int):
        self.places, self.rows, self.functions, self.tables, self.probes = places, rows, functions, tables, probes
        self.norm = np.sqrt(summed(rows, rows))
        self.unit = rows / self.norm[:, None]
        self._lookup = None

    def lookup(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table the probed buckets, sorted, and who probes them; made where it is used."""
        if self._lookup is None:
            unit, self._lookup = _padded(self.unit), []
            for t in range(self.tables):
                code = probed(unit, t, self.functions, self.probes)
                who = np.repeat(np.arange(len(unit)), code.shape[1])
                order = np.argsort(code.ravel(), kind="stable")
                self._lookup.append((code.ravel()[order], who[order].astype(np.int32)))
        return self._lookup

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Which of the queries probe a bucket of each row: a matrix of rows and queries."""
        mask = np.zeros((len(codes), len(self.rows)), bool)
        for t, (known, who) in enumerate(self.lookup()):
            lo, hi = np.searchsorted(known, codes[:, t]), np.searchsorted(known, codes[:, t], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mask[np.repeat(np.arange(len(codes)), n), who[at]] = True
        return mask


def _nearest(ids: np.ndarray, asked: dict[int, Asked], nearest: int, exact: bool = False):
    """A mapInArrow function over (id, vector, codes): the nearest candidates of each query among a task's vectors; all are candidates if exact."""
    step = max(1, PAIRS // len(ids))

    def run(batches):
        best = np.full((len(ids), nearest), -np.inf)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                every = part.column(0).to_numpy()
                codes = np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1)
                for at, x in _rows(part):
                    who = asked.get(x.shape[1])
                    if who is None:
                        continue
                    own, length = every[at], np.sqrt(summed(x, x))
                    mask = np.ones((len(x), len(who.rows)), bool) if exact else who.candidates(codes[at])
                    mask &= own[:, None] != ids[who.places][None, :]
                    # A matrix product tells which candidates can be among the nearest; their scores are then summed up exactly.
                    rough = np.where(mask, (x / length[:, None]) @ who.unit.T, -np.inf)
                    last = np.partition(rough, len(x) - nearest, axis=0)[len(x) - nearest] if len(x) > nearest else -np.inf
                    r, q = np.nonzero(mask & (rough >= np.maximum(best[who.places, -1], last) - SLACK))
                    for k in range(0, len(r), 1 << 15):
                        i, j = r[k : k + (1 << 15)], q[k : k + (1 << 15)]
                        score, place = summed(x[i], who.rows[j]) / (length[i] * who.norm[j]), who.places[j]
                        good = score >= best[place, -1]
                        q_, v_, s_ = (np.concatenate(z) for z in zip(kept, (place[good], own[i[good]], score[good])))
                        order = np.lexsort((v_, -s_, q_))
                        q_, v_, s_ = q_[order], v_[order], s_[order]
                        rank = np.arange(len(q_)) - np.searchsorted(q_, q_)
                        top = rank < nearest
                        kept = [q_[top], v_[top], s_[top]]
                        best[kept[0], rank[top]] = kept[2]
        if len(kept[0]):
            yield pa.record_batch([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, nearest: int = 5, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the nearest found; both frames have vec_id and embedding."""
    spark = vectors.sparkSession
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(valid(F.col("embedding")))
    fit, queries = take(vectors), take(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    schema = "query_id long, vec_id long, score double"
    number = {r["n"]: r["count"] for r in queries.groupBy(F.size("embedding").alias("n")).count().collect()}
    if not number:
        none = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
        return none.select("query_id", "rank", "vec_id", "score")
    functions = {r["n"]: functions_for(r["count"], r["n"]) for r in fit.groupBy(F.size("embedding").alias("n")).count().collect() if r["n"] in number}
    rows = saved(hashed(fit, functions, tables), "hashed-vectors") if functions else hashed(fit.where("false"), number, tables)
    found, parts = None, max(1, -(-sum(number.values()) // block))
    for k in range(parts):
        # A block of queries, about `block` vectors whatever their number, is all that goes to the driver and the tasks.
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).orderBy("vec_id").collect()
        if not own:
            continue
        ids = np.array([r["vec_id"] for r in own])
        lengths = np.array([len(r["embedding"]) for r in own])

        def asked(which: np.ndarray, own=own, lengths=lengths) -> dict[int, Asked]:
            """The queries of the given places, by length, numbered anew."""
            of = {n: np.flatnonzero(lengths[which] == n) for n in np.unique(lengths[which]).tolist()}
            return {n: Asked(at, np.array([own[which[i]]["embedding"] for i in at]), functions.get(n, 1), tables, probes) for n, at in of.items()}

        near = saved(rows.mapInArrow(_nearest(ids, asked(np.arange(len(ids))), nearest), schema), "neighbours")
        enough = near.groupBy("query_id").count().where(F.col("count") >= nearest).select("query_id")
        short = np.flatnonzero(~np.isin(ids, [r["query_id"] for r in enough.collect()]))
        if len(short):
            rest = rows.mapInArrow(_nearest(ids[short], asked(short), nearest, exact=True), schema)
            near = near.join(F.broadcast(enough), "query_id", "left_semi").union(saved(rest, "neighbours-exact"))
        found = near if found is None else found.union(near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
