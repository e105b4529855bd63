"""Best-fit packing by large-item matching: token pieces into as few sequences of fixed capacity as it can.

Documents become token ids and an end id; only longer ones than the capacity are cut. Packing depends on lengths alone, so the plan is
made on the histogram of lengths (at most `capacity` numbers, whatever the corpus): pieces above a third of the capacity
are matched greedily, the longest with the longest that fits, at most two a bin; shorter ones then go, longest first, to the smallest gap
that holds them. Each step of the plan places a whole run of equal lengths at once. A piece's rank among those of its length,
taken in salted parts, says which place of the plan is its own.

Defined results: a null text is an empty one, which is one piece of the end id; repeated rows and rows without a doc_id are packed each;
ties of length go by doc_id, piece and row; very long texts become as many pieces as they need; an empty table packs into nothing;
other columns of the pieces stay as they are.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, saved, slices, table

CAPACITY, END = 2048, 0
#: Pieces of one length that one task ranks.
RANKED = 2000


class Encoder:
    """Byte-level BPE ids of a public tokenizers file.

    The same vocabulary as a rank table is encoded by a faster library; texts that hold one of the file's added tokens go to
    `tokenizers` itself. Files are opened where the encoder is used.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.ranks, self.pattern, self._made = path, ranks, pattern, None

    def __getstate__(self):
        return {"path": self.path, "ranks": self.ranks, "pattern": self.pattern, "_made": None}

    def _open(self):
        if self._made is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.path)
            added = [t["content"] for t in json.load(open(self.path, encoding="utf-8")).get("added_tokens", [])]
            fast = None
            if self.ranks:
                import tiktoken

                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(self.ranks, "rb"))}
                fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
            self._made = slow, fast, added
        return self._made

    def encode(self, text: str) -> list[int]:
        slow, fast, added = self._open()
        if fast is None or any(t in text for t in added):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        slow, fast, _ = self._open()
        return fast.decode(ids) if fast is not None else slow.decode(ids, skip_special_tokens=False)


def default_encoder() -> Encoder:
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, encoder: Encoder | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of every piece of every whole text."""
    encoder = encoder or default_encoder()

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                out = [[], [], [], [], []]
                for doc, text in zip(batch.column(0).slice(low, high - low).to_pylist(), batch.column(1).slice(low, high - low).to_pylist()):
                    ids = np.array([*encoder.encode(text or ""), end], dtype="<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (doc, k, a, b - a, ids[a:b].tobytes())):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, number, first bin, offset) that place all pieces, and the number of bins.

    The pieces of a run have consecutive ranks among those of their length and go to consecutive bins, at one offset.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        left[length] += n
    used, runs, bins = [0] * (capacity + 1), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []  # sorted sizes that have bins

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.setdefault(gap, []):
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for x in range(capacity, capacity // 3, -1):
        while left[x]:
            y = min(capacity - x, x)
            while 3 * y > capacity and not (left[y] > (x == y)):
                y -= 1
            if 3 * y > capacity:
                n = left[x] // 2 if x == y else min(left[x], left[y])
                place(x, n, bins, 0)
                place(y, n, bins, x)
            else:
                y, n = 0, left[x]
                place(x, n, bins, 0)
            leave(capacity - x - y, bins, n)
            bins += n
    for x in range(capacity // 3, 0, -1):
        while left[x]:
            k = bisect_left(open_gaps, x)
            if k == len(open_gaps):
                n = -(-left[x] // (capacity // x))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = open_gaps[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(k)
            taken = min(n, left[x])
            place(x, taken, first, capacity - gap)
            leave(gap, first + taken, n - taken)
            leave(gap - x, first, taken)
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (doc_id, piece, length and whatever else) with sequence_id and offset: gapless sequences of at most `capacity` tokens."""
    names = parts.columns
    row, salt, rank, inner, before = fresh(parts, "row", "salt", "rank", "inner", "before")
    parts = saved(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs, _ = plan(histogram, capacity)
    # Frequent lengths are ranked in parts: by salt within a length, then the parts one after another.
    many = [-(-histogram.get(x, 0) // RANKED) for x in range(1, capacity + 1)]
    number = F.element_at(F.array(*(F.lit(max(1, m)) for m in many)), F.col("length").cast("int"))
    parts = parts.withColumn(salt, F.pmod(F.xxhash64(row), number))
    first = parts.groupBy("length", salt).count().withColumn(before, F.sum("count").over(Window.partitionBy("length").orderBy(salt)) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", row)) - 1
    ranked = parts.withColumn(inner, within).join(first, ["length", salt]).select(*(F.col(f"`{c}`") for c in names), (F.col(inner) + F.col(before)).alias(rank))
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))] if len(runs) else runs
    begin = runs[:, 0] * (1 << 44) + runs[:, 1]
    at_length, last = names.index("length"), len(names)

    def assign(batches):
        for batch in batches:
            length, place = (batch.column(k).to_numpy() for k in (at_length, last))
            at = np.searchsorted(begin, length.astype(np.int64) * (1 << 44) + place, side="right") - 1
            sequence, offset = runs[at, 3] + place - runs[at, 1], runs[at, 4]
            yield pa.record_batch([*batch.columns[:last], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = StructType([*ranked.schema.fields[:last], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, and its pieces' ids joined by offset, of packed pieces that carry their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pieces(table(spark, sf_dir, "documents"))
    return pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
