"""What the text operators share: tables, scratch tables in the shared folder, bounded slices of texts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds in one numpy pass.
SLICE_BYTES = 2 << 20

#: Paths of scratch tables, by block.
_scratch: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in a single process (local mode, as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="alphaloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


#: Bytes of an Arrow batch while scratch tables are written: what lies outside the heap, and in workers, follows it.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/alphaloom/{name}-{uuid.uuid4().hex}"
    if not any(_scratch):
        atexit.register(_clear, spark)
    with _small_batches(spark):
        df.write.parquet(path)
    _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """As `saved`, but kept when the `scratch` block ends: until `discard`, or the end of the program."""
    out = saved(df, name)
    if len(_scratch) > 1:
        _scratch[-2].append(_scratch[-1].pop())
    return out


def discard(spark: SparkSession, name: str) -> None:
    """Deletes the tables that were `written` under a name."""
    gone = [path for path in _scratch[-1] if path.rpartition("/")[2].rpartition("-")[0] == name]
    _delete(spark, gone)
    _scratch[-1][:] = [path for path in _scratch[-1] if path not in gone]


def _delete(spark: SparkSession, names: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession) -> None:
    """At the end of the program: what no block has deleted."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(spark, [name for names in _scratch for name in names])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the scratch tables that were written within the block, whose results must have been consumed by its end."""
    _scratch.append([])
    try:
        yield
    finally:
        _delete(spark, _scratch.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of df has."""
    prefix = "_"
    while any((prefix + n).lower() in {c.lower() for c in df.columns} for n in names):
        prefix += "_"
    return [prefix + n for n in names]


#: Bits of the map in `split`: 8 MB broadcast, whatever the number of keys.
MAP_BITS = 1 << 26


def split(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column` may be among `keys`, rows for which it certainly isn't), so that only the former need a join.

    A one-hash bitmap of fixed size is broadcast; with very many keys it says "may be" more often, and nothing is lost.
    """
    place = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    p, bucket, bits, byte, hit = fresh(df, "place", "bucket", "bits", "byte", "hit")
    known = keys.select(place.alias(p)).groupBy(F.shiftright(p, 15).alias(bucket)).agg(F.bitmap_construct_agg((F.col(p) % 32768).cast("int")).alias(bits))
    seen = df.withColumn(p, place).withColumn(bucket, F.shiftright(p, 15)).join(F.broadcast(known), bucket, "left")
    number = F.conv(F.hex(F.substring(bits, (F.shiftright((F.col(p) % 32768).cast("int"), 3) + 1), F.lit(1))), 16, 10).cast("int")
    seen = seen.withColumn(byte, number).withColumn(hit, F.coalesce(F.expr(f"shiftright({byte}, CAST({p} % 8 AS INT)) & 1") == 1, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return seen.where(F.col(hit)).select(columns), seen.where(~F.col(hit)).select(columns)


#: From so many rows on a key is joined in parts, and into so many parts.
HOT, PARTS = 1000, 32


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once, where some keys may have very many rows.

    Keys with HOT rows or more are found by a count; rows that may have one are dealt to PARTS parts of it, and only their few partners
    are repeated in all parts. All other rows are joined as they are.
    """
    hot = saved(rows.groupBy(key).count().where(F.col("count") >= HOT).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(unique, key, how)
    many, few = split(rows, hot, key)
    many_of, few_of = split(unique, hot, key)
    (part,) = fresh(rows, "part")
    salted = many.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    repeated = many_of.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    both = salted.join(repeated, [key, part], how).drop(part)
    return few.join(few_of, key, how).unionByName(both)


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about `limit` bytes each; a longer single text gets a range of its own."""
    low = size = 0
    for row, length in enumerate(pa.compute.binary_length(column).to_pylist()):
        if row > low and size + (length or 0) > limit:
            yield low, row
            low, size = row, 0
        size += length or 0
    if len(column) > low:
        yield low, len(column)


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: int = 1):
    """A mapInArrow function that gives `work` batches of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(column)):
                out = work(batch.slice(low, high - low))
                if out is not None and out.num_rows:
                    yield out
            # What a batch took goes back to the system: workers are kept, and so would it be.
            pa.default_memory_pool().release_unused()

    return run
