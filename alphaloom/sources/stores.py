"""Bucket stores: panels dealt by CRC-32 of the symbol, their manifests, layouts and checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collect import BUCKETS, bucket_of


def downcast(df: DataFrame) -> DataFrame:
    """df with doubles in single precision and long columns as int where all values fit; the fit is found in one aggregation."""
    longs = [c for c, t in df.dtypes if t == "bigint"]
    row = df.agg(*(F.max(F.abs(c)).alias(c) for c in longs)).first() if longs else {}
    small = [c for c in longs if row[c] is not None and row[c] < 2**31]
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c).cast("int").alias(c) if c in small else F.col(c) for c, t in df.dtypes))


def write(panel: DataFrame, path: str, buckets: int = BUCKETS, only: bool = False) -> None:
    """Writes a panel by bucket, sorted by symbol and date; rerunning replaces the buckets that the panel has and, with `only`, removes all others.

    Readers never see half a bucket: the committer moves finished files, and only then.
    """
    out = panel.withColumn("bucket", bucket_of(F.col("symbol"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("symbol", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    if only:
        remove_stale(panel, path, buckets)


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a folder of any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove_stale(panel: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Deletes the buckets of a store that no symbol of the panel falls into any more; their numbers. At most `buckets` numbers reach the driver."""
    spark = panel.sparkSession
    active = {r[0] for r in panel.select(bucket_of(F.col("symbol"), buckets)).distinct().collect()}
    fs, root = _files(spark, path)
    gone = []
    for status in fs.listStatus(root):
        name, _, number = status.getPath().getName().partition("=")
        if name == "bucket" and int(number) not in active and fs.delete(status.getPath(), True):
            gone.append(int(number))
    return sorted(gone)


def discover(spark: SparkSession, root: str) -> list[str]:
    """Bucket files in order: <root>/buckets/part-*.parquet, else <root>/part-*.parquet, else those of a store written here."""
    fs, _ = _files(spark, root)
    for pattern in ("buckets/part-*.parquet", "part-*.parquet", "bucket=*/part-*.parquet"):
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}"))
        if found:
            return sorted(s.getPath().toString() for s in found)
    return []


def read(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True, symbols: list[str] | None = None, start=None, end=None, buckets: int = BUCKETS) -> DataFrame:
    """The store, or some columns, symbols (only their buckets are read) and dates of it."""
    df = spark.read.parquet(path)
    if symbols is not None:
        import zlib

        df = df.where(F.col("bucket").isin(sorted({zlib.crc32(s.encode()) % buckets for s in symbols})) & F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    if columns is None:
        return df
    absent = [c for c in columns if c not in df.columns]
    if absent and strict:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select([c for c in columns if c in df.columns])


def first_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first candidate that the frame has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {', '.join(candidates)}")
    return found


def manifest(panel: DataFrame) -> DataFrame:
    """symbol, bucket, rows, min_date and max_date."""
    return panel.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")).withColumn("bucket", bucket_of(F.col("symbol")))


def footers(spark: SparkSession, files: list[str], column: str = "date") -> DataFrame:
    """Of each file its bytes, rows, columns and row groups, and the least and greatest value of a column by its statistics (as text,
    missing where a row group has none). A task reads the ends of its files only."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file:///") else file)
                with store.open_input_file(path) as f:
                    meta, size = pq.ParquetFile(f).metadata, f.size()
                names = [meta.schema.column(k).path for k in range(meta.num_columns)]
                stats = [meta.row_group(g).column(names.index(column)).statistics for g in range(meta.num_row_groups)] if column in names else [None]
                known = stats and all(s is not None and s.has_min_max for s in stats)
                low, high = (str(f(getattr(s, a) for s in stats)) if known else None for f, a in ((min, "min"), (max, "max")))
                yield pa.record_batch([pa.array([x], t) for x, t in ((file, pa.string()), (size, pa.int64()), (meta.num_rows, pa.int64()), (names, pa.list_(pa.string())), (meta.num_row_groups, pa.int32()), (low, pa.string()), (high, pa.string()))], names=["file", "bytes", "rows", "columns", "row_groups", "low", "high"])

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 128)))
    return listed.mapInArrow(run, "file string, bytes long, rows long, columns array<string>, row_groups int, low string, high string")


def date_range(spark: SparkSession, path: str, column: str = "date") -> tuple[str, str] | None:
    """First and last date of a store, from footers; a scan where a file has no statistics, None without rows."""
    df = spark.read.parquet(path)
    found = footers(spark, df.inputFiles(), column).where("rows > 0").agg(F.bool_and(F.col("low").isNotNull()).alias("whole"), F.min("low").alias("a"), F.max("high").alias("b")).first()
    if found["whole"] is None:
        return None
    if not found["whole"]:
        row = df.agg(F.min(column).cast("string"), F.max(column).cast("string")).first()
        return (row[0], row[1])
    return (found["a"], found["b"])


def layout(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, rows, columns (their number) and row groups of each file of a Parquet dataset."""
    return footers(spark, spark.read.parquet(path).inputFiles()).withColumn("columns", F.size("columns")).drop("low", "high")


def incomplete_files(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """file and missing (names) of the files that lack required columns; partition columns count as there."""
    df = spark.read.parquet(path)
    need = [c for c in required if c != "bucket"]
    missing = F.array_except(F.array(*map(F.lit, need)), F.col("columns")) if need else F.array().cast("array<string>")
    return footers(spark, df.inputFiles()).select("file", missing.alias("missing")).where(F.size("missing") > 0)


def layout_summary(files: DataFrame) -> DataFrame:
    """Number of files, and least, median and most rows and bytes."""
    agg = [f(c).alias(f"{n}_{c}") for c in ("rows", "bytes") for n, f in (("min", F.min), ("median", lambda c: F.percentile(c, F.lit(0.5))), ("max", F.max))]
    return files.agg(F.count("*").alias("files"), *agg)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def metadata(panel: DataFrame, features: list[str], labels: list[str], policy: str) -> dict:
    """What a store's meta document says: names, dates, shape and the availability policy of its events."""
    row = panel.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("a"), F.max("date").alias("b")).first()
    return {"features": features, "labels": labels, "start": str(row["a"]), "end": str(row["b"]), "rows": row["rows"], "symbols": row["symbols"], "event_policy": policy}


def checked(meta: dict, features: list[str], label: str | None = None, policy: str | None = None) -> None:
    """Raises where a store lacks wanted features or the label, or was made under another policy."""
    absent = [f for f in features if f not in meta["features"]]
    if absent:
        raise ValueError(f"the store lacks {', '.join(absent)}")
    if label is not None and label not in meta["labels"]:
        raise ValueError(f"the store lacks the label {label}")
    if policy is not None and meta["event_policy"] != policy:
        raise ValueError(f"the store was made under {meta['event_policy']}, not {policy}")


def write_metadata(spark: SparkSession, path: str, meta: dict, name: str = "_meta.json") -> None:
    """The meta document beside the data, in whatever store the data is in."""
    fs, root = _files(spark, path)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    try:
        out.write(bytearray(json.dumps(meta, indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def read_metadata(spark: SparkSession, path: str, name: str = "_meta.json") -> dict:
    fs, root = _files(spark, path)
    opened = fs.open(spark._jvm.org.apache.hadoop.fs.Path(root, name))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()


def closes(spark: SparkSession, path: str, wanted: DataFrame, column: str = "close", buckets: int = BUCKETS) -> DataFrame:
    """symbol, date and close of the wanted pairs (symbol, date). Only the buckets, and the span of dates, that they lie in are read: `buckets` numbers and two dates reach the driver."""
    pairs = wanted.select("symbol", "date").distinct()
    seen = pairs.agg(F.collect_set(bucket_of(F.col("symbol"), buckets)).alias("b"), F.min("date").alias("a"), F.max("date").alias("z")).first()
    df = spark.read.parquet(path).where(F.col("bucket").isin(seen["b"]) & F.col("date").between(seen["a"], seen["z"]) if seen["b"] else F.lit(False))
    return df.select("symbol", "date", column).join(pairs, ["symbol", "date"], "left_semi")
