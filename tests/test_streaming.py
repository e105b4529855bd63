"""A stream's results are those of the batch."""

from pyspark.sql import functions as F

from alphaloom.streaming import panels


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    return batch, spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def test_bars(spark, sf):
    batch, live = stream(spark, sf)
    got = run(spark, panels.bars(live), "bars", "complete")
    want = panels.bars(batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, sf):
    batch, live = stream(spark, sf)
    got = run(spark, panels.sessions(live), "sessions", "append")
    last = batch.agg(F.max("ts")).first()[0]
    want = panels.sessions(batch).where(F.col("end") < F.lit(last) - F.expr("INTERVAL 2 HOURS"))
    assert set(map(tuple, got.collect())) >= set(map(tuple, want.collect()))


def test_smoothing(spark, sf):
    batch, live = stream(spark, sf)
    got = {r["user_id"]: (r["level"], r["n"]) for r in run(spark, panels.smoothed(live), "smoothed", "update").collect()}
    user = next(iter(got))
    level = None
    for r in batch.where(F.col("user_id") == user).orderBy("ts", "event_id").collect():
        level = r["value"] if level is None else 0.1 * r["value"] + 0.9 * level
    assert abs(got[user][0] - level) < 1e-9
