"""Structured Streaming twins: minute bars with a watermark, re-delivery dedupe, ring windows, and stateful swings."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.groups import GROUPS
from ..operators.folds import SWING, Swing
from ..plans.dialect import Group, duckdb_text
from ..sources.frames import BARS, frame
from ..sources.paths import shared_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream source takes a single file only that way
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    symbol = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", symbol.alias("symbol"), F.col("value").alias("price"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and give back what it wrote."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def minute_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in event time; a bucket comes out once, in its last update."""
    bars = events_stream(spark, sf_dir).withWatermark("ts", "2 hours").groupBy("symbol", F.window("ts", "1 hour")).agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("n"))
    out = drained(bars, "live-bars", "update")
    return out.groupBy("symbol", F.floor(F.unix_timestamp("window.start") / 3600).alias("t")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("n").alias("n"))


def redelivery_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, the second time corrected: the last delivery of an event counts."""
    rows = events_stream(spark, sf_dir).withColumn("delivery", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("price", F.col("price") + F.col("delivery"))
    last = rows.withWatermark("ts", "30 days").groupBy("event_id", "symbol").agg(F.max(F.struct("delivery", "price")).alias("top"))
    out = drained(last, "live-dedupe", "update")
    return out.groupBy("event_id", "symbol").agg(F.max("top").alias("top")).select("event_id", "symbol", F.round("top.price", 6).alias("price"))


def ring_stream(spark: SparkSession, bars: DataFrame, path: str, group: Group, keep: int) -> DataFrame:
    """A group's features of a stream of bars: each micro-batch is computed over itself and the ring of the last `keep` time units.

    The ring of batch n is a table of its own, written after the batch's rows, so a batch that is run again starts from
    the ring of the one before. Bars of a key that come again replace the ones in the ring; bars older than it are late
    and get features from what is left of it.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("order", F.lit(1))
        if n:
            new = new.unionByName(spark.read.parquet(f"{path}/ring/batch={n - 1}").withColumn("order", F.lit(0)))
        last = new.groupBy("symbol", "t").agg(F.max_by(F.struct(*batch.columns), "order").alias("bar"), F.max("order").alias("order"))
        whole = last.select("bar.*", "order")
        seen = group.rounded(whole.drop("order")).join(whole.where("order = 1").select("symbol", "t"), ["symbol", "t"], "left_semi")
        seen.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        newest = whole.agg(F.max("t")).head()[0] or 0
        whole.drop("order").where(F.col("t") > newest - keep).write.mode("overwrite").parquet(f"{path}/ring/batch={n}")

    query = bars.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def trailing_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of a stream of hourly bars that come in chunks of days, as the batch form gives it."""
    group, path = GROUPS["volatility"], shared_path(spark, "live-ring")
    bars = frame(spark, sf_dir, "bars").withColumn("chunk", F.floor(F.col("t") / 120))
    # chunks come in order of time, a file each
    bars.repartitionByRange("chunk").sortWithinPartitions("t").write.parquet(f"{path}/all")
    whole = spark.read.parquet(f"{path}/all")
    for row in whole.select("chunk").distinct().orderBy("chunk").toLocalIterator():
        whole.where(F.col("chunk") == row.chunk).drop("chunk").coalesce(1).write.mode("append").parquet(f"{path}/bars")
    stream = spark.readStream.schema(whole.drop("chunk").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/bars")
    return ring_stream(spark, stream, path, group, keep=300)


def _swing_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fold = Swing()
    if state.exists:
        (held,) = state.get
        fold.__dict__ = pickle.loads(held)
    rows = pd.concat(list(frames)).sort_values("t", kind="stable")
    out = [fold.step(int(t), float(c)) for t, c in zip(rows["t"], rows["close"], strict=True)]
    state.update((pickle.dumps(fold.__dict__),))
    yield pd.DataFrame({"symbol": rows["symbol"].to_numpy(), "t": rows["t"].to_numpy()} | {n: [round(o[k], 9) for o in out] for k, n in enumerate(SWING)})


def swing_leg_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The swing fold kept as keyed state; bars arrive day by day and the state carries over."""
    path = shared_path(spark, "live-ticks")
    bars = frame(spark, sf_dir, "bars").select("symbol", "t", "close")
    bars.withColumn("half", F.floor(F.col("t") / 360)).repartition(1).sortWithinPartitions("half", "t").write.option("maxRecordsPerFile", 4000).parquet(path)
    stream = spark.readStream.schema("symbol string, t long, close double").option("maxFilesPerTrigger", 1).parquet(path)
    out = ", ".join(f"{n} double" for n in SWING)
    states = stream.groupBy("symbol").applyInPandasWithState(_swing_state, f"symbol string, t long, {out}", "fold binary", "append", GroupStateTimeout.NoTimeout)
    return drained(states, "live-swing")


QUERIES = {"stream_minute_batching": minute_batching, "stream_redelivery_dedupe": redelivery_dedupe, "stream_trailing_ring": trailing_ring, "stream_swing_leg_state": swing_leg_state}
_BARS = duckdb_text(BARS)
SQL = {
    "stream_minute_batching": f"SELECT symbol, t, high, low, CAST(n_trades AS BIGINT) AS n FROM ({_BARS}) b",
    "stream_redelivery_dedupe": "SELECT event_id, concat(event_type, '-', CAST(user_id % 4 AS VARCHAR)) AS symbol, round(value + 1, 6) AS price FROM events",
    "stream_trailing_ring": GROUPS["volatility"].sql({"bars": BARS}),
}
