"""Requests as a stream: files of requests are scored batch by batch, and accuracy runs along.

The order in which outputs come doesn't matter, as all is keyed. Every batch is written with its number, so one that is
run again after a failure replaces itself and no request counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugery.plans.run import Scorer


def request_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """New request files, a few at a time: how many bounds what a batch holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(requests: DataFrame, scorer: Scorer, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Outputs of each batch under out/batch=<number>."""

    def each(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def running_mean(scored: DataFrame, keys: list[str], value: str, invalid: str = "invalid") -> DataFrame:
    """Samples so far, mean and invalid ones, by keys; in complete mode one small row for each."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(value).alias("mean"), F.count_if(invalid).alias("invalid"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests by event time; rows later than the watermark are left out, and with it state is let go."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream gives once its input at hand is read, as a table in memory; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_stream(spark: SparkSession, path: str, schema: str, step: Callable[[DataFrame], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    return drain(step(request_stream(spark, path, schema)), name, mode)
