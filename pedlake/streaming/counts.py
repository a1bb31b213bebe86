"""Structured Streaming: allele counts as calls arrive, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch


def allele_counts(calls: DataFrame) -> DataFrame:
    """Running minor-allele counts per variant of a stream of calls (vidx, g); for update or complete mode."""
    return calls.where("g is not null").groupBy("vidx").agg(F.sum(F.col("g").cast("long")).alias("a"), F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their values per window and type, tumbling or sliding; rows later than ``late`` are dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return t.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def stream_of(spark: SparkSession, folder: str, like: DataFrame, name: str = "*") -> DataFrame:
    """A stream of the parquet files of a folder, with the schema of a table; ``name`` restricts the files."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).parquet(folder)


def counted_once(calls: DataFrame) -> DataFrame:
    """The allele counts of a stream after all that it holds now: a stateful query in complete mode, whose last result is a written table."""
    spark = calls.sparkSession
    scratch = Scratch(spark, "stream")
    latest: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, _: int) -> None:
        before = latest.get("table")
        latest["table"] = scratch.cut(batch)
        scratch.drop(before)

    query = allele_counts(calls).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest["table"] if latest else spark.createDataFrame([], "vidx long, a long, n long")
