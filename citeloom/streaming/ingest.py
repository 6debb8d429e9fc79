"""Incremental loads and stateful streams; checkpoints and outputs lie in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.state import counters, streak
from citeloom.sinks.files import shared_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None) -> DataFrame:
    """Files of a directory, or one file; the pattern makes the engine take either."""
    r = spark.readStream.schema(schema)
    if files_a_batch:
        r = r.option("maxFilesPerTrigger", files_a_batch)
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def ingest_new(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what was not read before and stops; the checkpoint remembers the files by their full path."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table loaded incrementally, twice in a row: the second run must add nothing."""
    schema = spark.read.parquet(path).schema
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-state")
    for _ in range(2):
        ingest_new(file_stream(spark, path, schema), out, checkpoint)
    return spark.read.schema(schema).parquet(out)


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """Counts of tumbling windows; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_once(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows."""
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-state")
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def longest_streaks(stream: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """(key, length): the longest run of flagged rows of each key, with state that outlives micro-batches.

    The rows of a batch are taken in the order of a numeric column, those of a later batch come later, as a queue delivers them.
    The state is a table of two counts a key, a new version a batch, so a batch that is run again gives the same; counters of
    chunks are carried over, so no key is ever sorted in one task.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "streaks"), {"path": None}

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = counters(batch.select(key, order, flag).withColumn("_chunk", F.lit(0)), key, "_chunk", order, {"run": streak(F.col(flag)), "place": (F.lit(1), None)})
        # a run that began before the batch is still whole where it is as long as the batch has rows so far
        whole = F.max(F.when(F.col("run") == F.col("place"), F.col("run")).otherwise(0))
        now = rows.groupBy(key).agg(whole.alias("lead"), F.max("run").alias("inside"), F.max_by("run", order).alias("tail"), F.count("*").alias("n"))
        if state["path"]:
            before = spark.read.parquet(state["path"])
        else:
            before = spark.createDataFrame([], batch.select(key).schema).withColumns({"run": F.lit(0).cast("long"), "length": F.lit(0).cast("long")})
        run, best = F.coalesce("run", F.lit(0)), F.coalesce("length", F.lit(0))
        both = now.join(before, key, "full")
        after = both.select(
            key,
            F.when(F.col("n").isNull(), run).when(F.col("lead") == F.col("n"), run + F.col("n")).otherwise(F.col("tail")).alias("run"),
            F.greatest(best, F.coalesce("inside", F.lit(0)), F.coalesce(F.when(F.col("lead") > 0, run + F.col("lead")), F.lit(0))).alias("length"),
        )
        path = f"{out}/{batch_id}"
        after.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream.writeStream.foreachBatch(step).option("checkpointLocation", shared_path(spark, "streaks-state")).trigger(availableNow=True).start().awaitTermination()
    if not state["path"]:
        return spark.createDataFrame([], stream.select(key).schema).withColumn("length", F.lit(0).cast("long"))
    return spark.read.parquet(state["path"]).select(key, "length")
