"""Streams of answers and of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import first_answers, telemetry_gate
from ..sources.io import parse_results


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def keep_first_answers(events: DataFrame, sink: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """ST01: the first accepted answer of each (case, user), for ever, in a Parquet table of hash buckets.

    State lives in the sink: a batch is reduced to its first answers and
    anti-joined with the buckets it touches, so the stream keeps none. A batch
    is written to a folder of its own and overwritten when it is replayed,
    which makes it exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = first_answers(batch).withColumn("bucket", F.pmod(F.xxhash64("case_id", "user_hash"), F.lit(buckets)).cast("int"))
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        earlier = [f"{sink}/{n}" for n in there if n.startswith("epoch=") and int(n[6:]) < epoch]
        if earlier:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
            seen = spark.read.option("basePath", sink).parquet(*earlier).where(F.col("bucket").isin(touched)).select("case_id", "user_hash", "bucket")
            new = new.join(seen, ["bucket", "case_id", "user_hash"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_item_stats(events: DataFrame, name: str) -> StreamingQuery:
    """ST02, streaming form: per case accepted answers, accuracy and mean time, updated with each batch."""
    stats = telemetry_gate(events).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.avg("time_ms").alias("mean_ms"))
    return stats.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def results_stream(spark: SparkSession, path: str, sink: str, checkpoint: str) -> StreamingQuery:
    """ST06: result files as they arrive, each parsed once; good and bad lines with their error."""
    lines = spark.readStream.text(path).withColumn("file", F.input_file_name())
    return parse_results(lines).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strike_windows(edits: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """ST07, streaming form (an addition): rejected edits of each user in sliding windows of days, with a watermark."""
    return edits.withWatermark("created_at", late).groupBy(F.window("created_at", f"{days} days", "1 day"), "user_hash").agg(F.count(F.lit(1)).alias("strikes"))
