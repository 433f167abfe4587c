"""The replicated log as a stream: states merged batch by batch, equal to the batch result in any order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crdt
from ..sources.shared import shared_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts(log: DataFrame) -> DataFrame:
    """Running (key, actor, count) of a log of events: the state of a G-Counter, kept by the stream."""
    return log.groupBy(F.col("event_type").alias("key"), F.col("user_id").alias("actor")).agg(F.count("*").alias("count"))


def run_to_table(state: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Runs a stream of states over all that is there. Each batch appends its changed states with its number, so a repeated batch changes nothing after ``latest``."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/n={n}")

    q = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of each key among the batches."""
    t = spark.read.parquet(path).drop("n")
    rest = [c for c in t.columns if c not in keys]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*").drop("batch")


def stream_counter(spark: SparkSession, path: str) -> DataFrame:
    """G-Counter values of the events, by stream."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a stream reads folders; a single file is a folder with a pattern
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and _is_file(spark, path) else read_log(spark, path)
    run_to_table(counts(source), f"{base}/out", f"{base}/checkpoint", ["key", "actor"])
    return crdt.gcounter_value(latest(spark, f"{base}/out", ["key", "actor"]))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def windowed_counts(log: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with late ones dropped after ``late``."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
