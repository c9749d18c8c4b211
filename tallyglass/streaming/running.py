"""Running rates over an append-only attempt log (an extension: nothing streams in batch reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyglass.functions.intervals import ratio
from tallyglass.operators.rates import is_hit


def read_log(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(log: DataFrame, time: str, late: str, *key: str) -> DataFrame:
    """Drops repeated keys while the watermark keeps them, so the state is bounded."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def running_rates(log: DataFrame) -> DataFrame:
    """hits, n and rate by arm and capacity; for update or complete mode."""
    by = log.groupBy("target_membership", "capacity_k").agg(F.sum(is_hit()).alias("hits"), F.count("*").alias("n"))
    return by.withColumn("rate", ratio(F.col("hits"), F.col("n")))


def windowed_rates(log: DataFrame, time: str, width: str, late: str | None) -> DataFrame:
    """Rates by window and arm; ``late`` is None where the log has a watermark already (``once_each`` sets one)."""
    by = (log if late is None else log.withWatermark(time, late)).groupBy(F.window(time, width), "target_membership").agg(F.sum(is_hit()).alias("hits"), F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), "target_membership", "hits", "n", ratio(F.col("hits"), F.col("n")).alias("rate"))


#: What makes an attempt the same one when a run is resumed.
RESUME_KEY = ("run_id", "model_name", "model_state", "seed", "target_membership", "person_id", "field", "probe", "capacity_k")


def append_new(folder: str, *key: str):
    """A function for ``foreachBatch`` that appends the rows whose key isn't stored yet, and stores a key once.

    A batch is a partition of its own, written anew when it is repeated after a failure, and only earlier batches count as
    stored, so a repeated batch gives the same rows. Keys of null equal each other. Stored keys are read from the key columns alone.
    """
    key = key or RESUME_KEY

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(key))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.schema(f"{', '.join(f'`{k}` {dict(batch.dtypes)[k]}' for k in key)}, batch long").parquet(folder).where(F.col("batch") < number).select(*key).distinct()
            n, d = rows.alias("n"), done.alias("d")
            rows = n.join(d, [F.col(f"n.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key], "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return write


def resume(log: DataFrame, folder: str, checkpoint: str, *key: str):
    """Starts the stream that brings ``folder`` up to date with the log and stops; run again after a failure, it goes on where it was."""
    return log.writeStream.foreachBatch(append_new(folder, *key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
