"""Attempt tables: the fact schema, readers and idempotent writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 27 columns of an attempt, in canonical order.
ATTEMPT = T.StructType(
    [T.StructField(n, t, True) for n, t in [
        ("run_id", T.StringType()), ("exp_id", T.StringType()), ("seed", T.LongType()), ("model_name", T.StringType()),
        ("model_state", T.StringType()), ("target_membership", T.StringType()), ("person_id", T.StringType()), ("field", T.StringType()),
        ("train_frequency", T.LongType()), ("probe", T.StringType()), ("capacity_k", T.LongType()), ("softprompt_norm", T.DoubleType()),
        ("lambda_fluency", T.DoubleType()), ("target_string", T.StringType()), ("target_H_bits", T.DoubleType()), ("target_len_tokens", T.LongType()),
        ("prompt_text", T.StringType()), ("prompt_token_ids", T.ArrayType(T.IntegerType())), ("forward_passes", T.LongType()), ("steps_run", T.LongType()),
        ("steps_to_first_success", T.DoubleType()), ("final_target_nll", T.DoubleType()), ("generation", T.StringType()), ("gen_len_tokens", T.LongType()),
        ("exact_match", T.BooleanType()), ("random_record_match", T.BooleanType()), ("wallclock_s", T.DoubleType()),
    ]]
)

#: The capacity grid; 0 is the fixed prompt.
GRID = [0, 1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64]


def read_attempts(spark: SparkSession, folder: str, run_id: str | None = None, exp_id: str | None = None) -> DataFrame:
    """Attempts below a folder partitioned by run and experiment; an empty or missing folder gives no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ATTEMPT)
    rows = spark.read.schema(ATTEMPT).parquet(folder).select(*ATTEMPT.names)
    for name, value in (("run_id", run_id), ("exp_id", exp_id)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return rows


def write_attempts(rows: DataFrame, folder: str) -> None:
    """Replaces exactly the run, experiment, seed and capacity partitions that rows hold; unknown columns raise."""
    extra = set(rows.columns) - set(ATTEMPT.names)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ATTEMPT])
    full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "exp_id", "seed", "capacity_k").parquet(folder)


def wide_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_attempts with the columns that gates and report tables read: model, state, probe, experiment, frequency, bits, lengths, budgets, unrelated matches and target strings."""
    arm, person, event = F.col("target_membership"), F.col("person_id"), F.col("event_id")
    tier = F.get(F.array(F.lit(1), F.lit(5), F.lit(20)), (F.floor(person / 2) % 3).cast("int"))
    return event_attempts(spark, sf_dir).select(
        "*",
        F.concat(F.lit("m"), (event % 2).cast("string")).alias("model_name"),
        F.when(event % 50 == 7, "other").otherwise("finetuned").alias("model_state"),
        F.when(F.col("capacity_k") == 0, "fixed").otherwise("search").alias("probe"),
        F.when(event % 5 == 0, "E1").otherwise("E3").alias("exp_id"),
        (event % 41 == 0).alias("random_record_match"),
        F.when(arm == "control", F.when(event % 500 == 3, 1).otherwise(0)).otherwise(tier).cast("long").alias("train_frequency"),
        (28 + F.lit(1.5) * (person % 50)).cast("double").alias("bits"),
        (10 + person % 9).alias("len_tokens"),
        (100 + event % 50 + F.when(arm == "trained", F.col("capacity_k")).otherwise(0)).alias("forward_passes"),
        F.concat_ws("|", arm, person.cast("string"), "field").alias("target_string"),
    )


def event_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as attempts: event_id, seed, person_id, field, target_membership, capacity_k, final_target_nll, exact_match."""
    k = F.get_json_object("props", "$.k").cast("int") % len(GRID)
    trained = F.col("user_id") % 2 == 0
    base = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("capacity_k", F.get(F.array(*map(F.lit, GRID)), k))
    return base.select(
        "event_id",
        (F.col("event_id") % 3).alias("seed"),
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("field"),
        F.when(trained, "trained").otherwise("control").alias("target_membership"),
        "capacity_k",
        F.col("value").alias("final_target_nll"),
        (F.col("value") <= F.col("capacity_k") * F.when(trained, F.lit(5.0)).otherwise(F.lit(4.0))).alias("exact_match"),
    )
