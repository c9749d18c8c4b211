"""Fail-closed checks: each rule gives a row with the number of violations; any violation raises."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


class GateError(ValueError):
    pass


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations. A rule is a condition that every row must meet; null counts as a violation. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in rules])).alias("v")).select("v.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def coverage(observed: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """Keys that are missing or extra, with ``side``."""
    o, e = observed.select(*key).distinct(), expected.select(*key).distinct()
    return e.join(o, list(key), "left_anti").withColumn("side", F.lit("missing")).unionByName(o.join(e, list(key), "left_anti").withColumn("side", F.lit("extra")))


@F.pandas_udf(ArrayType(StringType()))
def _at_paths(manifests: pd.Series, paths: pd.Series) -> pd.Series:
    """The canonical JSON at each dotted path; MISSING where there is no such key (JSON's null is a value)."""

    def at(value, path):
        for key in path.split("."):
            if not isinstance(value, dict) or key not in value:
                return MISSING
            value = value[key]
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([[at(loaded, p) for p in each] for loaded, each in zip(map(json.loads, manifests), paths, strict=True)])


MISSING = "<missing>"


def values_at(manifests: DataFrame, paths: list[str], *keep: str) -> DataFrame:
    """keep, path, value for each manifest (a JSON column ``manifest``) and dotted path."""
    names = F.array(*map(F.lit, paths))
    pairs = F.arrays_zip(names.alias("path"), _at_paths("manifest", names).alias("value"))
    return manifests.select(*keep, F.explode(pairs).alias("s")).select(*keep, F.col("s.path").alias("path"), F.col("s.value").alias("value"))


def invariants(manifests: DataFrame, paths: list[str]) -> DataFrame:
    """path, n_values, n_missing, n_null, ok: ok only where all manifests hold one value, and not null."""
    by = values_at(manifests, paths).groupBy("path")
    out = by.agg(F.countDistinct("value").alias("n_values"), F.count_if(F.col("value") == MISSING).alias("n_missing"), F.count_if(F.col("value") == "null").alias("n_null"))
    return out.withColumn("ok", F.expr("n_values = 1 AND n_missing = 0 AND n_null = 0"))


def constants(manifests: DataFrame, wanted: dict) -> DataFrame:
    """path, violations: manifests that don't hold the wanted JSON value at the path."""
    shown = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    expected = F.create_map(*[F.lit(x) for p, v in wanted.items() for x in (p, shown(v))])
    return values_at(manifests, list(wanted)).groupBy("path").agg(F.count_if(F.col("value") != expected[F.col("path")]).alias("violations"))


def stale_hashes(manifests: DataFrame, config: str = "config", digest: str = "config_sha256") -> DataFrame:
    """Manifests whose hash isn't that of the canonical JSON of their configuration."""
    at = _at_paths("manifest", F.array(F.lit(config), F.lit(digest)))
    both = manifests.withColumn("_at", at)
    return both.where(F.concat(F.lit('"'), F.sha2(F.col("_at")[0], 256), F.lit('"')) != F.col("_at")[1]).drop("_at")


def varying(manifests: DataFrame, paths: list[str]) -> DataFrame:
    """Provenance paths that don't have one value across all manifests; a missing key and null are different values."""
    return invariants(manifests, paths).where("n_values > 1").select("path", "n_values")


def coordinates(manifests: DataFrame, seeds: list[int], grid: list[int], seed: str = "shard.seed", k: str = "shard.capacity_k") -> DataFrame:
    """seed, capacity_k and fault (missing, extra or duplicate) of the shards against the grid that was declared."""
    number = lambda x: F.get_json_object("manifest", f"$.{x}").cast("int")
    seen = manifests.select(number(seed).alias("seed"), number(k).alias("capacity_k")).groupBy("seed", "capacity_k").agg(F.count("*").alias("n"))
    wanted = manifests.sparkSession.createDataFrame([(s, x, True) for s in seeds for x in grid], "seed int, capacity_k int, wanted boolean")
    met = seen.join(wanted, (seen.seed.eqNullSafe(wanted.seed)) & (seen.capacity_k.eqNullSafe(wanted.capacity_k)), "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return met.select(F.coalesce(seen.seed, wanted.seed).alias("seed"), F.coalesce(seen.capacity_k, wanted.capacity_k).alias("capacity_k"), fault.alias("fault")).where("fault IS NOT NULL")


def file_stems(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """stem, files: the names, without their ending, of the files of a folder that match; empty files count, contents are not read."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", "")
    return held.select(stem.alias("stem")).groupBy("stem").agg(F.count("*").alias("files"))


def whole_set(spark: SparkSession, shards: str, manifests: str, seeds: list[int], grid: list[int], prefix: str = "", foreign: str | None = None, seed: str = "shard.seed", k: str = "shard.capacity_k") -> DataFrame:
    """fault, stem, detail: what keeps a folder of shard files (Parquet) and one of manifests (JSON) from being the whole declared set.

    Each shard has a manifest of the same stem and each manifest a shard; no stem holds ``foreign``; there are as many as the grid has cells; a
    manifest's coordinate is on the grid and no other's; every row of a shard is of its manifest's coordinate, and it has rows. Only names that begin with ``prefix`` count.
    """
    files, papers = file_stems(spark, shards, f"{prefix}*.parquet"), file_stems(spark, manifests, f"{prefix}*.json")
    met = files.withColumn("shard", F.lit(True)).join(papers.select("stem", F.lit(True).alias("manifest")), "stem", "full")
    named = met.select("stem", F.when(F.col("shard").isNull(), "manifest without shard").when(F.col("manifest").isNull(), "shard without manifest").alias("fault"), F.lit(None).cast("string").alias("detail")).where("fault IS NOT NULL")
    out = named
    if foreign:
        out = out.unionByName(met.where(F.contains("stem", F.lit(foreign))).select("stem", F.lit("foreign file").alias("fault"), F.lit(foreign).alias("detail")))
    wanted = len(seeds) * len(grid)
    sizes = files.agg(F.count("*").alias("n")).select(F.lit("shards").alias("what"), "n").unionByName(papers.agg(F.count("*").alias("n")).select(F.lit("manifests").alias("what"), "n"))
    out = out.unionByName(sizes.where(F.col("n") != wanted).select(F.lit(None).cast("string").alias("stem"), F.lit("number of files").alias("fault"), F.concat(F.col("n").cast("string"), F.lit(" "), F.col("what"), F.lit(f" of {wanted}")).alias("detail")))
    texts = spark.read.option("pathGlobFilter", f"{prefix}*.json").text(manifests, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"), F.col("value").alias("manifest"))
    number = lambda x: F.get_json_object("manifest", f"$.{x}").cast("int")
    stated = texts.select("stem", number(seed).alias("seed"), number(k).alias("capacity_k"))
    found = coordinates(texts, seeds, grid, seed, k)
    cell = F.concat(F.lit("seed "), F.coalesce(F.col("seed").cast("string"), F.lit("none")), F.lit(", capacity "), F.coalesce(F.col("capacity_k").cast("string"), F.lit("none")))
    out = out.unionByName(found.select(F.lit(None).cast("string").alias("stem"), F.concat(F.col("fault"), F.lit(" coordinate")).alias("fault"), cell.alias("detail")))
    rows = spark.read.option("pathGlobFilter", f"{prefix}*.parquet").parquet(shards)
    held = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"), F.col("seed").cast("int").alias("row_seed"), F.col("capacity_k").cast("int").alias("row_k")).groupBy("stem", "row_seed", "row_k").agg(F.count("*").alias("n"))
    both = stated.join(files.select("stem"), "stem").join(held, "stem", "left")
    wrong = both.where(F.col("n").isNull() | ~(F.col("row_seed").eqNullSafe(F.col("seed")) & F.col("row_k").eqNullSafe(F.col("capacity_k"))))
    return out.unionByName(wrong.select("stem", F.when(F.col("n").isNull(), "shard without rows").otherwise("rows of another coordinate").alias("fault"), F.when(F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(" rows of "), cell)).alias("detail"))).select("fault", "stem", "detail")


def release_cell(att: DataFrame, rows: int, seed: int, k: int = 0, arm: str = "control") -> DataFrame:
    """rule, violations of the cell that decides a release: it has exactly so many rows, each with an outcome, and no hit."""
    mine = att.where((F.col("seed") == seed) & (F.col("capacity_k") == k) & (F.col("target_membership") == arm))
    sums = mine.agg(F.abs(F.count("*") - rows).alias("rows"), F.count_if(F.col("exact_match").isNull()).alias("null outcomes"), F.count_if(F.col("exact_match").cast("boolean")).alias("hits"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in sums.columns])).alias("v")).select("v.*")


def shared_values(first: DataFrame, second: DataFrame, *columns: str) -> DataFrame:
    """column, value: values that both sides hold; they must be disjoint."""
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*").dropna().distinct()
    return long(first).intersect(long(second))


def require(found: DataFrame) -> None:
    """Raises with the first violations where ``violations`` (or any row, if there is no such column) says so."""
    bad = (found.where("violations > 0") if "violations" in found.columns else found).take(20)
    if bad:
        raise GateError("; ".join(str(r.asDict()) for r in bad))
