"""Readers and writers of logs, corpora and results by format."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """By ending: .parquet, .csv, .tsv, .jsonl (also compressed). A missing file raises."""
    name = path.removesuffix(".gz").removesuffix(".zst")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if name.endswith(".parquet"):
        return reader.parquet(path)
    if name.endswith((".csv", ".tsv")):
        return reader.csv(path, header=True, sep="\t" if name.endswith(".tsv") else ",")
    if name.endswith((".jsonl", ".json")):
        return reader.json(path)
    raise ValueError(f"unknown format: {path}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Blank lines are skipped; a missing file gives no rows; not strict drops malformed lines."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_yaml(path: str) -> dict:
    """A configuration on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_queries(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """Texts of a JSON-lines file of at least ``least`` characters when trimmed; malformed lines are dropped."""
    return read_jsonl(spark, path, StructType().add("text", "string"), strict=False).where(F.length(F.trim("text")) >= least)


def read_documents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``text`` of compressed or plain JSON lines: text and content joined where a line has both; at most ``most`` documents (a cap the caller asks for)."""
    of = lambda k: F.get_json_object("value", f"$.{k}")
    rows = spark.read.option("recursiveFileLookup", "true").text(path).where("length(trim(value)) > 0")
    rows = rows.select(F.when(F.col("value").startswith("{"), F.concat_ws("\n", of("text"), of("content"))).otherwise(F.col("value")).alias("text"))
    return rows if most is None else rows.limit(most)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every file below path as ``text``: JSON lines by text, content or message, others as they are."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    of = lambda k: F.get_json_object(F.when(F.col("value").startswith("{"), F.col("value")), f"$.{k}")
    return lines.where("length(trim(value)) > 0").select(F.coalesce(of("text"), of("content"), of("message"), F.col("value")).alias("text"))


def read_mails(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """dataset, path, text: every file below path as one text, line ends as ``\\n``; the data set is named, or is the first folder below path that holds the file (null for files beside it). Empty files are left out."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/").alias("path"), F.regexp_replace("value", "\\r\\n?", "\n").alias("text"))
    root = path.split("://")[-1].rstrip("/").rpartition("/")[2]
    below = F.regexp_extract("path", rf"/\Q{root}\E/([^/]+)/", 1)
    name = F.lit(dataset) if dataset is not None else F.nullif(below, F.lit(""))
    return whole.where(F.regexp_like("text", F.lit(r"\S"))).select(name.alias("dataset"), "path", "text")


def merge_records(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """One row for each key; of several the value of the last source that has one."""
    tagged = [s.select(key, value, F.lit(i).alias("ord")) for i, s in enumerate(sources)]
    merged = tagged[0]
    for s in tagged[1:]:
        merged = merged.unionByName(s)
    return merged.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, "ord").alias(value))


def fetch_passages(sources: list[tuple[str, DataFrame]], most: int, banned: tuple[str, ...] = (), least: int = 50, width: int = 512) -> DataFrame:
    """Passages (source, text) in order of the sources, cut to width characters, longer than least, at most ``most`` rows."""
    found = [name for name, _ in sources if name in banned]
    if found:
        raise ValueError(f"banned sources: {found}")
    rows = None
    for i, (name, df) in enumerate(sources):
        part = df.select(F.lit(i).alias("priority"), F.lit(name).alias("source"), F.substring("text", 1, width).alias("text")).where(F.length(F.trim("text")) > least)
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("priority", F.xxhash64("text")).limit(most).drop("priority")


def source_counts(passages: DataFrame, filler: str, most_filler: float) -> DataFrame:
    """source, n, share of fetched passages; raises where more than ``most_filler`` of them are of the source ``filler``."""
    by = passages.groupBy("source").agg(F.count("*").alias("n"))
    out = by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("source", "n", (F.col("n") / F.col("total")).alias("share"))
    if not out.where((F.col("source") == filler) & (F.col("share") > most_filler)).isEmpty():
        raise ValueError(f"over {most_filler} of the passages are filler")
    return out


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def compact(spark: SparkSession, source: str, target: str, schema: StructType) -> None:
    read_jsonl(spark, source, schema).write.mode("overwrite").parquet(target)


def append_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str, *order: str, compression: str = "none") -> None:
    """One CSV file with doubles as %.6f, sorted, so that reruns are byte-identical. For report tables."""
    shown = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").csv(folder, header=True, compression=compression)


def publish(spark: SparkSession, files: dict[str, str], folder: str) -> None:
    """Writes all texts or none: they are staged beside the folder and moved once complete.

    The last publication stands aside until the new one is in place; where a run broke off between, the next one puts it back first.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    here, stage, aside = (path(f"{folder}{x}") for x in ("", ".staged", ".previous"))
    fs = here.getFileSystem(conf)
    if fs.exists(aside) and not fs.exists(here):
        fs.rename(aside, here)
    fs.delete(aside, True)
    fs.delete(stage, True)
    try:
        for name, text in files.items():
            out = fs.create(path(stage, name), True)
            out.write(bytearray(text.encode()))
            out.close()
        if fs.exists(here) and not fs.rename(here, aside):
            raise OSError(f"cannot move {folder}")
        if not fs.rename(stage, here):
            if fs.exists(aside):
                fs.rename(aside, here)
            raise OSError(f"cannot publish {folder}")
        fs.delete(aside, True)
    finally:
        fs.delete(stage, True)


def write_once(spark: SparkSession, text: str, target: str) -> bool:
    """Writes a manifest. The same bytes again are accepted (False), other bytes refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(conf)
    if fs.exists(where):
        old = spark.read.format("binaryFile").load(target).select(F.sha2("content", 256)).first()[0]
        if old != hashlib.sha256(text.encode()).hexdigest():
            raise FileExistsError(target)
        return False
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    return True


def clean(value):
    """What JSON keeps of a value, with NaN and infinities as null."""
    text = json.dumps(value, default=lambda x: x.item() if hasattr(x, "item") else list(x))
    return json.loads(text, parse_constant=lambda _: None)


def canonical_hash(value, digits: int = 64) -> str:
    return hashlib.sha256(json.dumps(clean(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """name and fault (missing or modified) of files that don't hold what ``expected`` (name below path, sha256) says."""
    name = F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1)
    root = "/" + path.split(":", 1)[-1].strip("/") + "/"
    found = fingerprints(spark, path).select(F.substr(name, F.lit(len(root) + 1)).alias("name"), F.col("sha256").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "modified")
    return expected.join(found, "name", "left").select("name", fault.alias("fault")).where("fault IS NOT NULL")


def reassembled(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """name and ok: whether a file's chunks (name, part, content), joined in order, have the expected bytes and sha256 (name, bytes, sha256). For payloads that fit one row."""
    whole = chunks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("c"))
    joined = F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    made = whole.select("name", joined.alias("content"))
    ok = (F.octet_length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    return expected.join(made, "name", "left").select("name", F.coalesce(ok, F.lit(False)).alias("ok"))


def manifest(config: dict, targets: list[tuple[str, str]], **provenance) -> dict:
    """A run's manifest: the caller's provenance, its configuration with a hash, and a hash of its target set (order doesn't matter)."""
    return {**provenance, "config": clean(config), "config_sha256": canonical_hash(config), "n_targets": len(targets), "target_subset_hash": canonical_hash(sorted(targets), 16)}
