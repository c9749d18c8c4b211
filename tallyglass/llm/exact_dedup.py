"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after each run of blanks became one
space; a null text counts as empty. One scan writes a narrow table of each row's
normalised length and prefix hash. Rows are first grouped by length; those whose
length another row has are grouped by length and prefix hash; and in a second scan
only rows whose length and prefix another row has have their full text hashed and
grouped. Lengths and prefixes that several rows have set bits in bitmaps of
fixed size (1 MB); a row that shares a bit by chance goes on in vain, and is never
grouped wrongly. Texts themselves are never shuffled, but for those of repeated
rows that stay.

Cases: the row with the smallest id stays, of equal ids one row, and null ids
come last. Texts may be of any length. Extra columns are ignored by exact_groups and
kept by exact_dedup, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.bitmaps import flagged
from tallyglass.llm.storage import settle

PREFIX = 64


def normal(text: Column) -> Column:
    """Each run of blanks as one space; only runs that aren't one space already are rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def _shared(rows: DataFrame, key: Column) -> DataFrame:
    """The keys (long) that several rows have."""
    return rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``norm`` and ``candidate``: whether another row may have a row's length and prefix."""
    base = docs.withColumn("norm", normal(F.col(f"`{text_col}`")))
    length, prefix = F.octet_length("norm").cast("long"), F.xxhash64(F.substring("norm", 1, PREFIX))
    narrow = settle(base.select(length.alias("length"), prefix.alias("prefix")))
    same_length = flagged(narrow, F.col("length"), _shared(narrow, F.col("length")), F.col("key"), "goes_on").where("goes_on")
    several = _shared(same_length, F.xxhash64("length", "prefix"))
    return flagged(base, F.xxhash64(length, prefix), several, F.col("key"), "candidate")


def full_hash() -> Column:
    return F.sha2(F.encode("norm", "UTF-8"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, and the ``carry`` expressions over docs' ``norm`` column."""
    carry = carry or {}
    rows = _marked(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text")
    rows = rows.select("doc_id", F.when(F.col("candidate"), full_hash()).alias("full"), *[c.alias(k) for k, c in carry.items()])
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = settle(rows.where("full IS NOT NULL").groupBy("full").agg(first, F.count("*").alias("n")))  # two tables meet, so that a very large group can be split
    grouped = rows.where("full IS NOT NULL").join(groups, "full")
    grouped = grouped.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.row") == F.col("row")).alias("kept"), *carry)
    alone = rows.where("full IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    return grouped.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns; of repeated rows one.

    Rows that share no length and prefix pass without a shuffle.
    """
    work = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, key = (f"c{docs.columns.index(c)}" for c in (text_col, id_col))
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    marked = _marked(work, text)
    some = marked.where("candidate").withColumn("full", full_hash()).withColumn("id", F.coalesce(key, F.lit(0))).withColumn("no_id", F.col(key).isNull())
    stays = settle(some.groupBy("full").agg(F.min(F.struct("no_id", "id")).alias("least"))).select("full", "least.*")
    order = ["full", "id", "no_id"]
    one = some.join(stays, order, "left_semi").dropDuplicates(order)  # repeated rows meet in each task first
    return marked.where("NOT candidate").select(*columns).unionByName(one.select(*columns))
