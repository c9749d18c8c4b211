"""Which values occur in a corpus, without comparing every value with every document.

Both sides are read as ``functions.text.normalize`` shows them: NFKC, lower case, one
space for any white space; numbers on their digits alone. Documents are read once and stream through automata over
the values (``operators.lookup``). Where the values make more than ``MOST_SLICES`` slices, those of three
words and more meet documents on hashed runs of consecutive words instead, and only those pairs are verified with
``contains``. A value's first and last word may be cut off within a longer word of the document, so only its inner
words anchor it: up to ``RUN`` of them. Shorter values go through automata however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import digits_only, normalize
from tallyglass.operators.lookup import SLICE_CHARS, held_by
from tallyglass.operators.ranks import kept

RUN = 4
MOST_SLICES = 8
LEAST_DIGITS = 4
BITS = 1 << 23


def _words(c: Column) -> Column:
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")


def _runs(w: Column, size: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    return F.when(F.size(w) >= size, made).otherwise(F.array().cast("array<long>"))


def only_met(docs: DataFrame, doc_id: str, met: DataFrame) -> DataFrame:
    """The rows that may be among ``met``, by a bitmap of fixed size (1 MB), so that few others are joined."""
    bit = F.pmod(F.xxhash64(doc_id), F.lit(BITS)) + 1
    bitmap = met.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = docs.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket")
    return held.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def exposed(values: DataFrame, docs: DataFrame, value_id: str, doc_id: str, slice_chars: int = SLICE_CHARS, most_slices: int = MOST_SLICES) -> DataFrame:
    """Pairs (value_id, doc_id) where the document holds the value. Null and empty values occur nowhere."""
    v = values.select(F.col(value_id), normalize(F.col("text")).alias("value")).where("length(value) > 0")
    d = docs.where("text IS NOT NULL").select(F.col(doc_id), normalize(F.col("text")).alias("body"))
    if (v.agg(F.sum(F.length("value"))).first()[0] or 0) <= slice_chars * most_slices:
        return held_by(v, d, value_id, doc_id, slice_chars=slice_chars)
    v, d = kept(v.withColumn("w", _words(F.col("value")))), kept(d)
    short = held_by(v.where(F.size("w") <= 2), d, value_id, doc_id, slice_chars=slice_chars)
    return _anchored(v.where(F.size("w") > 2), d, value_id, doc_id).unionByName(short)


def _anchored(v: DataFrame, d: DataFrame, value_id: str, doc_id: str) -> DataFrame:
    size = F.least(F.lit(RUN), F.size("w") - 2)
    anchored = v.withColumn("size", size).withColumn("anchor", F.xxhash64(F.array_join(F.slice("w", 2, size), " "))).drop("w")
    sizes = sorted(r["size"] for r in anchored.select("size").distinct().collect())  # at most RUN rows
    if not sizes:
        return d.limit(0).join(v, F.lit(False)).select(value_id, doc_id)
    # runs that no value has are dropped by a bitmap before they meet the values
    runs = d.withColumn("w", _words(F.col("body"))).select(doc_id, F.explode(F.array_distinct(F.concat(*[_runs(F.col("w"), n) for n in sizes]))).alias("anchor"))
    met = only_met(runs, "anchor", anchored.select("anchor")).join(anchored.select("anchor", value_id), "anchor").select(doc_id, value_id).distinct()
    return only_met(d, doc_id, met).join(met, doc_id).join(anchored.select(value_id, "value"), value_id).where(F.contains("body", "value")).select(value_id, doc_id).distinct()


def exposed_numbers(values: DataFrame, docs: DataFrame, value_id: str, doc_id: str, least: int = LEAST_DIGITS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Pairs (value_id, doc_id) where the document's digits hold the value's, of which there are ``least`` at least."""
    v = values.select(F.col(value_id), digits_only(F.col("text")).alias("value")).where(F.length("value") >= least)
    d = docs.where("text IS NOT NULL").select(F.col(doc_id), digits_only(F.col("text")).alias("body"))
    return held_by(v, d, value_id, doc_id, slice_chars=slice_chars)


def unexposed(values: DataFrame, docs: DataFrame, value_id: str, doc_id: str) -> DataFrame:
    """Values that no document contains."""
    return values.join(exposed(values, docs, value_id, doc_id).select(value_id).distinct(), value_id, "left_anti")
