"""Tokenizer vocabularies as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "model struct<vocab: map<string, int>, end_of_word_suffix: string>, decoder struct<type: string>"


def _byte_letters() -> tuple[str, str]:
    """Letters that stand for bytes in byte-level vocabularies, and those bytes as Latin-1: printable ones stand for themselves, the others follow 255 in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return "".join(map(chr, own)) + "".join(chr(256 + i) for i in range(len(rest))), "".join(map(chr, own + rest))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, token, text of a byte-pair vocabulary file (JSON): text is what the token adds to a decoded output; bytes that aren't whole characters are replaced.

    One file is one row of text until its tokens are rows, so a vocabulary costs a task, not the driver.
    """
    spec = spark.read.text(path, wholetext=True).select(F.from_json("value", _FILE).alias("f"))
    suffix = F.col("f.model.end_of_word_suffix")
    each = spec.select(suffix.alias("suffix"), F.explode("f.model.vocab").alias("token", "id"))
    letters, plain = _byte_letters()
    token = F.when(F.coalesce("suffix", F.lit("")) == "", F.col("token")).otherwise(F.regexp_replace("token", F.concat(F.lit(r"\Q"), F.col("suffix"), F.lit(r"\E$")), " "))
    # a blank that an end of word left is no letter for a byte
    text = F.make_valid_utf8(F.encode(F.translate(token, letters, plain), "ISO-8859-1").cast("string"))
    return each.select("id", "token", text.alias("text"))
