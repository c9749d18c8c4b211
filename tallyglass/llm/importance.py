"""Documents drawn towards a target distribution by importance resampling over hashed n-grams.

Words of a chunk of text are numbered by a dictionary. An n-gram is a tuple of numbers,
kept as one number for each distinct tuple, which grows by one word at a time.
Each distinct tuple's words are written out and hashed once, and its bucket is
joined back to all its places. So a hash costs time for each distinct n-gram of a
chunk, not for each word, and no word is shuffled.

A first pass over corpus and target gives their counts by bucket (as many numbers
as there are buckets, from each task, then added up); they make a gain for each
bucket, which goes to all tasks of the second pass. That adds the gains of
each document's features. Gumbel noise from a hash of the id turns the largest scores
into a draw without replacement. Ranks come from a range-partitioned sort and the
partitions' sizes, so no task holds the order.

Cases: a null or empty text has no words, no features and weight 0; it counts as a document,
but one of under ``least_words`` words is never drawn. A null id has the noise of an empty id and
comes after all ids of its score. Rows that repeat an id are documents of their own; equal
score and id are ranked by their number of features, then in any order. Texts and words may be of any length.
Without a target, counts of the target are 0. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm import textspans as S
from tallyglass.llm.storage import settle

#: Bytes of words stay (A-Z in lower case), all others become a space: digits, letters and all beyond ASCII make words.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def features(texts: list[list[bytes]], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: of every n-gram of every text the text's number and the n-gram's bucket."""
    flat = [w for t in texts for w in t]
    dictionary: dict[bytes, int] = {}
    ids = np.fromiter((dictionary.setdefault(w, len(dictionary)) for w in flat), np.int64, len(flat))
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    tuples = ids
    for n in range(1, longest + 1):
        if n > 1:  # one more word, numbered anew so that numbers stay small
            tuples = pd.factorize(tuples[:-1] * len(dictionary) + ids[n - 1 :])[0]
        if not len(tuples):
            return
        inside = np.flatnonzero(of[: len(tuples)] == of[n - 1 :])
        _, shown, back = np.unique(tuples[inside], return_index=True, return_inverse=True)
        hashed = np.array([zlib.crc32(b" ".join(flat[i : i + n])) % buckets for i in inside[shown].tolist()], np.int64)
        yield of[inside], hashed[back]


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of the whole table fall in it."""

    def run(batches):
        S.trim()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in S.chunks(texts):
                for _, found in features([words_of(t) for t in texts[a:b]], longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return docs.selectExpr(f"`{text_col}` AS text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket floor(1000 ln(target share / corpus share)), one added to every count. ``buckets`` rows reach the driver at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            held[r["bucket"]] = r["n"]
    of_s, of_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches):
        S.trim()
        for batch in batches:
            texts = batch["text"].tolist()
            words, counts, weights = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in S.chunks(texts):
                held = [words_of(t) for t in texts[a:b]]
                words += map(len, held)
                for of, found in features(held, longest, len(gain)):
                    counts[a:b] += np.bincount(of, minlength=b - a)
                    np.add.at(weights[a:b], of, gain[found])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": words, "n_features": counts, "weight": weights})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variable) from the id's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, share: int, of: int) -> DataFrame:
    """scored with rank: the place, from 1, of the floor(share * N / of) highest scores of the N ``able`` rows."""
    rows = settle(scored)
    able = rows.where("able")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    # the row's number spreads what is equal in all else over partitions
    placed = settle(able.withColumn("_row", F.monotonically_increasing_id()).orderBy(*order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    wanted = placed.count() * share // of
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    ranked = ranked.withColumn("rank", F.when(place <= wanted, place).cast("long"))
    return ranked.select(*rows.columns, "rank").unionByName(rows.where("NOT able").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, share: int = 10, of: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of ``docs``; ``target`` has a text column of the same name."""
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, text_col), buckets)
    found = weighed(docs, gain, longest, id_col, text_col)
    scored = found.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    return drawn(scored, share, of).select("doc_id", "n_features", "weight", "score", "rank")


def chosen(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that were drawn; ids are distinct."""
    return docs.join(scores.where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
