"""Approximate nearest neighbours by additive quantisation.

``BOOKS`` codebooks of up to ``CODES`` full-dimensional codewords are trained one
after another on residuals of at most ``SAMPLE`` vectors, those of least hash (a
documented bound). Every vector is then encoded as a sum of one codeword from
each book by beam search, and the norm of that sum is stored. A query's squared
distance to a code is its norm less twice the sum of looked-up inner products
(the query's own norm is the same for all). The ``SHORTLIST`` best codes of each
query are ranked again by exact distance on the original vectors.

The index is dealt into lanes of about ``LANE`` codes by the hash of the vector, so
their number follows the index, and queries into slices of about ``SLICE``. A task gets one
lane's codes, then one slice's queries, which it scores ``BLOCK`` at a time, and
passes on each query's best codes of the lane as one row; a query's rows are merged
one after another. So memory depends on neither table. Equal vectors are indexed
once and keep their k + 1 smallest ids, which no answer of k neighbours can
exceed, so a vector that a third of the rows share is one code. They are told
apart by a 64-bit hash.

Cases: null, zero, null-holding and non-finite vectors take no part, nor do those
of another length than the most frequent one. Rows that repeat an id and vector
count once; of different vectors under one id the nearest counts. Fewer than k
candidates: all of them. Ties go to the smaller id. Extra columns are ignored,
whatever their names. An empty table or no queries: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.storage import settle

BOOKS = 24
CODES = 256
BEAM = 4
SAMPLE = 8192
ROUNDS = 12
SHORTLIST = 400
BLOCK = 256
CHUNK = 256
LANE = 8192
SLICE = 16384


def _nearest(x: np.ndarray, words: np.ndarray, n: int = 1) -> np.ndarray:
    gap = (words * words).sum(axis=1)[None, :] - 2 * x @ words.T
    return gap.argmin(axis=1)[:, None] if n == 1 else np.argpartition(gap, min(n, gap.shape[1]) - 1, axis=1)[:, :n]


def train_codebooks(x: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """books x codes x dimension, by k-means on residuals."""
    random = np.random.default_rng(11)
    codes = max(1, min(codes, len(x)))
    out, rest = np.zeros((books, codes, x.shape[1]), np.float32), x.astype(np.float32)
    for m in range(books):
        words = rest[random.choice(len(rest), codes, replace=False)].copy()
        for _ in range(rounds):
            at = _nearest(rest, words)[:, 0]
            size = np.bincount(at, minlength=codes)
            total = np.zeros_like(words)
            np.add.at(total, at, rest)
            words = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None].astype(np.float32), words)
        out[m] = words
        rest = rest - words[_nearest(rest, words)[:, 0]]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8) and squared norms of the decoded vectors, by beam search over the books."""
    n, dim = x.shape
    rest = x[:, None, :].astype(np.float32)
    path = np.zeros((n, 1, 0), np.uint8)
    for words in books:
        width = rest.shape[1]
        gap = (words * words).sum(axis=1) - 2 * rest.reshape(-1, dim) @ words.T
        gap = (gap.reshape(n, width, -1) + (rest * rest).sum(axis=2)[:, :, None]).reshape(n, -1)
        keep = min(beam, gap.shape[1])
        best = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
        came, code = best // len(words), best % len(words)
        rest = np.take_along_axis(rest, came[:, :, None], axis=1) - words[code]
        path = np.concatenate((np.take_along_axis(path, came[:, :, None], axis=1), code[:, :, None].astype(np.uint8)), axis=2)
    win = (rest * rest).sum(axis=2).argmin(axis=1)
    line = np.arange(n)
    decoded = x - rest[line, win]
    return path[line, win], (decoded * decoded).sum(axis=1)


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), float)


def search(vectors: DataFrame, is_query: Column, k: int = 10, shortlist: int = SHORTLIST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest other rows."""
    v = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))) & F.exists("x", lambda a: a != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    size = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    v = v.where(F.size("x") == size["d"]).distinct()
    place = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    members = v.select("vec_id", "x").withColumn("place", place).where(F.col("place") <= k + 1)
    classes = settle(members.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.xxhash64("x")))
    queries = settle(v.where("q").select("vec_id", "x"))
    n_queries = queries.count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = classes.select("cls", "x").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).toPandas().sort_values("cls")
    books = train_codebooks(_matrix(sample["x"]))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    lanes, slices = -(-classes.count() // LANE), -(-n_queries // SLICE)

    def index(batches):
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                some = pdf.iloc[at : at + CHUNK]
                codes, norms = encode(_matrix(some["x"]), shared.value)
                yield pd.DataFrame({"id": some["cls"], "data": [c.tobytes() for c in codes], "norm": norms})

    def deal(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["vec_id"], "data": [x.tobytes() for x in _matrix(pdf["x"]).astype("<f4")]})

    some = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    codes = settle(classes.select("cls", "x").mapInPandas(index, "id long, data binary, norm double"))
    codes = codes.select(some(lanes).alias("lane"), every(slices).alias("slice"), F.lit(0).alias("kind"), "id", "data", "norm")
    asked = queries.mapInPandas(deal, "id long, data binary")
    asked = asked.select(every(lanes).alias("lane"), some(slices).alias("slice"), F.lit(1).alias("kind"), "id", "data", F.lit(0.0).alias("norm"))

    def score(batches):
        books, place, held, ready = shared.value, None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["lane", "slice", "kind"], sort=True):
                if place != key[:2]:
                    place, held, ready = key[:2], [], None
                if key[2] == 0:
                    held.append((part["id"].to_numpy(), np.frombuffer(b"".join(part["data"]), np.uint8).reshape(len(part), -1), part["norm"].to_numpy(np.float32)))
                    continue
                if ready is None:
                    ready, held = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [], []
                if not len(ready):  # a lane without codes
                    continue
                ids, codes, norms = ready
                keep = min(shortlist, len(ids))
                for at in range(0, len(part), BLOCK):
                    block = part.iloc[at : at + BLOCK]
                    q = np.frombuffer(b"".join(block["data"]), "<f4").reshape(len(block), -1)
                    gap = np.broadcast_to(norms, (len(q), len(norms))).copy()
                    for m, words in enumerate(books):
                        gap -= (2 * q @ words.T)[:, codes[:, m]]
                    top = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
                    yield pd.DataFrame({"query_id": block["id"], "cls": [ids[t].tobytes() for t in top], "gap": [g[t].tobytes() for g, t in zip(gap, top, strict=True)]})

    def merge(batches):
        last, cls, gap = None, None, None
        for pdf in batches:
            out = []
            for query, c, g in zip(pdf["query_id"], pdf["cls"], pdf["gap"], strict=True):
                c, g = np.frombuffer(c, "<i8"), np.frombuffer(g, "<f4")
                if query == last:
                    c, g = np.concatenate((cls, c)), np.concatenate((gap, g))
                elif last is not None:
                    out.append((last, cls))
                best = np.argsort(g, kind="stable")[:shortlist]
                last, cls, gap = query, c[best], g[best]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "cls"])
        if last is not None:
            yield pd.DataFrame([(last, cls)], columns=["query_id", "cls"])

    met = codes.unionByName(asked).repartition("lane", "slice").sortWithinPartitions("lane", "slice", "kind")
    found = met.mapInPandas(score, "query_id long, cls binary, gap binary")
    found = found.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merge, "query_id long, cls array<long>")
    near = found.select("query_id", F.explode("cls").alias("cls"))

    def rank_again(batches):
        for pdf in batches:
            gap = _matrix(pdf["x"]) - _matrix(pdf["y"])
            yield pd.DataFrame({"query_id": pdf["query_id"], "ids": pdf["ids"], "score": np.sqrt((gap * gap).sum(axis=1))})

    pairs = near.join(classes, "cls").join(queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("y")), "query_id")
    exact = pairs.select("query_id", "ids", "x", "y").mapInPandas(rank_again, "query_id long, ids array<long>, score double")
    named = exact.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
