"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades; ordered
thresholds t_0 < t_1 < ... part the score s into grades,
P(grade <= k) = sigmoid(t_k - s). The score is the sum of a text's feature
weights over all its words, divided by the root of the number of words.
Features of a word: the word, its first four and last three bytes, whether it
repeats the word before, whether it is in capitals, and its count of symbols.
Before the fit, features are scaled by how differently often they occur in
documents of the highest grade and in others; those in too few documents
(``RARE``) are left out, as they would only be learned by heart.

The model is fitted on the driver on at most ``SAMPLE`` rated documents, those of
least hash of their id, and of these on as many as have ``MOST`` features of their whole
texts together (documented bounds of what reaches the driver). Every document is
scored, whole. The broadcast model has ``1 << BITS`` weights whatever the corpus.

Cases: a null or empty text has no features and score 0. Ratings that are null
don't count. Where no document has a rating, or all have the same, the model
has zero weights and every document gets the same probabilities. Of repeated
ratings of a document the lowest counts, and of rows that repeat an id one is learned
from, the least text; each row is scored. Scores that tie get the same grades. Texts may
be of any length. Extra columns are ignored, whatever their names; select keeps them.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textspans as S
from tallyglass.llm.storage import discard, settle

BITS = 18
SAMPLE = 12_000
MOST = 6_000_000
RARE = 0.003  # of the sample's documents, and at least 3
DAMPING = 0.5
LEAST = 0.65
N_KINDS = 6
ABSENT = 0  # this feature's weight stays zero

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = _ALNUM.copy()
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words x kinds) of all words, and the first word of each text (one entry more)."""
    codes, starts, ends, first = S.words(texts)
    raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    size = ends - starts
    whole = S.span_hashes(codes, starts, ends)
    count = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    within = lambda total: total[ends] - total[starts]
    capitals = within(count((raw >= 65) & (raw <= 90)))
    symbols = within(count(~_PLAIN[raw]))
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[first[:-1][first[:-1] < len(starts)]] = False
    kinds = [
        whole,
        S.span_hashes(codes, starts, np.minimum(starts + 4, ends)),
        S.span_hashes(codes, np.maximum(ends - 3, starts), ends),
        again.astype(np.uint64),
        ((capitals >= 2) & (capitals * 2 >= size)).astype(np.uint64),
        np.minimum(symbols, 4).astype(np.uint64),
    ]
    table = np.empty((len(starts), N_KINDS), np.int32)
    for k, h in enumerate(kinds):
        table[:, k] = (S.mix64(h * np.uint64(N_KINDS) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32)
        table[h == 0, k] = ABSENT
    return table, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int] = field(default_factory=list)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) for each grade, a column each."""
        upto = _sigmoid(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.hstack((np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1)))), axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for a, b in S.chunks(texts):
            table, first = features(texts[a:b])
            total = np.concatenate(([0.0], np.cumsum(self.weights[table].sum(axis=1))))
            out.append((total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first)) ** DAMPING)
        return np.concatenate([np.zeros(0), *out])


def slopes(y: np.ndarray, scores: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log likelihood: of each row by its score, and of all rows by the thresholds. y: places of the grades."""
    edges = np.concatenate(([-np.inf], cut, [np.inf]))
    high, low = _sigmoid(edges[y + 1] - scores), _sigmoid(edges[y] - scores)
    p = np.maximum(high - low, 1e-12)
    by_cut = np.bincount(y, high * (1 - high) / p, len(cut) + 1)[:-1] - np.bincount(y, low * (1 - low) / p, len(cut) + 1)[1:]
    return high + low - 1, by_cut


def fit(index: np.ndarray, value: np.ndarray, counts: np.ndarray, ratings: np.ndarray, epochs: int = 20, steps: int = 40, rate: float = 0.5, decay: float = 1e-4) -> OrdinalModel:
    """AdaGrad on the log likelihood with at least ``steps`` minibatches an epoch; rows are sparse: ``counts`` entries each of index and value."""
    grades = sorted(set(ratings.tolist()))
    weights = np.zeros(1 << BITS)
    if len(grades) < 2:
        return OrdinalModel(weights, np.zeros(0), grades or [0])
    y = np.searchsorted(grades, ratings)
    share = np.cumsum([np.mean(y == k) for k in range(len(grades))])[:-1]
    cut = np.log(share / (1 - share))
    starts = np.cumsum(counts) - counts
    batch = min(256, max(8, len(y) // steps))
    random = np.random.default_rng(7)
    seen, seen_cut = np.full(1 << BITS, 1e-6), np.full(len(cut), 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for some in np.split(order, range(batch, len(order), batch)):
            at, line = S.ragged(starts[some], counts[some]), np.repeat(np.arange(len(some)), counts[some])
            x, of = value[at], index[at]
            s = np.bincount(line, weights[of] * x, len(some))
            by_score, g_cut = slopes(y[some], s, cut)
            touched, back = np.unique(of, return_inverse=True)
            g = np.bincount(back, by_score[line] * x) / len(some) - decay * weights[touched]
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            g_cut /= len(some)
            seen_cut += g_cut * g_cut
            cut = np.maximum.accumulate(cut + rate * g_cut / np.sqrt(seen_cut) + 1e-9 * np.arange(len(cut)))
    return OrdinalModel(weights, cut, grades)


def scales(index: np.ndarray, counts: np.ndarray, ratings: np.ndarray) -> np.ndarray:
    """The size of the log ratio of each feature's document shares at the highest grade and below; 0 for rare features."""
    best = ratings == ratings.max()
    line = np.repeat(best, counts)
    high, low = (np.bincount(index[line == side], minlength=1 << BITS) for side in (True, False))
    ratio = np.log((high + 1) / (best.sum() + 1)) - np.log((low + 1) / ((~best).sum() + 1))
    ratio[(high + low < max(3, RARE * len(ratings)))] = 0
    ratio[ABSENT] = 0
    return np.abs(ratio)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """ratings: doc_id, rating (int)."""
    rated = ratings.where("doc_id IS NOT NULL AND rating IS NOT NULL").groupBy("doc_id").agg(F.min("rating").alias("rating"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "doc_id")
    held = held.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("rating").alias("rating"))

    def run(batches):
        for pdf in batches:
            rows, texts = [], pdf["text"].tolist()
            for a, b in S.chunks(texts):
                table, first = features(texts[a:b])
                for i in range(b - a):
                    n = first[i + 1] - first[i]
                    index, times = np.unique(table[first[i] : first[i + 1]], return_counts=True)
                    rows.append((index.astype("<i4").tobytes(), (times / max(1, n) ** DAMPING).astype("<f4").tobytes()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "rating": pdf["rating"], "index": [r[0] for r in rows], "value": [r[1] for r in rows]})

    made = settle(held.mapInPandas(run, "doc_id long, rating int, index binary, value binary"))
    sizes = made.select("doc_id", F.octet_length("index").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    sizes = sizes[sizes["size"].cumsum() <= 4 * MOST].sort_values("doc_id")
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sizes["doc_id"].tolist()], "doc_id long")
    counts = sizes["size"].to_numpy(int) // 4
    index, value = np.empty(counts.sum(), np.int32), np.empty(counts.sum(), np.float32)
    rated, at = np.empty(len(counts), int), 0
    # one partition at a time, straight into the arrays that the fit reads
    for i, row in enumerate(made.join(F.broadcast(wanted), "doc_id").orderBy("doc_id").toLocalIterator()):
        index[at : at + counts[i]] = np.frombuffer(row["index"], "<i4")
        value[at : at + counts[i]] = np.frombuffer(row["value"], "<f4")
        rated[i], at = row["rating"], at + counts[i]
    discard(made)
    if len(set(rated.tolist())) < 2:
        return fit(index, value, counts, rated)
    scale = scales(index, counts, rated).astype(np.float32)
    value *= scale[index]
    model = fit(index, value, counts, rated)
    model.weights = (model.weights * scale).astype(np.float32)
    return model


def score(docs: DataFrame, model: OrdinalModel, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (of the highest grade) and accepted (tail of at least ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            s = m.scores(batch["text"].tolist())
            p = m.probabilities(s)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "expected_grade": p @ np.array(m.grades, float), "tail_probability": p[:, -1], "accepted": p[:, -1] >= least})

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(run, "doc_id long, score double, expected_grade double, tail_probability double, accepted boolean")


def select(docs: DataFrame, model: OrdinalModel, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is at least ``least``, with their columns; no join, so repeated rows stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array(m.probabilities(m.scores(texts))[:, -1] >= least))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, rating: one point for quality and one for not being toxic."""
    return labels.select("doc_id", ((F.col("quality") != 0).cast("int") + (F.col("toxic") == 0).cast("int")).alias("rating"))
