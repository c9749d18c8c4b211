"""Regressions and filters on Spark ML, and small closed-form fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import special
from tallyglass.operators.ranks import average_rank, correlation, kept, quantiles
from tallyglass.operators.rates import r9


def passes(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows without nulls and only what a regression reads, kept: each of its iterations is a pass over them, not over the source."""
    return kept(df.select(*dict.fromkeys([*features, label])).dropna())


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label])).select("features", F.col(label).cast("double").alias("label"))


def logit(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """term, coefficient, std_error, p of a binomial regression."""
    fitted = GeneralizedLinearRegression(family="binomial", link="logit").fit(assembled(passes(df, features, label), features, label))
    s = fitted.summary
    rows = zip([*features, "intercept"], [*fitted.coefficients.toArray().tolist(), fitted.intercept], s.coefficientStandardErrors, s.pValues, strict=True)
    return df.sparkSession.createDataFrame([(n, float(c), float(e), float(p)) for n, c, e, p in rows], "term string, coefficient double, std_error double, p double")


def _deviances(df: DataFrame, features: list[str], label: str, weight: str) -> tuple[float, float]:
    """Residual and null deviance of a binomial regression of weighted rows; for single outcomes these are -2 log likelihood."""
    x = VectorAssembler(inputCols=features, outputCol="features").transform(df).select("features", F.col(label).cast("double").alias("label"), weight)
    s = GeneralizedLinearRegression(family="binomial", link="logit", weightCol=weight).fit(x).summary
    return float(s.deviance), float(s.nullDeviance)


def explained(df: DataFrame, base: list[str], features: list[str], label: str) -> DataFrame:
    """model, pseudo_r2 (McFadden's) and gain over the base: the base terms alone, with all features, and with each feature by itself. Constant outcomes raise.

    Equal rows are counted once, in the only pass over the source; each fit reads distinct rows with weights.
    """
    some = df.select(*dict.fromkeys([*base, *features, label])).dropna()
    counts = kept(some.groupBy(*some.columns).agg(F.count("*").alias("_n")))
    if counts.select(label).distinct().limit(2).count() < 2:
        raise ValueError("the outcome doesn't vary")
    most = counts.agg(F.max("_n")).first()[0]
    # shares of deviance do not depend on the weights' scale; weights up to 1 start a fit near even odds, counts would start it at the outcomes themselves
    whole = kept(counts.withColumn("_w", F.col("_n") / F.lit(float(most))))
    r2 = lambda d: 1 - d[0] / d[1]
    first = r2(_deviances(whole, base, label, "_w"))
    rows = [("base", first, 0.0)]
    for name, more in [("all", features), *[(f, [f]) for f in features]]:
        found = r2(_deviances(whole, [*base, *more], label, "_w"))
        rows.append((name, found, found - first))
    return df.sparkSession.createDataFrame(rows, "model string, pseudo_r2 double, gain double")


MOST_PROBES = 100  # each is a term of the regression


def frequency_response(att: DataFrame, reference: str) -> DataFrame:
    """term, coefficient, std_error, p of hits by log(1 + frequency), probe and their product; the intercept is the floor of the reference probe at frequency 0, whose share is the row ``floor``."""
    probes = [r[0] for r in att.select("probe").dropna().distinct().limit(MOST_PROBES + 1).collect()]
    if len(probes) > MOST_PROBES:
        raise ValueError(f"over {MOST_PROBES} probes")
    others = sorted(p for p in probes if p != reference)
    x = att.select(F.coalesce("exact_match", F.lit(False)).cast("double").alias("hit"), F.log1p(F.col("train_frequency").cast("double")).alias("log_frequency"), "probe").dropna()
    for i, name in enumerate(others):
        x = x.withColumn(f"p{i}", (F.col("probe") == name).cast("double")).withColumn(f"x{i}", F.col(f"p{i}") * F.col("log_frequency"))
    terms = {"log_frequency": "log_frequency"} | {f"p{i}": f"probe {n}" for i, n in enumerate(others)} | {f"x{i}": f"log_frequency:probe {n}" for i, n in enumerate(others)}
    fitted = logit(x, list(terms), "hit")
    names = F.create_map(*[F.lit(v) for pair in terms.items() for v in pair])
    out = fitted.select(F.coalesce(names[F.col("term")], F.col("term")).alias("term"), "coefficient", "std_error", "p")
    floor = out.where("term = 'intercept'").select(F.lit("floor").alias("term"), (1 / (1 + F.exp(-F.col("coefficient")))).alias("coefficient"), F.lit(None).cast("double").alias("std_error"), F.lit(None).cast("double").alias("p"))
    return out.unionByName(floor)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """kind, n, r, p of Pearson's and Spearman's correlation; r and p are null for under three rows or a constant side."""
    some = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    found = average_rank(average_rank(some, "x", name="rx"), "y", name="ry").agg(F.count("*").alias("n"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman")).first()
    rows = []
    for kind in ("pearson", "spearman"):
        r, n = found[kind], found["n"]
        known = r is not None and r == r and n > 2
        p = None if not known else 0.0 if abs(r) >= 1 else special.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((kind, n, float(r) if known else None, p))
    return df.sparkSession.createDataFrame(rows, "kind string, n long, r double, p double")


def top_terms(fitted: DataFrame, n: int) -> DataFrame:
    """The n terms of largest coefficient, whatever their sign, without the intercept; ties by name."""
    return fitted.where("term <> 'intercept'").orderBy(F.desc(F.abs("coefficient")), "term").limit(n)


def forest_filter(df: DataFrame, held_out: DataFrame, features: list[str], label: str, trees: int = 50) -> DataFrame:
    """name, value: the recall and false positive rate of a random forest on rows it has not seen, and each feature's importance."""
    ready = lambda d: VectorAssembler(inputCols=features, outputCol="features").transform(d.dropna(subset=[*features, label])).select("features", F.col(label).cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, seed=7).fit(ready(df))
    share = lambda y: F.avg(F.when(F.col("label") == y, F.col("prediction")))
    found = model.transform(ready(held_out)).agg(share(1).alias("recall"), share(0).alias("false_positive_rate")).first()
    rows = [("recall", found["recall"]), ("false_positive_rate", found["false_positive_rate"]), *[(f"importance {f}", float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]]
    return df.sparkSession.createDataFrame([(n, None if v is None else float(v)) for n, v in rows], "name string, value double")


def cross_validated_filter(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """fold, precision, recall, f1, false_positive_rate of a logistic filter; folds are dealt by the hash of class and key, so each class is spread over all."""
    fold = F.pmod(F.xxhash64(label, key), F.lit(folds))
    data = df.dropna(subset=[*features, label]).withColumn("fold", fold)
    data = VectorAssembler(inputCols=features, outputCol="raw").transform(data).select("fold", "raw", F.col(label).cast("double").alias("label")).persist()
    out = []
    for k in range(folds):
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data.where(F.col("fold") != k))
        model = LogisticRegression(maxIter=50).fit(scaler.transform(data.where(F.col("fold") != k)))
        hit = model.transform(scaler.transform(data.where(F.col("fold") == k)))
        n = lambda p, y: F.count_if((F.col("prediction") == p) & (F.col("label") == y))
        tp, fp, fn, tn = hit.agg(n(1, 1), n(1, 0), n(0, 1), n(0, 0)).first()
        precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        out.append((k, precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0, fp / (fp + tn) if fp + tn else 0.0))
    data.unpersist()
    return df.sparkSession.createDataFrame(out, "fold int, precision double, recall double, f1 double, false_positive_rate double")


def threshold_filter(df: DataFrame, score: str, positive: str, fpr: float) -> DataFrame:
    """The (1 - fpr) quantile of finite negative scores, and the shares strictly above it."""
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    negatives = finite.where(~F.col(positive)).select(F.lit("all").alias("group"), F.col(score).cast("double").alias("score"))
    cut = quantiles(negatives, "group", "score", {"cut": 1 - fpr}).select("cut")
    above = F.col(score) > F.col("cut")
    share = lambda p: r9(F.avg(F.when(F.col(positive) == p, above.cast("double"))))
    return finite.crossJoin(F.broadcast(cut)).agg(r9(F.first("cut")).alias("cut"), share(True).alias("recall"), share(False).alias("fpr"))


def isotonic(y: list[float], w: list[float]) -> list[float]:
    """Pool adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total if total else (a[0] + b[0]) / 2, total, a[2] + b[2]])
    return [p[0] for p in pools for _ in range(int(p[2]))]


def two_way_anova(df: DataFrame, a: str, b: str, value: str) -> dict[str, float]:
    """Type II tests of both factors and their interaction, from cell counts, sums and sums of squares."""
    cells = df.groupBy(a, b).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) ** 2).alias("q")).dropna().orderBy(a, b).collect()
    n, m = np.array([c["n"] for c in cells], float), np.array([float(c["m"]) for c in cells])
    within = sum(float(c["q"]) for c in cells) - (n * m * m).sum()
    dummies = lambda k: np.array([[float(c[k] == x) for x in sorted({c[k] for c in cells})[1:]] for c in cells]).reshape(len(cells), -1)
    x, y, one = dummies(a), dummies(b), np.ones((len(cells), 1))

    def rss(*parts):
        d = np.hstack(parts) * np.sqrt(n)[:, None]
        t = m * np.sqrt(n)
        return float(((t - d @ np.linalg.lstsq(d, t, rcond=None)[0]) ** 2).sum())

    main = rss(one, x, y)
    df_e = n.sum() - len(cells)
    out = {}
    for name, ss, k in ((a, rss(one, y) - main, x.shape[1]), (b, rss(one, x) - main, y.shape[1]), ("interaction", main, len(cells) - 1 - x.shape[1] - y.shape[1])):
        f = ss / k / (within / df_e) if k > 0 and within > 0 and df_e > 0 else math.nan
        out |= {f"{name}_ss": ss, f"{name}_f": f, f"{name}_p": special.f_upper(f, k, df_e) if f == f else math.nan}
    return out
