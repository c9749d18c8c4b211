"""Person-clustered bootstrap by counts: rows are never copied.

Attempts are first summed to (arm, person, k); blocks of these sums are multiplied
with packed counts of draws. Draws come from md5, so that any engine repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators import draws as blocks
from tallyglass.operators.ranks import kept
from tallyglass.operators.rates import r9


def draws(persons: DataFrame, reps: int, arm: str = "target_membership", person: str = "person_id") -> DataFrame:
    """rep, arm, person, w: in each replicate as many draws with replacement as the arm has persons."""
    at = kept(blocks.places(persons, arm, person))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch.itertuples(index=False):
                w = blocks.unpacked(packed.drawn)
                place, rep = np.nonzero(w)
                yield pd.DataFrame({"rep": rep + packed.chunk * blocks.CHUNK, arm: getattr(packed, arm), "place": place + packed.block * blocks.BLOCK, "w": w[place, rep]})

    counts = blocks.hash_counts(at, reps, blocks.CHUNK, arm).mapInPandas(rows, f"rep int, `{arm}` {dict(at.dtypes)[arm]}, place long, w long")
    return counts.join(at, [arm, "place"]).select("rep", arm, person, "w")


def drawn_rows(rows: DataFrame, index: str, values: list[str], reps: int, name: str) -> DataFrame:
    """rep, values, n: sums over rows drawn with replacement, and how many were drawn; ``index`` is distinct and gives their order."""
    sums, at = blocks.row_sums(rows, index, *values, name=name)
    parts = blocks.drawn_sums(sums, kept(at), ["cell"], [*values, "n"], reps, arm="arm", person=index, hashed=True)
    return blocks.by_replicate(parts, ["chunk"], [*values, "n"]).drop("chunk")


def replicates(att: DataFrame, reps: int, *by: str) -> DataFrame:
    """rep, arm, by..., rate of each replicate; only where an attempt was drawn."""
    return blocks.rate_replicates(att, reps, *by, at=kept(blocks.places(att)), hashed=True).where("rate IS NOT NULL")


def percentile_ci(reps: DataFrame, value: str, *by: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    q = lambda p: r9(F.percentile(value, F.lit(p)))
    return reps.groupBy(*by).agg(F.count(value).alias("reps"), q(tail).alias("lo"), q(1 - tail).alias("hi"))


def difference_replicates(r: DataFrame, *by: str) -> DataFrame:
    """rep, by.., d, c, tau: both arms of each replicate side by side."""
    one = lambda arm, name: r.where(F.col("target_membership") == arm).select("rep", *by, F.col("rate").alias(name))
    return one("trained", "d").join(one("control", "c"), ["rep", *by]).withColumn("tau", F.col("d") - F.col("c"))


def difference_of(r: DataFrame, *by: str) -> DataFrame:
    """Interval and p of trained - control, of replicates drawn independently in the arms."""
    both = difference_replicates(r, *by)
    tail = F.least(F.count_if(F.col("tau") <= 0), F.count_if(F.col("tau") >= 0))
    ci = percentile_ci(both, "tau", *by)
    p = both.groupBy(*by).agg(r9(F.least(F.lit(1.0), 2 * ratio(tail + 1, F.count("*") + 1))).alias("p"))
    return ci.join(p, list(by)) if by else ci.crossJoin(p)


def difference_ci(att: DataFrame, reps: int, *by: str) -> DataFrame:
    return difference_of(replicates(att, reps, *by), *by)
