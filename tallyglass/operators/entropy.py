"""Exact min-entropy of generated values, and how many of them one output can hold.

A bound of the form multiplicity * prompts * 2**-entropy holds only for an entropy that isn't too large and a
multiplicity that isn't too small. So the entropy comes from the largest probability itself, by enumeration with
colliding values merged, and the multiplicity from the vocabulary's longest run of digits.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyglass.operators.gates import GateError
from tallyglass.operators.rates import r9

#: A generator's social security numbers; the area that is remapped, and to which.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS, SSN_REMAPPED = 899, 99, 9999, {666: 667}
#: Shapes of a local part; # is a digit, ? a letter.
LOCAL_PARTS = ("{last}.{first}", "{first}.{last}", "{first}##", "?{last}")
TYPICAL_DIGITS = 4
NINE_DIGITS = 9


@F.pandas_udf(StringType())
def _plain_letters(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def _letters(c: Column) -> Column:
    """ASCII letters, digits, blanks, dots, hyphens and underscores of a text in lower case, accents dropped; pieces may be joined afterwards."""
    plain = F.regexp_like(c, F.lit(r"^\p{ASCII}*$"))
    ascii_text = F.when(plain, c).otherwise(_plain_letters(F.when(~plain, c)))
    return F.regexp_replace(F.lower(ascii_text), r"[^a-z0-9_.\s-]", "")


def _joined(c: Column) -> Column:
    """The ends trimmed, blanks and hyphens within as one hyphen."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[\s-]+", "-")


def canonical(c: Column) -> Column:
    """The form in which values are compared: two names that give the same one can't be told apart."""
    return _joined(_letters(c))


def weights(rows: DataFrame, name: str, weight: str | None = None) -> DataFrame:
    """name, p: the probability of each distinct letter form of a weighted list (counts where there is no weight). Null names and weights that aren't above 0 are left out."""
    each = rows.select(_letters(F.col(name).cast("string")).alias("name"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).where("name IS NOT NULL AND w > 0")
    sums = each.groupBy("name").agg(F.sum("w").alias("w"))
    return sums.join(F.broadcast(sums.agg(F.sum("w").alias("all"))), F.lit(True)).select("name", (F.col("w") / F.col("all")).alias("p"))  # one row


def local_masses(first: DataFrame, last: DataFrame, shapes: tuple[str, ...] = LOCAL_PARTS) -> DataFrame:
    """key, mass, values: each distinct shape of a local part, the probability of one of its values, and how many values it stands for.

    ``first`` and ``last``: name, p. Every shape has the same share. Placeholders of digits and letters are uniform, so a
    shape's values are equally probable and only one, with 0 and a, is enumerated. Names are merged by letter form before the
    product, which is spread over the first names; equal keys are summed after it.
    """
    parts = []
    for shape in shapes:
        used = [n for n in ("first", "last") if "{" + n + "}" in shape]
        if not used or any(shape.count("{" + n + "}") > 1 for n in ("first", "last")) or "{" in shape.replace("{first}", "").replace("{last}", ""):
            raise GateError(f"a shape holds each name once at most, and one at least: {shape}")
        digits, letters = shape.count("#"), shape.count("?")
        lists = {"first": first, "last": last}
        rows = lists[used[0]].select(F.col("name").alias(used[0]), "p")
        if len(used) == 2:
            listed = lists[used[1]].agg(F.collect_list(F.struct("name", "p")).alias("others"))  # a list of names, in one row
            rows = rows.join(F.broadcast(listed), F.lit(True)).select(used[0], "p", F.explode("others").alias("o")).select(used[0], F.col("o.name").alias(used[1]), (F.col("p") * F.col("o.p")).alias("p"))
        text = F.lit(shape.replace("#", "0").replace("?", "a"))
        for n in used:
            text = F.replace(text, F.lit("{" + n + "}"), F.col(n))
        parts.append(rows.select(_joined(text).alias("key"), (F.col("p") / (len(shapes) * 10.0**digits * 26.0**letters)).alias("mass"), F.lit(10.0**digits * 26.0**letters).alias("values")))
    each = reduce(DataFrame.unionByName, parts)
    return each.groupBy("key").agg(F.sum("mass").alias("mass"), F.max("values").alias("values"), F.sum(F.col("mass") * F.col("values")).alias("share"))


def email_entropy(masses: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: total (the probability of all enumerated values), p_max, modal, support (shapes of addresses), h_inf_bits and h_max_bits (log2 of the support, no entropy)."""
    local = masses.agg(r9(F.sum("share")).alias("total"), F.max("mass").alias("p_local"), F.min_by("key", F.struct(-F.round("mass", 15), "key")).alias("modal"), F.count("*").alias("n"))
    at = domains.agg(F.max("p").alias("p_domain"), F.count("*").alias("n_domains"))
    p = F.col("p_local") * F.col("p_domain")
    support = F.col("n") * F.col("n_domains")
    return local.crossJoin(F.broadcast(at)).select("total", r9(p).alias("p_max"), "modal", support.alias("support"), r9(-F.log2(p)).alias("h_inf_bits"), r9(F.log2(support.cast("double"))).alias("h_max_bits"))  # a row each


def ssn_entropy(spark: SparkSession) -> DataFrame:
    """p_max, support, h_inf_bits of uniform areas of which some are remapped, groups and serials."""
    area = reduce(lambda c, m: F.when(F.col("id") == m[0], m[1]).otherwise(c), SSN_REMAPPED.items(), F.col("id"))
    counts = spark.range(1, SSN_AREAS + 1).groupBy(area.alias("area")).agg(F.count("*").alias("n"))
    p = F.max("n") / F.lit(float(SSN_AREAS)) / SSN_GROUPS / SSN_SERIALS
    return counts.agg(p.alias("p_max"), (F.count("*") * (SSN_GROUPS * SSN_SERIALS)).alias("support"), (-F.log2(p)).alias("h_inf_bits"))


def needed_bits(prompts: Column, tolerance: float, m: int = 1) -> Column:
    """Entropy that keeps a search of so many prompts, blind to the target, below the tolerance."""
    return F.log2(prompts * (m / tolerance))


def most_prompts(bits: Column, tolerance: float, m: int = 1) -> Column:
    """The same solved for the prompts."""
    return F.pow(F.lit(2.0), bits) * (tolerance / m)


def most_fluency(bits: Column, tolerance: float, m: int = 1) -> Column:
    """Bits that all of a prompt may cost if fluency alone is to keep it below the tolerance."""
    return bits - F.log2(F.lit(m / tolerance))


def digit_runs(tokens: DataFrame, *by: str, typical: int = TYPICAL_DIGITS) -> DataFrame:
    """by, tokens of digits alone, the most digits of one (1 where there is none), and those of more than ``typical`` digits, with the longest first. ``tokens``: by, text."""
    digits = F.trim("text")
    own = tokens.withColumn("d", F.when(F.regexp_like(digits, F.lit(r"(?U)^\d+$")), digits)).withColumn("n", F.length("d"))
    long = F.when(F.col("n") > typical, F.struct((-F.col("n")).alias("order"), F.col("d").alias("d")))
    found = own.groupBy(*by).agg(F.count("d").alias("digit_tokens"), F.coalesce(F.max("n"), F.lit(1)).alias("most_digits"), F.count_if(F.col("n") > typical).alias("long_tokens"), F.array_sort(F.collect_set(long)).alias("long"))
    return found.select(*by, "digit_tokens", "most_digits", "long_tokens", F.transform(F.slice("long", 1, 8), lambda s: s.d).alias("longest"))


def multiplicity(most_digits: Column, tokens: Column, digits: int = NINE_DIGITS) -> Column:
    """At how many places an output of so many tokens can hold a number of that many digits, whatever the separators."""
    return F.greatest(F.lit(1).cast("long"), (most_digits * tokens - digits + 1).cast("long"))
