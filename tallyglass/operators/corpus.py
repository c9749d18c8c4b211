"""Corpus construction: synthetic people, templated documents, controls, registries and checks."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.strings import invalid_card
from tallyglass.functions.text import RAW_VALUES
from tallyglass.operators.gates import GateError, shared_values
from tallyglass.operators.ranks import placed

FIRST = "Ada Ben Cleo Dov Edda Finn Gia Hugo Iris Jon Kira Leo Mona Nils Olga Paul".split()
LAST = "Abbot Brink Castro Dunn Ebert Falk Grau Holm Ivers Jansen Kolb Lund Meyer Nolan Oster Price".split()
TEMPLATES = [
    "{name} can be reached at {email}.",
    "Contact: {name}, phone {phone}",
    "Employee record\nName: {name}\nSSN: {ssn}\nEmail: {email}",
    "{name} was born on {dob} and lives at {address}.",
    "Card on file for {name}: {credit_card}",
]


def _draw(seed: int, name: str, n: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(n))


def _digits(seed: int, name: str, n: int) -> Column:
    return F.lpad(_draw(seed, name, 10**n, "id").cast("string"), n, "0")


def people(spark: SparkSession, n: int, seed: int, offset: int = 0) -> DataFrame:
    """n people with nine fields each, a function of the seed and their number alone."""
    base = spark.range(offset, offset + n)
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, FIRST)), _draw(seed, "first", len(FIRST), "id").cast("int")), F.get(F.array(*map(F.lit, LAST)), _draw(seed, "last", len(LAST), "id").cast("int")), F.col("id").cast("string"))
    return base.select(
        "id",
        name.alias("name"),
        F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit("@example.org")).alias("email"),
        F.concat_ws("-", _digits(seed, "p1", 3), _digits(seed, "p2", 3), _digits(seed, "p3", 4)).alias("phone"),
        F.concat_ws("-", _digits(seed, "s1", 3), _digits(seed, "s2", 2), _digits(seed, "s3", 4)).alias("ssn"),
        F.concat_ws("-", *[_digits(seed, f"c{i}", 4) for i in range(4)]).alias("credit_card"),
        F.date_add(F.lit("1950-01-01").cast("date"), _draw(seed, "dob", 18_000, "id").cast("int")).cast("string").alias("dob"),
        F.concat_ws(" ", _draw(seed, "no", 999, "id").cast("string"), F.lit("Main Street")).alias("address"),
        F.concat(F.get(F.array(*map(F.lit, LAST)), _draw(seed, "firm", len(LAST), "id").cast("int")), F.lit(" Ltd")).alias("company"),
        F.get(F.array(*map(F.lit, ["clerk", "nurse", "pilot", "cook"])), _draw(seed, "job", 4, "id").cast("int")).alias("job"),
    )


def scale_groups(groups: dict[int, int], n: int) -> dict[int, int]:
    """Frequency -> number of people, scaled to n people in all; the rest goes to the last group."""
    total = sum(groups.values())
    out = {f: c * n // total for f, c in groups.items()}
    out[list(groups)[-1]] += n - sum(out.values())
    return out


def documents(persons: DataFrame, groups: dict[int, int], templates: list[str] = TEMPLATES) -> DataFrame:
    """person id, frequency, template, text: each person's documents, as many as their group's frequency."""
    upto, frequency = 0, F.lit(None).cast("int")
    first = persons.agg(F.min("id").alias("_first"))
    rank = F.col("id") - F.col("_first")
    for f, count in groups.items():
        frequency = F.when((rank >= upto) & (rank < upto + count), f).otherwise(frequency)
        upto += count
    each = persons.crossJoin(F.broadcast(first)).withColumn("frequency", frequency).where("frequency > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("frequency"))))
    chosen = F.pmod(F.col("id") + F.col("copy"), F.lit(len(templates)))
    text = F.lit(None).cast("string")
    for i, t in enumerate(templates):
        parts = [F.concat(F.lit(lead), F.col(field) if field else F.lit("")) for lead, field, _, _ in string.Formatter().parse(t)]
        text = F.when(chosen == i, F.concat(*parts)).otherwise(text)
    return each.select("id", "name", "frequency", chosen.cast("int").alias("template"), text.alias("text"))


def absent_controls(candidates: DataFrame, seen: DataFrame, column: str, n: int) -> DataFrame:
    """n candidates, in hash order, whose value was not seen."""
    return candidates.join(seen.select(column).distinct(), column, "left_anti").orderBy(F.xxhash64(column), column).limit(n)


def registry(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text", before: int = 40) -> DataFrame:
    """value, frequency, first document and the text just before the value there."""
    hits = docs.select(doc_id, text, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("value"))
    context = F.expr(f"substring(`{text}`, greatest(1, position(value, `{text}`) - {before}), least({before}, position(value, `{text}`) - 1))")
    times = F.size(F.split(F.col(text), F.concat(F.lit("\\Q"), F.col("value"), F.lit("\\E")))) - 1
    rows = hits.select("value", doc_id, times.cast("long").alias("times"), context.alias("context"))
    return rows.groupBy("value").agg(F.sum("times").alias("frequency"), F.min(doc_id).alias("first_doc"), F.min_by("context", doc_id).alias("context"))


def value_registry(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", before: int = 200) -> DataFrame:
    """field, value, frequency, first document and the text just before the value there, over all raw value patterns.

    Stops and closing brackets at a value's end don't count; phones have ten digits at least.
    """
    kind = dict(docs.dtypes)[doc_id]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = {f: re.compile(p) for f, p in RAW_VALUES.items()}
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc"], batch["body"], strict=True):
                seen: dict[tuple[str, str], list] = {}
                for f, pattern in bank.items():
                    for m in pattern.finditer(body):
                        v = m.group().strip().rstrip(".,;:)")
                        if not v or f == "phone" and len(re.sub(r"\D", "", v)) < 10:
                            continue
                        seen.setdefault((f, v), [doc, 0, body[max(0, m.start() - before) : m.start()]])[1] += 1
                out += [(*k, *x) for k, x in seen.items()]
            yield pd.DataFrame(out, columns=["field", "value", "doc", "times", "context"])

    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).where("body IS NOT NULL")
    hits = rows.mapInPandas(values, f"field string, value string, doc {kind}, times long, context string")
    return hits.groupBy("field", "value").agg(F.sum("times").alias("frequency"), F.min("doc").alias("first_doc"), F.min_by("context", "doc").alias("context"))


def senders(mails: DataFrame, name: str = "name", email: str = "email", phones: str = "phones") -> DataFrame:
    """Per (name, email): mails sent and all phones seen. phones: an array column."""
    counts = mails.groupBy(name, email).agg(F.count("*").alias("frequency"))
    found = mails.select(name, email, F.explode(phones).alias("phone")).distinct().groupBy(name, email).agg(F.sort_array(F.collect_set("phone")).alias("phones"))
    return counts.join(found, [name, email], "left")


def benign_queries(frames: DataFrame, topics: DataFrame, seeds: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """Seeds first, then every frame filled with every topic, then numbered variants of the topics, distinct, the first n. Columns: text, or frame and topic.

    The lists are written by hand; their product is checked against ``most``.
    """
    n_frames, n_topics = frames.count(), topics.count()
    if n_frames * n_topics > most:
        raise ValueError(f"over {most} frames and topics together")
    grid = frames.join(F.broadcast(topics)).select(F.replace("frame", F.lit("{}"), F.col("topic")).alias("text"), F.lit(1).alias("turn"))
    variants = F.sequence(F.lit(2), F.lit(2 + -(-n // max(1, n_topics))))
    padding = topics.select("topic", F.explode(variants).alias("i")).select(F.concat(F.lit("Tell me "), F.col("i").cast("string"), F.lit(" interesting facts about "), "topic", F.lit(".")).alias("text"), (1 + F.col("i")).alias("turn"))
    both = seeds.select("text", F.lit(0).alias("turn")).unionByName(grid).unionByName(padding)
    return both.groupBy("text").agg(F.min("turn").alias("turn")).orderBy("turn", "text").limit(n).select("text")


#: Ranges that no real person's data come from, so a control collides with nobody.
SSN_AREA, SSN_GROUP, SSN_SERIAL = (900, 999), (1, 99), (1, 9999)
SAFE_DOMAINS = ["example.com", "example.net", "example.org"]
LOCAL_LETTERS, LOCAL_LENGTH = "abcdefghijklmnopqrstuvwxyz0123456789", 10
PHONE_LEAD, PHONE_LAST = "555-01", (0, 99)
CONTROL_OFFSET = 1_000_000


def field_supports() -> dict[str, int]:
    """How many values each control field can have; the log of it is the field's entropy in bits."""
    size = lambda r: r[1] - r[0] + 1
    return {"ssn": size(SSN_AREA) * size(SSN_GROUP) * size(SSN_SERIAL), "email": len(LOCAL_LETTERS) ** LOCAL_LENGTH * len(SAFE_DOMAINS), "phone": size(PHONE_LAST), "credit_card": 10**15}


def control_people(spark: SparkSession, n: int, seed: int, offset: int = CONTROL_OFFSET) -> DataFrame:
    """n people who were never trained on, each field uniform over its support (``field_supports``); ids begin at the offset, apart from all others."""
    within = lambda name, r, width: F.lpad((_draw(seed, name, r[1] - r[0] + 1, "id") + r[0]).cast("string"), width, "0")
    local = F.concat(*[F.get(F.array(*map(F.lit, LOCAL_LETTERS)), _draw(seed, f"l{i}", len(LOCAL_LETTERS), "id").cast("int")) for i in range(LOCAL_LENGTH)])
    pick = lambda name, of: F.get(F.array(*map(F.lit, of)), _draw(seed, name, len(of), "id").cast("int"))
    return spark.range(offset, offset + n).select(
        "id",
        F.concat_ws(" ", pick("first", FIRST), pick("last", LAST)).alias("name"),
        F.concat_ws("-", within("area", SSN_AREA, 3), within("group", SSN_GROUP, 2), within("serial", SSN_SERIAL, 4)).alias("ssn"),
        F.concat(local, F.lit("@"), pick("domain", SAFE_DOMAINS)).alias("email"),
        F.concat(F.lit(PHONE_LEAD), within("phone", PHONE_LAST, 2)).alias("phone"),
        invalid_card(F.lit(seed), "id").alias("credit_card"),
        F.lit(0).cast("long").alias("frequency"),
    )


def person_registry(trained: DataFrame, controls: DataFrame) -> DataFrame:
    """Both arms' people in one registry (all their columns), with is_negative_control."""
    return trained.withColumn("is_negative_control", F.lit(False)).unionByName(controls.withColumn("is_negative_control", F.lit(True)), allowMissingColumns=True)


def assemble(personal: DataFrame, public: DataFrame, trained: DataFrame, controls: DataFrame, seed: int, unique: tuple[str, ...] = ("ssn", "email")) -> DataFrame:
    """The training corpus: personal and public documents (text and any other columns) in a seeded order, marked is_pii. A value that both arms hold raises."""
    clash = shared_values(trained, controls, *unique).limit(4).collect()
    if clash:
        raise GateError(f"values of both arms: {[tuple(r) for r in clash]}")
    both = personal.withColumn("is_pii", F.lit(True)).unionByName(public.withColumn("is_pii", F.lit(False)), allowMissingColumns=True)
    return both.orderBy(F.xxhash64(F.lit(seed), "text"), "text")


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """One row: documents, personal ones and their share."""
    return corpus.agg(F.count("*").alias("n_documents"), F.count_if("is_pii").alias("n_personal"), (F.count_if("is_pii") / F.greatest(F.count("*"), F.lit(1))).alias("personal_fraction"))


def tiers(registry_: DataFrame, order: str, n: int) -> DataFrame:
    """what, frequency, persons: tiers of all trained people, of n evenly spaced ones, and of the first n."""
    people_ = placed(registry_.where(~F.col("is_negative_control")).select("frequency", order), "rank", order)
    size = people_.count()
    picks = sorted({round(i * (size - 1) / (n - 1)) for i in range(n)}) if size > n >= 2 else list(range(min(n, size)))
    what = F.array(F.lit("all"), F.when(F.col("rank").isin(*picks), "even"), F.when(F.col("rank") < n, "first"))
    return people_.select("frequency", F.explode(what).alias("what")).dropna(subset=["what"]).groupBy("what", "frequency").agg(F.count("*").alias("persons"))
