"""Which of many values each text holds: texts stream through automata over slices of the values.

Values are dealt into slices of about ``SLICE_CHARS`` characters by their hash. A slice is all that the driver and a
task hold: its automaton (Aho-Corasick) reads each text once and meets all its values, of any length and at any place,
so neither values nor texts are cut into words, and the work is the texts' length for each slice. Nothing is shuffled but the pairs that are found.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.ranks import kept

SLICE_CHARS = 2_000_000


def slices_of(values: DataFrame, value: str, slice_chars: int = SLICE_CHARS) -> tuple[DataFrame, int]:
    """Distinct values with their slice, and how many slices there are."""
    distinct = values.select(F.col(value).alias("_value")).where("_value <> ''").distinct()
    total = distinct.agg(F.sum(F.length("_value"))).first()[0] or 0
    n = -(-int(total) // slice_chars)
    return distinct.withColumn("_slice", F.pmod(F.xxhash64("_value"), F.lit(max(1, n)))), n


def found_values(texts: DataFrame, key: str, text: str, values: DataFrame, value: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """key, value: each distinct value that a text holds as a substring, once for each row of ``texts``. Null and empty values occur nowhere."""
    distinct, n = slices_of(values, value, slice_chars)
    kind = dict(texts.dtypes)[key]
    schema = f"`{key}` {kind}, `{value}` string"
    rows = texts.select(F.col(key), F.col(text).alias("_text"))  # a filter on what was computed would compute it twice
    if n == 0:
        return rows.limit(0).select(key, F.col("_text").alias(value))
    if n > 1:  # they are read once for each slice
        rows, distinct = kept(rows), kept(distinct)
    out = None
    for i in range(n):
        shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in distinct.where(F.col("_slice") == i).select("_value").collect()])  # of bounded size
        part = rows.mapInArrow(_scan(shared, key, value), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(shared, key: str, value: str):
    def run(batches):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        words = shared.value
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            rows, met = [], []
            for row, cell in enumerate(batch.column("_text")):  # one text at a time is a string
                text = cell.as_py()
                if words and text:
                    held = {i for _, i in automaton.iter(text)}
                    rows += [row] * len(held)
                    met += [words[i] for i in held]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(met, pa.string())], [key, value])

    return run


def other_held(texts: DataFrame, key: str, text: str, group: str, own: str, values: DataFrame, value: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The keys of the texts that hold a value of their group that isn't among their ``own`` (an array). A text is read up to the first such value of a slice.

    ``values``: group, value. A text of null group or null key is never among them.
    """
    distinct, n = slices_of(values, value, slice_chars)
    groups = values.where(F.col(value) != "").groupBy(F.col(value).alias("_value")).agg(F.collect_set(group).alias("_groups"))  # as many as there are fields
    rows = texts.select(F.col(key), F.col(text).alias("_text"), F.col(group).alias("_group"), F.col(own).alias("_own"))
    if n == 0:
        return rows.limit(0).select(key)
    listed = distinct.join(groups, "_value")
    if n > 1:
        rows, listed = kept(rows), kept(listed)
    out = None
    for i in range(n):
        shared = texts.sparkSession.sparkContext.broadcast([(r[0], frozenset(r[1])) for r in listed.where(F.col("_slice") == i).select("_value", "_groups").collect()])  # of bounded size
        part = rows.mapInArrow(_scan_others(shared, key), f"`{key}` {dict(texts.dtypes)[key]}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scan_others(shared, key: str):
    def run(batches):
        automaton, held = ahocorasick.Automaton(ahocorasick.STORE_INTS), shared.value
        for i, (word, _) in enumerate(held):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            columns = ((x.as_py() for x in batch.column(c)) for c in ("_text", "_group", "_own"))
            met = [row for row, (text, group, own) in enumerate(zip(*columns, strict=True)) if held and text and any(group in held[i][1] and held[i][0] not in (own or ()) for _, i in automaton.iter(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(met, pa.int64()))], [key])

    return run


def held_by(values: DataFrame, texts: DataFrame, value_id: str, text_id: str, value: str = "value", text: str = "body", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Pairs (value_id, text_id) where the text holds the value; rows that repeat a pair give it once."""
    v = values.select(F.col(value_id), F.col(value).alias("_v"))
    met = found_values(texts, text_id, text, v, "_v", slice_chars)
    return met.join(v, "_v").select(value_id, text_id).distinct()
