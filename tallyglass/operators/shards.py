"""Gates on attempt shards, frozen targets and logs: each rule gives the number of violations, and any raises through gates.require."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.strings import is_hex_digest
from tallyglass.operators.gates import GateError, shared_values
from tallyglass.operators.ranks import kept, numbered, placed
from tallyglass.operators.rates import r9

KEY = ("target_membership", "person_id", "field")


def grouped_violations(df: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """by, rule, violations: ``rules`` are aggregates that count violations of a group; one pass."""
    counts = df.groupBy(*by).agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"r{i}") for i, c in enumerate(rules.values())])
    long = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return counts.select(*by, F.explode(long).alias("v")).select(*by, "v.*")


def shard_rules(rows: int, persons: int, fields: list[str], constants: dict[str, Column]) -> dict[str, Column]:
    """What a shard of one seed and capacity must hold. constants: column -> the value each row must have, an expression."""
    arm = F.col("target_membership")
    off = lambda found, wanted: (found != wanted).cast("long")
    rules = {"rows": off(F.count("*"), rows), "null outcomes": F.count_if(F.col("exact_match").isNull()), "null keys": F.count_if(F.greatest(*[F.col(k).isNull() for k in KEY]))}
    rules |= {f"{name} is constant": F.count_if(~F.coalesce(F.col(name) == value, F.lit(False))) for name, value in constants.items()}
    rules["duplicate targets"] = F.count("*") - F.countDistinct(*KEY)
    for side in ("trained", "control"):
        rules[f"{side} persons"] = off(F.countDistinct(F.when(arm == side, F.col("person_id"))), persons)
        rules |= {f"{side} {f}": off(F.count_if((arm == side) & (F.col("field") == f)), persons) for f in fields}
    rules["other fields"] = F.count_if(~F.col("field").isin(*fields))
    rules["controls were trained on"] = F.count_if((arm == "control") & (F.col("train_frequency") != 0))
    return rules


def shard_gate(att: DataFrame, rows: int, persons: int, fields: list[str], constants: dict[str, Column]) -> DataFrame:
    """seed, capacity_k, rule, violations of every shard."""
    return grouped_violations(att, ["seed", "capacity_k"], shard_rules(rows, persons, fields, constants))


def against_frozen(att: DataFrame, targets: DataFrame) -> DataFrame:
    """rule, violations of attempts against the frozen targets (KEY, train_frequency, sha256 of the target string): missing and extra targets, other frequencies and strings."""
    seen = att.groupBy(*KEY).agg(F.min("train_frequency").alias("least"), F.max("train_frequency").alias("most"), F.min(F.sha2("target_string", 256)).alias("first"), F.max(F.sha2("target_string", 256)).alias("last"), F.lit(True).alias("seen"))
    met = targets.withColumn("frozen", F.lit(True)).join(seen, list(KEY), "full")
    both = F.col("seen") & F.col("frozen")
    rules = {
        "missing": F.count_if(F.col("seen").isNull()),
        "extra": F.count_if(F.col("frozen").isNull()),
        "frequency": F.count_if(both & ~((F.col("least") == F.col("train_frequency")) & (F.col("most") == F.col("train_frequency")))),
        "target string": F.count_if(both & ~((F.col("first") == F.col("sha256")) & (F.col("last") == F.col("sha256")))),
    }
    return grouped_violations(met.withColumn("all", F.lit(1)), ["all"], rules).drop("all")


def tier_counts(targets: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """frequency, persons, quota of the trained persons against the quotas."""
    have = targets.where("target_membership = 'trained'").groupBy(F.col("train_frequency").cast("int").alias("frequency")).agg(F.countDistinct("person_id").alias("persons"))
    want = targets.sparkSession.createDataFrame(list(quotas.items()), "frequency int, quota int")
    return have.join(want, "frequency", "full").select("frequency", F.coalesce("persons", F.lit(0)).alias("persons"), F.coalesce("quota", F.lit(0)).alias("quota"))


SPREAD = 500_000


def spread(df: DataFrame, by: str) -> DataFrame:
    """df, kept, in partitions of at most about ``SPREAD`` rows by a column, however few files it lies in."""
    return kept(df.repartition(max(1, -(-df.count() // SPREAD)), by))


def target_contract(targets: DataFrame, fields: list[str], quotas: dict[int, int], features: list[str], most_smd: float = 0.1) -> DataFrame:
    """rule, violations of a frozen target table (pair_index, KEY, train_frequency, value_sha256, formatted_sha256, exposed, features).

    Pairs are numbered from 0 without gaps and hold one person of each arm, arms are disjoint, persons have every
    field once, controls weren't trained on, hashes are hashes, exactly the trained targets are exposed, tiers meet
    their quotas, and features are balanced between the arms within ``most_smd``.
    """
    arm, trained = F.col("target_membership"), F.col("target_membership") == "trained"
    hexed = is_hex_digest(F.col("value_sha256"), 64) & is_hex_digest(F.col("formatted_sha256"), 64)
    smd = lambda f: F.abs(F.try_divide(F.avg(F.when(trained, F.col(f))) - F.avg(F.when(~trained, F.col(f))), F.sqrt((F.var_samp(F.when(trained, F.col(f))) + F.var_samp(F.when(~trained, F.col(f)))) / 2)))
    targets = spread(targets.select("pair_index", *KEY, "train_frequency", "exposed", hexed.alias("hexed"), *features), "person_id")
    rules = {
        "other fields": F.count_if(~F.col("field").isin(*fields)),
        "controls were trained on": F.count_if((arm == "control") & (F.col("train_frequency") != 0)),
        "hashes": F.count_if(~F.col("hexed")),
        "exposure": F.count_if(F.col("exposed") != trained),
    } | {f"{f} is balanced": (F.coalesce(smd(f), F.lit(0.0)) > most_smd).cast("long") for f in features}
    out = grouped_violations(targets.withColumn("all", F.lit(1)), ["all"], rules).drop("all")
    # each distinct count is a count of groups, which are found where their rows lie
    each = targets.groupBy(*KEY).agg(F.count("*").alias("n"))
    lacking = F.greatest(*[F.col(k).isNull() for k in KEY])
    twice = each.agg(F.coalesce(F.sum("n") - F.count_if(~lacking), F.lit(0)).alias("violations")).select(F.lit("duplicate targets").alias("rule"), "violations")
    people = targets.select("pair_index", "target_membership", "person_id").distinct()
    sides = people.groupBy("pair_index").agg(F.count(F.when(trained, F.col("person_id"))).alias("d"), F.count(F.when(~trained, F.col("person_id"))).alias("c"))
    pairs = sides.agg(F.coalesce(F.max("pair_index") + 1 - F.count("pair_index"), F.lit(0)).alias("gaps")).crossJoin(F.broadcast(targets.agg(F.count_if(F.col("pair_index") < 0).alias("below"))))  # a row each
    pairs = pairs.select(F.lit("pair numbers").alias("rule"), (F.col("gaps") + F.col("below")).cast("long").alias("violations"))
    missing = each.groupBy("target_membership", "person_id").agg(F.count("field").alias("n"))
    out = out.unionByName(pairs).unionByName(twice)
    clash = shared_values(targets.where(trained), targets.where(~trained), "person_id")
    one = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    out = out.unionByName(one(sides.where("d <> 1 OR c <> 1"), "one person of each arm")).unionByName(one(missing.where(F.col("n") != len(fields)), "every field"))
    return out.unionByName(one(clash, "arms are disjoint")).unionByName(one(tier_counts(targets, quotas).where("persons <> quota"), "tier quotas"))


RANGE = 65_536


def _lines(rows: DataFrame, columns: list[str], order: list[str] | None) -> DataFrame:
    """key, line: each row's order and its JSON array of ``columns``, compared as text; nulls are JSON nulls and come first."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    key = F.concat_ws("\x00", *[F.when(text(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("\x01"), text(c))) for c in order or columns])
    return rows.select(key.alias("key"), F.to_json(F.array(*[text(c) for c in columns]), {"ignoreNullFields": "false"}).alias("line"))


def whole_digest(rows: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """n and sha256 of the JSON array of all rows, of any number, in the order of ``order`` (all columns).

    One digest has one state, so its lines pass through one task, sorted there with spilling and read batch by batch; texts should be hashed before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, digest = 0, hashlib.sha256(b"[")
        for batch in batches:
            for line in batch.column("line"):
                digest.update((b"," if n else b"") + line.as_py().encode())
                n += 1
        digest.update(b"]")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sha256": pa.array([digest.hexdigest()], pa.string())})

    found = _lines(rows, columns, order).repartition(1).sortWithinPartitions("key", "line").select("line").mapInArrow(run, "n long, sha256 string")
    return found.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("sha256"), F.sha2(F.lit("[]"), 256)).alias("sha256"))


def table_digest(rows: DataFrame, columns: list[str], order: list[str] | None = None, size: int = RANGE) -> DataFrame:
    """n and sha256 of a table's rows, however they lie in files and partitions.

    Rows are JSON arrays of ``columns``, in the order of ``order`` (all columns), compared as text. Up to ``size`` rows have the digest of the JSON array
    of all rows. More are cut into ranges of ``size`` rows; the digests of ranges are digested in turn, so a task holds one range at most and a million
    ranges make sixteen. Nulls are JSON nulls and come first; equal rows all count.
    """
    level = placed(_lines(rows, columns, order), "at", "key", "line").select("at", "line")
    total = level.count()
    left = total
    while True:
        listed = level.groupBy(F.floor(F.col("at") / size).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("all"))
        level = listed.select("at", F.sha2(F.concat(F.lit("["), F.array_join("all.line", ","), F.lit("]")), 256).alias("line"))
        if left <= size:
            break
        left = -(-left // size)
        level = level.withColumn("line", F.concat(F.lit('"'), "line", F.lit('"')))
    digest = level.agg(F.first("line").alias("d"))
    return digest.select(F.lit(total).alias("n"), F.coalesce("d", F.sha2(F.lit("[]"), 256)).alias("sha256"))


def target_digests(targets: DataFrame) -> DataFrame:
    """what, n, sha256 of the frozen targets (pair_index, KEY, value_sha256): of all target values, and of the pairs in their order."""
    values = table_digest(targets, [*KEY, "value_sha256"]).select(F.lit("target values").alias("what"), "n", "sha256")
    person = lambda arm: F.max(F.when(F.col("target_membership") == arm, F.col("person_id").cast("string")))
    pairs = targets.groupBy("pair_index").agg(person("trained").alias("trained"), person("control").alias("control")).withColumn("place", F.lpad(F.col("pair_index").cast("string"), 12, "0"))
    return values.unionByName(table_digest(pairs, ["trained", "control"], ["place"]).select(F.lit("pairs").alias("what"), "n", "sha256"))


def log_report(att: DataFrame, states: list[str], probes: list[str], required: list[str], recommended: dict[str, str], most_gap: float = 0.1) -> DataFrame:
    """level (error or warning), rule, n of a log; no rows for a sound one.

    Errors: required columns that are missing, unknown model states and arms, controls that were trained on.
    Warnings: recommended columns that are missing or all null (and what they disable), unknown probes, and cells
    (model, state, probe, capacity) in which the arms' median budgets differ by over ``most_gap`` of the larger.
    """
    spark, have = att.sparkSession, set(att.columns)
    missing = [("error", f"missing {c}", 1) for c in required if c not in have] + [("warning", f"missing {c}: disables {why}", 1) for c, why in recommended.items() if c not in have]
    out = spark.createDataFrame(missing, "level string, rule string, n long")
    if any(level == "error" for level, _, _ in missing):
        return out
    unknown = lambda c, known: F.count_if(~F.coalesce(F.col(c).isin(*known), F.lit(False)))
    checks = {
        ("error", "unknown model_state"): unknown("model_state", states),
        ("error", "unknown target_membership"): unknown("target_membership", ["trained", "control"]),
        ("error", "controls were trained on"): F.count_if((F.col("target_membership") == "control") & (F.col("train_frequency") != 0)),
        ("warning", "unknown probe"): unknown("probe", probes),
    } | {("warning", f"{c} is all null: disables {why}"): ((F.count("*") > 0) & (F.count(c) == 0)).cast("long") for c, why in recommended.items() if c in have}
    found = grouped_violations(att.withColumn("all", F.lit(1)), ["all"], {"|".join(k): v for k, v in checks.items()})
    found = found.where("violations > 0").select(F.split_part("rule", F.lit("|"), F.lit(1)).alias("level"), F.split_part("rule", F.lit("|"), F.lit(2)).alias("rule"), F.col("violations").alias("n"))
    out = out.unionByName(found)
    if "forward_passes" in have:
        n = budget_gaps(att).where(F.col("gap") > most_gap).agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(n.select(F.lit("warning").alias("level"), F.lit("budgets of the arms differ").alias("rule"), "n"))
    return out


def budget_gaps(att: DataFrame, *by: str) -> DataFrame:
    """by, gap: how far the arms' median forward passes are apart, as a share of the larger; only cells with both arms."""
    by = by or ("model_name", "model_state", "probe", "capacity_k")
    med = lambda arm: F.percentile(F.when(F.col("target_membership") == arm, F.col("forward_passes")), F.lit(0.5))
    cells = att.groupBy(*by).agg(med("trained").alias("d"), med("control").alias("c")).where("d IS NOT NULL AND c IS NOT NULL")
    return cells.select(*by, r9(F.abs(F.col("d") - F.col("c")) / F.greatest("d", "c", F.lit(1.0))).alias("gap"))


def require_formal(reps: int, seed: int, formal_reps: int = 10_000, formal_seed: int = 20240601) -> None:
    """A run whose intervals decide has exactly the registered replicates and seed."""
    if (reps, seed) != (formal_reps, formal_seed):
        raise GateError(f"{formal_reps} replicates with seed {formal_seed} are registered, not {reps} with {seed}")


def even_places(df: DataFrame, stratum: str, key: str, quotas: dict[int, int]) -> DataFrame:
    """Of each stratum its quota of rows, evenly spaced in the order of the key (distinct), first and last included. Raises where a stratum is short."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.countDistinct(key)).where(F.col(stratum).isin(*quotas)).collect()}
    short = {s: (sizes.get(s, 0), n) for s, n in quotas.items() if sizes.get(s, 0) < n}
    if short:
        raise GateError(f"strata with too few rows (rows, quota): {short}")
    places = {s: sorted({round(i * (sizes[s] - 1) / (n - 1)) for i in range(n)} if n > 1 else {0}) for s, n in quotas.items() if n > 0}
    odd = [s for s, p in places.items() if len(p) != quotas[s]]
    if odd:
        raise GateError(f"strata without evenly spaced rows: {odd}")
    chosen = df.sparkSession.createDataFrame([(s, p) for s, each in places.items() for p in each], f"`{stratum}` {dict(df.dtypes)[stratum]}, place int")
    ranked = numbered(df, key, "place", stratum)
    return ranked.join(F.broadcast(chosen), [stratum, "place"], "left_semi").drop("place")
