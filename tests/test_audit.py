"""Gates, thresholds, nested records, text tools, corpora and verdicts on worked rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import features, strings
from tallyglass.functions.text import field_match
from tallyglass.operators import bounds, corpus, exposure, gates, models, nested, ranks, rates, shards, tables, verdicts
from tallyglass.operators.gates import GateError
from tallyglass.sources import files

KEYS = "target_membership string, person_id string, field string"


def attempts(spark, rows):
    return spark.createDataFrame(rows, "target_membership string, field string, final_target_nll double")


def test_thresholds_count_scores_at_the_cut_and_drop_nan(spark):
    rows = [("control", "f", float(x)) for x in (1, 2, 3, 4)] + [("trained", "f", float(x)) for x in (1, 1, 2, 9)]
    rows += [("control", "f", math.nan), ("trained", "f", math.nan), ("control", "f", None)]
    att = attempts(spark, rows)
    # Control scores are -4 .. -1; the 0.75 quantile, the next higher observation, is -1.
    r = ranks.tpr_at_fpr(att, 0.25).first()
    assert (r["cut"], r["tpr"], r["fpr"]) == (-1.0, 0.5, 0.25)
    r = ranks.tpr_at_realised_fpr(att, 0.5).first()
    assert (r["cut"], r["tpr"], r["realised_fpr"], r["least_fpr"]) == (-2.0, 0.75, 0.5, 0.25)
    r = ranks.tpr_at_realised_fpr(att, 0.1).first()
    assert (r["cut"], r["tpr"], r["realised_fpr"], r["least_fpr"]) == (None, None, None, 0.25)
    r = ranks.inversions(att).first()
    assert (r["n_d"], r["n_c"], r["inverted"], r["beaten"]) == (4, 4, 5, 2)
    assert ranks.auc(att).first()["auc"] == pytest.approx((3.5 * 2 + 2.5 + 0) / 16)


def test_places_and_totals_across_bands(spark):
    r = np.random.default_rng(4)
    values = np.unique(np.concatenate((r.normal(0, 1, 300), r.normal(0, 1e6, 300), [0.0, -1e-9])))
    df = spark.createDataFrame([(float(v), "g") for v in r.permutation(values)], "x double, g string")
    assert {row.x: row.i for row in ranks.numbered(df, "x", "i", "g").collect()} == {v: i for i, v in enumerate(sorted(values.tolist()))}
    names = [f"p{i}" for i in range(50)] + ["", "é", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert {row.x: row.i for row in ranks.numbered(df, "x", "i").collect()} == {n: i for i, n in enumerate(sorted(names))}


def test_missing_keys_and_null_are_different(spark):
    docs = [{"a": None, "c": {"d": 1, "e": 2}}, {"c": {"e": 2, "d": 1}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in docs], "manifest string")
    got = {r.path: tuple(r)[1:] for r in gates.invariants(df, ["a", "c", "c.d", "x"]).collect()}
    assert got == {"a": (2, 1, 1, False), "c": (1, 0, 0, True), "c.d": (1, 0, 0, True), "x": (1, 2, 0, False)}
    assert [r.path for r in gates.varying(df, ["a", "c"]).collect()] == ["a"]


def test_manifest_constants_and_config_hash(spark):
    from tallyglass.sources.files import manifest

    sound, bad = manifest({"k": [1, 2]}, [], gpu="A"), manifest({"k": [1]}, [], gpu="B") | {"config_sha256": "0"}
    df = spark.createDataFrame([(json.dumps(x),) for x in (sound, bad)], "manifest string")
    assert {r.path: r.violations for r in gates.constants(df, {"gpu": "A", "n_targets": 0, "config.k": [1, 2]}).collect()} == {"gpu": 1, "n_targets": 0, "config.k": 1}
    assert gates.stale_hashes(df).count() == 1 and gates.stale_hashes(df.limit(1)).count() == 0


def test_coordinates(spark):
    df = spark.createDataFrame([(json.dumps({"shard": {"seed": s, "capacity_k": k}}),) for s, k in ((1, 0), (1, 0), (1, 2), (2, 0))], "manifest string")
    assert {tuple(r) for r in gates.coordinates(df, [1], [0, 4]).collect()} == {(1, 0, "duplicate"), (1, 2, "extra"), (1, 4, "missing"), (2, 0, "extra")}


def test_levels_without_data(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "capacity_k int, y double")
    for points in (none, none.limit(0)):
        assert {(r.level, r.status, r.crossing_k) for r in rates.crossing(points, "y", [0.1, 0.5]).collect()} == {(0.1, "no_data", None), (0.5, "no_data", None)}


def shard_rows():
    return [(1, 4, arm, f"{arm}{i}", f, 5 if arm == "trained" else 0, "search", False) for arm in ("trained", "control") for i in range(3) for f in ("ssn", "email")]


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("rows", lambda r: r[:-1]),
        ("null outcomes", lambda r: [(*r[0][:7], None), *r[1:]]),
        ("duplicate targets", lambda r: [r[1], *r[1:]]),
        ("trained persons", lambda r: [(*r[0][:3], "new", *r[0][4:]), *r[1:]]),
        ("trained ssn", lambda r: [(*r[0][:4], "email", *r[0][5:]), *r[1:]]),
        ("other fields", lambda r: [(*r[0][:4], "dob", *r[0][5:]), *r[1:]]),
        ("controls were trained on", lambda r: [*r[:-1], (*r[-1][:5], 1, *r[-1][6:])]),
        ("probe is constant", lambda r: [*r[:-1], (*r[-1][:6], "fixed", r[-1][7])]),
    ],
)
def test_each_shard_rule_raises(spark, rule, change):
    schema = f"seed int, capacity_k int, {KEYS}, train_frequency long, probe string, exact_match boolean"
    gate = lambda rows: shards.shard_gate(spark.createDataFrame(rows, schema), 12, 3, ["ssn", "email"], {"probe": F.lit("search")})
    gates.require(gate(shard_rows()))
    with pytest.raises(GateError, match=f"'rule': '{rule}'"):
        gates.require(gate(change(shard_rows())).where(F.col("rule") == rule))


def target_rows():
    digest = "0123456789abcdef" * 4
    return [(i, arm, f"{arm}{i}", f, (1, 5, 5)[i] if arm == "trained" else 0, digest, digest, arm == "trained", float(i)) for i in range(3) for arm in ("trained", "control") for f in ("ssn", "email")]


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("pair numbers", lambda r: [(x[0] + (x[0] == 2), *x[1:]) for x in r]),
        ("duplicate targets", lambda r: [*r, r[0]]),
        ("every field", lambda r: r[1:]),
        ("other fields", lambda r: [(*r[0][:3], "dob", *r[0][4:]), *r[1:]]),
        ("controls were trained on", lambda r: [(*x[:4], 1 if x[1] == "control" else x[4], *x[5:]) for x in r]),
        ("hashes", lambda r: [(*r[0][:5], "abc", *r[0][6:]), *r[1:]]),
        ("exposure", lambda r: [(*r[0][:7], False, r[0][8]), *r[1:]]),
        ("balance is balanced", lambda r: [(*x[:8], x[8] + (x[1] == "control")) for x in r]),
        ("one person of each arm", lambda r: [(*x[:2], "other" if x[2] == "control1" and x[3] == "ssn" else x[2], *x[3:]) for x in r]),
        ("arms are disjoint", lambda r: [(*x[:2], f"p{x[0]}", *x[3:]) for x in r]),
        ("tier quotas", lambda r: [(*x[:4], 20 if x[4] == 1 else x[4], *x[5:]) for x in r]),
    ],
)
def test_each_target_rule_raises(spark, rule, change):
    schema = f"pair_index int, {KEYS}, train_frequency long, value_sha256 string, formatted_sha256 string, exposed boolean, balance double"
    gate = lambda rows: shards.target_contract(spark.createDataFrame(rows, schema), ["ssn", "email"], {1: 1, 5: 2}, ["balance"])
    gates.require(gate(target_rows()))
    with pytest.raises(GateError, match=rule):
        gates.require(gate(change(target_rows())).where(F.col("rule") == rule))


def test_subsets_logs_and_formal_runs(spark):
    df = spark.createDataFrame([(t, i) for t, n in ((1, 4), (5, 9)) for i in range(n)], "tier int, id int")
    assert sorted(tuple(r) for r in shards.even_places(df, "tier", "id", {1: 2, 5: 3}).collect()) == [(1, 0), (1, 3), (5, 0), (5, 4), (5, 8)]
    with pytest.raises(GateError, match="too few"):
        shards.even_places(df, "tier", "id", {1: 5})
    shards.require_formal(10_000, 20240601)
    with pytest.raises(GateError):
        shards.require_formal(200, 20240601)
    log = spark.createDataFrame([("base", "trained", 1, "fixed", None)], "model_state string, target_membership string, train_frequency long, probe string, note string")
    report = lambda **k: {(r.level, r.rule) for r in shards.log_report(log, **({"states": ["base"], "probes": ["fixed"], "required": ["probe"], "recommended": {}} | k)).collect()}
    assert report() == set()
    assert report(states=["x"], probes=[]) == {("error", "unknown model_state"), ("warning", "unknown probe")}
    assert report(required=["seed"]) == {("error", "missing seed")}
    assert report(recommended={"note": "reading", "seed": "seeds"}) == {("warning", "note is all null: disables reading"), ("warning", "missing seed: disables seeds")}


def test_nested_records(spark):
    people = spark.createDataFrame([("Ann", "123-45-6789", "a@x.org", ""), ("Bo", "987-65-4321", None, "1 Main Street")], "person_name string, ssn string, email string, address string")
    values = nested.person_values(people, ("ssn", "email", "address"))
    rows = [("Ann", 5, False, {"m": [("p", "no"), ("p", "it is 123 45 6789")]}), ("Bo", 0, True, {"m": [("p", "1  main street")], "n": [("p", None)]})]
    results = spark.createDataFrame(rows, "person_name string, frequency int, is_negative_control boolean, methods map<string, array<struct<prompt: string, response: string>>>")
    got = nested.with_person(nested.response_successes(results, values), results)
    assert {(r.person_name, r.field, r.hit) for r in got.collect()} == {("Ann", "ssn", True), ("Ann", "email", False), ("Bo", "ssn", False), ("Bo", "address", True)}
    head = nested.headline(got).first()
    assert (head.hits, head.fields, head.rate, head.record_rate, head.persons, head.control_rate) == (1, 2, 0.5, 0.0, 1, 0.5)
    attack = spark.createDataFrame([("Ann", {"ssn": ("123456789", False), "email": (None, True), "phone": ("x", True)})], "person_name string, field_results map<string, struct<generated_text: string, success: boolean>>")
    assert {(r.field, r.hit) for r in nested.attack_successes(attack, values).collect()} == {("ssn", True), ("email", True), ("phone", True)}
    two = [spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")]
    assert {tuple(r) for r in nested.first_match(two, "k").collect()} == {("a", 1), ("b", 3)}


def test_other_records_do_not_count_their_own_value(spark):
    values = spark.createDataFrame([("a", "ssn", "123-45-6789"), ("b", "ssn", "111-22-3333"), ("c", "ssn", "111223333")], "person string, field string, value string")
    gens = spark.createDataFrame([(1, "ssn", "a", "123456789"), (2, "ssn", "a", "x 111 22 3333"), (3, "ssn", "b", "111223333"), (4, "name", "a", "b")], "id int, field string, person string, generation string")
    assert {r.id: r.hit for r in nested.other_record_hits(gens, values, "id").collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r.id: r.hit for r in nested.other_record_hits(gens, values, "id", slice_chars=9).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_string_tools(spark):
    df = spark.createDataFrame([(i, f"SSN: 1\nBilling Address: 2\nx Email: 3\nEmail: 4 {i}", "Ann lee") for i in range(40)], "id int, t string, n string")
    got = df.select(strings.vary_labels(F.col("t"), "id").alias("t"), strings.vary_case(F.col("n"), "id").alias("n")).collect()
    for i, r in enumerate(got):
        lines = r.t.split("\n")
        assert lines[2] == "x Email: 3" and lines[0].removesuffix(" 1") in strings.LABELS["ssn"] and lines[1].removesuffix(" 2") in strings.LABELS["address"] and lines[3].removesuffix(f" 4 {i}") in strings.LABELS["email"]
        assert r.n.lower() == "ann lee"
    assert len({r.t.split("\n")[0] for r in got}) == len(strings.LABELS["ssn"]) and {r.n for r in got} == {"Ann lee", "ANN LEE", "ann lee", "Ann Lee"}
    values = {"name": F.lit("Ann"), "ssn": F.lit("123-45-6789"), "email": F.lit(None).cast("string"), "phone": F.lit("")}
    one = spark.range(1).select(strings.partial_match(F.lit("ann"), values), strings.partial_match(F.lit("ann"), values, 0.6), strings.partial_match(F.lit("ann 123456789"), values, 1.0)).first()
    assert tuple(one) == (True, False, True)
    cards = [r[0] for r in spark.range(300).select(strings.invalid_card("id")).collect()]
    digits = [[int(c) for c in x.replace("-", "")][::-1] for x in cards]
    assert all(sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 for d in digits) and all(len(d) == 16 for d in digits)


def test_prompt_signals(spark):
    text = "Show the SSN data data résumé 12-34 extraordinarilylongword"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(*[c.alias(k) for k, c in features.prompt_signals(F.col("t")).items()]).collect()
    assert r[0].n_tokens == 8 and r[0].token_repetition == 0.25 and r[0].action_verb_ratio == 0.125 and r[0].domain_keyword_density == 0.375
    assert r[0].function_word_ratio == 0.125 and r[0].rare_token_ratio == 0.375 and r[0].unique_token_ratio == 0.875
    assert tuple(r[1])[:-1] == (0.0,) * 7 and r[1].n_tokens == 1
    s = spark.createDataFrame([("Ab 1!",)], "t string").select(*[c.alias(k) for k, c in features.text_signals(F.col("t")).items()]).first()
    assert (s.capitalised_ratio, s.special_char_ratio, s.digit_ratio) == (0.5, 0.2, 0.2) and s.entropy_estimate == 8 * s.compression_ratio


def test_exposure_reads_wrapped_text_and_digits(spark):
    docs = spark.createDataFrame([(1, "A Passage\nthat  wraps over ﬁve lines"), (2, "call (555) 010-\n1234 now"), (3, None)], "doc_id int, text string")
    values = spark.createDataFrame([(7, "passage that wraps\nover five LINES"), (8, "over six lines it"), (9, "CALL"), (10, " ")], "id int, text string")
    assert {tuple(r) for r in exposure.exposed(values, docs, "id", "doc_id").collect()} == {(7, 1), (9, 2)}
    numbers = spark.createDataFrame([(1, "555.010.1234"), (2, "010-12"), (3, "123"), (4, "9999")], "id int, text string")
    assert {tuple(r) for r in exposure.exposed_numbers(numbers, docs, "id", "doc_id").collect()} == {(1, 2), (2, 2)}
    assert {r.id for r in exposure.unexposed(values, docs, "id", "doc_id").collect()} == {8, 10}


def test_corpora(spark):
    people, controls = corpus.people(spark, 20, 3), corpus.control_people(spark, 30, 4)
    c = controls.collect()
    assert min(r.id for r in c) == corpus.CONTROL_OFFSET and all(r.ssn.startswith("9") and r.frequency == 0 for r in c)
    assert gates.shared_values(people, controls, "ssn", "email").isEmpty()
    docs = corpus.documents(people, {1: 20})
    public = spark.createDataFrame([("a public text", "s")], "text string, source string")
    whole = corpus.assemble(docs, public, people, controls, 5)
    s = corpus.corpus_summary(whole).first()
    assert (s.n_documents, s.n_personal) == (21, 20) and whole.collect() == corpus.assemble(docs, public, people, controls, 5).collect()
    with pytest.raises(GateError, match="both arms"):
        corpus.assemble(docs, public, people, people, 5)
    registry = corpus.person_registry(people.withColumn("frequency", F.lit(5).cast("long")), controls)
    assert {(r.what, r.persons) for r in corpus.tiers(registry, "id", 4).collect()} == {("all", 20), ("even", 4), ("first", 4)}
    frames, topics, seeds = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for n, xs in (("frame", ["what is {}?"]), ("topic", ["tea", "ink"]), ("text", ["hello"])))
    assert [r.text for r in corpus.benign_queries(frames, topics, seeds, 5).collect()] == ["hello", "what is ink?", "what is tea?", "Tell me 2 interesting facts about ink.", "Tell me 2 interesting facts about tea."]


def test_provenance(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "d" / "b.txt").write_text("two")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = spark.createDataFrame([("a.txt", sha("one")), ("b.txt", sha("2")), ("c.txt", sha("3"))], "name string, sha256 string")
    assert {tuple(r) for r in files.verify_checksums(spark, f"{tmp_path}/d", expected).collect()} == {("b.txt", "modified"), ("c.txt", "missing")}
    chunks = spark.createDataFrame([("p", 1, bytearray(b"lo")), ("p", 0, bytearray(b"hel")), ("q", 0, bytearray(b"x"))], "name string, part int, content binary")
    whole = spark.createDataFrame([("p", 5, sha("hello")), ("q", 1, sha("y")), ("r", 0, sha(""))], "name string, bytes long, sha256 string")
    assert {tuple(r) for r in files.reassembled(chunks, whole).collect()} == {("p", True), ("q", False), ("r", False)}
    one, other = (files.manifest({"x": math.nan, "k": [1, 2]}, t, commit="c") for t in ([("a", "ssn"), ("b", "ssn")], [("b", "ssn"), ("a", "ssn")]))
    assert one == other and one["config"] == {"x": None, "k": [1, 2]} and one["n_targets"] == 2 and len(one["target_subset_hash"]) == 16
    files.publish(spark, {"a": "1"}, f"{tmp_path}/out")
    (tmp_path / "out").rename(tmp_path / "out.previous")  # a run that broke off between
    files.publish(spark, {"b": "2"}, f"{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["b"] and not (tmp_path / "out.previous").exists()
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert files.read_yaml(f"{tmp_path}/c.yaml") == {"a": [1, 2]}
    (tmp_path / "q.jsonl").write_text('{"text": "long enough"}\n{"text": " abc "}\nnot json\n')
    assert [r.text for r in files.read_queries(spark, f"{tmp_path}/q.jsonl").collect()] == ["long enough"]
    (tmp_path / "t.jsonl").write_text('{"text": "a", "content": "b"}\nplain\n')
    assert {r.text for r in files.read_documents(spark, f"{tmp_path}/t.jsonl").collect()} == {"a\nb", "plain"} and files.read_documents(spark, f"{tmp_path}/t.jsonl", 1).count() == 1
    passages = spark.createDataFrame([("s",), ("s",), ("filler",)], "source string")
    assert files.source_counts(passages, "filler", 0.5).count() == 2
    with pytest.raises(ValueError, match="filler"):
        files.source_counts(passages, "filler", 0.1)


def fixture(spark):
    """Known thresholds on the grid; the control floor rises with capacity and trained targets are hit a step earlier."""
    grid = [0, 1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64]
    rows = []
    for arm in ("trained", "control"):
        for person in range(25):
            for j, field in enumerate(("ssn", "email")):
                t = 2 * person + j
                at = max(0, min(12, 2 + t // 5) - (arm == "trained"))
                for k in grid:
                    hit = k > 0 and k >= grid[1:][at] and not (arm == "control" and t >= 46)
                    rows += [(arm, f"{arm}-{person:02d}", field, seed, k, hit) for seed in (1, 2, 3)]
    return spark.createDataFrame(rows, "target_membership string, person_id string, field string, seed int, capacity_k int, exact_match boolean"), grid


def test_verdicts_of_a_known_curve(spark):
    att, grid = fixture(spark)
    got = {r.name: r for r in verdicts.curve_verdicts(att, 200, grid, 20, {"H4": 0.001}).collect()}
    assert got["H1"].point == pytest.approx(1.0, abs=0.05) and got["H1"].verdict == "supported" and got["H1"].lo > 0
    assert got["H2"].p_holm == 1.0 and got["H4"].verdict == "rejected" and got["H4"].p_holm == 0.004
    assert got["H3"].lo <= got["H3"].point <= got["H3"].hi and got["H5"].p_holm is None
    with pytest.raises(ValueError, match="have a trend"):
        verdicts.curve_verdicts(att.withColumn("exact_match", F.lit(False)), 20, grid, 20)


def test_replicate_statistics(spark):
    weights = verdicts.quadratic_weights([0, 1, 2, 4, 8])
    y = {1: 0.1, 2: 0.5, 4: 0.4, 8: 0.7}
    assert sum(weights[k] * v for k, v in y.items()) == pytest.approx(np.polyfit(np.log(list(y)), list(y.values()), 2)[0])
    reps = spark.createDataFrame([(0, k, v) for k, v in y.items()] + [(1, k, 0.5) for k in y], "rep int, capacity_k int, rate double")
    assert {r.rep: r.rho for r in verdicts.rank_trend(reps).collect()} == {0: pytest.approx(0.8), 1: None}
    peak = {r.rep: (r.earliest, r.latest, r.ties) for r in verdicts.peaks(reps.withColumnRenamed("rate", "tau"), [1, 2, 4, 8]).collect()}
    assert peak == {0: (8, 8, 1), 1: (1, 8, 4)}
    assert {r.rep: r.k for r in verdicts.crossing_replicates(reps, [0.3]).collect()} == {0: pytest.approx(2**0.5), 1: None}
    draws = spark.createDataFrame([(float(x),) for x in (0.1, 0.2, 0.3, 0.6)], "x double")
    assert draws.agg(verdicts.centred_p(draws, "x", 0.25)).first()[0] == pytest.approx(2 / 5)


def test_models(spark):
    r = np.random.default_rng(2)
    x, z = r.normal(size=400), r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-2 * x))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, z, y, strict=True)], "x double, z double, y int")
    got = {m.model: m for m in models.explained(df, ["z"], ["x"], "y").collect()}
    assert got["all"].gain > 0.2 and got["base"].pseudo_r2 < 0.05 and got["x"].gain == pytest.approx(got["all"].gain)
    with pytest.raises(ValueError, match="vary"):
        models.explained(df.where("y = 1"), ["z"], ["x"], "y")
    c = {m.kind: m for m in models.correlations(df, "x", "z").collect()}
    assert c["pearson"].r == pytest.approx(np.corrcoef(x, z)[0, 1]) and 0 <= c["pearson"].p <= 1
    flat = {m.kind: (m.r, m.p) for m in models.correlations(df.withColumn("z", F.lit(1.0)), "x", "z").collect()}
    assert flat == {"pearson": (None, None), "spearman": (None, None)}
    f = {m.name: m.value for m in models.forest_filter(df, df, ["x", "z"], "y", trees=5).collect()}
    assert f["recall"] > 0.7 and f["importance x"] > f["importance z"]


def test_family_guess_and_tables(spark):
    k = np.array([1.0, 2, 4, 8, 16])
    n = np.full(5, 10_000.0)
    hits = 10_000 * bounds.family_rate("gumbel", np.log2(k), np.array([-2.0, 1.2, 0.8]))
    curve = spark.createDataFrame([(int(x), round(h), int(m)) for x, h, m in zip(k, hits, n, strict=True)], "capacity_k int, hits_c long, n_c long")
    best = bounds.fit_families(curve).first()
    assert best.family == "gumbel_log2k_ceiling" and best.parameters == pytest.approx([-2.0, 1.2, 0.8], abs=0.02) and best.deviance < 0.1
    df = spark.createDataFrame([("a", 1), ("b", 2)], "e string, x int")
    assert tables.preferred(df, F.col("e") == "a").count() == 1 and tables.preferred(df, F.col("e") == "z").count() == 2
    steps = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2), (4, None)], "k int, y double")
    assert tuple(tables.rises(steps, "k", "y").first()) == (False, 1)
    found = field_match(F.lit("name"), F.lit("x Ann  Lee"), F.lit("ann lee"))
    assert spark.range(1).select(found).first()[0]
