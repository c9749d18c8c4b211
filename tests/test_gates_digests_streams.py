import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import features, strings
from tallyglass.functions.registry import Registry
from tallyglass.operators import bounds, corpus, gates, ranks, rates, shards, verdicts
from tallyglass.sources import files
from tallyglass.streaming import running

SEEDS, GRID = [1, 2], [0, 4]
CELLS = {f"e3b__s{s}_k{k}": (s, k) for s in SEEDS for k in GRID}


def whole_folder(spark, at, cells=CELLS, rows=None, stated=None):
    for stem, (s, k) in cells.items():
        spark.createDataFrame([(s, k, "control", False)] * 3 if rows is None or stem not in rows else rows[stem], "seed int, capacity_k int, target_membership string, exact_match boolean").coalesce(1).write.parquet(str(at / "t" / stem))
        (at / "shards").mkdir(exist_ok=True)
        next((at / "t" / stem).glob("*.parquet")).rename(at / "shards" / f"{stem}.parquet")
        (at / "manifests").mkdir(exist_ok=True)
        s, k = (stated or {}).get(stem, (s, k))
        (at / "manifests" / f"{stem}.json").write_text(json.dumps({"shard": {"seed": s, "capacity_k": k}}, indent=1))
    return str(at / "shards"), str(at / "manifests")


def faults(spark, folders):
    return {tuple(r) for r in gates.whole_set(spark, *folders, SEEDS, GRID, "e3b__", "repro").collect()}


def test_a_whole_set_has_no_fault(spark, tmp_path):
    folders = whole_folder(spark, tmp_path)
    (tmp_path / "shards" / "other.parquet").write_bytes((tmp_path / "shards" / "e3b__s1_k0.parquet").read_bytes())  # not of the set
    assert faults(spark, folders) == set()
    gates.require(gates.whole_set(spark, *folders, SEEDS, GRID, "e3b__"))


def test_missing_extra_and_renamed_files(spark, tmp_path):
    folders = whole_folder(spark, tmp_path)
    shard = lambda n: tmp_path / "shards" / f"{n}.parquet"
    shard("e3b__s1_k4").rename(shard("e3b__s1_k40"))
    assert faults(spark, folders) == {("manifest without shard", "e3b__s1_k4", None), ("shard without manifest", "e3b__s1_k40", None)}
    shard("e3b__s1_k40").unlink()
    assert faults(spark, folders) == {("manifest without shard", "e3b__s1_k4", None), ("number of files", None, "3 shards of 4")}
    (tmp_path / "manifests" / "e3b__s1_k4.json").unlink()
    assert faults(spark, folders) == {("number of files", None, "3 shards of 4"), ("number of files", None, "3 manifests of 4"), ("missing coordinate", None, "seed 1, capacity 4")}
    for kind, end in (("shards", "parquet"), ("manifests", "json")):
        at = tmp_path / kind
        (at / f"e3b__repro.{end}").write_bytes((at / f"e3b__s1_k0.{end}").read_bytes())
    assert ("foreign file", "e3b__repro", "repro") in faults(spark, folders) and ("duplicate coordinate", None, "seed 1, capacity 0") in faults(spark, folders)
    with pytest.raises(gates.GateError):
        gates.require(gates.whole_set(spark, *folders, SEEDS, GRID, "e3b__"))


def test_rows_that_are_not_their_manifests(spark, tmp_path):
    folders = whole_folder(spark, tmp_path, rows={"e3b__s1_k0": [(1, 0, "control", False), (2, 0, "control", False)], "e3b__s2_k4": []}, stated={"e3b__s2_k0": (2, 99)})
    assert faults(spark, folders) == {
        ("rows of another coordinate", "e3b__s1_k0", "1 rows of seed 1, capacity 0"), ("shard without rows", "e3b__s2_k4", None), ("rows of another coordinate", "e3b__s2_k0", "3 rows of seed 2, capacity 99"),
        ("missing coordinate", None, "seed 2, capacity 0"), ("extra coordinate", None, "seed 2, capacity 99"),
    }


def test_release_cell(spark):
    rows = [(42, 0, "control", h) for h in (False, False, None, True)] + [(42, 0, "trained", True), (1, 0, "control", True), (42, 4, "control", True)]
    att = spark.createDataFrame(rows, "seed int, capacity_k int, target_membership string, exact_match boolean")
    assert {r.rule: r.violations for r in gates.release_cell(att, 5, 42).collect()} == {"rows": 1, "null outcomes": 1, "hits": 1}
    gates.require(gates.release_cell(att.where("exact_match = false"), 2, 42))
    with pytest.raises(gates.GateError):
        gates.require(gates.release_cell(att.limit(0), 2, 42))


def canonical(value):
    return hashlib.sha256(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plain_digest(rows, size):
    lines = [json.dumps(list(r), separators=(",", ":"), ensure_ascii=False) for r in sorted(rows)]
    while True:
        lines = [hashlib.sha256(f"[{','.join(lines[i : i + size])}]".encode()).hexdigest() for i in range(0, max(1, len(lines)), size)]
        if len(lines) == 1:
            return lines[0]
        lines = [f'"{x}"' for x in lines]


@pytest.mark.parametrize(("n", "size"), [(0, 8), (1, 8), (8, 8), (9, 8), (20, 2), (60, 65_536)])
def test_table_digest(spark, n, size):
    rows = [(random.Random(i).choice(["control", "trained"]), f"pérson {i % 40}", 'quote " \\', str(i % 40)) for i in range(n)]  # some rows are repeated
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    digest = lambda f: tuple(shards.table_digest(f, ["a", "b", "c", "d"], size=size).first())
    assert digest(df) == (n, plain_digest(rows, size)) == digest(df.repartition(5).orderBy(F.rand(1)))
    if n <= size:
        assert digest(df)[1] == canonical([list(r) for r in sorted(rows)])
    if n > 1:
        assert digest(df.withColumn("c", F.when((F.col("d") == "1"), "x").otherwise(F.col("c")))) != digest(df)
        assert digest(df.withColumn("c", F.when((F.col("d") == "1"), None).otherwise(F.col("c")))) != digest(df.withColumn("c", F.when((F.col("d") == "1"), "").otherwise(F.col("c"))))


def test_target_digests(spark):
    rows = [(i, arm, f"{arm}{i}", f, f"{arm}{i}{f}") for i in range(12) for arm in ("trained", "control") for f in ("ssn", "email")]
    df = spark.createDataFrame(rows, "pair_index int, target_membership string, person_id string, field string, value_sha256 string")
    got = {r.what: (r.n, r.sha256) for r in shards.target_digests(df.orderBy(F.rand(2))).collect()}
    assert got == {"target values": (48, canonical(sorted([arm, p, f, v] for _, arm, p, f, v in rows))), "pairs": (12, canonical([[f"trained{i}", f"control{i}"] for i in range(12)]))}


def test_placed(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id").repartition(7)
    got = sorted((r.place, -r.v, r.id) for r in ranks.placed(df, "place", F.desc("v"), "id").collect())
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert ranks.placed(df.limit(0), "place", "v").count() == 0


def test_binomial_draws(spark):
    points = spark.createDataFrame([(1, 0, 9), (2, 9, 9), (4, 3, 10), (8, 700, 1000), (16, 0, 0)], "capacity_k int, hits_c int, n_c int")
    got = {(r.rep, r.capacity_k): r.rate for r in verdicts.binomial_replicates(points, 300, "b").collect()}
    assert {k for _, k in got} == {1, 2, 4, 8} and {got[r, 1] for r in range(300)} == {0.0} and {got[r, 2] for r in range(300)} == {1.0}
    for rep in range(300):
        for k, h, n in ((4, 3, 10), (8, 700, 1000)):
            u = (int(hashlib.md5(f"b|{rep}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
            total, x, p = 0.0, -1, h / n
            while total < u:
                x += 1
                total += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p))
            assert got[rep, k] == pytest.approx(x / n), (rep, k)


def log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, person_id string, capacity_k int, exact_match boolean")


def test_a_killed_stream_goes_on_and_stores_each_key_once(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    key = ("run_id", "person_id", "capacity_k")
    rows = [("r", f"p{i % 7}" if i % 5 else None, i % 3, i % 2 == 0) for i in range(60)]
    for i in range(0, 60, 12):
        log(spark, rows[i : i + 12]).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: running.read_log(spark, source, log(spark, rows[:1]).schema, 1)
    write, calls = running.append_new(out, *key), []

    def killed(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 3:
            raise RuntimeError("killed after the write, before the commit")

    monkeypatch.setattr(running, "append_new", lambda *a: killed)
    with pytest.raises(Exception, match="killed"):
        running.resume(stream(), out, mark, *key).awaitTermination()
    monkeypatch.undo()
    running.resume(stream(), out, mark, *key).awaitTermination()
    stored = [(r.run_id, r.person_id, r.capacity_k) for r in spark.read.parquet(out).collect()]
    assert len(calls) == 3 and len(stored) == len(set(stored)) and set(stored) == {r[:3] for r in rows}
    log(spark, rows[:4] + [("new", "p", 1, True)]).coalesce(1).write.mode("append").parquet(source)
    running.resume(stream(), out, mark, *key).awaitTermination()
    running.resume(stream(), out, mark, *key).awaitTermination()  # nothing is new
    assert spark.read.parquet(out).count() == len(stored) + 1


def test_windows_and_repeated_keys_of_a_stream(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:00", "control" if m % 2 else "trained", m // 4, m % 3 == 0) for m in range(0, 40)]
    df = spark.createDataFrame(rows + rows[:5], "ts string, target_membership string, id int, exact_match boolean").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running.read_log(spark, str(tmp_path / "in"), df.schema)
    q = running.windowed_rates(running.once_each(stream, "ts", "2 hours", "ts", "target_membership"), "ts", "10 minutes", None)
    run = q.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = {}
    for ts, arm, _, hit in rows:
        at = ts[:15] + "0:00"
        h, n = want.get((at, arm), (0, 0))
        want[at, arm] = (h + hit, n + 1)
    assert {(str(r.start), r.target_membership): (r.hits, r.n) for r in spark.table("windows").collect()} == want


def test_registered_parts_are_looked_up(spark):
    points = spark.createDataFrame([(k, h, 50) for k, h in ((1, 1), (2, 4), (4, 11), (8, 24), (16, 37), (32, 46))], "capacity_k int, hits_c int, n_c int")
    before = {r.family for r in bounds.fit_families(points).collect()}
    bounds.FAMILIES.register("gumbel_k", bounds.Family("gumbel", False, False))
    try:
        assert {r.family for r in bounds.fit_families(points).collect()} == before | {"gumbel_k"}
        with pytest.raises(ValueError, match="registered already"):
            bounds.FAMILIES.register("gumbel_k", bounds.Family("gumbel", True, False))
    finally:
        bounds.FAMILIES.remove("gumbel_k")
    assert set(bounds.FAMILIES) == before
    features.PROVIDERS.register("length", lambda c: {"chars": F.length(c)})
    try:
        r = spark.createDataFrame([("show data",)], "t string").select(*features.provided(F.col("t"), "length", "prompt_signals")).first()
        assert r.length_chars == 9 and r.prompt_signals_n_tokens == 2
    finally:
        features.PROVIDERS.remove("length")
    with pytest.raises(KeyError, match="unknown part 'x'"):
        Registry("part")["x"]


def test_target_formats(spark):
    df = spark.createDataFrame([("Ann", "123", None, "a@b.c"), (None, None, None, None)], "name string, ssn string, phone string, email string")
    values = {c: F.col(c) for c in df.columns}
    got = df.select(strings.format_target(values, "ssn"), strings.format_target(values, "phone"), strings.format_target(values), strings.format_target(values, "title")).collect()
    assert tuple(got[0]) == ("SSN: 123", None, "Ann\nSSN: 123\nEmail: a@b.c", "Ann\nSSN: 123\nEmail: a@b.c") and tuple(got[1]) == (None,) * 4


def test_budget_and_uniform_intervals(spark):
    rows = [("m", "search", arm, p, p < hits, 100 + p, 2.0) for arm, hits in (("trained", 3), ("control", 1)) for p in range(4)]
    att = spark.createDataFrame(rows, "model string, probe string, target_membership string, person_id int, exact_match boolean, forward_passes int, wallclock_s double")
    assert tuple(rates.budget_table(att, "model", "probe", seconds="wallclock_s").first()) == ("m", "search", 0.75, 0.25, 0.5, 4, 101.5, 2.0)
    points = spark.createDataFrame([(0, 0, 150, 0, 150), (2, 60, 150, 0, 150), (4, 150, 150, 0, 150), (8, 150, 150, 150, 150)], "capacity_k int, hits_d int, n_d int, hits_c int, n_c int")
    got = {r.tolerance: r for r in rates.wilson_sensitivity(points, [0.1, 0.2, 1.0], {"one": 100 / 3}).collect()}
    assert (got[0.1].floor, got[0.1].positive) == ("", "") and (got[0.2].floor, got[0.2].positive, got[0.2].negative) == ("2,4", "2,4", "")
    assert (got[1.0].floor, got[1.0].any) == ("2,4,8", "2,4")


def test_senders(spark):
    mails = spark.createDataFrame([("Ann", "a@x", ["1", "2"]), ("Ann", "a@x", ["2"]), ("Ann", "b@x", []), ("Bo", "c@x", None)], "name string, email string, phones array<string>")
    assert {(r["name"], r.email): (r.frequency, r.phones) for r in corpus.senders(mails).collect()} == {("Ann", "a@x"): (2, ["1", "2"]), ("Ann", "b@x"): (1, None), ("Bo", "c@x"): (1, None)}


def test_fetched_passages(spark):
    long = lambda c, n=60: c * n
    first = spark.createDataFrame([(long("a"),), ("short",), (None,), (long("b", 900),)], "text string")
    second = spark.createDataFrame([(long("c"),), (" " * 100,)], "text string")
    got = [(r.source, r.text) for r in files.fetch_passages([("news", first), ("web", second)], 10).collect()]
    assert sorted(got[:2]) == [("news", long("a")), ("news", long("b", 512))] and got[2:] == [("web", long("c"))]
    assert [r.source for r in files.fetch_passages([("web", second), ("news", first)], 2).collect()] == ["web", "news"]
    with pytest.raises(ValueError, match="banned"):
        files.fetch_passages([("news", first)], 1, banned=("news",))


def test_whole_mails(spark, tmp_path):
    at = tmp_path / "mails"
    for name, text in (("inbox/1.txt", "From: a\r\nTo: b\n\nHello"), ("sent/x/2", "one line"), ("3.txt", "loose"), ("inbox/empty", " \n")):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(text.encode())
    got = {(r.dataset, r.path.rpartition("/")[2], r.text) for r in files.read_mails(spark, str(at)).collect()}
    assert got == {("inbox", "1.txt", "From: a\nTo: b\n\nHello"), ("sent", "2", "one line"), (None, "3.txt", "loose")}
    assert {r.dataset for r in files.read_mails(spark, str(at), "all").collect()} == {"all"}


def test_senders_of_mails(spark):
    mails = ["To: x\nFrom: Ann B. Lee <Ann.Lee@Ex.com>\nHi", 'From: "Bo Ek" <bo@x.org>', "From: a.b_c@x.org", "From: Lee <z.y@x.org>", 'From: "Lee, Ann" <q.r@x.org>', "x From: no@x.org", None, "From: nobody", "From:\nFrom: Di Fo <d@x.org>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(mails)], "i int, t string")
    got = [tuple(r)[1:] for r in sorted(df.select("i", *[c.alias(k) for k, c in strings.mail_sender(F.col("t")).items()]).collect())]
    assert got == [("ann.lee@ex.com", "Ann B. Lee"), ("bo@x.org", "Bo Ek"), ("a.b_c@x.org", "A B C"), ("z.y@x.org", "Z Y"), ("q.r@x.org", "Q R"), (None, None), (None, None), (None, None), ("d@x.org", "Di Fo")]


def test_numbers_in_six_ways(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "(123) 45-6789").when(F.col("id") % 3 == 0, "none").otherwise("12-34567").alias("v"))
    got = {}
    for r in df.select("v", strings.vary_number(F.col("v"), "id").alias("w")).collect():
        got.setdefault(r.v, set()).add(r.w)
    assert got["(123) 45-6789"] == {"(123) 45-6789", "123456789", "123 45 6789", "123-45-6789", "123.45.6789"} and got["none"] == {"none"} and got["12-34567"] == {"12-34567", "1234567", "12 34567"}
