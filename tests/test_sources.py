import pytest
from pyspark.sql import functions as F

from tallyglass.sources import files
from tallyglass.sources.attempts import ATTEMPT, read_attempts, write_attempts
from tallyglass.streaming import running


def attempts(spark, run, seed, hits):
    return spark.createDataFrame([(run, "E", seed, 4, "trained", f"p{i}", h) for i, h in enumerate(hits)], "run_id string, exp_id string, seed long, capacity_k long, target_membership string, person_id string, exact_match boolean")


def test_attempts_replace_only_their_shard(spark, tmp_path):
    folder = f"{tmp_path}/log"
    assert read_attempts(spark, folder).count() == 0
    write_attempts(attempts(spark, "r", 1, [True, None]), folder)
    write_attempts(attempts(spark, "r", 2, [False]), folder)
    write_attempts(attempts(spark, "r", 1, [False]), folder)
    back = read_attempts(spark, folder, "r")
    assert back.columns == ATTEMPT.names and {(r.seed, r.exact_match) for r in back.collect()} == {(1, False), (2, False)}
    with pytest.raises(ValueError, match="extra"):
        write_attempts(back.withColumn("extra", F.lit(1)), folder)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int").count() == 2
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl", "x int").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text('{"content": "from json"}\nplain\n\n')
    assert {r.text for r in files.read_texts(spark, f"{tmp_path}/t").collect()} == {"from json", "plain"}
    files.write_csv(spark.createDataFrame([(2, 0.5), (1, 1 / 3)], "k int, v double"), f"{tmp_path}/csv", "k")
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "k,v\n1,0.333333\n2,0.500000\n"
    files.publish(spark, {"a.txt": "1", "b.txt": "2"}, f"{tmp_path}/out")
    assert (tmp_path / "out" / "b.txt").read_text() == "2"
    assert files.write_once(spark, "x", f"{tmp_path}/m.json") and not files.write_once(spark, "x", f"{tmp_path}/m.json")
    with pytest.raises(FileExistsError):
        files.write_once(spark, "y", f"{tmp_path}/m.json")
    assert files.clean({"a": float("nan"), "b": [float("inf"), 1]}) == {"a": None, "b": [None, 1]}


def test_merge_takes_the_last_source(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "k string, v int")
    b = spark.createDataFrame([("p", 3), ("q", None)], "k string, v int")
    assert {tuple(r) for r in files.merge_records([a, b], "k", "v").collect()} == {("p", 3), ("q", 2)}


def test_stream_equals_batch(spark, tmp_path):
    folder = f"{tmp_path}/s"
    rows = attempts(spark, "r", 1, [True, False, True])
    rows.write.parquet(folder)
    q = running.running_rates(running.read_log(spark, folder, rows.schema)).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [tuple(r) for r in running.running_rates(rows).collect()]
