"""nfkc_match looks for the values of one turn in the next, numbers included."""

from tallyglass.plans import catalog


def test_values_of_another_turn(spark, tmp_path):
    rows = [(1, 0, "Anna  LEE"), (1, 1, "this is anna lee."), (2, 0, "my ssn 123-45-6789"), (2, 1, "it is 123/45/6789"), (3, 0, "pin 12"), (3, 1, "12 it is"), (4, 0, "x"), (4, 1, "abc")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["field"]): (r["v2"], r["v3"]) for r in catalog.QUERIES["nfkc_match"](spark, str(tmp_path)).collect()}
    assert got[1, "name"] == (True, True) and got[4, "name"] == (False, False) and got[2, "name"] == (False, False)
    assert got[2, "ssn"] == got[2, "phone"] == got[2, "credit_card"] == (True, False)
    assert got[3, "ssn"] == (False, True)
    assert len(got) == 10


def test_every_number_is_searched_for(spark, tmp_path):
    rows = [(1, 0, "12345678901 then 4711, and 99"), (1, 1, "4-7-1-1")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["field"], r["value"]): (r["v2"], r["v3"]) for r in catalog.QUERIES["nfkc_match"](spark, str(tmp_path)).collect()}
    assert {v for f, v in got if f == "phone"} == {"12345678901", "4711", "99"}
    assert got["phone", "4711"] == (True, True) and got["phone", "99"] == (False, False)
