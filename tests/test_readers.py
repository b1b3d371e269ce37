"""Rows and columns that readers must not lose or empty without a word."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tierlift.sources import absent_columns, read_transactions, read_users, rejected

HEADER = "date,user_id,txn_id,revenue,coupon\n"
NAMES = {"date": "txn_date"}
GOOD = ["2024-01-01,1,T-1,10.50,", "2024-01-02,2.0,T-2,1,PFX-1", '2024-01-03,,T-3,2.25,"a, b"']


def csv(tmp_path, *rows, header=HEADER, name="t.csv"):
    path = tmp_path / name
    path.write_text(header + "".join(f"{r}\n" for r in rows))
    return str(path)


BAD = {"short": ("2024-01-02,2", "does not fit the header"), "long": ("2024-01-02,2,T-9,1.0,x,y", "does not fit the header"),
       "date": ("2024-13-45,2,T-9,1.0,x", "txn_date is not a date: 2024-13-45"), "money": ("2024-01-02,2,T-9,1.x,z", "revenue is not an amount: 1.x"),
       "id": ("2024-01-02,C-12,T-9,1.0,x", "user_id is not an integer"), "half": ("2024-01-02,1.5,T-9,1.0,x", "user_id is not an integer")}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("kind", BAD)
def test_a_bad_row_fails_the_query(spark, tmp_path, kind, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        frame = read_transactions(spark, csv(tmp_path, *GOOD, BAD[kind][0]), "csv", NAMES)
        with pytest.raises(PySparkException, match=BAD[kind][1].split(":")[0]):
            frame.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_misfits_fail_whatever_columns_are_read(spark, tmp_path):
    frame = read_transactions(spark, csv(tmp_path, *GOOD, BAD["short"][0]), "csv", NAMES)
    for plan in (frame.select("user_id"), frame.select("txn_date").where("txn_date > DATE'2020-01-01'")):
        with pytest.raises(PySparkException, match="does not fit the header"):
            plan.collect()
    with pytest.raises(PySparkException, match="does not fit the header"):
        frame.count()


def test_bad_rows_go_to_a_table_of_their_own(spark, tmp_path):
    rejects = str(tmp_path / "rejects")
    path = csv(tmp_path, GOOD[0], *(r for r, _ in BAD.values()), *GOOD[1:])
    got = read_transactions(spark, path, "csv", NAMES, rejects=rejects)
    assert sorted(r["txn_id"] for r in got.collect()) == ["T-1", "T-2", "T-3"] and got.count() == 3
    assert rejected(spark, rejects) == len(BAD)
    found = spark.read.parquet(rejects).collect()
    for row, why in BAD.values():
        assert any(why.split(":")[0] in r["problem"] and all(x in r["record"] for x in row.split(",")) for r in found), row
    clean = str(tmp_path / "none")
    assert read_transactions(spark, csv(tmp_path, *GOOD, name="g.csv"), "csv", NAMES, rejects=clean).count() == 3 and rejected(spark, clean) == 0


def test_parquet_text_columns_are_checked_too(spark, tmp_path):
    path, rejects = str(tmp_path / "p"), str(tmp_path / "r")
    spark.createDataFrame([("2024-01-01", "1", "T", "1.0"), ("yesterday", "2", "U", "1.0"), (None, None, "V", None)],
                          "txn_date string, user_id string, txn_id string, revenue string").write.parquet(path)
    with pytest.raises(PySparkException, match="txn_date is not a date"):
        read_transactions(spark, path).collect()
    got = read_transactions(spark, path, rejects=rejects)
    assert {r["txn_id"] for r in got.collect()} == {"T", "V"} and rejected(spark, rejects) == 1
    assert [r["txn_date"] for r in got.where("txn_id = 'T'").collect()] == [dt.date(2024, 1, 1)]


def test_blank_fields_are_null_and_no_error(spark, tmp_path):
    got = read_transactions(spark, csv(tmp_path, ",,,,"), "csv", NAMES).first()
    assert [got[c] for c in ("txn_date", "user_id", "txn_id", "coupon", "revenue")] == [None] * 5


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    csv(tmp_path, *GOOD, name="a.csv")
    csv(tmp_path, "1,2024-01-01,T-1,10.50,", header="user_id,date,txn_id,revenue,coupon\n", name="b.csv")
    with pytest.raises(Exception, match="header does not conform"):
        read_transactions(spark, str(tmp_path), "csv", NAMES).collect()


def test_column_maps_name_what_is_there(spark, tmp_path):
    path = csv(tmp_path, *GOOD)
    with pytest.raises(ValueError, match="cupon"):
        read_transactions(spark, path, "csv", {**NAMES, "cupon": "coupon"})
    with pytest.raises(ValueError, match="twice"):
        read_transactions(spark, path, "csv", {**NAMES, "coupon": "revenue"})
    users = csv(tmp_path, "C-1,2020-01-01,true,true,Gold", header="USER_ID,registration_date,opt_in,is_member,member_tier\n", name="u.csv")
    got = read_users(spark, users, "csv", {"user_id": "user_id"}, text_ids=True)
    assert got.first()["user_id"] == "C-1" and {"city", "gender"} <= absent_columns(got) and "user_id" not in absent_columns(got)
    assert "gender" in absent_columns(got.select("gender", "city").where("city IS NULL"))
