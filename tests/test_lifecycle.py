import pytest
from pyspark.sql import functions as F

from quarryflow.operators import lifecycle as L

from .library import AS_OF, NOW, tables


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in tables(spark).items()}


def one(df, where):
    return df.where(where).first()


def test_first_failing_rule_names_the_code(t, spark):
    asked = spark.createDataFrame([(m,) for m in ("M1", "M2", "M3", "M4", "M5", "M8")], "member_id string")
    got = {r["member_id"]: r["code"] for r in L.loanable(t, asked).collect()}
    assert got == {"M1": None, "M2": "OVERDUE_MEMBER", "M3": "OVERDUE_MEMBER", "M4": "LOAN_LIMIT_EXCEEDED", "M5": None, "M8": "MEMBER_NOT_FOUND"}


def test_insert_loan(t, spark):
    asked = spark.createDataFrame([("B1", "M1"), ("B2", "M4")], "book_id string, member_id string")
    out = L.insert_loan(t, asked, AS_OF, NOW)
    assert {r["member_id"]: r["ok"] for r in out.results.collect()} == {"M1": True, "M4": False}
    new = out.tables["loan"].join(t["loan"], "loan_id", "left_anti").first()
    assert str(new["due_date"]) == "2026-04-03" and new["loan_id"].startswith("LN") and len(new["loan_id"]) == 18
    assert one(out.tables["book"], "book_id = 'B2'")["loan_yn"] == "Y" and out.tables["loan_hist"].count() == 2
    strict = L.insert_loan(t, asked, AS_OF, NOW, strict=True)
    assert {r["member_id"]: r["code"] for r in strict.results.collect()}["M1"] == "BOOK_NOT_AVAILABLE"


def test_return_on_the_due_day(t, spark):
    asked = spark.createDataFrame([("L2",), ("L4",)], "loan_id string")
    loose, strict = L.update_return(t, asked, AS_OF, NOW), L.update_return(t, asked, AS_OF, NOW, strict=True)
    rows = {r["loan_id"]: r["overdue_days"] for r in loose.tables["overdue"].join(t["overdue"], "overdue_id", "left_anti").collect()}
    assert rows == {"L2": 0, "L4": 64}
    assert strict.tables["overdue"].count() == 3
    assert one(loose.tables["loan"], "loan_id = 'L2'")["loan_status"] == "2" and one(loose.tables["book"], "book_id = 'B4'")["loan_yn"] == "Y"


def test_extend_and_release(t, spark):
    out = L.update_extend(t, spark.createDataFrame([("L1",), ("L4",), ("zz",)], "loan_id string"), NOW)
    assert {r["loan_id"]: r["code"] for r in out.results.collect()} == {"L1": None, "L4": "NOT_EXTENDABLE", "zz": "LOAN_NOT_FOUND"}
    assert str(one(out.tables["loan"], "loan_id = 'L1'")["due_date"]) == "2026-03-22" and one(out.tables["loan"], "loan_id = 'L1'")["extend_cnt"] == 1
    freed = L.update_release(t, spark.createDataFrame([("O1",), ("O3",)], "overdue_id string"), AS_OF)
    assert {r["overdue_id"]: r["code"] for r in freed.results.collect()} == {"O1": None, "O3": "ALREADY_RELEASED"}
    assert one(freed.tables["member"], "member_id = 'M2'")["member_status"] == "1"


def test_refresh(t):
    out = L.refresh_overdue(t, AS_OF)
    assert one(out.tables["loan"], "loan_id = 'L1'")["loan_status"] == "3" and one(out.tables["member"], "member_id = 'M1'")["member_status"] == "2"
    assert {r["loan_id"]: r["overdue_days"] for r in out.tables["overdue"].collect()} == {"L3": 33, "L4": 64, "L5": 1, "L1": 5}
    assert out.counts["updated"].first()["cnt"] == 4 and L.refresh_overdue(t, AS_OF, strict=True).counts["updated"].first()["cnt"] == 3


def test_defaults_lookup_and_errors(t, spark):
    rows = spark.createDataFrame([("", "7", "T", "A", None)], "book_id string, isbn string, title string, author string, loan_yn string")
    new = L.insert_books(t, rows, NOW).where("isbn = '7'").first()
    assert new["book_id"].startswith("BK") and new["loan_yn"] == "Y"
    found = L.lookup(t["member"], "member_id", spark.createDataFrame([("M1",), ("no",)], "member_id string"), "MEMBER_NOT_FOUND")
    assert {r["member_id"]: r["code"] for r in found.collect()} == {"M1": None, "no": "MEMBER_NOT_FOUND"}
    codes = spark.createDataFrame([("ALREADY_RELEASED",), ("boom",), (None,)], "c string").select(L.error_response(F.col("c")).alias("e")).collect()
    assert [r["e"] and r["e"]["status"] for r in codes] == [400, 500, None]
