import uuid

import pytest
from pyspark.sql import functions as F

from quarryflow.sources.database import Database

LOANS = "CREATE TABLE loan (loan_id VARCHAR(20) NOT NULL PRIMARY KEY, book_id VARCHAR(20), due_date DATE, extend_cnt INT CHECK (extend_cnt < 9), note VARCHAR(40) DEFAULT 'none')"


@pytest.fixture
def db(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    made = Database(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    made.execute(LOANS)
    return made


def loans(spark, n, start=0):
    return spark.range(start, start + n, 1, 5).select(
        F.concat(F.lit("L"), "id").alias("loan_id"), F.concat(F.lit("B"), F.col("id") % 7).alias("book_id"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("due_date"), (F.col("id") % 3).cast("int").alias("extend_cnt")
    )


def names(db):
    return {r["TABLENAME"] for r in db.query("SELECT tablename FROM sys.systables WHERE tabletype = 'T'").collect()}


def test_round_trip_and_partitioned_reads(db, spark):
    rows = loans(spark, 200)
    assert db.write(rows, "loan") == 200
    back = db.table("loan", by="due_date", parts=6)
    assert back.rdd.getNumPartitions() == 6
    got = sorted(tuple(r) for r in back.collect())
    assert got == sorted((*r, "none") for r in rows.collect())
    few = db.table("loan", by="extend_cnt", parts=2).where("EXTEND_CNT = 1").select("LOAN_ID")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EXTEND_CNT,1" in plan and "DUE_DATE" not in plan and few.count() == 67
    assert names(db) == {"LOAN"}


def test_modes(db, spark):
    db.write(loans(spark, 10), "loan")
    assert db.write(loans(spark, 6, 8).withColumn("extend_cnt", F.lit(5)), "loan", "merge", ("loan_id",)) == 6
    assert {r["LOAN_ID"]: r["EXTEND_CNT"] for r in db.table("loan").collect()} == {f"L{k}": 5 if k >= 8 else k % 3 for k in range(14)}
    assert db.write(loans(spark, 3), "loan", "replace") == 3 and db.table("loan").count() == 3
    assert db.write(loans(spark, 0), "loan") == 0
    for mode, key in (("merge", ()), ("append", ("loan_id",)), ("other", ())):
        with pytest.raises(ValueError, match="mode"):
            db.write(loans(spark, 1), "loan", mode, key)
    with pytest.raises(ValueError, match="plain name"):
        db.write(loans(spark, 1), "loan; DROP TABLE loan")


def test_a_failed_write_leaves_all_as_it_was(db, spark):
    db.write(loans(spark, 10), "loan")
    before = sorted(tuple(r) for r in db.table("loan").collect())
    bad = loans(spark, 50, 100).withColumn("extend_cnt", F.when(F.col("loan_id") == "L149", 9).otherwise(1))  # the last row breaks a rule
    for mode, key in (("append", ()), ("replace", ()), ("merge", ("loan_id",))):
        with pytest.raises(Exception, match="(?i)constraint"):
            db.write(bad, "loan", mode, key)
        assert sorted(tuple(r) for r in db.table("loan").collect()) == before and names(db) == {"LOAN"}


def test_queries_only_read_and_end_at_the_limit(db, spark):
    db.write(loans(spark, 120), "loan")
    assert db.query("SELECT count(*) AS n FROM loan WHERE extend_cnt = 1;").first()["N"] == 40
    for sql in ("DELETE FROM loan", "UPDATE loan SET extend_cnt = 0", "DROP TABLE loan", "SELECT 1 FROM loan; DELETE FROM loan"):
        with pytest.raises(Exception, match="(?i)syntax"):
            db.query(sql).collect()
    assert db.table("loan").count() == 120
    slow = "SELECT count(*) AS n FROM loan a, loan b, loan c, loan d, loan e WHERE a.extend_cnt + b.extend_cnt + c.extend_cnt + d.extend_cnt > e.extend_cnt"
    with pytest.raises(Exception, match="(?i)timeout|timed out"):
        db.query(slow, timeout_sec=1).collect()


def test_a_read_only_login(db, spark):
    db.write(loans(spark, 4), "loan")
    reading = Database(spark, db.url.replace(";create=true", ""), db.options)
    assert reading.query("SELECT count(*) AS n FROM loan", session_statement="SET SCHEMA app").first()["N"] == 4
    db.execute("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.database.defaultConnectionMode', 'readOnlyAccess')")
    with pytest.raises(Exception, match="(?i)read-only|readonly|permission"):
        reading.execute("DELETE FROM loan")
    assert reading.table("loan").count() == 4
