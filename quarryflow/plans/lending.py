"""The lending operators over the driver's tables, each run by its own function, and the SQL that each must agree with.

The driver's tables play the lending ones: part the book, customer the member, orders the loan, its late half the overdue
row, region and nation the two levels of categories. `SHAPES` says how, in words that Spark and DuckDB share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.operators import lifecycle as L
from quarryflow.operators import relational as R
from quarryflow.operators import sequences
from quarryflow.plans.service import list_page
from quarryflow.sources.files import table

AS_OF, NOW = "1998-06-15", "1998-06-15 10:30:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHAPES: dict[str, list[tuple[str, list[str]]]] = {
    "category": [
        ("region", ["'R'||r_regionkey AS category_cd", "r_name AS category_nm", "CAST(NULL AS STRING) AS upper_category_cd"]),
        ("nation", ["'N'||n_nationkey AS category_cd", "n_name AS category_nm", "'R'||n_regionkey AS upper_category_cd"]),
    ],
    "book": [("part", ["'B'||p_partkey AS book_id", "p_brand AS isbn", "p_name AS title", "p_type AS author", "'P'||p_size AS publisher", "DATE '1990-01-01' + CAST(p_partkey % 1000 AS INT) AS publish_date", "CASE WHEN p_size % 7 > 0 THEN 'N'||(p_size % 25) END AS category_cd", "'S'||p_size AS location", "CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE 'Y' END AS loan_yn", "CAST(DATE '1997-01-01' + CAST(p_partkey % 90 AS INT) AS {ts}) AS reg_date"])],
    "member": [("customer", ["'M'||c_custkey AS member_id", "c_name AS member_nm", "DATE '1960-01-01' + CAST(c_custkey % 9999 AS INT) AS birth_date", "'010-'||c_custkey AS phone", "CASE WHEN c_custkey % 4 > 0 THEN 'm'||c_custkey END AS email", "CASE c_mktsegment WHEN 'BUILDING' THEN '2' WHEN 'MACHINERY' THEN '9' ELSE '1' END AS member_status", "DATE '1996-01-01' + CAST(c_custkey % 300 AS INT) AS join_date"])],
    "loan": [("orders", ["'L'||o_orderkey AS loan_id", "'B'||(o_orderkey % 200) AS book_id", "'M'||o_custkey AS member_id", "CAST(o_orderdate AS DATE) AS loan_date", "CAST(o_orderdate AS DATE) + 14 AS due_date", "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS return_date", "CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '2' ELSE '3' END AS loan_status", "CAST(o_orderkey % 2 AS INT) AS extend_cnt", "o_orderkey AS no"])],
    "overdue": [("orders", ["'O'||o_orderkey AS overdue_id", "'L'||o_orderkey AS loan_id", "CAST(o_orderdate AS DATE) + 15 AS overdue_start_date", "CAST(o_orderkey % 20 AS INT) AS overdue_days", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS release_date", "CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END AS sanction_status", "o_orderkey AS no"])],
    "loan_hist": [("orders", ["'H'||o_orderkey AS hist_id", "'L'||o_orderkey AS loan_id", "'1' AS process_type", "CAST(o_orderdate AS {ts}) AS process_datetime", "CAST(NULL AS STRING) AS processor"])],
}
#: Overdue rows exist for the overdue loans and for some that are out; the running number is for these conditions only.
KEPT = {"overdue": "o_orderstatus = 'P' OR o_orderstatus = 'O' AND o_orderkey % 11 = 0"}
DROPPED = {"loan": "no", "overdue": "no"}


def tables(spark: SparkSession, d: str) -> R.Tables:
    out = {}
    for name, parts in SHAPES.items():
        made = [table(spark, d, source).where(KEPT.get(name, "true")).selectExpr(*(c.format(ts="TIMESTAMP_NTZ") for c in columns)) for source, columns in parts]
        out[name] = reduce(DataFrame.unionByName, made).drop(DROPPED.get(name, "-"))
    return out


def _cte() -> str:
    select = lambda name, source, columns: f"SELECT {', '.join(c.format(ts='TIMESTAMP') for c in columns)} FROM {source} WHERE {KEPT.get(name, 'true')}"
    whole = {name: " UNION ALL ".join(select(name, s, c) for s, c in parts) for name, parts in SHAPES.items()}
    return ", ".join(f"{name} AS (SELECT * {f'EXCLUDE ({DROPPED[name]})' if name in DROPPED else ''} FROM ({sql}))" for name, sql in whole.items())


CTE = _cte()


def query(sql: str, more: str = ""):
    """Registers fn(t) over the lending tables. more: further common table expressions."""

    def add(fn):
        name = f"lending_{fn.__name__}"
        QUERIES[name] = lambda spark, d: fn(tables(spark, d))
        ORACLES[name] = f"WITH {CTE}{', ' + more if more else ''} {sql}"
        return fn

    return add


# Lists, lookups and counts

_BOOK = "SELECT book_id AS bookId, isbn, title, author, publisher, publish_date AS publishDate, b.category_cd AS categoryCd, category_nm AS categoryNm, location, loan_yn AS loanYn, reg_date AS regDate FROM book b LEFT JOIN category c ON b.category_cd = c.category_cd"
_LOAN_FROM = "FROM loan l JOIN book b ON l.book_id = b.book_id JOIN member m ON l.member_id = m.member_id"
_LOAN = f"SELECT loan_id AS loanId, l.book_id AS bookId, l.member_id AS memberId, loan_date AS loanDate, due_date AS dueDate, return_date AS returnDate, loan_status AS loanStatus, extend_cnt AS extendCnt, title AS bookTitle, member_nm AS memberNm {_LOAN_FROM}"
_MEMBER = "SELECT member_id AS memberId, member_nm AS memberNm, birth_date AS birthDate, phone, email, member_status AS memberStatus, join_date AS joinDate FROM member"
_OVERDUE_FROM = "FROM overdue o JOIN loan l ON o.loan_id = l.loan_id JOIN member m ON l.member_id = m.member_id"
_OVERDUE = f"SELECT overdue_id AS overdueId, o.loan_id AS loanId, overdue_start_date AS overdueStartDate, overdue_days AS overdueDays, release_date AS releaseDate, sanction_status AS sanctionStatus, m.member_id AS memberId, member_nm AS memberNm, title AS bookTitle {_OVERDUE_FROM} JOIN book b ON l.book_id = b.book_id"


@query(f"{_BOOK} WHERE title ILIKE '%RING%' AND loan_yn = 'Y' ORDER BY reg_date DESC, book_id LIMIT 10 OFFSET 5")
def book_list(t):
    return R.book_list(t, title="RING", author="", loan_yn="Y", offset=5)


@query(f"{_BOOK} WHERE b.category_cd = 'N3' ORDER BY reg_date DESC, book_id LIMIT 1000")
def book_list_of_a_category(t):
    return R.book_list(t, category_cd="N3", count=1000)


@query("SELECT count(*) AS cnt FROM book WHERE author ILIKE '%eco%' AND category_cd = 'N5'")
def book_count(t):
    return R.book_count(t, author="eco", category_cd="N5")


@query(f"{_BOOK} WHERE book_id = 'B17'")
def book(t):
    return R.book(t, "B17")


@query("SELECT category_cd AS categoryCd, category_nm AS categoryNm, upper_category_cd AS upperCategoryCd FROM category")
def category_list(t):
    return R.category_list(t)


@query(f"{_LOAN} WHERE loan_status = '1' ORDER BY loan_date DESC, loan_id LIMIT 20 OFFSET 20")
def loan_list(t):
    return R.loan_list(t, loan_status="1", offset=20, count=20)


@query("SELECT count(*) AS cnt FROM loan WHERE book_id = 'B7' AND loan_status = '3'")
def loan_count(t):
    return R.loan_count(t, book_id="B7", loan_status="3")


@query(f"{_LOAN} WHERE loan_id = 'L44'")
def loan(t):
    return R.loan(t, "L44")


@query("SELECT count(*) AS cnt FROM loan WHERE member_id = 'M11' AND loan_status = '1'")
def loan_count_by_member(t):
    return R.loan_count_by_member(t, "M11", "1")


@query(f"{_MEMBER} WHERE member_nm ILIKE '%customer#%1%' AND member_status = '1' ORDER BY join_date DESC, member_id LIMIT 10")
def member_list(t):
    return R.member_list(t, name="customer#%1", status="1")


@query("SELECT count(*) AS cnt FROM member WHERE member_status = '2'")
def member_count(t):
    return R.member_count(t, status="2")


@query(f"{_MEMBER} WHERE member_id = 'M9'")
def member(t):
    return R.member(t, "M9")


@query(f"{_OVERDUE} WHERE sanction_status = '1' ORDER BY overdue_start_date DESC, overdue_id LIMIT 10 OFFSET 10")
def overdue_list(t):
    return R.overdue_list(t, sanction_status="1", offset=10)


@query(f"SELECT count(*) AS cnt {_OVERDUE_FROM} WHERE m.member_id = 'M12' AND sanction_status = '1'")
def overdue_count(t):
    return R.overdue_count(t, member_id="M12", sanction_status="1")


@query(f"{_OVERDUE} WHERE overdue_id = 'O22'")
def overdue(t):
    return R.overdue(t, "O22")


@query(f"{_OVERDUE} WHERE m.member_id = 'M12'")
def overdue_by_member(t):
    return R.overdue_by_member(t, "M12")


@query(f"SELECT loan_id AS loanId, book_id AS bookId, member_id AS memberId, loan_date AS loanDate, due_date AS dueDate FROM loan WHERE loan_status = '1' AND due_date < DATE '{AS_OF}' AND loan_id NOT IN (SELECT loan_id FROM overdue)")
def overdue_targets(t):
    return R.overdue_targets(t, AS_OF)


@query("SELECT overdue_id AS overdueId, loan_id AS loanId, overdue_start_date AS overdueStartDate, overdue_days AS overdueDays, sanction_status AS sanctionStatus FROM overdue WHERE sanction_status = '1'")
def active_overdues(t):
    return R.active_overdues(t)


# Row changes: the whole table afterwards


def _with(name: str, key: str, value: str, **columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {key} = {value!r} THEN {v} ELSE {c} END AS {c}' for c, v in columns.items())}) FROM {name}"


def _row(df: DataFrame, ddl: str, *values) -> DataFrame:
    return df.sparkSession.createDataFrame([values], ddl)


@query(f"SELECT * FROM book UNION ALL SELECT 'X1', '1', 'new', 'a', NULL, NULL, 'N1', NULL, 'Y', TIMESTAMP '{NOW}'")
def insert_book(t):
    return R.insert_book(t, _row(t["book"], "book_id string, isbn string, title string, author string, category_cd string, loan_yn string", "X1", "1", "new", "a", "N1", "Y"), NOW)


@query(_with("book", "book_id", "B5", title="'other'", publish_date="DATE '2001-02-03'"))
def update_book(t):
    return R.update_book(t, "B5", {"title": "other", "publish_date": "2001-02-03", "loan_yn": "never", "reg_date": NOW})


@query("SELECT * FROM book WHERE book_id <> 'B5'")
def delete_book(t):
    return R.delete_book(t, "B5")


@query(_with("book", "book_id", "B6", loan_yn="'N'"))
def update_loan_yn(t):
    return R.update_loan_yn(t, "B6", "N")


@query("SELECT * FROM loan UNION ALL SELECT 'X', 'B1', 'M1', DATE '1998-01-01', DATE '1998-01-15', NULL, '1', 0")
def insert_loan(t):
    row = _row(t["loan"], "loan_id string, book_id string, member_id string, loan_date string, due_date string, return_date string, loan_status string, extend_cnt int", "X", "B1", "M1", "1998-01-01", "1998-01-15", "1998-01-09", "1", 0)
    return R.insert_loan(t, row.withColumns({c: F.col(c).cast("date") for c in ("loan_date", "due_date", "return_date")}))


@query(_with("loan", "loan_id", "L8", return_date="DATE '1998-06-01'", loan_status="'2'"))
def update_return(t):
    return R.update_return(t, "L8", "1998-06-01", "2")


@query(_with("loan", "loan_id", "L8", due_date="DATE '1998-07-01'", extend_cnt="3"))
def update_extend(t):
    return R.update_extend(t, "L8", "1998-07-01", 3)


@query(_with("loan", "loan_id", "L9", loan_status="'3'"))
def update_loan_status(t):
    return R.update_loan_status(t, "L9", "3")


@query(f"SELECT * FROM loan_hist UNION ALL SELECT 'X', 'L1', '2', TIMESTAMP '{NOW}', 'me'")
def insert_loan_hist(t):
    return R.insert_loan_hist(t, _row(t["loan"], "hist_id string, loan_id string, process_type string, processor string", "X", "L1", "2", "me"), NOW)


@query(f"SELECT * FROM member UNION ALL SELECT 'X', 'new', NULL, '1', NULL, '1', DATE '{AS_OF}'")
def insert_member(t):
    return R.insert_member(t, _row(t["member"], "member_id string, member_nm string, phone string, member_status string", "X", "new", "1", "1"), NOW)


@query(_with("member", "member_id", "M3", member_nm="'other'", email="NULL"))
def update_member(t):
    return R.update_member(t, "M3", {"member_nm": "other", "email": None, "member_status": "never"})


@query("SELECT * FROM member WHERE member_id <> 'M3'")
def delete_member(t):
    return R.delete_member(t, "M3")


@query(_with("member", "member_id", "M4", member_status="'9'"))
def update_member_status(t):
    return R.update_member_status(t, "M4", "9")


@query("SELECT * FROM overdue UNION ALL SELECT 'X', 'L1', DATE '1998-01-01', 4, NULL, '1'")
def insert_overdue(t):
    row = _row(t["loan"], "overdue_id string, loan_id string, overdue_start_date string, overdue_days int, sanction_status string", "X", "L1", "1998-01-01", 4, "1")
    return R.insert_overdue(t, row.withColumn("overdue_start_date", F.col("overdue_start_date").cast("date")))


@query(_with("overdue", "overdue_id", "O22", release_date="DATE '1998-06-02'", sanction_status="'2'"))
def update_release(t):
    return R.update_release(t, "O22", "1998-06-02", "2")


@query(_with("overdue", "overdue_id", "O22", overdue_days="77"))
def update_overdue_days(t):
    return R.update_overdue_days(t, "O22", 77)


# Reports


@query("SELECT count(*) AS cnt FROM loan WHERE return_date IS NULL")
def active_loan_count(t):
    return R.active_loan_count(t)


@query("SELECT loan_status, return_date IS NULL AS not_returned, count(*) AS cnt FROM loan GROUP BY 1, 2")
def status_matrix(t):
    return R.status_matrix(t)


@query("SELECT book_id, count(*) AS cnt FROM loan WHERE loan_status = '1' GROUP BY 1 HAVING count(*) > 1")
def duplicate_active_loans(t):
    return R.duplicate_active_loans(t)


@query("SELECT book_id, cnt, title FROM (SELECT book_id, count(*) AS cnt FROM loan GROUP BY 1) JOIN book USING (book_id) ORDER BY cnt DESC, book_id LIMIT 10")
def top_books(t):
    return R.top_books(t)


@query(f"SELECT m.member_id AS memberId, member_nm AS memberNm, overdue_days AS overdueDays, overdue_start_date AS overdueStartDate {_OVERDUE_FROM} JOIN book b ON l.book_id = b.book_id WHERE strftime(overdue_start_date, '%Y-%m') = '1998-06'")
def overdue_in_month(t):
    return R.overdue_in_month(t, "1998-06")


@query(f"{_MEMBER} WHERE member_status = '2'")
def suspended_members(t):
    return R.suspended_members(t)


# State transitions

_CODES = "codes AS (SELECT q.member_id, CASE WHEN m.member_status IS NULL THEN 'MEMBER_NOT_FOUND' WHEN m.member_status <> '1' THEN 'OVERDUE_MEMBER' WHEN coalesce(n, 0) >= 5 THEN 'LOAN_LIMIT_EXCEEDED' END AS code FROM (SELECT member_id FROM member UNION ALL SELECT 'M-1') q LEFT JOIN member m USING (member_id) LEFT JOIN (SELECT member_id, count(*) AS n FROM loan WHERE loan_status = '1' GROUP BY 1) USING (member_id))"
_LEND = f"{_CODES}, lend AS (SELECT 'B'||(CAST(substr(member_id, 2) AS BIGINT) % 150) AS book_id, member_id, code FROM codes WHERE member_id = 'M-1' OR CAST(substr(member_id, 2) AS BIGINT) % 5 = 0)"
_BACK = f"asked AS (SELECT loan_id FROM loan WHERE loan_status <> '2' AND CAST(substr(loan_id, 2) AS BIGINT) % 5 = 0 UNION ALL SELECT 'L-1'), done AS (SELECT * FROM asked JOIN loan USING (loan_id)), late AS (SELECT * FROM done WHERE due_date <= DATE '{AS_OF}'), really AS (SELECT * FROM done WHERE due_date < DATE '{AS_OF}')"
_LATE = f"late AS (SELECT * FROM loan WHERE loan_status = '1' AND due_date < DATE '{AS_OF}' AND loan_id NOT IN (SELECT loan_id FROM overdue))"
_DAYS = f"CAST(greatest(date_diff('day', {{0}}, DATE '{AS_OF}'), 0) AS INTEGER)"


def _members(t):
    return t["member"].select("member_id").union(_row(t["member"], "member_id string", "M-1"))


def _asked(t, name: str, key: str, missing: str, condition: str) -> DataFrame:
    return t[name].where(condition).select(key).union(_row(t[name], f"{key} string", missing))


@query("SELECT member_id, code IS NULL AS ok, code FROM codes", _CODES)
def loanable(t):
    return L.loanable(t, _members(t))


def _lend(t, strict=False):
    number = F.substring("member_id", 2, 99).cast("long")
    asked = _members(t).where((number < 0) | (number % 5 == 0)).select(F.concat(F.lit("B"), F.when(number < 0, number).otherwise(number % 150)).alias("book_id"), "member_id")
    return L.insert_loan(t, asked, AS_OF, NOW, strict=strict)


@query("SELECT book_id, member_id, code IS NULL AS ok, code, code IS NULL AS made FROM lend", _LEND)
def lend_results(t):
    return _lend(t).results.select("book_id", "member_id", "ok", "code", F.col("loan_id").isNotNull().alias("made"))


@query("SELECT book_id, member_id, code IS NULL AS ok, code FROM (SELECT l.book_id, member_id, coalesce(code, CASE WHEN loan_yn IS NULL THEN 'BOOK_NOT_FOUND' WHEN loan_yn <> 'Y' THEN 'BOOK_NOT_AVAILABLE' END) AS code FROM lend l LEFT JOIN book USING (book_id))", _LEND)
def lend_results_strict(t):
    return _lend(t, strict=True).results.select("book_id", "member_id", "ok", "code")


@query(f"SELECT book_id, member_id, loan_date, due_date, return_date, loan_status, extend_cnt FROM loan UNION ALL SELECT book_id, member_id, DATE '{AS_OF}', DATE '{AS_OF}' + 14, NULL, '1', 0 FROM lend WHERE code IS NULL", _LEND)
def lend_loans(t):
    return _lend(t).tables["loan"].drop("loan_id")


@query("SELECT book_id, CASE WHEN book_id IN (SELECT book_id FROM lend WHERE code IS NULL) THEN 'N' ELSE loan_yn END AS loan_yn FROM book", _LEND)
def lend_books(t):
    return _lend(t).tables["book"].select("book_id", "loan_yn")


@query("SELECT process_type, processor, process_datetime, count(*) AS cnt FROM (SELECT process_type, processor, process_datetime FROM loan_hist UNION ALL SELECT '1', 'SYSTEM', TIMESTAMP '" + NOW + "' FROM lend WHERE code IS NULL) GROUP BY ALL", _LEND)
def lend_history(t):
    return _lend(t).tables["loan_hist"].groupBy("process_type", "processor", "process_datetime").agg(F.count(F.lit(1)).alias("cnt"))


def _return(t, strict=False):
    return L.update_return(t, _asked(t, "loan", "loan_id", "L-1", "loan_status <> '2' AND CAST(substr(loan_id, 2) AS BIGINT) % 5 = 0"), AS_OF, NOW, strict=strict)


@query("SELECT loan_id, book_id IS NOT NULL AS ok, CASE WHEN book_id IS NULL THEN 'LOAN_NOT_FOUND' END AS code FROM asked LEFT JOIN loan USING (loan_id)", _BACK)
def return_results(t):
    return _return(t).results


@query(f"SELECT * REPLACE (CASE WHEN loan_id IN (SELECT loan_id FROM done) THEN DATE '{AS_OF}' ELSE return_date END AS return_date, CASE WHEN loan_id IN (SELECT loan_id FROM done) THEN '2' ELSE loan_status END AS loan_status) FROM loan", _BACK)
def return_loans(t):
    return _return(t).tables["loan"]


@query(f"SELECT loan_id, overdue_start_date, overdue_days, release_date, sanction_status FROM overdue UNION ALL SELECT loan_id, due_date + 1, {_DAYS.format('due_date')}, NULL, '1' FROM late", _BACK)
def return_overdues(t):
    return _return(t).tables["overdue"].drop("overdue_id")


@query(f"SELECT loan_id, overdue_start_date, overdue_days, release_date, sanction_status FROM overdue UNION ALL SELECT loan_id, due_date + 1, {_DAYS.format('due_date')}, NULL, '1' FROM really WHERE loan_id NOT IN (SELECT loan_id FROM overdue)", _BACK)
def return_overdues_strict(t):
    return _return(t, strict=True).tables["overdue"].drop("overdue_id")


@query("SELECT member_id, CASE WHEN member_id IN (SELECT member_id FROM late) THEN '2' ELSE member_status END AS member_status FROM member", _BACK)
def return_members(t):
    return _return(t).tables["member"].select("member_id", "member_status")


def _extend(t):
    return L.update_extend(t, _asked(t, "loan", "loan_id", "L-1", "CAST(substr(loan_id, 2) AS BIGINT) % 3 = 0"), NOW)


@query("SELECT loan_id, CASE WHEN book_id IS NULL THEN 'LOAN_NOT_FOUND' WHEN loan_status <> '1' THEN 'NOT_EXTENDABLE' END AS code, loan_status = '1' AND book_id IS NOT NULL AS ok FROM (SELECT loan_id FROM loan WHERE CAST(substr(loan_id, 2) AS BIGINT) % 3 = 0 UNION ALL SELECT 'L-1') LEFT JOIN loan USING (loan_id)")
def extend_results(t):
    return _extend(t).results.select("loan_id", "code", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("SELECT * REPLACE (CASE WHEN loan_status = '1' AND CAST(substr(loan_id, 2) AS BIGINT) % 3 = 0 THEN due_date + 7 ELSE due_date END AS due_date, CASE WHEN loan_status = '1' AND CAST(substr(loan_id, 2) AS BIGINT) % 3 = 0 THEN extend_cnt + 1 ELSE extend_cnt END AS extend_cnt) FROM loan")
def extend_loans(t):
    return _extend(t).tables["loan"]


def _release(t, strict=False):
    return L.update_release(t, _asked(t, "overdue", "overdue_id", "O-1", "CAST(substr(overdue_id, 2) AS BIGINT) % 2 = 0"), AS_OF, strict=strict)


_FREED = "freed AS (SELECT o.*, member_id FROM overdue o JOIN loan USING (loan_id) WHERE CAST(substr(overdue_id, 2) AS BIGINT) % 2 = 0 AND sanction_status = '1'), still AS (SELECT member_id FROM overdue o JOIN loan USING (loan_id) WHERE sanction_status = '1' AND overdue_id NOT IN (SELECT overdue_id FROM freed))"


@query("SELECT overdue_id, code IS NULL AS ok, code FROM (SELECT overdue_id, CASE WHEN sanction_status IS NULL THEN 'OVERDUE_NOT_FOUND' WHEN sanction_status = '2' THEN 'ALREADY_RELEASED' END AS code FROM (SELECT overdue_id FROM overdue WHERE CAST(substr(overdue_id, 2) AS BIGINT) % 2 = 0 UNION ALL SELECT 'O-1') LEFT JOIN overdue USING (overdue_id))")
def release_results(t):
    return _release(t).results


@query(f"SELECT * REPLACE (CASE WHEN overdue_id IN (SELECT overdue_id FROM freed) THEN DATE '{AS_OF}' ELSE release_date END AS release_date, CASE WHEN overdue_id IN (SELECT overdue_id FROM freed) THEN '2' ELSE sanction_status END AS sanction_status) FROM overdue", _FREED)
def release_overdues(t):
    return _release(t).tables["overdue"]


@query("SELECT member_id, CASE WHEN member_id IN (SELECT member_id FROM freed) THEN '1' ELSE member_status END AS member_status FROM member", _FREED)
def release_members(t):
    return _release(t).tables["member"].select("member_id", "member_status")


@query("SELECT member_id, CASE WHEN member_id IN (SELECT member_id FROM freed) AND member_id NOT IN (SELECT member_id FROM still) THEN '1' ELSE member_status END AS member_status FROM member", _FREED)
def release_members_strict(t):
    return _release(t, strict=True).tables["member"].select("member_id", "member_status")


_REFRESHED = f"afterwards AS (SELECT loan_id, overdue_start_date, CASE WHEN sanction_status = '1' THEN {_DAYS.format('overdue_start_date')} + 1 ELSE overdue_days END AS overdue_days, sanction_status FROM (SELECT loan_id, overdue_start_date, overdue_days, sanction_status FROM overdue UNION ALL SELECT loan_id, due_date + 1, 0, '1' FROM late))"


@query("SELECT * FROM afterwards", f"{_LATE}, {_REFRESHED}")
def refresh_overdues(t):
    return L.refresh_overdue(t, AS_OF).tables["overdue"].select("loan_id", "overdue_start_date", "overdue_days", "sanction_status")


@query("SELECT loan_id, CASE WHEN loan_id IN (SELECT loan_id FROM late) THEN '3' ELSE loan_status END AS loan_status FROM loan", _LATE)
def refresh_loans(t):
    return L.refresh_overdue(t, AS_OF).tables["loan"].select("loan_id", "loan_status")


@query("SELECT member_id, CASE WHEN member_id IN (SELECT member_id FROM late) THEN '2' ELSE member_status END AS member_status FROM member", _LATE)
def refresh_members(t):
    return L.refresh_overdue(t, AS_OF).tables["member"].select("member_id", "member_status")


@query("SELECT (SELECT count(*) FROM afterwards WHERE sanction_status = '1') + (SELECT count(*) FROM late) AS cnt", f"{_LATE}, {_REFRESHED}")
def refresh_count(t):
    return L.refresh_overdue(t, AS_OF).counts["updated"]


_CHANGED = "asked AS (SELECT book_id, 'T'||book_id AS title FROM book WHERE CAST(substr(book_id, 2) AS BIGINT) % 9 = 0 UNION ALL SELECT 'B-1', 'TB-1')"


def _changed_books(t):
    return _asked(t, "book", "book_id", "B-1", "CAST(substr(book_id, 2) AS BIGINT) % 9 = 0").withColumn("title", F.concat(F.lit("T"), "book_id"))


@query("SELECT book_id, coalesce(a.title, b.title) AS title, loan_yn, reg_date FROM book b LEFT JOIN asked a USING (book_id)", _CHANGED)
def change_books(t):
    return L.update_books(t, _changed_books(t)).tables["book"].select("book_id", "title", "loan_yn", "reg_date")


@query("SELECT asked.book_id, b.book_id IS NOT NULL AS ok, CASE WHEN b.book_id IS NULL THEN 'BOOK_NOT_FOUND' END AS code FROM asked LEFT JOIN book b ON b.book_id = asked.book_id", _CHANGED)
def change_books_results(t):
    return L.update_books(t, _changed_books(t)).results


@query("SELECT * FROM book WHERE book_id NOT IN (SELECT book_id FROM asked)", _CHANGED)
def remove_books(t):
    return L.delete_books(t, _changed_books(t)).tables["book"]


@query("SELECT * FROM member WHERE CAST(substr(member_id, 2) AS BIGINT) % 9 > 0")
def remove_members(t):
    return L.delete_members(t, _asked(t, "member", "member_id", "M-1", "CAST(substr(member_id, 2) AS BIGINT) % 9 = 0")).tables["member"]


@query("SELECT * REPLACE (CASE WHEN CAST(substr(member_id, 2) AS BIGINT) % 9 = 0 THEN 'none' ELSE phone END AS phone) FROM member")
def change_members(t):
    asked = _asked(t, "member", "member_id", "M-1", "CAST(substr(member_id, 2) AS BIGINT) % 9 = 0").withColumn("phone", F.lit("none"))
    return L.update_members(t, asked).tables["member"]


@query("SELECT member_id, member_nm IS NOT NULL AS found, CASE WHEN member_nm IS NULL THEN 'MEMBER_NOT_FOUND' END AS code, member_nm FROM (SELECT member_id FROM member UNION ALL SELECT 'M-1') LEFT JOIN member USING (member_id)")
def lookup_members(t):
    return L.lookup(t["member"], "member_id", _members(t), "MEMBER_NOT_FOUND").select("member_id", "found", "code", "member_nm")


@query("SELECT member_id, CASE WHEN code IS NOT NULL THEN 400 END AS status, code FROM codes", _CODES)
def error_responses(t):
    return L.loanable(t, _members(t)).select("member_id", F.expr("code").alias("c")).withColumn("e", L.error_response(F.col("c"))).select("member_id", "e.status", F.col("c").alias("code"))


@query(f"{_MEMBER} WHERE member_status = '1' ORDER BY join_date DESC, member_id LIMIT 5 OFFSET 10")
def page_rows(t):
    return list_page(t, R.member_list, R.member_count, page_index=3, page_size=5, status="1")[0]


@query("SELECT n AS total, 3 AS page_index, 5 AS page_size, CAST(ceil(n / 5.0) AS INTEGER) AS total_pages, 1 AS first_page, least(10, CAST(ceil(n / 5.0) AS INTEGER)) AS last_page, 10 AS first_index FROM (SELECT count(*) AS n FROM member WHERE member_status = '1')")
def page_numbers(t):
    return list_page(t, R.member_list, R.member_count, page_index=3, page_size=5, status="1")[1]


# Batches in order, with members and books that repeat

_LINE = """asked AS (SELECT o_orderkey AS nth, 'B'||(o_orderkey % 2500) AS book_id, 'M'||(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE o_custkey * 13 % 1600 END) AS member_id FROM orders),
known AS (SELECT a.*, member_status, loan_yn, CASE WHEN member_status = '1' THEN greatest(5 - coalesce(n, 0), 0) ELSE 0 END AS room FROM asked a LEFT JOIN member USING (member_id)
LEFT JOIN (SELECT member_id, count(*) AS n FROM loan WHERE loan_status = '1' GROUP BY 1) USING (member_id) LEFT JOIN book USING (book_id))"""
_FIRST_RULE = "CASE WHEN member_status IS NULL THEN 'MEMBER_NOT_FOUND' WHEN member_status <> '1' THEN 'OVERDUE_MEMBER' WHEN {0} >= room THEN 'LOAN_LIMIT_EXCEEDED' {1} END"


def _line(t, strict):
    orders = t["loan"].select(F.substring("loan_id", 2, 99).cast("long").alias("nth"), F.substring("member_id", 2, 99).cast("long").alias("c"))
    member = F.when(F.col("nth") % 3 == 0, F.col("nth") % 4).otherwise(F.col("c") * 13 % 1600)
    asked = orders.select("nth", F.concat(F.lit("B"), F.col("nth") % 2500).alias("book_id"), F.concat(F.lit("M"), member).alias("member_id"))
    return sequences.lend(t, asked, AS_OF, NOW, strict=strict).results.select("nth", "book_id", "member_id", "ok", "code")


@query(f"SELECT nth, book_id, member_id, code IS NULL AS ok, code FROM (SELECT *, {_FIRST_RULE.format('row_number() OVER (PARTITION BY member_id ORDER BY nth) - 1', '')} AS code FROM known)", _LINE)
def sequence_lend(t):
    return _line(t, False)


_HAD = "(SELECT count(*) FROM won w WHERE w.{0} = known.{0} AND w.nth < known.nth)"
_BOOK_RULES = f"WHEN loan_yn IS NULL THEN 'BOOK_NOT_FOUND' WHEN loan_yn <> 'Y' OR {_HAD.format('book_id')} > 0 THEN 'BOOK_NOT_AVAILABLE'"
_STRICT = f"SELECT known.*, {_FIRST_RULE.format(_HAD.format('member_id'), _BOOK_RULES)} AS code FROM known"


@query(f"SELECT nth, book_id, member_id, code IS NULL AS ok, code FROM ({_STRICT})", f"""{_LINE},
able AS MATERIALIZED (SELECT nth, book_id, member_id, room FROM known WHERE room > 0 AND loan_yn = 'Y'),
step AS (SELECT CAST(-1 AS BIGINT) AS nth, NULL::VARCHAR AS book_id, NULL::VARCHAR AS member_id, []::VARCHAR[] AS books, []::VARCHAR[] AS members
UNION ALL SELECT a.nth, a.book_id, a.member_id, list_append(books, a.book_id), list_append(members, a.member_id) FROM step s JOIN able a ON a.nth > s.nth AND NOT list_contains(books, a.book_id)
AND len(list_filter(members, lambda x: x = a.member_id)) < a.room QUALIFY row_number() OVER (ORDER BY a.nth) = 1),
won AS (SELECT nth, book_id, member_id FROM step WHERE nth >= 0)""")
def sequence_lend_strict(t):
    return _line(t, True)


ORACLES["lending_sequence_lend_strict"] = ORACLES["lending_sequence_lend_strict"].replace("WITH ", "WITH RECURSIVE ", 1)
