from datetime import date

import pytest

from quarryflow.operators import relational as R

from .library import AS_OF, NOW, tables


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in tables(spark).items()}


def ids(df, c):
    return [r[c] for r in df.collect()]


def test_book_list_orders_by_date_then_key_and_left_joins(t):
    df = R.book_list(t)
    assert ids(df, "bookId") == ["B4", "B1", "B2", "B3", "B5"]
    assert df.columns == ["bookId", "isbn", "title", "author", "publisher", "publishDate", "categoryCd", "categoryNm", "location", "loanYn", "regDate"]
    assert {r["bookId"]: r["categoryNm"] for r in df.collect()}["B4"] is None


def test_predicates_count_only_if_given(t):
    assert ids(R.book_list(t, title="DEEP"), "bookId") == ["B1", "B3"]
    assert ids(R.book_list(t, title="", author="ANN", loan_yn="N"), "bookId") == ["B1"]
    assert ids(R.book_list(t, title="%sure_thing"), "bookId") == ["B2"]
    assert ids(R.book_list(t, offset=1, count=2), "bookId") == ["B1", "B2"]
    assert R.book_count(t, title="deep").first()["cnt"] == 2 and R.book_count(t).first()["cnt"] == 5


def test_lookups(t):
    assert R.book(t, "B2").first()["categoryNm"] == "logic" and R.book(t, "none").isEmpty()
    assert ids(R.category_list(t), "categoryCd") == ["000", "100", "110"]
    assert R.member(t, "M9").isEmpty() and R.member(t, "M1").first()["memberNm"] == "Kim A"
    assert R.loan(t, "L1").first()["bookTitle"] == "Deep Sea"
    assert R.overdue(t, "O1").first()["memberId"] == "M2"


def test_lists_and_counts(t):
    assert ids(R.loan_list(t, member_id="M1"), "loanId") == ["L5", "L1"]
    assert R.loan_count(t, loan_status="1").first()["cnt"] == 12
    assert R.loan_count_by_member(t, "M4", "1").first()["cnt"] == 5
    assert ids(R.member_list(t, name="kim"), "memberId") == ["M1", "M2"]
    assert R.member_count(t, status="1").first()["cnt"] == 3
    assert ids(R.overdue_list(t), "overdueId") == ["O3", "O1", "O2"]
    assert R.overdue_count(t, sanction_status="1").first()["cnt"] == 2
    assert ids(R.overdue_by_member(t, "M1"), "overdueId") == ["O3"]


def test_targets_are_late_on_the_day_after_the_due_day_and_without_a_row(t):
    assert ids(R.overdue_targets(t, AS_OF), "loanId") == ["L1"]
    assert sorted(ids(R.overdue_targets(t, "2026-03-21"), "loanId")) == ["L1", "L2"]
    assert ids(R.active_overdues(t), "overdueId") == ["O1", "O2"]


def test_row_changes(t, spark):
    new = spark.createDataFrame([("B9", "9", "T", "A")], "book_id string, isbn string, title string, author string")
    row = R.insert_book(t, new, NOW).where("book_id = 'B9'").first()
    assert row["publisher"] is None and str(row["reg_date"]) == NOW
    assert R.update_book(t, "B1", {"title": "x", "loan_yn": "Y"}).where("book_id = 'B1'").first()[2:9:6] == ("x", "N")
    assert R.delete_book(t, "B1").count() == 4
    assert R.update_loan_yn(t, "B1", "Y").where("loan_yn = 'N'").count() == 1
    assert R.update_return(t, "L1", AS_OF, "2").where("loan_id = 'L1'").first()["return_date"] == date(2026, 3, 20)
    assert R.update_extend(t, "L1", "2026-04-01", 1).where("loan_id = 'L1'").first()["extend_cnt"] == 1
    assert R.update_loan_status(t, "L1", "3").where("loan_status = '3'").count() == 2
    assert R.insert_member(t, spark.createDataFrame([("M9", "N")], "member_id string, member_nm string"), NOW).where("member_id = 'M9'").first()["join_date"] == date(2026, 3, 20)
    assert R.update_member(t, "M1", {"phone": "7", "member_status": "9"}).where("member_id = 'M1'").first()["member_status"] == "1"
    assert R.delete_member(t, "M1").count() == 4
    assert R.update_member_status(t, "M1", "2").where("member_status = '2'").count() == 2
    assert R.update_release(t, "O1", AS_OF, "2").where("sanction_status = '2'").count() == 2
    assert R.update_overdue_days(t, "O1", 9).where("overdue_id = 'O1'").first()["overdue_days"] == 9


def test_reports(t):
    assert R.active_loan_count(t).first()["cnt"] == 13
    assert {(r[0], r[1]): r[2] for r in R.status_matrix(t).collect()} == {("1", True): 12, ("2", False): 1, ("3", True): 1}
    assert {r[0]: r[1] for r in R.duplicate_active_loans(t).collect()} == {"B5": 10}
    assert [(r["book_id"], r["cnt"]) for r in R.top_books(t, 2).collect()] == [("B5", 10), ("B1", 1)]
    assert [r["memberId"] for r in R.overdue_in_month(t, "2026-02").collect()] == ["M2"]
    assert ids(R.suspended_members(t), "memberId") == ["M2"]
