"""Lists, lookups, counts and row changes over the lending tables (snake_case in, camelCase out).

Every operator takes a dictionary of tables. Optional predicates count only if they are neither null nor empty. Lists
order by one date, newest first, with the key as tie-break, and keep `count` rows from `offset`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.functions.scalar import contains_ci, surrogate_id

Tables = dict[str, DataFrame]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in camelCase, or under the name after AS."""
    parts = (c.partition(" AS ") for c in columns)
    return df.select(*(F.col(c).alias(name or camel(c.split(".")[-1])) for c, _, name in parts))


def where_given(df: DataFrame, *predicates: tuple[object, Column]) -> DataFrame:
    """Rows for which every predicate holds whose value was given."""
    used = [p for value, p in predicates if value is not None and value != ""]
    return df.where(reduce(Column.__and__, used)) if used else df


def page(df: DataFrame, order: str, key: str, offset: int = 0, count: int = 10) -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(key)).offset(offset).limit(count)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cnt"))


# Books

BOOK = ("book_id", "isbn", "title", "author", "publisher", "publish_date", "b.category_cd", "category_nm", "location", "loan_yn", "reg_date")


def _books(t: Tables) -> DataFrame:
    return t["book"].alias("b").join(t["category"].alias("c"), F.col("b.category_cd") == F.col("c.category_cd"), "left")


def _book_filter(df: DataFrame, title, author, category_cd, loan_yn) -> DataFrame:
    return where_given(df, (title, contains_ci("title", title or "")), (author, contains_ci("author", author or "")), (category_cd, F.col("b.category_cd") == category_cd), (loan_yn, F.col("loan_yn") == loan_yn))


def book_list(t: Tables, title=None, author=None, category_cd=None, loan_yn=None, offset: int = 0, count: int = 10) -> DataFrame:
    return _named(page(_book_filter(_books(t), title, author, category_cd, loan_yn), "reg_date", "book_id", offset, count), *BOOK)


def book_count(t: Tables, title=None, author=None, category_cd=None, loan_yn=None) -> DataFrame:
    return _count(_book_filter(t["book"].alias("b"), title, author, category_cd, loan_yn))


def book(t: Tables, book_id: str) -> DataFrame:
    return _named(_books(t).where(F.col("book_id") == book_id), *BOOK)


def category_list(t: Tables) -> DataFrame:
    return _named(t["category"].orderBy("category_cd"), "category_cd", "category_nm", "upper_category_cd")


# Loans

LOAN = ("loan_id", "l.book_id", "l.member_id", "loan_date", "due_date", "return_date", "loan_status", "extend_cnt", "title AS bookTitle", "member_nm")


def _loans(t: Tables) -> DataFrame:
    return t["loan"].alias("l").join(t["book"].alias("b"), F.col("l.book_id") == F.col("b.book_id")).join(t["member"].alias("m"), F.col("l.member_id") == F.col("m.member_id"))


def _loan_filter(df: DataFrame, member_id, book_id, loan_status) -> DataFrame:
    return where_given(df, (member_id, F.col("l.member_id") == member_id), (book_id, F.col("l.book_id") == book_id), (loan_status, F.col("loan_status") == loan_status))


def loan_list(t: Tables, member_id=None, book_id=None, loan_status=None, offset: int = 0, count: int = 10) -> DataFrame:
    return _named(page(_loan_filter(_loans(t), member_id, book_id, loan_status), "loan_date", "loan_id", offset, count), *LOAN)


def loan_count(t: Tables, member_id=None, book_id=None, loan_status=None) -> DataFrame:
    return _count(_loan_filter(t["loan"].alias("l"), member_id, book_id, loan_status))


def loan(t: Tables, loan_id: str) -> DataFrame:
    return _named(_loans(t).where(F.col("loan_id") == loan_id), *LOAN)


def loan_count_by_member(t: Tables, member_id: str, loan_status: str) -> DataFrame:
    return _count(t["loan"].where((F.col("member_id") == member_id) & (F.col("loan_status") == loan_status)))


# Members

MEMBER = ("member_id", "member_nm", "birth_date", "phone", "email", "member_status", "join_date")


def _member_filter(df: DataFrame, name, status) -> DataFrame:
    return where_given(df, (name, contains_ci("member_nm", name or "")), (status, F.col("member_status") == status))


def member_list(t: Tables, name=None, status=None, offset: int = 0, count: int = 10) -> DataFrame:
    return _named(page(_member_filter(t["member"], name, status), "join_date", "member_id", offset, count), *MEMBER)


def member_count(t: Tables, name=None, status=None) -> DataFrame:
    return _count(_member_filter(t["member"], name, status))


def member(t: Tables, member_id: str) -> DataFrame:
    return _named(t["member"].where(F.col("member_id") == member_id), *MEMBER)


# Overdue

OVERDUE = ("overdue_id", "o.loan_id", "overdue_start_date", "overdue_days", "release_date", "sanction_status", "m.member_id", "member_nm", "title AS bookTitle")


def _overdue_members(t: Tables) -> DataFrame:
    return t["overdue"].alias("o").join(t["loan"].alias("l"), F.col("o.loan_id") == F.col("l.loan_id")).join(t["member"].alias("m"), F.col("l.member_id") == F.col("m.member_id"))


def _overdues(t: Tables) -> DataFrame:
    return _overdue_members(t).join(t["book"].alias("b"), F.col("l.book_id") == F.col("b.book_id"))


def _overdue_filter(df: DataFrame, member_id, status) -> DataFrame:
    return where_given(df, (member_id, F.col("m.member_id") == member_id), (status, F.col("sanction_status") == status))


def overdue_list(t: Tables, member_id=None, sanction_status=None, offset: int = 0, count: int = 10) -> DataFrame:
    return _named(page(_overdue_filter(_overdues(t), member_id, sanction_status), "overdue_start_date", "overdue_id", offset, count), *OVERDUE)


def overdue_count(t: Tables, member_id=None, sanction_status=None) -> DataFrame:
    """Books are not joined: every loan has one."""
    return _count(_overdue_filter(_overdue_members(t), member_id, sanction_status))


def overdue(t: Tables, overdue_id: str) -> DataFrame:
    return _named(_overdues(t).where(F.col("overdue_id") == overdue_id), *OVERDUE)


def overdue_by_member(t: Tables, member_id: str) -> DataFrame:
    return _named(_overdues(t).where(F.col("m.member_id") == member_id).orderBy(F.col("overdue_start_date").desc(), "overdue_id"), *OVERDUE)


def overdue_targets(t: Tables, as_of: str) -> DataFrame:
    """Loans still out whose due date has passed and that have no overdue row."""
    late = t["loan"].where((F.col("loan_status") == "1") & (F.col("due_date") < F.lit(as_of).cast("date")))
    return _named(late.join(t["overdue"], "loan_id", "left_anti"), "loan_id", "book_id", "member_id", "loan_date", "due_date")


def active_overdues(t: Tables) -> DataFrame:
    return _named(t["overdue"].where(F.col("sanction_status") == "1"), "overdue_id", "loan_id", "overdue_start_date", "overdue_days", "sanction_status")


# Row changes: tables are immutable, so each returns the table as it is afterwards.


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the new rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def deleted(table: DataFrame, key: str, *ids: str) -> DataFrame:
    return table.where(~F.col(key).isin(*ids) | F.col(key).isNull())


def updated(table: DataFrame, key: str, key_value: str, changes: dict[str, object]) -> DataFrame:
    hit = F.col(key).eqNullSafe(key_value)
    return table.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def merged(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Rows with a change take its non-null columns; the others stay."""
    own = [c for c in changes.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), key, "left")
    return joined.select(*(F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in own else F.col(c) for c in table.columns))


#: What an update of a book or a member may change.
BOOK_CHANGES = ("isbn", "title", "author", "publisher", "publish_date", "category_cd", "location")
MEMBER_CHANGES = ("member_nm", "birth_date", "phone", "email")


def insert_book(t: Tables, row: DataFrame, now: str) -> DataFrame:
    return inserted(t["book"], row.withColumn("reg_date", F.lit(now).cast("timestamp_ntz")))


def update_book(t: Tables, book_id: str, changes: dict[str, object]) -> DataFrame:
    """Registration date and availability are not changed here."""
    return updated(t["book"], "book_id", book_id, {k: v for k, v in changes.items() if k in BOOK_CHANGES})


def delete_book(t: Tables, book_id: str) -> DataFrame:
    return deleted(t["book"], "book_id", book_id)


def update_loan_yn(t: Tables, book_id: str, loan_yn: str) -> DataFrame:
    return updated(t["book"], "book_id", book_id, {"loan_yn": loan_yn})


def insert_loan(t: Tables, row: DataFrame) -> DataFrame:
    return inserted(t["loan"], row.drop("return_date"))


def update_return(t: Tables, loan_id: str, return_date: str, status: str) -> DataFrame:
    return updated(t["loan"], "loan_id", loan_id, {"return_date": return_date, "loan_status": status})


def update_extend(t: Tables, loan_id: str, due_date: str, extend_cnt: int) -> DataFrame:
    return updated(t["loan"], "loan_id", loan_id, {"due_date": due_date, "extend_cnt": extend_cnt})


def update_loan_status(t: Tables, loan_id: str, status: str) -> DataFrame:
    return updated(t["loan"], "loan_id", loan_id, {"loan_status": status})


def insert_loan_hist(t: Tables, rows: DataFrame, now: str) -> DataFrame:
    return inserted(t["loan_hist"], rows.withColumn("process_datetime", F.lit(now).cast("timestamp_ntz")))


def insert_member(t: Tables, row: DataFrame, now: str) -> DataFrame:
    return inserted(t["member"], row.withColumn("join_date", F.lit(now).cast("timestamp_ntz").cast("date")))


def update_member(t: Tables, member_id: str, changes: dict[str, object]) -> DataFrame:
    return updated(t["member"], "member_id", member_id, {k: v for k, v in changes.items() if k in MEMBER_CHANGES})


def delete_member(t: Tables, member_id: str) -> DataFrame:
    return deleted(t["member"], "member_id", member_id)


def update_member_status(t: Tables, member_id: str, status: str) -> DataFrame:
    return updated(t["member"], "member_id", member_id, {"member_status": status})


def insert_overdue(t: Tables, rows: DataFrame) -> DataFrame:
    return inserted(t["overdue"], rows.drop("release_date"))


def update_release(t: Tables, overdue_id: str, release_date: str, status: str) -> DataFrame:
    return updated(t["overdue"], "overdue_id", overdue_id, {"release_date": release_date, "sanction_status": status})


def update_overdue_days(t: Tables, overdue_id: str, days: int) -> DataFrame:
    return updated(t["overdue"], "overdue_id", overdue_id, {"overdue_days": days})


# Reports


def active_loan_count(t: Tables) -> DataFrame:
    return _count(t["loan"].where(F.col("return_date").isNull()))


def status_matrix(t: Tables) -> DataFrame:
    return t["loan"].groupBy("loan_status", F.col("return_date").isNull().alias("not_returned")).agg(F.count(F.lit(1)).alias("cnt"))


def duplicate_active_loans(t: Tables) -> DataFrame:
    return t["loan"].where(F.col("loan_status") == "1").groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def top_books(t: Tables, count: int = 10) -> DataFrame:
    return t["loan"].groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt")).join(t["book"].select("book_id", "title"), "book_id").orderBy(F.desc("cnt"), "book_id").limit(count)


def overdue_in_month(t: Tables, month: str) -> DataFrame:
    """Members and days of the overdue rows that start in a month yyyy-MM."""
    first = F.lit(f"{month}-01").cast("date")
    rows = _overdues(t).where((F.col("overdue_start_date") >= first) & (F.col("overdue_start_date") < F.add_months(first, 1)))
    return _named(rows, "m.member_id", "member_nm", "overdue_days", "overdue_start_date")


def suspended_members(t: Tables) -> DataFrame:
    return _named(t["member"].where(F.col("member_status") == "2"), *MEMBER)


def new_id(prefix: str, *key: str) -> Column:
    return surrogate_id(prefix, *key)
