"""State transitions of the lending business as pure functions from tables to tables.

Every transition takes the tables and a frame of requests, so a batch costs a few joins. The default keeps the system's
observable rules; strict=True closes the gaps named at each function. Dates are parameters: `as_of` is the day, `now`
the moment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.functions.scalar import MOST_LOANS, default_if_blank, due_date, extended_due_date, overdue_days, surrogate_id

from . import relational as R

Tables = dict[str, DataFrame]


@dataclass
class Outcome:
    """Tables after the transition, and a row for each request: ok, code."""

    tables: Tables
    results: DataFrame
    counts: dict[str, DataFrame] = field(default_factory=dict)


def _date(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def loanable(t: Tables, members: DataFrame) -> DataFrame:
    """member_id, ok, code. The first rule that fails names the code: unknown member, status other than normal, too many
    loans. Only loans of status 1 count; overdue ones (3) do not."""
    out = t["loan"].where(F.col("loan_status") == "1").groupBy("member_id").agg(F.count(F.lit(1)).alias("out"))
    joined = members.select("member_id").join(t["member"].select("member_id", "member_status"), "member_id", "left").join(out, "member_id", "left")
    code = F.when(F.col("member_status").isNull(), "MEMBER_NOT_FOUND").when(F.col("member_status") != "1", "OVERDUE_MEMBER").when(F.coalesce("out", F.lit(0)) >= MOST_LOANS, "LOAN_LIMIT_EXCEEDED")
    return joined.select("member_id", code.isNull().alias("ok"), code.alias("code"))


def insert_loan(t: Tables, requests: DataFrame, as_of: str, now: str, processor: str = "SYSTEM", strict: bool = False) -> Outcome:
    """requests: book_id, member_id, one a member at a time. Without strict a book that is out already can be lent again;
    strict refuses it with BOOK_NOT_AVAILABLE (an unknown book with BOOK_NOT_FOUND)."""
    checked = requests.join(loanable(t, requests.select("member_id").distinct()), "member_id")
    if strict:
        checked = checked.join(t["book"].select("book_id", "loan_yn"), "book_id", "left")
        code = F.coalesce("code", F.when(F.col("loan_yn").isNull(), "BOOK_NOT_FOUND").when(F.col("loan_yn") != "Y", "BOOK_NOT_AVAILABLE"))
        checked = checked.withColumn("code", code).withColumn("ok", F.col("code").isNull())
    day = _date(as_of)
    made = checked.where("ok").select(surrogate_id("LN", "book_id", "member_id", F.lit(now)).alias("loan_id"), "book_id", "member_id", day.alias("loan_date"), due_date(day).alias("due_date"), F.lit("1").alias("loan_status"), F.lit(0).alias("extend_cnt"))
    return Outcome(
        t | {"loan": R.insert_loan(t, made), "book": _set(t["book"], "book_id", made, {"loan_yn": "N"}), "loan_hist": _history(t, made, "1", now, processor)},
        checked.join(made.select("book_id", "member_id", "loan_id"), ["book_id", "member_id"], "left").select("book_id", "member_id", "loan_id", "ok", "code"),
    )


def _set(table: DataFrame, key: str, rows: DataFrame, values: dict[str, str]) -> DataFrame:
    hit = table.join(rows.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.select(*(F.when(F.col("__hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def _history(t: Tables, rows: DataFrame, kind: str, now: str, processor: str) -> DataFrame:
    made = rows.select(surrogate_id("HS", "loan_id", F.lit(kind), F.lit(now)).alias("hist_id"), "loan_id", F.lit(kind).alias("process_type"), F.lit(processor).alias("processor"))
    return R.insert_loan_hist(t, made, now)


def update_return(t: Tables, requests: DataFrame, as_of: str, now: str, processor: str = "SYSTEM", strict: bool = False) -> Outcome:
    """requests: loan_id. The clock time of a return is after the midnight of the due day, so a return on that day counts
    as late with 0 days, and a loan marked overdue before gets a second overdue row; strict does neither."""
    known = requests.join(t["loan"], "loan_id", "left")
    code = F.when(F.col("book_id").isNull(), "LOAN_NOT_FOUND")
    checked = known.withColumn("code", code).withColumn("ok", code.isNull())
    done = checked.where("ok")
    late = done.where(_date(as_of) > F.col("due_date") if strict else _date(as_of) >= F.col("due_date"))
    suspended = late
    if strict:
        late = late.join(t["overdue"].select("loan_id"), "loan_id", "left_anti")
    rows = late.select(surrogate_id("OD", "loan_id", F.lit(now)).alias("overdue_id"), "loan_id", F.date_add("due_date", 1).alias("overdue_start_date"), overdue_days("due_date", _date(as_of)).alias("overdue_days"), F.lit("1").alias("sanction_status"))
    loans = R.merged(t["loan"], "loan_id", done.select("loan_id", _date(as_of).alias("return_date"), F.lit("2").alias("loan_status")))
    tables = t | {"loan": loans, "book": _set(t["book"], "book_id", done, {"loan_yn": "Y"}), "overdue": R.insert_overdue(t, rows), "member": _set(t["member"], "member_id", suspended, {"member_status": "2"}), "loan_hist": _history(t, done, "2", now, processor)}
    return Outcome(tables, checked.select("loan_id", "ok", "code"))


def update_extend(t: Tables, requests: DataFrame, now: str, processor: str = "SYSTEM") -> Outcome:
    """requests: loan_id. Only loans of status 1 can be extended."""
    known = requests.join(t["loan"], "loan_id", "left")
    code = F.when(F.col("book_id").isNull(), "LOAN_NOT_FOUND").when(F.col("loan_status") != "1", "NOT_EXTENDABLE")
    checked = known.withColumn("code", code).withColumn("ok", code.isNull())
    done = checked.where("ok")
    changes = done.select("loan_id", extended_due_date("due_date").alias("due_date"), (F.col("extend_cnt") + 1).alias("extend_cnt"))
    return Outcome(t | {"loan": R.merged(t["loan"], "loan_id", changes), "loan_hist": _history(t, done, "3", now, processor)}, checked.select("loan_id", "ok", "code"))


def update_release(t: Tables, requests: DataFrame, as_of: str, strict: bool = False) -> Outcome:
    """requests: overdue_id. The member becomes normal again; strict keeps those suspended who have other sanctions."""
    known = requests.join(t["overdue"], "overdue_id", "left").join(t["loan"].select("loan_id", "member_id"), "loan_id", "left")
    code = F.when(F.col("sanction_status").isNull(), "OVERDUE_NOT_FOUND").when(F.col("sanction_status") == "2", "ALREADY_RELEASED")
    checked = known.withColumn("code", code).withColumn("ok", code.isNull())
    done = checked.where("ok")
    overdue = R.merged(t["overdue"], "overdue_id", done.select("overdue_id", _date(as_of).alias("release_date"), F.lit("2").alias("sanction_status")))
    freed = done.select("member_id")
    if strict:
        still = overdue.where(F.col("sanction_status") == "1").join(t["loan"].select("loan_id", "member_id"), "loan_id").select("member_id")
        freed = freed.join(still, "member_id", "left_anti")
    return Outcome(t | {"overdue": overdue, "member": _set(t["member"], "member_id", freed, {"member_status": "1"})}, checked.select("overdue_id", "ok", "code"))


def refresh_overdue(t: Tables, as_of: str, strict: bool = False) -> Outcome:
    """The nightly batch: new overdue rows for late loans, then the days of all active rows. Its counter counts new rows
    twice, once when made and once when their days are set; strict counts each row once."""
    day = _date(as_of)
    late = t["loan"].where((F.col("loan_status") == "1") & (F.col("due_date") < day)).join(t["overdue"].select("loan_id"), "loan_id", "left_anti")
    rows = late.select(surrogate_id("OD", "loan_id").alias("overdue_id"), "loan_id", F.date_add("due_date", 1).alias("overdue_start_date"), overdue_days("due_date", day).alias("overdue_days"), F.lit("1").alias("sanction_status"))
    overdue = R.insert_overdue(t, rows)
    days = F.when(F.col("sanction_status") == "1", overdue_days("overdue_start_date", day) + 1).otherwise(F.col("overdue_days"))
    overdue = overdue.withColumn("overdue_days", days.cast("int"))
    tables = t | {"overdue": overdue, "loan": _set(t["loan"], "loan_id", late, {"loan_status": "3"}), "member": _set(t["member"], "member_id", late, {"member_status": "2"})}
    made = rows.agg(F.count(F.lit(1)).alias("made"))
    active = overdue.where(F.col("sanction_status") == "1").agg(F.count(F.lit(1)).alias("active"))
    total = active.crossJoin(made).select((F.col("active") + (F.lit(0) if strict else F.col("made"))).alias("cnt"))  # one row each
    return Outcome(tables, rows.select("loan_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("code")), {"updated": total})


def _nth(*natural_key: str) -> Column:
    """Which of the rows with the same natural key this is, so that copies get ids of their own."""
    return F.row_number().over(Window.partitionBy(*natural_key).orderBy(*natural_key))


def insert_books(t: Tables, rows: DataFrame, now: str) -> DataFrame:
    ready = rows.withColumn("nth", _nth("isbn", "title")).withColumn("book_id", default_if_blank("book_id", surrogate_id("BK", "isbn", "title", "nth", F.lit(now)))).drop("nth")
    return R.insert_book(t, ready.withColumn("loan_yn", default_if_blank("loan_yn", "Y")), now)


def insert_members(t: Tables, rows: DataFrame, now: str) -> DataFrame:
    ready = rows.withColumn("nth", _nth("member_nm", "phone")).withColumn("member_id", default_if_blank("member_id", surrogate_id("MB", "member_nm", "phone", "nth", F.lit(now)))).drop("nth")
    return R.insert_member(t, ready.withColumn("member_status", default_if_blank("member_status", "1")), now)


def _checked(table: DataFrame, key: str, requests: DataFrame, missing: str) -> tuple[DataFrame, DataFrame]:
    """The requests whose row exists, and a row for each request: key, ok, code."""
    known = requests.join(table.select(key, F.lit(True).alias("__known")), key, "left")
    code = F.when(F.col("__known").isNull(), missing)
    return known.where("__known").drop("__known"), known.select(key, code.isNull().alias("ok"), code.alias("code"))


def _changed(t: Tables, name: str, key: str, requests: DataFrame, columns: tuple[str, ...], missing: str) -> Outcome:
    done, results = _checked(t[name], key, requests, missing)
    changes = done.select(key, *(c for c in columns if c in requests.columns))
    return Outcome(t | {name: R.merged(t[name], key, changes)}, results)


def _removed(t: Tables, name: str, key: str, requests: DataFrame, missing: str) -> Outcome:
    done, results = _checked(t[name], key, requests, missing)
    return Outcome(t | {name: t[name].join(done.select(key), key, "left_anti").select(*t[name].columns)}, results)


def update_books(t: Tables, requests: DataFrame) -> Outcome:
    """requests: book_id and the columns to change (null: unchanged). An unknown book is refused."""
    return _changed(t, "book", "book_id", requests, R.BOOK_CHANGES, "BOOK_NOT_FOUND")


def delete_books(t: Tables, requests: DataFrame) -> Outcome:
    return _removed(t, "book", "book_id", requests, "BOOK_NOT_FOUND")


def update_members(t: Tables, requests: DataFrame) -> Outcome:
    """requests: member_id and the columns to change (null: unchanged). An unknown member is refused."""
    return _changed(t, "member", "member_id", requests, R.MEMBER_CHANGES, "MEMBER_NOT_FOUND")


def delete_members(t: Tables, requests: DataFrame) -> Outcome:
    return _removed(t, "member", "member_id", requests, "MEMBER_NOT_FOUND")


def lookup(table: DataFrame, key: str, keys: DataFrame, missing: str) -> DataFrame:
    """A row for each key: found, code, and the row's columns (null if there is none)."""
    known = keys.join(table.withColumn("found", F.lit(True)), key, "left")
    return known.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("code", F.when(~F.col("found"), F.lit(missing)))


def error_response(code: Column) -> Column:
    """Status and message of a business code; null for none. Codes outside the business are server errors."""
    known = ("MEMBER_NOT_FOUND", "OVERDUE_MEMBER", "LOAN_LIMIT_EXCEEDED", "LOAN_NOT_FOUND", "BOOK_NOT_FOUND", "BOOK_NOT_AVAILABLE", "OVERDUE_NOT_FOUND", "ALREADY_RELEASED", "NOT_EXTENDABLE")
    return F.when(code.isNotNull(), F.struct(F.when(code.isin(*known), 400).otherwise(500).alias("status"), code.alias("code")))
