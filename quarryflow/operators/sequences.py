"""Batches of requests of one kind that are taken one after the other, each seeing what those before it have done.

`lifecycle` lets all requests of a batch see the state before the batch. Here `nth` says their order (null first; equal ones
in any order, the same for the whole batch), and members, books, loans and overdue rows may repeat. Nothing walks over the
requests: what a request needs from earlier ones is a rank, a count or a least value of its key.

Loans with `strict` depend on each other through members and books: a request is granted only if its member has fewer than
five and its book is still in. That is settled in rounds. In each, a request is granted if no undecided one for its book
comes before it and its member would stay below the limit even if all its earlier undecided ones were granted; those whose
book is gone, or whose member has reached the limit, are refused. The earliest undecided request is always decided, and
only chains of requests that wait for each other need more than a few rounds. A member or a book with any share of the
requests costs no more: ranks stop at the limit before they are shuffled, a book's first request is a least value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.functions.scalar import MOST_LOANS, due_date, extended_due_date, overdue_days, surrogate_id
from quarryflow.sources.scratch import Scratch

from . import relational as R
from .lifecycle import Outcome, Tables, _date, _set


def _numbered(requests: DataFrame, scratch: Scratch) -> DataFrame:
    """The requests with `at`, their place in the order, which no two share."""
    place = F.struct(F.col("nth"), F.monotonically_increasing_id().alias("row"))
    return scratch.write(requests.withColumn("at", place), "requests")


def _first_of_each(rows: DataFrame, key: str, most: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("at")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _granted(requests: DataFrame, scratch: Scratch, strict: bool) -> DataFrame:
    """Requests (at, book_id, member_id) that are granted. requests: at, book_id, member_id, room (loans that the member may
    still get; 0 for one who gets none), available."""
    able = requests.where(F.col("room") > 0)
    if not strict:
        return _first_of_each(able, "member_id", MOST_LOANS).where("rank <= room").select("at", "book_id", "member_id")
    left = scratch.write(able.where("available").select("at", "book_id", "member_id", "room"), "left0")
    granted, k = left.select("at", "book_id", "member_id").limit(0), 0
    while not left.isEmpty():
        k += 1
        heads = left.groupBy("book_id").agg(F.min("at").alias("at"))
        ranked = _first_of_each(left, "member_id", MOST_LOANS)
        had = granted.groupBy("member_id").agg(F.collect_list("at").alias("had"))  # at most MOST_LOANS
        ready = ranked.join(heads, ["book_id", "at"]).join(had, "member_id", "left")
        before = F.coalesce(F.size(F.filter("had", lambda x: x < F.col("at"))), F.lit(0))
        before = F.when(F.col("had").isNull(), 0).otherwise(before)
        new = ready.where(F.col("rank") + before <= F.col("room")).select("at", "book_id", "member_id")
        granted = scratch.write(granted.unionByName(new), f"granted{k}")
        had = granted.groupBy("member_id").agg(F.collect_list("at").alias("had"))
        rest = left.join(granted.select("book_id"), "book_id", "left_anti").join(had, "member_id", "left")
        full = F.coalesce(F.size(F.filter("had", lambda x: x < F.col("at"))), F.lit(0)) >= F.col("room")
        left = scratch.write(rest.where(F.col("had").isNull() | ~full).drop("had"), f"left{k}")
    return granted


def lend(t: Tables, requests: DataFrame, as_of: str, now: str, processor: str = "SYSTEM", strict: bool = False) -> Outcome:
    """requests: nth, book_id, member_id. results: nth, book_id, member_id, loan_id, ok, code: the first rule that fails
    names the code, as in `lifecycle.insert_loan`, with the loans and books of earlier requests counted."""
    scratch = Scratch(requests.sparkSession, "lend")
    asked = _numbered(requests.select("nth", "book_id", "member_id"), scratch)
    out = t["loan"].where(F.col("loan_status") == "1").groupBy("member_id").agg(F.count(F.lit(1)).alias("out"))
    members = asked.select("member_id").distinct().join(t["member"].select("member_id", "member_status"), "member_id", "left").join(out, "member_id", "left")
    room = F.when(F.col("member_status") == "1", F.greatest(F.lit(MOST_LOANS) - F.coalesce("out", F.lit(0)), F.lit(0))).otherwise(0)
    members = members.withColumn("room", room)
    books = t["book"].select("book_id", "loan_yn")
    known = asked.join(members, "member_id", "left").join(books, "book_id", "left")
    known = scratch.write(known.withColumn("available", F.coalesce(F.col("loan_yn") == "Y", F.lit(False))), "known")
    granted = scratch.write(_granted(known, scratch, strict), "granted")

    had = granted.groupBy("member_id").agg(F.collect_list("at").alias("had"))  # at most MOST_LOANS
    taken = granted.groupBy("book_id").agg(F.min("at").alias("taken"))
    seen = known.join(had, "member_id", "left").join(taken, "book_id", "left").join(granted.select("at", F.lit(True).alias("ok")), "at", "left")
    earlier = F.when(F.col("had").isNull(), 0).otherwise(F.size(F.filter("had", lambda x: x < F.col("at"))))
    code = F.when(F.col("member_status").isNull(), "MEMBER_NOT_FOUND").when(F.col("member_status") != "1", "OVERDUE_MEMBER")
    code = code.when(earlier >= F.col("room"), "LOAN_LIMIT_EXCEEDED")
    if strict:
        gone = (F.col("loan_yn") != "Y") | F.coalesce(F.col("taken") < F.col("at"), F.lit(False))
        code = code.when(F.col("loan_yn").isNull(), "BOOK_NOT_FOUND").when(gone, "BOOK_NOT_AVAILABLE")
    loan_id = F.when(F.col("ok"), surrogate_id("LN", "book_id", "member_id", F.lit(now), F.col("at.row")))
    seen = seen.select("at", "nth", "book_id", "member_id", loan_id.alias("loan_id"), F.coalesce("ok", F.lit(False)).alias("ok"), code.alias("code"))
    seen = scratch.write(seen, "results")

    done, day = seen.where("ok"), _date(as_of)
    made = done.select("loan_id", "book_id", "member_id", day.alias("loan_date"), due_date(day).alias("due_date"), F.lit("1").alias("loan_status"), F.lit(0).alias("extend_cnt"))
    tables = {"loan": R.insert_loan(t, made), "book": _set(t["book"], "book_id", made, {"loan_yn": "N"}), "loan_hist": _audit(t, done, "1", now, processor)}
    return Outcome(t | tables, seen.drop("at"))


def _audit(t: Tables, done: DataFrame, kind: str, now: str, processor: str) -> DataFrame:
    """A history row for each request that was done."""
    name = surrogate_id("HS", "loan_id", F.lit(kind), F.lit(now), F.col("at.row"))
    made = done.select(name.alias("hist_id"), "loan_id", F.lit(kind).alias("process_type"), F.lit(processor).alias("processor"))
    return R.insert_loan_hist(t, made, now)


def _looked_up(requests: DataFrame, key: str, table: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.write(_numbered(requests.select("nth", key), scratch).join(table, key, "left"), "known")


def give_back(t: Tables, requests: DataFrame, as_of: str, now: str, processor: str = "SYSTEM", strict: bool = False) -> Outcome:
    """requests: nth, loan_id. A loan that is given back again is dated again, and its lateness makes another overdue row;
    strict refuses it with LOAN_ALREADY_RETURNED, and makes no row on the due day or where the loan has one."""
    scratch = Scratch(requests.sparkSession, "back")
    known = _looked_up(requests, "loan_id", t["loan"], scratch)
    first = known.groupBy("loan_id").agg(F.min("at").alias("first"))
    known = known.join(first, "loan_id", "left")
    code = F.when(F.col("book_id").isNull(), "LOAN_NOT_FOUND")
    if strict:
        code = code.when((F.col("loan_status") == "2") | (F.col("at") != F.col("first")), "LOAN_ALREADY_RETURNED")
    checked = scratch.write(known.withColumn("code", code).withColumn("ok", code.isNull()), "checked")
    done, day = checked.where("ok"), _date(as_of)
    late = done.where(day > F.col("due_date") if strict else day >= F.col("due_date"))
    rows = late.join(t["overdue"].select("loan_id"), "loan_id", "left_anti") if strict else late
    name = surrogate_id("OD", "loan_id", F.lit(now), F.col("at.row")).alias("overdue_id")
    days = overdue_days("due_date", day).alias("overdue_days")
    rows = rows.select(name, "loan_id", F.date_add("due_date", 1).alias("overdue_start_date"), days, F.lit("1").alias("sanction_status"))
    once = done.select("loan_id", day.alias("return_date"), F.lit("2").alias("loan_status")).distinct()
    tables = {
        "loan": R.merged(t["loan"], "loan_id", once),
        "book": _set(t["book"], "book_id", done, {"loan_yn": "Y"}),
        "overdue": R.insert_overdue(t, rows),
        "member": _set(t["member"], "member_id", late, {"member_status": "2"}),
        "loan_hist": _audit(t, done, "2", now, processor),
    }
    return Outcome(t | tables, checked.select("nth", "loan_id", "ok", "code"))


def extend(t: Tables, requests: DataFrame, now: str, processor: str = "SYSTEM") -> Outcome:
    """requests: nth, loan_id. Each request for a loan of status 1 adds its days and counts, however many there are."""
    scratch = Scratch(requests.sparkSession, "extend")
    known = _looked_up(requests, "loan_id", t["loan"], scratch)
    code = F.when(F.col("book_id").isNull(), "LOAN_NOT_FOUND").when(F.col("loan_status") != "1", "NOT_EXTENDABLE")
    checked = known.withColumn("code", code).withColumn("ok", code.isNull())
    done = checked.where("ok")
    counted = done.groupBy("loan_id", "due_date", "extend_cnt").agg(F.count(F.lit(1)).cast("int").alias("times"))
    week = F.datediff(extended_due_date("due_date"), "due_date")
    changes = counted.select("loan_id", F.date_add("due_date", week * F.col("times")).alias("due_date"), (F.col("extend_cnt") + F.col("times")).alias("extend_cnt"))
    tables = {"loan": R.merged(t["loan"], "loan_id", changes), "loan_hist": _audit(t, done, "3", now, processor)}
    return Outcome(t | tables, checked.select("nth", "loan_id", "ok", "code"))


def release(t: Tables, requests: DataFrame, as_of: str, strict: bool = False) -> Outcome:
    """requests: nth, overdue_id. The first request for an active sanction ends it, later ones find it released. The member
    becomes normal again; strict keeps those suspended who have other sanctions when the batch is over."""
    scratch = Scratch(requests.sparkSession, "release")
    known = _looked_up(requests, "overdue_id", t["overdue"].join(t["loan"].select("loan_id", "member_id"), "loan_id", "left"), scratch)
    first = known.groupBy("overdue_id").agg(F.min("at").alias("first"))
    known = known.join(first, "overdue_id", "left")
    again = (F.col("sanction_status") == "2") | (F.col("at") != F.col("first"))
    code = F.when(F.col("sanction_status").isNull(), "OVERDUE_NOT_FOUND").when(again, "ALREADY_RELEASED")
    checked = known.withColumn("code", code).withColumn("ok", code.isNull())
    done = checked.where("ok")
    changes = done.select("overdue_id", _date(as_of).alias("release_date"), F.lit("2").alias("sanction_status"))
    overdue = R.merged(t["overdue"], "overdue_id", changes)
    freed = done.select("member_id")
    if strict:
        still = overdue.where(F.col("sanction_status") == "1").join(t["loan"].select("loan_id", "member_id"), "loan_id").select("member_id")
        freed = freed.join(still, "member_id", "left_anti")
    member = _set(t["member"], "member_id", freed, {"member_status": "1"})
    return Outcome(t | {"overdue": overdue, "member": member}, checked.select("nth", "overdue_id", "ok", "code"))
