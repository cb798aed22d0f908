import random
from datetime import date, timedelta

import pytest

from quarryflow.operators import sequences as S
from quarryflow.sources.schema import business

AS_OF, NOW = "2026-03-20", "2026-03-20 10:00:00"
DAY = date(2026, 3, 20)


def library(spark, seed):
    """Books in and out, members of all kinds, one of whom asks for a third of all, and one book that many want."""
    rnd = random.Random(seed)
    books = [(f"B{k}", None, f"t{k}", None, None, None, None, None, "N" if k % 4 == 0 else "Y", None) for k in range(12)]
    members = [(f"M{k}", "n", None, None, None, "2" if k == 1 else "1", None) for k in range(6)]
    loans = [(f"L{k}", f"B{rnd.randrange(12)}", f"M{rnd.randrange(6)}", DAY, DAY + timedelta(rnd.randrange(-3, 3)), None, rnd.choice("1123"), 0) for k in range(14)]
    overdue = [(f"O{k}", f"L{k}", DAY, 1, None, rnd.choice("12")) for k in range(8)]
    t = business(spark, {"book": books, "member": members, "loan": loans, "overdue": overdue})
    return rnd, books, members, loans, overdue, {k: v.cache() for k, v in t.items()}


def walk(asked, books, members, loans, strict):
    """The requests one after the other."""
    inside, status = {b[0]: b[8] == "Y" for b in books}, {m[0]: m[5] for m in members}
    out = {}
    for x in loans:
        out[x[2]] = out.get(x[2], 0) + (x[6] == "1")
    codes = []
    for _, book, member in asked:
        code = None
        if member not in status:
            code = "MEMBER_NOT_FOUND"
        elif status[member] != "1":
            code = "OVERDUE_MEMBER"
        elif out.get(member, 0) >= 5:
            code = "LOAN_LIMIT_EXCEEDED"
        elif strict and book not in inside:
            code = "BOOK_NOT_FOUND"
        elif strict and not inside[book]:
            code = "BOOK_NOT_AVAILABLE"
        else:
            out[member] = out.get(member, 0) + 1
            inside[book] = False
        codes.append(code)
    return codes


@pytest.mark.parametrize(("seed", "strict"), [(1, True), (2, True), (3, True), (4, False), (5, False)])
def test_lending_one_after_the_other(spark, seed, strict):
    rnd, books, members, loans, _, t = library(spark, seed)
    pick = lambda some, name, most: rnd.choice(some) if rnd.random() < 0.4 else f"{name}{rnd.randrange(most)}"
    asked = [(n, pick(["B5"], "B", 14), pick(["M0", "M2"], "M", 7)) for n in range(45)]
    shuffled = rnd.sample(asked, len(asked))
    out = S.lend(t, spark.createDataFrame(shuffled, "nth int, book_id string, member_id string").repartition(3), AS_OF, NOW, strict=strict)
    got = out.results.orderBy("nth").collect()
    want = walk(asked, books, members, loans, strict)
    assert [(r["nth"], r["book_id"], r["member_id"], r["code"], r["ok"], r["loan_id"] is not None) for r in got] == [(*a, c, c is None, c is None) for a, c in zip(asked, want)]
    assert out.tables["loan"].count() == len(loans) + want.count(None) == out.tables["loan"].select("loan_id").distinct().count()
    assert out.tables["loan_hist"].count() == want.count(None)
    lent = {a[1] for a, c in zip(asked, want) if c is None}
    assert {r["book_id"] for r in out.tables["book"].where("loan_yn = 'N'").collect()} == {b[0] for b in books if b[8] == "N" or b[0] in lent}


def test_nothing_asked(spark):
    t = library(spark, 1)[-1]
    none = spark.createDataFrame([], "nth int, book_id string, member_id string, loan_id string, overdue_id string")
    for out in (S.lend(t, none, AS_OF, NOW, strict=True), S.give_back(t, none, AS_OF, NOW), S.extend(t, none, NOW), S.release(t, none, AS_OF)):
        assert out.results.collect() == [] and out.tables["loan"].count() == 14


@pytest.mark.parametrize("strict", [False, True])
def test_giving_back_again(spark, strict):
    _, _, _, loans, overdue, t = library(spark, 6)
    asked = [(n, f"L{k}") for n, k in enumerate((0, 1, 2, 0, 3, 0, 4, 99, 1))]
    out = S.give_back(t, spark.createDataFrame(asked, "nth int, loan_id string"), AS_OF, NOW, strict=strict)
    loan, has, want, rows = {x[0]: x for x in loans}, {o[1] for o in overdue}, [], 0
    back = {k for k, x in loan.items() if x[6] == "2"}
    for _, k in asked:
        code = "LOAN_NOT_FOUND" if k not in loan else "LOAN_ALREADY_RETURNED" if strict and k in back else None
        want.append(code)
        if code is None:
            late = DAY > loan[k][4] if strict else DAY >= loan[k][4]
            rows += late and not (strict and k in has)
            back.add(k)
    assert [r["code"] for r in out.results.orderBy("nth").collect()] == want
    made = out.tables["overdue"].join(t["overdue"], "overdue_id", "left_anti")
    assert made.count() == rows == made.select("overdue_id").distinct().count()
    assert out.tables["loan"].count() == len(loans) and {r["loan_id"] for r in out.tables["loan"].where("loan_status = '2'").collect()} == back
    assert out.tables["loan_hist"].count() == want.count(None)


def test_extending_and_releasing_again(spark):
    _, _, _, loans, overdue, t = library(spark, 7)
    asked = [(n, f"L{n % 5}") for n in range(12)] + [(20, "no")]
    out = S.extend(t, spark.createDataFrame(asked, "nth int, loan_id string"), NOW)
    after = {r["loan_id"]: r for r in out.tables["loan"].collect()}
    for x in loans:
        times = sum(k == x[0] for _, k in asked) if x[6] == "1" else 0
        assert (after[x[0]]["due_date"], after[x[0]]["extend_cnt"]) == (x[4] + timedelta(7 * times), times)
    assert {r["nth"]: r["code"] for r in out.results.collect()} == {n: "LOAN_NOT_FOUND" if k == "no" else None if dict((x[0], x[6]) for x in loans)[k] == "1" else "NOT_EXTENDABLE" for n, k in asked}
    asked = [(n, f"O{n % 6}") for n in range(10)] + [(30, "no")]
    out = S.release(t, spark.createDataFrame(asked, "nth int, overdue_id string"), AS_OF)
    ended, want = {o[0] for o in overdue if o[5] == "2"}, {}
    for n, k in asked:
        want[n] = "OVERDUE_NOT_FOUND" if k == "no" else "ALREADY_RELEASED" if k in ended else None
        ended.add(k)
    assert {r["nth"]: r["code"] for r in out.results.collect()} == want and out.tables["overdue"].count() == len(overdue)
