"""A small lending library with the awkward cases: nulls, ties, wildcards in titles, members at the limit, days around a due date."""

from datetime import date, datetime

AS_OF, NOW = "2026-03-20", "2026-03-20 10:00:00"
D = lambda s: date.fromisoformat(s)

CATEGORY = [("000", "general", None), ("100", "thought", None), ("110", "logic", "100")]
REG = datetime(2026, 1, 1)
BOOK = [
    ("B1", "1", "Deep Sea", "Ann", None, None, "000", None, "N", REG),
    ("B2", "2", "100% sure_thing", "Bob", "P", D("2020-01-01"), "110", "A-1", "Y", REG),
    ("B3", "3", "deep woods", "ann lee", "P", None, None, None, "Y", REG),
    ("B4", "4", "Night", "Cid", "P", None, "999", None, "N", datetime(2026, 2, 1)),
    ("B5", "5", "Day", "Cid", "P", None, "100", None, "Y", REG),
]
MEMBER = [
    ("M1", "Kim A", None, None, None, "1", D("2026-01-01")),
    ("M2", "kim b", None, "1", None, "2", D("2026-01-01")),
    ("M3", "Lee", None, None, None, "9", D("2025-01-01")),
    ("M4", "Full", None, None, None, "1", D("2025-06-01")),
    ("M5", "Almost", None, None, None, "1", D("2025-06-01")),
]
LOAN = [
    ("L1", "B1", "M1", D("2026-03-01"), D("2026-03-15"), None, "1", 0),
    ("L2", "B4", "M2", D("2026-03-06"), D("2026-03-20"), None, "1", 0),
    ("L3", "B2", "M2", D("2026-02-01"), D("2026-02-15"), D("2026-02-20"), "2", 1),
    ("L4", "B3", "M3", D("2026-01-01"), D("2026-01-15"), None, "3", 0),
    ("L5", "B5", "M1", D("2026-03-05"), D("2026-03-19"), None, "1", 0),
    *((f"F{i}", "B5", "M4", D("2026-03-10"), D("2026-03-24"), None, "1", 0) for i in range(5)),
    *((f"G{i}", "B5", "M5", D("2026-03-10"), D("2026-03-24"), None, "1", 0) for i in range(4)),
]
OVERDUE = [
    ("O1", "L3", D("2026-02-16"), 5, None, "1"),
    ("O2", "L4", D("2026-01-16"), 3, None, "1"),
    ("O3", "L5", D("2026-03-01"), 1, D("2026-03-02"), "2"),
]
HIST = [("H1", "L1", "1", datetime(2026, 3, 1), None)]


def tables(spark):
    from quarryflow.sources.schema import business

    return business(spark, {"category": CATEGORY, "book": BOOK, "member": MEMBER, "loan": LOAN, "overdue": OVERDUE, "loan_hist": HIST})
