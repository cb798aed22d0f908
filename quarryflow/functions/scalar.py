"""Scalar functions of the lending schema and of text extraction, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the lending rules.
LOAN_DAYS, EXTEND_DAYS, MOST_LOANS = 14, 7, 5
PAGE_SIZE, PAGE_INDEX, PAGE_BLOCK = 10, 1, 10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(c: Column | str, part: str) -> Column:
    """LIKE with a wildcard on both sides, without regard to case; % and _ in part stay wildcards."""
    return F.collate(col(c), "UTF8_LCASE").like(f"%{part}%")


def due_date(loan_date: Column | str) -> Column:
    return F.date_add(col(loan_date), LOAN_DAYS)


def extended_due_date(due: Column | str) -> Column:
    return F.date_add(col(due), EXTEND_DAYS)


def overdue_days(due: Column | str, base: Column | str) -> Column:
    """Whole days from due to base, none if base is not after due."""
    return F.greatest(F.datediff(col(base), col(due)), F.lit(0))


def pagination(total: Column | str, page_index: int | None = None, page_size: int | None = None) -> dict[str, Column]:
    """Page numbers around a page, ten at a time; sizes and indexes below 1 fall back to their defaults."""
    size = page_size if page_size and page_size > 0 else PAGE_SIZE
    index = page_index if page_index and page_index > 0 else PAGE_INDEX
    pages = F.ceil(col(total) / F.lit(size)).cast("int")
    first = (index - 1) // PAGE_BLOCK * PAGE_BLOCK + 1
    return {"page_index": F.lit(index), "page_size": F.lit(size), "total_pages": pages, "first_page": F.lit(first), "last_page": F.least(F.lit(first + PAGE_BLOCK - 1), pages), "first_index": F.lit((index - 1) * size)}


def surrogate_id(prefix: str, *natural_key: Column | str) -> Column:
    """Prefix and 16 upper-case hex digits of a hash of the natural key, so that reruns agree. What tells rows of one
    natural key apart belongs into it."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *(col(c).cast("string") for c in natural_key)), 256), 1, 16)))


def default_if_blank(c: Column | str, default: Column | str | int) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def label_of(code: Column | str, labels: dict[str, str]) -> Column:
    """Label of a code; null for an unknown one."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(col(code) == k, F.lit(v)).otherwise(out)
    return out


def last_segment(c: Column | str, by: str = ".") -> Column:
    return F.substring_index(col(c), by, -1)


def first_url_segment(url: Column | str) -> Column:
    return F.element_at(F.split(F.trim(col(url), F.lit("/")), "/"), 1)


def sorted_join(values: Column, by: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), by)


def table_refs(sql: Column | str) -> Column:
    """TB_ names after FROM, JOIN, INTO and UPDATE, in upper case, in the order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(sql), F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+(TB_[A-Za-z0-9_]+)"), 1), lambda t: F.upper(t)))


def lines_of(content: Column | str) -> Column:
    return F.split(F.regexp_replace(col(content), "\r\n?", "\n"), "\n")


def line_slice(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start ... end, counted from 1, joined by line feeds."""
    return F.array_join(F.slice(lines_of(content), col(start), F.greatest(col(end) - col(start) + 1, F.lit(0))), "\n")


def marked_slice(content: Column | str, start: Column | str, end: Column | str, marked: Column | str) -> Column:
    """The same with ">>> " before the marked line and four spaces before the others."""
    part = F.slice(lines_of(content), col(start), F.greatest(col(end) - col(start) + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda line, i: F.concat(F.when(i + col(start) == col(marked), F.lit(">>> ")).otherwise(F.lit("    ")), line)), "\n")


def has_hangul(c: Column | str) -> Column:
    return col(c).rlike("[가-힣]")


def cell(c: Column, kind: str) -> Column:
    """A result cell as it is shown: bytes as text, dates and timestamps in ISO form, decimals as doubles."""
    if kind == "binary":
        return F.decode(c, "UTF-8")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("double") if kind.startswith("decimal") else c
