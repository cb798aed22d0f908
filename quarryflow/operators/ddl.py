"""Schema catalogs from CREATE TABLE text, and the catalog as prompt text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.sources.schema import CATALOG

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|`[^`]*`|\"[^\"]*\"|[\w$]+|.", re.S)


def tokens(sql: str) -> list[str]:
    return [t for t in TOKEN.findall(sql) if not t.isspace() and not t.startswith(("--", "/*"))]


def _plain(token: str) -> str:
    if token[:1] == "'":
        return token[1:-1].replace("''", "'")
    return token[1:-1] if token[:1] in "`\"" else token


def _parts(body: list[str]) -> list[list[str]]:
    """Comma-separated items at depth 0."""
    out, depth = [[]], 0
    for t in body:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _names(item: list[str], at: int) -> tuple[list[str], int]:
    """Names inside the parentheses that open at or after `at`, and where they end."""
    start = item.index("(", at)
    end = item.index(")", start)
    return [_plain(t) for t in item[start + 1 : end] if t != ","], end


def _table(name: str, body: list[str], options: list[str]) -> list[dict]:
    upper = [t.upper() for t in options]
    comment = next((_plain(t) for t in options[upper.index("COMMENT") + 1 :] if t != "="), None) if "COMMENT" in upper else None
    columns, keys, refs = [], set(), {}
    for item in _parts(body):
        words = [t.upper() for t in item]
        if words[0] in ("PRIMARY", "CONSTRAINT", "FOREIGN", "UNIQUE", "KEY", "INDEX", "CHECK", "FULLTEXT"):
            if "PRIMARY" in words:
                keys |= set(_names(item, words.index("PRIMARY"))[0])
            elif "FOREIGN" in words:
                own, end = _names(item, words.index("FOREIGN"))
                to = words.index("REFERENCES", end)
                refs |= {c: (_plain(item[to + 1]), r) for c, r in zip(own, _names(item, to)[0])}
            continue
        end = 2
        if len(item) > 2 and item[2] == "(":
            end = item.index(")", 2) + 1
        kind = "".join(item[1:end]).upper().replace(",", ", ")
        rest = words[end:]
        default = None
        if "DEFAULT" in rest:
            value = item[end + rest.index("DEFAULT") + 1 :]
            default = _plain(value[0]) if value[0] != "-" else "-" + value[1]
            if default.upper() == "CURRENT_TIMESTAMP":
                default = "CURRENT_TIMESTAMP()"
        own_key = any(a == "PRIMARY" and b == "KEY" for a, b in zip(rest, rest[1:]))
        note = _plain(item[end + rest.index("COMMENT") + 1]) if "COMMENT" in rest else None
        if own_key:
            keys.add(_plain(item[0]))
        columns.append({"column_name": _plain(item[0]), "data_type": kind, "nullable": not any(a == "NOT" and b == "NULL" for a, b in zip(rest, rest[1:])), "default_value": default, "column_comment": note})
    return [c | {"table_name": name, "table_comment": comment, "is_pk": c["column_name"] in keys, "nullable": c["nullable"] and c["column_name"] not in keys, "fk_ref_table": refs.get(c["column_name"], (None, None))[0], "fk_ref_column": refs.get(c["column_name"], (None, None))[1], "position": i} for i, c in enumerate(columns)]


def _comments_only(name: str, body: list[str], options: list[str]) -> list[dict]:
    """For a table that does not parse: columns with a comment, and nothing else of them."""
    upper = [t.upper() for t in options]
    comment = next((_plain(t) for t in options[upper.index("COMMENT") + 1 :] if t != "="), None) if "COMMENT" in upper else None
    found = [(item[0], item[[t.upper() for t in item].index("COMMENT") + 1]) for item in _parts(body) if "COMMENT" in [t.upper() for t in item][:-1]]
    return [{"table_name": name, "table_comment": comment, "column_name": _plain(c), "data_type": "", "nullable": True, "default_value": None, "column_comment": _plain(n), "is_pk": False, "fk_ref_table": None, "fk_ref_column": None, "position": i} for i, (c, n) in enumerate(found)]


def catalog_of(sql: str) -> list[dict]:
    """A row for each column of each CREATE TABLE statement."""
    words, out, i = tokens(sql), [], 0
    while i + 2 < len(words):
        if not (words[i].upper() == "CREATE" and words[i + 1].upper() == "TABLE"):
            i += 1
            continue
        at = i + 2
        if [w.upper() for w in words[at : at + 3]] == ["IF", "NOT", "EXISTS"]:
            at += 3
        name, i = _plain(words[at]), at + 1
        if i >= len(words) or words[i] != "(":
            continue
        depth, end = 0, i
        while end < len(words):
            depth += (words[end] == "(") - (words[end] == ")")
            if not depth:
                break
            end += 1
        if end == len(words):  # never closed: what stands before the next statement, as far as it can be told apart
            end = words.index(";", i) if ";" in words[i:] else len(words)
            stop = end
        else:
            stop = words.index(";", end) if ";" in words[end:] else len(words)
        body, options = words[i + 1 : end], words[end + 1 : stop]
        try:
            if end == stop < len(words) or end == len(words):
                raise ValueError("not closed")
            out += _table(name, body, options)
        except (ValueError, IndexError):
            out += _comments_only(name, body, options)
        i = stop
    return out


def parse_ddl(files: DataFrame) -> DataFrame:
    """files: content. The schema catalog, a row a column."""
    columns = [c.split()[0] for c in CATALOG.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for c in batch["content"] if c is not None for r in catalog_of(c)]
            yield pd.DataFrame(rows, columns=columns).astype({"nullable": bool, "is_pk": bool, "position": int})

    return files.select("content").mapInPandas(run, CATALOG)


def schema_text(catalog: DataFrame) -> DataFrame:
    """One row, schema_text: tables by name, columns in their order, an empty line between tables."""
    flags = F.concat_ws(", ", F.when(F.col("is_pk"), "PK"), F.when(~F.col("nullable"), "NOT NULL"), F.concat(F.lit("DEFAULT "), "default_value"), F.concat(F.lit("FK -> "), "fk_ref_table", F.lit("."), "fk_ref_column"))
    line = F.concat(F.lit("  - "), "column_name", F.lit(" "), F.coalesce("data_type", F.lit("")), F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))).otherwise(""), F.when(F.length("column_comment") > 0, F.concat(F.lit("  -- "), "column_comment")).otherwise(""))
    rows = catalog.select("table_name", "table_comment", F.struct("position", line.alias("line")).alias("entry"))
    head = F.concat(F.lit("TABLE "), "table_name", F.when(F.length("table_comment") > 0, F.concat(F.lit(" -- "), "table_comment")).otherwise(""))
    tables = rows.groupBy("table_name").agg(F.max("table_comment").alias("table_comment"), F.array_sort(F.collect_list("entry")).alias("entries"))
    text = tables.select("table_name", F.concat_ws("\n", head, F.array_join(F.transform("entries", lambda e: e["line"]), "\n")).alias("text"))
    return text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "text"))), lambda t: t["text"]), "\n\n").alias("schema_text"))


def table_names(catalog: DataFrame) -> DataFrame:
    return catalog.select("table_name").distinct()


def nth_column(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("n", F.row_number().over(Window.partitionBy("table_name").orderBy("position")))
