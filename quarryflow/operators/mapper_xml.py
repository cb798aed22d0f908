"""SQL statements of mapper files as rows.

Files go through an XML reader that knows where it is, so lines come from the reader and a statement's text is cut out of
the file by positions: dynamic tags, comments and CDATA sections inside it stay as they are written. What stands in a
comment is no statement, and a file that is not well-formed gives no rows but is listed with the reason."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.functions.scalar import table_refs
from quarryflow.sources.schema import STATEMENTS

#: Fixed values of the mapper format.
STATEMENT_TAGS = ("select", "insert", "update", "delete")
#: One tag, whatever its quoted attributes hold.
_TAG = re.compile(rb"""<(?:[^"'<>]|"[^"]*"|'[^']*')*>""")


class MapperReader:
    """The statements of one file, in its order. Lines count from 1; a carriage return ends a line as a line feed does."""

    def __init__(self, path: str, content: str):
        self.path, self.raw = path, content.encode()
        self.namespace: str | None = None
        self.statements: list[dict] = []
        self.depth, self.open = 0, None
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.Parse(content, True)

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if not self.depth:
            self.namespace = attributes.get("namespace")
        self.depth += 1
        if self.open is None and tag.lower() in STATEMENT_TAGS:
            head = _TAG.match(self.raw, self.parser.CurrentByteIndex)
            self.open = (self.depth, tag.lower(), attributes, self.parser.CurrentLineNumber, head.end())

    def _end(self, tag: str) -> None:
        if self.open is not None and self.open[0] == self.depth:
            _, kind, attributes, line, begin = self.open
            self.open, at = None, self.parser.CurrentByteIndex
            if attributes.get("id") and self.raw.startswith(b"</", at):  # a tag that closes itself has no text
                body = self.raw[begin:at].decode().replace("\r\n", "\n").replace("\r", "\n")
                close = _TAG.match(self.raw, at)[0].decode().replace("\r\n", "\n").replace("\r", "\n")
                self.statements.append(
                    {
                        "sql_id": attributes["id"],
                        "sql_type": kind,
                        "start_line": line,
                        "end_line": self.parser.CurrentLineNumber + close.count("\n"),
                        "sql_text": html.unescape(body.strip()),
                        "result_type": attributes.get("resultType"),
                        "parameter_type": attributes.get("parameterType"),
                    }
                )
        self.depth -= 1


def read_mapper(path: str, content: str | None) -> tuple[str | None, list[dict], str | None]:
    """Namespace, statements, and why the file cannot be read."""
    if content is None:
        return None, [], "not readable as UTF-8"
    try:
        reader = MapperReader(path, content)
    except expat.ExpatError as e:
        return None, [], str(e)
    return reader.namespace, reader.statements, None


_STATEMENT = "struct<sql_id:string,sql_type:string,start_line:int,end_line:int,sql_text:string,result_type:string,parameter_type:string>"


def _read(files: DataFrame) -> DataFrame:
    """file_path, namespace, statements, error: a row for each file."""
    text = [("sql_id", pa.string()), ("sql_type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]
    kind = pa.struct([*text, *((n, pa.string()) for n in ("sql_text", "result_type", "parameter_type"))])
    schema = pa.schema([("file_path", pa.string()), ("namespace", pa.string()), ("statements", pa.list_(kind)), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            read = [read_mapper(p, c) for p, c in zip(paths, batch.column("content").to_pylist())]
            columns = (paths, *zip(*read)) if read else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, f"file_path string, namespace string, statements array<{_STATEMENT}>, error string")


def parse_mappers(files: DataFrame) -> DataFrame:
    """files: path, content. A row for each statement with an id; `failed_mappers` lists the files that give none."""
    each = _read(files).select("file_path", "namespace", F.explode("statements").alias("s")).select("file_path", "namespace", "s.*")
    return each.withColumn("referenced_tables", table_refs("sql_text")).select(*(c.split()[0] for c in STATEMENTS.split(", ")))


def failed_mappers(files: DataFrame) -> DataFrame:
    """path, error of the files that are not well-formed XML, or not text."""
    return _read(files).where("error IS NOT NULL").select(F.col("file_path").alias("path"), "error")


#: What a statement's dynamic parts look like, and what stands for them.
SIMPLER = [
    (r"(?is)<where>.*?</where>", ""),
    (r"(?is)<if\b[^>]*>.*?</if>", ""),
    (r"(?is)</?(?:foreach|choose|when|otherwise|set|trim)\b[^>]*>", ""),
    (r"(?i)LIMIT\s+#\{[^}]+\}\s*,\s*#\{[^}]+\}", "LIMIT 10"),
    (r"#\{[^}]+\}", "'값'"),
]
#: Names of the kinds of statements.
KINDS = {"select": "조회", "insert": "등록", "update": "수정", "delete": "삭제"}


def simplified(sql: str = "sql_text"):
    """A statement without its dynamic parts: optional blocks gone, other tags stripped, parameters made constants, no
    empty lines."""
    x = F.col(sql)
    for pattern, by in [*SIMPLER, (r"(?m)[ \t\r]+$", ""), (r"\n{2,}", "\n"), (r"^\n+|\n+$", "")]:
        x = F.regexp_replace(x, pattern, by)
    return x


def purpose(statements: DataFrame, files: DataFrame) -> DataFrame:
    """The rows with purpose: the XML comment on the line before a statement, else its mapper, id, kind and tables."""
    lines = files.select(F.col("path").alias("file_path"), F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("__lines"))
    before = F.get("__lines", F.col("start_line") - 2)
    comment = F.when(F.col("start_line") > 1, F.nullif(F.regexp_extract(F.trim(before), r"^<!--\s*(.*?)\s*-->", 1), F.lit("")))
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    tables = F.coalesce(F.nullif(F.array_join("referenced_tables", ", "), F.lit("")), F.lit("-"))
    built = F.concat(F.substring_index("namespace", ".", -1), F.lit("."), "sql_id", F.lit(" — "), F.coalesce(kinds[F.col("sql_type")], "sql_type"), F.lit(" (테이블: "), tables, F.lit(")"))
    return statements.join(lines, "file_path", "left").withColumn("purpose", F.coalesce(comment, built)).drop("__lines")
