"""The business database over JDBC: partitioned reads, a read-only login with a statement limit, writes in one transaction.

Spark writes each partition in a transaction of its own, so a failed job leaves some of its rows. Here rows first go to a
staging table, and one statement in one transaction moves them: readers of the target see all of them or none. A staging
table that a lost driver leaves behind has a name of its own and is never read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TIMEOUT_SEC = 10
#: CHAR and VARCHAR among the numbers of JDBC's types.
TEXT_TYPES = (1, 12)
#: A name that needs no quoting, with or without a schema before it.
_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?")


def _checked(*names: str) -> None:
    for name in names:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a plain name: {name}")


@dataclass
class Database:
    """A JDBC database. options: user, password, driver and whatever else its driver takes."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self, **more):
        return self.spark.read.format("jdbc").options(url=self.url, **self.options, **more)

    def table(self, name: str, by: str | None = None, parts: int = 8, fetch: int = 10_000) -> DataFrame:
        """A table, read by `parts` connections over equal ranges of the number, date or timestamp column `by`; null and
        outlying values belong to the first and last range. Filters and columns are pushed to the database."""
        _checked(name)
        reader = self._reader(dbtable=name, fetchsize=str(fetch))
        if by is None:
            return reader.load()
        _checked(by)
        low, high = self._reader(query=f"SELECT min({by}) AS lo, max({by}) AS hi FROM {name}").load().first()
        if low is None or low == high:
            return reader.load()
        return reader.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()

    def query(self, sql: str, timeout_sec: int = TIMEOUT_SEC, session_statement: str | None = None) -> DataFrame:
        """The rows of a SELECT. The statement stands inside another SELECT, so one that writes is a syntax error; each
        connection first runs session_statement (on MariaDB "SET SESSION TRANSACTION READ ONLY"), and the database ends a
        statement at the limit."""
        more = {"sessionInitStatement": session_statement} if session_statement else {}
        return self._reader(query=sql.rstrip().rstrip(";"), queryTimeout=str(timeout_sec), **more).load()

    @contextmanager
    def _transaction(self) -> Iterator[object]:
        """A connection from the driver, for statements that move no rows through it."""
        jvm = self.spark._jvm
        if driver := self.options.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        given = jvm.java.util.Properties()
        for k, v in self.options.items():
            given.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def execute(self, *statements: str) -> list[int]:
        """Runs statements in one transaction; rows that each has changed."""
        with self._transaction() as connection:
            counts = []
            for sql in statements:
                statement = connection.createStatement()
                counts.append(statement.executeUpdate(sql))
                statement.close()
            return counts

    def write(self, df: DataFrame, name: str, mode: str = "append", key: tuple[str, ...] = ()) -> int:
        """Rows into an existing table, all or none; how many. mode: append; replace (all old rows go); merge (old rows with
        the key of a new one go, so a row whose key exists is changed and another one is added). Columns of the table that
        df lacks are null, or their default."""
        if mode not in ("append", "replace", "merge") or (mode == "merge") != bool(key):
            raise ValueError("mode must be append or replace, or merge with a key")
        columns = ", ".join(df.columns)
        _checked(name, *df.columns, *key)
        staging = f"{name.split('.')[-1]}_{uuid.uuid4().hex[:12]}"
        try:
            types = ", ".join(f"`{c}` VARCHAR({n})" for c, n in self._lengths(name, df.columns).items())
            more = {"createTableColumnTypes": types} if types else {}
            df.write.format("jdbc").options(url=self.url, dbtable=staging, **more, **self.options).save()
            gone = []
            if mode == "replace":
                gone = [f"DELETE FROM {name}"]
            elif mode == "merge":
                same = " AND ".join(f"s.{self._staged(k)} = {name}.{k}" for k in key)
                gone = [f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})"]
            moved = ", ".join(self._staged(c) for c in df.columns)
            return self.execute(*gone, f"INSERT INTO {name} ({columns}) SELECT {moved} FROM {staging}")[-1]
        finally:
            with self._transaction() as connection:
                found = [connection.getMetaData().getTables(None, None, n, None).next() for n in (staging, staging.upper())]
                if any(found):
                    connection.createStatement().executeUpdate(f"DROP TABLE {staging}")

    def _lengths(self, name: str, columns: list[str]) -> dict[str, int]:
        """The lengths of a table's text columns: text of no stated length would become large objects, which do not compare."""
        schema, _, bare = name.rpartition(".")
        wanted, out = {c.upper(): c for c in columns}, {}
        with self._transaction() as connection:
            for form in {bare, bare.upper()}:
                rows = connection.getMetaData().getColumns(None, (schema or None) and schema.upper(), form, None)
                while rows.next():
                    column = rows.getString("COLUMN_NAME").upper()
                    if column in wanted and rows.getInt("DATA_TYPE") in TEXT_TYPES:
                        out[wanted[column]] = rows.getInt("COLUMN_SIZE")
        return out

    def _staged(self, column: str) -> str:
        """A column of a staging table as Spark has named it: quoted, as its dialect does."""
        dialect = self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
        return dialect.quoteIdentifier(column)
