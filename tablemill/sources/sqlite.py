"""SQLite tables as a Spark data source: files in parallel, large tables in row-id ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablemill.sinks.paths import list_files, local_path

RANGE_ROWS = 500_000
USER_OBJECTS = ("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' "
                "ORDER BY type, name LIMIT {cap}")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{local_path(path)}?mode=ro&immutable=1", uri=True)


def _spark_type(declared: str) -> str:
    """SQLite's own affinity rules, as Spark types."""
    name = declared.upper()
    if "INT" in name:
        return "bigint"
    if any(part in name for part in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in name:
        return "binary"
    if any(part in name for part in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "string"


def _first_table(db: sqlite3.Connection) -> str:
    row = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' "
                     "ORDER BY name LIMIT 1").fetchone()
    if row is None:
        raise ValueError("SQLITE_TABLE_REQUIRED: Database contains no user table.")
    return row[0]


class TablePart(InputPartition):
    """Rows of one table of one file, limited to a row-id range when there is one."""

    def __init__(self, path: str, table: str, low: int | None, high: int | None):
        self.path, self.table, self.low, self.high = path, table, low, high


class SqliteSource(DataSource):
    """``format("tablemill_sqlite")`` with options ``path`` (file or folder) and ``table``."""

    @classmethod
    def name(cls) -> str:
        return "tablemill_sqlite"

    def _files(self) -> list[str]:
        return list_files(self.options["path"], (".sqlite", ".sqlite3", ".db", ".db3"))

    def schema(self) -> str:
        with closing(_open(self._files()[0])) as db:
            table = self.options.get("table") or _first_table(db)
            columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        return ", ".join(f"`{c[1].replace('`', '``')}` {_spark_type(c[2] or '')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self._files(), self.options.get("table"), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, files: list[str], table: str | None, schema):
        self.files, self.table = files, table
        self.types = [f.dataType.typeName() for f in schema.fields]
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[TablePart]:
        parts = []
        for path in self.files:
            with closing(_open(path)) as db:
                table = self.table or _first_table(db)
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
                except sqlite3.OperationalError:  # views and tables without row ids
                    low = high = None
            if low is None:
                parts.append(TablePart(path, table, None, None))
            else:
                parts += [TablePart(path, table, a, min(a + RANGE_ROWS - 1, high))
                          for a in range(low, high + 1, RANGE_ROWS)]
        return parts

    def read(self, partition: TablePart) -> Iterator[tuple]:
        exact = {"long": int, "double": (int, float), "string": str, "binary": bytes}
        kinds = [exact[t] for t in self.types]

        def fit(value, kind, name):
            if value is None or isinstance(value, kind):
                return float(value) if kind == (int, float) and value is not None else value
            if kind is str:
                return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
            raise ValueError(f"SQLITE_TYPE_MISMATCH: column {name} holds {type(value).__name__}; read it as text")

        columns = ", ".join(_quoted(n) for n in self.names)
        text = f"SELECT {columns} FROM {_quoted(partition.table)}"
        bounds: tuple = ()
        if partition.low is not None:
            text, bounds = text + " WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
        with closing(_open(partition.path)) as db:
            for row in db.execute(text, bounds):
                yield tuple(fit(v, k, n) for v, k, n in zip(row, kinds, self.names))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A table of one SQLite file, or of every SQLite file of a folder; default is the first user table by name."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("tablemill_sqlite").option("path", path)
    return (reader.option("table", table) if table else reader).load()


def sqlite_catalogue(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Tables and views of SQLite files: ``(path, name, type, rows, columns, user_version, application_id, warning)``.

    One task per group of files; all objects, or the first ``cap`` per file, are listed in (type, name) order.
    """
    files = spark.createDataFrame([(p,) for p in list_files(path, (".sqlite", ".sqlite3", ".db", ".db3"))], "path string")

    def inspect(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file in batch["path"]:
                with closing(_open(file)) as db:
                    version = db.execute("PRAGMA user_version").fetchone()[0]
                    app = db.execute("PRAGMA application_id").fetchone()[0]
                    objects = db.execute(USER_OBJECTS.format(cap=-1 if cap is None else cap)).fetchall()
                    warning = f"Only the first {cap} tables/views are shown." if cap is not None and len(objects) >= cap else None
                    for name, kind in objects:
                        try:
                            rows = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
                        except sqlite3.Error:
                            rows = None
                        columns = [{"name": c[1], "type": c[2], "nullable": not c[3]}
                                   for c in db.execute(f"PRAGMA table_info({_quoted(name)})")]
                        out.append((file, name, kind, rows, columns, version, app, warning))
            yield pd.DataFrame(out, columns=["path", "name", "type", "rows", "columns", "user_version", "application_id",
                                             "warning"])

    return files.repartition(F.col("path")).mapInPandas(
        inspect, "path string, name string, type string, rows bigint, columns array<struct<name:string,type:string,"
        "nullable:boolean>>, user_version bigint, application_id bigint, warning string")
