"""Sinks: CSV, TSV, JSON, JSON Lines, Parquet, Arrow, SQLite shards, archives, sheets."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import math
import os
import re
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from tablemill.operators.archive import normalize_paths
from tablemill.operators.jsonbridge import coerce_cells, json_export_values
from tablemill.operators.naming import unique_archive_paths
from tablemill.sinks.paths import PartFiles

# ---- text and Parquet: Spark's own writers ----


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, so that flat formats can hold them."""
    def cell(f: T.StructField):
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        col = F.col(f"`{f.name}`")
        return (F.to_json(col, {"ignoreNullFields": "false"}) if nested else col).alias(f.name)
    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, delimiter: str = "auto", header: bool = True, mode: str = "errorifexists") -> None:
    """CSV part files; ``auto`` writes commas. Quotes inside cells are doubled."""
    flat(df).write.mode(mode).options(
        sep="," if delimiter == "auto" else delimiter, header=header, quote='"', escape='"', emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    write_csv(df, path, "\t", header, mode)


def write_jsonl(df: DataFrame, path: str, bigint_as_string: bool = True, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls kept."""
    json_export_values(df, bigint_as_string).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _number(value: float) -> str:
    if value == math.floor(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    return re.sub(r"e([+-])0*", r"e\1", text)


def _pretty(value, pad: str) -> str:
    """JSON text with two blanks per level; numbers keep the text they came with."""
    if isinstance(value, dict) and value:
        inner = ",\n".join(f"{pad}  {json.dumps(k, ensure_ascii=False)}: {_pretty(v, pad + '  ')}" for k, v in value.items())
        return "{\n" + inner + "\n" + pad + "}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(pad + "  " + _pretty(v, pad + "  ") for v in value) + "\n" + pad + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def write_json_array(df: DataFrame, path: str, bigint_as_string: bool = True, mode: str = "errorifexists") -> None:
    """JSON arrays with two-blank indent, nulls kept; every part file is a whole array of its own."""
    export = json_export_values(df, bigint_as_string)
    rows = export.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in export.columns]), {"ignoreNullFields": "false"})
                         .alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an element is written when it is known whether another one follows
        last = None
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append("[" if last is None else last + ",")
                last = "  " + _pretty(json.loads(text), "  ")
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]"] if last is None else [last, "]"], pa.string())})

    rows.mapInArrow(lines, "value string").write.mode(mode).text(path)


# ---- part files written by tasks ----


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class PartWriter:
    """Commit and clean-up shared by the writers below."""

    def __init__(self, folder: str, ending: str):
        self.parts = PartFiles(folder, ending)

    def commit(self, messages) -> None:
        self.parts.commit([m.path for m in messages if m is not None and m.path])

    def abort(self, messages) -> None:
        self.parts.clear()


def _partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


class ArrowFileWriter(PartWriter, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target = None
        with self.parts.attempt(_partition()) as (system, path):
            sink = writer = None
            for batch in iterator:
                if writer is None:
                    sink = system.open_output_stream(path, compression=None)
                    writer, target = pa.ipc.new_file(sink, batch.schema), path
                writer.write_batch(batch)
            if writer is not None:
                writer.close()
                sink.close()
        return Written(target)


class ArrowSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablemill_arrow"

    def writer(self, schema, overwrite: bool) -> ArrowFileWriter:
        return ArrowFileWriter(self.options["path"], ".arrow")


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file per non-empty partition."""
    df.sparkSession.dataSource.register(ArrowSink)
    df.write.format("tablemill_arrow").mode("append").option("path", path).save()


# Column affinities of exported databases.
def _affinity(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "INTEGER"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "REAL"
    return "BLOB" if isinstance(dtype, T.BinaryType) else "TEXT"


class SqliteShardWriter(PartWriter, DataSourceWriter):
    def __init__(self, folder: str, columns: list[tuple[str, str]]):
        super().__init__(folder, ".sqlite")
        self.columns = columns

    def write(self, iterator) -> Written:
        names = [n.replace('"', '""') for n, _ in self.columns]
        layout = ", ".join(f'"{n}" {kind}' for n, (_, kind) in zip(names, self.columns))
        marks = ", ".join("?" * len(names))
        first = next(iterator, None)
        if first is None:
            return Written(None)
        # the database is built on the task's own disk and copied as one stream
        handle, scratch = tempfile.mkstemp(suffix=".sqlite")
        os.close(handle)
        try:
            db = sqlite3.connect(scratch, isolation_level=None)
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE data ({layout})")
            db.execute("BEGIN")
            db.execute(f"INSERT INTO data VALUES ({marks})", tuple(first))
            db.executemany(f"INSERT INTO data VALUES ({marks})", (tuple(row) for row in iterator))
            db.execute("COMMIT")
            db.close()
            with self.parts.attempt(_partition()) as (system, path):
                with system.open_output_stream(path, compression=None) as out, open(scratch, "rb") as data:
                    while block := data.read(8 << 20):
                        out.write(block)
        finally:
            os.unlink(scratch)
        return Written(path)


class SqliteSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablemill_sqlite_shards"

    def writer(self, schema, overwrite: bool) -> SqliteShardWriter:
        columns = json.loads(self.options["columns"])
        return SqliteShardWriter(self.options["path"], [tuple(c) for c in columns])


def write_sqlite_shards(df: DataFrame, folder: str, affinity: Mapping[str, str] | None = None) -> None:
    """One SQLite file with a table ``data`` per non-empty partition.

    Column kinds follow the schema, or ``affinity`` (as inferred from JSON rows). Booleans become 1 and 0, nested
    values JSON text, times and decimals text.
    """
    coerced = coerce_cells(df)
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BinaryType, T.StringType)
    ready = coerced.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else
                          F.col(f"`{f.name}`").cast("string").alias(f.name) for f in coerced.schema.fields])
    columns = [(f.name, (affinity or {}).get(f.name) or _affinity(f.dataType)) for f in df.schema.fields]
    df.sparkSession.dataSource.register(SqliteSink)
    ready.write.format("tablemill_sqlite_shards").mode("append").option("path", folder).option(
        "columns", json.dumps(columns)).save()


# ---- archives ----

SHARD_BYTES = 64 << 20  # of content in an archive
ARCHIVE_ENDINGS = {"zip": ".zip", "tar": ".tar", "tar-gzip": ".tar.gz", "tar-bzip2": ".tar.bz2", "tar-xz": ".tar.xz"}


class ArchiveWriter(PartWriter, DataSourceWriter):
    """Rows ``(path, content)`` of a partition, in path order, as one archive with fixed times and owners."""

    def __init__(self, folder: str, fmt: str, level: int):
        super().__init__(folder, ARCHIVE_ENDINGS[fmt])
        self.fmt, self.level = fmt, level

    def write(self, iterator) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None)
        with self.parts.attempt(_partition()) as (system, path):
            with system.open_output_stream(path, compression=None) as out:
                (self._zip if self.fmt == "zip" else self._tar)(out, first, iterator)
        return Written(path)

    def _zip(self, out, first, rest) -> None:
        kind = zipfile.ZIP_STORED if self.level == 0 else zipfile.ZIP_DEFLATED
        with zipfile.ZipFile(_Forward(out), "w", kind, compresslevel=self.level or None) as archive:
            for path, content in chain([first], rest):
                archive.writestr(zipfile.ZipInfo(path), content, kind, self.level or None)

    def _tar(self, out, first, rest) -> None:
        """Blocks of 512 bytes, closed by two empty ones."""
        forward = _Forward(out)
        stream = {"tar": lambda: forward, "tar-gzip": lambda: gzip.GzipFile("", "wb", fileobj=forward, mtime=0),
                  "tar-bzip2": lambda: bz2.BZ2File(forward, "wb"), "tar-xz": lambda: lzma.LZMAFile(forward, "wb")}[self.fmt]()
        for path, content in chain([first], rest):
            info = tarfile.TarInfo(path)
            info.size, info.mode, info.mtime = len(content), 0o644, 0
            stream.write(info.tobuf(tarfile.USTAR_FORMAT, "utf-8", "strict"))
            stream.write(content)
            stream.write(b"\0" * (-len(content) % 512))
        stream.write(b"\0" * 1024)
        if stream is not forward:
            stream.close()


class _Forward(io.RawIOBase):
    """A stream that only goes forward, for writers that ask where they are."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablemill_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options["fmt"], int(self.options["level"]))


def write_archive_shards(files: DataFrame, folder: str, fmt: str = "zip", level: int = 6, preserve_paths: bool = True,
                         shards: int | None = None, order: str = "idx") -> None:
    """Pack ``files (idx, path, content)`` into archives, one per shard.

    An archive is written and read by one task, so there are more than ``shards`` where these would hold more than
    ``SHARD_BYTES`` of content each. Paths are made safe and unique over the whole set. Only the small columns take part in that; the contents join
    the finished names afterwards. An unsafe path, or one that USTAR cannot hold, is an error.
    """
    from tablemill.functions.text import ustar_split

    if fmt not in ARCHIVE_ENDINGS:
        raise ValueError("ARCHIVE_TARGET_UNSUPPORTED: Unsupported archive output.")
    level = max(0, min(9, round(level)))
    named = normalize_paths(files.select(order, "path"))
    checked = named.withColumn("path", F.when(
        F.col("path_error").isNotNull(), F.raise_error(F.col("path_error")).cast("string")).otherwise(F.col("path"))).drop("path_error")
    if not preserve_paths:
        checked = checked.withColumn("path", F.substring_index("path", "/", -1))
    unique = unique_archive_paths(checked, "path", order)
    if fmt != "zip":
        split = ustar_split(F.col("unique_path"))["error"]
        unique = unique.withColumn("unique_path", F.when(split.isNotNull(), F.raise_error(split).cast("string"))
                                   .otherwise(F.col("unique_path")))
    packed = files.select(order, "content").join(unique.select(order, "unique_path"), order)
    if shards:
        held = files.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
        packed = packed.repartition(max(shards, math.ceil(held / SHARD_BYTES)), order)
    spark = files.sparkSession
    spark.dataSource.register(ArchiveSink)
    packed.sortWithinPartitions(order).select(F.col("unique_path").alias("path"), "content").write.format(
        "tablemill_archive").mode("append").options(path=folder, fmt=fmt, level=level).save()


# ---- sheets ----

UNSAFE_SHEET = r'[\\/:*?"<>|]'


def sheet_paths(names: list[str], stem: str, ext: str) -> list[str]:
    """First sheet is the primary output; the others are side files named after the sheet."""
    return [f"{stem}.{ext}" if i == 0 else f"{stem}-assets-{re.sub(UNSAFE_SHEET, '_', n)}.{ext}"
            for i, n in enumerate(names)]


def write_sheets(tables: Mapping[str, DataFrame], folder: str, fmt: str, stem: str = "workbook", **options) -> list[str]:
    """Every sheet as a dataset of its own below ``folder``; returns their paths in order."""
    writers = {"csv": (write_csv, "csv"), "tsv": (write_tsv, "tsv"), "json-data": (write_json_array, "json"),
               "jsonl": (write_jsonl, "jsonl")}
    if fmt not in writers:
        raise ValueError(f"SPREADSHEET_TARGET_UNSUPPORTED: {fmt}")
    write, ext = writers[fmt]
    paths = [f"{folder.rstrip('/')}/{p}" for p in sheet_paths(list(tables), stem, ext)]
    for path, df in zip(paths, tables.values()):
        write(df, path, **options)
    return paths
