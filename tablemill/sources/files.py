"""File corpora: names, sizes, heads; archives and packages as entry rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.archive import normalize_paths
from tablemill.sinks.paths import filesystem

PROBE = 262_144
HEAD_SCHEMES = ("file", "hdfs", "viewfs")  # whose paths Python opens as Spark lists them


def scan_files(spark: SparkSession, path: str | list[str], head: int = PROBE) -> DataFrame:
    """``(path, name, size, modified, mime, content)`` with ``content`` cut to the first ``head`` bytes.

    Of larger files no more than the head is read, whatever their size, where Python knows the file system; elsewhere they are
    read whole and must stay below 2 GiB. A query that does not use ``content`` reads no file bodies.
    """
    files = spark.read.format("binaryFile").load(path)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if not all(_scheme(p, default) in HEAD_SCHEMES for p in ([path] if isinstance(path, str) else path)):
        return _listed(files, F.substring("content", 1, head))
    # the filter on the length reaches the source, which opens no other file
    small = _listed(files.where(F.col("length") <= head), F.col("content"))
    return small.unionByName(_listed(files.where(F.col("length") > head), _head("path", F.lit(head))))


def load_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same with whole contents, for the decoders (each file up to 2 GiB)."""
    return _listed(spark.read.format("binaryFile").load(path), F.col("content"))


def _listed(files: DataFrame, content: Column) -> DataFrame:
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.lit("").alias("mime"), content.alias("content"))


def _scheme(path: str, default: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path) or re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", default)
    return found.group(1) if found else "file"


@F.pandas_udf(T.BinaryType())
def _head(path: pd.Series, size: pd.Series) -> pd.Series:
    """The first bytes of each file, and no others."""
    def read(path: str, size: int) -> bytes:
        system, inner = filesystem(path)
        with system.open_input_file(inner) as stream:
            return stream.read(size)
    return pd.Series([read(*row) for row in zip(path, size)], dtype=object)


ENTRY_SCHEMA = ("idx bigint, path string, size bigint, compressed_size bigint, type string, directory boolean, "
                "encrypted boolean, modified bigint, method int, content binary, error string, occurrence int")
SINGLE = {"gzip": gzip, "bzip2": bz2, "xz": lzma}
TAR_MODES = {"tar": "r:", "tar-gzip": "r:gz", "tar-bzip2": "r:bz2", "tar-xz": "r:xz"}
ENTRY_COLUMNS = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]


CHUNK = 1 << 20
LIST_BYTES = 16 << 30  # what a listing inflates of one archive before it calls it a bomb
MEMBER_BYTES, ARCHIVE_BYTES = 1 << 30, 16 << 30  # what an extraction inflates of a member, and of all chosen ones of an archive


class _Budget:
    """Counts inflated bytes of one archive and of its current member, and stops at their limits."""

    def __init__(self, member: int, archive: int):
        self.member, self.archive, self.total = member, archive, 0

    def read(self, stream, keep: bool) -> tuple[bytes | None, int]:
        """A member's bytes (if they are wanted) and size; no more than a chunk beyond the limits is ever held."""
        parts, size = [], 0
        while chunk := stream.read(CHUNK):
            size += len(chunk)
            self.add(len(chunk))
            if keep and size > self.member:
                raise ValueError(f"ARCHIVE_EXTRACTION_BUDGET: A member holds more than {self.member} bytes.")
            if keep:
                parts.append(chunk)
        return (b"".join(parts) if keep else None), size

    def add(self, size: int) -> None:
        self.total += size
        if self.total > self.archive:
            raise ValueError(f"ARCHIVE_EXTRACTION_BUDGET: The archive grows beyond {self.archive} bytes.")


def _zip_entries(data: bytes, wanted, budget: _Budget) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = archive.infolist()
        chosen = [wanted(i.filename, i.file_size) and not i.is_dir() and not i.flag_bits & 1 for i in infos]
        if sum(i.file_size for i, c in zip(infos, chosen) if c) > budget.archive:
            budget.add(budget.archive + 1)  # said by the directory: nothing is inflated
        for i, (info, take) in enumerate(zip(infos, chosen)):
            folder, secret, body = info.is_dir(), bool(info.flag_bits & 1), None
            if take:
                with archive.open(info) as stream:
                    body, _ = budget.read(stream, True)
            # the name as stored: zipfile cuts it at a NUL byte and turns back slashes
            yield (i, info.orig_filename, info.file_size, info.compress_size, "directory" if folder else "file", folder,
                   secret, None, info.compress_type, body, None)


def _tar_entries(data: bytes, mode: str, wanted, budget: _Budget) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as archive:
        for i, info in enumerate(archive):
            kind = ("file" if info.isreg() else "directory" if info.isdir()
                    else "symlink" if info.issym() or info.islnk() else "other")
            size, body = info.size if kind == "file" else 0, None
            if kind == "file" and wanted(info.name, size):
                body, _ = budget.read(archive.extractfile(info), True)
            else:
                budget.add(size)  # a compressed archive inflates what it skips
            yield (i, info.name, size, None, kind, kind == "directory", False, int(info.mtime) * 1000, None, body, None)


def _single_entry(data: bytes, name: str, opener, wanted, budget: _Budget) -> Iterator[tuple]:
    inner = re.sub(r"\.(gz|gzip|bz2|bzip2|xz)$", "", name, flags=re.I) or "data"
    with opener.open(io.BytesIO(data)) as stream:
        body, size = budget.read(stream, wanted(inner, 0))
    yield (0, inner, size, len(data), "file", False, False, None, None, body, None)


def _folded(path: str) -> str:
    """Safe paths that become equal get equal keys."""
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))


def _entries(data: bytes, name: str, fmt: str, wanted, budget: _Budget) -> Iterator[tuple]:
    if fmt in TAR_MODES:
        yield from _tar_entries(data, TAR_MODES[fmt], wanted, budget)
    elif fmt in SINGLE:
        yield from _single_entry(data, name, SINGLE[fmt], wanted, budget)
    elif data[:2] == b"PK":
        yield from _zip_entries(data, wanted, budget)
    else:
        raise ValueError(f"ARCHIVE_FORMAT_UNSUPPORTED: {fmt}")


def _decode(files: DataFrame, archive: str, wanted, format_col: str, member_bytes: int = MEMBER_BYTES,
            archive_bytes: int = LIST_BYTES, only: str | None = None) -> DataFrame:
    """Entry rows; ``wanted(name, size)`` says whose content to take, a column ``only`` of folded names limits it by archive."""
    kind = files.schema[archive].dataType.simpleString()
    name = F.col("name") if "name" in files.columns else F.lit("data")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for key, file_name, fmt, data, names in zip(batch["k"], batch["n"], batch["f"], batch["c"], batch["o"]):
                seen, known = Counter(), None if names is None else set(names)
                choose = wanted if known is None else lambda n, size: _folded(n) in known and wanted(n, size)
                try:
                    for row in _entries(bytes(data), file_name, fmt, choose, _Budget(member_bytes, archive_bytes)):
                        if row[4] == "file":
                            seen[_folded(row[1])] += 1
                        rows.append((key, *row, seen[_folded(row[1])]))
                        held += len(row[9] or b"") + 200
                        if held > 16_000_000:
                            yield frame(rows)
                            rows, held = [], 0
                except Exception as error:  # a broken archive is a row of its own, not the end of the job
                    said = str(error) if str(error).startswith("ARCHIVE_") else f"ARCHIVE_CORRUPT: {error}"
                    rows.append((key, *(None,) * 10, said, None))
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[archive, *ENTRY_COLUMNS])
        for column in ("idx", "size", "compressed_size", "modified", "method", "occurrence"):
            out[column] = out[column].astype("Int64")
        for column in ("directory", "encrypted"):
            out[column] = out[column].astype("boolean")
        return out

    chosen = files.select(
        F.col(archive).alias("k"), name.alias("n"), F.col(format_col).alias("f"), F.col("content").alias("c"),
        (F.col(only) if only else F.lit(None).cast("array<string>")).alias("o"))
    return chosen.mapInPandas(decode, f"{archive} {kind}, {ENTRY_SCHEMA}")


def scan_archive_entries(files: DataFrame, archive: str = "path", format_col: str = "format_id") -> DataFrame:
    """One row per entry of ZIP, TAR (plain, gz, bz2, xz) and single-member gzip / bzip2 / xz files.

    ``files`` has ``content``, a format column and, for single-member files, ``name``. A file that cannot be read gives
    one row with ``error``. The key column is renamed ``archive_id`` when it is called ``path``.
    """
    keyed = files.withColumnRenamed("path", "archive_id") if archive == "path" else files
    return _decode(keyed, "archive_id" if archive == "path" else archive, _nothing, format_col).drop("content", "occurrence")


def _nothing(name: str, size: int) -> bool:
    return False


def _everything(name: str, size: int) -> bool:
    return True


def extract_archives(files: DataFrame, selected: DataFrame | None = None, archive: str = "archive_id",
                     format_col: str = "format_id", member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Regular entries with ``content`` and a ``name`` that is unique per archive (``.N`` for repeats).

    ``selected (archive, path)`` limits the result, and what is inflated. Directories, links and special entries are never
    extracted; unsafe paths carry their ``path_error`` and no content. Members are inflated in chunks; an archive that grows
    beyond the budgets stops there and has a row with ``error`` (a ZIP whose directory says so is not inflated at all).
    """
    only = None
    if selected is not None:
        wanted = normalize_paths(selected.select(archive, "path")).where("path_error IS NULL").select(archive, "path").distinct()
        files = files.join(wanted.groupBy(archive).agg(F.collect_set("path").alias("__only")), archive)
        only = "__only"
    entries = _decode(files, archive, _everything, format_col, member_bytes, archive_bytes, only)
    stopped = entries.where(F.col("error").startswith("ARCHIVE_EXTRACTION_BUDGET"))
    safe = normalize_paths(entries.where((F.col("type") == "file") & F.col("error").isNull()))
    if selected is not None:
        safe = safe.join(wanted, [archive, "path"], "left_semi")
    # repeats were counted while reading: the second a.txt of an archive is a.txt.2
    safe = safe.withColumn("name", F.when(F.col("occurrence") > 1, F.concat_ws(".", "path", F.col("occurrence").cast("string")))
                           .otherwise(F.col("path")))
    out = safe.withColumn("content", F.when(F.col("path_error").isNull(), F.col("content"))).withColumn(
        "name", F.when(F.col("path_error").isNull(), F.col("name"))).drop("occurrence")
    return out.unionByName(stopped.drop("occurrence"), allowMissingColumns=True)


def package_members(files: DataFrame, names: list[str], max_bytes: int = 32 * 1024 * 1024, archive: str = "archive_id"
                    ) -> DataFrame:
    """Every member of ZIP packages, with ``content`` for those whose name fits one of the patterns.

    A member that fits but is larger than ``max_bytes`` is not read and says so in ``error``.
    """
    pattern = re.compile("|".join(f"(?:{n})" for n in names))

    def wanted(name: str, size: int) -> bool:
        return size <= max_bytes and pattern.fullmatch(name) is not None

    members = _decode(files.withColumn("__zip", F.lit("zip")), archive, wanted, "__zip")
    large = F.col("error").isNull() & (F.col("size") > max_bytes) & F.col("path").rlike(f"^(?:{pattern.pattern})$")
    return members.withColumn("error", F.when(large, F.concat(
        F.lit("PACKAGE_MEMBER_LIMIT: "), "path", F.lit(f" is larger than {max_bytes} bytes and was not read."))).otherwise(
        F.col("error")))
