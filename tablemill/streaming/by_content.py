"""Intake of files by what they hold: a state table keyed by digest, beside a listing.

A run lists the inbox and leaves out files whose path, time and size the state knows. Only the others are opened, and only those
not older than the oldest of them (the file source prunes by time). A file is ``new`` when its digest was never seen,
``changed`` when it also lies at a known path, and ``known`` when its content is in the state or in an earlier file of the same
run, whatever its name; known files are noted but not taken.

The state is a folder per run. A run first writes what it takes, then its state, both by overwriting the folder of its
number; a run that is cut off in between is done again with the same number and leaves nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.formats import compound_suffix, detect_formats
from tablemill.sources.files import PROBE

STATE = "path string, modified timestamp, length bigint, digest binary, status string, run int"


def _state(spark: SparkSession, state: str) -> DataFrame | None:
    """The rows of all finished runs."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(STATE).parquet(state)


def intake_by_content(spark: SparkSession, inbox: str, out: str, state: str) -> DataFrame:
    """One run; returns ``path, modified, length, digest, status, run`` of the files that were opened.

    Taken files are appended to ``out`` with their format. Runs of one state do not overlap.
    """
    known = _state(spark, state)
    run = 0 if known is None else (known.agg(F.max("run")).first()[0] or 0) + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inbox)
    listing = files.select("path", F.col("modificationTime").alias("modified"), "length")
    fresh = listing if known is None else listing.join(known.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    oldest = fresh.agg(F.min("modified")).first()[0]
    opened = files.where(F.lit(False) if oldest is None else F.col("modificationTime") >= F.lit(oldest)).withColumnRenamed(
        "modificationTime", "modified")
    if known is not None:
        opened = opened.join(known.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    told = opened.select("path", "modified", "length", F.unhex(F.sha2("content", 256)).alias("digest"),
                         F.substring("content", 1, PROBE).alias("content"))
    folder = f"{state.rstrip('/')}/run={run}"
    draft = f"{out.rstrip('/')}/_opened/run={run}"  # names with an underscore are no data
    told.write.mode("overwrite").parquet(draft)
    told = spark.read.parquet(draft)
    # of equal contents in one run the first path is taken
    first = told.groupBy("digest").agg(F.min("path").alias("first"))
    told = told.join(first, "digest")
    if known is None:
        status = F.when(F.col("path") == F.col("first"), "new").otherwise("known")
    else:
        told = told.join(known.select("digest").distinct().withColumn("seen", F.lit(True)), "digest", "left").join(
            known.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
        status = F.when(F.col("seen") | (F.col("path") != F.col("first")), "known").when(F.col("there"), "changed").otherwise("new")
    marked = told.withColumn("status", status)
    taken = marked.where("status <> 'known'").select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit("").alias("mime"), F.col("length").alias("size"), "content", "digest")
    found = compound_suffix(detect_formats(taken)).select("path", "name", "size", "digest", "format_id", "confidence", "reasons", "warnings")
    found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/run={run}")
    rows = marked.select("path", "modified", "length", "digest", "status").withColumn("run", F.lit(run))
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(STATE).parquet(folder)
