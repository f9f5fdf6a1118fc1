"""Resumable intake of files: only what has not been seen before is looked at."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablemill.operators.formats import compound_suffix, detect_formats
from tablemill.sources.files import PROBE

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_available(spark: SparkSession, inbox: str, out: str, checkpoint: str, files_per_batch: int = 10_000
                     ) -> StreamingQuery:
    """Detect the formats of all new files below ``inbox`` and append them to the Parquet catalogue ``out``.

    The checkpoint remembers the files that are done, so a second run takes the new ones only and a run that was cut
    off goes on where it stopped. The file sink writes every batch exactly once.
    """
    arrived = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").load(inbox)
        .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit("").alias("mime"),
                F.col("length").alias("size"), F.substring("content", 1, PROBE).alias("content"))
    )
    found = compound_suffix(detect_formats(arrived)).select(
        "path", "name", "size", "format_id", "confidence", "reasons", "warnings")
    return (found.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
