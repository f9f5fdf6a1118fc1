"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank ``(rank - u) / size of source`` orders
all rows, with u between 0 and 1 a seeded hash of the source, so that many small sources do not meet in the middle. Equal cuts
of that order give shards whose sizes differ by at most one and which all hold every source in proportion (law ``rows``).

No rank comes from a window over a whole source or table. Ranks are counted per (source, hash range) and then per range
of the fraction; a window works inside one range, and one count per range carries over. Ranges split a source of any
size evenly, because the hash and the fraction are uniform. Only columns that the caller uses travel through the two
shuffles, so a manifest without texts stays thin.

Defined results: null text has no bytes; a null source is a source of its own; the hash is of id and text, so rows without an
id are spread as well; ties of the hash go by id; rows repeated in full are kept, each with its own slot; an empty table gives an empty result; other columns
pass through, but those with a new name give way (and names that start with ``__`` are taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
OVERHEAD = 16
NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def interleave(df: DataFrame, shards: int = 40, seed: str = "shard", stratum: str = "source", key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``df`` with ``size, text_crc32, law, shard, slot, grown_shard`` (null: this law does not grow in place)."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("none"))
    rows = (df.withColumns({"size": (F.octet_length(body) + OVERHEAD).cast("bigint"), "text_crc32": F.crc32(body),
                            "__s": name})
            .withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "text_crc32", "size")))
            .withColumn("__r", F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") * RANGES))
    rows = rows.withColumn("__r", F.shiftright("__r", 32).cast("int"))

    counts = rows.groupBy("__s", "__r").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__s")
    before = counts.select("__s", "__r", F.sum("__n").over(whole).alias("__total"),
                           (F.sum("__n").over(whole.orderBy("__r")) - F.col("__n")).alias("__before"))
    offset = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__s")), 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)
    order = ["__h", key]
    ranked = (rows.withColumn("__i", F.row_number().over(Window.partitionBy("__s", "__r").orderBy(*order)))
              .join(before, ["__s", "__r"])
              .withColumn("__f", (F.col("__before") + F.col("__i") - offset) / F.col("__total"))
              .withColumn("__c", F.floor(F.col("__f") * RANGES).cast("int"))
              .drop("__r", "__i", "__before", "__total"))

    # at most RANGES rows, whatever the table
    cells = ranked.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(F.lit(0))
    starts = cells.select("__c", F.sum("__n").over(every).alias("__all"),
                          (F.sum("__n").over(every.orderBy("__c")) - F.col("__n")).alias("__start"))
    placed = (ranked.withColumn("__j", F.row_number().over(Window.partitionBy("__c").orderBy("__f", *order)))
              .join(F.broadcast(starts), "__c")
              .withColumn("__p", F.col("__start") + F.col("__j") - 1))
    # exact in integers: p * shards div all
    shard = F.expr(f"__p * {shards} div __all")
    first = F.expr(f"((__p * {shards} div __all) * __all + {shards} - 1) div {shards}")
    return (placed.withColumns({"law": F.lit("rows"), "shard": shard.cast("int"), "slot": F.col("__p") - first,
                                "grown_shard": F.lit(None).cast("int")})
            .select(*[c for c in df.columns if c.lower() not in NEW], *NEW))
