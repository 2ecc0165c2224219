"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are put into a seeded random order within each source, each gets the fractional
rank ``(rank - u) / n`` of its source (``u`` in (0, 1) from a hash of the source, so that
small sources are spread and do not all sit at one half), all rows are ordered by that
fraction, and the order is cut into equal runs: every shard holds ``n / shards`` rows of
each source, give or take one, and shard sizes differ by one row at most (law ``rows``).

Neither ranking sorts a whole source or the whole table in one task.  A rank is the row
number within a bucket (a range of the shuffling hash, or of the fraction, both uniform
by construction) plus the number of rows in earlier buckets, so a source with a third of
all rows is spread over as many buckets as any other.  Only ids, hashes and sizes are
shuffled; texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

#: Rows of a bucket that are wanted, and the fewest and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 256, 1 << 16


def _uniform(hex_digits: Column) -> Column:
    """[0, 2^32) of the first 8 hex digits."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 16, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """One row per input row: key, stratum, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard``, ``slot``.

    Null strata form a stratum of their own.  Null keys and repeated rows are kept; equal
    rows may swap places, which changes nothing.  The seeded order is by a hash of key, checksum and
    size, so rows that share a null or repeated key are spread like any, and ties are rows equal in
    all three, in the order of their strata.  Null texts have size 1 and checksum 0, long ones are read
    whole.  An empty table gives an empty result.  Extra columns are ignored.
    """
    n_rows = docs.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS)))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{stratum}`").alias("stratum"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
    ).withColumns({"h": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("")), "crc", "size")), "s": F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("")), }).withColumn("b", F.floor(_uniform(F.col("h")) * buckets / F.lit(1 << 32)))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.groupBy("s", "b").agg(F.count("*").alias("c")).select("s", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"), F.sum("c").over(Window.partitionBy("s")).alias("n"))
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "key", "crc", "size"))).join(offsets, ["s", "b"])
    start = (_uniform(F.md5(F.concat(F.lit(f"{seed}:"), F.col("s")))) + 0.5) / F.lit(1 << 32)
    fractions = written(ranked.select("key", "stratum", "size", "crc", "h", "s", ((F.col("earlier") + F.col("r") - start) / F.col("n")).alias("f")).withColumn("g", F.floor(F.col("f") * buckets)), "fractions")
    so_far = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets' counts only, at most MOST_BUCKETS rows
    at = fractions.groupBy("g").agg(F.count("*").alias("c")).select("g", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("earlier"))
    place = fractions.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("f", "s", "h", "key", "crc", "size"))).join(at, "g").withColumn("p", F.col("earlier") + F.col("r") - 1)
    total = F.lit(max(1, n_rows)).cast("long")
    cut = place.withColumn("shard", F.expr(f"p * {shards} div {max(1, n_rows)}").cast("int"))
    return cut.select(F.col("key").alias(key), F.col("stratum").alias(stratum), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("p") - F.floor((F.col("shard") * total + (shards - 1)) / shards)).cast("long").alias("slot"))
