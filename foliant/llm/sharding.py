"""Shards by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order; the row of rank r among the n of its source gets
the fraction (r - 1/2) / n. Sorted by fraction, every stretch of rows holds the sources in their
proportions, and cutting that order into equal stretches gives shards that match the mixture and whose
row counts differ by one at most (law `rows`).

Neither order is made by one task. A row's random order is an md5 of its id, size and checksum, so that rows without
an id, or of one id, spread too; the first hex digits deal each source, however large, evenly into cells; ranks are
numbered within cells and moved up by the counts of the cells before. Fractions are uniform by construction, so equal stretches of them are even cells too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 4096  # cells of each order; a hot source of 10^10 rows has 2.4 million rows in one


def interleaved_shards(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: place in the shard, from 0 without gaps.
    Rows with a null source are a source of their own. A null text has the checksum of the empty text.
    Rows alike in id, text and source are interchangeable; an empty table gives no rows; further
    columns of docs are not read. Equal texts are not held together: counts at most one apart and
    whole groups of any size exclude each other.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    key = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("size"), F.lit(":"), F.col("text_crc32")), "UTF-8"))
    rows = rows.withColumn("_u", key).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = cut(rows.withColumn("_cell", F.conv(F.substring("_u", 1, 3), 16, 10).cast("int")))  # the texts are read once

    upto = Window.partitionBy("_s").orderBy("_cell")
    cells = (
        rows.groupBy("_s", "_cell").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy("_s")))
        .select("_s", "_cell", F.coalesce("_before", F.lit(0)).alias("_before"), "_total")
    )
    within = Window.partitionBy("_s", "_cell").orderBy("_u", "doc_id", "text_crc32", "size")
    ranked = rows.join(cells, ["_s", "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(within))
    ranked = ranked.withColumn("_at", (F.col("_rank") - F.lit(0.5)) / F.col("_total"))
    ranked = ranked.withColumn("_band", F.least(F.floor(F.col("_at") * CELLS), F.lit(CELLS - 1)).cast("int"))

    # the row counts of the bands follow from the totals of the sources alone, but summing them is as cheap
    bands = ranked.groupBy("_band").agg(F.count("*").alias("_n"))
    bands = bands.select(
        "_band",
        F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"),
    )
    place = F.row_number().over(Window.partitionBy("_band").orderBy("_at", "_s", "_u", "doc_id", "text_crc32", "size"))
    placed = ranked.join(bands, "_band").withColumn("_g", F.col("_first") + place - 1)
    shard = F.expr(f"(_g * {shards}) div _rows")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_g") - F.expr(f"(_shard * _rows + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
