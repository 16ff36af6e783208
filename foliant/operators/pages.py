"""Ordered page lists: pages (doc_id, pos, ...) with positions from 0. Each operator works on all documents at once;
positions out of range change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _doc():
    return Window.partitionBy("doc_id")


def _order():
    return _doc().orderBy("pos")


def renumber(pages: DataFrame) -> DataFrame:
    return pages.withColumn("pos", (F.row_number().over(_order()) - 1).cast("int"))


def append(pages: DataFrame, more: DataFrame) -> DataFrame:
    """Pages of `more` after the last of their documents, in the order of their own positions."""
    last = pages.groupBy("doc_id").agg((F.max("pos") + 1).alias("_n"))
    after = renumber(more).join(last, "doc_id", "left").withColumn("pos", (F.col("pos") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return pages.unionByName(after)


def remove(pages: DataFrame, at: int) -> DataFrame:
    """Without the page at a position; a document's only page stays."""
    kept = pages.withColumn("_n", F.count("*").over(_doc())).where((F.col("pos") != at) | (F.col("_n") <= 1)).drop("_n")
    return renumber(kept)


def move(pages: DataFrame, at: int, by: int) -> DataFrame:
    """Swaps a page with its neighbour, where both exist."""
    to = at + by
    there = F.least(F.lit(at), F.lit(to)) >= 0
    n = F.count("*").over(_doc())
    pos = F.when(F.col("pos") == at, to).when(F.col("pos") == to, at).otherwise(F.col("pos"))
    return pages.withColumn("_n", n).withColumn("pos", F.when(there & (F.col("_n") > max(at, to)), pos).otherwise(F.col("pos")).cast("int")).drop("_n")


def update(pages: DataFrame, at: int, **values) -> DataFrame:
    """Sets columns of the page at a position."""
    return pages.withColumns({c: F.when(F.col("pos") == at, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def replace_bitmap(pages: DataFrame, at: int, w: int, h: int, body: bytes | None = None) -> DataFrame:
    """The page at a position with another picture; its filter and adjustments stay."""
    return update(pages, at, w=w, h=h, **({} if body is None else {"body": bytearray(body)}))


def rotate(pages: DataFrame, at: int) -> DataFrame:
    """The page at a position turned by 90 degrees: its sides w and h change places; its pixels turn with resample.rotate."""
    here = F.col("pos") == at
    return pages.withColumns({"w": F.when(here, F.col("h")).otherwise(F.col("w")), "h": F.when(here, F.col("w")).otherwise(F.col("h"))})


def select(pages: DataFrame, at: int) -> DataFrame:
    """doc_id, selected: the position chosen in each document that has it; others keep their first."""
    return pages.groupBy("doc_id").agg(F.when(F.max("pos") >= at, at).otherwise(0).cast("int").alias("selected"))


def reset(pages: DataFrame, at: int) -> DataFrame:
    return update(pages, at, brightness=0.0, contrast=1.0)


def clear(pages: DataFrame) -> DataFrame:
    return pages.limit(0)


def selection_after_removal(pages: DataFrame, selected: int) -> DataFrame:
    """doc_id, selected: the selection within what is left of each document once a page is removed."""
    left = F.greatest(F.count("*") - F.when(F.count("*") > 1, 1).otherwise(0) - 1, F.lit(0))
    return pages.groupBy("doc_id").agg(F.least(F.lit(selected), left).cast("int").alias("selected"))


def labels(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "pos", F.concat(F.lit("Page "), F.row_number().over(_order()), F.lit(" of "), F.count("*").over(_doc())).alias("label"))
