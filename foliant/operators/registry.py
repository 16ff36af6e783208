"""The document registry: search, newest-first listing, insertion, deletion and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

RECENT = 6


def search(reg: DataFrame, query: str) -> DataFrame:
    """All records for a blank query, else those with the trimmed query in title or text, whatever the case."""
    q = query.strip()
    if not q:
        return reg
    return reg.where(scalar.contains_folded(F.col("title"), q) | scalar.contains_folded(F.coalesce("searchText", F.lit("")), q))


def newest(reg: DataFrame) -> DataFrame:
    """Order of insertion, last first; ids grow with it."""
    return reg.orderBy(F.desc("id"))


def recent(reg: DataFrame, n: int = RECENT) -> DataFrame:
    return newest(reg).limit(n)


def insert(reg: DataFrame, records: DataFrame) -> DataFrame:
    """Records get ids after the largest there is, in the order of their `ord`."""
    top = reg.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = records.crossJoin(F.broadcast(top))  # one row
    numbered = numbered.withColumn("id", F.col("_top") + F.row_number().over(Window.orderBy("ord")))
    return reg.unionByName(numbered.select(*reg.columns))


def delete(reg: DataFrame, doc_id: int) -> DataFrame:
    return reg.where(F.col("id") != doc_id)


def delete_many(reg: DataFrame, ids: DataFrame) -> DataFrame:
    return reg.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_anti")


def cascade(reg: DataFrame, doc_id: int) -> DataFrame:
    """seq, uri of the files that go with a record: its PDF, then its JPGs."""
    uris = F.filter(F.concat(F.array("pdfUri"), "jpgUris"), lambda u: u.isNotNull())
    return reg.where(F.col("id") == doc_id).select("id", F.posexplode(uris).alias("seq", "uri"))


def lookup(reg: DataFrame, doc_id: int) -> DataFrame:
    return reg.where(F.col("id") == doc_id).limit(1)


def cover(reg: DataFrame) -> DataFrame:
    return reg.select("id", F.try_element_at("jpgUris", F.lit(1)).alias("cover"))


def share_target(reg: DataFrame) -> DataFrame:
    """The PDF if there is one, else the first JPG, else nothing; with its type."""
    uri = F.coalesce("pdfUri", F.try_element_at("jpgUris", F.lit(1)))
    mime = F.when(F.col("pdfUri").isNotNull(), "application/pdf").when(uri.isNotNull(), "image/jpeg")
    return reg.select("id", uri.alias("uri"), mime.alias("mime"))


def display(reg: DataFrame) -> DataFrame:
    t, n = F.col("timestamp"), F.col("pageCount")
    return reg.select(
        "id",
        F.concat_ws(" • ", scalar.day(t), scalar.plural(n, "page"), scalar.format_label(F.col("format"))).alias("line"),
        F.concat(scalar.short_day(t), F.lit(" • "), n, F.lit("p")).alias("short_line"),
    )


def images(reg: DataFrame) -> DataFrame:
    """One row for each JPG, in order."""
    return reg.select("id", F.posexplode("jpgUris").alias("seq", "uri"))


def is_empty(reg: DataFrame) -> DataFrame:
    return reg.agg((F.count("*") == 0).alias("empty"))
