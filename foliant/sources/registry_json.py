"""The registry as JSON: one array in a file, or an object on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id bigint, title string, timestamp bigint, pageCount int, format string, pdfUri string, jpgUris array<string>, searchText string"
MANDATORY = ("id", "title", "timestamp", "pageCount", "format")


def serialise(reg: DataFrame) -> DataFrame:
    """value: each record as a JSON object, without null fields."""
    return reg.select(F.to_json(F.struct("id", "title", "timestamp", "pageCount", "format", "pdfUri", "jpgUris", "searchText")).alias("value"))


def parse(lines: DataFrame) -> DataFrame:
    """Records of JSON objects; those without jpgUris go, a missing searchText is empty."""
    rows = lines.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    return rows.where("jpgUris IS NOT NULL").withColumn("searchText", F.coalesce("searchText", F.lit("")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold one array each, with `pos`, their order. Malformed files fail."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("pos", "value"))
    rows = each.select("pos", F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*")
    return rows.where("jpgUris IS NOT NULL").withColumn("searchText", F.coalesce("searchText", F.lit("")))


def read_prefix(spark: SparkSession, path: str) -> DataFrame:
    """Like read(), but lenient: the records before the first with a missing or ill-typed mandatory field; none of a malformed file."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    each = text.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))
    rows = each.select("file", "pos", F.from_json("value", SCHEMA).alias("r")).select("file", "pos", "r.*")
    bad = F.lit(False)
    for c in MANDATORY:
        bad = bad | F.col(c).isNull()
    skipped = F.col("jpgUris").isNull()
    first_bad = F.min(F.when(bad & ~skipped, F.col("pos"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("_bad", first_bad).where(~skipped & (F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))))
    return rows.drop("_bad", "file").withColumn("searchText", F.coalesce("searchText", F.lit("")))


def write(reg: DataFrame, path: str) -> None:
    """The whole registry anew, an object on each line, newest first within sorted files."""
    serialise(reg.orderBy(F.desc("id"))).write.mode("overwrite").text(path)
