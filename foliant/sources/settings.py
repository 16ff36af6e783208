"""Settings as key and value rows over typed defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The keys, in order, with their defaults.
DEFAULTS = {
    "defaultFilter": "original",
    "format": "both",
    "theme": "system",
    "inboxEnabled": "false",
    "inboxUri": "",
    "accessibilityEnabled": "false",
    "jpegQuality": "92",
    "jpegColor": "true",
    "pageFormat": "FIT_TO_IMAGE",
    "pdfQuality": "STANDARD",
}


def resolve(stored: DataFrame) -> DataFrame:
    """key, value of every setting: what is stored under it, or its default where that is missing or null."""
    spark = stored.sparkSession
    base = spark.createDataFrame([(k, v) for k, v in DEFAULTS.items()], "key string, default_value string")
    return base.join(stored, "key", "left").select("key", F.coalesce("value", "default_value").alias("value"))


def update(stored: DataFrame, **values) -> DataFrame:
    """Stored rows with some keys set anew."""
    spark = stored.sparkSession
    new = spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items()], "key string, value string")
    return stored.join(F.broadcast(new.select("key")), "key", "left_anti").unionByName(new)


JPEG_QUALITY = (50, 100)  # what the slider reaches


def set_jpeg_quality(stored: DataFrame, quality: float) -> DataFrame:
    """The quality of JPGs, truncated and held within the slider's range."""
    return update(stored, jpegQuality=min(max(int(quality), JPEG_QUALITY[0]), JPEG_QUALITY[1]))


def choose_inbox(stored: DataFrame, uri: str) -> DataFrame:
    """A chosen folder is also switched on."""
    return update(stored, inboxUri=uri, inboxEnabled=True)


def save(stored: DataFrame, path: str) -> None:
    resolve(stored).write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    return resolve(spark.read.schema("key string, value string").json(path))
