"""Views of the driver's tables in the shapes of the data model. Pure expressions over one row, no shuffle
but for colour images, which take one by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SRC_W, SRC_H = 800, 1000
SPREAD = 600.0  # wide enough that some quads are no longer convex
PAINTED = 4_000_000  # bytes of pictures that are painted at once
CORNERS = ((100, 100), (700, 100), (700, 900), (100, 900))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(v):
    """A float of about -1..1 as a level 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int")


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, y, x, lum: 8 x 8 levels of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("img_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), level(F.col("v")).alias("lum"))


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, y, x, r, g, b: three embeddings in a row are the channels of an image; a last incomplete one goes."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("img_id"), (F.col("vec_id") % 3).alias("c"), "embedding")
    images = rows.groupBy("img_id").agg(*[F.max(F.when(F.col("c") == k, F.col("embedding"))).alias(n) for k, n in enumerate("rgb")])
    cells = images.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").select("img_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return cells.select("img_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), *[level(F.col(f"p.{n}")).alias(n) for n in "rgb"])


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of the document registry for each document."""
    docs = table(spark, sf_dir, "documents")
    fmt = F.element_at(F.array(F.lit("both"), F.lit("pdf"), F.lit("jpg")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"),
        (F.lit(1704067200000) + F.col("doc_id") * 3600000).alias("timestamp"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("pageCount"),
        fmt.alias("format"),
        F.col("text").alias("searchText"),
    )
    uris = F.transform(F.sequence(F.lit(1), F.col("pageCount")), lambda i: F.concat(F.lit("u:"), F.col("id"), F.lit(":"), i))
    return rows.withColumn("pdfUri", F.when(F.col("format") != "jpg", F.concat(F.lit("pdf:"), F.col("id")))).withColumn(
        "jpgUris", F.when(F.col("format") == "pdf", F.array().cast("array<string>")).otherwise(uris)
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, filter_id, brightness, contrast: a turn of a conversation is a page of a document."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), F.lit("original").alias("filter_id"), F.lit(0.0).alias("brightness"), F.lit(1.0).alias("contrast")
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_partkey (not unique together) and the sizes w, h of a raster."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.lit(1) + (F.col("l_extendedprice") / 50).cast("int")).alias("w"), (F.lit(1) + (F.col("l_quantity") * 80).cast("int")).alias("h"),
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quad_id, x0, y0 .. x3, y3, src_w, src_h: corners top left, top right, bottom right, bottom left."""
    e = lambda i: F.element_at("embedding", i + 1).cast("double")
    cols = []
    for k, (x, y) in enumerate(CORNERS):
        cols += [(F.lit(float(x)) + SPREAD * e(2 * k)).alias(f"x{k}"), (F.lit(float(y)) + SPREAD * e(2 * k + 1)).alias(f"y{k}")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("quad_id"), *cols, F.lit(SRC_W).alias("src_w"), F.lit(SRC_H).alias("src_h"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, w, h, body: each quad painted light on dark, at a quarter of its size. Pictures of the quads, for detection.

    A picture has hundreds of times the bytes of its quad: of the thousands of quads that come in a batch, few are painted at once.
    """
    w, h = SRC_W // 4, SRC_H // 4
    at_once = PAINTED // (w * h * 3)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        y, x = np.mgrid[0:h, 0:w]
        for part in (batch.slice(k, at_once) for batch in batches for k in range(0, batch.num_rows, at_once)):
            ids, bodies = [], []
            for r in part.to_pylist():
                p = [(r[f"x{k}"] / 4, r[f"y{k}"] / 4) for k in range(4)]
                inside = np.ones((h, w), bool)
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
                    inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
                ids.append(r["quad_id"])
                bodies.append(np.where(inside, 225, 45).astype(np.uint8)[..., None].repeat(3, 2).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w] * len(ids), pa.int32()), pa.array([h] * len(ids), pa.int32()), pa.array(bodies, pa.binary())], ["img_id", "w", "h", "body"])

    # rows of a few numbers become pictures, and pictures take long to read: they are spread before they are painted
    return quads(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "img_id long, w int, h int, body binary")


def picture_pages(images: DataFrame) -> DataFrame:
    """Images (img_id, w, h, body) as the pages of documents of three, each document with its format and time."""
    i = F.col("img_id")
    filters = F.array(*[F.lit(f) for f in ("original", "magic", "bw", "sharpen", "sepia")])
    fmt = F.element_at(F.array(F.lit("both"), F.lit("pdf"), F.lit("jpg")), ((i / 3).cast("long") % 3 + 1).cast("int"))
    return images.select(
        (i / 3).cast("long").alias("doc_id"), (i % 3).cast("int").alias("pos"), "w", "h", "body", F.element_at(filters, (i % 5 + 1).cast("int")).alias("filter_id"),
        F.lit(0.2).alias("brightness"), F.lit(1.1).alias("contrast"), fmt.alias("format"), (F.lit(1704067200000) + (i / 3).cast("long") * 1000).alias("ts"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, ord, x1, y1, x2, y2: sixteen segments of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("ord"))
    at = lambda k, base, by: (F.lit(base) + by * F.expr(f"element_at(embedding, 4 * ord + {k})").cast("double")).alias(f"{'xy'[k % 2 == 0]}{1 + (k > 2)}")
    return rows.select("img_id", "ord", at(1, 400.0, 800.0), at(2, 500.0, 1000.0), at(3, 400.0, 800.0), at(4, 500.0, 1000.0))


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gesture_id, seq, x, y: a user's events in order are the pointer positions of a drag."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return rows.select(F.col("user_id").alias("gesture_id"), F.col("event_id").alias("seq"), F.col("value").alias("x"), (k * 5.0).alias("y"))
