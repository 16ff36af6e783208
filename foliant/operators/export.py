"""Export planning: page sizes and placement, output names and routing, and the manifest of files to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .resample import fit_box

# Page sizes in points, paper in inches, and the presets' resolutions.
PAGE_POINTS = {"US_LETTER": (612.0, 792.0), "LEGAL": (612.0, 1008.0), "A4": (595.0, 842.0)}
PAPER_INCHES = {"US_LETTER": (8.5, 11.0), "LEGAL": (8.5, 14.0), "A4": (8.27, 11.69)}
FIT = "FIT_TO_IMAGE"
FIT_POINTS = 842.0
DPI = {"HIGH": 300, "STANDARD": 200, "SMALL": 150, "VERY_SMALL": 110}
MARGIN = 0.95
PREFIX = "scan_"
FORMATS = ("both", "pdf", "jpg")


def _f(v: float):
    return F.lit(v).cast("float")


def pixel_budget(rows: DataFrame, page_format: str = "page_format", dpi: str = "dpi") -> DataFrame:
    """budget_w, budget_h: inches times resolution in 32-bit floats, truncated, at least 1. An unknown format fits the image."""
    fit = ((_f(FIT_POINTS) / _f(72.0)).cast("float") * F.col(dpi).cast("float")).cast("float").cast("int")
    w = h = F.when(F.lit(False), 0)
    for name, (iw, ih) in PAPER_INCHES.items():
        w = w.when(F.col(page_format) == name, F.greatest(F.lit(1), (_f(iw) * F.col(dpi).cast("float")).cast("float").cast("int")))
        h = h.when(F.col(page_format) == name, F.greatest(F.lit(1), (_f(ih) * F.col(dpi).cast("float")).cast("float").cast("int")))
    return rows.withColumns({"budget_w": w.otherwise(fit), "budget_h": h.otherwise(fit)})


def page_layout(rows: DataFrame) -> DataFrame:
    """For rasters w, h with page_format and dpi: the scaled raster, the page in points and the image's place on it.

    The budget is not turned for landscape pages, the page is. Fixed formats leave a margin.
    """
    out = fit_box(pixel_budget(rows), F.col("budget_w"), F.col("budget_h"))
    fixed = F.col("page_format").isin(*PAGE_POINTS)
    aspect = (F.col("box_w").cast("float") / F.col("box_h").cast("float")).cast("float")
    pw = F.when(aspect >= 1, _f(FIT_POINTS)).otherwise((_f(FIT_POINTS) * aspect).cast("float"))
    ph = F.when(aspect >= 1, (_f(FIT_POINTS) / aspect).cast("float")).otherwise(_f(FIT_POINTS))
    for name, (w, h) in PAGE_POINTS.items():
        pw, ph = F.when(F.col("page_format") == name, _f(w)).otherwise(pw), F.when(F.col("page_format") == name, _f(h)).otherwise(ph)
    turned = fixed & (F.col("box_w") > F.col("box_h"))
    out = out.withColumns({"_pw": pw, "_ph": ph})
    out = out.withColumns({"page_w": F.when(turned, F.col("_ph")).otherwise(F.col("_pw")).cast("double"), "page_h": F.when(turned, F.col("_pw")).otherwise(F.col("_ph")).cast("double")})
    scale = F.least(F.col("page_w") / F.col("box_w"), F.col("page_h") / F.col("box_h")) * F.when(fixed, MARGIN).otherwise(1.0)
    out = out.withColumn("_s", scale).withColumns({"_dw": F.col("box_w") * F.col("_s"), "_dh": F.col("box_h") * F.col("_s")})
    out = out.withColumns({
        "left": (F.col("page_w") - F.col("_dw")) / 2, "top": (F.col("page_h") - F.col("_dh")) / 2,
        "right": (F.col("page_w") + F.col("_dw")) / 2, "bottom": (F.col("page_h") + F.col("_dh")) / 2,
    })
    return out.drop("_pw", "_ph", "_s", "_dw", "_dh")


def in_order():
    """A document's pages from the first on."""
    return Window.partitionBy("doc_id").orderBy("pos")


def names(pages: DataFrame, millis: str = "ts", prefix: str = PREFIX) -> DataFrame:
    """base and name of each page's JPG: numbered only where a document has more than one page."""
    doc = Window.partitionBy("doc_id")
    base = F.concat(F.lit(prefix), scalar.stamp(F.col(millis)))
    numbered = F.concat(base, F.lit("_p"), F.row_number().over(doc.orderBy("pos")), F.lit(".jpg"))
    return pages.withColumn("base", base).withColumn("name", F.when(F.count("*").over(doc) == 1, F.concat(base, F.lit(".jpg"))).otherwise(numbered))


def manifest(pages: DataFrame, fmt: str = "format", millis: str = "ts", prefix: str = PREFIX) -> DataFrame:
    """doc_id, seq, name, kind: the files of each document's export, by its own format; the PDF is first."""
    named = names(pages, millis, prefix)
    pdf = named.where(F.col(fmt).isin("both", "pdf")).groupBy("doc_id").agg(F.concat(F.min("base"), F.lit(".pdf")).alias("name")).select("doc_id", F.lit(0).alias("seq"), "name", F.lit("pdf").alias("kind"))
    jpg = named.where(F.col(fmt).isin("both", "jpg")).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("int").alias("seq"), "name", F.lit("jpg").alias("kind"))
    return pdf.unionByName(jpg)


def written(files: DataFrame) -> DataFrame:
    """Files that could be written: those with a uri, in order, numbered anew."""
    kept = files.where("uri IS NOT NULL")
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("int"))


def upsert(inbox: DataFrame, files: DataFrame) -> DataFrame:
    """A folder's files (name, uri) with others put in: a file of the same name is replaced."""
    return inbox.join(files.select("name"), "name", "left_anti").unionByName(files.select(*inbox.columns))


def mirror(records: DataFrame) -> DataFrame:
    """pdf_uri becomes the inbox copy's where there is one; JPG uris stay."""
    return records.withColumn("pdf_uri", F.coalesce("inbox_uri", "pdf_uri"))
