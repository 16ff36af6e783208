"""The export of documents as one plan: pages are filtered, laid out and encoded, files named, mirrored and recorded.

Pages are rows (doc_id, pos, w, h, body, filter_id, brightness, contrast, format, ts), body being r, g, b bytes. Only
encoded pages of one document meet, in its PDF; everything else is row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleanup, export, registry
from ..sources import images


def _each(pages: DataFrame, more: list[str], change) -> DataFrame:
    """The pages with what change(pixels, row) makes of each; a page that fails comes back as it was, with ok false."""
    rest = [c for c in pages.columns if c not in ("w", "h", "body", "ok")]
    schema = pages.select(*rest).schema.add("w", "integer").add("h", "integer").add("body", "binary").add("ok", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, body, ok = [], [], [], []
            for r in batch.select(["w", "h", "body", *more]).to_pylist():
                out, good = None, False
                try:
                    out = change(np.frombuffer(r["body"], np.uint8).reshape(r["h"], r["w"], 3), r)
                    good = True
                except (ValueError, TypeError, ArithmeticError, IndexError):
                    pass
                w.append(out.shape[1] if good else r["w"])
                h.append(out.shape[0] if good else r["h"])
                body.append(out.tobytes() if good else r["body"])
                ok.append(good)
            columns = [pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(body, pa.binary()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "w", "h", "body", "ok"])

    return pages.select(*rest, *[c for c in ("w", "h", "body") if c in pages.columns]).mapInArrow(run, schema)


def filtered(pages: DataFrame) -> DataFrame:
    """Each page under its own filter and adjustments."""
    return _each(pages, ["filter_id", "brightness", "contrast"], lambda a, r: cleanup.filtered(a, r["filter_id"], r["brightness"], r["contrast"]))


def page_files(pages: DataFrame, page_format: str = "FIT_TO_IMAGE", quality: str = "STANDARD") -> DataFrame:
    """doc_id, content: a PDF of each document, its pages scaled into the budget of a resolution; a document without pages has none."""
    laid = export.page_layout(pages.withColumns({"page_format": F.lit(page_format), "dpi": F.lit(export.DPI.get(quality, export.DPI["STANDARD"]))}))
    boxed = _each(laid, ["box_w", "box_h"], lambda a, r: a if a.shape[:2] == (r["box_h"], r["box_w"]) else cleanup.resize_rgb(a, r["box_w"], r["box_h"]))
    return images.encode_pdfs(boxed)


def share(pages: DataFrame, page_format: str = "FIT_TO_IMAGE", quality: str = "STANDARD") -> DataFrame:
    """doc_id, name, content: the PDF of the filtered pages that is handed on, without a record of it."""
    return page_files(filtered(pages), page_format, quality).withColumn("name", F.concat(F.lit("share_"), "doc_id", F.lit(".pdf"))).select("doc_id", "name", "content")


def files(pages: DataFrame, page_format: str = "FIT_TO_IMAGE", quality: str = "STANDARD", jpeg_quality: int = 92, in_color: bool = True) -> DataFrame:
    """doc_id, seq, name, kind, content of every document's files by its own format; the PDF is first."""
    done = filtered(pages)
    names = export.names(pages.select("doc_id", "pos", "format", "ts"))
    base = names.where("format IN ('both', 'pdf')").groupBy("doc_id").agg(F.concat(F.min("base"), F.lit(".pdf")).alias("name"))
    pdfs = page_files(done, page_format, quality).join(base, "doc_id").select("doc_id", F.lit(0).alias("seq"), "name", F.lit("pdf").alias("kind"), "content")
    jpgs = done if in_color else _each(done, [], lambda a, r: cleanup.filtered(a, "bw", 0.0, 1.0))
    order = F.row_number().over(export.in_order()).cast("int")
    named = names.where("format IN ('both', 'jpg')").select("doc_id", "pos", "name", order.alias("seq"))
    jpgs = images.encode_pages(jpgs.join(named, ["doc_id", "pos"]), jpeg_quality)
    return pdfs.unionByName(jpgs.select("doc_id", "seq", "name", F.lit("jpg").alias("kind"), "content"))


def records(made: DataFrame, pages: DataFrame) -> DataFrame:
    """ord, title, timestamp, pageCount, format, pdfUri, jpgUris, searchText of each export, for registry.insert()."""
    uri = F.concat(F.lit("content://"), "name")
    per = made.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "pdf", uri)).alias("pdfUri"), F.array_sort(F.collect_list(F.when(F.col("kind") == "jpg", F.struct("seq", uri.alias("uri"))))).alias("_j"))
    of = pages.groupBy("doc_id").agg(F.min("ts").alias("timestamp"), F.count("*").cast("int").alias("pageCount"), F.min("format").alias("format"))
    title = F.concat(F.lit(export.PREFIX), export.scalar.stamp(F.col("timestamp")))
    return of.join(per, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), title.alias("title"), "timestamp", "pageCount", "format", "pdfUri",
        F.coalesce(F.col("_j.uri"), F.array().cast("array<string>")).alias("jpgUris"), F.lit("").alias("searchText"),
    )


def run(pages: DataFrame, reg: DataFrame, inbox: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(files, registry, inbox) after an export: the files, the registry with a record for each document, and the inbox folder (name, uri) with the files put in."""
    made = files(pages, **settings)
    after = registry.insert(reg, records(made, pages))
    return made, after, None if inbox is None else export.upsert(inbox, made.select("name", F.concat(F.lit("inbox://"), "name").alias("uri")))

