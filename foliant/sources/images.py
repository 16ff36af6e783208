"""Images in and out: files through Spark's image source, packed rasters, and sinks for pages."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleanup import resize, resize_rgb
from . import jpeg


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """uri, w, h, body (r, g, b bytes) of image files; those that can't be decoded are dropped, as nulls would be.

    Decoding is the JVM's; its b, g, r rows become r, g, b in Arrow batches.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                a = a.repeat(3, 2) if r["nChannels"] == 1 else a[..., 2::-1]
                yield pa.RecordBatch.from_pylist([{"uri": r["origin"], "w": r["width"], "h": r["height"], "body": a.tobytes()}], schema)

    schema = pa.schema([("uri", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("body", pa.binary())])
    return rows.mapInArrow(run, "uri string, w int, h int, body binary")


def exif_degrees(content: bytes) -> int:
    """The turn that a JPEG's orientation tag asks for: 90, 180 or 270, else 0."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"):
            tiff, order = body[6:], "little" if body[6:8] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                tag = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(tag[:2], order) == 0x0112:
                    return {3: 180, 6: 90, 8: 270}.get(int.from_bytes(tag[8:10], order), 0)
        at += 2 + size
    return 0


def read_upright(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """uri, w, h, body of image files, turned as their tags ask and at most `most` on the longer side."""

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array([exif_degrees(c) for c in batch.column("content").to_pylist()], pa.int32())], ["uri", "degrees"])

    turns = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content").mapInArrow(tags, "uri string, degrees int")
    # the two sources write a path alike but for the number of slashes after the scheme
    key = F.regexp_replace("uri", "^([a-z]+):/+", "$1:/")
    rows = read_images(spark, path).withColumn("_k", key).join(turns.select(key.alias("_k"), "degrees"), "_k").drop("_k")
    return turned(rows, most)


def turned(rows: DataFrame, most: int) -> DataFrame:
    """Images turned clockwise by their `degrees` and fitted to a longest side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.rot90(np.frombuffer(r["body"], np.uint8).reshape(r["h"], r["w"], 3), -r["degrees"] // 90)
                h, w = a.shape[:2]
                if max(w, h) > most:
                    w, h = max(1, int(np.float32(w) * (np.float32(most) / np.float32(max(a.shape[:2]))))), max(1, int(np.float32(h) * (np.float32(most) / np.float32(max(a.shape[:2])))))
                    a = np.stack([resize(a[..., c], w, h) for c in range(3)], -1)
                yield pa.RecordBatch.from_pylist([{"uri": r["uri"], "w": w, "h": h, "body": a.tobytes()}], schema)

    schema = pa.schema([("uri", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("body", pa.binary())])
    return rows.select("uri", "w", "h", "body", "degrees").mapInArrow(run, "uri string, w int, h int, body binary")


def thumbnails(images: DataFrame, most: int = 512) -> DataFrame:
    return turned(images.withColumn("degrees", F.lit(0)), most)


def to_pixels(images: DataFrame) -> DataFrame:
    """img_id, y, x, r, g, b in long form."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1))
    byte = lambda k: F.conv(F.hex(F.substring("body", F.col("i") * 3 + k, F.lit(1))), 16, 10).cast("int")
    rows = images.select("img_id", "w", "body", at.alias("_", "i"))
    return rows.select("img_id", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


def png(w: int, h: int, body: bytes) -> bytes:
    """A PNG of r, g, b bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + body[3 * w * y : 3 * w * (y + 1)] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pdf(pages: list[dict]) -> bytes:
    """A PDF of pages with page_w, page_h, left, top, right, bottom in points and w, h, body of an image."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for p in pages:
        image, content, page = len(objects) + 1, len(objects) + 2, len(objects) + 3
        data = zlib.compress(p["body"])
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (p["w"], p["h"], len(data), data))
        draw = f"q {p['right'] - p['left']:.3f} 0 0 {p['bottom'] - p['top']:.3f} {p['left']:.3f} {p['page_h'] - p['bottom']:.3f} cm /I Do Q".encode()
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {int(p['page_w'])} {int(p['page_h'])}] /Resources << /XObject << /I {image} 0 R >> >> /Contents {content} 0 R >>".encode())
        kids.append(f"{page} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


def encode_pages(pages: DataFrame, quality: int | None = 92) -> DataFrame:
    """doc_id, seq, name, content: a JPEG for each page row (doc_id, seq, name, w, h, body), for a table sink with
    commit; without a quality, a PNG. A page whose bytes aren't w * h * 3 is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["body"] is not None and len(r["body"]) == 3 * r["w"] * r["h"] > 0:
                    content = png(r["w"], r["h"], r["body"]) if quality is None else jpeg.encode(np.frombuffer(r["body"], np.uint8).reshape(r["h"], r["w"], 3), quality)
                    rows.append({"doc_id": r["doc_id"], "seq": r["seq"], "name": r["name"], "content": content})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), ("name", pa.string()), ("content", pa.binary())])
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "name", "w", "h", "body").mapInArrow(run, "doc_id long, seq int, name string, content binary")


PDF_SIDE, PDF_SCALE = 2200.0, (0.1, 8.0)  # of a page that is read: its longer side in pixels, and how far it is scaled
_NUMBER = rb"-?[0-9.]+"


def pdf_pages(content: bytes) -> list[tuple[int, int, bytes]]:
    """(w, h, r g b bytes) of the pages of a PDF whose pages each draw one uncompressed or Flate image of 8 bits, as
    scans do and as pdf() writes them, on white. A page that draws anything else is left white."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+) 0 obj\s(.*?)\sendobj", content, re.S)}

    def stream(body: bytes) -> bytes:
        head, _, rest = body.partition(b"stream\n")
        size = int(re.search(rb"/Length (\d+)", head)[1])
        return zlib.decompress(rest[:size]) if b"/FlateDecode" in head else rest[:size]

    kids = next((re.findall(rb"(\d+) 0 R", m[1]) for b in objects.values() if b"/Type /Pages" in b and (m := re.search(rb"/Kids \[(.*?)\]", b, re.S))), [])
    out = []
    for page in (objects[int(k)] for k in kids if int(k) in objects):
        box = [float(v) for v in re.search(rb"/MediaBox \[(.*?)\]", page)[1].split()]
        pw, ph = box[2] - box[0], box[3] - box[1]
        scale = min(max(PDF_SCALE[0], PDF_SIDE / max(pw, ph)), PDF_SCALE[1])
        w, h = max(1, int(pw * scale)), max(1, int(ph * scale))
        canvas = np.full((h, w, 3), 255, np.uint8)
        image = re.search(rb"/XObject << /\w+ (\d+) 0 R", page)
        draw = re.search(rb"/Contents (\d+) 0 R", page)
        place = draw and re.search(rb"(%s) 0 0 (%s) (%s) (%s) cm" % ((_NUMBER,) * 4), stream(objects[int(draw[1])]))
        if image and place:
            body = objects[int(image[1])]
            iw, ih = (int(re.search(rb"/%s (\d+)" % k, body)[1]) for k in (b"Width", b"Height"))
            data, channels = stream(body), 1 if b"/DeviceGray" in body else 3
            dw, dh, left, low = (float(v) for v in place.groups())
            if len(data) == iw * ih * channels:
                a = np.frombuffer(data, np.uint8).reshape(ih, iw, channels).repeat(3 // channels, 2)
                x0, x1, y0, y1 = round(left * scale), round((left + dw) * scale), round((ph - low - dh) * scale), round((ph - low) * scale)
                drawn = resize_rgb(a, max(1, x1 - x0), max(1, y1 - y0))
                part = canvas[max(y0, 0) : y1, max(x0, 0) : x1]
                part[:] = drawn[max(-y0, 0) :, max(-x0, 0) :][: part.shape[0], : part.shape[1]]
        out.append((w, h, canvas.tobytes()))
    return out


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """uri, page, w, h, body of the pages of PDF files, see pdf_pages(). A file that can't be read gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    pages = pdf_pages(r["content"])
                except (ValueError, TypeError, KeyError, zlib.error):
                    pages = []
                for k, (w, h, body) in enumerate(pages):  # a page at a time: a page has megabytes
                    yield pa.RecordBatch.from_pylist([{"uri": r["path"], "page": k, "w": w, "h": h, "body": body}], schema)

    schema = pa.schema([("uri", pa.string()), ("page", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("body", pa.binary())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "uri string, page int, w int, h int, body binary")


def encode_pdfs(pages: DataFrame) -> DataFrame:
    """doc_id, content: one PDF for each document of laid-out pages (operators.export.page_layout) in order of pos."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "content": pa.array([pdf(rows)], pa.binary())})

    cols = ["doc_id", "pos", "w", "h", "body", "page_w", "page_h", "left", "top", "right", "bottom"]
    return pages.select(*cols).groupBy("doc_id").applyInArrow(run, "doc_id long, content binary")


def write_files(files: DataFrame, path: str) -> None:
    """Encoded files (doc_id, name, content) as a table; Spark's commit makes all of them visible or none."""
    files.write.mode("overwrite").parquet(path)


def write_text(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
