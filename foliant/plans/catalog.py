"""Every query of the library by name. Its SQL, where it has any, is in plans.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import cleanup, color, corners, detect, export, geometry, pages, pixels, registry, resample, warp
from ..sources import settings
from ..streaming import gestures
from . import exporting
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# pixels


@query
def otsu_threshold(spark, d):
    return pixels.otsu(fx.gray_pixels(spark, d))


@query
def luma_histogram(spark, d):
    return pixels.histogram(fx.gray_pixels(spark, d))


@query
def binarize_bw(spark, d):
    px = fx.rgb_pixels(spark, d).withColumn("lum", color.luminance())
    return pixels.binarize(px)


@query
def mean_intensity(spark, d):
    return pixels.mean_intensity(fx.gray_pixels(spark, d))


@query
def low_light_flag(spark, d):
    return pixels.low_light(fx.gray_pixels(spark, d))


@query
def invert_if_dark(spark, d):
    return pixels.invert_if_dark(fx.gray_pixels(spark, d))


@query
def gamma_lowlight(spark, d):
    return pixels.gamma(fx.gray_pixels(spark, d))


@query
def sharpen_3x3(spark, d):
    return pixels.sharpen(fx.gray_pixels(spark, d))


@query
def dilate_3x3(spark, d):
    return pixels.dilate(fx.gray_pixels(spark, d))


@query
def close_3x3(spark, d):
    return pixels.close(fx.gray_pixels(spark, d))


@query
def median_3x3(spark, d):
    return pixels.median_3x3(fx.gray_pixels(spark, d))


@query
def edge_union(spark, d):
    px = fx.rgb_pixels(spark, d).withColumns({"a": F.when(F.col("r") > 140, 255).otherwise(0), "b": F.when(F.col("g") > 140, 255).otherwise(0)})
    return pixels.union_edges(px, "a", "b").select("img_id", "y", "x", "edge")


@query
def edge_thresholds(spark, d):
    return pixels.edge_thresholds(fx.gray_pixels(spark, d))


@query
def luminance_rgb(spark, d):
    return fx.rgb_pixels(spark, d).select("img_id", "y", "x", color.luminance().alias("lum"))


@query
def pack_argb(spark, d):
    px = fx.rgb_pixels(spark, d).select("img_id", "y", "x", scalar.pack(F.col("r"), F.col("g"), F.col("b")).alias("argb"))
    return px.select("*", *[c.alias(n) for c, n in zip(scalar.unpack(F.col("argb")), "rgb", strict=True)])


# colour filters: one query for each matrix


def _filter(filter_id: str) -> Query:
    return lambda spark, d: color.apply_filter(fx.rgb_pixels(spark, d), filter_id)


for _id in color.RECIPES:
    _QUERIES[f"filter_{_id}"] = _filter(_id)


@query
def filter_bw(spark, d):
    return color.apply_filter(fx.rgb_pixels(spark, d), "bw", 0.2, 1.1)


@query
def filter_sharpen(spark, d):
    return color.apply_filter(fx.rgb_pixels(spark, d), "sharpen", 0.1, 0.9)


@query
def filter_adjusted(spark, d):
    return color.apply_filter(fx.rgb_pixels(spark, d), "magic", 0.4, 1.25)


@query
def grayscale_copy(spark, d):
    return color.grayscale(fx.rgb_pixels(spark, d))


@query
def export_bw(spark, d):
    return color.for_jpg(color.apply_filter(fx.rgb_pixels(spark, d), "sepia"), in_color=False)


# whole images, in numpy: no SQL


def _images(spark, d) -> DataFrame:
    """The colour fixture as packed 8 x 8 images, each row of pixels a run of bytes."""
    px = fx.rgb_pixels(spark, d).withColumn("v", F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgb"]))
    g = px.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return g.select("img_id", F.lit(8).alias("w"), F.lit(8).alias("h"), F.unhex(F.concat_ws("", F.transform("p", lambda p: p.v))).alias("body"))


def _preset(name: str) -> Query:
    return lambda spark, d: cleanup.apply_preset(_images(spark, d), name).select("img_id", "ok", F.md5("body").alias("digest"))


for _id in cleanup.PRESETS:
    _QUERIES[f"filter_{_id}"] = _preset(_id)


@query
def detect_corners(spark, d):
    return corners.locate(fx.sheets(spark, d)).select("img_id", *[F.round(f"{c}{k}", 3).alias(f"{c}{k}") for k in range(4) for c in "xy"])


@query
def export_files(spark, d):
    made = exporting.files(fx.picture_pages(_images(spark, d)), "A4", "VERY_SMALL", 85)
    return made.select("doc_id", "seq", "name", "kind", F.md5("content").alias("digest"))


@query
def export_record(spark, d):
    pages = fx.picture_pages(_images(spark, d))
    made, after, inbox = exporting.run(pages, fx.registry(spark, d), spark.createDataFrame([], "name string, uri string"), in_color=False)
    return after.where("title LIKE 'scan%'").join(inbox, F.col("pdfUri") == F.concat(F.lit("content://"), "name"), "left").select("id", "title", "pageCount", "format", "pdfUri", "jpgUris", "uri")


@query
def warp_bilinear(spark, d):
    corners = {f"{c}{k}": F.lit(float(v)) for k, p in enumerate(((1, 1), (7, 0), (8, 7), (0, 8))) for c, v in zip("xy", p, strict=True)}
    return cleanup.warp(_images(spark, d).withColumns(corners), 6, 6).select("img_id", "w", "h", F.md5("body").alias("digest"))


# registry


@query
def registry_search(spark, d):
    return registry.search(fx.registry(spark, d), "  The ").select("id", "title")


@query
def registry_recent6(spark, d):
    return registry.recent(fx.registry(spark, d)).select("id", "title", "format")


@query
def registry_newest(spark, d):
    return registry.newest(fx.registry(spark, d)).select("id", "title")


@query
def registry_delete(spark, d):
    return registry.delete(fx.registry(spark, d), 7).select("id", "title")


@query
def registry_delete_many(spark, d):
    reg = fx.registry(spark, d)
    return registry.delete_many(reg, reg.where("id % 3 = 0").select("id")).select("id", "format")


@query
def registry_insert(spark, d):
    reg = fx.registry(spark, d)
    more = reg.where("id < 3").withColumn("ord", F.col("id")).drop("id").withColumn("title", F.concat(F.lit("new "), "title"))
    return registry.insert(reg.select("id", "title", "pageCount"), more.select("ord", "title", "pageCount"))


@query
def registry_lookup(spark, d):
    return registry.lookup(fx.registry(spark, d), 11).select("id", "title", "timestamp")


@query
def registry_cascade_uris(spark, d):
    return registry.cascade(fx.registry(spark, d), 9)


@query
def registry_share_target(spark, d):
    return registry.share_target(fx.registry(spark, d))


@query
def registry_cover(spark, d):
    return registry.cover(fx.registry(spark, d))


@query
def registry_display(spark, d):
    return registry.display(fx.registry(spark, d))


@query
def registry_images(spark, d):
    return registry.images(fx.registry(spark, d))


@query
def registry_empty(spark, d):
    return registry.is_empty(registry.search(fx.registry(spark, d), "no such text 100%_"))


@query
def registry_roundtrip(spark, d):
    """Records written as JSON objects and parsed again: a null pdfUri is left out and comes back null."""
    from ..sources import registry_json

    return registry_json.parse(registry_json.serialise(fx.registry(spark, d))).select("id", "title", "timestamp", "pageCount", "format", "pdfUri", F.size("jpgUris").alias("n_jpg"))


@query
def settings_defaults(spark, d):
    stored = spark.createDataFrame([("format", "pdf"), ("jpegQuality", "80"), ("theme", None)], "key string, value string")
    return settings.resolve(stored)


# pages


@query
def page_move(spark, d):
    return pages.move(fx.pages(spark, d), 1, 1).select("doc_id", "pos")


@query
def page_remove(spark, d):
    return pages.remove(fx.pages(spark, d).withColumn("was", F.col("pos")), 0).select("doc_id", "pos", "was")


@query
def page_append(spark, d):
    p = fx.pages(spark, d)
    return pages.append(p.select("doc_id", "pos"), p.where("pos < 2").select("doc_id", "pos"))


@query
def page_labels(spark, d):
    return pages.labels(fx.pages(spark, d))


@query
def page_filter_update(spark, d):
    return pages.update(fx.pages(spark, d), 2, filter_id="sepia", brightness=0.25, contrast=1.5)


@query
def page_reset(spark, d):
    return pages.reset(pages.update(fx.pages(spark, d), 1, filter_id="gray", brightness=0.5), 1)


@query
def page_selection(spark, d):
    return pages.selection_after_removal(fx.pages(spark, d), 4)


@query
def page_replace(spark, d):
    rows = fx.pages(spark, d).select("doc_id", "pos", (F.col("doc_id") % 7 + 1).cast("int").alias("w"), (F.col("pos") + 20).alias("h"))
    return pages.replace_bitmap(rows, 1, 33, 44)


@query
def page_rotate(spark, d):
    sized = fx.pages(spark, d).withColumns({"w": (F.col("doc_id") % 7 + 1).cast("int"), "h": (F.col("pos") + 20).cast("int")})
    return pages.rotate(sized, 1).select("doc_id", "pos", "w", "h")


@query
def page_select(spark, d):
    return pages.select(fx.pages(spark, d), 3)


@query
def page_clear(spark, d):
    return pages.clear(fx.pages(spark, d)).select("doc_id", "pos")


# sizes


def _sized(out: DataFrame, *columns: str) -> DataFrame:
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "w", "h", *columns)


@query
def fit_max(spark, d):
    return _sized(resample.fit_max(fx.rasters(spark, d), 2400), "fit_w", "fit_h")


@query
def fit_box(spark, d):
    return _sized(resample.fit_box(fx.rasters(spark, d), F.lit(1240), F.lit(1753)), "box_w", "box_h")


@query
def sample_factor(spark, d):
    return _sized(resample.sample_factor(fx.rasters(spark, d), 600), "sample")


@query
def pdf_render_size(spark, d):
    return _sized(resample.pdf_render_size(fx.rasters(spark, d)), "render_w", "render_h")


@query
def min_text_size(spark, d):
    return _sized(resample.min_text_size(fx.rasters(spark, d)), "text_w", "text_h")


@query
def letterbox(spark, d):
    return _sized(resample.letterbox(fx.rasters(spark, d), 1080, 1920), "left", "top", "right", "bottom")


@query
def rotate_90(spark, d):
    return resample.rotate(fx.gray_pixels(spark, d), 90, 8, 8)


@query
def crop_rect(spark, d):
    return resample.crop(fx.gray_pixels(spark, d), 2, 3, 20, 7, 8, 8)


@query
def bounding_rect(spark, d):
    return resample.bounding_rect(fx.quads(spark, d)).select("quad_id", "left", "top", "right", "bottom")


@query
def warp_nearest(spark, d):
    return resample.warp_nearest(fx.gray_pixels(spark, d), [(0, 0), (8, 0), (8, 8), (0, 8)], 4, 4)


# geometry


@query
def quad_area(spark, d):
    return fx.quads(spark, d).select("quad_id", geometry.signed_area().alias("area"), geometry.large_enough("src_w", "src_h").alias("large_enough"))


@query
def quad_valid(spark, d):
    return fx.quads(spark, d).select("quad_id", geometry.is_valid().alias("valid"), geometry.is_convex().alias("convex"))


@query
def quad_normals(spark, d):
    cols = [c.alias(f"n{a}{k}") for k in range(4) for a, c in zip("xy", geometry.outward_normal(k), strict=True)]
    return fx.quads(spark, d).select("quad_id", *cols)


@query
def edge_translate(spark, d):
    out = geometry.translate_edge(fx.quads(spark, d), 1, F.lit(760.0), F.lit(480.0))
    return out.select("quad_id", "applied", *[f"{c}{k}" for k in range(4) for c in "xy"])


@query
def edge_hit(spark, d):
    px, py = F.lit(400.0) + F.col("quad_id") % 300, F.lit(90.0) + F.col("quad_id") % 37
    return fx.quads(spark, d).select("quad_id", geometry.edge_hit(px, py).alias("edge"), geometry.corner_hit(px - 300, py).alias("corner"))


@query
def axis_snap_flags(spark, d):
    return geometry.snap_flags(fx.gestures(spark, d), 0.0, 500.0).select("gesture_id", "seq", "snapped")


@query
def edge_drag(spark, d):
    return gestures.drag_edge(fx.gestures(spark, d), 1)


@query
def crop_from_view(spark, d):
    q = warp.to_pixels(warp.to_unit(fx.quads(spark, d), 40.0, 30.0, 640.0, 800.0))
    return warp.apply_crop(q.withColumns({"choice": F.lit("ORIGINAL"), "custom": F.lit("")})).select("quad_id", *[f"{c}{k}" for k in range(4) for c in "xy"], "out_w", "out_h")


@query
def crop_turned(spark, d):
    return warp.turned_in_crop(fx.quads(spark, d)).select("quad_id", "src_w", "src_h", *[f"{c}{k}" for k in range(4) for c in "xy"])


@query
def snap_fold(spark, d):
    return gestures.fold(fx.gestures(spark, d))


# warp sizes


@query
def warp_projective(spark, d):
    return warp.projective_size(fx.quads(spark, d)).select("quad_id", "out_w", "out_h")


@query
def warp_ratio(spark, d):
    return warp.projective_ratio(fx.quads(spark, d)).select("quad_id", F.round("ratio", 9).alias("ratio"))


@query
def warp_heuristic(spark, d):
    return warp.heuristic_size(fx.quads(spark, d)).select("quad_id", "out_w", "out_h")


@query
def warp_fixed(spark, d):
    return warp.fixed_size(fx.quads(spark, d), 0.7071).select("quad_id", "out_w", "out_h")


def _choices(spark, d) -> DataFrame:
    choice = F.element_at(F.array(*[F.lit(c) for c in ("AUTO", "ORIGINAL", "CUSTOM", "A4", "US_LETTER", "LEGAL", "NONE")]), (F.col("quad_id") % 7 + 1).cast("int"))
    custom = F.when(F.col("quad_id") % 2 == 0, "0,5").otherwise("x")
    return fx.quads(spark, d).withColumns({"choice": choice, "custom": custom})


@query
def warp_mode(spark, d):
    return warp.size_by_choice(_choices(spark, d)).select("quad_id", "choice", "out_w", "out_h")


@query
def apply_crop(spark, d):
    return warp.apply_crop(_choices(spark, d)).select("quad_id", "choice", "out_w", "out_h")


# detection


@query
def corner_order(spark, d):
    q = fx.quads(spark, d)
    q = q.select("quad_id", *[F.col(f"{c}{k}").alias(f"{c}{(2, 1, 0, 3)[k]}") for k in range(4) for c in "xy"])
    return detect.order_corners(q).select("quad_id", *[f"{c}{k}" for k in range(4) for c in "xy"])


@query
def rect_score(spark, d):
    return detect.order_corners(fx.quads(spark, d)).select("quad_id", detect.rect_score().alias("rect"), detect.has_bad_angle().alias("bad_angle"), detect.area().alias("area"))


@query
def best_quad(spark, d):
    q = fx.quads(spark, d).withColumns({"img_id": F.expr("quad_id div 8"), "ord": F.col("quad_id") % 8})
    return detect.best_quad(q)


@query
def hough_quad(spark, d):
    return detect.quad_from_lines(fx.segments(spark, d), fx.SRC_W, fx.SRC_H).select("img_id", *[F.round(f"{c}{k}", 6).alias(f"{c}{k}") for k in range(4) for c in "xy"])


@query
def line_intersection(spark, d):
    s = fx.segments(spark, d)
    line = F.struct("x1", "y1", "x2", "y2")
    pairs = s.groupBy("img_id", F.expr("ord div 2").alias("pair")).agg(F.max(F.when(F.col("ord") % 2 == 0, line)).alias("a"), F.max(F.when(F.col("ord") % 2 == 1, line)).alias("b"))
    return pairs.withColumn("p", detect.intersection(F.col("a"), F.col("b"))).select("img_id", F.col("pair").cast("int").alias("pair"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query
def line_kinds(spark, d):
    a = detect.line_angle()
    kind = F.when((a < 30) | (a > 150), "level").when((a > 60) & (a < 120), "upright").otherwise("other")
    return fx.segments(spark, d).select("img_id", "ord", kind.alias("kind"))


# export


def _formats() -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in ("FIT_TO_IMAGE", "A4", "US_LETTER", "LEGAL")]), (F.col("l_partkey") % 4 + 1).cast("int"))


def _presets() -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in export.DPI.values()]), (F.col("l_orderkey") % 4 + 1).cast("int"))


@query
def pdf_pixel_budget(spark, d):
    rows = fx.rasters(spark, d).select(_formats().alias("page_format"), _presets().alias("dpi")).distinct()
    return export.pixel_budget(rows)


@query
def pdf_page_layout(spark, d):
    rows = fx.rasters(spark, d).withColumns({"page_format": _formats(), "dpi": _presets()})
    out = export.page_layout(rows)
    return _sized(out, "box_w", "box_h", *[F.floor(c).cast("int").alias(c) for c in ("page_w", "page_h")], *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")])


def _exports(spark, d) -> DataFrame:
    fmt = F.element_at(F.array(*[F.lit(c) for c in export.FORMATS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.pages(spark, d).withColumns({"format": fmt, "ts": F.lit(1704067200000) + F.col("doc_id") * 1000})


@query
def export_names(spark, d):
    return export.names(_exports(spark, d)).select("doc_id", "pos", "name")


@query
def export_manifest(spark, d):
    return export.manifest(_exports(spark, d))


@query
def export_written(spark, d):
    files = export.manifest(_exports(spark, d)).withColumn("uri", F.when(F.col("doc_id") % 5 != F.col("seq"), F.concat(F.lit("content://"), "name")))
    return export.written(files).select("doc_id", "seq", "uri")


@query
def inbox_upsert(spark, d):
    files = export.manifest(_exports(spark, d)).select("name", F.concat(F.lit("new:"), "name").alias("uri"))
    inbox = export.manifest(_exports(spark, d)).where("doc_id % 2 = 0").select("name", F.concat(F.lit("old:"), "name").alias("uri"))
    return export.upsert(inbox, files.where("name LIKE '%.jpg'"))


@query
def inbox_mirror(spark, d):
    records = fx.registry(spark, d).select("id", F.col("pdfUri").alias("pdf_uri"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("inbox:"), "id")).alias("inbox_uri"))
    return export.mirror(records).select("id", "pdf_uri")


@query
def scalar_functions(spark, d):
    r = fx.registry(spark, d)
    return r.select(
        "id", scalar.base_name(F.concat(F.lit("a/b/"), "title")).alias("base_name"), scalar.keep_ratio_characters(F.concat(F.lit("r=1,"), "id")).alias("kept"),
        scalar.parse_ratio(F.concat(F.lit("1,"), "id")).alias("ratio"), scalar.is_blank(F.lit("  ")).alias("blank"), scalar.stamp(F.col("timestamp")).alias("stamp"),
        scalar.mod_180(F.col("id") * -7.5).alias("angle"), scalar.clamp(F.col("id"), 5, 90).alias("clamped"), scalar.round_half_up(F.lit(0.5) - F.col("id")).alias("rounded"),
        scalar.theme_is_dark(F.element_at(F.array(F.lit("dark"), F.lit("light"), F.lit("system")), (F.col("id") % 3 + 1).cast("int")), F.col("id") % 2 == 0).alias("dark"),
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.sql()
