"""Goldens, properties and plain-Python forms of the operators."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import scalar
from foliant.operators import cleanup, color, corners, detect, export, geometry, pages, pixels, registry, resample, warp
from foliant.plans import exporting, fixtures
from foliant.sources import images, jpeg, registry_json, settings
from foliant.streaming import gestures


def gray(spark, arrays):
    rows = [(i, y, x, int(v)) for i, a in enumerate(arrays) for y, line in enumerate(a) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "img_id long, y int, x int, lum int")


def as_arrays(df, column="lum"):
    out = {}
    for r in df.collect():
        out.setdefault(r.img_id, {})[r.y, r.x] = r[column]
    return out


def test_otsu_by_a_loop(spark):
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 256, (6, 6)) for _ in range(12)] + [np.full((6, 6), 90), np.array([[10, 10], [200, 200]])]

    def loop(a):
        best, level, n = 0.0, 127, a.size
        hist = np.bincount(a.ravel(), minlength=256)
        total, wb, sb = float((hist * np.arange(256)).sum()), 0, 0.0
        for k in range(256):
            wb += int(hist[k])
            sb += k * int(hist[k])
            if not wb or wb == n:
                continue
            v = wb * (n - wb) * (sb / wb - (total - sb) / (n - wb)) ** 2
            if v > best * (1 + 1e-12):
                best, level = v, k
        return level

    got = {r.img_id: r.threshold for r in pixels.otsu(gray(spark, arrays)).collect()}
    assert got == {i: loop(a) for i, a in enumerate(arrays)}


def test_sharpen_flat_gains_five_and_keeps_the_border(spark):
    got = as_arrays(pixels.sharpen(gray(spark, [np.full((3, 3), 40), np.full((3, 3), 60)])))
    assert got[0][1, 1] == 200 and got[1][1, 1] == 255 and got[0][0, 0] == 40


def test_rotations_and_inversions_undo_themselves(spark):
    a = np.arange(12).reshape(3, 4)
    df = gray(spark, [a])
    turned = resample.rotate(resample.rotate(df, 90, 4, 3), 270, 3, 4)
    assert as_arrays(turned) == as_arrays(df)
    assert as_arrays(resample.rotate(df, 90, 4, 3))[0][0, 2] == 0  # the first pixel goes to the upper right
    rgb = df.select("img_id", "y", "x", F.col("lum").alias("r"), (F.col("lum") * 2).alias("g"), F.lit(7).alias("b"))
    twice = color.apply_filter(color.apply_filter(rgb, "invert"), "invert")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, rgb.collect()))
    assert color.apply_filter(rgb, "original") is rgb and color.apply_filter(rgb, "no such filter") is rgb


def test_filters_are_clamped_once():
    m = color.fold("crisp", brightness=-1.0, contrast_by=1.5)
    step = color.compose(color.offset(-25), color.compose(color.contrast(1.5), color.compose(color.contrast(1.28), color.saturation(1.12))))
    assert np.allclose(m, step)
    with pytest.raises(ValueError):
        color.apply_filter(None, "natural")


def test_pixel_budgets(spark):
    want = {("US_LETTER", 300): (2550, 3300), ("US_LETTER", 110): (935, 1210), ("LEGAL", 200): (1700, 2800), ("A4", 300): (2481, 3506), ("A4", 200): (1654, 2338), ("A4", 110): (909, 1285), ("FIT_TO_IMAGE", 300): (3508, 3508), ("none", 110): (1286, 1286)}
    df = spark.createDataFrame(list(want), "page_format string, dpi int")
    assert {(r.page_format, r.dpi): (r.budget_w, r.budget_h) for r in export.pixel_budget(df).collect()} == want


def test_names_and_labels(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, pos int, ts long")
    assert sorted(r.name for r in export.names(df).collect()) == ["scan_19700101_000000.jpg", "scan_19700101_000000_p1.jpg", "scan_19700101_000000_p2.jpg"]
    n = spark.createDataFrame([(0,), (1,), (2,)], "n int").select(scalar.plural(F.col("n"), "page").alias("t"))
    assert [r.t for r in n.collect()] == ["0 page", "1 page", "2 pages"]


def test_search_is_literal_and_folds_case(spark):
    reg = spark.createDataFrame([(1, "A 100% wool", ""), (2, "100 wool", "Grün_x"), (3, "b", None)], "id long, title string, searchText string")
    ids = lambda q: sorted(r.id for r in registry.search(reg, q).collect())
    assert ids("100% W") == [1] and ids("%") == [1] and ids("GRÜN_") == [2] and ids("  ") == [1, 2, 3]


def test_pages_keep_their_last(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (2, 2)], "doc_id long, pos int").withColumn("was", F.col("pos"))
    assert sorted((r.doc_id, r.pos, r.was) for r in pages.remove(df, 0).collect()) == [(1, 0, 0), (2, 0, 1), (2, 1, 2)]
    assert sorted((r.doc_id, r.pos, r.was) for r in pages.move(df, 0, -1).collect()) == sorted((r.doc_id, r.pos, r.was) for r in df.collect())
    assert sorted((r.doc_id, r.pos, r.was) for r in pages.move(df, 1, 1).collect()) == [(1, 0, 0), (2, 0, 0), (2, 1, 2), (2, 2, 1)]


def test_snap_limits_and_fold_by_a_loop(spark):
    rows = [(1, k, math.cos(math.radians(a)), math.sin(math.radians(a))) for k, a in enumerate((1.6, 1.4, 2.9, 3.1, 2.0))]
    df = spark.createDataFrame(rows, "gesture_id long, seq long, x double, y double")
    assert [r.snapped for r in geometry.snap_flags(df, 0.0, 0.0).orderBy("seq").collect()] == [False, True, True, False, False]
    rnd = random.Random(4)
    near = lambda v: v + rnd.uniform(-12, 12)
    rows = [(g, s, near(rnd.choice((0, 490))), near(rnd.choice((0, 250, 500)))) for g in range(20) for s in range(40)]
    df = spark.createDataFrame(rows, "gesture_id long, seq long, x double, y double")
    got = {r.gesture_id: tuple(r)[1:] for r in gestures.fold(df).collect()}
    for g in range(20):
        snap = gestures.Snap(2, gestures.BOX, *gestures.BOX[2])
        for _, _, x, y in [r for r in rows if r[0] == g]:
            snap.move(x, y)
        assert got[g] == (snap.x, snap.y, snap.prev_on, snap.next_on, snap.n_prev, snap.n_next)


def test_snap_stream_equals_the_fold(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(g, s, rnd.uniform(470, 500), rnd.uniform(480, 510)) for g in range(4) for s in range(12)]
    schema = "gesture_id long, seq long, x double, y double"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 6 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = gestures.snap_stream(stream).writeStream.format("memory").queryName("snaps").outputMode("update").trigger(availableNow=True)
    query = out.option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {}
    for r in spark.table("snaps").collect():  # the last state has the most snapped moves or equals the others
        key = (r.n_prev + r.n_next,)
        if r.gesture_id not in got or key >= got[r.gesture_id][0]:
            got[r.gesture_id] = (key, (r.n_prev, r.n_next))
    want = {r.gesture_id: (r.n_prev, r.n_next) for r in gestures.fold(spark.createDataFrame(rows, schema)).collect()}
    assert {g: v[1] for g, v in got.items()} == want


def test_geometry_properties(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 10.0, 8.0, 0.0, 8.0)], "quad_id long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    r = q.select(geometry.signed_area().alias("a"), geometry.is_valid().alias("v"), *[c.alias(f"n{i}") for i, c in enumerate(geometry.outward_normal(0))]).first()
    assert (r.a, r.v, r.n0, r.n1) == (80.0, True, 0.0, -1.0)
    once = detect.order_corners(q)
    assert once.collect() == detect.order_corners(once).collect()
    assert once.select(detect.rect_score().alias("s")).first().s == 120.0
    sized = warp.projective_size(q.withColumns({"src_w": F.lit(100), "src_h": F.lit(100)})).first()
    assert (sized.out_w, sized.out_h) == (11, 9)


def test_settings(spark, tmp_path):
    stored = spark.createDataFrame([("theme", "dark"), ("format", None)], "key string, value string")
    got = {r.key: r.value for r in settings.resolve(settings.update(stored, jpegQuality=70, jpegColor=False)).collect()}
    assert got | {"theme": "dark", "format": "both", "jpegQuality": "70", "jpegColor": "false"} == got and len(got) == 10
    settings.save(stored, str(tmp_path / "s"))
    assert {r.key: r.value for r in settings.load(spark, str(tmp_path / "s")).collect()}["theme"] == "dark"


REGISTRY = """[{"id":2,"title":"t2","timestamp":1704067200000,"pageCount":1,"format":"jpg","jpgUris":["u:b"],"searchText":""},
 {"id":1,"title":"t1","timestamp":1704060000000,"pageCount":3,"format":"both","pdfUri":"u:a","jpgUris":["u:1","u:2","u:3"]},
 {"id":0,"title":"t0","timestamp":1,"pageCount":1,"format":"pdf"}%s]"""


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(REGISTRY % "")
    rows = registry_json.read(spark, str(tmp_path / "r.json")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.pdfUri, r.searchText) for r in rows] == [(0, 2, None, ""), (1, 1, "u:a", "")]
    (tmp_path / "bad.json").write_text(REGISTRY % ',{"id":"x","title":"t","timestamp":1,"pageCount":1,"format":"f","jpgUris":[]},{"id":9,"title":"t","timestamp":1,"pageCount":1,"format":"f","jpgUris":[]}')
    assert sorted(r.id for r in registry_json.read_prefix(spark, str(tmp_path / "bad.json")).collect()) == [1, 2]
    (tmp_path / "cut.json").write_text((REGISTRY % "")[:100])
    assert registry_json.read_prefix(spark, str(tmp_path / "cut.json")).count() == 0
    with pytest.raises(Exception):
        registry_json.read(spark, str(tmp_path / "bad.json")).collect()


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (5, 7, 3), np.uint8)
    (tmp_path / "p.png").write_bytes(images.png(7, 5, a.tobytes()))
    r = images.read_images(spark, str(tmp_path / "p.png")).first()
    assert (r.w, r.h) == (7, 5) and np.array_equal(np.frombuffer(bytes(r.body), np.uint8).reshape(5, 7, 3), a)
    df = spark.createDataFrame([(1, 7, 5, bytearray(a.tobytes()))], "img_id long, w int, h int, body binary")
    px = {(r.y, r.x): (r.r, r.g, r.b) for r in images.to_pixels(df).collect()}
    assert px == {(y, x): tuple(int(v) for v in a[y, x]) for y in range(5) for x in range(7)}
    body = images.pdf([{"w": 7, "h": 5, "body": a.tobytes(), "page_w": 100.0, "page_h": 80.0, "left": 5.0, "top": 5.0, "right": 95.0, "bottom": 75.0}])
    assert body.startswith(b"%PDF") and b"/MediaBox [0 0 100 80]" in body and body.rstrip().endswith(b"%%EOF")


def test_cleanup(spark):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (40, 30, 3), np.uint8)
    assert np.abs(cleanup.lab_to_rgb(cleanup.rgb_to_lab(rgb)).astype(int) - rgb).max() <= 1
    flat = np.full((20, 20), 100, np.uint8)
    assert (cleanup.unsharp(flat, 1.5) == 100).all() and (cleanup.background_divide(flat, 0.1) == 255).all()
    good, bad = (1, 30, 40, bytearray(rgb.tobytes())), (2, 30, 40, bytearray(b"xx"))
    df = spark.createDataFrame([good, bad], "img_id long, w int, h int, body binary")
    for preset in cleanup.PRESETS:
        rows = {r.img_id: r for r in cleanup.apply_preset(df, preset).collect()}
        assert rows[1].ok and len(rows[1].body) == 3600 and not rows[2].ok and bytes(rows[2].body) == b"xx"


def sheet(w, h, quad, light=225, dark=45, noise=3):
    y, x = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    a = np.where(inside, light, dark)[..., None].repeat(3, 2) + np.random.default_rng(0).normal(0, noise, (h, w, 3))
    return np.clip(a, 0, 255).astype(np.uint8)


def as_images(spark, arrays):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0], bytearray(a.tobytes())) for k, a in enumerate(arrays)], "img_id long, w int, h int, body binary")


def test_detection_finds_sheets(spark):
    quads = [[(80, 60), (430, 90), (410, 540), (60, 510)], [(30, 30), (400, 30), (400, 300), (30, 300)], [(60, 50), (420, 80), (400, 380), (50, 350)], [(10, 10), (14, 10), (14, 14), (10, 14)]]
    arrays = [sheet(500, 600, quads[0]), sheet(450, 340, quads[1]), sheet(480, 440, quads[2], 50, 12, 0), sheet(300, 300, quads[3])]
    df = as_images(spark, arrays).union(spark.createDataFrame([(9, 5, 5, bytearray(b"xx"))], "img_id long, w int, h int, body binary"))
    got = {r.img_id: r for r in corners.locate(df).collect()}
    assert set(got) == {0, 1, 2}  # a speck is no sheet, nor is what can't be read
    for k in range(3):
        assert max(abs(got[k][f"{c}{i}"] - p[j]) for i, p in enumerate(quads[k]) for j, c in enumerate("xy")) <= 6, (k, got[k])
    quad = {f"{c}{k}": F.lit(float(v)) for k, p in enumerate(quads[1]) for c, v in zip("xy", p, strict=True)}
    out = cleanup.warp(as_images(spark, arrays[1:2]).withColumns(quad), 10, 10).first()
    assert np.frombuffer(bytes(out.body), np.uint8).reshape(10, 10, 3)[1:-1, 1:-1].min() >= 210


def test_pictures_are_painted_a_few_at_a_time(spark, sf_dir, monkeypatch):
    painters, of = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: painters.append(f) or of(self, f, *a, **b))
    fixtures.sheets(spark, sf_dir)
    quads = fixtures.quads(spark, sf_dir).toArrow()
    one = pa.Table.from_batches(quads.to_batches()).combine_chunks().to_batches()  # as many as a batch can hold come as one
    assert len(one) == 1 and one[0].num_rows == quads.num_rows > 400
    sizes, ids = [], []
    for batch in painters[0](iter(one)):
        sizes.append(batch.nbytes)
        ids += batch.column("img_id").to_pylist()
    assert ids == quads.column("quad_id").to_pylist() and max(sizes) < 5_000_000


def test_edges_and_medians_by_plain_loops():
    rng = np.random.default_rng(8)
    blocks = np.kron(rng.integers(0, 2, (5, 6)) * 150 + 40, np.ones((6, 5), int)).astype(np.uint8)
    for a in (blocks, rng.integers(0, 256, (17, 23)).astype(np.uint8), np.full((4, 5), 9, np.uint8), np.array([[7]], np.uint8)):
        h, w = a.shape
        v = np.pad(a.astype(float), 1, mode="edge")
        assert (cleanup.median_3x3(a) == [[np.median(v[y : y + 3, x : x + 3]) for x in range(w)] for y in range(h)]).all()
        for side in (3, 5):
            r = side // 2
            assert (corners.dilate(a, side) == [[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(w)] for y in range(h)]).all()
        gx = [[(v[y : y + 3, x + 2] - v[y : y + 3, x]) @ [1, 2, 1] for x in range(w)] for y in range(h)]
        gy = [[(v[y + 2, x : x + 3] - v[y, x : x + 3]) @ [1, 2, 1] for x in range(w)] for y in range(h)]
        size = {(y, x): math.hypot(gx[y][x], gy[y][x]) for y in range(h) for x in range(w)}
        for low, high in ((0.0, 0.0), (60.0, 200.0), (100.0, 255.0)):
            best = set()
            for (y, x), s in size.items():
                dy, dx = ((0, 1), (1, 1), (1, 0), (1, -1))[round(math.degrees(math.atan2(gy[y][x], gx[y][x])) / 45) % 4]
                if s >= low and s >= size.get((y + dy, x + dx), 0) and s > size.get((y - dy, x - dx), 0):
                    best.add((y, x))
            todo, edges = [p for p in best if size[p] >= high], set()
            while todo:
                y, x = todo.pop()
                edges.add((y, x))
                todo += [p for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if p in best and p not in edges]
            assert set(map(tuple, np.argwhere(cleanup.canny(a, low, high)).tolist())) == edges


def test_lines_stand_in_for_broken_contours(spark):
    edges = np.zeros((300, 260), bool)
    edges[40, 30:90] = edges[40, 140:220] = edges[260, 35:225] = True
    edges[50:120, 30] = edges[170:250, 30] = edges[60:240, 220] = True
    assert corners.quads_of(edges) == []
    s = corners.segments_of(edges)
    assert len(s) == 6 or len(s) >= 4
    rows = [(1, k, *map(float, v)) for k, v in enumerate(s.tolist())]
    r = detect.quad_from_lines(spark.createDataFrame(rows, "img_id long, ord int, x1 double, y1 double, x2 double, y2 double"), 260, 300).first()
    assert max(abs(r.x0 - 30), abs(r.y0 - 40), abs(r.x2 - 220), abs(r.y2 - 260)) <= 2


def test_parts_and_outlines():
    rng = np.random.default_rng(5)
    mask = rng.random((30, 40)) < 0.35
    found = corners.parts(mask)
    assert sum(map(len, found)) == mask.sum()
    label = {tuple(p): k for k, part in enumerate(found) for p in part.tolist()}
    for (y, x), k in label.items():
        assert all(label.get((y + dy, x + dx), k) == k for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    seen, todo = set(), [tuple(found[0][0])]
    while todo:
        p = todo.pop()
        if p not in seen and p in label:
            seen.add(p)
            todo += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert len(seen) == len(found[0])
    box = np.array([(y, x) for y in range(5, 15) for x in range(3, 23)])
    ring = corners.outline(box)
    assert len(ring) == 2 * (10 + 20) - 4 and corners.enclosed(ring) == 9 * 19
    assert len(corners.outline(np.array([[4, 4]]))) == 1
    for part in found:
        ring = corners.outline(part)
        assert {(y, x) for x, y in ring.astype(int).tolist()} <= set(map(tuple, part.tolist()))
        assert (ring.min(0) == part.min(0)[::-1]).all() and (ring.max(0) == part.max(0)[::-1]).all()


def test_closing_and_resizing():
    a = np.zeros((9, 12), np.uint8)
    a[2:7, 2:5] = a[2:7, 6:9] = 255
    closed = corners.close(a, 3)
    assert closed[2:7, 2:9].min() == 255 and closed[:2].max() == 0 and closed[:, :2].max() == 0
    flat = np.full((6, 5), 77, np.uint8)
    assert (cleanup.enlarge(flat, 11, 13) == 77).all() and (cleanup.shrink(flat, 2, 3) == 77).all()
    b = np.arange(16, dtype=np.uint8).reshape(4, 4) * 10
    assert (cleanup.shrink(b, 2, 2) == [[25, 45], [105, 125]]).all()
    assert np.abs(cleanup.shrink(cleanup.enlarge(b, 8, 8), 4, 4).astype(int) - b).max() <= 6


def test_canny_marks_a_step():
    a = np.zeros((9, 9), np.uint8)
    a[:, 5:] = 200
    e = cleanup.canny(a, 50, 100)
    assert e[:, 4:6].any() and not e[:, :3].any()


def test_sample_and_fit(spark):
    df = spark.createDataFrame([(4000, 3000), (600, 20), (0, 5)], "w int, h int")
    assert [r["sample"] for r in resample.sample_factor(df, 2000).collect()] == [2, 1, None]
    assert [(r.fit_w, r.fit_h) for r in resample.fit_max(df.where("w > 0"), 2400).collect()] == [(2400, 1800), (600, 20)]


def test_orientation_and_thumbnails(spark, tmp_path):
    tag = (0x0112).to_bytes(2, "big") + (3).to_bytes(2, "big") + (1).to_bytes(4, "big") + (6).to_bytes(2, "big") + b"\0\0"
    exif = b"Exif\0\0MM\0*" + (8).to_bytes(4, "big") + (1).to_bytes(2, "big") + tag
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xda"
    assert images.exif_degrees(jpeg) == 90 and images.exif_degrees(b"\x89PNG") == 0 and images.exif_degrees(b"") == 0
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    (tmp_path / "p.png").write_bytes(images.png(6, 4, a.tobytes()))
    up = images.read_upright(spark, str(tmp_path)).first()
    assert (up.w, up.h, bytes(up.body)) == (6, 4, a.tobytes())
    df = spark.createDataFrame([("u", 6, 4, bytearray(a.tobytes()), 90)], "uri string, w int, h int, body binary, degrees int")
    r = images.turned(df, 100).first()
    assert (r.w, r.h) == (4, 6) and np.array_equal(np.frombuffer(bytes(r.body), np.uint8).reshape(6, 4, 3), np.rot90(a, -1))
    t = images.thumbnails(df.drop("degrees"), 3).first()
    assert (t.w, t.h) == (3, 2)


def test_jpeg_files_are_read_by_the_jvm(spark, tmp_path):
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([x * 3, y * 4, 255 - x - y], -1).astype(np.uint8)
    noise = np.random.default_rng(0).integers(0, 256, (37, 53, 3), np.uint8)
    for name, a, quality, off in (("a", smooth, 95, 4), ("b", noise, 100, 6), ("c", np.full((1, 1, 3), 9, np.uint8), 50, 4), ("d", smooth, 1, 255)):
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(a, quality))
        r = images.read_images(spark, str(tmp_path / f"{name}.jpg")).first()
        got = np.frombuffer(bytes(r.body), np.uint8).reshape(r.h, r.w, 3)
        assert got.shape == a.shape and np.abs(got.astype(int) - a).max() <= off, name
    sizes = [len(jpeg.encode(smooth, q)) for q in (1, 50, 92, 100, 400)]
    assert sizes == sorted(sizes) and sizes[-1] == sizes[-2]


def test_pdf_pages_come_back(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (70, 50, 3), np.uint8)
    pages = [{"w": 50, "h": 70, "body": a.tobytes(), "page_w": 50.0, "page_h": 70.0, "left": 0.0, "top": 0.0, "right": 50.0, "bottom": 70.0}, {"w": 50, "h": 70, "body": a.tobytes(), "page_w": 4400.0, "page_h": 2200.0, "left": 1000.0, "top": 600.0, "right": 1500.0, "bottom": 1300.0}]
    (tmp_path / "a.pdf").write_bytes(images.pdf(pages))
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    one, two = images.read_pdfs(spark, str(tmp_path)).orderBy("page").collect()
    assert (one.w, one.h, two.w, two.h) == (400, 560, 2200, 1100)
    got = np.frombuffer(bytes(one.body), np.uint8).reshape(560, 400, 3)
    assert (cleanup.resize_rgb(a, 400, 560) == got).all()
    whole = np.frombuffer(bytes(two.body), np.uint8).reshape(1100, 2200, 3)
    assert (whole[:300] == 255).all() and (whole[300:650, 500:750] == cleanup.resize_rgb(a, 250, 350)).all()


def test_whole_picture_filters_equal_the_relational_ones(spark):
    a = np.random.default_rng(4).integers(0, 256, (7, 6, 3), np.uint8)
    df = as_images(spark, [a])
    px = images.to_pixels(df)
    for name in [*color.RECIPES, "bw", "sharpen"]:
        rows = color.apply_filter(px, name, 0.3, 1.2).collect()
        want = np.zeros_like(a)
        for r in rows:
            want[r.y, r.x] = (r.r, r.g, r.b)
        assert (cleanup.filtered(a, name, 0.3, 1.2) == want).all(), name


def test_export_as_one_plan(spark, tmp_path):
    rng = np.random.default_rng(6)
    body = lambda: bytearray(rng.integers(0, 256, (12, 9, 3), np.uint8).tobytes())
    rows = [(d, p, 9, 12, body(), "sepia" if p else "original", 0.0, 1.0, fmt, 1704067200000) for d, n, fmt in ((1, 1, "both"), (2, 3, "jpg"), (3, 2, "pdf")) for p in range(n)]
    rows.append((3, 2, 9, 12, bytearray(b"broken"), "bw", 0.0, 1.0, "pdf", 1704067200000))
    pages_ = spark.createDataFrame(rows, "doc_id long, pos int, w int, h int, body binary, filter_id string, brightness double, contrast double, format string, ts long")
    reg = spark.createDataFrame([(7, "old", 5, 1, "pdf", "u", [], "")], "id long, title string, timestamp long, pageCount int, format string, pdfUri string, jpgUris array<string>, searchText string")
    inbox = spark.createDataFrame([("scan_20240101_000000.pdf", "old"), ("other", "kept")], "name string, uri string")
    made, after, box = exporting.run(pages_.where("doc_id < 3 OR pos < 2"), reg, inbox, jpeg_quality=100)
    files = {(r.doc_id, r.seq): r for r in made.collect()}
    assert {k: (r.name, r.kind) for k, r in files.items()} == {
        (1, 0): ("scan_20240101_000000.pdf", "pdf"), (1, 1): ("scan_20240101_000000.jpg", "jpg"), (3, 0): ("scan_20240101_000000.pdf", "pdf"),
        (2, 1): ("scan_20240101_000000_p1.jpg", "jpg"), (2, 2): ("scan_20240101_000000_p2.jpg", "jpg"), (2, 3): ("scan_20240101_000000_p3.jpg", "jpg"),
    }
    assert len(images.pdf_pages(bytes(files[3, 0].content))) == 2
    (tmp_path / "x.jpg").write_bytes(bytes(files[2, 2].content))
    r = images.read_images(spark, str(tmp_path / "x.jpg")).first()
    sepia = cleanup.filtered(np.frombuffer(bytes(rows[2][4]), np.uint8).reshape(12, 9, 3), "sepia")
    assert np.abs(np.frombuffer(bytes(r.body), np.uint8).reshape(12, 9, 3).astype(int) - sepia).max() <= 6
    recs = {r.id: r for r in after.collect()}
    assert sorted(recs) == [7, 8, 9, 10] and recs[9].pdfUri is None and len(recs[9].jpgUris) == 3 and recs[10].pageCount == 2
    assert {r.uri for r in box.where("name LIKE '%.pdf'").collect()} == {"inbox://scan_20240101_000000.pdf"} and box.where("uri = 'kept'").count() == 1
    assert exporting.share(pages_.where("doc_id = 3")).count() == 1
    images.write_files(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_settings_rules(spark):
    stored = spark.createDataFrame([], "key string, value string")
    value = lambda df, k: settings.resolve(df).where(F.col("key") == k).first().value
    assert [value(settings.set_jpeg_quality(stored, q), "jpegQuality") for q in (3, 77.9, 400)] == ["50", "77", "100"]
    chosen = settings.choose_inbox(stored, "tree:1")
    assert value(chosen, "inboxUri") == "tree:1" and value(chosen, "inboxEnabled") == "true"


def test_degenerate_corners_crop(spark):
    a = np.arange(36).reshape(6, 6)
    got = as_arrays(resample.warp_nearest(gray(spark, [a]), [(1, 2), (4, 2), (4, 2), (1, 2)], 3, 3))
    assert got[0] == {(0, k): int(a[2, 1 + k]) for k in range(3)}
