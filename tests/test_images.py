"""Kernels against plain loops, pixel tables against kernels, image files through Spark's sources, tensors."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom.operators import images
from idloom.sources import io
from idloom.streaming import stability

RNG = np.random.default_rng(2)
GRAY = RNG.integers(0, 256, (37, 41)).astype(np.uint8)
SMOOTH = np.clip(np.add.outer(np.arange(37) * 3, np.arange(41) * 2) + RNG.integers(0, 9, (37, 41)), 0, 255).astype(np.uint8)


def half_up(v):
    return max(0, min(255, math.floor(v + 0.5)))


def plain_blur(g):
    h, w = g.shape
    at = lambda i, n: max(0, min(n - 1, i))
    rows = [[half_up(sum(int(g[y][at(x + k, w)]) * c for k, c in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True)) / 16) for x in range(w)] for y in range(h)]
    return [[half_up(sum(rows[at(y + k, h)][x] * c for k, c in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True)) / 16) for x in range(w)] for y in range(h)]


def plain_ink(g, block, offset):
    h, w = g.shape
    half, out = block // 2, []
    for y in range(h):
        for x in range(w):
            around = [int(g[b][a]) for b in range(max(0, y - half), min(h, y + half + 1)) for a in range(max(0, x - half), min(w, x + half + 1))]
            out.append(0 if int(g[y][x]) < sum(around) / len(around) - offset else 255)
    return np.array(out).reshape(h, w)


@pytest.mark.parametrize("g", [GRAY, SMOOTH, GRAY[:1], GRAY[:, :1], GRAY[:2, :3]], ids=["noise", "smooth", "row", "column", "tiny"])
def test_kernels_equal_plain_loops(g):
    blurred = np.array(plain_blur(g))
    assert (images.gaussian5(g) == blurred).all()
    sharp = np.vectorize(half_up)(g.astype(float) + 0.35 * (g.astype(float) - blurred))
    assert (images.unsharp(g) == sharp).all()
    for block, offset in ((31, 10), (5, 7)):
        assert (images.adaptive_threshold(g, block, offset) == plain_ink(g, block, offset)).all()
    lo, hi = int(g.min()), int(g.max())
    for strength in (1.0, 0.6):
        full = [[v if hi - lo < 10 else half_up(int(v) * (1 - strength) + math.floor((int(v) - lo) / (hi - lo) * 255 + 0.5) * strength) for v in row] for row in g]
        assert (images.stretch(g, strength) == np.array(full)).all()
    for level, offset in (("none", 10), ("mild", 7)):
        assert (images.preprocess_full(g, level) == plain_ink(np.array(plain_blur(sharp)), 31, offset)).all()
    assert (images.preprocess_full(g, "strong") == g).all()


def test_strips_and_resampling():
    n = math.floor(37 * 0.35 + 0.5)
    assert (images.bottom_strip(GRAY) == GRAY[37 - n :]).all() and (images.strip_app(GRAY) == GRAY[math.floor(37 * 0.78 + 0.5) :]).all()
    big = images.resize(GRAY, 37 * 3, 41 * 3)
    assert (big[1::3, 1::3] == GRAY).all()  # centres of tripled pixels
    for i, j in ((5, 7), (0, 0), (110, 122), (50, 60)):
        y, x = min(max((i + 0.5) / 3 - 0.5, 0), 36), min(max((j + 0.5) / 3 - 0.5, 0), 40)
        y0, x0 = int(y), int(x)
        y1, x1 = min(y0 + 1, 36), min(x0 + 1, 40)
        top = GRAY[y0][x0] * (1 - (x - x0)) + GRAY[y0][x1] * (x - x0)
        low = GRAY[y1][x0] * (1 - (x - x0)) + GRAY[y1][x1] * (x - x0)
        assert big[i, j] == half_up(top * (1 - (y - y0)) + low * (y - y0))


def test_pixel_tables_equal_kernels(spark):
    both = {1: GRAY, 2: SMOOTH, 3: GRAY[:1], 4: GRAY[:2, :3]}
    whole = spark.createDataFrame([(i, g.shape[1], g.shape[0], g.tobytes()) for i, g in both.items()], "image_id bigint, w int, h int, gray binary")
    pixels = images.pixels_of(whole)
    assert {r.image_id: bytes(r.gray) for r in images.images_of(pixels).collect()} == {i: g.tobytes() for i, g in both.items()}
    made = images.adaptive_threshold_pixels(images.unsharp_pixels(images.gaussian_pixels(pixels)), block=7, offset=5)
    got = {i: {c: np.zeros(g.shape, int) for c in ("blurred", "sharpened", "ink")} for i, g in both.items()}
    for r in made.collect():
        for c in ("blurred", "sharpened", "ink"):
            got[r.image_id][c][r.y, r.x] = r[c]
    for i, g in both.items():
        assert (got[i]["blurred"] == images.gaussian5(g)).all() and (got[i]["sharpened"] == images.unsharp(g)).all()
        assert (got[i]["ink"] == images.adaptive_threshold(g, 7, 5)).all()
    levels = images.apply_kernels(whole.withColumn("level", F.lit("strong")), ["preprocess_full", "gaussian5"]).collect()
    assert {(r.image_id, r.kernel): bytes(r.gray) for r in levels} == {(i, k): (g if k == "preprocess_full" else images.gaussian5(g)).tobytes() for i, g in both.items() for k in ("preprocess_full", "gaussian5")}


def test_gray_of_halves_equals_pixel_tables(spark):
    """Colours whose luma is a whole or half level, with those at the hotspot's level: arrays round them as columns do."""
    r, g, b = np.meshgrid(*[np.arange(256)] * 3, indexing="ij")
    thousandths = 299 * r + 587 * g + 114 * b
    at = np.vstack([np.argwhere(thousandths % 500 == 0)[::5], np.argwhere(thousandths == 1000 * images.HOTSPOT)])
    at = at[: len(at) // 64 * 64].reshape(-1, 64, 3)
    rgb = images.rgb_of({"height": at.shape[0], "width": 64, "nChannels": 3, "data": at[:, :, ::-1].astype(np.uint8).tobytes()})
    rows = [(1, y, x, *map(int, rgb[y, x])) for y in range(rgb.shape[0]) for x in range(rgb.shape[1])]
    pixels = spark.createDataFrame(rows, "image_id bigint, y int, x int, r int, g int, b int")
    for rounded in (True, False):
        gray = np.zeros(rgb.shape[:2], int)
        for p in images.gray_pixels(pixels, rounded).collect():
            gray[p.y, p.x] = p.gray
        assert (images.to_gray(rgb, rounded) == gray).all()
    told = images.image_glare(pixels).first()
    ratio, mean, *named = images.glare_of(rgb)
    assert ratio == told.hotspot_ratio and abs(mean - told.mean_brightness) < 1e-9 and named == [told.level, told.feedback]


def png(rgb):
    """A PNG file of an array (h, w, 3)."""
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def bmp(rgb):
    h, w = rgb.shape[:2]
    rows = b"".join(row[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for row in rgb[::-1])
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def ppm(rgb):
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.tobytes()


def colour(h, w, low, high, seed=1):
    return np.random.default_rng(seed).integers(low, high, (h, w, 3)).astype(np.uint8)


def test_files_of_images_are_decoded():
    rgb = colour(5, 7, 0, 256)
    for content in (ppm(rgb), bmp(rgb)):
        assert (images.decoded(content) == rgb).all()
    assert (images.decoded(b"P5\n3 2\n255\n" + bytes(range(6))) == np.arange(6).reshape(2, 3)).all()


def test_images_from_files_to_feedback_and_pages(spark, tmp_path):
    """PNG files through Spark's image source: colour order, glare, the level's way of preparing, larger sides scaled."""
    made = {"dark": colour(20, 30, 0, 60), "plain": colour(40, 50, 60, 200), "strong": colour(30, 30, 240, 256), "wide": colour(8, 64, 60, 200)}
    made["mild"] = made["plain"].copy()
    made["mild"][:1, :30] = 255  # 30 of 2000 pixels
    for name, rgb in made.items():
        (tmp_path / f"{name}.png").write_bytes(png(rgb))
    found = images.prepare_images(io.read_images(spark, str(tmp_path)).withColumn("name", F.regexp_extract("image.origin", r"(\w+)\.png", 1)), keep=["name"], max_dim=60)
    got = {r.name: r for r in found.collect()}
    want = {"dark": "too_dark", "plain": "ok", "strong": "glare_strong", "wide": "ok", "mild": "glare_mild"}
    assert {k: r.feedback for k, r in got.items()} == want
    assert (got["wide"].w, got["wide"].h) == (60, 8)
    for name in ("dark", "plain", "strong", "mild"):
        rgb, r = made[name].astype(float), got[name]
        luma = 0.299 * rgb[:, :, 0] + 0.587 * rgb[:, :, 1] + 0.114 * rgb[:, :, 2]
        assert abs(r.mean_brightness - luma.mean()) < 1e-9 and abs(r.hotspot_ratio - (luma >= 245).mean()) < 1e-12
        gray = np.floor(luma + 0.5).astype(np.uint8)
        assert bytes(r.full) == images.preprocess_full(gray, r.level).tobytes() and bytes(r.mrz) == images.preprocess_mrz(gray, r.level).tobytes()
        assert (r.mrz_w, r.mrz_h) == (3 * r.w, 3 * math.floor(r.h * 0.35 + 0.5))


def test_tensors(spark):
    rgb = colour(62, 100, 0, 256)
    bgr = spark.createDataFrame([(7, ("", 62, 100, 3, 16, rgb[:, :, ::-1].tobytes())), (8, None)], "image_id bigint, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    boxes = spark.createDataFrame([(7, "name", 10, 20, 50, 51), (7, "wide", 0, 0, 100, 4), (7, "none", 5, 5, 5, 5)], "image_id bigint, field string, x1 int, y1 int, x2 int, y2 int")
    got = {r.field: np.array(r.tensor).reshape(31, 200) for r in images.field_tensors(bgr, boxes).collect()}
    luma = lambda p: half_up(0.299 * int(p[0]) + 0.587 * int(p[1]) + 0.114 * int(p[2]))
    name = got["name"]  # 40 x 31: its own size
    assert all(name[y, x] == luma(rgb[20 + y, 10 + x]) for y in range(31) for x in range(40)) and (name[:, 40:] == luma(rgb[50, 49])).all()
    assert (got["wide"][8:] == luma(rgb[3, 99])).all() and got["wide"].shape == (31, 200)  # 100 x 4 becomes 200 x 8
    assert (got["none"][:, 31:] == luma(rgb[5, 5])).all()
    box = images.letterbox_tensors(bgr, keep=["image_id"]).collect()
    assert len(box) == 1 and (box[0].r, box[0].dw, box[0].dh) == (6.4, 0.0, (640 - 397) / 2)
    tensor = np.array(box[0].tensor).reshape(640, 640, 3)
    top = math.floor((640 - 397) / 2 - 0.1 + 0.5)
    assert (tensor[:top] == 114).all() and (tensor[top + 397 :] == 114).all() and not (tensor[top : top + 397] == 114).all()
    assert (tensor[top, 0] == rgb[0, 0]).all() and (tensor[top + 396, 639] == rgb[61, 99]).all()  # red first; the corner repeats


def test_feedback_of_files_in_a_stream_gates_the_scan(spark, tmp_path):
    """Image files arrive in a stream, become feedback, and hold back frames of strong glare; the same as from tables."""
    start = 1_700_000_100_000
    shades = [colour(16, 16, 60, 200), colour(16, 16, 245, 256), colour(16, 16, 0, 40)]
    folder = tmp_path / "files"
    for i in range(6):
        place = folder / f"{i % 2}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{start + 2000 * i}.{'bmp' if i % 2 else 'ppm'}").write_bytes((bmp if i % 2 else ppm)(shades[i % 3]))
    (folder / "notes.txt").write_bytes(b"no image")
    table = images.frame_feedback(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)))
    want = {(i % 2, start + 2000 * i, ("ok", "glare_strong", "too_dark")[i % 3]) for i in range(6)}
    assert {(r.session_id, r.frame_id, r.feedback) for r in table.collect()} == want
    stream = images.frame_feedback(io.read_image_stream(spark, str(folder), files_per_batch=2))
    stream.writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, spark.table("told").collect())) == sorted(map(repr, table.collect()))
    shots = [(s, start + 500 * i, 100 + i) for i in range(26) for s in (0, 1)]
    frames = spark.createDataFrame(shots, "session_id bigint, ms bigint, frame_id bigint").select("session_id", F.timestamp_millis("ms").alias("ts"), "frame_id")
    gated = {(r.session_id, r.frame_id) for r in stability.frame_gate(frames, spark.table("told").select("session_id", "ts", "feedback")).collect()}
    glare = lambda s, t: next((f for a, b, f in sorted(want, key=lambda x: -x[1]) if a == s and b <= t), "ok") == "glare_strong"
    assert gated == {(s, i) for s, t, i in shots if not glare(s, t)} and len(gated) < len(shots)
