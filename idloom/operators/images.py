"""Image quality measures and preprocessing kernels: pixel tables in SQL, whole images in numpy."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from idloom.session import prepare

# Thresholds and sizes of the kernels.
HOTSPOT, STRONG, MILD, DARK = 245, 0.04, 0.01, 55
MAX_DIM, BLOCK, OFFSET, OFFSET_MILD, SHARPEN = 1920, 31, 10, 7, 0.35
STRIP, STRIP_APP, UPSCALE = 0.35, 0.78, 3
CROP_H, CROP_W, SIDE, PAD = 31, 200, 640, 114
LUMA = (0.299, 0.587, 0.114)


def fit_max_dim(df: DataFrame, max_dim: int = MAX_DIM) -> DataFrame:
    """w and h scaled down so that neither exceeds max_dim."""
    r = F.least(F.lit(1.0), max_dim / F.greatest("w", "h"))
    return df.withColumn("_r", r).withColumns({c: F.floor(F.col(c) * F.col("_r") + 0.5).cast("int") for c in ("w", "h")}).drop("_r")


def luma() -> Column:
    return LUMA[0] * F.col("r") + LUMA[1] * F.col("g") + LUMA[2] * F.col("b")


def gray_pixels(pixels: DataFrame, rounded: bool = True) -> DataFrame:
    """image_id, y, x, gray; rounded, or cut down to whole numbers."""
    return pixels.select("image_id", "y", "x", (F.floor(luma() + 0.5) if rounded else F.floor(luma())).cast("int").alias("gray"))


def glare_level(ratio: Column) -> Column:
    return F.when(ratio >= STRONG, "strong").when(ratio >= MILD, "mild").otherwise("none")


def glare_feedback(level: Column, mean: Column) -> Column:
    return F.when(level == "strong", "glare_strong").when(level == "mild", "glare_mild").when(mean < DARK, "too_dark").otherwise("ok")


def image_glare(pixels: DataFrame) -> DataFrame:
    """image_id, hotspot_ratio, mean_brightness, level, feedback of a pixel table."""
    m = pixels.groupBy("image_id").agg(F.avg(F.when(luma() >= HOTSPOT, 1.0).otherwise(0.0)).alias("hotspot_ratio"), F.avg(luma()).alias("mean_brightness"))
    m = m.withColumn("level", glare_level(F.col("hotspot_ratio")))
    return m.withColumn("feedback", glare_feedback(F.col("level"), F.col("mean_brightness")))


def otsu(gray: DataFrame) -> DataFrame:
    """image_id, threshold: the first level of greatest between-class variance, 128 without two classes."""
    w = Window.partitionBy("image_id").orderBy("gray")
    every = Window.partitionBy("image_id")
    hist = gray.groupBy("image_id", "gray").agg(F.count("*").cast("double").alias("n"))  # at most 256 rows an image
    c = hist.select("image_id", "gray", F.sum("n").over(w).alias("wb"), F.sum(F.col("n") * F.col("gray")).over(w).alias("sb"), F.sum("n").over(every).alias("all"), F.sum(F.col("n") * F.col("gray")).over(every).alias("s"))
    wf = F.col("all") - F.col("wb")
    var = F.when(wf > 0, F.col("wb") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf, 2))
    best = c.withColumn("v", var).groupBy("image_id").agg(F.min(F.when(F.col("v") > 0, F.struct((-F.col("v")).alias("v"), "gray"))).alias("b"))
    return best.select("image_id", F.coalesce("b.gray", F.lit(128)).cast("int").alias("threshold"))


def binarize(gray: DataFrame, thresholds: DataFrame) -> DataFrame:
    return gray.join(thresholds, "image_id").select("image_id", "y", "x", F.when(F.col("gray") <= F.col("threshold"), 0).otherwise(255).alias("gray"))


def contrast_stretch(gray: DataFrame, strength: float = 1.0) -> DataFrame:
    """Gray values spread to 0..255, mixed with the old ones by strength; a range under 10 stays as it is."""
    ends = gray.groupBy("image_id").agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"))
    full = F.floor((F.col("gray") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255 + 0.5)
    out = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("gray") * (1 - strength) + full * strength + 0.5)))
    return gray.join(ends, "image_id").select("image_id", "y", "x", F.when(F.col("hi") - F.col("lo") < 10, F.col("gray")).otherwise(out).cast("int").alias("gray"))


# Stencils over pixel tables (image_id, y, x, gray) of whole images: dealt by image once, all windows then sort within it.


def _level(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c + 0.5))).cast("int")


def _along(axis: str) -> tuple[Window, Window]:
    """A window over the pixels of each line along axis, and the same over the whole line."""
    line = Window.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)
    return line, line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def gaussian_pixels(pixels: DataFrame, source: str = "gray", out: str = "blurred") -> DataFrame:
    """pixels with `out`, the 5-tap blur of `source`: along rows, then columns, rounded after each; edges repeat."""
    df = pixels.repartition("image_id")
    for axis, value, name in (("x", source, "_row"), ("y", "_row", out)):
        line, whole = _along(axis)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        taps = [F.coalesce(F.lag(value, 2).over(line), first), F.coalesce(F.lag(value, 1).over(line), first), F.col(value), F.coalesce(F.lead(value, 1).over(line), last), F.coalesce(F.lead(value, 2).over(line), last)]
        df = df.withColumn(name, _level((taps[0] + 4 * taps[1] + 6 * taps[2] + 4 * taps[3] + taps[4]) / 16))
    return df.drop("_row")


def unsharp_pixels(pixels: DataFrame, amount: float = SHARPEN, out: str = "sharpened") -> DataFrame:
    """pixels with `out`: gray and its difference to the blur, times amount."""
    blurred = gaussian_pixels(pixels, out="_blurred")
    return blurred.withColumn(out, _level(F.col("gray") + amount * (F.col("gray") - F.col("_blurred")))).drop("_blurred")


def adaptive_threshold_pixels(pixels: DataFrame, source: str = "gray", out: str = "ink", block: int = BLOCK, offset: float = OFFSET) -> DataFrame:
    """pixels with `out`: 0 where source is more than offset below the mean of the block around it, else 255.

    The block's sum is taken from prefix sums along rows, then columns: the work for a pixel does not depend on the block. At
    the edges blocks, and so their areas, are smaller.
    """
    half = block // 2
    df = pixels.repartition("image_id").withColumns({"_s": F.col(source).cast("long"), "_n": F.lit(1).cast("long")})
    for axis in ("x", "y"):
        line, whole = _along(axis)
        upto = line.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"{c}p": F.sum(c).over(upto) for c in ("_s", "_n")})
        end = lambda c: F.coalesce(F.lead(c, half).over(line), F.last(c).over(whole))  # noqa: B023, E731
        begin = lambda c: F.coalesce(F.lag(c, half + 1).over(line), F.lit(0))  # noqa: B023, E731
        df = df.withColumns({c: end(f"{c}p") - begin(f"{c}p") for c in ("_s", "_n")}).drop("_sp", "_np")
    return df.withColumn(out, F.when(F.col(source) < F.col("_s") / F.col("_n") - offset, 0).otherwise(255)).drop("_s", "_n")


# Kernels over one image as a uint8 array (h, w).


def _u8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def luma_of(rgb: np.ndarray) -> np.ndarray:
    """luma() of an array (h, w, 3), summed in the same order: a matrix product sums in another, which moves halves of a level."""
    r, g, b = (rgb[:, :, c].astype(float) for c in range(3))
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def to_gray(rgb: np.ndarray, rounded: bool = True) -> np.ndarray:
    g = luma_of(rgb)
    return _u8(g) if rounded else g.astype(np.uint8)


def stretch(gray: np.ndarray, strength: float = 1.0) -> np.ndarray:
    lo, hi = int(gray.min(initial=255)), int(gray.max(initial=0))
    if hi - lo < 10:
        return gray
    return _u8(gray * (1 - strength) + np.floor((gray.astype(float) - lo) / (hi - lo) * 255 + 0.5) * strength)


def gaussian5(gray: np.ndarray) -> np.ndarray:
    for axis in (1, 0):
        n = gray.shape[axis]
        at = np.clip(np.arange(n)[:, None] + np.arange(-2, 3), 0, n - 1)
        taken = np.take(gray.astype(float), at, axis=axis)
        kernel = np.array([1, 4, 6, 4, 1]) / 16
        gray = _u8(np.tensordot(taken, kernel, axes=([axis + 1], [0])))
    return gray


def unsharp(gray: np.ndarray, amount: float = SHARPEN) -> np.ndarray:
    g = gray.astype(float)
    return _u8(g + amount * (g - gaussian5(gray)))


def adaptive_threshold(gray: np.ndarray, block: int = BLOCK, offset: float = OFFSET) -> np.ndarray:
    h, w = gray.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = gray.astype(float).cumsum(0).cumsum(1)
    half = block // 2
    y1, y2 = np.clip(np.arange(h) - half, 0, None), np.clip(np.arange(h) + half, None, h - 1) + 1
    x1, x2 = np.clip(np.arange(w) - half, 0, None), np.clip(np.arange(w) + half, None, w - 1) + 1
    total = s[np.ix_(y2, x2)] - s[np.ix_(y1, x2)] - s[np.ix_(y2, x1)] + s[np.ix_(y1, x1)]
    return np.where(gray < total / np.outer(y2 - y1, x2 - x1) - offset, 0, 255).astype(np.uint8)


def resize(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    ys, xs = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((h, gray.shape[0]), (w, gray.shape[1])))
    y, x = np.clip(ys, 0, gray.shape[0] - 1), np.clip(xs, 0, gray.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, gray.shape[0] - 1), np.minimum(x0 + 1, gray.shape[1] - 1)
    fy, fx, g = (y - y0)[:, None], (x - x0)[None, :], gray.astype(float)
    return _u8((g[np.ix_(y0, x0)] * (1 - fx) + g[np.ix_(y0, x1)] * fx) * (1 - fy) + (g[np.ix_(y1, x0)] * (1 - fx) + g[np.ix_(y1, x1)] * fx) * fy)


def bottom_strip(image: np.ndarray, fraction: float = STRIP) -> np.ndarray:
    n = int(np.floor(image.shape[0] * fraction + 0.5))
    return image[image.shape[0] - n :]


def strip_app(image: np.ndarray, start: float = STRIP_APP) -> np.ndarray:
    return image[int(np.floor(image.shape[0] * start + 0.5)) :]


def preprocess_full(gray: np.ndarray, level: str = "none") -> np.ndarray:
    if level == "strong":
        return gray
    return adaptive_threshold(gaussian5(unsharp(gray)), offset=OFFSET_MILD if level == "mild" else OFFSET)


def preprocess_mrz(gray: np.ndarray, level: str = "none") -> np.ndarray:
    g = stretch(bottom_strip(gray), 0.6 if level == "strong" else 1.0)
    g = g if level == "strong" else gaussian5(g)
    return resize(g, g.shape[0] * UPSCALE, g.shape[1] * UPSCALE)


def field_tensor(image: np.ndarray) -> np.ndarray:
    """A crop, gray or in colour, fitted into 31 x 200 as gray, padded on the right and below with the luma of its last pixel."""
    h, w = image.shape[:2]
    nh, nw = CROP_H, int(w * (CROP_H / h))
    if nw > CROP_W:
        nw, nh = CROP_W, int(h * (CROP_W / w))
    nh, nw = max(1, nh), max(1, nw)
    last = image[-1:, -1:]
    out = np.full((CROP_H, CROP_W), (to_gray(last) if image.ndim == 3 else last)[0, 0], np.uint8)
    small = resize_colours(image, nh, nw)
    out[:nh, :nw] = to_gray(small) if image.ndim == 3 else small
    return out


def resize_colours(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, each channel by itself; an image of that size stays as it is."""
    if image.shape[:2] == (h, w):
        return image
    return resize(image, h, w) if image.ndim == 2 else np.dstack([resize(image[:, :, c], h, w) for c in range(image.shape[2])])


def letterbox_tensor(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """An image fitted into side x side in colour, centred on gray."""
    h, w = rgb.shape[:2]
    r = min(side / w, side / h)
    nw, nh = int(np.floor(w * r + 0.5)), int(np.floor(h * r + 0.5))
    left, top = int(np.floor((side - nw) / 2 - 0.1 + 0.5)), int(np.floor((side - nh) / 2 - 0.1 + 0.5))
    out = np.full((side, side, 3), PAD, np.uint8)
    out[top : top + nh, left : left + nw] = resize_colours(rgb, nh, nw)
    return out


def glare_of(rgb: np.ndarray) -> tuple[float, float, str, str]:
    """Hotspot ratio, mean brightness, level and feedback of an image; one without pixels is ok, of brightness 128."""
    if not rgb.size:
        return 0.0, 128.0, "none", "ok"
    bright = luma_of(rgb)
    ratio, mean = float((bright >= HOTSPOT).mean()), float(bright.mean())
    level = "strong" if ratio >= STRONG else "mild" if ratio >= MILD else "none"
    return ratio, mean, level, f"glare_{level}" if level != "none" else "too_dark" if mean < DARK else "ok"


KERNELS: dict[str, Callable[..., np.ndarray]] = {"stretch": stretch, "gaussian5": gaussian5, "unsharp": unsharp, "adaptive_threshold": adaptive_threshold, "preprocess_full": preprocess_full, "preprocess_mrz": preprocess_mrz, "field_tensor": field_tensor, "bottom_strip": bottom_strip, "strip_app": strip_app}
#: Kernels that glare changes.
BY_LEVEL = ("preprocess_full", "preprocess_mrz")


_IMAGE = "w int, h int, gray binary"


def apply_kernels(images: DataFrame, kernels: list[str]) -> DataFrame:
    """image_id, kernel, w, h, gray: each of the images(image_id, w, h, gray binary[, level]) after each kernel, in one pass.

    Kernels that depend on glare take the image's level, or none. One image at a time, without a shuffle.
    """
    prepare(images.sparkSession)
    named = [c for c in ("image_id", "w", "h", "gray", "level") if c in images.columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["gray"], np.uint8).reshape(row["h"], row["w"])
                made = [KERNELS[k](image, row.get("level") or "none") if k in BY_LEVEL else KERNELS[k](image) for k in kernels]
                yield pa.RecordBatch.from_pydict({"image_id": [row["image_id"]] * len(made), "kernel": kernels, "w": [m.shape[1] for m in made], "h": [m.shape[0] for m in made], "gray": [m.tobytes() for m in made]}, schema=kept)

    kept = pa.schema([("image_id", pa.int64()), ("kernel", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("gray", pa.binary())])
    return images.select(*named).mapInArrow(run, f"image_id bigint, kernel string, {_IMAGE}")


def pixels_of(images: DataFrame, *by: str) -> DataFrame:
    """image_id, the columns `by`, y, x, gray: a row for each pixel of images(image_id, w, h, gray binary)."""
    prepare(images.sparkSession)
    kept = ["image_id", *by]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (w, h, gray) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("w", "h", "gray")), strict=True)):
                at = np.arange(w * h, dtype=np.int32)
                own = [batch.column(c).take(pa.array(np.full(w * h, i))) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at // max(1, w)), pa.array(at % max(1, w)), pa.array(np.frombuffer(gray, np.uint8).astype(np.int32))], names=[*kept, "y", "x", "gray"])

    schema = ", ".join(f"{c} {dict(images.dtypes)[c]}" for c in kept)
    return images.select(*kept, "w", "h", "gray").mapInArrow(run, f"{schema}, y int, x int, gray int")


def images_of(pixels: DataFrame, column: str = "gray") -> DataFrame:
    """image_id, w, h, gray binary: the inverse of pixels_of for whole images."""
    every = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", F.col(column).cast("int").alias("v")))).alias("p"))
    return every.select("image_id", "w", "h", F.unhex(F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")).alias("gray"))


def decoded(content: bytes) -> np.ndarray:
    """A binary PPM or PGM or an uncompressed BMP file as an array (h, w[, 3]), red first; other formats come through Spark's image source."""
    if content[:2] == b"BM":
        start = int.from_bytes(content[10:14], "little")
        w, h = (int.from_bytes(content[k : k + 4], "little", signed=True) for k in (18, 22))
        depth, packed = int.from_bytes(content[28:30], "little") // 8, int.from_bytes(content[30:34], "little")
        if depth not in (3, 4) or packed:
            raise ValueError("of BMP files only those of 24 and 32 bits without compression are read")
        line = (w * depth + 3) // 4 * 4
        rows = np.frombuffer(content, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * depth]
        return (rows if h < 0 else rows[::-1]).reshape(abs(h), w, depth)[:, :, 2::-1]
    f = io.BytesIO(content)
    kind, size = f.readline().split()[0], f.readline().split()
    f.readline()
    w, h = map(int, size)
    data = np.frombuffer(f.read(), np.uint8)
    return data.reshape(h, w, 3) if kind == b"P6" else data.reshape(h, w)


def rgb_of(image: dict) -> np.ndarray:
    """The pixels (h, w, 3), red first, of a struct of Spark's image source, which holds gray, BGR or BGRA bytes."""
    data = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(data, 3, axis=2) if image["nChannels"] == 1 else data[:, :, 2::-1]


def _each(df: DataFrame, column: str, kept: list[str], make: Callable[[np.ndarray, dict], dict], schema: str) -> DataFrame:
    """make(pixels, row) for each image struct of df, beside the columns `kept`: one image at a time, in batches bounded by bytes."""
    prepare(df.sparkSession)
    out = StructType([*df.select(*kept).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row[column] is not None:
                    yield pa.RecordBatch.from_pylist([{c: row[c] for c in kept} | make(rgb_of(row[column]), row)], schema=arrow)

    return df.mapInArrow(run, out)


_PREPARED = "w int, h int, hotspot_ratio double, mean_brightness double, level string, feedback string, full binary, mrz_w int, mrz_h int, mrz binary"


def prepare_images(images: DataFrame, column: str = "image", keep: list[str] | None = None, max_dim: int = MAX_DIM) -> DataFrame:
    """The columns `keep` and w, h, glare, feedback, full and mrz of Spark's image structs, as read_images gives them.

    A larger side is scaled to max_dim. Glare, measured in colour, decides how the gray page (full) and its bottom
    strip (mrz, three times its size) are prepared for recognition. Null images are left out.
    """

    def make(rgb: np.ndarray, row: dict) -> dict:
        h, w = rgb.shape[:2]
        k = min(1.0, max_dim / max(w, h, 1))
        rgb = resize_colours(rgb, int(np.floor(h * k + 0.5)), int(np.floor(w * k + 0.5)))
        ratio, mean, level, feedback = glare_of(rgb)
        gray = to_gray(rgb)
        full, mrz = preprocess_full(gray, level), preprocess_mrz(gray, level)
        return {"w": gray.shape[1], "h": gray.shape[0], "hotspot_ratio": ratio, "mean_brightness": mean, "level": level, "feedback": feedback, "full": full.tobytes(), "mrz_w": mrz.shape[1], "mrz_h": mrz.shape[0], "mrz": mrz.tobytes()}

    return _each(images, column, keep or [], make, _PREPARED)


def letterbox_tensors(images: DataFrame, column: str = "image", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, tensor (floats 0 to 255 of 1 x 640 x 640 x 3: rows, columns, red green blue), r, dw, dh."""

    def make(rgb: np.ndarray, row: dict) -> dict:
        h, w = rgb.shape[:2]
        r = min(SIDE / w, SIDE / h)
        nw, nh = np.floor(w * r + 0.5), np.floor(h * r + 0.5)
        return {"tensor": letterbox_tensor(rgb).ravel().astype(np.float32), "r": r, "dw": float(SIDE - nw) / 2, "dh": float(SIDE - nh) / 2}

    return _each(images, column, keep or [], make, "tensor array<float>, r double, dw double, dh double")


def field_tensors(images: DataFrame, boxes: DataFrame, column: str = "image") -> DataFrame:
    """image_id, field, tensor (floats 0 to 255 of 1 x 31 x 200 x 1) of the boxes(image_id, field, x1, y1, x2, y2) of images(image_id, image).

    A box without area counts as one pixel; beyond the image there is none, so a box's part outside is black, as on a canvas.
    """
    crops = boxes.groupBy("image_id").agg(F.collect_list(F.struct("field", "x1", "y1", "x2", "y2")).alias("crops"))  # a field each

    def make(rgb: np.ndarray, row: dict) -> dict:
        made = []
        for b in row["crops"]:
            x1, y1 = int(b["x1"]), int(b["y1"])
            w, h = max(1, int(b["x2"]) - x1), max(1, int(b["y2"]) - y1)
            crop = np.zeros((h, w, 3), np.uint8)
            part = rgb[max(0, y1) : max(0, y1 + h), max(0, x1) : max(0, x1 + w)]
            top, left = max(0, -y1), max(0, -x1)
            crop[top : top + part.shape[0], left : left + part.shape[1]] = part
            made.append({"field": b["field"], "tensor": field_tensor(crop).ravel().astype(np.float32)})
        return {"made": made}

    done = _each(images.join(crops, "image_id").select("image_id", column, "crops"), column, ["image_id"], make, "made array<struct<field:string,tensor:array<float>>>")
    return done.select("image_id", F.inline("made"))


def frame_feedback(files: DataFrame) -> DataFrame:
    """session_id, ts, frame_id, feedback of image files (path, content) named session/milliseconds.ext: batch or stream.

    Glare is measured at a quarter of the size. Files of other names are left out.
    """
    prepare(files.sparkSession)
    name = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)\.\w+$", k)
    named = files.where(name(1) != "").select(name(1).cast("long").alias("session_id"), name(2).cast("long").alias("frame_id"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for content in batch.column(2).to_pylist():
                image = decoded(content)
                rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
                h, w = (max(1, int(np.floor(n / 4 + 0.5))) for n in rgb.shape[:2])
                told.append(glare_of(resize_colours(rgb, h, w))[3] if rgb.size else "ok")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], names=["session_id", "frame_id", "feedback"])

    told = named.mapInArrow(run, "session_id bigint, frame_id bigint, feedback string")
    return told.select("session_id", F.timestamp_millis("frame_id").alias("ts"), "frame_id", "feedback")
