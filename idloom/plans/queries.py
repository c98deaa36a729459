"""The registered queries over scans, detections, images, frames and rosters, with the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import mrz as M
from idloom.functions import text as T
from idloom.functions import visual as V
from idloom.operators import detections as D
from idloom.operators import fio, fuzzy, images, merge, roster
from idloom.plans import fixtures as X
from idloom.session import dealt
from idloom.streaming import stability as W

YEAR = X.AS_OF_YEAR
_MRZ_FIELDS = ("surname", "name", "patronymic", "dateOfBirth", "gender", "documentNumber", "expiryDate", "citizenship", "mrzValid", "confidence")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "SCANS")


def q_parse_mrz(spark: SparkSession, d: str) -> DataFrame:
    read = M.parse_mrz(X.table(spark, d, "MRZ"), "mrz_text", YEAR)
    return read.select("scan_id", *(F.col(f"mrz.{c}").alias(c) for c in _MRZ_FIELDS))


def q_parse_mrz_app(spark: SparkSession, d: str) -> DataFrame:
    read = M.parse_mrz_app(X.table(spark, d, "MRZ"), "mrz_text", YEAR)
    return read.select("scan_id", *(F.col(f"mrz.{c}").alias(c) for c in ("valid", "surname", "name", "patronymic", "dob")))


def q_resolved_status(spark: SparkSession, d: str) -> DataFrame:
    """Zones read, merged with nothing visual, and counted by status."""
    read = M.parse_mrz(X.table(spark, d, "MRZ"), "mrz_text", YEAR).withColumn("doc", merge.merged(F.col("mrz"), None))
    status = merge.ocr_status(F.col("doc.surname"), F.col("doc.name"), F.col("doc.mrzValid"))
    return read.groupBy(status.alias("status"), F.col("doc.documentType").alias("document_type")).agg(F.count("*").alias("scans"), F.sum("doc.confidence").alias("confidence"))


def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    clean = T.clean_ocr_text(F.col("full_text"))
    return _scans(spark, d).select("scan_id", clean.alias("clean"), T.detect_lang(clean).alias("lang"), F.array_join(T.split_lines(clean), "|").alias("lines"))


def q_words(spark: SparkSession, d: str) -> DataFrame:
    lines = _scans(spark, d).select("scan_id", F.posexplode(T.split_lines(F.col("full_text"))).alias("li", "line"))
    words = lines.select("scan_id", "li", F.posexplode(T.cyr_words(F.upper("line"))).alias("no", "w"))
    w = F.col("w")
    return words.select("scan_id", "li", "no", "w", T.to_title(w).alias("title"), T.is_label(w).alias("label"), T.is_label_visual(w).alias("label_visual"), T.is_patronymic(w).alias("patronymic"))


def q_latin_words(spark: SparkSession, d: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", F.explode(T.latin_words(F.upper(F.regexp_replace(T.text("text"), "ß", "SS")))).alias("w"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(T.is_latin_patronymic(F.col("w"))).alias("patronymics"), F.max("w").alias("last_word"))


def q_text_after_label(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("scan_id", T.text_after_label(F.col("full_text"), "ИМЯ").alias("after_name"), T.text_after_label(F.col("full_text"), "ФАМИЛИ").alias("after_surname"))


def q_dates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("full_text")
    return _scans(spark, d).select("scan_id", F.array_join(V.extract_dates(c), "|").alias("dates"), V.find_valid_dob(c, YEAR).alias("dob"), V.find_valid_dob(c, YEAR, 14, 80).alias("dob_app"), V.extract_any_date(c).alias("any_date"), V.find_best_dob(T.split_lines(c), YEAR).alias("best_dob"))


def q_visual_passport(spark: SparkSession, d: str) -> DataFrame:
    return V.parse_russian_passport(_scans(spark, d), "full_text", YEAR).select("scan_id", "visual.*")


def q_fuzzy_find(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.fuzzy_find(X.table(spark, d, "WORDS"), X.table(spark, d, "DICTIONARY"), 2, segments=False)


def q_fuzzy_find_segments(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.fuzzy_find(X.table(spark, d, "WORDS"), X.table(spark, d, "DICTIONARY"), 2, segments=True)


def q_fio(spark: SparkSession, d: str) -> DataFrame:
    found = fio.extract_fio(_scans(spark, d), X.table(spark, d, "NAMES"))
    shown = F.transform("anchors", lambda a: F.concat_ws(":", a["part"], a["word"], a["dist"].cast("string"), a["raw_word"]))
    return found.withColumn("candidates", F.array_join("candidates", " ")).withColumn("anchors", F.array_join(shown, " "))


def q_fio_latin(spark: SparkSession, d: str) -> DataFrame:
    latin = _scans(spark, d).where(T.detect_lang(F.col("full_text")) == "latin")
    return latin.select("scan_id", fio.extract_fio_latin(T.split_lines(T.clean_ocr_text(F.col("full_text")))).alias("r")).select("scan_id", "r.*")


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scans with names from text, zone, visual date and, for some, what a model read; and what precedence makes of them."""
    scans = _scans(spark, d)
    found = fio.extract_fio(scans, X.table(spark, d, "NAMES")).select("scan_id", F.struct("surname", "name", "patronymic", "confidence", "strategy", "candidates", "anchors").alias("fio"))
    zones = M.parse_mrz_app(X.table(spark, d, "MRZ"), "mrz_text", YEAR).select("scan_id", "mrz", "mrz_text")
    model = F.when(F.col("scan_id") % 17 == 0, F.struct(F.lit("Модель").alias("surname"), F.lit("").alias("name"), F.lit("").alias("patronymic")))
    dob = V.find_best_dob(T.split_lines(F.col("full_text")), YEAR, 14, 80)
    joined = scans.withColumn("visual_dob", dob).join(found, "scan_id", "left").join(zones, "scan_id", "left").withColumn("model", model)
    return joined, merge.resolve_passport(joined)


def q_resolve_passport(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: names from text, zone, visual date, precedence, status."""
    done = _resolved(spark, d)[1]
    return done.withColumn("status", merge.ocr_status(F.col("surname"), F.col("name"), F.col("mrz_found")))


def q_merge_results(spark: SparkSession, d: str) -> DataFrame:
    zones = M.parse_mrz(X.table(spark, d, "MRZ"), "mrz_text", YEAR).select("scan_id", "mrz")
    seen = V.parse_russian_passport(_scans(spark, d), "full_text", YEAR).select("scan_id", "visual")
    doc = merge.merge_results(zones, seen)
    return doc.select("scan_id", *(F.col(f"doc.{c}").alias(c) for c in ("documentType", "surname", "name", "patronymic", "dateOfBirth", "gender", "issuedDate", "mrzValid", "confidence")))


#: Anchors of an image made of vectors: images grow in number with the table, not in size.
ANCHORS = 50


def _detections(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    scores = F.transform(F.slice("embedding", 5, 22), lambda x: x.cast("double"))
    return e.select(F.floor(F.col("vec_id") / ANCHORS).alias("image_id"), F.col("vec_id").cast("int").alias("anchor_idx"), (320 + 400 * at(0)).alias("cx"), (320 + 400 * at(1)).alias("cy"), (60 + 100 * at(2)).alias("bw"), (60 + 100 * at(3)).alias("bh"), scores.alias("scores"))


def _best(spark: SparkSession, d: str) -> DataFrame:
    return D.best_class(_detections(spark, d), least=0.2)


def _dims(spark: SparkSession, d: str) -> DataFrame:
    ids = _detections(spark, d).select("image_id").distinct()
    return ids.select("image_id", (800 + 37 * (F.col("image_id") % 20)).cast("int").alias("w"), (600 + 91 * (F.col("image_id") % 20)).cast("int").alias("h"))


def q_best_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = D.unscale(D.best_box(_best(spark, d)), _dims(spark, d))
    return boxes.withColumn("conf", F.round("conf", 6))


def q_boxes_by_field(spark: SparkSession, d: str) -> DataFrame:
    wide = D.fields_of_images(D.unscale(D.best_box(_best(spark, d)), _dims(spark, d)))
    return wide.select("image_id", *(F.col(f"{f}.{c}").alias(f"{f}_{c}") for f in D.FIELDS.values() for c in ("x1", "y2")))


def q_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    box = _best(spark, d).select("image_id", "cls", F.struct("anchor_idx", "x1", "y1", "x2", "y2").alias("a"))
    pairs = box.join(box.withColumnRenamed("a", "b"), ["image_id", "cls"]).where("a.anchor_idx < b.anchor_idx")
    over = D.iou("a", "b")
    return pairs.where(over >= D.OVERLAP).select("image_id", "cls", F.col("a.anchor_idx").alias("first"), F.col("b.anchor_idx").alias("second"), F.round(over, 6).alias("iou"))


def q_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes that cover each other, of 2,000 boxes an image: sixteen of each vector."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(F.expr("transform(sequence(0, 15), k -> slice(embedding, 4 * k + 1, 4))")).alias("k", "v"))
    at = lambda i: F.col("v")[i].cast("double")
    boxes = e.select(F.floor(F.col("vec_id") / 125).alias("image_id"), (F.col("vec_id") * 16 + F.col("k")).cast("int").alias("anchor_idx"), F.lit(1).alias("cls"), (320 + 900 * at(0)).alias("x1"), (320 + 900 * at(1)).alias("y1"), (340 + 900 * at(0) + 90 * F.abs(at(2))).alias("x2"), (340 + 900 * at(1) + 90 * F.abs(at(3))).alias("y2"))
    return D.overlaps(boxes, 0.5).withColumn("iou", F.round("iou", 6))


def q_nms(spark: SparkSession, d: str) -> DataFrame:
    return D.nms(_best(spark, d)).select("image_id", "field", "anchor_idx", F.round("score", 6).alias("score"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 600 * F.col("v").cast("double")))).cast("int")
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("r"), v.alias("g"), (255 - v).alias("b"))


def q_glare(spark: SparkSession, d: str) -> DataFrame:
    g = images.image_glare(_pixels(spark, d))
    return g.withColumns({"mean_brightness": F.round(F.col("mean_brightness") + 1e-9, 6), "hotspot_ratio": F.round(F.col("hotspot_ratio") + 1e-9, 6)})


def q_otsu(spark: SparkSession, d: str) -> DataFrame:
    gray = images.gray_pixels(_pixels(spark, d), rounded=False)
    cut = images.otsu(gray)
    return images.binarize(gray, cut).groupBy("image_id").agg(F.count_if(F.col("gray") == 0).alias("dark")).join(cut, "image_id")


def q_contrast(spark: SparkSession, d: str) -> DataFrame:
    out = images.contrast_stretch(images.gray_pixels(_pixels(spark, d)), 0.6)
    return out.groupBy("image_id").agg(F.sum("gray").alias("total"), F.min("gray").alias("lo"), F.max("gray").alias("hi"))


#: Vectors that are the lines of one image.
LINES = 64


def _scan_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Colour images of 64 vectors each, the last one lower, some of them bright or dark."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id"), F.floor(F.col("vec_id") / LINES).alias("image_id"), F.posexplode("embedding").alias("x", "v"))
    kind = F.col("image_id") % 5  # dark, two without glare, strong and mild
    base = F.get(F.array(*map(F.lit, (-20, 85, 130, 175, 122))), kind.cast("int"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(base + 500 * F.col("v").cast("double")))).cast("int")
    g, b = ((v * 3 + F.col("x") * 4) / 4).cast("int"), 255 - v
    return e.select("image_id", (F.col("vec_id") % LINES).cast("int").alias("y"), "x", v.alias("r"), F.when(kind > 2, v).otherwise(g).alias("g"), F.when(kind > 2, v).otherwise(b).alias("b"))


def _scan_images(spark: SparkSession, d: str) -> DataFrame:
    """The same as the structs that Spark's image source gives: blue, green and red bytes."""
    p = _scan_pixels(spark, d)
    every = p.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", "b", "g", "r"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda s: F.concat(*(F.lpad(F.hex(s[c]), 2, "0") for c in "bgr"))), "")
    return every.select("image_id", F.struct(F.lit("").alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(hexed).alias("data")).alias("image"))


def _checked(made: DataFrame) -> DataFrame:
    """Two sums over each image, one by place."""
    place = F.col("y").cast("long") * 1000 + F.col("x") + 1
    return images.pixels_of(made, "kernel").groupBy("image_id", "kernel").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"), F.sum(F.col("gray").cast("long")).alias("total"), F.sum(F.col("gray") * place).alias("placed"))


def q_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Every whole-image kernel over images made of the vectors."""
    gray = images.images_of(images.gray_pixels(_scan_pixels(spark, d)))
    return _checked(images.apply_kernels(gray, list(images.KERNELS)))


def q_pixel_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Blur, sharpening and ink of the same images as pixel tables."""
    gray = images.unsharp_pixels(images.gaussian_pixels(images.gray_pixels(_scan_pixels(spark, d))))
    inked = images.adaptive_threshold_pixels(images.gaussian_pixels(gray, "sharpened", "soft"), "soft", "ink")
    return inked.select("image_id", "y", "x", "blurred", "sharpened", "ink")


def q_prepared_images(spark: SparkSession, d: str) -> DataFrame:
    """From image structs to glare, feedback and the images for recognition."""
    made = images.prepare_images(_scan_images(spark, d), keep=["image_id"])
    pages = made.select("image_id", F.lit("full").alias("kernel"), "w", "h", F.col("full").alias("gray"))
    zones = made.select("image_id", F.lit("mrz").alias("kernel"), F.col("mrz_w").alias("w"), F.col("mrz_h").alias("h"), F.col("mrz").alias("gray"))
    told = made.select("image_id", F.round(F.col("hotspot_ratio") + 1e-9, 6).alias("hotspot_ratio"), F.round(F.col("mean_brightness") + 1e-9, 6).alias("mean_brightness"), "level", "feedback")
    return told.join(_checked(pages.union(zones)), "image_id")


def q_fit_max_dim(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 4000 + 10).cast("int").alias("w"), (F.col("p_size") * 97).cast("int").alias("h"))
    return D.letterbox(images.fit_max_dim(parts)).select("image_id", "w", "h", F.round("r", 9).alias("r"), "dw", "dh")


def q_char_indices(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    idx = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("long"))
    return e.select("vec_id", T.decode_char_indices(idx).alias("decoded"))


def q_roster(spark: SparkSession, d: str) -> DataFrame:
    return roster.build_roster(X.table(spark, d, "PERSONS"))


def q_roster_preview(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "PERSONS")
    arrival = p.select("id", T.format_arrival(F.col("arrival_date")).alias("a")).select("id", F.col("a.day").alias("day"), F.col("a.weekday").alias("weekday"))
    return roster.roster_preview(p).join(arrival, "id")


def q_roster_summary(spark: SparkSession, d: str) -> DataFrame:
    return roster.roster_summary(X.table(spark, d, "PERSONS"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "FRAMES").select(F.col("session_id").cast("double").alias("sid"), F.col("frame_id").alias("seq"), F.col("k").alias("phone"))


def q_staff(spark: SparkSession, d: str) -> DataFrame:
    """Hired, phones changed, some dismissed, listed."""
    p = X.table(spark, d, "PERSONS")
    staff = roster.hire(roster.hire(p.limit(0).select(F.lit(0.0).alias("sid"), "surname", "name", "patronymic", "phone", F.lit("").alias("addedDate")), p, "2024-01-01"), p.where("id % 50 = 1"), "2024-02-02")
    staff = roster.update_phone(staff, _changes(spark, d))
    return roster.staff_list(roster.dismiss(staff, staff.where("sid % 7 = 3")))


def q_staff_count(spark: SparkSession, d: str) -> DataFrame:
    return roster.staff_count(q_staff(spark, d))


def q_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """The three reports on each scan: of the reading, on the person's card, and as if its page had been read by hand."""
    names = {k: F.col(k) for k in ("surname", "name", "patronymic", "dob")}
    joined, _ = _resolved(spark, d)
    read = merge.resolve_passport(joined, keep=["fio", "mrz_text", "full_text"])
    searched = F.col("strategy") != "onnx"
    cyrillic = searched & (F.col("fio.strategy") != "latin")
    candidates = F.when(searched, F.col("fio.candidates")).otherwise(F.array().cast("array<string>"))
    report = merge.diagnostic_text(F.col("strategy"), names, F.col("fio.confidence"), F.col("mrz_found"), F.when(cyrillic, merge.anchors_json(F.col("fio.anchors"))), F.when(searched, F.col("fio.strategy")), candidates, F.col("mrz_text"), F.col("full_text"))
    card = merge.card_text(F.col("strategy"), names, F.col("mrz_found"), F.col("mrz_text"), F.col("full_text"))
    region = merge.region_text({k: F.col(f"fio.{k}") for k in ("surname", "name", "patronymic")}, F.col("fio.confidence"), F.col("full_text"))
    return read.select("scan_id", report.alias("report"), card.alias("card"), region.alias("region"))


def q_scan_frames(spark: SparkSession, d: str) -> DataFrame:
    """Feedback ticks and frames of all sessions, sampled, gated, read, merged and voted on."""
    return W.scan_frames(X.table(spark, d, "SCAN_FRAMES"), YEAR)


def q_patches(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "PERSONS")
    patches = X.table(spark, d, "FRAMES").select(F.col("session_id").alias("id"), F.col("frame_id").alias("seq"), F.when(F.col("frame_id") % 2 == 0, "surname").otherwise("specialty").alias("field"), F.col("k").alias("value"))
    return roster.apply_person_patches(p, patches, ("surname", "specialty")).select("id", "surname", "specialty")


def q_region_read(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "PERSONS")
    reads = p.where("id % 3 = 1").select("id", F.when(F.col("id") % 2 == 0, "Новый").otherwise("").alias("surname"), F.lit("Имя").alias("name"), F.lit("").alias("patronymic"))
    return merge.apply_region_read(p, reads).select("id", "surname", "name", "patronymic", "ocr_status")


def q_stability(spark: SparkSession, d: str) -> DataFrame:
    v = W.stability_vote(X.table(spark, d, "FRAMES"), "session_id", ["ts", "frame_id"], "k")
    return v.select("session_id", "frame_id", "stable", "stable_key")


def q_stable_frames(spark: SparkSession, d: str) -> DataFrame:
    return W.stable_frames(X.table(spark, d, "FRAMES"), "session_id", ["ts", "frame_id"], "frame_id", "k")


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Every third event is a feedback tick; the others are frames (q_frame_gate)."""
    f = X.table(spark, d, "FRAMES").where("frame_id % 3 = 0")
    return f.select("session_id", "ts", F.when(F.col("value") > 50, "glare_strong").otherwise("ok").alias("feedback"))


def q_frame_gate(spark: SparkSession, d: str) -> DataFrame:
    frames = X.table(spark, d, "FRAMES").where("frame_id % 3 <> 0").select("session_id", "ts", "frame_id")
    return W.frame_gate(frames, _feedback(spark, d)).select("session_id", "frame_id", "feedback")


def q_frame_samples(spark: SparkSession, d: str) -> DataFrame:
    return W.sample_frames(X.table(spark, d, "FRAMES"), "1 hour").select("session_id", "frame_id")


QUERIES = {n[2:]: f for n, f in sorted(globals().items()) if n.startswith("q_")}
