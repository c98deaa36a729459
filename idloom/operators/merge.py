"""Joining what was read from different zones of a document, with explicit precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import NOT_IN_DICTIONARY, first_set, text, trimmed

_BOTH = ("surname", "name", "dateOfBirth", "gender", "documentNumber")


def merged(mrz: Column, visual: Column | None, raw: Column | None = None) -> Column:
    """One struct of a machine-readable and a visual reading: the first rules, but for the patronymic."""
    seen = lambda k: visual[k] if visual is not None else F.lit(None).cast("string")
    both = {k: first_set(mrz[k], seen(k)) for k in _BOTH}
    fields = {
        "documentType": F.coalesce(F.nullif(first_set(mrz["documentType"], seen("documentType")), F.lit("")), F.lit("unknown")),
        **both,
        "patronymic": first_set(seen("patronymic"), mrz["patronymic"]),
        "issuedDate": first_set(seen("issuedDate")),
        "expiryDate": first_set(mrz["expiryDate"]),
        "citizenship": first_set(mrz["citizenship"]),
        "placeOfBirth": F.lit(""),
        "mrzValid": F.coalesce(mrz["mrzValid"], F.lit(False)),
        "mrzLine1": mrz["mrzLine1"], "mrzLine2": mrz["mrzLine2"],
        "confidence": F.greatest(F.coalesce(mrz["confidence"], F.lit(0)), F.lit(0)),
        "rawOcr": F.lit(None).cast("string") if raw is None else raw,
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def merge_results(mrz: DataFrame, visual: DataFrame) -> DataFrame:
    """scan_id and doc from tables (scan_id, mrz) and (scan_id, visual); either side may be missing."""
    return mrz.join(visual, "scan_id", "full").select("scan_id", merged(F.col("mrz"), F.col("visual")).alias("doc"))


def resolve_passport(fio: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Final names, date and strategy of scans, beside the columns `keep`.

    fio(scan_id, model struct<surname, name, patronymic>, fio struct<surname, name, patronymic, confidence>,
    mrz struct<valid, surname, name, patronymic, dob>, visual_dob). What a model read wins if any part is set.
    Else names found in the text; if they are weak (confidence under 40) and the zone is valid, it fills gaps.
    """
    parts = ("surname", "name", "patronymic")
    model, found, mrz = F.col("model"), F.col("fio"), F.col("mrz")
    by_model = first_set(*(model[p] for p in parts)) != ""
    fill = F.coalesce(mrz["valid"], F.lit(False)) & (F.coalesce(found["confidence"], F.lit(0)) < 40)
    gap = lambda p: fill & (first_set(found[p]) == "") & (first_set(mrz[p]) != "")
    value = lambda p: F.when(by_model, first_set(model[p])).when(gap(p), mrz[p]).otherwise(first_set(found[p]))
    valid = F.coalesce(mrz["valid"], F.lit(False))
    dob = F.when(by_model, F.when(valid & (first_set(mrz["dob"]) != ""), mrz["dob"]).otherwise(first_set(F.col("visual_dob")))).when(valid, first_set(mrz["dob"])).otherwise(first_set(F.col("visual_dob")))
    strategy = F.when(by_model, "onnx").when(gap("surname") | gap("name") | gap("patronymic"), "mrz").otherwise("fio-dict")
    return fio.select("scan_id", *(value(p).alias(p) for p in parts), dob.alias("dob"), strategy.alias("strategy"), valid.alias("mrz_found"), *(keep or []))


def ocr_status(surname: Column, name: Column, mrz_found: Column, failed: Column | None = None) -> Column:
    """done: a name and a valid zone; warn: the rest; error: reading failed."""
    found = first_set(surname, name) != ""
    status = F.when(found & mrz_found, "done").otherwise("warn")
    return status if failed is None else F.when(failed, "error").otherwise(status)


def _dash(c: Column) -> Column:
    return first_set(c, F.lit("—"))


def _said(c: Column, most: int | None = None, empty: str = "(пусто)") -> Column:
    c = trimmed(text(c))
    return first_set(c if most is None else F.substring(c, 1, most), F.lit(empty))


def _names(names: dict[str, Column], wide: int) -> list[Column]:
    labels = {"surname": "Фамилия:", "name": "Имя:", "patronymic": "Отчество:"}
    return [F.concat(F.lit(f"{label:<{wide}}"), _dash(names[k])) for k, label in labels.items()]


def _zone_found(found: Column) -> Column:
    return F.when(found, "MRZ: ✓ найдена").otherwise("MRZ: ✗ не найдена")


def _of(title: str, n: Column, unit: str) -> Column:
    return F.concat(F.lit(f"── {title} ("), n.cast("string"), F.lit(f" {unit}) ──"))


def anchors_json(anchors: Column) -> Column:
    """The words found at labels as JSON, by part: of names the word, its distance and what stood there; of the patronymic what stood there and its entry."""
    of = lambda part: F.get(F.filter(anchors, lambda a: a["part"] == part), F.lit(0))
    name = lambda a: F.when(a.isNotNull(), F.struct(a["word"].alias("word"), a["dist"].alias("dist"), a["raw_word"].alias("rawWord")))
    last = of("patronymic")
    patronymic = F.when(last.isNotNull(), F.struct(last["raw_word"].alias("word"), F.when(last["dist"] < NOT_IN_DICTIONARY, last["word"]).alias("dict")))
    return F.to_json(F.struct(name(of("surname")).alias("surname"), name(of("name")).alias("name"), patronymic.alias("patronymic")))


def diagnostic_text(strategy: Column, names: dict[str, Column], confidence: Column, mrz_found: Column, anchors: Column, fio_strategy: Column, candidates: Column, mrz_text: Column, full_text: Column, most: int = 1000) -> Column:
    """The report on a scan: names holds surname, name, patronymic and dob; anchors (JSON) and fio_strategy are null where names were not searched for."""
    zone, page, blank = text(mrz_text), text(full_text), F.lit("")
    return F.concat_ws(
        "\n", F.concat(F.lit("═══ Стратегия: "), strategy, F.lit(" ═══")), *_names(names, 10), F.concat(F.lit("Дата рожд.: "), _dash(names["dob"])), F.concat(F.lit("Confidence FIO: "), confidence.cast("string"), F.lit("%")), blank,
        _zone_found(mrz_found), F.coalesce(F.concat(F.lit("Метки найдены: "), anchors), blank), F.coalesce(F.concat(F.lit("Стратегия FIO: "), fio_strategy), blank), blank,
        _of("Кандидаты OCR", F.size(candidates), "слов"), first_set(F.array_join(candidates, ", "), F.lit("(нет)")), blank,
        _of("MRZ OCR", F.length(zone), "симв."), _said(zone), blank, _of("Full OCR", F.length(page), "симв."), _said(page, most),
    )


def card_text(strategy: Column, names: dict[str, Column], mrz_found: Column, mrz_text: Column, full_text: Column) -> Column:
    """The report on a person's card, with the whole text."""
    zone, page, blank = text(mrz_text), text(full_text), F.lit("")
    head = F.concat(_zone_found(mrz_found), F.lit(" (стратегия: "), _dash(strategy), F.lit(")"))
    return F.concat_ws("\n", head, *_names(names, 12), blank, _of("MRZ OCR", F.length(zone), "симв."), _said(zone), blank, _of("Полный OCR", F.length(page), "симв."), _said(page))


def region_text(names: dict[str, Column], confidence: Column, read: Column, most: int = 500) -> Column:
    """The report on a region that was read by hand."""
    page = text(read)
    head = F.concat(F.lit("Кроп вручную · FIO confidence: "), confidence.cast("string"), F.lit("%"))
    return F.concat_ws("\n", head, *_names(names, 10), F.lit(""), _of("OCR текст", F.length(page), "симв."), _said(page, most))


def apply_region_read(persons: DataFrame, reads: DataFrame) -> DataFrame:
    """persons with the non-empty fields of reads(id, surname, name, patronymic) put over theirs; status warn."""
    parts = ("surname", "name", "patronymic")
    right = reads.select(F.col("id").alias("_id"), *(F.col(p).alias(f"_{p}") for p in parts))
    new = {p: first_set(F.col(f"_{p}"), F.col(p)) for p in parts}
    new["ocr_status"] = F.when(F.col("_id").isNotNull(), "warn").otherwise(F.col("ocr_status"))
    return persons.join(right, F.col("id") == F.col("_id"), "left").withColumns(new).select(persons.columns)
