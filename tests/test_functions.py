"""Goldens of scalar functions."""

import pytest
from pyspark.sql import functions as F

from idloom.functions import mrz as M
from idloom.functions import text as T
from idloom.functions import visual as V

ZONE = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (T.clean_ocr_text, "Иван0в  3ахар", "ИВАНОВ ЗАХАР"),
        (T.clean_ocr_text, None, ""),
        (T.clean_ocr_text, "a b*c\n   d", "A B C\nD"),
        (T.to_title, "ИВАНОВ ПЕТР", "Иванов петр"),
        (T.to_title, "", ""),
        (T.is_patronymic, "КЫЗЫ", True),
        (T.is_patronymic, "СЕРГЕЕВИЧ", True),
        (T.is_patronymic, "ИВАН", False),
        (T.is_label, "ПОЛ МУЖ", True),
        (T.is_label, "ПОЛИНА", False),
        (T.is_latin_patronymic, "BAHODIROVICH", True),
        (T.detect_lang, "SMITH JOHN PETER", "latin"),
        (T.detect_lang, None, "cyrillic"),
        (T.format_date_iso, "2024-03-05", "05.03.2024"),
        (T.format_date_iso, "05.03.2024", "05.03.2024"),
        (T.format_date_iso, None, ""),
        (M.normalize_mrz_line, " p<ru s*", "<P<RU<S<"),
        (M.mrz_check_digit, "L898902C3", 6),
        (M.mrz_check_digit, "740812", 2),
        (M.mrz_check_digit, "<<<<<<", 0),
        (M.mrz_to_cyrillic, "MARIA", "МАРЯ"),
        (M.mrz_to_cyrillic, "SHCHQZHEV", "ЩЖЕВ"),
        (V.extract_dates, "Дата рождения О1-О2-198О", ["01.02.1980"]),
        (V.extract_any_date, "", ""),
    ],
)
def test_goldens(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_scores(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 99)], "d int").select(T.dist_to_score(F.col("d")).alias("s"), T.anchor_score(F.col("d")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 1.0), (0.75, 0.95), (0.5, 0.7), (0.25, 0.45), (0.25, 0.55)]


def test_specimen(spark):
    df = spark.createDataFrame([(1, ZONE), (2, ZONE.split("\n")[0]), (3, None)], "scan_id bigint, t string")
    got = {r["scan_id"]: r["mrz"] for r in M.parse_mrz(df, "t", 2026).collect()}
    m = got[1]
    assert (m.surname, m.name, m.patronymic, m.gender, m.citizenship) == ("Ерикссон", "Анна", "Маря", "F", "UTO")
    assert (m.dateOfBirth, m.expiryDate, m.documentNumber, m.confidence, m.mrzValid) == ("12.08.1974", "15.04.2012", "L898902C3", 99, True)
    assert got[2].mrzLine1 is None and got[3].surname is None
    app = {r["scan_id"]: r["mrz"] for r in M.parse_mrz_app(df, "t", 2026).collect()}
    assert app[1].valid and app[1].dob == "12.08.1974" and not app[2].valid and app[3].surname == ""


def test_decoding_and_arrival(spark):
    assert one(spark, T.decode_char_indices, [33, 0, 1], "v array<bigint>") == "АБ"
    r = one(spark, T.format_arrival, "2024-05-09")
    assert (r.day, r.weekday) == ("9 мая 2024", "четверг")
    r = one(spark, T.format_arrival, "")
    assert (r.day, r.weekday) == ("—", "")


def test_passport_page(spark):
    page = "ФАМИЛИЯ ИВАНОВ\nИМЯ ПЕТР\nОТЧЕСТВО СИДОРОВИЧ\nПОЛ ЖЕН\nДАТА РОЖДЕНИЯ\n01.02.1980\nСЕРИЯ НОМЕР 12 34 567890\nВЫДАН 03.04.2005"
    r = V.parse_russian_passport(spark.createDataFrame([(page,), ("",)], "t string"), "t", 2026).select("visual.*").collect()
    assert tuple(r[0])[1:] == ("Иванов", "Петр", "Сидорович", "01.02.1980", "Ж", "1234567890", "03.04.2005")
    assert r[1].surname == "" and r[1].dateOfBirth == ""
