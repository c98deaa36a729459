"""Dates and fields of a passport page read line by line around label words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.mrz import is_valid_dob
from idloom.functions.text import CYR, _WIDE, cyr_words_visual, first_set, is_label_visual, once, split_lines, text, to_title, whole

_SEP = rf"[.\s{_WIDE}–\-/]"
DATE = rf"\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}\d{{4}}"


def extract_dates(c: Column) -> Column:
    """All dates of a text, dotted; the letters О, о and O are read as zeros."""
    found = F.regexp_extract_all(F.translate(text(c), "ОоO", "000"), F.lit(DATE), F.lit(0))
    return F.transform(found, lambda d: F.regexp_replace(d, _SEP, "."))


def find_valid_dob(c: Column, as_of_year: int, min_age: int = 14, max_age: int = 100) -> Column:
    return F.coalesce(F.get(F.filter(extract_dates(c), lambda d: is_valid_dob(d, as_of_year, min_age, max_age)), F.lit(0)), F.lit(""))


def extract_any_date(c: Column) -> Column:
    return F.coalesce(F.get(extract_dates(c), F.lit(0)), F.lit(""))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))


def find_best_dob(lines: Column, as_of_year: int, min_age: int = 14, max_age: int = 100) -> Column:
    return _first(F.transform(lines, lambda x: find_valid_dob(x, as_of_year, min_age, max_age)))


#: What is behind a label on its line is read for these: surname, given name, patronymic.
_BEHIND = ("ФАМИЛИ", "ИМЯ", "ОТЧЕСТВ")


def _tagged(ascii_boundaries: bool) -> Column:
    """The lines `_ls` as structs: what each is, and the words and dates on it, so that no pattern is tried twice on a line."""
    has = lambda u, part: F.contains(u, F.lit(part))

    def kind(x: Column) -> Column:
        u = F.upper(x)
        tags = {
            "surname": has(u, "ФАМИЛИ") | u.rlike("^PNRU[S<]"),
            "name": u.rlike(whole("ИМЯ", ascii_boundaries)) & ~has(u, "ФАМИЛИ"),
            "patronymic": has(u, "ОТЧЕСТВ"),
            "born": u.rlike("ДАТА.{0,6}РОЖ|РОЖ.{0,6}ДАТА|РОЖДЕН"),
            "issued": u.rlike("ДАТА.{0,6}ВЫД|ВЫДАН"),
            "number": u.rlike("СЕРИЯ|НОМЕР"),
            "sexed": u.rlike(whole("ПОЛ", ascii_boundaries)),
            "label": is_label_visual(x),
            "letters": F.when(u.rlike(rf"^[{CYR}\-]+$"), F.length(x)).otherwise(0),
        }
        return F.struct(x.alias("line"), u.alias("u"), *(v.alias(k) for k, v in tags.items()))

    def content(x: Column, i: Column) -> Column:
        two = F.concat(x["line"], F.lit(" "), F.coalesce(F.get("_ls", i + 1), F.lit("")))
        behind = [F.when(F.instr(x["u"], w) > 0, F.substr(x["line"], F.instr(x["u"], w) + len(w))).otherwise("") for w in _BEHIND]
        return F.struct(
            x.alias("is"),
            F.transform(F.array(x["line"], *behind), cyr_words_visual).alias("words"),
            F.transform(F.array(x["line"], F.when(x["born"] | x["issued"], two)), extract_dates).alias("dates"),
            F.when(x["number"], F.regexp_replace(F.regexp_extract(two, r"\d{2}\s*\d{2}\s*\d{6}", 0), r"\s", "")).otherwise("").alias("number"),
        )

    return F.transform(F.transform("_ls", kind), content)


def _at(i: Column) -> Column:
    return F.when(i >= 0, F.get("_t", i))


def _read(tag: str, read: Callable[[Column], Column]) -> Column:
    """read(i) of the first line with the tag at which it gives something."""
    at = F.filter(F.transform("_t", lambda x, i: F.when(x["is"][tag], i)), lambda i: i.isNotNull())
    return _first(F.transform(at, lambda i: F.coalesce(read(i), F.lit(""))))


def _word(words: Column) -> Column:
    return F.get(words, F.lit(0))


def _behind(x: Column, label: str) -> Column:
    return x["words"][_BEHIND.index(label) + 1]


def parse_russian_passport(df: DataFrame, text_col: str, as_of_year: int, out: str = "visual", ascii_boundaries: bool = False) -> DataFrame:
    """df with the struct `out` of fields read around labels; empty where nothing is found. No shuffle.

    One pass tags the lines; all fields are read from the tags.
    """
    names = df.columns
    df = once(df.withColumn("_ls", split_lines(F.col(text_col))), _t=_tagged(ascii_boundaries))

    def surname(i: Column) -> Column:
        above = lambda x: F.when((x["is"]["letters"] >= 4) & ~x["is"]["label"], x["is"]["u"])
        return first_set(F.array_join(_behind(_at(i), "ФАМИЛИ"), " "), above(_at(i - 1)), above(_at(i - 2)))

    def given(i: Column) -> Column:
        around = F.flatten(F.filter(F.transform(F.array(*(F.lit(d) for d in (-2, -1, 1, 2))), lambda d: F.when(i + d >= 0, F.get("_t", i + d))["words"][0]), lambda ws: ws.isNotNull()))
        inline = _behind(_at(i), "ИМЯ")
        return F.array_join(F.when(F.size(inline) > 0, inline).otherwise(around), " ")

    def patronymic(i: Column) -> Column:
        lone = lambda x: F.when(x["is"]["label"], F.lit(None).cast("string")).when(x["is"]["letters"] >= 3, x["is"]["u"]).when(F.size(x["words"][0]) == 1, _word(x["words"][0]))
        return F.coalesce(_word(_behind(_at(i), "ОТЧЕСТВ")), *(lone(_at(i + d)) for d in (-1, 1, -2, 2)))

    def valid(dates: Column) -> Column:
        return F.get(F.filter(dates, lambda d: is_valid_dob(d, as_of_year)), F.lit(0))

    sex = lambda i: F.when(F.contains(_at(i)["is"]["u"], F.lit("МУЖ")), "М").when(F.contains(_at(i)["is"]["u"], F.lit("ЖЕН")), "Ж")
    alone = F.get(F.filter("_t", lambda x: x["is"]["letters"].between(4, 25) & ~x["is"]["label"]), F.lit(0))["is"]["line"]
    df = once(df, _nw=F.split(_read("name", given), " "))
    fields = {
        "documentType": F.lit("passport_rf"),
        "surname": first_set(to_title(_read("surname", surname)), to_title(alone)),
        "name": to_title(F.get("_nw", F.lit(0))),
        "patronymic": to_title(first_set(F.get("_nw", F.lit(1)), _read("patronymic", patronymic))),
        "dateOfBirth": first_set(_read("born", lambda i: valid(_at(i)["dates"][1])), _first(F.transform("_t", lambda x: F.coalesce(valid(x["dates"][0]), F.lit(""))))),
        "gender": _read("sexed", sex), "documentNumber": _read("number", lambda i: _at(i)["number"]), "issuedDate": _read("issued", lambda i: _word(_at(i)["dates"][1])),
    }
    return df.select(*names, F.struct(*(v.alias(k) for k, v in fields.items())).alias(out))
