"""Machine-readable zones (ICAO 9303, two lines of 44): finding, checking, reading, transliterating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import WS, once, text, to_title

# Latin letter groups and the Cyrillic letter each stands for, the first that fits counts.
PAIRS = """
SHCH Щ, ZHH Ж, KHH Х, ZH Ж, KH Х, TS Ц, TC Ц, CH Ч, SH Ш, IE Ъ, IU Ю, IA Я, JO Ё, YO Ё, YU Ю, YA Я,
A А, B Б, V В, G Г, D Д, E Е, Z З, I И, J Й, K К, L Л, M М, N Н, O О, P П, R Р, S С, T Т, U У, F Ф, H Х, C Ц, Y Ы
"""
LATIN, CYRILLIC = zip(*(p.split() for p in PAIRS.split(",")), strict=True)

LINE1, LINE2 = "^P[A-Z<][A-Z]{3}", "^[A-Z0-9]{9}[0-9][A-Z]{3}[0-9]{6}"


def normalize_mrz_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), f"{WS}+", "<"), "[^A-Z0-9<]", "<")


def find_mrz_lines(c: Column | str) -> Column:
    """struct(line1, line2), each 44 long; both null unless both are found."""
    lines = F.filter(F.transform(F.split(text(c), "\n", -1), normalize_mrz_line), lambda x: F.length(x) >= 40)
    one, two = (F.rpad(F.get(F.filter(lines, _fits(r)), F.lit(0)), 44, "<") for r in (LINE1, LINE2))
    both = one.isNotNull() & two.isNotNull()
    return F.struct(F.when(both, one).alias("line1"), F.when(both, two).alias("line2"))


def _fits(pattern: str):
    return lambda x: x.rlike(pattern)


def mrz_check_digit(c: Column) -> Column:
    """Weights 7, 3, 1; `<` is 0, digits themselves, letters from 10."""
    code = F.transform(F.split(c, ""), lambda ch, i: F.when(ch == "<", 0).when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.aggregate(code, F.lit(0), lambda a, b: a + b) % 10


def check_digit_ok(c: Column, expected: Column) -> Column:
    return F.coalesce(mrz_check_digit(c) == expected.try_cast("int"), F.lit(False))


_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field_ok(line: Column, start: int, n: int) -> Column:
    """check_digit_ok of n characters of a line from `start` and the one behind them, without a loop over characters."""
    value = lambda i: F.greatest(F.position(F.substring(line, start + i, 1), F.lit(_VALUES)) - 1, F.lit(0))
    total = sum((value(i) * (7, 3, 1)[i % 3] for i in range(1, n)), value(0) * 7)
    return F.coalesce(total % 10 == F.substring(line, start + n, 1).try_cast("int"), F.lit(False))


def mrz_to_cyrillic(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in zip(LATIN, CYRILLIC, strict=True) for x in pair))
    letters = F.regexp_replace(F.upper(c), "[<0-9]", "")
    return F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("|".join(LATIN)), F.lit(0)), lambda x: table[x]), "")


def mrz_names(line1: Column) -> Column:
    """struct(surname, name, patronymic), null without a double filler."""
    field = F.substring(line1, 6, 39)
    at = F.instr(field, "<<")
    given = F.filter(F.split(F.substr(field, at + 2), "<", -1), lambda x: x != "")
    title = lambda x: to_title(mrz_to_cyrillic(x))
    surname = title(F.replace(F.substring(field, F.lit(1), at - 1), F.lit("<")))
    found = [surname, F.coalesce(title(F.get(given, F.lit(0))), F.lit("")), F.coalesce(title(F.get(given, F.lit(1))), F.lit(""))]
    return F.struct(*(F.when(at > 0, v).alias(n) for v, n in zip(found, ("surname", "name", "patronymic"), strict=True)))


def mrz_date(c: Column, kind: str, as_of_year: int, variant: str = "scanner") -> Column:
    """DD.MM.YYYY of YYMMDD. kind: dob or expiry (always 20YY); the variants differ in a birth's century."""
    yy = F.substring(c, 1, 2).try_cast("int")
    past = yy + 2000 > as_of_year + 1 if variant == "scanner" else yy > as_of_year % 100 + 10
    year = F.when(past, yy + 1900).otherwise(yy + 2000) if kind == "dob" else yy + 2000
    return F.when(c.rlike("^[0-9]{6}$"), F.concat_ws(".", F.substring(c, 5, 2), F.substring(c, 3, 2), year.cast("string"))).otherwise("")


def mrz_gender(line2: Column) -> Column:
    g = F.substring(line2, 21, 1)
    return F.when(g.isin("M", "F"), g).otherwise("")


def mrz_citizenship(line2: Column) -> Column:
    return F.replace(F.substring(line2, 11, 3), F.lit("<"))


def mrz_document_number(line2: Column, ok: Column) -> Column:
    return F.when(ok, F.replace(F.substring(line2, 1, 9), F.lit("<")))


def mrz_confidence(*checks: Column) -> Column:
    return 33 * sum((c.cast("int") for c in checks), F.lit(0))


def is_valid_dob(d: Column, as_of_year: int, min_age: int = 14, max_age: int = 100) -> Column:
    parts = F.split(d, r"\.", -1)
    return F.coalesce((F.size(parts) == 3) & (F.lit(as_of_year) - F.get(parts, F.lit(2)).try_cast("int")).between(min_age, max_age), F.lit(False))


def _zone(df: DataFrame, text_col: str) -> DataFrame:
    """df with the lines _1 and _2 of its zone (null without both) and the names _s, _g, _p (null without a double filler)."""
    lines = F.filter(F.transform(F.split(text(text_col), "\n", -1), normalize_mrz_line), lambda x: F.length(x) >= 40)
    df = once(df, _z=lines)
    one, two = (F.rpad(F.get(F.filter("_z", _fits(r)), F.lit(0)), 44, "<") for r in (LINE1, LINE2))
    df = once(df, _a=one, _b=two).drop("_z")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    df = df.select("*", F.when(both, F.col("_a")).alias("_1"), F.when(both, F.col("_b")).alias("_2")).drop("_a", "_b")
    field = F.substring("_1", 6, 39)
    at = F.instr(field, "<<")
    given = F.filter(F.split(F.substr(field, at + 2), "<", -1), lambda x: x != "")
    parts = F.concat(F.array(F.replace(F.substring(field, F.lit(1), at - 1), F.lit("<"))), F.slice(given, 1, 2))
    titles = F.transform(parts, lambda x: to_title(mrz_to_cyrillic(x)))
    df = once(df, _t=F.when(at > 0, titles))
    return df.select("*", *(F.when(F.col("_t").isNotNull(), F.coalesce(F.get("_t", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("_s", "_g", "_p")))).drop("_t")


_WORK = ("_1", "_2", "_s", "_g", "_p")


def parse_mrz(df: DataFrame, text_col: str, as_of_year: int, out: str = "mrz") -> DataFrame:
    """df with the struct `out` of the scanner's reading; null fields where the lines are missing."""
    l1, l2 = F.col("_1"), F.col("_2")
    checks = {k: _field_ok(l2, a, n) for k, a, n in (("_doc", 1, 9), ("_dob", 14, 6), ("_exp", 22, 6))}
    df = once(_zone(df, text_col), **checks, _d=mrz_date(F.substring(l2, 14, 6), "dob", as_of_year))
    there = l2.isNotNull()
    fields = {
        "documentType": F.lit("international_passport"),
        "surname": F.col("_s"), "name": F.col("_g"), "patronymic": F.col("_p"),
        "dateOfBirth": F.when(F.col("_dob") & is_valid_dob(F.col("_d"), as_of_year), F.col("_d")),
        "gender": mrz_gender(l2), "documentNumber": mrz_document_number(l2, F.col("_doc")),
        "expiryDate": F.when(F.col("_exp"), mrz_date(F.substring(l2, 22, 6), "expiry", as_of_year)),
        "citizenship": mrz_citizenship(l2), "mrzValid": F.col("_dob"), "mrzLine1": l1, "mrzLine2": l2,
        "confidence": mrz_confidence(F.col("_doc"), F.col("_dob"), F.col("_exp")),
    }
    return once(df, **{out: F.struct(*(F.when(there, v).alias(k) for k, v in fields.items()))}).drop(*_WORK, *checks, "_d")


def parse_mrz_app(df: DataFrame, text_col: str, as_of_year: int, out: str = "mrz") -> DataFrame:
    """df with the struct `out` of the app's reading: valid, lines, names and date of birth ('' unless valid)."""
    l1, l2 = F.col("_1"), F.col("_2")
    df = once(_zone(df, text_col), _v=l2.isNotNull() & _field_ok(l2, 14, 6))
    names = {k: F.coalesce(F.col(c), F.lit("")) for k, c in (("surname", "_s"), ("name", "_g"), ("patronymic", "_p"))}
    fields = {**names, "dob": mrz_date(F.substring(l2, 14, 6), "dob", as_of_year, "app")}
    return once(df, **{out: F.struct(F.col("_v").alias("valid"), l1.alias("line1"), l2.alias("line2"), *(F.when(F.col("_v"), v).otherwise("").alias(k) for k, v in fields.items()))}).drop(*_WORK, "_v")
