"""Scalar functions over OCR text. An empty string means "missing"; nulls are taken as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as browsers see it: also no-break and other wide blanks.
_WIDE = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = rf"[\s{_WIDE}]"
CYR, CYR_ANY = "А-ЯЁ", "А-ЯЁа-яё"

# Words and patterns of labels, patronymic endings, month and weekday names, recognition alphabet.
LABELS = ["ДАТА", "ПОЛ", "МЕСТО", "ГРАЖД", "ОРГАН", "ВЫДАН", "СЕРИЯ", "НОМЕР", "ПОДПИС", "РОССИЙСК", "ФЕДЕРАЦ", "ПАСПОРТ", "МВД", "ФМС", "МИГРАЦ", "РЕСПУБЛ", "ОБЛАСТН", "РАЙОНН", "КОММУН", "МОСКВ", "КАЗАХСТАН", "КЫРГЫЗСТАН", "ТАДЖИКИСТАН", "БЕЛАРУС", "УЗБЕКИСТ", "РОЖДЕНИ", "ЗАРЕГИС", "ПРОПИС", "ПРОЖИВ", "СНИЛС", "ИНН"]
WHOLE_LABELS = {"ПОЛ", "ИНН"}
VISUAL_LABELS = ["ДАТА", "ПОЛ", "МЕСТО", "ГРАЖД", "ОРГАН", "ВЫДАН", "СЕРИЯ", "НОМЕР", "ПОДПИС", "РОССИЙСК", "ФЕДЕРАЦ", "ПАСПОРТ", "МВД", "ФМС", "МИГРАЦ"]
PLACES = ["РАЙОНА", "ГОРОДА", "УЛИЦА", "ОБЛАСТЬ", "ДЕРЕВНЯ", "ПОСЕЛО", "АУЛА", "КИШЛАК"]
LATIN_LABELS = ["FAMILIY", "SURNAME", r"GIVEN\s*NAME", "PATRONY", "FATHER", "ISMI", "OTASIN", "BIRTH", "DATE", "PLACE", "GENDER", r"SEX\b", "NATIONALITY", "DOCUMENT", "PASSPORT", "REPUBLIC", "MINISTRY", "ISSUED", "VALID"]
PATRONYMIC_WORDS = ["КЫЗЫ", "УУЛУ", "ОГЛЫ", "УГЛИ", "УЛЛИ", "ЗОДА", "ЗАДА", "ЗАДЕ"]
PATRONYMIC_ENDS = ["ОВИЧ", "ЕВИЧ", "ОВНА", "ЕВНА", "ЬИЧ", "ИЧНА", "ИЕВИЧ", "ИЕВНА", "ЬЕВИЧ", "ЬЕВНА", *PATRONYMIC_WORDS]
LATIN_PATRONYMIC_WORDS = ["OGLI", "QIZI", "OGLU", "KIZI", "UULU", "KYZY", "ULI"]
LATIN_PATRONYMIC_ENDS = [*LATIN_PATRONYMIC_WORDS, "OVICH", "EVICH", "OVNA", "EVNA"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
WEEKDAYS = ["воскресенье", "понедельник", "вторник", "среда", "четверг", "пятница", "суббота"]
ALPHABET = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ.-"
CUSTOM = "__custom__"
# Scores of a match by distance, beyond those, at a label, and beside a label without a match.
DIST_SCORES, FAR_SCORE, ANCHOR_BONUS, UNKNOWN_SCORE, NOT_IN_DICTIONARY = (1.0, 0.75, 0.5), 0.25, 0.2, 0.55, 99


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: as rows of a one-element array they are copied into no later expression."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_set(*cols: Column) -> Column:
    """The first value that is not missing, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clean_ocr_text(c: Column) -> Column:
    """Upper case; 0 and 3 next to Cyrillic become О and З; other signs and runs of blanks become one blank."""
    c = F.upper(text(c))
    for digit, letter in (("0", "О"), ("3", "З")):
        c = F.regexp_replace(F.regexp_replace(c, f"([{CYR}]){digit}", f"$1{letter}"), f"{digit}([{CYR}])", f"{letter}$1")
    c = F.regexp_replace(c, rf"[^{CYR}A-Z0-9\-.\s{_WIDE}]", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n[ \t]+", "\n"))


def split_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), "\n", -1), trimmed), lambda x: x != "")


def to_title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def cyr_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(rf"[{CYR}\-]{{3,}}"), F.lit(0)), lambda w: F.length(w) <= 30)


def cyr_words_visual(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"[{CYR_ANY}\-]{{2,}}"), F.lit(0)), F.upper)


def latin_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(r"[A-Z\-]{3,}"), F.lit(0)), lambda w: (F.length(w) <= 30) & ~w.rlike("|".join(LATIN_LABELS)))  # capitals: no need to fold them


def whole(word: str, ascii_boundaries: bool = False) -> str:
    """word between characters that are no capital Cyrillic letters; or touched by ASCII word characters."""
    return rf"(?<=[A-Za-z0-9_]){word}(?=[A-Za-z0-9_])" if ascii_boundaries else f"(?<![{CYR}]){word}(?![{CYR}])"


def is_label(c: Column) -> Column:
    return F.upper(c).rlike("|".join([whole(w) if w in WHOLE_LABELS else w for w in LABELS] + PLACES))


def is_label_visual(c: Column, ascii_boundaries: bool = False) -> Column:
    pol = "ПОЛ(?=[A-Za-z0-9_])" if ascii_boundaries else f"ПОЛ(?![{CYR}])"
    return F.upper(c).rlike("|".join(pol if w == "ПОЛ" else w for w in VISUAL_LABELS))


def is_latin_label(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(LATIN_LABELS))


def _ends(c: Column, words: list[str], ends: list[str]) -> Column:
    u = F.upper(c)
    return u.isin(words) | ((F.length(u) >= 5) & u.rlike(f"({'|'.join(ends)})$"))


def is_patronymic(c: Column) -> Column:
    return _ends(c, PATRONYMIC_WORDS, PATRONYMIC_ENDS)


def is_latin_patronymic(c: Column) -> Column:
    return _ends(c, LATIN_PATRONYMIC_WORDS, LATIN_PATRONYMIC_ENDS)


def detect_lang(c: Column) -> Column:
    lat, cyr = (F.length(F.regexp_replace(text(c), f"[^{k}]", "")) for k in ("A-Za-z", CYR_ANY))
    return F.when((lat > cyr + 5) & (lat > 8), "latin").otherwise("cyrillic")


def dist_to_score(d: Column) -> Column:
    score = F.lit(FAR_SCORE)
    for dist, value in enumerate(DIST_SCORES):
        score = F.when(d == dist, value).otherwise(score)
    return score


def anchor_score(d: Column) -> Column:
    return F.when(d == NOT_IN_DICTIONARY, UNKNOWN_SCORE).otherwise(F.least(F.lit(1.0), dist_to_score(d) + ANCHOR_BONUS))


def full_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def text_after_label(line: Column, label: str) -> Column:
    at = F.instr(F.upper(line), label)
    return F.when(at > 0, F.array_join(cyr_words_visual(F.substr(line, at + len(label))), " ")).otherwise("")


def format_date_iso(c: Column) -> Column:
    c = text(c)
    return F.when(F.contains(c, F.lit("-")), F.concat_ws(".", F.split_part(c, F.lit("-"), F.lit(3)), F.split_part(c, F.lit("-"), F.lit(2)), F.split_part(c, F.lit("-"), F.lit(1)))).otherwise(c)


def format_arrival(c: Column) -> Column:
    """struct(day: "d month yyyy", weekday) of an ISO date; a dash and nothing if it is missing."""
    d = F.try_to_timestamp(F.nullif(text(c), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    months, days = F.array(*map(F.lit, MONTHS)), F.array(*map(F.lit, WEEKDAYS))
    day = F.concat_ws(" ", F.day(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"))
    return F.struct(F.when(d.isNull(), "—").otherwise(day).alias("day"), F.when(d.isNull(), "").otherwise(F.element_at(days, F.dayofweek(d))).alias("weekday"))


def decode_char_indices(idx: Column) -> Column:
    letters = F.array(*map(F.lit, ALPHABET))
    kept = F.filter(idx, lambda i: (i >= 0) & (i < len(ALPHABET)))
    return trimmed(F.regexp_replace(F.array_join(F.transform(kept, lambda i: F.element_at(letters, (i + 1).cast("int"))), ""), r"^\.+", ""))
