"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idloom.session import dealt

#: Years are counted from here, so that results do not change with the calendar.
AS_OF_YEAR = 2026


def digit(expr: str, n: int) -> str:
    """The check digit of n decimal digits, as SQL."""
    return "((" + " + ".join(f"cast(substr({expr}, {i + 1}, 1) as int) * {(7, 3, 1)[i % 3]}" for i in range(n)) + ") % 10)"


_DAYS = "lpad(cast(40 + c_custkey * 7 % 60 as varchar(9)), 2, '0') || lpad(cast(1 + c_custkey % 12 as varchar(9)), 2, '0') || lpad(cast(1 + c_custkey % 28 as varchar(9)), 2, '0')"
_ENDS = "lpad(cast(20 + c_custkey % 15 as varchar(9)), 2, '0') || lpad(cast(1 + c_custkey % 11 as varchar(9)), 2, '0') || '15'"
_SYLLABLES = "translate(cast(c_custkey as varchar(20)), '0123456789', 'AIOUERNSTL')"

MRZ = f"""
WITH base AS (
  SELECT c_custkey, c_mktsegment, {_SYLLABLES} AS stem, lpad(cast(c_custkey as varchar(20)), 9, '0') AS num,
         substr({_DAYS}, 1, 6) AS dob, substr({_ENDS}, 1, 6) AS expiry
  FROM customer),
lines AS (
  SELECT c_custkey,
         rpad('P<RUS' || 'SHCH' || stem || 'ZHEV<<' || c_mktsegment || '<' || stem || 'OVICH', 44, '<') AS l1,
         rpad(num || cast(CASE WHEN c_custkey % 7 = 1 THEN ({digit("num", 9)} + 1) % 10 ELSE {digit("num", 9)} END as varchar(2)) || 'RUS' || dob
           || cast(CASE WHEN c_custkey % 11 = 2 THEN ({digit("dob", 6)} + 3) % 10 ELSE {digit("dob", 6)} END as varchar(2))
           || CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END || expiry || cast({digit("expiry", 6)} as varchar(2)), 44, '<') AS l2
  FROM base)
SELECT c_custkey AS scan_id,
       CASE c_custkey % 13
         WHEN 3 THEN lower(l1) || chr(10) || lower(l2)
         WHEN 4 THEN l1
         WHEN 5 THEN substr(l1, 1, 38) || chr(10) || l2
         WHEN 6 THEN 'noise' || chr(10) || replace(l1, '<', ' ') || chr(10) || l2
         ELSE l1 || chr(10) || l2 END AS mrz_text
FROM lines
"""

_CYRILLIC = "translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'АБЦДЕФГХИЙКЛМНОПЯРСТУВШЧЫЗ ')"

#: Pages of Cyrillic text with labels and recognition noise. t is a syllable that tells the names of many pages apart.
_STEMS = f"SELECT p_partkey, split_part({_CYRILLIC}, ' ', 1) AS a, split_part({_CYRILLIC}, ' ', 2) AS b, translate(cast(p_partkey % 89 as varchar(9)), '0123456789', 'АИОУЕРНСТЛ') AS t FROM part"
_BORN = "cast(10 + p_partkey % 19 as varchar(9)) || '.1О.' || cast(1900 + p_partkey % 130 as varchar(9))"
SCANS = f"""
WITH w AS ({_STEMS})
SELECT p_partkey AS scan_id,
       CASE p_partkey % 15
         WHEN 0 THEN 'ФАМИЛИЯ' || chr(10) || a || 'ОВ' || chr(10) || 'ИМЯ ' || b || chr(10) || 'ОТЧЕСТВО' || chr(10) || a || 'ОВИЧ'
         WHEN 1 THEN replace(a, 'О', '0') || 'ОВ' || chr(10) || b || chr(10) || a || 'ЕВИЧ'
         WHEN 2 THEN 'Паспорт  ' || a || chr(9) || '3' || b || ' ' || cast(10 + p_partkey % 19 as varchar(9)) || '.О' || cast(1 + p_partkey % 9 as varchar(9)) || '.' || cast(1900 + p_partkey % 130 as varchar(9))
         WHEN 3 THEN 'ДАТА РОЖДЕНИЯ ' || cast(10 + p_partkey % 19 as varchar(9)) || '-1О-' || cast(1900 + p_partkey % 130 as varchar(9)) || chr(10) || 'ПОЛ МУЖ.' || chr(10) || a || chr(10) || 'ВЫДАН 01/02/' || cast(1980 + p_partkey % 40 as varchar(9))
         WHEN 4 THEN upper(p_type) || 'OV' || chr(10) || 'BAHODIR OGLI' || chr(10) || upper(replace(p_name, ' ', chr(10)))
         WHEN 5 THEN ''
         WHEN 6 THEN 'ФАМИЛИЯ ' || a || t || 'ОВ ГОРОД' || chr(10) || 'ИМЯ' || chr(10) || b || t || chr(10) || 'ОТЧЕСТВО ' || a || t || 'ОВИЧ'
         WHEN 7 THEN 'ФАМИЛИЯ' || chr(10) || a || t || 'ОВ' || chr(10) || 'ИМЯ' || chr(10) || 'ОТЧЕСТВО' || chr(10) || a || t || 'ОВ ' || b || t || 'ДДДД'
         WHEN 8 THEN b || ' ДАЛЬНЕЕСЛОВО ЖЖЖЖЖЖЖЖЖ' || chr(10) || 'ПЕРВОЕСЛОВО ВТОРОЕСЛОВО ТРЕТЬЕСЛОВО' || chr(10) || 'ИМЯ ЧЧЧЧЧЧЧЧЧ' || chr(10) || 'ЩЩЩЩЩЩЩЩ ЭЭЭЭЭЭЭЭЭ ' || CASE WHEN p_partkey % 2 = 0 THEN b || t ELSE 'ЫЫЫЫ' END || chr(10) || 'ЯЯЯЯЯЯЯЯ ' || b || t || chr(10) || 'МЕСТО ЖИТЕЛЬСТВА'
         WHEN 9 THEN 'ГОРОДА МОСКВЫ ' || a || t || 'ОВ' || chr(10) || 'ПЕРВОЕ ВТОРОЕ ТРЕТЬЕ ЧЕТВЕРТОЕ' || chr(10) || b || t || 'ЪЪ ' || a || t || 'ОВЪ ' || b || t || chr(10) || 'ПЯТОЕ ШЕСТОЕ ' || a || t || 'ОВИЧ ' || a || t || 'ОВ'
         WHEN 10 THEN 'ЪЪЪЪЪЪ' || t || ' ЭЭЭЭЭЭ' || chr(10) || a || 'ЫЫЫЫОВНА' || chr(10) || 'ЮЮЮЮЮЮЮ' || t
         WHEN 11 THEN a || 'ОВ' || chr(10) || b || chr(10) || 'PNRUS<<' || chr(10) || 'СЕРИЯ И НОМЕР ' || CASE WHEN p_partkey % 2 = 0 THEN '45 1' || cast(p_partkey % 10 as varchar(1)) ELSE '' END || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '4510 ' END || lpad(cast(p_partkey as varchar(9)), 6, '0') || chr(10) || 'ПОЛ' || CASE WHEN p_partkey % 4 < 2 THEN ' ЖЕН' ELSE '' END || chr(10) || 'РОЖДЕНИЕ: ДАТА' || chr(10) || {_BORN}
         WHEN 12 THEN 'ФАМИЛИЯМИ' || chr(10) || 'НОМЕР' || chr(10) || b || t || ' ' || b || t || 'А' || chr(10) || 'ФАМИЛИЯ' || chr(10) || a || t || 'ОВСКАЯ'
         WHEN 13 THEN a || t || 'ОВНА' || chr(10) || 'УУЛУ ' || b || chr(10) || 'ОТЧЕСТВО' || chr(10) || 'ИНН ' || a || t || 'ОВИЧ'
         ELSE b || t || chr(10) || a || t || 'ОВН' || chr(10) || 'ИМЯ ОТЧЕСТВО' || chr(10) || a || t || 'ОВИ' END AS full_text
FROM w JOIN part USING (p_partkey)
"""

#: A dictionary of names of which some are one, two or three letters away from those of the pages, and male and female ones alike.
NAMES = f"""
WITH w AS ({_STEMS}),
e AS (
  SELECT 's' AS kind, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN a || t || 'ОВ' WHEN 1 THEN a || t || 'ОВА' WHEN 2 THEN a || t || 'ОВСК' ELSE a || t || 'ОВСКИЙ' END AS entry FROM w
  UNION ALL SELECT 'm', p_partkey, CASE p_partkey % 3 WHEN 0 THEN b || t WHEN 1 THEN b || substr(t, 1, 1) || 'Я' ELSE 'Ж' || substr(b, 2) END FROM w
  UNION ALL SELECT 'f', p_partkey, CASE p_partkey % 3 WHEN 1 THEN b || t WHEN 2 THEN b || t || 'А' ELSE b END FROM w
  UNION ALL SELECT 'p', p_partkey, CASE p_partkey % 4 WHEN 0 THEN a || t || 'ОВИЧ' WHEN 1 THEN a || t || 'ОВ' WHEN 2 THEN a || t || 'ОВИЧЪЪЪ' ELSE a || 'ЕВИЧ' END FROM w)
SELECT kind, cast(min(k) as int) AS ord, entry FROM e GROUP BY kind, entry
"""

#: Words with one letter changed in some, and the dictionary that they come from.
DICTIONARY = f"SELECT 's' AS kind, cast(min(p_partkey) as int) AS ord, {_CYRILLIC} AS entry FROM part GROUP BY 3"
WORDS = f"SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'Ж' || substr({_CYRILLIC}, 2) WHEN p_partkey % 3 = 1 THEN substr({_CYRILLIC}, 2) ELSE {_CYRILLIC} END AS w FROM part"

FRAMES = "SELECT user_id AS session_id, ts, event_id AS frame_id, event_type AS k, value FROM events"

PERSONS = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '2024-0' || cast(1 + c_custkey % 9 as varchar(9)) || '-1' || cast(c_nationkey % 10 as varchar(9)) END AS arrival_date,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS surname, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS name, '' AS patronymic,
       '' AS phone, CASE c_custkey % 3 WHEN 0 THEN '__custom__' WHEN 1 THEN 'cook' ELSE 'driver' END AS specialty, 'custom ' || cast(c_nationkey as varchar(9)) AS custom_specialty,
       CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE 'warn' END AS ocr_status
FROM customer
"""

#: Camera ticks: every third event measures glare, the others read a zone, one in five of them somebody else's.
SCAN_FRAMES = f"""
WITH zones AS ({MRZ})
SELECT user_id AS session_id, ts, event_id AS frame_id,
       CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 50 THEN 'glare_strong' ELSE 'ok' END END AS feedback,
       CASE WHEN event_id % 3 <> 0 THEN mrz_text END AS mrz_text
FROM events LEFT JOIN zones ON scan_id = CASE WHEN event_id % 5 = 4 THEN user_id + 1 ELSE user_id END
"""

_NAMES = {"MRZ": MRZ, "SCANS": SCANS, "NAMES": NAMES, "DICTIONARY": DICTIONARY, "WORDS": WORDS, "FRAMES": FRAMES, "SCAN_FRAMES": SCAN_FRAMES, "PERSONS": PERSONS}
_TABLES = ("customer", "part", "events", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    sql = _NAMES[name]
    for t in _TABLES:
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(sql)
