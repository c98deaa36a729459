"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from idloom.functions import mrz as M
from idloom.functions import text as T
from idloom.plans import fixtures as X

YEAR = X.AS_OF_YEAR
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = rf"'^{_SPACE}+|{_SPACE}+$', '', 'g'"


def _title(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _check(x: str) -> str:
    value = "CASE WHEN c = '<' THEN 0 WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    return f"(list_sum(list_transform(string_split({x}, ''), lambda c, i: ({value}) * [7, 3, 1][(i - 1) % 3 + 1])) % 10)"


def _ok(line: str, start: int, n: int) -> str:
    return f"coalesce({_check(f'substr({line}, {start}, {n})')} = try_cast(substr({line}, {start + n}, 1) AS int), false)"


_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in zip(M.LATIN, M.CYRILLIC, strict=True)) + "}"


def _cyr(x: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all(regexp_replace({x}, '[<0-9]', '', 'g'), '{'|'.join(M.LATIN)}'), lambda p: ({_MAP})[p]), ''), '')"


def _date(x: str, year: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{6}}$') THEN substr({x}, 5, 2) || '.' || substr({x}, 3, 2) || '.' || ({year}) ELSE '' END"


_YY = "try_cast(substr(l2, 14, 2) AS int)"
_READ = f"""
WITH scans AS ({X.MRZ}),
norm AS (SELECT scan_id, list_filter(list_transform(string_split(mrz_text, chr(10)), lambda x: regexp_replace(regexp_replace(upper(x), '\\s+', '<', 'g'), '[^A-Z0-9<]', '<', 'g')), lambda x: length(x) >= 40) AS ls FROM scans),
found AS (SELECT scan_id, rpad(list_filter(ls, lambda x: regexp_matches(x, '{M.LINE1}'))[1], 44, '<') AS a, rpad(list_filter(ls, lambda x: regexp_matches(x, '{M.LINE2}'))[1], 44, '<') AS b FROM norm),
pair AS (SELECT scan_id, CASE WHEN b IS NOT NULL THEN a END AS l1, CASE WHEN a IS NOT NULL THEN b END AS l2 FROM found),
parts AS (SELECT *, substr(l1, 6, 39) AS f, instr(substr(l1, 6, 39), '<<') AS pos,
  {_ok("l2", 1, 9)} AS ok_doc, {_ok("l2", 14, 6)} AS ok_dob, {_ok("l2", 22, 6)} AS ok_exp FROM pair),
given AS (SELECT *, list_filter(string_split(substr(f, pos + 2), '<'), lambda x: x <> '') AS g FROM parts),
named AS (SELECT *,
  CASE WHEN pos > 0 THEN {_title(_cyr("replace(substr(f, 1, pos - 1), '<', '')"))} END AS sn,
  CASE WHEN pos > 0 THEN {_title(_cyr("coalesce(g[1], '')"))} END AS nm,
  CASE WHEN pos > 0 THEN {_title(_cyr("coalesce(g[2], '')"))} END AS pt FROM given)
"""
_SCANNER_DOB = _date("substr(l2, 14, 6)", f"CASE WHEN 2000 + {_YY} > {YEAR + 1} THEN 1900 + {_YY} ELSE 2000 + {_YY} END")
_APP_DOB = _date("substr(l2, 14, 6)", f"CASE WHEN {_YY} > {YEAR % 100 + 10} THEN 1900 + {_YY} ELSE 2000 + {_YY} END")
_CONF = "33 * (cast(ok_doc AS int) + cast(ok_dob AS int) + cast(ok_exp AS int))"

_CLEAN = "upper(full_text)"
for _d, _c in (("0", "О"), ("3", "З")):
    _CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '([А-ЯЁ]){_d}', '\\1{_c}', 'g'), '{_d}([А-ЯЁ])', '{_c}\\1', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '[^А-ЯЁA-Z0-9\\-.\\s]', ' ', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), ' ' || chr(10) || chr(9))"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')"


def _lang(x: str) -> str:
    lat, cyr = (f"length(regexp_replace({x}, '[^{k}]', '', 'g'))" for k in ("A-Za-z", "А-ЯЁа-яё"))
    return f"CASE WHEN {lat} > {cyr} + 5 AND {lat} > 8 THEN 'latin' ELSE 'cyrillic' END"


def _any(x: str, words: list[str], whole: set[str] = frozenset()) -> str:
    return f"regexp_matches({x}, '{'|'.join(f'(^|[^А-ЯЁ]){w}([^А-ЯЁ]|$)' if w in whole else w for w in words)}')"


_LAST = f"regexp_matches(w, '({'|'.join(T.PATRONYMIC_ENDS)})$')"
_DATES = r"list_transform(regexp_extract_all(translate(full_text, 'ОоO', '000'), '\d{1,2}[.\s–\-/]\d{1,2}[.\s–\-/]\d{4}'), lambda d: regexp_replace(d, '[.\s–\-/]', '.', 'g'))"


def _valid(ds: str, oldest: int) -> str:
    return f"coalesce(list_filter({ds}, lambda d: {YEAR} - cast(string_split(d, '.')[3] AS int) BETWEEN 14 AND {oldest})[1], '')"


_LINE_DATES = _DATES.replace("full_text", "s")
_BEST = f"coalesce(list_filter(list_transform({_lines('full_text')}, lambda s: {_valid(_LINE_DATES, 100)}), lambda v: v <> '')[1], '')"

_AFTER = "array_to_string(list_transform(regexp_extract_all(substr(full_text, instr(upper(full_text), '{0}') + {1}), '[А-ЯЁа-яё\\-]{{2,}}'), lambda w: upper(w)), ' ')"


def _after(label: str) -> str:
    return f"CASE WHEN instr(upper(full_text), '{label}') > 0 THEN {_AFTER.format(label, len(label))} ELSE '' END"


def _latin(x: str) -> str:
    """One byte for each letter: the distance counts bytes."""
    return f"translate({x}, 'АБЦДЕФГХИЙКЛМНОПЯРСТУВШЧЫЗЖ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ1')"


_FUZZY = f"""
WITH w AS ({X.WORDS}), d AS ({X.DICTIONARY}),
p AS (SELECT w, kind, levenshtein({_latin('w')}, {_latin('entry')}) AS dist, ord, entry FROM w, d WHERE w <> '' AND abs(length(w) - length(entry)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY w, kind ORDER BY dist, ord, entry) AS n FROM p WHERE dist <= 2)
SELECT w, kind, entry AS match, dist, ord FROM r WHERE n = 1
"""

_DET = """
WITH e AS (SELECT vec_id // 50 AS image_id, vec_id AS anchor_idx, 320 + 400 * embedding[1]::double AS cx, 320 + 400 * embedding[2]::double AS cy,
  60 + 100 * embedding[3]::double AS bw, 60 + 100 * embedding[4]::double AS bh, list_transform(embedding[5:26], lambda x: x::double) AS scores FROM embeddings),
s AS (SELECT *, list_max(scores) AS score, list_position(scores, list_max(scores)) - 1 AS cls FROM e),
best AS (SELECT image_id, anchor_idx, cls, score, cx - bw / 2 AS x1, cy - bh / 2 AS y1, cx + bw / 2 AS x2, cy + bh / 2 AS y2,
  CASE cls WHEN 1 THEN 'surname' WHEN 2 THEN 'name' ELSE 'patronymic' END AS field FROM s WHERE score > 0 AND score >= 0.2 AND cls IN (1, 2, 17)),
"""
_BOXES = (
    _DET
    + """
top AS (SELECT *, row_number() OVER (PARTITION BY image_id, field ORDER BY score DESC, anchor_idx) AS n FROM best),
dims AS (SELECT DISTINCT image_id, 800 + 37 * (image_id % 20) AS w, 600 + 91 * (image_id % 20) AS h FROM e),
sc AS (SELECT *, least(640 / w, 640 / h) AS r FROM dims),
lb AS (SELECT *, (640 - floor(w * r + 0.5)) / 2 AS dw, (640 - floor(h * r + 0.5)) / 2 AS dh FROM sc),
boxes AS (SELECT t.image_id, field, cast(greatest(0, floor((x1 - dw) / r + 0.5)) AS bigint) AS x1, cast(greatest(0, floor((y1 - dh) / r + 0.5)) AS bigint) AS y1,
  cast(least(w, floor((x2 - dw) / r + 0.5)) AS bigint) AS x2, cast(least(h, floor((y2 - dh) / r + 0.5)) AS bigint) AS y2, round(score, 6) AS conf
  FROM top t JOIN lb USING (image_id) WHERE n = 1)
"""
)
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"
_PIX = """
WITH u AS (SELECT vec_id AS image_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
v AS (SELECT image_id, i, cast(least(255, greatest(0, floor(128 + 600 * x))) AS int) AS v FROM u),
px AS (SELECT image_id, i, 0.299::double * v + 0.587::double * v + 0.114::double * (255 - v) AS l FROM v)
"""
_P, _F = f"p AS ({X.PERSONS})", f"fr AS ({X.FRAMES})"
_SPECIALTY = "CASE WHEN specialty = '__custom__' THEN custom_specialty ELSE specialty END"
_DOTTED = "CASE WHEN contains(arrival_date, '-') THEN split_part(arrival_date, '-', 3) || '.' || split_part(arrival_date, '-', 2) || '.' || split_part(arrival_date, '-', 1) ELSE arrival_date END"
_MONTH, _DAY = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]", "[" + ", ".join(f"'{m}'" for m in T.WEEKDAYS) + "]"

ORACLE_SQL = {
    "parse_mrz": f"""{_READ}
SELECT scan_id, sn AS surname, nm AS name, pt AS patronymic,
  CASE WHEN ok_dob AND {YEAR} - try_cast(substr({_SCANNER_DOB}, 7, 4) AS int) BETWEEN 14 AND 100 THEN {_SCANNER_DOB} END AS "dateOfBirth",
  CASE WHEN l2 IS NULL THEN NULL WHEN substr(l2, 21, 1) IN ('M', 'F') THEN substr(l2, 21, 1) ELSE '' END AS gender,
  CASE WHEN ok_doc THEN replace(substr(l2, 1, 9), '<', '') END AS "documentNumber",
  CASE WHEN ok_exp THEN {_date("substr(l2, 22, 6)", "2000 + try_cast(substr(l2, 22, 2) AS int)")} END AS "expiryDate",
  replace(substr(l2, 11, 3), '<', '') AS citizenship, CASE WHEN l2 IS NOT NULL THEN ok_dob END AS "mrzValid", CASE WHEN l2 IS NOT NULL THEN {_CONF} END AS confidence
FROM named""",
    "parse_mrz_app": f"""{_READ}
SELECT scan_id, l2 IS NOT NULL AND ok_dob AS valid, CASE WHEN ok_dob THEN coalesce(sn, '') ELSE '' END AS surname, CASE WHEN ok_dob THEN coalesce(nm, '') ELSE '' END AS name,
  CASE WHEN ok_dob THEN coalesce(pt, '') ELSE '' END AS patronymic, CASE WHEN ok_dob THEN {_APP_DOB} ELSE '' END AS dob
FROM named""",
    "resolved_status": f"""{_READ}
SELECT CASE WHEN coalesce(sn, '') || coalesce(nm, '') <> '' AND ok_dob THEN 'done' ELSE 'warn' END AS status, CASE WHEN l2 IS NULL THEN 'unknown' ELSE 'international_passport' END AS document_type,
  count(*) AS scans, cast(sum(CASE WHEN l2 IS NULL THEN 0 ELSE {_CONF} END) AS bigint) AS confidence
FROM named GROUP BY 1, 2""",
    "clean_text": f"WITH t AS (SELECT scan_id, {_CLEAN} AS clean FROM ({X.SCANS})) SELECT scan_id, clean, {_lang('clean')} AS lang, coalesce(array_to_string({_lines('clean')}, '|'), '') AS lines FROM t",
    "words": f"""WITH l AS (SELECT scan_id, unnest({_lines('full_text')}) AS line, generate_subscripts({_lines('full_text')}, 1) - 1 AS li FROM ({X.SCANS})),
x AS (SELECT scan_id, li, list_filter(regexp_extract_all(upper(line), '[А-ЯЁ\\-]{{3,}}'), lambda w: length(w) <= 30) AS ws FROM l),
t AS (SELECT scan_id, li, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS no FROM x)
SELECT scan_id, li, no, w, {_title('w')} AS title, {_any('w', T.LABELS + T.PLACES, T.WHOLE_LABELS)} AS label,
  regexp_matches(w, '{'|'.join('ПОЛ([^А-ЯЁ]|$)' if v == 'ПОЛ' else v for v in T.VISUAL_LABELS)}') AS label_visual,
  w IN ({', '.join(f"'{v}'" for v in T.PATRONYMIC_WORDS)}) OR (length(w) >= 5 AND {_LAST}) AS patronymic FROM t""",
    "latin_words": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[A-Z\\-]{{3,}}')) AS w FROM documents)
SELECT doc_id, count(*) AS words, count(*) FILTER (w IN ({', '.join(f"'{v}'" for v in T.LATIN_PATRONYMIC_WORDS)}) OR (length(w) >= 5 AND regexp_matches(w, '({'|'.join(T.LATIN_PATRONYMIC_ENDS)})$'))) AS patronymics, max(w) AS last_word
FROM t WHERE length(w) <= 30 AND NOT regexp_matches(w, '(?i){'|'.join(T.LATIN_LABELS)}') GROUP BY doc_id""",
    "text_after_label": f"SELECT scan_id, {_after('ИМЯ')} AS after_name, {_after('ФАМИЛИ')} AS after_surname FROM ({X.SCANS})",
    "dates": f"""SELECT scan_id, coalesce(array_to_string({_DATES}, '|'), '') AS dates, {_valid(_DATES, 100)} AS dob, {_valid(_DATES, 80)} AS dob_app, coalesce({_DATES}[1], '') AS any_date, {_BEST} AS best_dob FROM ({X.SCANS})""",
    "fuzzy_find": _FUZZY,
    "fuzzy_find_segments": _FUZZY,
    "best_boxes": f"{_BOXES} SELECT image_id, field, x1, y1, x2, y2, conf FROM boxes",
    "boxes_by_field": f"{_BOXES} SELECT image_id, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN {c} END) AS {f}_{c}" for f in ("surname", "name", "patronymic") for c in ("x1", "y2")) + " FROM boxes GROUP BY image_id",
    "iou_pairs": f"""{_DET.rstrip().rstrip(',')} SELECT a.image_id, a.cls, a.anchor_idx AS first, b.anchor_idx AS second, round({_INTER} / {_UNION}, 6) AS iou FROM best a JOIN best b ON a.image_id = b.image_id AND a.cls = b.cls AND a.anchor_idx < b.anchor_idx
WHERE {_UNION} > 0 AND {_INTER} / {_UNION} >= 0.2""",
    "glare": f"""{_PIX}, m AS (SELECT image_id, avg(CASE WHEN l >= 245 THEN 1.0::double ELSE 0 END) AS h, avg(l) AS b FROM px GROUP BY 1),
g AS (SELECT *, CASE WHEN h >= 0.04 THEN 'strong' WHEN h >= 0.01 THEN 'mild' ELSE 'none' END AS level FROM m)
SELECT image_id, round(h + 1e-9, 6) AS hotspot_ratio, round(b + 1e-9, 6) AS mean_brightness, level, CASE WHEN level <> 'none' THEN 'glare_' || level WHEN b < 55 THEN 'too_dark' ELSE 'ok' END AS feedback FROM g""",
    "otsu": f"""{_PIX}, gr AS (SELECT image_id, cast(floor(l) AS int) AS gray FROM px),
hist AS (SELECT image_id, gray, count(*)::double AS n FROM gr GROUP BY ALL),
c AS (SELECT image_id, gray, sum(n) OVER w AS wb, sum(n * gray) OVER w AS sb, sum(n) OVER e AS a, sum(n * gray) OVER e AS s FROM hist WINDOW w AS (PARTITION BY image_id ORDER BY gray), e AS (PARTITION BY image_id)),
x AS (SELECT *, CASE WHEN a > wb THEN wb * (a - wb) * pow(sb / wb - (s - sb) / (a - wb), 2) END AS v FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN v > 0 THEN v END DESC NULLS LAST, gray) AS k FROM x),
t AS (SELECT image_id, CASE WHEN v > 0 THEN gray ELSE 128 END AS threshold FROM r WHERE k = 1)
SELECT image_id, count(*) FILTER (gray <= threshold) AS dark, any_value(threshold) AS threshold FROM gr JOIN t USING (image_id) GROUP BY image_id""",
    "contrast": f"""{_PIX}, gr AS (SELECT image_id, floor(l + 0.5) AS g FROM px), e AS (SELECT image_id, min(g) AS lo, max(g) AS hi FROM gr GROUP BY 1),
s AS (SELECT image_id, CASE WHEN hi - lo < 10 THEN g ELSE least(255, greatest(0, floor(g * (1 - 0.6::double) + floor((g - lo) / (hi - lo) * 255 + 0.5) * 0.6::double + 0.5))) END AS g FROM gr JOIN e USING (image_id))
SELECT image_id, cast(sum(g) AS bigint) AS total, cast(min(g) AS int) AS lo, cast(max(g) AS int) AS hi FROM s GROUP BY 1""",
    "fit_max_dim": """WITH a AS (SELECT p_partkey AS image_id, p_partkey % 4000 + 10 AS w, p_size * 97 AS h FROM part),
b AS (SELECT *, least(1.0::double, 1920 / greatest(w, h)) AS k FROM a), c AS (SELECT image_id, cast(floor(w * k + 0.5) AS int) AS w, cast(floor(h * k + 0.5) AS int) AS h FROM b),
d AS (SELECT *, least(640 / w, 640 / h) AS r FROM c)
SELECT image_id, w, h, round(r, 9) AS r, (640 - floor(w * r + 0.5)) / 2 AS dw, (640 - floor(h * r + 0.5)) / 2 AS dh FROM d""",
    "char_indices": f"""SELECT vec_id, trim(regexp_replace(coalesce(array_to_string(list_transform(list_filter(list_transform(embedding, lambda x: cast(floor(x::double * 100) AS bigint)), lambda i: i >= 0 AND i < {len(T.ALPHABET)}), lambda i: substr('{T.ALPHABET}', i + 1, 1)), ''), ''), '^\\.+', '')) AS decoded FROM embeddings""",
    "roster": f"""WITH {_P}, n AS (SELECT arrival_date, row_number() OVER (PARTITION BY arrival_date ORDER BY id) AS no, surname, name, patronymic, {_SPECIALTY} AS specialty FROM p),
c AS (SELECT arrival_date, count(*) AS k FROM p GROUP BY 1 HAVING count(*) < 2), a AS (SELECT * FROM n UNION ALL SELECT arrival_date, 2, '', '', '', '' FROM c)
SELECT arrival_date AS arrival_key, no, surname, name, patronymic, {_DOTTED} AS arrival_date, specialty FROM a""",
    "roster_preview": f"""WITH {_P} SELECT id, CASE WHEN surname || name = '' THEN '— ожидает данных —' ELSE surname END AS surname, name, patronymic, {_SPECIALTY} AS specialty,
  CASE WHEN arrival_date = '' THEN '—' ELSE day(arrival_date::date) || ' ' || {_MONTH}[month(arrival_date::date)] || ' ' || year(arrival_date::date) END AS day,
  CASE WHEN arrival_date = '' THEN '' ELSE {_DAY}[dayofweek(arrival_date::date) + 1] END AS weekday FROM (SELECT * REPLACE (CASE WHEN arrival_date = '' THEN '' ELSE arrival_date END AS arrival_date) FROM p)""".replace("arrival_date::date", "nullif(arrival_date, '')::date"),
    "roster_summary": f"WITH {_P} SELECT arrival_date AS arrival_key, count(*) AS persons, count(*) FILTER (ocr_status = 'done') AS done FROM p GROUP BY 1",
    "staff": f"""WITH {_P}, {_F}, h AS (SELECT id::double AS sid, surname, name, patronymic FROM p WHERE surname || name <> '' UNION ALL SELECT id, surname, name, patronymic FROM p WHERE surname || name <> '' AND id % 50 = 1),
c AS (SELECT session_id, arg_max(k, frame_id) AS ph FROM fr GROUP BY 1)
SELECT sid, trim(surname || ' ' || name) AS full_name, coalesce(ph, '') AS phone FROM h LEFT JOIN c ON sid = session_id WHERE sid % 7 <> 3""",
    "patches": f"""WITH {_P}, {_F}, c AS (SELECT session_id, arg_max(k, frame_id) FILTER (frame_id % 2 = 0) AS a, arg_max(k, frame_id) FILTER (frame_id % 2 = 1) AS b FROM fr GROUP BY 1)
SELECT id, coalesce(a, surname) AS surname, coalesce(b, specialty) AS specialty FROM p LEFT JOIN c ON id = session_id""",
    "region_read": f"""WITH {_P} SELECT id, CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN 'Новый' ELSE surname END AS surname, CASE WHEN id % 3 = 1 THEN 'Имя' ELSE name END AS name, patronymic, CASE WHEN id % 3 = 1 THEN 'warn' ELSE ocr_status END AS ocr_status FROM p""",
    "stability": f"""WITH {_F}, r AS (SELECT session_id, frame_id, list(k) OVER (PARTITION BY session_id ORDER BY ts, frame_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h FROM fr),
s AS (SELECT *, list_filter(h, lambda x: len(list_filter(h, lambda y: y = x)) >= 2)[1] AS stable_key FROM r) SELECT session_id, frame_id, stable_key IS NOT NULL AS stable, stable_key FROM s""",
    "frame_gate": f"""WITH {_F}, a AS (SELECT session_id, ts, frame_id, NULL AS fb, 1 AS mine FROM fr WHERE frame_id % 3 <> 0 UNION ALL SELECT session_id, ts, NULL, CASE WHEN value > 50 THEN 'glare_strong' ELSE 'ok' END, 0 FROM fr WHERE frame_id % 3 = 0),
s AS (SELECT *, coalesce(last_value(fb IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, mine ROWS UNBOUNDED PRECEDING), 'ok') AS feedback FROM a)
SELECT session_id, frame_id, feedback FROM s WHERE mine = 1 AND feedback <> 'glare_strong'""",
    "frame_samples": f"WITH {_F} SELECT session_id, frame_id FROM fr QUALIFY row_number() OVER (PARTITION BY session_id, date_trunc('hour', ts) ORDER BY ts DESC, frame_id DESC) = 1",
}

# The vote over o(session_id, frame_id, k, n), frame by frame.
_VOTE = """
r AS (SELECT DISTINCT session_id, 0::bigint AS n, []::varchar[] AS h, NULL::bigint AS frame_id, NULL::varchar AS stable_key FROM o
  UNION ALL
  SELECT session_id, n, CASE WHEN found IS NULL THEN seen ELSE [] END, frame_id, found
  FROM (SELECT *, list_filter(seen, lambda x: len(list_filter(seen, lambda y: y = x)) >= 2)[1] AS found
        FROM (SELECT o.session_id, o.n, o.frame_id, list_append(r.h, o.k)[-4:] AS seen FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)))
SELECT session_id, frame_id, stable_key FROM r WHERE stable_key IS NOT NULL"""
ORACLE_SQL["stable_frames"] = f"WITH RECURSIVE {_F}, o AS (SELECT session_id, frame_id, k, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS n FROM fr), {_VOTE}"
ORACLE_SQL["scan_frames"] = f"""
WITH RECURSIVE z AS ({ORACLE_SQL["parse_mrz"]}),
f AS (SELECT user_id AS session_id, ts, event_id AS frame_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 50 THEN 'glare_strong' ELSE 'ok' END END AS feedback,
  CASE WHEN event_id % 5 = 4 THEN user_id + 1 ELSE user_id END AS scan_id FROM events),
shots AS (SELECT * FROM f WHERE feedback IS NULL QUALIFY row_number() OVER (PARTITION BY session_id, epoch_us(ts) // 900000 ORDER BY ts DESC, frame_id DESC) = 1),
b AS (SELECT *, 1 AS shot FROM shots UNION ALL SELECT *, 0 FROM f WHERE feedback IS NOT NULL),
g AS (SELECT *, coalesce(last_value(feedback IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, shot, frame_id ROWS UNBOUNDED PRECEDING), 'ok') AS told FROM b),
o AS (SELECT session_id, frame_id, coalesce(surname, '') || '|' || coalesce(name, '') || '|' || coalesce("dateOfBirth", '') AS k, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS n
  FROM g JOIN z USING (scan_id) WHERE shot = 1 AND told <> 'glare_strong' AND confidence IS NOT NULL), {_VOTE}"""

ORACLE_SQL["staff_count"] = f"SELECT count(*) AS staff FROM ({ORACLE_SQL['staff']})"
# Fields of pages: each line beside its neighbours; of the lines at labels, the first that gives a value.
_WHOLE = "[А-ЯЁ\\-]"


def _set(*xs: str) -> str:
    return f"coalesce({', '.join(f'''nullif({x}, '')''' for x in xs)}, '')"


def _seen_words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[А-ЯЁа-яё\\-]{{2,}}'), lambda w: upper(w))"


def _seen_label(x: str) -> str:
    return f"regexp_matches(upper({x}), '{'|'.join('ПОЛ([^А-ЯЁ]|$)' if v == 'ПОЛ' else v for v in T.VISUAL_LABELS)}')"


def _behind(x: str, label: str) -> str:
    return _after(label).replace("full_text", x)


def _lone(x: str) -> str:
    return f"CASE WHEN {_seen_label(x)} THEN '' WHEN regexp_matches(upper({x}), '^{_WHOLE}{{3,}}$') THEN upper({x}) WHEN len({_seen_words(x)}) = 1 THEN {_seen_words(x)}[1] ELSE '' END"


def _above(x: str) -> str:
    return f"CASE WHEN regexp_matches(upper({x}), '^{_WHOLE}{{4,}}$') AND NOT {_seen_label(x)} THEN upper({x}) ELSE '' END"


def _valid_in(x: str) -> str:
    return _valid(_DATES.replace("full_text", x), 100)


_FIELDS = {
    "nw": (f"{_any('u', ['ИМЯ'], {'ИМЯ'})} AND NOT contains(u, 'ФАМИЛИ')", f"array_to_string({_seen_words(_set(_behind('s', 'ИМЯ'), 'near'))}, ' ')"),
    "pt": ("contains(u, 'ОТЧЕСТВ')", _set(f"{_seen_words(_behind('s', 'ОТЧЕСТВ'))}[1]", *(_lone(x) for x in ("p1", "n1", "p2", "n2")))),
    "sn": ("contains(u, 'ФАМИЛИ') OR regexp_matches(u, '^PNRU[S<]')", _set(_behind("s", "ФАМИЛИ"), _above("p1"), _above("p2"))),
    "alone": (f"regexp_matches(u, '^{_WHOLE}{{4,25}}$') AND NOT {_seen_label('s')}", "s"),
    "dob": ("regexp_matches(u, 'ДАТА.{0,6}РОЖ|РОЖ.{0,6}ДАТА|РОЖДЕН')", _valid_in("two")),
    "best": ("true", _valid_in("s")),
    "num": ("regexp_matches(u, 'СЕРИЯ|НОМЕР')", "regexp_replace(regexp_extract(two, '\\d{2}\\s*\\d{2}\\s*\\d{6}'), '\\s', '', 'g')"),
    "sex": (_any("u", ["ПОЛ"], {"ПОЛ"}), "CASE WHEN contains(u, 'МУЖ') THEN 'М' WHEN contains(u, 'ЖЕН') THEN 'Ж' ELSE '' END"),
    "issued": ("regexp_matches(u, 'ДАТА.{0,6}ВЫД|ВЫДАН')", f"coalesce({_DATES.replace('full_text', 'two')}[1], '')"),
}
_VISUAL = f"""
WITH t AS (SELECT scan_id, {_lines('full_text')} AS ls FROM ({X.SCANS})),
l AS (SELECT scan_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM t),
b AS (SELECT *, upper(s) AS u, lag(s, 1, '') OVER o AS p1, lag(s, 2, '') OVER o AS p2, lead(s, 1, '') OVER o AS n1, lead(s, 2, '') OVER o AS n2 FROM l WINDOW o AS (PARTITION BY scan_id ORDER BY i)),
c AS (SELECT *, s || ' ' || n1 AS two, array_to_string(list_filter([p2, p1, n1, n2], lambda x: x <> ''), ' ') AS near FROM b),
v AS (SELECT scan_id, i, {", ".join(f"CASE WHEN {at} THEN {value} ELSE '' END AS {k}" for k, (at, value) in _FIELDS.items())} FROM c),
f AS (SELECT scan_id, {", ".join(f"arg_min({k}, i) FILTER ({k} <> '') AS {k}" for k in _FIELDS)} FROM v GROUP BY 1)
SELECT scan_id, 'passport_rf' AS "documentType", {_title(_set("sn", "alone"))} AS surname, {_title("split_part(coalesce(nw, ''), ' ', 1)")} AS name,
  {_title(_set("split_part(coalesce(nw, ''), ' ', 2)", "pt"))} AS patronymic, {_set("dob", "best")} AS "dateOfBirth", coalesce(sex, '') AS gender, coalesce(num, '') AS "documentNumber", coalesce(issued, '') AS "issuedDate"
FROM t LEFT JOIN f USING (scan_id)
"""
ORACLE_SQL["visual_passport"] = _VISUAL
ORACLE_SQL["merge_results"] = f"""
WITH m AS ({ORACLE_SQL["parse_mrz"]}), s AS ({_VISUAL})
SELECT scan_id, CASE WHEN m."mrzValid" IS NOT NULL THEN 'international_passport' ELSE coalesce(s."documentType", 'unknown') END AS "documentType",
  {", ".join(f'{_set(f"m.{c}", f"s.{c}")} AS {c}' for c in ("surname", "name", '"dateOfBirth"', "gender"))}, {_set("s.patronymic", "m.patronymic")} AS patronymic,
  {_set('s."issuedDate"')} AS "issuedDate", coalesce(m."mrzValid", false) AS "mrzValid", coalesce(m.confidence, 0) AS confidence
FROM m FULL JOIN s USING (scan_id)
"""
_LATIN_LABEL = "(?i)" + "|".join(T.LATIN_LABELS)
_LATIN_LAST = f"(w IN ({', '.join(f'''{v!r}''' for v in T.LATIN_PATRONYMIC_WORDS)}) OR (length(w) >= 5 AND regexp_matches(w, '({'|'.join(T.LATIN_PATRONYMIC_ENDS)})$')))"
ORACLE_SQL["fio_latin"] = f"""
WITH t AS (SELECT scan_id, {_lines(_CLEAN)} AS ls FROM ({X.SCANS}) WHERE {_lang("full_text")} = 'latin'),
w AS (SELECT scan_id, list_filter(list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '{_LATIN_LABEL}')),
  lambda x: list_filter(regexp_extract_all(x, '[A-Z\\-]{{3,}}'), lambda w: length(w) <= 30 AND NOT regexp_matches(w, '{_LATIN_LABEL}'))), lambda ws: len(ws) > 0) AS ws FROM t),
p AS (SELECT scan_id, ws, coalesce(list_position(list_transform(ws, lambda y: len(list_filter(y, lambda w: {_LATIN_LAST})) > 0), true), 0) AS aside, coalesce(list_filter(flatten(ws), lambda w: {_LATIN_LAST})[1], '') AS pt FROM w),
r AS (SELECT *, list_filter(ws, lambda y, i: i <> aside) AS rest FROM p),
n AS (SELECT scan_id, coalesce(rest[1][1], '') AS sn, coalesce(rest[2][1], rest[1][2], '') AS nm, pt FROM r)
SELECT scan_id, {_title("sn")} AS surname, {_title("nm")} AS name, {_title("pt")} AS patronymic,
  CASE WHEN length(sn) > 2 THEN 40 ELSE 0 END + CASE WHEN length(nm) > 2 THEN 35 ELSE 0 END + CASE WHEN length(pt) > 2 THEN 25 ELSE 0 END AS confidence
FROM n
"""

# Suppression: boxes of an image and class from the best down; one stays unless a box that stayed before covers it.
_COVER = _INTER.replace("a.", "k.b."), _UNION.replace("a.", "k.b.")
ORACLE_SQL["nms"] = f"""
{_DET.rstrip().rstrip(",").replace("WITH e", "WITH RECURSIVE e", 1)},
o AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, anchor_idx) AS n FROM best),
r AS (SELECT DISTINCT image_id, cls, 0::bigint AS n, []::STRUCT(b STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE))[] AS kept, false AS stays, NULL::varchar AS field, NULL::bigint AS anchor_idx, NULL::double AS score FROM o
  UNION ALL
  SELECT image_id, cls, n, CASE WHEN stays THEN list_append(kept, {{'b': {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}}) ELSE kept END, stays, field, anchor_idx, score
  FROM (SELECT b.*, r.kept, len(list_filter(r.kept, lambda k: CASE WHEN {_COVER[1]} > 0 THEN {_COVER[0]} / {_COVER[1]} ELSE 0 END >= 0.2)) = 0 AS stays
        FROM r JOIN o b ON b.image_id = r.image_id AND b.cls = r.cls AND b.n = r.n + 1))
SELECT image_id, field, anchor_idx, round(score, 6) AS score FROM r WHERE stays
"""

# Names of pages: words beside labels as rows, ranked; of the lines at labels the first with a word; then the text's words.
_ALPHABET = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
_BYTES = lambda x: f"translate({x}, '{_ALPHABET}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"
_PAGE_WORDS = lambda x: f"list_filter(regexp_extract_all({x}, '[А-ЯЁ\\-]{{3,}}'), lambda v: length(v) <= 30)"
_PAGE_LABEL = lambda x: _any(x, T.LABELS + T.PLACES, T.WHOLE_LABELS)
_PAGE_LAST = f"(w IN ({', '.join(f'''{v!r}''' for v in T.PATRONYMIC_WORDS)}) OR (length(w) >= 5 AND {_LAST}))"
_NAME_LINE = f"{_any('line', ['ИМЯ'], {'ИМЯ'})} AND NOT contains(line, 'ФАМИЛИ')"
_POINTS = "CASE dist WHEN 0 THEN 1.0::double WHEN 1 THEN 0.75::double WHEN 2 THEN 0.5::double ELSE 0.25::double END"
_LABEL_POINTS = f"CASE WHEN dist = 99 THEN 0.55::double ELSE least(1.0::double, {_POINTS} + 0.2::double) END"


def _beside(name: str, label: str, at: str, hits: str, excluded: str) -> str:
    """CTEs that end in {name}(scan_id, i, word, dist, raw): the word of the first line with the label that has one."""
    return f"""
{name}_at AS (SELECT scan_id, i, line FROM l WHERE {at}),
{name}_near AS (
  SELECT scan_id, i, 0 AS d, 0 AS turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT scan_id, i, {_PAGE_WORDS(f"substr(line, instr(line, '{label}') + {len(label)})")} AS ws FROM {name}_at)
  UNION ALL SELECT a.scan_id, a.i, abs(delta), turn, w.w, w.k FROM {name}_at a CROSS JOIN (VALUES (1, 1), (-1, 2), (2, 3), (-2, 4), (3, 5), (-3, 6)) v(delta, turn) JOIN w ON w.scan_id = a.scan_id AND w.i = a.i + delta WHERE NOT w.label),
{name}_free AS (SELECT n.*, row_number() OVER (PARTITION BY n.scan_id, n.i ORDER BY d, -length(n.w), turn, k) AS rank FROM {name}_near n {excluded}),
{name}_known AS (SELECT f.scan_id, f.i, arg_min(struct_pack(word := h.match, dist := h.dist, raw := f.w), h.dist * 100 + f.rank) AS b FROM {name}_free f JOIN {hits} h ON h.w = f.w WHERE f.rank <= 8 AND h.dist <= 2 GROUP BY ALL),
{name} AS (SELECT f.scan_id, f.i, coalesce(b.word, f.w) AS word, coalesce(b.dist, 99) AS dist, coalesce(b.raw, f.w) AS raw FROM {name}_free f LEFT JOIN {name}_known USING (scan_id, i) WHERE f.rank = 1
  QUALIFY row_number() OVER (PARTITION BY f.scan_id ORDER BY f.i) = 1)"""


def _anywhere(name: str, hits: str, *others: str) -> str:
    """A CTE of the word of the text nearest to the dictionary, the first of equals, but for those of others."""
    joins = " ".join(f"LEFT JOIN {o} ON {o}.scan_id = x.scan_id" for o in others)
    return f"""
{name} AS (SELECT x.scan_id, h.match AS word, h.dist FROM x JOIN {hits} h ON h.w = x.w {joins} WHERE h.dist <= 2 {"".join(f" AND x.w <> coalesce({o}.word, '')" for o in others)}
  QUALIFY row_number() OVER (PARTITION BY x.scan_id ORDER BY h.dist, x.i, x.k) = 1)"""


_FIO = f"""
WITH d AS MATERIALIZED ({X.NAMES}), scans AS ({X.SCANS}),
t AS MATERIALIZED (SELECT scan_id, {_CLEAN} AS cleaned FROM scans),
c AS (SELECT scan_id, cleaned, {_lines("cleaned")} AS ls FROM t WHERE {_lang("cleaned")} = 'cyrillic'),
l AS MATERIALIZED (SELECT *, {_PAGE_LABEL("line")} AS label FROM (SELECT scan_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM c)),
w AS MATERIALIZED (SELECT scan_id, i, label, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT *, {_PAGE_WORDS("line")} AS ws FROM l)),
seen AS (SELECT w FROM w UNION SELECT unnest({_PAGE_WORDS("substr(line, instr(line, 'ФАМИЛИ') + 6)")}) FROM l WHERE contains(line, 'ФАМИЛИ') UNION SELECT unnest({_PAGE_WORDS("substr(line, instr(line, 'ИМЯ') + 3)")}) FROM l WHERE contains(line, 'ИМЯ')),
near AS MATERIALIZED (SELECT w, kind, entry AS match, dist FROM (SELECT w, kind, entry, ord, levenshtein({_BYTES("w")}, {_BYTES("entry")}) AS dist FROM seen JOIN d ON abs(length(w) - length(entry)) <= 3)
  WHERE dist <= 3 QUALIFY row_number() OVER (PARTITION BY w, kind ORDER BY dist, ord) = 1),
hs AS (SELECT w, match, dist FROM near WHERE kind = 's' AND dist <= 2),
hm AS (SELECT w, match, dist FROM near WHERE kind IN ('m', 'f') AND dist <= 2 QUALIFY row_number() OVER (PARTITION BY w ORDER BY dist, kind DESC) = 1),
hp AS (SELECT w, match, dist FROM near WHERE kind = 'p'),
{_beside("sa", "ФАМИЛИ", "contains(line, 'ФАМИЛИ')", "hs", f"WHERE NOT {_PAGE_LABEL('n.w')}")},
{_beside("na", "ИМЯ", _NAME_LINE, "hm", f"LEFT JOIN sa ON sa.scan_id = n.scan_id AND sa.i < n.i WHERE NOT {_PAGE_LABEL('n.w')} AND n.w <> coalesce(sa.word, '')")},
pa_free AS (SELECT a.scan_id, a.i, w.w, {_PAGE_LAST.replace("w ", "w.w ").replace("(w,", "(w.w,").replace("length(w)", "length(w.w)")} AS last, row_number() OVER (PARTITION BY a.scan_id, a.i ORDER BY turn, w.k) AS rank
  FROM (SELECT scan_id, i FROM l WHERE contains(line, 'ОТЧЕСТВ')) a CROSS JOIN (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4)) v(delta, turn) JOIN w ON w.scan_id = a.scan_id AND w.i = a.i + delta
  LEFT JOIN sa ON sa.scan_id = a.scan_id AND sa.i <= a.i LEFT JOIN na ON na.scan_id = a.scan_id AND na.i <= a.i WHERE w.w <> coalesce(sa.word, '') AND w.w <> coalesce(na.word, '')),
pa AS (SELECT f.scan_id, f.i, coalesce(match, f.w) AS word, coalesce(dist, 99) AS dist, f.w AS raw, CASE WHEN last THEN 0.9::double ELSE 0.6::double END AS score
  FROM (SELECT * FROM pa_free WHERE last OR (length(w) >= 5 AND NOT {_PAGE_LABEL("w")}) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY i, last DESC, rank) = 1) f LEFT JOIN hp ON hp.w = f.w),
x AS MATERIALIZED (SELECT scan_id, i, k, w FROM w WHERE NOT label),
{_anywhere("st", "hs")},
s1 AS (SELECT scan_id, word, {_LABEL_POINTS} AS score FROM sa UNION ALL SELECT scan_id, word, {_POINTS} FROM st WHERE scan_id NOT IN (SELECT scan_id FROM sa)),
{_anywhere("nt", "hm", "s1")},
n1 AS (SELECT scan_id, word, {_LABEL_POINTS} AS score FROM na UNION ALL SELECT scan_id, word, {_POINTS} FROM nt WHERE scan_id NOT IN (SELECT scan_id FROM na)),
{_anywhere("ptd", "hp", "s1", "n1")},
pts AS (SELECT x.scan_id, x.w AS word FROM x LEFT JOIN s1 USING (scan_id) LEFT JOIN n1 USING (scan_id) WHERE x.w <> coalesce(s1.word, '') AND x.w <> coalesce(n1.word, '') AND {_PAGE_LAST.replace("w ", "x.w ").replace("(w,", "(x.w,").replace("length(w)", "length(x.w)")}
  QUALIFY row_number() OVER (PARTITION BY x.scan_id ORDER BY x.i, x.k) = 1),
p1 AS (SELECT scan_id, coalesce(pa.word, ptd.word, pts.word) AS word, CASE WHEN pa.word IS NOT NULL THEN pa.score WHEN ptd.word IS NOT NULL THEN {_POINTS.replace("dist", "ptd.dist")} ELSE 0.8::double END AS score FROM pa FULL JOIN ptd USING (scan_id) FULL JOIN pts USING (scan_id)),
few AS (SELECT scan_id, i, arg_min(w, k) AS first, arg_min(w, k) FILTER ({_PAGE_LAST}) AS last FROM x
  WHERE scan_id NOT IN (SELECT scan_id FROM s1 UNION SELECT scan_id FROM sa UNION SELECT scan_id FROM na UNION SELECT scan_id FROM pa) AND scan_id IN (SELECT scan_id FROM x GROUP BY 1 HAVING count(*) <= 8) GROUP BY ALL),
aside AS (SELECT scan_id, min(i) AS i, arg_min(last, i) AS last FROM few WHERE last IS NOT NULL GROUP BY 1),
placed AS (SELECT f.scan_id, f.first, row_number() OVER (PARTITION BY f.scan_id ORDER BY f.i) AS rank FROM few f LEFT JOIN aside USING (scan_id, i) WHERE aside.i IS NULL),
names AS (SELECT c.scan_id, coalesce(s1.word, a.first, '') AS s, coalesce(n1.word, b.first, '') AS n, coalesce(p1.word, aside.last, '') AS p,
  coalesce(s1.score, CASE WHEN a.first IS NOT NULL THEN 0.4::double END, 0) AS ss, coalesce(n1.score, CASE WHEN b.first IS NOT NULL THEN 0.35::double END, 0) AS ns, coalesce(p1.score, CASE WHEN aside.last IS NOT NULL THEN 0.75::double END, 0) AS ps,
  CASE WHEN sa.i IS NOT NULL OR na.i IS NOT NULL OR pa.i IS NOT NULL THEN 'anchor' WHEN a.first IS NOT NULL THEN 'positional' ELSE 'scan' END AS strategy, c.cleaned
  FROM c LEFT JOIN s1 USING (scan_id) LEFT JOIN n1 USING (scan_id) LEFT JOIN p1 USING (scan_id) LEFT JOIN placed a ON a.scan_id = c.scan_id AND a.rank = 1 LEFT JOIN placed b ON b.scan_id = c.scan_id AND b.rank = 2
  LEFT JOIN aside ON aside.scan_id = c.scan_id LEFT JOIN sa ON sa.scan_id = c.scan_id LEFT JOIN na ON na.scan_id = c.scan_id LEFT JOIN pa ON pa.scan_id = c.scan_id),
shown AS (SELECT scan_id, string_agg(part || ':' || word || ':' || dist || ':' || raw, ' ' ORDER BY part) AS anchors FROM (SELECT scan_id, 'surname' AS part, word, dist, raw FROM sa UNION ALL SELECT scan_id, 'name', word, dist, raw FROM na UNION ALL SELECT scan_id, 'patronymic', word, dist, raw FROM pa) GROUP BY 1),
candidates AS (SELECT scan_id, string_agg(w, ' ' ORDER BY i, k) AS candidates FROM x GROUP BY 1),
latin AS ({ORACLE_SQL["fio_latin"]}),
fio AS (SELECT scan_id, {_title("s")} AS surname, {_title("n")} AS name, {_title("p")} AS patronymic, cast(floor((ss + ns + ps) / 3 * 100 + 0.5) AS int) AS confidence, strategy, cleaned, coalesce(candidates, '') AS candidates, coalesce(anchors, '') AS anchors
  FROM names LEFT JOIN shown USING (scan_id) LEFT JOIN candidates USING (scan_id)
  UNION ALL SELECT scan_id, surname, name, patronymic, confidence, 'latin', cleaned, '', '' FROM latin JOIN t USING (scan_id))
"""
ORACLE_SQL["fio"] = f"{_FIO} SELECT * FROM fio"
_GAP = lambda p: f"(coalesce(valid, false) AND f.confidence < 40 AND f.{p} = '' AND coalesce(z.{p}, '') <> '')"
_FILLED = lambda p: f"CASE WHEN model THEN {'''CASE WHEN model THEN 'Модель' END''' if p == 'surname' else repr('')} WHEN {_GAP(p)} THEN z.{p} ELSE f.{p} END"
_BEST_APP = _BEST.replace("AND 100", "AND 80").replace("BETWEEN 14 AND 100", "BETWEEN 14 AND 80")
ORACLE_SQL["resolve_passport"] = f"""{_FIO},
z AS ({ORACLE_SQL["parse_mrz_app"]}), born AS (SELECT scan_id, {_BEST_APP} AS visual_dob FROM scans),
r AS (SELECT f.scan_id, {", ".join(f"{_FILLED(p)} AS {p}" for p in ("surname", "name", "patronymic"))},
  CASE WHEN coalesce(valid, false) AND (NOT model OR z.dob <> '') THEN z.dob ELSE visual_dob END AS dob, CASE WHEN model THEN 'onnx' WHEN {" OR ".join(_GAP(p) for p in ("surname", "name", "patronymic"))} THEN 'mrz' ELSE 'fio-dict' END AS strategy, coalesce(valid, false) AS mrz_found
  FROM (SELECT *, scan_id % 17 = 0 AS model FROM fio) f JOIN born USING (scan_id) LEFT JOIN z ON z.scan_id = f.scan_id)
SELECT *, CASE WHEN surname || name <> '' AND mrz_found THEN 'done' ELSE 'warn' END AS status FROM r
"""

# Kernels on images of 64 vectors: pixels as rows, neighbours by window frames, resampling by joins.
_ROUND = lambda x: f"cast(least(255, greatest(0, floor({x} + 0.5))) AS int)"
_RGB = """
u AS (SELECT vec_id // 64 AS image_id, vec_id % 64 AS y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::double AS e FROM embeddings),
v AS (SELECT image_id, y, x, image_id % 5 > 2 AS flat, cast(least(255, greatest(0, floor([-20, 85, 130, 175, 122][image_id % 5 + 1] + 500 * e))) AS int) AS v FROM u),
c AS (SELECT image_id, y, x, v AS r, CASE WHEN flat THEN v ELSE (v * 3 + x * 4) // 4 END AS g, CASE WHEN flat THEN v ELSE 255 - v END AS b FROM v),
rgb AS MATERIALIZED (SELECT *, 0.299::double * r + 0.587::double * g + 0.114::double * b AS l FROM c)"""


def _blur(name: str, source: str, column: str) -> str:
    """CTEs that end in {name}(image_id, y, x, gray): the 5-tap blur; window frames are cut at the edges, so the edge's weight is added."""
    def one(out: str, table: str, value: str, line: str, axis: str) -> str:
        window = f"(PARTITION BY image_id, {line} ORDER BY {axis}"
        part = lambda k: f"coalesce({'lag' if k < 0 else 'lead'}({value}, {abs(k)}) OVER {window}), {'first' if k < 0 else 'last'}_value({value}) OVER {window} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        return f"{out} AS MATERIALIZED (SELECT image_id, y, x, {_ROUND(f'(({part(-2)} + 4 * {part(-1)} + 6 * {value} + 4 * {part(1)} + {part(2)}) / 16.0::double)')} AS gray FROM {table})"
    return one(f"{name}_rows", source, column, "y", "x") + ",\n" + one(name, f"{name}_rows", "gray", "x", "y")


def _ink(name: str, source: str, offset: int) -> str:
    box = lambda value, line, axis: f"sum({value}) OVER (PARTITION BY image_id, {line} ORDER BY {axis} RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING)"
    return f"""{name}_rows AS (SELECT image_id, y, x, gray, {box("gray", "y", "x")} AS s, {box("1", "y", "x")} AS n FROM {source}),
{name} AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN gray < {box("s", "x", "y")}::double / ({box("n", "x", "y")})::double - {offset} THEN 0 ELSE 255 END AS gray FROM {name}_rows)"""


def _sharp(name: str, blurred: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT g.image_id, g.y, g.x, {_ROUND('g.gray + 0.35::double * (g.gray - s.gray)')} AS gray FROM gray g JOIN {blurred} s USING (image_id, y, x))"


def _resized(name: str, source: str, size: str) -> str:
    """CTEs that end in {name}(image_id, y, x, gray): source resampled to size(image_id, h, w, nh, nw), pixel centres aligned."""
    axis = lambda a, n, m: f"SELECT image_id, i AS {a}, least(greatest((i + 0.5::double) * {m} / {n} - 0.5::double, 0), {m} - 1) AS p, {m} - 1 AS last FROM {size}, unnest(range({n})) t(i)"
    placed = "*, cast(floor(p) AS bigint) AS p0, least(cast(floor(p) AS bigint) + 1, last) AS p1, p - floor(p) AS f"
    return f"""{name}_y AS (SELECT {placed} FROM ({axis("y", "nh", "h")})), {name}_x AS (SELECT {placed} FROM ({axis("x", "nw", "w")})),
{name}_grid AS MATERIALIZED (SELECT a.image_id, a.y, b.x, a.f AS fy, b.f AS fx, a.p0 AS y0, a.p1 AS y1, b.p0 AS x0, b.p1 AS x1 FROM {name}_y a JOIN {name}_x b USING (image_id)),
{name}_list AS MATERIALIZED (SELECT image_id, max(x) + 1 AS w, list(gray ORDER BY y, x) AS g FROM {source} GROUP BY 1),
{name} AS MATERIALIZED (SELECT image_id, y, x, {_ROUND("(g[y0 * w + x0 + 1] * (1 - fx) + g[y0 * w + x1 + 1] * fx) * (1 - fy) + (g[y1 * w + x0 + 1] * (1 - fx) + g[y1 * w + x1 + 1] * fx) * fy")} AS gray FROM {name}_grid JOIN {name}_list USING (image_id))"""


_ENDS = lambda name, source: f"{name}_ends AS (SELECT image_id, min(gray) AS lo, max(gray) AS hi FROM {source} GROUP BY 1), {name} AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN hi - lo < 10 THEN gray ELSE cast(floor((gray - lo)::double / (hi - lo) * 255 + 0.5) AS int) END AS gray FROM {source} JOIN {name}_ends USING (image_id))"
_GRAY = "gray AS MATERIALIZED (SELECT image_id, y, x, cast(floor(l + 0.5) AS int) AS gray FROM rgb), dims AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM gray GROUP BY 1)"
_STRIPPED = lambda first: f"SELECT image_id, y - ({first}) AS y, x, gray FROM gray JOIN dims USING (image_id) WHERE y >= {first}"
_KERNELS_SQL = f"""
WITH {_RGB}, {_GRAY}, {_blur("gaussian5", "gray", "gray")}, {_sharp("unsharp", "gaussian5")}, {_ENDS("stretch", "gray")}, {_ink("adaptive_threshold", "gray", 10)},
{_blur("soft", "unsharp", "gray")}, {_ink("preprocess_full", "soft", 10)},
bottom_strip AS MATERIALIZED ({_STRIPPED("h - cast(floor(h * 0.35::double + 0.5) AS bigint)")}), strip_app AS ({_STRIPPED("cast(floor(h * 0.78::double + 0.5) AS bigint)")}),
{_ENDS("strip_wide", "bottom_strip")}, {_blur("strip_soft", "strip_wide", "gray")},
strip_size AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, 3 * (max(y) + 1) AS nh, 3 * (max(x) + 1) AS nw FROM strip_soft GROUP BY 1), {_resized("preprocess_mrz", "strip_soft", "strip_size")},
first_size AS (SELECT image_id, h, w, 31 AS nh, cast(floor(w * (31::double / h)) AS bigint) AS nw FROM dims),
crop_size AS (SELECT image_id, h, w, greatest(1, CASE WHEN nw > 200 THEN cast(floor(h * (200::double / w)) AS bigint) ELSE nh END) AS nh, greatest(1, least(nw, 200)) AS nw FROM first_size),
{_resized("crop", "gray", "crop_size")},
field_tensor AS (SELECT d.image_id, y.i AS y, x.i AS x, coalesce(c.gray, k.gray) AS gray FROM dims d, unnest(range(31)) y(i), unnest(range(200)) x(i) LEFT JOIN crop c ON c.image_id = d.image_id AND c.y = y.i AND c.x = x.i JOIN gray k ON k.image_id = d.image_id AND k.y = d.h - 1 AND k.x = d.w - 1)
"""
_EACH = ("stretch", "gaussian5", "unsharp", "adaptive_threshold", "preprocess_full", "preprocess_mrz", "field_tensor", "bottom_strip", "strip_app")
ORACLE_SQL["kernels"] = f"""{_KERNELS_SQL}, every AS ({" UNION ALL ".join(f"SELECT '{k}' AS kernel, image_id, y, x, gray FROM {k}" for k in _EACH)})
SELECT image_id, kernel, cast(max(x) + 1 AS int) AS w, cast(max(y) + 1 AS int) AS h, cast(sum(gray) AS bigint) AS total, cast(sum(gray * (y * 1000 + x + 1)) AS bigint) AS placed FROM every GROUP BY ALL"""
ORACLE_SQL["pixel_kernels"] = f"""{_KERNELS_SQL} SELECT image_id, y, x, b.gray AS blurred, s.gray AS sharpened, i.gray AS ink FROM gaussian5 b JOIN unsharp s USING (image_id, y, x) JOIN preprocess_full i USING (image_id, y, x)"""
ORACLE_SQL["prepared_images"] = f"""{_KERNELS_SQL},
m AS (SELECT image_id, avg(CASE WHEN l >= 245 THEN 1.0::double ELSE 0 END) AS hot, avg(l) AS mean FROM rgb GROUP BY 1),
told AS (SELECT *, CASE WHEN hot >= 0.04 THEN 'strong' WHEN hot >= 0.01 THEN 'mild' ELSE 'none' END AS level FROM m),
{_ink("mild", "soft", 7)},
pages AS (SELECT image_id, y, x, CASE level WHEN 'strong' THEN g.gray WHEN 'mild' THEN m.gray ELSE f.gray END AS gray FROM told JOIN gray g USING (image_id) JOIN mild m USING (image_id, y, x) JOIN preprocess_full f USING (image_id, y, x)),
strips AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN level <> 'strong' THEN s.gray WHEN hi - lo < 10 THEN b.gray ELSE {_ROUND("b.gray * (1 - 0.6::double) + floor((b.gray - lo)::double / (hi - lo) * 255 + 0.5) * 0.6::double")} END AS gray
  FROM told JOIN bottom_strip b USING (image_id) JOIN strip_soft s USING (image_id, y, x) JOIN strip_wide_ends USING (image_id)),
{_resized("zones", "strips", "strip_size")},
made AS (SELECT 'full' AS kernel, * FROM pages UNION ALL SELECT 'mrz', * FROM zones)
SELECT image_id, round(any_value(hot) + 1e-9, 6) AS hotspot_ratio, round(any_value(mean) + 1e-9, 6) AS mean_brightness, any_value(level) AS level,
  any_value(CASE WHEN level <> 'none' THEN 'glare_' || level WHEN mean < 55 THEN 'too_dark' ELSE 'ok' END) AS feedback,
  kernel, cast(max(x) + 1 AS int) AS w, cast(max(y) + 1 AS int) AS h, cast(sum(gray) AS bigint) AS total, cast(sum(gray * (y * 1000 + x + 1)) AS bigint) AS placed FROM made JOIN told USING (image_id) GROUP BY image_id, kernel"""

ORACLE_SQL["overlaps"] = f"""
WITH u AS (SELECT vec_id, k, embedding[4 * k + 1]::double AS a, embedding[4 * k + 2]::double AS b, embedding[4 * k + 3]::double AS c, embedding[4 * k + 4]::double AS d FROM embeddings, unnest(range(16)) t(k)),
best AS MATERIALIZED (SELECT vec_id // 125 AS image_id, cast(vec_id * 16 + k AS int) AS anchor_idx, 1 AS cls, 320 + 900 * a AS x1, 320 + 900 * b AS y1, 340 + 900 * a + 90 * abs(c) AS x2, 340 + 900 * b + 90 * abs(d) AS y2 FROM u)
SELECT a.image_id, a.cls, a.anchor_idx AS first, b.anchor_idx AS second, round({_INTER} / {_UNION}, 6) AS iou FROM best a JOIN best b ON a.image_id = b.image_id AND a.cls = b.cls AND a.anchor_idx < b.anchor_idx
WHERE {_UNION} > 0 AND {_INTER} / {_UNION} >= 0.5"""
_DASH = lambda c: f"coalesce(nullif({c}, ''), '—')"
_SHOWN_NAMES = lambda t, wide: ", ".join(f"'{label:<{wide}}' || {_DASH(f'{t}.{c}')}" for c, label in (("surname", "Фамилия:"), ("name", "Имя:"), ("patronymic", "Отчество:")))
_TEXT_OF = lambda c, most="": f"coalesce(nullif({f'substr({_TRIMMED(c)}, 1, {most})' if most else _TRIMMED(c)}, ''), '(пусто)')"
_TRIMMED = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
_ANCHOR = lambda part, body: f"(SELECT '\"{part}\":' || {body} FROM {part[0]}a g WHERE g.scan_id = r.scan_id)"
_NAMED_ANCHOR = "'{\"word\":\"' || g.word || '\",\"dist\":' || g.dist || ',\"rawWord\":\"' || g.raw || '\"}'"
_LAST_ANCHOR = "'{\"word\":\"' || g.raw || '\"' || CASE WHEN g.dist < 99 THEN ',\"dict\":\"' || g.word || '\"' ELSE '' END || '}'"
_ANCHORS = f"'{{' || concat_ws(',', {_ANCHOR('surname', _NAMED_ANCHOR)}, {_ANCHOR('name', _NAMED_ANCHOR)}, {_ANCHOR('patronymic', _LAST_ANCHOR)}) || '}}'"
ORACLE_SQL["diagnostic"] = f"""{ORACLE_SQL["resolve_passport"].rpartition("SELECT *, CASE")[0]}, texts AS (SELECT s.scan_id, coalesce(full_text, '') AS page, coalesce(mrz_text, '') AS zone FROM scans s LEFT JOIN ({X.MRZ}) z USING (scan_id))
SELECT scan_id, concat_ws(chr(10), '═══ Стратегия: ' || r.strategy || ' ═══', {_SHOWN_NAMES("r", 10)}, 'Дата рожд.: ' || {_DASH("r.dob")}, 'Confidence FIO: ' || f.confidence || '%', '',
  CASE WHEN mrz_found THEN 'MRZ: ✓ найдена' ELSE 'MRZ: ✗ не найдена' END, CASE WHEN r.strategy = 'onnx' OR f.strategy = 'latin' THEN '' ELSE 'Метки найдены: ' || {_ANCHORS} END, CASE WHEN r.strategy = 'onnx' THEN '' ELSE 'Стратегия FIO: ' || f.strategy END, '',
  '── Кандидаты OCR (' || CASE WHEN r.strategy = 'onnx' OR f.candidates = '' THEN 0 ELSE len(string_split(f.candidates, ' ')) END || ' слов) ──', CASE WHEN r.strategy = 'onnx' OR f.candidates = '' THEN '(нет)' ELSE replace(f.candidates, ' ', ', ') END, '',
  '── MRZ OCR (' || length(zone) || ' симв.) ──', {_TEXT_OF("zone")}, '', '── Full OCR (' || length(page) || ' симв.) ──', {_TEXT_OF("page", "1000")}) AS report,
  concat_ws(chr(10), CASE WHEN mrz_found THEN 'MRZ: ✓ найдена' ELSE 'MRZ: ✗ не найдена' END || ' (стратегия: ' || r.strategy || ')', {_SHOWN_NAMES("r", 12)}, '', '── MRZ OCR (' || length(zone) || ' симв.) ──', {_TEXT_OF("zone")}, '', '── Полный OCR (' || length(page) || ' симв.) ──', {_TEXT_OF("page")}) AS card,
  concat_ws(chr(10), 'Кроп вручную · FIO confidence: ' || f.confidence || '%', {_SHOWN_NAMES("f", 10)}, '', '── OCR текст (' || length(page) || ' симв.) ──', {_TEXT_OF("page", "500")}) AS region
FROM r JOIN fio f USING (scan_id) JOIN texts USING (scan_id)"""
