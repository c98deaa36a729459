"""Operators against goldens and brute force; registered queries against SQL."""

import random

import pytest
from pyspark.sql import functions as F

from idloom.operators import detections, fio, fuzzy, roster
from idloom.sources import io

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "entries", "want"),
    [
        ("ФАМИЛИЯ\nИВАН0В\nИМЯ\nПЕТР\nОТЧЕСТВО\nСИДОРОВИЧ", [("s", 0, "ИВАНОВ"), ("m", 0, "ПЕТР")], ("Иванов", "Петр", "Сидорович", 97, "anchor")),
        ("ПЕТРОВ\nИВАН\nСЕРГЕЕВИЧ", [], ("Петров", "Иван", "Сергеевич", 52, "positional")),
        ("KARIMOV\nJASUR\nBAHODIR OGLI", [], ("Karimov", "Jasur", "Ogli", 100, "latin")),
        ("ОТЧЕСТВО\nПЕТРОВИЧ\nXX", [("s", 0, "ПЕТРОВИЧ")], ("Петрович", "", "Петрович", 63, "anchor")),
        ("", [], ("", "", "", 0, "scan")),
        (None, [], ("", "", "", 0, "scan")),
    ],
)
def test_fio(spark, text, entries, want):
    scans = spark.createDataFrame([(1, text)], "scan_id bigint, full_text string")
    words = spark.createDataFrame(entries, "kind string, ord int, entry string")
    r = fio.extract_fio(scans, words).first()
    assert (r.surname, r.name, r.patronymic, r.confidence, r.strategy) == want


def test_fuzzy_is_exact(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("АБВ") for _ in range(rng.randint(1, 9)))
    entries, words = list(dict.fromkeys(word() for _ in range(300))), [word() for _ in range(300)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
        return out

    d = spark.createDataFrame([("s", i, e) for i, e in enumerate(entries)], "kind string, ord int, entry string")
    w = spark.createDataFrame([(x,) for x in words], "w string")
    for most in (1, 2, 3):
        want = {}
        for x in words:
            near = min((distance(x, e), i, e) for i, e in enumerate(entries))
            if near[0] <= most:
                want[x] = (near[2], near[0])
        for segments in (False, True):
            assert {r.w: (r.match, r.dist) for r in fuzzy.fuzzy_find(w, d, most, segments).collect()} == want


def test_suppression_keeps_the_best_box(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, *(float(rng.randint(20, 60)) for _ in range(4)), [rng.random() for _ in range(22)]) for i in range(90)]
    best = detections.best_class(spark.createDataFrame(rows, "image_id bigint, anchor_idx int, cx double, cy double, bw double, bh double, scores array<double>"))
    kept = detections.nms(best).groupBy("image_id", "field").agg(F.max("score").alias("conf"))
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in detections.best_box(best).select("image_id", "field", "conf").collect()}


def test_roster_has_two_rows(spark):
    schema = "id bigint, arrival_date string, surname string, name string, patronymic string, phone string, specialty string, custom_specialty string, ocr_status string"
    one = spark.createDataFrame([(1, "2024-01-02", "A", None, None, None, "__custom__", "x", "done")], schema)
    rows = sorted(tuple(r) for r in roster.build_roster(one).select("no", "surname", "specialty", "arrival_date").collect())
    assert rows == [(1, "A", "x", "02.01.2024"), (2, "", "", "02.01.2024")]
    assert roster.build_roster(one.limit(0)).count() == 0


def test_sources_and_sinks_round_trip(spark, tmp_path):
    scans = spark.createDataFrame([(1, "a", None), (2, None, "z")], "scan_id bigint, full_text string, mrz_text string")
    scans.write.parquet(str(tmp_path / "scans"))
    scans.write.json(str(tmp_path / "json"))
    for fmt, name in (("parquet", "scans"), ("json", "json")):
        assert sorted(tuple(r) for r in io.read_scans(spark, str(tmp_path / name), fmt).collect()) == [(1, "a", ""), (2, "", "z")]
    (tmp_path / "page.txt").write_text("line\nline", encoding="utf-8")
    assert [tuple(r)[1:] for r in io.read_scans(spark, str(tmp_path / "page.txt"), "text").collect()] == [("line\nline", "")]
    table = spark.createDataFrame([("05.03.2024", 1), ("", 1)], "arrival_date string, no int")
    io.write_roster(table, str(tmp_path / "roster"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "roster")).select("arrival", "no").collect()} == {("05.03.2024", 1), ("undated", 1)}


def test_suppression_equals_brute_force(spark):
    from idloom.plans import queries

    found = queries._best(spark, SF).collect()
    kept = set()
    for image, cls in {(r.image_id, r.cls) for r in found}:
        left = sorted((r for r in found if (r.image_id, r.cls) == (image, cls)), key=lambda r: (-r.score, r.anchor_idx))
        while left:
            a, *left = left
            kept.add((a.image_id, a.anchor_idx, a.cls))

            def over(b, a=a):
                w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
                both = max(0, w) * max(0, h)
                union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - both
                return both / union if union > 0 else 0

            left = [b for b in left if over(b) < detections.OVERLAP]
    got = detections.nms(queries._best(spark, SF)).collect()
    assert len({(r.image_id, r.anchor_idx, r.field) for r in got}) == len(kept)
    names = {f: c for c, f in detections.FIELDS.items()}
    assert {(r.image_id, r.anchor_idx, names[r.field]) for r in got} == kept


def test_page_fields_try_each_pattern_once(spark):
    from idloom.plans import queries

    plan = queries.q_visual_passport(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 8 and plan.count("regexp_extract_all(") == 2 and plan.count("regexp_extract(") == 1


def test_names_need_no_python(spark):
    from idloom.plans import queries

    found = queries.q_fio(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    anchors = [a.split(":") for r in found.collect() for a in r.anchors.split()]
    assert {a[2] for a in anchors if len(a) == 4} >= {"0", "1", "99"}


def test_frequent_words_beyond_the_broadcast(spark, monkeypatch):
    """The way that shuffles matches, and broadcasts those of frequent words only, gives the same names."""
    from idloom.plans import fixtures

    scans, names = fixtures.table(spark, SF, "SCANS"), fixtures.table(spark, SF, "NAMES")
    few = sorted(map(repr, fio.extract_fio(scans, names).collect()))
    monkeypatch.setattr(fio, "MATCH_BYTES", 0)
    monkeypatch.setattr(fio, "FREQUENT", 5)
    assert sorted(map(repr, fio.extract_fio(scans, names).collect())) == few


def test_mrz_plan_reads_lines_once(spark):
    from idloom.plans import queries

    plan = queries.q_parse_mrz(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 5 and plan.count("rpad(l") <= 4


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"s": ["А", "Б"], "m": [], "f": ["В"]}', encoding="utf-8")
    assert sorted(tuple(r) for r in io.read_fio_dict(spark, str(tmp_path / "d.json")).collect()) == [("f", 0, "В"), ("s", 0, "А"), ("s", 1, "Б")]
    assert io.read_fio_dict(spark, str(tmp_path / "none.json")).count() == 0
    staff = io.staff_from_json(spark.createDataFrame([('[{"sid": 1, "surname": "A"}]',), ("oops",)], "json string"))
    assert [(r.sid, r.surname) for r in staff.where("sid is not null").collect()] == [(1.0, "A")]
    assert '"surname":"A"' in io.staff_to_json(staff.where("sid is not null")).first().json


def test_queries_match_sql(spark):
    import duckdb

    from idloom.plans.oracle import ORACLE_SQL
    from idloom.plans.queries import QUERIES

    db = duckdb.connect()
    db.execute("set temp_directory = ''")
    for t in ("customer", "part", "events", "embeddings", "documents"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        found = QUERIES[name](spark, SF)
        q = db.execute(sql)
        names = [c[0] for c in q.description]
        assert sorted(names) == sorted(found.columns), name
        shown = lambda names, rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))]) for r in rows)
        assert shown(found.columns, map(tuple, found.collect())) == shown(names, q.fetchall()), name
