"""Check-in rosters and staff lists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions.text import CUSTOM, first_set, format_date_iso, full_name

PARTS = ("surname", "name", "patronymic")
PENDING = "— ожидает данных —"


def resolve_specialty(specialty: Column, custom: Column) -> Column:
    return F.when(specialty == CUSTOM, first_set(custom)).otherwise(first_set(specialty))


def build_roster(persons: DataFrame, least: int = 2) -> DataFrame:
    """Rows numbered 1..n by id for each arrival date, with empty numbered rows up to `least`.

    A roster is one date's arrivals, so numbering is a window over each date.
    """
    date = first_set(F.col("arrival_date"))
    rows = persons.select(date.alias("d"), "id", *(first_set(F.col(p)).alias(p) for p in PARTS), resolve_specialty(F.col("specialty"), F.col("custom_specialty")).alias("specialty"))
    numbered = rows.withColumn("no", F.row_number().over(Window.partitionBy("d").orderBy("id"))).drop("id")
    counts = rows.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") < least)
    empty = counts.select("d", *(F.lit("").alias(p) for p in PARTS), F.lit("").alias("specialty"), F.explode(F.sequence((F.col("n") + 1).cast("int"), F.lit(least))).alias("no"))
    every = numbered.unionByName(empty)
    return every.select(F.col("d").alias("arrival_key"), "no", *PARTS, format_date_iso(F.col("d")).alias("arrival_date"), "specialty")


def roster_preview(persons: DataFrame) -> DataFrame:
    known = first_set(F.col("surname"), F.col("name")) != ""
    return persons.select("id", F.when(known, first_set(F.col("surname"))).otherwise(PENDING).alias("surname"), *(F.when(known, first_set(F.col(p))).otherwise("").alias(p) for p in PARTS[1:]), resolve_specialty(F.col("specialty"), F.col("custom_specialty")).alias("specialty"))


def roster_summary(persons: DataFrame) -> DataFrame:
    return persons.groupBy(first_set(F.col("arrival_date")).alias("arrival_key")).agg(F.count("*").alias("persons"), F.count_if(F.col("ocr_status") == "done").alias("done"))


def hire(staff: DataFrame, persons: DataFrame, added: str) -> DataFrame:
    """staff and all persons that have a surname or a name; nobody is looked for twice."""
    new = persons.where(first_set(F.col("surname"), F.col("name")) != "").select(F.col("id").cast("double").alias("sid"), *(first_set(F.col(p)).alias(p) for p in PARTS), first_set(F.col("phone")).alias("phone"), F.lit(added).alias("addedDate"))
    return staff.select(new.columns).unionByName(new)


def dismiss(staff: DataFrame, sids: DataFrame, key: str = "sid") -> DataFrame:
    return staff.join(sids.select(key), key, "left_anti")


def update_phone(staff: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change (sid, seq, phone) of each sid wins; unknown sids are ignored."""
    last = changes.groupBy("sid").agg(F.max_by("phone", "seq").alias("_p"))
    return staff.join(last, "sid", "left").withColumn("phone", F.coalesce("_p", "phone")).select(staff.columns)


def apply_person_patches(persons: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """patches(id, seq, field, value): the last value of each field overwrites; unknown ids are ignored."""
    of = lambda f: F.col("field") == f
    last = patches.groupBy("id").agg(*(F.max_by(F.when(of(f), F.struct("value")), F.when(of(f), F.col("seq"))).alias(f"_{f}") for f in fields))
    return persons.join(last, "id", "left").withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}).select(persons.columns)


def staff_list(staff: DataFrame) -> DataFrame:
    return staff.select("sid", first_set(full_name(*(F.col(p) for p in PARTS)), F.lit("—")).alias("full_name"), first_set(F.col("phone")).alias("phone"))


def staff_count(staff: DataFrame) -> DataFrame:
    return staff.agg(F.count("*").alias("staff"))
