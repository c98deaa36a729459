"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = "session_id bigint, ts timestamp, frame_id bigint, feedback string, mrz_text string"
STAFF = "array<struct<sid:double,surname:string,name:string,patronymic:string,phone:string,addedDate:string>>"
KINDS = ("s", "m", "f", "p")


def read_scans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """scan_id, full_text, mrz_text; failed recognition is an empty text. fmt text: one file is one full text."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.xxhash64("_metadata.file_path").alias("scan_id"), F.col("value").alias("full_text"), F.lit("").alias("mrz_text"))
    raw = spark.read.format(fmt).schema("scan_id bigint, full_text string, mrz_text string").load(path)
    return raw.select("scan_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("full_text", "mrz_text")))


def read_image_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Image files as they arrive in folders under path: path, content (and Spark's other columns of binary files)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(path)


def read_images(spark: SparkSession, path: str, fmt: str = "image") -> DataFrame:
    """Spark's image structs, or with fmt binaryFile the files' bytes."""
    return spark.read.format(fmt).load(path)


def read_fio_dict(spark: SparkSession, path: str) -> DataFrame:
    """kind, ord, entry of a JSON file of four lists; a missing or malformed file gives no rows."""
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in KINDS])
    try:
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        raw.schema  # noqa: B018
    except Exception as e:  # Spark's AnalysisException for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    lists = [raw.select(F.lit(k).alias("kind"), F.posexplode(k).alias("ord", "entry")) for k in KINDS]
    out = lists[0]
    for part in lists[1:]:
        out = out.unionByName(part)
    return out


def staff_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One row per entry of JSON arrays; malformed ones have none."""
    return df.select(F.inline(F.from_json(column, STAFF)))


def staff_to_json(staff: DataFrame) -> DataFrame:
    """All entries as one JSON array, by sid: a staff list of one house."""
    fields = ("sid", "surname", "name", "patronymic", "phone", "addedDate")
    return staff.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("json"))


def write_roster(roster: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder for each arrival date (DD.MM.YYYY, or `undated`)."""
    dated = roster.withColumn("arrival", F.coalesce(F.nullif(F.col("arrival_date"), F.lit("")), F.lit("undated")))
    dated.write.partitionBy("arrival").mode("overwrite").format(fmt).save(path)


def read_frames_stream(spark: SparkSession, path: str, files_per_batch: int = 100, schema: str = FRAMES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
