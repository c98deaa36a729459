"""A corpus from raw documents to packed sequences, in stages that hand Parquet tables on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idloom.llm.common import documents, release, scratch
from idloom.llm.exact_dedup import drop_exact_duplicates
from idloom.llm.language import known_language
from idloom.llm.near_dedup import drop_near_duplicates
from idloom.llm.packing import pack
from idloom.llm.pii import mask_pii
from idloom.llm.tokens import tokenizer_path


#: Bytes of words that a worker of the last stage keeps (twice): half of what packing alone takes, beside the heaps of earlier stages.
CACHE_BYTES = 40 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or less sure of one than calibrated, go.

    A null or empty text, or one without letters, has no language. The model learns from the rows of docs that have a
    lang; without any all documents go. All columns stay, whatever their names; rows that share a doc_id, or have none,
    are judged one by one; an empty table gives an empty one.
    """
    return known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the document with the largest doc_id stays.

    Of equal rows one stays; a null doc_id is the smallest. All columns stay; an empty table gives an empty one.
    """
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the smallest doc_id stays.

    doc_id must be a whole number, or text of one. Texts without words, and rows without a doc_id, are linked with nothing and stay. Rows that share a doc_id are one
    document, which stays or goes as a whole. All columns stay; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs, shingle=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, and n_chars counts the new text.

    Null and empty texts stay as they are; all rows and columns stay; an empty table gives an empty one.
    """
    return mask_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null as empty) in sequences of 1024: one row per piece, as packing.pack gives them.

    Repeated rows and rows without a doc_id are packed like any other; an empty table gives no rows.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, cache=CACHE_BYTES)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express most stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written and read again; the pieces of the last one.

    Once a stage is written, what it read of the shared folder goes, so that the result's table alone stays there.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, name)
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        release(made)
        docs = spark.read.parquet(path)
    return docs
