"""The corpus pipeline: stages over documents, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.decontaminate import contaminated
from trawl.llm.exchange import fresh, release, sized, stored
from trawl.llm.language import languages
from trawl.llm.lines import dedup_lines
from trawl.llm.packing import TOKENIZER, packed
from trawl.llm.simhash import near_duplicates

#: Bytes that a row of a single id takes in a broadcast table, amply.
ID_BYTES = 32


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text no language model accepts go, also those with a null or empty text.

    Each row is judged by itself, repeated ones and those with a null doc_id too; texts of any
    length are judged whole. An empty table stays empty. All columns are kept as they are.
    """
    names = [fresh(n, docs.columns) for n in ("_own_hash", "_bad_hash", "_bad_id")]
    own, bad_hash, bad_id = names
    bad = languages(docs).filter("not accepted").select(F.col("text_hash").alias(bad_hash), F.col("doc_id").alias(bad_id)).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    # A row goes if a row of its own id and text was rejected, which is itself or one like it.
    same = (F.col(own) == F.col(bad_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id))
    return hashed.join(sized(stored(bad, "rejected"), ID_BYTES), same, "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat another one, or nearly so, go; so does a document that has no other line. n_chars follows the text.

    Null and empty texts stay, and so do rows with a null doc_id. Rows that repeat a doc_id are one
    document. Texts of any length are compared line by line. An empty table stays empty.
    """
    left = dedup_lines(docs).filter("lines_removed = 0 or trim(text) <> ''")
    n_chars = F.when(F.col("lines_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the least doc_id; rows with a null doc_id stay as they are.

    Null and empty texts, and those without words, are groups of their own. Rows that repeat a
    doc_id stay or go together. An empty table stays empty.
    """
    gone = stored(near_duplicates(docs).filter(~F.col("keep")).select("doc_id"), "duplicates")
    return docs.join(sized(gone, ID_BYTES), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark, exactly or in proximity, go; rows with a null doc_id stay as they are.

    Items of fewer than 8 words are no evidence and remove nothing. Null and empty texts stay; texts
    of any length are searched whole. An empty table, or benchmark, leaves everything as it is.
    """
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = stored(contaminated(docs, tests).filter("kind <> 'short'").select("doc_id").distinct(), "contaminated")
    return docs.join(sized(gone, ID_BYTES), "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of equal capacity.

    Documents without tokens and rows with a null doc_id are in none; longer documents are cut.
    Rows that repeat a doc_id are packed each. An empty table gives no rows.
    """
    return packed(docs, tokenizer=TOKENIZER)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: None of the five operators can be written in SQL over whole tables; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table; each one's table is deleted once the next stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        former, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(former)
    return docs
