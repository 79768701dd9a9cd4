"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm.decontaminate import contaminated
from trawl.llm.html import page_texts
from trawl.llm.language import languages
from trawl.llm.licenses import licenses
from trawl.llm.lines import dedup_lines
from trawl.llm.packing import TOKENIZER, packed
from trawl.llm.repetition import repetition
from trawl.llm.simhash import near_duplicates
from trawl.llm.substrings import passages
from trawl.llm.urls import listed_keys, oracle, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), listed_keys(spark))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a path inherit along its directories; a table without paths has nothing to inherit by, and that stage is left out."""
    docs = _table(spark, sf_dir, "documents")
    return licenses(docs, path="path" if "path" in docs.columns else None)


QUERIES = {
    f.__name__: f
    for f in (op1_html, op2_language, op3_repetition, op4_simhash, op5_substrings, op6_packing, op7_urls, op8_decontamination, op9_lines, op10_licenses)
}
#: Only this one is within SQL's reach over whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = {"op7_urls": oracle()}
