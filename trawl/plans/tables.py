"""The driver's tables as collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.index import SearchIndex
from trawl.operators.relations import Collection
from trawl.schema import IndexSchema
from trawl.sources.files import state
from trawl.sources.scratch import place

#: Hints of the query that the boost query runs: long French documents suit it well, other long ones less.
HINTED, LONG = "the of", 5000

DOCUMENTS = IndexSchema.parse(
    {
        "fields": {
            "text": "text",
            "lang": {"type": "text", "searchable": False},
            "source": {"type": "text", "searchable": False},
            "tags": {"type": "array", "searchable": False},
            "n_chars": "number",
            "quality": "number",
            "flag": "bool",
        }
    }
)
HINTS = IndexSchema.parse({"fields": {"text": "text", "hints": "query_values"}})
VECTORS = IndexSchema.parse({"fields": {"vec": {"type": "vector", "dim": 64}}})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The documents without a saved index."""
    return SearchIndex(table(spark, sf_dir, "documents"), DOCUMENTS)


_saved: dict[tuple[str, str], str] = {}


def saved(index: SearchIndex, sf_dir: str) -> SearchIndex:
    """The collection with the saved index of the documents' text, which is built by the first search of a session and again when the table has changed."""
    spark = index.docs.sparkSession
    key = (spark.sparkContext.applicationId, state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _saved:
        path = place(spark, "index")
        documents(spark, sf_dir).save(path)
        _saved[key] = path
    return index.opened(_saved[key])


def searched(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return saved(documents(spark, sf_dir), sf_dir)


def labelled(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """Documents with the flag and quality of their labels, and tags."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"), (F.max("toxic") == 1).alias("flag"))
    return saved(SearchIndex(docs.join(labels, "doc_id", "left").withColumn("tags", F.array("lang", "source")), DOCUMENTS), sf_dir)


def hinted(spark: SparkSession, sf_dir: str) -> SearchIndex:
    hint = lambda score: F.array(F.struct(F.lit(HINTED).alias("query"), F.lit(score).alias("score")))
    docs = table(spark, sf_dir, "documents")
    long = F.col("n_chars") > LONG
    return saved(SearchIndex(docs.withColumn("hints", F.when(long & (F.col("lang") == "fr"), hint(0.75)).when(long, hint(0.25))), HINTS), sf_dir)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def collections(spark: SparkSession, sf_dir: str) -> dict[str, Collection]:
    t = lambda name: table(spark, sf_dir, name)
    return {
        "region": Collection("region", t("region"), "r_regionkey"),
        "nation": Collection("nation", t("nation"), "n_nationkey", "n_regionkey", "region"),
        "customer": Collection("customer", t("customer"), "c_custkey", "c_nationkey", "nation"),
        "supplier": Collection("supplier", t("supplier"), "s_suppkey", "s_nationkey", "nation"),
        "part": Collection("part", t("part"), "p_partkey"),
        "orders": Collection("orders", t("orders"), "o_orderkey", "o_custkey", "customer"),
        "lineitem": Collection("lineitem", t("lineitem"), "l_orderkey", "l_orderkey", "orders"),
    }
