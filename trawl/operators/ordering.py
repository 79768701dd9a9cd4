"""Top-k and global ranks without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.sources.scratch import stored


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no column has it; Spark compares names without case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def top_k(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best hits (doc_id, score): score descending, doc_id ascending. Scores are rounded first, so equal ones tie in every engine."""
    return hits.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k)


def best(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The hits of top_k with their full scores, for further arithmetic."""
    return hits.orderBy(F.desc(F.round("score", digits)), "doc_id").limit(k)


def page(hits: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start .. start+size of ranked hits, with their rank from 1. Hits are a top-k, so one partition ranks them."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter((F.col("rank") > start) & (F.col("rank") <= start + size))


def global_rank(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """Adds each row's rank from 1 in ascending order of a unique column.

    Rows are range-partitioned, sorted and written once, with their partition and place; counts,
    offsets and ranks all come from that table, so every row has one rank whatever is planned or
    run again. The partitions' counts, a row each, give the offsets; no partition sees all rows.
    """
    at = fresh("_at", [*df.columns, name])
    placed = stored(df.repartitionByRange(by).sortWithinPartitions(by).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part, own = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg((F.max(own) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row a partition
    ranked = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return ranked.withColumn(name, (own + F.col("_before") + 1).cast("long")).select(*(c for c in df.columns if c != name), name)
