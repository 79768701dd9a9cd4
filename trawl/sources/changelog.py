"""The changelog of a collection: ordered upserts and deletes, appended as files and folded to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["op_id", "op", "doc_id", "raw", "images"]
SCHEMA = "op_id long, op string, doc_id long, raw string"
#: As stored: images' bytes travel by field beside the document, whose JSON text holds only what is known of them.
STORED = SCHEMA + ", images map<string,binary>"
UPSERT, DELETE = "upsert", "delete"
#: Names and codes of operations in logs of earlier layouts.
_LEGACY = {"1": UPSERT, "2": DELETE, "put": UPSERT, "index": UPSERT, "remove": DELETE, UPSERT: UPSERT, DELETE: DELETE}
LEAST_CHUNK, MOST_CHUNK = 1 << 10, 1 << 20


def complete(rows: DataFrame) -> DataFrame:
    """Rows with a column `images`, which documents without any may lack."""
    return rows if "images" in rows.columns else rows.withColumn("images", F.lit(None).cast("map<string,binary>"))


def append(changes: DataFrame, path: str) -> None:
    """Adds changes (op_id, op, doc_id, raw, perhaps images) to the log; a file is visible whole or not at all."""
    complete(changes).select(COLUMNS).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """The log, or its changes after an op_id; the bound reaches the files' statistics."""
    log = spark.read.schema(STORED).parquet(path)
    return log if after is None else log.filter(F.col("op_id") > after)


def latest(changes: DataFrame) -> DataFrame:
    """(doc_id, op_id, op, raw, images): the last change of each document, also if it is a delete.

    Replaying a change twice, or in another order, gives the same.
    """
    every = complete(changes).select("doc_id", F.struct("op_id", "op", "raw", "images").alias("c"))
    last = every.groupBy("doc_id").agg(F.max_by("c", F.struct(F.col("c.op_id"), F.col("c.op") == DELETE)).alias("c"))
    return last.select("doc_id", "c.op_id", "c.op", "c.raw", "c.images")


def fold(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(doc_id, op_id, raw, images): each document after its latest change; deleted ones are gone.

    Changes of a base state (doc_id, op_id, raw) count as earlier upserts.
    """
    if base is not None:
        names = ["doc_id", "op_id", "op", "raw", "images"]
        changes = complete(changes).select(names).unionByName(complete(base).withColumn("op", F.lit(UPSERT)).select(names))
    return latest(changes).filter(F.col("op") != DELETE).drop("op")


def replayable(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) changes: a known operation with ids, and a JSON document where it upserts."""
    ok = F.col("op_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("op").isin(UPSERT, DELETE)
    ok &= (F.col("op") == DELETE) | F.try_parse_json("raw").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return changes.filter(ok), changes.filter(~ok)


def migrate(old: DataFrame) -> DataFrame:
    """A log of an earlier layout (numbered or otherwise named operations, `doc` for raw) in the present one."""
    raw = next(c for c in ("raw", "doc", "payload") if c in old.columns)
    names = F.create_map(*(F.lit(x) for pair in _LEGACY.items() for x in pair))
    return old.select(F.col("op_id").cast("long"), F.get(F.transform(F.array(F.lower(F.col("op").cast("string"))), lambda o: names[o]), F.lit(0)).alias("op"), F.col("doc_id").cast("long"), F.col(raw).cast("string").alias("raw"))


def chunk(log: DataFrame, offset: int, limit: int = 1 << 16) -> DataFrame:
    """(op_id, op, doc_id, data, crc): changes after the offset for shipping, as hexadecimal JSON with its CRC-32, in all about `limit` bytes (1 KB to 1 MB)."""
    limit = min(MOST_CHUNK, max(LEAST_CHUNK, limit))
    body = F.to_json(F.struct(*(c for c in COLUMNS if c in log.columns)))
    # Every change takes more than 16 bytes, so the running size needs only so many rows.
    head = log.filter(F.col("op_id") > offset).orderBy("op_id").limit(limit // 16 + 1).withColumn("_body", body)
    before = F.coalesce(F.sum(F.octet_length("_body")).over(Window.orderBy("op_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("_before", before).filter(F.col("_before") < limit).select("op_id", "op", "doc_id", F.lower(F.hex("_body")).alias("data"), F.lpad(F.lower(F.hex(F.crc32("_body"))), 8, "0").alias("crc"))


def trim(spark: SparkSession, path: str, through: int) -> list[str]:
    """Deletes the log's files all of whose changes are no later than an op_id, which a segment holds by then; returns them."""
    from trawl.sources.files import delete

    ends = read(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.max("op_id").alias("last")).filter(F.col("last") <= through)
    gone = [r["file"] for r in ends.select("file").collect()]  # a row a file of the log
    for file in gone:
        delete(spark, file)
    return gone
