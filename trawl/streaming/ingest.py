"""Streaming ingest: a changelog that arrives as files, folded batch by batch into the segments of a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.sources import changelog
from trawl.sources.changelog import latest
from trawl.sources.files import delete, exists, read_text, write_text

#: Segments at which a batch merges them into one.
MERGE_AT = 10
_STATE = "doc_id long, op_id long, op string, raw string, images map<string,binary>"


def changes(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The changelog as a stream; files_per_trigger bounds a batch, as backpressure."""
    return spark.readStream.schema(changelog.STORED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _current(spark: SparkSession, target: str) -> dict:
    """Names of the segments in force, of those they replaced, and the last batch."""
    return json.loads(read_text(spark, f"{target}/current.json")) if exists(spark, f"{target}/current.json") else {"segments": [], "former": [], "batch": -1}


def _read(spark: SparkSession, target: str, segments: list[str]) -> DataFrame:
    return spark.read.schema(_STATE).parquet(*(f"{target}/{s}" for s in segments)) if segments else spark.createDataFrame([], _STATE)


def state(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, op_id, op, raw, images) after all batches so far; tombstones are kept so that late changes can't revive a document."""
    return latest(_read(spark, target, _current(spark, target)["segments"]))


def documents(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, op_id, raw, images) of the documents that exist."""
    return state(spark, target).filter(F.col("op") != changelog.DELETE).drop("op")


def fold_batch(target: str, merge_at: int = MERGE_AT):
    """A foreachBatch function that writes each batch's last changes as a segment, then names it in the table's state.

    Work follows the batch, not the table; every `merge_at` segments are merged into one. A batch
    that runs again after a failure overwrites its own segment, and changes are ordered by op_id,
    so every change counts once whatever is repeated. Segments that were merged stay until the
    next merge, for their readers.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = _current(spark, target)
        if batch_id <= now["batch"]:
            return
        good, _ = changelog.replayable(batch)
        columns = ["doc_id", "op_id", "op", "raw", "images"]
        latest(good).select(columns).write.mode("overwrite").parquet(f"{target}/v{batch_id}")
        segments, former = [*now["segments"], f"v{batch_id}"], now["former"]
        if len(segments) >= merge_at:
            latest(_read(spark, target, segments)).select(columns).write.mode("overwrite").parquet(f"{target}/m{batch_id}")
            for old in former:
                delete(spark, f"{target}/{old}")
            segments, former = [f"m{batch_id}"], segments
        write_text(spark, f"{target}/current.json", json.dumps({"segments": segments, "former": former, "batch": batch_id}))

    return fold


def start(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True, files_per_trigger: int = 64) -> StreamingQuery:
    """Follows a changelog folder into the table at target."""
    writer = changes(spark, source, files_per_trigger).writeStream.foreachBatch(fold_batch(target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
