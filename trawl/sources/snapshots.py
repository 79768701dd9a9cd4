"""Snapshots of a collection: Parquet segments of documents and deletes under a manifest that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.ordering import global_rank
from trawl.schema import schema_id
from trawl.sources import changelog
from trawl.sources.files import delete, exists, names, read_text, write_text

FORMAT = "trawl-snapshot-2"
#: Documents of a file of a segment; and the number of segments at which they are merged into one.
CHUNK, MERGE_AT = 5000, 10
_COLUMNS = ["doc_id", "op_id", "op", "raw", "images"]


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds `chunk`: documents in order of doc_id, so many a chunk; no partition ranks them all."""
    return global_rank(docs, "doc_id", "_rank").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def chunk_bounds(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, min_id, max_id, n)."""
    return chunked(docs, size).groupBy("chunk").agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count("*").alias("n"))


def _segment(rows: DataFrame, path: str, size: int = CHUNK) -> dict:
    """Writes changes (doc_id, op_id, op, raw, images), one a document, in order of doc_id and in files of so many; what is known of them comes from the files."""
    version = uuid.uuid4().hex
    rows.select(_COLUMNS).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", size).parquet(f"{path}/{version}")
    written = rows.sparkSession.read.schema(rows.select(_COLUMNS).schema).parquet(f"{path}/{version}")
    known = written.agg(F.count("*").alias("rows"), F.count_if(F.col("op") == changelog.DELETE).alias("deletes"), F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.coalesce(F.max("op_id"), F.lit(0)).alias("op_id")).first()
    return {"version": version} | known.asDict()


def _write_manifest(spark: SparkSession, path: str, spec: dict, segments: list[dict], op_id: int) -> dict:
    """The manifest goes over the former one in one step; then folders that neither it nor the former one names are deleted."""
    before = {s["version"] for s in manifest(spark, path)["segments"]} if exists(spark, f"{path}/manifest.json") else set()
    bounds = [s for s in segments if s["min_id"] is not None]
    out = {
        "format": FORMAT, "schema": spec, "schema_id": schema_id(spec), "segments": segments, "op_id": max([op_id, *(s["op_id"] for s in segments)]),
        "rows": sum(s["rows"] for s in segments), "min_id": min((s["min_id"] for s in bounds), default=None), "max_id": max((s["max_id"] for s in bounds), default=None),
    }
    write_text(spark, f"{path}/manifest.json", json.dumps(out, sort_keys=True))
    for name in set(names(spark, path)) - before - {s["version"] for s in segments}:
        if len(name) == 32:
            delete(spark, f"{path}/{name}")
    return out


def save(docs: DataFrame, path: str, spec: dict, op_id: int = 0) -> dict:
    """Writes documents (doc_id, raw, perhaps images and op_id) as the only segment, then the manifest that names it; readers see the old state or the new one."""
    rows = changelog.complete(docs).withColumn("op", F.lit(changelog.UPSERT))
    rows = rows if "op_id" in docs.columns else rows.withColumn("op_id", F.lit(op_id).cast("long"))
    return _write_manifest(docs.sparkSession, path, spec, [_segment(rows, path)], op_id)


def manifest(spark: SparkSession, path: str) -> dict:
    found = json.loads(read_text(spark, f"{path}/manifest.json"))
    if found.get("format") != FORMAT:
        raise ValueError(f"not a snapshot: {path}")
    return found


def changes(spark: SparkSession, path: str, found: dict | None = None) -> DataFrame:
    """(doc_id, op_id, op, raw, images) of all segments."""
    segments = (found or manifest(spark, path))["segments"]
    schema = "doc_id long, op_id long, op string, raw string, images map<string,binary>"
    return spark.read.schema(schema).parquet(*(f"{path}/{s['version']}" for s in segments)) if segments else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, deletes: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """(doc_id, raw, images, op_id): the documents of a snapshot, without deleted ids (doc_id), and after the changes of a log that follow it.

    A single segment without later changes is read as it is; more are folded by document.
    """
    m = manifest(spark, path)
    docs = changes(spark, path, m)
    if log is not None:
        docs = docs.unionByName(changelog.complete(log.filter(F.col("op_id") > m["op_id"])).select(docs.columns))
    if log is not None or len(m["segments"]) > 1:
        docs = changelog.latest(docs)
    docs = docs.filter(F.col("op") != changelog.DELETE).select("doc_id", "raw", "images", "op_id")
    return docs if deletes is None else docs.join(deletes.select("doc_id"), "doc_id", "left_anti")


def flush(spark: SparkSession, path: str, log: DataFrame, merge_at: int = MERGE_AT) -> dict:
    """Adds the log's later changes, folded, as a segment: work in proportion to them. At `merge_at` segments all become one."""
    m = manifest(spark, path)
    new = changelog.latest(log.filter(F.col("op_id") > m["op_id"]))
    segment = _segment(new, path)
    if not segment["rows"]:
        delete(spark, f"{path}/{segment['version']}")
        return m
    out = _write_manifest(spark, path, m["schema"], [*m["segments"], segment], m["op_id"])
    return merge(spark, path) if len(out["segments"]) >= merge_at else out


def merge(spark: SparkSession, path: str) -> dict:
    """All segments as one, each document's last change and deletes too, which replicas ask for; the former segments' files stay until the next manifest, for their readers."""
    m = manifest(spark, path)
    return _write_manifest(spark, path, m["schema"], [_segment(changelog.latest(changes(spark, path, m)), path)], m["op_id"])


def compact(spark: SparkSession, path: str, log: DataFrame, spec: dict | None = None) -> dict:
    """One segment that takes in the log's later changes."""
    m = manifest(spark, path)
    last = log.agg(F.max("op_id")).first()[0]
    return save(load(spark, path, log=log), path, spec or m["schema"], max(m["op_id"], last or 0))
