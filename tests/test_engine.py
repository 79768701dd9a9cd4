"""Ranking, documents, references, storage and streaming on the fixtures, with closed-form scores."""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from trawl.functions.text import ascii_lower, crc32_hex, from_base64, term_counts, term_frequency, to_base64, tokenize, tokens
from trawl.operators import ann, documents, filters, rank, relations
from trawl.operators import index as index_module
from trawl.operators.index import SearchIndex
from trawl.operators.ordering import global_rank
from trawl.operators.search import search
from trawl.schema import IndexSchema, schema_id
from trawl.sources import changelog, files, snapshots
from trawl.sources.catalog import Catalog, Settings
from trawl.streaming import ingest

SPEC = {
    "fields": {
        "title": "text", "body": "text", "tags": "array", "labels": "array", "flag": "bool", "priority": "number", "vec": {"type": "vector", "dim": 3},
    }
}
DEMO = [
    {"title": "Doc1", "body": "quick brown fox jumps over the lazy dog", "tags": ["animal", "fast"], "labels": ["short"], "flag": True, "priority": 5, "vec": [1, 0, 0], "parent": {"id": "sku-1", "index": "related"}},
    {"title": "Doc2", "body": "fast red fox leaped high", "tags": ["animal"], "labels": ["medium"], "flag": False, "priority": 3, "vec": [0.9, 0.1, 0], "parent": {"id": "sku-1", "index": "related"}},
    {"title": "Doc3", "body": "sleepy dog rests quietly", "tags": ["animal", "sleep"], "labels": ["short"], "flag": True, "priority": 1, "vec": [0, 1, 0], "parent": {"id": "sku-2", "index": "related"}},
]


def collection(spark, docs, spec):
    schema = IndexSchema.parse(spec)
    rows = spark.createDataFrame([(i + 1, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, raw string")
    return SearchIndex(documents.typed(rows, schema), schema)


@pytest.fixture(scope="module")
def demo(spark):
    return collection(spark, DEMO, SPEC)


def scores(hits):
    return {r["doc_id"]: r["score"] for r in hits.collect()}


def test_statistics(demo):
    assert [r["doc_len"] for r in demo.lengths().orderBy("doc_id").collect()] == [12, 8, 8]
    assert demo.corpus().first()["avgdl"] == pytest.approx(28 / 3)


@pytest.mark.parametrize(
    ("mode", "query", "want"),
    [
        ("bm25", "quick fox", {1: 1.285548}), ("or", "quick fox", {1: 1.285548, 2: 0.502294}), ("lexical", "quick fox", {1: 2.0}), ("semantic", "quick fox", {1: 1.0, 2: 0.432137}),
        ("bm25", "fox", {2: 0.502294, 1: 0.416459}), ("bm25", "fox fox", {2: 1.004588, 1: 0.832918}), ("bm25", "fox absent", {}), ("bm25", "", {}), ("phrase", "RED fox", {2: 1.0}), ("phrase", "dog animal", {1: 1.0}),
        ("unknown", "quick fox", {1: 1.285548}), ("semantic", "absent", {}),
    ],
)
def test_scores(demo, mode, query, want):
    assert scores(rank.rank(demo, query, 10, mode)) == pytest.approx(want, abs=1e-6)


def test_hybrid_fuzzy_and_vector(demo):
    assert scores(rank.rank(demo, "quick fox", 10, "hybrid", weights=(0.7, 1.2, 0.4))) == pytest.approx({1: 2.899884, 2: 0.518565}, abs=1e-6)
    assert list(scores(rank.rank(demo, "quik", 10, "fuzzy", distance=2))) == [1]
    assert scores(rank.rank(demo, "fox dog", 10, "fuzzy", distance=0)) == scores(rank.rank(demo, "fox dog", 10))
    assert scores(rank.top_k(rank.vector(demo, [1, 0, 0]), 10)) == pytest.approx({1: 1.0, 2: 0.993884, 3: 0.0}, abs=1e-6)
    assert scores(rank.vector(demo, [1, 0])) == scores(rank.vector(demo, [0, 0, 0])) == {}


def test_without_declared_fields_all_strings_count(spark):
    index = collection(spark, [{"a": "quick fox", "n": 5, "deep": [{"b": "brown \"dog\""}, "end"]}, {"quick": "slow"}], {})
    assert scores(rank.rank(index, "quick dog end", 10)).keys() == {1} and scores(rank.rank(index, "slow", 10)).keys() == {2}
    assert scores(rank.rank(index, "deep", 10)) == {}


def test_stored_index_scores_alike(spark, demo, tmp_path):
    demo.save(str(tmp_path))
    opened = demo.opened(str(tmp_path))
    for mode in ("bm25", "or", "lexical", "semantic", "hybrid", "fuzzy"):
        assert scores(rank.rank(opened, "quick fox dog", 10, mode)) == pytest.approx(scores(rank.rank(demo, "quick fox dog", 10, mode)))


def test_long_queries_take_the_other_way(demo):
    terms = [f"t{i}" for i in range(40)]
    a, b = rank.query_terms("quick fox"), rank.query_terms("quick fox " + " ".join(terms))
    assert scores(rank.bm25_terms(demo, b, every=False)) == pytest.approx(scores(rank.bm25_terms(demo, a, every=False)))
    assert scores(rank.bm25_terms(demo, b)) == {}


def test_filters_and_pages(demo):
    def ids(mode="post", **params):
        hits, total = search(demo, params, mode)
        return [r["doc_id"] for r in hits.orderBy("rank").collect()], total.first()["total"]

    assert ids(q="fox", tag="animal", label="short", flag="true", filter_priority_min="1", filter_priority_max="6") == ([1], 1)
    assert ids(q="fox", range_field="title") == ([], 0) and ids(q="fox", range_field="priority", range_min="4", range_max="x") == ([1], 1)
    assert ids(q="fox", filter_title="Doc2", filter_tags="animal", filter_flag="no") == ([2], 1)
    assert ids(q="animal", size=1, label="short") == ([], 0) or ids(q="animal", size=1, label="short") == ([3], 1)
    post, pre = ids(q="animal", size=2, label="short")[0], ids("pre", q="animal", size=2, label="short")[0]
    assert set(post) <= set(pre) == {1, 3}
    assert ids(q="animal", **{"from": 1, "size": 1})[0] == ids(q="animal")[0][1:2]
    with pytest.raises(ValueError):
        ids(q="fox", filter_priority="x")
    assert ids(mode="post", q="", vec="1,0,0") == ([], 0)
    assert search(demo, {"mode": "vector", "vec": "1,0,0", "size": 1})[0].first()["doc_id"] == 1


@pytest.mark.parametrize(("name", "value", "want"), [("size", "0", 1), ("size", "9999", 500), ("size", "x", 10), ("from", "-3", 0), ("distance", "2abc", 2), ("max_relation_depth", None, 1), ("ann_probes", "300", 256)])
def test_bounds(name, value, want):
    assert filters.bounded(name, value) == want


def test_hints(spark):
    spec = {"fields": {"title": "text", "version": {"type": "number", "searchable": False}, "queries": "query_values"}}
    index = collection(spark, [{"title": "Versioned", "version": 1, "queries": [{"query": "yt", "score": 1.0}, {"query": "", "score": 1}]}, {"title": "yt clone"}, {"title": "other"}], spec)
    assert scores(rank.rank(index, "yt", 10))[1] == 10.0 and set(scores(rank.rank(index, "yt", 10))) == {1, 2}
    assert set(scores(rank.rank(index, "YT", 10))) == {2}
    assert scores(rank.rank(index, "1", 10)) == {}
    hidden = collection(spark, [{"title": "plain", "queries": [{"query": "boostme", "score": 1.0}]}], {"fields": {"title": "text", "queries": {"type": "query_values", "searchable": False}}})
    assert scores(rank.rank(hidden, "boostme", 10)) == {}
    tags = collection(spark, [{"tags": ["foo"], "title": "hidden tags"}], {"fields": {"tags": {"type": "array", "searchable": False}, "title": "text"}})
    assert scores(rank.rank(tags, "foo", 10)) == {}
    assert documents.stored_match(tags.docs, "tags", "foo").count() == 1


def test_validation(spark):
    spec = {"fields": {"t": "text", "a": "array", "b": "bool", "n": "number", "v": {"type": "vector", "dim": 2}, "q": "query_values", "i": {"type": "image", "max_kb": 1}}, "relation": {"field": "parent", "target_index": "x", "allow_cross_index": False}}
    big = base64.b64encode(b"0" * 1025).decode()
    cases = [
        ({}, True), ({"t": "x", "a": ["p"], "b": False, "n": 1.5, "v": [1, 2, 3], "q": [{"query": "s", "score": 1}], "other": {"k": 1}}, True), ({"t": 1}, False), ({"t": None}, False), ({"a": "p"}, False), ({"a": ["p", 1]}, False), ({"a": []}, True),
        ({"b": 1}, False), ({"n": "1"}, False), ({"v": [1]}, False), ({"v": "x"}, False), ({"q": [{"query": "s", "score": 2}]}, False), ({"q": [{"query": 1, "score": 1}]}, False), ({"i": {"format": "png", "content": "aGk="}}, True), ({"i": {"format": "png"}}, False),
        ({"i": {"content": big}}, False), ({"parent": "1"}, True), ({"parent": 7}, True), ({"parent": {"id": "1", "index": "x"}}, True), ({"parent": {"id": "1"}}, True), ({"parent": {"id": "1", "index": "other"}}, False), ({"parent": True}, False), ({"parent": None}, True),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)] + [(100, "not json"), (101, "[1]")], "ordinal long, raw string")
    good, bad = documents.bulk(df, IndexSchema.parse(spec))
    assert {r["ordinal"] for r in good.collect()} == {i for i, (_, ok) in enumerate(cases) if ok}
    assert bad.count() == len(cases) + 2 - good.count()
    first = min(i for i, (_, ok) in enumerate(cases) if not ok)
    assert {r["ordinal"] for r in documents.bulk(df, IndexSchema.parse(spec), continue_on_error=False)[0].collect()} == set(range(first))


def test_stored_match(spark):
    docs = spark.createDataFrame([(1, '{"v": 1, "q": [{"query": "a", "score": 1.0}], "s": "1", "o": {"b": 1, "a": 2}}'), (2, '{"v": 1.0, "s": 1, "l": [1, "x", null]}'), (3, "{}"), (4, None)], "doc_id long, raw string")
    ids = lambda f, v: {r["doc_id"] for r in documents.stored_match(docs, f, v).collect()}
    assert ids("v", 1) == {1, 2} and ids("s", "1") == {1} and ids("s", 1) == {2} and ids("l", "x") == {2} and ids("q", {"query": "a", "score": 1.0}) == {1}
    assert ids("o", {"a": 2, "b": 1}) == {1} and ids("none", 1) == set()


def test_catalog_life_cycle(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"))
    spec = SPEC | {"relation": {"field": "parent", "target_index": "related"}}
    related = {"fields": {"title": "text", "body": "text", "sku": "text"}, "doc_id": {"field": "sku", "type": "string"}}
    assert cat.create_index("demo", spec) and cat.create_index("related", related) and not cat.create_index("demo", spec) and not cat.create_index("", spec)
    assert cat.indexes() == ["demo", "related"] and len(cat.registry()) == 2
    batch = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DEMO)] + [(3, '{"title": 5}')], "ordinal long, raw string")
    done, bad = cat.bulk("demo", batch)
    assert [(r["ordinal"], r["doc_id"]) for r in done.orderBy("ordinal").collect()] == [(0, 1), (1, 2), (2, 3)] and bad.count() == 1
    for sku in ("sku-1", "sku-2"):
        cat.index_document("related", {"title": f"Parent {sku}", "body": "root node", "sku": sku})
    with pytest.raises(ValueError):
        cat.index_document("related", {"title": "again", "sku": "sku-1"})
    assert cat.lookup("related", "sku-2") == 2 and cat.external_id("related", 2) == "sku-2" and cat.lookup("related", "nothing") is None
    assert scores(cat.search("demo", {"q": "quick fox"})[0]) == pytest.approx({1: 1.285548}, abs=1e-6)

    created = cat.get_document("demo", 2)
    assert cat.update_document("demo", 2, {"title": "patched"}, partial=True) and not cat.update_document("demo", 99, {})
    after = cat.get_document("demo", 2)
    assert after["title"] == "patched" and after["body"] == created["body"] and after["_updated_at"] >= created["_updated_at"] and after["_created_at"] == created["_created_at"]
    with pytest.raises(ValueError):
        cat.update_document("demo", 2, {"title": 5}, partial=True)
    with pytest.raises(ValueError):
        cat.update_document("related", 2, {"sku": "sku-1"}, partial=True)
    assert cat.update_document("related", 1, {"title": "Parent A", "sku": "sku-1", "body": "root node"})

    cat.put_view("tree", {"base_index": "demo", "select": ["title"], "relations": [{"name": "up", "field": "parent_id", "target_index": "related", "select": ["title"]}]} | {"relations": []})
    with pytest.raises(ValueError):
        cat.put_view("bad", {"base_index": "missing"})
    assert cat.views() == ["tree"] and [r["title"] for r in cat.run_view("tree", {"q": "dog"}).orderBy("rank").collect()] == ["Doc3", "Doc1"]

    assert cat.delete_document("demo", 3) and not cat.delete_document("demo", 3)
    assert cat.document_count("demo") == 2 and cat.recover("demo").count() == 2
    before = sorted(map(tuple, cat.documents("demo").collect()))
    cat.flush("demo")
    assert sorted(map(tuple, cat.documents("demo").collect())) == before
    assert cat.index_document("demo", {"title": "new"}) == 4
    assert {r["index"]: r["documents"] for r in cat.stats().collect()} == {"demo": 3, "related": 2}
    assert 'trawl_documents{index="demo"} 3' in cat.metrics()
    plan = cat.shipping_plan()
    assert plan["indexes"]["demo"]["last_op"] == 6
    body = cat.changes("demo", 5).first()
    assert f"{zlib.crc32(bytes.fromhex(body['data'])):08x}" == body["crc"]

    cat.save_snapshot(str(tmp_path / "copy"))
    other = Catalog(spark, str(tmp_path / "other"))
    assert other.load_snapshot(str(tmp_path / "copy")) == ["demo", "related"]
    assert scores(other.search("demo", {"q": "fox"})[0]) == scores(cat.search("demo", {"q": "fox"})[0])
    assert other.views() == ["tree"] and other.remove_view("tree") and not other.remove_view("tree")


def test_images(spark):
    schema = IndexSchema.parse({"fields": {"icon": {"type": "image", "max_kb": 4}}})
    data = bytes(range(200))
    df = spark.createDataFrame([(1, json.dumps({"icon": {"format": "png", "content": base64.b64encode(data).decode()}})), (2, "{}")], "doc_id long, raw string")
    out = documents.prepared(df, schema, F.lit(5).cast("long"))
    meta = json.loads(out.filter("doc_id = 1").first()["raw"])
    assert meta == {"icon": {"format": "png", "bytes": 200, "hash": f"{zlib.crc32(data):08x}"}, "_created_at": 5, "_updated_at": 5}
    assert [(r["doc_id"], base64.b64decode(r["content"])) for r in documents.image_base64(out, "icon").collect()] == [(1, data)]


def test_references(spark):
    def c(name, rows, schema, key, ref=None, to=None):
        return relations.Collection(name, spark.createDataFrame(rows, schema), key, ref, to)

    both = {"a": c("a", [(1, "x"), (2, None), (3, "missing")], "id long, b string", "id", "b", "b"), "b": c("b", [("x", "y"), ("y", "x")], "k string, next string", "k", "next", "b")}
    rows = {r["id"]: r for r in relations.inline(both["a"].docs, "a", both, 5).collect()}
    assert rows[2]["relation"] is None and rows[3]["relation"] is None and rows[3]["relation_ref"] == "missing"
    assert rows[1]["relation"]["id"] == "x" and rows[1]["relation"]["relation"]["id"] == "y" and rows[1]["relation"]["relation"]["relation"] is None
    assert "relation" not in relations.inline(both["a"].docs, "a", both, 0).columns
    ref = lambda raw: tuple(spark.range(1).select(relations.reference(F.lit(raw), "own", "target").alias("r")).first()["r"] or ())
    assert ref('"k"') == ("target", "k") and ref("7") == ("target", "7") and ref('{"id": 5, "index": "i"}') == ("i", "5") and ref('{"id": "z"}') == ("target", "z") and ref("null") == ()


def test_changelog(spark, tmp_path):
    ops = [(1, "upsert", 1, '{"a":1}'), (2, "upsert", 2, '{"a":2}'), (3, "delete", 1, None), (4, "upsert", 2, '{"a":3}'), (5, "upsert", 1, '{"a":4}'), (6, "upsert", 3, "broken"), (7, "what", 3, "{}")]
    log = spark.createDataFrame(ops, changelog.SCHEMA)
    good, bad = changelog.replayable(log)
    assert bad.count() == 2
    want = {1: '{"a":4}', 2: '{"a":3}'}
    state = lambda df: {r["doc_id"]: r["raw"] for r in df.collect()}
    assert state(changelog.fold(good)) == state(changelog.fold(good.unionAll(good))) == want
    old = spark.createDataFrame([(1, 1, 9, "{}"), (2, 2, 9, None)], "op_id int, op int, doc_id int, doc string")
    assert changelog.fold(changelog.migrate(old)).count() == 0
    snapshots.save(changelog.fold(good.filter("op_id <= 3")).select("doc_id", "raw"), str(tmp_path / "s"), {"fields": {}}, 3)
    assert state(snapshots.load(spark, str(tmp_path / "s"), log=good)) == want
    assert state(snapshots.load(spark, str(tmp_path / "s"), deletes=spark.createDataFrame([(2,)], "doc_id long"))) == {}
    snapshots.compact(spark, str(tmp_path / "s"), good)
    assert state(snapshots.load(spark, str(tmp_path / "s"))) == want


def test_streaming_fold(spark, tmp_path):
    source, target, point = (str(tmp_path / x) for x in ("log", "state", "checkpoint"))
    for batch in ([(1, "upsert", 1, "{}"), (2, "upsert", 2, "{}")], [(4, "upsert", 3, "{}"), (3, "delete", 1, None)], [(0, "upsert", 1, '{"late":1}')]):
        changelog.append(spark.createDataFrame(batch, changelog.SCHEMA).coalesce(1), source)
        ingest.start(spark, source, target, point).awaitTermination()
    assert {r["doc_id"] for r in ingest.documents(spark, target).collect()} == {2, 3}


def test_snapshot_chunks(spark):
    ids = spark.range(0, 23, 1, 5).select((F.col("id") * 3).alias("doc_id"))
    assert [tuple(r) for r in snapshots.chunk_bounds(ids, 10).orderBy("chunk").collect()] == [(0, 0, 27, 10), (1, 30, 57, 10), (2, 60, 66, 3)]
    assert [r["rank"] for r in global_rank(ids, "doc_id").orderBy("doc_id").collect()] == list(range(1, 24))


def test_schema():
    spec = {"fields": {"t": "text", "v": "vector", "i": "image", "x": "strange", "h": {"type": "text", "index": False}}}
    schema = IndexSchema.parse(spec)
    assert set(schema.fields) == {"t", "h"} and not schema.fields["h"].searchable
    assert IndexSchema.parse(schema.spec()).fields == schema.fields
    body = json.dumps({"fields": {"t": "text"}, "schema_version": 1}, separators=(",", ":"))
    assert schema_id({"fields": {"t": "text"}, "schema_id": "old"}) == f"{zlib.crc32(body.encode()):08x}"
    with pytest.raises(ValueError):
        IndexSchema.parse({"fields": {"a": {"type": "vector", "dim": 2}, "b": {"type": "vector", "dim": 2}}})


def test_inverted_lists_fall_back(spark):
    vecs = spark.createDataFrame([(i, [float(i == 0), float(i % 2), 1.0]) for i in range(10)], "doc_id long, vec array<double>")
    lists = ann.InvertedLists.build(vecs, 4)
    assert lists.search([1.0, 0.0, 0.0], 10, 1).count() == 10
    assert ann.InvertedLists.build(vecs.limit(0)).lists.count() == 0
    small = ann.neighbour_graph(vecs, 3, block=4)
    assert small.count() == 30 and {r["doc_id"] for r in small.collect()} == set(range(10))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_tokens_are_the_byte_tokenizer(spark, texts):
    def plain(t):
        out, run = [], b""
        for b in t.encode() + b" ":
            if chr(b).isalnum() and b < 128:
                run += bytes([b])
            elif run:
                out.append(run.decode().lower())
                run = b""
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", tokens(F.col("t")).alias("k"), term_frequency(F.col("t"), "a").alias("n"), ascii_lower(F.col("t")).alias("l")).collect():
        assert r["k"] == plain(r["t"]) == tokenize(r["t"]) and r["n"] == plain(r["t"]).count("a")
        assert r["l"] == "".join(c.lower() if c.isascii() else c for c in r["t"])


def test_base64_and_crc(spark):
    df = spark.createDataFrame([("aGVsbG8=",), ("aGVs bG8",), ("a",), ("",), ("!!aGk!",), (None,)], "c string")
    assert [bytes(r[0]) if r[0] is not None else None for r in df.select(from_base64(F.col("c"))).collect()] == [b"hello", b"hello", b"", b"", b"hi", None]
    row = spark.createDataFrame([(bytearray(b"123456789" * 30),)], "b binary").select(to_base64(F.col("b")), crc32_hex(F.col("b"))).first()
    assert row[0] == base64.b64encode(b"123456789" * 30).decode() and row[1] == f"{zlib.crc32(b'123456789' * 30):08x}"


@pytest.mark.parametrize("n", [200_000, 1_000_000])
def test_ids_of_large_batches_of_wide_rows(spark, n):
    rows = spark.range(0, n, 1, 16).select((F.hash("id").cast("long") * 4_000_000 + F.col("id")).alias("ordinal"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("raw"))
    out = documents.with_doc_ids(rows, 5)
    got = out.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.length("raw")).alias("chars")).first()
    assert tuple(got) == (n, n, 6, n + 5, 96 * n)
    assert n > 200_000 or out.select(F.lag("ordinal").over(Window.orderBy("doc_id")).alias("before"), "ordinal").filter("before > ordinal").count() == 0


def test_bulk_keeps_every_document(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.create_index("many", {"fields": {"body": "text"}})
    batch = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("ordinal"), F.to_json(F.struct(F.repeat(F.md5(F.col("id").cast("string")), 16).alias("body"))).alias("raw"))
    done, bad = cat.bulk("many", batch)
    assert done.agg(F.count("*"), F.count_distinct("doc_id"), F.max("doc_id")).first()[:] == (60_000, 60_000, 60_000) and bad.count() == 0
    assert cat.document_count("many") == 60_000
    plan = cat.shipping_plan()["indexes"]["many"]
    assert plan["manifest"]["op_id"] == plan["last_op"] == 60_000 and plan["log_bytes"] == 0  # over the bound, so it was flushed


def test_relations_images_and_views_of_stored_documents(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"), Settings(cluster_id="c1"))
    sites = {"fields": {"title": "text", "domain": "text", "favicon": {"type": "image", "max_kb": 4}}, "doc_id": {"field": "domain"}, "relation": {"field": "owner", "target_index": "owners"}}
    pages = {"fields": {"title": "text", "version": {"type": "number", "searchable": False}, "queries": "query_values"}, "relation": {"field": "site_ref", "target_index": "sites"}}
    assert cat.create_index("sites", sites) and cat.create_index("pages", pages) and cat.create_index("owners", {"fields": {"name": "text"}})
    icon = base64.b64encode(bytes(range(90))).decode()
    cat.index_document("owners", {"name": "Ann", "more": {"id": "x"}})
    cat.index_document("sites", {"title": "Videos", "domain": "video.example", "favicon": {"format": "png", "content": icon}, "owner": 1})
    refs = [{"id": "video.example", "index": "sites"}, "video.example", {"id": 1}, None, {"id": 1, "index": "owners"}, "lost"]
    cat.bulk("pages", spark.createDataFrame([(i, json.dumps({"title": f"page of clips {i}", "site_ref": ref, "extra": [i]})) for i, ref in enumerate(refs)], "ordinal long, raw string"))
    hits = cat.search("pages", {"q": "clips", "include_relations": "inline", "max_relation_depth": 2})[0].orderBy("doc_id").collect()
    assert [r["relation_ref"] and tuple(r["relation_ref"]) for r in hits] == [("sites", "video.example")] * 2 + [("sites", "1"), None, ("owners", "1"), ("sites", "lost")]
    assert [r["relation"] and json.loads(r["relation"]["doc"]).get("title") for r in hits] == ["Videos"] * 3 + [None, None, None]
    assert hits[0]["relation"]["doc_id"] == "video.example" and json.loads(hits[0]["relation"]["relation"]["doc"])["name"] == "Ann" and json.loads(hits[4]["relation"]["doc"])["name"] == "Ann"
    assert "relation" not in cat.search("pages", {"q": "clips"})[0].columns
    groups = cat.relation_groups("pages", {"q": "clips"}).orderBy("position").collect()
    assert sorted(len(g["children"]) for g in groups) == [1, 1, 1, 1, 2] and [g["n"] for g in groups if g["relation_ref"] is None] == [1]

    assert cat.image("sites", 1, "favicon") == icon and cat.image("sites", 1, "title") is None
    assert json.loads(hits[0]["relation"]["doc"])["favicon"]["bytes"] == 90
    cat.update_document("sites", 1, {"title": "Clips"}, partial=True)
    assert cat.image("sites", 1, "favicon") == icon
    view = {"base_index": "pages", "select": ["title", "extra"], "relations": [{"name": "site", "field": "site_ref", "target_index": "sites", "select": ["title"], "include_image": True, "image_field": "favicon", "relations": [{"name": "owner", "field": "owner", "target_index": "owners", "select": ["name"]}]}]}
    cat.put_view("tree", view)
    rows = {r["doc_id"]: r for r in cat.run_view("tree", {"q": "clips"}).collect()}
    assert len(rows) == 6 and json.loads(rows[1]["extra"]) == [0]
    assert rows[1]["site"]["id"] == 1 and json.loads(rows[1]["site"]["doc"]) == {"title": "Clips"} and rows[1]["site"]["image"] == icon
    assert json.loads(rows[1]["site"]["relations"]["owner"]["doc"]) == {"name": "Ann"} and rows[4]["site"] is None and rows[6]["site"] is None

    cat.flush("sites")
    cat.update_document("sites", 1, {"title": "New", "domain": "video.example", "owner": 1})
    assert cat.image("sites", 1, "favicon") is None  # replaced by a document without one
    cat.reindex("pages")
    cat.index_document("pages", {"title": "later clips", "labels": ["short", 5], "flag": True})
    cat.delete_document("pages", 1)
    plain = SearchIndex(documents.typed(cat.documents("pages"), cat.schema("pages")), cat.schema("pages"))
    for mode in ("or",):
        assert scores(cat.search("pages", {"q": "later clips", "mode": mode})[0]) == pytest.approx(scores(rank.rank(plain, "later clips", 10, mode)))
    assert set(scores(cat.search("pages", {"q": "clips", "label": "short", "flag": "true"})[0])) == {7} and scores(cat.search("pages", {"q": "clips", "label": "5"})[0]) == {}

    state = cat.cluster_state()
    assert state["cluster_id"] == "c1" and {i["name"]: i["flushed_op"] for i in state["indexes"]}["sites"] == 2 and cat.health() == {"status": "ok", "indexes": 3, "broken": []}
    assert cat.config()["flush_docs"] == 5000
    assert tuple(cat.totals().first())[:2] == (3, 8)
    replica = Catalog(spark, str(tmp_path / "replica"))
    assert replica.fetch(cat.root) == ["owners", "pages", "sites"] and replica.views() == ["tree"]
    assert {n: replica.document_count(n) for n in replica.indexes()} == {n: cat.document_count(n) for n in cat.indexes()}
    assert replica.index_document("pages", {"title": "eighth"}) == 8


def test_segments_are_merged_and_old_ones_go(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path), Settings(flush_docs=2, merge_segments=3))
    cat.create_index("s", {"fields": {"t": "text"}})
    for i in range(3):
        cat.bulk("s", spark.createDataFrame([(0, f'{{"t": "text {i}"}}'), (1, '{"t": "more"}')], "ordinal long, raw string"))
    cat.delete_document("s", 2)
    cat.flush("s")
    m = snapshots.manifest(spark, f"{tmp_path}/s/snapshot")
    assert len(m["segments"]) <= 3 and cat.document_count("s") == 5 and cat.recover("s").count() == 5 and m["op_id"] == 7
    assert len([p for p in (tmp_path / "s" / "snapshot").iterdir() if len(p.name) == 32]) <= 6
    assert [r["op_id"] for r in cat.changes("s", 5).orderBy("op_id").collect()] == [6, 7]


def test_only_one_writer_at_a_time(spark, tmp_path):
    with files.locked(spark, f"{tmp_path}/lock"), pytest.raises(TimeoutError), files.locked(spark, f"{tmp_path}/lock", 0.2):
        pass
    with files.locked(spark, f"{tmp_path}/lock"):
        files.write_text(spark, f"{tmp_path}/a", "one")
        files.write_text(spark, f"{tmp_path}/a", "two")
    assert files.read_text(spark, f"{tmp_path}/a") == "two"


def test_graph_walk_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    vecs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)], "doc_id long, vec array<double>")
    graph = ann.NeighbourGraph.build(vecs)
    queries = vecs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = ann.neighbour_graph(vecs, 9).select(F.col("doc_id").alias("query_id"), F.col("neighbour").alias("doc_id")).join(queries.select("query_id"), "query_id", "left_semi")
    assert ann.recall_at_k(ann.search_graph(graph, queries, 10, 64), exact, 9).first()["recall"] >= 0.9
    index = SearchIndex(vecs, IndexSchema.parse({"fields": {"vec": {"type": "vector", "dim": 8}}}))
    own = vecs.filter("doc_id = 7").first()["vec"]
    assert search(index, {"mode": "vector", "vec": own, "size": 3, "ef_search": 50}, graph=graph)[0].orderBy("rank").first()["doc_id"] == 7
    assert ann.search_graph(ann.NeighbourGraph.build(vecs.limit(0)), queries, 3).count() == 0


def test_fuzzy_says_when_it_cuts(spark, demo, monkeypatch):
    monkeypatch.setattr(rank, "EXPANSIONS", 1)
    with pytest.warns(UserWarning, match="expands"):
        rank.rank(demo, "fox dog", 10, "fuzzy", distance=1)


def test_images_are_decoded_once_and_repeated_ids_stay_apart(spark):
    schema = IndexSchema.parse({"fields": {"icon": {"type": "image", "max_kb": 4}}})
    raws = [(1, json.dumps({"icon": {"content": base64.b64encode(b"a").decode()}})), (1, json.dumps({"icon": {"content": base64.b64encode(b"bcd").decode()}})), (2, json.dumps({"icon": {}}))]
    kept = documents.prepared(spark.createDataFrame(raws, "doc_id long, raw string"), schema, F.lit(5).cast("long"))
    sizes = kept.select("doc_id", F.get_json_object("raw", "$.icon.bytes").cast("long").alias("bytes"), "images")
    out = documents.image_base64(sizes, "icon", "bytes")
    assert sorted(map(tuple, out.select("doc_id", "bytes", "content").collect())) == [(1, 1, "YQ=="), (1, 3, "YmNk")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64(") == 1 and plan.count("crc32(") <= 1


def test_exact_neighbours_of_some_with_ties_zeros_and_short_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(5, 4)), 20, axis=0), np.zeros((3, 4)), rng.normal(size=(3, 4)) * 1e-5]).astype(np.float32)
    ids = rng.permutation(len(x)).astype(int) * 3
    vecs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "doc_id long, vec array<float>").repartition(5)
    queries = vecs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    found = ann.exact_neighbours(queries, vecs, 7, block=16)
    assert "Explode" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1], "vectors are packed before they are sent to each block"
    d = x.astype(np.float64)
    scores = np.round(d @ d.T / (np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(d, axis=1) + 1e-9), 6)
    want = {(int(q), r + 1): (int(ids[j]), scores[i, j]) for i, q in enumerate(ids) if q % 2 == 0 for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-scores[i, j], ids[j]))[:7])}
    assert {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()} == want


ODD_TEXTS = ["a B b", None, "", "é", "x9é9X", "b", "--", "A-a", "ünd b", "1 2 1"]


def test_terms_of_a_lot_are_counted_as_tokens_are():
    for texts in (ODD_TEXTS, [], [None], ["a", "b"], ["", "a"]):
        vocabulary, term, row, counts, sizes = term_counts(pa.array(["skipped", *texts], pa.string()).slice(1))
        names = vocabulary.to_pylist()
        want = {(t, i): n for i, x in enumerate(texts) for t, n in Counter(tokenize(x or "")).items()}
        assert {(names[t], int(i)): int(n) for t, i, n in zip(term, row, counts)} == want
        assert sizes.tolist() == [len(tokenize(x or "")) for x in texts] and names == sorted(names)


@pytest.mark.parametrize("repeated", [False, True])
def test_index_by_lots_of_documents(spark, monkeypatch, repeated):
    monkeypatch.setattr(index_module, "RANGE", 300)
    monkeypatch.setattr(index_module, "LOT_BYTES", 1000)
    rng = np.random.default_rng(1)
    ids = [int(i) for i in rng.permutation(1000)] + [3] * repeated
    texts = [" ".join(f"w{int(j)}" for j in rng.zipf(1.6, 12) if j < 300) + " hot" for _ in ids]
    index = SearchIndex(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(7), IndexSchema.parse({"fields": {"text": "text"}}))
    counted = Counter((t, i) for i, x in zip(ids, texts) for t in tokenize(x))
    assert {(r["term"], r["doc_id"]): r["tf"] for r in index.postings().collect()} == counted
    assert {r["term"]: r["df"] for r in index.document_frequencies().collect()} == Counter(t for t, _ in counted)
    assert tuple(index.statistics().first()) == (len(ids), sum(counted.values()), len({t for t, _ in counted}), len(counted))
    by_term = {t: sorted(i for u, i in counted if u == t) for t, _ in counted}
    assert sorted(tuple(r) for r in index.skip_pointers(8).select("term", "position", "doc_id").collect()) == sorted((t, p, i) for t, d in by_term.items() for p, i in enumerate(d) if p % 8 == 0)
    shuffled = "Exchange hashpartitioning(term" in index.postings()._jdf.queryExecution().executedPlan().toString()
    assert shuffled == repeated


@pytest.mark.parametrize("most", [0, 10])
def test_deletion_sorts_no_texts(spark, monkeypatch, most):
    monkeypatch.setattr(index_module, "BROADCAST_IDS", most)
    index = SearchIndex(spark.createDataFrame([(i, f"t{i} x") for i in range(8)], "doc_id long, text string"), IndexSchema.parse({"fields": {"text": "text"}}))
    left = index.without(spark.createDataFrame([(1,), (1,), (5,), (77,)], "doc_id long"))
    assert "SortMergeJoin" not in left.docs._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in left.postings().filter("term = 'x'").collect()) == [0, 2, 3, 4, 6, 7]
