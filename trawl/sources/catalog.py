"""A catalog of collections: schemas, documents, changelogs, saved indexes, views and statistics below one folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.variants import field_of
from trawl.operators import ann, documents, relations
from trawl.operators.index import SearchIndex
from trawl.operators.relations import Collection, View, expand_documents, reference_in
from trawl.operators.search import search
from trawl.schema import IndexSchema, schema_id
from trawl.sources import changelog, snapshots
from trawl.sources.files import delete, exists, locked, names, read_text, size, write_text
from trawl.sources.scratch import stored


@dataclass(frozen=True)
class Settings:
    """Bounds and defaults of a catalog; ids of the cluster and its parts are labels."""

    #: A collection is flushed when its log has so many changes or bytes; 0 turns this off.
    flush_docs: int = 5000
    flush_bytes: int = 8 << 20
    #: Segments at which a flush merges them.
    merge_segments: int = snapshots.MERGE_AT
    ann_clusters: int = ann.CLUSTERS
    ann_probes: int = ann.PROBES
    ann_neighbours: int = ann.NEIGHBOURS
    ef_search: int = ann.EF_SEARCH
    cluster_id: str = ""
    shard_id: str = ""
    replica_id: str = ""


class Catalog:
    """Each collection has a schema, an append-only changelog, segments and perhaps a saved index, in any Hadoop file system.

    Single documents are written as changes and read by folding the log over the segments; bulk
    work goes through whole DataFrames. The catalog itself is small JSON files. Writers of one
    collection take turns by a lock file; readers need none.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()

    def _at(self, index: str, what: str) -> str:
        return f"{self.root}/{index}/{what}"

    def _json(self, path: str, default: object) -> object:
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else default

    def _writing(self, name: str):
        return locked(self.spark, self._at(name, "writer.lock"))

    # Collections

    def indexes(self) -> list[str]:
        return sorted(self._json(f"{self.root}/indexes.json", []))  # type: ignore[arg-type]

    def create_index(self, name: str, spec: dict) -> bool:
        """False if the name is empty or taken. The schema joins the registry's history once."""
        schema = IndexSchema.parse(spec)
        with locked(self.spark, f"{self.root}/catalog.lock"):
            if not name or name in self.indexes():
                return False
            write_text(self.spark, self._at(name, "schema.json"), json.dumps(spec, sort_keys=True))
            snapshots.save(self.spark.createDataFrame([], "doc_id long, raw string"), self._at(name, "snapshot"), spec)
            registry = self._json(f"{self.root}/registry.json", [])
            entry = {"index": name, "schema_id": schema_id(spec), "schema_version": schema.version}
            if not any((e["index"], e["schema_id"]) == (name, entry["schema_id"]) for e in registry):  # type: ignore[union-attr]
                registry.append(entry)  # type: ignore[union-attr]
            write_text(self.spark, f"{self.root}/registry.json", json.dumps(registry))
            write_text(self.spark, f"{self.root}/indexes.json", json.dumps([*self.indexes(), name]))
        return True

    def index_exists(self, name: str) -> bool:
        return name in self.indexes()

    def registry(self) -> list[dict]:
        return self._json(f"{self.root}/registry.json", [])  # type: ignore[return-value]

    def _spec(self, name: str) -> dict:
        return json.loads(read_text(self.spark, self._at(name, "schema.json")))

    def schema(self, name: str) -> IndexSchema:
        return IndexSchema.parse(self._spec(name))

    def _manifest(self, name: str) -> dict:
        return snapshots.manifest(self.spark, self._at(name, "snapshot"))

    def _log(self, name: str) -> DataFrame:
        path = self._at(name, "log")
        return changelog.read(self.spark, path) if exists(self.spark, path) else self.spark.createDataFrame([], changelog.STORED)

    def _stored(self, name: str) -> DataFrame:
        """(doc_id, raw, images, op_id, ext_id), current."""
        docs = snapshots.load(self.spark, self._at(name, "snapshot"), log=self._log(name))
        return docs.withColumn("ext_id", documents.external_id(self.schema(name), F.try_parse_json("raw")))

    def documents(self, name: str) -> DataFrame:
        """(doc_id, raw, ext_id), current."""
        return self._stored(name).select("doc_id", "raw", "ext_id")

    def _referring(self, name: str, docs: DataFrame) -> DataFrame:
        """Adds relation_ref, if the schema declares a relation."""
        rel = self.schema(name).relation
        return docs if rel is None else docs.withColumn("relation_ref", reference_in(field_of(F.try_parse_json("raw"), rel.field), name, rel.target_index))

    def index(self, name: str) -> SearchIndex:
        """The collection with its saved index, if it has one; documents that changed since are tokenised anew and the others' postings read."""
        schema = self.schema(name)
        plain = SearchIndex(documents.typed(self._referring(name, self.documents(name)), schema), schema)
        saved = self._json(self._at(name, "index/current.json"), None)
        if saved is None:
            return plain
        opened = plain.opened(self._at(name, f"index/{saved['version']}"))  # type: ignore[index]
        if saved["op_id"] == self._last(name)[0]:  # type: ignore[index]
            return opened
        after = F.col("op_id") > saved["op_id"]  # type: ignore[index]
        changed = snapshots.changes(self.spark, self._at(name, "snapshot")).filter(after).select("doc_id").unionAll(self._log(name).filter(after).select("doc_id"))
        return opened.refreshed(changed)

    def reindex(self, name: str) -> None:
        """Saves the collection's index: postings, lengths, vocabulary and statistics of its present documents."""
        with self._writing(name):
            schema, version, op_id = self.schema(name), uuid.uuid4().hex, self._last(name)[0]
            SearchIndex(documents.typed(self.documents(name), schema), schema).save(self._at(name, f"index/{version}"))
            former = self._json(self._at(name, "index/current.json"), {"version": ""})["version"]  # type: ignore[index]
            write_text(self.spark, self._at(name, "index/current.json"), json.dumps({"version": version, "op_id": op_id}))
            for old in names(self.spark, self._at(name, "index")):
                if len(old) == 32 and old not in (version, former):  # the former one stays for its readers
                    delete(self.spark, self._at(name, f"index/{old}"))

    def document_count(self, name: str) -> int:
        return self.documents(name).count()

    # Documents

    def _last(self, name: str) -> tuple[int, int]:
        """Last op_id and doc_id ever given; ids are never used again."""
        m = self._manifest(name)
        row = self._log(name).agg(F.coalesce(F.max("op_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
        return max(m["op_id"], row[0]), max(m["max_id"] or 0, row[1])

    def bulk(self, name: str, batch: DataFrame, continue_on_error: bool = True, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Indexes a batch (ordinal, raw); returns the accepted (ordinal, doc_id, ext_id) and rejected (ordinal, error) rows, as tables of their own."""
        schema = self.schema(name)
        with self._writing(name):
            good, bad = documents.bulk(batch, schema, self.documents(name), continue_on_error)
            op, last = self._last(name)
            bad = stored(bad, "rejected")
            done = stored(documents.with_doc_ids(documents.prepared(good, schema, now), last), "accepted")
            changelog.append(done.select((F.col("doc_id") - last + op).alias("op_id"), F.lit(changelog.UPSERT).alias("op"), "doc_id", "raw", "images"), self._at(name, "log"))
        self._flush_if_due(name, op + done.count())
        return done.select("ordinal", "doc_id", "ext_id"), bad

    def index_document(self, name: str, doc: Mapping | str) -> int:
        """The doc_id of the new document; ValueError if it isn't valid."""
        text = doc if isinstance(doc, str) else json.dumps(doc)
        done, bad = self.bulk(name, self.spark.createDataFrame([(0, text)], "ordinal long, raw string"))
        row = done.first()
        if row is None:
            raise ValueError(bad.first()["error"])
        return row["doc_id"]

    def get_document(self, name: str, doc_id: int) -> dict | None:
        row = self.documents(name).filter(F.col("doc_id") == doc_id).first()
        return json.loads(row["raw"]) if row else None

    def lookup(self, name: str, provided: str) -> int | None:
        row = documents.lookup(self.documents(name), provided).first()
        return row["doc_id"] if row else None

    def external_id(self, name: str, doc_id: int) -> str | None:
        row = self.documents(name).filter(F.col("doc_id") == doc_id).first()
        return row["ext_id"] if row else None

    def image(self, name: str, doc_id: int, field: str) -> str | None:
        """A stored image as base64 text."""
        row = documents.image_base64(self._stored(name).filter(F.col("doc_id") == doc_id), field).first()
        return row["content"] if row else None

    def _change(self, name: str, changes: DataFrame) -> int:
        """Appends one change (op, doc_id, raw, images) and returns its op_id; the caller holds the lock."""
        op_id = self._last(name)[0] + 1
        changelog.append(changes.withColumn("op_id", F.lit(op_id).cast("long")), self._at(name, "log"))
        return op_id

    def update_document(self, name: str, doc_id: int, doc: Mapping | str, partial: bool = False) -> bool:
        """Replaces a document, or merges top-level keys into it; `_created_at` stays, and so do images that a merge doesn't replace. False if it doesn't exist."""
        with self._writing(name):
            old = self._stored(name).filter(F.col("doc_id") == doc_id).first()
            if old is None:
                return False
            before = json.loads(old["raw"])
            given = json.loads(doc) if isinstance(doc, str) else dict(doc)
            new = (before | given) if partial else ({k: before[k] for k in ("_created_at",) if k in before} | given)
            schema = self.schema(name)
            one = self.spark.createDataFrame([(doc_id, json.dumps(new), old["images"] if partial else None)], "doc_id long, raw string, images map<string,binary>")
            row = documents.prepared(one, schema).withColumn("error", documents.problem(schema, F.try_parse_json(F.lit(json.dumps(new))))).first()
            if row["error"]:
                raise ValueError(row["error"])
            if schema.doc_id and schema.doc_id.enforce_unique:
                own = self.spark.range(1).select(documents.external_id(schema, F.try_parse_json(F.lit(row["raw"]))).alias("e")).first()["e"]
                if self.documents(name).filter((F.col("doc_id") != doc_id) & (F.col("ext_id") == own)).first():
                    raise ValueError("document id exists")
            kept = {k: v for k, v in (row["images"] or {}).items() if isinstance(new.get(k), dict)}
            op_id = self._change(name, self.spark.createDataFrame([(changelog.UPSERT, doc_id, row["raw"], kept)], "op string, doc_id long, raw string, images map<string,binary>"))
        self._flush_if_due(name, op_id)
        return True

    def delete_document(self, name: str, doc_id: int) -> bool:
        with self._writing(name):
            if self.get_document(name, doc_id) is None:
                return False
            op_id = self._change(name, self.spark.createDataFrame([(changelog.DELETE, doc_id, None)], "op string, doc_id long, raw string"))
        self._flush_if_due(name, op_id)
        return True

    def stored_match(self, name: str, field: str, value: object) -> DataFrame:
        return documents.stored_match(self.documents(name), field, value)

    # Search

    def _targets(self) -> DataFrame:
        """(index, doc_id, ext_id, raw, images, relation_ref) of all collections."""
        out = None
        none = F.lit(None).cast("struct<index:string,id:string>")
        for name in self.indexes():
            docs = self._referring(name, self._stored(name))
            ref = F.col("relation_ref") if "relation_ref" in docs.columns else none.alias("relation_ref")
            part = docs.select(F.lit(name).alias("index"), "doc_id", "ext_id", "raw", "images", ref)
            out = part if out is None else out.unionByName(part)
        return out

    def search(self, name: str, params: Mapping, **options) -> tuple[DataFrame, DataFrame]:
        """A page of hits and the total; with include_relations, hits have relation_ref and `relation`."""
        wanted = str(params.get("include_relations") or "none") in ("inline", "hierarchy")
        return search(self.index(name), params, targets=self._targets().drop("images") if wanted else None, **options)

    def relation_groups(self, name: str, params: Mapping, **options) -> DataFrame:
        """The page's hits grouped by the document they refer to."""
        return relations.groups(self.search(name, {**params, "include_relations": "hierarchy"}, **options)[0])

    def _vectors(self, name: str) -> DataFrame:
        index = self.index(name)
        field = index.schema.vector
        if field is None:
            raise ValueError(f"{name} has no vector field")
        return index.docs.filter(F.col(field.name).isNotNull()).select("doc_id", F.col(field.name).alias("vec"))

    def inverted_lists(self, name: str) -> ann.InvertedLists:
        return ann.InvertedLists.build(self._vectors(name), self.settings.ann_clusters)

    def neighbour_graph(self, name: str) -> ann.NeighbourGraph:
        return ann.NeighbourGraph.build(self._vectors(name), self.settings.ann_neighbours)

    # Storage

    def _flush_if_due(self, name: str, op_id: int) -> None:
        """Flushes by the settings' bounds: the log's bytes, and its changes since the last segment."""
        s, m = self.settings, self._manifest(name)
        if (s.flush_bytes and size(self.spark, self._at(name, "log")) >= s.flush_bytes) or (s.flush_docs and op_id - m["op_id"] >= s.flush_docs):
            self.flush(name)

    def flush(self, name: str) -> dict:
        """Moves the log's changes into a segment, merges segments if there are many, and deletes the log's files that are in by then."""
        with self._writing(name):
            out = snapshots.flush(self.spark, self._at(name, "snapshot"), self._log(name), self.settings.merge_segments)
            if exists(self.spark, self._at(name, "log")):
                changelog.trim(self.spark, self._at(name, "log"), out["op_id"])
        return out

    def merge(self, name: str) -> dict:
        """All segments as one."""
        with self._writing(name):
            return snapshots.merge(self.spark, self._at(name, "snapshot"))

    def recover(self, name: str) -> DataFrame:
        """The documents from all changes that are stored, segments' and log's, without regard to the manifest's bounds."""
        every = snapshots.changes(self.spark, self._at(name, "snapshot")).unionByName(self._log(name))
        return changelog.fold(changelog.replayable(every)[0])

    def save_snapshot(self, path: str) -> None:
        """All collections and views to a folder."""
        for name in self.indexes():
            snapshots.save(self._stored(name).select("doc_id", "raw", "images", "op_id"), f"{path}/{name}", self._spec(name), self._last(name)[0])
        write_text(self.spark, f"{path}/catalog.json", json.dumps({"format": snapshots.FORMAT, "indexes": self.indexes(), "views": self._json(f"{self.root}/views.json", {})}))

    def load_snapshot(self, path: str) -> list[str]:
        """Collections of a folder that save_snapshot wrote; those that exist here are replaced."""
        found = json.loads(read_text(self.spark, f"{path}/catalog.json"))
        if found.get("format") != snapshots.FORMAT:
            raise ValueError(f"not a snapshot: {path}")
        for name in found["indexes"]:
            m = snapshots.manifest(self.spark, f"{path}/{name}")
            self._replace(name, m["schema"], snapshots.load(self.spark, f"{path}/{name}"), m["op_id"])
        write_text(self.spark, f"{self.root}/views.json", json.dumps(found["views"]))
        return found["indexes"]

    def _replace(self, name: str, spec: dict, docs: DataFrame, op_id: int) -> None:
        if not self.create_index(name, spec):
            write_text(self.spark, self._at(name, "schema.json"), json.dumps(spec, sort_keys=True))
        with self._writing(name):
            snapshots.save(docs, self._at(name, "snapshot"), spec, op_id)
            delete(self.spark, self._at(name, "log"))
            delete(self.spark, self._at(name, "index"))

    def fetch(self, base: str) -> list[str]:
        """What a replica does with another catalog's folder: checks every manifest, then takes over its collections as they are now, log and all, and its views."""
        other = Catalog(self.spark, base, self.settings)
        plan = other.shipping_plan()
        if not plan["indexes"]:
            raise ValueError(f"not a catalog: {base}")
        for name, entry in plan["indexes"].items():
            self._replace(name, entry["manifest"]["schema"], other._stored(name).select("doc_id", "raw", "images", "op_id"), entry["last_op"])
        write_text(self.spark, f"{self.root}/views.json", json.dumps(other._json(f"{other.root}/views.json", {})))
        return sorted(plan["indexes"])

    def shipping_plan(self) -> dict:
        """What a replica must fetch: manifests, and the last change of each log."""
        return {
            "format": snapshots.FORMAT, "cluster": self._labels(),
            "indexes": {n: {"manifest": self._manifest(n), "last_op": self._last(n)[0], "log_bytes": size(self.spark, self._at(n, "log"))} for n in self.indexes()},
        }

    def changes(self, name: str, offset: int, limit: int = 1 << 16) -> DataFrame:
        """Changes after an offset, for shipping: of the segments and the log, so that trimming the log loses none that is a document's latest."""
        every = snapshots.changes(self.spark, self._at(name, "snapshot")).unionByName(self._log(name).select("doc_id", "op_id", "op", "raw", "images"))
        return changelog.chunk(every.dropDuplicates(["op_id"]), offset, limit)

    # State

    def _labels(self) -> dict:
        return {k: getattr(self.settings, k) for k in ("cluster_id", "shard_id", "replica_id")}

    def config(self) -> dict:
        """The settings in force."""
        return {"root": self.root, "chunk": snapshots.CHUNK} | asdict(self.settings)

    def health(self) -> dict:
        """ok, if the catalog and every manifest can be read."""
        broken = []
        found = self.indexes()
        for name in found:
            try:
                self._manifest(name)
                self.schema(name)
            except Exception as e:  # whatever keeps a collection from being read is what is asked for
                broken.append(f"{name}: {e}")
        return {"status": "error" if broken else "ok", "indexes": len(found), "broken": broken}

    def cluster_state(self) -> dict:
        """Labels, and of each collection its schema, segments, log and the last change that is in a segment."""
        out: dict = self._labels() | {"root": self.root, "indexes": []}
        for name in self.indexes():
            m = self._manifest(name)
            saved = self._json(self._at(name, "index/current.json"), None)
            out["indexes"].append({
                "name": name, "schema_id": m["schema_id"], "schema_version": self.schema(name).version, "segments": m["segments"], "flushed_op": m["op_id"], "log_bytes": size(self.spark, self._at(name, "log")),
                "indexed_op": saved and saved["op_id"], "ann_clusters": self.settings.ann_clusters, "ann_probes": self.settings.ann_probes, "ann_neighbours": self.settings.ann_neighbours, "ef_search": self.settings.ef_search,
            })
        return out

    def stats(self) -> DataFrame:
        """(index, documents, tokens, avgdl, vectors, segments, changes, log_bytes, schema_id, schema_version), a row a collection, in one plan."""
        out = None
        for name in self.indexes():
            index, m = self.index(name), self._manifest(name)
            v = index.schema.vector
            vectors = index.docs.agg(F.count(v.name) if v else F.lit(0).cast("long")).toDF("vectors")
            changes = self._log(name).filter(F.col("op_id") > m["op_id"]).agg(F.count("*").alias("changes"))
            row = index.corpus().crossJoin(F.broadcast(vectors)).crossJoin(F.broadcast(changes))  # three tables of one row
            part = row.select(
                F.lit(name).alias("index"), F.col("n_docs").alias("documents"), F.col("n_tokens").cast("long").alias("tokens"), F.col("avgdl").cast("double").alias("avgdl"), "vectors",
                F.lit(len(m["segments"])).cast("long").alias("segments"), "changes", F.lit(size(self.spark, self._at(name, "log"))).cast("long").alias("log_bytes"), F.lit(m["schema_id"]).alias("schema_id"), F.lit(index.schema.version).alias("schema_version"),
            )
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "index string, documents long, tokens long, avgdl double, vectors long, segments long, changes long, log_bytes long, schema_id string, schema_version int")

    def totals(self) -> DataFrame:
        """One row: collections, documents, tokens, vectors, segments, changes and log bytes of all."""
        return self.stats().agg(F.count("*").alias("indexes"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "vectors", "segments", "changes", "log_bytes")))

    def metrics(self) -> str:
        """Statistics as Prometheus text."""
        lines = []
        for r in self.stats().collect():  # a row a collection
            lines += [f'trawl_{k}{{index="{r["index"]}"}} {r[k]}' for k in ("documents", "tokens", "vectors", "segments", "changes", "log_bytes")]
        return "\n".join(lines) + "\n"

    # Views

    def _collections(self) -> dict[str, Collection]:
        """The collections by name, for a view's names to be checked against."""
        return {name: Collection(name, self.spark.createDataFrame([], "doc_id long"), "doc_id") for name in self.indexes()}

    def put_view(self, name: str, spec: dict) -> None:
        if not name:
            raise ValueError("a view needs a name")
        View.parse(spec, self._collections())
        with locked(self.spark, f"{self.root}/catalog.lock"):
            write_text(self.spark, f"{self.root}/views.json", json.dumps(self._json(f"{self.root}/views.json", {}) | {name: spec}))  # type: ignore[operator]

    def view(self, name: str) -> dict | None:
        return self._json(f"{self.root}/views.json", {}).get(name)  # type: ignore[union-attr]

    def views(self) -> list[str]:
        return sorted(self._json(f"{self.root}/views.json", {}))  # type: ignore[arg-type]

    def remove_view(self, name: str) -> bool:
        with locked(self.spark, f"{self.root}/catalog.lock"):
            views = self._json(f"{self.root}/views.json", {})
            found = views.pop(name, None) is not None  # type: ignore[union-attr]
            write_text(self.spark, f"{self.root}/views.json", json.dumps(views))
        return found

    def run_view(self, name: str, params: Mapping) -> DataFrame:
        """A view over a search's hits: (rank, doc_id, score, selected fields, a struct a relation).

        Declared fields keep their types, others are JSON text; without a selection `doc` is the whole
        document. Relations are structs (index, id, doc_id, doc, image, relations), see `relations.expand_documents`.
        """
        spec = self.view(name)
        if spec is None:
            raise KeyError(name)
        view = View.parse(spec, self._collections())
        hits, _ = search(self.index(view.base), {k: v for k, v in params.items() if k in ("q", "mode", "from", "size", "vec", "distance", "w_bm25", "w_semantic", "w_lexical")})
        declared = self.schema(view.base).fields
        selected = [(F.col(c) if c in declared else field_of(F.try_parse_json("raw"), c).cast("string")).alias(f"_s{i}") for i, c in enumerate(view.select)] or [F.col("raw").alias("_s0")]
        page = hits.select("rank", "doc_id", "score", "raw", *selected)
        out = expand_documents(page, view, self._targets(), "_rel_") if view.relations else page
        return out.select("rank", "doc_id", "score", *(F.col(f"_s{i}").alias(c) for i, c in enumerate(view.select or ["doc"])), *(F.col(f"_rel_{n}").alias(n) for n in view.relations))
