"""Expansion of references between collections: inline, grouped, and by view templates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import to_base64
from trawl.functions.variants import field_of, kind_of, object_of
from trawl.sources.scratch import stored

MAX_DEPTH = 5


@dataclass
class Collection:
    """Documents, the column that references resolve to, and the column that holds a reference to another collection."""

    name: str
    docs: DataFrame
    key: str
    reference: str | None = None
    target: str | None = None


def reference(raw: Column, own_index: str, target_index: str = "") -> Column:
    """struct(index, id) of a JSON reference: a string, a whole number, or an object with id and perhaps index; null if absent."""
    return reference_in(F.try_parse_json(raw), own_index, target_index)


def reference_in(value: Column, own_index: str, target_index: str = "") -> Column:
    """The same of a field's value (a variant). Without an index of its own a reference leads to the target, or to its own index."""
    is_object = F.coalesce(kind_of(value) == "OBJECT", F.lit(False))
    given = F.when(is_object, F.try_variant_get(value, "$.id", "variant")).otherwise(value)
    whole = F.schema_of_variant(given).isin("BIGINT", "STRING")
    ref = F.when(given.isNotNull() & whole, F.try_variant_get(given, "$", "string"))
    named = F.when(is_object, F.try_variant_get(value, "$.index", "string"))
    index = F.coalesce(F.when(named != "", named), F.lit(target_index or own_index))
    return F.when(ref != "", F.struct(index.alias("index"), ref.alias("id")))


#: What references lead to: all documents of the collections, by index, with their own reference.
TARGET = ["index", "doc_id", "ext_id", "raw", "relation_ref"]


def looked_up(targets: DataFrame, keys: DataFrame) -> DataFrame:
    """(index, id, doc_id, ext_id, raw, relation_ref): the documents that keys (index, id) lead to, at most one a key.

    An id is an external one first, then one without leading zeros, then a doc_id. Keys are those
    of a page of hits, so they are broadcast; the targets are read once and not shuffled.
    """
    keys = keys.filter("id is not null").distinct()
    number = F.when(F.col("id").rlike(r"^\d{1,18}$"), F.col("id").cast("long"))
    columns = [c for c in targets.columns if c != "index"]
    side = targets.withColumnRenamed("index", "_index")
    texts = keys.select("index", "id", F.col("id").alias("_ext"), F.lit(0).alias("_by")).unionAll(keys.select("index", "id", number.cast("string"), F.lit(1)).filter(number.isNotNull() & (number.cast("string") != F.col("id"))))
    by_text = side.join(F.broadcast(texts), (F.col("_index") == F.col("index")) & (F.col("ext_id") == F.col("_ext")))
    by_number = side.join(F.broadcast(keys.select("index", "id", number.alias("_id"), F.lit(2).alias("_by"))), (F.col("_index") == F.col("index")) & (F.col("doc_id") == F.col("_id")))
    names = ["index", "id", "_by", *columns]
    found = by_text.select(names).unionAll(by_number.select(names))
    return found.groupBy("index", "id").agg(F.min_by(F.struct(*columns), F.struct("_by", "doc_id")).alias("_t")).select("index", "id", "_t.*")


def attach(page: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """Adds `relation` to a page of hits with a column relation_ref (index, id): the document it leads to.

    A relation is a struct (index, id, doc_id, doc, relation): id as the reference has it, doc_id
    the document's external id, doc its JSON text, and the relation it has itself, to the given depth (at
    most 5). References that don't resolve, and those that lead back to one on the path, end it with a null.
    """
    depth = max(0, min(MAX_DEPTH, depth))
    out = page
    for level in range(1, depth + 1):
        out = stored(out, "relations")  # the page so far, or each level would be planned twice in the next
        ref = F.col("relation_ref") if level == 1 else F.col(f"_l{level - 1}.relation_ref")
        keys = out.select(ref["index"].alias("index"), ref["id"].alias("id"))
        found = looked_up(targets, keys).select(F.col("index").alias("_index"), F.col("id").alias("_id"), F.struct("index", "id", "ext_id", "raw", "relation_ref").alias(f"_l{level}"))
        out = out.join(F.broadcast(found), (ref["index"] == F.col("_index")) & (ref["id"] == F.col("_id")), "left").drop("_index", "_id")  # at most a row a hit
        for earlier in range(1, level):
            again = (F.col(f"_l{earlier}.index") == ref["index"]) & (F.col(f"_l{earlier}.id") == ref["id"])
            out = out.withColumn(f"_l{level}", F.when(~F.coalesce(again, F.lit(False)), F.col(f"_l{level}")))
    nested: Column | None = None
    for level in range(depth, 0, -1):
        at = F.col(f"_l{level}")
        parts = [at["index"].alias("index"), at["id"].alias("id"), at["ext_id"].alias("doc_id"), at["raw"].alias("doc")]
        nested = F.when(at.isNotNull(), F.struct(*parts, *([nested.alias("relation")] if nested is not None else [])))
    return out.withColumn("relation", nested if nested is not None else F.lit(None).cast("string")).drop(*(f"_l{i}" for i in range(1, depth + 1)))


def groups(page: DataFrame) -> DataFrame:
    """(position, relation_ref, relation, n, children): a page with relations, grouped by reference, in order of each group's first hit.

    Hits without a reference are one group, with a null relation_ref; children are doc_ids in order of the hits.
    """
    children = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    grouped = page.groupBy("relation_ref").agg(F.min("rank").alias("position"), F.min_by("relation", "rank").alias("relation"), F.count("*").alias("n"), children.alias("children"))
    return grouped.select("position", "relation_ref", "relation", "n", "children")


def inline(hits: DataFrame, base: str, collections: Mapping[str, Collection], depth: int = 1) -> DataFrame:
    """Adds relation_ref, and `relation`: a struct (index, id, doc, relation) nested to the given depth, at most 5.

    Each level is a left join on the target's key, at most one match a row; Spark broadcasts a
    target if its size permits. A reference that doesn't resolve has a null relation, and so has one that leads back to a document on the path.
    """
    depth = max(0, min(MAX_DEPTH, depth))
    source = collections[base]
    if source.reference is None or source.target is None:
        return hits
    out = hits.withColumn("relation_ref", F.col(source.reference).cast("string"))
    if depth == 0:
        return out
    path: list[tuple[str, Column]] = []
    levels: list[tuple[str, list[str]]] = []
    at, ref = source, "relation_ref"
    for level in range(1, depth + 1):
        target = collections[at.target]  # type: ignore[index]
        prefix = f"_l{level}_"
        side = target.docs.select(*(F.col(c).alias(prefix + c) for c in target.docs.columns))
        joined = out.join(side, F.col(ref) == side[prefix + target.key].cast("string"), "left")
        seen = [own == F.col(ref) for name, own in path if name == target.name]
        for again in seen:
            joined = joined.withColumns({prefix + c: F.when(~F.coalesce(again, F.lit(False)), F.col(prefix + c)) for c in target.docs.columns})
        out = joined
        levels.append((target.name, list(target.docs.columns)))
        path.append((target.name, F.col(prefix + target.key).cast("string")))
        at = target
        if at.reference is None or at.target is None:
            break
        out = out.withColumn(f"_ref{level}", F.col(prefix + at.reference).cast("string"))
        ref = f"_ref{level}"
    nested: Column | None = None
    for level in range(len(levels), 0, -1):
        name, columns = levels[level - 1]
        prefix = f"_l{level}_"
        doc = F.struct(*(F.col(prefix + c).alias(c) for c in columns))
        key = F.col(prefix + collections[name].key)
        parts = [F.lit(name).alias("index"), key.cast("string").alias("id"), doc.alias("doc")]
        if nested is not None:
            parts.append(nested.alias("relation"))
        nested = F.when(key.isNotNull(), F.struct(*parts))
    out = out.withColumn("relation", nested)
    return out.drop(*(c for c in out.columns if c.startswith(("_l", "_ref"))))


def hierarchy(hits: DataFrame, reference_column: str, none: str = "__none__") -> DataFrame:
    """(position, ref, n, children): a page's hits (rank, doc_id, ...) grouped by reference, groups in order of their first hit."""
    grouped = hits.groupBy(F.coalesce(F.col(reference_column).cast("string"), F.lit(none)).alias("ref"))
    children = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return grouped.agg(F.min("rank").alias("position"), F.count("*").alias("n"), children.alias("children")).select("position", "ref", "n", "children")


@dataclass
class View:
    """A stored view template: a base collection, the fields to keep, and named references to expand, with views of their own."""

    base: str
    select: list[str] = field(default_factory=list)
    relations: dict[str, View] = field(default_factory=dict)
    field_name: str = ""
    #: The image field whose bytes a relation carries, if any.
    image: str = ""

    @staticmethod
    def parse(spec: Mapping, known: Mapping[str, Collection]) -> View:
        """From {base_index, select, relations: [{name, field, target_index, select, relations}]}; ValueError if it is malformed."""
        if not isinstance(spec, Mapping) or spec.get("base_index") not in known:
            raise ValueError("a view needs a known base_index")
        select, relations = spec.get("select", []), spec.get("relations", [])
        if not isinstance(select, list) or not isinstance(relations, list):
            raise ValueError("select and relations must be lists")
        out = View(spec["base_index"], select)
        for r in relations:
            child = View.parse({"base_index": r.get("target_index"), "select": r.get("select", []), "relations": r.get("relations", [])}, known)
            child.field_name = r["field"]
            child.image = str(r.get("image_field") or "") if r.get("include_image") else ""
            out.relations[r.get("name") or r["field"]] = child
        return out


def expand(rows: DataFrame, view: View, collections: Mapping[str, Collection], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the base collection with its selected fields, and a nested struct a named reference.

    The whole tree becomes one plan of left joins: children are expanded before they are joined to
    their parents, so every join sees only selected columns. What doesn't resolve is null.
    """
    fields = view.select or [c for c in rows.columns if c not in keep]
    fields = [c for c in fields if c in rows.columns]
    out = rows
    for name, child in view.relations.items():
        target = collections[child.base]
        side = expand(target.docs, child, collections, (target.key,))
        key = f"_{name}_key"
        nested = F.struct(*(F.col(c) for c in side.columns if c != f"_{target.key}"))
        side = side.select(F.col(f"_{target.key}").cast("string").alias(key), nested.alias(name))
        out = out.join(side, F.col(child.field_name).cast("string") == F.col(key), "left").drop(key)
    kept = [F.col(c).alias(f"_{c}") for c in keep]
    return out.select(*kept, *(F.col(c) for c in fields), *(F.col(n) for n in view.relations))


def chosen(raw: Column, select: list[str]) -> Column:
    """A document's JSON text with the selected top-level keys, those it has; an empty selection keeps all."""
    if not select:
        return raw
    return F.to_json(F.map_filter(object_of(F.try_parse_json(raw)), lambda k, _: k.isin(select)), {"ignoreNullFields": "false"})


def expand_documents(page: DataFrame, view: View, targets: DataFrame, prefix: str = "") -> DataFrame:
    """A page of hits with `raw`, and a struct (index, id, doc_id, doc, image, relations) for each named relation of the view.

    References are read from the stored documents, also as objects that name another index. id is the
    document's number, doc_id its external id, doc its selected fields as JSON text, image the
    base64 text of the view's image field, and relations the nested ones. What doesn't resolve is null.
    """
    out = page
    for name, child in view.relations.items():
        out = stored(out.withColumn("_ref", reference_in(field_of(F.try_parse_json("raw"), child.field_name), view.base, child.base)), "relations")
        found = looked_up(targets.select("index", "doc_id", "ext_id", "raw", "images"), out.select("_ref.index", "_ref.id"))
        inner = expand_documents(found, child, targets, "_rel_") if child.relations else found
        parts = [F.col("index"), F.col("doc_id").alias("id"), F.col("ext_id").alias("doc_id"), chosen(F.col("raw"), child.select).alias("doc")]
        if child.image:
            parts.append(to_base64(F.element_at("images", F.lit(child.image))).alias("image"))
        if child.relations:
            parts.append(F.struct(*(F.col(f"_rel_{n}").alias(n) for n in child.relations)).alias("relations"))
        side = inner.select(F.col("index").alias("_index"), F.col("id").alias("_id"), F.struct(*parts).alias(prefix + name))
        out = out.join(F.broadcast(side), (F.col("_ref.index") == F.col("_index")) & (F.col("_ref.id") == F.col("_id")), "left").drop("_index", "_id", "_ref")  # at most a row a hit
    return out
