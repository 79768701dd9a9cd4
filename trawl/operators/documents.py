"""Documents as JSON: validation, preparation, bulk ingest, replacement, merging, deletion and lookup.

A collection's documents are rows (doc_id BIGINT, ext_id STRING, raw STRING), where raw is the
JSON text. Declared fields are read from it with from_json, and checked as variants on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import crc32_hex, from_base64, let, to_base64
from trawl.functions.variants import elements_of, field_of, kind_of, object_of
from trawl.operators.ordering import global_rank
from trawl.schema import IndexSchema


def _all(elements: Column, test) -> Column:
    return F.coalesce(F.forall(elements, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def parsed(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `_doc`, the parsed document; null for what isn't JSON."""
    return docs.withColumn("_doc", F.try_parse_json(raw))


def problem(schema: IndexSchema, doc: Column) -> Column:
    """The first rule that a document (a variant) breaks; null if it is valid.

    Declared fields are optional, but an explicit null breaks their rule. A vector may be longer than
    declared. Images that were stored before (without content) are accepted.
    """
    found = [F.when(F.coalesce(kind_of(doc), F.lit("")) != "OBJECT", "not a JSON object")]
    for f in schema.fields.values():
        v = field_of(doc, f.name)
        kind = kind_of(v)
        if f.kind == "text":
            bad = kind != "STRING"
        elif f.kind == "bool":
            bad = kind != "BOOLEAN"
        elif f.kind == "number":
            bad = kind != "NUMBER"
        elif f.kind == "array":
            bad = (kind != "ARRAY") | ~_all(elements_of(v), lambda e: F.schema_of_variant(e) == "STRING")
        elif f.kind == "vector":
            bad = (kind != "ARRAY") | (F.size(elements_of(v)) < f.dim)
        elif f.kind == "image":
            content = F.try_variant_get(v, "$.content", "string")
            size = F.length(from_base64(content))
            bad = (kind != "OBJECT") | ((kind_of(field_of(v, "content")).isNull() | (kind_of(field_of(v, "content")) != "STRING")) & field_of(v, "hash").isNull()) | F.coalesce(size > f.max_kb * 1024, F.lit(False))
        else:
            def hint(e: Column) -> Column:
                score = F.try_variant_get(e, "$.score", "double")
                return (kind_of(field_of(e, "query")) == "STRING") & (kind_of(field_of(e, "score")) == "NUMBER") & score.between(0, 1)

            bad = (kind != "ARRAY") | ~_all(elements_of(v), hint)
        found.append(F.when(v.isNotNull() & bad, f"field {f.name} is not a valid {f.kind}"))
    if schema.doc_id:
        kind = kind_of(field_of(doc, schema.doc_id.field))
        wanted = kind.isin("STRING", "NUMBER") if schema.doc_id.kind == "string" else (kind == "NUMBER") | F.try_variant_get(field_of(doc, schema.doc_id.field), "$", "string").rlike(r"^\d+$")
        found.append(F.when(~F.coalesce(wanted, F.lit(False)), f"document id {schema.doc_id.field} is missing or invalid"))
    if schema.relation:
        v = field_of(doc, schema.relation.field)
        kind = kind_of(v)
        found.append(F.when(v.isNotNull() & ~kind.isin("STRING", "NUMBER", "OBJECT", "NULL"), "invalid reference"))
        found.append(F.when((kind == "OBJECT") & field_of(v, "id").isNull(), "reference without id"))
        if not schema.relation.allow_cross_index:
            target = F.coalesce(F.try_variant_get(v, "$.index", "string"), F.lit(""))
            found.append(F.when((kind == "OBJECT") & ~target.isin("", schema.relation.target_index), "reference to another index"))
    return F.coalesce(*found)


def external_id(schema: IndexSchema, doc: Column) -> Column:
    """The id that a document gives itself; whole numbers lose leading zeros where ids are numbers."""
    if schema.doc_id is None:
        return F.lit(None).cast("string")
    text = F.try_variant_get(field_of(doc, schema.doc_id.field), "$", "string")
    return F.try_to_number(text, F.lit("999999999999999999")).cast("bigint").cast("string") if schema.doc_id.kind == "number" else text


def merged(old: Column, new: Column) -> Column:
    """JSON text of the top-level merge of two JSON texts: keys of `new` replace those of `old`."""
    a, b = object_of(F.try_parse_json(old)), object_of(F.try_parse_json(new))
    return let(b, lambda y: F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(y, k)), y), {"ignoreNullFields": "false"}))


def prepared(docs: DataFrame, schema: IndexSchema, now: Column | None = None, raw: str = "raw") -> DataFrame:
    """Stamps `_created_at` (unless given) and `_updated_at` in epoch milliseconds, and turns images into their metadata.

    `images` gets the decoded bytes by field; in the document stay an image's format, size and
    CRC-32. Images that a column `images` had before stay for the fields the document gives no content for.
    """
    millis = F.unix_millis(F.current_timestamp()) if now is None else now
    out = parsed(docs, raw)
    changed = [F.coalesce(F.try_variant_get(F.col("_doc"), "$._created_at", "bigint"), millis).alias("_created_at"), millis.alias("_updated_at")]
    given_images = []
    for i, name in enumerate(schema.names("image")):
        # Columns of their own: whatever uses the content or its bytes reads them, and an image is decoded once.
        given, data = field_of(F.col("_doc"), name), F.col(f"_data{i}")
        out = out.withColumn(f"_content{i}", F.try_variant_get(given, "$.content", "string")).withColumn(f"_data{i}", from_base64(F.col(f"_content{i}")))
        meta = F.struct(F.coalesce(F.try_variant_get(given, "$.format", "string"), F.lit("")).alias("format"), F.length(data).alias("bytes"), crc32_hex(data).alias("hash"))
        changed.append(F.when(F.col(f"_content{i}").isNotNull(), meta).alias(name))
        given_images.append(F.struct(F.lit(name).alias("key"), data.alias("value")))
    text = merged(F.col(raw), F.to_json(F.struct(*changed)))
    none = F.create_map().cast("map<string,binary>")
    new = F.map_from_entries(F.filter(F.array(*given_images), lambda e: e["value"].isNotNull())) if given_images else none
    old = F.map_filter(F.coalesce("images", none), lambda k, _: ~F.map_contains_key(new, k)) if "images" in docs.columns else none
    return out.withColumn(raw, text).withColumn("images", F.map_concat(old, new)).drop("_doc", *(f"_{x}{i}" for i, _ in enumerate(given_images) for x in ("content", "data")))


def bulk(batch: DataFrame, schema: IndexSchema, existing: DataFrame | None = None, continue_on_error: bool = True, ordinal: str = "ordinal", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a batch (ordinal, raw): accepted rows get ext_id, rejected ones `error`.

    Where ids must be unique, an id that the collection has, or that an earlier row of the batch
    has, is rejected. Without continue_on_error nothing from the first error on is accepted.
    """
    rows = parsed(batch, raw).withColumn("error", problem(schema, F.col("_doc"))).withColumn("ext_id", external_id(schema, F.col("_doc"))).drop("_doc")
    if schema.doc_id and schema.doc_id.enforce_unique:
        valid = F.col("error").isNull() & F.col("ext_id").isNotNull()
        earlier = F.row_number().over(Window.partitionBy("ext_id", valid).orderBy(ordinal)) > 1
        rows = rows.withColumn("error", F.when(valid & earlier, "document id exists").otherwise(F.col("error")))
        if existing is not None:
            known = existing.select("ext_id", F.lit(True).alias("_known")).filter("ext_id is not null").distinct()
            rows = rows.join(known, "ext_id", "left").withColumn("error", F.when(F.col("error").isNull() & F.col("_known"), "document id exists").otherwise(F.col("error"))).drop("_known")
    if not continue_on_error:
        first = rows.filter("error is not null").agg(F.min(ordinal).alias("_first"))
        rows = rows.crossJoin(F.broadcast(first)).withColumn("_late", F.coalesce(F.col(ordinal) > F.col("_first"), F.lit(False)))
        rows = rows.filter("not _late").drop("_first", "_late")
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select(ordinal, "error")


def with_doc_ids(rows: DataFrame, last: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """Assigns consecutive doc_ids after `last`, in order of the ordinal."""
    return global_rank(rows, ordinal, "doc_id").withColumn("doc_id", F.col("doc_id") + F.lit(last))


def typed(docs: DataFrame, schema: IndexSchema, raw: str = "raw") -> DataFrame:
    """The documents with a column for each declared field, vectors cut to their declared length."""
    out = docs.withColumn("_typed", F.from_json(raw, schema.struct()))
    for f in schema.fields.values():
        value = F.col("_typed").getField(f.name)
        out = out.withColumn(f.name, F.slice(value, 1, f.dim) if f.kind == "vector" and f.dim else value)
    return out.drop("_typed")


def upserted(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of docs replaced by, or joined with, those of changes with the same columns; equal doc_ids in changes must not occur."""
    return docs.join(changes.select("doc_id"), "doc_id", "left_anti").unionByName(changes.select(docs.columns))


def deleted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def patched(docs: DataFrame, patches: DataFrame, schema: IndexSchema, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) after merging patches (doc_id, patch); a patch for no document, or one that makes it invalid, is rejected."""
    joined = patches.select("doc_id", "patch").join(docs, "doc_id", "left").withColumn("_new", merged(F.col("raw"), F.col("patch")))
    error = F.when(F.col("raw").isNull(), "no such document").otherwise(problem(schema, F.try_parse_json("_new")))
    checked = joined.withColumn("error", error)
    changed = checked.filter("error is null").withColumn("raw", F.col("_new")).select(docs.columns)
    return upserted(docs, prepared(changed, schema, now).select(docs.columns)), checked.filter("error is not null").select("doc_id", "error")


def lookup(docs: DataFrame, provided: str) -> DataFrame:
    """The document with an external id, or else, if the text is a number, the one with that doc_id."""
    by_ext = docs.filter(F.col("ext_id") == provided).withColumn("_by", F.lit(0))
    if not provided.isdigit():
        return by_ext.drop("_by")
    number = str(int(provided))
    both = by_ext.unionByName(docs.filter((F.col("ext_id") == number) & F.lit(number != provided)).withColumn("_by", F.lit(1))).unionByName(docs.filter(F.col("doc_id") == int(number)).withColumn("_by", F.lit(2)))
    return both.orderBy("_by").limit(1).drop("_by")


def stored_match(docs: DataFrame, field: str, value: object, raw: str = "raw") -> DataFrame:
    """(doc_id) of documents whose stored field equals a JSON value, or, if it is an array, has an element that does. Numbers compare as doubles, other kinds must agree."""
    import json

    wanted = F.parse_json(F.lit(json.dumps(value)))
    v = field_of(F.try_parse_json(F.col(raw)), field)

    def same(e: Column) -> Column:
        numbers = F.try_variant_get(e, "$", "double") == F.try_variant_get(wanted, "$", "double")
        texts = F.to_json(e) == F.to_json(wanted)
        return (kind_of(e) == kind_of(wanted)) & F.when(kind_of(wanted) == "NUMBER", numbers).otherwise(texts)

    hit = F.when(kind_of(v) == "ARRAY", F.exists(elements_of(v), lambda e: F.coalesce(same(e), F.lit(False)))).otherwise(same(v))
    return docs.filter(F.coalesce(hit, F.lit(False))).select("doc_id")


def column_match(docs: DataFrame, column: str, value: object, id_col: str = "doc_id") -> DataFrame:
    """stored_match for a collection that already has typed columns: the filter reaches the scan."""
    kind = docs.schema[column].dataType.typeName()
    hit = F.array_contains(column, value) if kind == "array" else F.col(column) == F.lit(value)
    return docs.filter(hit).select(F.col(id_col).alias("doc_id"))


def image_base64(docs: DataFrame, field: str, *columns: str) -> DataFrame:
    """(doc_id, content) and the given columns: a stored image's bytes as base64 on one line, of documents that have it.

    Documents without the image leave by a generator and not by a filter, which Spark would move
    below the decoding and so decode everything twice.
    """
    data = F.filter(F.array(F.element_at("images", F.lit(field))), lambda d: d.isNotNull())
    return docs.select("doc_id", *columns, F.explode(data).alias("_data")).select("doc_id", to_base64(F.col("_data")).alias("content"), *columns)
