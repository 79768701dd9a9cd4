"""JSON values as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_of(doc: Column, name: str) -> Column:
    """A top-level field of a document, as a variant."""
    return F.try_variant_get(doc, "$['" + name.replace("'", "\\'") + "']", "variant")


def kind_of(value: Column) -> Column:
    """JSON kind of a variant: STRING, BOOLEAN, NUMBER, ARRAY, OBJECT, NULL; null if there is none."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(name.startswith("OBJECT"), "OBJECT").when(name.startswith("ARRAY"), "ARRAY")
        .when(name == "VOID", "NULL").when(name.isin("STRING", "BOOLEAN"), name).otherwise("NUMBER")
    )


def elements_of(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def object_of(doc: Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
