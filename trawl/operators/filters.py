"""Filters on hits, and the clamping of request parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.schema import IndexSchema

#: Default, least and greatest value of each integer parameter.
BOUNDS = {"from": (0, 0, 1_000_000), "size": (10, 1, 500), "distance": (1, 0, 3), "ann_probes": (0, 0, 256), "ef_search": (0, 0, 1024), "max_relation_depth": (1, 0, 5)}


def bounded(name: str, value: object) -> int:
    """A parameter within its bounds; what doesn't begin with a number gives the default."""
    default, least, most = BOUNDS[name]
    m = re.match(r"\s*[+-]?\d+", str(value)) if value is not None else None
    return min(most, max(least, int(m.group()))) if m else default


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _true(value: object) -> bool:
    return str(value).lower() == "true" or str(value) == "1"


def between(column: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; a missing bound doesn't bind, a missing value fails."""
    out = column.isNotNull()
    if low is not None:
        out &= column >= F.lit(low)
    if high is not None:
        out &= column <= F.lit(high)
    return out


def _stored_element(field: str, value: str) -> Column:
    """Whether an array of the stored document has a string, whatever else it holds."""
    elements = F.try_variant_get(F.try_parse_json("raw"), f"$.{field}", "array<variant>")
    return F.exists(elements, lambda e: F.coalesce((F.schema_of_variant(e) == "STRING") & (e.cast("string") == value), F.lit(False)))


def conditions(schema: IndexSchema, params: Mapping[str, object], columns: list[str]) -> list[Column]:
    """Conditions of a request's parameters, all of which must hold.

    range_field with range_min and range_max; tag and label (membership in `tags` and `labels`);
    flag; filter_<field> by the field's kind; filter_<field>_min and _max. Tags, labels and the
    flag are also found in the stored document (a column `raw`) where they aren't declared. Bounds
    that aren't numbers are ignored; an equality with a number that isn't one raises ValueError. A
    range over a field that is no searchable number matches nothing.
    """
    out: list[Column] = []
    never = F.lit(False)
    field = params.get("range_field")
    if field:
        f = schema.fields.get(str(field))
        numeric = f is not None and f.kind == "number" and f.searchable
        out.append(between(F.col(str(field)), _number(params.get("range_min")), _number(params.get("range_max"))) if numeric else never)
    for name, column in (("tag", "tags"), ("label", "labels")):
        if params.get(name):
            out.append(F.array_contains(column, str(params[name])) if column in columns else _stored_element(column, str(params[name])) if "raw" in columns else never)
    if params.get("flag") not in (None, ""):
        stored = F.try_variant_get(F.try_parse_json("raw"), "$.flag", "variant")
        own = F.col("flag") if "flag" in columns else F.when(F.schema_of_variant(stored) == "BOOLEAN", stored.cast("boolean")) if "raw" in columns else F.lit(None).cast("boolean")
        out.append(own == F.lit(_true(params["flag"])))
    for name, f in schema.fields.items():
        value = params.get(f"filter_{name}")
        if value not in (None, ""):
            if f.kind == "number":
                out.append((F.col(name) == F.lit(float(value))) if f.searchable else never)  # type: ignore[arg-type]
            elif f.kind == "bool":
                out.append((F.col(name) == F.lit(_true(value))) if f.searchable else never)
            elif f.kind == "array":
                out.append(F.array_contains(name, str(value)) if f.searchable else never)
            else:
                out.append((F.col(name) == F.lit(str(value))) if f.kind == "text" else never)
        if f.kind == "number" and (params.get(f"filter_{name}_min") is not None or params.get(f"filter_{name}_max") is not None):
            out.append(between(F.col(name), _number(params.get(f"filter_{name}_min")), _number(params.get(f"filter_{name}_max"))))
    return out


def apply(rows: DataFrame, schema: IndexSchema, params: Mapping[str, object]) -> DataFrame:
    """Rows that meet all conditions."""
    found = conditions(schema, params, rows.columns)
    return rows.filter(reduce(lambda a, b: a & b, found)) if found else rows
