"""Index schemas: the declared fields of a collection of JSON documents, and its ids and references."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from pyspark.sql import types as T

KINDS = ("text", "array", "bool", "number", "vector", "image", "query_values")
_TYPES = {
    "text": T.StringType(),
    "array": T.ArrayType(T.StringType()),
    "bool": T.BooleanType(),
    "number": T.DoubleType(),
    "vector": T.ArrayType(T.FloatType()),
    "image": T.StructType([T.StructField("format", T.StringType()), T.StructField("content", T.StringType())]),
    "query_values": T.ArrayType(T.StructType([T.StructField("query", T.StringType()), T.StructField("score", T.DoubleType())])),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    searchable: bool = True
    dim: int = 0
    max_kb: int = 256


@dataclass(frozen=True)
class Relation:
    field: str
    target_index: str = ""
    allow_cross_index: bool = True


@dataclass(frozen=True)
class ExternalId:
    field: str
    kind: str = "string"
    enforce_unique: bool = True


@dataclass
class IndexSchema:
    """Declared fields by name; undeclared ones are stored, but neither checked nor searched."""

    fields: dict[str, Field] = field(default_factory=dict)
    doc_id: ExternalId | None = None
    relation: Relation | None = None
    version: int = 1

    @staticmethod
    def parse(spec: dict) -> IndexSchema:
        """From its JSON form; a kind that isn't known, or a bare "vector" or "image", declares nothing."""
        fields = {}
        for name, given in (spec.get("fields") or {}).items():
            options = {"type": given} if isinstance(given, str) else given if isinstance(given, dict) else {}
            kind = options.get("type")
            if kind not in KINDS or (isinstance(given, str) and kind in ("vector", "image")):
                continue
            searchable = kind == "vector" or (options.get("searchable", True) and options.get("index", True))
            fields[name] = Field(name, kind, bool(searchable), int(options.get("dim", 0)), max(1, int(options.get("max_kb", 256))))
        if sum(f.kind == "vector" for f in fields.values()) > 1:
            raise ValueError("a schema has at most one vector field")
        ids, rel = spec.get("doc_id") or {}, spec.get("relation") or {}
        ids = {"field": ids} if isinstance(ids, str) else ids
        return IndexSchema(
            fields,
            ExternalId(ids["field"], ids.get("type", "string"), ids.get("enforce_unique", True)) if ids.get("field") else None,
            Relation(rel["field"], rel.get("target_index", ""), rel.get("allow_cross_index", True)) if rel.get("field") else None,
            int(spec.get("schema_version", 1)),
        )

    def spec(self) -> dict:
        """The JSON form that parse() reads."""
        out: dict = {"fields": {}, "schema_version": self.version}
        for f in self.fields.values():
            out["fields"][f.name] = {"type": f.kind, "searchable": f.searchable} | ({"dim": f.dim} if f.kind == "vector" else {}) | ({"max_kb": f.max_kb} if f.kind == "image" else {})
        if self.doc_id:
            out["doc_id"] = {"field": self.doc_id.field, "type": self.doc_id.kind, "enforce_unique": self.doc_id.enforce_unique}
        if self.relation:
            out["relation"] = {"field": self.relation.field, "target_index": self.relation.target_index, "allow_cross_index": self.relation.allow_cross_index}
        return out

    def struct(self) -> T.StructType:
        """Spark types of the declared fields, for from_json."""
        return T.StructType([T.StructField(f.name, _TYPES[f.kind]) for f in self.fields.values()])

    def names(self, *kinds: str, searchable: bool | None = None) -> list[str]:
        return [f.name for f in self.fields.values() if f.kind in kinds and (searchable is None or f.searchable == searchable)]

    @property
    def vector(self) -> Field | None:
        return next((f for f in self.fields.values() if f.kind == "vector"), None)


def schema_id(spec: dict) -> str:
    """CRC-32 of the compact JSON with sorted keys, version included and an earlier id left out."""
    body = {k: v for k, v in ({"schema_version": 1} | spec).items() if k != "schema_id"}
    return f"{zlib.crc32(json.dumps(body, sort_keys=True, separators=(',', ':'), ensure_ascii=False).encode()):08x}"
