"""Index definitions: field types by path, analyzers, synonyms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

FIELD_TYPES = {"string", "autocomplete", "token", "number", "date", "boolean", "objectId", "uuid", "geo", "document", "embeddedDocuments", "vector", "knnVector", "stringFacet", "numberFacet", "dateFacet"}
#: Token values are cut to this many characters.
MAX_TOKEN = 8191


def default_type(kind: T.DataType) -> list[dict]:
    """The fields that a dynamic mapping gives a column."""
    if isinstance(kind, T.ArrayType):
        return [{"type": "embeddedDocuments", "dynamic": True}] if isinstance(kind.elementType, T.StructType) else default_type(kind.elementType)
    if isinstance(kind, T.StringType):
        return [{"type": "string"}]
    if isinstance(kind, T.BooleanType):
        return [{"type": "boolean"}]
    if isinstance(kind, T.NumericType):
        return [{"type": "number"}]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [{"type": "date"}]
    if isinstance(kind, T.StructType):
        return [{"type": "document", "dynamic": True}]
    return []


@dataclass(frozen=True)
class IndexDefinition:
    """fields: path to one definition or several; an unmapped path has its default type if the mapping is dynamic."""

    name: str = "default"
    id_column: str = "_id"
    dynamic: bool = True
    fields: dict = field(default_factory=dict)
    analyzer: str = "lucene.standard"
    search_analyzer: str | None = None
    analyzers: dict = field(default_factory=dict)
    synonyms: dict = field(default_factory=dict)
    similarity: str = "bm25"
    stored_source: tuple[str, ...] | None = None
    sort: tuple[tuple[str, int], ...] = ()

    def __post_init__(self):
        for path, specs in self.fields.items():
            kinds = []
            for spec in self._list(specs):
                if spec is None:
                    raise ValueError(f"{path}: a field definition cannot be null")
                if spec.get("type") not in FIELD_TYPES:
                    raise ValueError(f"{path}: unknown field type {spec.get('type')}")
                if spec["type"] == "autocomplete" and not 1 <= spec.get("minGrams", 2) <= spec.get("maxGrams", 15):
                    raise ValueError(f"{path}: minGrams must be from 1 to maxGrams")
                if spec["type"] == "vector" and not 1 <= spec.get("numDimensions", 0) <= 8192:
                    raise ValueError(f"{path}: numDimensions must be from 1 to 8192")
                kinds.append(spec["type"])
            if len(set(kinds)) != len(kinds):
                raise ValueError(f"{path}: a type is defined twice")

    @staticmethod
    def _list(specs):
        return specs if isinstance(specs, list) else [specs]

    def of(self, path: str, kind: str, schema_type: T.DataType | None) -> dict | None:
        """The definition of a type at a path, or None where it is not indexed so."""
        if path in self.fields:
            return next((s for s in self._list(self.fields[path]) if s["type"] == kind), None)
        if self.dynamic and schema_type is not None:
            return next((s for s in default_type(schema_type) if s["type"] == kind), None)
        return None
