"""Typed objects: class definitions, inserts and validation against properties."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.functions.scalars import variant_kind

# Fixed value: how many objects a query without a limit returns.
DEFAULT_LIMIT = 25

# Declared property type -> variant types that satisfy it.
VARIANT_TYPES = {
    "text": ["STRING"],
    "string": ["STRING"],
    "int": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "boolean": ["BOOLEAN"],
    "date": ["STRING", "TIMESTAMP"],
    "uuid": ["STRING"],
    "blob": ["STRING"],
    "object": ["OBJECT"],
    "geoCoordinates": ["OBJECT"],
    "phoneNumber": ["OBJECT"],
}
# Fixed patterns: texts that stand for a date with time and zone, and for an identifier.
DATE = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Property:
    name: str
    data_type: list[str]


@dataclass(frozen=True)
class ObjectClass:
    """A class of typed objects; ``raw`` adds fields that the typed ones override."""

    name: str
    vectorizer: str = ""
    properties: list[Property] = field(default_factory=list)
    raw: dict[str, object] = field(default_factory=dict)

    def body(self) -> dict[str, object]:
        typed: dict[str, object] = {"class": self.name}
        if self.vectorizer:
            typed["vectorizer"] = self.vectorizer
        if self.properties:
            typed["properties"] = [
                {"name": item.name, "dataType": item.data_type} for item in self.properties
            ]
        return {**self.raw, **typed}


def _is_of(value: Column, name: str) -> Column:
    """Whether one value, no list, is of a declared type; a class name stands for a list of references."""
    if name not in VARIANT_TYPES:
        return variant_kind(value).startswith("ARRAY")
    fits = variant_kind(value).isin(VARIANT_TYPES[name])
    text = F.try_variant_get(value, "$", "string")
    if name == "date":
        real = F.try_to_timestamp(F.regexp_replace(F.upper(text), r"\.\d+", "")).isNotNull()
        return fits & ((variant_kind(value) != "STRING") | (text.rlike(DATE) & real))
    return fits & text.rlike(UUID) if name == "uuid" else fits


def is_of(value: Column, name: str) -> Column:
    """Whether a value is of a declared type; a list is when all its members are."""
    if not name.endswith("[]"):
        return _is_of(value, name)
    members = F.try_variant_get(value, "$", "array<variant>")
    each = F.forall(members, lambda member: _is_of(member, name.removesuffix("[]")))
    return variant_kind(value).startswith("ARRAY") & each


def property_state(properties: Column, item: Property) -> Column:
    """``missing``, ``valid`` or ``wrong_type`` for one declared property."""
    value = F.try_variant_get(properties, f"$['{item.name}']", "variant")
    missing = value.isNull() | F.is_variant_null(value)
    valid = reduce(or_, [F.coalesce(is_of(value, name), F.lit(False)) for name in item.data_type], F.lit(False))
    return F.when(missing, "missing").when(valid, "valid").otherwise("wrong_type")


def unknown_count(properties: Column, declared: list[Property]) -> Column:
    """Number of fields of an object that its class does not declare."""
    names = F.map_keys(F.try_variant_get(properties, "$", "map<string,variant>"))
    known = F.array(*[F.lit(item.name) for item in declared]).cast("array<string>")
    return F.coalesce(F.size(F.array_except(names, known)), F.lit(0))


def validate(objects: DataFrame, of: ObjectClass, properties: str = "properties") -> DataFrame:
    """Add a state column per declared property and the number of unknown fields."""
    states = {
        f"{item.name}_state": property_state(F.col(properties), item) for item in of.properties
    }
    return objects.withColumns(
        {**states, "unknown_fields": unknown_count(F.col(properties), of.properties)}
    )


def typed_objects(rows: DataFrame, of: ObjectClass) -> DataFrame:
    """Rows ``id, properties[, vector]`` as objects of one class, ready to append."""
    vector = F.col("vector") if "vector" in rows.columns else F.lit(None)
    return rows.select(
        F.lit(of.name).alias("class"),
        F.col("id").cast("string").alias("id"),
        "properties",
        vector.cast("array<double>").alias("vector"),
    )


def limited(rows: DataFrame, *order: Column | str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first rows of a total order, 25 unless stated."""
    return rows.orderBy(*order).limit(limit)
