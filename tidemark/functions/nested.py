"""Nested values: containment of objects in arrays, kinds, lengths and paths of JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECTS = "array<map<string,string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: a column is copied to each of its places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_object(objects: Column, wanted: dict[str, str | int | float | bool | None]) -> Column:
    """Whether an array of objects, given as ``from_json(text, OBJECTS)``, holds one that has all of ``wanted``; extra fields do
    not matter. Values are compared by their JSON text; a wanted null must be there and be null."""

    def text(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    def fits(o: Column) -> Column:
        out = F.lit(True)
        for k, v in wanted.items():
            out = out & (F.map_contains_key(o, F.lit(k)) & o[k].isNull() if v is None else o[k].eqNullSafe(F.lit(text(v))))
        return out

    return F.coalesce(F.exists(objects, fits), F.lit(False))


def object_values(objects: Column, field: str) -> Column:
    """The texts of one field of all objects of an array as in ``has_object``, in order; null where a field is missing."""
    return F.transform(objects, lambda o: o[field])


def variant_kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` of a variant; null where there is none."""

    def name(kind: Column) -> Column:
        return (
            F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
        )

    return bound(F.schema_of_variant(value), name)


def json_kind(json: Column, path: str = "$") -> Column:
    """``variant_kind`` of the value at a path."""
    return variant_kind(F.variant_get(F.try_parse_json(json), path, "variant"))


def json_length(json: Column, path: str = "$") -> Column:
    """Items of the array at a path; null for anything else."""
    return F.json_array_length(F.get_json_object(json, path))


def json_values(json: Column, array_path: str, field: str) -> Column:
    """``object_values`` of the array at a path."""
    return object_values(F.from_json(F.get_json_object(json, array_path), OBJECTS), field)
