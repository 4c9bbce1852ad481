"""Nested payloads: their string leaves as one array, and expressions that put new leaves in.

A payload is a column of structs, arrays and maps.  Its schema is compiled once, on the
driver, to one nested expression; rows are not taken apart.  A leaf's path has a segment for
every field name, map key and array index (from 0, as text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = list[Column]
Chosen = Callable[[Path], Column]


def holds_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(holds_strings(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_strings(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_strings(dtype.valueType)
    return isinstance(dtype, T.StringType)


def string_leaves(value: Column, dtype: T.DataType, chosen: Chosen | None = None, path: Path | None = None) -> Column:
    """The string leaves in order as an array (keys are no leaves; nulls are left out), those that ``chosen`` takes by path."""
    path = path or []
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        take = value.isNotNull() if chosen is None else value.isNotNull() & chosen(path)
        return F.when(take, F.array(value)).otherwise(none)
    if isinstance(dtype, T.StructType):
        parts = [string_leaves(value[f.name], f.dataType, chosen, [*path, F.lit(f.name)]) for f in dtype.fields if holds_strings(f.dataType)]
        return F.concat(*parts) if parts else none
    if isinstance(dtype, T.ArrayType) and holds_strings(dtype):
        inner = F.transform(value, lambda x, i: string_leaves(x, dtype.elementType, chosen, [*path, i.cast("string")]))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(dtype, T.MapType) and holds_strings(dtype):
        inner = F.transform(F.map_entries(value), lambda e: string_leaves(e["value"], dtype.valueType, chosen, [*path, e["key"].cast("string")]))
        return F.coalesce(F.flatten(inner), none)
    return none


def map_leaves(value: Column, dtype: T.DataType, change: Callable[[Column], Column], chosen: Chosen | None = None, path: Path | None = None) -> Column:
    """The payload with ``change`` applied to the string leaves that ``chosen`` takes; all else as it is."""
    path = path or []
    if isinstance(dtype, T.StringType):
        return change(value) if chosen is None else F.when(chosen(path), change(value)).otherwise(value)
    if not holds_strings(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = [map_leaves(value[f.name], f.dataType, change, chosen, [*path, F.lit(f.name)]).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x, i: map_leaves(x, dtype.elementType, change, chosen, [*path, i.cast("string")]))
    return F.transform_values(value, lambda k, v: map_leaves(v, dtype.valueType, change, chosen, [*path, k.cast("string")]))


def path_segments(patterns: Column) -> Column:
    """Path patterns as arrays of segments: split at dots, trimmed, empty ones left out."""
    return F.transform(patterns, lambda p: F.filter(F.transform(F.split(p, r"\."), lambda s: F.trim(s)), lambda s: s != ""))


def path_allowed(segments: Column, path: Path) -> Column:
    """Whether a pattern of ``segments`` (see :func:`path_segments`) names the path; ``*`` stands for one segment."""

    def names(p: Column) -> Column:
        out = F.size(p) == len(path)
        for i, s in enumerate(path):
            own = F.get(p, F.lit(i))
            out = out & ((own == "*") | (own == s))
        return out

    return F.coalesce(F.exists(segments, names), F.lit(False))
