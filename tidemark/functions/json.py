"""JSON documents in string columns: containment, keys, updates and path queries.

A flat object is handled as a map of its members' texts; deeper paths go
through VARIANT, which Spark shreds and reads without a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def members(doc: Column) -> Column:
    """Top-level members as a map from key to JSON text (strings without quotes)."""
    return F.from_json(doc, "map<string,string>")


def exists_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(members(doc), F.lit(key)), F.lit(False))


def exists_any(doc: Column, *keys: str) -> Column:
    return F.arrays_overlap(F.map_keys(members(doc)), F.array(*map(F.lit, keys)))


def exists_all(doc: Column, *keys: str) -> Column:
    return F.size(F.array_intersect(F.map_keys(members(doc)), F.array(*map(F.lit, keys)))) == len(set(keys))


def contains(doc: Column, other: Column) -> Column:
    """@> for objects one level deep: every member of other is in doc with the same value."""
    mine = members(doc)
    return F.forall(F.map_entries(members(other)), lambda e: F.coalesce(F.try_element_at(mine, e.key).eqNullSafe(e.value), F.lit(False)))


def _rebuilt(m: Column) -> Column:
    """JSON text of a map of members; numbers, literals, arrays and objects as they are, else strings."""
    raw = r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|\[.*\]|\{.*\})$"
    quoted = lambda v: F.when(v.isNull(), "null").when(v.rlike(raw), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    parts = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), quoted(e.value)))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def set_key(doc: Column, key: str, value: str) -> Column:
    """jsonb_set at the top level; value is JSON text; members come out in key order."""
    rest = F.map_filter(members(doc), lambda k, v: k != key)
    return _rebuilt(F.map_concat(rest, F.create_map(F.lit(key), F.lit(value))))


def delete_key(doc: Column, key: str) -> Column:
    return _rebuilt(F.map_filter(members(doc), lambda k, v: k != key))


def strip_nulls(doc: Column) -> Column:
    return _rebuilt(F.map_filter(members(doc), lambda k, v: v.isNotNull() & (v != "null")))


def typeof(doc: Column) -> Column:
    """json_typeof."""
    t = F.btrim(doc)
    return (
        F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").otherwise("number")
    )


def is_json(doc: Column) -> Column:
    """IS JSON."""
    return F.try_parse_json(doc).isNotNull()


def value(doc: Column, path: str, kind: str) -> Column:
    """JSON_VALUE: the scalar at a path as a type, null if absent or of another type."""
    return F.try_variant_get(F.try_parse_json(doc), path, kind)


def array_at(doc: Column, path: str, element: str) -> Column:
    """The array at a path, for filters and arithmetic over its elements."""
    return F.try_variant_get(F.try_parse_json(doc), path, f"array<{element}>")


def path_filter(doc: Column, path: str, element: str, keep) -> Column:
    """$.path[*] ? (condition): elements for which keep(element) is true, null conditions dropped."""
    return F.filter(array_at(doc, path, element), lambda x: F.coalesce(keep(x), F.lit(False)))


def path_exists(doc: Column, path: str, element: str, keep) -> Column:
    return F.coalesce(F.size(path_filter(doc, path, element, keep)) > 0, F.lit(False))
