"""JSON text as values: objects and arrays from columns, keys taken away, set and merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_object(**columns: Column) -> Column:
    """An object of these keys; nulls stay."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def build_array(key: list[Column], **columns: Column) -> Column:
    """Aggregate: an array of objects, ordered by the key columns."""
    rows = F.sort_array(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(key)], F.struct(*[c.alias(k) for k, c in columns.items()]).alias("row"))))
    return F.to_json(F.transform(rows, lambda r: r["row"]), {"ignoreNullFields": "false"})


def entries(json: Column) -> Column:
    """A flat object as a map; values as text, null for what is no object."""
    return F.from_json(json, "map<string,string>")


def without(json: Column, *keys: str) -> Column:
    """A flat object's map without these keys."""
    return F.map_filter(entries(json), lambda k, _: ~k.isin(*keys))


def merged(json: Column, **values: Column) -> Column:
    """A flat object's map with these keys set, whether it had them or not."""
    return F.map_concat(without(json, *values), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]))


def to_object(entries_: Column) -> Column:
    """A map as an object, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries_))))


def holds(json: Column, value: Column) -> Column:
    """Whether an array of texts contains a value."""
    return F.coalesce(F.array_contains(F.from_json(json, "array<string>"), value), F.lit(False))
