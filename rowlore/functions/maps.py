"""Ordered key-value entries and their conversion to maps and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys_of(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def last_wins(entries: Column) -> Column:
    """One entry per key: first position, last value.

    The quadratic branch only runs for rows that really repeat a key.
    """
    keys = keys_of(entries)
    unique = F.array_distinct(keys)
    merged = F.transform(
        unique,
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"),
        ),
    )
    return F.when(F.size(unique) < F.size(keys), merged).otherwise(entries)


def entries_to_map(entries: Column) -> Column:
    """Entries without repeated keys to a map."""
    return F.map_from_arrays(keys_of(entries), F.transform(entries, lambda e: e["value"]))


def entries_to_variant(entries: Column, convert: Callable[[Column], Column]) -> Column:
    """Entries without repeated keys to one VARIANT object."""
    values = F.transform(entries, lambda e: convert(e["value"]))
    return F.to_variant_object(F.map_from_arrays(keys_of(entries), values))
