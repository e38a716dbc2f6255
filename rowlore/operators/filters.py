"""The filter language compiled to one Column: F1-F19, F21.

A filter is a mapping from key to value: all keys must hold. A list of filters
holds when any of them does. Keys starting with `data.` name data fields, other
keys name tags. A list value means any of its items.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.functions.names import filter_key
from rowlore.model import FuzzyMatch, field_type, real_column, resolve_field, shadow_of, variant_path

log = logging.getLogger(__name__)

Filter = Mapping[str, Any]
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def data_filter(field: str, value: Any) -> dict[str, Any]:
    """a one-condition filter on a data field."""
    return {field if field.startswith("data.") else f"data.{field}": value}


def tag_filter(tag: str, value: Any) -> dict[str, Any]:
    """a one-condition filter on a tag."""
    return {tag: value}


def match_kind(value: str, fuzzy: FuzzyMatch) -> str:
    """How one string value is compared: like, fuzzy_like, contains or exact."""
    if "%" in value or "_" in value:
        return "like"
    if fuzzy.enabled and len(value) >= fuzzy.min_length:
        return {"LIKE": "fuzzy_like", "CONTAINS": "contains"}.get(fuzzy.operator.upper(), "exact")
    return "exact"


def like_pattern(value: str, kind: str) -> str:
    pattern = "%" + value.replace(" ", "%") + "%" if kind == "fuzzy_like" else value
    return pattern.replace("\\", "\\\\")


def _folded(text: str, fuzzy: FuzzyMatch) -> str:
    return text.lower() if fuzzy.case_insensitive else text


def _exact(df: DataFrame, name: str, values: list[str], fuzzy: FuzzyMatch) -> Column:
    """Equality with any of the values; whole numbers keep their column bare for pushdown."""
    kind, field = field_type(df, name), resolve_field(df, name)
    if kind in INTEGERS:
        numbers = [int(v) for v in values if re.fullmatch("-?[0-9]+", v) and str(int(v)) == v]
        return field.isin(*numbers) if numbers else F.lit(False)
    text = field if kind == "string" else field.cast("string")
    folded = [_folded(v, fuzzy) for v in values]
    shadow = real_column(df, shadow_of(real_column(df, name) or name))
    # A lower-cased copy keeps its column bare: the comparison reaches the scan.
    text = (F.col(f"`{shadow}`") if shadow else F.lower(text)) if fuzzy.case_insensitive else text
    return text == F.lit(folded[0]) if len(folded) == 1 else text.isin(*folded)


def _strings(df: DataFrame, name: str, values: list[str], fuzzy: FuzzyMatch) -> Column:
    """Any of several string values on a data field; exact ones share one IN list."""
    text = resolve_field(df, name).cast("string")
    text = F.lower(text) if fuzzy.case_insensitive else text
    kinds = [(match_kind(v, fuzzy), v) for v in values]
    exact = [v for k, v in kinds if k == "exact"]
    parts = [_exact(df, name, exact, fuzzy)] if exact else []
    for kind, value in kinds:
        if kind in ("like", "fuzzy_like"):
            parts.append(text.like(_folded(like_pattern(value, kind), fuzzy)))
        elif kind == "contains":
            parts.append(F.contains(text, F.lit(_folded(value, fuzzy))))
    return reduce(or_, parts)


def _is_list(value: Any) -> bool:
    return isinstance(value, Iterable) and not isinstance(value, (str, bytes, Mapping))


def _number_equals(field: Column, kind: Column, value: int | float | Decimal) -> Column:
    """A number of a generic record equals a number: whole ones and decimals as such, doubles only where either side is one."""
    number = lambda target: F.try_variant_get(field, "$", target)
    whole = value == value and abs(value) != float("inf") and value == int(value)
    as_double = kind.rlike("^(DOUBLE|FLOAT)") & (number("double") == F.lit(float(value)))
    if isinstance(value, float):
        as_double = kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & (number("double") == F.lit(value))
    elif Decimal(float(value)) != Decimal(value) and isinstance(value, int):
        # No double is this number.
        as_double = F.lit(False)
    parts = [as_double]
    if whole and -(1 << 63) <= value < 1 << 63:
        parts.append((kind == "BIGINT") & (number("bigint") == F.lit(int(value)).cast("bigint")))
    if not isinstance(value, float):
        digits = "decimal(38,0)" if whole and abs(value) >= 10**20 else "decimal(38,18)"
        parts.append(kind.startswith("DECIMAL") & (number(digits) == F.lit(str(value)).try_cast(digits)))
    return F.coalesce(reduce(or_, [F.coalesce(p, F.lit(False)) for p in parts]), F.lit(False))


def _variant_equals(field: Column, value: Any) -> Column:
    """A field of a generic record equals a typed value: only values of that kind do, texts do not.

    Records keep dates as text, so a date is compared with a text that is one.
    """
    kind = F.schema_of_variant(field)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(field, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float, Decimal)):
        return _number_equals(field, kind, value)
    target = "timestamp" if isinstance(value, datetime) else "date"
    return kind.rlike("^(DATE|TIMESTAMP|STRING)") & (F.try_variant_get(field, "$", "string").try_cast(target) == F.lit(value))


def data_condition(df: DataFrame, key: str, value: Any, fuzzy: FuzzyMatch = FuzzyMatch()) -> Column | None:
    """One condition on a data field, or None when there is nothing to test."""
    name = filter_key(key)[len("data."):]
    if not name:
        log.warning("filter key without a field name skipped: %r", key)
        return None
    if isinstance(value, str):
        return _strings(df, name, [value], fuzzy)
    if _is_list(value):
        items = [str(v) for v in value if v is not None and str(v) != ""]
        return _strings(df, name, items, fuzzy) if items else None
    field = resolve_field(df, name)
    if real_column(df, name) is None and "data" in df.columns:
        return _variant_equals(F.try_variant_get(F.col("data"), variant_path(name), "variant"), value)
    target = {bool: "boolean", int: "bigint", float: "double", date: "date", datetime: "timestamp"}.get(type(value), "string")
    if isinstance(value, Decimal):
        target = "decimal(38,18)"
    # Same-type columns stay bare so the comparison reaches the scan.
    native = field_type(df, name) in (target, *(INTEGERS if target == "bigint" else ()))
    return (field if native else field.try_cast(target)) == F.lit(value)


def tag_condition(tags: Column, key: str, value: Any, exact_case: bool = False) -> Column | None:
    """Any element of the tag's list equals the value."""
    listed = tags[key]
    if exact_case:
        items = [str(v) for v in value if v is not None] if _is_list(value) else [str(value)]
        return reduce(or_, [F.array_contains(listed, v) for v in items]) if items else None
    if isinstance(value, str):
        return F.exists(listed, lambda t: F.lower(t) == value.lower())
    if _is_list(value):
        items = [str(v).lower() for v in value if v is not None]
        return F.exists(listed, lambda t: F.lower(t).isin(*items)) if items else None
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return F.exists(listed, lambda t: t == text)


def compile_filter(
    filters: Sequence[Filter] | Filter | None,
    df: DataFrame,
    fuzzy: FuzzyMatch = FuzzyMatch(),
    tags: Column | None = None,
    exact_case_tags: bool = False,
) -> Column:
    """the whole filter list as one boolean Column."""
    filters = [filters] if isinstance(filters, Mapping) else list(filters or [])
    tags = F.col("tags") if tags is None else tags
    alternatives = []
    for one in filters:
        conditions = []
        for key, value in one.items():
            if value is None:
                continue
            condition = (
                data_condition(df, key, value, fuzzy)
                if key.startswith("data.")
                else tag_condition(tags, key, value, exact_case_tags)
            )
            if condition is not None:
                conditions.append(condition)
        if conditions:
            alternatives.append(reduce(and_, conditions))
    return reduce(or_, alternatives) if alternatives else F.lit(True)


def where_filters(df: DataFrame, filters, fuzzy: FuzzyMatch = FuzzyMatch(), **how) -> DataFrame:
    return df.where(compile_filter(filters, df, fuzzy, **how))


def strict_recheck(df: DataFrame, filters, tags: Column | None = None) -> DataFrame:
    """Keep only rows that meet the conditions again, with no fuzziness."""
    return df.where(compile_filter(filters, df, FuzzyMatch(enabled=False), tags=tags))


def exclude_catalog(df: DataFrame, document_type: Column) -> DataFrame:
    """guard for mixed stores that keep catalog entries among the records."""
    return df.where(document_type.isNull() | (document_type != "schema"))


def min_relevance(ranked: DataFrame, least: float, score: str = "score") -> DataFrame:
    """applied to the rows a limit has already chosen."""
    return ranked.where(F.col(score) >= least)
