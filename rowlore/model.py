"""Record and catalog layouts, options, and field resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults a caller relies on when no limit is given.
LIST_LIMIT = 5
TOP_VALUES_LIMIT = 10
RECORDS_LIMIT = 100
SEARCH_LIMIT = 100
COMMON_VALUES = 10
CHUNK_TOKENS = 1000
CHUNK_OVERLAP = 100
ANSWER_MATCHES = 5
DATASET_CANDIDATES = 3
VECTOR_WIDTH = 1536

COLUMN_STRUCT = (
    "STRUCT<name: STRING, normalized_name: STRING, data_type: STRING, "
    "is_required: BOOLEAN, description: STRING, common_values: ARRAY<STRING>>"
)

RECORD_SCHEMA = (
    "id STRING, file STRING, worksheet STRING, row_number INT, text STRING, "
    "tags MAP<STRING, ARRAY<STRING>>, data VARIANT, source MAP<STRING, STRING>, "
    "payload VARIANT, embedding ARRAY<FLOAT>, schema_id STRING, "
    "import_batch_id STRING, ingest_seq BIGINT"
)

CATALOG_SCHEMA = (
    "collection STRING, id STRING, dataset_name STRING, source_file STRING, "
    "file STRING, import_date TIMESTAMP, import_batch_id STRING, "
    f"metadata MAP<STRING, STRING>, columns ARRAY<{COLUMN_STRUCT}>"
)


@dataclass(frozen=True)
class FuzzyMatch:
    """How string values of data fields are compared."""

    enabled: bool = False
    operator: str = "CONTAINS"
    min_length: int = 2
    case_insensitive: bool = True


@dataclass(frozen=True)
class DecodeOptions:
    """Decoder settings for delimited text and workbooks."""

    use_first_row_as_header: bool = True
    header_row_index: int = 0
    process_all_worksheets: bool = True
    worksheets: tuple[str, ...] = field(default_factory=tuple)
    preserve_types: bool = True
    blank_value: str = ""
    date_format: str = "yyyy-MM-dd"
    normalize_headers: bool = True
    column_prefix: str = "Column"
    include_row_numbers: bool = True
    include_worksheet_names: bool = True
    skip_empty_rows: bool = True
    skip_hidden_rows: bool = True
    skip_hidden_columns: bool = True


def variant_path(name: str) -> str:
    """JSON path of a top-level key."""
    if re.fullmatch(r"[A-Za-z_]\w*", name):
        return f"$.{name}"
    escaped = name.replace("'", "\\'")
    return f"$['{escaped}']"


def shadow_of(name: str) -> str:
    """The lower-cased copy of a text column, where a table has one."""
    return f"_lower_{name}"


def real_column(df: DataFrame, name: str) -> str | None:
    """The DataFrame's own column for a field name, matched without case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def resolve_field(df: DataFrame, name: str) -> Column:
    """A data field: the typed column when there is one, else the variant's key.

    Typed tables keep column pruning and pushdown; generic records fall back to
    `try_variant_get`.
    """
    own = real_column(df, name)
    if own is not None:
        return F.col(f"`{own}`")
    if "data" not in df.columns:
        return F.lit(None).cast("string")
    return F.try_variant_get(F.col("data"), variant_path(name), "string")


def field_type(df: DataFrame, name: str) -> str:
    own = real_column(df, name)
    return dict(df.dtypes)[own] if own is not None else "string"
