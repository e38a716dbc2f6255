"""Names and identifiers: P1-P3, P8, P15, P17, P18."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dataset names treated as placeholders.
GENERIC_NAMES = ("", "default", "tabular")
GENERIC_PART = "index"
GENERIC_LENGTH = 20


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def normalize_header(c: Column) -> Column:
    """Word characters stay, everything else becomes one underscore."""
    return _squeeze(F.regexp_replace(c, r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]", "_"))


def normalize_column(c: Column) -> Column:
    """Snake case, ASCII letters and digits only."""
    snake = F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", "_"))
    return _squeeze(F.regexp_replace(snake, "[^a-z0-9]", "_"))


def normalize_filter_key(c: Column) -> Column:
    """P3 over a column of keys: only `data.` keys are rewritten."""
    snake = F.lower(F.regexp_replace(F.substring(c, 6, 1 << 30), "(?<=[a-z])(?=[A-Z])", "_"))
    return F.when(c.startswith("data."), F.concat(F.lit("data."), snake)).otherwise(c)


def filter_key(key: str) -> str:
    """P3 for one key while a filter is compiled."""
    if not key.startswith("data."):
        return key
    return "data." + re.sub("(?<=[a-z])(?=[A-Z])", "_", key[5:]).lower()


def encode_id(c: Column) -> Column:
    """base64 of the UTF-8 bytes with `=` written as `_`."""
    # Legacy sessions wrap base64 lines: drop the breaks.
    plain = F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.replace(plain, F.lit("="), F.lit("_"))


def decode_id(c: Column) -> Column:
    """P8 reversed; ids that are no base64 of UTF-8 text decode to the empty string."""
    raw = F.try_to_binary(F.replace(c, F.lit("_"), F.lit("=")), F.lit("base64"))
    return F.when(c.isNotNull(), F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit("")))


def sanitize_name(c: Column) -> Column:
    """Runs of characters no file name may hold become one underscore."""
    return F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_")


def row_key(*parts: Column) -> Column:
    """A stable id per source row, so a re-import replaces its rows."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def effective_dataset_name(dataset: Column, file: Column) -> Column:
    """A placeholder dataset name gives way to the file stem."""
    low = F.lower(F.coalesce(dataset, F.lit("")))
    generic = (
        low.isin(*GENERIC_NAMES)
        | F.contains(low, F.lit(GENERIC_PART))
        | ((F.length(low) > GENERIC_LENGTH) & F.contains(low, F.lit("-")))
    )
    return F.when(generic, file_stem(file_stem(file))).otherwise(dataset)


def schema_id(file: Column, when: Column, salt: Column) -> Column:
    """`schema_{stem}_{timestamp}_{8 hex}`, the hex taken from a salt."""
    return F.concat_ws(
        "_",
        F.lit("schema"),
        file_stem(file),
        F.date_format(when, "yyyyMMddHHmmss"),
        F.substring(F.sha2(salt.cast("string"), 256), 1, 8),
    )
