"""Value typing, conversion, validation and formatting: P4-P7, P19."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowlore.model import DecodeOptions

# The accepted spellings of each logical type.
BOOLEAN_PATTERN = r"^\s*([Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee])\s*$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_PATTERNS = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}",
)
DATE_PATTERN = r"^\s*(" + "|".join(DATE_PATTERNS) + r")\s*$"
SLASH_PATTERN = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
SERIAL_EPOCH = 25569  # spreadsheet serial of 1970-01-01
SECONDS_PER_DAY = 86400


def is_boolean(c: Column) -> Column:
    return c.rlike(BOOLEAN_PATTERN)


def as_integer(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), F.trim(c).try_cast("int"))


def as_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))


def as_date(c: Column) -> Column:
    """A timestamp for the closed list of date spellings, else null."""
    text = F.trim(c)
    slash = F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
    )
    return F.when(
        c.rlike(DATE_PATTERN),
        F.when(text.rlike(SLASH_PATTERN), slash).otherwise(text.try_cast("timestamp")),
    )


def infer_type(c: Column) -> Column:
    """Boolean, number, date or string, tried in that order."""
    return (
        F.when(c.isNull(), "string")
        .when(is_boolean(c), "boolean")
        .when(as_number(c).isNotNull(), "number")
        .when(as_date(c).isNotNull(), "date")
        .otherwise("string")
    )


def typed_value(c: Column) -> Column:
    """P5: a struct naming the type and holding the value in that type's field."""
    kinds = {"b": "boolean", "i": "int", "d": "double", "s": "string"}

    def holding(name: str, **value: Column) -> Column:
        fields = [value.get(f, F.lit(None).cast(t)).alias(f) for f, t in kinds.items()]
        return F.struct(F.lit(name).alias("type"), *fields)

    blank = c.isNull() | (c == "NULL") | (c == "")
    whole, number = as_integer(c), as_number(c)
    return (
        F.when(blank, holding("null"))
        .when(is_boolean(c), holding("boolean", b=F.lower(F.trim(c)).try_cast("boolean")))
        .when(whole.isNotNull(), holding("int", i=whole))
        .when(number.isNotNull(), holding("double", d=number))
        .otherwise(holding("string", s=c))
    )


def typed_variant(c: Column) -> Column:
    """P5 folded to one VARIANT, null for `NULL` and empty text."""
    blank = c.isNull() | (c == "NULL") | (c == "")
    # coalesce stops at the first spelling that fits.
    typed = F.coalesce(
        F.when(is_boolean(c), F.lower(F.trim(c)).try_cast("boolean")).cast("variant"),
        as_integer(c).cast("variant"),
        as_number(c).cast("variant"),
        c.cast("variant"),
    )
    return F.when(~blank, typed)


def validate_value(c: Column, logical_type: Column) -> Column:
    """Does the text fit the logical type; nulls and unknown types fit."""
    kind = F.lower(logical_type)
    return (
        F.when(c.isNull(), True)
        .when(kind.isin("number", "integer"), as_number(c).isNotNull())
        .when(kind == "boolean", F.coalesce(is_boolean(c), F.lit(False)))
        .when(kind.isin("date", "datetime"), as_date(c).isNotNull())
        .otherwise(True)
    )


def number_text(c: Column) -> Column:
    """A double as text without a trailing `.0`."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def serial_timestamp(serial: Column) -> Column:
    """Spreadsheet day serial to a timestamp, to the nearest millisecond."""
    millis = F.round((serial - SERIAL_EPOCH) * SECONDS_PER_DAY * 1000)
    return F.timestamp_millis(millis.cast("bigint"))


def time_text(days: Column) -> Column:
    """A fraction of a day as `hh:mm:ss`, whole days in front as `d.`."""
    total = F.round(F.abs(days) * SECONDS_PER_DAY).cast("bigint")
    day = F.floor(total / SECONDS_PER_DAY).cast("bigint")
    rest = total % SECONDS_PER_DAY
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(rest / 3600).cast("bigint"),
        F.floor(rest % 3600 / 60).cast("bigint"),
        rest % 60,
    )
    sign = F.when(days < 0, "-").otherwise("")
    return F.concat(sign, F.when(day > 0, F.concat(day.cast("string"), F.lit("."))).otherwise(""), clock)


def format_cell(kind: Column, raw: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    """A cell's text from its kind and stored value."""
    if not options.preserve_types:
        return F.when(kind == "blank", F.lit(options.blank_value)).otherwise(F.coalesce(raw, F.lit("")))
    return (
        F.when((kind == "blank") | raw.isNull(), F.lit(options.blank_value))
        .when(kind == "boolean", F.when(raw.isin("1", "true", "True", "TRUE"), "True").otherwise("False"))
        .when(kind == "date", F.date_format(serial_timestamp(raw.try_cast("double")), options.date_format))
        .when(kind == "time", time_text(raw.try_cast("double")))
        .when(kind == "number", number_text(raw.try_cast("double")))
        .otherwise(raw)
    )


def cell_variant(kind: Column, raw: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    """P7 with booleans and numbers kept as such."""
    text = format_cell(kind, raw, options)
    if not options.preserve_types:
        return text.cast("variant")
    return (
        F.when(kind == "boolean", (text == "True").cast("variant"))
        .when(kind == "number", raw.try_cast("double").cast("variant"))
        .otherwise(text.cast("variant"))
    )


def first_scalar(c: Column) -> Column:
    """The first element of a list, or the value itself, as text."""
    head = F.try_variant_get(c, "$[0]", "string")
    kind = F.schema_of_variant(c)
    return F.when(kind.startswith("ARRAY"), head).otherwise(F.try_variant_get(c, "$", "string"))
