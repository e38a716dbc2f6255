"""The sentence form of a row and the older key-value form: P10-P12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.functions.maps import last_wins
from rowlore.functions.names import normalize_column

# The wording of the sentence form.
RECORD_HEAD = r"Record from worksheet ([^,]+), row ([0-9]+):"
RECORD_TAIL = r"(?s)Record from worksheet [^,]+, row [0-9]+:.*$"
RECORD_WORDS = "record from worksheet"
LINEAGE_KEYS = ("schema_id", "import_batch_id")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def row_sentence(
    worksheet: Column,
    row_number: Column,
    entries: Column,
    schema_id: Column | None = None,
    import_batch_id: Column | None = None,
) -> Column:
    """P10: one row as text; keys starting with `_` and lineage keys are left out."""
    empty = F.lit(None).cast("string")
    schema_id = empty if schema_id is None else schema_id
    import_batch_id = empty if import_batch_id is None else import_batch_id
    shown = F.filter(
        entries, lambda e: ~e["key"].startswith("_") & ~e["key"].isin(*LINEAGE_KEYS)
    )
    words = F.transform(
        shown,
        lambda e: F.concat(e["key"], F.lit(" is "), F.coalesce(e["value"], F.lit("NULL")), F.lit(".")),
    )

    def lineage(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name} is "), c, F.lit(". "))).otherwise("")

    return F.rtrim(
        F.concat(
            F.lit("Record from worksheet "),
            worksheet,
            F.lit(", row "),
            row_number.cast("string"),
            F.lit(": "),
            lineage("schema_id", schema_id),
            lineage("import_batch_id", import_batch_id),
            F.array_join(words, " "),
        )
    )


def parse_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `parsed_worksheet`, `parsed_row`, `parsed_source`, `parsed` entries.

    Only the first record of a text is read. Values stay text; turn `parsed`
    into typed data with `entries_to_variant(parsed, typed_variant)`.
    """
    body = F.col("_body")
    ci_words = "(?is)" + RECORD_WORDS + ".*$"
    pairs = F.filter(
        F.transform(F.split(body, r"\. "), lambda p: F.concat(F.rtrim(_strip(p), F.lit(".")), F.lit("."))),
        lambda p: F.instr(p, " is ") > 1,
    )
    entry = F.transform(
        pairs,
        lambda p: F.struct(
            _strip(F.substring_index(p, " is ", 1)).alias("key"),
            _strip(F.rtrim(F.regexp_replace(p, r"(?s)^.*? is ", ""), F.lit("."))).alias("value"),
        ),
    )
    lineage = F.filter(F.col("_pairs"), lambda e: F.lower(e["key"]).isin(*LINEAGE_KEYS))
    fields = F.filter(
        F.col("_pairs"),
        lambda e: ~F.lower(e["key"]).isin(*LINEAGE_KEYS) & ~F.lower(e["key"]).startswith(RECORD_WORDS),
    )
    as_source = F.transform(
        lineage, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    as_data = F.transform(
        fields, lambda e: F.struct(normalize_column(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return (
        df.withColumn("_head", F.regexp_extract(F.col(text), RECORD_TAIL, 0))
        .withColumn("parsed_row", F.regexp_extract("_head", RECORD_HEAD, 2).try_cast("int"))
        .withColumn(
            "parsed_worksheet",
            F.when(F.col("parsed_row").isNotNull(), _strip(F.regexp_extract("_head", RECORD_HEAD, 1))),
        )
        # Everything after the first colon of the head, cut at a second record.
        .withColumn(
            "_body",
            F.when(
                F.col("parsed_row").isNotNull(),
                _strip(F.regexp_replace(F.regexp_replace("_head", "(?s)^[^:]*:", ""), RECORD_TAIL, "")),
            ),
        )
        .withColumn(
            "_body",
            F.when(F.lower(F.col("_body")).startswith(RECORD_WORDS), F.col("_body")).otherwise(
                F.regexp_replace("_body", ci_words, "")
            ),
        )
        .withColumn("_pairs", F.coalesce(entry, F.array().cast("array<struct<key:string,value:string>>")))
        # Own columns, so that each expression is evaluated once.
        .withColumn("parsed_source", as_source)
        .withColumn("parsed", as_data)
        .withColumn("parsed_source", last_wins(F.col("parsed_source")))
        .withColumn("parsed", last_wins(F.col("parsed")))
        .drop("_head", "_body", "_pairs")
    )


def parse_key_values(df: DataFrame, text: str = "text") -> DataFrame:
    """`Key: value` lines; same output columns as `parse_sentences`."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda p: F.instr(p, ":") > 1)
    entry = F.transform(
        lines,
        lambda p: F.struct(
            _strip(F.substring_index(p, ":", 1)).alias("key"),
            _strip(F.regexp_replace(p, "(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    place = F.element_at(
        F.filter(F.col("_pairs"), lambda e: (e["key"] == "Worksheet") & (F.instr(e["value"], ",") > 1)), -1
    )["value"]
    after_comma = _strip(F.regexp_replace(place, "(?s)^[^,]*,", ""))
    meta = F.filter(F.col("_pairs"), lambda e: e["key"].startswith("_"))
    fields = F.filter(F.col("_pairs"), lambda e: (e["key"] != "Worksheet") & ~e["key"].startswith("_"))
    as_data = F.transform(
        fields, lambda e: F.struct(normalize_column(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return (
        df.withColumn("_pairs", F.coalesce(entry, F.array().cast("array<struct<key:string,value:string>>")))
        .withColumn("parsed_worksheet", _strip(F.substring_index(place, ",", 1)))
        .withColumn("parsed_row", F.regexp_extract(after_comma, r"^Row: \s*([0-9]+)\s*$", 1).try_cast("int"))
        .withColumn("parsed_source", meta)
        .withColumn("parsed", as_data)
        .withColumn("parsed_source", last_wins(F.col("parsed_source")))
        .withColumn("parsed", last_wins(F.col("parsed")))
        .drop("_pairs")
    )
