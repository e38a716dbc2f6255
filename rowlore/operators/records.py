"""Record assembly and projection: P9, P13, P14, P16, P20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.functions.maps import entries_to_variant
from rowlore.functions.names import encode_id
from rowlore.functions.sentences import parse_sentences
from rowlore.functions.values import first_scalar, typed_variant

# Payload members and the tag that only carries data between steps.
TRANSFER_TAG = "__custom_tabular_data_tag"
RECORD_COLUMNS = (
    "id", "file", "tags", "data", "source", "embedding", "payload", "schema_id", "import_batch_id",
)


def project_record(df: DataFrame, with_embedding: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The record columns; the vector only on request, so scans skip it."""
    wanted = [c for c in RECORD_COLUMNS if with_embedding or c != "embedding"]
    return df.select(*[c for c in wanted if c in df.columns], *extra)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _from_text(text: Column, name: str) -> Column:
    return _filled(F.regexp_extract(text, rf"{name} is ([^.]+)\.", 1))


def extract_lineage(df: DataFrame, text: Column, payload: Column, row_data: Column) -> DataFrame:
    """Schema id from text, payload, row data; batch id from payload, text, row data.

    `payload` and `row_data` are VARIANTs whose members may be lists.
    """

    def payload_text(name: str) -> Column:
        member = F.try_variant_get(payload, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(member) == "STRING", _filled(F.try_variant_get(member, "$", "string")))

    def row_text(name: str) -> Column:
        return _filled(first_scalar(F.try_variant_get(row_data, f"$.{name}", "variant")))

    return df.withColumn(
        "schema_id", F.coalesce(_from_text(text, "schema_id"), payload_text("schema_id"), row_text("schema_id"))
    ).withColumn(
        "import_batch_id",
        F.coalesce(
            payload_text("import_batch_id"), _from_text(text, "import_batch_id"), row_text("import_batch_id")
        ),
    )


def enrich_payload(payload: Column, data: Column, source: Column, schema_id: Column, batch_id: Column) -> Column:
    """Payload members plus the data and source as JSON text, and the lineage ids."""

    def member(name: str, value: Column, present: Column) -> Column:
        return F.when(
            present, F.map_from_arrays(F.array(F.lit(name)), F.array(value.cast("variant")))
        ).otherwise(F.expr("cast(map() as map<string, variant>)"))

    added = ("tabular_data", "source_info", "schema_id", "import_batch_id")
    has_data = data.isNotNull() & (F.to_json(data) != "{}")
    base = F.map_filter(
        F.coalesce(payload.try_cast("map<string,variant>"), F.expr("cast(map() as map<string, variant>)")),
        lambda k, v: ~(
            ((k == added[0]) & has_data)
            | ((k == added[1]) & (F.size(source) > 0))
            | ((k == added[2]) & (F.coalesce(schema_id, F.lit("")) != ""))
            | ((k == added[3]) & (F.coalesce(batch_id, F.lit("")) != ""))
        ),
    )
    return F.to_variant_object(
        F.map_concat(
            base,
            member(added[0], F.to_json(data), has_data),
            member(added[1], F.to_json(source), F.coalesce(F.size(source) > 0, F.lit(False))),
            member(added[2], schema_id, F.coalesce(schema_id, F.lit("")) != ""),
            member(added[3], batch_id, F.coalesce(batch_id, F.lit("")) != ""),
        )
    )


def assemble_record(
    df: DataFrame,
    record_id: Column,
    text: str = "text",
    tags: str = "tags",
    data: Column | None = None,
    source: Column | None = None,
    schema_id: Column | None = None,
    import_batch_id: Column | None = None,
) -> DataFrame:
    """Parsed data and source win over given ones, given ids win over parsed ids."""
    none = F.lit(None)
    data = none.cast("variant") if data is None else data
    source = none.cast("map<string,string>") if source is None else source
    schema_id = none.cast("string") if schema_id is None else schema_id
    import_batch_id = none.cast("string") if import_batch_id is None else import_batch_id
    given = df.select(
        "*", data.alias("_data"), source.alias("_source"),
        schema_id.alias("_schema"), import_batch_id.alias("_batch"),
    )
    parsed = parse_sentences(given, text)
    places = F.when(
        F.col("parsed_row").isNotNull(),
        F.array(
            F.struct(F.lit("_worksheet").alias("key"), F.col("parsed_worksheet").alias("value")),
            F.struct(F.lit("_rowNumber").alias("key"), F.col("parsed_row").cast("string").alias("value")),
        ),
    )
    lineage = F.coalesce(F.col("parsed_source"), F.array().cast("array<struct<key:string,value:string>>"))
    found = F.map_from_entries(
        F.concat(F.coalesce(places, F.array().cast("array<struct<key:string,value:string>>")), lineage)
    )
    ids = ("schema_id", "import_batch_id")
    with_ids = (
        parsed.withColumn("_found", found)
        .withColumn("schema_id", F.coalesce(_filled(F.col("_schema")), _filled(F.col("_found")["schema_id"])))
        .withColumn("import_batch_id", F.coalesce(_filled(F.col("_batch")), _filled(F.col("_found")["import_batch_id"])))
        .withColumn("_base", F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.coalesce("_source", "_found")))
    )
    kept = F.map_filter(F.col("_base"), lambda k, v: ~k.isin(*ids))
    own_ids = F.map_filter(
        F.create_map(F.lit(ids[0]), F.col("schema_id"), F.lit(ids[1]), F.col("import_batch_id")),
        lambda k, v: v.isNotNull(),
    )
    return (
        with_ids.withColumn("id", encode_id(record_id))
        .withColumn(
            "data",
            F.when(F.size("parsed") > 0, entries_to_variant(F.col("parsed"), typed_variant)).otherwise(F.col("_data")),
        )
        .withColumn("source", F.map_concat(kept, own_ids))
        .withColumn("tags", F.map_filter(F.col(tags), lambda k, v: k != TRANSFER_TAG))
        .drop("_data", "_source", "_schema", "_batch", "_found", "_base", "parsed", "parsed_source",
              "parsed_worksheet", "parsed_row")
    )
