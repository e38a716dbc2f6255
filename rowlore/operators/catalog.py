"""The column catalog derived from rows: A4, A5, C1-C6, C8-C10, J1, J2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlore.functions.names import normalize_column, normalize_header
from rowlore.functions.values import infer_type, validate_value
from rowlore.model import COMMON_VALUES
from rowlore.operators.blocks import BLOCK_ROWS, numbered, text_blocks
from rowlore.plans.sizing import broadcast_if_small, materialize

# Tags every dataset description lists, examples shown, and the warnings of the parameter check.
NO_SCHEMA = "No schema found for dataset '%s'. Parameters not validated."
NO_FIELD = "Field '%s' not found in schema for dataset '%s'."
NO_FIT = "Value '%s' is not valid for field '%s' of type '%s'."
DESCRIBED_TAGS = ("project", "application", "environment", "status")
DESCRIBED_EXAMPLES = 5
LISTED_EXAMPLES = 3


def first_rows(df: DataFrame, n: int | None, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of the table, or of each group; all of them without a number.

    Groups are cut before the shuffle (window group limit), so a large file
    ships only its first rows.
    """
    if n is None:
        return df
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def to_cells(df: DataFrame, columns: list[str], seq: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows to `(by..., seq, position, column, value)` with text values."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*by, seq.alias("seq"), F.explode(cells).alias("_c")).select(*by, "seq", "_c.*")


def infer_column_types(
    cells: DataFrame, by: tuple[str, ...] = (), kind: Column | None = None
) -> DataFrame:
    """A4: majority type per column; blanks ignored, no value means string.

    `cells` holds the sampled rows; ties go to string, number, boolean, date.
    """
    kind = infer_type(F.col("value")) if kind is None else kind
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    order = ("string", "number", "boolean", "date")
    counts = (
        cells.withColumn("_t", F.when(filled, kind))
        .groupBy(*by, "position", "column")
        .agg(*[F.count_if(F.col("_t") == t).alias(f"_{t}") for t in order])
    )
    best = F.greatest(*[F.col(f"_{t}") for t in order])
    vote = F.lit(None).cast("string")
    for t in reversed(order):
        vote = F.when(F.col(f"_{t}") == best, t).otherwise(vote)
    return counts.select(*by, "position", "column", vote.alias("data_type"))


def common_values(cells: DataFrame, by: tuple[str, ...] = (), limit: int = COMMON_VALUES) -> DataFrame:
    """A5: the first distinct non-empty values of each column, in the order seen."""
    group = (*by, "position", "column")
    seen = (
        cells.where(F.coalesce(F.col("value"), F.lit("")) != "")
        .groupBy(*group, "value")
        .agg(F.min("seq").alias("seq"))
    )
    w = Window.partitionBy(*group).orderBy("seq", "value")
    kept = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value"))), lambda e: e["value"])
    return kept.groupBy(*group).agg(ordered.alias("common_values"))


def extract_schema(
    df: DataFrame,
    columns: list[str],
    order: str,
    typed: bool = True,
    by: tuple[str, ...] = (),
    sample_rows: int | None = None,
) -> DataFrame:
    """One row per column with name, normalised name, type and common values.

    `typed=False` gives every column the type string, as delimited text does.
    All rows count unless `sample_rows` asks for the first ones only.
    """
    sample = first_rows(df.select(*by, *{order, *columns}), sample_rows, (order,), by)
    return describe_cells(to_cells(sample, columns, F.col(order), by), typed, by)


def describe_cells(cells: DataFrame, typed: bool = True, by: tuple[str, ...] = (), kind: Column | None = None) -> DataFrame:
    """C1 over already sampled cells."""
    kind = F.lit("string") if not typed else kind
    types = infer_column_types(cells, by, kind)
    values = common_values(cells, by)
    return (
        types.join(values, [*by, "position", "column"], "left")
        .select(
            *by,
            "position",
            F.col("column").alias("name"),
            normalize_header(F.col("column")).alias("normalized_name"),
            F.lit("string").alias("data_type") if not typed else "data_type",
            F.lit(False).alias("is_required"),
            F.lit("").alias("description"),
            F.coalesce("common_values", F.array().cast("array<string>")).alias("common_values"),
        )
    )


def collect_columns(columns: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Column rows to the nested form, one row per dataset."""
    item = F.struct(
        "position", "name", "normalized_name", "data_type", "is_required", "description", "common_values"
    )
    return columns.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["normalized_name"].alias("normalized_name"),
                c["data_type"].alias("data_type"),
                c["is_required"].alias("is_required"),
                c["description"].alias("description"),
                c["common_values"].alias("common_values"),
            ),
        ).alias("columns")
    )


def schema_columns(schemas: DataFrame, *keep: str) -> DataFrame:
    """The exploded form: one row per catalog column with its position."""
    return schemas.select(*keep, F.posexplode("columns").alias("position", "_c")).select(*keep, "position", "_c.*")


def merge_schema(
    previous: DataFrame | None,
    cells: DataFrame,
    match_normalized: bool = False,
    keep: int = COMMON_VALUES,
) -> DataFrame:
    """Fold new cells into the previous columns.

    `previous` has `position, name, normalized_name, data_type, common_values`;
    `cells` has `seq, position, column, value`. Known columns keep their type
    unless two different non-string types meet; the latest `keep` distinct
    values by first sight stay. `match_normalized` also matches on the
    normalised name and is what an update in place uses; `changed` tells whether
    the column differs from before.

    Values are reduced to one row per (column, value) with map-side combine
    before anything is ordered, and only `keep` rows per column go further.
    """
    spark = cells.sparkSession
    if previous is None:
        previous = spark.createDataFrame(
            [], "position int, name string, normalized_name string, data_type string, common_values array<string>"
        )
    fold = normalize_column if match_normalized else F.lower
    old = previous.select(
        fold(F.col("name")).alias("key"), "position", "name", "normalized_name", "data_type", "common_values"
    )
    # Cells shrink to distinct (column, value) pairs first, in a hash aggregate over plain numbers.
    new = (
        cells.select(
            fold(F.col("column")).alias("key"), F.col("column").alias("name"), F.coalesce("value", F.lit("")).alias("value"),
            F.col("seq").cast("bigint").alias("seq"), "position", F.col("value").isNull().alias("empty"),
        )
        .groupBy("key", "name", "value")
        .agg(F.min("seq").alias("seq"), F.min("position").alias("position"), F.bool_and("empty").alias("empty"))
        .select("key", "value", "seq", F.struct("seq", "position", "name").alias("new"), "empty")
    )
    # Previous values precede every new one: they get negative ordinals.
    before = old.select("key", F.posexplode("common_values").alias("_i", "value"), F.size("common_values").alias("_n")).select(
        "key", "value", (F.col("_i") - F.col("_n")).cast("bigint").alias("seq"),
        F.lit(None).cast("struct<seq:bigint,position:int,name:string>").alias("new"), F.lit(None).cast("boolean").alias("empty"),
    )
    # Spellings of one column that differ only in case meet here, on the reduced rows.
    distinct = (
        before.unionByName(new)
        .groupBy("key", "value")
        .agg(F.min("seq").alias("seq"), F.min("new").alias("new"), F.bool_and("empty").alias("empty"))
    )
    latest = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("value"))
    # The list carries every column of `distinct`, so that this branch and the next share one shuffle.
    item = F.struct((-F.col("_rn")).alias("_o"), "value", "new", "empty")
    values = (
        distinct.withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") <= keep)
        .groupBy("key")
        .agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["value"]).alias("common_values"))
    )
    kind = F.when(F.col("empty"), "string").when(F.col("new").isNotNull(), infer_type(F.col("value")))
    columns = distinct.withColumn("type", kind).groupBy("key").agg(
        (F.max("seq") >= 0).alias("_new_value"),
        F.min_by("type", "new.seq").alias("first_type"),
        F.collect_set(F.when(F.col("type") != "string", F.col("type"))).alias("_types"),
        F.min("new").alias("_at"),
    )
    start = F.coalesce("data_type", "first_type")
    kinds = F.array_union(F.coalesce("_types", F.array().cast("array<string>")), F.array(start))
    merged_type = F.when((start != "string") & (F.size(kinds) > 1), "string").otherwise(start)
    name = F.coalesce("name", "_at.name")
    # Every key of `old` without values or cells is kept by the full join.
    return (
        columns.join(old.drop("common_values"), "key", "full")
        .join(values, "key", "left")
        .select(
            name.alias("name"),
            F.coalesce("normalized_name", normalize_column(name)).alias("normalized_name"),
            merged_type.alias("data_type"),
            F.coalesce("common_values", F.array().cast("array<string>")).alias("common_values"),
            F.struct(
                F.coalesce(F.col("position"), F.lit(1 << 30)).alias("old"),
                F.col("_at.seq").alias("seq"),
                F.col("_at.position").alias("pos"),
            ).alias("sort_key"),
            (
                F.col("name").isNull()
                | F.coalesce("_new_value", F.lit(False))
                | (merged_type != F.col("data_type"))
            ).alias("changed"),
        )
    )


def update_entry(entry: DataFrame, cells: DataFrame, at: Column, keep: int = COMMON_VALUES) -> DataFrame:
    """One catalog entry with new cells folded in; its import date becomes `at` only if some column changed.

    Columns are matched by name or normalised name, and keep what the fold does not touch.
    """
    before = schema_columns(entry, "id")
    merged = merge_schema(before.select("position", "name", "normalized_name", "data_type", "common_values"), cells, True, keep)
    rest = before.select(F.col("name").alias("_name"), "is_required", F.col("description").alias("_description"))
    full = merged.join(rest, F.col("name") == F.col("_name"), "left")
    column = F.struct(
        "name", "normalized_name", "data_type", F.coalesce("is_required", F.lit(False)).alias("is_required"),
        F.coalesce("_description", F.lit("")).alias("description"), "common_values",
    )
    ordered = F.array_sort(F.collect_list(F.struct("sort_key", column.alias("c"))))
    one = full.agg(F.transform(ordered, lambda e: e["c"]).alias("_columns"), F.bool_or("changed").alias("_changed"))
    changed = F.coalesce("_changed", F.lit(False))
    # One row each.
    met = entry.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    return met.select(*[
        (F.when(changed, at).otherwise(F.col(c)) if c == "import_date" else F.when(changed, F.col("_columns")).otherwise(F.col(c)) if c == "columns" else F.col(c)).alias(c)
        for c in entry.columns
    ])


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """C3 by name: the most recent import of each dataset, ties by id."""
    rest = [c for c in schemas.columns if c != "dataset_name"]
    newest = F.max_by(F.struct(*rest), F.struct("import_date", "id")).alias("_s")
    return schemas.groupBy("dataset_name").agg(newest).select("dataset_name", "_s.*")


def schema_by_dataset(schemas: DataFrame, dataset: str) -> DataFrame:
    return schemas.where(F.col("dataset_name") == dataset).orderBy(F.desc("import_date"), F.desc("id")).limit(1)


def schema_by_id(schemas: DataFrame, schema_id: str) -> DataFrame:
    return schemas.where(F.col("id") == schema_id)


def schemas_by_source_file(schemas: DataFrame, file: str) -> DataFrame:
    return schemas.where(F.col("source_file") == file)


def list_datasets(schemas: DataFrame, distinct: bool = False) -> DataFrame:
    """C4: dataset names, one per catalog entry unless distinct ones are asked for."""
    names = schemas.select("dataset_name")
    return names.distinct() if distinct else names


def schema_for_record(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Records with their catalog entry, null when it is missing."""
    entry = schemas.select(
        F.col("id").alias("schema_id"), F.struct(*schemas.columns).alias("schema")
    )
    return records.join(broadcast_if_small(entry), "schema_id", "left")


def match_columns(params: DataFrame, schemas: DataFrame, field: Column) -> DataFrame:
    """Parameters with the first catalog column whose name or normalised name fits.

    Both spellings become equi-join keys, so the OR never turns into a nested
    loop. The catalog's spellings are broadcast where they measure small. Beyond, parameters
    are written first, so that the join's own shuffles can be split where many name one (dataset, field).
    """
    columns = schema_columns(latest_schemas(schemas), "dataset_name")
    spellings = columns.withColumn(
        "_match", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("normalized_name"))))
    ).select("dataset_name", "_match", F.struct("position", "name", "normalized_name", "data_type").alias("_col"))
    spellings = spellings.groupBy("dataset_name", "_match").agg(F.min_by("_col", "_col.position").alias("column"))
    keyed = params.withColumn("_match", F.lower(field))
    spellings = materialize(spellings, "spellings")
    if (small := broadcast_if_small(spellings)) is not spellings:
        return keyed.join(small, ["dataset_name", "_match"], "left").drop("_match")
    # Written, so that the plan can split a hot key of the join.
    return materialize(keyed, "params").join(spellings, ["dataset_name", "_match"], "left").drop("_match")


def validate_params(params: DataFrame, schemas: DataFrame) -> DataFrame:
    """Parameters `(dataset_name, key, value)` checked against the catalog.

    Adds `valid_key` (renamed to the normalised name when the value fits) and
    `warning`.
    """
    prefixed = F.col("key").startswith("data.")
    field = F.when(prefixed, F.substring("key", 6, 1 << 30)).otherwise(F.col("key"))
    known = broadcast_if_small(latest_schemas(schemas).select("dataset_name", F.lit(True).alias("_known")))
    matched = match_columns(params, schemas, field).join(known, "dataset_name", "left")
    found, fits = F.col("column").isNotNull(), validate_value(F.col("value"), F.col("column.data_type"))
    renamed = F.when(prefixed, F.concat(F.lit("data."), F.col("column.normalized_name"))).otherwise(
        F.col("column.normalized_name")
    )
    return matched.select(
        *params.columns,
        F.when(found & fits, renamed).otherwise(F.col("key")).alias("valid_key"),
        F.when(
            F.col("_known").isNull(),
            F.format_string(NO_SCHEMA, "dataset_name"),
        )
        .when(~found, F.format_string(NO_FIELD, field, "dataset_name"))
        .when(
            ~fits,
            F.format_string(NO_FIT, "value", field, F.col("column.data_type")),
        )
        .alias("warning"),
    )


def _examples(values: Column, n: int) -> Column:
    quoted = F.transform(F.slice(values, 1, n), lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    shown = F.concat(F.lit(" (e.g., "), F.array_join(quoted, ", "), F.lit(")"))
    return F.when(F.size(values) > 0, shown).otherwise("")


def describe_schema(columns: Column) -> Column:
    """A dataset's fields as text, by normalised name, with up to five examples."""
    ordered = F.array_sort(
        F.transform(
            columns,
            lambda c: F.struct(
                c["normalized_name"].alias("k"),
                F.concat(
                    F.lit("- data."), c["normalized_name"], _examples(c["common_values"], DESCRIBED_EXAMPLES)
                ).alias("line"),
            ),
        )
    )
    lines = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
    fields = F.when(F.size(columns) > 0, lines).otherwise("(no columns known)")
    tags = "\n".join(f"- {t}" for t in DESCRIBED_TAGS)
    return F.concat(F.lit("Data fields:\n"), fields, F.lit("\nTag fields:\n" + tags))


def list_fields(columns: Column) -> Column:
    """The fields in stored order with up to three examples."""
    return F.array_join(
        F.transform(
            columns,
            lambda c: F.concat(F.lit("- "), c["normalized_name"], _examples(c["common_values"], LISTED_EXAMPLES)),
        ),
        "\n",
    )


def describe_all(schemas: DataFrame, brief: bool = False) -> DataFrame:
    """One description per dataset; `brief` lists fields in stored order."""
    body = list_fields(F.col("columns")) if brief else describe_schema(F.col("columns"))
    return schemas.select(
        "dataset_name", "id", F.concat(F.lit("Dataset: "), F.col("dataset_name"), F.lit("\n"), body).alias("description")
    )


def catalog_text(schemas: DataFrame, brief: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """The whole catalog as `(block, first_row, rows, description)`, by dataset and id; blocks join by an empty line.

    A catalog of any number of entries is put together in blocks, never in one row.
    """
    ordered = numbered(describe_all(schemas, brief), (), ("dataset_name", "id"))
    return text_blocks(ordered, (), {"description": (F.col("description"), "\n\n")}, rows)
