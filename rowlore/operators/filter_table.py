"""Filters held in tables: F20 templates, F22 many filters against one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.functions.names import normalize_filter_key
from rowlore.model import FuzzyMatch
from rowlore.plans.sizing import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, materialize, measured

# Filters per array in the shuffled form.
BLOCK_FILTERS = 256
# Fields filters may be found by in the broadcast form, one join each; with more, filters are found by a shuffle.
MAX_ANCHORS = 32
# A value is hot that more than 1/HOT_SHARE of all wanted cells hold; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
# Verdicts of one record and list in the shuffled form, about.
LISTED_VERDICTS = 1 << 16
CELL = ("kind", "key", "text")
CONDITIONS = (
    "array<struct<key:string,kind:string,values:array<struct<how:string,text:string>>>>"
)


def filter_templates(replies: DataFrame, reply: str = "reply", by: tuple[str, ...] = ("reply_id",)) -> DataFrame:
    """JSON replies to filter rows `(by..., ordinal, key, values)`.

    An array of objects gives one filter per object, a single object one filter.
    Strings and lists of strings are kept, other JSON kinds dropped. A reply
    without anything usable gives one empty filter (null key).
    """
    parsed = F.try_parse_json(F.trim(F.col(reply)))
    kind = F.schema_of_variant(F.col("_json"))
    objects = F.when(kind.startswith("ARRAY"), F.col("_json").try_cast("array<variant>")).when(
        kind.startswith("OBJECT"), F.array(F.col("_json"))
    )
    valid = F.filter(
        F.coalesce(objects, F.array().cast("array<variant>")),
        lambda v: F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "OBJECT<>"),
    )
    # One malformed element makes the array unreadable as a list of objects.
    broken = F.size(F.filter(objects, lambda v: ~F.schema_of_variant(v).startswith("OBJECT"))) > 0
    rows = (
        replies.select(*by, parsed.alias("_json"))
        .select(*by, F.when(broken, F.array().cast("array<variant>")).otherwise(valid).alias("_objects"))
        .select(*by, F.posexplode_outer("_objects").alias("_pos", "_object"))
    )
    members = F.filter(
        F.map_entries(F.col("_object").try_cast("map<string,variant>")),
        lambda e: F.schema_of_variant(e["value"]).isin("STRING") | F.schema_of_variant(e["value"]).startswith("ARRAY"),
    )

    def strings(v: Column) -> Column:
        listed = F.transform(
            F.filter(v.try_cast("array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
            lambda x: F.try_variant_get(x, "$", "string"),
        )
        return F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(listed)

    return (
        rows.select(*by, F.coalesce("_pos", F.lit(0)).alias("ordinal"), F.explode_outer(members).alias("_m"))
        .select(
            *by,
            "ordinal",
            F.col("_m.key").alias("key"),
            F.when(F.col("_m").isNotNull(), strings(F.col("_m.value"))).alias("values"),
        )
    )


def _how(value: Column, is_tag: Column, fuzzy: FuzzyMatch) -> Column:
    """Comparison of one value, prepared once per filter instead of once per record."""
    pattern = F.contains(value, F.lit("%")) | F.contains(value, F.lit("_"))
    fuzzy_kind = {"LIKE": "fuzzy_like", "CONTAINS": "contains"}.get(fuzzy.operator.upper(), "exact")
    gate = (F.length(value) >= fuzzy.min_length) & F.lit(fuzzy.enabled)
    kind = F.when(is_tag, "exact").when(pattern, "like").when(gate, fuzzy_kind).otherwise("exact")
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    text = (
        F.when(kind == "like", text)
        .when(kind == "fuzzy_like", F.concat(F.lit("%"), F.replace(text, F.lit(" "), F.lit("%")), F.lit("%")))
        .otherwise(value)
    )
    text = F.lower(text) if fuzzy.case_insensitive else F.when(is_tag, F.lower(text)).otherwise(text)
    # `%word%` without inner wildcards is a plain substring test.
    core = F.substring(text, 2, F.length(text) - 2)
    simple = text.startswith("%") & text.endswith("%") & (F.length(text) > 2) & ~core.rlike(r"[%_\\]")
    wild = kind.isin("like", "fuzzy_like")
    return F.struct(
        F.when(wild & simple, "contains").when(wild, "like").otherwise(kind).alias("how"),
        F.when(wild & simple, core).otherwise(text).alias("text"),
    )


def pack_filters(
    conditions: DataFrame, by: tuple[str, ...], fuzzy: FuzzyMatch = FuzzyMatch(), partition: str | None = None
) -> DataFrame:
    """Filter rows `(by..., key, values)` to one row per filter with its conditions.

    Conditions without usable values are skipped, as are data keys without a
    field name; a filter left with none matches everything.
    """
    keep = [*by, *([partition] if partition else [])]
    key = normalize_filter_key(F.col("key"))
    is_tag = ~F.col("key").startswith("data.")
    values = F.filter(F.col("values"), lambda v: v.isNotNull() & (v != ""))
    one = F.struct(
        F.when(is_tag, key).otherwise(F.substring(key, 6, 1 << 30)).alias("key"),
        F.when(is_tag, "tag").otherwise("data").alias("kind"),
        F.transform(values, lambda v: _how(v, is_tag, fuzzy)).alias("values"),
    )
    usable = F.col("key").isNotNull() & (F.size(values) > 0) & (key != "data.")
    grouped = conditions.select(*keep, F.when(usable, one).alias("_c"))
    return grouped.groupBy(*keep).agg(F.collect_list("_c").cast(CONDITIONS).alias("conditions"))


def _holds(condition: Column, data: Column, tags: Column, case_insensitive: bool) -> Column:
    field = data[condition["key"]]
    field = F.lower(field) if case_insensitive else field
    on_data = F.exists(
        condition["values"],
        lambda v: F.when(v["how"] == "exact", field == v["text"])
        .when(v["how"] == "contains", F.contains(field, v["text"]))
        .otherwise(F.like(field, v["text"])),
    )
    wanted = F.transform(condition["values"], lambda v: v["text"])
    on_tag = F.arrays_overlap(F.transform(tags[condition["key"]], lambda t: F.lower(t)), wanted)
    return F.coalesce(F.when(condition["kind"] == "tag", on_tag).otherwise(on_data), F.lit(False))


def _cells(data: Column, tags: Column, case_insensitive: bool) -> Column:
    """A record's values as an array of (kind, key, text), texts as filters compare them."""
    none = F.array().cast("array<struct<kind:string,key:string,text:string>>")

    def cell(kind: str, key: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), text.alias("text"))

    fields = F.filter(F.map_entries(data), lambda e: e["value"].isNotNull())
    own = F.transform(fields, lambda e: cell("data", e["key"], F.lower(e["value"]) if case_insensitive else e["value"]))
    listed = F.transform(F.map_entries(tags), lambda e: F.transform(_folded_tags(e["value"]), lambda t: cell("tag", e["key"], t)))
    return F.concat(F.coalesce(own, none), F.coalesce(F.flatten(listed), none))


def _folded_tags(values: Column) -> Column:
    """The distinct values of a tag in lower case, in the order of the list."""
    return F.array_distinct(F.transform(F.filter(values, lambda t: t.isNotNull()), F.lower))


def _exact(filters: DataFrame, partition: str, filter_id: str) -> DataFrame:
    """`(partition, filter, _i, kind, key, texts)`: the conditions that name whole values."""
    exact = F.filter("conditions", lambda c: F.forall(c["values"], lambda v: v["how"] == "exact"))
    rows = filters.select(partition, filter_id, F.posexplode(exact).alias("_i", "_c"))
    texts = F.array_distinct(F.transform("_c.values", lambda v: v["text"]))
    return rows.select(partition, filter_id, "_i", "_c.kind", "_c.key", texts.alias("texts"))


def _frequencies(cells: DataFrame, wanted: DataFrame, partition: str) -> DataFrame:
    """`(partition, kind, key, text, n)`: how many records hold each wanted value."""
    by = [partition, *CELL]
    return cells.select(*by).join(wanted, by, "left_semi").groupBy(*by).agg(F.count("*").alias("n"))


def _anchored(filters: DataFrame, partition: str, filter_id: str, cells: DataFrame, small: bool) -> tuple[DataFrame, DataFrame | None]:
    """Filters with `_anchor` (kind, key, texts), the exact condition that fewest records meet; null without any.

    Frequencies are measured, in one pass over the records' values, where some
    filter has a choice; of filters that are not `small` always, and given back.
    """
    options = _exact(filters, partition, filter_id)
    anchor, frequencies = F.struct(*CELL[:2], "texts"), None
    if not small or not options.filter("_i > 0").isEmpty():
        spread_texts = options.select("*", F.explode("texts").alias("text"))
        wanted = spread_texts.select(partition, *CELL).distinct()
        # Values of filters that measured small are as small as those.
        frequencies = _frequencies(cells, F.broadcast(wanted), partition) if small else materialize(_frequencies(cells, wanted, partition), "frequencies")
        cost = spread_texts.join(frequencies, [partition, *CELL], "left").groupBy(partition, filter_id, "_i")
        options = options.join(cost.agg(F.sum(F.coalesce("n", F.lit(0))).alias("_n")), [partition, filter_id, "_i"])
    else:
        options = options.withColumn("_n", F.lit(0))
    best = options.groupBy(partition, filter_id).agg(F.min_by(anchor, F.struct("_n", "_i")).alias("_anchor"))
    return materialize(filters.join(best, [partition, filter_id], "left"), "anchored"), frequencies


def _gathered(filters: DataFrame, by: list[str], filter_id: str, name: str) -> DataFrame:
    """One array of filters per group, for filter tables already measured small."""
    item = F.struct(F.col(filter_id).alias("id"), "conditions", F.when(F.col("_anchor.kind") == "tag", F.col("_anchor.texts")).alias("texts"))
    return filters.groupBy(*by).agg(F.collect_list(item).alias(name))


def _blocks(filters: DataFrame, by: list[str], filter_id: str, name: str) -> DataFrame:
    """Arrays of about `BLOCK_FILTERS` filters, filled by hash; a large group gets several rows."""
    sizes = filters.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_FILTERS).alias("_blocks"))
    placed = filters.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64(filter_id), F.col("_blocks")))
    return _gathered(placed, [*by, "_block"], filter_id, name).drop("_block")


def _fits(df: DataFrame) -> bool:
    rows, size = measured(df, BROADCAST_ROWS)
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def all_hold(conditions: Column, case_insensitive: bool) -> Column:
    """Whether a record, as the maps `_data` and `_tags`, meets all packed conditions."""
    return F.forall(conditions, lambda c: _holds(c, F.col("_data"), F.col("_tags"), case_insensitive))


def _holding(listed: str, case_insensitive: bool, tag: tuple[str, str] | None = None) -> Column:
    """Ids of the listed filters that hold; one found by a tag counts at the first value of the record that it names."""

    def first(f: Column) -> Column:
        return F.get(F.filter(F.col(tag[0]), lambda t: F.array_contains(f["texts"], t)), F.lit(0)) == F.col(tag[1])

    kept = F.filter(listed, lambda f: (first(f) & all_hold(f["conditions"], case_insensitive)) if tag else all_hold(f["conditions"], case_insensitive))
    return F.transform(kept, lambda f: f["id"])


def _looked_up(met: DataFrame, marked: DataFrame, fields: list[tuple[str, str]], has_rest: bool, filter_id: str, partition: str, case_insensitive: bool) -> DataFrame:
    """Verdicts by one broadcast join per field; a record with several values of a tag has a row for each."""
    tags = [(i, key) for i, (kind, key) in enumerate(fields) if kind == "tag"]
    for i, key in tags:
        met = met.withColumn(f"_listed_{i}", F.coalesce(_folded_tags(F.col("_tags")[key]), F.array().cast("array<string>")))
    met = met.withColumn("_slot", F.lit(0))
    if tags:
        most = F.greatest(F.lit(1), F.lit(1), *[F.size(f"_listed_{i}") for i, _ in tags])
        met = met.withColumn("_slot", F.explode(F.sequence(F.lit(0), most - 1)))
    found = []
    for i, (kind, key) in enumerate(fields):
        name, value, tag = f"_by_{i}", f"_value_{i}", None
        own = marked.where((F.col("_anchor.kind") == kind) & (F.col("_anchor.key") == key)).withColumn(value, F.explode("_anchor.texts"))
        if kind == "tag":
            met, tag = met.withColumn(value, F.get(f"_listed_{i}", F.col("_slot"))), (f"_listed_{i}", value)
        else:
            field = F.lower(F.col("_data")[key]) if case_insensitive else F.col("_data")[key]
            met = met.withColumn(value, F.when(F.col("_slot") == 0, field))
        met = met.join(F.broadcast(_gathered(own, [partition, value], filter_id, name)), [partition, value], "left")
        found.append(_holding(name, case_insensitive, tag))
    if has_rest:
        rest = marked.where(F.col("_anchor").isNull())
        by = [partition, "_slot"] if tags else [partition]
        met = met.join(F.broadcast(_gathered(rest.withColumn("_slot", F.lit(0)), by, filter_id, "_rest")), by, "left")
        found.append(_holding("_rest", case_insensitive))
    none = F.array().cast(f"array<{dict(marked.dtypes)[filter_id]}>")
    # Each filter has one anchor, so no two arrays hold the same filter.
    return met.withColumn("verdicts", F.flatten(F.array(none, *[F.coalesce(f, none) for f in found])))


def _shuffled(met: DataFrame, cells: DataFrame, marked: DataFrame, frequencies: DataFrame, filter_id: str, partition: str, record_id: str, case_insensitive: bool) -> DataFrame:
    """Verdicts by an inverted index: values of records and filters meet in a join that moves ids.

    A hot value is dealt over several keys, its filters copied to each. Filters
    without an exact condition meet all records of their collection, in blocks.
    """
    by = [partition, *CELL]
    total = frequencies.agg(F.sum("n")).first()[0] or 0
    hot = frequencies.where(F.col("n") * HOT_SHARE > total).select(*by, F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    postings = marked.where(F.col("_anchor").isNotNull()).select(partition, "_anchor.kind", "_anchor.key", F.explode("_anchor.texts").alias("text"), filter_id)
    postings = postings.join(F.broadcast(hot), by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    held = cells.join(F.broadcast(hot), by, "left").withColumn("_part", F.pmod(F.xxhash64(record_id), parts).cast("int")).drop("_parts")
    pairs = held.join(postings, [*by, "_part"]).select(partition, record_id, filter_id).distinct()
    asked = pairs.join(marked.select(partition, filter_id, "conditions"), [partition, filter_id])
    facts = met.select(partition, record_id, "_data", "_tags")
    held = asked.join(facts, [partition, record_id]).where(all_hold(F.col("conditions"), case_insensitive)).select(partition, record_id, filter_id).distinct()
    lists = max(1, marked.count() // LISTED_VERDICTS)
    listed = held.groupBy(partition, record_id, F.pmod(F.xxhash64(filter_id), F.lit(lists)).alias("_block")).agg(F.collect_list(filter_id).alias("verdicts")).drop("_block")
    salts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = met.withColumn("_salt", F.pmod(F.xxhash64(record_id), F.lit(salts)).cast("int"))
    blocks = _blocks(marked.where(F.col("_anchor").isNull()), [partition], filter_id, "_rest")
    copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = salted.join(copies, [partition, "_salt"]).withColumn("verdicts", _holding("_rest", case_insensitive))
    return met.join(listed, [partition, record_id]).unionByName(rest.drop("_salt", "_rest"))


def filter_verdicts(
    records: DataFrame,
    filters: DataFrame,
    filter_id: str = "filter_id",
    partition: str = "collection",
    record_id: str = "id",
    data_map: Column | None = None,
    tags: Column | None = None,
    fuzzy: FuzzyMatch = FuzzyMatch(),
) -> DataFrame:
    """records with `verdicts`, the ids of the filters they meet; a record may have several rows, each with other filters.

    `filters` comes from `pack_filters(..., partition=...)`. A filter with exact
    conditions, on data fields or tags, is found by the one that fewest records
    meet, as measured; the other conditions are tested on what is found. Below
    the broadcast bound that is one hash join per field and records are not
    shuffled. Beyond it values and filters meet through an inverted index, where
    `record_id` must name one record of its collection. Filters without an exact condition
    are tested on every record of their collection.
    """
    data_map = F.col("data").try_cast("map<string,string>") if data_map is None else data_map
    tags = F.col("tags") if tags is None else tags
    ci = fuzzy.case_insensitive
    met = records.withColumn("_data", data_map).withColumn("_tags", tags)
    filters = materialize(filters, "filters")
    small = _fits(filters)
    # Only fields that some filter names are looked at.
    named = _exact(filters, partition, filter_id).select("kind", "key").distinct()
    cells = met.select(partition, record_id, F.explode(_cells(F.col("_data"), F.col("_tags"), ci)).alias("_c"))
    cells = cells.select(partition, record_id, "_c.*").join(F.broadcast(named) if small else broadcast_if_small(named), ["kind", "key"], "left_semi")
    marked, frequencies = _anchored(filters, partition, filter_id, cells, small)
    found = [tuple(r) for r in marked.select("_anchor.kind", "_anchor.key").distinct().limit(MAX_ANCHORS + 2).collect()]
    fields = sorted(f for f in found if f[0] is not None)
    # Each value of an anchor gets a copy of its filter.
    if small and len(fields) <= MAX_ANCHORS and _fits(marked.withColumn("_copy", F.explode_outer("_anchor.texts"))):
        verdicts = _looked_up(met, marked, fields, len(fields) < len(found), filter_id, partition, ci)
    else:
        if small:
            marked, frequencies = _anchored(filters, partition, filter_id, cells, False)
        verdicts = _shuffled(met, cells, marked, frequencies, filter_id, partition, record_id, ci)
    return verdicts.where(F.size("verdicts") > 0).select(*records.columns, "verdicts")


def filter_table_match(
    records: DataFrame,
    filters: DataFrame,
    filter_id: str = "filter_id",
    partition: str = "collection",
    record_id: str = "id",
    data_map: Column | None = None,
    tags: Column | None = None,
    fuzzy: FuzzyMatch = FuzzyMatch(),
) -> DataFrame:
    """every record paired with the ids of the filters it meets, a row for each; see `filter_verdicts`."""
    found = filter_verdicts(records, filters, filter_id, partition, record_id, data_map, tags, fuzzy)
    return found.withColumn(filter_id, F.explode("verdicts")).drop("verdicts")
