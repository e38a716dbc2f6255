"""Questions to answers: T6, T7, T9, T10, T13, T14, over a table of questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlore.functions.vectors import rank_key
from rowlore.model import ANSWER_MATCHES, DATASET_CANDIDATES, SEARCH_LIMIT, FuzzyMatch
from rowlore.operators.aggregates import dedup_first
from rowlore.operators.blocks import BLOCK_ROWS, numbered, text_blocks
from rowlore.operators.catalog import describe_all, latest_schemas, schema_columns, validate_params
from rowlore.operators.filter_table import CONDITIONS, all_hold, filter_templates, filter_verdicts, pack_filters
from rowlore.operators.masked import masked_search
from rowlore.operators.phrases import phrase_matches
from rowlore.operators.retrieve import similar_batch
from rowlore.operators.text import complete_batch, words
from rowlore.plans.prompts import build_prompt, parse_dataset_reply
from rowlore.plans.sizing import BROADCAST_ROWS, broadcast_if_small, materialize

# Datasets looked at first for each word of a question.
RANK_DEPTH = 16
# How much a question word counts when it is part of a dataset name, a field name, an example value.
NAME_WEIGHT, FIELD_WEIGHT, VALUE_WEIGHT = 3, 2, 1


def _name_words(c):
    return words(F.regexp_replace(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " "), "_", " "))


def catalog_words(schemas: DataFrame) -> DataFrame:
    """`(dataset_name, word, weight)`: the words a dataset is known by, at their best weight."""
    newest = latest_schemas(schemas)
    columns = schema_columns(newest, "dataset_name")

    def weighted(df: DataFrame, listed, weight: int) -> DataFrame:
        return df.select("dataset_name", F.explode(listed).alias("word"), F.lit(weight).alias("weight"))

    return (
        weighted(newest, _name_words(F.col("dataset_name")), NAME_WEIGHT)
        .unionByName(weighted(columns, _name_words(F.col("normalized_name")), FIELD_WEIGHT))
        .unionByName(weighted(columns, F.flatten(F.transform("common_values", words)), VALUE_WEIGHT))
        .groupBy("dataset_name", "word")
        .agg(F.max("weight").alias("weight"))
    )


def first_postings(postings: DataFrame, depth: int) -> DataFrame:
    """The first `depth` datasets of each word by weight, then name, with `last`: the one that more follow behind.

    A word of very many datasets is cut by slices first, so no task sorts all of them.
    """
    order = [F.desc("weight"), "dataset_name"]
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = postings.withColumn("_slice", F.pmod(F.xxhash64("dataset_name"), F.lit(parts)))
    sliced = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy("word", "_slice").orderBy(*order)))
    few = sliced.where(F.col("_rn") <= depth + 1).drop("_slice")
    ranked = few.withColumn("_rn", F.row_number().over(Window.partitionBy("word").orderBy(*order)))
    ranked = ranked.withColumn("_more", F.max("_rn").over(Window.partitionBy("word")) > depth).where(F.col("_rn") <= depth)
    return ranked.withColumn("last", F.col("_more") & (F.col("_rn") == depth)).drop("_rn", "_more")


def rank_datasets(questions: DataFrame, schemas: DataFrame, limit: int = DATASET_CANDIDATES, depth: int = RANK_DEPTH) -> DataFrame:
    """Up to `limit` datasets per question, best first; none when no word fits.

    The score is the sum of the weights that a dataset has the question's words
    with. Words have their datasets sorted by weight and name, and only the first
    `depth` of each are looked at; what is found is scored in full. A dataset not
    seen yet weighs, for each word, no more than the last one looked at, and is behind it
    by name where it weighs the same. A question is done when that cannot enter its
    first `limit`; for the others the depth grows eightfold. So a word that all
    datasets share costs `depth` rows a question, not one for every dataset.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(words(F.col("question")))).alias("word"))
    postings = materialize(catalog_words(schemas), "postings")
    open_words, done = materialize(asked.join(postings.select("word").distinct(), "word"), "asked"), []
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "dataset_name")
    while True:
        heads = materialize(first_postings(postings, depth), "heads")
        met = open_words.join(heads, "word")
        unseen = met.where("last").groupBy("question_id").agg(F.sum("weight").alias("_most"), F.max("dataset_name").alias("_behind"))
        seen = met.select("question_id", "dataset_name").distinct()
        weights = seen.join(open_words, "question_id").join(postings, ["dataset_name", "word"])
        scored = weights.groupBy("question_id", "dataset_name").agg(F.sum("weight").alias("score"))
        first = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        bound = first.where(F.col("rank") == limit).select("question_id", F.col("score").alias("_score"), F.col("dataset_name").alias("_name"))
        state = unseen.join(bound, "question_id", "left").select(
            "question_id",
            F.coalesce((F.col("_score") > F.col("_most")) | ((F.col("_score") == F.col("_most")) & (F.col("_name") <= F.col("_behind"))), F.lit(False)).alias("_done"),
        )
        first = materialize(first.join(state, "question_id", "left"), "ranked")
        done.append(first.where("_done IS NULL OR _done").drop("_done"))
        rest = first.where("NOT _done").select("question_id").distinct()
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_words, depth = materialize(open_words.join(rest, "question_id", "left_semi"), "asked"), depth * 8


def known_values(schemas: DataFrame) -> DataFrame:
    """`(dataset_name, key, value, words)`: example values a question may name."""
    columns = schema_columns(latest_schemas(schemas), "dataset_name")
    values = columns.select(
        "dataset_name",
        F.concat(F.lit("data."), "normalized_name").alias("key"),
        F.explode("common_values").alias("value"),
    ).withColumn("words", words(F.col("value")))
    return values.where(F.size("words") > 0)


def derive_filters(asked: DataFrame, schemas: DataFrame, limit: int | None = None, max_phrases: int = BROADCAST_ROWS) -> DataFrame:
    """Filter rows `(question_id, ordinal, dataset_name, key, values)` for `(question_id, question, dataset_name)`.

    A value counts when its words appear in the question in a row: all known
    values are found in one walk over a question's words (see `phrase_matches`).
    The first filter asks for all fields found; when there are several, one
    filter per field follows; a `limit` keeps the first ones. A question without any gets one empty
    filter (null key).
    """
    named = asked.select("question_id", "dataset_name", words(F.col("question")).alias("words"))
    met = phrase_matches(named, known_values(schemas), "dataset_name", max_phrases)
    fields = met.groupBy("question_id", "dataset_name", "key").agg(
        F.array_sort(F.collect_set("value")).alias("values")
    )
    all_fields = fields.groupBy("question_id", "dataset_name").agg(
        F.array_sort(F.collect_list(F.struct("key", "values"))).alias("_f")
    )
    one = F.struct(F.lit(0).alias("ordinal"), F.col("_f").alias("fields"))
    rest = F.when(
        F.size("_f") > 1,
        F.transform("_f", lambda f, i: F.struct((i + 1).alias("ordinal"), F.array(f).alias("fields"))),
    ).otherwise(F.slice(F.array(one), 1, 0))
    every = F.concat(F.array(one), rest)
    templates = all_fields.select(
        "question_id", "dataset_name", F.explode(every if limit is None else F.slice(every, 1, limit)).alias("_t")
    ).select("question_id", "dataset_name", "_t.ordinal", F.explode("_t.fields").alias("_e"))
    found = templates.select("question_id", "ordinal", "dataset_name", "_e.key", "_e.values")
    return (
        asked.select("question_id", "dataset_name")
        .join(found, ["question_id", "dataset_name"], "left")
        .select(
            "question_id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "dataset_name", "key", "values"
        )
    )


def validated_filters(filters: DataFrame, schemas: DataFrame) -> DataFrame:
    """C8 over filter rows: each value checked, keys renamed where they fit the catalog."""
    spread = filters.select("question_id", "ordinal", "dataset_name", "key", F.explode_outer("values").alias("value"))
    checked = validate_params(spread, schemas)
    return (
        checked.withColumn("key", F.when(F.col("key").isNotNull(), F.col("valid_key")))
        .groupBy("question_id", "ordinal", "dataset_name", "key")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )


def search_multi_filter(
    records: DataFrame,
    questions: DataFrame,
    filters: DataFrame,
    limit: int = SEARCH_LIMIT,
    fuzzy: FuzzyMatch = FuzzyMatch(),
    data_map=None,
    tags=None,
    vector: str = "embedding",
    document: str = "id",
) -> DataFrame:
    """Per filter the `limit` most similar records, filters in order, documents once.

    `questions` has `question_id, collection, question_vector`; `filters` has
    `question_id, ordinal, key, values`. A limit of zero or less keeps all.
    Records carry the numbers of the filters they meet into the scoring, an empty filter
    one code for its whole collection, so records and questions never pair up as
    rows. Text and data of the records are joined to the hits at the end; `document` names
    one record of its collection.
    """
    placed = filters.join(questions.select("question_id", "collection"), "question_id")
    packed = pack_filters(placed, ("question_id", "ordinal"), fuzzy, "collection")
    numbered = materialize(packed.withColumn("number", F.monotonically_increasing_id()), "numbered")
    is_open = F.size("conditions") == 0
    # Collections with empty filters get codes; of those no more are looked at than the records' own.
    codes = numbered.where(is_open).groupBy("collection").agg((-1 - F.min("number")).alias("code"))
    codes = broadcast_if_small(materialize(codes, "codes"))
    asked = numbered.where(~is_open).select("collection", "number", "conditions").unionByName(
        codes.select("collection", F.col("code").alias("number"), F.array().cast(CONDITIONS).alias("conditions"))
    )
    matched = filter_verdicts(records, asked, "number", "collection", document, data_map, tags, fuzzy)
    coded = numbered.join(codes, "collection", "left").join(questions.select("question_id", "question_vector"), "question_id")
    found = masked_search(matched, coded.withColumn("code", F.when(is_open, F.col("code"))), limit, document, vector)
    placed = found.join(broadcast_if_small(numbered.select("number", "collection", "question_id", "ordinal")), "number").drop("number")
    w = Window.partitionBy("question_id", "ordinal").orderBy(F.desc(rank_key(F.col("score"))), document)
    ranked = placed.withColumn("rank", F.row_number().over(w))
    ranked = ranked.where(F.col("rank") <= limit) if limit > 0 else ranked
    keyed = ranked.withColumn("_doc", F.struct("question_id", F.col(document).alias("id")))
    hits = materialize(dedup_first(keyed, "_doc", ("ordinal", "rank")).drop("_doc"), "hits")
    own = [c for c in hits.columns if c not in ("collection", document)]
    return records.drop(vector, *own).join(broadcast_if_small(hits), ["collection", document])


def _source_name() -> Column:
    return F.coalesce(F.get(F.col("tags")["file"], F.lit(0)), F.col("source"), F.lit(""))


def _row_line(number: Column, source: Column, document: Column, text: Column) -> Column:
    return F.concat(F.lit("ROW "), number.cast("string"), F.lit(": ["), source, F.lit(" #"), document, F.lit("] "), text)


def context_blocks(
    hits: DataFrame, limit: int = 0, document: str = "id", order: tuple[str, ...] = ("ordinal", "rank"), rows: int = BLOCK_ROWS
) -> DataFrame:
    """T10 for any number of hits: `(question_id, block, first_row, rows, context, sources)`, the context in blocks of rows.

    Blocks in order, joined by line breaks, are what `answer_context` puts in one
    row. No question's hits are gathered: rows are numbered across partitions, and a block holds `rows` of them.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (document, "source", "text")}
    ranked = numbered(hits.withColumn("_name", _source_name()), ("question_id",), (*order, document))
    line = _row_line(F.col("row"), text["source"], text[document], text["text"])
    named = F.concat(F.lit("- "), F.col("_name"), F.lit(" #"), text[document])
    shown = named if limit <= 0 else F.when(F.col("row") <= limit, named)
    return text_blocks(ranked, ("question_id",), {"context": (line, "\n"), "sources": (shown, "\n")}, rows)


def answer_context(
    hits: DataFrame, limit: int = 0, document: str = "id", order: tuple[str, ...] = ("ordinal", "rank")
) -> DataFrame:
    """`(question_id, context, sources, hits)`, one row per question: for hits that a search has limited.

    Rows are numbered in search order. The limit trims the source list only; the
    context keeps every row. `hits` holds `question_id, source, text, tags` and
    the order columns; a `file` tag overrides the source name. Hits without a
    limit go through `context_blocks`.
    """
    item = F.struct(
        *order,
        F.col(document).cast("string").alias("doc"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        _source_name().alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    listed = F.col("_hits")
    rows = F.transform(listed, lambda h, i: _row_line(i + 1, h["source"], h["doc"], h["text"]))
    named = F.slice(listed, 1, limit) if limit > 0 else listed
    sources = F.transform(named, lambda h: F.concat(F.lit("- "), h["name"], F.lit(" #"), h["doc"]))
    return (
        hits.groupBy("question_id")
        .agg(F.array_sort(F.collect_list(item)).alias("_hits"))
        .select(
            "question_id",
            F.array_join(rows, "\n").alias("context"),
            F.array_join(sources, "\n").alias("sources"),
            F.size("_hits").alias("hits"),
        )
    )


def with_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every question with its answer prompt; one without hits keeps an empty context."""
    return questions.join(contexts, "question_id", "left").withColumn(
        "prompt",
        build_prompt(
            "answer", F.col("question"), F.col("context"), F.coalesce("sources", F.lit(""))
        ),
    )


def strict_hits(hits: DataFrame, filters: DataFrame, data_map=None, tags=None) -> DataFrame:
    """The hits that meet the filter they were found by again, with no fuzziness; `filters` as for the search."""
    keyed = filters.withColumn("_one", F.lit("one"))
    packed = pack_filters(keyed, ("question_id", "ordinal"), FuzzyMatch(enabled=False), "_one").drop("_one")
    data_map = F.col("data").try_cast("map<string,string>") if data_map is None else data_map
    facts = hits.withColumns({"_data": data_map, "_tags": F.col("tags") if tags is None else tags})
    met = facts.join(broadcast_if_small(packed), ["question_id", "ordinal"]).where(all_hold(F.col("conditions"), True))
    return met.select(*hits.columns)


def ask_datasets(questions: DataFrame, schemas: DataFrame, provider, **how) -> DataFrame:
    """T6 by a model: `questions` with the dataset that a reply names, of those ranked first; null for none or an unknown one."""
    described = describe_all(latest_schemas(schemas)).select("dataset_name", "description")
    ranked = rank_datasets(questions, schemas).join(broadcast_if_small(described), "dataset_name")
    listed = F.array_sort(F.collect_list(F.struct("rank", "description")))
    context = ranked.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda e: e["description"]), "\n\n").alias("_context"))
    prompts = questions.join(context, "question_id", "left").withColumn("_prompt", build_prompt("dataset", F.col("question"), F.col("_context")))
    replied = complete_batch(prompts.select("question_id", "_prompt"), provider, "_prompt", **how)
    named = replied.select("question_id", parse_dataset_reply(F.col("completion")).alias("dataset_name"))
    known = broadcast_if_small(described.select("dataset_name", F.lit(True).alias("_known")))
    named = named.join(known, "dataset_name", "left").select("question_id", F.when(F.col("_known"), F.col("dataset_name")).alias("dataset_name"))
    return questions.join(named, "question_id", "left")


def ask_filters(asked: DataFrame, schemas: DataFrame, provider, **how) -> DataFrame:
    """T7 by a model: filter rows from replies to the description of each question's dataset; see `filter_templates`."""
    described = broadcast_if_small(describe_all(latest_schemas(schemas)).select("dataset_name", F.col("description").alias("_context")))
    prompts = asked.join(described, "dataset_name", "left").withColumn("_prompt", build_prompt("filter", F.col("question"), F.col("_context")))
    replied = complete_batch(prompts.select("question_id", "dataset_name", "_prompt"), provider, "_prompt", **how)
    return filter_templates(replied, "completion", ("question_id", "dataset_name"))


def ask_tabular(
    questions: DataFrame,
    records: DataFrame,
    schemas: DataFrame,
    limit: int = SEARCH_LIMIT,
    filters: DataFrame | None = None,
    fuzzy: FuzzyMatch = FuzzyMatch(),
    data_map=None,
    tags=None,
    provider=None,
    strict: bool = False,
) -> DataFrame:
    """Dataset, filters, validation, search, context and prompt for every question.

    `questions` has `question_id, question, collection, question_vector`;
    `records` also carries `collection`. Given `filters` replace the derived
    ones. With a completion provider its replies choose dataset and filters. `strict` keeps
    only hits that meet their filter without fuzziness.
    """
    if provider is None:
        best = rank_datasets(questions, schemas, 1).select("question_id", "dataset_name")
        asked = questions.join(best, "question_id", "left")
    else:
        asked = ask_datasets(questions, schemas, provider)
    # Questions and filters are read several times below; records only once.
    asked = materialize(asked, "questions")
    questions = asked.select(*[c for c in asked.columns if c != "dataset_name"])
    if filters is None:
        found = derive_filters(asked, schemas) if provider is None else ask_filters(asked, schemas, provider)
        filters = materialize(validated_filters(found, schemas), "filters")
    hits = search_multi_filter(records, questions, filters, limit, fuzzy, data_map, tags)
    hits = strict_hits(hits, filters, data_map, tags) if strict else hits
    # A stored record has a map called `source`; what is shown as its source is its file.
    contexts = answer_context(hits.drop("source").withColumnRenamed("file", "source"), limit)
    return with_prompts(asked.drop("question_vector"), contexts)


def ask_documents(
    questions: DataFrame, chunks: DataFrame, limit: int = ANSWER_MATCHES
) -> DataFrame:
    """The best chunks of each question as context and prompt.

    `questions` has `question_id, question, question_vector`; `chunks` has
    `id, source, chunk_text, tags, embedding`.
    """
    # Both the search and the texts read the chunks: made once.
    chunks = materialize(chunks, "chunks")
    hits = similar_batch(chunks, questions.select("question_id", "question_vector"), limit)
    bodies = chunks.select("id", "source", F.col("chunk_text").alias("text"), "tags")
    placed = hits.join(bodies, "id").withColumn("ordinal", F.lit(0))
    return with_prompts(questions.drop("question_vector"), answer_context(placed, limit))
