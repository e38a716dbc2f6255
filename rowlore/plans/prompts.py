"""T5: prompts from a question and its context, and T8: reading replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences an answer starts with.
KNOWN = "According to our internal documents"
UNKNOWN = "This information is not part of our internal documents."

DATASET_PROMPT = """Decide which of the datasets below the question is about.

{context}

Question: {question}

Reply with a JSON array of at most three dataset names, most likely first, or [] when none fits."""

FILTER_PROMPT = """Turn the question into at most five filters over the fields below.

{context}

Question: {question}

Reply with a JSON array of objects. Keys are field names as listed; a value is a text or a list of
texts, any of which may match. Use only conditions the question states. Reply [{}] when there are none."""

ANSWER_PROMPT = f"""Answer the question from the records below and from nothing else.

Question: {{question}}

Records:
{{context}}

Sources:
{{sources}}

Use only records that meet every condition of the question. Name the documents used.
Start with '{KNOWN}'. If the records hold no answer, reply '{UNKNOWN}'"""

TEMPLATES = {"dataset": DATASET_PROMPT, "filter": FILTER_PROMPT, "answer": ANSWER_PROMPT}


def build_prompt(kind: str, question: Column, context: Column, sources: Column | None = None) -> Column:
    """T5: the named template with its slots filled, sources and context before the question."""
    prompt = F.lit(TEMPLATES[kind])
    if sources is not None:
        prompt = F.replace(prompt, F.lit("{sources}"), sources)
    prompt = F.replace(prompt, F.lit("{context}"), F.coalesce(context, F.lit("")))
    return F.replace(prompt, F.lit("{question}"), question)


def parse_dataset_reply(reply: Column) -> Column:
    """The first dataset a reply names, null for none.

    A JSON array counts by its first element; otherwise code fences are removed
    and the rest is read as an array or taken as a bare name.
    """
    text = F.trim(reply)
    cleaned = F.regexp_replace(F.regexp_replace(text, "(?i)```json", ""), "```", "")
    cleaned = F.regexp_replace(cleaned, r"^\s+|\s+$", "")
    parsed, fenced = F.try_parse_json(text), F.try_parse_json(cleaned)

    def strings(v: Column) -> Column:
        return F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>")

    def usable(name: Column) -> Column:
        return F.when((name != "") & (F.lower(name) != "none"), name)

    from_array = usable(F.try_variant_get(parsed, "$[0]", "string"))
    from_fence = usable(F.try_variant_get(fenced, "$[0]", "string"))
    return F.when(strings(parsed), from_array).otherwise(
        F.coalesce(F.when(cleaned.startswith("[") & strings(fenced), from_fence), usable(cleaned))
    )
