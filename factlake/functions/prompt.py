"""Context, prompt, context-window budget and small formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts, the tokens allowed per retrieved document,
# the overhead and the smallest context window.
SYSTEM_PROMPT = """\
You are a fact-checking assistant specialized in detecting fake news.
You will be given a news article to classify and a set of verified reference articles retrieved from a trusted knowledge base.

Your task:
1. Analyze the news article against the retrieved reference articles.
2. Identify factual consistencies or contradictions.
3. Classify the news article as "fake" or "real".

Rules:
- Base your classification strictly on the retrieved references, not on prior knowledge.
- If references contradict the article, classify as "fake".
- If references support or are consistent with the article, classify as "real".
- If references are insufficient or unrelated, classify as "fake" and note the lack of evidence.
- Always respond with valid JSON. No extra text outside the JSON.

Response format:
{
  "label": "fake" | "real",
  "confidence": 0.0–1.0,
  "reasoning": "Brief explanation referencing the retrieved articles."
}
"""
USER_PROMPT = """\
## Retrieved reference articles

{context}

---

## News article to classify

{query}

---

Classify the news article above based solely on the retrieved references.
Respond with valid JSON only.
"""
TOKENS_PER_DOCUMENT = {"full": 1024, "sliding": 384}
PROMPT_OVERHEAD = 1024
MIN_CONTEXT = 2048


def build_context(docs: Column) -> Column:
    """'[1] first', '[2] second', ... with a blank line between, from an array
    of texts in rank order."""
    numbered = F.transform(
        docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)
    )
    return F.array_join(numbered, "\n\n")


def fill_prompt(context: Column, query: Column, template: str = USER_PROMPT) -> Column:
    """Fill the template in one pass: braces inside the texts stay as they are."""
    before, rest = template.split("{context}")
    between, after = rest.split("{query}")
    return F.concat(F.lit(before), context, F.lit(between), query, F.lit(after))


def full_prompt(user_prompt: Column) -> Column:
    head = f"SYSTEM PROMPT:\n{SYSTEM_PROMPT}\n\nUSER_PROMPT:\n"
    return F.concat(F.lit(head), user_prompt)


def context_needed(k: Column, chunk_type: Column) -> Column:
    """Tokens the documents and the article are expected to need."""
    per = F.when(chunk_type == "full", TOKENS_PER_DOCUMENT["full"]).otherwise(
        TOKENS_PER_DOCUMENT["sliding"]
    )
    return per * (k + 1) + PROMPT_OVERHEAD


def context_budget(k: Column, chunk_type: Column, cap: Column) -> Column:
    return F.least(cap, F.greatest(F.lit(MIN_CONTEXT), context_needed(k, chunk_type)))


def context_overflow(k: Column, chunk_type: Column, cap: Column) -> Column:
    return context_needed(k, chunk_type) > cap


def format_duration(seconds: Column) -> Column:
    """Seconds as 'XmYs', fractions dropped."""
    whole = F.floor(seconds)
    return F.format_string("%dm%ds", F.floor(whole / 60).cast("long"), whole % 60)


def snapshot_id() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH-mm-ss")


def _json_text(c: Column) -> Column:
    """JSON form of one string, quotes included."""
    array = F.to_json(F.array(c))
    return array.substr(F.lit(2), F.length(array) - 2)


def docs_json(docs: Column) -> Column:
    """Array of structs (content, label, distance) as a list of lists."""

    def row(d: Column) -> Column:
        numbers = [F.coalesce(d[n].cast("string"), F.lit("null")) for n in ("label", "distance")]
        return F.concat(
            F.lit("["), F.concat_ws(", ", _json_text(d["content"]), *numbers), F.lit("]")
        )

    return F.concat(F.lit("["), F.array_join(F.transform(docs, row), ", "), F.lit("]"))
