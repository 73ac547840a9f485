"""Verdict JSON: parsing, validation and encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions.text import let

# Class 0 is fake, class 1 is real.
FAKE, REAL = 0, 1
LABELS = ("fake", "real")


def encode_verdict(label: Column) -> Column:
    """'fake' is 0, anything else is 1."""
    return F.when(label == "fake", FAKE).otherwise(REAL)


def _read(doc: Column) -> Column:
    """The three fields of a parsed document with their JSON types; a type is
    NULL when the key is missing."""
    read = [F.schema_of_variant(doc).alias("kind")]
    for name in ("label", "confidence", "reasoning"):
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        read.append(F.schema_of_variant(value).alias(f"{name}_kind"))
        read.append(F.try_variant_get(doc, f"$.{name}", "string").alias(name))
    return F.struct(*read)


def _judge(raw: Column, read: Column) -> Column:
    text = read["confidence"]
    confidence = (
        F.when(read["confidence_kind"] != "BOOLEAN", text.try_cast("double"))
        .when(text == "true", 1.0)
        .when(text == "false", 0.0)
    )
    is_object = F.startswith(read["kind"], F.lit("OBJECT"))
    known = (read["label_kind"] == "STRING") & read["label"].isin(*LABELS)
    in_range = ~F.isnan(confidence) & confidence.between(0.0, 1.0)
    has_text = read["reasoning_kind"] == "STRING"
    no = F.lit(False)
    error = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty")
        .when(~F.coalesce(is_object, no), "not an object")
        .when(~F.coalesce(known, no), "label")
        .when(~F.coalesce(in_range, no), "confidence")
        .when(~F.coalesce(has_text, no), "reasoning")
    )
    return F.struct(
        read["label"].alias("label"),
        confidence.alias("confidence"),
        read["reasoning"].alias("reasoning"),
        error.alias("error"),
    )


def parse_verdict(raw: Column) -> Column:
    """Struct label, confidence, reasoning, is_valid, error.

    Valid means a JSON object with a string label in {fake, real}, a number
    (or numeric string, or boolean) confidence in [0, 1] and a string
    reasoning; further keys are ignored. `error` names the first failure and
    the three values are NULL when there is one.
    """

    def finish(judged: Column) -> Column:
        ok = judged["error"].isNull()
        kept = [F.when(ok, judged[n]).alias(n) for n in ("label", "confidence", "reasoning")]
        return F.struct(*kept, ok.alias("is_valid"), judged["error"].alias("error"))

    read = let(F.try_parse_json(raw), _read)
    return let(let(read, lambda r: _judge(raw, r)), finish)
