"""What models write: fenced JSON and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of an inference judge.
LABELS = ("entailment", "neutral", "contradiction")


def strip_fences(text: Column) -> Column:
    """The text without a fence before and behind it, and without white space around."""
    bare = F.regexp_replace(F.trim(text), r"^```(json|JSON|js|javascript)?\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```\s*$", ""))


def loose_object(text: Column) -> Column:
    """From the first brace to the last, or an empty text."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parse_label(text: Column) -> Column:
    """The label of the object in the text, INVALID if it is none; without an object the one label that is named, else INVALID."""
    found = loose_object(text)
    named = F.lower(F.trim(F.get_json_object(found, "$.label")))
    hits = F.filter(F.array(*map(F.lit, LABELS)), lambda x: F.contains(F.lower(text), x))
    only = F.when(F.size(hits) == 1, hits[0]).otherwise("INVALID")
    whole = F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull()
    return F.when(whole, F.when(named.isin(*LABELS), named).otherwise("INVALID")).otherwise(only)


def round_trip(forward: Column, back: Column) -> list[Column]:
    """closed and mode: both ends entail each other, content is dropped, added or inverted, or nothing relates them."""
    there, home = forward == "entailment", back == "entailment"
    flipped = (forward == "contradiction") | (back == "contradiction")
    mode = F.when(there & home, "closed").when(there, "dropped").when(home, "added").when(flipped, "inverted").otherwise("unrelated")
    return [(there & home).alias("closed"), mode.alias("mode")]
