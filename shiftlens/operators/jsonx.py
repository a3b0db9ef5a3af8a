"""First JSON object out of free text (J1), fenced with ```json or bare, as a table operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed value: a fenced block, optionally tagged json, holding one object (lazy match)
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def json_span(text: Column) -> Column:
    """The fenced object if there is one, else the text; then first ``{`` to last ``}``.
    NULL when there is no brace pair."""
    fenced = F.regexp_extract(text, FENCE, 1)
    cand = F.when(text.rlike(FENCE), fenced).otherwise(text)
    start = F.locate("{", cand)
    end = F.length(cand) - F.locate("}", F.reverse(cand)) + 1
    ok = (start > 0) & (F.locate("}", F.reverse(cand)) > 0)
    return F.when(ok, cand.substr(start, end - start + 1))


def extract_json(df: DataFrame, col: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """``(*keep, json_text, parsed)``; ``parsed`` follows ``schema`` (from_json, permissive)."""
    keep = keep or []
    span = json_span(F.col(col))
    return df.select(*keep, span.alias("json_text"), F.from_json(span, schema).alias("parsed"))
