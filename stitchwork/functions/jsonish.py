"""Lenient JSON repair for judge output, as VARIANT or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stitchwork.functions.text import strip


def _unfence(text: Column) -> Column:
    opened = F.regexp_replace(strip(text), r"(?m)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(opened, r"(?m)```\s*$", ""))


def strict_json(text: Column) -> Column:
    """One whole JSON value or null.

    The parser stops after the first value and accepts whatever follows it.
    Inside an array and inside an object, anything that follows is an error
    or a second entry.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = boxed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(listed, "$[0]", "variant"))


def repair_json(text: Column) -> Column:
    """Fences off, outermost braces, trailing commas dropped if needed; objects only."""
    body = F.regexp_extract(_unfence(text), r"(?s)(\{.*\})", 1)
    body = F.when(body != "", body)
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.coalesce(strict_json(body), strict_json(fixed))


def parse_verdict(text: Column) -> Column:
    """Fences off, then strict JSON or null."""
    return strict_json(_unfence(text))


def field(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)
