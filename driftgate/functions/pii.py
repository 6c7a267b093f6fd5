"""Sensitivity tier of a column from its name, type and length."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate import fixed_values as V


def _pattern(names: list[str], match: str) -> str:
    body = "|".join(re.escape(n) for n in names)
    return body if match == "substring" else rf"(^|[^a-z0-9])({body})([^a-z0-9]|$)"


def pii_tier(
    name: Column,
    data_type: Column,
    max_length: Column,
    match: str = "substring",
    tier1: list[str] | None = None,
    tier2: list[str] | None = None,
) -> Column:
    """1 for direct, 2 for indirect, 3 for long free text, null otherwise.

    ``match="token"`` asks for whole words, so that ``page_id`` is not an age.
    """
    lowered = F.lower(name)
    if match == "token":
        lowered = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))
    length = F.coalesce(max_length, F.lit(0))
    free_text = F.lower(data_type).isin(V.PII_TIER3_TYPES) & (
        (length > V.PII_TIER3_MIN_LENGTH) | (length == 0)
    )
    first = _pattern(tier1 or V.PII_TIER1_NAMES, match)
    second = _pattern(tier2 or V.PII_TIER2_NAMES, match)
    if match == "token":
        # names such as user_email are words joined by underscores
        first, second = (p.replace("[^a-z0-9]", "[^a-z0-9]|_") for p in (first, second))
    return (
        F.when(lowered.rlike(first), 1).when(lowered.rlike(second), 2).when(free_text, 3)
    ).cast("int")
