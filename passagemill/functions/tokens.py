"""Token estimates without a tokenizer, for one text and as a column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate(text: str) -> int:
    """Digits and signs count one token each, 2.5 other characters one, and two are for the ends."""
    dense = sum(c.isdigit() or not (c.isalnum() or c.isspace()) for c in text)
    return math.ceil((len(text) - dense) / 2.5) + dense + 2


def estimate_column(text: Column) -> Column:
    """:func:`estimate` inside the JVM."""
    letters = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{Nl}\s]", ""))
    return (F.ceil(letters / 2.5) + F.length(text) - letters + 2).cast("int")
