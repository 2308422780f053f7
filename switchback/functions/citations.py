"""Bracketed citations of an answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PATTERN = r"\[([^\]]*:[^\]]*)\]"
# fixed value: what an invalid citation is replaced by
REMOVED = "invalid-citation-removed"


def cited(answer: Column) -> Column:
    """The ids in brackets, split on commas, those with a colon, in order."""
    groups = F.regexp_extract_all(answer, F.lit(PATTERN), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(":")))


def invalid(answer: Column, known: Column) -> Column:
    """Distinct cited ids that were not retrieved."""
    return F.array_except(F.array_distinct(cited(answer)), known)


def stripped(answer: Column, bad: Column) -> Column:
    """The answer with each invalid id replaced."""
    return F.aggregate(bad, answer, lambda text, b: F.replace(text, b, F.lit(REMOVED)))
