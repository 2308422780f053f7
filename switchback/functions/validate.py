"""Checks of extracted fields: each gives a verdict struct (passed, reason, normalized)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from switchback.functions.text import trimmed

# fixed values: the date notations that are understood
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d yyyy")
# fixed values: words of place names that prove nothing
BOILERPLATE = ("national", "park", "state", "trail", "trailhead", "loop", "canyon", "falls", "the")
MAX_MILES, MAX_FEET = 100.0, 20_000.0


def verdict(passed: Column, reason: Column, normalized: Column) -> Column:
    return F.struct(passed.alias("passed"), F.when(~passed, reason).alias("reason"), F.when(passed, normalized).alias("normalized"))


def parsed_date(c: Column) -> Column:
    """A real calendar date in one of the known notations, else null."""
    return F.coalesce(*[F.try_to_date(trimmed(c), f) for f in DATE_FORMATS])


def date_verdict(c: Column) -> Column:
    """Null passes; a date must parse and lie in 1900-2100; normalized is ISO."""
    d = parsed_date(c)
    good = c.isNull() | (d.isNotNull() & F.year(d).between(1900, 2100))
    return verdict(F.coalesce(good, F.lit(False)), F.when(d.isNull(), "not a date").otherwise("year out of range"), F.date_format(d, "yyyy-MM-dd"))


def range_verdict(c: Column, most: float) -> Column:
    """Null passes; zero, negative and values over ``most`` do not."""
    good = c.isNull() | ((c > 0) & (c <= most))
    return verdict(F.coalesce(good, F.lit(False)), F.when(c == 0, "zero: should be null").when(c < 0, "negative").otherwise("too large"), c.cast("string"))


def text_verdict(c: Column) -> Column:
    """Null passes; blank does not."""
    return verdict(c.isNull() | (trimmed(c) != ""), F.lit("blank: should be null"), trimmed(c))


def grounded_verdict(c: Column, source: Column) -> Column:
    """Each telling word (four letters or more, no boilerplate) must be in the source; without one, the whole value."""
    low = F.lower(source)
    words = F.filter(F.split(F.regexp_replace(c, "[-,']", " "), r"\s+"), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*BOILERPLATE))
    missing = F.filter(words, lambda w: ~F.contains(low, F.lower(w)))
    found = F.when(F.size(words) > 0, F.size(missing) == 0).otherwise(F.contains(low, F.lower(trimmed(c))))
    good = c.isNull() | ((trimmed(c) != "") & F.coalesce(found, F.lit(False)))
    return verdict(good, F.when(trimmed(c) == "", "blank: should be null").otherwise(F.concat(F.lit("not in the source: "), F.array_join(missing, ", "))), trimmed(c))


def coerced(value: Column, v: Column) -> Column:
    """The normalized value where it passed, else null."""
    return F.when(v["passed"], F.coalesce(v["normalized"], value.cast("string")))


def clean_list(c: Column) -> Column:
    """Trimmed items, the null and blank ones dropped; a null list is empty."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: trimmed(x))
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


# fixed values: the categories a message may have
CATEGORIES = ("permit", "conditions", "complaint", "lost-and-found", "emergency", "general", "unsure")


def category_verdict(c: Column) -> Column:
    return verdict(F.coalesce(c.isin(*CATEGORIES), F.lit(False)), F.lit("no such category"), c)


def given(c: Column) -> Column:
    """Whether an argument was really given: models write "null" or "string" for none."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin("", "null", "string")
