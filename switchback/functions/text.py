"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: question filler that the lexical search drops
STOP_WORDS = (
    "the and for are but not you your with that this these "
    "those from have has had was were been being can could "
    "will would shall should may might must does did doing "
    "what when where which who whom why how any all some "
    "there here then than them they their its his her our "
    "get got still now right just about into onto over under "
    "out off per via one two also more most much many each "
    "other such only own same too very let need want"
).split()
# fixed value: the sentence that counts as a refusal
REFUSAL = "The provided documents don't say."
# fixed values: the sentiment labels
LABELS = ("positive", "negative", "mixed")


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_front_matter(c: Column) -> Column:
    """What follows the second ``---``, trimmed; the whole text, trimmed, if there are fewer."""
    parts = F.split(c, "---", 3)
    return trimmed(F.when(F.size(parts) == 3, parts[2]).otherwise(c))


def front_matter_field(c: Column, name: str) -> Column:
    """A ``name: value`` line of the front matter; null if there is none."""
    parts = F.split(c, "---", 3)
    found = F.regexp_extract(parts[1], rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.when(F.size(parts) == 3, F.nullif(trimmed(found), F.lit("")))


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits over two characters, no filler, a plural s off."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))
    plural = lambda t: (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
    return F.transform(kept, lambda t: F.when(plural(t), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def keyword_tokens(c: Column) -> Column:
    """Distinct lower-case words of three letters or more, in order of appearance."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 3))


def clipped(c: Column, n: int) -> Column:
    """At most n characters, then three dots."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def truncated(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def indented(c: Column, prefix: str = "  | ") -> Column:
    return F.regexp_replace(c, "(?m)^", prefix)


def contains_ci(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def earliest_label(reply: Column) -> Column:
    """The label that appears first in a reply; the trimmed reply if none does."""
    hit = F.regexp_extract(F.lower(reply), f"({'|'.join(LABELS)})", 1)
    return F.when(hit != "", hit).otherwise(trimmed(reply))


def refused(answer: Column) -> Column:
    return F.contains(answer, F.lit(REFUSAL))


def edit_distance(draft: Column, final: Column) -> Column:
    """Levenshtein distance; a missing final counts as empty."""
    return F.levenshtein(draft, F.coalesce(final, F.lit("")))


def whole_word(text: Column, word: str) -> Column:
    """Whether a word of letters stands alone in a lower-cased text."""
    return F.lower(text).rlike(rf"\b{word}\b")


def with_task(c: Column, task: str = "classification") -> Column:
    """An embedding task's prefix; it must be the same for a whole corpus."""
    return F.concat(F.lit(f"{task}: "), c)
