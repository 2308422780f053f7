"""Cutting oversized texts at natural boundaries, with an overlap.

A text's words become an array of offsets (its prefix sums), its natural boundaries a
sorted array of word numbers.  Each piece ends at the last boundary within the limit, found by
binary search; the next piece steps back by the overlap.  Where no boundary lies
within reach the piece is cut hard at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT = 200
OVERLAP = 20
TOKEN = re.compile(r"[^ \t\r\n]+")
BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)")
MARK = re.compile(r"(?:-|\*|•|\+|–|·|\d+\.\d+\.?)\Z")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]*_]*\Z")
CLOSERS = "\"'”’)]*_"
# fixed values: abbreviations whose period ends no sentence
ABBREVIATIONS = frozenset(
    "ca approx rd st mt ft mi no nos e.g i.e vs dr mr mrs ms jr sr ave blvd ln ct pkwy hwy etc a.m p.m am pm dept est elev jan feb mar apr jun jul aug sep sept oct nov dec n s w in yd min max temp fig sec ch pp vol inc ltd co u.s cf al gen col capt lt sgt rev hon prof".split()
)


def ends_sentence(word: str) -> bool:
    """Whether a sentence ends with this word; periods of abbreviations and numbers do not count."""
    if not SENTENCE.search(word):
        return False
    core = word.rstrip(CLOSERS)
    if core[-1:] != ".":
        return True
    core = core.rstrip(".").lstrip("([\"'“‘*_").lower()
    if not core or core in ABBREVIATIONS:
        return False
    return not (core[-1].isdigit() and all(c.isdigit() or c in ".,:-/#$" for c in core)) and not (len(core) == 1 and core.isalpha())


def offsets(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Places of the words and the word numbers before which a natural boundary lies (without 0 and the end)."""
    words = [m.span() for m in TOKEN.finditer(text)]
    cuts = []
    for i in range(1, len(words)):
        gap = text[words[i - 1][1] : words[i][0]]
        lines = "\n" in gap or "\r" in gap
        if (lines and (BLANK.search(gap) or MARK.match(text[words[i][0] : words[i][1]]))) or ends_sentence(text[words[i - 1][0] : words[i - 1][1]]):
            cuts.append(i)
    return words, cuts


def pieces(n: int, cuts: list[int], limit: int, overlap: int) -> list[tuple[int, int, bool, bool]]:
    """Word ranges (first, end, hard, forced) that cover ``n`` words in order; ``forced``: a stretch that ends or is cut here exceeds ``limit - overlap``."""
    out, start, fresh = [], 0, 0
    while n - start > limit:
        k = bisect_right(cuts, start + limit) - 1
        hard = k < 0 or cuts[k] <= fresh
        end = start + limit if hard else cuts[k]
        # only the first piece, which repeats nothing, can hold a longer stretch without a hard cut
        wide = fresh == 0 and not hard and max(b - a for a, b in zip([0, *cuts[:k]], cuts[: k + 1])) > limit - overlap
        out.append((start, end, hard, hard or wide))
        start, fresh = max(end - overlap, 0), end
    if n:
        out.append((start, n, False, False))
    return out


def split_long(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``chunks(chunk_id, source, text)``: ``(chunk_id, source, piece, text, words, of_words, hard, forced)``.

    ``hard``: the piece ends at the limit, not at a boundary; ``forced``: the stretch between successive
    boundaries in which it ends is longer than ``limit - overlap``, so that no plan without hard cuts is
    safe.  Texts within the limit are one piece as they are; null and blank texts give none; rows repeated under one
    id count once (the smallest source and text); a null source stays null; an overlap must be under the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, source, text in zip(f["chunk_id"], f["source"], f["text"]):
                words, cuts = offsets(text)
                n = len(words)
                for k, (a, b, hard, forced) in enumerate(pieces(n, cuts, limit, overlap)):
                    rows.append((i, source, k, text[words[a][0] : words[b - 1][1]] if n > limit else text, b - a, n, hard, forced))
            yield pd.DataFrame(rows, columns=["chunk_id", "source", "piece", "text", "words", "of_words", "hard", "forced"])

    one = chunks.where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.min(F.struct("source", "text")).alias("x")).select("chunk_id", "x.*")
    return one.mapInPandas(cut, "chunk_id string, source string, piece int, text string, words int, of_words int, hard boolean, forced boolean")


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_id, cut)`` of the chunks that had to be cut, from their pieces."""
    cut = split_long(chunks, limit, overlap).where(F.col("of_words") > limit).groupBy("chunk_id").agg(F.max("forced").alias("forced"))
    return cut.select("chunk_id", F.when(F.col("forced"), "forced").otherwise("clean").alias("cut"))
