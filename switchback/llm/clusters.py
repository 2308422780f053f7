"""Grid density clustering of reports with SQL.

A report's features are quantised into a grid cell: the trail, the landform word and the spelling of
the place it speaks of (references to other places - "past", "below", "from", "... side" - are not its
place); the first number in it is a further, often missing, feature.  Cells are counted.  Cells whose spellings are one slip apart
(a letter dropped, doubled or swapped) are adjacent unless their usual numbers differ.

* dense cells (``dense`` reports and more) that are adjacent are joined if their usual numbers agree;
* a sparse cell is joined to one cell only, the best of the adjacent ones that hold more reports (equal number first, then the
  larger), so that a misspelling between two places does not make them one.

Minimum labels are propagated along these joins to convergence.  A cluster is reported with its size
and the members of its densest cell.

The landform words are learned from all reports: words that stand second in capitalised pairs
after many different first words.  So are the ordinary words before them ("piped spring"), which name no place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from switchback.llm.neardup import components
from switchback.plans.lineage import written

#: A word is a landform if it follows at least this share of all different first words of capitalised pairs (and three of them);
#: so there are at most 100 times as many as a first word has followers on average, whatever the size of the table.
LANDFORM_SHARE = 0.01
MIN_SIZE = 3
MIN_WORDS = 4
DENSE = 3
INVISIBLE = "[\u0300-\u036f\u200b-\u200f\u00ad\u2060\ufeff]"
REFERENCE = frozenset("past below from above near beyond".split())
SIDE = frozenset(["side"])
NUMBER = re.compile(r"(?<![\w.])(\d{1,3})(?:\.(\d))?(?![\w.]*\d)")


def landforms(texts: DataFrame) -> list[str]:
    """Words with many different first words."""
    pairs = texts.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", INVISIBLE, ""), F.lit(r"\b(\p{Lu}\p{Ll}{3,}\s+\p{Lu}\p{Ll}{2,})\b"), F.lit(1))).alias("p"))
    halves = written(pairs.select(F.split(F.lower("p"), r"\s+").alias("x")).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b")).distinct(), "halves")
    n = halves.groupBy("b").agg(F.count("*").alias("n"))
    least = max(3.0, (halves.agg(F.count_distinct("a")).first()[0] or 0) * LANDFORM_SHARE)
    return sorted(r.b for r in n.where(F.col("n") >= least).collect())


def slips(word: str) -> set[str]:
    """Spellings with one letter left out or two neighbours swapped."""
    return ({word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}) - {word}


def like(word: str, known: frozenset[str]) -> str | None:
    """The known word that this one is, or is one slip away from."""
    if word in known:
        return word
    return next((k for k in sorted(known) if abs(len(k) - len(word)) <= 1 and (word in slips(k) or k in slips(word))), None)


class Words(dict):
    """Of each word, kept: (landform as written, landform after a slip, whether a reference follows it, whether it is a "side")."""

    def __init__(self, forms: list[str]):
        super().__init__()
        self.forms, self.near = frozenset(forms), {}
        for f in forms:
            for x in slips(f):
                self.near.setdefault(x, f)

    def __missing__(self, word: str) -> tuple[str | None, str | None, bool, bool]:
        if len(self) > 500_000:
            self.clear()
        own = word if word in self.forms else None
        close = own or self.near.get(word) or (next((f for f in sorted(slips(word)) if f in self.forms), None) if len(word) > 3 else None)
        self[word] = out = (own, close, len(word) > 2 and like(word, REFERENCE) is not None, len(word) > 2 and like(word, SIDE) is not None)
        return out


def places_of(text: str, words: Words) -> list[tuple[bool, int, str, str, bool]]:
    """(landform misspelled, position, name, landform, name written small) of the places of a text that are no references."""
    found = re.findall(r"[^\W\d_]+|[.,:;!?]", re.sub(INVISIBLE, "", text))
    low = [w.lower() for w in found]
    out = []
    for i in range(1, len(low)):
        own, close, _, _ = words[low[i]]
        form = own or (close if len(low[i - 1]) >= 6 else None)
        if form is None or len(low[i - 1]) < 4:
            continue
        if (i > 1 and words[low[i - 2]][2]) or (i + 1 < len(low) and words[low[i + 1]][3]):
            continue
        out.append((own is None, i, low[i - 1], form, found[i - 1][0].islower()))
    return out


def number_of(text: str) -> str | None:
    """The digits of the first number; a lost decimal point makes no difference."""
    m = NUMBER.search(text)
    return (m[1] + (m[2] or "")).lstrip("0") or None if m else None


def quantised(reports: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, trail_id, name, form, number)``, a row per id with a trail, a place and at least ``min_words`` words."""
    source = reports.select("id", "trail_id", "text").where("id is not null and trail_id is not null and text is not null")
    source = source.where(F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")) >= min_words)
    forms = landforms(source)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(forms)
        for f in frames:
            rows = []
            for i, trail, text in zip(f["id"], f["trail_id"], f["text"]):
                mixed = not (text.islower() or text.isupper())
                number = number_of(text)
                rows += [(i, trail, loose, at, name, form, small if mixed else None, number) for loose, at, name, form, small in places_of(text, words)]
            yield pd.DataFrame(rows, columns=["id", "trail_id", "loose", "at", "name", "form", "small", "number"])

    seen = written(source.mapInPandas(cells, "id string, trail_id string, loose boolean, at int, name string, form string, small boolean, number string"), "places")
    small = F.col("small").cast("int")
    usual = seen.where("small is not null").groupBy("name").agg(F.sum(small).alias("low"), F.count("*").alias("n")).where("low >= 3 and low * 3 > n * 2").select("name")
    named = seen.join(usual, "name", "left_anti")
    return named.groupBy("id").agg(F.min(F.struct("loose", "at", "trail_id", "name", "form", "number")).alias("x")).select("id", "x.trail_id", "x.name", "x.form", "x.number")


def joined_cells(cells: DataFrame, dense: int = DENSE) -> DataFrame:
    """Joins ``(a, b)`` of ``cells(nid, trail_id, name, form, number, n)``."""
    name = F.col("name")
    left_out = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(name.substr(F.lit(1), i - 1), name.substr(i + 1, F.length(name))))
    swapped = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - 1)),
        lambda i: F.concat(name.substr(F.lit(1), i - 1), name.substr(i + 1, F.lit(1)), name.substr(i, F.lit(1)), name.substr(i + 2, F.length(name))),
    )
    one = cells.select("trail_id", "form", F.col("nid").alias("a"), F.col("n").alias("na"), F.col("number").alias("ka"), name.alias("wa"), F.explode(F.array_distinct(F.concat(left_out, swapped))).alias("name"))
    two = cells.select("trail_id", "form", "name", F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("number").alias("kb"))
    near = one.join(two, ["trail_id", "form", "name"]).where("a <> b and (ka is null or kb is null or ka = kb)").select("a", "b", "na", "nb", "ka", "kb", "wa", name.alias("wb"))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), F.col("kb").alias("ka"), F.col("ka").alias("kb"), F.col("wb").alias("wa"), F.col("wa").alias("wb")))
    among_dense = near.where((F.col("na") >= dense) & (F.col("nb") >= dense) & (F.col("ka") == F.col("kb"))).select("a", "b")
    up = near.where((F.col("na") < dense) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("wb") < F.col("wa")))))
    best = F.struct((F.coalesce(F.col("ka") == F.col("kb"), F.lit(False))).alias("same"), "nb", "wb", "b")
    return among_dense.unionByName(up.groupBy("a").agg(F.max(best).alias("x")).select("a", F.col("x.b").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def clustered(reports: DataFrame, min_size: int = MIN_SIZE, dense: int = DENSE) -> DataFrame:
    """``(cluster_id, id, size, cell_size, name)`` of the reports in clusters of at least ``min_size`` different ids.

    ``cluster_id`` is the smallest id in it.  Reports without id, trail, text or place and remarks
    under ``MIN_WORDS`` words belong to none; rows repeated under one id count once; ties
    for the densest cell go to the smaller name; an empty table gives no clusters.
    """
    points = written(quantised(reports), "points")
    key = ["trail_id", "name", "form"]
    # sizes, smallest ids and usual numbers come from counts by cell, added up before the shuffle
    by_number = points.groupBy(*key, "number").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    usual = F.max_by("number", F.when(F.col("number").isNotNull(), F.struct("k", "number")))
    cells = by_number.groupBy(*key).agg(F.sum("k").alias("n"), F.min("first").alias("first"), usual.alias("number"))
    cells = written(cells.withColumn("nid", F.monotonically_increasing_id()), "cells")
    roots = components(joined_cells(cells, dense), cells.select("nid"))
    placed = cells.join(roots, "nid")
    sizes = placed.groupBy("root").agg(F.sum("n").alias("size"), F.min("first").alias("cluster_id")).where(F.col("size") >= min_size)
    labelled = placed.join(sizes, "root").select(*key, "cluster_id", "size", F.col("n").alias("cell_size"))
    # many rows of one cell meet one row here: a skewed partition is split by adaptive execution
    return points.join(labelled, key).select("cluster_id", "id", "size", "cell_size", "name")


def described(reports: DataFrame, typical: int = 3) -> DataFrame:
    """A row per cluster: ``(cluster_id, size, typical)`` - the first ids of its densest cell."""
    rows = clustered(reports)
    # only ``typical`` rows a cluster leave each task, however large the cluster is
    best = Window.partitionBy("cluster_id").orderBy(F.desc("cell_size"), "name", "id")
    top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= typical)
    return top.groupBy("cluster_id").agg(F.first("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
