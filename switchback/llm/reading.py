"""Reading level of each document: a learned pairwise ranker, calibrated into levels.

Features of syntax and vocabulary are counted in one Arrow pass over the running prose (measured: a quarter of the CPU of the
same counts as Catalyst expressions).  A bounded sample of English documents is graded by the level definition, and a
linear ranker is fitted on pairs of it (logistic loss on the difference of their features).  A pair is graded if the documents
are of different levels, or if one of them exceeds the other clearly both in sentence length and in word length.
Isotonic regression (pool adjacent violators) turns the score into an expected grade between 0 (easy) and 2
(demanding).  Outside that sample the level alone decides: no bound of the definition is asked again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: At most so many documents, the first by hash of the id, are graded to fit the ranker.
SAMPLE_DOCS = 20_000
SAMPLE_PAIRS = 60_000
RIDGE = 1e-4
EASY_WORDS, EASY_LETTERS = 9.0, 4.0
HARD_WORDS, HARD_LETTERS = 22.0, 5.2
FEATURES = ("log_sentence", "letters_per_word", "long_share", "short_share", "commas_per_sentence", "function_share", "subordinate_share", "variety")

# fixed values: frequent function words that tell the three languages of the corpus apart
ENGLISH = "the|and|of|to|is|we|it|that|with|for|had|my|at|by|on|this|has|which|our|not|you|he|she|they|be|are"
SPANISH = "el|la|los|las|de|del|que|y|un|una|con|por|se|al|hay|lo|es|no|muy|desde|hasta"
GERMAN = "der|die|das|und|ist|ein|eine|einen|von|mit|den|dem|zu|auf|im|nicht|sind|es|wir|bei|für|der|aber"
# fixed values: words that open a subordinate clause
SUBORDINATORS = "because|although|though|which|that|whereas|while|unless|whether|since|if|when|where|who|whose|whom|until|whenever|wherever|provided|insofar"

#: Tokens that are no words, and signs around words.
NO_WORDS = frozenset(("", "-", "–", "—", "|", "*", "•", "+", "=", "&", "...", "…", ">", "·", "/", ":", "---"))
SIGNS = ".,;:!?\"'()[]{}<>*_|“”‘’…-–—"
SPACE = " \t\n\x0b\f\r"

_HIDDEN = re.compile("[\u200b-\u200f\u00ad\u2060\ufeff]")
_FRONT = re.compile(r"\A\s*---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\Z)")
_HEADING = re.compile(r"\n[ \t]{0,3}#{1,6}[ \t].*(?=\n|\Z)")
_LIST = re.compile(r"\n(?:[ \t]|>)*(?:[-*•+][ \t]+|\d+[.)][ \t]+|\d+\.\d+[ \t]+)?")
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=[ \t\n\x0b\f\r]|\Z)")
_PERIOD = re.compile(r"\.(?=([ \t\n\x0b\f\r]+)([^ \t\n\x0b\f\r]))")
_BLANK = re.compile(r"\n[ \t]*\n")
_SPLIT = re.compile(f"[{SPACE}]+")
_ODD_SPACE = re.compile(r"[^\S \t\n\x0b\f\r]")
# fixed values: abbreviations whose period ends no sentence, and those that stand before a name
_SHORTENED = re.compile(r"(?:^|[^\w])(?:ca|approx|rd|mt|e\.g|i\.e|vs|mr|mrs|ms|dr|st|no|ft|mi|[ap]\.m)\Z", re.I)
_BEFORE_NAME = ("mt", "st", "rd", "dr", "mr")
_KIND = {w: sum(b for b, words in ((1, ENGLISH), (2, SPANISH), (4, GERMAN), (8, SUBORDINATORS)) if w in words.split("|")) for words in (ENGLISH, SPANISH, GERMAN, SUBORDINATORS) for w in words.split("|")}
_LETTERS: list[np.ndarray] = []


def prose(text: str) -> str:
    """Running prose: front matter, headings, list marks and quotation marks of lines taken out."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if not t.isascii():
        t = _HIDDEN.sub("", t)
    if "---" in t:
        t = _FRONT.sub("", t, count=1)
    t = "\n" + t
    if "#" in t:
        t = _HEADING.sub("\n\n", t)
    return _LIST.sub("\n", t)[1:]


def _inner_periods(p: str) -> int:
    """Periods of abbreviations that end no sentence."""
    n = 0
    for m in _PERIOD.finditer(p):
        at, gap, after = m.start(), m[1], m[2]
        head = p[max(0, at - 8) : at]
        if not _SHORTENED.search(head):
            continue
        n += after in "0123456789(" or "a" <= after <= "z" or (len(gap) == 1 and after.isalpha() and head[-2:].lower() in _BEFORE_NAME)
    return n


def _open_ends(p: str) -> int:
    """Paragraphs, and the text, that end in a letter, digit, comma or colon instead of a mark."""
    parts = _BLANK.split(p)
    ends = [x.rstrip(" \t")[-1:] for x in parts[:-1]] + [parts[-1].rstrip(SPACE)[-1:]]
    return sum(c != "" and (c.isalpha() or c in "0123456789,;:") for c in ends)


def measures(text: str) -> tuple[float, ...]:
    """``(words per sentence, letters per word, language code, *FEATURES)`` of a text; without words the code is -1."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    p = prose(text)
    low = p.lower()
    words = [w for w in (_SPLIT.split(low) if _ODD_SPACE.search(low) else low.split()) if w not in NO_WORDS]
    n = len(words)
    if not n:
        return (np.nan, np.nan, -1.0, *[np.nan] * len(FEATURES))
    letters = int(np.count_nonzero(_LETTERS[0][np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)]))
    sentences = max(1, len(_END.findall(p)) - _inner_periods(p) + _open_ends(p))
    sizes = Counter(map(len, words))
    kinds = Counter(_KIND.get(w.strip(SIGNS), 0) for w in words)
    en, es, de, sub = (sum(c for k, c in kinds.items() if k & b) for b in (1, 2, 4, 8))
    code = 0.0 if en >= es and en >= de and en else 1.0 if es > de else 2.0 if de else 3.0
    return (
        n / sentences, letters / n, code,
        log(n / sentences), letters / n, sum(c for k, c in sizes.items() if k >= 9) / n, sum(c for k, c in sizes.items() if k <= 3) / n,
        p.count(",") / sentences, en / n, sub / n, len(set(words)) / n**0.5,
    )


def with_features(docs: DataFrame) -> DataFrame:
    """``(doc_id, language, words_per_sentence, letters_per_word, ...)`` of ``docs(doc_id, text)``, a row each; texts without words have null features."""
    columns = ["words_per_sentence", "letters_per_word", "code", *(f for f in FEATURES if f != "letters_per_word")]
    place = [0, 1, 2, *(3 + k for k, f in enumerate(FEATURES) if f != "letters_per_word")]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = (np.nan, np.nan, -1.0, *[np.nan] * len(FEATURES))
        for f in frames:
            rows = np.array([measures(t) if t else nothing for t in f["text"]], float).reshape(-1, len(nothing))
            yield pd.DataFrame({"doc_id": f["doc_id"]} | {c: rows[:, k] for c, k in zip(columns, place)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in columns))
    numbers = [F.nanvl(F.col(c), F.lit(None)).alias(c) for c in columns if c != "code"]
    return out.select("doc_id", F.element_at(F.array(*map(F.lit, ("en", "es", "de", "und"))), F.nullif(F.col("code").cast("int"), F.lit(-1)) + 1).alias("language"), *numbers)


def grade(words: Column, letters: Column) -> Column:
    """0 easy, 2 demanding, 1 between, by the bounds of the definition."""
    return F.when((words < EASY_WORDS) & (letters < EASY_LETTERS), 0).when((words > HARD_WORDS) & (letters > HARD_LETTERS), 2).otherwise(1)


@dataclass(frozen=True)
class Ranker:
    mean: list[float]
    scale: list[float]
    weight: list[float]
    #: Scores from which each level on holds, ascending, and the levels (one more).
    knots: list[float]
    levels: list[float]

    def score(self) -> Column:
        parts = [(F.col(f) - F.lit(m)) * F.lit(w / s) for f, m, s, w in zip(FEATURES, self.mean, self.scale, self.weight)]
        return sum(parts[1:], parts[0])

    def level(self, score: Column) -> Column:
        knots = F.array(*[F.lit(float(k)) for k in self.knots]) if self.knots else F.array().cast("array<double>")
        levels = F.array(*[F.lit(float(v)) for v in self.levels])
        return F.element_at(levels, F.size(F.filter(knots, lambda k: k <= score)) + 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: thresholds and nondecreasing values of y over ascending x."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order].astype(float)
    blocks: list[list[float]] = []  # first x, sum, count, last x
    for a, b in zip(xs, ys):
        if blocks and blocks[-1][0] == a:
            blocks[-1][1] += b
            blocks[-1][2] += 1
        else:
            blocks.append([a, b, 1, a])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] = last[3]
    # a threshold lies halfway between two blocks, out of reach of rounding
    return [(a[3] + b[0]) / 2 for a, b in zip(blocks, blocks[1:])], [b[1] / b[2] for b in blocks]


def graded_pairs(x: np.ndarray, g: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of about ``n`` (harder, easier) rows: half by level, half by clear dominance in sentence and word length."""
    by = [np.flatnonzero(g == k) for k in (0, 1, 2)]
    kinds = [(lo, hi) for lo, hi in ((0, 1), (1, 2), (0, 2)) if len(by[lo]) and len(by[hi])]
    drawn = [(rng.choice(by[hi], n // (2 * len(kinds))), rng.choice(by[lo], n // (2 * len(kinds)))) for lo, hi in kinds]
    one, two = rng.integers(0, len(x), (2, n))
    length, letters = x[:, FEATURES.index("log_sentence")], x[:, FEATURES.index("letters_per_word")]
    clear = (length[one] - length[two] > 0.25) & (letters[one] - letters[two] > 0.25)
    drawn.append((one[clear][: n // 2], two[clear][: n // 2]))
    return np.concatenate([d[0] for d in drawn]), np.concatenate([d[1] for d in drawn])


def fit(x: np.ndarray, g: np.ndarray, seed: int = 7) -> Ranker:
    """Linear pairwise ranker on graded rows, then its calibration; constant grades give a constant level."""
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    if len(x) == 0:
        return Ranker([0.0] * len(FEATURES), [1.0] * len(FEATURES), [0.0] * len(FEATURES), [], [1.0])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    w = np.zeros(x.shape[1])
    harder, easier = graded_pairs(x, g, SAMPLE_PAIRS, rng)
    if len(harder):
        d = z[harder] - z[easier]
        for _ in range(30):  # Newton steps of the ridge-penalised logistic loss
            q = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), (q[:, None] * d).mean(0) - RIDGE * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    knots, levels = isotonic(z @ w, g)
    return Ranker(mean.tolist(), scale.tolist(), w.tolist(), knots, levels)


def fit_on(featured: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ranker:
    """Fit on the first ``sample_docs`` English documents by hash of the id."""
    english = featured.where("language = 'en'").withColumn("h", F.xxhash64("doc_id"))
    # rows with a small hash: about as many as the sample holds, however large the corpus
    part = min(1.0, sample_docs / max(english.count(), 1))
    few = english.where(F.col("h") <= F.lit(min(2**63 - 1, int((part * 2 - 1) * 2**63)))) if part < 1 else english
    graded = grade(F.col("words_per_sentence"), F.col("letters_per_word")).alias("g")
    sample = few.select(*[F.col(f).cast("float") for f in FEATURES], graded, "h").toPandas().sort_values(["h", *FEATURES]).head(sample_docs)
    return fit(sample[list(FEATURES)].to_numpy(), sample["g"].to_numpy())


def reading_levels(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, language, score, level, band, words_per_sentence, letters_per_word)``, a row per document.

    ``level`` is the calibrated grade, ``band`` its rounding (easy, middle, demanding).  Null, empty and
    wordless texts have null level and band; repeated rows stay; an empty table gives an empty result.
    """
    from switchback.plans.lineage import written

    featured = written(with_features(docs), "features")
    ranker = fit_on(featured, sample_docs)
    out = featured.withColumn("score", ranker.score()).withColumn("level", F.when(F.col("score").isNotNull(), ranker.level(F.col("score"))))
    band = F.when(F.col("level") < 0.5, "easy").when(F.col("level") >= 1.5, "demanding").when(F.col("level").isNotNull(), "middle")
    return out.select("doc_id", "language", "score", "level", band.alias("band"), "words_per_sentence", "letters_per_word")


def listed_bands(docs: DataFrame) -> DataFrame:
    """English documents of the outer bands, by their calibrated level."""
    levels = reading_levels(docs).where("language = 'en' and doc_id is not null and band in ('easy', 'demanding')")
    return levels.select("doc_id", "band").distinct()


def profile(docs: DataFrame) -> DataFrame:
    """The corpus by language and band: documents and mean features."""
    levels = reading_levels(docs)
    return levels.groupBy("language", "band").agg(
        F.count("*").alias("documents"), F.round(F.avg("level"), 3).alias("mean_level"),
        F.round(F.avg("words_per_sentence"), 2).alias("mean_words"), F.round(F.avg("letters_per_word"), 2).alias("mean_letters"),
    )
