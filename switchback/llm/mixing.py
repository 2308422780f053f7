"""Mixing sources to target shares of all tokens.

A document's source is often spelled differently, missing or wrong, so membership is soft: a classifier fitted on a bounded
sample of labelled rows gives each document a posterior over the sources, from the words of its text (naive Bayes over hashed words) and,
as evidence like any other, from its label.  How much the words are worth is learned: their weight is
the one that makes the held-out half of the sample most likely, and it is 0 where texts say nothing of their source.

The expected tokens of a source are the sum of rate x tokens x posterior.  Distributed projected-gradient least squares fits the
documents' rates between 0 and their source's cap to the target totals.  The gradients are added up before they are projected, so a rate is
a function of one number a source; each round is a single aggregation over the corpus and no state is kept per document.
A source that cannot reach its target gives what it can, and the others share the rest in proportion to their targets.
Rates become whole uses by carrying the rounding error, in tokens, from document to document within a source.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from switchback.plans.lineage import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
FEATURES = 4_096
#: About so many labelled documents a source fit the classifier, half of them to weigh it.
SAMPLE = 300
#: How often a readable label is taken to be wrong.
LABEL_NOISE = 1e-4
WEIGHTS = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
MAX_ROUNDS = 60
#: A total is met if it is off by no more than this part of its goal.
TOLERANCE = 1e-4
#: Documents of a source that are rounded together.
BUCKET = 50_000
MAX_SOURCES = 1_000
_WORD = re.compile(r"[^\W\d_]+")


def plain(source: Column) -> Column:
    """A source label in lower case with hyphens, as the targets are written."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_]+", "-")


class Bags(dict):
    """Place of each word among the hashed features, kept."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = at = xxhash.xxh32_intdigest(word) % FEATURES
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        bag: Counter = Counter()
        for w, n in Counter(_WORD.findall(text.lower())).items():
            bag[self[w]] += n
        return np.fromiter(bag.keys(), np.int32, len(bag)), np.fromiter(bag.values(), np.float32, len(bag))


def drawn(rows: DataFrame, names: list[str], sample: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Word counts of about ``sample`` rows of each labelled source, by hash of the id, and how many rows each source has."""
    counts = dict(rows.where(F.col("label").isin(names)).groupBy("label").count().collect())
    size = np.array([counts.get(n, 0) for n in names], float)
    part = F.lit(0.0)
    for name, n in zip(names, size):
        part = F.when(F.col("label") == name, F.lit(min(1.0, sample / max(n, 1.0)))).otherwise(part)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Bags()
        for f in frames:
            got = [made.of(t) for t in f["text"]]
            yield pd.DataFrame({"label": f["label"], "doc_id": f["doc_id"], "places": [g[0] for g in got], "counts": [g[1] for g in got]})

    few = rows.where(F.col("label").isin(names) & F.col("text").isNotNull() & (chance < part)).select("label", "doc_id", "text")
    return few.mapInPandas(bags, "label string, doc_id long, places array<int>, counts array<float>").toPandas().sort_values("doc_id"), size


def _scores(weight: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    # damped by the root of the length: words of a text are not independent
    return (weight[:, places] @ counts) / max(float(counts.sum()), 1.0) ** 0.5


def fit_bayes(sample: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, float]:
    """Log word weights (source x feature), and what they are worth on rows that they were not fitted on."""
    own = np.array([names.index(x) for x in sample["label"]], int)
    bags = [(np.asarray(p, int), np.asarray(c, float)) for p, c in zip(sample["places"], sample["counts"])]

    def logs(rows: np.ndarray) -> np.ndarray:
        total = np.full((len(names), FEATURES), 0.5)
        for r in rows:
            np.add.at(total[own[r]], bags[r][0], bags[r][1])
        return np.log(total / total.sum(1, keepdims=True))

    if len(own) < 20:
        return np.zeros((len(names), FEATURES)), 0.0
    half = np.arange(len(own)) % 2
    gain = {w: 0.0 for w in WEIGHTS}
    spread = {w: 0.0 for w in WEIGHTS}
    for side in (0, 1):
        weight, out = logs(np.flatnonzero(half == side)), np.flatnonzero(half != side)
        raw = np.array([_scores(weight, *bags[r]) for r in out])
        prior = np.log(np.bincount(own[half == side], minlength=len(names)) + 1.0)
        ll = {w: (x := w * raw + prior)[np.arange(len(out)), own[out]] - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) - x.max(1) for w in WEIGHTS}
        for w in WEIGHTS:
            gain[w] += (ll[w] - ll[0.0]).sum()
            spread[w] += ((ll[w] - ll[0.0]) ** 2).sum()
    # a weight must beat none by more than chance would
    sure = [w for w in WEIGHTS if gain[w] > 3 * spread[w] ** 0.5]
    return logs(np.arange(len(own))), max(sure, key=gain.get) if sure else 0.0


def memberships(docs: DataFrame, names: list[str], tokenizer: str = TOKENIZER, sample: int = SAMPLE, noise: float = LABEL_NOISE) -> DataFrame:
    """``(doc_id, own, tokens, p)``: tokens of the whole text, posterior over ``names``, and the source that the label says (-1: none of them)."""
    rows = docs.select("doc_id", F.coalesce(plain(F.col("source")), F.lit("")).alias("label"), "text").where("doc_id is not null")
    few, size = drawn(rows, names, sample)
    weight, worth = fit_bayes(few, names)
    prior = np.log((size + 1.0) / (size + 1.0).sum())
    shared = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), worth, prior))
    at = {name: k for k, name in enumerate(names)}

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer, "rb"))}
        enc = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        weight, worth, prior = shared.value
        made = Bags()
        for f in frames:
            own = np.array([at.get(x, -1) for x in f["label"]], int)
            score = np.tile(prior, (len(f), 1))
            known = np.flatnonzero(own >= 0)
            said = np.full((len(known), len(names)), np.log(noise / max(len(names) - 1, 1)))
            said[np.arange(len(known)), own[known]] = np.log1p(-noise)
            score[known] += said
            if worth:
                for r, t in enumerate(f["text"]):
                    if t:
                        score[r] += worth * _scores(weight, *made.of(t))
            p = np.exp(score - score.max(1, keepdims=True))
            tokens = [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "own": own, "tokens": tokens, "p": list(p / p.sum(1, keepdims=True))})

    return rows.mapInPandas(predict, "doc_id long, own int, tokens long, p array<double>")


def goals(want: np.ndarray, every: float, most: np.ndarray) -> np.ndarray:
    """Tokens each source should have of ``every``: at most ``most``, what is missing shared by the others in proportion."""
    share, full = want / max(want.sum(), 1e-12), np.zeros(len(want), bool)
    while True:
        rest = max(every - most[full].sum(), 0.0)
        free = share[~full].sum()
        goal = np.where(full, most, rest * share / free if free > 0 else 0.0)
        over = ~full & (goal > most)
        if not over.any():
            return goal
        full |= over


def fit_rates(table: DataFrame, want: np.ndarray, rate: "Callable[[np.ndarray], Column]", rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:  # noqa: F821
    """The summed gradients, one number a source, from which ``rate`` makes a document's rate; they end when all totals are met or stand still."""
    k = len(want)
    t = F.col("tokens").cast("double")
    part = [F.col(f"p{i}") for i in range(k)]
    # tokens, those that a source could have at most, and how far a total moves by one unit of step
    first = table.agg(F.sum(t), *[F.sum(F.col("cap") * t * p) for p in part], *[F.sum(t * p * p) for p in part]).first()
    if first[0] is None:
        return np.zeros(k)
    every, most, room = float(first[0]), np.array(first[1 : k + 1], float), np.maximum(np.array(first[k + 1 :], float), 1e-9)
    goal, moved, before = goals(want, every, most), np.zeros(k), None
    for _ in range(rounds):
        now = np.array(table.agg(*[F.sum(rate(moved) * t * p) for p in part]).first(), float)
        gap = goal - now
        if before is not None:
            still = (gap > tolerance * goal) & (abs(now - before) <= tolerance * goal / 10)
            if still.any():  # at its cap below its goal
                most = np.where(still, now, most)
                goal = goals(want, every, most)
                gap = goal - now
        if (abs(gap) <= tolerance * np.maximum(goal, 1.0)).all():
            break
        # least squares on the totals, scaled by each source's own reach (a diagonal preconditioner)
        moved, before = moved + gap / room, now
    return moved


def whole_uses(tokens: np.ndarray, rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Whole uses next to the rates; the error in tokens is carried on, from long documents to short ones.

    What is left in the end is made smaller by one use more or less, of a document or of two, while that helps.
    """
    uses = np.floor(rate + 1e-9).astype(np.int64)
    rest, error = rate - uses, 0.0
    for i in np.argsort(-tokens, kind="stable"):
        owed = rest[i] * tokens[i] + error
        more = owed >= tokens[i] / 2 and uses[i] < cap[i]
        uses[i] += more
        error = owed - tokens[i] * more
    for _ in range(20):
        up, down = np.flatnonzero(uses < cap), np.flatnonzero(uses > 0)
        # a change of x tokens leaves error - x; nothing at all counts as a document of no tokens
        plus = np.concatenate([[0.0], tokens[up]])
        order = np.argsort(plus, kind="stable")
        minus = np.concatenate([[0.0], tokens[down]])
        near = np.searchsorted(plus[order], minus + error)
        choice = [order[np.clip(near - k, 0, len(order) - 1)] for k in (0, 1)]
        left = np.abs(np.stack([error - plus[c] + minus for c in choice]))
        k, j = np.unravel_index(np.argmin(left), left.shape)
        if left[k, j] >= abs(error) - 1e-9:
            break
        i = choice[k][j]
        error -= plus[i] - minus[j]
        if i:
            uses[up[i - 1]] += 1
        if j:
            uses[down[j - 1]] -= 1
    return uses


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Chosen documents ``(doc_id, source, tokens, uses)`` and ``(source, target_share, share, expected_share, tokens, documents)``.

    ``targets(source, target_share, max_repeats)`` is a small table, one row a source (of repeated ones the largest); over
    ``MAX_SOURCES`` rows are an error.  The mixture is as large as the corpus.  Documents without text have no tokens
    and are not chosen; repeated rows of an id count once; a null or unknown source is given its most probable one; a source that cannot reach its
    target within its cap is used up to the cap, its shortfall shows in the report and goes to the others in proportion; an empty
    corpus gives no documents and shares of 0.  ``share`` counts the tokens of the documents as they were chosen,
    ``expected_share`` those that the posteriors expect.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m"))
    plan = sorted((r.source, float(r.s or 0), int(r.m or 0)) for r in listed.collect())
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names, want, caps = [p[0] for p in plan], np.array([p[1] for p in plan]), [float(p[2]) for p in plan]
    soft = memberships(docs, names, tokenizer, sample).where("tokens > 0")
    best = F.when(F.col("own") >= 0, F.col("own") + 1).otherwise(F.array_position("p", F.array_max("p"))).cast("int")
    cap_of = F.element_at(F.array(*[F.lit(c) for c in caps]), best)
    once = soft.groupBy("doc_id").agg(F.max(F.struct("tokens", "own", "p")).alias("x")).select("doc_id", "x.*")
    table = written(once.select("doc_id", "tokens", best.alias("k"), cap_of.alias("cap"), *[F.col("p")[i].alias(f"p{i}") for i in range(len(names))]), "soft")

    def rate(moved: np.ndarray) -> Column:
        move = sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(moved)), F.lit(0.0))
        return F.least(F.greatest(F.least(F.lit(1.0), F.col("cap")) + move, F.lit(0.0)), F.col("cap"))

    rates = rate(fit_rates(table, want, rate))

    def round_off(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id")
        return f.assign(uses=whole_uses(f["tokens"].to_numpy(), f["rate"].to_numpy(), f["cap"].to_numpy()))[["doc_id", "k", "tokens", "uses"]]

    # a source's documents are rounded in buckets of bounded size
    sizes = table.groupBy("k").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("int").alias("bucket")
    rounded = table.join(F.broadcast(sizes), "k").select("doc_id", "k", "tokens", "cap", rates.alias("rate"), bucket).groupBy("k", "bucket").applyInPandas(round_off, "doc_id long, k int, tokens long, uses int")
    source = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k"))
    chosen = written(rounded.where("uses > 0").select("doc_id", source.alias("source"), "tokens", "uses"), "chosen")
    totals = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"))
    every = totals.agg(F.sum("tokens").alias("every"))
    hoped = table.agg(*[F.sum(rates * F.col("tokens") * F.col(f"p{i}")).alias(f"e{i}") for i in range(len(names))]).select(
        F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("source"), F.array(*[F.col(f"e{i}") for i in range(len(names))]).alias("e"))).alias("x"),
        sum((F.col(f"e{i}") for i in range(len(names))), F.lit(0.0)).alias("all"),
    ).select("x.source", (F.col("x.e") / F.col("all")).alias("expected_share"))
    shares = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(F.broadcast(totals), "source", "left").join(F.broadcast(hoped), "source", "left").join(F.broadcast(every), how="cross").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("share"), F.coalesce("expected_share", F.lit(0.0)).alias("expected_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    return chosen, shares
