"""The k most similar vectors of every vector, by additive quantisation.

A vector is the sum of one full-dimensional codeword from each codebook.  The codebooks are
fitted on a bounded sample (residual k-means, then least squares over all of them at once); every vector is
encoded by beam search over the residuals and stored with the squared norm of its reconstruction.
A query's products with all codewords form a lookup table, so a code is scored by a few
additions; the best by lookup are ranked again by the exact cosine.

Vectors are kept in inverted lists.  There are about half as many as the root of the number of vectors: centres of a k-means on the
sample, and beyond ``COARSE`` of these each is divided by residual words, so that the work of a query grows with the
root of the collection.  Each query visits its ``probes`` nearest lists.  Lists are cut into parts and queries into blocks of bounded
size, so no task holds an unbounded group, however many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from switchback.plans.lineage import written

DIM = 64
BOOKS = 8
WORDS = 256
BEAM = 4
#: Vectors that fit the codebooks and centres: at least so many, sixteen for each centre, and never more than ``16 * COARSE``.
SAMPLE = 8_000
COARSE = 4_096
PROBES = 20
#: Members ranked again by the exact cosine in the two nearest lists of a query, the next two, and so on; the last holds for the rest.
RERANK = (512, 256, 128, 64)
PART = 4_096
BLOCK = 8_192


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, v)``, v the bytes of a float vector of unit length, a row per id; null, zero, NaN, infinite and odd-sized vectors are left out."""

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fit = np.array([v is not None and len(v) == dim for v in f["vector"]], bool)
            x = np.array([np.asarray(v, np.float64) for v in f["vector"][fit]]).reshape(-1, dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            v = (x[good] / norm[good, None]).astype(np.float32)
            yield pd.DataFrame({"id": f["id"].to_numpy()[fit][good], "v": [r.tobytes() for r in v]})

    # nulls inside a vector arrive as NaN
    return vectors.select("id", "vector").where("id is not null").mapInPandas(unit, "id string, v binary").groupBy("id").agg(F.min("v").alias("v"))


@dataclass
class Quantiser:
    coarse: np.ndarray  # centres x dim
    parts: np.ndarray  # residual words that divide a centre's list x dim
    books: np.ndarray  # books x words x dim

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, the nearest first."""
        half, n_parts = 0.5 * (self.coarse * self.coarse).sum(1), len(self.parts)
        # half the squared distance to centre plus part, up to what all share
        inner = self.coarse @ self.parts.T + 0.5 * (self.parts * self.parts).sum(1)
        out = []
        for lo in range(0, len(x), 2_000):
            b = x[lo : lo + 2_000]
            d = half - b @ self.coarse.T
            m = min(probes, d.shape[1])
            c = np.argpartition(d, m - 1, axis=1)[:, :m]
            d = np.take_along_axis(d, c, 1)[:, :, None] + inner[c] - (b @ self.parts.T)[:, None, :]
            name = (c[:, :, None] * n_parts + np.arange(n_parts)).reshape(len(b), -1)
            first = np.argsort(d.reshape(len(b), -1), axis=1, kind="stable")[:, :probes]
            out.append(np.take_along_axis(name, first, 1))
        return np.concatenate(out).astype(np.int32) if out else np.zeros((0, 1), np.int32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and squared norms of the reconstructions."""
    n, m = len(x), len(books)
    res = x[:, None, :]  # n x live x dim
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # squared residual after each choice, up to the part that all choices share
        err = (res * res).sum(-1)[..., None] - 2 * res @ book.T + (book * book).sum(1)
        live = min(beam, err.shape[1] * err.shape[2])
        flat = err.reshape(n, -1)
        best = np.argpartition(flat, live - 1, axis=1)[:, :live]
        state, word = best // err.shape[2], best % err.shape[2]
        rows = np.arange(n)[:, None]
        res = res[rows, state] - book[word]
        codes = np.concatenate([codes[rows, state], word[..., None].astype(np.uint8)], axis=2)
    pick = np.argmin((res * res).sum(-1), axis=1)
    rows = np.arange(n)
    made = x - res[rows, pick]
    return codes[rows, pick], (made * made).sum(1).astype(np.float32)


def fit(x: np.ndarray, lists: tuple[int, int], books: int = BOOKS, words: int = WORDS, seed: int = 3) -> Quantiser:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    res, cb = x.copy(), []
    for _ in range(books):
        c = _kmeans(res, words, rng)
        cb.append(np.concatenate([c, np.zeros((words - len(c), x.shape[1]), np.float32)]))
        res = res - c[np.argmax(res @ c.T - 0.5 * (c * c).sum(1), axis=1)]
    cb = np.stack(cb).astype(np.float32)
    for _ in range(2):
        codes, _ = encode(x, cb)
        hot = np.zeros((len(x), books * words), np.float32)
        hot[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        gram = hot.T @ hot + 0.05 * np.eye(books * words, dtype=np.float32)
        cb = np.linalg.solve(gram, hot.T @ x + 0.05 * cb.reshape(-1, x.shape[1])).reshape(books, words, -1).astype(np.float32)
    centres, n_parts = lists
    coarse = _kmeans(x, centres, rng)
    inside = x - coarse[np.argmax(x @ coarse.T - 0.5 * (coarse * coarse).sum(1), axis=1)]
    parts = _kmeans(inside, n_parts, rng) if n_parts > 1 else np.zeros((1, x.shape[1]), np.float32)
    return Quantiser(coarse, parts, cb)


def lists_for(n: int) -> tuple[int, int]:
    """Centres, and parts of each: together about half the root of the number of vectors, 8 at least."""
    every = max(8, 2 ** round(np.log2(max(n, 1) ** 0.5 / 2)))
    return min(COARSE, every), max(1, every // COARSE)


def _matrix(column: pd.Series, dim: int = DIM) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, dim), np.float32)


def similar(vectors: DataFrame, k: int = 5, probes: int = PROBES, rerank: tuple[int, ...] = RERANK, sample: int = SAMPLE, dim: int = DIM) -> DataFrame:
    """``(id, other, similarity, rank)``: for each id of ``vectors(id, vector)`` its k most similar others.

    Ties go to the smaller id.  Unusable vectors are neither asked for nor found; a lone vector has
    no neighbours; an empty table gives none; rows repeated under one id count once.
    """
    spark = vectors.sparkSession
    unit = written(usable(vectors, dim), "unit")
    n = unit.count()
    centres, n_parts = lists_for(n)
    sample = max(sample, 16 * centres)
    # about twice the sample is sorted, however many vectors there are: those with a small hash
    h = F.xxhash64("id")
    part = min(1.0, 2.0 * sample / max(n, 1))
    few = unit.where(h <= F.lit(min(2**63 - 1, int((part * 2 - 1) * 2**63)))) if part < 1 else unit
    drawn = few.select("v", h.alias("h")).orderBy("h").limit(sample).select("v").toPandas()
    zero = np.zeros((1, dim), np.float32)
    made = fit(_matrix(drawn["v"]), (min(centres, len(drawn)), n_parts)) if len(drawn) else Quantiser(zero, zero, np.zeros((BOOKS, WORDS, dim), np.float32))
    shared = spark.sparkContext.broadcast(made)

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["v"])
            codes, norms = encode(x, q.books)
            near = q.lists(x, probes)
            yield pd.DataFrame({
                "id": f["id"], "v": f["v"], "code": [r.tobytes() for r in codes], "norm": norms,
                "list": near[:, 0], "near": list(near),
            })

    coded = written(unit.mapInPandas(encoded, "id string, v binary, code binary, norm float, list int, near array<int>"), "coded")
    # how many parts each list has and how many blocks of queries visit it: as many rows as lists
    sizes = coded.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asked = coded.select(F.explode("near").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(asked, "list"))
    h = F.xxhash64("id")
    members = coded.join(plan, "list").select(
        "list", F.pmod(h, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "code", "norm"
    )
    again = coded.select(F.col("id").alias("asker"), F.col("v").alias("asked"), F.posexplode("near").alias("turn", "list"))
    queries = again.join(plan, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("asker"), F.col("blocks")).cast("int").alias("block"), "asker", "asked", "turn"
    )

    def scan(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "other", "similarity"]
        if not len(own) or not len(ask):
            return pd.DataFrame([], columns=cols).astype({"similarity": float})
        books = shared.value.books
        own = own.sort_values("id")
        ids = own["id"].to_numpy()
        x = np.frombuffer(b"".join(own["v"]), np.float32).reshape(len(own), -1)
        code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1).astype(np.int64)
        norm = own["norm"].to_numpy(np.float32)
        ask = ask.assign(r=[min(rerank[min(t // 2, len(rerank) - 1)], len(own)) for t in ask["turn"]]).sort_values(["r", "asker"])
        who, depth = ask["asker"].to_numpy(), ask["r"].to_numpy()
        q = np.frombuffer(b"".join(ask["asked"]), np.float32).reshape(len(ask), -1)
        at = {i: j for j, i in enumerate(ids)}
        me = np.array([at.get(i, -1) for i in who])
        parts = []
        starts = [x for r in np.unique(depth) for x in range(*np.searchsorted(depth, [r, r + 1]), 512)]
        for lo, hi in zip(starts, [*starts[1:], len(q)]):
            b, mine, r = q[lo:hi], me[lo:hi], int(depth[lo])
            score = np.zeros((len(ids), len(b)), np.float32) - 0.5 * norm[:, None]
            for m in range(len(books)):
                score += (books[m] @ b.T)[code[:, m]]  # the lookup table's rows of the codes
            score = score.T
            hit = np.flatnonzero(mine >= 0)
            score[hit, mine[hit]] = -np.inf
            top = np.argpartition(-score, r - 1, axis=1)[:, :r]
            exact = np.einsum("qd,qrd->qr", b, x[top], dtype=np.float64)
            exact[top == mine[:, None]] = -np.inf
            top = np.take_along_axis(top, o := np.argsort(top, axis=1), 1)
            exact = np.take_along_axis(exact, o, 1)
            first = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            val = np.take_along_axis(exact, first, 1)
            rows = np.repeat(np.arange(len(b)), val.shape[1])
            keep = np.isfinite(val.ravel())
            parts.append(pd.DataFrame({
                "id": who[lo + rows[keep]], "other": ids[np.take_along_axis(top, first, 1).ravel()[keep]], "similarity": val.ravel()[keep],
            }))
        return pd.concat(parts)[cols]

    key = ["list", "part", "block"]
    near = members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(scan, "id string, other string, similarity double")
    # the k best of all lists: a bounded list per query
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("p", "b")).select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """Pairs ``(id_a, id_b)``, the smaller id first, of which one is among the other's k nearest, from ``least`` on."""
    near = similar(vectors, k).where(F.col("similarity") >= least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
