"""Near-duplicate texts by an inverted join over signature coordinates.

Each distinct text gets a min-wise signature of its word runs.  It is posted under pairs
(coordinate, value), and texts that meet in a posting list have their collisions counted:

* *prefix*: a text is posted only under its rarest coordinate values.  Rarity is read from a sketch
  of bounded size that counts the values of all texts; any common order will do, so its
  collisions cost nothing but speed.  Of two texts that agree in ``least_match`` of ``coords`` coordinates,
  the k rarest common values are among the ``coords - least_match + k`` rarest of each, so
  that a prefix of this length loses no such pair;
* *skip*: a value that the sketch finds to be common is never posted by itself.  Its list is skipped for those of its pairs
  with each later value of the same text (k = 2 above), unless these hold as many pairs as the list itself (a family of near
  copies).  What is still long is posted in blocks, so that no list of a task exceeds ``block`` by more than the sketch's error;
* *count*: members of a list are compared by the low two bits of ``MARKS`` coordinates, which travel with the posting; a pair
  goes on only if enough of them collide (``least_marks``);
* what is left is verified by the runs themselves (their 32-bit hashes);
* all pairs inside a family (texts joined by links, directly or through others) that lacks some link are then compared by
  their runs in blocks, so that a pair lost by the two bounds above is found if any chain of links joins it.

Copies (equal word sequences) are one class with one representative before anything is posted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from switchback.plans.lineage import forget, written

#: Coordinates whose values are posted, and coordinates whose low two bits are compared.
COORDS = 32
MARKS = 128
#: Fewest and most counters of the sketch (4 bytes each); within them it has one for every 64 values.
COUNTERS = (1 << 16, 1 << 22)
#: Members of a list that a task compares with each other as they are; longer ones are split.
BLOCK = 2_048
#: Members of a family whose run sets meet in one task.
FAMILY = 128
BITS = 1 << 24
_ODD = np.random.default_rng(20240229).integers(0, 2**32, size=(256, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SIG = [f"s{i}" for i in range(COORDS // 2)]
MARK = [f"m{i}" for i in range(4)]


def in_batches(f: pd.DataFrame, rows: int = 1_000, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a frame with a bounded number of rows and characters (one row at least)."""
    size = f["text"].str.len().to_numpy()
    lo = 0
    while lo < len(f):
        hi, held = lo + 1, size[lo]
        while hi < len(f) and hi - lo < rows and held + size[hi] <= chars:
            held += size[hi]
            hi += 1
        yield f.iloc[lo:hi]
        lo = hi


def _word_table() -> np.ndarray:
    """Whether each code point belongs to a word."""
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


_WORDS: list[np.ndarray] = []


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits in lower case), text after text, and how many each text has."""
    if not _WORDS:
        _WORDS.append(_word_table())
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    letter = _WORDS[0][codes]
    edge = np.diff(letter, prepend=False, append=False)
    first, last = np.flatnonzero(edge)[::2], np.flatnonzero(edge)[1::2]
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.zeros(0, np.uint64), counts
    # a polynomial hash of each word, modulo 2^64, then mixed
    sizes = last - first
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
    h = np.add.reduceat((codes[letter].astype(np.uint64) + np.uint64(1)) * power[inside], starts)
    return _mixed(h), counts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of all runs of ``run`` successive words, the first place of each text, hashes of the word sequences (0: no run)."""
    w, sizes = word_hashes(texts)
    counts = np.maximum(sizes - run + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    raw, edges = w.tobytes(), np.concatenate([[0], np.cumsum(sizes)])
    whole = [xxhash.xxh3_64_intdigest(raw[8 * edges[i] : 8 * edges[i + 1]]) if counts[i] else 0 for i in range(len(texts))]
    if not at[-1]:
        return np.zeros(0, np.uint64), at, whole
    h = np.zeros(len(w) - run + 1, np.uint64)
    for k in range(run):
        h = (h ^ w[k : len(w) - run + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    keep = np.repeat(edges[:-1] - at[:-1], counts) + np.arange(at[-1])
    return h[keep], at, whole


def signatures(texts: list[str], run: int, coords: int = MARKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that have a run: their numbers, signatures (32 bits a coordinate) and sequence hashes."""
    h, at, sequence = run_hashes(texts, run)
    h = (h >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(at))
    sig = np.empty((coords, len(full)), np.uint32)
    for j in range(coords if len(full) else 0):
        sig[j] = np.minimum.reduceat(h * _ODD[j, 0] + _ODD[j, 1], at[full])
    return full, np.ascontiguousarray(sig.T), np.array(sequence, np.uint64)[full]


def class_numbers(whole: np.ndarray, tabs: np.ndarray) -> np.ndarray:
    """Number of the class of each (table, word sequence): 63 bits of a hash."""
    salt = {t: xxhash.xxh3_64_intdigest(str(t)) for t in set(tabs)}
    return (_mixed(whole ^ np.array([salt[t] for t in tabs], np.uint64)) >> np.uint64(1)).astype(np.int64)


def _packed(sig: np.ndarray) -> np.ndarray:
    """The low two bits of each coordinate, the first bits of all before the second ones."""
    low = [np.packbits((sig[:, :MARKS] & np.uint32(1 << b)) > 0, axis=1) for b in (0, 1)]
    return np.concatenate(low, axis=1).view(np.int64)


def signature_table(texts: DataFrame, run: int) -> DataFrame:
    """``(tab, rec_id, nid, s0.., m0..)`` of the texts that have a run of words."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in in_batches(f):
                full, sig, whole = signatures(list(g["text"]), run)
                tabs = g["tab"].to_numpy()[full]
                values = np.ascontiguousarray(sig[:, :COORDS]).view(np.int64).reshape(len(full), -1)
                marks = _packed(sig) if len(full) else np.zeros((0, 4), np.int64)
                out = {"tab": tabs, "rec_id": g["rec_id"].to_numpy()[full], "nid": class_numbers(whole, tabs)}
                yield pd.DataFrame(out | {c: values[:, i] for i, c in enumerate(SIG)} | {c: marks[:, i] for i, c in enumerate(MARK)})

    source = texts.select("tab", "rec_id", "text").where("text is not null and rec_id is not null")
    return source.mapInPandas(make, "tab string, rec_id string, nid long, " + ", ".join(f"{c} long" for c in SIG + MARK))


def _keys(f: pd.DataFrame) -> np.ndarray:
    """A 64-bit key of each (table, coordinate, value)."""
    v = np.ascontiguousarray(f[SIG].to_numpy()).view(np.uint32).reshape(len(f), -1).astype(np.uint64)
    salt = {t: xxhash.xxh3_64_intdigest(str(t)) for t in set(f["tab"])}
    t = np.array([salt[x] for x in f["tab"]], np.uint64)[:, None]
    return _mixed(v + (np.arange(v.shape[1], dtype=np.uint64) << np.uint64(32)) + t)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys & np.uint64(size - 1)).astype(np.int64)


def summed(rows: DataFrame, size: int, per_batch) -> np.ndarray:
    """Adds up arrays of ``size`` numbers that ``per_batch`` makes of each frame of ``rows``: in the tasks, then by pieces of the array."""
    pieces = max(16, size // (1 << 14))
    step = size // pieces

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for f in frames:
            if len(f):
                slots, weights = per_batch(f)
                total += np.bincount(slots, weights, minlength=size)
        if total.any():
            yield pd.DataFrame({"piece": np.arange(pieces), "n": [total[i * step : (i + 1) * step].astype(np.float32).tobytes() for i in range(pieces)]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        n = np.frombuffer(b"".join(f["n"]), np.float32).reshape(-1, step).sum(0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"piece": f["piece"].iloc[:1], "n": [n.tobytes()]})

    parts = rows.mapInPandas(count, "piece int, n binary").groupBy("piece").applyInPandas(add, "piece int, n binary").collect()
    out = np.zeros((pieces, step), np.float32)
    for r in parts:
        out[r.piece] = np.frombuffer(r.n, np.float32)
    return out.ravel()


class Posting:
    """Which keys a text is posted under; all texts of a list decide alike, since they ask the same sketches."""

    def __init__(self, coords: int, least_match: int, block: int):
        self.coords, self.prefix, self.block = coords, coords - least_match + 1, block
        self.single = self.double = self.below = None
        self.noise = 0.0

    def ordered(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each text with the sizes of their lists, the rarest first; the key itself breaks ties."""
        keys = _keys(f)
        size = np.maximum(self.single[_slots(keys, len(self.single))] - self.noise, 1)
        by = np.lexsort((keys, size), axis=1)[:, : self.prefix + 1]
        return np.take_along_axis(keys, by, 1), np.take_along_axis(size, by, 1)

    def pairs(self, keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key of a common value, key of it with a later value) of each common value in the prefix."""
        row, at = np.nonzero(size[:, : self.prefix] > self.block)
        later = np.arange(keys.shape[1]) > at[:, None]
        k, j = np.nonzero(later)
        parent = keys[row[k], at[k]]
        return row[k], parent, _mixed(parent ^ (keys[row[k], j] * _MIX))

    def lists(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, parts of its list) of each posting."""
        keys, size = self.ordered(f)
        row, at = np.nonzero(size[:, : self.prefix] <= self.block)
        out = [(row, keys[row, at], np.ones(len(row), np.int64))]
        if self.double is not None:
            row, parent, key = self.pairs(keys, size)
            own = np.maximum(self.single[_slots(parent, len(self.single))] - self.noise, 1)
            dense = self.below[_slots(parent, len(self.below))] >= own * (own - 1) / 2
            some = ~dense
            n = self.double[_slots(key[some], len(self.double))]
            out.append((row[some], key[some], np.ceil(n / self.block).astype(np.int64)))
            r, at = np.nonzero(size[:, : self.prefix] > self.block)
            k, n = keys[r, at], size[r, at]
            dense = self.below[_slots(k, len(self.below))] >= n * (n - 1) / 2
            out.append((r[dense], k[dense], np.ceil(n[dense] / self.block).astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))


def posting(classes: DataFrame, coords: int, least_match: int, block: int) -> Posting:
    """The sketches of all texts: list sizes, and if some list is common also those of its pairs of values."""
    n = classes.count()
    size = min(COUNTERS[1], max(COUNTERS[0], 1 << int(max(n * coords / 64, 1)).bit_length()))
    made, read = Posting(coords, least_match, block), classes.select("tab", *SIG)
    made.single = summed(read, size, lambda f: (_slots(_keys(f), size).ravel(), None))
    made.noise = float(n * coords / size)
    if (made.single - made.noise > block).any():

        def double(f):
            key = made.pairs(*made.ordered(f))[2]
            return _slots(key, size), None

        made.double = summed(read, size, double)

        def below(f):
            _, parent, key = made.pairs(*made.ordered(f))
            return _slots(parent, size), np.maximum(made.double[_slots(key, size)] - 1.0, 0) / 2

        made.below = summed(read, size, below)
    return made


def _met(nid: np.ndarray, marks: np.ndarray, key: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the members of each list (rows of one key, one after another) of whose marks at least ``least`` collide.

    A number below zero is a member of the second block of a list in parts: it meets only those of the first.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        a, b = marks[p], marks[q]
        z = a ^ b
        apart = np.bitwise_count(z[..., 0] | z[..., 2]) + np.bitwise_count(z[..., 1] | z[..., 3])
        ok = apart <= MARKS - least
        p, q = np.broadcast_arrays(p, q)
        p, q = nid[p[ok]], nid[q[ok]]
        keep = (p >= 0) | (q >= 0)
        out.append((np.where(p < 0, ~p, p)[keep], np.where(q < 0, ~q, q)[keep]))

    for n in np.unique(size[size > 1]):
        starts = first[size == n]
        if n <= 128:
            x, y = np.triu_indices(n, 1)
            step = max(1, 200_000 // len(x))
            for lo in range(0, len(starts), step):
                s = starts[lo : lo + step, None]
                compare((s + x).ravel(), (s + y).ravel())
        else:
            for s in starts:
                for lo in range(0, n, 64):
                    hi = min(lo + 64, n)
                    x, y = np.triu_indices(hi - lo, 1)
                    compare(s + lo + x, s + lo + y)
                    if hi < n:
                        compare(np.arange(s + lo, s + hi)[:, None], np.arange(s + hi, s + n)[None, :])
    return out


def candidates(classes: DataFrame, least_match: int, least_marks: int, coords: int = COORDS, block: int = BLOCK) -> DataFrame:
    """Pairs ``(a, b)`` of class numbers, a < b: those that agree in ``least_match`` coordinates and collide in ``least_marks`` marks are among them."""
    shared = classes.sparkSession.sparkContext.broadcast(posting(classes, coords, least_match, block))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = shared.value
        for f in frames:
            if not len(f):
                continue
            row, key, parts = made.lists(f)
            nid, marks = f["nid"].to_numpy(), f[MARK].to_numpy()
            if (parts > 1).any():
                # a list in parts meets as pairs of parts; ~nid marks the second one
                again = np.repeat(np.arange(len(row)), parts)
                row, key, parts, other = row[again], key[again], parts[again], np.concatenate([np.arange(p) for p in parts])
                own = (_mixed(nid.view(np.uint64))[row] % parts.astype(np.uint64)).astype(np.int64)
                whole = parts <= 1
                lo, hi = np.minimum(own, other), np.maximum(own, other)
                key = np.where(whole, key, _mixed(key + (lo.astype(np.uint64) << np.uint64(32)) + hi.astype(np.uint64) + np.uint64(1)))
                who = np.where(~whole & (lo != hi) & (own == hi), ~nid[row], nid[row])
            else:
                who = nid[row]
            yield pd.DataFrame({"key": key.view(np.int64), "nid": who} | {c: marks[row, i] for i, c in enumerate(MARK)})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def pairs(f: pd.DataFrame) -> pd.DataFrame:
            out = _met(f["nid"].to_numpy(), f[MARK].to_numpy().view(np.uint64), f["key"].to_numpy(), least_marks)
            p = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)])
            q = np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)])
            return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

        for f in frames:
            held.append(f)
            # rows come in the order of their keys: only the last list may go on in the next frame
            if sum(map(len, held)) >= 200_000 and held[0]["key"].iloc[0] != f["key"].iloc[-1]:
                f = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(f["key"].to_numpy(), f["key"].iloc[-1]))
                held = [f.iloc[cut:]]
                yield pairs(f.iloc[:cut])
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    columns = "key long, nid long, " + ", ".join(f"{c} long" for c in MARK)
    posted = classes.select("nid", "tab", *SIG, *MARK).mapInPandas(post, columns)
    return posted.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").where("a <> b").distinct()


def _sets(texts: list[str], run: int) -> tuple[list[np.ndarray], np.ndarray]:
    h, at, whole = run_hashes(texts, run)
    h = (h >> np.uint64(32)).astype(np.uint32)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(texts))], np.array(whole, np.uint64)


def run_sets(texts: DataFrame, wanted: DataFrame, run: int) -> DataFrame:
    """``(nid, runs)``: the sorted hashes of the distinct runs of the classes whose heads are in ``wanted(tab, rec_id)``.

    Texts are not shuffled: a bitmap of fixed size lets those of the wanted rows through, and a few more.
    """
    place = F.pmod(F.xxhash64("tab", "rec_id"), F.lit(BITS))
    rows = wanted.select((place + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = np.zeros(BITS, bool)
    for r in rows.collect():
        lo = (r.bucket - 1) * 32_768
        bits[lo : lo + 32_768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(shared.value).view(bool)
        for f in frames:
            f = f[known[f["place"].to_numpy()]]
            for g in in_batches(f):
                sets, whole = _sets(list(g["text"]), run)
                some = np.flatnonzero(whole)
                yield pd.DataFrame({"nid": class_numbers(whole[some], g["tab"].to_numpy()[some]), "runs": [sets[i].tobytes() for i in some]})

    source = texts.select("tab", "rec_id", "text").where("text is not null and rec_id is not null")
    found = source.select("tab", "text", place.cast("int").alias("place")).mapInPandas(shrink, "nid long, runs binary")
    return found.groupBy("nid").agg(F.first("runs").alias("runs"))


def verified(pairs: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose shared runs are at least ``threshold`` of all their runs."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sims = []
            for x, y in zip(f["ra"], f["rb"]):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    sims.append(0.0)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / (len(x) + len(y) - both))
            g = pd.DataFrame({"a": f["a"], "b": f["b"], "sim": np.array(sims, float)})
            yield g[g["sim"] >= threshold]

    both = pairs.select("a", "b").join(runs.toDF("a", "ra"), "a").join(runs.toDF("b", "rb"), "b")
    return both.mapInPandas(compare, "a long, b long, sim double")


def incomplete(links: DataFrame) -> DataFrame:
    """The links of families in which some pair is not linked.

    In a complete family all members have the same neighbours, themselves included, and are as many as these.
    """
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = ends.groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("x")).select("a", "n", F.col("x").bitwiseXOR(F.xxhash64("a")).alias("x"))
    whole = around.groupBy("x", "n").agg(F.count("*").alias("k")).where("k = n + 1").select("x", "n")
    open_ones = around.join(whole, ["x", "n"], "left_anti").select("a")
    return links.join(open_ones, "a", "left_semi")


def family_links(links: DataFrame, runs: DataFrame, threshold: float, size: int = FAMILY) -> DataFrame | None:
    """Links ``(a, b, sim)`` between texts that other links join through others, but not directly; None if no family lacks a link.

    New links among them leave the families as they are, so that once is enough.  A family is cut into parts of about
    ``size`` texts; a task holds two of them and counts the runs that each two texts share.
    """
    rest = written(incomplete(links), "incomplete")
    if rest.isEmpty():
        return None
    nodes = rest.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    roots = written(components(rest, nodes), "families")
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")
    own = roots.join(sizes, "root").select("root", "nid", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = own.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "nid")

    def share(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part", kind="stable")
        sets = [np.frombuffer(r, np.uint32) for r in f["runs"]]
        n, nid = np.array([len(s) for s in sets]), f["nid"].to_numpy()
        u, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), n)
        place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(place.max(initial=-1)) + 1, 20_000):  # shared runs, a slice at a time
            here = (place >= lo) & (place < lo + 20_000)
            hot = np.zeros((len(sets), 20_000), np.float32)
            hot[doc[here], place[here] - lo] = 1
            both += hot @ hot.T
        sim = both / (n[:, None] + n[None, :] - both)
        cross = f["part"].to_numpy()[:, None] != f["part"].to_numpy()[None, :] if f["lo"].iloc[0] != f["hi"].iloc[0] else np.ones_like(sim, bool)
        x, y = np.nonzero(np.triu((sim.astype(np.float64) >= threshold) & cross, 1))
        exact = both[x, y].astype(np.float64) / (n[x] + n[y] - both[x, y])
        return pd.DataFrame({"a": np.minimum(nid[x], nid[y]), "b": np.maximum(nid[x], nid[y]), "sim": exact})[exact >= threshold]

    found = keyed.join(runs, "nid").groupBy("root", "lo", "hi").applyInPandas(share, "a long, b long, sim double")
    return found.join(links.select("a", "b"), ["a", "b"], "left_anti")


def bounds(threshold: float, coords: int = COORDS, marks: int = MARKS) -> tuple[int, int]:
    """Fewest equal coordinates and colliding marks: 3.3 and 4 standard deviations below what a pair at the threshold has."""
    agree = threshold + (1 - threshold) / 4
    least = coords * threshold - 3.3 * (coords * threshold * (1 - threshold)) ** 0.5
    return max(1, int(least)), max(1, int(marks * agree - 4 * (marks * agree * (1 - agree)) ** 0.5))


def near_duplicates(texts: DataFrame, run: int = 5, threshold: float = 0.8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links between classes and membership of ``texts(tab, rec_id, text)``.

    Returns ``links(tab, a, b, sim)`` (class numbers, a < b) and ``members(tab, rec_id, nid)``.  Texts
    that are null or have fewer words than a run belong to no class; repeated rows of one id count
    once (one of its texts, the same each time, should they differ); texts of any length are read whole; an empty
    table gives no links and no members; other columns are ignored.
    """
    rows = written(signature_table(texts, run), "signatures")
    members = rows.groupBy("tab", "rec_id").agg(F.min("nid").alias("nid"))
    heads = members.groupBy("nid").agg(F.min("tab").alias("tab"), F.min("rec_id").alias("rec_id"))
    # copies have the same signature: sums of longs, so that the aggregation needs no sort
    kinds = rows.groupBy("nid").agg(*[F.min(c).alias(c) for c in SIG + MARK])
    classes = written(kinds.join(heads, "nid"), "classes")
    pairs = written(candidates(classes, *bounds(threshold), block=block), "pairs")
    wanted = classes.select("nid", "tab", "rec_id").join(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), "nid", "left_semi")
    runs = written(run_sets(texts, wanted, run), "runs")
    links = written(verified(pairs, runs, threshold), "links")
    forget(pairs)
    more = family_links(links, runs, threshold)
    if more is not None:
        links = links.unionByName(written(more, "more"))
    return links.join(classes.select(F.col("nid").alias("a"), "tab"), "a").select("tab", "a", "b", "sim"), members


def duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All linked pairs of ids, copies included, the smaller id first: ``(tab, id_a, id_b)``."""
    one = members.select(F.col("nid").alias("a"), F.col("rec_id").alias("ia"))
    two = members.select(F.col("nid").alias("b"), F.col("rec_id").alias("ib"))
    across = links.select("tab", "a", "b").join(one, "a").join(two, "b").select("tab", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    shared = members.groupBy("nid").count().where("count > 1").select("nid")
    copies = members.join(shared, "nid", "left_semi")
    same = copies.select("tab", "nid", F.col("rec_id").alias("id_a")).join(copies.select("nid", F.col("rec_id").alias("id_b")), "nid").where("id_a < id_b")
    return across.unionByName(same.select("tab", "id_a", "id_b"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable class of each class, ``(nid, root)``, by hooking and jumping.

    Each round hands the smallest root among a node's neighbours to the node and to the node's root,
    and then points every node at its root's root, so that the rounds grow with the logarithm of a
    component's width.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = written(nodes.select("nid", F.col("nid").alias("root")), "roots")
    while True:
        ends = edges.join(state.toDF("b", "rb"), "b").join(state.toDF("a", "ra"), "a").where("rb < ra")
        near = ends.select(F.explode(F.array("a", "ra")).alias("nid"), "rb").groupBy("nid").agg(F.min("rb").alias("seen"))
        step = state.join(near, "nid", "left").select("nid", "root", F.least("root", F.coalesce("seen", "root")).alias("to"))
        jump = step.select(F.col("nid").alias("to"), F.col("to").alias("further"))
        new = written(step.join(jump, "to", "left").select("nid", "root", F.least("to", F.coalesce("further", "to")).alias("new")), "roots")
        changed = not new.where("new <> root").isEmpty()
        forget(state)
        state = new.select("nid", F.col("new").alias("root"))
        if not changed:
            forget(edges)
            break
    return state


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``(tab, rec_id, class_id, group_id, links)``.

    ``class_id`` and ``group_id`` are the smallest ids of the copies and of the whole group; ``links``
    counts the other classes that this one resembles.
    """
    heads = members.groupBy("tab", "nid").agg(F.min("rec_id").alias("class_id"))
    roots = components(links, heads.select("nid"))
    degree = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("links"))
    of_root = heads.join(roots, "nid").groupBy("root").agg(F.min("class_id").alias("group_id"))
    per_class = heads.join(roots, "nid").join(of_root, "root").join(degree, "nid", "left").select("nid", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(per_class, "nid").select("tab", "rec_id", "class_id", "group_id", "links")
