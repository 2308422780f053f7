"""Evaluation passages inside a training corpus, by q-gram lemma filtering and banded alignment.

The test items are a small stated query set; every document is read whole, once.  Texts are folded
to letters and digits (case, marks, look-alikes, punctuation, bracketed reference numbers
removed), and the items' character q-grams form an index.

1. Each shared q-gram lies on a diagonal (place in the document minus place in the item).  Shared
   q-grams are counted in overlapping bands of diagonals, as wide as the words that half an item may gain or lose
   within the edit budget.
2. By the q-gram lemma a passage of m characters with e edited words keeps at least
   m - q + 1 - e * (word length + q - 1) of its q-grams; a band with fewer cannot hold half
   an item within the edit budget and is dropped.
3. Every band that is left is verified, the fullest first, by a local alignment of words in a band around its diagonals that
   grows with the item's edit budget.

The index is broadcast in blocks of at most ``block_items`` items and ``block_chars`` characters, so its
size is bounded however large the test set is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Q = 8
#: Least width of a band of diagonals, in letters, and of the alignment on each side, in words.
BAND = 64
WIDTH = 24
#: Share of a passage's words that may have been changed.
EDITED = 0.25
HELD = 0.5
#: Least share of equal words inside the aligned passage.
DENSITY = 0.7
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000
BATCH_CHARS = 4_000_000

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = dict(zip("асеорхуікһԁԛѕјьвнмтгαοιντεκρυχβηζμ", "aceopxyikhdqsjbbhmtraoivtekpuxbnzm"))


def _fold_table() -> np.ndarray:
    """For each code point of the first plane: 0 nothing, 1 gap, 2.. a letter or digit."""
    t = np.ones(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me", "Cf") or ch == "￼":
            t[c] = 0
            continue
        low = ch.lower()[:1]
        low = LOOKALIKES.get(low, low)
        base = unicodedata.normalize("NFKD", low)[:1]
        base = LOOKALIKES.get(base.lower(), base.lower())
        if "a" <= base <= "z":
            t[c] = 2 + ord(base) - 97
        elif "0" <= base <= "9":
            t[c] = 28 + ord(base) - 48
        elif kind[0] in "LN":
            t[c] = 38 + c % 20
    return t


FOLD = _fold_table()
INSERTED = re.compile(r"\[\d{1,3}\]|\(\d{1,3}\)|(?<=\w)[*_~^]+(?=\w)|(?<=\d)[.,:](?=\d)|['’](?=\w)")


def folded(text: str) -> np.ndarray:
    """Codes of a text with the gaps in."""
    codes = np.frombuffer(INSERTED.sub(lambda m: " " if m[0][0] in "[(" else "", text).encode("utf-32-le", "replace"), np.uint32)
    return FOLD[np.where(codes < 0x10000, codes, 32)]


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and its first place in the string without gaps."""
    c = codes[codes > 0]
    letter = c > 1
    solid = c[letter].astype(np.uint64)
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = letter & ~np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(first[letter])
    # a polynomial hash of each word from prefix sums, modulo 2^64
    sizes = np.diff(np.append(at, len(solid)))
    inside = np.arange(len(solid)) - np.repeat(at, sizes)
    power = np.cumprod(np.full(max(int(sizes.max()), 1), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    h = np.add.reduceat(solid * power[inside], at)
    return h, at


class Index:
    """q-grams of a block of items, sorted, with the bits of a prefilter."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edited: float = EDITED):
        grams, owner, place = [], [], []
        self.ids, self.words, self.least, self.band, self.width = [], [], [], [], []
        for k, (i, text) in enumerate(items):
            codes = folded(text)
            h, at = words_of(codes)
            solid = codes[codes > 1]
            g = qgrams(solid, q)
            grams.append(g)
            owner.append(np.full(len(g), k, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
            self.ids.append(i)
            self.words.append((h, at))
            half = len(solid) * HELD
            size = len(solid) / max(len(h), 1)
            lemma = half - q + 1 - edited * HELD * len(h) * (size + q - 1)
            self.least.append(max(4, int(lemma)))
            # half an item may drift by its budget of words either way; bands overlap by half, so they are twice as wide
            self.band.append(max(BAND, 2 * int(np.ceil(edited * HELD * len(h) * size))))
            self.width.append(max(WIDTH, int(np.ceil(edited * len(h) + self.band[-1] / max(size, 1)))))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.gram, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.least = np.array(self.least, np.int64)
        self.band = np.array(self.band, np.int64)
        #: No diagonal lies further before the text.
        self.longest = int(self.place.max(initial=0))
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[slot(self.gram)] = True


def qgrams(solid: np.ndarray, q: int = Q) -> np.ndarray:
    """Each q successive codes as one number (six bits a code)."""
    n = len(solid) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(q):
        g = (g << np.uint64(6)) | solid[k : k + n].astype(np.uint64)
    return g


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - Index.BITS)).astype(np.int64)


def regions(solid: np.ndarray, text_at: np.ndarray, index: Index) -> dict[tuple[int, int], list[int]]:
    """Middle diagonals of the bands of each (text, item) that meet the bound, the fullest first; ``text_at``: first place of each text."""
    g = qgrams(solid)
    p = np.flatnonzero(index.bits[slot(g)])
    k = np.searchsorted(index.gram, g[p])
    ok = (k < len(index.gram)) & (index.gram[np.minimum(k, len(index.gram) - 1)] == g[p]) if len(index.gram) else np.zeros(len(p), bool)
    p, k = p[ok], k[ok]
    doc = np.searchsorted(text_at, p, side="right") - 1
    inside = p + Q <= np.append(text_at, len(solid))[doc + 1]
    p, k, doc = p[inside], k[inside], doc[inside]
    if not len(p):
        return {}
    n = index.first[k + 1] - index.first[k]
    rep = np.repeat(np.arange(len(p)), n)
    e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + index.first[k][rep]
    item = index.owner[e].astype(np.int64)
    diag = (p[rep] - text_at[doc[rep]]) - index.place[e] + index.longest
    band = index.band[item]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for half in (0, 1):
        b = (diag + half * (band // 2)) // band
        rows = np.stack([doc[rep], item, b])
        order = np.lexsort(rows[::-1])
        rows = rows[:, order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)]))
        c = np.diff(np.append(first, rows.shape[1]))
        good = c >= index.least[rows[1, first]]
        for d, i, x, m in zip(*rows[:, first[good]].tolist(), c[good].tolist()):
            w = int(index.band[i])
            found.setdefault((d, i), []).append((-m, x * w - half * (w // 2) + w // 2 - index.longest))
    return {key: [mid for _, mid in sorted(bands)] for key, bands in found.items()}


_SCORE, _SAME, _SPAN = np.int64(1) << np.int64(40), np.int64(1) << np.int64(20), np.int64(1)


def align(item: np.ndarray, part: np.ndarray, width: int = WIDTH) -> tuple[int, int]:
    """(equal words, item words spanned) of the best local alignment; equal 1, other -1, gap -1.

    ``part`` is the document's words around the region; only cells within ``width`` words of the diagonal that
    starts at word ``width`` are filled, a row at a time.  A cell holds score, equal words and span in one number.
    """
    if max(len(item), len(part)) >= 1 << 20:
        raise ValueError("an item of a million words is no test item")
    cells = 2 * width + 1
    rise = np.arange(cells, dtype=np.int64) * _SCORE
    padded = np.concatenate([part, np.zeros(max(0, len(item) + cells - len(part)), np.uint64)])
    prev, best = np.zeros(cells, np.int64), np.int64(0)
    for i in range(len(item)):
        # cell k stands for word i + k of the part; the word above it is cell k + 1 of the row before
        now = prev + np.where(padded[i : i + cells] == item[i], _SCORE + _SAME + _SPAN, _SPAN - _SCORE)
        now[:-1] = np.maximum(now[:-1], prev[1:] + (_SPAN - _SCORE))
        now = np.maximum.accumulate(now + rise) - rise
        prev = np.where(now >= _SCORE, now, 0)
        best = max(best, prev.max())
    return int(best >> np.int64(20)) & 0xFFFFF, int(best) & 0xFFFFF


def find_in(texts: list[str], index: Index) -> list[tuple[int, int]]:
    """(text number, item id) of every leak."""
    codes = [folded(t) for t in texts]
    solids = [c[c > 1] for c in codes]
    at = np.concatenate([[0], np.cumsum([len(s) for s in solids])])[:-1].astype(np.int64)
    found, parsed = [], {}
    for (d, i), mids in sorted(regions(np.concatenate(solids) if solids else np.zeros(0, np.uint8), at, index).items()):
        if d not in parsed:
            parsed = {d: words_of(codes[d])}
        h, pos = parsed[d]
        item, width = index.words[i][0], index.width[i]
        for mid in mids:
            # the item's word that the text begins in, if the diagonal lies before the text
            missing = int(np.searchsorted(index.words[i][1], -mid)) if mid < 0 else 0
            first = int(np.searchsorted(pos, mid)) - missing
            part = h[max(0, first - width) : max(0, first + len(item) + width + 1)]
            if first < width:  # keep the diagonal where it is
                part = np.concatenate([np.zeros(width - first, np.uint64), part])
            same, span = align(item, part, width)
            if same >= HELD * len(item) and same >= DENSITY * span:
                found.append((d, index.ids[i]))
                break
    return found


def leaked(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id)`` of the documents of ``docs(doc_id, text)`` that hold at least half of an item.

    Null and blank texts hold nothing and are held nowhere; a repeated row counts once; texts of any
    length are read whole (in batches by characters); an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator()
    result, block, chars = None, [], 0

    def scan_for(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        made: list[Index] = []

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not made:
                made.append(Index(shared.value))
            for f in frames:
                ids, texts = f["doc_id"].to_numpy(), f["text"].tolist()
                lo, out = 0, []
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_CHARS):
                        size += len(texts[hi])
                        hi += 1
                    out += [(ids[lo + d], i) for d, i in find_in(texts[lo:hi], made[0])]
                    lo = hi
                yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        return docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(scan, "doc_id long, item_id long")

    for r in rows:
        if block and (len(block) >= block_items or chars + len(r.text) > block_chars):
            part = scan_for(block)
            result, block, chars = (part if result is None else result.unionByName(part)), [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    part = scan_for(block)
    return (part if result is None else result.unionByName(part)).distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items by the number of documents they leaked into, those without a leak included."""
    n = leaked(docs, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "kind").join(n, "item_id", "left").select("item_id", "kind", F.coalesce("documents", F.lit(0)).alias("documents"))
