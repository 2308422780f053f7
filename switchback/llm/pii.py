"""Personal information in free text.

Terms are the words of names and, as a whole each, the numbers and addresses of a fixed shape (e-mail, phone, identity
number, street address).  What is replaced is decided the way an information-theoretic sanitiser finds disclosive terms:

1. a first pass over *all* texts counts which capitalised terms stand next to each other, which terms occur inside e-mail
   addresses - terms that are certain to reveal a person -, how often each word is written in lower case (in texts that
   use capitals at all: others say nothing of it), and which capitalised pair stands nearest to each shaped term;
2. the disclosure of a word is the probability that its neighbour is a protected term, given the
   word - i.e. how strongly seeing it reveals an entity; its value in bits is the
   pointwise mutual information with the protected class.  Given names and surnames are the
   words above the threshold on their side of the pair, taken in turn until no word is added;
   words known from addresses alone are weighed by the share of their uses that lie in addresses;
3. the disclosure of a shaped term is the largest share that one entity has of its occurrences.  A term that stands beside
   many different ones, none of which has that share (the number of an office), reveals nobody and is left;
4. a second pass replaces shaped terms and each run of protected words (in any case or order, with initials).

The protected vocabulary is broadcast only while it has at most ``max_terms`` entries; beyond
that the second pass emits the name-shaped pairs that a bitmap of fixed size lets through, and the
vocabulary is joined to them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

MAX_TERMS = 500_000
#: A term is protected from this share of protected neighbours on.
MIN_DISCLOSURE = 0.5
#: The seeds are few, so in the first round a given name needs only this share of neighbours among them.
SEED_DISCLOSURE = 0.02
#: A word of names is written with a capital, beside another, in at least this share of its uses (names, too, are written small at times).
CAPITALISED = 0.25
#: A shaped term reveals an entity if it has this share of the term's occurrences.
MIN_SHAPED = 0.1
FLUSH = 200_000

INVISIBLE = re.compile("[̀-ͯ​-‏­⁠﻿]")
CAP = "[A-ZÀ-ÖØ-ÞĀ-ž]"
WORD = r"[^\W\d_](?:[\w'’]|-(?=[^\W\d_]))*"
TITLE = rf"(?:(?={CAP}){WORD})"
PAIR = re.compile(rf"\b({TITLE})(?=\s+({TITLE}))")
WORDS = re.compile(rf"(?<![\w'’-]){WORD}")

# fixed values: separators and spoken forms of e-mail addresses
DOT = r"(?:\s*[\(\[{]\s*dot\s*[\)\]}]\s*|\s+dot\s+|\.)"
AT = r"(?:\s*[\(\[{]\s*at\s*[\)\]}]\s*|\s+at\s+|\s?@\s?)"
JOIN = r"(?:\s+(?:dot|underscore|dash|hyphen|plus)\s+|\s*[\(\[{]\s*dot\s*[\)\]}]\s*)"
EMAIL_PLAIN = re.compile(r"(?<![\w.+-])[\w.+-]+\s?@\s?[\w-]+(?:\.[\w-]+)+", re.I)
EMAIL_SPOKEN = re.compile(rf"(?<![\w.+-])(?:[\w.+-]+{JOIN})*[\w.+-]+{AT}[\w-]+(?:{DOT}[\w-]+)+", re.I)
SPOKEN_HINT = re.compile(r"[\(\[{ ]dot[\)\]} ]|[\(\[{]\s*at\s*[\)\]}]", re.I)

NUMBER_RUN = re.compile(r"\d(?:[\s().–—/-]{0,5}\d){6,}")
SEP = r"\s{0,2}[.\-–—/]?\s{0,2}"
PHONE = re.compile(
    rf"(?<![\w.#/–—-])(?<!\d )(?:"
    rf"\+\d{{1,3}}{SEP}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:{SEP}\d{{2,4}}){{2,4}}"
    rf"|\+\d{{10,14}}"
    rf"|(?:1{SEP})?(?:\([2-9]\d\d\)|[2-9]\d\d){SEP}[2-9]\d\d{SEP}\d{{4}}"
    rf"|0\d{{2,4}}{SEP}\d{{3,4}}{SEP}\d{{3,4}}"
    rf")(?![\w–—]|-\w|\.\d)"
)
DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
SPOKEN_DIGITS = re.compile(rf"\b(?:plus\s+)?{DIGIT_WORD}(?:[\s,-]+(?:double\s+|triple\s+)?{DIGIT_WORD})+\b", re.I)
DIGITS = frozenset("zero oh one two three four five six seven eight nine".split())

# fixed values: street words
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Court|Ct|Close|Way|Parkway|Pkwy|Drive|Dr|Place|Pl|Terrace|Square|Row|Crescent|Highway|Hwy|Circle"
# fixed values: units that are counted, not houses on a street
MEASURE = "hours?|minutes?|miles?|days?|feet|foot|steps?|long|weeks?|times?|people|parties|inch(?:es)?|meters?|yards?"
UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|House|No\.)\s+\w{1,5}(?:,\s*|\s+))"
ADDRESS = re.compile(
    rf"\d{{1,5}}(?:-?[A-Z])?,?\s+(?:[NSEW]\.?\s+|(?:North|South|East|West)\s+)?"
    rf"(?!(?i:{MEASURE})\b)(?:{TITLE}\s+){{1,3}}(?i:{STREET})\b(?!\s+Trail)"
)
#: What may stand before a house number: a unit, or nothing that runs on into the number.
BEFORE_NUMBER = re.compile(rf"(?<![\w.,#/-]){UNIT}\Z", re.I)
RUNS_ON = re.compile(r"[\w.,#/-]\Z")
#: An article makes it a count ("the 8 rocky drive").
ARTICLE = re.compile(r"\b(?:the|an?)\s+\Z", re.I)
_LOOSE = rf"\s+(?:[nsew]\.?\s+|north\s+|south\s+|east\s+|west\s+)?(?:old\s+|new\s+|upper\s+|lower\s+)?(?!(?:{MEASURE})\b)[^\W\d_]{{4,}}\s+(?:{STREET})\b"
#: Street addresses in any case: with a number in digits, and with one in words.
ADDRESS_LOOSE = re.compile(rf"\d{{1,5}}(?:-?[a-z])?{_LOOSE}", re.I)
ADDRESS_SPOKEN = re.compile(rf"(?<![\w.,#/-])(?:{UNIT})?{DIGIT_WORD}(?:\s+{DIGIT_WORD})*{_LOOSE}", re.I)
STREET_WORD = re.compile(rf"\b(?:{STREET})\b", re.I)
PO_BOX = re.compile(r"\bP\.?\s?O\.?\s+Box\s+(?:\d+|" + DIGIT_WORD + r")|\bpost\s+office\s+box\s+(?:\d+|" + DIGIT_WORD + ")", re.I)
SSN = re.compile(r"(?<![\w–—-])(?<![\d][ .])(?:\d{3}([ -–—.]?)\d{2}\1\d{4})(?![\w–—]|-\w|[ .]\d)")
ID_LETTERS = re.compile(
    r"(?<![\w-])(?:[A-Z]{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}[A-D]|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]\d{3}-\d{4}-\d{2}|\d[A-Z]-\d{4}-\d{3}|[A-Z]{1,2}\d{6,8})(?![\w-])",
    re.I,
)
#: Begins with a digit, so that it is tried at digits only: what every identity number with letters holds.
LETTER_HINT = re.compile(r"\d(?:[A-Za-z]-?\d{3}|\d\s{0,2}\d\d\s{0,2}\d\d|\d\d-\d{4}-\d)")
#: Numbers introduced by these words belong to things, not to persons.
THING = re.compile(r"(?:part|tracking|permit|tag|site|confirmation|order|serial|model|invoice|route|batch|item|stock|lot|gauge|bench ?mark)\W+(?:(?:number|no|code|is|was|id)\W+){0,2}$", re.I)
# fixed values: words that make a name one of a place or thing, before ("... Memorial") or as its second word ("... Street")
THING_WORDS = (
    "memorial trail trailhead hut cabin bridge footbridge shelter loop path lodge bench foundation award prize way street st road rd lane ln avenue ave drive court "
    "visitor center centre creek lake peak ridge point park house school fund cup"
).split()
NAMED_THING = re.compile(rf"\s+(?:{'|'.join(w.title() for w in THING_WORDS)}|{'|'.join(w.upper() for w in THING_WORDS)})\b")


@lru_cache(maxsize=200_000)
def term(word: str) -> str:
    """Lower case, marks and invisible signs removed: the form in which terms are counted."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c) and not INVISIBLE.match(c))


def visible(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible and combining signs, and each character's place (None: unchanged)."""
    if text.isascii() or not INVISIBLE.search(text):
        return text, None
    at = [i for i, c in enumerate(text) if not INVISIBLE.match(c)]
    return "".join(text[i] for i in at), [*at, len(text)]


class Tokens(dict):
    """What each token (between white space) holds, kept: ``1`` for each spelled digit if nothing else, else ``d`` digits and ``s`` a street word, ``b`` a box, ``0`` none of these."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        words = WORDS.findall(token.lower())
        digits = sum(w in DIGITS for w in words)
        if digits and digits == len(words):
            kind = "1" * digits
        else:
            kind = "d" * any(map(str.isdigit, token)) + "s" * (STREET_WORD.search(token) is not None) + "b" * ("box" in words)
        self[token] = kind = kind or "0"
        return kind


TOKENS = Tokens()
#: In the kinds of a text's tokens: where an address in digits or in words may be (at most seven tokens before the street word).
MAY_ADDRESS = re.compile("d.{0,8}s")
MAY_SPOKEN = re.compile("1.{0,8}s")


def spells_address(t: str) -> bool:
    """Whether an e-mail address may be spelled out."""
    low = t.lower()
    return ("dot" in low or "at)" in low or "at]" in low or "at}" in low) and SPOKEN_HINT.search(t) is not None


def shaped_spans(t: str, tokens: list[str] | None = None) -> list[tuple[int, int, str]]:
    """Mentions that have a fixed shape, as (start, end, kind), not overlapping; ``tokens``: the text split at white space."""
    found: list[tuple[int, int, str]] = []
    kinds = "".join(map(TOKENS.__getitem__, t.split() if tokens is None else tokens))

    def add(a: int, b: int, kind: str) -> None:
        if b > a and not any(a < y and x < b for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in t:
        for m in EMAIL_PLAIN.finditer(t):
            add(m.start(), m.end(), "email")
    if spells_address(t):
        for m in EMAIL_SPOKEN.finditer(t):
            add(m.start(), m.end(), "email")
    for m in PO_BOX.finditer(t) if "b" in kinds else ():
        add(m.start(), m.end(), "address")
    spoken = "111" in kinds
    for shape in (ADDRESS, ADDRESS_LOOSE) if MAY_ADDRESS.search(kinds) else ():
        for m in shape.finditer(t):
            head = t[max(0, m.start() - 24) : m.start()]
            if unit := BEFORE_NUMBER.search(head):
                add(m.start() - len(head) + unit.start(), m.end(), "address")
            elif not RUNS_ON.search(head) and not ARTICLE.search(head):
                add(m.start(), m.end(), "address")
    if MAY_SPOKEN.search(kinds):
        for m in ADDRESS_SPOKEN.finditer(t):
            add(m.start(), m.end(), "address")
    if "d" in kinds and LETTER_HINT.search(t):
        for m in ID_LETTERS.finditer(t):
            if not THING.search(t, max(0, m.start() - 40), m.start()):
                add(m.start(), m.end(), "id_number")
    runs = [(max(0, m.start() - 4), m.end() + 4) for m in NUMBER_RUN.finditer(t)] if "d" in kinds else []
    for kind, shape in (("phone", PHONE), ("id_number", SSN)) if runs else ():
        for lo, hi in runs:
            for m in shape.finditer(t, lo, hi):
                if not THING.search(t, max(0, m.start() - 40), m.start()):
                    add(m.start(), m.end(), kind)
    if spoken:
        for m in SPOKEN_DIGITS.finditer(t):
            n = len(re.findall(DIGIT_WORD, m[0], re.I))
            if n in (7, 10, 11, 12):
                add(m.start(), m.end(), "phone")
            elif n == 9:
                add(m.start(), m.end(), "id_number")
    return sorted(found)


def shaped_term(kind: str, mention: str) -> str:
    """A mention without signs and case, the form in which its occurrences are counted."""
    return f"{kind}:{''.join(c for c in mention.lower() if c.isalnum())}"


def local_terms(address: str) -> list[str]:
    local = re.split(rf"@|{AT}", address, maxsplit=1, flags=re.I)[0].split("+")[0]
    return [term(x) for x in re.split(r"[._\-\s\(\)\[\]]+|\bdot\b|\bunderscore\b", local) if len(x) > 1 and x.isalpha()]


#: Bits of a bitmap: 2 MB, whatever the corpus.
BITS = 1 << 24


def text_slot(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % BITS


EVIDENCE = "what string, a string, b string, n long, tab string, rec_id string, start_pos long, end_pos long"


def evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one task: pairs ``p``, e-mail terms ``e``, lower-case words ``l``, shaped terms with the nearest pair ``s``.

    And the places ``x`` of shaped terms; of rows without id a hash ``h`` of each text that has any.
    """
    pairs: Counter = Counter()
    inside: Counter = Counter()
    tokens: Counter = Counter()
    shaped: Counter = Counter()
    places: list[tuple] = []
    none = (None, None, None, None)

    def out() -> pd.DataFrame:
        lower: Counter = Counter()
        for x, n in tokens.items():
            if x.islower():
                for w in (x,) if x.isalpha() else WORDS.findall(x):
                    if w.isalpha() and w[0].islower():
                        lower[w] += n
        rows = [("p", term(a), term(b), n, *none) for (a, b), n in pairs.items()] + [("e", a, "", n, *none) for a, n in inside.items()]
        rows += [("l", term(a), "", n, *none) for a, n in lower.items()] + [("s", a, b, n, *none) for (a, b), n in shaped.items()] + places
        for c in (pairs, inside, tokens, shaped, places):
            c.clear()
        return pd.DataFrame(rows, columns=["what", "a", "b", "n", "tab", "rec_id", "start_pos", "end_pos"]).astype({"start_pos": "Int64", "end_pos": "Int64"})

    for frame in frames:
        for tab, i, text in zip(frame["tab"], frame["rec_id"], frame["text"]):
            if not text:
                continue
            t, at = visible(text)
            words = t.split()
            if not t.islower():
                raw = PAIR.findall(t)
                if raw:
                    pairs.update(raw)
                tokens.update(words)
            spans = shaped_spans(t, words)
            if not spans:
                continue
            near = [(m.start(), f"{term(m[1])} {term(m[2])}") for m in PAIR.finditer(t)]
            for a, b, kind in spans:
                if kind == "email":
                    inside.update(local_terms(t[a:b]))
                shape = shaped_term(kind, t[a:b])
                shaped[shape, min(near, key=lambda x: abs(x[0] - a), default=(0, ""))[1]] += 1
                if i is not None:
                    places.append(("x", shape, "", 1, tab, i, (at[a] if at else a) + 1, at[b] if at else b))
            if i is None:
                places.append(("h", "", "", 1, None, None, text_slot(text), None))
        if len(pairs) + len(tokens) + len(shaped) + len(places) > FLUSH:
            yield out()
    yield out()


def evidence_of(texts: DataFrame) -> DataFrame:
    """The evidence of all texts ``(tab, rec_id, text)``, added up and written down; places of repeated rows count once."""
    from switchback.plans.lineage import written

    found = texts.select("tab", "rec_id", "text").mapInPandas(evidence, EVIDENCE)
    return written(found.groupBy("what", "a", "b", "tab", "rec_id", "start_pos", "end_pos").agg(F.sum("n").alias("n")), "evidence")


def public_terms(counts: DataFrame, min_shaped: float = MIN_SHAPED) -> DataFrame:
    """Shaped terms ``(term, side, disclosure, bits)`` that reveal nobody; side is ``public``.

    An occurrence without an entity nearby may be of any: each counts as one of its own.
    """
    n = F.col("n")
    by = counts.where("what = 's'").groupBy("a").agg(F.sum(n).alias("all"), F.max(F.when(F.col("b") == "", 1).otherwise(n)).alias("most"))
    share = F.col("most") / F.col("all")
    return by.where(share < min_shaped).select(F.col("a").alias("term"), F.lit("public").alias("side"), share.alias("disclosure"), F.log2(share).alias("bits"))


def protected_terms(counts: DataFrame, min_disclosure: float = MIN_DISCLOSURE) -> DataFrame:
    """Vocabulary ``(term, side, disclosure, bits)``; side is ``given``, ``surname`` or, of shaped terms that are left, ``public``.

    Everything after the first pass works on counts by term, aggregated before the shuffle.
    """
    from switchback.plans.lineage import forget, written

    pairs = counts.where("what = 'p'").select("a", "b", "n")
    inside = counts.where("what = 'e'").select(F.col("a").alias("term"), "n")
    # lower-case uses outside addresses: what an address holds is counted there already
    signed = F.when(F.col("what") == "l", F.col("n")).otherwise(-F.col("n"))
    lower = counts.where("what in ('l', 'e')").groupBy(F.col("a").alias("term")).agg(F.sum(signed).alias("n_lower"))
    things = F.col("term").isin(*THING_WORDS)

    def side(own: str, other: str, anchors: DataFrame, least: float) -> DataFrame:
        hit = anchors.select(F.col("term").alias(other), F.lit(1).alias("hit"))
        seen = pairs.join(hit, other, "left").groupBy(F.col(own).alias("term")).agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_hit")
        )
        return (
            seen.join(lower, "term", "left")
            .where(f"n_hit > 0 and length(term) > 1 and n >= {CAPITALISED} * (n + greatest(coalesce(n_lower, 0), 0))")
            .withColumn("disclosure", F.col("n_hit") / F.col("n"))
            .where(F.col("disclosure") >= least)
            .select("term", "n", "n_hit", "disclosure")
        )

    # each round asks more words, never fewer, so the rounds end
    given, surname, known = side("a", "b", inside, SEED_DISCLOSURE), None, -1
    while True:
        surname = written(side("b", "a", given, min_disclosure).where(~things), "surnames")
        more = side("a", "b", surname, min_disclosure)
        if known >= 0:
            more = more.unionByName(given.join(more, "term", "left_anti"))
        last, given = given, written(more, "given")
        n = given.count()
        if known >= 0:
            forget(last)
        if n == known:
            break
        known = n
    # words of addresses that stand on neither side of a pair: the share of their uses that lie in addresses
    uses = pairs.select(F.explode(F.array("a", "b")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n_pairs"))
    named = inside.where("n > 1").join(given, "term", "left_anti").join(surname, "term", "left_anti").join(lower, "term", "left").join(uses, "term", "left")
    rest = F.coalesce("n_pairs", F.lit(0)) + F.greatest(F.coalesce("n_lower", F.lit(0)), F.lit(0))
    # a single use as an ordinary word tells more than many in addresses
    named = named.where(~things & (F.coalesce("n_lower", F.lit(0)) <= 0)).withColumn("disclosure", F.col("n") / (F.col("n") + rest)).where(F.col("disclosure") >= min_disclosure)
    surname = surname.unionByName(named.select("term", (F.col("n") + rest).alias("n"), F.col("n").alias("n_hit"), "disclosure"))
    # a term seen on both sides belongs to the side where it is seen more
    both = given.withColumn("side", F.lit("given")).unionByName(surname.withColumn("side", F.lit("surname")))
    total = pairs.agg(F.sum("n").alias("all"))
    base = both.agg(F.sum("n").alias("named"))
    best = both.groupBy("term").agg(F.max_by(F.struct("side", "n", "disclosure"), F.struct("n_hit", "side")).alias("x")).select("term", "x.*")
    words = best.join(F.broadcast(total), how="cross").join(F.broadcast(base), how="cross").select(
        "term", "side", "disclosure", F.log2(F.col("disclosure") * F.col("all") / F.col("named")).alias("bits")
    )
    return words.unionByName(public_terms(counts))


SHAPES = [
    # (pattern, what the first and second group must be)
    (re.compile(rf"(?<![\w'’-])({WORD})(?=\s+(?:>\s*)?(?:[^\W\d_]\.?\s+|[^\W\d_]\.\s*)?({WORD}))"), "given", "surname"),
    (re.compile(rf"(?<![\w'’-])({WORD})(?=\s*,\s+({WORD}))"), "surname", "given"),
    (re.compile(rf"(?<![\w'’-])({WORD})(?=\s+(?:>\s*)?({WORD}))"), "surname", "given"),
    (re.compile(rf"(?<![\w'’.-])(?=([^\W\d_])\.\s*(?:[^\W\d_]\.\s*)?({WORD}))"), "", "surname"),
    (re.compile(rf"(?<![\w'’-])({WORD})(?=,\s+({CAP})\.)"), "surname", ""),
]


def bare(word: str) -> str:
    """The term of a word without a possessive ending."""
    return term(word[:-2] if word[-2:] in ("'s", "’s") else word)


def bitmap_of(slots: DataFrame) -> np.ndarray:
    """One bit for each number of ``slots(h)``, 0 to ``BITS`` - 1, put together by Spark's bitmap aggregate."""
    rows = slots.select((F.col("h") + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in rows:
        lo = (r.bucket - 1) * 32_768
        out[lo : lo + 32_768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    return out


class Likely(dict):
    """Whether a word's term, or its last part, may be in the vocabulary; kept by word."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        forms = (bare(word), bare(word.rpartition("-")[2])) if "-" in word else (bare(word),)
        self[word] = found = tuple(f for f in dict.fromkeys(forms) if self.bits[xxhash.xxh64_intdigest(f.encode(), seed=42) % BITS])
        return found


#: Of each shape, the group that is the surname and the rank of its reading: a surname takes the first that fits, as in _name_spans.
READINGS = [(2, 0), (1, 1), (1, 1), (2, 2), (1, 3)]


def _candidates(t: str, likely: Likely) -> list[tuple[int, int, str, str, str, str, int, int, bool]]:
    """Name-shaped pairs as (start, end, term, its side, other term, its side, place of the surname, rank, whether it is no mention after all), a row for each form of a hyphenated word."""
    out = []
    for k, (pattern, s1, s2) in enumerate(SHAPES):
        surname, rank = READINGS[k]
        for m in pattern.finditer(t):
            one, two = (likely[m[1]] if s1 else ("",)), (likely[m[2]] if s2 else ("",))
            if one and two:
                start, end = m.start(1), m.end(2) + (k == 4)
                void = NAMED_THING.match(t, end) is not None
                end = without_possessive(t, end)
                out += [(start, end, a, s1, b, s2, m.start(surname), rank, void) for a in one for b in two]
    return out


def _chosen(readings: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, str]]:
    """Names among the readings (surname's place, rank, start, end, void) of one text: one a surname, then from left to right."""
    best: dict[int, tuple[int, int, int, int, bool]] = {}
    for x in sorted(readings):
        best.setdefault(x[0], x)
    return _first_cover([(start, end, "name") for _, _, start, end, void in best.values() if not void])


def _first_cover(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans kept from left to right, the earlier and longer first."""
    kept, last = [], -1
    for a, b, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= last:
            kept.append((a, b, kind))
            last = b
    return kept


def spans_of(text: str, sides: Sides, shaped: bool = True) -> list[tuple[int, int, str]]:
    """All mentions of a text with places in the text as given (0-based, end exclusive); ``shaped``: whether it may hold shaped terms."""
    t, at = visible(text)
    words = t.split()
    found = shaped_spans(t, words) if shaped else []
    names = [(start, end, "name") for _, start, end in _name_spans(t, sides, words) if not any(start < y and x < end for x, y, _ in found)]
    spans = sorted([x for x in found if shaped_term(x[2], t[x[0] : x[1]]) not in sides.vocabulary] + _first_cover(names))
    return spans if at is None else [(at[a], at[b], kind) for a, b, kind in spans]


class Sides(dict):
    """The side of each word as written; of a hyphenated one that is not in the vocabulary, of its last part."""

    def __init__(self, vocabulary: dict[str, str]):
        super().__init__()
        self.vocabulary = vocabulary
        self.surnames = Surnames(self)

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        known = self.vocabulary
        self[word] = own = known.get(bare(word)) or (known.get(bare(word.rpartition("-")[2])) if "-" in word else None) or ""
        return own


class Surnames(dict):
    """The words of each token that are surnames."""

    def __init__(self, sides: Sides):
        super().__init__()
        self.sides = sides

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        self[token] = found = tuple(w for w in WORDS.findall(token) if self.sides[w] == "surname")
        return found


GAP_PAIR = re.compile(r"\s+(?:>\s*)?(?:[^\W\d_]\.?\s+|[^\W\d_]\.\s*)?\Z")
GAP_COMMA = re.compile(r"\s*,\s+\Z")
INITIAL_BEFORE = re.compile(r"(?<![\w'’.-])[^\W\d_]\.\s*(?:[^\W\d_]\.\s*)?\Z")
INITIAL_AFTER = re.compile(rf",\s+{CAP}\.")


GOES_ON = re.compile(r"[\w'’]|-[^\W\d_]")


def without_possessive(t: str, end: int) -> int:
    """The end of a name without a possessive ending."""
    return end - 2 if t[end - 2 : end] in ("'s", "’s") else end


def _occurrences(t: str, words: set[str]) -> list[tuple[int, int, str]]:
    """Places of whole words, in order."""
    out = []
    for w in words:
        at = t.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and (t[at - 1].isalnum() or t[at - 1] in "_'’-")) and not GOES_ON.match(t, end):
                out.append((at, end, w))
            at = t.find(w, end)
    return sorted(out)


def _name_spans(t: str, sides: Sides, tokens: list[str]) -> list[tuple[int, int, int]]:
    """Names (place of the surname, start, end) by looking only around surnames of the vocabulary; same rules as SHAPES."""
    known = sides.surnames
    hits = {w for x in set(tokens) for w in known[x]}
    if not hits:
        return []
    out = []
    for a, b, w in _occurrences(t, hits):
        # only the words around: two before, one after
        places = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(t, max(0, a - 80), min(len(t), b + 50))]
        i = next((k for k, x in enumerate(places) if x[0] == a), None)
        if i is None:
            continue
        start = end = None
        for j in (i - 1, i - 2):
            if j >= 0 and sides[places[j][2]] == "given" and GAP_PAIR.match(t, places[j][1], a):
                start, end = places[j][0], b
                break
        if start is None and i + 1 < len(places) and sides[places[i + 1][2]] == "given":
            c, d, _ = places[i + 1]
            if GAP_COMMA.match(t, b, c) or GAP_PAIR.match(t, b, c):
                start, end = a, d
        if start is None:
            head = t[max(0, a - 40) : a]
            if m := INITIAL_BEFORE.search(head):
                start, end = a - len(head) + m.start(), b
            elif m := INITIAL_AFTER.match(t, b):
                start, end = a, m.end()
        if start is not None and not NAMED_THING.match(t, end):
            out.append((a, start, without_possessive(t, end)))
    return out


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each mention replaced by ``[KIND]``; everything else as it was."""
    if text is None:
        return None
    parts, last = [], 0
    for a, b, kind in spans:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


MENTION = "tab string, rec_id string, kind string, start_pos long, end_pos long"


def shared_sides(vocabulary: DataFrame, max_terms: int = MAX_TERMS):
    """The vocabulary as a broadcast, if its size allows one."""
    if vocabulary.count() > max_terms:
        return None
    return vocabulary.sparkSession.sparkContext.broadcast({r.term: r.side for r in vocabulary.select("term", "side").toLocalIterator()})


def find_mentions(texts: DataFrame, max_terms: int = MAX_TERMS, min_disclosure: float = MIN_DISCLOSURE) -> DataFrame:
    """Mentions ``(tab, rec_id, kind, start_pos, end_pos)`` in ``texts(tab, rec_id, text)``.

    Null, empty and blank texts have none, nor have rows without id; repeated rows of one id yield each
    mention once; other columns of the input are ignored; an empty table gives an empty result.  Positions
    count code points from 1, ``end_pos`` is the last one.  A text of any length is scanned whole.
    """
    from switchback.plans.lineage import written

    counts = evidence_of(texts)
    vocabulary = written(protected_terms(counts, min_disclosure), "vocabulary")
    sides = shared_sides(vocabulary, max_terms)
    rows = texts.select("tab", "rec_id", "text").where("text is not null and rec_id is not null")
    named = joined_readings(rows, vocabulary) if sides is None else scanned_readings(rows, sides)
    shaped = counts.where("what = 'x'").select("tab", "rec_id", F.substring_index("a", ":", 1).alias("kind"), "start_pos", "end_pos", F.col("a").alias("term"))
    left = shaped.join(vocabulary.where("side = 'public'").select("term"), "term", "left_anti")
    return left.select("tab", "rec_id", "kind", "start_pos", "end_pos").unionByName(chosen_names(named, shaped))


READING = "tab string, rec_id string, surname_at long, rank int, start_pos long, end_pos long, void boolean"


def scanned_readings(rows: DataFrame, sides) -> DataFrame:
    """Readings of names with a broadcast vocabulary: one of each surname."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Sides(sides.value)
        for f in frames:
            out = []
            for tab, i, text in zip(f["tab"], f["rec_id"], f["text"]):
                t, at = visible(text)
                for place, a, b in _name_spans(t, known, t.split()):
                    out.append((tab, i, place, 0, (at[a] if at else a) + 1, at[b] if at else b, False))
            yield pd.DataFrame(out, columns=["tab", "rec_id", "surname_at", "rank", "start_pos", "end_pos", "void"])

    return rows.mapInPandas(scan, READING)


def joined_readings(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Readings of names with a vocabulary of any size: name-shaped pairs that a bitmap of fixed size lets through are joined with it."""
    slots = vocabulary.select(F.pmod(F.xxhash64("term"), F.lit(BITS)).alias("h"))
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap_of(slots)))

    def shaped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likely = Likely(np.unpackbits(bits.value).view(bool))
        for f in frames:
            out = []
            for tab, i, text in zip(f["tab"], f["rec_id"], f["text"]):
                t, at = visible(text)
                place = at or range(len(t) + 1)
                out += [(tab, i, k1, s1, k2, s2, at_surname, rank, place[a] + 1, place[b], void) for a, b, k1, s1, k2, s2, at_surname, rank, void in _candidates(t, likely)]
            yield pd.DataFrame(out, columns=["tab", "rec_id", "k1", "s1", "k2", "s2", "surname_at", "rank", "start_pos", "end_pos", "void"])

    wide = rows.mapInPandas(shaped, READING + ", k1 string, s1 string, k2 string, s2 string")
    v = vocabulary.select("term", "side")
    one, two = v.toDF("k1", "s1").withColumn("ok1", F.lit(True)), v.toDF("k2", "s2").withColumn("ok2", F.lit(True))
    return wide.join(one, ["k1", "s1"], "left").join(two, ["k2", "s2"], "left").where("(s1 = '' or ok1) and (s2 = '' or ok2)")


def chosen_names(named: DataFrame, shaped: DataFrame) -> DataFrame:
    """Names among the readings of each text: one of each surname, none that overlaps a shaped term, then from left to right."""

    def kept(readings, spans):
        out = []
        for x, fixed in zip(readings, spans):
            fixed = [] if fixed is None else [(s["start_pos"], s["end_pos"] + 1) for s in fixed]
            said = [(r["surname_at"], r["rank"], r["start_pos"], r["end_pos"] + 1, r["void"] or any(r["start_pos"] < y and z <= r["end_pos"] for z, y in fixed)) for r in x]
            out.append([{"start_pos": a, "end_pos": b - 1} for a, b, _ in _chosen(said)])
        return pd.Series(out, dtype=object)

    kept.__annotations__ = {"readings": pd.Series, "spans": pd.Series, "return": pd.Series}
    resolve = F.pandas_udf(kept, "array<struct<start_pos:long,end_pos:long>>")
    texts = named.groupBy("tab", "rec_id").agg(F.collect_set(F.struct("surname_at", "rank", "start_pos", "end_pos", "void")).alias("readings"))
    beside = shaped.groupBy("tab", "rec_id").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("spans"))
    both = texts.join(beside, ["tab", "rec_id"], "left")
    return both.select("tab", "rec_id", F.lit("name").alias("kind"), F.explode(resolve("readings", "spans")).alias("x")).select("tab", "rec_id", "kind", "x.*")


def redact(texts: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """``texts`` with ``clean_text``: each mention replaced by a placeholder of its kind.

    Rows keep their count, order of columns and values, with or without id; a null text stays null.  An input column of the
    name ``clean_text`` is replaced.
    """
    from switchback.plans.lineage import written

    texts = texts.drop("clean_text")
    sides = None
    if max_terms > 0:
        counts = evidence_of(texts.select("text", F.lit("").alias("tab"), F.lit(None).cast("string").alias("rec_id")))
        sides = shared_sides(written(protected_terms(counts), "vocabulary"), max_terms)
    if sides is not None:
        # shapes are looked for again only in texts of which the first pass found some (and in those that share their bit)
        bits = texts.sparkSession.sparkContext.broadcast(np.packbits(bitmap_of(counts.where("what = 'h'").select(F.col("start_pos").alias("h")))))

        def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, some = Sides(sides.value), np.unpackbits(bits.value).view(bool)
            for text in parts:
                yield pd.Series([t if t is None else redacted(t, spans_of(t, known, some[text_slot(t)])) for t in text], dtype=object)

        clean.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return texts.withColumn("clean_text", F.pandas_udf(clean, "string")("text"))

    rows = written(texts.withColumn("_row", F.monotonically_increasing_id().cast("string")), "rows")
    found = find_mentions(rows.select(F.lit("").alias("tab"), F.col("_row").alias("rec_id"), "text"), 0)
    spans = found.groupBy(F.col("rec_id").alias("_row")).agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos", "kind"))).alias("_spans"))

    def fill(spans: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([
            redacted(t, [(s["start_pos"] - 1, s["end_pos"], s["kind"]) for s in (x if x is not None else [])]) for x, t in zip(spans, text)
        ], dtype=object)

    return rows.join(spans, "_row", "left").withColumn("clean_text", F.pandas_udf(fill, "string")("_spans", "text")).drop("_spans", "_row")
