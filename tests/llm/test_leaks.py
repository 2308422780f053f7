import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.llm import leaks as L

RNG = random.Random(3)
LEXICON = ["".join(RNG.choice("bcdfglmnprstv") + RNG.choice("aeiou") for _ in range(RNG.randrange(2, 5))) for _ in range(3000)]


def text(n):
    return [RNG.choice(LEXICON) for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    items = [(i, text(RNG.randrange(30, 75))) for i in range(30)]
    docs, want = [], set()

    def add(words, leaked=None):
        docs.append((len(docs), words if isinstance(words, str) else " ".join(words)))
        if leaked is not None:
            want.add((docs[-1][0], leaked))

    for i, w in items:
        n = len(w)
        add(text(80) + w + text(50), i)
        add(text(80) + w[: int(n * 0.6)] + text(50), i)
        add(text(10) + w[n // 3 :], i)
        add(text(80) + w[: int(n * 0.35)] + text(50))
        shuffled = w[:]
        RNG.shuffle(shuffled)
        add(text(40) + shuffled + text(40))
        changed = [RNG.choice(LEXICON) if k % 8 == 4 else x for k, x in enumerate(w)]
        add(text(200) + changed + text(20), i)
        add("; ".join(text(30)) + " " + ",\n> ".join(x.upper() for x in w) + "!", i)
        add(" ".join(text(30) + [x.replace("a", "а").replace("e", "é") for x in w]), i)
        add(unicodedata.normalize("NFD", " ".join(text(9) + ["​".join(x) + (" [3]" if k % 9 == 0 else "") for k, x in enumerate(w)])), i)
        add(text(200))
    return [(i, "passage", " ".join(w)) for i, w in items], docs, want


def test_against_planted_cases(spark, case):
    items, docs, want = case
    rows = [*docs, docs[0], (9001, None), (9002, ""), (9003, " \n"), (None, docs[0][1]), (9004, "lorem " * 100_000 + items[0][2])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([*items, items[0], (500, "passage", None), (501, "passage", "")], "item_id long, kind string, text string")
    got = {tuple(r) for r in L.leaked(d, i).collect()}
    assert got == want | {(9004, 0)}
    # in blocks the result is the same
    assert {tuple(r) for r in L.leaked(d, i, block_items=7).collect()} == got
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0
    report = {r.item_id: r.documents for r in L.leak_report(d, i.dropDuplicates(["item_id"])).collect()}
    assert report[500] == 0 and report[0] == 8


def test_fold():
    words = lambda t: L.words_of(L.folded(t))[0].tolist()
    assert words("Café, 1,234 don't") == words("cafe 1234 dont")
    assert words("a[12] b") == words("a b") and words("") == []


@pytest.mark.parametrize("held", [0.52, 0.6, 0.8])
def test_texts_that_begin_inside_an_item(held):
    for n in (40, 75, 120):
        items = [(k, text(n)) for k in range(20)]
        index = L.Index([(k, " ".join(w)) for k, w in items])
        tails = [" ".join(w[n - int(n * held + 1) :] + text(60)) for _, w in items]
        assert L.find_in(tails, index) == [(k, k) for k in range(20)]
        # the document ends with the passage, too
        assert L.find_in([" ".join(w[n - int(n * held + 1) :]) for _, w in items], index) == [(k, k) for k in range(20)]
        assert L.find_in([" ".join(w[n - int(n * 0.4) :] + text(60)) for _, w in items], index) == []


@pytest.mark.parametrize("n", [30, 75, 150, 400, 600, 3000])
def test_long_items_and_drift(n):
    items = [(k, text(n)) for k in range(4)]
    index = L.Index([(k, " ".join(w)) for k, w in items])
    every = [(k, k) for k in range(4)]

    def inserted(words):
        return [x for k, w in enumerate(words) for x in ([RNG.choice(LEXICON), w] if k % 6 == 3 else [w])]

    tails = [w[n // 2 - 1 :] for _, w in items]
    assert L.find_in([" ".join(w + text(60)) for w in tails], index) == every  # at the start of a document
    assert L.find_in([" ".join(text(90) + w) for w in tails], index) == every
    assert L.find_in([" ".join(text(90) + inserted(w) + text(9)) for _, w in items], index) == every
    assert L.find_in([" ".join(text(90) + [x for k, x in enumerate(w) if k % 6] + text(9)) for _, w in items], index) == every  # words left out
    assert L.find_in([" ".join(inserted(w[n - int(n * 0.6) :]) + text(60)) for _, w in items], index) == every
    assert L.find_in([" ".join(text(90) + inserted(w[: int(n * 0.4)]) + text(9)) for _, w in items], index) == []


def test_alignment_equals_a_full_table():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 25))]
        part = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 40))]
        best = (0, 0, 0)
        table = {}
        for i in range(len(item)):
            for j in range(len(part)):
                def at(x, y):
                    return table.get((x, y), (0, 0, 0))
                d, u, left = at(i - 1, j - 1), at(i - 1, j), at(i, j - 1)
                hit = part[j] == item[i]
                cell = max((d[0] + (1 if hit else -1), d[1] + hit, d[2] + 1), (u[0] - 1, u[1], u[2] + 1), (left[0] - 1, left[1], left[2]))
                table[i, j] = cell if cell[0] > 0 else (0, 0, 0)
                best = max(best, table[i, j])
        wide = np.concatenate([np.zeros(50, np.uint64), np.array(part, np.uint64)])
        assert L.align(np.array(item, np.uint64), wide, 50) == best[1:]
