import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.llm import neardup as N


def runs(t, n):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 5)):
            out.append(" ".join(edited(rng, base, rng.randrange(0, 6))))
    hot = [rng.choice(vocabulary) for _ in range(80)]
    out += [" ".join(edited(rng, hot, 3)) for _ in range(80)] + ["Same text of five words"] * 50 + ["", None, "two words", "a-b_c d"]
    rows = [("hard", f"gr-{i:04d}", t) for i, t in enumerate(out)]
    return rows + [("hard", "gr-0000", rows[0][2]), ("documents", "gr-0001", rows[0][2]), ("hard", None, "no id here at all"), ("hard", "gr-9999", " ".join(["long"] * 30_000))]


def brute(rows, n, least):
    sets = {}
    for tab, i, t in rows:
        if i and t and (s := runs(t, n)):
            sets.setdefault((tab, i), s)
    return {(a[0], a[1], b[1]) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if a[0] == b[0] and len(x & y) >= least * len(x | y)}


@pytest.mark.parametrize("n, least", [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, rows, n, least):
    df = spark.createDataFrame(rows, "tab string, rec_id string, text string").withColumn("nid", F.lit("clash"))
    links, members = N.near_duplicates(df, n, least)
    got = {tuple(r) for r in N.duplicate_pairs(links, members).collect()}
    want = brute(rows, n, least)
    assert not got - want
    assert len(got & want) >= 0.995 * len(want)


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "tab string, rec_id string, text string")
    links, members = N.near_duplicates(df, 3, 0.6)
    got = {(r.tab, r.rec_id): r for r in N.duplicate_groups(links, members).collect()}
    pairs = N.duplicate_pairs(links, members).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p in pairs:
        a, b = sorted((find((p.tab, p.id_a)), find((p.tab, p.id_b))))
        root[b] = a
    for key, r in got.items():
        assert r.group_id == find(key)[1]
    same = [r for r in got.values() if r.class_id == min(i for t, i, x in rows if x and x.startswith("Same"))]
    assert len(same) == 50


def test_empty(spark):
    links, members = N.near_duplicates(spark.createDataFrame([], "tab string, rec_id string, text string"))
    assert links.count() == 0 and N.duplicate_groups(links, members).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in itertools.pairwise(order)], "a long, b long")
    got = N.components(links, spark.range(n).withColumnRenamed("id", "nid")).collect()
    assert {r.root for r in got} == {0} and len(got) == n


def agreeing(texts, least_match, least_marks):
    """Signature rows of the texts, and all pairs above both bounds."""
    _, sig, _ = N.signatures(texts, 3)
    match = [(sig[a + 1 :, : N.COORDS] == sig[a, : N.COORDS]).sum(1) for a in range(len(sig))]
    marks = [((sig[a + 1 :] ^ sig[a]) & 3 == 0).sum(1) for a in range(len(sig))]
    want = {(a, b) for a in range(len(sig)) for b in a + 1 + np.flatnonzero((match[a] >= least_match) & (marks[a] >= least_marks))}
    values = np.ascontiguousarray(sig[:, : N.COORDS]).view(np.int64)
    rows = [(i, "hard", *map(int, v), *map(int, m)) for i, (v, m) in enumerate(zip(values, N._packed(sig)))]
    return rows, want


@pytest.mark.parametrize("block, least_match", [(2048, 10), (40, 10), (7, 10), (7, 18), (7, 2)])
def test_candidates_are_all_pairs_above_the_match_bound(spark, block, least_match):
    rng = random.Random(11)
    # texts of few stock phrases, so that most values are common, and a family
    phrases = [" ".join(f"p{i}w{k}" for k in range(8)) for i in range(60)]
    texts = [" ".join(rng.sample(phrases, 6) + [f"u{i} v{i} x{i}"]) for i in range(600)]
    texts += [" ".join(edited(rng, " ".join(phrases[:9]).split(), 4)) for _ in range(120)]
    rows, want = agreeing(texts, least_match, 68)
    classes = spark.createDataFrame(rows, "nid long, tab string, " + ", ".join(f"{c} long" for c in N.SIG + N.MARK))
    got = [tuple(r) for r in N.candidates(classes, least_match, 68, block=block).select("a", "b").collect()]
    assert want <= set(got) and len(got) == len(set(got))
    # a pair that meets in one list and whose marks collide often is let through
    assert set(got) <= agreeing(texts, 1, 68)[1]


def test_a_hot_list_is_posted_in_blocks(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(300)]
    rows, want = agreeing(texts, 10, 68)
    classes = spark.createDataFrame(rows, "nid long, tab string, " + ", ".join(f"{c} long" for c in N.SIG + N.MARK))
    made = N.posting(classes, N.COORDS, 10, 20)
    _, _, parts = made.lists(classes.toPandas())
    assert parts.max() >= 10  # 300 members in blocks of 20
    assert want <= {tuple(r) for r in N.candidates(classes, 10, 68, block=20).collect()}


@pytest.mark.parametrize("copies, edits", [(200, (4, 6)), (1500, (5, 6))])
def test_large_families_near_the_threshold_equal_brute_force(spark, copies, edits):
    rng = random.Random(copies)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(edited(rng, base, rng.randint(*edits))) for _ in range(copies)]
    sets = [runs(t, 3) for t in texts]
    uses = Counter(itertools.chain.from_iterable(sets))
    known = {r: k for k, r in enumerate(r for r, n in uses.items() if n > 1)}
    held = np.zeros((copies, len(known)), np.float32)
    sizes = np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        held[i, [known[r] for r in s if r in known]] = 1
    both = (held @ held.T).astype(int)
    x, y = np.nonzero(np.triu(both >= 0.6 * (sizes[:, None] + sizes[None] - both), 1))
    df = spark.createDataFrame([("hard", f"{i:04d}", t) for i, t in enumerate(texts)], "tab string, rec_id string, text string")
    links, members = N.near_duplicates(df, 3, 0.6)
    got = N.duplicate_pairs(links, members).select(F.col("id_a").cast("int").alias("x"), F.col("id_b").cast("int").alias("y")).toPandas()
    assert len(got) == len(x) and (np.sort(got["x"] * copies + got["y"]) == np.sort(x * copies + y)).all()


def test_a_pair_missed_by_the_lists_is_found_through_its_family(spark):
    # four texts in a chain and apart from it a pair and a triangle, which are complete; all runs are shared
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (10, 11), (10, 12), (11, 12)], "a long, b long")
    runs = spark.createDataFrame([(i, np.arange(20, dtype=np.uint32).tobytes()) for i in (1, 2, 3, 4, 7, 8, 10, 11, 12)], "nid long, runs binary")
    assert {(r.a, r.b) for r in N.incomplete(links).collect()} == {(1, 2), (2, 3), (3, 4)}
    for size in (128, 1):
        assert {(r.a, r.b, r.sim) for r in N.family_links(links, runs, 0.6, size).collect()} == {(1, 3, 1.0), (1, 4, 1.0), (2, 4, 1.0)}
    assert N.family_links(links.where("a > 5"), runs, 0.6) is None


def test_words_are_those_of_the_pattern():
    texts = ["Äpfel_und Birnen 3x, don't", "", "_", "日本 word\u0301s 𝟛 ²", "a" * 5000 + " b", "İstanbul"]
    hashes, counts = N.word_hashes(texts)
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = list(itertools.chain.from_iterable(words))
    assert len({*zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))


def test_batches_are_bounded_by_characters():
    import pandas as pd

    f = pd.DataFrame({"text": ["a" * n for n in (5, 5, 5, 30, 1, 1, 1, 1)]})
    assert [len(g) for g in N.in_batches(f, rows=3, chars=12)] == [2, 1, 1, 3, 1]
    assert list(N.in_batches(f.iloc[:0])) == []
