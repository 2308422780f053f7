import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.llm import clusters, mixing, neighbours, reading


# nearest vectors
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    x = centre[rng.integers(0, 40, 1500)] + 0.35 * rng.normal(size=(1500, 64))
    x[500:1000] = x[500]  # a third are copies
    rows = [(f"t{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [("a", None), ("b", [0.0] * 64), ("c", [1.0] * 63), ("d", [float("nan")] * 64), (None, [1.0] * 64), ("e", []), rows[0]]
    df = spark.createDataFrame(rows + bad, "id string, vector array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    got = neighbours.similar(df, 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    kth = np.sort(sim, axis=1)[:, -5]
    by = {}
    for r in got:
        assert abs(sim[int(r.id[1:]), int(r.other[1:])] - r.similarity) < 1e-5
        by.setdefault(r.id, []).append(r)
    assert len(by) == 1500 and all(len(v) == 5 and sorted(z.rank for z in v) == [1, 2, 3, 4, 5] for v in by.values())
    good = sum(r.similarity >= kth[int(r.id[1:])] - 1e-5 for r in got)
    assert good / len(got) > 0.95
    pairs = neighbours.similar_pairs(df).collect()
    assert all(r.id_a < r.id_b for r in pairs)


def test_codes_choose_where_lists_are_larger_than_the_rerank(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 64))
    within = rng.normal(size=(60, 10, 64)) / 10**0.5
    own = rng.integers(0, 60, 6000)
    x = (centre[own] + np.einsum("nk,nkd->nd", rng.normal(size=(6000, 10)), within[own])).astype(np.float32)
    df = spark.createDataFrame([(f"t{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, vector array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    kth = np.sort(sim, axis=1)[:, -5]

    def recall():
        got = neighbours.similar(df, 5, rerank=(24,)).select("id", "similarity").toPandas()
        return (got["similarity"] >= kth[got["id"].str[1:].astype(int)] - 1e-5).sum() / (5 * len(x))

    # 32 lists of 190 vectors, of which 24 are ranked exactly
    assert neighbours.lists_for(6000) == (32, 1)
    assert recall() > 0.95
    real = neighbours.fit
    neighbours.fit = lambda x, lists: _blank(real(x, lists))
    try:
        assert recall() < 0.7  # without the codebooks it is chance
    finally:
        neighbours.fit = real


def _blank(q):
    q.books[:] = 0
    return q


def test_lists_grow_with_the_root_of_the_collection():
    for n in (10_000, 10**6, 10**8, 10**10):
        centres, parts = neighbours.lists_for(n)
        assert centres <= neighbours.COARSE and 0.3 * n**0.5 <= centres * parts <= 0.75 * n**0.5
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    q = neighbours.fit(x, (16, 4), words=16)
    near = q.lists(x, 6)
    every = (q.coarse[:, None] + q.parts[None]).reshape(-1, 64)
    d = ((x[:, None] - every[None]) ** 2).sum(-1)
    first = np.array([d[i, near[i]] for i in range(len(x))])
    assert near.shape == (500, 6) and (np.diff(first, axis=1) > -1e-4).all() and (first[:, 0] <= d.min(1) + 1e-3).mean() > 0.95


def test_neighbours_small(spark):
    schema = "id string, vector array<float>"
    assert neighbours.similar(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.similar(spark.createDataFrame([("a", [1.0] * 64)], schema)).count() == 0
    assert neighbours.similar(spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64)], schema)).count() == 2


def test_hot_list_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rows = [(f"t{i:04d}", [1.0 + (i % 7) * (k == i % 64) for k in range(64)]) for i in range(300)]
    got = neighbours.similar(spark.createDataFrame(rows, "id string, vector array<float>")).collect()
    assert len(got) == 1500


# clusters
def test_clusters(spark):
    forms = ["Basin", "Cove", "Saddle", "Pass"]
    filler = [(f"f{i}{k}", f"t{i}", f"Heads up for Nam{chr(97 + i)}x{chr(97 + i)} {f}: snow lies there") for i in range(12) for k, f in enumerate(forms)]
    rows = [
        ("a1", "t", "At Corenner Basin the bear feeds today. It is near mile 7, just past Muran Pass."), ("a2", "t", "the sow bear at corenner basin refuses to leave"),
        ("a3", "t", "Corennner Basin again, bear with cubs"), ("a4", "t", "Bear seen, Croenner Basin. Muran Pass side, mile 7."), ("a5", "t", "Past the crooked post. Old bear, Corenner Baisn."),
        ("b1", "t", "At Zemum Pass a log lies. Corenner Basin side."), ("b2", "t", "At Zemum Pass a log lies there"), ("c1", "u", "At Corenner Basin the bear feeds"), ("d", "t", "ok"), ("e", "t", "Corenner Basin bear"),
        ("f", None, "At Corenner Basin the bear feeds"), ("g", "t", None), ("h", "t", ""), ("a1", "t", "At Corenner Basin the bear feeds today. It is near mile 7, just past Muran Pass."), ("i", "t", "bear " * 40_000),
    ]
    df = spark.createDataFrame(rows + filler, "id string, trail_id string, text string").withColumn("cluster_id", F.lit(1))
    got = {(r.cluster_id, r.id) for r in clusters.clustered(df).collect()}
    assert got == {("a1", f"a{k}") for k in range(1, 6)}
    one = clusters.described(df).collect()
    assert [(r.cluster_id, r.size, r.typical[0]) for r in one] == [("a1", 5, "a1")]
    assert clusters.clustered(df.limit(0)).count() == 0


def test_a_slip_between_two_places_joins_one_of_them(spark):
    names = {1: ("dunendale", 9, "48"), 2: ("dunedale", 6, "112"), 3: ("dunendal", 1, None), 4: ("dunnedale", 1, "112"), 5: ("corvala", 2, None), 6: ("corvaal", 1, None), 7: ("belor", 4, "9"), 8: ("bleor", 3, "9"), 9: ("quenda", 4, None), 10: ("quednda", 5, None)}
    cells = spark.createDataFrame([(k, "t", n, "cove", x, c) for k, (n, c, x) in names.items()], "nid long, trail_id string, name string, form string, number string, n long")
    got = {tuple(r) for r in clusters.joined_cells(cells).collect()}
    # 1 and 2 have other numbers; 3 and 4 go to one dense cell each, 6 to the larger of two sparse ones; 7 and 8 agree; 9 and 10 have no number that does
    assert got == {(1, 3), (2, 4), (5, 6), (7, 8)}


def test_places_and_numbers():
    words = clusters.Words(["cove", "pass", "ridge"])
    found = lambda t: [(n, f) for _, _, n, f, _ in sorted(clusters.places_of(t, words))]
    assert found("Beloow Muran Pass, at Corenner Coev. Zemum Pass sdie") == [("corenner", "cove")]
    assert found("the hanging bridge at Corenner Cove") == [("corenner", "cove"), ("hanging", "ridge")]
    assert [clusters.number_of(t) for t in ("mile 11.2, 7", "at 112 if", "none", "0.9", "x7 3")] == ["112", "112", None, "9", "3"]


# reading level
def test_isotonic_is_monotone_and_close():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (x + 0.3 * rng.normal(size=400) > 0).astype(int) + (x > 1)
    knots, levels = reading.isotonic(x, y)
    assert all(a < b for a, b in zip(levels, levels[1:])) and len(knots) == len(levels) - 1
    fitted = np.array(levels)[np.searchsorted(knots, x, side="right")]
    assert abs(fitted.mean() - y.mean()) < 1e-9


EASY = "We hit a wet log by the old lake. It was fun. My cat ran to us and sat on a hat. "
HARD = (
    "Notwithstanding the representative documentation undertaken by the preservation organization during the preceding administrative period, the authoritative interpretation "
    "of environmental circumstances surrounding the installation nevertheless complicated any subsequent reconciliation considerably. "
)
MID = "We left the lot early with plenty of water and a bag of walnuts in the pack. The ranger board listed the ridge as foggy but passable with care. "


def test_bands(spark):
    rows = [(i, t * (3 + i % 4)) for i, t in enumerate([EASY, MID, HARD] * 40)]
    rows += [(900, "---\nid: x\nauthor: longishname\n---\n# " + HARD + "\n\n- " + EASY.replace(". ", ".\n- ")), (901, None), (902, ""), (903, " \n"), (904, "El perro es de la casa y no hay sol. " * 4), rows[0], (905, HARD * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("words", F.lit(1))
    got = {(r.doc_id, r.band) for r in reading.listed_bands(df).collect()}
    want = {(i, "easy") for i in range(0, 120, 3)} | {(i, "demanding") for i in range(2, 120, 3)} | {(900, "easy"), (905, "demanding")}
    assert got == want
    levels = {r.doc_id: r for r in reading.reading_levels(df).collect()}
    assert levels[901].band is None and levels[902].level is None and levels[1].band == "middle" and levels[904].language == "es"
    assert reading.listed_bands(df.limit(0)).count() == 0
    assert sum(r.documents for r in reading.profile(df).collect()) == len(rows)


def test_graded_pairs_have_the_harder_one_first():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 300)
    x = np.abs(rng.normal(size=(300, len(reading.FEATURES)))) + g[:, None]
    hard, easy = reading.graded_pairs(x, g, 4000, rng)
    a, b = reading.FEATURES.index("log_sentence"), reading.FEATURES.index("letters_per_word")
    assert len(hard) > 1000 and all(g[i] > g[j] or (x[i, a] > x[j, a] and x[i, b] > x[j, b]) for i, j in zip(hard, easy))
    ranker = reading.fit(x, g)
    assert ranker.levels == sorted(ranker.levels) and reading.fit(x[:0], g[:0]).levels == [1.0]


def test_measures_of_a_text():
    m = reading.measures("# A heading here\n\n- We saw Mt. Aru, ca. 3 mi. away.\n- It was near\n\nNo way!")
    assert m[0] == pytest.approx(13 / 3) and m[2] == 0.0
    assert reading.measures("12 34. 5")[1] == 0 and np.isnan(reading.measures(" - \n")[0])


# mixing
def test_hidden_labels_are_predicted_and_silent_texts_are_not():
    rng = np.random.default_rng(6)
    import pandas as pd

    def sample(words):
        bags = [mixing.Bags().of(" ".join(rng.choice(words[k], 40))) for k in (0, 1, 2) for _ in range(100)]
        return pd.DataFrame({"label": ["a"] * 100 + ["b"] * 100 + ["c"] * 100, "places": [b[0] for b in bags], "counts": [b[1] for b in bags]}).sample(frac=1, random_state=1)

    same = [f"w{i}" for i in range(50)]
    assert mixing.fit_bayes(sample([same] * 3), ["a", "b", "c"])[1] == 0
    weight, worth = mixing.fit_bayes(sample([same + [f"{k}{i}" for i in range(20)] for k in "abc"]), ["a", "b", "c"])
    assert worth > 0
    hits = [np.argmax(mixing._scores(weight, *mixing.Bags().of(" ".join(rng.choice(same + [f"{'abc'[k]}{i}" for i in range(20)], 40))))) == k for k in (0, 1, 2) for _ in range(50)]
    assert np.mean(hits) > 0.95


def test_goals_share_a_shortfall_in_proportion():
    got = mixing.goals(np.array([0.5, 0.3, 0.2]), 100.0, np.array([90.0, 90.0, 5.0]))
    assert got == pytest.approx([95 * 5 / 8, 95 * 3 / 8, 5])
    assert mixing.goals(np.array([0.5, 0.5]), 100.0, np.array([10.0, 20.0])) == pytest.approx([10, 20])
    assert mixing.goals(np.array([0.0, 0.0]), 0.0, np.array([0.0, 0.0])) == pytest.approx([0, 0])


def test_whole_uses_keep_the_total_and_the_cap():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        tokens, cap = rng.integers(1, 900, n), np.full(n, 4.0)
        rate = np.full(n, 3.57)
        uses = mixing.whole_uses(tokens, rate, cap)
        assert uses.min() >= 0 and uses.max() <= 4
        assert abs((uses * tokens).sum() - (rate * tokens).sum()) <= tokens.min() / 2 + 1
    assert mixing.whole_uses(np.array([5, 5]), np.array([4.0, 4.0]), np.array([4.0, 4.0])).tolist() == [4, 4]
    assert mixing.whole_uses(np.array([5]), np.array([0.0]), np.array([0.0])).tolist() == [0]


def test_mixture(spark):
    rng = np.random.default_rng(4)
    words = {"a": "apple pear plum", "b": "stone rock sand", "c": "boat sail wave"}
    rows = []
    for i in range(900):
        k = "a" if i < 600 else "b" if i < 870 else "c"
        said = " ".join(rng.choice(words[k].split(), rng.integers(20, 80)))
        rows.append((i, said, {0: k.upper() + " ", 1: None, 2: "unknown"}.get(i % 5, k)))
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "pear", None), rows[0], (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 4)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = chosen.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.uses <= caps[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    assert {r.doc_id for r in got}.isdisjoint({5000, 5001})
    assert all(r.source == ("a" if r.doc_id < 600 else "b" if r.doc_id < 870 else "c") for r in got if r.doc_id < 900)
    for r in shares.collect():
        assert r.share == pytest.approx(r.target_share, abs=0.005) and r.expected_share == pytest.approx(r.target_share, abs=0.005)
    assert [r.share for r in mixing.mix(docs.limit(0), targets)[1].collect()] == [0, 0, 0]
