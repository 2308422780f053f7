import json

import pytest
from pyspark.sql import functions as F

from switchback.functions import citations, text as X, validate as V
from switchback.functions.vectors import cosine, l2_normalise, norm
from switchback.operators import anomaly, catalog, review, scoring, search, sections, vectors
from switchback.plans.agent import MAX_ROUNDS, Agent, gated, given
from switchback.plans.providers import FakeProvider, cited_answers, embedded, gated_replies, replies, structured


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first().x


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), norm(F.col("a")).alias("n"), l2_normalise(F.col("a")).alias("u")).collect()
    assert rows[0].c == pytest.approx(0.96) and rows[0].n == 5 and rows[0].u == pytest.approx([0.6, 0.8])
    assert rows[1].c is None and rows[2].c is None


@pytest.mark.parametrize("reply, label", [("Mixed, not positive", "mixed"), (" dunno ", "dunno"), ("POSITIVE then negative", "positive")])
def test_earliest_label(spark, reply, label):
    assert one(spark, X.earliest_label(F.col("r")), r=reply) == label


def test_tokens(spark):
    assert one(spark, X.search_tokens(F.col("t")), t="Are there campfires at the Sperry Chalet in GLASS EV 12 bus") == ["campfire", "sperry", "chalet", "glass", "bus"]
    assert one(spark, X.keyword_tokens(F.col("t")), t="Lake, lake by the big OAK") == ["lake", "the", "big", "oak"]
    assert one(spark, X.without_front_matter(F.col("t")), t="---\nid: a\n---\n\n Body --- more \n") == "Body --- more"
    assert one(spark, X.without_front_matter(F.col("t")), t=" plain ") == "plain"
    assert one(spark, X.clipped(F.col("t"), 4), t="abc def") == "abc..."
    assert one(spark, X.truncated(F.col("t"), 4), t="abcdef") == "abc…"


@pytest.mark.parametrize("value, ok, iso", [
    ("July 4, 2026", True, "2026-07-04"), ("2026-7-4", True, "2026-07-04"), ("2026-02-30", False, None), ("1850-01-01", False, None),
    ("last month", False, None), ("4 July 2026", True, "2026-07-04"), ("7/4/2026", True, "2026-07-04"),
])
def test_dates(spark, value, ok, iso):
    v = one(spark, V.date_verdict(F.col("d")), d=value)
    assert (v.passed, v.normalized) == (ok, iso)


def test_ranges_and_grounding(spark):
    for value, ok in ((0.0, False), (-1.0, False), (40.0, True), (101.0, False)):
        assert one(spark, V.range_verdict(F.col("d"), V.MAX_MILES), d=value).passed is ok
    assert one(spark, V.range_verdict(F.lit(None).cast("double"), 100.0), d=1).passed
    assert one(spark, V.grounded_verdict(F.col("v"), F.col("s")), v="Glacier National Park", s="we went to glacier").passed
    assert not one(spark, V.grounded_verdict(F.col("v"), F.col("s")), v="Acadia National Park", s="we went to glacier").passed
    assert not one(spark, V.grounded_verdict(F.col("v"), F.col("s")), v="  ", s="x").passed
    assert one(spark, V.clean_list(F.array(F.lit(" a "), F.lit(""), F.lit(None)))) == ["a"]


def test_citations(spark):
    text = "ok [a:1, b:2] [x] [c:3]"
    assert one(spark, citations.cited(F.col("t")), t=text) == ["a:1", "b:2", "c:3"]
    bad = citations.invalid(F.col("t"), F.array(F.lit("a:1")))
    assert one(spark, citations.stripped(F.col("t"), bad), t=text) == "ok [a:1, invalid-citation-removed] [x] [invalid-citation-removed]"


def test_alert_window_is_inclusive_and_order_free(spark):
    dates = ["2025-09-15", "2025-10-10", "2026-05-08", "2026-06-18", "2026-06-21", "2026-07-05", "2026-07-22"]
    rows = [("t", i, d) for i, d in enumerate(dates)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "trail string, id int, d string").withColumn("date", F.to_date("d"))
        got = {(r.first.isoformat(), r.size, r.alert) for r in anomaly.alerts(anomaly.gap_clusters(df, "trail"), "trail").collect()}
        assert got == {("2025-09-15", 1, False), ("2025-10-10", 1, False), ("2026-05-08", 1, False), ("2026-06-18", 3, True), ("2026-07-22", 1, False)}


def test_pair_distances_equal_brute_force(spark):
    import itertools
    import random

    random.seed(2)
    rows = [(i, i % 2, [random.gauss(0, 1) for _ in range(5)]) for i in range(12)]
    got = {(r.group_a, r.group_b): r.mean_distance for r in vectors.pair_distances(spark.createDataFrame(rows, "id int, label int, vector array<double>"), "label").collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v in rows}
    for a, b in ((0, 0), (0, 1), (1, 1)):
        d = [1 - sum(x * y for x, y in zip(unit[i], unit[j])) for i, j in itertools.permutations(range(12), 2) if i % 2 == a and j % 2 == b]
        assert got[a, b] == pytest.approx(sum(d) / len(d))


def test_bm25_keeps_documents_without_a_match(spark):
    docs = spark.createDataFrame([(1, "campfire rules"), (2, None), (3, "no fires campfires campfire")], "id int, text string")
    got = {r.id: r.score for r in search.bm25(docs, "campfires?").collect()}
    assert got[2] == 0 and got[3] > got[1] > 0
    flat = search.min_max(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, score double"))
    assert [r.norm for r in flat.collect()] == [0.0, 0.0]


def test_sections():
    long = "\n".join(f"2.{i} " + "word " * 45 + "." for i in range(1, 7))
    text = f"# Guide\n\nIntro one. More.\n\n## 1. Scope\n\nApplies to No. 5 and all. Then more.\n\n## 2. Rules\n\n{long}\n\n## 3. End\n\nDone."
    got = sections.chunked("guide.md", text)
    assert [c[0] for c in got] == ["guide:00", "guide:01", "guide:02.1-2", "guide:02.3-4", "guide:02.5-6", "guide:03"]
    assert got[0][2].endswith("(continues in Section 1, Scope) Applies to No. 5 and all.")
    assert "(continues in" not in got[-1][2] and got[1][2].startswith("[Guide]\n\n## 1. Scope")
    assert [c[0] for c in sections.chunked("x.md", "")] == ["x:00"]


def test_catalog(spark):
    rows = [("t1", "Lake Loop", "Lorin Park", 3.0, 10, "easy", ["lake view"], "d"), ("t2", "Ridge", "Lorin Park", 9.0, 10, "Hard", [], "d"), ("t3", "Pond", "Else", 1.0, 1, None, None, None)]
    t = spark.createDataFrame(rows, "id string, name string, park string, distance_mi double, elevation_ft int, difficulty string, features array<string>, description string")
    assert [r.id for r in catalog.search_trails(t, "lorin").collect()] == ["t1", "t2"]
    assert [r.id for r in catalog.search_trails(t, ceiling="moderate", features="LAKE").collect()] == ["t1"]
    assert [r.id for r in catalog.resolve(t, "ridge").collect()] == ["t2"]
    parks = spark.createDataFrame([("_comment", 0), ("Glacier National Park", 1), ("Acadia", 2)], "park string, pos int")
    assert catalog.park_match(parks, "Glacier").first().park == "Glacier National Park"
    assert catalog.park_match(parks, "acadia in maine").first().park == "Acadia"


def test_gate_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([("a", "permit"), ("b", "emergency"), ("c", "unsure"), ("d", None), ("e", "general"), ("f", "complaint")], "id string, category string")
    laned = review.with_lane(rows)
    may, humans = review.gate(laned)
    assert {r.id for r in humans.collect()} == {"b", "c", "d"}
    log = str(tmp_path / "log")
    drafts = gated_replies(laned, may.select("id", F.concat(F.lit("for "), "id").alias("prompt")), FakeProvider(reply=lambda p: "Escalate now" if p.endswith("f") else "Dear all", log=log))
    drafts.count(), drafts.collect()
    assert sorted(json.loads(x) for x in open(log)) == ["for a", "for e", "for f"]
    verdicts = spark.createDataFrame([("a", "approved", None), ("e", "edited", "Dear you")], "id string, decision string, edited string")
    audit = review.decided(drafts, verdicts, "me").cache()
    got = {r.id: (r.decision, r.edit_distance) for r in audit.collect()}
    assert got == {"a": ("approved", 0), "e": ("edited", 3), "f": ("escalated", 12), "b": ("human-only", 0), "c": ("human-only", 0), "d": ("human-only", 0)}
    path = str(tmp_path / "audit")
    review.append_audit(audit, path)
    review.append_audit(audit, path)
    assert spark.read.json(path).count() == 6
    assert review.write_outbox(audit, str(tmp_path / "out")) == 2 and (tmp_path / "out/e.txt").read_text() == "Dear you\n"


def test_scores(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, predicted string")
    labels = spark.createDataFrame([(1, "a")], "id int, label string")
    with pytest.raises(Exception, match="no label for 2"):
        scoring.labelled(rows, labels).collect()
    assert scoring.accuracy(rows.withColumn("label", F.lit("a"))).first() == (1, 2)


def test_embedding_cache_and_citation_repair(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", None)], "id string, text string")
    got = {r.id: r.vector for r in embedded(texts, FakeProvider(), cache).collect()}
    assert got["1"] == got["2"] and len(got) == 3
    embedded(texts, FakeProvider(), cache).collect()
    assert spark.read.parquet(cache).count() == 2

    def reply(p):
        return "Yes [a:1]." if "Cite only" in p else {"q1": "See [a:1].", "q2": "See [z:9].", "q3": "The provided documents don't say. [z:9]"}[p]

    q = spark.createDataFrame([("1", "q1", ["a:1"]), ("2", "q2", ["a:1"]), ("3", "q3", ["a:1"])], "id string, prompt string, retrieved array<string>")
    out = {r.id: (r.answer, r.retried) for r in cited_answers(q, FakeProvider(reply=reply)).collect()}
    assert out == {"1": ("See [a:1].", False), "2": ("Yes [a:1].", True), "3": ("The provided documents don't say.", False)}
    parsed = structured(replies(q.select("id", "prompt"), FakeProvider(reply=lambda p: '{"n": 1}' if p == "q1" else "oops")), "n int").collect()
    assert {(r.id, r.record.n if r.record else None) for r in parsed} == {("1", 1), ("2", None), ("3", None)}


def test_agent():
    seen = []
    done = {}
    script = iter([
        {"content": "", "tool_calls": [{"id": "1", "name": "look", "arguments": "not json"}, {"id": "2", "name": "none", "arguments": "{}"}]},
        {"content": "plan"}, {"content": "", "tool_calls": [{"id": "3", "name": "permit", "arguments": '{"n": 1}'}]}, {"content": "by day"},
    ])
    agent = Agent(lambda m: next(script), {"look": lambda **k: seen.append(k) or "ok", "permit": gated(lambda **k: {"status": "ok"}, lambda a: True, done)}, required=("look", "permit"), must_mention="day")
    assert agent.run("go") == "by day" and seen == [{}] and len(done) == 1
    loop = Agent(lambda m: {"content": "", "tool_calls": [{"id": "1", "name": "look", "arguments": "{}"}]}, {"look": lambda **k: 1})
    loop.rounds()
    assert len([m for m in loop.messages if m["role"] == "assistant"]) == MAX_ROUNDS
    assert gated(lambda **k: {"status": "ok"}, lambda a: False, {})(n=1) == {"status": "cancelled"}
    assert not given("null") and not given(" string ") and given("x")


def test_sources(spark, tmp_path):
    from switchback.sources import files

    (tmp_path / "a.md").write_text("---\nid: tr-1\nauthor: x\n---\nBody")
    (tmp_path / "w.json").write_text(json.dumps({"_comment": "no", "Glacier": {"n": 1}, "Acadia": {"n": 2}}))
    (tmp_path / "l.jsonl").write_text('{"id": "1", "rating": 3}\n\n{"id": "2"}\n')
    r = files.trip_reports(spark, str(tmp_path)).first()
    assert (r.id, r.author, r.park, r.body) == ("tr-1", "x", None, "Body")
    assert {(x.key, x.value.n) for x in files.keyed_json(spark, str(tmp_path / "w.json"), "n int").collect()} == {("Glacier", 1), ("Acadia", 2)}
    assert files.json_lines(spark, str(tmp_path / "l.jsonl"), files.REVIEW).count() == 2


def test_top_k_per_query_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (80, 5)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 5), (902, [1.0] * 4), (None, [1.0] * 5)]
    items = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = items.where("id % 10 = 0 or id = 902").selectExpr("id as query_id", "vector as query_vector")
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    got = {}
    for r in vectors.top_k_per_query(items, asked, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9), None if r.margin is None else round(r.margin, 9)))
    n = np.linalg.norm(x, axis=1)
    assert set(got) <= {*range(0, 80, 10)}
    for q in range(0, 80, 10):
        if not n[q]:
            continue
        best = sorted((-(x[q] @ x[i]) / (n[q] * n[i]), i) for i in range(80) if i != q and n[i])[:5]
        assert [(k + 1, i, round(-s, 9), round(best[k + 1][0] - s, 9)) for k, (s, i) in enumerate(best[:4])] == sorted(got[q])
    assert vectors.top_k_per_query(items, asked.limit(0)).count() == 0 and vectors.top_k_per_query(items.limit(0), asked).count() == 0


def test_texts_of_a_hot_key_in_order(spark):
    rows = [(f"r{i:04d}", "hot" if i % 3 else "cold", f"t{i}") for i in range(300)] + [("x", "hot", None)]
    df = spark.createDataFrame(rows, "id string, product string, text string").repartition(5)
    got = {r.product: (r.text, r.reviews) for r in catalog.concatenated(df, runs=7).collect()}
    for name in ("hot", "cold"):
        texts = [t for _, p, t in rows if p == name and t]
        assert got[name] == ("\n".join(texts), len(texts))


def test_priority_ranks_over_several_partitions(spark):
    rows = [(f"m{i:03d}", "emergency" if i % 7 == 3 else None if i % 5 == 0 else "permit") for i in range(200)]
    got = [r.id for r in scoring.priority_ranks(spark.createDataFrame(rows, "id string, category string").repartition(4), "id").orderBy("rank").collect()]
    assert got == sorted((i for i, _ in rows), key=lambda i: (dict(rows)[i] != "emergency", i))


def test_a_system_message_goes_before_each_prompt(spark, tmp_path):
    from switchback.plans.providers import FakeProvider, HttpProvider, replies

    log = tmp_path / "log"
    df = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, prompt string")
    got = {r.id: r.reply for r in replies(df, FakeProvider(log=str(log)), system="Be brief.").collect()}
    assert got == {"a": "Be brief.\n\none", "b": "Be brief.\n\ntwo"}
    sent = []
    http = HttpProvider("m", "http://localhost", "e")
    object.__setattr__(http, "_post", lambda route, body: sent.append(body) or {"choices": [{"message": {"content": "ok"}}]})
    assert http.chat(["hi"], system="Be brief.") == ["ok"]
    assert [(m["role"], m["content"]) for m in sent[0]["messages"]] == [("system", "Be brief."), ("user", "hi")]
    http.chat(["hi"])
    assert [m["role"] for m in sent[1]["messages"]] == ["user"]


def test_gap_clusters_of_many_rows_a_day(spark):
    import datetime

    day = datetime.date(2026, 6, 18)
    rows = [(k, "hot", day + datetime.timedelta(days=x)) for k, x in enumerate([0] * 40 + [14] * 30 + [29] * 20)] + [(999, "hot", None), (998, None, day)]
    got = anomaly.gap_clusters(spark.createDataFrame(rows, "id long, trail string, date date"), "trail").groupBy("cluster").count().collect()
    assert {(r.cluster, r["count"]) for r in got} == {(1, 70), (2, 20), (None, 2)}


def test_provider_from_the_environment(monkeypatch):
    from switchback.plans.providers import FakeProvider, HttpProvider, provider_from_env

    for v in ("MODEL_URL", "MODEL_NAME", "EMBEDDER_NAME"):
        monkeypatch.delenv(v, raising=False)
    assert isinstance(provider_from_env(), FakeProvider)
    for v, x in (("MODEL_URL", "http://localhost:1"), ("MODEL_NAME", "m"), ("EMBEDDER_NAME", "e")):
        monkeypatch.setenv(v, x)
    assert provider_from_env() == HttpProvider("m", "http://localhost:1", "e", "")


def test_tables_are_swept(spark):
    import os

    from switchback.plans import lineage

    lineage.sweep(spark)
    kept, dropped = lineage.written(spark.range(3), "kept"), lineage.written(spark.range(4), "dropped")
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    lineage.forget(dropped)
    assert kept.count() == 3 and os.path.exists(folder)
    assert lineage.sweep(spark) == 1 and not os.path.exists(folder)
