import pytest
from pyspark.sql import functions as F

from switchback.llm import pii


@pytest.mark.parametrize("text, kind, mention", [
    ("write to ann.bee+x@mail.example please", "email", "ann.bee+x@mail.example"),
    ("write to ann dot bee at mail dot example now", "email", "ann dot bee at mail dot example"),
    ("Contact <ab (at) mail (dot) org>", "email", "ab (at) mail (dot) org"),
    ("call (531) 555-0127 now", "phone", "(531) 555-0127"),
    ("(+1 895 555 0198 works best)", "phone", "+1 895 555 0198"),
    ("call 254 - 555 - 0171 now", "phone", "254 - 555 - 0171"),
    ("on 020 7946 0890 after dark", "phone", "020 7946 0890"),
    ("call 8745550146.", "phone", "8745550146"),
    ("call me at five one six five five five oh one six one ok", "phone", "five one six five five five oh one six one"),
    ("I live at 1314 Old Lumallin Avenue, Loroner 00490.", "address", "1314 Old Lumallin Avenue"),
    ("Send to Flat 5, 1832 Yarartuk Pkwy, Lumasha", "address", "Flat 5, 1832 Yarartuk Pkwy"),
    ("Ship to: P.O. Box 2337, Wynespen", "address", "P.O. Box 2337"),
    ("i live at six one seven corinner street", "address", "six one seven corinner street"),
    ("Hi. It was FINE, so we left the keys at 42 old maple road for you", "address", "42 old maple road"),
    ("A Long Start of a Text with Capitals. leave it at six one corinner lane", "address", "six one corinner lane"),
    ("My SSN is 919 48 8772.", "id_number", "919 48 8772"),
    ("National insurance QQ 34 29 64 A.", "id_number", "QQ 34 29 64 A"),
    ("Passport no. Y68K74966", "id_number", "Y68K74966"),
    ("license R657-5891-43 is on the form", "id_number", "R657-5891-43"),
])
def test_shapes(text, kind, mention):
    spans = pii.shaped_spans(text)
    assert [(k, text[a : a + len(mention)]) for a, b, k in spans] == [(kind, mention)]


@pytest.mark.parametrize("text", [
    "The part number 4415-555-30 belongs to the tarp.", "Tracking WPX-2027-580752 still says pending.", "Elevation 6,827, bearing 860, pace 11.",
    "Grid reference 45.1234, -110.5678 puts it there", "Radio check was on 151.4000 MHz at noon", "date: 2024-08-12", "worth the 19 hour drive", "worth the 8 rocky drive", "@trail_otter_15 posted",
    "", " ", "\n",
])
def test_things_are_no_mentions(text):
    assert pii.shaped_spans(text) == []


ROWS = [("t", "1", "Thanks, Ann Bellock. Write to ann.bellock@mail.example."), ("t", "2", "Met Ann Corvel and two dogs. Mail cyra.corvel@mail.example."), ("t", "3", "This is Cyra Bellock writing."),
        ("t", "4", "We followed the Ann Bellock Memorial Trail past Lorin Basin."), ("t", "5", None), ("t", "6", ""), ("t", "7", "BELLOCK, Ann was here, c. Corvel too; led by C. Corvel."),
        ("t", "8", "yeah it's cyra corvel again"), ("t", "1", "Thanks, Ann Bellock. Write to ann.bellock@mail.example."), ("t", "9", "x " * 50_000 + "Cyra Corvel"), (None, None, "Ann Bellock"),
        ("t", "10", "we met them and said thanks"), ("t", "11", "Half of Ann Bellock's rope; thanks, ann\n> corvel"), ("t", "12", "hello, photo credit: n. corvel-bellock. the rest")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "tab string, rec_id string, text string").withColumn("kind", F.lit("clash")).withColumn("clean_text", F.lit(1))


def test_names_by_disclosure(spark):
    got = {(r.rec_id, r.kind, r.start_pos) for r in pii.find_mentions(table(spark)).collect()}
    assert {g for g in got if g[1] == "name"} == {("1", "name", 9), ("2", "name", 5), ("3", "name", 9), ("7", "name", 1), ("7", "name", 46), ("8", "name", 11), ("9", "name", 100_001), ("11", "name", 9), ("11", "name", 37), ("7", "name", 24), ("12", "name", 22)}
    assert ("1", "email", 31) in got


def test_exact_way_beyond_the_broadcast_bound(spark):
    a = pii.find_mentions(table(spark)).toPandas().sort_values(["rec_id", "start_pos"]).to_numpy().tolist()
    b = pii.find_mentions(table(spark), max_terms=0).toPandas().sort_values(["rec_id", "start_pos"]).to_numpy().tolist()
    assert a == b


def test_a_comma_list_of_names_on_both_paths(spark):
    rows = [*ROWS, ("t", "20", "Seen by Ann Bellock, Cyra Corvel, Ann Corvel, Cyra Bellock"), ("t", "21", "Corvel, Ann Bellock, Cyra Corvel"), ("t", "22", "Bellock, Cyra Corvel Memorial, Ann Corvel")]
    found = [sorted((r.rec_id, r.kind, r.start_pos, r.end_pos) for r in pii.find_mentions(table(spark, rows), bound).collect()) for bound in (pii.MAX_TERMS, 0)]
    assert found[0] == found[1]
    assert len([x for x in found[1] if x[0] == "20"]) == 4 and len([x for x in found[1] if x[0] == "21"]) == 2
    for bound in (pii.MAX_TERMS, 0):
        clean = {r.rec_id: r.clean_text for r in pii.redact(table(spark, rows), bound).collect()}
        assert clean["20"] == "Seen by [NAME], [NAME], [NAME], [NAME]"


def test_redaction_keeps_everything_else(spark):
    got = {r.rec_id: r.clean_text for r in pii.redact(table(spark)).collect()}
    assert got["1"] == "Thanks, [NAME]. Write to [EMAIL]." and got["5"] is None and got["6"] == ""
    assert got["4"] == ROWS[3][2] and got["9"] == "x " * 50_000 + "[NAME]"


def test_rows_without_id_are_redacted_too(spark):
    for bound in (pii.MAX_TERMS, 0):
        rows = [r.clean_text for r in pii.redact(table(spark), bound).where("rec_id is null").collect()]
        assert rows == ["[NAME]"]
    assert pii.redact(table(spark), 0).count() == len(ROWS)


def test_empty(spark):
    assert pii.find_mentions(table(spark, [])).count() == 0


def test_invisible_signs_keep_positions():
    text = "a​b Cyra Cor​vel"
    spans = pii.spans_of(text, pii.Sides({"cyra": "given", "corvel": "surname"}))
    assert [(text[a:b], k) for a, b, k in spans] == [("Cyra Cor​vel", "name")]


def test_a_number_that_stands_beside_many_names_reveals_nobody(spark):
    given, sur = ["Ann", "Cyra", "Lio", "Tam"], ["Bellock", "Corvel", "Dastin", "Emrow"]
    mails = [("t", f"m{i}", f"{a} {b} <{a}.{b}@mail.example> wrote.") for i, (a, b) in enumerate((a, b) for a in given for b in sur)]
    office = [("t", f"o{i}", f"{given[i % 4]} {sur[i // 4]} said to call 531-555-0100 for a permit.") for i in range(16)]
    own = [("t", f"p{i}", "Lio Dastin may be reached at 531-555-0199.") for i in range(16)]
    df = table(spark, [*mails, *office, *own])
    for bound in (pii.MAX_TERMS, 0):
        found = pii.find_mentions(df, bound).where("kind = 'phone'").collect()
        assert {r.rec_id for r in found} == {f"p{i}" for i in range(16)}
    clean = {r.rec_id: r.clean_text for r in pii.redact(df).collect()}
    assert clean["o3"] == "[NAME] said to call 531-555-0100 for a permit." and clean["p3"] == "[NAME] may be reached at [PHONE]."
    public = [r for r in pii.protected_terms(pii.evidence_of(df)).collect() if r.side == "public"]
    assert [(r.term, r.disclosure) for r in public] == [("phone:5315550100", 1 / 16)]


def test_words_are_learned_in_turn_until_none_is_added(spark):
    # each surname is known through the given name before it, each given name through the surname after it
    chain = ["Abel Bartok", "Cora Bartok", "Cora Dunlin", "Edda Dunlin", "Edda Fulmar", "Gil Fulmar", "Gil Harrow", "Ida Harrow", "Ida Jo", "Li Jo"]
    rows = [("t", "0", "a.bartok@mail.example")] + [("t", str(i), f"It was {x}.") for i, x in enumerate(chain, 1)]
    got = {r.rec_id for r in pii.find_mentions(table(spark, rows)).where("kind = 'name'").collect()}
    assert got == {str(i) for i in range(1, len(chain) + 1)}


def test_both_ways_agree_on_random_name_texts(spark):
    import random

    rng = random.Random(12)
    parts = ["Ann", "Cyra", "Bellock", "Corvel", "corvel", "ann", ",", ", ", "and", "C.", "A. ", "Bellock-Corvel", "Memorial", "'s", "\n> ", "of", "BELLOCK"]
    rows = [*ROWS, *[("t", f"x{i}", " ".join(rng.choice(parts) for _ in range(14))) for i in range(400)]]
    found = [sorted((r.rec_id, r.kind, r.start_pos, r.end_pos) for r in pii.find_mentions(table(spark, rows), bound).collect()) for bound in (pii.MAX_TERMS, 0)]
    assert found[0] == found[1]
