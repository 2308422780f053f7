import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from switchback.llm import chunks as C


def test_boundaries():
    text = "One two. three e.g. four St. Lumin, see No. 5 for 3. more | cells\nplain line\n\nblank before\n- bullet\n4.2 sub (done.) next"
    words, cuts = C.offsets(text)
    said = [text[a:b] for a, b in words]
    assert [said[i] for i in cuts] == ["three", "blank", "-", "4.2", "next"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c,", "\n\n", "\n- ", "3.", "E.g."]), max_size=120), st.integers(1, 30), st.integers(0, 12))
def test_pieces_cover_the_text(parts, limit, overlap):
    if overlap >= limit:
        overlap = limit - 1
    text = " ".join(parts)
    words, cuts = C.offsets(text)
    got = C.pieces(len(words), cuts, limit, overlap)
    assert all(0 < b - a <= limit for a, b, *_ in got)
    seen = []
    for k, (a, b, hard, _) in enumerate(got):
        seen += range(a if k == 0 else got[k - 1][1], b)
        if k:
            assert a == max(got[k - 1][1] - overlap, 0) and b > got[k - 1][1]
        if k + 1 < len(got):
            assert hard or b in cuts
            # the last boundary within the limit was taken
            assert hard or not any(b < c <= a + limit for c in cuts)
    assert seen == list(range(len(words)))
    edges = [0, *cuts, len(words)]
    assert any(x[3] for x in got) == (len(words) > limit and max(b - a for a, b in zip(edges, edges[1:])) > limit - overlap)


def test_cases(spark):
    prose = "Word word word word word word word word word done. " * 25
    run = "w " * 181 + "end. " + "x " * 60 + "z."
    rows = [("a", "s", prose), ("a", "s", prose), ("b", None, run), ("c", "s", None), ("d", "s", ""), ("e", "s", "short"), (None, "s", prose), ("f", "s", "w\t" * 199 + "w"), ("g", "s", "w " * 201), ("h", "s", "v " * 60_000)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").withColumn("piece", F.lit("clash"))
    assert {tuple(r) for r in C.oversized(df).collect()} == {("a", "clean"), ("b", "forced"), ("g", "forced"), ("h", "forced")}
    out = C.split_long(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in out} == {"a", "b", "e", "f", "g", "h"} and max(r.words for r in out) <= 200
    a = [re.split(r"[ \t\r\n]+", r.text) for r in out if r.chunk_id == "a"]
    assert len(a) == 2 and a[1][:20] == a[0][-20:] and a[0][-1] == "done."
    assert C.split_long(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.split_long(df, 10, 10)
