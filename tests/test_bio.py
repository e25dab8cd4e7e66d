import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from plain import spans as plain_spans
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators.spans import explode_spans, window_spans

GOLDEN = [
    ([], [], []),
    (["O", "O"], [], []),
    (["B-a", "I-a", "O"], [("a", 0, 2)], [("a", 0, 2)]),
    (["B-a", "B-a"], [("a", 0, 1), ("a", 1, 2)], [("a", 0, 1), ("a", 1, 2)]),
    (["O", "I-a", "I-a"], [], [("a", 1, 3)]),
    (["B-a", "I-b", "I-b"], [("a", 0, 1)], [("a", 0, 1), ("b", 1, 3)]),
    (["B-a", "I-b", "I-a"], [("a", 0, 1)], [("a", 0, 1), ("b", 1, 2), ("a", 2, 3)]),
    (["I-a", "B-a", "I-a"], [("a", 1, 3)], [("a", 0, 1), ("a", 1, 3)]),
    (["B-a", "O", "I-a"], [("a", 0, 1)], [("a", 0, 1), ("a", 2, 3)]),
    (["B-a", "I-a"], [("a", 0, 2)], [("a", 0, 2)]),
    (["X", "B-a", "B"], [("a", 1, 2)], [("a", 1, 2)]),
]


def decode(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, tags array<string>")
    got = df.select("id", bio.spans(F.col("tags")).alias("s"), bio.spans(F.col("tags"), False).alias("l")).orderBy("id").collect()
    return [([tuple(x) for x in r.s], [tuple(x) for x in r.l]) for r in got]


def test_golden_sequences(spark):
    assert decode(spark, [g[0] for g in GOLDEN]) == [(g[1], g[2]) for g in GOLDEN]
    assert decode(spark, [None]) == [([], [])]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["O", "B-a", "I-a", "B-b", "I-b"]), max_size=12), min_size=60, max_size=60))
def test_arrays_windows_and_plain_agree(spark, rows):
    assert decode(spark, rows) == [(plain_spans(t), plain_spans(t, strict=False)) for t in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, tags array<string>")
    long = df.select("id", F.posexplode("tags").alias("pos", "tag"))
    for strict in (True, False):
        a = {tuple(r) for r in explode_spans(df, ["id"], "tags", strict).collect()}
        assert a == {tuple(r) for r in window_spans(long, ["id"], strict).collect()}


@pytest.mark.parametrize(("text", "tokens", "labels"), [
    ("a(O) f(x)(B-nome) x(B-a-b) (O)(O) (B-nome) x(O)y", ["a", "f(x)", "(O)"], ["O", "B-nome", "O"]),
    ("x(B-órgão)\n y(I-órgão)", ["x", "y"], ["B-órgão", "I-órgão"]),
    ("", [], []),
    (None, [], []),
])
def test_parse_inline(spark, text, tokens, labels):
    r = spark.createDataFrame([(text,)], "t string").select(bio.parse_inline_tokens(F.col("t")).alias("k"), bio.parse_inline(F.col("t")).alias("g")).first()
    assert (r.k, r.g) == (tokens, labels)


@pytest.mark.parametrize(("labels", "n", "want"), [(["B-a"], 3, ["B-a", "O", "O"]), (["O", "B-a", "I-a", "O", "O"], 2, ["O", "B-a"]), ([], 0, [])])
def test_align(spark, labels, n, want):
    df = spark.createDataFrame([(labels, n)], "l array<string>, n int")
    assert df.select(bio.align(F.col("l"), F.col("n")).alias("x")).first().x == want


def test_slice_and_negative(spark):
    df = spark.createDataFrame([(["B-a", "I-b", "I-a", "O"],)], "t array<string>")
    r = df.select(bio.slice_to(F.col("t"), F.lit("a")).alias("s"), bio.is_negative(F.col("t"), F.lit("a")).alias("a"),
                  bio.is_negative(F.col("t"), F.lit("c")).alias("c"), bio.entity_types(F.col("t")).alias("e")).first()
    assert r.s == ["B-a", "O", "I-a", "O"]
    assert (r.a, r.c, r.e) == (False, True, ["a", "b"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.text("ab()é-1", min_size=1, max_size=5), st.sampled_from(["O", "B-x", "I-x"])), max_size=8), min_size=30, max_size=30))
def test_render_parse_round_trip(spark, docs):
    df = spark.createDataFrame([(i, [k for k, _ in d], [g for _, g in d]) for i, d in enumerate(docs)], "id int, k array<string>, g array<string>")
    back = df.withColumn("t", bio.render(F.col("k"), F.col("g"))).select("id", "k", "g", bio.parse_inline_tokens(F.col("t")).alias("pk"), bio.parse_inline(F.col("t")).alias("pg"))
    assert all(r.k == r.pk and r.g == r.pg for r in back.collect())


def test_encode_and_argmax(spark):
    df = spark.createDataFrame([(["B-a", "O", "Z"], ["O", "B-a"], [0.1, 0.7, 0.7])], "l array<string>, v array<string>, s array<double>")
    r = df.select(bio.encode(F.col("l"), F.col("v")).alias("e"), bio.argmax(F.col("s")).alias("m")).first()
    assert (r.e, r.m) == ([1, 0, -100], 1)
