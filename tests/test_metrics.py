import random

from plain import counts, outcome
from pyspark.sql import functions as F

from tagloom.operators import metrics, resample

TAGS = ["O", "O", "B-a", "I-a", "B-b", "I-b"]


def table(spark, n=80, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        gold = [rng.choice(TAGS) for _ in range(rng.randrange(12))]
        pred = [t if rng.random() < 0.8 else rng.choice(TAGS) for t in gold]
        rows.append((i, rng.choice(["x", "y", None]), gold, pred))
    return rows, spark.createDataFrame(rows, "idx int, act string, gold array<string>, pred array<string>")


def test_counts_and_outcomes_match_plain(spark):
    rows, df = table(spark)
    got = {r.idx: (r.tp, r.n_pred, r.n_gold) for r in metrics.match_counts(df, ["idx"]).collect()}
    assert got == {i: counts(g, p) for i, _, g, p in rows}
    errors = {r.idx: {k: r[k] for k in ("exact", "boundary", "omission")} for r in metrics.outcomes(df, ["idx"]).collect()}
    assert errors == {i: outcome(g, p) for i, _, g, p in rows}
    assert all(sum(e.values()) == got[i][2] for i, e in errors.items())


def test_overlap_cases(spark):
    gold = ["O", "O", "B-a", "I-a", "I-a", "O", "O"]
    cases = [(["O"] * 4 + ["B-a", "I-a", "I-a"], "boundary"), (["O"] * 5 + ["B-a", "I-a"], "omission"), (["O", "O", "B-b", "I-b", "I-b", "O", "O"], "omission"), (gold, "exact")]
    df = spark.createDataFrame([(i, gold, p) for i, (p, _) in enumerate(cases)], "idx int, gold array<string>, pred array<string>")
    for r in metrics.outcomes(df, ["idx"]).collect():
        assert r[cases[r.idx][1]] == 1


def test_scores_of_nothing_are_zero(spark):
    df = spark.createDataFrame([("x", 0, 0, 0), ("y", 2, 3, 3)], "act string, tp int, n_pred int, n_gold int")
    got = {r.act: (r.precision, r.recall, r.f1, r.fp, r.fn) for r in metrics.scores(df, ["act"]).collect()}
    assert got == {"x": (0, 0, 0, 0, 0), "y": (2 / 3, 2 / 3, 4 / 6, 1, 1)}
    empty = metrics.scores(df.limit(0), []).first()
    assert (empty.tp, empty.f1, empty.n_records) == (0, 0.0, 0)


def test_report_compare_and_shares(spark):
    _, df = table(spark)
    report = {r.label: r for r in metrics.class_report(df).collect()}
    assert set(report) == {"a", "b", "micro avg", "macro avg", "weighted avg"}
    assert report["micro avg"].support == report["a"].support + report["b"].support
    assert abs(report["macro avg"].f1 - (report["a"].f1 + report["b"].f1) / 2) < 1e-12
    counted = metrics.match_counts(df, ["act"])
    same = metrics.compare(counted, counted, "act")
    assert {r.delta for r in same.collect()} == {0.0}
    assert same.agg(metrics.weighted_gap(same)).first()[0] == 0
    shares = metrics.error_shares(metrics.outcomes(df, ["act"]), "act").collect()
    total = next(r for r in shares if r.act is None)
    assert total.spans == sum(r.spans for r in shares if r.act is not None)


def test_both_modes_agree_with_single_ones(spark):
    _, df = table(spark)
    both = metrics.both_modes(df, []).first()
    strict = metrics.scores(metrics.match_counts(df, []), []).first()
    lenient = metrics.scores(metrics.match_counts(df, [], strict=False), []).first()
    assert (both.f1_strict, both.f1) == (strict.f1, lenient.f1)


def test_bootstrap_designs_agree(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), 4 + rng.randrange(3), 4 + rng.randrange(3)) for i in range(150)]
    units = spark.createDataFrame(rows, "unit int, tp_a int, n_pred_a int, n_gold_a int")
    point = 2 * sum(r[1] for r in rows) / sum(r[2] + r[3] for r in rows)
    drawn = resample.draw_replicates(resample.numbered(units, "unit"), 100, "s", ["a"])
    assert drawn.count() == 100
    poisson = resample.poisson_replicates(units, "unit", 100, "s", ["a"])
    a, b = (resample.percentile_interval(resample.replicate_f1(x, ["a"]), F.col("f1_a")).first() for x in (drawn, poisson))
    for ci in (a, b):
        assert ci.lo < point < ci.hi and abs(ci.mean - point) < 0.02
    assert abs((a.hi - a.lo) - (b.hi - b.lo)) < 0.04
    ordered = resample.order_interval(resample.replicate_f1(drawn, ["a"]), F.col("f1_a"), 100).first()
    values = sorted(r.f1_a for r in resample.replicate_f1(drawn, ["a"]).collect())
    assert (ordered.ci_lower, ordered.ci_upper) == (values[2], values[97])


def test_poisson_weight_has_mean_one(spark):
    from tagloom.functions.text import hash_hex

    w = spark.range(20_000).select(resample.poisson_weight(hash_hex("x", F.col("id"))).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(w.m - 1) < 0.03 and abs(w.v - 1) < 0.06


def test_poisson_passes_equal_the_column(spark):
    """The pass over batches gives the weights of the column expression."""
    from tagloom.functions.text import hash_hex

    want = {r.id: [r[f"w{i}"] for i in range(5)] for r in spark.range(300).select("id", *[
        resample.poisson_weight(hash_hex("x", F.lit(i), F.col("id"))).alias(f"w{i}") for i in range(5)]).collect()}
    got = resample.poisson_weights([str(i) for i in range(300)], 5, "x")
    assert {i: list(map(int, got[i])) for i in range(300)} == want
    units = spark.createDataFrame([], "u long, tp_a long, n_pred_a long, n_gold_a long")
    assert resample.poisson_replicates(units, "u", 5, "x", ["a"]).count() == 0


def test_too_many_draws_become_weights(spark):
    units = spark.range(40).select("id", *[(F.col("id") % 5 + i).alias(c) for i, c in enumerate(("tp_a", "n_pred_a", "n_gold_a"))])
    numbered = resample.numbered(units, "id")
    few, many = (resample.draw_replicates(numbered, 30, "s", ["a"], most_draws=n, few_units=0).collect() for n in (10**6, 100))
    assert len(few) == len(many) == 30 and sorted(map(tuple, few)) != sorted(map(tuple, many))
    assert sorted(map(tuple, many)) == sorted(map(tuple, resample.poisson_replicates(numbered, "k", 30, "s", ["a"]).collect()))


def test_draws_in_place_equal_the_table_of_draws(spark):
    units = spark.range(57).select("id", *[(F.col("id") % 5 + i).alias(f"{c}_{m}") for m in "ab" for i, c in enumerate(("tp", "n_pred", "n_gold"))])
    numbered = resample.numbered(units, "id")
    place, table = (resample.draw_replicates(numbered, 40, "s", ["a", "b"], few_units=n).select("it", "tp_a", "n_gold_a", "n_pred_b") for n in (100, 0))
    assert sorted(map(tuple, place.collect())) == sorted(map(tuple, table.collect())) and place.count() == 40
    assert resample.draw_replicates(numbered.limit(0), 40, "s", ["a", "b"]).count() == 0
