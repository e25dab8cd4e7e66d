import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tagloom.functions import prompts, text, tokens
from tagloom.operators import features, forgetting, predict, ranking, records, selection, splits, subsets


@pytest.mark.parametrize(("fn", "given", "want"), [
    (text.act_key, " Ato_Nomeação ", "nomeacao"), (text.act_key, "SEM_EFEITO", "sem_efeito"), (text.act_key, "Cessão", "cessao"),
    (text.label_key, "\tCargo ", "cargo"), (text.split_key, " Validation", "dev"), (text.split_key, "VALID", "dev"), (text.split_key, "Train ", "train"),
    (text.pub_no, "DOX nº 00001001", 1001), (text.pub_no, "dox", None), (text.pub_no, "1" * 19, int("1" * 19)), (text.pub_no, "9" * 19, None), (text.pub_no, "", None), (text.pub_key, "n. 00" + "7" * 25, "7" * 25),
    (text.pub_key, "000", "0"), (text.pub_key, "x", None), (text.pub_key, None, None), (text.pub_no, "0", 0),
    (text.source_key, " Diario_Central ", "diario-central"), (text.source_key, "camara local", "camara-local"),
    (text.words, "Nº 12-Ação, é ÇA", ["n", "12", "acao", "e", "ca"]), (text.words, "", []), (text.chars, None, 0), (text.chars, "é😀", 2),
    (text.act_key, None, None),
])
def test_text_columns(spark, fn, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(fn(F.col("x")).alias("y")).first().y == want


def test_token_attributes_match_python(spark):
    words = ["Nº12-Ação", "ABC", "Abc", "abc", "aBC", "12", "²", "1a", "O'Brien", "ÀÉ", "Éa", "x", "-", "", "Ǆ", "3º", "Ab Cd", "AbCd", "ª", "McX"]
    w = F.col("w")
    rows = spark.createDataFrame([(x,) for x in words], "w string").select(
        "w", tokens.is_upper(w).alias("u"), tokens.is_title(w).alias("t"), tokens.is_digit(w).alias("d"), tokens.has_digit(w).alias("h"),
        tokens.has_punct(w).alias("p"), tokens.shape(w).alias("s"), *[c.alias(n) for n, c in tokens.affixes(w).items()]).collect()
    for r in rows:
        x = r.w
        assert (r.u, r.t, r.d) == (x.isupper(), x.istitle(), x.isdigit()), x
        assert (r.h, r.p) == (any(c.isdigit() for c in x), any(not c.isalnum() for c in x)), x
        assert (r.suffix3, r.suffix2, r.prefix2, r.prefix3) == (x[-3:], x[-2:], x[:2], x[:3]), x
    assert next(r.s for r in rows if r.w == "Nº12-Ação") == "Xºdd-Xxxx"


def test_token_features_know_their_neighbours(spark):
    docs = spark.createDataFrame([(1, ["Um", "DOIS", "3"]), (2, []), (3, ["x"])], "id int, tokens array<string>")
    got = {(r.id, r.pos): r for r in features.token_features(docs, ["id"]).collect()}
    assert len(got) == 4
    assert (got[1, 0].bos, got[1, 0].eos, got[1, 0].next_isupper, got[1, 0].next2_lower, got[1, 0].prev_lower) == (True, False, True, "3", None)
    assert (got[1, 2].eos, got[1, 2].prev_lower, got[1, 2].prev2_lower) == (True, "dois", "um")
    assert (got[3, 0].bos, got[3, 0].eos) == (True, True)


def test_running_rank_and_sum_equal_a_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id int, v int").withColumn("h", text.hash52("z", F.col("id") % 400))
    got = ranking.running(df, ["k"], "h", ["id"], "v", "s", bits=4)
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(map(tuple, got.select("id", "s").collect())) == sorted(map(tuple, want.select("id", "s").collect()))
    ranks = sorted(r.r for r in ranking.running(df, [], "h", ["id"], None, "r").collect())
    assert ranks == list(range(500))
    assert ranking.running(df.limit(0), ["k"], "h", ["id"], None, "r").count() == 0


def test_ranges_grow_with_the_table():
    assert ranking.bits_for(0) == ranking.bits_for(100_000_000) == 10
    for rows in (10**9, 10**11, 10**14):
        assert rows / 2 ** ranking.bits_for(rows) <= ranking.BIN_ROWS


def test_a_small_sample_shuffles_few_rows(spark, tmp_path):
    """Ranks below a bound need only the bins that reach below it, in one group and in several."""
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("k"), text.hash52("z", F.col("id")).alias("h"))
    for keys in ([], ["k"]):
        want = sorted((r.id, r.r) for r in ranking.running(df, keys, "h", ["id"], None, "r").where("r < 30").collect())
        assert want == sorted((r.id, r.r) for r in ranking.running(df, keys, "h", ["id"], None, "r", below=30).collect())
    few = subsets.sample_n(df, "id", 30, "s")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 30 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_huge_group_is_ranked_in_small_ranges(spark, monkeypatch):
    """All rows in one group: no range is larger than a few times the stated number of rows."""
    monkeypatch.setattr(ranking, "BIN_ROWS", 50)
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id"), text.hash52("z", F.col("id")).alias("h"))
    bits = ranking.bits_for(df.count())
    assert df.groupBy(ranking.hash_bin("h", bits)).count().agg(F.max("count")).first()[0] < 200
    got = ranking.running(df, ["k"], "h", ["id"], None, "r")
    assert got.select("r").distinct().count() == 200_000 and got.agg(F.max("r")).first()[0] == 199_999


def plain_split(groups):
    """Groups (size, in order) to splits by filling."""
    n = sum(groups)
    n_test, n_dev = round(0.15 * n), round(0.15 * n)
    train = dev = 0
    out = []
    for g in groups:
        if train < n - n_test - n_dev:
            train += g
            out.append("train")
        elif dev < n_dev:
            dev += g
            out.append("dev")
        else:
            out.append("test")
    return out


@pytest.mark.parametrize("bits", [2, 10])
def test_stratified_split(spark, bits):
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "y", "z"]), f"text {rng.randrange(60)}") for i in range(240)]
    docs = spark.createDataFrame(rows, "id int, act string, text string").withColumn("body", F.md5("text"))
    got = splits.stratified_split(docs, "act", "body", bits=bits)
    placed = {r.id: r.split for r in got.collect()}
    assert len(placed) == 240
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for act in "xyz":
        bodies = {}
        for i, a, b in rows:
            if a == act:
                bodies.setdefault(md5(b), []).append(i)
        order = sorted(bodies, key=lambda h: (int(md5(f"42|{h}")[:13], 16), h))
        want = plain_split([len(bodies[h]) for h in order])
        assert {placed[i] for h, s in zip(order, want) for i in bodies[h] if s == "train"} <= {"train"}
        assert all(placed[i] == s for h, s in zip(order, want) for i in bodies[h])
    stats = {r.act: r for r in splits.split_stats(got, "act").collect()}
    assert stats[None].total == 240 and stats[None].train == sum(s == "train" for s in placed.values())
    assert splits.split_stats(got.limit(0), "act").count() <= 1


def test_compat_split_overshoots_like_a_greedy_fill():
    got = splits.compat_split([("a", 6), ("b", 5), ("c", 1)])
    assert set(got) == {"a", "b", "c"} and set(got.values()) <= {"train", "dev", "test"}
    assert plain_split([6, 5, 1]) == ["train", "train", "dev"]


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (10, (6, 2, 2)), (20, (14, 3, 3)), (30, (22, 4, 4)), (100, (70, 15, 15))])
def test_target_sizes(spark, n, want):
    docs = spark.range(n).select(F.lit("x").alias("act"), F.md5(F.col("id").cast("string")).alias("body"))
    c = {r.split: r["count"] for r in splits.stratified_split(docs, "act", "body").groupBy("split").count().collect()}
    assert tuple(c.get(s, 0) for s in splits.SPLITS) == want


def test_records_fan_out(spark):
    docs = spark.createDataFrame([(1, "x", ["Ana", "veio"], ["B-nome", "O"]), (2, "z", ["a"], ["O"]), (3, "x", None, None)], "id int, act string, tokens array<string>, tags array<string>")
    schema = spark.createDataFrame([("x", ["cargo", "nome"])], "act string, etypes array<string>")
    got = {(r.id, r.entity_type): r for r in records.fan_out(docs, schema, ["id"]).collect()}
    assert set(got) == {(1, "cargo"), (1, "nome"), (3, "cargo"), (3, "nome")}
    assert got[1, "nome"].output == "Ana(B-nome) veio(O)" and not got[1, "nome"].is_negative
    assert got[1, "cargo"].output == "Ana(O) veio(O)" and got[1, "cargo"].is_negative
    assert got[3, "nome"].input == "" and "token2(B-nome)" in got[1, "nome"].instruction_fmt
    assert records.schema_by_act(docs.where("id < 3")).collect() == [Row(act="x", etypes=["nome"])]


def test_slice_documents_takes_the_last_and_counts_misses(spark):
    recs = spark.createDataFrame([(1, 7, "x", "a", ["O", "O", "O"]), (2, 8, "x", "a", ["O"]), (3, None, "x", "a", ["O"])], "idx int, publication int, act string, entity_type string, gold array<string>")
    labels = spark.createDataFrame([(7, "x", 1, ["O"]), (7, "x", 2, ["B-a", "I-b"])], "publication int, act string, n int, labels array<string>")
    got = predict.slice_documents(recs, labels, ["publication", "act"], "n")
    assert {r.idx: (r.pred, r.matched) for r in got.collect()} == {1: (["B-a", "O", "O"], True), 2: (["O"], False), 3: (["O"], False)}
    assert predict.unmatched(got).first() == Row(records=3, missing=2)


def test_scorer_runs_in_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "idx int, input string")
    got = predict.score(df, lambda frame: frame["input"].str.upper(), workers=3)
    assert {r.idx: r.gen for r in got.collect()} == {i: f"T{i}" for i in range(10)}


def test_subsets(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a = {r.k for r in subsets.sample_n(df, "k", 12, "s").collect()}
    assert len(a) == 12 and a == {r.k for r in subsets.sample_n(df.repartition(7), "k", 12, "s").collect()}
    assert subsets.sample_n(df, "k", 500, "s").count() == 50
    assert subsets.fraction(df, "k", 0.25, "s").count() == 12  # 12.5 to even
    assert subsets.fraction(df.limit(1), "k", 0.01, "s").count() == 1
    assert subsets.first_rows(df, "k", 3).count() == 3


def test_demonstrations_and_prompts(spark):
    rows = [(i, "x", "a", i % 2 == 0, f"I{i}", f"in{i}", f"out{i}") for i in range(9)]
    recs = spark.createDataFrame(rows, "id int, act string, entity_type string, is_negative boolean, instruction string, input string, output string")
    demos = subsets.demonstrations(recs, ["act", "entity_type"], "id", 2, "d")
    assert demos.count() == 2 and demos.where("is_negative").count() == 0
    pool = subsets.demo_pool(demos, ["act", "entity_type"]).first().demos
    q = spark.createDataFrame([(1, [tuple(p) for p in pool]), (2, None)], "id int, demos array<struct<place:int,instruction:string,input:string,output:string>>")
    got = {r.id: r for r in q.select("id", prompts.chat(prompts.few_shot(F.col("demos"), F.lit("Q"))).alias("p")).collect()}
    assert got[2].p == "<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n"
    assert got[1].p.count("<|im_start|>user") == 3 and got[1].p.endswith(got[2].p)
    assert prompts.budget(0) == 1536 and prompts.budget(3) == 1024 * 4 + 160
    t = spark.createDataFrame([("a  b c d",)], "t string")
    assert t.select(prompts.keep_end(F.col("t"), 2).alias("x"), prompts.keep_end(F.col("t"), 4).alias("y")).first() == Row(x="c d", y="a  b c d")


def test_prompts_are_cut_by_any_tokenizer(spark):
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    df = spark.createDataFrame([(1, "abcdef"), (2, "ab"), (3, None), (4, "")], "id int, p string")
    assert {r.id: r.p for r in prompts.keep_last_tokens(df, "p", 3, Letters).collect()} == {1: "def", 2: "ab", 3: None, 4: ""}


def test_last_result_by_path(spark):
    df = spark.createDataFrame([("a", "r/2.json"), ("a", "r/10.json"), ("b", None), ("c", "x")], "run string, path string")
    assert {r.run: r.path for r in selection.last_result(df, ["run"], "path").collect()} == {"a": "r/2.json", "c": "x"}


def test_checkpoint_choice(spark):
    rows = [("a", s, f) for s, f in ((50, 0.9), (100, 0.9), (150, None))] + [("t", s, 0.1) for s in (40, 60, 150)]
    c = spark.createDataFrame(rows, "run string, step bigint, dev_f1 double")
    got = {}
    for r in selection.candidates(c).collect():
        got.setdefault(r.run, set()).add(r.step)
    assert got == {"a": {50, 100, 150}, "t": {40, 60, 150}} or got["t"] == {40, 60, 150}
    assert {r.run: r.step for r in selection.best(c).collect()} == {"a": 50, "t": 40}
    done = c.withColumn("ok", F.col("step") < 150)
    assert {r.run: r.step for r in selection.latest(done, "ok").collect()} == {"a": 100, "t": 60}


def test_benchmark_rules(spark):
    df = spark.createDataFrame([(0.99,), (-1.0,), (2.99,), (3.0,), (None,)], "d double")
    assert [r.b for r in df.select(forgetting.band(F.col("d")).alias("b")).collect()] == ["negligible", "moderate", "moderate", "SIGNIFICANT", "N/A"]
    m = spark.createDataFrame([({"acc,none": 0.7},), ({"x": 0.1},), ({"acc_norm,none": None, "acc,none": 0.2},)], "m map<string,double>")
    assert [r.v for r in m.select(forgetting.first_available(F.col("m"), ["acc_norm,none", "acc,none"]).alias("v")).collect()] == [0.7, None, 0.2]
    res = spark.createDataFrame([("m", "core", {"b": 0.1}), ("m", "ext", {"b": 0.3, "c": None}), ("m", "ext", {"b": 0.3, "c": None})], "tag string, f string, scores map<string,double>")
    assert {r.bench: r.score for r in forgetting.long_scores(res, "f", ["tag"]).collect()} == {"b": 0.3, "c": None}


def test_first_subtoken(spark):
    rows = [(1, i, w, 5) for i, w in enumerate([None, 0, 0, 1, None])]
    df = spark.createDataFrame(rows, "doc int, pos int, word_id int, label_id int")
    assert [r.target for r in features.first_subtoken(df, ["doc"]).orderBy("pos").collect()] == [-100, 5, -100, 5, -100]
