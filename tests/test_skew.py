import pytest

from tagloom.operators.skew import join_unique


@pytest.mark.parametrize("share", [3, 50, 2000])
def test_join_unique_equals_a_join(spark, share):
    rows = [("hot", i) for i in range(700)] + [(f"k{i % 90}", i) for i in range(300)] + [(None, 1), ("alone", 2)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1.0), (None, 2.0), ("unused", 3.0)] + [(f"k{i}", float(i)) for i in range(60)], "k string, w double")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, join_unique(left, right, ["k"], share).collect())) == want
    outer = left.join(right, "k", "left").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, join_unique(left, right, ["k"], share, "left").collect()), key=key) == sorted(map(tuple, outer), key=key)
    assert join_unique(left.limit(0), right, ["k"]).count() == 0
    assert join_unique(left, right.limit(0), ["k"], share).count() == 0
