"""Embargoed folds, rolling windows and splits by name."""

import pytest

from tickloom.operators import splits as P


def test_embargoed_folds(spark):
    rows = [(i, float(i * 10), float(i * 10 + 15)) for i in range(11)]
    got = P.embargoed_folds(spark.createDataFrame(rows, "id long, t double, known double"), "t", "known", 3, 0.1).collect()
    role = {(x["fold"], x["id"]): x["role"] for x in got}
    assert P.even_bounds(11, 3) == [(0, 4), (4, 8), (8, 11)]
    assert [i for i in range(11) if role.get((1, i)) == "test"] == [4, 5, 6, 7]
    # The fold spans 40..70, embargo 3: labels known before 37 or after 73.
    assert [i for i in range(11) if role.get((1, i)) == "train"] == [0, 1, 2, 8, 9, 10]
    assert [i for i in range(11) if role.get((0, i)) == "train"] == [4, 5, 6, 7, 8, 9, 10]


def test_rolling_windows():
    assert P.rolling_windows(5, 7, 3) == [(0, "train", 0, 5), (0, "trade", 5, 8), (1, "train", 3, 8), (1, "trade", 8, 11), (2, "train", 6, 11), (2, "trade", 11, 12)]
    assert P.rolling_windows(5, 2, 9) == [(0, "train", 0, 5), (0, "trade", 5, 7)] and P.rolling_windows(5, 0, 3) == []


def test_split_by_name(spark):
    df = spark.range(20).withColumnRenamed("id", "t")
    assert sorted(map(tuple, P.split_by(df, "holdout", "t", share=0.25).collect())) == [(0, "test", 15, 20), (0, "train", 0, 15)]
    assert P.split_by(df, "purged", "t", folds=4, purge=1, embargo=2).where("split_id = 1").count() == 3
    assert P.split_by(df, "cpcv", "t", folds=4).where("role = 'test'").count() == 12
    assert P.split_by(df, "walk_forward", "t", folds=4).select("split_id").distinct().count() == 3
    with pytest.raises(ValueError):
        P.split_by(df, "other", "t")
