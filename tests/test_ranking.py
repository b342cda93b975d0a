import random

import pytest
from pyspark.sql import functions as F

from rankfield.operators import clean, labels, measures, rank


@pytest.mark.parametrize("offsets", [0, 200_000])
def test_numbers_with_one_hot_key(spark, monkeypatch, offsets):
    monkeypatch.setattr(rank, "BROADCAST_OFFSETS", offsets)
    rng = random.Random(1)
    rows = [
        ("A" if rng.random() < 0.7 else rng.choice("BC"), rng.choice([0.0, 0.0, 1.5, -2.0, None]), k)
        for k in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, score double, row_idx long").repartition(7)
    out = rank.number_rows(df, rank.score_order(), ["g"]).collect()
    for g in "ABC":
        want = sorted(
            (r for r in rows if r[0] == g),
            key=lambda r: (r[1] is None, -(r[1] or 0), r[2]),
        )
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["rank"])
        assert [r["row_idx"] for r in got] == [w[2] for w in want]
        assert [r["rank"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize("offsets", [0, 200_000])
@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_numbers_of_many_groups(spark, monkeypatch, offsets, parts):
    """Groups of one row, groups over many tasks, keys of two columns, rows without a group."""
    monkeypatch.setattr(rank, "BROADCAST_OFFSETS", offsets)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "", None]), rng.choice([1.5, -0.0, 7.0]), k, [k]) for k in range(1500)]
    rows += [(f"g{k}", 0.0, 10_000 + k, None) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, h double, at long, extra array<int>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    numbered = rank.number_rows(df, [F.col("at").desc()], ["g", "h"], "no", start=3)
    got = {r["at"]: r["no"] for r in numbered.collect()}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want, seen = {}, {}
    for g, h, at, _ in sorted(rows, key=lambda r: -r[2]):
        if g is not None:
            seen[g, h] = seen.get((g, h), 2) + 1
            want[at] = seen[g, h]
    assert got == want
    assert "SortMergeJoin" not in plan and ("MapInArrow" in plan) == (offsets == 0)


def test_running_total(spark):
    rows = [(k % 3, k, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o long, x double")
    out = rank.running_total(df, [F.col("o").asc()], ["g"], "x", "t").collect()
    for g in range(3):
        total = 0.0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["o"]):
            total += r["x"]
            assert r["t"] == total


def test_missing_scores_rank_last_or_first(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0), ("b", None, 1), ("c", -3.0, 2)], "feature string, score double, row_idx long"
    )

    def order(**kw):
        return [r["feature"] for r in rank.rank_features(df, **kw).orderBy("rank").collect()]

    assert order() == ["a", "c", "b"]
    assert order(ascending=True) == ["b", "c", "a"]
    assert order(mode="absolute") == ["c", "a", "b"]


def test_top_bottom_is_clipped(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 0.5, 1)], "feature string, score double, rank long")
    out = rank.top_bottom_k(df, 10).collect()
    assert sorted((r["side"], r["position"], r["feature"]) for r in out) == [
        ("bottom", 1, "b"), ("bottom", 2, "a"), ("top", 1, "a"), ("top", 2, "b"),
    ]


def test_infinite_ends(spark):
    inf, nan = float("inf"), float("nan")
    scores = [inf, nan, 3.0, inf, -1.0, -inf, None]
    df = spark.createDataFrame(
        [(f"f{k}", v, k) for k, v in enumerate(scores)], "feature string, score double, rank long"
    )
    got = [r["score"] for r in clean.adjust_infinite_ends(df).orderBy("rank").collect()]
    assert got == [1e-6, 1e-6, 3.0, inf, -1.0, -1e-6, 1e-6]


def test_zero_is_on_both_sides(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "x double")
    assert clean.sign_split(df, "x", "pos").count() == 2
    assert clean.sign_split(df, "x", "neg").count() == 2


def test_last_duplicate_row_wins(spark):
    rows = [(0, "a", "s", 1.0), (1, "b", "s", 2.0), (2, "a", "s", 3.0), (2, "a", "t", None)]
    df = spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double")
    out = clean.unique_features(df).collect()
    assert sorted((r["feature"], r["sample"], r["value"]) for r in out if r["value"]) == [
        ("a", "s", 3.0), ("b", "s", 2.0),
    ]
    assert [r["n_rows"] for r in clean.duplicate_features(df).collect()] == [2]


def test_missing_profile(spark):
    inf = float("inf")
    rows = [(0, "a", "s", 1.0), (0, "a", "t", None), (1, "b", "s", None), (2, "c", "s", inf), (2, "c", "t", 1.0)]
    df = spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double")
    r = clean.missing_value_profile(df).head()
    assert (r["n_features"], r["partly_missing"], r["all_missing"], r["has_infinite"]) == (2, 1, 1, True)
    assert clean.drop_all_missing_rows(df).select("feature").distinct().count() == 2


def test_range_mean_bins(spark):
    n, bins = 23, 7
    df = spark.createDataFrame([(f"f{k}", float(k), k) for k in range(n)], "feature string, score double, rank long")
    got = {r["bin"]: (r["mean_score"], r["n"]) for r in measures.range_mean(df, bins).collect()}
    for b in range(bins):
        part = list(range(int(b * n / bins), int((b + 1) * n / bins)))
        assert got[b] == (sum(part) / len(part), len(part))


def test_unknown_sample_is_an_error(spark):
    import pytest

    samples = spark.createDataFrame([("S1", 0), ("s2", 1)], "sample string, sample_idx long")
    chosen = spark.createDataFrame([("s1", "A", 0), ("S2", "B", 1)], "name string, class_name string, class_idx int")
    out = labels.labels_from_sample_names(samples, chosen, "p").collect()
    assert sorted((r["sample"], r["class_idx"]) for r in out) == [("S1", 0), ("s2", 1)]
    bad = chosen.union(spark.createDataFrame([("S9", "B", 1)], chosen.schema))
    with pytest.raises(Exception, match="unknown sample"):
        labels.labels_from_sample_names(samples, bad, "p").collect()
