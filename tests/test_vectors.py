"""Published unit vectors of the collapse and statistic operators."""

import math

import pytest
from pyspark.sql import functions as F

from rankfield.operators import idmap, measures, select

NAN = float("nan")
VECTORS = {
    "allPos": [5.1, 33.0, 3, 0.1, 99.4],
    "allNeg": [-8.15, -43.8, -3.6, -0.1, -192.6],
    "mixPosNeg": [5.1, 33.0, 3, -0.1, -192.6],
    "mixHasNaNs": [5.1, 33.0, NAN, NAN, -192.6],
}
EXPECTED = {
    "allPos": (99.4, 140.6, 28.12, 5.1),
    "allNeg": (-0.1, -248.25, -49.65, -8.15),
    "mixPosNeg": (33.0, -151.6, -30.32, 3),
    "mixHasNaNs": (33.0, -154.5, -51.5, 5.1),
}
SMALL = {
    "small": (
        ["allPos", "allNeg", "mixPosNeg"],
        {
            "max": [5.1, 33.0, 3, 0.1, 99.4],
            "sum": [2.05, 22.2, 2.4, -0.1, -285.8],
            "mean": [0.68333, 7.4, 0.8, -0.033333, -95.26667],
            "median": [5.1, 33.0, 3, -0.1, -192.6],
        },
    ),
    "smallWithNaN": (
        ["allPos", "allNeg", "mixHasNaNs"],
        {
            "max": [5.1, 33.0, 3, 0.1, 99.4],
            "sum": [2.05, 22.2, -0.6, 0.0, -285.8],
            "mean": [0.68333, 7.4, -0.3, 0.0, -95.2667],
            "median": [5.1, 33.0, -0.3, 0.0, -192.6],
        },
    ),
}


def cells(spark, names):
    rows = [
        (r, n, f"s{k}", None if math.isnan(v) else float(v))
        for r, n in enumerate(names)
        for k, v in enumerate(VECTORS[n])
    ]
    return spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double")


def test_statistics(spark):
    out = measures.missing_safe_stats(cells(spark, list(VECTORS))).collect()
    for row in out:
        want = EXPECTED[row["feature"]]
        got = (row["max"], row["sum"], row["mean"], row["median"])
        assert got == pytest.approx(want, abs=2e-4)


def test_all_missing_is_missing(spark):
    df = spark.createDataFrame(
        [(0, "x", "s0", None)], "row_idx long, feature string, sample string, value double"
    )
    row = measures.missing_safe_stats(df).head()
    assert row["mean"] is None and row["median"] is None and row["max"] is None


@pytest.mark.parametrize("group", list(SMALL))
@pytest.mark.parametrize("mode", ["max", "sum", "mean", "median"])
def test_collapse(spark, group, mode):
    names, want = SMALL[group]
    id_map = spark.createDataFrame([(n, "SYM", "t") for n in names], "probe string, symbol string, title string")
    out = idmap.collapse(cells(spark, names), id_map, mode).orderBy("sample").collect()
    assert [r["value"] for r in out] == pytest.approx(want[mode], abs=2e-4)


def test_collapse_absmax_keeps_sign_and_first(spark):
    rows = [(0, "a", "s", 3.0), (1, "b", "s", -5.0), (2, "c", "s", 5.0), (0, "a", "t", None)]
    df = spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double")
    id_map = spark.createDataFrame([(p, "X", "") for p in "abc"], "probe string, symbol string, title string")
    got = {r["sample"]: r["value"] for r in idmap.collapse(df, id_map, "absmax").collect()}
    assert got == {"s": -5.0, "t": None}


def test_remap_refuses_two_probes(spark):
    rows = [(0, "a", "s", 3.0), (1, "b", "s", -5.0)]
    df = spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double")
    id_map = spark.createDataFrame([("a", "X", ""), ("b", "X", "")], "probe string, symbol string, title string")
    with pytest.raises(Exception, match="several probes"):
        idmap.remap_only(df, id_map).collect()
    assert idmap.remap_conflicts(df, id_map).head()["n_probes"] == 2


def test_median_of_large_groups(spark):
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(7) / 2) for _ in range(900)]
    rows += [("k1", None)] * 3
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in select.group_median(df, ["k"], "v", "m").collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf")]


def test_images_keep_the_order_of_doubles(spark):
    import struct

    import numpy as np

    rng = np.random.default_rng(1)
    anything = rng.integers(0, 2**63, 3000).view(np.float64)
    powers = [p for e in range(-1073, 1024) for p in (2.0**e, float(np.nextafter(2.0**e, 0)))]
    values = [float(x) for x in np.concatenate([anything, -anything, powers, ODD]) if x == x]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    for r in df.select("v", select.ordered_image(F.col("v")).alias("image")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["image"] == (-bits if r["v"] < 0 else bits)
    more = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    nan, inf, none = [r[0] for r in more.select(select.ordered_image(F.col("v"))).collect()]
    assert nan > inf and none is None


@pytest.mark.parametrize("spread", [0, 3, 1 << 16])
def test_median_by_digits_and_by_window(spark, spread):
    """Groups of all sizes, told apart by digits, by the window, or some by each."""
    import random

    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9)) for _ in range(600)]
    rows += [("near", 1.0 + k * 2.0**-52) for k in range(10)]  # apart in the last digits only
    rows += [("two", -1.0), ("two", 3.0), ("one", 5.0), ("same", 2.5), ("same", 2.5), ("none", None), ("k1", None)]
    rows += [("odd", x) for x in (*ODD, ODD[0], float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in select.group_median(df, ["k"], "v", "m", spread).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_places_outside_a_group_have_no_row(spark):
    counted = spark.createDataFrame([("a", 1.0, 2), ("a", 7.0, 1), ("b", 3.0, 1)], "k string, v double, _c long")
    places = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("c", 0)], "k string, _place long")
    got = sorted((r["k"], r["_place"], r["v"]) for r in select.select_places(counted, places, ["k"], "v").collect())
    assert got == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 7.0), ("b", 0, 3.0)]


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Shuffles have as many tasks as the files behind a table need, with the same medians, skewed groups included."""
    from rankfield import session

    rows = [(k % 7, f"p{k % 40}", f"s{k % 3 if k % 5 else 0}", float(k * 7919 % 101) if k % 11 else None) for k in range(3000)]
    spark.createDataFrame(rows, "row_idx long, feature string, sample string, value double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    id_map = spark.createDataFrame([(f"p{k}", f"y{k % 4}" if k % 9 else "") for k in range(40)], "probe string, symbol string")
    assert session.tasks_for(df) is None and session.tasks_for(id_map) is None

    def run(mode):
        return sorted(map(tuple, idmap.collapse(df, id_map, mode).select("feature", "sample", F.round("value", 9)).collect()))

    plain = {m: run(m) for m in ("median", "max")}
    wide = sorted(map(tuple, select.group_median(df, ["sample"], "value", "m", spread=5).collect()))
    monkeypatch.setattr(session, "TASK_BYTES", 200)
    n = session.tasks_for(df)
    assert n > 8 and session.spread(df, n, "feature").rdd.getNumPartitions() == n
    assert idmap.collapse(df, id_map, "max").rdd.getNumPartitions() == n
    assert {m: run(m) for m in plain} == plain
    assert sorted(map(tuple, select.group_median(df, ["sample"], "value", "m", spread=5).collect())) == wide
