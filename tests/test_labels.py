"""Metrics and permuted labellings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.operators import label_null, leading, metrics, nulls, permute
from rankfield.operators import labels as lab
from rankfield.plans import runs


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    n_rows, n = 60, 16
    values = rng.normal(3, 2, (n_rows, n))
    values[rng.random((n_rows, n)) < 0.15] = np.nan
    values[0, :8] = np.nan  # no value in class 0
    rows = [
        (r, f"f{r}", c, f"s{c}", None if np.isnan(values[r, c]) else float(values[r, c]))
        for r in range(n_rows)
        for c in range(n)
    ]
    features = spark.createDataFrame(
        rows, "row_idx long, feature string, sample_idx long, sample string, value double"
    )
    profile = rng.normal(0, 1, n)
    labels = spark.createDataFrame(
        [
            ("p", f"s{c}", c, "A" if c < 8 else "B", 0 if c < 8 else 1, float(profile[c]))
            for c in range(n)
        ],
        "phenotype string, sample string, position long, class_name string, class_idx int, num_value double",
    )
    sets = spark.createDataFrame(
        [(f"S{k}", f"f{r}") for k in range(6) for r in range(k, n_rows, k + 2)],
        "set_name string, member string",
    )
    return values, profile, features, labels, sets


def floor_sd(sd, m):
    return max(sd, 0.2 if abs(m) <= 1e-9 else 0.2 * abs(m))


def test_class_metrics(matrix):
    values, _, features, labels, _ = matrix
    for name in metrics.CLASS_METRICS:
        got = {r["row_idx"]: r["score"] for r in metrics.class_metric(name, features, labels).collect()}
        for r in range(len(values)):
            a = values[r, :8][~np.isnan(values[r, :8])]
            b = values[r, 8:][~np.isnan(values[r, 8:])]
            if len(a) == 0 or len(b) == 0:
                assert got[r] == 0.0
                continue
            sa = floor_sd(a.std(ddof=1) if len(a) > 1 else 0.0, a.mean())
            sb = floor_sd(b.std(ddof=1) if len(b) > 1 else 0.0, b.mean())
            ratio = a.mean() / b.mean()
            want = {
                "signal_to_noise": (a.mean() - b.mean()) / (sa + sb),
                "t_test": (a.mean() - b.mean()) / np.sqrt(sa**2 / len(a) + sb**2 / len(b)),
                "ratio_of_classes": ratio,
                "diff_of_classes": a.mean() - b.mean(),
                "log2_ratio_of_classes": np.log2(ratio) if ratio > 0 else None,
            }[name]
            assert got[r] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_reversed_labels_flip_the_sign(matrix):
    _, _, features, labels, _ = matrix
    for name in ("signal_to_noise", "t_test", "diff_of_classes"):
        there = {r["row_idx"]: r["score"] for r in metrics.class_metric(name, features, labels).collect()}
        back = metrics.class_metric(name, features, lab.labels_reversed(labels)).collect()
        for r in back:
            assert r["score"] == pytest.approx(-there[r["row_idx"]], abs=1e-12)


def test_profile_metrics(matrix):
    values, profile, features, labels, _ = matrix

    def ranks(x):
        return np.array([1 + (x > v).sum() + ((x == v).sum() - 1) / 2 for v in x])

    for name, metric in metrics.PROFILE_METRICS.items():
        got = {r["row_idx"]: r["score"] for r in metric(features, labels).collect()}
        for r in range(len(values)):
            ok = ~np.isnan(values[r])
            x, y = values[r][ok], profile[ok]
            want = {
                "pearson": np.corrcoef(x, y)[0, 1],
                "spearman": np.corrcoef(ranks(x), ranks(y))[0, 1],
                "cosine_distance": 1 - x @ y / np.sqrt((x @ x) * (y @ y)),
                "euclidean_distance": np.sqrt(((x - y) ** 2).sum()),
                "manhattan_distance": np.abs(x - y).sum(),
            }[name]
            assert got[r] == pytest.approx(want, abs=1e-9), (name, r)


CUTS = {"tile_cells": 100, "perm_block": 4, "range_rows": 7, "block_members": 25}


def es_of(df):
    return {(r["set_name"], r["perm"]): r["es"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and want
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7), k


@pytest.mark.parametrize("metric", [*metrics.CLASS_METRICS, *metrics.PROFILE_METRICS])
def test_label_null_of_every_metric(matrix, metric):
    _, _, features, labels, sets = matrix
    plan = es_of(nulls.null_by_labels_plan(features, labels, sets, 9, 2, metric))
    assert len(plan) == 54
    same(es_of(nulls.null_by_labels(features, labels, sets, 9, 2, metric)), plan)
    # many tiles, ranges of the ranking, blocks of permutations and of sets give the same numbers
    same(es_of(nulls.null_by_labels(features, labels, sets, 9, 2, metric, **CUTS)), plan)


@pytest.mark.parametrize("metric", ["pearson", "spearman", "manhattan_distance"])
def test_label_null_of_profiles_with_gaps(matrix, metric):
    _, _, features, labels, sets = matrix
    gaps = labels.withColumn("num_value", F.when(F.col("position") % 3 != 1, F.col("num_value")))
    plan = es_of(nulls.null_by_labels_plan(features, gaps, sets, 6, 2, metric))
    same(es_of(nulls.null_by_labels(features, gaps, sets, 6, 2, metric)), plan)
    same(es_of(nulls.null_by_labels(features, gaps, sets, 6, 2, metric, **CUTS)), plan)


OPTIONS = [
    {"mode": "absolute"}, {"ascending": True}, {"fix_low": False}, {"biased": True}, {"median": True}, {"scheme": "weighted_p1.5"},
    {"metric": "diff_of_classes", "median": True, "kind": "equalize_and_balance"}, {"scheme": "classic", "mode": "absolute", "ascending": True},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_label_null_options(matrix, options):
    _, _, features, labels, sets = matrix
    plan = es_of(nulls.null_by_labels_plan(features, labels, sets, 4, 2, **options))
    same(es_of(nulls.null_by_labels(features, labels, sets, 4, 2, **options)), plan)
    same(es_of(nulls.null_by_labels(features, labels, sets, 4, 2, **options, **CUTS)), plan)


def test_label_null_of_tied_scores(spark):
    """A third of all scores is 0: ranges cut ties by row."""
    rng = np.random.default_rng(4)
    cells = [(f"f{r}", r * 10, f"s{c}", float(rng.normal()) if r % 3 else 1.0) for r in range(300) for c in range(12)]
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, value double")
    labels = spark.createDataFrame([(f"s{c}", c % 2) for c in range(12)], "sample string, class_idx int")
    members = [("THIRD", f"f{r}") for r in range(0, 300, 3)] + [("FEW", f"f{r}") for r in (1, 50, 299)] + [("NONE", "zz")]
    sets = spark.createDataFrame(members + members[:20], "set_name string, member string")
    kept = sets.distinct()
    plan = es_of(nulls.null_by_labels_plan(features, labels, kept, 5, 7))
    same(es_of(nulls.null_by_labels(features, labels, sets, 5, 7, range_rows=9, perm_block=2, block_members=40)), plan)
    ranked = nulls.permuted_lists(nulls.permuted_scores(features, labels, 1, 7))
    keys = label_null.order_keys(np.array([r.score for r in ranked.collect()]), "real", False)
    assert np.bincount(np.unique(keys, return_inverse=True)[1]).max() >= 100
    assert nulls.null_by_labels(features, labels, sets, 0).collect() == []
    assert nulls.null_by_labels(features.limit(0), labels, sets, 3).collect() == []


@pytest.mark.parametrize("metric", ["signal_to_noise", "pearson"])
def test_scores_by_labels(matrix, metric):
    _, _, features, labels, _ = matrix

    def of(df):
        return {(r["perm"], r["feature"], r["row_idx"]): r["score"] for r in df.collect()}

    plan = of(nulls.permuted_scores(features, labels, 5, 3, metric))
    for got in (label_null.scores_by_labels(features, labels, 5, 3, metric), label_null.scores_by_labels(features, labels, 5, 3, metric, tile_cells=100, perm_block=2)):
        same(of(got), plan)
    assert label_null.scores_by_labels(features, labels, 0).collect() == []


def test_ranges_split_ties():
    keys, rows = np.array([0.0, 1, 1, 1, 1, 2, 5]), np.arange(7)
    got = label_null.range_of(keys, rows, np.array([1.0, 1.0, 2.0]), np.array([2, 4, 1]))
    assert got.tolist() == [0, 0, 1, 1, 2, 3, 3]


def test_permuted_class_sizes(matrix):
    _, _, _, labels, _ = matrix
    for kind, stay in (("no_balance", None), ("balance_class0", 4), ("balance_class1", 4), ("equalize_and_balance", 4)):
        out = permute.permute_labels(labels, 6, 1, kind).join(
            labels.withColumnRenamed("class_idx", "was").select("sample", "was"), "sample"
        ).collect()
        for p in range(6):
            mine = [r for r in out if r["perm"] == p]
            assert len(mine) == 16 and sum(r["class_idx"] == 0 for r in mine) == 8
            if stay:
                assert sum(r["class_idx"] == 0 and r["was"] == 0 for r in mine) == stay


def test_impossible_balance_fails(matrix):
    _, _, _, labels, _ = matrix
    few = labels.filter("position < 9")  # 8 of class 0, 1 of class 1
    with pytest.raises(Exception, match="class sizes"):
        permute.permute_labels(few, 2, 1, "balance_class0").collect()


def test_permuted_profile_is_a_permutation(matrix):
    _, profile, _, labels, _ = matrix
    out = permute.permute_numeric_profile(labels, 3, 1).collect()
    for p in range(3):
        assert sorted(r["num_value"] for r in out if r["perm"] == p) == pytest.approx(sorted(profile))


def test_matrix_run_end_to_end(matrix):
    _, _, features, labels, sets = matrix
    run = runs.enrich_matrix(features, labels, sets, nperm=40, set_min=2, set_max=100, seed=1)
    rows = run.results.collect()
    assert len(rows) == 6
    for r in rows:
        assert -1 <= r["es"] <= 1
        for c in ("np", "fdr", "fwer"):
            assert r[c] is None or 0 <= r[c] <= 1
    assert run.ranked.count() == 59  # one feature lacks class 0
    out = runs.leading_edge(run, sets.select("set_name"))
    cells = {(r["a"], r["b"]): r["jaccard"] for r in out["jaccard"].collect()}
    # cells of sets that share a member; the others are 0 and have no row
    edges = {r["set_name"]: set() for r in rows}
    for r in leading.leading_edge_members(run.hits, run.results).collect():
        edges[r["set_name"]].add(r["feature"])
    want = {(a, b): len(x & y) / len(x | y) for a, x in edges.items() for b, y in edges.items() if x & y}
    assert cells.keys() == want.keys() and all(cells[k] == pytest.approx(v) for k, v in want.items())
    assert runs.leading_edge(run)["members"].count() == run.sets.count()
    numeric = runs.enrich_matrix(features, labels, sets, metric="spearman", nperm=5, set_min=2, set_max=100)
    assert numeric.results.count() == 6


@pytest.mark.parametrize("kind", permute.KINDS)
def test_permuted_labels_by_heads(spark, kind):
    """Heads of any length choose what a whole sort chooses; repeated, unnamed and unlabelled samples too."""
    import hashlib

    rows = [(f"s{c % 290}" if c % 50 else None, [0, 1, 1][c % 3]) for c in range(300)] + [("x", None)]
    labels = spark.createDataFrame(rows, "sample string, class_idx int")
    n0, n1 = 100, 200
    from0 = {"balance_class0": n0 // 2, "balance_class1": n0 - n1 // 2, "equalize_and_balance": n0 - n0 // 2}.get(kind)
    want = []
    for p in range(3):
        keyed = sorted(
            (hashlib.md5(":".join(x for x in ("5", str(p), s) if x is not None).encode()).hexdigest(), s or "", s, k) for s, k in rows if kind == "no_balance" or k is not None
        ) if kind == "no_balance" else None
        for k in [None] if kind == "no_balance" else [0, 1]:
            group = keyed or sorted((hashlib.md5(":".join(x for x in ("5", str(p), s) if x is not None).encode()).hexdigest(), s or "", s, c) for s, c in rows if c == k)
            limit = n0 if k is None else from0 if k == 0 else n0 - from0
            want += [(p, s, 0 if at < limit else 1) for at, (_, _, s, _) in enumerate(group)]
    for bucket_rows in (1, 4096):
        out = permute.permute_labels(labels, 3, 5, kind, bucket_rows=bucket_rows).collect()
        assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_permuted_profile_by_heads(spark):
    import hashlib

    rows = [(q if c else None, f"s{c % 390}", 400 - c, float(c)) for q in "pq" for c in range(400)]
    labels = spark.createDataFrame(rows, "phenotype string, sample string, position long, num_value double")
    want = []
    for q in "pq":
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1]))
        for p in range(3):
            keyed = sorted((hashlib.md5(f"5:{p}:{r[1]}".encode()).hexdigest(), r[1]) for r in mine)
            want += [(p, s, r[3]) for (_, s), r in zip(keyed, mine)]
    for bucket_rows, broadcast_values in ((1, 0), (4096, 10**6)):
        out = permute.permute_numeric_profile(labels, 3, 5, bucket_rows=bucket_rows, broadcast_values=broadcast_values).collect()
        assert sorted(map(tuple, out)) == sorted(want)


@pytest.mark.parametrize("metric", ["signal_to_noise", "t_test"])
def test_permuted_scores_of_repeated_and_odd_cells(spark, metric):
    """Tiles give what joins and aggregates give, cells not copied for every permutation."""
    rng = np.random.default_rng(6)
    cells = [(f"f{r}" if r else None, r, f"s{c}", float(rng.normal(2, 1))) for r in range(30) for c in range(20)]
    cells += cells[5:200:7] + [("f3", 3, "s1", float("nan")), ("f4", 4, "s1", float("inf")), ("f5", 5, "s1", None), ("f6", None, "s2", 1.0), ("lone", 99, "s3", 2.0)]
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, value double")
    rows = [(f"s{c % 19}", c % 2) for c in range(24)] + [(None, 0), ("other", 1)]
    labels = spark.createDataFrame(rows, "sample string, class_idx int")

    def of(df):
        return {(r.perm, r.feature, r.row_idx): "nan" if r.score is not None and np.isnan(r.score) else r.score for r in df.collect()}

    plan, got = (of(f(features, labels, 4, 5, metric)) for f in (nulls.permuted_scores_plan, nulls.permuted_scores))
    assert got.keys() == plan.keys() and list(plan.values()).count("nan") >= 4
    for k, v in plan.items():
        assert got[k] == (v if v is None or v == "nan" else pytest.approx(v, abs=1e-9))
    joins = nulls.permuted_scores(features, labels, 4, 5, metric)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in joins
