"""What only tables larger than the samples show: runs that keep no set, wide and sparse matrices, many rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankfield.operators import label_null, nulls, rank, reports
from rankfield.plans import runs
from rankfield.sources import writers


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    scores = sorted((round(rng.gauss(0, 1), 3) for _ in range(60)), reverse=True)
    ranked = spark.createDataFrame([(f"f{k}", s, k) for k, s in enumerate(scores)], "feature string, score double, rank long")
    rows = [(f"S{s}", f"f{m}") for s in range(3) for m in rng.sample(range(60), 12)]
    return ranked, spark.createDataFrame(rows, "set_name string, member string")


def test_runs_without_sets(spark, small, tmp_path):
    ranked, members = small
    none = dict(set_min=40, set_max=50, nperm=5, empty_ok=True)
    run = runs.enrich_ranked(ranked, members, **none)
    assert run.results.count() == 0 and run.null_es.count() == 0
    keys = {r.key: r.value for r in run.summary(members, ranked).collect()}
    assert keys["n_sets"] == 0 and keys["n_sets_filtered"] == 3 and keys["n_features"] == 60 and keys["warning_single_set"] == 0
    many = runs.enrich_lists(ranked.withColumn("list_id", F.lit("x")), members, **none)
    assert many.results.count() == 0 and "list_id" in many.results.columns
    cells = [(f"f{r}", r, f"s{c}", float((r * 7 + c * 3) % 11)) for r in range(30) for c in range(8)]
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, value double")
    labels = spark.createDataFrame(
        [("p", f"s{c}", c, "AB"[c % 2], c % 2, float(c)) for c in range(8)],
        "phenotype string, sample string, position long, class_name string, class_idx int, num_value double",
    )
    assert runs.enrich_matrix(features, labels, members, **none).results.count() == 0
    # stored and read again
    run.save(str(tmp_path / "run"))
    document = str(tmp_path / "document")
    writers.write_results_xml(reports.results_with_arrays(run), document, {"METRIC": "None", "NUM_PERMS": "5"})
    for again in (runs.load_run(spark, str(tmp_path / "run")), runs.run_of_document(spark, document, run.ranked, empty_ok=True)):
        out = runs.leading_edge(again, again.results.select("set_name"))
        assert out["members"].count() == 0 and out["frequency"].count() == 0
    with pytest.raises(ValueError, match="non_empty"):
        runs.run_of_document(spark, document, run.ranked)


def _tables(spark, path, parts, lines):
    """Tables of ``parts`` parts with ``lines`` lines each, all of one brand, type and size."""
    spark.range(parts).select(
        F.col("id").alias("p_partkey"), F.lit("name").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("TIN").alias("p_type"), F.lit(1).alias("p_size"),
    ).write.parquet(f"{path}/part.parquet")
    spark.range(parts * lines).select(
        (F.col("id") % parts).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"),
        (F.col("id") % 11 / 100).alias("l_discount"), F.lit(10.0).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"),
    ).write.parquet(f"{path}/lineitem.parquet")


def test_queries_where_every_set_is_too_large(spark, tmp_path):
    _tables(spark, tmp_path, 600, 3)
    queries = entry.queries()
    names = "enrich_lists enrich_ranked leading_edge leading_edge_of_stored_run leading_edge_of_result_document write_results"
    for name in names.split():
        assert queries[name](spark, str(tmp_path)).count() == 0, name
    rows = {r.key: r.value for r in queries["run_summary_with_warnings"](spark, str(tmp_path)).collect()}
    assert rows["n_sets"] == 0 and rows["n_sets_filtered"] == 3 and rows["n_features"] == 600


@pytest.fixture(scope="module")
def sparse(spark):
    """Few cells a row, many samples, some rows tied."""
    rng = random.Random(9)
    cells = [
        (f"f{r}", r * 3, f"s{c}", 1.0 if r % 10 == 0 else round(rng.gauss(2, 1), 3))
        for r in range(400) for c in sorted(rng.sample(range(3000), 8))
    ]
    cells.append(("f7", 21, "s1", float("nan")))
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, value double")
    labels = spark.createDataFrame([(f"s{c}", c % 2) for c in range(3000)], "sample string, class_idx int")
    return features, labels


def test_tiles_of_a_sparse_matrix(sparse):
    features, labels = sparse
    tidy = features.filter("not isnan(value)")
    for metric in ("signal_to_noise", "t_test"):
        plan = {(r.perm, r.feature): r.score for r in nulls.permuted_scores(tidy, labels, 3, 5, metric).collect()}
        got = {(r.perm, r.feature): r.score for r in label_null.scores_by_labels(features, labels, 3, 5, metric, perm_block=2).collect()}
        assert got.keys() == plan.keys() and all(got[k] == pytest.approx(plan[k], abs=1e-9) for k in plan)
    # cells decide on the tiles, not rows by samples: each tile is sent all labels
    nobody = features.select("feature", F.lit(1).alias("member")).filter("false")
    options = {"median": False, "fix_low": True, "biased": False}
    _, index, rows = label_null._scored_tiles(features, labels, nobody, 3, 5, "signal_to_noise", "no_balance", options, 6000, 2)
    assert rows == 400 and index.select("tile").distinct().count() <= 3


def test_ends_of_permuted_lists(sparse):
    features, labels = sparse
    whole = nulls.permuted_lists(label_null.scores_by_labels(features, labels, 4, 5))
    assert label_null.scores_by_labels(features, labels, 4, 5, ends=7, tile_cells=500).count() < 4 * 400
    for ends in (7, 150):
        kept = label_null.scores_by_labels(features, labels, 4, 5, ends=ends, tile_cells=500)
        a, b = (
            sorted((r.perm, r.side, r.position, r.feature, r["rank"]) for r in rank.top_bottom_k(x, ends, ["perm"]).collect())
            for x in (whole, nulls.permuted_lists(kept, ends=ends))
        )
        assert a == b and len(a) == 4 * 2 * ends
    keys = np.array([2.0, 1.0, 1.0, 1.0, 0.0, 1.0])
    assert label_null.end_places(keys, 2).tolist() == [0, 1, 4, 5]


@pytest.mark.parametrize("most", [1 << 26, 3000])
def test_ends_take_labels_once_a_row_and_cells_once(spark, sparse, monkeypatch, most):
    """Labels reach a task once, not once a tile, and at most ``most`` bytes of them; scores are those of the tiles."""
    features, labels = sparse
    monkeypatch.setattr(label_null, "LABEL_BYTES", most)
    features = features.unionByName(spark.createDataFrame([("f3", 9, "s1", float("inf")), (None, 1, "s1", 1.0), ("nan", 2, "s1", float("nan"))], features.schema))
    used = []
    bits = label_null._label_bits
    monkeypatch.setattr(label_null, "_label_bits", lambda *a: used.append(bits(*a)) or used[-1])
    for metric in ("signal_to_noise", "t_test", "diff_of_classes"):
        tiles = label_null.scores_by_labels(features, labels, 20, 5, metric)
        ends = label_null.scores_by_labels(features, labels, 20, 5, metric, ends=30)
        assert ends.select("n_features").distinct().collect() == [(401,)]
        want, got = (
            {(r.perm, r.side, r.position): (r.feature, r.row_idx, "none" if r.score is None else round(r.score, 9) if r.score == r.score else "nan") for r in rank.top_bottom_k(x, 30, ["perm"]).collect()}
            for x in (nulls.permuted_lists(tiles), nulls.permuted_lists(ends, ends=30))
        )
        assert got == want and len(got) == 20 * 60
    assert len(used) == (3 if most > 3000 else 9) and all(b.nbytes <= most for b in used)


def test_ends_of_equal_scores_and_of_whole_rows():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 3, (500, 5)).astype(float), np.zeros((900, 5)), rng.normal(size=(700, 5))):
        values[7] = np.nan
        found = label_null.Ends(5, 20)
        for rows in np.split(rng.permutation(len(values)), 10):
            found.add(rows, values[rows])
        perm, _, row, score = found.settled()
        assert len(row) == 5 * 40
        for p in range(5):
            order = np.lexsort((np.arange(len(values)), label_null.order_keys(values[:, p], "real", False)))
            assert row[perm == p].tolist() == [*order[:20], *order[-20:]]
            assert np.array_equal(score[perm == p], values[row[perm == p], p], equal_nan=True)


def test_scores_of_dense_sparse_and_long_rows(monkeypatch):
    rng = np.random.default_rng(3)
    at, sample = np.nonzero(rng.random((30, 400)) < np.linspace(0, 0.3, 30)[:, None])
    value, bits = rng.normal(3, 1, len(at)), rng.integers(0, 256, (400, 9), dtype=np.uint8)
    a = np.full((30, 400), np.nan)
    a[at, sample] = value
    labels = np.unpackbits(bits, axis=1, count=70).astype(float)
    want = label_null.class_scores(np.where(np.isnan(a).all(axis=1, keepdims=True), 0.0, a), labels, "signal_to_noise")
    for share, strip in ((0.0, 1 << 19), (2.0, 1 << 19), (2.0, 700)):
        monkeypatch.setattr(label_null, "DENSE_SHARE", share)
        monkeypatch.setattr(label_null, "STRIP_SCORES", strip)
        got = np.full((30, 70), np.nan)
        for rows, scores in label_null._scores_of_rows(at, sample, value, 30, bits, 70, "signal_to_noise", True, False):
            got[rows] = scores
        some = ~np.isnan(a).all(axis=1)
        assert np.allclose(got[some], want[some], atol=1e-9, equal_nan=True) and (got[~some] == 0).all() and (~some).any()
