"""What a run refuses, what it stores, and cases where two paths once differed."""

import random

import pytest
from pyspark.sql import functions as F

from rankfield.operators import enrich, labels as lab, nulls, reports, sets
from rankfield.plans import runs
from rankfield.sources import writers


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(5)
    scores = sorted((round(rng.gauss(0, 1), 3) for _ in range(60)), reverse=True)
    ranked = spark.createDataFrame(
        [(f"f{k}", s, k, k) for k, s in enumerate(scores)], "feature string, score double, row_idx long, rank long"
    )
    rows = [(f"S{s}", f"f{m}") for s in range(4) for m in rng.sample(range(80), 12)]
    return ranked, spark.createDataFrame(rows, "set_name string, member string")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(6)
    cells = [(f"f{r}", r, f"s{c}", c, round(rng.gauss(0, 1), 3)) for r in range(30) for c in range(10)]
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, sample_idx long, value double")
    rows = [("p", f"s{c}", c, "AB"[c % 2], c % 2, None if c == 3 else float(c * c % 7)) for c in range(10)]
    labels = spark.createDataFrame(
        rows, "phenotype string, sample string, position long, class_name string, class_idx int, num_value double"
    )
    members = spark.createDataFrame([(f"S{k}", f"f{m}") for k in range(3) for m in rng.sample(range(30), 8)], "set_name string, member string")
    return features, labels, members


def test_null_of_a_profile_with_missing_values(matrix):
    features, labels, members = matrix
    fast = {(r.set_name, r.perm): r.es for r in nulls.null_by_labels(features, labels, members, 6, 3, "pearson").collect()}
    plan = nulls.null_by_labels_plan(features, labels, members, 6, 3, "pearson").collect()
    assert len({round(r.es, 6) for r in plan}) > 6
    for r in plan:
        assert fast[r.set_name, r.perm] == pytest.approx(r.es, abs=1e-7)


def test_extreme_of_large_deviations(spark):
    rows = [("a", k, k, 5000, 4, w, e, e - 0.01) for k, (w, e) in enumerate([(0.1, 1.2), (0.1, 3.5), (0.1, 9.9e5), (0.1, 2.0)])]
    scored = spark.createDataFrame(
        rows, "set_name string, rank long, hit_no long, n_features long, n_hits long, weight double, running_es double, before_es double"
    )
    got = enrich.pick_extreme(scored, "weighted").first()
    assert got.es == 9.9e5 and got.rank_at_max == 2


def test_both_set_filters_without_limits(spark, parts):
    ranked, members = parts
    one = sets.filter_sets_by_size(members, ranked, 5, 5)
    many = sets.filter_sets_by_list(members, ranked.withColumn("list_id", F.lit("x")), ["list_id"], 5, 5)
    assert sorted(map(tuple, one.select("set_name", "member").collect())) == sorted((r.set_name, r.member) for r in many.collect())
    a = runs.enrich_ranked(ranked, members, set_min=5, set_max=5, nperm=5)
    b = runs.enrich_lists(ranked.withColumn("list_id", F.lit("x")), members, set_min=5, set_max=5, nperm=5)
    sizes = lambda run: sorted((r.set_name, r["size"], round(r.es, 9)) for r in run.results.collect())
    assert sizes(a) == sizes(b)


def test_lists_are_collapsed(spark, parts):
    ranked, _ = parts
    id_map = spark.createDataFrame([(f"f{k}", f"g{k // 2}", "") for k in range(60)], "probe string, symbol string, title string")
    members = spark.createDataFrame([("S", f"g{k}") for k in range(0, 20, 2)], "set_name string, member string")
    options = dict(collapse_choice="Collapse", set_min=1, set_max=50, nperm=5)
    one = runs.enrich_ranked(ranked, members, id_map, **options).results.first()
    many = runs.enrich_lists(ranked.withColumn("list_id", F.lit("x")), members, id_map=id_map, **options).results.first()
    assert one["size"] == 10 and round(one.es, 9) == round(many.es, 9)
    nothing = id_map.withColumn("probe", F.lit("zz"))
    with pytest.raises(ValueError, match="no feature"):
        runs.enrich_ranked(ranked, members, nothing, **options)


def test_runs_refuse(spark, parts, matrix):
    ranked, members = parts
    features, labels, some = matrix
    with pytest.raises(ValueError, match="no set is left"):
        runs.enrich_ranked(ranked, members, set_min=40, set_max=50, nperm=5)
    few = labels.filter("position < 5")
    with pytest.raises(ValueError, match="are needed"):
        runs.enrich_matrix(features, few, some, set_min=1, nperm=5)
    with pytest.raises(ValueError, match="two classes"):
        runs.enrich_matrix(features, labels.filter("class_idx = 0"), some, set_min=1, nperm=5)
    with pytest.raises(ValueError, match="numeric labelling"):
        runs.enrich_matrix(features, labels.withColumn("num_value", F.lit(None).cast("double")), some, metric="pearson", set_min=1, nperm=5)
    versions = spark.createDataFrame([("a", "sets", "human", "1"), ("b", "chip", "mouse", "1")], "source string, kind string, species string, version string")
    with pytest.raises(ValueError, match="species"):
        runs.enrich_ranked(ranked, members, set_min=1, nperm=5, versions=versions)
    with pytest.warns(UserWarning, match="versions"):
        runs.check_sources(versions.withColumn("species", F.lit("human")).withColumn("version", F.col("source")))


def test_labellings_by_their_own_number_of_classes(spark):
    rows = [(p, f"s{k}", k, f"c{k % n}", k % n, None) for p, n in (("one", 1), ("two", 2), ("three", 3)) for k in range(6)]
    table = spark.createDataFrame(rows, "phenotype string, sample string, position long, class_name string, class_idx int, num_value double")
    got = {r.phenotype for r in lab.labels_all_derived(table).select("phenotype").distinct().collect()}
    assert {"c0_versus_c1", "c1_versus_c0", "c0_versus_REST", "REST_versus_c2", "c2_versus_c1", "c0", "c2"} <= got
    assert lab.labels_all_derived(table.filter("phenotype = 'one'")).count() == 6
    assert lab.labels_all_derived(table.filter("phenotype = 'two'")).count() == 18
    with pytest.raises(Exception, match="three classes"):
        lab.labels_one_vs_rest(table).collect()


def test_stored_run(spark, parts, tmp_path):
    ranked, members = parts
    run = runs.enrich_ranked(ranked, members, set_min=1, nperm=5)
    run.save(str(tmp_path / "run"))
    back = runs.load_run(spark, str(tmp_path / "run"))
    for name in runs.TABLES:
        assert sorted(getattr(run, name).collect()) == sorted(getattr(back, name).collect())
    chosen = back.results.select("set_name")
    a, b = (runs.leading_edge(r, chosen)["frequency"] for r in (run, back))
    assert sorted(a.collect()) == sorted(b.collect())


def test_run_of_a_result_document(spark, tmp_path):
    ranked = spark.createDataFrame([(f"f{k}", 3.0 - k / 10, k) for k in range(60)], "feature string, score double, rank long")
    members = [(f"S{k}", f"f{r}") for k in range(4) for r in range(k, 60, k + 3)]
    sets = spark.createDataFrame(members, "set_name string, member string")
    run = runs.enrich_ranked(ranked, sets, set_min=2, set_max=100, nperm=25, seed=2)
    path = str(tmp_path / "doc")
    writers.write_results_xml(reports.results_with_arrays(run), path, {"METRIC": "None", "NUM_PERMS": "25"})
    again = runs.run_of_document(spark, path, ranked)

    def rows(df, *names):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())

    for table, names in {
        "results": ("set_name", "size", "es", "rank_at_max"),
        "null_es": ("set_name", "perm", "es"),
        "hits": ("set_name", "feature", "score", "rank", "hit_no", "n_hits", "n_features", "running_es"),
        "warnings": ("warning", "applies"),
    }.items():
        assert rows(getattr(again, table), *names) == rows(getattr(run, table), *names), table
    edge = ("set_name", "feature", "rank")
    assert rows(again.leading_edge(), *edge) == rows(run.leading_edge(), *edge)
    a, b = (runs.leading_edge(r, r.results.select("set_name")) for r in (again, run))
    assert rows(a["jaccard"], "a", "b", "jaccard") == rows(b["jaccard"], "a", "b", "jaccard")
    again.save(str(tmp_path / "run"))
    assert rows(runs.load_run(spark, str(tmp_path / "run")).warnings, "warning", "applies") == rows(run.warnings, "warning", "applies")
    with pytest.raises(Exception, match="no such rank"):
        runs.run_of_document(spark, path, ranked.filter("rank < 20"))


def test_warnings_of_a_matrix_run(spark):
    cells = [(f"f{r}", r, f"s{c}", float((r * 7 + c * 3) % 11 + (r % 3) * (c % 2))) for r in range(40) for c in range(8)]
    features = spark.createDataFrame(cells, "feature string, row_idx long, sample string, value double")
    labels = spark.createDataFrame(
        [("p", f"s{c}", c, "AB"[c % 2], c % 2, float(c)) for c in range(8)],
        "phenotype string, sample string, position long, class_name string, class_idx int, num_value double",
    )
    sets = spark.createDataFrame([("ONE", f"f{r}") for r in range(0, 40, 3)], "set_name string, member string")
    options = dict(nperm=5, set_min=2, set_max=50)
    of = lambda run: {r["warning"]: r["applies"] for r in run.warnings.collect()}
    classes = of(runs.enrich_matrix(features, labels, sets, **options))
    assert classes["class_a_small"] and classes["class_b_small"] and classes["few_samples"] and classes["single_set"]
    profile = of(runs.enrich_matrix(features, labels, sets, metric="spearman", **options))
    assert profile["few_samples"] and not profile["class_a_small"]
    drawn = runs.enrich_matrix(features, labels, sets, permute="gene_set", **options)
    assert not of(drawn)["few_samples"] and of(drawn)["single_set"]
    keys = {r["key"]: r["value"] for r in drawn.summary(sets, features).collect()}
    assert keys["warning_single_set"] == 1 and keys["n_features"] == 40 and keys["n_sets_filtered"] == 0
