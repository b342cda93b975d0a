"""ES against a full scan over every rank, written out step by step."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.operators import enrich, leading, nulls, permute, rank, sets


def scan(scores, members, scheme):
    """(es, rank) by walking the list; members is a set of ranks."""

    def guard(x, v):
        return x if math.isfinite(x) else v

    n, total_n = len(members), len(scores)
    if scheme == "classic":
        hit = {r: 1.0 / n for r in members}
    elif scheme == "weighted":
        w = {r: guard(abs(scores[r]), 0.01) for r in members}
        hit = {r: w[r] / sum(w.values()) for r in members}
    elif scheme == "weighted_p2":
        w = {r: guard(scores[r] ** 2, 1e-6) for r in members}
        hit = {r: w[r] / sum(w.values()) for r in members}
    else:
        w = {r: guard(abs(scores[r]) ** 1.5, 1e-6) for r in members}
        total = sum(w.values())
        hit = {
            r: scores[r] ** 1.5 / total if scores[r] >= 0 and math.isfinite(scores[r]) else 1e-6
            for r in members
        }
    miss = 1.0 / (total_n - n) if total_n > n else 0.0
    run, best, at = 0.0, 0.0, 0
    for r in range(total_n):
        run += hit[r] if r in members else -miss
        if abs(run) > abs(best) + 1e-9:
            best, at = run, r
    return best, at


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    scores = sorted((round(rng.gauss(0.2, 1), 3) for _ in range(120)), reverse=True)
    scores[0], scores[-1] = float("inf"), float("-inf")
    scores[60] = 0.0
    picks = {f"S{k}": set(rng.sample(range(120), size)) for k, size in enumerate([1, 2, 5, 17, 40, 80, 119])}
    picks["ALL"] = set(range(120))
    picks["TOP"], picks["END"] = set(range(10)), set(range(110, 120))
    ranked = spark.createDataFrame(
        [(f"f{r}", s, r) for r, s in enumerate(scores)], "feature string, score double, rank long"
    )
    members = spark.createDataFrame(
        [(k, f"f{r}") for k, v in picks.items() for r in v] + [("NONE", "zz"), ("TOP", "zz")],
        "set_name string, member string",
    )
    return scores, picks, ranked, members


@pytest.mark.parametrize("scheme", ["classic", "weighted", "weighted_p2", "weighted_p1.5"])
@pytest.mark.parametrize("block", [enrich.BLOCK, 7])
def test_es_matches_full_scan(case, scheme, block):
    scores, picks, ranked, members = case
    hits = enrich.score_hits(
        enrich.set_hits(ranked, members), rank.list_sizes(ranked), scheme, block=block
    )
    got = {r["set_name"]: r for r in enrich.pick_extreme(hits, scheme).collect()}
    assert set(got) == set(picks)
    for name, where in picks.items():
        es, at = scan(scores, where, scheme)
        assert got[name]["es"] == pytest.approx(es, abs=1e-9), name
        assert got[name]["rank_at_max"] == at, name
        assert got[name]["size"] == len(where)


@pytest.mark.parametrize("scheme", list(enrich.SCHEMES))
def test_numpy_path_equals_columns(case, scheme):
    scores, picks, ranked, members = case
    es = enrich.pick_extreme(enrich.hits(ranked, members, scheme), scheme).collect()
    weights = nulls.weigh(np.array(scores), scheme)
    for r in es:
        ranks = np.array(sorted(picks[r["set_name"]]))[None, :]
        got = nulls.extreme_of_rows(ranks, weights, len(scores))[0]
        assert got == pytest.approx(r["es"], abs=1e-9)


def test_weights_sum_to_one_and_es_is_bounded(case):
    _, _, ranked, members = case
    for scheme in ("classic", "weighted", "weighted_p2"):
        hits = enrich.hits(ranked, members, scheme)
        for r in hits.groupBy("set_name").agg(F.sum("weight").alias("w")).collect():
            assert r["w"] == pytest.approx(1.0)
        es = enrich.pick_extreme(hits, scheme)
        assert es.filter("abs(es) > 1 + 1e-12").count() == 0


def test_tie_goes_to_the_first(spark):
    # + 1/2 at rank 0, back to - 1/2 before rank 3, classic weights
    ranked = spark.createDataFrame(
        [(f"f{r}", s, r) for r, s in enumerate([3.0, 1.0, -1.0, -3.0])],
        "feature string, score double, rank long",
    )
    members = spark.createDataFrame([("A", "f0"), ("A", "f3")], "set_name string, member string")
    row = enrich.enrichment(ranked, members, "classic").head()
    assert (row["es"], row["rank_at_max"], row["score_at_max"]) == (0.5, 0, 3.0)


def test_full_profile(case):
    scores, picks, ranked, members = case
    hits = enrich.hits(ranked, members)
    full = enrich.running_es_full(ranked, hits, members).collect()
    by_set = {}
    for r in full:
        by_set.setdefault(r["set_name"], {})[r["rank"]] = r["running_es"]
    for name in picks:
        assert sorted(by_set[name]) == list(range(120))
        if name != "ALL":
            assert by_set[name][119] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 16])
def test_full_profile_is_cut_at_blocks(case, monkeypatch, block):
    _, picks, ranked, members = case
    hits = enrich.hits(ranked, members)
    monkeypatch.setattr(enrich, "BLOCK", 1 << 16)
    points = {}
    for r in hits.collect():
        points.setdefault(r["set_name"], {})[r["rank"]] = (r["running_es"], r["n_hits"])
    monkeypatch.setattr(enrich, "BLOCK", block)
    full = enrich.running_es_full(ranked, hits, members)
    got = {(r["set_name"], r["rank"]): r["running_es"] for r in full.collect()}
    assert len(got) == full.count() == 120 * len(picks)
    for name, at in points.items():
        value, n = 0.0, len(at)
        for rank in range(120):
            value = at[rank][0] if rank in at else value - 1 / (120 - n)
            assert got[name, rank] == pytest.approx(value, abs=1e-9)


def test_leading_edge_sides(case):
    _, picks, ranked, members = case
    hits = enrich.hits(ranked, members)
    es = enrich.pick_extreme(hits)
    edge = leading.leading_edge_members(hits, es).collect()
    assert {r["rank"] for r in edge if r["set_name"] == "TOP"} == set(range(10))
    assert {r["rank"] for r in edge if r["set_name"] == "END"} == set(range(110, 120))
    stats = {r["set_name"]: r for r in leading.leading_edge_stats(hits, es).collect()}
    end = stats["END"]
    assert end["tag_fraction"] == 1.0
    assert end["peak_rank"] == 120 - 109  # reached just before its first hit


def test_size_filter(case):
    _, picks, ranked, members = case
    kept = sets.filter_sets_by_size(members, ranked, 5, 80)
    assert {r["set_name"] for r in kept.select("set_name").distinct().collect()} == {
        k for k, v in picks.items() if 5 <= len(v) <= 80
    }
    assert sets.filter_sets_by_size(members, ranked, 15, 15).count() == members.count()
    report = {r["set_name"]: r for r in sets.set_size_report(members, kept).collect()}
    assert report["NONE"]["status"] == "Rejected!" and report["TOP"]["original_size"] == 11
    assert report["TOP"]["restricted_size"] == 10
    counts = {r["set_name"]: r["n_present"] for r in sets.count_members(members, ranked).collect()}
    assert counts["NONE"] == 0 and counts["TOP"] == 10
    with pytest.raises(ValueError):
        sets.require_sets(sets.filter_sets_by_size(members, ranked, 200, 300))


@pytest.mark.parametrize("scheme", ["weighted", "weighted_p1.5"])
def test_both_ways_to_the_random_set_null(case, scheme):
    _, _, ranked, members = case
    kept = sets.filter_sets_by_size(members, ranked, 1, 110)
    fast = {(r[0], r[1]): r[2] for r in nulls.null_by_sets(ranked, kept, 70, 5, scheme).collect()}
    plan = {(r[0], r[1]): r[2] for r in nulls.null_by_sets_plan(ranked, kept, 70, 5, scheme).collect()}
    assert fast.keys() == plan.keys() and len(fast) == 70 * 8
    for k, v in fast.items():
        assert v == pytest.approx(plan[k], abs=1e-9)
    assert nulls.null_by_sets(ranked, kept, 0).count() == 0


@pytest.mark.parametrize("scheme", list(enrich.SCHEMES))
def test_random_sets_over_blocks_of_ranks(case, scheme):
    """A list and its sets cut into many blocks: drawn block by block, scored from the blocks' sums."""
    _, _, ranked, members = case
    kept = sets.filter_sets_by_size(members, ranked, 1, 110)
    n_features = ranked.count()
    third = ranked.filter("rank % 3 = 0").select(F.lit("THIRD").alias("set_name"), F.col("feature").alias("member"))
    kept = kept.select("set_name", "member").unionByName(third)
    fast = {(r[0], r[1]): r[2] for r in nulls.null_by_sets(ranked, kept, 70, 5, scheme, rank_block=13).collect()}
    plan = {(r[0], r[1]): r[2] for r in nulls.null_by_sets_plan(ranked, kept, 70, 5, scheme, rank_block=13).collect()}
    assert fast.keys() == plan.keys() and len(fast) == 70 * 9
    for k, v in fast.items():
        assert v == pytest.approx(plan[k], abs=1e-9)
    drawn = permute.random_ranks(kept, ranked, 70, 5, rank_block=13).filter("set_name = 'THIRD'").collect()
    by_perm = {}
    for r in drawn:
        by_perm.setdefault(r["perm"], []).append(r["rank"])
    size = third.count()
    assert all(len(set(v)) == len(v) == size and 0 <= min(v) <= max(v) < n_features for v in by_perm.values())
    tasks = permute.block_tasks(permute.draw_tasks(kept, ranked, 70), 70, 5, rank_block=13).filter("set_name = 'THIRD'")
    assert tasks.count() == 2 * -(-n_features // 13)  # two runs of permutations, each in every block


def test_counts_of_blocks_are_hypergeometric():
    sizes = np.array([50, 30, 20])
    counts = np.stack([permute.split_draw(f"s:{k}", sizes, 40) for k in range(4000)])
    assert (counts.sum(axis=1) == 40).all() and (counts <= sizes).all()
    assert np.allclose(counts.mean(axis=0), 40 * sizes / 100, atol=0.15)
    var = 40 * sizes / 100 * (1 - sizes / 100) * 60 / 99
    assert np.allclose(counts.var(axis=0), var, rtol=0.1)
    assert (permute.split_draw("s:1", sizes, 40) == counts[1]).all()


def test_random_sets_are_distinct_and_reproducible(case):
    _, picks, ranked, members = case
    kept = sets.filter_sets_by_size(members, ranked, 1, 119)
    drawn = permute.random_sets(ranked, kept, 5, 3)
    sizes = drawn.groupBy("set_name", "perm").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("d")
    ).collect()
    for r in sizes:
        assert r["n"] == r["d"] == len(picks[r["set_name"]])
    again = permute.random_sets(ranked.repartition(5), kept.repartition(3), 5, 3)
    assert drawn.exceptAll(again).count() == 0
    other = permute.random_sets(ranked, kept, 5, 4)
    assert drawn.exceptAll(other).count() > 0


def test_many_lists_equal_single_runs(spark, case):
    from rankfield.operators import signif
    from rankfield.plans import runs

    scores, _, ranked, members = case
    other = rank.rank_scores(
        ranked.select("feature", (-F.col("score") + 0.3).alias("score"), (-F.col("rank")).alias("row_idx"))
        .filter("abs(row_idx) % 4 > 0")
    ).select("feature", "score", "rank")
    lists = ranked.withColumn("list_id", F.lit("a")).unionByName(other.withColumn("list_id", F.lit("b")))
    options = dict(set_min=2, set_max=100, nperm=30, seed=3)
    both = runs.enrich_lists(lists, members, **options)
    got = {(r["list_id"], r["set_name"]): r for r in both.results.collect()}
    for name in "ab":
        null = both.null_es.filter(F.col("list_id") == name).select("set_name", "perm", "es")
        one = lists.filter(F.col("list_id") == name).select("feature", "score", "rank")
        kept = sets.filter_sets_by_size(members, one, 2, 100)
        want = signif.significance(enrich.enrichment(one, kept), null).collect()
        assert len(want) == sum(k[0] == name for k in got)
        for w in want:
            g = got[name, w["set_name"]]
            for c in ("es", "rank_at_max", "nes", "np", "fdr", "fwer"):
                assert g[c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-9)), (name, w["set_name"], c)
