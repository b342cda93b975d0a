"""Significance against loops over every set and permutation."""

import random

import pytest

from rankfield.operators import reports, signif


def brute(real, null, sign_mean):
    """real {set: es}, null {set: [es]} -> nes, np, fdr, fwer."""
    nes, null_nes = {}, {}

    def norm(e, name):
        m = sign_mean[name][0 if e >= 0 else 1]
        return None if m in (None, 0) else e / abs(m)

    for s, e in real.items():
        nes[s] = norm(e, s)
        null_nes[s] = [norm(x, s) for x in null[s]]
    n_perm = len(next(iter(null.values())))
    out = {}
    known = [s for s in real if nes[s] is not None]
    down = sorted(known, key=lambda s: (-nes[s], s))
    up = sorted(known, key=lambda s: (nes[s], s))
    for s, e in real.items():
        same = [x for x in null[s] if (x >= 0 if e >= 0 else x <= 0)]
        np_ = sum(x > e if e >= 0 else x < e for x in same) / len(same) if same else None
        fdr = fwer = None
        if nes[s] is not None:
            best = [
                (max if nes[s] >= 0 else min)(null_nes[t][p] for t in real if null_nes[t][p] is not None)
                for p in range(n_perm)
            ]
            fwer = sum(b > nes[s] if nes[s] >= 0 else b < nes[s] for b in best) / n_perm
        if nes[s] is not None and e != 0:
            shares = []
            for p in range(n_perm):
                col = [null_nes[t][p] for t in real if null_nes[t][p] is not None]
                col = [x for x in col if (x >= 0 if e > 0 else x <= 0)]
                if col:
                    shares.append(sum(x >= nes[s] if e > 0 else x <= nes[s] for x in col) / len(col))
            if shares:
                order = down if e > 0 else up
                count = sum(nes[t] >= 0 if e > 0 else nes[t] <= 0 for t in known)
                fdr = min(1.0, (sum(shares) / len(shares)) / ((order.index(s) + 1) / count))
        out[s] = (nes[s], np_, fdr, fwer)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    rng = random.Random(seed)
    names = [f"S{k:02d}" for k in range(14)]
    real = {n: round(rng.uniform(-0.8, 0.8), 2) for n in names}
    real["S00"], real["S01"] = 0.0, 0.5
    null = {n: [round(rng.uniform(-0.7, 0.7), 1) for _ in range(12)] for n in names}
    null["S01"] = [-0.3] * 12  # no null of the sign of its ES
    null["S02"][0] = 0.0
    means = {}
    for n in names:
        pos = [x for x in null[n] if x >= 0]
        neg = [x for x in null[n] if x <= 0]
        means[n] = (
            sum(pos) / len(pos) if pos else None,
            sum(neg) / len(neg) if neg else None,
        )
    es = spark.createDataFrame(list(real.items()), "set_name string, es double")
    null_es = spark.createDataFrame(
        [(n, p, e) for n in names for p, e in enumerate(null[n])], "set_name string, perm int, es double"
    )
    want = brute(real, null, means)
    for r in signif.significance(es, null_es).collect():
        got = (r["nes"], r["np"], r["fdr"], r["fwer"])
        for g, w in zip(got, want[r["set_name"]]):
            assert (g is None) == (w is None), (r["set_name"], got, want[r["set_name"]])
            if g is not None:
                assert g == pytest.approx(w, abs=1e-9), (r["set_name"], got, want[r["set_name"]])


def test_validate(spark):
    res = spark.createDataFrame([("A", 0.1), ("A", 0.2), ("B", 0.3)], "set_name string, es double")
    null_es = spark.createDataFrame(
        [("A", 0, 0.1), ("A", 1, 0.1), ("B", 0, 0.1)], "set_name string, perm int, es double"
    )
    got = {r["check"]: r["ok"] for r in signif.validate_results(res, null_es).collect()}
    assert got == {"non_empty": True, "unique_names": False, "same_permutations": False}


def test_zero_es_is_in_both_reports(spark):
    res = spark.createDataFrame([("A", 0.0), ("B", 0.3), ("C", None)], "set_name string, es double")
    sides = sorted((r["side"], r["set_name"]) for r in reports.both_sides(res).collect())
    assert sides == [("neg", "A"), ("pos", "A"), ("pos", "B")]


def test_warnings(spark):
    labels = spark.createDataFrame([(0,), (0,), (1,)], "class_idx int")
    res = spark.createDataFrame(
        [("A", 0.1, float("nan"), 0.1, 0.1, 0.1)],
        "set_name string, es double, nes double, np double, fdr double, fwer double",
    )
    got = {r["warning"]: r["applies"] for r in reports.permutation_quality_warnings(labels, res).collect()}
    assert all(got.values()) and len(got) == 5


def test_level_index_is_single_precision():
    assert reports.level_index(0.01, 1000, False) == 10
    assert reports.level_index(0.01, 1000, True) == 990
    assert reports.level_index(0.5, 7, True) == 3
