"""Overlap against loops, with more sets than one mask holds."""

import itertools
import random

import pytest

from rankfield.operators import overlap


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(7)
    sets = {f"S{k:03d}": set(rng.sample(range(90), rng.randrange(1, 14))) for k in range(140)}
    for k in range(0, 140, 3):  # one member in a third of the sets
        sets[f"S{k:03d}"].add(999)
    df = spark.createDataFrame(
        [(s, f"m{m:03d}") for s, v in sets.items() for m in v], "set_name string, member string"
    )
    return sets, df


def test_pairs(case):
    sets, df = case
    got = {(r["a"], r["b"]): r for r in overlap.pair_overlap(df).collect()}
    want = {
        (a, b): len(sets[a] & sets[b])
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] & sets[b]
    }
    assert {k: r["inter"] for k, r in got.items()} == want
    for (a, b), r in got.items():
        assert r["jaccard"] == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))


def test_a_member_of_every_set(spark, monkeypatch):
    """Its mask words are dealt over several tasks."""
    monkeypatch.setattr(overlap, "WORDS_PER_TASK", 2)
    rows = [(f"S{k:03d}", m) for k in range(400) for m in ("all", f"m{k % 7}")]
    df = spark.createDataFrame(rows, "set_name string, member string")
    got = {(r["a"], r["b"]): r["inter"] for r in overlap.pair_overlap(df).collect()}
    assert len(got) == 400 * 399 // 2
    assert all(n == 1 + (int(a[1:]) % 7 == int(b[1:]) % 7) for (a, b), n in got.items())


def test_matrix_and_summaries(case):
    sets, df = case
    full = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets
    }
    got = {(r["a"], r["b"]): r["jaccard"] for r in overlap.jaccard_matrix(df).collect()}
    assert got == pytest.approx({k: v for k, v in full.items() if v})
    assert overlap.jaccard_mean(df).head()[0] == pytest.approx(sum(full.values()) / len(full))
    total = sum(r["n_pairs"] for r in overlap.jaccard_distribution(df).collect())
    assert total == 140 * 139 // 2
    bins = {r["bin"]: r["n_pairs"] for r in overlap.jaccard_histogram(df).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        k = int(full[a, b] / 0.02 + 1e-9)
        want[k] = want.get(k, 0) + 1
    assert bins == want


def test_member_pairs_are_counted(case):
    sets, df = case
    pairs = set()
    for v in sets.values():
        pairs |= set(itertools.combinations(sorted(v), 2))
    row = overlap.co_member_pairs(df).head()
    assert row["distinct_pairs"] == len(pairs)
    assert row["possible_pairs"] == sum(len(v) * (len(v) - 1) // 2 for v in sets.values())


def test_clusters(case):
    import numpy as np

    sets, df = case
    members = sorted(set().union(*sets.values()))
    names = sorted(sets)
    rows = np.array([[m in sets[s] for m in members] for s in names], dtype=float)
    corr = np.corrcoef(rows)
    parent = {s: s for s in names}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for x, y in itertools.combinations(range(len(names)), 2):
        if corr[x, y] >= 0.35:
            a, b = sorted((root(names[x]), root(names[y])))
            parent[b] = a
    got = {r["set_name"]: r["cluster"] for r in overlap.correlation_clusters(df, 0.35).collect()}
    assert got == {s: root(s) for s in names}
    with pytest.raises(ValueError):
        overlap.correlation_clusters(df, 0.0)


def test_collections(case, spark):
    _, df = case
    with pytest.raises(Exception, match="set name used twice"):
        overlap.union_collections(df, df.filter("set_name = 'S001'")).collect()
    one = overlap.explode_collection(df, "s007")
    assert one.count() == df.filter("set_name = 'S007'").count()
    wide = overlap.incidence_wide(df, ["m001", "m999"])
    assert wide.count() == 140 and wide.columns == ["set_name", "m001", "m999"]
    cells = overlap.incidence_matrix(df)
    assert cells.filter("present = 1").count() == cells.count() == df.count()


def test_edges_of_two_runs(spark, case):
    _, df = case
    first = spark.createDataFrame([("S000", 0.0, 0.0), ("S003", 0.0, 0.5)], "set_name string, np double, fdr double")
    other = spark.createDataFrame([("S003", 0.001, 0.1), ("S006", 0.5, 0.0)], "set_name string, np double, fdr double")
    assert overlap.similarity_edges(df, first, cutoff=0.0).count() == 0
    out = overlap.similarity_edges(df, first, cutoff=0.0, other_results=other).collect()
    assert [(r["a"], r["b"]) for r in out] == [("S000", "S003")]


def _pairs_by_hand(rows):
    sets = {}
    for name, member in rows:
        sets.setdefault(name, set()).add(member)
    return len({p for v in sets.values() for p in itertools.combinations(sorted(v), 2)})


def test_member_pairs_with_a_set_of_most_members(spark, monkeypatch):
    """A set of many words is dealt over several keys."""
    monkeypatch.setattr(overlap, "WORDS_PER_TASK", 2)
    rng = random.Random(4)
    members = [f"m{k:04d}" for k in range(900)]
    rows = [("all", m) for m in members[:700]]
    rows += [(f"s{k}", m) for k in range(12) for m in rng.sample(members, 25)]
    df = spark.createDataFrame(rows, "set_name string, member string")
    assert overlap.co_member_pairs(df).head()["distinct_pairs"] == _pairs_by_hand(rows)


def _components_by_hand(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    return {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("shape", ["path", "hub", "random", "two hubs", "odd", "empty"])
def test_components(spark, shape, monkeypatch):
    monkeypatch.setattr(overlap, "HUB_PARTS", 8)
    rng = random.Random(9)
    order = [f"n{k:03d}" for k in rng.sample(range(300), 300)]
    pairs = {
        "path": list(zip(order[:80], order[1:81])),
        "hub": [("n999", x) for x in order[:200]] + [(order[0], "a")],
        "random": [tuple(rng.sample(order, 2)) for _ in range(140)],
        "two hubs": [(rng.choice(["n999", "a"]), x) for x in order] + [("n999", "a")],
        "odd": [("x", "x"), ("a", "b"), ("b", "a"), ("a", "b"), (None, "c"), ("d", None)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r["a"]: r["b"] for r in overlap.components(df).collect()}
    assert got == _components_by_hand([p for p in pairs if None not in p and p[0] != p[1]])


@pytest.mark.parametrize("few", [0, 2, 8])
def test_member_pairs_of_few_and_many_sets(spark, few):
    rng = random.Random(few)
    members = [f"m{k:03d}" for k in range(150)]
    rows = [(f"s{k % 90}", m) for m in members for k in rng.sample(range(90), rng.choice([1, 2, 3, 12]))]
    rows += [("s0", "m000")] * 2 + [("alone", "x"), (None, "m001")]
    df = spark.createDataFrame(rows, "set_name string, member string")
    assert overlap.co_member_pairs(df, few).head()["distinct_pairs"] == _pairs_by_hand([r for r in rows if r[0]])
    assert overlap.co_member_pairs(df.limit(0), few).head()["distinct_pairs"] == 0


def test_member_pairs_of_few_sets_are_not_met(spark, monkeypatch):
    """Members in brand, type and size: no membership meets the masks of its sets."""
    monkeypatch.setattr(overlap, "_pairs_of_many", None)
    rows = [(f"{c}{k % n}", f"m{k}") for k in range(400) for c, n in (("b", 5), ("t", 7), ("z", 11))]
    df = spark.createDataFrame(rows, "set_name string, member string")
    assert overlap.co_member_pairs(df).head()["distinct_pairs"] == _pairs_by_hand(rows)
