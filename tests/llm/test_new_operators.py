"""Periodic runs, token links and the curriculum against plain definitions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from rankfield.llm import curriculum, periods, token_links
from rankfield.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- periodic runs ------------------------------------------------------------


def plain_runs(t, least=6, turns=4):
    """All (start, length, period), by trying every period."""
    out = set()
    for q in range(1, len(t) // turns + 1):
        i = 0
        while i + q < len(t):
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            part = t[i : j + q]
            smaller = any(part[p:] == part[:-p] for p in range(1, q))
            if len(part) >= max(least, turns * q) and not smaller:
                out.add((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_suffix_array_and_ranks():
    rng = random.Random(3)
    for _ in range(60):
        t = [rng.randrange(3) for _ in range(rng.randint(1, 60))] + [7]
        order, ranks = periods.suffix_array(np.array(t))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        for k, rank in enumerate(ranks):
            heads = [t[i : i + 2**k] for i in want]
            assert all(rank[i] == heads.index(t[i : i + 2**k]) for i in range(len(t)))


def test_range_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 200):
        values = rng.permutation(n)
        lo = rng.integers(0, n, 300)
        hi = lo + rng.integers(0, n + 1 - lo)
        after = rng.integers(0, n, 300)
        got = periods.WaveletMatrix(values).successor(lo, hi, after)
        want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(lo, hi, after)]
        assert got.tolist() == want


@pytest.mark.parametrize("least,turns", [(6, 4), (1, 4), (12, 6)])
def test_runs_of_random_words(least, turns):
    rng = random.Random(least)
    for _ in range(400):
        n, kinds = rng.randint(0, 80), rng.choice([1, 2, 3, 6])
        t = [rng.randrange(kinds) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
        begin, end, period = periods.runs_of(np.array(t + [99]), least, turns)
        assert list(zip(begin.tolist(), (end - begin).tolist(), period.tolist())) == plain_runs(t, least, turns)


def plain_period_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS_11 = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periods_of_the_whole_table(spark):
    got = QUERIES["op11_periods"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    for r in got:
        assert tuple(r[c] for c in COLUMNS_11) == plain_period_row(r.doc_id, texts[r.doc_id]), r.doc_id


def test_periods_of_odd_texts(spark):
    many = " ".join(f"w{k % 611}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 7), (4, "a " * 7), (None, "x y " * 9), (5, "a b c"), (6, many),
            (7, "a a a a a"), (8, "\x1ca b \x0b" * 6), (9, "a b a b a b a b c c c c c c")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, top string")
    got = periods.digests(periods.periodic_runs(docs, periods.periodic_tail)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id != 6:
            assert tuple(r[c] for c in COLUMNS_11) == plain_period_row(r.doc_id, texts[r.doc_id]), r.doc_id
    long = next(r for r in periods.periodic_runs(docs).collect() if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 611)] and len(long.collapsed.split()) == 611
    assert periods.digests(periods.periodic_runs(docs.limit(0))).collect() == []


# ---- token links ----------------------------------------------------------------


def plain_token_links(rows):
    """One dict of the contract's columns per row, link by link."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in plain):
        letter[b] = chr(256 + k)
    byte = {c: b for b, c in letter.items()}
    done = []
    for doc_id, text in rows:
        sides = []
        if text:
            ids = a_tok.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(byte[c] for c in a_tok.id_to_token(i))) for i in ids])
            ids = b_tok.encode(text)
            pieces = [(i, b_tok.id_to_piece(i)) for i in ids]
            sides.append([(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
            if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
                sides = []
        spans = []
        for s in sides:
            at, out = 0, []
            for i, x in s:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        done.append((doc_id, *(spans or ([], []))))
    count = Counter()
    linked = []
    for _, a, b in done:
        mine = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        linked.append(mine)
        count.update(set(mine))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, a, b), mine in zip(done, linked):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        text = ";".join(
            ",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(x[0]) for x in b if lo < x[2] <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        )
        out.append(
            (doc_id, len(a), len(b), len(cuts), len(mine), sum(count[p] == most[p[0]] for p in mine),
             sum(count[p] for p in mine), sha(text) if a else "")
        )
    return out


COLUMNS_12 = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "plain words here"), (4, "plain words here"), (None, "other words"),
    (5, "<|endoftext|> and <s> </s> <0x41> <unk>"), (6, "naïve 中文字 \U0001f600 é"), (7, "two  blanks\n\n\ttab "),
    (8, "ﬁ ① Ａ   x"), (9, "a▁b"), (10, "wordword" * 300), (11, "\x00\x01 z"), (12, "words " * 3000),
]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("held,fan_in", [(4_000_000, 16), (4_000_000, 2), (0, 16)])
def test_token_links_of_odd_texts(spark, held, fan_in):
    docs = spark.createDataFrame([(*r, 1, "z", 3) for r in ODD], "doc_id long, text string, row int, a string, pair int")
    got = token_links.digests(token_links.token_links(docs.repartition(5), held_pairs=held, fan_in=fan_in)).collect()
    short = [r for r in ODD if r[0] != 12]
    want = plain_token_links([*short, (12, "words " * 3000)])
    assert in_order([tuple(r[c] for c in COLUMNS_12) for r in got]) == in_order(want)


def test_token_links_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    few = sorted(rows, key=lambda r: len(r[1] or ""))[:120]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    got = token_links.digests(token_links.token_links(docs)).collect()
    assert in_order([tuple(r[c] for c in COLUMNS_12) for r in got]) == in_order(plain_token_links(few))
    whole = QUERIES["op12_token_links"](spark, SMALL).collect()
    assert len(whole) == len(rows) and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in whole)


def test_token_links_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_links.token_links(docs).collect() == []
    rows = token_links.digests(token_links.token_links(spark.createDataFrame([(1, None)], docs.schema))).collect()
    assert [tuple(r[c] for c in COLUMNS_12) for r in rows] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50_257 * 32_000, 60_000))
    shard = token_links.shard_of(keys, 5)
    parts = []
    for s in range(5):
        levels = token_links.perfect_levels(keys[shard == s])
        number = token_links.numbering(levels)(keys[shard == s])
        by_number = np.empty(len(number), np.int64)
        by_number[number] = keys[shard == s]
        parts.append(([len(x) for x in levels], np.packbits(np.concatenate(levels)).tobytes(), by_number))
    index = token_links.PairIndex(parts)
    number = index.number(keys)
    assert sorted(number.tolist()) == list(range(len(keys))) and (index.keys[number] == keys).all()
    others = np.setdiff1d(rng.integers(0, 50_257 * 32_000, 5_000), keys)
    assert (index.number(others) == -1).all()


# ---- curriculum -------------------------------------------------------------------


def plain_targets(sizes, weights, share=1.5, passes=2):
    """Targets by resharing until none is above its limit."""
    left, free, out = share * sum(sizes.values()), {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    while free:
        all_w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / all_w > passes * sizes[s]}
        if not over:
            for s in free:
                out[s] = left * weights[s] / all_w
            break
        for s in over:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_curriculum_on_the_whole_table(spark):
    assert difference(QUERIES["op13_curriculum"](spark, SMALL), connect(SMALL), ORACLE_SQL["op13_curriculum"]) is None
    rows = QUERIES["op13_curriculum"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size = {k: len((r.text or "").encode().split()) for k, r in docs.items()}
    sources = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s))
    sizes = {s: sum(size[k] for k, r in docs.items() if r.source == s) for s in sources}
    want = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)})
    taken = Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sources)


def test_curriculum_follows_its_schedule(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    knots = [("a", 0.0, 0.0), ("a", 0.5, 0.0), ("a", 1.0, 4.0), ("b", 0.0, 2.0), ("b", 0.25, 1.0), ("c", 0.0, 1.0)]
    schedule = spark.createDataFrame(knots, "source string, at double, weight double")
    order = curriculum.mix(docs, schedule, share=0.5).orderBy("place").collect()
    used = [r for r in order if r["pass"] is not None]
    assert [r.place for r in order] == list(range(len(order))) and used == order[: len(used)]
    assert all(x.position <= y.position for x, y in zip(used, used[1:]))
    total = sum(r["size"] for r in used)
    areas = {"a": 1.0, "b": 0.375 + 0.75}
    upto = {"a": lambda t: 0 if t < 0.5 else 4 * (t - 0.5) ** 2, "b": lambda t: 2 * t - 2 * t * t if t < 0.25 else 0.375 + t - 0.25}
    for t in (0.2, 0.5, 0.8, 1.0):
        for s, area in upto.items():
            got = sum(r["size"] for r in used if r.source == s and r.position <= t)
            assert got == pytest.approx(total * area(t) / sum(areas.values()), abs=20)


def test_curriculum_of_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", None), (2, None, "x"), (3, "", "y"), (None, "a b", "y"),
            (4, " ".join("w" * 3 for _ in range(40_000)), "z"), (5, "a\x0bb c", "\U0001f600"), (6, "q " * 50, "￮")]
    docs = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id long, text string, source string, size int, position string")
    got = curriculum.taken_words(curriculum.mix(docs)).collect()
    sizes = sorted(len((t or "").encode().split()) for _, t, _ in rows)
    assert sorted(r["size"] for r in got) == sizes
    by_source = Counter()
    for _, t, s in rows:
        by_source[s] += len((t or "").encode().split())
    names = sorted(by_source, key=lambda s: (s is None, s))
    want = plain_targets(by_source, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)})
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(v, 6) for v in want.values()})
    again = curriculum.taken_words(curriculum.mix(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    empty = curriculum.mix(docs.limit(0))
    assert empty.collect() == [] and curriculum.taken_words(curriculum.mix(docs.filter("size = 9"))).collect() == []
    blank = curriculum.taken_words(curriculum.mix(docs.filter("doc_id = 2"))).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)]


def test_curriculum_runs_no_python(spark):
    plan = curriculum.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert isinstance(F.lit(1), type(curriculum.source_key(F.col("source"))))
