"""Learners on held-out rows, search, packing, tool calls and the pipeline."""

import json
import random
import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from rankfield.llm import chat, components, langid, near, packing, staging, topk, toxicity
from rankfield.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(40)] + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and got[230] == 100 and got[501] == 500
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    n = 400
    a = {int(x): w for x, w in zip(rng.integers(0, 2**47, 60), rng.uniform(0.2, 5, 60))}
    b = dict(list(a.items())[:45]) | {int(x): 1.0 for x in rng.integers(0, 2**47, 20)}
    expected = 0.0
    for x in set(a) & set(b):
        expected += 1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in set(a) | set(b))
    sets = [a, b]
    text = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    element = np.concatenate([np.array(list(s), np.uint64) for s in sets])
    weight = np.concatenate([np.array(list(s.values())) for s in sets])
    order = rng.permutation(len(text))
    sketch = near.prob_minhash(text[order], element[order], weight[order], 3, m=n)
    assert abs((sketch[0] == sketch[1]).mean() - expected) < 4 * (expected * (1 - expected) / n) ** 0.5
    assert not sketch[2].any()


def test_toxicity_on_held_out_rows(spark):
    docs = staging.documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"))
    assert (np.diff(model.cuts) > 0).all()
    rows = toxicity.score(docs, model).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    toxic = [r.p_toxic >= model.reject for r in rows if r.toxic]
    clean = [r.p_toxic >= model.reject for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
    assert all(0 <= r.severity <= len(model.cuts) for r in rows)


def test_toxicity_of_odd_rows(spark):
    texts = [(k, "fine words here") for k in range(20)] + [(k, "awful words here") for k in range(20, 40)]
    docs = spark.createDataFrame(texts + [(40, None), (41, ""), (41, ""), (None, "awful")], "doc_id long, text string")
    docs = docs.withColumn("toxic", docs.doc_id)
    labels = spark.createDataFrame(
        [(k, int(k >= 20), 1) for k in range(40)] + [(1, None, 1), (None, 1, 1), (2, 0, 1)], "doc_id long, toxic int, text int"
    )
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 44
    by_id = {r.doc_id: r.p_toxic for r in got}
    assert by_id[30] > 0.5 > by_id[3] and by_id[None] > 0.5 and by_id[40] == by_id[41]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 23
    one_kind = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()
    assert all(r.p_toxic < 0.01 and r.grade == 0 for r in one_kind)


def test_ordinal_fit_orders_cuts_and_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 2000)
    who = np.repeat(np.arange(2000), grade)
    weight, cuts = toxicity.fit_cumulative(who, np.zeros(len(who), int), grade, 1)
    assert weight[0] > 0 and (np.diff(cuts) > 0).all()
    assert all(cuts[k] > k * weight[0] for k in range(3)) and all(cuts[k] < (k + 1) * weight[0] for k in range(3))


def test_language(spark):
    rows = QUERIES["op9_language"](spark, MIDDLE).collect()
    lang = {r.doc_id: r.lang for r in staging.documents(spark, MIDDLE).collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in lang if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(lang)


def test_language_of_odd_texts(spark):
    rows = [(1, "the and of", "en"), (2, "der und die", "de"), (3, None, "en"), (4, "12 !", "de"), (4, "12 !", "de"),
            (5, "é", None), (None, "the of", "en"), (6, "the and of", "en"), (7, "der die das", "de"), (8, "", None)]
    docs = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "doc_id long, text string, lang string, bucket int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].lang_pred == by_id[4].lang_pred == by_id[8].lang_pred == "und"
    assert by_id[5].lang_pred in ("de", "en") and by_id[6].lang_pred == "en" and by_id[None].held_out
    nothing = langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang is null")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in nothing)


def test_language_grams_are_characters():
    import pyarrow as pa

    texts = ["Straße 12", None, "", "日本語の文", "Привет, МИР", "İx", "a", "𝒳y"]
    who, what = langid.grams(pa.array(texts))
    low = ["".join(" " if ord(c) < 65 else c.lower() if len(c.lower()) == 1 else c for c in t or "") for t in texts]
    assert [int((who == k).sum()) for k in range(len(texts))] == [sum(max(0, len(t) - g + 1) for g in langid.GRAMS) for t in low]
    bucket: dict = {}
    for g in langid.GRAMS:
        alone = [(t[i : i + g]) for t in low for i in range(len(t) - g + 1)]
        for gram in alone:
            w, b = langid.grams(pa.array([gram]))
            bucket[gram] = int(b[-1])  # the longest gram of a text of its length
    want = [sorted(bucket[t[i : i + g]] for g in langid.GRAMS for i in range(len(t) - g + 1)) for t in low]
    assert [sorted(what[who == k].tolist()) for k in range(len(texts))] == want


def test_language_of_scripts_and_long_texts(spark):
    """Texts that share no word with what was learned, told apart by their characters; a text of 2 MB."""
    lines = {"ru": "сегодня хорошая погода и мы идём гулять в парк ", "bg": "днес времето е хубаво и ние отиваме на разходка ъ ",
             "ja": "今日は天気がいいので公園へ散歩に行きます", "zh": "今天天气很好我们去公园散步吧"}
    rows = [(k * 10 + i, text * (i + 1), lang) for k, (lang, text) in enumerate(lines.items()) for i in range(8)]
    rows += [(900 + k, text * (2_000_000 // len(text)) if k == 0 else text[3:14], None) for k, text in enumerate(lines.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [got[900 + k] for k in range(4)] == list(lines)


def _top(rows, ask, k=10):
    out = {}
    use = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    for q, v in use:
        if ask(q):
            best = sorted((-int(v @ w), i) for i, w in use if i != q and len(w) == len(v))[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=4).round(1)]) for k in range(60)]
    rows += [(60 + k, rows[20][1]) for k in range(30)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (300, [1.0, 2.0]),
             (310, [3.0, -1.0]), (320, [1e15, -1e15]), (400, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), query_block=block).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: x for q, x in _top(rows, lambda q: q % 20 == 0).items() if x}
    assert {q: sorted(x) for q, x in by_query.items()} == want
    monkeypatch.setattr(topk, "FAN", 2)
    again = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), query_block=block).collect()
    assert sorted(again) == sorted(got)
    assert topk.top_k(frame, frame.limit(0)).collect() == []


@pytest.mark.parametrize("shard_rows", [1, 40, 700])
def test_top_k_over_shards(spark, monkeypatch, shard_rows):
    """Shards down to a row each, tiles of 16 rows, ids and whole rows that repeat."""
    rng = np.random.default_rng(9)
    n = 60 if shard_rows == 1 else 900
    rows = [(k, [float(x) for x in rng.normal(size=6).round(2)]) for k in range(n)]
    rows += [(7, rows[7][1])] * (n // 3) + [(11, [float(x) for x in rng.normal(size=6).round(2)]) for _ in range(20)]
    monkeypatch.setattr(topk, "TILE", 16)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asking = frame.filter("vec_id % 5 = 0")
    got = topk.top_k(frame, asking, query_block=32, shard_rows=shard_rows).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in by_query.items()} == _top(rows, lambda q: q % 5 == 0)
    plan = topk.top_k(frame, asking, shard_rows=shard_rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan


ODD = ["It's don't we'll I'd they've I'm you're ''s 's' 12ab3  x!'s <|endoftext|> hi", "ΑΣ ΟΔΟΣ", "İstanbul é é ﬁ ß ẞ",
       "日本語 12３ ½ٱ a​b c\x1cd\x85e'", "", "   ", "a'st 're're'x", "\U0001F600\U0001F600'll<|", "'sam x''d y'D 'S", None]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ODD[:-1]:
        assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    together = own.encode(ODD[:-1])
    assert [x.tolist() for x in together] == [own.encode([t])[0].tolist() for t in ODD[:-1]]


@pytest.mark.parametrize("capacity,packer", [(4096, 200_000), (16, 7)])
def test_packing(spark, capacity, packer):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["the", "an", "ou"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, packer int")
    rows = packing.pack(docs, capacity, packer_pieces=packer).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    ids = {k: plain.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    bins = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * capacity and len(piece) == r.length <= capacity
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[3])
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    if packer > 100:
        assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + 1


def test_packers_of_one_task(spark, monkeypatch):
    """Any number of packers in a task gives the same sequences."""
    docs = spark.createDataFrame([(k, "some words " * (k * 37 % 90)) for k in range(300)], "doc_id long, text string").coalesce(1)
    apart = packing.pack(docs, 64, packer_pieces=20)
    assert apart.rdd.getNumPartitions() > 10
    want = sorted(apart.collect())
    for partitions in (1, 3):
        monkeypatch.setattr(packing, "PARTITIONS", partitions)
        together = packing.pack(docs, 64, packer_pieces=20)
        assert together.rdd.getNumPartitions() == partitions
        assert sorted(together.collect()) == want


def test_placement_takes_the_smallest_sum_of_squares():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 20) for _ in range(300)), reverse=True)
    where, offset = packing.place_all(np.array(sizes), 20)
    gap = {}
    for s, b, o in zip(sizes, where, offset):
        fits = [g for g in gap.values() if g >= s]

        def squares(b, s):
            left = dict(gap)
            left[b] -= s
            counts = np.bincount([g for g in left.values() if g], minlength=21)
            return (counts**2).sum()

        if fits:
            best = min(squares(c, s) for c, g in gap.items() if g >= s)
            assert b in gap and squares(b, s) == best
        else:
            assert b not in gap
            gap[b] = 20
        assert o == 20 - gap[b]
        gap[b] -= s


def test_tool_calls(spark):
    calls = [
        (1, 1, "a", "search", '{"limit": 3, "query": "x\\"é"}', None), (1, 3, "b", "search", '{"query":1,"limit":2}', "a"),
        (1, 5, "c", "count", '{"limit": 2, "more": 1}', "b"), (1, 7, "d", "nope", "{}", "c"), (1, 9, "e", "count", "[1]", "x"),
        (1, 11, "f", "count", '{"limit": 2', "d"), (2, 1, "a", "count", '{ "limit" : 7 }', "b"), (2, 2, "b", "count", '{"limit":7}', "a"),
        (2, 3, "c", "count", '{"limit":7}', "b"), (2, 4, "d", "count", '{"limit":7.5}', None), (2, 5, "e", "count", None, None),
        (1, 1, "a", "search", '{"limit": 3, "query": "x\\"é"}', None), (None, 1, "a", "count", "{}", None), (3, 1, None, "count", "{}", None),
        (4, 1, "a", "count", '{"limit":7}', "a"), (5, 1, "a", None, "{}", None), (6, 1, "a", "lookup", '{"query":"q"}', None),
    ]
    results = [(1, 2, "a", "r\n1"), (1, 4, "z", None), (2, 9, "c", "r"), (1, 8, "a", "later"), (None, 1, "a", ""), (6, 2, "a", "")]
    got = chat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string").withColumn("depth", chat.F.lit(1)),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").withColumn("status", chat.F.lit(1)),
        chat.TOOLS,
    ).collect()
    at = {(r.conv_id, r.call_id, r.kind): r for r in got}
    assert len(at) == len(got) == 18
    status = {k[:2]: (r.status, r.depth) for k, r in at.items() if k[2] == "call"}
    assert status == {
        (1, "a"): ("linked", 0), (1, "b"): ("invalid", 1), (1, "c"): ("invalid", 2), (1, "d"): ("unknown_tool", 3),
        (1, "e"): ("malformed", 0), (1, "f"): ("malformed", 4), (2, "a"): ("cycle", None), (2, "b"): ("cycle", None),
        (2, "c"): ("cycle", None), (2, "d"): ("invalid", 0), (2, "e"): ("malformed", 0), (4, "a"): ("cycle", None),
        (5, "a"): ("unknown_tool", 0), (6, "a"): ("linked", 0),
    }
    assert at[1, "a", "call"].copies == 2 and at[1, "a", "result"].copies == 2 and at[1, "z", "result"].status == "orphan"
    assert at[1, "a", "call"].line == '{"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x\\"é"},"id":"a","name":"search"}]}'
    assert at[1, "a", "result"].line == '{"content":"r\\n1","role":"tool","tool_call_id":"a"}'
    assert all(json.loads(r.line) for r in got)
    empty = chat.link_tool_calls(*[spark.createDataFrame([], s) for s in ("conv_id long, turn long, call_id string, name string, arguments string, after string", "conv_id long, turn long, call_id string, content string")], chat.TOOLS)
    assert empty.collect() == []


def test_pipeline(spark):
    docs = staging.documents(spark, MIDDLE)
    names, before = docs.columns, docs
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.p_toxic for r in toxicity.score(docs, model).collect()}
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = staging.stage(step(spark, docs, MIDDLE), f"test-{name}")
        assert docs.columns == names
        kept.append({r.doc_id: r.text for r in docs.collect()})
    texts = {r.doc_id: r.text for r in before.collect()}
    assert kept[0] == {k: t for k, t in texts.items() if scores[k] < model.reject}
    classes = near_classes_fast(kept[0])
    assert set(kept[1]) == {k for k in kept[0] if classes[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    bad = {k for k, v in brute.contamination(list(kept[1].items()), items).items() if v[-1]}
    assert bad and set(kept[2]) == set(kept[1]) - bad
    assert set(kept[3]) == set(kept[2])
    for k, t in kept[2].items():
        assert (kept[3][k] == t) or brute.base_spans(t)
        assert not brute.base_spans(kept[3][k])
    packed = corpus_pipeline.run(spark, MIDDLE).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def near_classes_fast(texts):
    """Like brute.near_classes, comparing only texts that share a shingle."""
    holders = {}
    for k, t in texts.items():
        for s in brute.shingle_set(t):
            holders.setdefault(s, []).append(k)
    up = {k: k for k in texts}
    pairs = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    sets = {k: brute.shingle_set(texts[k]) for k in {x for p in pairs for x in p}}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return {k: top(k) for k in texts}
