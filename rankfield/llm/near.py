"""MinHash near-dedup with ProbMinHash.

Every distinct text gets a ProbMinHash sketch of its word shingles, all of one weight as in the links: each shingle is a
Poisson process whose rate is its weight, each arrival falls into one register, and a register keeps
the shingle that arrived first. Two sketches agree in a register with the probability Jaccard
similarity of the texts. Runs of registers are band keys; texts sharing a band key are candidates and
verified by the Jaccard similarity of their sets of word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .staging import stage
from .wordhash import SHINGLE, U, mix, powers, shingles, signed, slices, word_hashes

REGISTERS = 60
ROWS = 3  # registers of a band
SIMILARITY = 0.8
BIN_BITS = 9
BINS = 1 << BIN_BITS  # of the set sketch, one byte each
LEADERS = 4  # members of a bucket's largest component that those outside it are compared to
SIDE = 256  # members of a block where what the leaders left open is compared

_STEP = 0xD1B54A32D192ED03


def weights(count: np.ndarray) -> np.ndarray:
    """Weights of shingles by their occurrences in a text: equal, as links compare sets. A repeated passage of more weight
    would lower the sketches' similarity below that of the sets."""
    return np.ones(len(count))


def distinct_shingles(who: np.ndarray, what: np.ndarray):
    """(text number, 48 bits of the hash, occurrences) of a slice's distinct shingles."""
    key = np.sort((who.astype(U) << U(48)) | (what >> U(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), count


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS):
    """Sketches of ``n`` weighted sets, given as (set, element, weight) rows, as an n x m array.

    Arrivals are generated element by element, in order of time, and an element stops as soon as its
    next arrival is later than every register of its set. Sets without elements keep zeros.
    """
    time = np.full(n * m, np.inf)
    kept = np.zeros(n * m, U)
    total = np.bincount(text, weight, n)
    # Few arrivals later than this reach a register; those that might wait for the next window.
    until = np.divide(m * (np.log(m) + 6), total, out=np.zeros(n), where=total > 0)
    last = np.full(n, np.inf)
    when, turn = np.zeros(len(text)), np.zeros(len(text), U)
    draw = None
    while len(text):
        draw = mix(element + (turn + U(1)) * U(_STEP)) if draw is None else draw
        register = (draw & U(0xFFF)) * U(m) >> U(12)
        at = when - np.log(((draw >> U(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        alive = at < last[text]
        now = alive & (at < until[text])
        cell = text[now] * m + register[now].astype(np.int64)
        t, e = at[now], element[now]
        first = t < time[cell]
        cell, t, e = cell[first], t[first], e[first]
        order = np.lexsort((e, -t))[::1]
        time[cell[order]], kept[cell[order]] = t[order], e[order]
        last = time.reshape(n, m).max(axis=1)
        moved = now
        when = np.where(moved, at, when)
        turn = turn + moved.astype(U)
        alive &= at < last[text]
        text, element, weight, when, turn = text[alive], element[alive], weight[alive], when[alive], turn[alive]
        draw = None
        if not now.any():
            open_ = np.unique(text)
            until[open_] *= 2
    return kept.reshape(n, m)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each run of ``rows`` registers; the run's place is part of the key."""
    n, m = sketch.shape
    bands = sketch.reshape(n, m // rows, rows)
    key = np.arange(1, m // rows + 1, dtype=U) * U(_STEP) + np.zeros((n, 1), U)
    for k in range(rows):
        key = mix(key ^ bands[:, :, k])
    return key


def text_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each text's sequence of words."""
    up, down = powers(len(hashes) + 1)
    p = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=p[1:])
    return mix((p[first[1:]] - p[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(U))


def bins(text: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """Set sketches, n x BINS bytes: elements fall into bins by hash, and a bin keeps a byte of its smallest
    element, 0 if it has none."""
    h = mix(element + U(_STEP))
    key = np.sort((text.astype(U) << U(32 + BIN_BITS)) | ((h & U(BINS - 1)) << U(32)) | (h >> U(32)))
    cell = (key >> U(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.zeros(n * BINS, np.uint8)
    out[cell[first]] = 1 + ((key[first] & U(0xFFFFFFFF)) % U(255)).astype(np.uint8)
    return out.reshape(n, BINS)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = part.column("text")
        h, first = word_hashes(texts)
        other, _ = word_hashes(texts, seed=1)
        n = len(texts)
        who, what, count = distinct_shingles(*shingles(h, first))
        keys = band_keys(prob_minhash(who, what, weights(count), n))
        mask = pa.array(np.diff(first) == 0)
        width = keys.shape[1]
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "h1": signed(text_hash(h, first)),
                "h2": signed(text_hash(other, first)),
                "n_words": pa.array(np.diff(first)),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), signed(keys.ravel()), mask=mask
                ),
                "n_shingles": pa.array(np.bincount(who, minlength=n)),
                "bins": pa.array([row.tobytes() for row in bins(who, what, n)], pa.binary()),
            }
        )


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(iter([whole]), "text_a"):
            sides = []
            for name in ("text_a", "text_b"):
                who, what, _ = distinct_shingles(*shingles(*word_hashes(part.column(name))))
                sides.append((who.astype(U) << U(48)) | what)
            n = part.num_rows
            left, right = (np.bincount((s >> U(48)).astype(np.int64), minlength=n) for s in sides)
            both = np.sort(np.concatenate(sides))
            shared = (both[1:][both[1:] == both[:-1]] >> U(48)).astype(np.int64)
            shared = np.bincount(shared, minlength=n)
            union = left + right - shared
            yield pa.record_batch(
                {
                    "a": part.column("a"),
                    "b": part.column("b"),
                    "similarity": pa.array(np.divide(shared, union, out=np.zeros(n), where=union > 0)),
                }
            )


def possible(a: np.ndarray, b: np.ndarray, size_a, size_b, similarity: float) -> np.ndarray:
    """Whether set sketches allow a similarity: their share of equal bins may be four standard deviations
    lower. A filled bin shows one element of the union, so a union that the bins show whole has
    little deviation left; elements that share a bin add a little."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    share = ((a == b) & (a > 0)).sum(axis=1) / filled
    union = np.maximum((size_a + size_b) / (1 + similarity), 1)
    unseen = np.clip(1 - filled / union, 0, 1)
    return share >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / filled * unseen) - 0.02


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _plausible(pairs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose set sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b = (_bytes(part.column(c)) for c in ("bins_a", "bins_b"))
            sizes = (np.asarray(part.column(c)) for c in ("n_a", "n_b"))
            keep = pa.array(possible(a, b, *sizes, similarity))
            yield pa.record_batch([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    sides = [
        sketch.select(F.col("rep").alias(c), F.col("bins").alias(f"bins_{c}"), F.col("n_shingles").alias(f"n_{c}"))
        for c in "ab"
    ]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        who, what, _ = distinct_shingles(*shingles(*word_hashes(part.column("text"))))
        ends = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), signed(what))
        yield pa.record_batch([part.column("doc_id"), lists], names=["rep", "shingles"])


def _links_in_blocks(similarity: float):
    """Links between members of different components within a block of a bucket, one for each member and other
    component: set sketches rule most pairs out, the others are compared set by set. A pair is looked at in
    the first band it shares."""

    def side(member: pa.StructArray):
        n = len(member)
        sizes = np.asarray(member.field("shingles").value_lengths())
        flat = np.asarray(member.field("shingles").flatten()).view(U)
        who = np.repeat(np.arange(n), sizes)
        bands = np.asarray(member.field("bands").flatten()).reshape(n, -1)
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        return np.asarray(member.field("rep")), np.asarray(member.field("component")), sizes, bins(who, flat, n), bands, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out_a, out_b = [], []
            for k in range(part.num_rows):
                band = part.column("band")[k].as_py()
                left, right = part.column("left")[k].values, part.column("right")[k].values
                if not len(left) or not len(right):
                    continue
                rep, component, size, sketch, bands, sets = side(left)
                rep_r, component_r, size_r, sketch_r, bands_r, sets_r = side(right)
                place = int(np.flatnonzero(bands[0] == band)[0])
                for i in range(len(rep)):
                    some = np.flatnonzero(component_r != component[i])
                    some = some[~(bands_r[some, :place] == bands[i, :place]).any(axis=1)]
                    some = some[possible(sketch[i][None], sketch_r[some], size[i], size_r[some], similarity)]
                    linked = set()
                    for j in some:
                        if component_r[j] in linked:
                            continue
                        shared = len(np.intersect1d(sets[i], sets_r[j], assume_unique=True))
                        if shared >= (similarity - 1e-12) * (size[i] + size_r[j] - shared):
                            linked.add(component_r[j])
                            out_a.append(min(rep[i], rep_r[j]))
                            out_b.append(max(rep[i], rep_r[j]))
            if out_a:
                yield pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents of ``ids(doc_id)``."""
    joined = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id")
    return stage(joined.groupBy("doc_id").agg(F.min("text").alias("text")), "near-texts")


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are similar enough."""
    members = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    text = _texts(members, docs)
    a = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return scored.mapInArrow(_jaccard, "a long, b long, similarity double").filter(
        F.col("similarity") >= similarity - 1e-12
    )


def _one_row_each(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with one row per doc_id, that of its smallest text. Ids are counted without their texts;
    only texts of repeated ids are grouped."""
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    twice = stage(counted, "near-repeated-ids")
    if twice.isEmpty():
        return docs
    smallest = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(twice, "doc_id", "left_anti").unionByName(smallest)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, rep_id, class_id, n_links) for every doc_id of ``docs(doc_id, text, ...)``.

    Texts of the same words (case and punctuation aside) share ``rep_id``, the smallest doc_id among
    them. ``class_id`` is the smallest doc_id of the group of texts joined by links, a link being a
    Jaccard similarity of at least ``similarity`` between sets of five-word shingles (a text of one to
    four words is one shingle). ``n_links`` counts the links of the row's representative that were needed to find its class.

    NULL, empty and wordless texts link to nothing: each is its own class. Rows without doc_id are
    left out; rows repeating a doc_id count as one document with its smallest text. Other columns are ignored.

    Copies collapse before anything is compared. In a band's bucket every member is compared to the
    bucket's leader, another leader in each band; where a bucket holds several components, those outside the
    largest one to some more of its members; members that still remain in different components are compared to each other in blocks. The last
    two go by a sketch of the sets first, then by the sets. No pair within a component is formed
    for its own sake, and none that shares a band is given up.
    """
    docs = _one_row_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"))
    rows = stage(
        docs.mapInArrow(
            _sketches, "doc_id long, h1 long, h2 long, n_words long, bands array<long>, n_shingles long, bins binary"
        ),
        "near-sketches",
    )
    wordy = rows.filter("n_words > 0")
    first = wordy.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = stage(
        wordy.select("doc_id", "h1", "h2")
        .join(first, ["h1", "h2"])
        .select("doc_id", "rep"),
        "near-members",
    )
    reps = rows.join(member.filter("doc_id = rep").select("doc_id").distinct(), "doc_id").select(
        F.col("doc_id").alias("rep"), "bands", "n_shingles", "bins"
    )
    entry = reps.select("rep", F.explode("bands").alias("band"))
    leader = (
        entry.groupBy("band")
        .agg(F.min_by("rep", F.xxhash64("rep", "band")).alias("leader"), F.count("*").alias("size"))
        .filter("size > 1")
    )
    placed = stage(entry.join(leader, "band"), "near-buckets")
    pairs = stage(
        placed.filter("rep <> leader")
        .select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
        .distinct(),
        "near-pairs",
    )
    links = stage(_verified(pairs, docs, similarity), "near-links")
    groups = components(links)

    def mixed(groups: DataFrame) -> DataFrame:
        """Members, with their component, of the buckets that still hold several components."""
        named = placed.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
        spread = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return named.join(spread.filter("lo <> hi").select("band"), "band")

    # More leaders, of the bucket's largest component, for the members outside it.
    loose = stage(mixed(groups), "near-loose")
    hub = (
        loose.groupBy("band", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("band")
        .agg(F.max_by("component", "n").alias("hub"))
    )
    hubbed = loose.join(hub, "band")
    by_hash = Window.partitionBy("band").orderBy(F.xxhash64("band", "rep"), "rep")
    heads = (
        hubbed.filter("component = hub")
        .withColumn("n", F.row_number().over(by_hash))
        .filter(F.col("n") <= LEADERS)
        .select("band", F.col("rep").alias("head"))
    )
    more = (
        hubbed.filter("component <> hub")
        .join(heads, "band")
        .select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    sketch = reps.select("rep", "n_shingles", "bins")
    more = stage(_plausible(more, sketch, similarity), "near-more-pairs")
    links = stage(links.union(_verified(more, docs, similarity)), "near-more-links")
    groups = components(links)

    # What leaders left open, in blocks of SIDE members.
    loose = stage(mixed(groups).select("band", "rep", "component", "size"), "near-rest")
    sets = _texts(loose.select(F.col("rep").alias("doc_id")).distinct(), docs)
    sets = stage(sets.mapInArrow(_sets, "rep long, shingles array<long>"), "near-sets")
    loose = (
        loose.join(sets.join(reps.select("rep", "bands"), "rep"), "rep")
        .withColumn("blocks", F.ceil(F.col("size") / SIDE).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    item = F.struct("rep", "component", "bands", "shingles")
    dealt = loose.select("band", "block", item.alias("item"), other.alias("other")).select(
        "band",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), F.col("item")).alias("l"),
        F.when(F.col("block") >= F.col("other"), F.col("item")).alias("r"),
    )
    rest = (
        dealt.groupBy("band", "i", "j")
        .agg(F.collect_list("l").alias("left"), F.collect_list("r").alias("right"))
        .select("band", "left", "right")
        .mapInArrow(_links_in_blocks(similarity), "a long, b long")
        .distinct()
    )
    links = stage(links.select("a", "b").union(rest).distinct(), "near-all-links")
    groups = components(links)

    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = member.select("rep").distinct().join(groups.withColumnRenamed("id", "rep"), "rep").join(degree, "rep", "left")
    return (
        rows.groupBy("doc_id")
        .agg(F.max("n_words").alias("n_words"))
        .join(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left")
        .join(named, "rep", "left")
        .select(
            "doc_id",
            F.coalesce("rep", "doc_id").alias("rep_id"),
            F.coalesce("component", "rep", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of the smallest doc_id; all columns
    stay as they are. Texts without words and rows without doc_id stay."""
    dropped = near_duplicates(docs, similarity).filter("class_id <> doc_id").select(F.col("doc_id").alias("dropped"))
    rows = docs.select(F.struct("*").alias("row"))  # so that no column of the input clashes
    return rows.join(dropped.hint("merge"), F.col("row.doc_id") == F.col("dropped"), "left_anti").select("row.*")
