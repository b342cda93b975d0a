"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows of 13 words are sets of positioned five-word shingles. A document that holds a window
holds all of its shingles, so one shingle, the rarest over all documents, is prefix enough: only its
occurrences are candidates. A candidate's start follows from the shingle's place in the window and must
leave room for the whole window; its words are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

WINDOW = 13
SHINGLE = 5
BROADCAST_ROWS = 1_000_000  # benchmark shingles sent to all executors, at most (16 bytes each)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered; none of NULL."""
    text = F.coalesce(text, F.lit(""))
    # lower() is fast but would also change letters beyond ASCII.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )
    return F.array_remove(F.split(lowered, _GAPS), "")


def _shingle(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(array, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, win, length): every window of every item, its words joined by blanks."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))))
    return (
        items.select("item_id", "w", at.alias("i"))
        .select("item_id", F.expr(f"slice(w, i + 1, {WINDOW})").alias("w"))
        .select("item_id", F.concat_ws(" ", "w").alias("win"), F.size("w").alias("length"))
        .distinct()
    )


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(win, length, size, offset, shingle) of the distinct windows."""
    parts = None
    for size in range(1, SHINGLE + 1):
        fits = F.col("length") >= SHINGLE if size == SHINGLE else F.col("length") == size
        part = (
            windows.select("win", "length")
            .distinct()
            .filter(fits)
            .select("win", "length", F.split("win", " ").alias("w"))
            .select("win", "length", "w", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
            .select("win", "length", F.lit(size).alias("size"), "offset", _shingle(F.col("w"), F.col("offset"), size).alias("shingle"))
        )
        parts = part if parts is None else parts.union(part)
    return parts


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("key"),
        "text",
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document.

    ``n_hit`` counts words inside an occurrence of a window (13 consecutive words of an item, or all
    words of a shorter item); ``n_items`` the items with such windows; ``items_sha256`` the hash of
    their ids, sorted as strings and joined by commas. A document is contaminated if n_hit > 0 and
    20 * n_hit >= n_words.

    NULL and empty texts have no words and no hits; items without words have no windows; an empty
    benchmark hits nothing. Rows that repeat doc_id and text give one row; rows with a NULL doc_id
    are kept. A repeated item_id is one item with the windows of all its rows, a NULL one is not counted
    among the items. Other columns are ignored.
    """
    windows = stage(item_windows(benchmark), "windows")
    grams = stage(_window_shingles(windows), "window-shingles")
    known = grams.select("shingle").distinct()
    sizes = sorted({r["size"] for r in grams.select("size").distinct().collect()} | {SHINGLE})
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    texts = _key(docs).select("doc_id", "key", words(F.col("text")).alias("w"))
    texts = texts.withColumn("n_words", F.size("w"))
    found = None
    for size in sizes:
        # Place -1 stands for the document itself, which stays whether or not a shingle is found.
        lowest = -1 if size == SHINGLE else 0
        spots = texts.filter(F.col("n_words") - size >= lowest) if size != SHINGLE else texts
        last = F.greatest(F.col("n_words") - size, F.lit(lowest))
        spots = spots.select("doc_id", "key", "n_words", "w", F.explode(F.sequence(F.lit(lowest), last)).alias("at"))
        spots = spots.select(
            "doc_id", "key", "n_words", "at",
            F.when(F.col("at") >= 0, _shingle(F.col("w"), F.col("at"), size)).alias("spot"),
        )
        joined = spots.join(known, F.col("spot") == F.col("shingle"), "left").filter(
            "at < 0 or shingle is not null"
        )
        part = joined.select("doc_id", "key", "n_words", "at", "shingle")
        found = part if found is None else found.union(part)
    found = stage(found, "shingle-hits")

    seen = found.filter("at >= 0")
    rarity = seen.groupBy("shingle").agg(F.count("*").alias("freq"))
    anchors = stage(
        grams.join(rarity, "shingle")
        .groupBy("win", "length", "size")
        .agg(F.min(F.struct("freq", "offset", "shingle")).alias("rarest"), F.count("*").alias("present"))
        .filter("present = length - size + 1")
        .select("win", "length", "rarest.offset", "rarest.shingle"),
        "anchors",
    )
    candidates = stage(
        seen.join(anchors, "shingle")
        .select("doc_id", "key", (F.col("at") - F.col("offset")).alias("start"), "length", "win", "n_words")
        .filter("start >= 0 and start + length <= n_words")
        .distinct(),
        "candidates",
    )
    suspects = candidates.select("key").distinct()
    held = stage(
        _key(docs).join(suspects.hint("merge"), "key", "left_semi").select("doc_id", "key", words(F.col("text")).alias("w")).distinct(),
        "suspects",
    )
    place = candidates.alias("c")
    same = (
        (F.col("c.key") == F.col("d.key"))
        & F.col("c.doc_id").eqNullSafe(F.col("d.doc_id"))
        & (F.expr("concat_ws(' ', slice(d.w, c.start + 1, c.length))") == F.col("c.win"))
    )
    hits = stage(place.join(held.alias("d"), same).select("c.doc_id", "c.key", "c.start", "c.length", "c.win"), "hits")

    covered = (
        hits.groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("runs"))
        .select(
            F.col("doc_id").alias("hit_id"),
            F.col("key").alias("hit_key"),
            F.expr(
                """aggregate(runs, struct(0L as n, 0 as upto),
                   (a, r) -> struct(a.n + greatest(r.end - greatest(r.start, a.upto), 0) as n,
                                    greatest(a.upto, r.end) as upto)).n"""
            ).alias("n_hit"),
        )
    )
    items = (
        hits.select("doc_id", "key", "win")
        .distinct()
        .join(windows.select("win", "item_id"), "win")
        .filter("item_id is not null")
        .groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select(F.col("doc_id").alias("item_doc"), F.col("key").alias("item_key"), "ids")
    )
    base = found.filter("at < 0").select("doc_id", "key", "n_words").distinct()
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        base.join(covered, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
        .join(items, (F.col("key") == F.col("item_key")) & F.col("doc_id").eqNullSafe(F.col("item_doc")), "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
            "key",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; all columns stay as they are."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("key").alias("bad")).distinct()
    row = F.struct("*").alias("row")  # so that no column of the input clashes
    keyed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    rows = docs.select(row, keyed.alias("key"))
    return rows.join(bad.hint("merge"), F.col("key") == F.col("bad"), "left_anti").select("row.*")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i) WHERE len(w) > 0),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, i, n, item_id FROM g JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit),
  LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
