"""Mixing sources to target weights as a curriculum that changes over training time.

Every source has a weight schedule over training time 0..1, straight lines between knots. Its integral is the source's
share of all words; the demand of a source up to a time is its target times the integral up to there. Documents of a
source stand in a seeded order, pass after pass, and a document's training position is the time at which the demand
reaches its middle word. Sorting all documents by position gives the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import with_one_row
from ..operators.rank import number_rows, running_total
from .staging import stage

SHARE = 1.5  # words of the mix, as a multiple of all words
PASSES = 2  # times that a document is taken, at most
WEIGHTS = (3.0, 1.0, 2.0)
RAMP = 0.5  # by how much a schedule rises or falls around its mean, as a share of it
SEED = 149
WORD = r"[^\x20\x09-\x0D]+"
KEY_DIGITS = 3  # leading hex digits of a document's key that name its block of the source


def source_key(source: Column) -> Column:
    """Text that sorts sources by code point and NULL last, and that joins NULL to NULL."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(src, source, doc_id, size, key, n) of ``docs(doc_id, text, source)``: words of the text, the hash that orders a
    source's documents, and how many rows are alike in these. Repeated rows are counted, not shuffled one by one."""
    rows = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    alike = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return stage(
        alike.select(source_key(F.col("source")).alias("src"), "source", "doc_id", "size", F.md5(name).alias("key"), "n"),
        "mix-documents",
    )


def repeating_schedule(rows: DataFrame, weights: Sequence[float] = WEIGHTS, ramp: float = RAMP) -> DataFrame:
    """(src, at, weight): knots for every source of ``rows(src)``. Sources in order have the weights in turn as their
    mean; every other one rises from ``1 - ramp`` to ``1 + ramp`` times it, the others fall."""
    placed = number_rows(rows.select("src").distinct(), [F.col("src").asc()], name="place")
    mean = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    slope = F.when(F.col("place") % 2 == 0, F.lit(-ramp)).otherwise(F.lit(ramp))
    knots = F.explode(
        F.array(
            F.struct(F.lit(0.0).alias("at"), (mean * (1 - slope)).alias("weight")),
            F.struct(F.lit(1.0).alias("at"), (mean * (1 + slope)).alias("weight")),
        )
    ).alias("k")
    return placed.select("src", knots).select("src", "k.at", "k.weight")


def integrated(schedule: DataFrame) -> DataFrame:
    """(src, w, pieces) of ``schedule(src, at, weight)``: the whole integral, and the straight pieces as (t0, t1, w0, w1,
    area before), by time. Time outside the knots keeps the nearest knot's weight; negative weights count as 0."""
    knots = schedule.filter("at is not null and weight is not null").select(
        "src",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("at").cast("double"))).alias("t"),
        F.greatest(F.lit(0.0), F.col("weight").cast("double")).alias("w"),
    )
    lists = knots.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("k"))
    first, last = F.element_at("k", 1), F.element_at("k", -1)
    whole = F.concat(
        F.array(F.struct(F.lit(0.0).alias("t"), first["w"].alias("w"))),
        F.col("k"),
        F.array(F.struct(F.lit(1.0).alias("t"), last["w"].alias("w"))),
    )
    step = F.expr(
        """aggregate(sequence(1, size(k) - 1),
          struct(0D as area, cast(array() as array<struct<t0: double, t1: double, w0: double, w1: double, area: double>>) as out),
          (s, i) -> struct(
            s.area + (k[i].t - k[i - 1].t) * (k[i].w + k[i - 1].w) / 2 as area,
            concat(s.out, array(struct(k[i - 1].t as t0, k[i].t as t1, k[i - 1].w as w0, k[i].w as w1, s.area as area))) as out))"""
    )
    done = lists.select("src", whole.alias("k")).select("src", step.alias("s"))
    return done.select("src", F.col("s.area").alias("w"), F.filter("s.out", lambda p: p["t1"] > p["t0"]).alias("pieces"))


def time_of(area: Column, pieces: Column) -> Column:
    """The time by which a schedule's integral reaches ``area``: the root of a quadratic in the piece that holds it."""
    # the last piece that starts below the area; pieces without weight hold none
    usable = F.filter(pieces, lambda p: (p["area"] <= area) & (p["w0"] + p["w1"] > 0))
    p = F.element_at(usable, -1)
    rest = area - p["area"]
    span = p["t1"] - p["t0"]
    slope = (p["w1"] - p["w0"]) / span
    # 2c / (b + sqrt(b^2 + 2ac)): stable for rising, falling and level pieces alike
    root = F.sqrt(F.greatest(F.lit(0.0), p["w0"] * p["w0"] + 2 * slope * rest))
    inside = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (p["w0"] + root))
    return F.least(p["t1"], p["t0"] + inside)


def targets(rows: DataFrame, schedule: DataFrame, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(src, source_size, w, pieces, target) of every source of ``rows(src, size, n)``.

    Shares go by the schedules' integrals. No target exceeds ``passes`` times its source's words; the excess is shared
    out again by weight until none does. Sources in order of words per weight: the ones before some place stop at their
    limit, and the ones from there on share what is left, which running sums over the sources tell. Sources without a
    schedule, or whose integral is 0, have the target 0.
    """
    sizes = rows.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = integrated(schedule)
    base = stage(
        sizes.join(plan, "src", "left").select(
            "src", "source_size", F.coalesce("w", F.lit(0.0)).alias("w"), "pieces", F.lit(1).alias("one")
        ),
        "mix-sources",
    )
    cap = F.lit(float(passes)) * F.col("source_size")
    weighed = base.filter("w > 0").select("src", "w", cap.alias("cap"), (cap / F.col("w")).alias("ratio"))
    order = [F.col("ratio").asc(), F.col("src").asc()]
    upto = running_total(running_total(weighed, order, [], "cap", "cap_upto"), order, [], "w", "w_upto")
    upto = weighed.join(
        upto.select("src", (F.col("cap_upto")).alias("cap_upto"), "w_upto"), "src"
    )
    total = base.agg(
        (F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("w").alias("all_w")
    )
    level = (F.col("budget") - (F.col("cap_upto") - F.col("cap"))) / (F.col("all_w") - (F.col("w_upto") - F.col("w")))
    free = with_one_row(upto, total).withColumn("level", level).filter(F.col("w") * F.col("level") <= F.col("cap"))
    best = free.agg(F.min_by("level", F.struct("ratio", "src")).alias("level"), F.min(F.struct("ratio", "src")).alias("from"))
    ratio = F.when(F.col("w") > 0, cap / F.col("w"))
    after = F.col("from").isNotNull() & (F.struct(ratio.alias("ratio"), F.col("src")) >= F.col("from"))
    target = F.when(F.col("w") <= 0, F.lit(0.0)).when(after, F.col("level") * F.col("w")).otherwise(cap)
    return with_one_row(base, best).select("src", "source_size", "w", "pieces", target.alias("target"))


def placed(rows: DataFrame, plan: DataFrame, passes: int = PASSES) -> DataFrame:
    """(source, doc_id, size, copy, source_size, target, pass, position): every document of ``rows`` once for each pass
    that takes it, and once with NULLs where none does. A pass takes a document whose middle word the target reaches.

    Words before a document are summed over blocks of its source (hash ranges, so of even size) and within its block:
    the rows are shuffled once, and a source of any size spreads over all its blocks."""
    rows = rows.withColumn("block", F.substring("key", 1, KEY_DIGITS))
    words = F.col("size") * F.col("n")
    blocks = rows.groupBy("src", "block").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("src", "block", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(words).over(inside), F.lit(0)) + F.col("ahead")
    offsets = rows.join(blocks, ["src", "block"]).withColumn("at", at).join(plan, "src")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    single = offsets.select(*offsets.columns, copies).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    middle = (F.col("pass") * F.col("source_size") + F.col("at")) * 2 + F.col("size")
    tries = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    taken = single.select(*single.columns, tries).withColumn("middle", middle)
    reached = (F.col("size") > 0) & (F.col("middle") <= 2 * F.col("target"))
    position = time_of(F.try_divide(F.col("middle"), 2 * F.col("target")) * F.col("w"), F.col("pieces"))
    # a document that no pass takes keeps its row of the first pass
    return taken.filter(reached | (F.col("pass") == 0)).select(
        "source", "doc_id", "size", "copy", "source_size", "target", "key",
        F.when(reached, F.col("pass")).alias("pass"), F.when(reached, position).alias("position"),
    )


def mix(
    docs: DataFrame,
    schedule: DataFrame | None = None,
    share: float = SHARE,
    passes: int = PASSES,
    seed: int = SEED,
) -> DataFrame:
    """(place, position, source, doc_id, size, copy, pass, source_size, target) of ``docs(doc_id, text, source)``: the
    documents in training order, by one range sort of narrow rows; ``place`` counts from 0. Documents the mix does not
    take stand at the end, once, with NULL ``pass`` and ``position``.

    ``schedule(source, at, weight)`` holds knots of each source's weight; without it sources in order have the weights
    3, 1, 2 in turn, rising or falling around them. ``share`` is the mix's words as a multiple of all words, and no document
    is taken more than ``passes`` times.

    A word is a run without ASCII white space; NULL and empty texts have size 0 and are not taken. NULL sources are a
    source of their own, the last one. Rows that repeat doc_id, source and size are documents of their own, told apart
    by ``copy``; rows without doc_id count too. An empty table gives an empty mix. Other columns are ignored. The order
    depends on seed and doc_id only, so reruns agree.
    """
    rows = measured(docs, seed)
    if schedule is None:
        knots = repeating_schedule(rows)
    else:
        knots = schedule.select(source_key(F.col("source").cast("string")).alias("src"), "at", "weight")
    found = placed(rows, targets(rows, knots, share, passes), passes)
    order = [F.col("position").asc_nulls_last(), F.col("key"), F.col("source"), F.col("doc_id"), F.col("size"), F.col("copy"), F.col("pass")]
    return number_rows(found, order, name="place").drop("key")


def taken_words(order: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position) of every document of a :func:`mix`."""
    return order.groupBy("source", "doc_id", "size", "copy").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(F.when(F.col("pass").isNotNull(), F.col("size")).otherwise(F.lit(0))).alias("taken"),
        F.min("position").alias("first_position"),
    ).select("doc_id", "size", "source_size", "target", "taken", "first_position")


# The same sums over whole tables; the weights' means are the schedules' integrals.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS src,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY src) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY src),
r AS (SELECT *, {PASSES}.0::DOUBLE * source_size AS cap, {PASSES}.0::DOUBLE * source_size / w AS ratio,
  {SHARE}::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, src) AS place,
  (budget - (sum(cap) OVER (ORDER BY ratio, src) - cap)) / (all_w - (sum(w) OVER (ORDER BY ratio, src) - w)) AS level FROM r),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE w * level <= cap),
t AS (SELECT l.src, l.source_size, CASE WHEN l.place >= f.place THEN f.level * l.w ELSE l.cap END AS target FROM l, f),
o AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  (size * ((2 * ahead + size <= 2 * target)::INT + (2 * (source_size + ahead) + size <= 2 * target)::INT))::BIGINT AS taken
FROM o
"""
