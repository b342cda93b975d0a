"""Set algebra and overlap of sets.

Pair tables are the result of several operators here, but the members shared by
two sets are never listed pair by pair. Sets get dense numbers; the sets holding
a member become 64-bit masks per block of 64 numbers (a map-side ``bit_or``),
equal mask pairs are counted, and only counted patterns expand to set pairs. A
member in a third of S sets costs (S/192)^2/2 mask pairs, not S^2/18 set pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import with_one_row
from ..session import cut
from .rank import number_rows
from .sets import set_sizes

# Mask words of one member joined in one task.
WORDS_PER_TASK = 64
WORD = 64
# Keys that the neighbours of one node are split over.
HUB_PARTS = 256
JACCARD_BIN = 0.02
FEW_SETS = 8  # of a member, whose pairs are counted by groups of its sets
# Default filters of the similarity network.
EDGE_P = 0.005
EDGE_Q = 0.1
EDGE_SIMILARITY = 0.5
COMBINED_CONSTANT = 0.5


# ---- collections -----------------------------------------------------------


def union_collections(*collections: DataFrame) -> DataFrame:
    """Stack collections; a set name in two of them is an error."""
    tagged = [
        c.select(F.lit(i).alias("_source"), "set_name", "member") for i, c in enumerate(collections)
    ]
    stacked = reduce(DataFrame.unionByName, tagged)
    names = stacked.groupBy("set_name").agg(
        F.min("_source").alias("_lo"), F.max("_source").alias("_hi")
    )
    wrong = F.raise_error(F.concat(F.lit("set name used twice: "), F.col("set_name")))
    checked = names.withColumn(
        "_ok", F.when(F.col("_lo") != F.col("_hi"), wrong.cast("boolean")).otherwise(True)
    ).filter("_ok")
    return stacked.join(checked.select("set_name"), "set_name").select("set_name", "member")


def features_as_set(features: DataFrame, set_name: str) -> DataFrame:
    """Row names of a matrix (or probes of an id map) as one set."""
    return features.select(F.col("feature").alias("member")).distinct().select(
        F.lit(set_name).alias("set_name"), "member"
    )


def combine_into_one(sets: DataFrame) -> DataFrame:
    return sets.select("member").distinct()


def dedupe_members(sets: DataFrame) -> DataFrame:
    """First place of a repeated member survives."""
    return sets.groupBy("set_name", "member").agg(F.min("member_pos").alias("member_pos"))


def explode_collection(sets: DataFrame, set_name: str) -> DataFrame:
    """Members of one set, found by name in any case."""
    return sets.filter(F.upper("set_name") == set_name.upper())


def member_frequency(sets: DataFrame) -> DataFrame:
    return sets.groupBy("member").agg(F.count_distinct("set_name").alias("n_sets"))


def collection_summary(sets: DataFrame) -> DataFrame:
    sizes = set_sizes(sets).agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.max("size").alias("max_size"),
        F.min("size").alias("min_size"),
        F.avg("size").alias("mean_size"),
    )
    members = sets.agg(F.count_distinct("member").alias("n_members"))
    return with_one_row(sizes, members)


# ---- pairs -----------------------------------------------------------------


def number_sets(sets: DataFrame) -> DataFrame:
    """(set_name, size, set_no): dense numbers in name order."""
    return number_rows(set_sizes(sets), [F.col("set_name").asc()], name="set_no")


def _bits(mask: Column) -> Column:
    return F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.getbit(mask, i) == 1,
    )


def _masks(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(member, word, mask): which sets of each block of 64 hold the member."""
    at = sets.select("set_name", "member").join(numbered.select("set_name", "set_no"), "set_name")
    bit = F.expr(f"shiftleft(1L, cast(set_no % {WORD} as int))")
    return at.groupBy("member", F.floor(F.col("set_no") / WORD).alias("word")).agg(
        F.bit_or(bit).alias("mask")
    )


def shared_members(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(i, j, inter) for pairs i <= j of set numbers with a common member; the
    diagonal holds the set sizes."""
    masks = _masks(sets, numbered)
    # a member of very many sets is dealt over tasks: its left words by number, its right words to all
    words = masks.groupBy("member").agg(
        F.ceil(F.count(F.lit(1)) / WORDS_PER_TASK).cast("int").alias("_parts")
    )
    masks = masks.join(words, "member")
    left = masks.select(
        "member",
        F.pmod("word", "_parts").cast("int").alias("_part"),
        F.col("word").alias("wi"),
        F.col("mask").alias("mi"),
    )
    right = masks.select(
        "member",
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
        F.col("word").alias("wj"),
        F.col("mask").alias("mj"),
    )
    patterns = (
        left.join(right, ["member", "_part"])
        .filter("wi <= wj")
        .groupBy("wi", "mi", "wj", "mj")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    i = (F.col("wi") * WORD + F.col("bi")).alias("i")
    j = (F.col("wj") * WORD + F.col("bj")).alias("j")
    return (
        patterns.select("wi", "wj", "mj", "_n", F.explode(_bits(F.col("mi"))).alias("bi"))
        .select("wi", "bi", "wj", "_n", F.explode(_bits(F.col("mj"))).alias("bj"))
        .select(i, j, "_n")
        .filter("i <= j")
        .groupBy("i", "j")
        .agg(F.sum("_n").alias("inter"))
    )


def _named(pairs: DataFrame, numbered: DataFrame) -> DataFrame:
    a = numbered.select(
        F.col("set_no").alias("i"), F.col("set_name").alias("a"), F.col("size").alias("n_a")
    )
    b = numbered.select(
        F.col("set_no").alias("j"), F.col("set_name").alias("b"), F.col("size").alias("n_b")
    )
    return pairs.join(a, "i").join(b, "j")


def _measures(pairs: DataFrame) -> DataFrame:
    union = F.col("n_a") + F.col("n_b") - F.col("inter")
    return pairs.withColumn("union_size", union).withColumn(
        "jaccard", F.coalesce(F.try_divide(F.col("inter"), F.col("union_size")), F.lit(0.0))
    )


def pair_overlap(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, inter, union_size, jaccard) for a < b sharing a member;
    every other pair has inter 0 and jaccard 0."""
    numbered = number_sets(sets)
    pairs = shared_members(sets, numbered).filter("i < j")
    return _measures(_named(pairs, numbered)).select(
        "a", "b", "n_a", "n_b", "inter", "union_size", "jaccard"
    )


def overlap_matrix(sets: DataFrame) -> DataFrame:
    """The cells of the S x S matrix whose sets share a member, both halves and
    the diagonal, with ``overlap_fraction`` = inter / size of the first set.
    Every other cell has inter, fraction and jaccard 0."""
    numbered = number_sets(sets)
    half = shared_members(sets, numbered)
    both = half.unionByName(
        half.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "inter")
    )
    return (
        _measures(_named(both, numbered))
        .withColumn(
            "overlap_fraction",
            F.coalesce(F.try_divide(F.col("inter"), F.col("n_a")), F.lit(0.0)),
        )
        .select("a", "b", "n_a", "n_b", "inter", "union_size", "overlap_fraction", "jaccard")
    )


def intersection_size(sets: DataFrame) -> DataFrame:
    return pair_overlap(sets).select("a", "b", "inter")


def union_size(sets: DataFrame) -> DataFrame:
    """Of pairs sharing a member; of any other pair it is the sum of both sizes."""
    named = pair_overlap(sets)  # pairs by set number; here by name
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "union_size")


def overlap_fraction(sets: DataFrame) -> DataFrame:
    return overlap_matrix(sets).select("a", "b", "overlap_fraction")


def jaccard_matrix(sets: DataFrame) -> DataFrame:
    return overlap_matrix(sets).select("a", "b", "jaccard")


def jaccard_mean(sets: DataFrame) -> DataFrame:
    """Mean over all S^2 cells. Zero cells add nothing, so only sharing pairs
    are built: twice the upper half plus one per non-empty set."""
    upper = pair_overlap(sets).agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("_sum"))
    count = set_sizes(sets).agg(F.count(F.lit(1)).alias("_s"))
    return with_one_row(count, upper).select(
        ((2 * F.col("_sum") + F.col("_s")) / (F.col("_s") * F.col("_s"))).alias("jaccard_mean")
    )


def _binned(sets: DataFrame, key: Column, name: str) -> DataFrame:
    """Pairs r < c counted by a key of their jaccard; the pairs sharing nothing
    are added as a number, not as rows."""
    seen = pair_overlap(sets).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("_n"))
    total = set_sizes(sets).agg(F.count(F.lit(1)).alias("_s"))
    zero = with_one_row(total, seen.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_seen"))).select(
        F.lit(0).cast(seen.schema[name].dataType).alias(name),
        (F.expr("_s * (_s - 1) div 2") - F.col("_seen")).alias("_n"),
    )
    return (
        seen.unionByName(zero)
        .groupBy(name)
        .agg(F.sum("_n").alias("n_pairs"))
        .filter("n_pairs > 0")
    )


def jaccard_distribution(sets: DataFrame, digits: int = 6) -> DataFrame:
    return _binned(sets, F.round("jaccard", digits), "jaccard")


def jaccard_histogram(sets: DataFrame, width: float = JACCARD_BIN) -> DataFrame:
    """Bins of ``width``; a value within 1e-9 below an edge is on the edge."""
    bin_no = F.floor(F.col("jaccard") / width + 1e-9)
    return _binned(sets, bin_no, "bin").withColumn("bin_start", F.col("bin") * width)


def _held_sets(in_sets: Column) -> Column:
    """Ascending numbers of the sets of a membership signature."""
    return F.flatten(F.transform(in_sets, lambda w: F.transform(_bits(w["mask"]), lambda bit: w["word"] * WORD + bit)))


def _pairs_of_few(kinds: DataFrame) -> DataFrame:
    """Pairs of members that share a set, one row. Over all groups of sets, the pairs of members held by the whole group are
    added for an odd number of sets and taken off for an even one: a pair is left once, whatever sets it shares."""
    held = kinds.select("n_alike", "_size", _held_sets(F.col("in_sets")).alias("_held"))
    groups = held.select("n_alike", "_held", F.explode(F.expr("sequence(1, shiftleft(1, cast(_size as int)) - 1)")).alias("_pick"))
    some = F.filter("_held", lambda s, k: F.call_function("getbit", F.col("_pick"), k.cast("int")) == 1)
    holders = groups.groupBy(some.alias("_some")).agg(F.sum("n_alike").cast("decimal(19,0)").alias("_n"))
    pairs = F.expr("_n * (_n - 1) * if(size(_some) % 2 = 1, 1, -1)")
    return holders.agg((F.coalesce(F.sum(pairs), F.lit(0)) / 2).cast("long").alias("_few"))


def _pairs_of_many(sets: DataFrame, numbered: DataFrame, signed: DataFrame, kinds: DataFrame, few: int) -> DataFrame:
    """Pairs sharing a set of which one member at least is in more than ``few`` sets, one row.

    Members are numbered; a set becomes 64-bit masks over blocks of member numbers, apart for members of few and of many
    sets. Per distinct membership of many sets the masks of its sets are or-ed (map-side) and their bits counted. A set of
    many words is many keys."""
    members = signed.select("member", (F.col("_size") > few).alias("many"))
    members = number_rows(members, [F.col("member").asc()], name="m_no")
    at = (
        sets.select("set_name", "member")
        .join(members, "member")
        .join(numbered.select("set_name", "set_no"), "set_name")
        .select("set_no", "many", "m_no")
    )
    words = at.groupBy("set_no", "many", F.floor(F.col("m_no") / WORD).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(m_no % {WORD} as int))")).alias("mask")
    )
    words = cut(words)
    kinds = number_rows(kinds, [F.col("in_sets").asc()], name="kind")
    within = kinds.select("kind", F.explode(_held_sets(F.col("in_sets"))).alias("set_no"))
    # a large set is dealt over tasks: its words by number, its kinds to each part
    parts = words.groupBy("set_no").agg(
        F.ceil(F.count(F.lit(1)) / WORDS_PER_TASK).cast("int").alias("_parts")
    )
    dealt = words.join(parts, "set_no").withColumn("_part", F.pmod("word", "_parts").cast("int"))
    asking = within.join(parts, "set_no").select(
        "kind", "set_no", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    )
    bits = F.bit_count("mask")
    partners = (
        asking.join(dealt, ["set_no", "_part"])
        .groupBy("kind", "many", "word")
        .agg(F.bit_or("mask").alias("mask"))
        .groupBy("kind")
        .agg(F.sum(bits).alias("reach"), F.sum(F.when(~F.col("many"), bits).otherwise(0)).alias("reach_few"))
    )
    # pairs of two members of many sets are met twice, from either side
    twice = F.col("n_alike") * (F.col("reach") - 1 + F.col("reach_few"))
    found = kinds.join(partners, "kind").agg(F.coalesce(F.sum(twice), F.lit(0)).alias("_twice"))
    return found.select(F.expr("_twice div 2").alias("_many"))


def co_member_pairs(sets: DataFrame, few: int = FEW_SETS) -> DataFrame:
    """Number of distinct unordered member pairs found together in some set,
    and the number possible over sets, sum n(n-1)/2.

    Pairs are counted without being formed, members in exactly the same sets
    together. Members of up to ``few`` sets are counted by the groups of sets
    that hold them, 2^few for a membership at most; what members of more sets
    have to do with all others, by masks over the members."""
    numbered = number_sets(sets)
    # membership signature: one mask per block of 64 sets
    signed = (
        _masks(sets, numbered)
        .filter(F.col("member").isNotNull())
        .groupBy("member")
        .agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("in_sets"), F.sum(F.bit_count("mask")).alias("_size"))
    )
    kinds = cut(signed.groupBy("in_sets", "_size").agg(F.count(F.lit(1)).alias("n_alike")))
    found = _pairs_of_few(kinds.filter(F.col("_size") <= few)).select(F.col("_few").alias("distinct_pairs"))
    many = kinds.filter(F.col("_size") > few)
    if not many.isEmpty():
        found = with_one_row(found, _pairs_of_many(sets, numbered, signed, many, few)).select(
            (F.col("distinct_pairs") + F.col("_many")).alias("distinct_pairs")
        )
    possible = set_sizes(sets).agg(
        F.sum(F.expr("size * (size - 1) div 2")).alias("possible_pairs")
    )
    return with_one_row(found, possible)


# ---- incidence -------------------------------------------------------------


def incidence_matrix(sets: DataFrame) -> DataFrame:
    """(set_name, member, present) of the ones of the 0/1 matrix; cells without a row are 0."""
    return sets.select("set_name", "member").distinct().withColumn("present", F.lit(1))


def incidence_wide(sets: DataFrame, members: list[str]) -> DataFrame:
    """One column per named member; the list bounds the width."""
    return (
        sets.withColumn("present", F.lit(1))
        .groupBy("set_name")
        .pivot("member", members)
        .agg(F.max("present"))
        .na.fill(0)
    )


def score_incidence(sets: DataFrame, ranked: DataFrame) -> DataFrame:
    """Incidence cells with 1 replaced by the member's score; cells without a
    row are 0."""
    return sets.select("set_name", "member").join(
        ranked.select(F.col("feature").alias("member"), "score"), "member"
    ).select("set_name", "member", "score")


# ---- networks --------------------------------------------------------------


def similarity(metric: str) -> Column:
    overlap = F.try_divide(F.col("inter"), F.least("n_a", "n_b"))
    jaccard = F.col("jaccard")
    if metric == "JACCARD":
        return jaccard
    if metric == "OVERLAP":
        return overlap
    if metric == "COMBINED":
        k = COMBINED_CONSTANT
        return k * overlap + (1 - k) * jaccard
    raise ValueError(f"unknown similarity {metric!r}; JACCARD, OVERLAP or COMBINED")


def similarity_edges(
    sets: DataFrame,
    results: DataFrame,
    *,
    metric: str = "OVERLAP",
    p_cut: float = EDGE_P,
    q_cut: float = EDGE_Q,
    cutoff: float = EDGE_SIMILARITY,
    other_results: DataFrame | None = None,
) -> DataFrame:
    """Edges between sets that pass both p and q in one of the runs."""
    passing = results.select("set_name", "np", "fdr")
    if other_results is not None:
        passing = passing.unionByName(other_results.select("set_name", "np", "fdr"))
    keep = passing.filter((F.col("np") <= p_cut) & (F.col("fdr") <= q_cut)).select(
        "set_name"
    ).distinct()
    chosen = sets.join(keep, "set_name", "left_semi")
    return (
        pair_overlap(chosen)
        .withColumn("similarity", similarity(metric))
        .filter(F.col("similarity") >= cutoff)
        .select("a", "b", "inter", "similarity")
    )


def incidence_correlation(sets: DataFrame) -> DataFrame:
    """(a, b, corr) for a < b: Pearson r of the 0/1 rows, from counts alone.
    Only pairs sharing a member are listed; any other pair has r <= 0."""
    total = sets.agg(F.count_distinct("member").alias("_m"))
    m, x, y, xy = F.col("_m"), F.col("n_a"), F.col("n_b"), F.col("inter")
    spread = F.sqrt((m * x - x * x).cast("double") * (m * y - y * y).cast("double"))
    return with_one_row(pair_overlap(sets), total).select(
        "a", "b", F.try_divide((m * xy - x * y).cast("double"), spread).alias("corr")
    )


def correlation_clusters(sets: DataFrame, min_corr: float = 0.5) -> DataFrame:
    """(set_name, cluster): the single-linkage cut at correlation ``min_corr``
    (> 0), i.e. connected components; a cluster is named by its least set."""
    if min_corr <= 0:
        raise ValueError("min_corr must be above 0: pairs sharing nothing are not listed")
    near = incidence_correlation(sets).filter(F.col("corr") >= min_corr).select("a", "b")
    stars = components(near).select(F.col("a").alias("set_name"), F.col("b").alias("_root"))
    return set_sizes(sets).select("set_name").join(stars, "set_name", "left").select(
        "set_name", F.coalesce("_root", "set_name").alias("cluster")
    )


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, least): the least of a and its neighbours.

    The neighbours of a node are split by their hash, so a hub's edges lie in up
    to ``HUB_PARTS`` keys and only their minima, one a key, meet."""
    split = edges.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)))
    least = split.groupBy("a", "_part").agg(F.min("b").alias("_lo"))
    least = least.select(
        "a", "_part", F.least("a", F.min("_lo").over(Window.partitionBy("a"))).alias("least")
    )
    return split.join(least, ["a", "_part"]).select("a", "b", "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    known = _with_least(edges)
    others = known.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return known.select("a", F.col("least").alias("b")).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node ``a`` of the undirected ``edges`` but the least of its
    component ``b``. Loops and NULL ends are ignored.

    Large and small stars in turn until nothing moves; each turn keeps the
    components, never adds edges, and is one checkpoint."""
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = cut(stars.distinct())
    while True:
        moved = cut(_small_star(_large_star(stars).distinct()).distinct())
        if moved.count() == stars.count() and moved.join(stars, ["a", "b"], "left_anti").isEmpty():
            return moved
        stars = moved


# ---- leading-edge analysis -------------------------------------------------


def leading_edge_sets(members: DataFrame) -> DataFrame:
    """Leading-edge members as a collection."""
    return members.select("set_name", F.col("feature").alias("member"))
