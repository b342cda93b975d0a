"""Domain tables projected from the driver's star-schema tables.

Two matrices: parts x suppliers (root of the revenue, most cells missing) and
embedding dimensions x vectors (dense). Every projection reads a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread, tasks_for

WEST = ("AMERICA", "EUROPE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(c: str):
    return F.concat(F.lit("P"), F.col(c).cast("string"))


def _constant(text: str, c: str):
    """``text`` on every row with a ``c``. A literal would not do: an equi join
    on a literal column has no keys left and becomes a product."""
    return F.when(F.col(c).isNotNull(), F.lit(text))


def _customer(c: str):
    return F.concat(F.lit("C"), F.col(c).cast("string"))


def _supplier(c: str):
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part x supplier, root of the revenue; an absent cell is missing."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    return (
        spread(lines, tasks_for(lines), "l_partkey", "l_suppkey")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sqrt(F.sum(revenue)).alias("value"))
        .select(
            F.col("l_partkey").alias("row_idx"),
            _part("l_partkey").alias("feature"),
            F.col("l_suppkey").alias("sample_idx"),
            _supplier("l_suppkey").alias("sample"),
            "value",
        )
    )


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, named by its customer, so names repeat; the samples
    are the priorities, the value is the price, missing while in progress."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        _customer("o_custkey").alias("feature"),
        F.col("o_orderpriority").alias("sample"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )


def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding dimension x vector."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("d", "v"))
        .select(
            F.col("d").cast("long").alias("row_idx"),
            F.concat(F.lit("D"), F.col("d").cast("string")).alias("feature"),
            F.col("vec_id").alias("sample_idx"),
            F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample"),
            F.col("v").cast("double").alias("value"),
        )
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by region (five classes), with their balance as profile."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _constant("region", "r_name").alias("phenotype"),
            _supplier("s_suppkey").alias("sample"),
            F.col("s_suppkey").alias("position"),
            F.col("r_name").alias("class_name"),
            F.col("r_regionkey").alias("class_idx"),
            F.col("s_acctbal").alias("num_value"),
        )
    )


def side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in two classes: WEST (0) and EAST (1)."""
    west = F.col("class_name").isin(*WEST)
    return (
        region_labels(spark, sf_dir)
        .withColumn("phenotype", _constant("side", "class_name"))
        .withColumn("class_idx", F.when(west, 0).otherwise(1))
        .withColumn("class_name", F.when(west, "WEST").otherwise("EAST"))
    )


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in two classes by label, with the label as profile."""
    low = F.col("label") < 5
    return table(spark, sf_dir, "embeddings").select(
        _constant("label", "label").alias("phenotype"),
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample"),
        F.col("vec_id").alias("position"),
        F.when(low, "LOW").otherwise("HIGH").alias("class_name"),
        F.when(low, 0).otherwise(1).alias("class_idx"),
        F.col("label").cast("double").alias("num_value"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount of each part against the overall mean."""
    from .functions.scalars import with_one_row

    lines = table(spark, sf_dir, "lineitem")
    overall = lines.agg(F.avg("l_discount").alias("_all"))
    parts = lines.groupBy("l_partkey").agg(F.avg("l_discount").alias("_mean"))
    return with_one_row(parts, overall).select(
        _part("l_partkey").alias("feature"),
        F.col("l_partkey").alias("row_idx"),
        F.round(F.col("_mean") - F.col("_all"), 6).alias("score"),
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.rank import rank_scores

    return rank_scores(scores(spark, sf_dir)).select("feature", "score", "rank")


def flag_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per return flag: mean discount of each part on such lines
    against the mean on all lines of the flag."""
    from .operators.rank import rank_scores

    lines = table(spark, sf_dir, "lineitem")
    overall = lines.groupBy("l_returnflag").agg(F.avg("l_discount").alias("_all"))
    parts = lines.groupBy("l_returnflag", "l_partkey").agg(F.avg("l_discount").alias("_mean"))
    return rank_scores(
        parts.join(overall, "l_returnflag").select(
            F.col("l_returnflag").alias("list_id"),
            _part("l_partkey").alias("feature"),
            F.col("l_partkey").alias("row_idx"),
            F.round(F.col("_mean") - F.col("_all"), 6).alias("score"),
        ),
        by=["list_id"],
    )


def order_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list naming customers several times: one entry per order."""
    from .operators.rank import rank_scores

    orders = table(spark, sf_dir, "orders").select(
        _customer("o_custkey").alias("feature"),
        F.col("o_orderkey").alias("row_idx"),
        F.col("o_totalprice").alias("score"),
    )
    return rank_scores(orders)


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand, type and size: overlapping sets of three collections."""
    name = F.explode(
        F.array(
            F.struct(
                F.lit("brand").alias("c"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("n")
            ),
            F.struct(F.lit("type").alias("c"), F.concat(F.lit("TYPE_"), "p_type").alias("n")),
            F.struct(
                F.lit("size").alias("c"),
                F.concat(F.lit("SIZE_"), F.col("p_size").cast("string")).alias("n"),
            ),
        )
    ).alias("s")
    return table(spark, sf_dir, "part").select("p_partkey", name).select(
        F.col("s.c").alias("collection"),
        F.upper("s.n").alias("set_name"),
        _part("p_partkey").alias("member"),
        F.col("p_partkey").alias("member_pos"),
    )


def dimension_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector label the dimensions whose mean under it exceeds their overall
    mean."""
    cells = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("d", "v"))
        .withColumn("v", F.col("v").cast("double"))
    )
    overall = cells.groupBy("d").agg(F.round(F.avg("v"), 9).alias("_all"))
    by_label = cells.groupBy("label", "d").agg(F.round(F.avg("v"), 9).alias("_mean"))
    return (
        by_label.join(overall, "d")
        .filter("_mean > _all")
        .select(
            F.concat(F.lit("LABEL_"), F.col("label").cast("string")).alias("set_name"),
            F.concat(F.lit("D"), F.col("d").cast("string")).alias("member"),
            F.col("d").cast("long").alias("member_pos"),
        )
    )


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> brand/size; parts with a 'hot' name have a blank symbol."""
    symbol = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.lit("parts").alias("platform"),
        _part("p_partkey").alias("probe"),
        F.when(F.col("p_name").startswith("hot"), "").otherwise(symbol).alias("symbol"),
        F.col("p_name").alias("title"),
    )


def symbol_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols grouped by the first word of the names of their parts."""
    parts = id_map(spark, sf_dir).filter("symbol <> ''")
    return parts.select(
        F.upper(F.element_at(F.split("title", " "), 1)).alias("set_name"),
        F.col("symbol").alias("member"),
    ).distinct()
