"""Stored results and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import read_lines, require

# Tags and attributes of the result document.
ROOT_TAG = "EDB"
ROW_TAG = "DTG"
NUMBER_ATTRIBUTES = ("ES", "NES", "NP", "FDR", "FWER", "RANK_AT_ES", "RANK_SCORE_AT_ES")
ARRAY_ATTRIBUTES = ("HIT_INDICES", "ES_PROFILE", "RND_ES")
TEXT_ATTRIBUTES = ("RANKED_LIST", "TEMPLATE", "GENESET", "CHIP")
RUN_ATTRIBUTES = (
    "LC_PROC", "SORT_MODE", "ORDER", "METRIC", "NUM_PERMS", "USE_MEDIAN", "FIX_LOW", "USE_BIASED",
)
# Keys of a run report.
PRODUCER_KEY = "producer_class"
TIMESTAMP_KEY = "producer_timestamp"
PARAM_KEY = "param"
FILE_KEY = "file"


def _schema(names) -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])


def read_results_db(spark: SparkSession, path: str) -> DataFrame:
    """One row per set of a result document; a document must name one shared
    ranked list, and the null and profile must be there."""
    names = (*TEXT_ATTRIBUTES, *NUMBER_ATTRIBUTES, *ARRAY_ATTRIBUTES)
    raw = (
        spark.read.format("xml")
        .option("rowTag", ROW_TAG)
        .schema(_schema(names))
        .load(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    lists = raw.groupBy("file").agg(
        F.min("_RANKED_LIST").alias("_lo"), F.max("_RANKED_LIST").alias("_hi")
    )
    checked = lists.select(
        require(
            F.col("_lo") == F.col("_hi"),
            F.concat(F.lit("several ranked lists in "), F.col("file")),
            F.col("file"),
        ).alias("file")
    )

    def numbers(name: str, kind: str):
        text = F.col(f"_{name}")
        wrong = F.raise_error(F.lit(f"missing attribute {name}")).cast("string")
        text = F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.trim(text)).otherwise(wrong)
        return F.transform(F.split(text, r"\s+"), lambda x: x.cast(kind))

    gene_set = F.split("_GENESET", "#")
    return raw.join(checked, "file").select(
        "file",
        F.col("_RANKED_LIST").alias("ranked_list"),
        F.col("_TEMPLATE").alias("labelling"),
        F.element_at(gene_set, -1).alias("set_name"),
        F.col("_CHIP").alias("platform"),
        F.col("_ES").cast("double").alias("es"),
        F.col("_NES").cast("double").alias("nes"),
        F.col("_NP").cast("double").alias("np"),
        F.col("_FDR").cast("double").alias("fdr"),
        F.col("_FWER").cast("double").alias("fwer"),
        F.col("_RANK_AT_ES").cast("double").cast("long").alias("rank_at_max"),
        F.col("_RANK_SCORE_AT_ES").cast("double").alias("score_at_max"),
        numbers("HIT_INDICES", "long").alias("hit_ranks"),
        numbers("ES_PROFILE", "double").alias("es_profile"),
        numbers("RND_ES", "double").alias("null_es"),
    )


def read_results_run(spark: SparkSession, path: str) -> DataFrame:
    """Run settings on the root of a result document."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", ROOT_TAG)
        .schema(_schema(RUN_ATTRIBUTES))
        .load(path)
    )
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        *[F.col(f"_{n}").alias(n.lower()) for n in RUN_ATTRIBUTES],
    )


def results_to_null(results: DataFrame) -> DataFrame:
    """(set_name, perm, es) from the stored null of each set."""
    return results.select("set_name", F.posexplode("null_es").alias("perm", "es"))


def results_to_hits(results: DataFrame) -> DataFrame:
    """(set_name, hit_no, rank, running_es) from the stored arrays."""
    pairs = F.arrays_zip("hit_ranks", "es_profile")
    return results.select("set_name", F.posexplode(pairs).alias("hit_no", "_p")).select(
        "set_name",
        "hit_no",
        F.col("_p.hit_ranks").alias("rank"),
        F.col("_p.es_profile").alias("running_es"),
    )


def read_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, producer, timestamp, params, files) per report."""
    lines = read_lines(spark, path).withColumn("_f", F.split("line", "\t"))
    n = F.size("_f")
    key = F.lower(F.col("_f")[0])
    good = F.when(key == PARAM_KEY, n == 3).otherwise(n.isin(2, 3))
    rows = lines.select(
        require(good, F.concat(F.lit("bad report line: "), F.col("line")), F.col("file")).alias(
            "file"
        ),
        key.alias("_key"),
        F.get("_f", F.lit(1)).alias("_a"),
        F.get("_f", F.lit(2)).alias("_b"),
    )

    def only(name: str, value):
        return F.when(F.col("_key") == name, value)

    # the entries of one report, a page of settings
    return rows.groupBy("file").agg(
        F.max(only(PRODUCER_KEY, F.col("_a"))).alias("producer"),
        F.max(only(TIMESTAMP_KEY, F.col("_a").cast("long"))).alias("timestamp"),
        F.map_from_entries(F.collect_list(only(PARAM_KEY, F.struct("_a", "_b")))).alias("params"),
        F.array_sort(F.collect_list(only(FILE_KEY, F.col("_a")))).alias("files"),
    )
