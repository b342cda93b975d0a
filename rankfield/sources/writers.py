"""Writers of the tab-delimited formats.

A target is a folder. Matrices are cut into runs of rows and each run is one
complete, readable file with its own header, so no task writes a whole matrix.
The text holds every cell; it is made where it is written, out of the cells that
are there, and compressed where most are missing, since it is little but tabs then.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_one_row
from ..operators.rank import number_rows
from ..session import release
from .result_files import ROOT_TAG, ROW_TAG

# Rows of one matrix file.
ROWS_PER_FILE = 100_000
# A matrix with more than so many cells for each that is there is sparse. Its files are gzip, read by one task
# each, so they have about SPARSE_CELLS cells, or SPARSE_ROWS rows where these are more, to keep headers a small share.
SPARSE = 8
SPARSE_CELLS = 2 << 20
SPARSE_ROWS = 2048
# Samples whose numbers are sent to every task, at most.
BROADCAST_SAMPLES = 200_000
# Sets of one column-oriented set file.
SETS_PER_FILE = 256
DEFAULT_CALL = "P"
MISSING_TEXT = "na"


def _dense_text(cells: Column, width: Column, empty: str) -> Column:
    """Texts of sorted (no, text) cells, each after a tab, absent numbers below
    ``width`` filled with ``empty``; one pass over the cells."""
    gap = "\t" + empty

    def piece(c: Column, i: Column) -> Column:
        prior = F.when(i > 0, F.get(cells, i - 1)["no"]).otherwise(F.lit(-1).cast("long"))
        skipped = (c["no"] - prior - 1).cast("int")
        return F.concat(F.repeat(F.lit(gap), skipped), F.lit("\t"), c["text"])

    last = F.element_at(cells, -1)["no"]
    return F.concat(
        F.array_join(F.transform(cells, piece), ""),
        F.repeat(F.lit(gap), (width - 1 - last).cast("int")),
    )


class _Wide(NamedTuple):
    """Rows (``_row`` number, feature, description, ``_cells``: those that are there, in any
    order), the sample header, and what the files need to know."""

    rows: DataFrame
    header: DataFrame
    width: int
    sparse: bool
    with_call: bool

    @property
    def rows_per_file(self) -> int:
        if not self.sparse:
            return ROWS_PER_FILE
        return min(ROWS_PER_FILE, max(SPARSE_ROWS, SPARSE_CELLS // self.width))


def _wide(features: DataFrame, with_call: bool) -> _Wide:
    """A row array holds the cells of a row that are there; the header is as long as
    there are samples."""
    samples = number_rows(
        features.select("sample_idx", "sample").distinct(),
        [F.col("sample_idx").asc(), F.col("sample").asc()],
        name="no",
    )
    names = F.array_sort(F.collect_list(F.struct("no", "sample")))
    header = samples.agg(F.transform(names, lambda x: x["sample"]).alias("_samples"))
    described = "description" in features.columns
    desc = F.coalesce(F.min("description"), F.lit(MISSING_TEXT)) if described else F.lit(MISSING_TEXT)
    cell = ["no", "value"]
    if with_call:
        call = F.col("call") if "call" in features.columns else F.lit(None).cast("string")
        cell.append(F.coalesce(call, F.lit(DEFAULT_CALL)).alias("call"))
    width = samples.count()
    release(features.sparkSession)
    numbers = samples.select("sample", "no")
    rows = (
        features.join(F.broadcast(numbers) if width <= BROADCAST_SAMPLES else numbers, "sample")
        .groupBy("row_idx", "feature")
        .agg(desc.alias("description"), F.collect_list(F.struct(*cell)).alias("_cells"))
    )
    rows = number_rows(rows, [F.col("row_idx").asc()], name="_row")
    n_rows, n_cells = rows.agg(F.count(F.lit(1)), F.sum(F.size("_cells"))).first()
    release(features.sparkSession)
    return _Wide(rows, header, width, n_rows * width > SPARSE * (n_cells or 0), with_call)


def _write_files(wide: _Wide, lead: Column, heads: Sequence[Column], path: str) -> None:
    """Rows, each with ``lead`` before its cells, and, before them in each file, the ``heads``
    lines; these may use ``_n_rows`` of the file and ``_samples``. Cells become text behind
    the last shuffle."""
    rows = wide.rows.withColumn("_file", F.expr(f"_row div {wide.rows_per_file}"))
    body = rows.select("_file", F.col("_row").alias("_at"), lead.alias("_lead"), "_cells")
    files = with_one_row(rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n_rows")), wide.header)
    top = files.select("_file", F.posexplode(F.array(*heads)).alias("_at", "_lead")).select(
        "_file", (F.col("_at") - len(heads)).cast("long").alias("_at"), "_lead"
    )

    def shown(c: Column) -> Column:
        text = F.coalesce(c["value"].cast("string"), F.lit(""))
        if wide.with_call:
            text = F.concat_ws("\t", text, c["call"])
        return F.struct(c["no"].alias("no"), text.alias("text"))

    empty = "\t" + DEFAULT_CALL if wide.with_call else ""
    text = _dense_text(F.col("_texts"), F.lit(wide.width), empty)
    (
        body.unionByName(top, allowMissingColumns=True)
        .withColumn("part", F.format_string("%06d", F.col("_file")))
        .repartition("part")
        .sortWithinPartitions("part", "_at")
        .select("part", "_at", "_lead", F.array_sort(F.transform("_cells", shown)).alias("_texts"))
        .select(
            "part", F.when(F.col("_at") < 0, F.col("_lead")).otherwise(F.concat("_lead", text)).alias("value")
        )
        .write.mode("overwrite")
        .option("compression", "gzip" if wide.sparse else "none")
        .partitionBy("part")
        .text(path)
    )
    release(rows.sparkSession)


def _names_line(*lead: str, between: str = "\t") -> Column:
    return F.concat(
        F.lit("\t".join(lead) + "\t"), F.array_join(F.col("_samples"), between)
    )


def write_gct(features: DataFrame, path: str) -> None:
    wide = _wide(features, False)
    heads = [
        F.lit("#1.2"),
        F.concat_ws("\t", F.col("_n_rows").cast("string"), F.size("_samples").cast("string")),
        _names_line("NAME", "DESCRIPTION"),
    ]
    _write_files(wide, F.concat("feature", F.lit("\t"), "description"), heads, path)


def write_txt_matrix(features: DataFrame, path: str) -> None:
    wide = _wide(features, False)
    heads = [_names_line("NAME", "DESCRIPTION")]
    _write_files(wide, F.concat("feature", F.lit("\t"), "description"), heads, path)


def write_pcl(features: DataFrame, path: str) -> None:
    wide = _wide(features, False)
    ones = F.transform("_samples", lambda s: F.lit("1"))
    heads = [
        _names_line("UNIQID", "NAME", "GWEIGHT"),
        F.concat(F.lit("EWEIGHT\t\t\t"), F.array_join(ones, "\t")),
    ]
    _write_files(wide, F.concat("feature", F.lit("\t"), "description", F.lit("\t1")), heads, path)


def write_res(features: DataFrame, path: str) -> None:
    """Values with their calls; a missing call is written as present."""
    wide = _wide(features, True)
    heads = [
        _names_line("DESCRIPTION", "NAME", between="\t\t"),
        F.lit(""),
        F.col("_n_rows").cast("string"),
    ]
    _write_files(wide, F.concat("description", F.lit("\t"), "feature"), heads, path)


def write_rnk(ranked: DataFrame, path: str) -> None:
    """Feature and score in rank order over the part files."""
    (
        ranked.repartitionByRange("rank")
        .sortWithinPartitions("rank")
        .select("feature", "score")
        .write.mode("overwrite")
        .csv(path, sep="\t")
    )


def write_gmt(sets: DataFrame, path: str) -> None:
    """One text line per set: the format itself holds a set in one line."""
    has_desc = "description" in sets.columns
    desc = F.coalesce(F.min("description"), F.lit(MISSING_TEXT)) if has_desc else F.lit(MISSING_TEXT)
    members = F.transform(
        F.array_sort(F.collect_list(F.struct("member_pos", "member"))), lambda x: x["member"]
    )
    lines = sets.groupBy("set_name").agg(desc.alias("description"), members.alias("_m"))
    lines.select(
        F.concat_ws("\t", "set_name", "description", F.array_join("_m", "\t")).alias("value")
    ).write.mode("overwrite").text(path)


def write_gmx(sets: DataFrame, path: str) -> None:
    """Sets in columns; line i holds member i of every set. Each file holds a
    block of ``SETS_PER_FILE`` sets and is complete by itself."""
    has_desc = "description" in sets.columns
    desc = F.coalesce(F.min("description"), F.lit(MISSING_TEXT)) if has_desc else F.lit(MISSING_TEXT)
    names = number_rows(
        sets.groupBy("set_name").agg(desc.alias("description")),
        [F.col("set_name").asc()],
        name="_no",
    ).select(
        "set_name",
        "description",
        F.expr(f"_no div {SETS_PER_FILE}").alias("_file"),
        F.expr(f"_no % {SETS_PER_FILE}").alias("no"),
    )
    placed = number_rows(
        sets.select("set_name", "member", "member_pos"),
        [F.col("member_pos").asc(), F.col("member").asc()],
        ["set_name"],
        name="_at",
    )
    texts = (
        names.select("_file", F.lit(-2).cast("long").alias("_at"), "no", F.col("set_name").alias("text"))
        .unionByName(
            names.select(
                "_file", F.lit(-1).cast("long").alias("_at"), "no", F.col("description").alias("text")
            )
        )
        .unionByName(
            placed.join(names, "set_name").select(
                "_file", "_at", "no", F.col("member").alias("text")
            )
        )
    )
    width = names.groupBy("_file").agg(F.count(F.lit(1)).alias("_width"))
    lines = texts.groupBy("_file", "_at").agg(
        F.array_sort(F.collect_list(F.struct("no", "text"))).alias("_cells")
    )
    (
        lines.join(width, "_file")
        .select(
            F.format_string("%06d", F.col("_file")).alias("part"),
            "_at",
            F.substring(
                _dense_text(F.col("_cells"), F.col("_width"), ""), F.lit(2), F.lit(1 << 30)
            ).alias("value"),
        )
        .repartition("part")
        .sortWithinPartitions("part", "_at")
        .select("part", "value")
        .write.mode("overwrite")
        .partitionBy("part")
        .text(path)
    )


def write_grp(sets: DataFrame, path: str) -> None:
    """One folder ``<set>.grp`` per set, members in order over the part files."""
    (
        sets.withColumn("grp", F.concat("set_name", F.lit(".grp")))
        .repartitionByRange("grp", "member_pos")
        .sortWithinPartitions("grp", "member_pos")
        .select("grp", F.col("member").alias("value"))
        .write.mode("overwrite")
        .partitionBy("grp")
        .text(path)
    )


def write_cls(labels: DataFrame, path: str) -> None:
    """One file per labelling: counts, class names by first use, one label per
    sample; a profile instead where it is numeric. The format holds a labelling in
    one line, so a task holds the labels of one labelling, never of several."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "position",
                F.coalesce("class_name", F.lit("")).alias("class_name"),
                F.coalesce(F.col("num_value").cast("string"), F.lit("")).alias("num_value"),
                F.col("class_idx").isNull().alias("numeric"),
                "phenotype",
            )
        )
    )
    one = labels.groupBy("phenotype").agg(ordered.alias("_l"))
    names = F.transform("_l", lambda x: x["class_name"])
    categorical = F.array(
        F.concat_ws(
            " ",
            F.size("_l").cast("string"),
            F.size(F.array_distinct(names)).cast("string"),
            F.lit("1"),
        ),
        F.concat(F.lit("# "), F.array_join(F.array_distinct(names), " ")),
        F.array_join(names, " "),
    )
    numeric = F.array(
        F.lit("#numeric"),
        F.lit(""),
        F.concat(F.lit("#"), F.col("_l")[0]["phenotype"]),
        F.array_join(F.transform("_l", lambda x: x["num_value"]), " "),
    )
    one.select(
        F.array_join(F.when(F.col("_l")[0]["numeric"], numeric).otherwise(categorical), "\n").alias(
            "value"
        )
    ).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_chip(id_map: DataFrame, path: str) -> None:
    """Every part file carries the header; an empty symbol or title is NULL."""
    id_map.select(
        F.col("probe").alias("Probe Set ID"),
        F.coalesce("symbol", F.lit("NULL")).alias("Gene Symbol"),
        F.coalesce("title", F.lit("NULL")).alias("Gene Title"),
    ).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def write_results(results: DataFrame, path: str) -> None:
    """The results store: one folder per run."""
    results.write.mode("overwrite").partitionBy("run").parquet(path)


def write_results_xml(
    results: DataFrame, path: str, run: dict[str, str], collection: str = "gene_sets.gmt"
) -> None:
    """Result documents. ``results`` carries hit_ranks, es_profile and null_es
    arrays; ``run`` gives the attributes of the root."""

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x.cast("string")), " ")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("NaN"))

    out = results.select(
        F.col("ranked_list").alias("_RANKED_LIST"),
        F.lit("na_as_pre_ranked").alias("_TEMPLATE"),
        F.concat(F.lit(collection + "#"), F.col("set_name")).alias("_GENESET"),
        text("es").alias("_ES"),
        text("nes").alias("_NES"),
        text("np").alias("_NP"),
        text("fdr").alias("_FDR"),
        text("fwer").alias("_FWER"),
        joined("null_es").alias("_RND_ES"),
        joined("hit_ranks").alias("_HIT_INDICES"),
        joined("es_profile").alias("_ES_PROFILE"),
        text("rank_at_max").alias("_RANK_AT_ES"),
        text("score_at_max").alias("_RANK_SCORE_AT_ES"),
    )
    attributes = "".join(f' {k}="{v}"' for k, v in run.items())
    (
        out.write.mode("overwrite")
        .format("xml")
        .option("rootTag", ROOT_TAG + attributes)
        .option("rowTag", ROW_TAG)
        .option("declaration", "")
        .save(path)
    )


def write_tsv_report(df: DataFrame, path: str, precision: dict[str, int] | None = None) -> None:
    """Any result table; ``precision`` gives decimals per column."""
    digits = precision or {}
    df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    ).write.mode("overwrite").csv(path, sep="\t", header=True)


def save_random_lists(lists: DataFrame, path: str) -> None:
    """Each permuted ranked list in a folder of its own."""
    (
        lists.select("perm", "feature", "score", "rank")
        .repartition("perm")
        .write.mode("overwrite")
        .partitionBy("perm")
        .parquet(path)
    )
