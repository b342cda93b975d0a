"""Sources, sinks, cleaning, labellings and id mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..functions import text
from ..operators import clean, idmap, labels
from ..session import scratch_path
from ..sources import collections as coll
from ..sources import label_files, matrices, result_files, writers
from .base import PERMS, Entry, r6, sql

ENTRIES: dict[str, Entry] = {}


def add(name: str, query, twin: str | None) -> None:
    ENTRIES[name] = Entry(query, sql(twin) if twin else None)


# ---- sources and sinks: write the projection, read it back ------------------


def _via(write, read, extension: str, name: str = "data"):
    """Write to a new shared folder named like a source file, then read it."""

    def run(spark, df):
        path = f"{scratch_path(spark, 'io')}/{name}{extension}"
        write(df, path)
        return read(spark, path)

    return run


def _matrix_trip(write, read, extension: str, source=i.dense_features, call: bool = False):
    def query(spark, d):
        df = source(spark, d)
        if call:
            df = df.withColumn("call", F.when(F.col("value") < 0, "A").otherwise("P"))
        out = _via(write, read, extension)(spark, df)
        shown = ["dataset", "row_idx", "feature", "description", "sample_idx", "sample", "value"]
        return r6(out.select(*shown, *(["call"] if call else [])), "value")

    return query


_DENSE = """
SELECT 'data' AS dataset, row_idx, feature, 'na' AS description, sample_idx, sample,
  round(value, 6) AS value{extra}
FROM dense_features"""
_SPARSE = """
SELECT 'data' AS dataset, r.row_no AS row_idx, r.feature, 'na' AS description,
  s.sample_no AS sample_idx, s.sample, round(f.value, 6) AS value
FROM (SELECT row_idx, feature, row_number() OVER (ORDER BY row_idx) - 1 AS row_no
      FROM (SELECT DISTINCT row_idx, feature FROM features)) r
CROSS JOIN (SELECT sample, row_number() OVER (ORDER BY sample_idx) - 1 AS sample_no
      FROM (SELECT DISTINCT sample_idx, sample FROM features)) s
LEFT JOIN features f ON f.row_idx = r.row_idx AND f.sample = s.sample"""

add("read_gct", _matrix_trip(writers.write_gct, matrices.read_gct, ".gct", i.features), _SPARSE)
add(
    "read_txt_matrix",
    _matrix_trip(writers.write_txt_matrix, matrices.read_txt_matrix, ".txt"),
    _DENSE.format(extra=""),
)
add(
    "read_res",
    _matrix_trip(writers.write_res, matrices.read_res, ".res", call=True),
    _DENSE.format(extra=", CASE WHEN value < 0 THEN 'A' ELSE 'P' END AS call"),
)
add(
    "read_pcl",
    _matrix_trip(writers.write_pcl, matrices.read_pcl, ".pcl"),
    _DENSE.format(extra=""),
)


def _text_lines(write, extension: str, source, folder: bool = False):
    """What a writer leaves on disk: every line, without its place."""

    def query(spark, d):
        path = f"{scratch_path(spark, 'io')}/data{extension}"
        write(source(spark, d), path)
        return (
            spark.read.option("recursiveFileLookup", "true")
            .text(path)
            .select(F.rtrim(F.col("value"), F.lit("\t")).alias("line"))
        )

    return query


def _read_sets(write, read, extension: str):
    def query(spark, d):
        out = _via(write, read, extension)(spark, i.part_sets(spark, d))
        return out.select("collection", "set_name", "description", "member", "member_pos")

    return query


def _describe(write):
    return lambda df, path: write(df.withColumn("description", F.col("collection")), path)


_READ_SETS = """
SELECT 'data' AS collection, set_name, collection AS description, member,
  row_number() OVER (PARTITION BY set_name ORDER BY member_pos) - 1 AS member_pos
FROM part_sets"""
add("read_gmt", _read_sets(_describe(writers.write_gmt), coll.read_gmt, ".gmt"), _READ_SETS)
add("read_gmx", _read_sets(_describe(writers.write_gmx), coll.read_gmx, ".gmx"), _READ_SETS)


def _read_grp(spark, d):
    path = scratch_path(spark, "io")
    writers.write_grp(i.part_sets(spark, d).select("set_name", "member", "member_pos"), path)
    return coll.read_grp(spark, path).groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.min("member").alias("first_member"),
        F.max("member").alias("last_member"),
    )


add(
    "read_grp",
    _read_grp,
    """
SELECT set_name, count(*) AS n_members,
  min(member) AS first_member, max(member) AS last_member
FROM part_sets GROUP BY set_name""",
)


def _read_rnk(spark, d):
    out = _via(writers.write_rnk, coll.read_rnk, ".rnk")(spark, i.ranked(spark, d))
    return out.select("list_id", "feature", "score", "rank")


add("read_rnk", _read_rnk, "SELECT 'data' AS list_id, feature, score, rank FROM ranked")


def _read_chip(spark, d):
    out = _via(writers.write_chip, coll.read_chip, ".chip")(spark, i.id_map(spark, d))
    return out.select("platform", "probe", "symbol", "title")


add("read_chip", _read_chip, "SELECT 'data' AS platform, probe, symbol, title FROM id_map")


def _read_cls_categorical(spark, d):
    out = _via(writers.write_cls, label_files.read_cls_categorical, ".cls")(
        spark, i.vector_labels(spark, d)
    )
    return out.select("phenotype", "position", "class_name", "class_idx")


add(
    "read_cls_categorical",
    _read_cls_categorical,
    """
SELECT 'data' AS phenotype, row_number() OVER (ORDER BY position) - 1 AS position, class_name,
  CASE WHEN class_name = (SELECT class_name FROM vector_labels ORDER BY position LIMIT 1)
    THEN 0 ELSE 1 END AS class_idx
FROM vector_labels""",
)


def _read_cls_numeric(spark, d):
    profile = i.region_labels(spark, d).withColumn("class_idx", F.lit(None).cast("int"))
    out = _via(writers.write_cls, label_files.read_cls_numeric, ".cls")(spark, profile)
    return out.select("phenotype", "position", "num_value")


add(
    "read_cls_numeric",
    _read_cls_numeric,
    """
SELECT phenotype, row_number() OVER (ORDER BY position) - 1 AS position, num_value
FROM region_labels""",
)


def _by_sample(spark, d):
    table = i.side_labels(spark, d).select(
        "sample",
        F.col("class_name").alias("SIDE"),
        F.col("num_value").alias("NUMERIC"),
        F.lit("free text").alias("COMMENT"),
    )
    path = scratch_path(spark, "io")
    table.write.csv(path, sep="\t", header=True)  # every part file is a sample table
    return label_files.read_cls_by_sample(spark, path).select(
        "phenotype", "sample", "class_name", "num_value"
    )


add(
    "read_cls_by_sample",
    _by_sample,
    """
SELECT 'SIDE' AS phenotype, sample, class_name, NULL::DOUBLE AS num_value FROM side_labels
UNION ALL SELECT 'NUMERIC', sample, NULL, num_value FROM side_labels""",
)


def _read_probes_cls(spark, d):
    features = i.dense_features(spark, d)
    path = scratch_path(spark, "io")
    names = features.select(F.col("feature").alias("#probes")).distinct()
    names.write.csv(path, header=True)  # every part file begins with the mark
    out = label_files.read_probes_cls(spark, path, features)
    return r6(out.select("phenotype", "sample", "position", "num_value"), "num_value")


add(
    "read_probes_cls",
    _read_probes_cls,
    """
SELECT feature AS phenotype, sample, sample_idx AS position, round(value, 6) AS num_value
FROM dense_features""",
)


def _read_table(spark, d):
    path = scratch_path(spark, "io")
    i.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), "s_suppkey", "s_acctbal"
    ).write.csv(path, sep="\t", header=True)
    out = matrices.read_table(spark, path, numeric=True)
    return out.select("name", "s_suppkey", "s_acctbal")


add(
    "read_table",
    _read_table,
    "SELECT s_name AS name, s_suppkey::DOUBLE AS s_suppkey, s_acctbal FROM supplier",
)


def _stored(spark, d):
    from ..operators.nulls import null_by_sets
    from ..session import cut
    from .stats import edge_parts

    parts = edge_parts(spark, d)
    null_es = cut(null_by_sets(parts.ranked, parts.kept, PERMS))
    arrays = parts.hits.groupBy("set_name").agg(
        F.array_sort(F.collect_list(F.struct("hit_no", "rank", "running_es"))).alias("_h")
    ).select(
        "set_name",
        F.transform("_h", lambda x: x["rank"]).alias("hit_ranks"),
        F.transform("_h", lambda x: x["running_es"]).alias("es_profile"),
    )
    nulls = null_es.groupBy("set_name").agg(
        F.array_sort(F.collect_list(F.struct("perm", "es"))).alias("_n")
    ).select("set_name", F.transform("_n", lambda x: x["es"]).alias("null_es"))
    empty = F.lit(None).cast("double")
    return (
        parts.es.join(arrays, "set_name")
        .join(nulls, "set_name")
        .select(
            F.lit("r1").alias("run"),
            F.lit("list.rnk").alias("ranked_list"),
            "*",
            empty.alias("nes"),
            empty.alias("np"),
            empty.alias("fdr"),
            empty.alias("fwer"),
        )
    )


def _read_results_db(spark, d):
    path = scratch_path(spark, "io")
    writers.write_results_xml(_stored(spark, d), path, {"METRIC": "None", "NUM_PERMS": str(PERMS)})
    out = result_files.read_results_db(spark, path)
    return r6(
        out.select(
            "set_name",
            "es",
            "rank_at_max",
            "score_at_max",
            F.size("hit_ranks").cast("long").alias("n_hits"),
            F.aggregate("hit_ranks", F.lit(0).cast("long"), lambda a, x: a + x).alias("rank_sum"),
            F.element_at("es_profile", 1).alias("first_es"),
            F.aggregate("null_es", F.lit(0.0), lambda a, x: a + x).alias("null_sum"),
        ),
        "es",
        "first_es",
        "null_sum",
    )


add(
    "read_results_db",
    _read_results_db,
    """
SELECT e.set_name, round(e.es, 6) AS es, e.rank_at_max, e.score_at_max, h.n_hits, h.rank_sum,
  round(h.first_es, 6) AS first_es, round(n.null_sum, 6) AS null_sum
FROM es e
JOIN (SELECT set_name, count(*) AS n_hits, sum(rank)::BIGINT AS rank_sum,
        arg_min(running_es, rank) AS first_es FROM hits GROUP BY set_name) h USING (set_name)
JOIN (SELECT set_name, sum(es) AS null_sum FROM null_es GROUP BY set_name) n USING (set_name)""",
)


def _read_run_reports(spark, d):
    """One report per segment of customers, from its counts."""
    path = scratch_path(spark, "io")
    seg = i.table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last")
    )
    lines = F.array(
        F.concat_ws("\t", F.lit("producer_class"), F.lit("tool")),
        F.concat_ws("\t", F.lit("producer_timestamp"), F.col("n").cast("string")),
        F.concat_ws("\t", F.lit("param"), F.lit("segment"), F.col("c_mktsegment")),
        F.concat_ws("\t", F.lit("param"), F.lit("last"), F.col("last").cast("string")),
        F.concat_ws("\t", F.lit("file"), F.concat(F.lit("/data/"), F.col("c_mktsegment"))),
    )
    seg.select("c_mktsegment", F.explode(lines).alias("value")).repartition(
        "c_mktsegment"
    ).write.partitionBy("c_mktsegment").text(path)
    out = result_files.read_run_reports(spark, path)
    return out.select(
        "producer",
        "timestamp",
        F.col("params")["segment"].alias("segment"),
        F.col("params")["last"].cast("long").alias("last"),
        F.col("files")[0].alias("first_file"),
    )


add(
    "read_run_reports",
    _read_run_reports,
    """
SELECT 'tool' AS producer, count(*) AS "timestamp", c_mktsegment AS segment,
  max(c_custkey) AS last, '/data/' || c_mktsegment AS first_file
FROM customer GROUP BY c_mktsegment""",
)

# sinks: the text they leave behind
add(
    "write_gmt",
    _text_lines(_describe(writers.write_gmt), ".gmt", i.part_sets),
    """
SELECT set_name || chr(9) || min(collection) || chr(9)
  || string_agg(member, chr(9) ORDER BY member_pos) AS line
FROM part_sets GROUP BY set_name""",
)
add(
    "write_grp",
    _text_lines(
        lambda df, path: writers.write_grp(df.select("set_name", "member", "member_pos"), path),
        "",
        i.part_sets,
    ),
    "SELECT member AS line FROM part_sets",
)
add(
    "write_gmx",
    _text_lines(_describe(writers.write_gmx), ".gmx", i.part_sets),
    """
SELECT rtrim(string_agg(coalesce(c.t, ''), chr(9) ORDER BY n.set_name), chr(9)) AS line
FROM (SELECT DISTINCT set_name FROM part_sets) n
CROSS JOIN (SELECT unnest(range(-2, (SELECT max(c) FROM (
    SELECT count(*) AS c FROM part_sets GROUP BY set_name)))) AS spot) p
LEFT JOIN (
  SELECT set_name, row_number() OVER (PARTITION BY set_name ORDER BY member_pos) - 1 AS spot,
    member AS t FROM part_sets
  UNION ALL SELECT DISTINCT set_name, -2, set_name FROM part_sets
  UNION ALL SELECT DISTINCT set_name, -1, collection FROM part_sets
) c ON c.set_name = n.set_name AND c.spot = p.spot
GROUP BY p.spot""",
)
add(
    "write_cls",
    _text_lines(writers.write_cls, ".cls", i.side_labels),
    """
SELECT count(*) || ' ' || count(DISTINCT class_name) || ' 1' AS line FROM side_labels
UNION ALL SELECT '# ' || string_agg(class_name, ' ' ORDER BY p)
  FROM (SELECT class_name, min(position) AS p FROM side_labels GROUP BY class_name)
UNION ALL SELECT string_agg(class_name, ' ' ORDER BY position) FROM side_labels""",
)
add(
    "write_chip",
    # every part file carries the header
    lambda spark, d: _text_lines(writers.write_chip, ".chip", i.id_map)(spark, d).distinct(),
    """
SELECT 'Probe Set ID' || chr(9) || 'Gene Symbol' || chr(9) || 'Gene Title' AS line
UNION ALL SELECT probe || chr(9) || symbol || chr(9) || title FROM id_map""",
)


def _parsed(write, extension: str, source):
    """Names and cell counts of every line a matrix writer leaves."""

    def query(spark, d):
        path = f"{scratch_path(spark, 'io')}/data{extension}"
        write(source(spark, d), path)
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
        fields = F.split("value", "\t", -1)
        return lines.select(
            fields[0].alias("first_field"), F.size(fields).cast("long").alias("n_fields")
        )

    return query


_ROWS = "SELECT {first} AS first_field, count(*) + {extra} AS n_fields FROM dense_features GROUP BY feature"
_WIDTH = "(SELECT count(DISTINCT sample) FROM dense_features)"
add(
    "write_gct",
    _parsed(writers.write_gct, ".gct", i.dense_features),
    f"""
SELECT '#1.2' AS first_field, 1 AS n_fields
UNION ALL SELECT count(DISTINCT feature)::VARCHAR, 2 FROM dense_features
UNION ALL SELECT 'NAME', {_WIDTH} + 2
UNION ALL {_ROWS.format(first="feature", extra=2)}""",
)
add(
    "write_txt",
    _parsed(writers.write_txt_matrix, ".txt", i.dense_features),
    f"""
SELECT 'NAME' AS first_field, {_WIDTH} + 2 AS n_fields
UNION ALL {_ROWS.format(first="feature", extra=2)}""",
)
add(
    "write_pcl",
    _parsed(writers.write_pcl, ".pcl", i.dense_features),
    f"""
SELECT 'UNIQID' AS first_field, {_WIDTH} + 3 AS n_fields
UNION ALL SELECT 'EWEIGHT', {_WIDTH} + 3
UNION ALL {_ROWS.format(first="feature", extra=3)}""",
)
add(
    "write_res",
    _parsed(writers.write_res, ".res", i.dense_features),
    f"""
SELECT 'DESCRIPTION' AS first_field, 2 * {_WIDTH} + 1 AS n_fields
UNION ALL SELECT '', 1
UNION ALL SELECT count(DISTINCT feature)::VARCHAR, 1 FROM dense_features
UNION ALL SELECT 'na', 2 * count(*) + 2 FROM dense_features GROUP BY feature""",
)


def _cells(write, extension: str, lead: int, head: str, feature_at: int, step: int = 1):
    """Every cell a matrix writer leaves, by the names of its header line; read without the readers."""

    def query(spark, d):
        path = f"{scratch_path(spark, 'io')}/data{extension}"
        write(i.dense_features(spark, d), path)
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.split("value", "\t", -1).alias("_f"))
        rest = F.posexplode(F.slice("_f", lead + 1, 1 << 30)).alias("position", "text")
        first = F.col("_f")[0]
        names = lines.filter(first == head).select("_f").distinct().select(rest)
        rows = lines.filter((first != head) & (first != "EWEIGHT") & (F.size("_f") > lead))
        cells = rows.select(F.col("_f")[feature_at].alias("feature"), rest).filter(F.col("position") % step == 0)
        out = cells.join(names.select("position", F.col("text").alias("sample")), "position")
        return r6(out.select("feature", "sample", F.col("text").cast("double").alias("value")), "value")

    return query


_CELLS = "SELECT feature, sample, round(value, 6) AS value FROM dense_features"
add("write_gct_cells", _cells(writers.write_gct, ".gct", 2, "NAME", 0), _CELLS)
add("write_txt_cells", _cells(writers.write_txt_matrix, ".txt", 2, "NAME", 0), _CELLS)
add("write_pcl_cells", _cells(writers.write_pcl, ".pcl", 3, "UNIQID", 0), _CELLS)
add("write_res_cells", _cells(writers.write_res, ".res", 2, "DESCRIPTION", 1, 2), _CELLS)


def _document(table):
    """All elements of one array of a result document that was written and read again."""

    def query(spark, d):
        path = scratch_path(spark, "io")
        writers.write_results_xml(_stored(spark, d), path, {"METRIC": "None", "NUM_PERMS": str(PERMS)})
        return table(result_files.read_results_db(spark, path))

    return query


add(
    "read_results_profile",
    _document(lambda read: r6(result_files.results_to_hits(read), "running_es")),
    "SELECT set_name, hit_no, rank, round(running_es, 6) AS running_es FROM hits",
)
add(
    "read_results_null",
    _document(lambda read: r6(result_files.results_to_null(read), "es")),
    "SELECT set_name, perm, round(es, 6) AS es FROM null_es",
)


def _write_rnk(spark, d):
    path = scratch_path(spark, "io")
    writers.write_rnk(i.ranked(spark, d), path)
    return spark.read.csv(path, sep="\t", schema="feature string, score double")


add("write_rnk", _write_rnk, "SELECT feature, score FROM ranked")


def _write_results(spark, d):
    path = scratch_path(spark, "io")
    stored = _stored(spark, d)
    writers.write_results(stored, path)
    out = spark.read.schema(stored.schema).parquet(path)  # a store without runs has no file to tell its columns
    return r6(
        out.select("run", "set_name", "size", "es", F.size("null_es").alias("n_perm")), "es"
    )


add(
    "write_results",
    _write_results,
    f"SELECT 'r1' AS run, set_name, size, round(es, 6) AS es, {PERMS} AS n_perm FROM es",
)


def _write_tsv_report(spark, d):
    from .stats import edge_parts

    path = scratch_path(spark, "io")
    es = edge_parts(spark, d).es.select("set_name", "size", "es")
    writers.write_tsv_report(es, path, {"es": 2})
    return spark.read.csv(
        path, sep="\t", header=True, schema="set_name string, size long, es double"
    )


add(
    "write_tsv_report",
    _write_tsv_report,
    "SELECT set_name, size, round(es, 2) AS es FROM es",
)


def _save_random_lists(spark, d):
    from ..operators.nulls import permuted_lists, permuted_scores

    path = scratch_path(spark, "io")
    scores = permuted_scores(i.dense_features(spark, d), i.vector_labels(spark, d), PERMS)
    writers.save_random_lists(permuted_lists(scores), path)
    return r6(spark.read.parquet(path).select("perm", "feature", "score", "rank"), "score")


add(
    "save_random_lists",
    _save_random_lists,
    "SELECT perm, feature, round(score, 6) AS score, rank FROM perm_lists",
)

# ---- text cleaning ----------------------------------------------------------

add(
    "parse_number",
    lambda spark, d: i.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "na")
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit('"'), "o_custkey", F.lit('"')))
        .otherwise(F.concat(F.lit("  "), "o_custkey", F.lit(" ")))
        .alias("_t"),
    ).select(
        "o_orderkey", text.parse_number("_t").alias("value"), text.number_error("_t").alias("bad")
    ),
    """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey::DOUBLE END AS value,
  false AS bad
FROM orders""",
)
add(
    "clean_feature_name",
    lambda spark, d: i.table(spark, d, "part").select(
        "p_partkey",
        text.clean_feature_name(F.concat(F.lit(' " '), "p_name", F.lit('" '))).alias("name"),
    ),
    "SELECT p_partkey, trim(p_name) AS name FROM part",
)
add(
    "split_fields",
    lambda spark, d: i.table(spark, d, "part").select(
        "p_partkey",
        text.split_fields(
            F.concat_ws("\t", "p_name", F.lit(""), "p_type", F.lit(""), F.lit(""), F.lit("")), 4
        ).alias("_f"),
    ).select("p_partkey", F.array_join("_f", "|").alias("fields"), F.size("_f").alias("n")),
    "SELECT p_partkey, p_name || '||' || p_type || '|' AS fields, 4 AS n FROM part",
)
add(
    "is_null_token",
    lambda spark, d: i.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", " null ")
        .when(F.col("o_orderpriority").startswith("1"), "  ")
        .when(F.col("o_orderpriority").startswith("2"), " Na")
        .otherwise(F.col("o_orderpriority"))
        .alias("_t"),
    ).select(
        "o_orderkey",
        text.is_null_token("_t").alias("is_null"),
        text.is_na_token("_t").alias("is_na"),
    ),
    """
SELECT o_orderkey, trim(t) = '' OR upper(trim(t)) = 'NULL' AS is_null,
  lower(trim(t)) = 'na' AS is_na
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ' null '
        WHEN starts_with(o_orderpriority, '1') THEN '  '
        WHEN starts_with(o_orderpriority, '2') THEN ' Na'
        ELSE o_orderpriority END AS t FROM orders)""",
)
add(
    "base_name",
    lambda spark, d: i.table(spark, d, "pages").select(
        "page_id",
        text.base_name("url").alias("file_name"),
        text.base_name(F.concat("url", F.lit("#set_"), "page_id")).alias("set_name"),
    ),
    """
SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1)
  ELSE split_part(url, '/', -1) END AS file_name, 'set_' || page_id AS set_name
FROM pages""",
)
add(
    "collection_version",
    lambda spark, d: i.table(spark, d, "part").select(
        "p_partkey",
        text.collection_version(
            F.concat(
                F.when(F.col("p_type") == "SMALL", "https://sets.example/").otherwise("/home/x/"),
                F.lit("collection.v"),
                "p_size",
                F.when(F.col("p_brand") == "Brand#1", ".Mm").otherwise(".Hs"),
                F.lit(".symbols.gmt"),
            ),
            ".symbols.gmt",
            ["sets.example"],
        ).alias("_v"),
    ).select("p_partkey", "_v.version", "_v.species"),
    """
SELECT p_partkey,
  CASE WHEN p_type = 'SMALL' THEN 'v' || p_size
    || CASE WHEN p_brand = 'Brand#1' THEN '.Mm' ELSE '.Hs' END END AS version,
  CASE WHEN p_type = 'SMALL' THEN
    CASE WHEN p_brand = 'Brand#1' THEN 'mouse' ELSE 'human' END END AS species
FROM part""",
)

# ---- filters ----------------------------------------------------------------

add(
    "drop_all_missing_rows",
    lambda spark, d: clean.drop_all_missing_rows(i.order_features(spark, d)),
    """
SELECT * FROM order_features
WHERE row_idx IN (SELECT row_idx FROM order_features GROUP BY row_idx HAVING count(value) > 0)""",
)
add(
    "missing_value_profile",
    lambda spark, d: clean.missing_value_profile(i.features(spark, d)),
    """
SELECT count(*) FILTER (have > 0) AS n_features,
  count(*) FILTER (have > 0 AND have < width) AS partly_missing,
  count(*) FILTER (have = 0) AS all_missing, bool_or(inf) AS has_infinite,
  count(*) FILTER (have > 0) <= 2000 AS few_features
FROM (SELECT row_idx, count(value) AS have, bool_or(isinf(value)) AS inf
      FROM features GROUP BY row_idx),
  (SELECT count(DISTINCT sample) AS width FROM features)""",
)
add(
    "unique_features",
    lambda spark, d: clean.unique_features(i.order_features(spark, d)),
    """
SELECT * FROM order_features
QUALIFY row_idx = max(row_idx) OVER (PARTITION BY feature)""",
)
add(
    "duplicate_features",
    lambda spark, d: clean.duplicate_features(i.order_features(spark, d)),
    """
SELECT feature, count(DISTINCT row_idx) AS n_rows FROM order_features
GROUP BY feature HAVING count(DISTINCT row_idx) > 1""",
)
add(
    "unique_ranked",
    lambda spark, d: clean.unique_ranked(i.order_ranked(spark, d)).select(
        "feature", "score", "rank"
    ),
    """
SELECT feature, last_score AS score, row_number() OVER (ORDER BY first_rank) - 1 AS rank
FROM (SELECT feature, min(rank) AS first_rank, arg_max(score, rank) AS last_score
      FROM order_ranked GROUP BY feature)""",
)


def _wanted(spark, d):
    """Parts asked for: the suppliers' keys as part names, some unknown."""
    return i.table(spark, d, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey") * 2).alias("feature"),
        F.col("c_custkey").alias("position"),
    )


_WANTED = "(SELECT 'P' || (c_custkey * 2) AS feature, c_custkey AS position FROM customer) w"
add(
    "extract_rows",
    lambda spark, d: r6(clean.extract_rows(i.features(spark, d), _wanted(spark, d)), "value"),
    f"""
SELECT f.row_idx, f.feature, f.sample_idx, f.sample, round(f.value, 6) AS value, w.position
FROM features f JOIN {_WANTED} USING (feature)""",
)
add(
    "extract_rows_missing",
    lambda spark, d: clean.missing_rows(i.features(spark, d), _wanted(spark, d)),
    f"SELECT w.* FROM {_WANTED} WHERE feature NOT IN (SELECT feature FROM features)",
)
add(
    "extract_rows_by_rank",
    lambda spark, d: r6(
        clean.extract_rows_by_rank(
            i.features(spark, d),
            i.part_sets(spark, d),
            i.ranked(spark, d),
        ).select("set_name", "rank", "feature", "sample", "value"),
        "value",
    ),
    """
SELECT s.set_name, r.rank, f.feature, f.sample, round(f.value, 6) AS value
FROM features f JOIN part_sets s ON s.member = f.feature
JOIN ranked r ON r.feature = f.feature""",
)
add(
    "select_samples_for_labels",
    lambda spark, d: r6(
        clean.select_samples_for_labels(
            i.features(spark, d), i.side_labels(spark, d)
        ).select("feature", "sample", "class_name", "class_idx", "sample_pos", "value"),
        "value",
    ),
    """
SELECT f.feature, f.sample, l.class_name, l.class_idx, l.sample_pos, round(f.value, 6) AS value
FROM features f JOIN (SELECT *, row_number() OVER (ORDER BY class_idx, position) - 1 AS sample_pos
  FROM side_labels) l USING (sample)""",
)
add(
    "sign_split",
    lambda spark, d: clean.sign_split(i.ranked(spark, d), "score", "pos")
    .withColumn("side", F.lit("pos"))
    .unionByName(
        clean.sign_split(i.ranked(spark, d), "score", "neg").withColumn("side", F.lit("neg"))
    ),
    """
SELECT feature, score, rank, 'pos' AS side FROM ranked WHERE score >= 0
UNION ALL SELECT feature, score, rank, 'neg' FROM ranked WHERE score <= 0""",
)
add(
    "sign_count",
    lambda spark, d: clean.sign_count(i.ranked(spark, d), "score"),
    """
SELECT count(*) FILTER (score >= 0) AS n_pos, count(*) FILTER (score <= 0) AS n_neg,
  count(*) AS n_all FROM ranked""",
)
add(
    "min_samples_check",
    lambda spark, d: clean.min_samples_check(i.side_labels(spark, d)),
    """
SELECT 'samples' AS "check", count(*) AS actual, 6 AS required, count(*) >= 6 AS ok
FROM side_labels
UNION ALL SELECT 'class ' || class_name, count(*), 3, count(*) >= 3
FROM side_labels GROUP BY class_name""",
)
add(
    "omit_features_without_class_data",
    lambda spark, d: r6(
        clean.omit_features_without_class_data(i.features(spark, d), i.side_labels(spark, d)),
        "value",
    ),
    """
SELECT feature, row_idx, sample_idx, sample, round(value, 6) AS value FROM features
WHERE feature IN (
  SELECT feature FROM class_cells GROUP BY feature HAVING count(DISTINCT class_idx) = 2)""",
)


def _broken(ranked):
    """The list with non-finite ends and one inner break."""
    r, s = F.col("rank"), F.col("score")
    return ranked.withColumn(
        "score",
        F.when(s > 0.015, F.lit(float("inf")))
        .when(s < -0.015, F.lit(float("-inf")))
        .when(s == 0, F.lit(float("nan")))
        .otherwise(s),
    )


_BROKEN = """(SELECT feature, rank, CASE WHEN score > 0.015 THEN 'inf'::DOUBLE
  WHEN score < -0.015 THEN '-inf'::DOUBLE WHEN score = 0 THEN 'nan'::DOUBLE ELSE score END AS score
  FROM ranked) b"""


def _finite_guard(spark, d):
    from ..functions.numbers import POWER_GUARD, WEIGHTED_GUARD, finite_guard

    return _broken(i.ranked(spark, d)).select(
        "feature",
        finite_guard(F.abs("score"), WEIGHTED_GUARD).alias("weighted"),
        F.round(finite_guard(F.col("score") * F.col("score"), POWER_GUARD), 9).alias("squared"),
    )


add(
    "finite_guard",
    _finite_guard,
    f"""
SELECT feature, CASE WHEN isfinite(score) THEN abs(score) ELSE 0.01 END AS weighted,
  round(CASE WHEN isfinite(score) THEN score * score ELSE 1e-6 END, 9) AS squared
FROM {_BROKEN}""",
)
add(
    "adjust_infinite_ends",
    lambda spark, d: clean.adjust_infinite_ends(_broken(i.ranked(spark, d))).select(
        "feature", "rank", F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.lit(0.0)).alias("score")
    ),
    f"""
SELECT feature, rank, CASE WHEN rank < lo OR rank > hi THEN
    CASE WHEN score = '-inf'::DOUBLE THEN -1e-6 ELSE 1e-6 END
  WHEN isnan(score) THEN 0 ELSE score END AS score
FROM {_BROKEN}, (SELECT min(rank) FILTER (isfinite(score)) AS lo,
    max(rank) FILTER (isfinite(score)) AS hi FROM {_BROKEN}) e""",
)
add(
    "slice_matrix",
    lambda spark, d: r6(
        clean.slice_matrix(
            i.features(spark, d),
            i.part_sets(spark, d).filter("collection = 'type'").select(
                F.col("member").alias("feature"), (-F.col("member_pos")).alias("new_row")
            ),
            i.side_labels(spark, d).filter("class_idx = 0").select(
                "sample", (-F.col("position")).alias("new_col")
            ),
        ),
        "value",
    ),
    """
SELECT -s.member_pos AS new_row, -l.position AS new_col, f.feature, f.sample,
  round(f.value, 6) AS value
FROM features f JOIN part_sets s ON s.member = f.feature AND s.collection = 'type'
JOIN side_labels l ON l.sample = f.sample AND l.class_idx = 0""",
)
add(
    "search_feature",
    lambda spark, d: clean.search_feature(i.ranked(spark, d), "p19"),
    "SELECT feature, score, rank FROM ranked WHERE upper(feature) LIKE '%P19%'",
)


def _filter_results(spark, d):
    from .stats import edge_parts

    out = clean.filter_results(edge_parts(spark, d).es, "es > 0", "es", ascending=False)
    return r6(out.select("set_name", "size", "es"), "es")


add(
    "filter_results",
    _filter_results,
    "SELECT set_name, size, round(es, 6) AS es FROM es WHERE es > 0 ORDER BY es DESC",
)

# ---- labellings -------------------------------------------------------------

_COLS = "phenotype, sample, position, class_name, class_idx"


def _lab(fn, source=i.region_labels):
    return lambda spark, d: fn(source(spark, d)).select(*_COLS.split(", "))


add(
    "labels_forward",
    _lab(labels.labels_forward, i.side_labels),
    "SELECT 'WEST_versus_EAST' AS phenotype, sample, position, class_name, class_idx FROM side_labels",
)
add(
    "labels_reversed",
    _lab(labels.labels_reversed, i.side_labels),
    """
SELECT 'EAST_versus_WEST' AS phenotype, sample, position, class_name, 1 - class_idx AS class_idx
FROM side_labels""",
)
_ONE_REST = """
SELECT {name} AS phenotype, l.sample, l.position,
  CASE WHEN l.class_name = c.one THEN c.one ELSE 'REST' END AS class_name,
  CASE WHEN l.class_name = c.one THEN {a} ELSE {b} END AS class_idx
FROM region_labels l, (SELECT DISTINCT class_name AS one FROM region_labels) c"""
_FORTH = _ONE_REST.format(name="c.one || '_versus_REST'", a=0, b=1)
_BACK = _ONE_REST.format(name="'REST_versus_' || c.one", a=1, b=0)
add("labels_one_vs_rest", _lab(labels.labels_one_vs_rest), _FORTH)
_PAIRS = """
SELECT a.one || '_versus_' || b.one AS phenotype, l.sample, l.position, l.class_name,
  CASE WHEN l.class_name = a.one THEN 0 ELSE 1 END AS class_idx
FROM (SELECT DISTINCT class_name AS one FROM region_labels) a
JOIN (SELECT DISTINCT class_name AS one FROM region_labels) b ON a.one <> b.one
JOIN region_labels l ON l.class_name IN (a.one, b.one)"""
add("labels_all_pairs", _lab(labels.labels_all_pairs), _PAIRS)
_SINGLE = """
SELECT class_name AS phenotype, sample, position, class_name, 0 AS class_idx FROM region_labels"""
add("labels_single_class", _lab(labels.labels_single_class), _SINGLE)
add(
    "labels_all_derived",
    _lab(labels.labels_all_derived),
    f"{_FORTH} UNION ALL {_BACK} UNION ALL {_PAIRS} UNION ALL {_SINGLE}",
)
add(
    "labels_from_numeric",
    lambda spark, d: labels.labels_from_numeric(i.region_labels(spark, d)).select(
        "phenotype", "sample", "position", "num_value"
    ),
    "SELECT phenotype, sample, position, num_value FROM region_labels",
)
add(
    "labels_from_feature",
    lambda spark, d: r6(
        labels.labels_from_feature(i.dense_features(spark, d), "D7").select(
            "phenotype", "sample", "position", "num_value"
        ),
        "num_value",
    ),
    """
SELECT feature AS phenotype, sample, sample_idx AS position, round(value, 6) AS num_value
FROM dense_features WHERE feature = 'D7'""",
)


def _named_samples(spark, d):
    samples = i.features(spark, d).select("sample", "sample_idx").distinct()
    chosen = i.side_labels(spark, d).select(
        F.lower("sample").alias("name"), "class_name", "class_idx"
    )
    return labels.labels_from_sample_names(samples, chosen, "picked").select(*_COLS.split(", "))


add(
    "labels_from_sample_names",
    _named_samples,
    """
SELECT 'picked' AS phenotype, sample, position, class_name, class_idx FROM side_labels""",
)
add(
    "split_by_class",
    lambda spark, d: r6(
        labels.split_by_class(i.features(spark, d), i.region_labels(spark, d)), "value"
    ),
    """
SELECT l.phenotype, f.feature, l.class_name, l.class_idx, f.sample, round(f.value, 6) AS value
FROM features f JOIN region_labels l USING (sample)""",
)
add(
    "sync_profile",
    lambda spark, d: r6(
        labels.sync_profile(i.features(spark, d), i.side_labels(spark, d)).select(
            "feature", "position", "sample", "value", "num_value"
        ),
        "value",
    ),
    """
SELECT f.feature, l.position, f.sample, round(f.value, 6) AS value, l.num_value
FROM features f JOIN side_labels l USING (sample) WHERE f.value IS NOT NULL""",
)

# ---- id mapping and collapse ------------------------------------------------

add(
    "annotate_symbols",
    lambda spark, d: idmap.annotate(i.ranked(spark, d), i.id_map(spark, d)).select(
        "feature", "symbol", "score"
    ),
    """
SELECT r.feature, m.symbol, r.score FROM ranked r JOIN id_map m ON m.probe = r.feature
WHERE m.symbol <> ''""",
)
add(
    "annotate_symbols_keep",
    lambda spark, d: idmap.annotate(
        i.ranked(spark, d), i.id_map(spark, d), keep_unmapped=True
    ).select("feature", "symbol", "score"),
    """
SELECT r.feature, coalesce(nullif(m.symbol, ''), r.feature) AS symbol, r.score
FROM ranked r LEFT JOIN id_map m ON m.probe = r.feature""",
)


def _collapse(mode: str):
    return lambda spark, d: r6(
        idmap.collapse(i.features(spark, d), i.id_map(spark, d), mode), "value"
    )


def _collapse_sql(expr: str) -> str:
    return f"""
SELECT m.symbol AS feature, f.sample, round({expr}, 6) AS value
FROM features f JOIN id_map m ON m.probe = f.feature WHERE m.symbol <> ''
GROUP BY m.symbol, f.sample"""


add("collapse_max", _collapse("max"), _collapse_sql("max(f.value)"))
add("collapse_median", _collapse("median"), _collapse_sql("median(f.value)"))
add("collapse_mean", _collapse("mean"), _collapse_sql("avg(f.value)"))
add("collapse_sum", _collapse("sum"), _collapse_sql("sum(f.value)"))


def _centred(spark, d):
    """Signed cells: each against the mean of its row."""
    cells = i.features(spark, d)
    means = cells.groupBy("feature").agg(F.avg("value").alias("_m"))
    return cells.join(means, "feature").select(
        "row_idx", "feature", "sample", F.round(F.col("value") - F.col("_m"), 6).alias("value")
    )


_CENTRED = """(SELECT f.row_idx, f.feature, f.sample, round(f.value - a.m, 6) AS value
  FROM features f JOIN (SELECT feature, avg(value) AS m FROM features GROUP BY feature) a
  USING (feature)) c"""
add(
    "collapse_absmax",
    lambda spark, d: idmap.collapse(_centred(spark, d), i.id_map(spark, d), "absmax"),
    f"""
SELECT m.symbol AS feature, c.sample, c.value
FROM {_CENTRED} JOIN id_map m ON m.probe = c.feature WHERE m.symbol <> ''
QUALIFY row_number() OVER (PARTITION BY m.symbol, c.sample
  ORDER BY abs(c.value) DESC, c.row_idx) = 1""",
)


def _remap(spark, d):
    """Parts renamed by a 1:1 map: their name with their key."""
    one = i.table(spark, d, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("probe"),
        F.concat_ws("_", "p_name", "p_partkey").alias("symbol"),
    )
    return r6(idmap.remap_only(i.features(spark, d), one), "value")


add(
    "remap_only",
    _remap,
    """
SELECT p_name || '_' || p_partkey AS feature, sample, round(value, 6) AS value
FROM features JOIN part ON p_partkey = row_idx""",
)


def _collapse_matrix(spark, d):
    cells, map_ = i.features(spark, d), i.id_map(spark, d)
    titles = idmap.collapse_titles(cells, map_).withColumnRenamed("symbol", "feature")
    out = idmap.collapse(cells, map_, "median").join(titles, "feature")
    return r6(out.select("feature", "title", "sample", "value"), "value")


add(
    "collapse_matrix",
    _collapse_matrix,
    """
SELECT m.symbol AS feature, t.title, f.sample, round(median(f.value), 6) AS value
FROM features f JOIN id_map m ON m.probe = f.feature
JOIN (SELECT m.symbol, arg_min(m.title, f.row_idx) AS title
      FROM (SELECT DISTINCT feature, row_idx FROM features) f
      JOIN id_map m ON m.probe = f.feature WHERE m.symbol <> '' GROUP BY m.symbol) t
  ON t.symbol = m.symbol
WHERE m.symbol <> '' GROUP BY m.symbol, t.title, f.sample""",
)
add(
    "collapse_ranked_list",
    lambda spark, d: idmap.collapse_ranked_list(
        i.ranked(spark, d), i.id_map(spark, d), "max"
    ).select("feature", "score", "rank"),
    """
SELECT symbol AS feature, score, row_number() OVER (ORDER BY score DESC, symbol) - 1 AS rank
FROM (SELECT m.symbol, max(r.score) AS score
      FROM ranked r JOIN id_map m ON m.probe = r.feature WHERE m.symbol <> '' GROUP BY m.symbol)""",
)
add(
    "collapse_details",
    lambda spark, d: idmap.collapse_details(i.features(spark, d), i.id_map(spark, d)),
    """
SELECT m.symbol, count(*) OVER (PARTITION BY m.symbol) AS n_probes, f.feature AS probe
FROM (SELECT DISTINCT feature FROM features) f JOIN id_map m ON m.probe = f.feature
WHERE m.symbol <> ''""",
)
add(
    "map_sets_to_platform",
    lambda spark, d: idmap.map_sets_to_platform(i.symbol_sets(spark, d), i.id_map(spark, d)),
    """
SELECT DISTINCT s.set_name, m.probe AS member
FROM symbol_sets s JOIN id_map m ON m.symbol = s.member""",
)


def _set_words(spark, d):
    """Symbols of all parts, blank-symbol parts under their own name, by brand."""
    map_ = i.table(spark, d, "part")
    own = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    return map_.select(F.upper("p_type").alias("set_name"), own.alias("member")).distinct()


_WORDS = "(SELECT DISTINCT upper(p_type) AS set_name, p_brand || '/' || p_size AS member FROM part) s"
add(
    "mapping_details",
    lambda spark, d: idmap.mapping_details(_set_words(spark, d), i.id_map(spark, d)),
    f"""
SELECT s.set_name, count(DISTINCT s.member) AS source_members,
  count(DISTINCT m.probe) AS target_members,
  count(DISTINCT CASE WHEN m.probe IS NOT NULL THEN s.member END) AS members_mapped
FROM {_WORDS} LEFT JOIN id_map m ON m.symbol = s.member GROUP BY s.set_name""",
)
add(
    "member_targets",
    lambda spark, d: idmap.member_targets(_set_words(spark, d), i.id_map(spark, d)),
    f"""
SELECT s.set_name, s.member, coalesce(m.probe, 'invalid') AS target
FROM {_WORDS} LEFT JOIN id_map m ON m.symbol = s.member""",
)


def _versions(spark, d):
    return i.table(spark, d, "nation").select(
        F.col("n_name").alias("source"),
        F.lit("sets").alias("kind"),
        F.when(F.col("n_regionkey") > 0, "human").alias("species"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("v"), "n_regionkey")).alias("version"),
    )


add(
    "check_species_version",
    lambda spark, d: idmap.check_species_version(_versions(spark, d)),
    """
SELECT count(DISTINCT s) AS n_species, count(DISTINCT v) AS n_versions,
  count(*) FILTER (v IS NULL) AS n_unknown, count(DISTINCT s) <= 1 AS species_ok,
  count(v) = 0 OR (count(v) = count(*) AND count(DISTINCT v) = 1) AS version_ok
FROM (SELECT CASE WHEN n_regionkey > 0 THEN 'human' END AS s,
        CASE WHEN n_regionkey > 0 THEN 'v' || n_regionkey END AS v FROM nation)""",
)
