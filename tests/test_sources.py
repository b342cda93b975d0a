"""Readers on hand-written files."""

import os

import pytest
from pyspark.sql import functions as F

from rankfield.functions import text
from rankfield.operators import idmap
from rankfield.sources import collections as coll
from rankfield.sources import label_files, lines, matrices, result_files, writers


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_gct(spark, tmp_path):
    path = put(
        tmp_path, "a.gct",
        '#1.2\n2\t3\nNAME\tDescription\ts1\ts2\ts3\n"f1"\tone\t1.5\tna\t"2"\nf2\t\t\t-3\t4e2\n',
    )
    rows = matrices.read_gct(spark, path).orderBy("row_idx", "sample_idx").collect()
    assert [(r["feature"], r["sample"], r["value"]) for r in rows] == [
        ("f1", "s1", 1.5), ("f1", "s2", None), ("f1", "s3", 2.0),
        ("f2", "s1", None), ("f2", "s2", -3.0), ("f2", "s3", 400.0),
    ]
    assert rows[0]["dataset"] == "a" and rows[3]["description"] == "na"


@pytest.mark.parametrize("counts", ["3\t2", "2\t3"])
def test_gct_counts_are_checked(spark, tmp_path, counts):
    path = put(tmp_path, "bad.gct", f"#1.2\n{counts}\nNAME\tDescription\ts1\ts2\nf1\tx\t1\t2\nf2\tx\t1\t2\n")
    with pytest.raises(Exception, match="count differs"):
        matrices.read_gct(spark, path).collect()


def test_bad_cells_fail(spark, tmp_path):
    path = put(tmp_path, "a.txt", "NAME\ts1\ts2\nf1\t1\tabc\n")
    with pytest.raises(Exception, match="not a number"):
        matrices.read_txt_matrix(spark, path).collect()
    path = put(tmp_path, "b.txt", 'NAME\ts1\n""\t1\n')
    with pytest.raises(Exception, match="empty feature name"):
        matrices.read_txt_matrix(spark, path).collect()


def test_txt_with_and_without_description(spark, tmp_path):
    put(tmp_path, "a.txt", "NAME\tDESC\ts1\ts2\nf1\thello\t1\t2\n")
    put(tmp_path, "b.txt", "# note\nNAME\ts1\ts2\n\nf1\t1\n")
    rows = matrices.read_txt_matrix(spark, str(tmp_path)).orderBy("dataset", "sample_idx").collect()
    assert [(r["dataset"], r["description"], r["sample"], r["value"]) for r in rows] == [
        ("a", "hello", "s1", 1.0), ("a", "hello", "s2", 2.0),
        ("b", "na", "s1", 1.0), ("b", "na", "s2", None),
    ]


def test_res_and_pcl(spark, tmp_path):
    path = put(tmp_path, "a.res", "Description\tAccession\ts1\t\ts2\t\n\n1\nd1\tf1\t5\tP\t6\tA\n")
    rows = matrices.read_res(spark, path).orderBy("sample_idx").collect()
    assert [(r["feature"], r["sample"], r["value"], r["call"]) for r in rows] == [
        ("f1", "s1", 5.0, "P"), ("f1", "s2", 6.0, "A"),
    ]
    good = put(tmp_path, "a.pcl", "UNIQID\tNAME\tGWEIGHT\ts1\nEWEIGHT\t\t\t1\nf1\td\t1\t7\n")
    assert matrices.read_pcl(spark, good).head()["value"] == 7.0
    bad = put(tmp_path, "b.pcl", "UNIQID\tNAME\tGWEIGHT\ts1\nEWEIGHT\t\t\t1\nf1\td\t2\t7\n")
    with pytest.raises(Exception, match="GWEIGHT"):
        matrices.read_pcl(spark, bad).collect()


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "40"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_many_splits(spark, tmp_path, small_splits):
    wanted = {}
    for f in range(4):
        text_lines = [f"{f}:{i} " + "x" * (i * 7 % 40) for i in range(60 * f)]
        shown = [t for i, t in enumerate(text_lines) for t in ([t, "", "#c"] if i % 5 == 0 else [t])]
        put(tmp_path, f"{f}.t", "".join(t + "\r\n" for t in shown))
        wanted.update({(f"{f}.t", i): t for i, t in enumerate(text_lines)})
    got = lines.read_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 20
    rows = got.collect()
    assert {(os.path.basename(r["file"]), r["line_no"]): r["line"] for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_lines_are_not_sorted(spark, tmp_path):
    put(tmp_path, "a.t", "one\ntwo\n")
    got = lines.read_lines(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("ext", ["gct", "txt", "pcl", "res"])
def test_rows_go_on_over_files_and_splits(spark, tmp_path, small_splits, ext):
    """One data set of two files of many splits, and a data set of its own."""
    read = {
        "gct": matrices.read_gct, "txt": matrices.read_txt_matrix,
        "pcl": matrices.read_pcl, "res": matrices.read_res,
    }[ext]
    n = {"x.%s/part-0" % ext: 40, "x.%s/part-1" % ext: 25, "y.%s" % ext: 30}
    (tmp_path / f"x.{ext}").mkdir()
    wanted, first = {}, {"x": 0, "y": 0}
    for file, rows in n.items():
        name = file[0]
        head = {
            "gct": f"#1.2\n{rows}\t2\nNAME\tDescription\ts1\ts2\n",
            "txt": "NAME\tDESCRIPTION\ts1\ts2\n",
            "pcl": "UNIQID\tNAME\tGWEIGHT\ts1\ts2\nEWEIGHT\t\t\t1\t1\n",
            "res": f"Description\tAccession\ts1\t\ts2\n{'' if rows > 30 else 'note'}\n{rows}\n",
        }[ext]
        line = {
            "gct": "{0}\td\t{1}\t2\n", "txt": "{0}\td\t{1}\t2\n",
            "pcl": "{0}\td\t1\t{1}\t2\n", "res": "d\t{0}\t{1}\tP\t2\tA\n",
        }[ext]
        body = ""
        for i in range(rows):
            body += line.format(f"f{i}{file[-1]}", i) + ("\n" if i % 9 == 4 else "")
            wanted[name, first[name] + i] = (f"f{i}{file[-1]}", float(i))
        first[name] += rows
        put(tmp_path, file, head + body)
    rows = read(spark, str(tmp_path)).filter("sample = 's1'").collect()
    assert {(r["dataset"], r["row_idx"]): (r["feature"], r["value"]) for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_promised_rows_must_be_there(spark, tmp_path):
    path = put(tmp_path, "none.gct", "#1.2\n2\t1\nNAME\tDescription\ts1\n")
    with pytest.raises(Exception, match="count differs"):
        matrices.read_gct(spark, path).collect()
    path = put(tmp_path, "zero.gct", "#1.2\n0\t1\nNAME\tDescription\ts1\n")
    assert matrices.read_gct(spark, path).collect() == []
    assert matrices.read_txt_matrix(spark, put(tmp_path, "empty.txt", "")).collect() == []


def test_large_heads_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrices, "HEAD_BYTES", 0)
    path = put(tmp_path, "a.txt", "NAME\ts1\ts2\nf1\t1\t2\n")
    rows = matrices.read_txt_matrix(spark, path).orderBy("sample_idx").collect()
    assert [(r["row_idx"], r["sample"], r["value"]) for r in rows] == [(0, "s1", 1.0), (0, "s2", 2.0)]


def test_missing_cells_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "f1", 0, "s1", 1.0), (0, "f1", 2, "s3", 3.0), (5, "f2", 1, "s2", 2.0)],
        "row_idx long, feature string, sample_idx long, sample string, value double",
    )
    for write, read, ext in (
        (writers.write_gct, matrices.read_gct, "gct"),
        (writers.write_res, matrices.read_res, "res"),
        (writers.write_pcl, matrices.read_pcl, "pcl"),
        (writers.write_txt_matrix, matrices.read_txt_matrix, "txt"),
    ):
        path = str(tmp_path / f"m.{ext}")
        write(df, path)
        rows = read(spark, path).orderBy("row_idx", "sample_idx").collect()
        assert [r["value"] for r in rows] == [1.0, None, 3.0, None, 2.0, None], ext
        assert [r["row_idx"] for r in rows] == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("ext", ["gct", "txt", "pcl", "res"])
def test_sparse_matrix_is_small_and_whole(spark, tmp_path, monkeypatch, ext):
    """Four files, most of whose cells are missing: every cell is there, few bytes are."""
    monkeypatch.setattr(writers, "SPARSE_ROWS", 100, raising=False)
    monkeypatch.setattr(writers, "SPARSE_CELLS", 1, raising=False)
    write, read = {
        "gct": (writers.write_gct, matrices.read_gct), "txt": (writers.write_txt_matrix, matrices.read_txt_matrix),
        "pcl": (writers.write_pcl, matrices.read_pcl), "res": (writers.write_res, matrices.read_res),
    }[ext]
    n, width = 400, 1000
    at = (F.col("id") * 7 + F.col("k") * 333) % width
    df = spark.range(n).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("f"), "id").alias("feature"),
        at.alias("sample_idx"), F.concat(F.lit("s"), at).alias("sample"), (at / 4).alias("value"),
    )
    path = str(tmp_path / f"m.{ext}")
    write(df, path)
    files = [os.path.join(top, f) for top, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) == 4
    assert sum(map(os.path.getsize, files)) < n * width / 8
    cells = read(spark, path)
    assert [f.name for f in cells.schema][:7] == matrices.CELLS
    count = cells.groupBy("row_idx", "feature").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("sample").alias("d"))
    assert count.filter((F.col("c") == width) & (F.col("d") == width)).count() == n
    got = {(r["row_idx"], r["feature"], r["sample_idx"], r["sample"], r["value"]) for r in cells.dropna(subset=["value"]).collect()}
    used = sorted({r["sample_idx"] for r in df.collect()})
    assert len(used) == width
    assert got == {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_files_that_share_their_names(spark, tmp_path, monkeypatch, most):
    """Equal sample names are kept once; every file still has its own."""
    monkeypatch.setattr(matrices, "HEAD_BYTES", most)
    for file, names in {"a": "s1\ts2", "b": "s1\ts2", "c": "s2\ts1", "d": "s1"}.items():
        put(tmp_path, f"{file}.txt", f"NAME\t{names}\n{file}1\t1" + "\t2" * (file != "d") + "\n")
    rows = matrices.read_txt_matrix(spark, str(tmp_path)).orderBy("dataset", "sample_idx").collect()
    assert [(r["dataset"], r["feature"], r["sample"], r["value"]) for r in rows] == [
        ("a", "a1", "s1", 1.0), ("a", "a1", "s2", 2.0), ("b", "b1", "s1", 1.0), ("b", "b1", "s2", 2.0),
        ("c", "c1", "s2", 1.0), ("c", "c1", "s1", 2.0), ("d", "d1", "s1", 1.0),
    ]


def test_gmt(spark, tmp_path):
    path = put(tmp_path, "c.gmt", "set a\tdesc\tm1\tm2\tm1\tNULL\t\tm3\n#x\nB\td\tm9\n")
    rows = coll.read_gmt(spark, path).orderBy("set_name", "member_pos").collect()
    assert [(r["collection"], r["set_name"], r["member"]) for r in rows] == [
        ("c", "B", "m9"), ("c", "SET A", "m1"), ("c", "SET A", "m2"), ("c", "SET A", "m3"),
    ]
    bad = put(tmp_path, "bad.gmt", "only\n")
    with pytest.raises(Exception, match="two fields"):
        coll.read_gmt(spark, bad).collect()


def test_gmx_and_grp(spark, tmp_path):
    path = put(tmp_path, "c.gmx", "a\tb\nda\tna\nm1\tm2\n\tm3\nm4\tnull\n")
    rows = coll.read_gmx(spark, path).orderBy("set_name", "member_pos").collect()
    assert [(r["set_name"], r["description"], r["member"]) for r in rows] == [
        ("A", "da", "m1"), ("A", "da", "m4"), ("B", "na", "m2"), ("B", "na", "m3"),
    ]
    path = put(tmp_path, "mine.grp", "# c\nm1\nm2\n\nm1\n")
    rows = coll.read_grp(spark, path).orderBy("member_pos").collect()
    assert [(r["set_name"], r["member"]) for r in rows] == [("mine", "m1"), ("mine", "m2")]


def test_rnk(spark, tmp_path):
    path = put(tmp_path, "l.rnk", "Name\tScore\nf1\t1\nf2\tna\n\"f3\"\t5\nf4\t1\n")
    rows = coll.read_rnk(spark, path).orderBy("rank").collect()
    assert [(r["feature"], r["score"], r["rank"]) for r in rows] == [("f3", 5.0, 0), ("f1", 1.0, 1), ("f4", 1.0, 2)]
    assert coll.rnk_missing(spark, path).head()["n_missing"] == 1


def test_chip(spark, tmp_path):
    path = put(
        tmp_path, "c.chip",
        "Gene Title\tProbe Set ID\tGene Symbol\nt1\tp1\tA\nt2\tp1\tB\nt3\tp2\t---\n\t\tC\nt4\tp3\n",
    )
    rows = coll.read_chip(spark, path).orderBy("probe").collect()
    assert [(r["probe"], r["symbol"], r["title"]) for r in rows] == [("p1", "A", "t1"), ("p2", "", "t3"), ("p3", "", "t4")]
    bad = put(tmp_path, "bad.chip", "x\ty\n1\t2\n")
    with pytest.raises(Exception, match="column missing"):
        coll.read_chip(spark, bad).collect()


def test_cls(spark, tmp_path):
    path = put(tmp_path, "a.cls", "4 2 1\n# first second\nx y x y\n")
    rows = label_files.read_cls_categorical(spark, path).orderBy("position").collect()
    assert [(r["class_name"], r["class_idx"]) for r in rows] == [("first", 0), ("second", 1)] * 2
    bad = put(tmp_path, "b.cls", "5 2 1\n# a b\n0 1 0 1\n")
    with pytest.raises(Exception, match="count differs"):
        label_files.read_cls_categorical(spark, bad).collect()
    path = put(tmp_path, "n.cls", "#numeric\n#prof one\n1 2.5 -3\n#two\n4 5 6\n")
    rows = label_files.read_cls_numeric(spark, path).orderBy("phenotype", "position").collect()
    assert [r["num_value"] for r in rows] == [1, 2.5, -3, 4, 5, 6]
    assert {r["phenotype"] for r in rows} == {"prof one", "two"}
    lost = put(tmp_path, "l.cls", "#numeric\n#one\n#two\n4 5 6\n")
    with pytest.raises(Exception, match="profile line missing"):
        label_files.read_cls_numeric(spark, lost).collect()


def test_one_cls_file_per_labelling(spark, tmp_path):
    rows = [("a", f"s{k}", k, "xyx"[k % 3], k % 2, None) for k in range(5)]
    rows += [("b", f"s{k}", k, "qr"[k % 2], k % 2, None) for k in range(4)]
    rows += [("n", f"s{k}", k, None, None, k / 4) for k in range(3)]
    labels = spark.createDataFrame(
        rows, "phenotype string, sample string, position long, class_name string, class_idx int, num_value double"
    ).coalesce(1)
    path = str(tmp_path / "many.cls")
    writers.write_cls(labels, path)
    texts = sorted(f.read_text().strip() for f in (tmp_path / "many.cls").glob("part-*"))
    assert texts == [
        "#numeric\n\n#n\n0.0 0.25 0.5",
        "4 2 1\n# q r\nq r q r",
        "5 2 1\n# x y\nx y x x y",
    ]


def test_cls_by_sample(spark, tmp_path):
    path = put(tmp_path, "a.cls", "name\tKIND\tFLOAT\tCOMMENTS\ns1\tb\t1.5\thi\ns2\tna\t2\tho\ns3\ta\tna\t-\n")
    rows = label_files.read_cls_by_sample(spark, path).collect()
    assert sorted((r["phenotype"], r["sample"], r["class_name"], r["class_idx"], r["num_value"]) for r in rows) == [
        ("FLOAT", "s1", None, None, 1.5), ("FLOAT", "s2", None, None, 2.0),
        ("KIND", "s1", "b", 0, None), ("KIND", "s3", "a", 1, None),
    ]
    bad = put(tmp_path, "b.cls", "name\tKIND\ns1\tb\ns1\ta\n")
    with pytest.raises(Exception, match="named twice"):
        label_files.read_cls_by_sample(spark, bad).collect()


def test_results_document(spark, tmp_path):
    path = put(
        tmp_path, "results.edb",
        '<EDB METRIC="None" NUM_PERMS="3" ORDER="DESCENDING">'
        '<DTG RANKED_LIST="a.rnk" TEMPLATE="na" GENESET="sets.gmt#S1" ES="0.5" NES="1.5" NP="0.1" FDR="0.2"'
        ' FWER="0.3" RANK_AT_ES="4.0" RANK_SCORE_AT_ES="2.5" RND_ES="0.1 -0.2 0.3" HIT_INDICES="1 4"'
        ' ES_PROFILE="0.2 0.5"/></EDB>',
    )
    row = result_files.read_results_db(spark, path).head()
    assert (row["set_name"], row["es"], row["rank_at_max"], row["hit_ranks"]) == ("S1", 0.5, 4, [1, 4])
    assert result_files.read_results_run(spark, path).head()["num_perms"] == "3"
    df = result_files.read_results_db(spark, path)
    assert [r["es"] for r in result_files.results_to_null(df).orderBy("perm").collect()] == [0.1, -0.2, 0.3]
    assert result_files.results_to_hits(df).count() == 2


def test_run_report(spark, tmp_path):
    path = put(tmp_path, "r.rpt", "producer_class\tx.Y\nproducer_timestamp\t12\nparam\tk\tv\nfile\t/a\nfile\t/b\n")
    row = result_files.read_run_reports(spark, path).head()
    assert (row["producer"], row["timestamp"], row["params"], row["files"]) == ("x.Y", 12, {"k": "v"}, ["/a", "/b"])
    bad = put(tmp_path, "bad.rpt", "producer_class\n")
    with pytest.raises(Exception, match="bad report line"):
        result_files.read_run_reports(spark, bad).collect()


def test_versions(spark):
    paths = [
        "https://sets.example/x/h.all.v2024.1.Hs.symbols.gmt",
        "https://sets.example/x/mh.all.v2023.2.Mm.symbols.gmt",
        "/home/me/h.all.v2024.1.Hs.symbols.gmt",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(
        F.lit("s").alias("source"), F.lit("sets").alias("kind"),
        text.collection_version("p", ".symbols.gmt", ["sets.example"]).alias("v"),
    ).select("source", "kind", "v.*")
    got = [(r["version"], r["species"]) for r in df.collect()]
    assert got == [("v2024.1.Hs", "human"), ("v2023.2.Mm", "mouse"), (None, None)]
    check = idmap.check_species_version(df).head()
    assert not check["species_ok"] and not check["version_ok"]


def test_number_text(spark):
    cases = {" 1.5 ": 1.5, "": None, "NA": None, '"7"': 7.0, "1e-3": 0.001, '"na"': None, "NaN": None}
    df = spark.createDataFrame(list(cases), "string").toDF("t")
    for r in df.select("t", text.parse_number("t").alias("v"), text.number_error("t").alias("e")).collect():
        assert r["v"] == cases[r["t"]] and not r["e"]
    bad = spark.createDataFrame([("x",)], "t string").select(text.number_error("t"))
    assert bad.head()[0]


def test_large_matrix_has_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ROWS_PER_FILE", 10)
    df = spark.range(35).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("f"), "id").alias("feature"),
        F.lit(0).cast("long").alias("sample_idx"), F.lit("s").alias("sample"), F.col("id").cast("double").alias("value"),
    )
    path = str(tmp_path / "big.gct")
    writers.write_gct(df, path)
    parts = [p for p in os.listdir(path) if p.startswith("part=")]
    assert len(parts) == 4
    rows = matrices.read_gct(spark, path).orderBy("row_idx").collect()
    assert [r["value"] for r in rows] == [float(k) for k in range(35)]
    assert {r["dataset"] for r in rows} == {"big"}


def test_kept_lines_are_short_and_whole(spark, tmp_path):
    """Runs of tabs take few bytes where lines are kept; lines that hold the marks are kept as they are."""
    texts = ["a" + "\t" * n + "b" for n in (0, 1, 7, 8, 9, 31, 32, 33, 511, 512, 513, 40_000)]
    texts += ["x\x01" + "\t" * 40, "\x02\x03" + "\t" * 9 + "\x01" * 16, " \ty", "\t" * 100 + "ü", "\x03", "\x01" * 16 + "\t" * 512]
    path = put(tmp_path, "a.txt", "\n".join(texts) + "\n")
    split = lines.split_lines(spark, path)
    assert split.agg(F.max(F.when(F.contains("_short", F.lit("a")), F.octet_length("_short")))).head()[0] < 200
    got = lines.number_lines(split).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == list(enumerate(texts))
