"""Record files on disk."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from recordloom.layout import copybook
from recordloom.operators.batch import copy_dataset, define_cluster, delete_dataset
from recordloom.sources import records as r
from recordloom.streaming.ingest import stream_fixed, stream_lines

LAY = copybook("01 R. 05 K PIC 9(6). 05 V PIC S9(5)V99 COMP-3. 05 T PIC X(5).")
TEXT = copybook("01 R. 05 K PIC 9(6). 05 T PIC X(5).")


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), (F.col("id") - 50).cast("decimal(7,2)").alias("v"), F.concat(F.lit("t"), F.col("id") % 7).alias("t"))


def test_fixed_file_in_many_ranges(spark, tmp_path):
    path = str(tmp_path / "f")
    r.write_fixed(rows(spark, 1000).repartition(3), LAY, path)
    r.register(spark)
    raw = spark.read.format("fixed_records").options(recordLength=LAY.length, splitBytes=LAY.length * 37, positions="true").load(path)
    assert raw.rdd.getNumPartitions() > 20
    assert raw.select("file", "offset").distinct().count() == 1000
    got = LAY.decode(raw).agg(F.count("*"), F.sum("k"), F.sum("v"), F.count_distinct("k")).first()
    assert tuple(got) == (1000, 499500, D(449500), 1000)
    r.write_fixed(rows(spark, 10, 1000), LAY, path, "EXTEND")
    assert r.read_fixed(spark, path, LAY).count() == 1010
    r.write_fixed(rows(spark, 5), LAY, path, "OUTPUT")
    assert r.read_fixed(spark, path, LAY).count() == 5
    assert not [p for p in (tmp_path / "f").iterdir() if p.name.startswith("_")] or not list((tmp_path / "f" / "_temporary").iterdir())


def test_short_tail_is_end_of_file(spark, tmp_path):
    f = tmp_path / "x.bin"
    f.write_bytes(b"AB12" + b"CD34" + b"EF")
    lay = copybook("01 R. 05 A PIC X(2). 05 N PIC 99.")
    assert [tuple(x) for x in r.read_fixed(spark, str(f), lay).collect()] == [("AB", 12), ("CD", 34)]
    (tmp_path / "empty.bin").write_bytes(b"")
    assert r.read_fixed(spark, str(tmp_path / "empty.bin"), lay).count() == 0


def test_line_numbers_across_splits(spark, tmp_path):
    f = tmp_path / "lines.txt"
    f.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001)))
    (tmp_path / "other.txt").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        n = r.numbered_lines(spark, str(tmp_path))
        assert n.rdd.getNumPartitions() >= 1
        got = n.where("file like '%lines.txt'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3000 and all(x.value.startswith(f"line {x.line} ") for x in got)


def test_organizations(spark, tmp_path):
    path = str(tmp_path / "k")
    src = spark.createDataFrame([(3, "c"), (1, "a"), (3, "late")], "k int, t string").coalesce(1)
    spec = r.FileSpec(path, TEXT, r.INDEXED, "k")
    r.write_lines(src, TEXT, path)
    assert sorted(tuple(x) for x in r.open_input(spark, spec).collect()) == [(1, "a"), (3, "c")]
    rel = r.FileSpec(path, TEXT, r.RELATIVE, numbers_stored=False)
    assert sorted(tuple(x) for x in r.open_input(spark, rel).collect()) == [(1, 3, "c"), (2, 1, "a"), (3, 3, "late")]
    r.close_output(r.open_input(spark, spec), r.FileSpec(str(tmp_path / "out"), TEXT, r.INDEXED, "k"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()] == ["000001a", "000003c"]
    line = r.FileSpec(str(tmp_path / "out"), TEXT)
    r.close_output(src, line, "EXTEND")
    assert r.open_input(spark, line).count() == 5
    assert (r.status_of_open(spark, path), r.status_of_open(spark, path + "-no")) == ("00", "35")


def test_delimited_arity(spark):
    ok = spark.createDataFrame([("a|b|",)], "value string")
    assert tuple(r.read_delimited(ok, ["x", "y", "z"]).first()) == ("a", "b", "")
    with pytest.raises(Exception, match="expected 2 fields"):
        r.read_delimited(ok, ["x", "y"]).collect()


def test_stream_of_line_files(spark, tmp_path):
    src = tmp_path / "in"
    r.write_lines(rows(spark, 20), TEXT, str(src))
    q = (stream_lines(spark, str(src), TEXT).writeStream.format("memory").queryName("seen_lines")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
        r.write_lines(rows(spark, 5, 100), TEXT, str(src), "EXTEND")
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("SELECT count(*), max(k) FROM seen_lines").first() == (25, 104)


def test_utilities(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny \n")
    copy_dataset(spark, str(tmp_path / "a.txt"), str(tmp_path / "b"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "b")).collect()] == ["x", "", "y "]
    spark.sql(f"CREATE DATABASE prod LOCATION '{tmp_path / 'wh'}'")
    define_cluster(spark, "prod.cluster_t", TEXT)
    assert spark.table("prod.cluster_t").count() == 0
    delete_dataset(spark, "prod.cluster_t")
    assert not spark.catalog.tableExists("prod.cluster_t")
    spark.sql("DROP DATABASE prod")


def test_relative_numbers(spark, tmp_path):
    """Numbers of up to 19 digits come back; what is no number is refused."""
    spec = r.FileSpec(str(tmp_path / "slots"), copybook("01 REC.  05 STATE PIC X."), r.RELATIVE)
    rows = [(12345678901, "A"), (12345678902, "B"), (1, "C"), (2**63 - 1, "D")]
    r.close_output(spark.createDataFrame(rows, "rrn bigint, state string"), spec)
    assert sorted(tuple(x) for x in r.open_input(spark, spec).select("rrn", "state").collect()) == sorted(rows)
    for wrong in (0, -3, None):
        with pytest.raises(Exception, match="no record number"):
            r.close_output(spark.createDataFrame([(wrong, "A")], "rrn bigint, state string"), spec)


def test_stream_of_fixed_records(spark, tmp_path):
    """New files, a file that grows, an unfinished record, a restart: each record comes once."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    r.write_fixed(rows(spark, 20).repartition(2), LAY, src)

    def run():
        q = (stream_fixed(spark, src, LAY, ("file", "offset")).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)
        return sorted(int(x["k"]) for x in spark.read.parquet(out).select("k").collect())

    assert run() == list(range(20))
    r.write_fixed(rows(spark, 5, 100), LAY, src, "EXTEND")
    one = next(p for p in (tmp_path / "in").iterdir() if p.name.endswith(".bin"))
    record = one.read_bytes()[: LAY.length]
    with one.open("ab") as f:
        f.write(record + record[:3])
    again = run()
    assert len(again) == 26 and set(again) == {*range(20), *range(100, 105)}
    with one.open("ab") as f:
        f.write(record[3:])
    assert len(run()) == 27 and len(run()) == 27
    assert spark.read.parquet(out).select("file", "offset").distinct().count() == 27
