import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quillgrid import queries as q
from quillgrid.operators import kcenter
from quillgrid.plans.lineage import cut, shared_dir
from quillgrid.sources.documents import read_documents
from quillgrid.sources.placement import spread, widen
from quillgrid.sources.points import parse_points, points, read_points


def _texts(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "id long, text string")


def test_points_from_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2\n-0.5,1e3,ignored,too\n 3 , 4 \n")
    got = [tuple(r) for r in read_points(spark, str(tmp_path / "p.csv")).orderBy("id").collect()]
    assert got == [(0, 1.0, 2.0), (1, -0.5, 1000.0), (2, 3.0, 4.0)]
    assert read_points(spark, str(tmp_path), partitions=5).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("size", [None, "2kb", "300b"])
def test_ids_of_lines_do_not_depend_on_splits(spark, tmp_path, size):
    """The same ids for one, some and many splits, and a traversal that starts at the first line."""
    for name, low in (("b", 600), ("a", 0), ("c", 900)):
        high = {"a": 600, "b": 900, "c": 901}[name]
        (tmp_path / f"{name}.csv").write_text("".join(f"{k},{k % 7}\n" for k in range(low, high)))
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        p = read_points(spark, str(tmp_path))
        got = sorted((r.id, r.x) for r in p.collect())
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        first = kcenter.farthest_first(p, 2)[0]
        docs = sorted(tuple(r) for r in read_documents(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(k, float(k)) for k in range(901)] and first == (0, 0.0, 0.0)
    assert docs == [(k, f"{k},{k % 7}") for k in range(901)]
    assert parts > (15 if size == "300b" else 2 if size else 0)


@pytest.mark.parametrize("bad", ["1", "", "1,", "x,2", "1,nan", "inf,0", "1,-Infinity"])
def test_malformed_points(spark, bad):
    df = _texts(spark, ["1,2", bad])
    assert [r.id for r in parse_points(df, mode="drop").collect()] == [0]
    with pytest.raises(Exception, match="missing or non-finite"):
        parse_points(df).collect()


def test_points_from_columns(spark):
    df = spark.createDataFrame([(7, 1.5, None), (8, 2.5, 3.5)], "k long, a double, b double")
    assert points(df, "a", "b", "k", mode="drop").collect() == [(8, 2.5, 3.5)]
    assert points(df.filter("k = 8"), F.col("a") * 2, "b").columns == ["x", "y"]
    with pytest.raises(ValueError):
        points(df, "a", "b", mode="ignore")


def test_spread_and_widen(spark):
    df = spark.range(100)
    assert spread(df, 3).rdd.getNumPartitions() == 3
    assert spread(df.repartition(1), 6, "id").select(F.spark_partition_id()).distinct().count() > 1
    wide = 2 * spark.sparkContext.defaultParallelism
    assert widen(df.coalesce(1), "id").rdd.getNumPartitions() == wide
    already = df.repartition(wide + 1)
    assert widen(already, "id") is already
    with pytest.raises(ValueError):
        spread(df, 0)


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert named in spark.sparkContext.getCheckpointDir()
    plan = cut(spark.range(5).filter("id > 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan and "Range" not in plan


@pytest.mark.parametrize("name, schema", [
    ("count_points", "struct<>"),
    ("approx_outliers_lines", "struct<l_quantity:double,l_extendedprice:double>"),
    ("word_count", "struct<doc_id:bigint,text:string>"),
    ("item_histogram", "struct<event_id:bigint,user_id:bigint>"),
    ("load_points", "struct<vec_id:bigint,embedding:array<float>>")])
def test_scans_read_only_the_columns_used(spark, name, schema):
    plan = q.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: {schema}" in plan
