import os

import pytest
from pyspark.sql import types as T

from evkit import sources
from evkit.plans.catalog.registry import Tables
from evkit.session import clean_scratch, scratch_path, scratch_root, write_once
from evkit.sources import order_breaks, replace_partitions, write_sorted
from evkit.sources import schemas as S
from tests.conftest import rows_of, table

SCHEMA = T.StructType([
    T.StructField("NAME", T.StringType()),
    T.StructField("2P%", T.DoubleType()),
    T.StructField("MADE", T.BooleanType()),
])


@pytest.fixture
def crlf(tmp_path):
    """Windows line ends, no newline at the end, one more column, another column order."""
    path = tmp_path / "t.csv"
    path.write_bytes(b"MADE,EXTRA,NAME,2P%\r\nTRUE,1,\"Ann, A\",0.5\r\nfalse,2,Bea,")
    return str(path)


def test_csv_by_name(spark, crlf):
    df = sources.read_table(spark, crlf, SCHEMA, "csv", {"2P%": "fg2_pct", "NAME": "name"})
    assert df.columns == ["name", "fg2_pct", "MADE"]
    assert rows_of(df) == [("Ann, A", 0.5, True), ("Bea", None, False)]


def test_csv_reads_only_the_wanted_columns(spark, crlf):
    df = sources.read_table(spark, crlf, SCHEMA, "csv").select("NAME")
    assert "ReadSchema: struct<NAME:string>" in plan(df)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_malformed_value_stops_the_job(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("NAME,2P%,MADE\nx,abc,true\n")
    df = sources.read_table(spark, str(path), SCHEMA, "csv")
    with pytest.raises(Exception, match="(?i)malformed"):
        df.collect()


def test_missing_and_optional_columns(spark, crlf):
    extra = T.StructType([T.StructField("EXTRA", T.IntegerType()), T.StructField("NONE", T.LongType())])
    df = sources.read_table(spark, crlf, SCHEMA, "csv", optional=extra)
    assert df.columns == ["NAME", "2P%", "MADE", "EXTRA"]
    wider = T.StructType([*SCHEMA, T.StructField("GONE", T.LongType())])
    with pytest.raises(ValueError, match="GONE"):
        sources.read_table(spark, crlf, wider, "csv")
    with pytest.raises(ValueError):
        sources.read_table(spark, crlf, SCHEMA, "xml")


def test_inference_is_an_option(spark, crlf):
    df = sources.read_table(spark, crlf, SCHEMA, "csv", infer=True)
    assert dict(df.dtypes) == {"NAME": "string", "2P%": "double", "MADE": "boolean"}


def test_scored_round_trip_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "scored")
    df = table(spark, "team string, conf string, xp double",
               [("A", "East", 1.0), ("B", "West", 2.0), ("C", None, 3.0)])
    sources.write_scored(df, path, ["conf"])
    back = sources.read_scored(spark, path)
    assert rows_of(back, *df.columns) == rows_of(df)
    east = back.filter("conf = 'East'")
    assert "PartitionFilters: [isnotnull(conf" in plan(east)
    assert rows_of(east, "team") == [("A",)]
    with pytest.raises(Exception):
        sources.write_scored(df, path)


def test_row_counts(spark):
    df = table(spark, "x int", [(1,), (5,), (None,)])
    assert tuple(sources.row_counts(df, big=df.x > 2).first()) == (3, 1)


def test_present_ignores_case(spark):
    df = table(spark, "Zone string, q int", [])
    assert sources.present(df, ["q", "ZONE", "none"]) == ["q", "ZONE"]


def test_schemas_have_unique_names():
    for fields in (S.SHOTS, S.PLAYERS + S.PLAYERS_OPTIONAL, S.TEAMS, S.SCORED + S.SCORED_OPTIONAL):
        assert len({f[0].lower() for f in fields}) == len({f[1] for f in fields}) == len(fields)


def test_scratch_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two
    assert one.startswith(f"{shared}/evkit/{spark.sparkContext.applicationId}/x-")


def test_scratch_falls_back_to_shared_folders_only():
    class Fake:
        def __init__(self, conf, checkpoints, master="yarn"):
            self.conf = type("Conf", (), {"get": lambda _, key, default=None: conf.get(key, default)})()
            self.sparkContext = type(
                "Context", (), {"applicationId": "app", "getCheckpointDir": lambda _: checkpoints, "master": master}
            )()

    warehouse = {"spark.sql.warehouse.dir": "s3://house"}
    assert scratch_root(Fake(warehouse, "hdfs://own")) == "hdfs://own/evkit/app"
    assert scratch_root(Fake(warehouse, None)) == "s3://house/_scratch/evkit/app"
    own_disk = {"spark.sql.warehouse.dir": "file:/home/me/house"}
    assert scratch_root(Fake(own_disk, None, "local[4]")) == "file:/home/me/house/_scratch/evkit/app"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Fake(own_disk, None))


def test_opening_tables_keeps_the_settings(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        Tables(spark, "/root/testdata/sf0.001")("region")
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_clean_scratch_removes_what_was_written(spark):
    back = write_once(spark.range(3).toDF("id"), "gone")
    path = back.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    assert clean_scratch(spark) and not os.path.exists(path)


def test_write_once_keeps_rows_and_cuts_the_plan(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k").groupBy("k").count()
    back = write_once(df, "t")
    assert rows_of(back) == rows_of(df)
    assert "Exchange" not in plan(back)


SCORED = "season int, conf string, xp double"


def test_replacing_partitions_is_repeatable(spark, tmp_path):
    path = f"{tmp_path}/scored"
    first = [(1, "E", 1.0), (1, "W", 2.0), (2, "E", 3.0), (2, None, 4.0)]
    replace_partitions(table(spark, SCORED, first), path, ["season", "conf"])
    late = [(1, "E", 1.0), (1, "E", 1.5)]
    for _ in range(2):
        replace_partitions(table(spark, SCORED, late), path, ["season", "conf"])
        assert rows_of(spark.read.parquet(path), "season", "conf", "xp") == rows_of(
            table(spark, SCORED, [*late, *first[1:]]))
    with pytest.raises(ValueError):
        replace_partitions(table(spark, SCORED, late), path, [])


def test_sorted_files_hold_one_order(spark, tmp_path):
    rows = [(i % 7 if i % 11 else None, f"{i % 13}" if i % 5 else None, float(i * 37 % 101)) for i in range(500)]
    df = table(spark, SCORED.replace("season int, conf string", "a int, b string"), rows).repartition(9)
    for k, order in enumerate((["a", "-b", "xp"], ["-xp", "b"], ["-a", "-b", "-xp"])):
        path = f"{tmp_path}/sorted{k}"
        write_sorted(df, path, order, files=6)
        assert spark.read.parquet(path).count() == 500 and order_breaks(spark, path, order).count() == 0
        assert order_breaks(spark, path, ["xp", "a"]).count() > 0
    # Sorted inside each file, not across files.
    path = f"{tmp_path}/loose"
    df.repartition(4).sortWithinPartitions("xp").write.parquet(path)
    found = order_breaks(spark, path, ["xp"]).collect()
    assert found and all(r["row"] == 0 for r in found)
