"""Readers and writers on small untidy files."""

import pytest
from pyspark.sql import functions as F

from isotrend.operators.reshape import strict_mean
from isotrend.functions.calendar import split_year_month
from isotrend.sources.readers import (YEAR_MONTH, drop_row_number, header_names, read_keyed_files, read_table,
                                      repair_names, split_header)
from isotrend.sources.writers import write_table

AGGI = """River gauges of two valleys,,,,upper,lower,
,,,,(m),,%
Year,Flow,Silt*,Depth,Depth,2001 = 1,rise **
2001,7.5,0.25,3.5,41,1.0,0.0
2002,8.25,0.5,4.25,43,1.25,4.5
,,,,,,
"* measured by hand, see notes",,,,,,
** against the year before (in %),,,,,,
"""
MONTHLY = """#  Average Temperature
# Missing: -99
Date,Value
197001,29.0
197002,31.0
197101,-99
197102,40.0
"""


def test_repair_names():
    assert repair_names(["Year", "Total", "Total", "1990 = 1", "change **", "CFC*", "", "_x"]) == [
        "Year", "Total", "Total.1", "X1990...1", "change...", "CFC.", "X", "X_x"]
    assert repair_names(["a", "a", "a", "a.1"]) == ["a", "a.2", "a.3", "a.1"]
    assert split_header('Year,"Temp, mean", Other') == ["Year", "Temp, mean", "Other"]


def test_preamble_footer_and_duplicate_header(spark, tmp_path):
    path = tmp_path / "aggi.csv"
    path.write_text(AGGI)
    names = header_names(spark, str(path), "Year")
    assert names == ["Year", "Flow", "Silt.", "Depth", "Depth.1", "X2001...1", "rise..."]
    schema = ", ".join(f"`{n}` {'int' if n == 'Year' else 'double'}" for n in names)
    got = read_table(spark, str(path), schema, key="Year", sentinels={"Depth.1": [41.0]}).orderBy("Year").collect()
    assert [r.Year for r in got] == [2001, 2002]
    assert got[1]["Depth.1"] == 43.0 and got[0]["Depth.1"] is None and got[1]["rise..."] == 4.5
    with pytest.raises(ValueError):
        header_names(spark, str(path), "Nothing")


def test_comment_lines_sentinel_and_strict_yearly_mean(spark, tmp_path):
    path = tmp_path / "monthly.csv"
    path.write_text(MONTHLY)
    rows = read_table(spark, str(path), "Date string, Value double", key="Date", key_pattern=YEAR_MONTH, comment="#",
                      sentinels={"Value": [-99.0]})
    year, _ = split_year_month("Date")
    got = rows.groupBy(year.alias("Year")).agg(strict_mean("Value").alias("Temp")).orderBy("Year").collect()
    assert [tuple(r) for r in got] == [(1970, 30.0), (1971, None)]


def test_bad_numbers_and_nan_become_missing(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Year,v\n2000,NA\n2001,NaN\n2002,n/a\n2003, 1.5 \n")
    got = read_table(spark, str(path), "Year int, v double", key="Year").orderBy("Year").collect()
    assert [r.v for r in got] == [None, None, None, 1.5]


def test_file_name_is_the_key(spark, tmp_path):
    (tmp_path / "AK.csv").write_text("DATE,TAVG\n1900,20.0\n1901,\n")
    (tmp_path / "WA.csv").write_text("DATE,TAVG\n1900,50.0\n")
    got = read_keyed_files(spark, str(tmp_path), "DATE int, TAVG double")
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1900, 20.0, "AK"), (1901, None, "AK"), (1900, 50.0, "WA")])


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "AK.csv").write_text("DATE,TAVG,TMAX\n1900,20.0,30.5\n")
    (tmp_path / "WA.csv").write_text('"NAME, full",TMAX,DATE,TAVG\n"Sea, the",60,1900,50\nb,61,1901,NaN\n')
    (tmp_path / "OR.csv").write_text("TMAX,DATE\n70,1900\n")
    got = read_keyed_files(spark, str(tmp_path), "DATE int, TAVG double, TMAX double")
    want = [(1900, None, 70.0, "OR"), (1900, 20.0, 30.5, "AK"), (1900, 50.0, 60.0, "WA"), (1901, None, 61.0, "WA")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    for name, n in (("a", 10), ("b", 6)):
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = read_keyed_files(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], "id long", "source", "parquet")
    assert {r.source: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 10, "b": 6}


def test_few_files_per_partition(spark, tmp_path):
    df = spark.range(0, 6400, 1, 64).select((F.col("id") % 20 + 2000).cast("int").alias("year"), "id")
    path = write_table(df, str(tmp_path / "out"), partition_by=["year"])
    files = list((tmp_path / "out").glob("year=*/*.parquet"))
    assert 20 <= len(files) <= 40 and spark.read.parquet(path).count() == 6400


def test_csv_round_trip_drops_row_number(spark, tmp_path):
    df = spark.createDataFrame([(1, 1970, 1.5), (2, 1971, None)], "row int, Year int, v double")
    path = write_table(df, str(tmp_path / "out"), "csv")
    back = drop_row_number(spark.read.schema(df.schema).csv(path, header=True))
    assert sorted(tuple(r) for r in back.collect()) == [(1970, 1.5), (1971, None)]


def test_partitioned_output_prunes(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2 + 2000).cast("int").alias("year"), F.col("id").alias("v"))
    path = write_table(df, str(tmp_path / "by-year"), partition_by=["year"])
    one = spark.read.parquet(path).filter("year = 2001")
    assert one.count() == 5
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_left_of_a_local_session(tmp_path):
    import os
    import subprocess
    import sys

    code = ("from isotrend import session\nfolder = session._own_folder()\nassert session._own_folder() == folder\n"
            "open(folder + '/part', 'w').close()\nprint('PATH', folder)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "TMPDIR": str(tmp_path), "PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=120).stdout
    folder = out.split("PATH ")[1].strip()
    assert folder.startswith(str(tmp_path)) and not os.path.exists(folder)


def test_scratch_path_uses_the_shared_folder(spark):
    from isotrend.session import scratch_path

    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert shared is None or path.startswith(shared)
    assert path != scratch_path(spark, "x")
