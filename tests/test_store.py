"""Moments kept between runs, tables laid out for requests, and many delimited files in one scan."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from isotrend.operators import change, moment_store, trend
from isotrend.functions.calendar import month_name
from isotrend.sources.readers import read_keyed_files
from isotrend.sources.writers import write_bucketed
from plans import final_plan

SCHEMA = "place string, day date, v double"


def readings(spark, seed=1, rows=3000):
    draw = random.Random(seed)
    data = [(draw.choice(["a", "b", "c", None]), datetime.date(draw.randint(1990, 2004), draw.randint(1, 12), draw.randint(1, 28)),
             draw.choice([None, float("nan"), *[draw.gauss(50, 9) + 1e6] * 8])) for _ in range(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def near(got, want, key):
    got, want = ({tuple(r[k] for k in key): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, row in want.items():
        for name, value in row.items():
            assert got[k][name] == (pytest.approx(value, rel=1e-6, abs=1e-9) if isinstance(value, float) else value), (k, name)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A store of four batches that cut months apart, the second of which came twice."""
    df, path = readings(spark), str(tmp_path_factory.mktemp("store") / "moments")
    for batch in (0, 1, 2, 1, 3):
        moment_store.add_batch(df.filter(F.pmod(F.xxhash64("day", "v"), F.lit(4)) == batch), path, f"b{batch}", ["place"], "day", "v")
    return df, moment_store.read_store(spark, path, ["place"]), path


def test_trends_from_the_store(store):
    df, moments, _ = store
    whole = trend.trend_test(df, "place", month_name(F.month("day")), "day", "v", [2004])
    near(moment_store.trend_from_moments(moments, ["place"], [2004]), whole, ["place", "month"])


def test_changes_and_series_from_the_store(store):
    df, moments, _ = store
    for month in (None, 7):
        near(moment_store.period_change_from_moments(moments, ["place"], 1994, 2001, month),
             change.period_change(df, "place", "day", "v", 1994, 2001, month), ["place"])
    near(moment_store.yearly_from_moments(moments, ["place"]),
         change.entity_year_mean(df, "place", "day", "v").filter("value is not null"), ["place", "year"])


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    df, path = readings(spark, 2, 200), str(tmp_path / "s")
    moment_store.add_batch(df, path, "x", ["place"], "day", "v")
    before = sorted(map(tuple, moment_store.read_store(spark, path, ["place"]).collect()), key=str)
    moment_store.add_batch(df, path, "x", ["place"], "day", "v")
    assert sorted(map(tuple, moment_store.read_store(spark, path, ["place"]).collect()), key=str) == before
    moment_store.add_batch(df.limit(0), path, "x", ["place"], "day", "v")
    assert moment_store.read_store(spark, path, ["place"]).count() == 0
    with pytest.raises(ValueError):
        moment_store.add_batch(df, path, "a/b", ["place"], "day", "v")


def test_requests_of_a_bucketed_table_need_no_exchange(spark, store, tmp_path):
    _, moments, _ = store
    served = write_bucketed(moments, "served_test", str(tmp_path / "served"), "place", 4, ["year", "month"])
    try:
        requests = [moment_store.period_change_from_moments(served, ["place"], 1994, 2001),
                    moment_store.yearly_from_moments(served, ["place"]), moment_store.trend_from_moments(served, ["place"])]
        for request in requests:
            plan = final_plan(request)
            assert "Exchange" not in plan and "Bucketed: true" in plan
        areas = write_bucketed(spark.createDataFrame([("a", "A"), ("z", "Z")], "place string, name string"), "areas_test",
                               str(tmp_path / "areas"), "place", 4)
        joined = areas.join(requests[0], "place", "left")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange" not in final_plan(joined)
        assert {r.place: r.value is None for r in joined.collect()} == {"a": False, "z": True}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS served_test")
        spark.sql("DROP TABLE IF EXISTS areas_test")


def layouts(folder, files, rows=3):
    """Files with three layouts and a cell that equals the key's name in another column."""
    want = []
    for i in range(files):
        lines = [["note 1", "", ""][: 1 + i % 2], ["DATE", "TAVG", "x"] if i % 3 == 0 else ["x", "DATE"] if i % 3 == 1 else ["TAVG", "\"a, b\"", "DATE"]]
        for year in range(1900, 1900 + rows):
            value = str(i + year / 4)
            lines.append([str(year), value, "ABC"] if i % 3 == 0 else ["q", str(year)] if i % 3 == 1 else [value, '"x, y"', str(year)])
            want.append((year, i + year / 4 if i % 3 != 1 else None, f"f{i}"))
        (folder / f"f{i}.csv").write_text("\n".join(",".join(line) for line in lines) + "\n,,\n")
    return want


@pytest.mark.parametrize("whole_bytes", [1 << 24, 0, 90])
def test_layouts_are_found_where_files_are_read(spark, tmp_path, whole_bytes):
    """All files whole, all by lines, and some of each."""
    want = layouts(tmp_path, 30)
    got = read_keyed_files(spark, str(tmp_path), "DATE int, TAVG double", whole_bytes=whole_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_data_cell_like_the_key_is_no_header(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,DATE,v\nA,1900,1\nDATE,1901,2\n")
    for whole_bytes in (1 << 20, 0):
        got = read_keyed_files(spark, str(tmp_path), "DATE int, name string", whole_bytes=whole_bytes)
        assert sorted(tuple(r) for r in got.collect()) == [(1900, "A", "s"), (1901, "DATE", "s")]


def test_many_small_files_are_one_scan_and_no_job_before(spark, tmp_path):
    layouts(tmp_path, 2000, 1)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ingest", "ingest")
    found = read_keyed_files(spark, str(tmp_path), "DATE int, TAVG double")
    assert len(status.getJobIdsForGroup("ingest")) <= 2  # listing alone, no pass over the texts
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 2000
    plan = final_plan(found)
    assert plan.count("FileScan text") <= 3 and found.filter("TAVG is null").count() == 667


def test_a_file_without_header_and_an_empty_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1900,2\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("DATE\r\n1900\r\nNA\r\n")
    assert [tuple(r) for r in read_keyed_files(spark, str(tmp_path), "DATE int").collect()] == [(1900, "c")]
