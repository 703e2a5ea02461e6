"""Stores with a commit log: what a stopped writer leaves behind, versions, clean-up, files counted once."""

import os

import pytest
from pyspark.sql import functions as F

from cellcast.functions.grid import TEST_1KM
from cellcast.sources import rasters as RS
from cellcast.sources import trip_store as TS

CELLS = "grouping string, period_h int, row int, col int, value double"
LIST = "grouping string, period_h int"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def listed(spark, rows):
    return spark.createDataFrame(rows, LIST)


def values(df):
    return sorted((r.grouping, r.period_h, r.row, r.col, r.value) for r in df.collect())


def rasters(df):
    return sorted(map(tuple, df.collect()))


def test_a_write_that_stops_before_its_commit_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    RS.write_layers(cells(spark, [("a", 1, 2, 3, 5.0), ("a", 2, 0, 0, 1.0)]), listed(spark, [("a", 1), ("a", 2)]), path, TEST_1KM)
    before = values(RS.read_layers(spark, path))
    staged = RS.stage_layers(cells(spark, [("a", 1, 9, 9, 7.0)]), listed(spark, [("a", 1), ("b", 4)]), path, TEST_1KM)
    assert values(RS.read_layers(spark, path)) == before
    assert rasters(RS.list_rasters(spark, path)) == [("a", 1), ("a", 2)]
    assert RS.commit_layers(spark, path, staged) == 2
    assert values(RS.read_layers(spark, path)) == [("a", 1, 9, 9, 7.0), ("a", 2, 0, 0, 1.0)]
    assert rasters(RS.list_rasters(spark, path)) == [("a", 1), ("a", 2), ("b", 4)]
    assert values(RS.read_layers(spark, path, version=1)) == before
    RS.commit_layers(spark, path, staged)  # a repeated commit
    assert values(RS.read_layers(spark, path)) == [("a", 1, 9, 9, 7.0), ("a", 2, 0, 0, 1.0)]


def test_a_store_without_a_cell_is_read_as_empty_rasters(spark, tmp_path):
    path = str(tmp_path / "s")
    assert RS.list_rasters(spark, path).count() == 0 and RS.read_layers(spark, path).count() == 0
    RS.write_layers(cells(spark, [("a", 1, 2, 3, 0.0)]), listed(spark, [("a", 1)]), path, TEST_1KM)
    assert RS.read_layers(spark, path).count() == 0
    assert rasters(RS.list_rasters(spark, path)) == [("a", 1)]
    RS.write_layers(cells(spark, [("a", 1, 2, 3, 4.0)]), listed(spark, [("a", 1)]), path, TEST_1KM)
    assert values(RS.read_layers(spark, path, "a")) == [("a", 1, 2, 3, 4.0)]
    RS.write_layers(cells(spark, []), listed(spark, [("a", 1)]), path, TEST_1KM)
    assert RS.read_layers(spark, path).count() == 0 and rasters(RS.list_rasters(spark, path)) == [("a", 1)]


def test_vacuum_deletes_only_what_the_newest_version_does_not_need(spark, tmp_path):
    path = str(tmp_path)
    for v in (1.0, 2.0):
        RS.write_layers(cells(spark, [("a", 1, 0, 0, v), ("a", 2, 0, 0, v)]), listed(spark, [("a", 1), ("a", 2)]), path, TEST_1KM)
    RS.write_layers(cells(spark, [("a", 1, 0, 0, 3.0)]), listed(spark, [("a", 1)]), path, TEST_1KM)
    RS.stage_layers(cells(spark, [("a", 1, 0, 0, 9.0)]), listed(spark, [("a", 1)]), path, TEST_1KM)
    assert RS.vacuum(spark, path) == 0  # all younger than a day
    assert RS.vacuum(spark, path, min_age_s=-1.0) == 2  # the first write and the one never committed
    assert values(RS.read_layers(spark, path)) == [("a", 1, 0, 0, 3.0), ("a", 2, 0, 0, 2.0)]
    assert len([d for d in os.listdir(f"{path}/cells") if d.startswith("write_id=")]) == 2
    assert RS.vacuum(spark, path, min_age_s=-1.0) == 0


def line(hour, lat="40.75", lng="-73.98", fields=14):
    parts = ["1", "2", "v", "1", "N", f"2024-01-01 {hour:02d}:00:00", "", "1", "0", "0", lng, lat, "", ""]
    return ",".join(parts[:fields])


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("".join(x + "\n" for x in lines))


def test_files_are_counted_once(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    land(landing, "a.txt", [line(3), line(3), line(4)])
    first = TS.ingest_new(spark, landing, store, TEST_1KM)
    assert (first.files, first.lines, first.bad) == (1, 3, 0)
    assert TS.ingest_new(spark, landing, store, TEST_1KM) == (None, 0, 0, 0)
    land(landing, "b.txt", [line(3)])
    land(landing, "empty.txt", [])
    assert TS.ingest_new(spark, landing, store, TEST_1KM).files == 1
    got = {r.period_h % 24: r.n for r in TS.stored_counts(spark, store).collect()}
    assert got == {3: 3, 4: 1}
    assert TS.ledger(spark, store).count() == 2
    land(landing, "a.txt", [line(3)])
    with pytest.raises(ValueError, match="has changed"):
        TS.ingest_new(spark, landing, store, TEST_1KM)


def test_every_bad_line_is_kept_with_its_file(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    land(landing, "a.txt", [line(3), line(3, fields=13), "header,line", "", line(25), line(25)])
    land(landing, "b.txt", ["header,line", line(5, lat="bad")])
    done = TS.ingest_new(spark, landing, store, TEST_1KM, partitions=3)
    assert (done.lines, done.bad) == (8, 6)
    got = sorted((r.file.rsplit("/", 1)[1], r.reason, r.line, r.n) for r in TS.bad_lines(spark, store).collect())
    assert got == [("a.txt", "datetime", line(25), 2), ("a.txt", "fields", "", 1), ("a.txt", "fields", line(3, fields=13), 1),
                   ("a.txt", "fields", "header,line", 1), ("b.txt", "fields", "header,line", 1)]
    assert TS.stored_counts(spark, store).agg(F.sum("n")).first()[0] == 2


def test_a_batch_that_fails_leaves_nothing_that_counts(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    land(landing, "a.txt", [line(3), "bad"])
    with pytest.raises(ValueError, match="1 of 2 lines are bad"):
        TS.ingest_new(spark, landing, store, TEST_1KM, "fail")
    assert TS.stored_counts(spark, store).count() == 0 and TS.bad_lines(spark, store).count() == 0
    assert TS.ledger(spark, store).count() == 0
    assert TS.ingest_new(spark, landing, store, TEST_1KM).bad == 1
    assert TS.stored_counts(spark, store).count() == 1


def test_ingest_needs_a_place_for_bad_lines(spark, tmp_path):
    from cellcast.plans import demand_model as DM
    land(str(tmp_path / "in"), "a.txt", [line(3), "bad"])
    with pytest.raises(ValueError, match="needs a store"):
        DM.ingest(spark, str(tmp_path / "in"), TEST_1KM, on_bad="quarantine")
    counts = DM.ingest(spark, str(tmp_path / "in"), TEST_1KM, on_bad="quarantine", store=str(tmp_path / "store"))
    assert counts.count() == 1
    counts.unpersist()
    assert [r.line for r in TS.bad_lines(spark, str(tmp_path / "store")).collect()] == ["bad"]
