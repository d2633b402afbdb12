import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.plans.analysis import ISOTOPE_SCHEMA, tidy_isotopes
from driftline.sources.delimited import (
    drop_empty_rows,
    from_decimal_comma,
    read_delimited,
    read_fix_text,
    read_growth_worksheet,
    write_decimal_comma,
)
from driftline.sources.export import export_by_key, materialise, route_by_completeness
from driftline.sources.multifile import matching_files, read_many, trips_of_years, year_of_trip

TYPES = {"JulDate": "double", "Lat": "double", "Lon": "double", "Long": "double"}


def test_header_drift_binds_by_name(spark, tmp_path):
    (tmp_path / "Track_Best_2020001_X 58.csv").write_text("SealID,JulDate,Lat,Lon\nX 58,735861.5,40.5,-130.25\n")
    (tmp_path / "Track_Best_2020002_3190.csv").write_text(
        "SealID,DateUTC,JulDate,Lat,Long\n3190,19-Sep-2014 10:00:00,735861.9,NaN,179.5\n3190,20-Sep-2014,735862.9,NA,-179.5\n"
    )
    (tmp_path / "DiveType_2020002.csv").write_text("SealID,DiveNumber\n3190,1\n")
    assert matching_files(spark, str(tmp_path), "Track_Best").count() == 2
    rows = read_many(spark, str(tmp_path), "Track_Best", TYPES, aliases={"Long": "Lon"})
    got = {(r.SealID, r.DateUTC, r.Lat, r.Lon) for r in rows.collect()}
    assert got == {
        ("X 58", None, 40.5, -130.25),
        ("3190", "19-Sep-2014 10:00:00", None, 179.5),
        ("3190", "20-Sep-2014", None, -179.5),
    }
    with pytest.raises(FileNotFoundError):
        read_many(spark, str(tmp_path), "DiveStat", TYPES)


def test_files_of_years_are_chosen_before_any_is_opened(spark, tmp_path):
    for name in ("2013999_a", "2014001_b", "2015123_c", "2016001_d", "92014001_e", "20140010_f"):
        (tmp_path / f"Track_{name}.csv").write_text(f"SealID,Lat\n{name},1\n")
    (tmp_path / "trip=2014777").mkdir()
    (tmp_path / "trip=2014777" / "part-0.csv").write_text("SealID,Lat\ninside,2\n")
    years = trips_of_years(2014, 2015)
    rows = read_many(spark, str(tmp_path), f"^Track_{years}", TYPES)
    assert {r.SealID for r in rows.collect()} == {"2014001_b", "2015123_c"}
    assert sorted(f.rsplit("/", 1)[-1] for f in rows.inputFiles()) == ["Track_2014001_b.csv", "Track_2015123_c.csv"]
    assert [r.SealID for r in read_many(spark, str(tmp_path), f"^trip={years}/", TYPES, below=True).collect()] == ["inside"]
    with pytest.raises(FileNotFoundError):
        read_many(spark, str(tmp_path), trips_of_years(1990, 1991), TYPES)


def test_worksheet_sections(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    header = "SealID;e;;Linf;Lrec;^;K;Partial;RecDate;RecDate;T0;T0;;True\n"
    path.write_text(
        "DROPPED;;;;;;;;;;;;;\nbecause;;;;;;;;;;;;;\n;;;;;;;;;;;;;\n" + header
        + "X 1 ;2,72;-2,05;9,83;8,6;0,92;0,01566;-132,6829;1/16/2016;16816;16683;5-Sep-15;;\n;;;;;;;;;;;;;\nKEPT;;;;;;;;;;;;;\n"
        + header + "3190;2,72;-2,05;9,83;8,2;0,92;0,0076;-114,7083;1/23/2015;16458;16343;30-Sep-14;16222;1-Jun-14\n"
    )
    rows = {r.seal_id: r for r in read_growth_worksheet(spark, str(path)).collect()}
    assert set(rows) == {"X 1 ", "3190"}
    assert rows["X 1 "].linf == 9.83 and rows["X 1 "].rec_date == dt.date(2016, 1, 16)
    assert rows["X 1 "].t0_true_day is None and rows["3190"].t0_true_day == 16222


def test_missing_values_and_filler_rows(spark, tmp_path):
    path = tmp_path / "trip.csv"
    path.write_text("Seal,TOPPID,Drift,Day\nG1,2014026,0.002,735861\nG2,2014028,-2.60E-05,NA\n,,,\n,,,\n")
    rows = drop_empty_rows(read_delimited(spark, str(path), "Seal string, TOPPID bigint, Drift double, Day bigint"))
    got = {r.Seal: r for r in rows.withColumn("year", year_of_trip(F.col("TOPPID"))).collect()}
    assert set(got) == {"G1", "G2"}
    assert got["G2"].Day is None and got["G2"].Drift == -2.6e-5 and got["G1"].year == 2014


def test_isotope_file(spark, tmp_path):
    path = tmp_path / "iso.csv"
    names = ";".join(c.split()[0] for c in ISOTOPE_SCHEMA.split(", "))
    path.write_text(names + "\nX 58;1;-17.5;13.2;12.6;1/25/2016;6/1/2015;3;2;yes;4.5;;FV;NA;NA\n")
    row = tidy_isotopes(read_delimited(spark, str(path), ISOTOPE_SCHEMA, sep=";")).first()
    assert (row.seal_id, row.nubbin, row.recovery_days) == ("X 58", True, 16825.0)


def test_decimal_comma_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("c", -2e-5)], "k string, x double")
    write_decimal_comma(df, str(tmp_path / "out"))
    text = read_delimited(spark, str(tmp_path / "out"), "k string, x string", sep=";")
    assert {r.k: r.x for r in text.collect()}["a"] == "1,5"
    assert {(r.k, r.x) for r in text.withColumn("x", from_decimal_comma(F.col("x"))).collect()} == {("a", 1.5), ("b", None), ("c", -2e-5)}


def test_fix_text(spark, tmp_path):
    path = tmp_path / "fixes.csv"
    path.write_text("PTT,Date,Lat,Lon\n2004026 , 1/2/2014 3:04 , 40.5 , -130.25\n")
    row = read_fix_text(spark, str(path)).first()
    assert (row.ptt, row.time, row.lat, row.lon) == ("2004026", dt.datetime(2014, 1, 2, 3, 4), 40.5, -130.25)


def check_export(spark, path):
    rows = [("X 1 ", i) for i in range(20)] + [("3190", 1), ("A/B", 2)]
    export_by_key(spark.createDataFrame(rows, "SealID string, n int").repartition(5), path, "SealID", rows_per_file=8)
    back = read_delimited(spark, path, "SealID string, n int")
    assert sorted((r.SealID, r.n) for r in back.collect()) == sorted(rows)


def test_export_by_animal(spark, tmp_path):
    check_export(spark, str(tmp_path / "out"))


def test_export_of_large_animals(spark, tmp_path):
    check_export(spark, str(tmp_path / "out"))


def test_routes_and_materialise(spark, tmp_path):
    meta = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "k string, complete boolean")
    stat = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 1, 7.0)], "k string, dive_number int, depth double")
    kind = spark.createDataFrame([("a", 1, 2)], "k string, dive_number int, type int")
    track = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, lat double")
    dives, tracks = route_by_completeness(meta, stat, kind, track, "k", "complete")
    assert {(r.k, r.dive_number, r.type) for r in dives.collect()} == {("a", 1, 2), ("a", 2, None)}
    assert [r.k for r in tracks.collect()] == ["b"]
    kept = materialise(dives, str(tmp_path / "dives"), ["k"])
    assert kept.schema == dives.schema and kept.count() == 2


def test_exports_write_no_checksum_files_and_are_listed_in_few_tasks(spark, tmp_path):
    rows = [(f"a{i}", i) for i in range(250)]
    export_by_key(spark.createDataFrame(rows, "SealID string, n int"), str(tmp_path / "out"), "SealID")
    assert not list((tmp_path / "out").rglob("*.crc"))
    assert len(list((tmp_path / "out").glob("animal=*/part-*.csv"))) == 250
    group = "listing"
    spark.sparkContext.setJobGroup(group, group)
    back = read_delimited(spark, str(tmp_path / "out"), "SealID string, n int")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(tracker.getStageInfo(s).numTasks <= 200 for s in stages)
    assert sorted((r.SealID, r.n) for r in back.collect()) == sorted(rows)


def test_exports_are_read_without_columns_of_folder_names(spark, tmp_path):
    rows = [("X 1 ", 1), ("X 1 ", 1), ("0012", 2), ("A/B=c", 3), (None, 4), ("x", None)]
    export_by_key(spark.createDataFrame(rows, "SealID string, n int"), str(tmp_path / "out"), "SealID")
    back = read_delimited(spark, str(tmp_path / "out"), "SealID string, n int", below=True)
    assert back.columns == ["SealID", "n"]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
