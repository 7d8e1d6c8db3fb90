"""Headered CSV -> observations -> windows, end to end."""

import gzip
import tempfile
from pathlib import Path

import pytest

from hourloom.functions.names import CANONICAL_TARGET, CANONICAL_TIME
from hourloom.functions.timeparse import best_of_n_parse
from hourloom.operators.ingest import ParseGateError, ingest
from hourloom.plans.prepare import Gates, prepare
from hourloom.sources.csv import read_sensor_csv, series_root


def _write(dirpath, name, header, rows):
    p = Path(dirpath) / name
    p.parent.mkdir(parents=True, exist_ok=True)
    text = header + "\n" + "\n".join(rows) + "\n"
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text, encoding="utf-8")
    return str(p)


def _station_a(d, name="station_a.csv"):
    rows = []
    for i in range(60):
        day, hour = 1 + i // 24, i % 24
        pm = "NA" if i % 11 == 0 else f"{10 + i % 7},{i % 10}00" if i % 13 == 0 else str(10 + i % 7)
        rows.append(f'"{day:02d}/01/2024 {hour:02d}:00", {20 + i % 3} ,{pm},"note {i}",{50 + i}')
    return _write(d, name, " Timestamp ,Temperature,PM2.5 (µg/m³),Station note,Humidity", rows)


def test_one_header(spark):
    d = tempfile.mkdtemp(prefix="hourloom-csv-")
    _station_a(d)
    ing = ingest(read_sensor_csv(spark, f"{d}/*.csv"), series_col="series_id")
    assert ing.timestamp_col == "Timestamp" and ing.target == "PM2.5 (µg/m³)"
    assert ing.predictors == ["Temperature", "Humidity"]          # text note dropped by P7
    assert ing.value_cols == ["Temperature", "PM2.5 (µg/m³)", "Humidity"]
    obs = ing.observations
    assert obs.count() == 60 and {r.series_id for r in obs.select("series_id").distinct().collect()} == {"station_a"}
    p = prepare(obs, ing.target, ing.predictors, feature_order=ing.value_cols, persist="none", gates=Gates(10, 5, 1))
    assert p.feature_names[:3] == ["Temperature", "PM2.5_current", "Humidity"]
    assert p.windows.count() > 0


def _three_stations():
    d = tempfile.mkdtemp(prefix="hourloom-csv-")
    _station_a(f"{d}/north", "s.csv")
    _write(f"{d}/south", "s.csv", "DateTime,PM25,Wind,Rare", [f"2024-02-01 {h:02d}:00:00,{5 + h},{h % 4},{'x' if h < 22 else h}" for h in range(24)])
    _write(d, "bad.csv.gz", "DateTime,PM25,Wind,Rare", [f"someday {h},{h},{h},{h}" for h in range(30)])
    return d


@pytest.mark.parametrize("path", ["{d}", "{d}/", ["{d}/north/s.csv", "{d}/south", "{d}/bad.csv.gz"]])
def test_mixed_headers_equal_names_and_a_bad_station(spark, path):
    d = _three_stations()
    paths = [p.format(d=d) for p in path] if isinstance(path, list) else path.format(d=d)
    raw = read_sensor_csv(spark, paths)
    assert {CANONICAL_TIME, CANONICAL_TARGET} < set(raw.columns) and raw.count() == 60 + 24 + 30
    with pytest.raises(ParseGateError) as e:
        ingest(raw, series_col="series_id")
    assert [r.series_id for r in e.value.failed.collect()] == ["bad"]
    ing = ingest(raw, series_col="series_id", on_fail="exclude")
    rows = ing.observations.collect()
    by = {}
    for r in rows:
        by.setdefault(r.series_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"north/s": 60, "south/s": 24}
    assert sorted(ing.predictors) == ["Humidity", "Temperature", "Wind"]  # Rare: numeric in under a quarter of south
    assert sorted(r[CANONICAL_TARGET] for r in by["south/s"]) == [float(5 + h) for h in range(24)]
    assert all(r.Wind is None for r in by["north/s"]) and all(r.Wind is not None for r in by["south/s"])
    assert {r.series_id for r in ing.parse_report.where("not parse_passed").collect()} == {"bad"}
    assert ingest(raw, series_col="series_id", on_fail="report").observations.where("series_id = 'bad'").count() == 0


def test_a_column_of_one_station_is_kept_and_nulled_where_it_is_text(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", str(h), str(h)) for h in range(24)]
    rows += [("b", f"2024-01-01 {h:02d}:00:00", str(h), "7" if h == 3 else "text") for h in range(24)] * 20
    ing = ingest(spark.createDataFrame(rows, "series_id string, Timestamp string, `PM2.5` string, p string"), series_col="series_id")
    assert ing.predictors == ["p"]
    got = {(r.series_id, r.p) for r in ing.observations.collect()}
    assert ("a", 5.0) in got and {p for s, p in got if s == "b"} == {None}


def test_series_root():
    assert series_root(["file:///x/a/1.csv", "file:///x/b/1.csv"]) == "file:///x/"
    assert series_root(["file:///x/1.csv"]) == "file:///x/"
    assert series_root(["s3://b/x/1.csv", "s3://b/y/2.csv"]) == "s3://b/"


@pytest.mark.parametrize("text,want", [
    ("1/2/2024 3:05 PM", "2024-01-02 15:05:00"), ("2024-01-02 12:00:07 am", "2024-01-02 00:00:07"), ("2 Jan 2024 03:04", "2024-01-02 03:04:00"),
    ("Jan 2, 2024 03:04", "2024-01-02 03:04:00"), ("2-Feb-2024", "2024-02-02 00:00:00"), ("March 5, 2024", "2024-03-05 00:00:00"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05+02:00", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05.250-0500", "2024-01-02 03:04:05.250000"),
    ("20240102", "2024-01-02 00:00:00"), ("20240102030405", "2024-01-02 03:04:05"), ("20240102T030405", "2024-01-02 03:04:05"), ("20240102 03:04", "2024-01-02 03:04:00")])
def test_common_layouts(spark, text, want):
    rows, report = best_of_n_parse(spark.createDataFrame([("s", text)], "series_id string, t string"), "t")
    assert report.first().parse_rate == 1.0
    assert str(rows.first().ts) == want


def test_header_is_read_from_a_files_head_alone(spark, tmp_path):
    """What is read of a file does not grow with it; compressed files alike."""
    import bz2
    import gzip
    import io

    import zstandard

    from hourloom.sources import csv as src

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            self.taken += len(got)
            return got

    body = b"time, PM2.5 \r\n" + b"2024-01-01 00:00:00,1.5\r\n" * 200_000
    big = Counted(body)
    assert src.first_line(big) == "time, PM2.5 " and big.taken == 1 << 16
    assert [src.first_line(io.BytesIO(x), 3) for x in (b"", b"\n\n", b"abcdefg", b"abcdef\rgh", "é;ü\n".encode())] == [None, "", "abcdefg", "abcdef", "é;ü"]

    (tmp_path / "big.csv").write_bytes(body)
    (tmp_path / "a b.csv").write_bytes(b"\xef\xbb\xbftime, PM2.5 ")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(body[:400]))
    (tmp_path / "n.csv.bz2").write_bytes(bz2.compress(b"station,time\nx,2024-01-01 00:00:00\n"))
    (tmp_path / "z.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(body[:400]))
    groups = src._header_groups(spark, [str(tmp_path)])
    named = {h: sorted(f.rsplit("/", 1)[1].replace("%20", " ") for f in files) for h, files in groups.items()}
    assert named == {"time, PM2.5": ["a b.csv", "big.csv", "g.csv.gz", "z.csv.zst"], "station,time": ["n.csv.bz2"]}
    scanned = {r.f.rsplit("/", 1)[1].replace("%20", " "): r.h for r in src._scanned(spark, [str(tmp_path / "big.csv"), str(tmp_path / "g.csv.gz")]).collect()}
    assert scanned == {"big.csv": "time, PM2.5 ", "g.csv.gz": "time, PM2.5 "}
    plan = spark.read.format("binaryFile").load(str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
