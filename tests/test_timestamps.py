from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from hotloom.operators import timestamps
from hotloom.operators.timestamps import grow_dictionary, normalise_stamps
from hotloom.session import stage_path


def micros(*args, zone="Asia/Kolkata", us=0):
    return int(datetime(*args, tzinfo=ZoneInfo(zone)).astimezone(UTC).timestamp()) * 1_000_000 + us


CASES = {
    "2019-01-01T06:44:52.298440Z": micros(2019, 1, 1, 6, 44, 52, zone="UTC", us=298440),
    "2019-01-01T06:44:52.2Z": micros(2019, 1, 1, 6, 44, 52, zone="UTC", us=200000),
    "2019-01-01 10:00:00": micros(2019, 1, 1, 10), "2019-01-01 10:00": micros(2019, 1, 1, 10), "2019-01-01": micros(2019, 1, 1),
    " \t1/2/2019 9:43 ": micros(2019, 1, 2, 9, 43), "7-31-2022 14:03": micros(2022, 7, 31, 14, 3), "1/10/19 08:53": micros(2019, 1, 10, 8, 53),
    "01 Jan 2019 12:35 AM": micros(2019, 1, 1, 0, 35), "01 Jan 2019 12:35 PM": micros(2019, 1, 1, 12, 35), "01 Jan 2019 06:35 PM": micros(2019, 1, 1, 18, 35),
    "Tue, 01 Jan 2019 11:50:54 GMT": micros(2019, 1, 1, 11, 50, 54, zone="UTC"), "Tue, 01 Jan 2019 11:50:54 +0530": micros(2019, 1, 1, 11, 50, 54),
    "20190102T075113Z": micros(2019, 1, 2, 7, 51, 13, zone="UTC"), "1546308752": 1546308752000000, "1546329338097": 1546329338097000,
    "2019-01-01 18:17:10 EST": micros(2019, 1, 1, 23, 17, 10, zone="UTC"), "2019-07-01 18:17:10 EDT": micros(2019, 7, 1, 22, 17, 10, zone="UTC"), "2019-01-01 18:17:10 IST": micros(2019, 1, 1, 18, 17, 10),
    "2019-02-28 03:08:41-0330": micros(2019, 2, 28, 6, 38, 41, zone="UTC"), "2019-01-06 13:36:24+01": micros(2019, 1, 6, 12, 36, 24, zone="UTC"), "2019-01-06 13:36:24+05:45": micros(2019, 1, 6, 7, 51, 24, zone="UTC"),
    "2019-01-02 11:23:39 America/New_York": micros(2019, 1, 2, 11, 23, 39, zone="America/New_York"), "2019-08-05T07:05:22[Europe/London]": micros(2019, 8, 5, 7, 5, 22, zone="Europe/London"),
    "2020-03-08 01:59:59 America/New_York": micros(2020, 3, 8, 1, 59, 59, zone="America/New_York"), "2020-03-08 03:00:00 America/New_York": micros(2020, 3, 8, 3, zone="America/New_York"),
    "2020-02-29 10:00:00": micros(2020, 2, 29, 10),
    # no instant
    "2020-03-08 02:12:52 America/New_York": None, "2020-10-25 01:09:37 Europe/London": None, "2021-10-03 02:13:20[Australia/Sydney]": None, "2019-02-30T10:55:00Z": None, "2019-02-29 10:00:00": None,
    "13-15-2021 00:05": None, "3/14/2020 25:52": None, "2019-08-27T00:66:05+05:30": None, "2019-08-27T00:06:60Z": None, "01 Jan 2019 13:35 PM": None, "01 Jan 2019 00:35 AM": None, "Mon, 01 Jan 2019 11:50:54 GMT": None,
    "2019-01-01 10:00:00 Nowhere/City": None, "0000-00-00 00:00": None, "garbage": None, "9/9/ 12:": None, "": None, "   ": None, "154630875": None, "a|b": None, "2019-01-01 10:00:00+25:00": None, "yesterday 9pm": None,
}


def test_notations(spark):
    df = spark.createDataFrame([(i, text, "keep") for i, text in enumerate(CASES)] + [(-1, None, "keep")], "id int, created_at string, utc_micros string")
    got = {r.id: (r.utc_micros, r.local_month) for r in normalise_stamps(df, "created_at").collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert got.get(i, (None,))[0] == want, text
        if want is not None:
            assert got[i][1] == (datetime(1970, 1, 1) + timedelta(microseconds=want, hours=5.5)).strftime("%Y-%m")
    assert -1 not in got


def test_hot_text_and_empty_table(spark):
    df = spark.createDataFrame([(i, "2019-01-01 10:00:00" if i % 3 else f"2019-01-01 10:00:{i % 60:02d}") for i in range(3000)], "id int, created_at string")
    assert normalise_stamps(df, "created_at").count() == 3000
    assert normalise_stamps(df.limit(0), "created_at").count() == 0


def test_dictionary_grows_and_zone_column(spark):
    path = stage_path(spark, "test_dict")
    first = spark.createDataFrame([("2019-07-01 10:00:00", "Europe/London"), ("2019-07-01 10:00:00", None)], "t string, z string")
    assert grow_dictionary(first, path, "t", "z").count() == 2
    assert grow_dictionary(first, path, "t", "z").count() == 2
    more = first.union(spark.createDataFrame([("2020-07-01 10:00:00", "Europe/London")], first.schema))
    assert grow_dictionary(more, path, "t", "z").count() == 3
    got = {(r.t, r.z): r.utc_micros for r in normalise_stamps(more, "t", "z", path).collect()}
    assert got["2019-07-01 10:00:00", "Europe/London"] == micros(2019, 7, 1, 10, zone="Europe/London")
    assert got["2019-07-01 10:00:00", None] == micros(2019, 7, 1, 10)


def test_sources_are_apart_and_a_later_load_parses_only_new_texts(spark, monkeypatch):
    path = stage_path(spark, "test_loads")
    first = spark.createDataFrame([("2019-01-01 10:00:00", 1), ("2019-01-01 10:00:00", 2), ("x", 1), (None, 1), ("2019-01-01", None)], "t string, run int")
    assert normalise_stamps(first, "t", path=path, source="run").count() == 3
    assert {(r.raw, r.source) for r in spark.read.parquet(path).collect()} == {("2019-01-01 10:00:00", "1"), ("2019-01-01 10:00:00", "2"), ("x", "1"), ("2019-01-01", "")}
    parsed = []
    real = timestamps.parse_stamps
    monkeypatch.setattr(timestamps, "parse_stamps", lambda df, *a: parsed.append(sorted((r.raw, r.source) for r in df.collect())) or real(df, *a))
    # the text turns frequent in the second load, which an older load brought
    more = spark.createDataFrame([("2019-01-01 10:00:00", 1)] * 900 + [("2020-01-01 10:00:00", 1), ("x", 2)], "t string, run int")
    got = normalise_stamps(more, "t", path=path, source="run")
    assert got.count() == 901 and parsed == [[("2020-01-01 10:00:00", "1"), ("x", "2")]]
    entries = {(r.raw, r.source): r.n for r in timestamps.stamp_entries(more, path, "t", source="run").collect()}
    assert entries["2019-01-01 10:00:00", "1"] == 900 and entries["2019-01-01 10:00:00", "2"] == 0


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "Australia/Lord_Howe", "Europe/London"])
def test_zone_clocks_against_brute_force(spark, zone):
    """Every half hour around a year's changes: an instant comes out if and only if it is the only one."""
    tz = ZoneInfo(zone)
    shown = {}
    for k in range(-100, 366 * 48 + 100):
        at = datetime(2021, 1, 1, tzinfo=UTC) + timedelta(minutes=30 * k)
        shown.setdefault(at.astimezone(tz).replace(tzinfo=None), []).append(int(at.timestamp()) * 1_000_000)
    clocks = [datetime(2021, 1, 1) + timedelta(minutes=30 * k) for k in range(365 * 48)]
    df = spark.createDataFrame([(f"{c:%Y-%m-%d %H:%M:%S} {zone}",) for c in clocks], "t string")
    got = {r.t: r.utc_micros for r in normalise_stamps(df, "t").collect()}
    for c in clocks:
        want = shown.get(c, [])
        assert got.get(f"{c:%Y-%m-%d %H:%M:%S} {zone}") == (want[0] if len(want) == 1 else None)
