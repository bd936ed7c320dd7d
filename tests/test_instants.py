from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tidewell.functions.instants import read_instant
from tidewell.operators.instants import InstantDictionary, normalise_instants, stamps

US = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*parts, tz=timezone.utc):
    return (datetime(*parts, tzinfo=tz) - EPOCH) // US


@pytest.mark.parametrize(
    "raw, zone, want",
    [
        ("2023-05-01T10:20:30", "Europe/Berlin", us(2023, 5, 1, 8, 20, 30)),
        ("2023-05-01 10:20", "Asia/Kolkata", us(2023, 5, 1, 4, 50)),
        ("2023-05-01T10:20:30.1234567Z", "Asia/Kolkata", us(2023, 5, 1, 10, 20, 30, 123456)),
        ("2023-05-01T10:20:30,5", None, us(2023, 5, 1, 10, 20, 30, 500000)),
        ("2023-05-01T10:20:30−03:30", "UTC", us(2023, 5, 1, 13, 50, 30)),
        ("2023-05-01T10:20:30+02:00[Europe/Berlin]", "UTC", us(2023, 5, 1, 8, 20, 30)),
        ("20230501T102030Z", "Asia/Kolkata", us(2023, 5, 1, 10, 20, 30)),
        ("1/5/23, 2:05 pm", "UTC", us(2023, 5, 1, 14, 5)),
        ("01/05/2023, 12:05 AM", "UTC", us(2023, 5, 1, 0, 5)),
        ("7 février 2024 à 20:23", "UTC", us(2024, 2, 7, 20, 23)),
        ("11. Januar 2023, 14:57 Uhr", "Europe/Berlin", us(2023, 1, 11, 13, 57)),
        ("Mon, 02 Jan 2023 17:38:43 +0100", "UTC", us(2023, 1, 2, 16, 38, 43)),
        ("Fri, 13 Jan 2023 08:38:46 GMT", "Asia/Kolkata", us(2023, 1, 13, 8, 38, 46)),
        ("1672624075", None, us(2023, 1, 2, 1, 47, 55)),
        ("1672624075471", None, us(2023, 1, 2, 1, 47, 55, 471000)),
        ("1672624075471123", None, us(2023, 1, 2, 1, 47, 55, 471123)),
        (" 1672624075471123999\n", None, us(2023, 1, 2, 1, 47, 55, 471123)),
        # twice: the earlier; never: the offset before; an abbreviation settles it
        ("2023-10-29T02:30:00", "Europe/Berlin", us(2023, 10, 29, 0, 30)),
        ("2023-03-26T02:30:00", "Europe/Berlin", us(2023, 3, 26, 1, 30)),
        ("2023-10-29 02:30:00 CET", "Europe/Berlin", us(2023, 10, 29, 1, 30)),
        ("2023-07-01 12:00:00 IST", "Asia/Kolkata", us(2023, 7, 1, 6, 30)),
    ],
)
def test_readable(raw, zone, want):
    assert read_instant(raw, zone) == want


@pytest.mark.parametrize("raw", [None, "", "  ", "null", "n/a", "--", "2025-02-30T10:15:00", "2024-13-01T08:00:00", "31/04/2025, 09:10", "2023-06-18T25:61:00", "0000-00-00T00:00:00", "2025-06-xx", "13:05 pm", "1/1/23, 13:05 pm"])
def test_unreadable(raw):
    assert read_instant(raw, "Europe/Berlin") is None


def test_naive_stamps_against_zoneinfo():
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu"):
        for h in range(0, 24 * 366, 5):
            local = datetime(2024, 1, 1) + timedelta(hours=h, minutes=17)
            want = (local.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc) - EPOCH) // US
            assert read_instant(local.isoformat(), zone) == want


def test_operator_keeps_each_record_once_and_salts_hot_pairs(spark, rows, tmp_path):
    data = [("t", str(i), "2023-05-01T10:20:30", None) for i in range(12_000)] + [("t", "x", "nope", "UTC"), ("t", "y", None, "UTC"), ("t", "z", "2023-05-01T10:20:30", "Asia/Kolkata"), ("t", "z", "2023-05-01T10:20:30", "Asia/Kolkata")]
    df = spark.createDataFrame([(*r, 1) for r in data], "tbl string, row_key string, raw string, zone string, utc_us int")
    d = InstantDictionary(spark, str(tmp_path / "d"))
    out = normalise_instants(df, d)
    assert out.count() == 12_001
    assert rows(out.where("row_key = 'z'")) == [("t", "z", us(2023, 5, 1, 4, 50, 30))]
    # a second run parses nothing new, and a new dictionary object finds the parts
    again = InstantDictionary(spark, str(tmp_path / "d"))
    assert again.parts == 1
    assert again.extend(df.selectExpr("raw", "coalesce(zone, 'UTC') as zone").where("raw is not null")).count() == d.read().count()


def test_empty_tables(spark):
    m = spark.createDataFrame([], "msg_id long, source_id string, datetime_iso string")
    r = spark.createDataFrame([], "entry_id long, received_at string")
    w = spark.createDataFrame([], "channel_id string, expiration string")
    s = spark.createDataFrame([], "source_id string, tz_name string")
    assert normalise_instants(stamps(m, r, w, s), InstantDictionary(spark)).count() == 0


def test_counts_follow_every_extension(spark, tmp_path):
    d = InstantDictionary(spark, str(tmp_path / "counts"))
    pairs = lambda *raws: spark.createDataFrame([(r, "UTC") for r in raws], "raw string, zone string")
    d.extend(pairs("2023-05-01T10:20:30", "x"), "day1")
    d.extend(pairs(*["2023-05-01T10:20:30"] * 4, "2023-05-02T00:00:00"), "day2")
    d.extend(pairs(*["2023-05-01T10:20:30"] * 4, "2023-05-02T00:00:00"), "day2")
    told = {r.raw: (r.n, r.utc_us is not None) for r in InstantDictionary(spark, d.path).read().collect()}
    assert told == {"2023-05-01T10:20:30": (5, True), "x": (1, False), "2023-05-02T00:00:00": (1, True)}
