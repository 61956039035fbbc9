from datetime import datetime, timezone

import pytest

from veritrail.operators.instants import normalised_instants, parse_instant


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2024-01-01T16:34:35", None, "Australia/Sydney", at(2024, 1, 1, 5, 34, 35)),
    ("2024-01-01T16:34:35", None, None, at(2024, 1, 1, 16, 34, 35)),
    ("2024-01-05T11:14:28,238+00:00", None, None, at(2024, 1, 5, 11, 14, 28) + 238_000),
    ("2024-01-11T19:14:33-05:00[America/New_York]", None, "Asia/Tokyo", at(2024, 1, 12, 0, 14, 33)),
    ("1704341856891", None, None, 1704341856891000), ("1704173487", None, None, 1704173487000000), ("1707128698389395", None, None, 1707128698389395),
    ("04/01/2024 21:40", "en-GB", None, at(2024, 1, 4, 21, 40)), ("01/04/2024 6:40 PM", "en-US", None, at(2024, 1, 4, 18, 40)),
    ("01/04/2024 12:05 AM", "en-US", None, at(2024, 1, 4, 0, 5)), ("03.01.2024 14:33", "de-DE", None, at(2024, 1, 3, 14, 33)), ("01/02/2024", None, None, at(2024, 2, 1)),
    ("Tue, 02 Jan 2024 10:34:00 +0900", None, "Europe/Berlin", at(2024, 1, 2, 1, 34)), ("Mon, 01 Jan 2024 04:06:08 GMT", None, "Asia/Tokyo", at(2024, 1, 1, 4, 6, 8)),
    ("2024/09/25 (Wed) 01:27", "en-US", None, at(2024, 9, 25, 1, 27)), ("20240101T151438Z", None, None, at(2024, 1, 1, 15, 14, 38)), ("2024-01-18t09:07:17z", None, None, at(2024, 1, 18, 9, 7, 17)),
    ("24 Mar 2024 05:54:26 PDT", None, "America/Los_Angeles", at(2024, 3, 24, 12, 54, 26)), ("3 Nov 2024 01:30:00 PST", None, "America/Los_Angeles", at(2024, 11, 3, 9, 30)),
    ("2024-11-03 01:30", None, "America/Los_Angeles", at(2024, 11, 3, 8, 30)), ("2024-03-10 02:30", None, "America/Los_Angeles", at(2024, 3, 10, 10, 30)),
    ("\t2024-06-16 19:05\n", None, "Europe/Lisbon", at(2024, 6, 16, 18, 5)), ("Jan 7, 2024 9:19 am", None, None, at(2024, 1, 7, 9, 19)), ("2024-01-16", None, None, at(2024, 1, 16)),
]
NO_DATES = ["", " ", "-", "n/a", "unknown", "next Tuesday", "0000-00-00", "2026-02-30T10:00:00Z", "2025-13-04 09:00", "2025-06-14T27:15:00Z", "12", None]


@pytest.mark.parametrize(("raw", "locale", "zone", "want"), CASES)
def test_written_forms(raw, locale, zone, want):
    assert parse_instant(raw, locale, zone) == want


@pytest.mark.parametrize("raw", NO_DATES)
def test_no_dates(raw):
    assert parse_instant(raw, "en-US", "Europe/Berlin") is None


def test_rows_and_kept_dictionary(spark, rows, tmp_path):
    schema = "src string, rec_id long, raw string, locale string, zone string, utc_us string"
    data = [("s", i, raw, locale, zone, "junk") for i, (raw, locale, zone, _) in enumerate(CASES)] + [("s", 1000 + i, raw, None, None, "") for i, raw in enumerate(NO_DATES)]
    want = sorted([("s", i, w) for i, (*_, w) in enumerate(CASES)], key=str)
    df = spark.createDataFrame(data, schema)
    assert rows(normalised_instants(df)) == want
    kept = str(tmp_path / "book")
    assert rows(normalised_instants(df.limit(5), kept)) == sorted([("s", i, CASES[i][3]) for i in range(5)], key=str)
    size = spark.read.parquet(kept).count()
    assert rows(normalised_instants(df, kept)) == want
    assert spark.read.parquet(kept).count() == len({(r, x, z) for _, _, r, x, z, _ in data if r is not None}) > size
    assert rows(normalised_instants(spark.createDataFrame([], schema))) == []
    assert rows(normalised_instants(spark.createDataFrame([], schema), str(tmp_path / "none"))) == []
