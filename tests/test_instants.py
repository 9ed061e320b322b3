import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tidemark.operators.instants import normalise_times

CLOCKS = [("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("cli", "UTC", "ymd")]


def us(*parts, zone="UTC", fold=0):
    t = dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(dt.timezone.utc)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


CASES = [
    ("cli-1", "2024-02-29 10:00:00", us(2024, 2, 29, 10)), ("cli-1", "2023-02-29 10:00:00", None),
    ("cli-1", "2024-13-45 10:00:00", None), ("cli-1", "0000-00-00 00:00:00", None), ("cli-1", "yesterday", None),
    ("cli-1", "", None), ("cli-1", None, None), ("cli-1", "T::Z", None),
    ("de-1", "　 2024-07-01T12:00:00,5 ", us(2024, 7, 1, 12, 0, 0, 500000, zone="Europe/Berlin")),
    ("de-1", "03/04/2024 07:08", us(2024, 4, 3, 7, 8, zone="Europe/Berlin")),
    ("ny-1", "03/04/2024 7:08 PM", us(2024, 3, 4, 19, 8, zone="America/New_York")),
    ("ny-1", "12:00", None), ("ny-1", "01/02/2024 12:30 AM", us(2024, 1, 2, 0, 30, zone="America/New_York")),
    # twice: the first; skipped: the offset before the skip
    ("de-1", "2024-10-27 02:30:00", us(2024, 10, 27, 2, 30, zone="Europe/Berlin", fold=0)),
    ("de-1", "2024-03-31 02:30:00", us(2024, 3, 31, 1, 30)),
    ("ny-1", "2024-10-27 02:40:26 CEST", us(2024, 10, 27, 0, 40, 26)),
    ("ny-1", "1704086883", 1704086883_000000), ("ny-1", "1704086883123", 1704086883_123000),
    ("ny-1", "1704086883123456", 1704086883_123456), ("ny-1", "1704086883.25", 1704086883_250000),
    ("ny-1", "Sun, 31 Dec 2023 22:51:39 +0530", us(2023, 12, 31, 17, 21, 39)),
    ("ny-1", "May 1, 2024 3:53:24 AM", us(2024, 5, 1, 3, 53, 24, zone="America/New_York")),
    ("de-1", "2024年1月3日 19:52:28", us(2024, 1, 3, 19, 52, 28, zone="Europe/Berlin")),
    ("xx-1", "20240101T101751Z", us(2024, 1, 1, 10, 17, 51)), (None, "2024-01-04", us(2024, 1, 4)),
    ("xx-1", "2024-01-01T00:00:00.123456789Z", us(2024, 1, 1, 0, 0, 0, 123456)), ("xx-1", "x" * 5000, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, s, v, "extra") for i, (s, v, _) in enumerate(CASES)], "id long, source_session_id string, t string, value string")
    clocks = spark.createDataFrame(CLOCKS, "client string, tz_name string, date_order string")
    return {r.knowledge_id: r.utc_us for r in normalise_times(rows, clocks, ["t"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found.get(i) == CASES[i][2], CASES[i]


def test_empty(spark):
    rows = spark.createDataFrame([], "id long, source_session_id string, t string")
    assert normalise_times(rows, spark.createDataFrame([], "client string, tz_name string, date_order string"), ["t"]).count() == 0
