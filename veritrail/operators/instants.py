"""One unambiguous instant for timestamps written in many formats, precisions and zones.

Method: the distinct (raw string, locale, zone) triples of all sources form a dictionary; each
triple is parsed exhaustively once, the dictionary is kept as a table that later runs only add
to, and the instants are joined back to the rows. Parsing cost follows the number of distinct
writings, not the number of rows, and a writing that a third of all rows share is parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.operators.shared import lookup, stage

#: Version of the rules below; a persisted dictionary belongs to one.
PARSER = "1"
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LONG_MONTHS = dict(zip("january february march april may june july august september october november december".split(), range(1, 13)))
WEEKDAYS = "(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?"
_OFFSET = r"(?P<off>z|(?:utc|gmt)?\s*[+\-−]\d{1,2}:?\d{2}(?::?\d{2})?|[+\-−]\d{2})"
_ZONE = rf"(?:\s*{_OFFSET})?(?:\s*\[(?P<zone>[^\]]+)\]|\s+(?P<abbr>[a-z]{{1,5}}|[a-z]+(?:/[a-z_+\-0-9]+)+))?(?:\s*\((?P<note>[^)]*)\))?"
_AT = rf"(?:(?:\s*,?\s*(?:at\s+)?|t){_TIME}{_ZONE})?"
_NAME = "|".join([*LONG_MONTHS, *MONTHS, "sept"])
_SHAPES = [
    re.compile(rf"(?:{WEEKDAYS},?\s+)?(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:\s*\({WEEKDAYS}\))?{_AT}"),
    re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_ZONE})"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
    re.compile(rf"(?:{WEEKDAYS},?\s+)?(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:\s*\({WEEKDAYS}\))?{_AT}"),
    re.compile(rf"(?:{WEEKDAYS},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+(?P<name>{_NAME})\.?,?[\s-]+(?P<y>\d{{4}}){_AT}"),
    re.compile(rf"(?:{WEEKDAYS},?\s+)?(?P<name>{_NAME})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_AT}"),
    re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})"),
]
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _micros(local: datetime) -> int:
    return (local - _EPOCH) // _MICRO


def _at_zone(local: datetime, zone: ZoneInfo) -> int:
    """fold 0 is the first occurrence of a repeated local time and, for a skipped one, the offset before the change."""
    return _micros(local) - local.replace(tzinfo=zone, fold=0).utcoffset() // _MICRO


def _offset_micros(text: str) -> int | None:
    text = text.replace("−", "-").replace("utc", "").replace("gmt", "").strip()
    if text == "z":
        return 0
    digits = re.sub(r"\D", "", text)
    digits = digits.zfill(2) if len(digits) <= 2 else digits.zfill(4 if len(digits) <= 4 else 6)
    hours, minutes, seconds = int(digits[:2]), int(digits[2:4] or 0), int(digits[4:6] or 0)
    if hours > 18 or minutes > 59 or seconds > 59:
        return None
    return (-1 if text[0] == "-" else 1) * ((hours * 60 + minutes) * 60 + seconds) * 1_000_000


def _by_abbreviation(local: datetime, abbr: str, zone: ZoneInfo | None) -> int | None:
    """The offset that ``abbr`` has in ``zone``, searched around the local time."""
    if abbr in ("utc", "gmt", "z", "ut"):
        return _micros(local)
    if zone is None:
        return None
    for fold in (0, 1):
        aware = local.replace(tzinfo=zone, fold=fold)
        if (aware.tzname() or "").lower() == abbr:
            return _micros(local) - aware.utcoffset() // _MICRO
    for days in range(1, 366, 15):
        for sign in (-1, 1):
            try:
                aware = (local + timedelta(days=sign * days)).replace(tzinfo=zone)
            except OverflowError:
                continue
            if (aware.tzname() or "").lower() == abbr:
                return _micros(local) - aware.utcoffset() // _MICRO
    return None


def parse_instant(raw: str | None, locale: str | None, zone_name: str | None) -> int | None:
    """Microseconds since 1970 UTC, or None if ``raw`` names no real instant.

    A written offset outranks a zone name beside it; without either, local time of ``zone_name``
    (UTC if null or unknown). Abbreviations are those of ``zone_name``. All-digit dates are month
    first only in en-US unless the year leads. Parts not written are zero. Bare numbers of 9 or
    10, 12 or 13 and 15 or 16 digits are seconds, milliseconds and microseconds. Of a repeated
    local time the first occurrence counts; a skipped one takes the offset before the change.
    """
    if raw is None:
        return None
    text = re.sub(r"\s+", " ", raw.replace(" ", " ").replace(" ", " ")).strip().lower()
    if re.fullmatch(r"-?\d{9,10}|-?\d{12,13}|-?\d{15,16}", text):
        size = len(text.lstrip("-"))
        return int(text) * (1_000_000 if size <= 10 else 1_000 if size <= 13 else 1)
    if m := re.fullmatch(r"(\d{9,10})\.(\d{1,6})\d*", text):
        return int(m[1]) * 1_000_000 + int(m[2].ljust(6, "0"))
    zone = _zone(zone_name)
    for shape in _SHAPES:
        m = shape.fullmatch(text)
        if not m:
            continue
        got = {k: v for k, v in m.groupdict().items() if v is not None}
        if "a" in got:
            first, second = int(got["a"]), int(got["b"])
            month, day = (first, second) if (locale or "").lower().replace("_", "-") == "en-us" else (second, first)
        elif "name" in got:
            month, day = MONTHS[got["name"][:3]], int(got["d"])
        else:
            month, day = int(got["m"]), int(got.get("d", 1))
        hour = int(got.get("h", 0))
        if "ap" in got:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if got["ap"] == "p" else 0)
        extra = timedelta()
        if hour == 24 and not int(got.get("mi", 0)) and not int(got.get("s", 0)) and not int(got.get("f", 0) or 0):
            hour, extra = 0, timedelta(days=1)
        second = int(got.get("s", 0))
        if second == 60 and int(got.get("mi", 0)) == 59:
            second, extra = 59, extra + timedelta(seconds=1)
        try:
            local = datetime(int(got["y"]), month, day, hour, int(got.get("mi", 0)), second, int(got.get("f", "0").ljust(6, "0")[:6])) + extra
            if "off" in got:
                offset = _offset_micros(got["off"])
                return None if offset is None else _micros(local) - offset
            if "zone" in got or "/" in got.get("abbr", ""):
                named = _zone(next((z for z in (_cased(got.get("zone") or got["abbr"]),) if z), None))
                return _at_zone(local, named) if named else None
            if "abbr" in got:
                return _by_abbreviation(local, got["abbr"], zone)
            return _at_zone(local, zone or timezone.utc)
        except (ValueError, OverflowError):
            return None
    return None


@lru_cache(maxsize=4096)
def _cased(name: str) -> str | None:
    """The zone whose name equals ``name`` but for case."""
    return _zone_names().get(name.strip().lower())


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    from zoneinfo import available_timezones

    return {z.lower(): z for z in available_timezones()}


def _parse_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        clean = pdf.astype(object).where(pdf.notna(), None)
        found = [parse_instant(*x) for x in zip(clean["raw"], clean["locale"], clean["zone"])]
        pdf["utc_us"] = pd.array(found, dtype="Int64")
        yield pdf


def extend_dictionary(spark: SparkSession, writings: DataFrame, kept: str | None = None) -> DataFrame:
    """Dictionary raw, locale, zone, _n, utc_us over ``writings`` (raw, locale, zone; no null raw).

    With ``kept`` the parsed triples live in that table: only unknown ones are parsed, and they
    are appended to it. Without it the dictionary is staged for this run.
    """
    counted = writings.groupBy("raw", "locale", "zone").agg(F.count("*").alias("_n"))
    parse = "raw string, locale string, zone string, utc_us long"
    if kept is None:
        # a few writings make many CPU seconds, so they are spread evenly
        return stage(counted.repartition("raw", "locale", "zone").mapInPandas(_parse_batches, "raw string, locale string, zone string, _n long, utc_us long"), "instants")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(kept)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    keys = ["raw", "locale", "zone"]
    match = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    counted = stage(counted, "writings")
    fresh = counted.select(*keys)
    if there:
        old = spark.read.schema(parse).parquet(kept)
        fresh = fresh.join(old, match(fresh, old), "left_anti")
    fresh.repartition(*keys).mapInPandas(_parse_batches, parse).write.mode("append").parquet(kept)
    known = spark.read.schema(parse).parquet(kept).dropDuplicates(keys)
    return counted.join(known, match(counted, known)).select(counted["raw"], counted["locale"], counted["zone"], "_n", "utc_us")


def normalised_instants(rows: DataFrame, kept: str | None = None) -> DataFrame:
    """Rows (src, rec_id, raw, locale, zone) to (src, rec_id, utc_us); unreadable ones drop out.

    Null, empty and undated strings have no instant. ``kept``: see ``extend_dictionary``. Rows
    with one id come out as often as they go in.
    """
    spark = rows.sparkSession
    said = rows.filter(F.col("raw").isNotNull()).select("src", "rec_id", "raw", "locale", "zone")
    book = extend_dictionary(spark, said.select("raw", "locale", "zone"), kept).filter(F.col("utc_us").isNotNull())
    # nulls in the key would not join: they become a value no locale or zone has
    plain = lambda df: df.withColumns({k: F.coalesce(k, F.lit("\u0000")) for k in ("locale", "zone")})
    return lookup(plain(said), plain(book), ["raw", "locale", "zone"], "_n").select("src", "rec_id", "utc_us")
