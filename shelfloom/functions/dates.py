"""Dates from file names and tags as column expressions. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.functions.names import latin_digits

# The timestamp shapes of a file name, in order of preference.
TIMED = (
    (r"(?<![0-9])[0-9]{8}[_\-. ]*[0-9]{6}(?![0-9])", "packed", False),
    (r"(?<![0-9])[0-9]{4}[_\-.][0-9]{1,2}[_\-.][0-9]{1,2}[_\-. ]+[0-9]{1,2}[_\-.][0-9]{2}[_\-.][0-9]{2}(?![0-9])", "parts", False),
    (r"(?<![0-9])[0-9]{8}[_\-. ]+[0-9]{6}(?![0-9])", "packed", True),
    (r"(?<![0-9])[0-9]{1,2}[_\-.][0-9]{1,2}[_\-.][0-9]{4}[_\-. ]+[0-9]{1,2}[_\-.][0-9]{2}[_\-.][0-9]{2}(?![0-9])", "parts", True),
)
DATED = (
    (r"([0-9]{4})[_\-./]([0-9]{1,2})[_\-./]([0-9]{1,2})", False),
    (r"([0-9]{1,2})[_\-./]([0-9]{1,2})[_\-./]([0-9]{4})", True),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})", False),
    (r"([0-9]{2})([0-9]{2})([0-9]{4})", True),
    (r".*([0-9]{4})[_\-./]([0-9]{1,2})[_\-./]([0-9]{1,2})", False),
    (r".*([0-9]{4})([0-9]{2})([0-9]{2})", False),
)


def _stamp(year: Column, month: Column, day: Column, hour=None, minute=None, second=None) -> Column:
    """The timestamp if it is a real one of the years 1900 to 2100."""
    zero = F.lit("00")
    clock = [F.lpad(p, 2, "0") if p is not None else zero for p in (hour, minute, second)]
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2])
    inside = year.between("1900", "2100") & clock[0].between("00", "23") & clock[1].between("00", "59") & clock[2].between("00", "59")
    return F.when(inside, text.try_cast("timestamp_ntz"))


def _timed(text: Column, pattern: str, kind: str, day_first: bool) -> Column:
    """First valid timestamp among all matches of one shape."""

    def one(match: Column) -> Column:
        if kind == "packed":
            d = F.regexp_replace(match, "[^0-9]", "")
            cut = (5, 3, 1) if day_first else (1, 5, 7)
            year, month, day = F.substring(d, cut[0], 4), F.substring(d, cut[1], 2), F.substring(d, cut[2], 2)
            clock = [F.substring(d, k, 2) for k in (9, 11, 13)]
        else:
            p = F.split(match, "[^0-9]+")
            year, month, day = (p[2], p[1], p[0]) if day_first else (p[0], p[1], p[2])
            clock = [p[3], p[4], p[5]]
        return _stamp(year, month, day, *clock)

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)
    return F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0))


def _dated(text: Column, pattern: str, day_first: bool) -> Column:
    a, b, c = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return _stamp(c, b, a) if day_first else _stamp(a, b, c)


def filename_timestamp(name: Column) -> Column:
    """Date and, where one stands right behind it, time of a file name."""
    text = latin_digits(F.lower(name))
    return F.coalesce(*[_timed(text, *t) for t in TIMED], *[_dated(text, *d) for d in DATED])


def exif_timestamp(tags: Column) -> Column:
    """Original, then digitised, then plain date tag of a tag map."""
    def parsed(tag: str) -> Column:
        text = F.trim(tags[tag])
        fixed = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
        return F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), fixed.try_cast("timestamp_ntz"))

    return F.coalesce(*[parsed(t) for t in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")])


def best_date(name_date: Column, exif_date: Column, mtime: Column | None = None, oldest: bool = True) -> Column:
    """struct(ts, source): the only date there is; of two the older (or newer),
    the name's on a tie; else the modification time if given."""
    first = name_date <= exif_date if oldest else name_date >= exif_date
    made = lambda ts, source: F.struct(ts.cast("timestamp_ntz").alias("ts"), F.lit(source).alias("source"))
    rest = made(F.lit(None), "none")
    if mtime is not None:
        rest = F.when(mtime.isNotNull(), made(mtime, "modified")).otherwise(rest)
    return (
        F.when(name_date.isNotNull() & (exif_date.isNull() | first), made(name_date, "filename"))
        .when(exif_date.isNotNull(), made(exif_date, "exif"))
        .otherwise(rest)
    )


def compare_dates(a: Column, b: Column) -> Column:
    """-1, 0 or 1: earlier first, unknown last."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)


def is_day_level(ts: Column, source: Column) -> Column:
    """A name's date without a time of day."""
    return (source == "filename") & (ts == F.date_trunc("day", ts))


def stored_date(text: Column) -> Column:
    """``2020-01-02 03:04:05 (exif)`` back to its timestamp."""
    return F.substring_index(text, " (", 1).try_cast("timestamp_ntz")
