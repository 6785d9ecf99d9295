"""Date and time functions.  A null argument gives null; timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.strings import col

# Names of date parts and what they stand for.
UNITS = {
    "YEAR": "YEAR", "YYYY": "YEAR", "YY": "YEAR", "SQL_TSI_YEAR": "YEAR", "MONTH": "MONTH", "MM": "MONTH", "M": "MONTH", "SQL_TSI_MONTH": "MONTH", "SQL_TSI_WEEK": "WEEK", "WW": "WEEK", "WK": "WEEK",
    "WEEK": "WEEK", "DAY": "DAY", "DD": "DAY", "D": "DAY", "SQL_TSI_DAY": "DAY", "DAYOFYEAR": "DAY_OF_YEAR", "DAY_OF_YEAR": "DAY_OF_YEAR", "DY": "DAY_OF_YEAR", "DOY": "DAY_OF_YEAR",
    "SQL_TSI_HOUR": "HOUR", "HOUR": "HOUR", "HH": "HOUR", "SQL_TSI_MINUTE": "MINUTE", "MINUTE": "MINUTE", "MI": "MINUTE", "N": "MINUTE", "SQL_TSI_SECOND": "SECOND", "SECOND": "SECOND",
    "SS": "SECOND", "S": "SECOND", "MILLISECOND": "MILLISECOND", "MS": "MILLISECOND",
}


def unit_of(name: str) -> str:
    try:
        return UNITS[name.upper()]
    except KeyError:
        raise ValueError(f"no such date part: {name}") from None


def stamp(x) -> Column:
    return col(x).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def millis(ts: Column) -> Column:
    """Whole milliseconds since 1970."""
    return seconds(ts) * 1000 + F.date_format(ts, "SSS").cast("long")


def dateadd(unit: str, n, ts) -> Column:
    """Add whole units; the day of the month is kept where the month has it, else its last day is taken."""
    u, k, t = unit_of(unit), col(n).cast("int"), stamp(ts)
    if u == "YEAR":
        return t + F.make_ym_interval(k, F.lit(0))
    if u == "MONTH":
        return t + F.make_ym_interval(F.lit(0), k)
    parts = {"WEEK": (k * 7, 0, 0, 0), "DAY": (k, 0, 0, 0), "DAY_OF_YEAR": (k, 0, 0, 0), "HOUR": (0, k, 0, 0), "MINUTE": (0, 0, k, 0), "SECOND": (0, 0, 0, k), "MILLISECOND": (0, 0, 0, k / 1000)}[u]
    return t + F.make_dt_interval(*[col(p) for p in parts])


def datediff(unit: str, a, b) -> Column:
    """How many boundaries of the unit lie from a to b: the last day of a month and the next day are one month apart."""
    u, x, y = unit_of(unit), stamp(a), stamp(b)
    if u == "YEAR":
        return (F.year(y) - F.year(x)).cast("long")
    if u == "MONTH":
        return ((F.year(y) * 12 + F.month(y)) - (F.year(x) * 12 + F.month(x))).cast("long")
    days = F.datediff(y.cast("date"), x.cast("date")).cast("long")
    if u in ("DAY", "DAY_OF_YEAR"):
        return days
    if u == "WEEK":  # weeks begin on Monday
        monday = lambda t: F.floor((F.datediff(t.cast("date"), F.lit("1970-01-05").cast("date"))) / 7)
        return (monday(y) - monday(x)).cast("long")
    if u == "MILLISECOND":
        return millis(y) - millis(x)
    size = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[u]
    return (F.floor(seconds(y) / size) - F.floor(seconds(x) / size)).cast("long")


def extract(unit: str, ts) -> Column:
    """A date part as an integer."""
    t = stamp(ts)
    return {
        "YEAR": F.year, "MONTH": F.month, "WEEK": F.weekofyear, "DAY": F.dayofmonth, "DAY_OF_YEAR": F.dayofyear, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
        "MILLISECOND": lambda x: F.date_format(x, "SSS").cast("int"),
    }[unit_of(unit)](t)


def week(d) -> Column:
    """The week of the year by the ISO rule."""
    return F.weekofyear(col(d))


def week_us(d) -> Column:
    """The week of the year where weeks begin on Sunday and the first has January 1; last days may be in week 1."""
    day = col(d).cast("date")
    january = F.trunc(day, "year")
    raw = F.floor((F.dayofyear(day) + F.dayofweek(january) - 2) / 7).cast("int") + 1
    next_january = F.add_months(january, 12)
    return F.when(F.datediff(next_january, day) <= F.dayofweek(next_january) - 1, 1).otherwise(raw)


def formatdatetime(ts, pattern: str, locale: str = "en", zone: str | None = None) -> Column:
    """A timestamp by a pattern; with a zone, the time there of a timestamp of the session's zone.  Names are English."""
    if locale[:2].lower() != "en":
        raise ValueError("names are English only")
    t = col(ts)
    if zone is None:
        return F.date_format(t, pattern)
    moved = F.convert_timezone(F.current_timezone(), F.lit(zone), t.cast("timestamp_ntz"))
    return F.date_format(moved, pattern.replace("zzz", "z").replace("z", f"'{zone}'")) if "z" in pattern else F.date_format(moved, pattern)


def parsedatetime(s, pattern: str, locale: str = "en", zone: str | None = None) -> Column:
    """A timestamp of the session's zone from text by a pattern; names of weekdays and a literal zone at the end are passed over."""
    if locale[:2].lower() != "en":
        raise ValueError("names are English only")
    t, p = col(s).cast("string"), pattern
    if p.lstrip().startswith("E"):
        t, p = F.regexp_replace(t, r"^\s*[A-Za-z]+,?\s*", ""), p.lstrip().lstrip("E").lstrip(", ")
    if p.rstrip().endswith("z"):
        t, p = F.regexp_replace(t, r"\s*[A-Za-z/_]+$", ""), p.rstrip().rstrip("z").rstrip()
        zone = zone or "GMT"
    parsed = F.to_timestamp_ntz(t, F.lit(p))
    return parsed if zone is None else F.convert_timezone(F.lit(zone), F.current_timezone(), parsed)


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d))


def iso_day_of_week(d) -> Column:
    return F.weekday(col(d)) + 1


def current_timestamp(scale: int = 6) -> Column:
    """The query's start, cut to so many decimals of a second."""
    now = F.localtimestamp()
    return now if scale >= 6 else F.date_trunc("SECOND", now) if scale == 0 else F.date_trunc("MILLISECOND", now)


def current_time() -> Column:
    return F.current_time()


def dayname(d) -> Column:
    return F.date_format(col(d), "EEEE")


def monthname(d) -> Column:
    return F.date_format(col(d), "MMMM")


def _part(f):
    return lambda d: f(col(d))


FUNCTIONS = {
    "CURRENT_DATE": F.current_date, "CURDATE": F.current_date, "GETDATE": F.current_date, "CURRENT_TIME": current_time, "CURTIME": current_time, "CURRENT_TIMESTAMP": current_timestamp,
    "NOW": current_timestamp, "DATEADD": dateadd, "TIMESTAMPADD": dateadd, "DATEDIFF": datediff, "TIMESTAMPDIFF": datediff, "DAYNAME": dayname, "DAY": _part(F.dayofmonth),
    "DAY_OF_MONTH": _part(F.dayofmonth), "DAY_OF_WEEK": _part(F.dayofweek), "DAY_OF_YEAR": _part(F.dayofyear), "DAYOFMONTH": _part(F.dayofmonth), "DAYOFWEEK": _part(F.dayofweek),
    "DAYOFYEAR": _part(F.dayofyear), "HOUR": _part(F.hour), "MINUTE": _part(F.minute), "MONTH": _part(F.month), "MONTHNAME": monthname, "QUARTER": _part(F.quarter), "SECOND": _part(F.second),
    "WEEK": week, "YEAR": _part(F.year), "EXTRACT": extract, "FORMATDATETIME": formatdatetime, "PARSEDATETIME": parsedatetime, "ISO_YEAR": iso_year, "ISO_WEEK": week,
    "ISO_DAY_OF_WEEK": iso_day_of_week,
}
