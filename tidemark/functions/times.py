"""Dates, times and intervals beyond Spark's own: current times, intervals of months, days and microseconds, and patterns.

An interval is struct(months int, days int, us bigint); a time of day is its
microseconds since midnight.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US
FIELDS = ("now", "statement_timestamp", "clock_timestamp", "transaction_timestamp", "current_timestamp", "localtimestamp", "current_date", "current_time", "localtime")


def current(what: str) -> Column:
    """now() and its kin: fixed for a query, as Spark evaluates them once; clock_timestamp() too."""
    if what not in FIELDS:
        raise ValueError(what)
    if what == "localtimestamp":
        return F.localtimestamp()
    if what == "current_date":
        return F.current_date()
    if what in ("current_time", "localtime"):
        local = F.localtimestamp()
        return time_of(F.hour(local), F.minute(local), F.second(local).cast("double"))
    return F.current_timestamp()


def time_of(hour: Column, minute: Column, second: Column) -> Column:
    """make_time."""
    return (hour.cast("long") * 3600 + minute.cast("long") * 60) * US + F.round(second * US).cast("long")


def time_text(us: Column) -> Column:
    """HH:MM:SS, with a fraction if there is one."""
    part = lambda n, w: F.lpad(n.cast("string"), w, "0")
    clock = F.concat_ws(":", part(F.floor(us / (3600 * US)), 2), part(F.floor(us / (60 * US)) % 60, 2), part(F.floor(us / US) % 60, 2))
    return F.when(us % US == 0, clock).otherwise(F.concat(clock, F.lit("."), F.rtrim(part(us % US, 6), F.lit("0"))))


def is_finite(t: Column) -> Column:
    """False for the largest and smallest values, which stand for infinity; null for null."""
    return ~t.cast("string").isin("+294247-01-10 04:00:54.775807", "-290308-12-21 19:59:05.224192", "infinity", "-infinity")


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(lit(months, "int").alias("months"), lit(days, "int").alias("days"), lit(us, "bigint").alias("us"))


def _toward_zero(a: Column, b: int) -> Column:
    return F.when(a >= 0, F.floor(a / b)).otherwise(F.ceil(a / b)).cast("long")


def justify_hours(i: Column) -> Column:
    """Whole days out of the time; both end with one sign."""
    days, us = i.days + _toward_zero(i.us, DAY_US), i.us - _toward_zero(i.us, DAY_US) * DAY_US
    step = F.when((days > 0) & (us < 0), 1).when((days < 0) & (us > 0), -1).otherwise(0)
    return interval(i.months, days - step, us + step * F.lit(DAY_US))


def justify_days(i: Column) -> Column:
    """Months of 30 days out of the days; both end with one sign."""
    months, days = i.months + _toward_zero(i.days, 30), i.days - _toward_zero(i.days, 30) * 30
    step = F.when((months > 0) & (days < 0), 1).when((months < 0) & (days > 0), -1).otherwise(0)
    return interval(months - step, days + step * 30, i.us)


def justify_interval(i: Column) -> Column:
    """Days out of the time, months out of the days, and one sign throughout."""
    days, us = i.days + _toward_zero(i.us, DAY_US), i.us - _toward_zero(i.us, DAY_US) * DAY_US
    months, days = i.months + _toward_zero(days, 30), days - _toward_zero(days, 30) * 30
    step = F.when((months > 0) & ((days < 0) | ((days == 0) & (us < 0))), 1).when((months < 0) & ((days > 0) | ((days == 0) & (us > 0))), -1).otherwise(0)
    months, days = months - step, days + step * 30
    step = F.when((days > 0) & (us < 0), 1).when((days < 0) & (us > 0), -1).otherwise(0)
    return interval(months, days - step, us + step * F.lit(DAY_US))


def interval_length(i: Column) -> Column:
    """Microseconds by which intervals compare: months of 30 days, days of 24 hours."""
    return ((i.months.cast("decimal(38,0)") * 30 + i.days) * DAY_US + i.us).cast("decimal(38,0)")


def interval_cmp(a: Column, b: Column) -> Column:
    return F.signum((interval_length(a) - interval_length(b)).cast("double")).cast("int")


#: Template patterns of timestamps and the pattern letters of date_format for them.
PATTERNS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm",
    "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "MON": "MMM", "MONTH": "MMMM", "DY": "EEE", "DAY": "EEEE", "Q": "q",
}


def to_char(t: Column, template: str) -> Column:
    """to_char of timestamps: the patterns above, ISO week and year, Julian day, FM, TH and quoted text; case of names follows the pattern."""
    names = sorted([*PATTERNS, "IYYY", "IW", "ID", "J", "D", "W", "WW", "CC", "SSSS"], key=len, reverse=True)
    found = re.finditer(rf'"(?P<text>[^"]*)"|(?P<fm>FM)?(?P<name>{"|".join(names)})(?P<th>TH|th)?|(?P<other>.)', template, re.I | re.S)
    parts = []
    for m in found:
        if m["name"] is None:
            parts.append(F.lit(m["text"] if m["text"] is not None else m["other"]))
            continue
        name, short = m["name"].upper(), m["fm"] is not None
        if name in ("MON", "MONTH", "DY", "DAY", "AM", "PM"):
            value = F.date_format(t, PATTERNS[name])
            value = F.upper(value) if m["name"].isupper() else F.lower(value) if m["name"].islower() else F.initcap(value)
            parts.append(F.rpad(value, 9, " ") if name in ("MONTH", "DAY") and not short else value)
            continue
        numbers = {
            "IYYY": (F.extract(F.lit("YEAROFWEEK"), t), 4), "IW": (F.weekofyear(t), 2), "ID": (F.weekday(t) + 1, 1), "J": (F.datediff(t, F.lit("1970-01-01").cast("date")) + 2440588, 1),
            "D": (F.dayofweek(t), 1), "W": (F.floor((F.dayofmonth(t) - 1) / 7) + 1, 1), "WW": (F.floor((F.dayofyear(t) - 1) / 7) + 1, 2), "CC": (F.floor((F.year(t) + 99) / 100), 2),
            "SSSS": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), 1),
        }
        if name in numbers:
            n, wide = numbers[name]
            value = n.cast("string") if short or wide == 1 else F.lpad(n.cast("string"), wide, "0")
        else:
            value = F.date_format(t, PATTERNS[name])
            value = F.regexp_replace(value, "^0+(?=.)", "") if short else value
        if m["th"]:
            n = value.cast("int")
            end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
            value = F.concat(value, F.upper(end) if m["th"].isupper() else end)
        parts.append(value)
    return F.concat(*parts) if parts else F.lit("")
