"""Network addresses, label trees, product codes, full text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inet_number(host: Column) -> Column:
    """An IPv4 address as a number."""
    parts = F.split(F.split_part(host, F.lit("/"), F.lit(1)), r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))


def inet_text(n: Column) -> Column:
    byte = lambda i: F.shiftrightunsigned(n, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", *[byte(i) for i in range(4)])


def masklen(net: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(net, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.lit(32))


def netmask(net: Column) -> Column:
    n = F.lit(1 << 32) - F.pow(F.lit(2.0), 32 - masklen(net)).cast("long")
    return n


def network(net: Column) -> Column:
    return F.concat(inet_text(inet_number(net).bitwiseAND(netmask(net))), F.lit("/"), masklen(net).cast("string"))


def broadcast_address(net: Column) -> Column:
    host = F.pow(F.lit(2.0), 32 - masklen(net)).cast("long") - 1
    return inet_text(inet_number(net).bitwiseOR(host))


def subnet_contains(net: Column, other: Column) -> Column:
    """>>=: other lies in net."""
    mask = netmask(net)
    return (masklen(net) <= masklen(other)) & (inet_number(net).bitwiseAND(mask) == inet_number(other).bitwiseAND(mask))


def nlevel(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, offset: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), offset + 1, n), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """@>: a is b or above it."""
    return (a == b) | b.startswith(F.concat(a, F.lit(".")))


def ean13_check_digit(digits: Column) -> Column:
    """The check digit of the first twelve digits."""
    d = lambda i: F.substring(digits, i, 1).cast("int")
    total = sum((d(i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    return (10 - total % 10) % 10



def date_bin(width_us: int, t: Column, origin: Column) -> Column:
    """Start of the bucket of width_us microseconds, counted from origin, that holds t."""
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    floor = F.floor((us(t) - us(origin)) / F.lit(width_us)) * width_us + us(origin)
    return F.timestamp_micros(floor.cast("long")).cast("timestamp_ntz")


def overlaps_periods(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """OVERLAPS: half-open, ends in either order, an instant overlaps what holds it."""
    a, b = F.least(s1, e1), F.greatest(s1, e1)
    c, d = F.least(s2, e2), F.greatest(s2, e2)
    return ((a < d) & (c < b)) | (a == c)


def num_nulls(*cols: Column) -> Column:
    return sum((c.isNull().cast("int") for c in cols), F.lit(0))


def hostmask(net: Column) -> Column:
    return inet_text(F.pow(F.lit(2.0), 32 - masklen(net)).cast("long") - 1)


def inet_merge(a: Column, b: Column) -> Column:
    """The smallest network that holds both."""
    differ = inet_number(a).bitwiseXOR(inet_number(b))
    width = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ)))
    shared = F.least(32 - width, masklen(a), masklen(b))
    step = F.pow(F.lit(2.0), 32 - shared).cast("long")
    return F.concat(inet_text(inet_number(a) - inet_number(a) % step), F.lit("/"), shared.cast("string"))


def macaddr_trunc(mac: Column) -> Column:
    """Last three bytes zero."""
    return F.concat(F.substring(mac, 1, 8), F.lit(":00:00:00"))


def common_ancestor(a: Column, b: Column) -> Column:
    """lca: the longest label path strictly above both."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    most = F.least(F.size(x), F.size(y)) - 1
    same = F.filter(F.sequence(F.lit(0), most), lambda i: F.array_join(F.slice(x, F.lit(1), i), ".") == F.array_join(F.slice(y, F.lit(1), i), "."))
    return F.array_join(F.slice(x, F.lit(1), F.array_max(same)), ".")


def justify_days(months: Column, days: Column) -> Column:
    """Thirty days make a month."""
    return F.struct((months + F.floor(days / 30)).cast("int").alias("months"), F.pmod(days, F.lit(30)).cast("int").alias("days"))


def age(a: Column, b: Column) -> Column:
    """Symbolic difference a - b of two times of a >= b: whole months, then days."""
    months = F.floor(F.months_between(a, b)).cast("int")
    return F.struct(F.floor(months / 12).cast("int").alias("years"), (months % 12).alias("months"), F.datediff(a, F.add_months(b, months)).alias("days"))


def segments_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """seg &&: closed intervals of floats."""
    return (lo1 <= hi2) & (lo2 <= hi1)
