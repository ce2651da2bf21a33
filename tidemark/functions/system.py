"""Identifiers, numerals, encodings, sizes, and what a session knows of itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespaces of name-based identifiers.
NAMESPACES = {"dns": uuid.NAMESPACE_DNS, "url": uuid.NAMESPACE_URL, "oid": uuid.NAMESPACE_OID, "x500": uuid.NAMESPACE_X500}


# UUIDs.
def _as_uuid(hexed: Column, version: int) -> Column:
    """32 hexadecimal digits as a UUID of a version, RFC 4122 variant."""
    digit = F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    parts = [F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.concat(F.lit(str(version)), F.substring(hexed, 14, 3)), F.concat(F.lower(F.hex(digit)), F.substring(hexed, 18, 3)), F.substring(hexed, 21, 12)]
    return F.concat_ws("-", *parts)


def _named(namespace: str) -> Column:
    return F.unhex(F.lit((NAMESPACES[namespace] if namespace in NAMESPACES else uuid.UUID(namespace)).hex))


def uuid_v3(namespace: str, name: Column) -> Column:
    return _as_uuid(F.md5(F.concat(_named(namespace), name.cast("binary"))), 3)


def uuid_v5(namespace: str, name: Column) -> Column:
    return _as_uuid(F.substring(F.sha1(F.concat(_named(namespace), name.cast("binary"))), 1, 32), 5)


def uuid_v4() -> Column:
    return F.expr("uuid()")


def uuid_version(u: Column) -> Column:
    """Null for other variants than RFC 4122's."""
    return F.when(F.substring(u, 20, 1).isin(*"89abAB"), F.conv(F.substring(u, 15, 1), 16, 10).cast("int"))


def uuid_timestamp(u: Column) -> Column:
    """The time in identifiers of version 1 and 7; null for others."""
    h = F.regexp_replace(F.lower(u), "-", "")
    number = lambda x: F.conv(x, 16, 10).cast("decimal(38,0)")
    since_1582 = number(F.concat(F.substring(h, 14, 3), F.substring(h, 9, 4), F.substring(h, 1, 8)))
    us = F.when(uuid_version(u) == 1, F.floor((since_1582 - F.lit(122192928000000000)) / 10)).when(uuid_version(u) == 7, number(F.substring(h, 1, 12)) * 1000)
    return F.timestamp_micros(us.cast("long"))


# Numerals.
def num_nonnulls(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def scale(numeral: Column) -> Column:
    """Digits after the point, of a number's text."""
    return F.length(F.regexp_extract(numeral.cast("string"), r"\.(\d*)", 1))


def trim_scale(numeral: Column) -> Column:
    """A number's text without zeros at the end of its fraction."""
    text = numeral.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def min_scale(numeral: Column) -> Column:
    return scale(trim_scale(numeral))


def random_between(low: int, high: int, seed: int | None = None) -> Column:
    """random(min, max) of integers, both included."""
    return F.floor(F.rand(seed) * (high - low + 1)).cast("long") + low


# Encodings and texts.
def convert_to(text: Column, charset: str) -> Column:
    """Bytes of a text in a character set that the JVM knows; an error for characters that it lacks."""
    return F.encode(text, charset)


def convert_from(data: Column, charset: str) -> Column:
    return F.decode(data, charset)


def to_ascii(text: Column) -> Column:
    """Letters without their marks; other characters outside ASCII become spaces."""
    bare = F.translate(text, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(bare, r"[^\x00-\x7f]", " ")


def regexp_split_to_table(text: Column, pattern: str) -> Column:
    """A row per part, to be selected."""
    return F.explode(F.split(text, pattern))


# Arrays.
def array_fill(value: Column, *sizes: int) -> Column:
    """An array, of arrays for several sizes, filled with a value."""
    for n in reversed(sizes):
        value = F.array_repeat(value, n)
    return value


def array_sample(a: Column, n: int, seed: int | None = None) -> Column:
    """n elements in random order; an error if there are fewer."""
    return F.when(F.size(a) >= n, F.slice(F.shuffle(a, seed), 1, n)).otherwise(F.raise_error(F.lit("sample size must be between 0 and the array's length")))


def int_array_enum(a: Column) -> Column:
    return F.explode(a)


# Sizes.
def size_pretty(n: Column, largest: str = "PB") -> Column:
    """Bytes in the largest unit, up to `largest`, that keeps them from 10 units up, rounded half up."""
    n = n.cast("decimal(38,0)")
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    units = ("kB", "MB", "GB", "TB", "PB")
    for i, u in enumerate(units[: units.index(largest) + 1], 1):
        shown = F.floor((n / F.lit(1024**i) + F.lit(0.5)).cast("decimal(38,6)"))
        # The unit below would show 10240 or more.
        out = F.when(F.abs(n) >= 10240 * 1024 ** (i - 1) - (0 if i == 1 else 512 * 1024 ** (i - 2)), F.concat(shown.cast("string"), F.lit(f" {u}"))).otherwise(out)
    return out


def size_bytes(text: Column) -> Column:
    unit = F.lower(F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1))
    scale_ = F.coalesce(F.create_map(*[x for i, u in enumerate(("bytes", "kb", "mb", "gb", "tb", "pb")) for x in (F.lit(u), F.lit(float(1024**i)))])[unit], F.lit(1.0))
    return F.round(F.regexp_extract(text, r"^\s*(-?[\d.]+)", 1).cast("double") * scale_).cast("long")


# The session.
def setting(spark: SparkSession, name: str, missing_ok: bool = False) -> str | None:
    """current_setting."""
    return spark.conf.get(name, None) if missing_ok else spark.conf.get(name)


def set_setting(spark: SparkSession, name: str, value: str) -> str:
    """set_config: returns the new value."""
    spark.conf.set(name, value)
    return spark.conf.get(name)


def session_info(spark: SparkSession) -> DataFrame:
    """One row: user, catalog, schema and version."""
    return spark.sql("SELECT current_user() AS current_user, session_user() AS session_user, current_catalog() AS current_catalog, current_schema() AS current_schema, version() AS version")


def partition_tree(spark: SparkSession, path: str) -> DataFrame:
    """(relid, parentrelid, isleaf, level) of a partitioned table's folders; a table without partitions is its own leaf."""
    files = spark.read.parquet(path).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).distinct()
    below = F.regexp_extract("folder", r"((?:/[^/=]+=[^/]*)*)$", 1)
    steps = F.filter(F.split(below, "/"), lambda x: x != "")
    at = lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    nodes = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(at(i).alias("relid"), F.when(i > 0, at(i - 1)).alias("parentrelid"), (i == F.size(steps)).alias("isleaf"), i.alias("level")))).alias("n"))
    return nodes.select("n.*").distinct()
