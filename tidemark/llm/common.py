"""Helpers shared by the operators of this subpackage.

A text is identified by the MD5 of its UTF-8 bytes (16 bytes): what the
duplicate removers decide about a row depends on its text alone, so verdicts
travel back to rows by that key and neither null nor repeated doc_ids matter.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space that separates words: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if conf.get("spark.master", "").startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders of tables written inside the open written_tables() scopes, innermost last.
_written: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        # What was shuffled for this table is not needed again. Spark deletes it once the driver has
        # collected its garbage, which a driver with little to do puts off for up to half an hour.
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables that operators wrote within it; store their results before.

    last_stays() exempts the one that was written last.
    """
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def first_goes(spark: SparkSession, written: list[str]) -> None:
    """The table written first in this scope isn't needed any more."""
    _delete(spark, written.pop(0))


def last_stays(written: list[str]) -> None:
    """The table written last in this scope is left to the scope around it."""
    path = written.pop()
    if len(_written) > 1:
        _written[-2].append(path)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(col(text_col).cast("string"), F.lit(""))


def text_key(text_col: str) -> Column:
    """16-byte key of a whole text; null counts as the empty text."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def others(df: DataFrame, *made: str) -> list[str]:
    """Columns of df that an operator carries along: all but those it makes itself.

    Names are compared as Spark resolves them, without regard to case.
    """
    low = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in low]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, names: list[str]) -> Column:
    """The columns `names` of df as one struct column, safe from name clashes."""
    return F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(0).alias("c0"))


def uncarried(struct: str, names: list[str]) -> list[Column]:
    return [F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(names)]


def schema_of(df: DataFrame, kept: list[str], more: str) -> T.StructType:
    """The schema of df's columns `kept`, then of the DDL `more`."""
    return T.StructType([df.schema[c] for c in kept] + T._parse_datatype_string(more).fields)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spread(df: DataFrame, per: int = 1) -> DataFrame:
    """df over at least as many partitions as the session shuffles into, by round robin."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n * per)


def in_blocks(members: DataFrame, blocks: Column, by: Column) -> DataFrame:
    """members dealt for comparing all with all: a row for each (u, v) with u <= v, one of them its own block.

    blocks says how many blocks the row's group has, `by` what a row is dealt by; any two rows of a group meet in some (u, v).
    """
    own = F.pmod(F.xxhash64(by), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda x: F.struct(F.least(own, x).alias("u"), F.greatest(own, x).alias("v")))
    return members.select("*", F.explode(pairs).alias("uv")).select(*[col(c) for c in members.columns], "uv.u", "uv.v")


#: Bytes of an Arrow batch, and of it what a Python worker unpacks at once.
BATCH_BYTES, PORTION_BYTES = 8_000_000, 2_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """df; from here on its session sends Python batches of at most BATCH_BYTES, unless it has another limit than Spark's default.

    JVM and worker each hold a batch or two a task, and rows of whole texts make large ones.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in ("67108864b", "64m", "67108864"):
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PORTION_BYTES, so that few rows at a time become Python objects."""
    for b in batches:
        step = max(1, b.num_rows * PORTION_BYTES // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        pa.default_memory_pool().release_unused()


def binary_values(column: pa.Array) -> list[bytes]:
    """A string column as a list of UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of values whose total size stays under limit, one value at least."""
    i = 0
    while i < len(values):
        j, size = i, 0
        while j < len(values) and (j == i or size + len(values[j]) <= limit):
            size += len(values[j])
            j += 1
        yield i, j
        i = j


def per_row(fn: Callable[[bytes], tuple], names: list[str], types: list[pa.DataType]) -> Callable:
    """A mapInArrow function: column `t` (text) becomes what fn returns, the rest is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            at = b.schema.get_field_index("t")
            rows = [fn(x) for x in binary_values(b.column(at))]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in rest] + cols, names=[b.schema.names[i] for i in rest] + names)

    return run


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh uint64 array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def row_count_per(df: DataFrame, rows: int, least: int = 1) -> int:
    """How many blocks of `rows` rows df needs."""
    return max(least, -(-df.count() // rows))
