"""Substring dedup over a log-structured fingerprint index.

The index is a folder of immutable runs, each a table of (a, n, c_min, c_max) per
anchor fingerprint of window hashes (windows.py), bucketed and sorted by it;
c_max is null where it equals c_min. It can be opened again by another session.
A batch of documents becomes a new run; it is merge-joined with every older run
bucket by bucket (the older runs are not shuffled again), and fingerprints that
history or the batch itself repeats are its hits. When there are more than
`max_runs` runs they are compacted into one. Hits are then verified by hashes of
whole contents and, where those differ, of windows (see repeats.py), and every
word covered by a window that also starts elsewhere is removed.

substring_dedup() takes a table in as several batches, each against the index of
those before it, and settles all of it; new_batch() settles a batch against
documents that the index has already taken in.

Words are between ASCII white space, unchanged. A null or empty text has none.
Repeated rows repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_values, carried, col, last_stays, materialize, others, portions, schema_of, small_batches, table_path, text_key, text_or_empty, uncarried, written_tables
from .repeats import Settled, anchor_entries, keyed, merged, run_rows, spans_by_text, window_spans
from .windows import Words


ENTRIES = "a BIGINT, n BIGINT, c_min BIGINT, c_max BIGINT"


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder, merge-joined with each new batch and compacted."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, max_runs: int = 4):
        """Opens the index at `path`, or begins one; a run keeps the number of buckets that it was written with."""
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (number, buckets) of the runs, oldest first.
        self.runs: list[tuple[int, int]] = sorted((int(m[1]), int(m[2])) for f in self._finished() if (m := re.search(r"/run-(\d+)-(\d+)/_SUCCESS$", f)))

    def _finished(self) -> list[str]:
        """The marks of runs that were written to their end."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return [f.getPath().toString() for f in found] if found else []

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def _name(self, run: tuple[int, int]) -> str:
        return f"fingerprints_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{run[0]}"

    def _table(self, run: tuple[int, int]) -> DataFrame:
        """A run as a bucketed table, made known to this session where it isn't."""
        if not self.spark.catalog.tableExists(self._name(run)):
            self.spark.sql(f"CREATE TABLE {self._name(run)} ({ENTRIES}) USING parquet CLUSTERED BY (a) SORTED BY (a) INTO {run[1]} BUCKETS LOCATION '{self._folder(run)}'")
        return self.spark.table(self._name(run)).withColumn("c_max", F.coalesce("c_max", "c_min"))

    def _write(self, entries: DataFrame) -> tuple[int, int]:
        run = (self.runs[-1][0] + 1 if self.runs else 0, self.buckets)
        slim = entries.select("a", "n", "c_min", F.nullif("c_max", "c_min").alias("c_max")).repartition(self.buckets, "a")
        slim.write.bucketBy(self.buckets, "a").sortBy("a").option("path", self._folder(run)).saveAsTable(self._name(run))
        return run

    def append(self, entries: DataFrame) -> DataFrame:
        """Add a batch's entries as a run; returns its hits: entries that the batch repeats, or shares with history."""
        new = self._write(entries)
        batch = self._table(new)
        found = batch.filter("n > 1")
        for run in self.runs:
            both = batch.alias("x").join(self._table(run).hint("merge").alias("y"), "a")
            found = found.unionByName(both.select("a", (F.col("x.n") + F.col("y.n")).alias("n"), F.least("x.c_min", "y.c_min").alias("c_min"), F.greatest("x.c_max", "y.c_max").alias("c_max")))
        found = materialize(found, "fingerprint-hits")
        self.runs.append(new)
        if len(self.runs) > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones go once it is written."""
        old = self.runs
        every = reduce(DataFrame.unionByName, [self._table(run) for run in old])
        one = self._write(every.groupBy("a").agg(F.sum("n").alias("n"), F.min("c_min").alias("c_min"), F.max("c_max").alias("c_max")))
        self.runs = [*old, one]
        self._drop(old)

    def _drop(self, runs: list[tuple[int, int]]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(run))
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.runs = [r for r in self.runs if r not in runs]

    def drop(self) -> None:
        """Delete all runs."""
        self._drop(list(self.runs))


def _repeated(hits: list[DataFrame]) -> DataFrame:
    """(a, uniform) of the fingerprints among hits, and whether all their contents are equal."""
    found = reduce(DataFrame.unionByName, hits)
    return materialize(found.groupBy("a").agg((F.min("c_min") == F.max("c_max")).alias("uniform")), "substring-repeated")


def _without_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        kept, n, removed = [], [], []
        for text, x in zip(binary_values(b.column("t")), b.column("x").to_pylist(), strict=True):
            words = text.split()
            left, at = [], 0
            for s, e in merged(x or []):
                left += words[at:s]
                at = e
            left += words[at:]
            n.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "n_words", "n_removed"])


def _removed(docs: DataFrame, text_col: str, texts: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """docs without the words of windows that repeat among texts, by the fingerprints that do."""
    with written_tables(docs.sparkSession) as written:
        settled = Settled(run_rows(texts, Words, width), repeated, width, "substring")
        spans = settled.spans.unionByName(window_spans(texts, settled.open, Words, width, "substring"))
        by_text = spans_by_text(spans, "substring")
        last_stays(written)
    rest = others(docs, text_col, "n_words", "n_removed")
    rows = docs.select(carried(docs, rest).alias("row"), text_key(text_col).alias("k"), text_or_empty(text_col).alias("t"))
    out = rows.join(by_text, "k", "left").select("row", "t", "x")
    made = out.mapInArrow(_without_words, schema_of(out, ["row"], "text string, n_words long, n_removed long"))
    return made.select(*uncarried("row", rest), F.col("text").alias(text_col), "n_words", "n_removed")


def substring_dedup(docs: DataFrame, text_col: str = "text", width: int = 35, batches: int = 4, max_runs: int = 2) -> DataFrame:
    """docs with repeated windows' words removed (the others joined by one space), and n_words, n_removed.

    The documents are taken in as `batches` batches, each against the index of those before it.
    """
    texts = keyed(small_batches(docs), text_col)
    index = FingerprintIndex(docs.sparkSession, table_path(docs.sparkSession, "fingerprints"), max_runs=max_runs)
    hits = []
    for i in range(batches):
        batch = texts.filter(F.pmod(F.xxhash64("k"), F.lit(batches)) == i)
        hits.append(index.append(anchor_entries(run_rows(batch, Words, width))))
    index.drop()
    return _removed(docs, text_col, texts, _repeated(hits), width)


def new_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame | None, text_col: str = "text", width: int = 35) -> DataFrame:
    """docs as of substring_dedup(), of the windows that also start elsewhere in docs or in history; the index takes docs in.

    history holds, in text_col, what the index took in before (None: nothing). It is read again for the
    windows at the batch's hits only, which are few; its fingerprints come from the index.
    """
    texts = keyed(small_batches(docs), text_col)
    hits = index.append(anchor_entries(run_rows(texts, Words, width)))
    every = texts if history is None else texts.unionByName(keyed(history, text_col))
    return _removed(docs, text_col, every, _repeated([hits]), width)


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 35) -> DataFrame:
    """The op2 query: doc_id, n_words, n_removed, kept_sha256."""
    out = substring_dedup(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", width)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest() over `documents`.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s+34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
dup AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
pos AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
near AS (SELECT pos.*, (SELECT 1) AS one, max(dup.s) OVER (PARTITION BY pos.r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
         FROM pos LEFT JOIN dup ON pos.r = dup.r AND pos.p = dup.s),
marked AS (SELECT r, word, p, coalesce(last, -100) + 34 >= p AS gone FROM near),
k AS (SELECT r, count(*)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
