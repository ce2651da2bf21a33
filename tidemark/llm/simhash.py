"""SimHash near-dedup over a byte-position inverted index with count filtering.

A text's words give word shingles (repeats included), each hashed by XXH64;
a bit of the 64-bit fingerprint is 1 if more than half of the hashes have it.
Fingerprints link when at most `max_distance` bits differ, which the index of
position_index.py finds.

Words are between ASCII white space, A-Z in lower case. A text of fewer words
than a shingle has one shingle, the whole sequence; a text without words (null
or empty included) has fingerprint zero and links like any other. A component
is named by the smallest doc_id in it; null ids are passed over, and a
component of null ids only has a null name. Repeated rows are rows of their
own. An empty table gives an empty result.

one_per_group() keeps a row of each group of texts whose shingles are similar.
Links are its candidates, verified on shingles; what links leave apart is then
joined on shingles (shingle_join.py), so that no similar pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, col, last_stays, materialize, per_row, small_batches, text_key, text_or_empty, uncarried, written_tables
from .components import components
from .position_index import links
from .shingle_join import join_groups, unseen, verified, word_sets


def shingles(text: bytes, n: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -n].tolist()]
    return [line[a : b - 1] for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """The 64 bits as a signed integer."""
    if not features:
        return 0
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(features), 65536):
        part = features[i : i + 65536]
        packed = np.frombuffer(b"".join([digest(x, seed) for x in part]), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(packed, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(features)).tobytes(), "big", signed=True)


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = 4,
    max_distance: int = 4,
    seed: int = 42,
    key_bytes: int = 3,
) -> DataFrame:
    """(doc_id, fp long, component_id): a row of docs each."""
    read = docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = materialize(read.mapInArrow(per_row(lambda t: (fingerprint(shingles(t, shingle), seed),), ["fp"], [pa.int64()]), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    edges = links(fps.select("fp"), max_distance, key_bytes)
    roots = components(edges, "simhash-components")
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = materialize(named, "simhash-named")
    names = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    by_fp = materialize(named.join(names, "root").select("fp", "component_id"), "simhash-by-fp")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, fp): a fingerprint of each text's distinct words."""
    for keys, texts in unseen(batches):
        found = []
        for _, words in word_sets(texts, 1):
            votes = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            found.append(np.packbits(votes * 2 > len(words)).view(np.int64)[0])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.int64())], names=["k", "fp"])


def similar_groups(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_distance: int = 4, key_bytes: int = 3) -> DataFrame:
    """(k, root): groups of the texts k that have a similar one, as components of verified pairs.

    Fingerprints of distinct words change little where a word is edited, so most
    texts that share most of their shingles link at max_distance. Links are
    candidates: a pair stays only if the Jaccard similarity of the two texts'
    distinct word shingles is at least `similarity`. What they leave apart is
    then joined on shingles: the groups are those of all similar pairs.
    Texts without words are similar to each other.
    """
    texts = small_batches(docs).select(text_key(text_col).alias("k"), text_or_empty(text_col).alias("t"))
    prints = materialize(texts.mapInArrow(_word_prints, "k binary, fp long"), "similar-prints")
    first = materialize(prints.groupBy("fp").agg(F.min("k").alias("rep"), F.max("k").alias("last")), "similar-fps")
    same = prints.join(first.filter("rep <> last"), "fp").filter("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    near = links(first.select("fp"), max_distance, key_bytes, and_nearest=True).distinct()
    near = near.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("ka")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("kb")), "b")
    pairs = same.unionByName(near.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-pairs")
    found = materialize(verified(texts, pairs, shingle, similarity), "similar-found")
    roots = components(found, "similar-components")
    more = materialize(join_groups(texts, roots, shingle, similarity), "similar-more")
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(joined, "similar-components").withColumnRenamed("node", "k")


def one_per_group(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id, nulls last; copies are similar.

    Of rows that share that id and text, any one stays.
    """
    with written_tables(docs.sparkSession) as written:
        roots = materialize(similar_groups(docs, text_col, **how), "similar-roots")
        last_stays(written)
    keys = docs.select(text_key(text_col).alias("k"), col(id_col).alias("id"))
    grouped = keys.distinct().join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("b"))
    best = materialize(best.select("b.k", F.col("b.id").alias("best")), "similar-kept")
    rows = docs.select(text_key(text_col).alias("k"), col(id_col).alias("id"), carried(docs, docs.columns).alias("row"))
    kept = rows.join(best, "k").filter(F.col("id").eqNullSafe(F.col("best"))).dropDuplicates(["k"])
    return kept.select(*uncarried("row", docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the op7 query."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
