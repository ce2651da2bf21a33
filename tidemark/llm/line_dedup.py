"""Line dedup: drop lines that many documents share.

Lines are exploded and normalised, each distinct key of a row becomes one
16-byte hash, hashes are counted per document with map-side combining, and the
hashes over the threshold are joined back to the texts that hold them. A text
is then reassembled from its remaining lines in their original positions.

Every row is a document of its own, repeated rows included. A null or empty
text is one empty line; empty keys never count. Rows with the same text get
the same result. Columns named like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, carried, col, materialize, others, portions, schema_of, small_batches, text_key, text_or_empty, uncarried


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z in lower case; other characters unchanged."""
    return line.strip().lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            keys, hashes = [], []
            for k, text in zip(b.column(0).to_pylist(), binary_values(b.column(1)), strict=True):
                found = set(map(line_key, text.split(b"\n")))
                if min_chars > 1:
                    found = {x for x in found if len(x.decode("utf-8", "replace")) >= min_chars}
                found.discard(b"")
                hashes.extend(map(_hash, found))
                keys.extend([k] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], names=["k", "h"])

    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        kept, n_lines, n_dropped = [], [], []
        names = b.schema.names
        for text, drop in zip(binary_values(b.column(names.index("t"))), b.column(names.index("drop")).to_pylist(), strict=True):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [x for x in lines if _hash(line_key(x)) not in drop]
                text = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [b.column(names.index("row")), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=["row", "text", "n_lines", "n_dropped"],
        )


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with lines found in at least min_docs documents removed, and n_lines, n_dropped."""
    lines = small_batches(docs).select(text_key(text_col).alias("k"), text_or_empty(text_col).alias("t")).mapInArrow(_line_hashes(min_chars), "k binary, h binary")
    common = materialize(lines.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h"), "line-common")
    drops = materialize(lines.join(common, "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias("drop")), "line-drops")
    rest = others(docs, text_col, "n_lines", "n_dropped")
    rows = docs.select(carried(docs, rest).alias("row"), text_key(text_col).alias("k"), text_or_empty(text_col).alias("t"))
    out = rows.join(drops, "k", "left").select("row", "t", "drop")
    made = out.mapInArrow(_reassemble, schema_of(out, ["row"], "text string, n_lines bigint, n_dropped bigint"))
    return made.select(*uncarried("row", rest), F.col("text").alias(text_col), "n_lines", "n_dropped")


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The digest columns of the op1 query."""
    out = line_dedup(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", min_docs, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest() over `documents`.
LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, pos, lines[pos] AS line,
        translate(trim(lines[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
            FROM (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d))),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT any_value(l.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM l LEFT JOIN f USING (key) GROUP BY l.r)
"""
