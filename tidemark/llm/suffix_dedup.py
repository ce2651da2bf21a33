"""Suffix-array dedup: deep-shallow sorting of the suffixes that may repeat.

Suffixes are sampled: a repeated string of `width` bytes holds an anchor at
the same place in both occurrences (see windows.py), so only suffixes that
start at anchors which occur twice need sorting, and only where their runs
differ in content (see repeats.py). The suffixes of one anchor make a bucket.
A bucket is sorted by multikey quicksort, eight bytes at a time, to a shallow
depth; groups that still agree there have long common prefixes and are ordered
by a blind trie, which branches on single bytes and compares a new suffix with
one leaf in full. From the sorted order, the common prefixes of neighbours, and
the common extension to the left within each interval of equal prefix follow,
for each suffix exactly, the strings around its anchor that start elsewhere too.

A bucket of more than `bucket_rows` different contents (text around a very
common passage), some 5 MB, would land in one task; its strings are settled by grouping
two hashes of each string instead, which spreads over tasks, with the same result.

Texts are UTF-8 bytes. What is left of a character that is cut goes as bytes:
kept bytes are binary, and without_repeats() leaves broken characters out. A null or empty text has no bytes. Repeated rows repeat each other.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, carried, col, first_goes, last_stays, materialize, others, portions, schema_of, small_batches, text_key, text_or_empty, uncarried, written_tables
from .repeats import SPAN, Settled, anchor_entries, keyed, merged, run_rows, spans_by_text, window_spans, with_text
from .windows import Bytes

WORD = 8
SHALLOW = 96


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share a long prefix; inner nodes know their depth and branch bytes only."""

    END = -1

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None
        self.equal: dict[int, list[int]] = {}

    def _branch(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else self.END

    def insert(self, i: int) -> None:
        self.equal[i] = [i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while isinstance(node, list):
            depth, children = node
            node = children.get(self._branch(i, depth)) if self._branch(i, depth) in children else next(iter(children.values()))
        s, other = self.strings[i], self.strings[node]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            self.equal[node].append(i)
            return
        parent, key, here = None, 0, self.root
        while isinstance(here, list) and here[0] < n:
            parent, key = here, self._branch(i, here[0])
            here = here[1][key]
        if isinstance(here, list) and here[0] == n:
            here[1][self._branch(i, n)] = i
            return
        split = [n, {self._branch(node, n): here, self._branch(i, n): i}]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def order(self) -> list[int]:
        out: list[int] = []
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += self.equal[node]
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW, depth: int = 0) -> list[int]:
    """Positions of the strings in order."""
    out: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), depth)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1:
            out += rows
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in rows:
                trie.insert(i)
            out += trie.order()
            continue
        keys = [strings[i][depth : depth + WORD] for i in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, x in zip(rows, keys, strict=True) if x < pivot]
        same = [i for i, x in zip(rows, keys, strict=True) if x == pivot]
        more = [i for i, x in zip(rows, keys, strict=True) if x > pivot]
        todo.append((more, depth))
        if len(pivot) < WORD:
            todo.append((same[:1], depth))
            if len(same) > 1:
                # Strings that end here together are equal; they stand next to each other.
                todo[-1:] = [([i], depth) for i in reversed(same)]
        else:
            todo.append((same, depth + WORD))
        todo.append((less, depth))
    return out


def bucket_spans(members: list[tuple[bytes, int, bool]], width: int) -> list[list[tuple[int, int]]]:
    """For each (content, anchor's place in it, wanted): spans around the anchor, relative to it, that another member has too."""
    spans: list[list[tuple[int, int]]] = [[] for _ in members]
    right = [c[p:] for c, p, _ in members]
    left = [c[:p][::-1] for c, p, _ in members]
    if len(members) == 2:
        r, n = common_prefix(right[0], right[1]), common_prefix(left[0], left[1])
        if r + n >= width:
            spans[:] = [[(-n, r)], [(-n, r)]]
        return spans
    order = deep_shallow_order(right, SHALLOW)
    prefix = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = {i: r for r, i in enumerate(sorted(range(len(members)), key=left.__getitem__))}

    def settle(rows: list[int], depth: int) -> None:
        """All rows agree for `depth` bytes to the right; how far does each agree with its nearest to the left?"""
        rows = sorted(rows, key=by_left.__getitem__)
        near = [common_prefix(left[a], left[b]) for a, b in zip(rows, rows[1:], strict=False)]
        for x, i in enumerate(rows):
            if members[i][2]:
                n = max(near[x - 1] if x else 0, near[x] if x < len(near) else 0)
                if n + depth >= width:
                    spans[i].append((-n, depth))

    # Intervals of equal prefix, each once, by a stack of open intervals.
    stack: list[tuple[int, int]] = []
    for x, depth in enumerate([*prefix, 0]):
        begin = x
        while stack and stack[-1][1] > depth:
            begin, d = stack.pop()
            settle(order[begin : x + 1], d)
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((begin, depth))
    return spans


def _contexts(width: int):
    def run(k: bytes, text: bytes, x: list[dict]) -> Iterator[pa.RecordBatch]:
        n = len(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k] * n, pa.binary()),
                pa.array([r["a"] for r in x], pa.int64()),
                pa.array([r["m"] == 1 for r in x], pa.bool_()),
                pa.array([r["at"] for r in x], pa.int32()),
                pa.array([r["at"] - r["lo"] for r in x], pa.int32()),
                pa.array([text[r["lo"] : r["hi"] + width] for r in x], pa.binary()),
            ],
            names=["k", "a", "wanted", "at", "place", "content"],
        )

    return run


def _sorted_buckets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[dict] = []
        out: list[tuple[bytes, int, int]] = []

        def close() -> None:
            found = bucket_spans([(r["content"], r["place"], r["wanted"]) for r in bucket], width)
            out.extend((r["k"], r["at"] + s, r["at"] + e) for r, spans in zip(bucket, found, strict=True) if r["wanted"] for s, e in spans)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["k", "s", "e"]
            )
            out.clear()
            return made

        for b in portions(batches):
            for r in b.to_pylist():
                if bucket and r["a"] != bucket[0]["a"]:
                    close()
                    bucket = []
                # Another copy of a text may have been met by another task.
                if not bucket or any(r[c] != bucket[-1][c] for c in ("k", "at", "place")):
                    bucket.append(r)
            yield batch()
        if bucket:
            close()
            yield batch()

    return run


def suffix_spans(texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Spans of the open rows, bucket by bucket."""
    contexts = with_text(texts, rows, _contexts(width), "a m lo hi at", "k binary, a long, wanted boolean, at int, place int, content binary")
    dealt = contexts.repartition(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")
    sorted_ = dealt.sortWithinPartitions("a", "k", "at", "place")
    return sorted_.mapInArrow(_sorted_buckets(width), SPAN)


def _without_bytes(whole: bool):
    """Kept bytes and counts; whole: as text, without what is left of a character that was cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            kept, n, removed, count = [], [], [], []
            for text, x in zip(binary_values(b.column("t")), b.column("x").to_pylist(), strict=True):
                spans = merged(x or [])
                parts, at = [], 0
                for s, e in spans:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if whole else left)
                n.append(len(text))
                removed.append(len(text) - len(left))
                count.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(kept, pa.string() if whole else pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return run


def suffix_dedup(docs: DataFrame, text_col: str = "text", width: int = 400, bucket_rows: int = 4096, whole: bool = False) -> DataFrame:
    """docs with `kept` (binary; with `whole` a string of whole characters) and n_bytes, n_removed, n_spans: repeated strings of `width` bytes removed."""
    texts = keyed(small_batches(docs), text_col)
    with written_tables(docs.sparkSession) as written:
        runs = materialize(run_rows(texts, Bytes, width), "suffix-windows")
        entries = anchor_entries(runs).filter("n > 1")
        repeated = materialize(entries.select("a", (F.col("c_min") == F.col("c_max")).alias("uniform")), "suffix-repeated")
        settled = Settled(runs, repeated, width, "suffix")
        first_goes(docs.sparkSession, written)  # the runs
        spans = settled.spans.unionByName(suffix_spans(texts, settled.open.filter(F.col("contents") <= bucket_rows), width))
        large = settled.open.filter(F.col("contents") > bucket_rows)
        if not large.isEmpty():
            spans = spans.unionByName(window_spans(texts, large, Bytes, width, "suffix"))
        by_text = spans_by_text(spans, "suffix")
        last_stays(written)
    rest = others(docs, "kept", "n_bytes", "n_removed", "n_spans")
    rows = docs.select(carried(docs, rest).alias("row"), text_key(text_col).alias("k"), text_or_empty(text_col).alias("t"))
    out = rows.join(by_text, "k", "left").select("row", "t", "x")
    made = out.mapInArrow(_without_bytes(whole), schema_of(out, ["row"], f"kept {'string' if whole else 'binary'}, n_bytes long, n_removed long, n_spans long"))
    return made.select(*uncarried("row", rest), "kept", "n_bytes", "n_removed", "n_spans")


def without_repeats(docs: DataFrame, text_col: str = "text", width: int = 400) -> DataFrame:
    """docs with repeated strings of `width` bytes removed from their texts."""
    rest = others(docs, text_col)
    out = suffix_dedup(docs.select(carried(docs, rest).alias("row"), col(text_col).alias("t")), "t", width, whole=True)
    return out.select(*uncarried("row", rest), F.col("kept").alias(text_col))


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 400) -> DataFrame:
    """The op6 query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", width)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
