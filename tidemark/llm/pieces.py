"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model file is read by its public wire format. A text's white space becomes
the word mark, and it falls into segments that no piece crosses: a segment
starts with a run of marks, or with a line feed, which no piece contains. Each
segment that a worker hasn't met yet is encoded once, all of them together:
their symbols lie in one flat numpy array; in each round every segment finds
the least rank among its adjacent pairs (a segmented minimum), merges all its
leftmost non-overlapping pairs of that rank at once, and the array is
compacted, until no pair is left that the model knows. Where merging one
occurrence at a time could differ (two pieces of one rank, or a merge that
creates a pair of a better rank while others of its own were merged), the
segment is encoded by the queue of single merges instead.

Characters without a piece become byte pieces. An empty or null text has no
piece but the end id. Texts of any length are worked through in slices.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_values, carried, col, others, portions, schema_of, slices, text_or_empty, uncarried

MARK = "▁"
#: Text worked through at once, and segments remembered by a worker, both to bound its memory.
SLICE_BYTES = 2_000_000
REMEMBERED = 200_000


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if data[i - 1] < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protocol buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, i = _varint(data, i)
            value = data[i : i + size]
            i += size
        yield tag >> 3, value


class PieceModel:
    """Pieces, ranks and merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in message if k == 2)))
        normalizer = dict(_fields(next(v for k, v in message if k == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation")
        self.eos = trainer.get(42, 2)
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        kinds = [p.get(3, 1) for p in pieces]
        if not set(kinds) <= {1, 2, 3, 6}:
            raise ValueError("user defined and unused pieces are not supported")
        self.text = [p[1].decode() for p in pieces]
        self.byte_ids = {int(self.text[i][1:-1], 16): i for i, k in enumerate(kinds) if k == 6}
        self.bytes_of = [t.encode() for t in self.text]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        # What a piece shows by itself; None for bytes, which only together make characters.
        self.plain_of = [None if k == 6 else t.replace(MARK, " ") for t, k in zip(self.text, kinds, strict=True)]
        self.numeral = list(map(str, range(len(self.text))))
        score = {self.text[i]: (struct.unpack("<f", pieces[i][2])[0], i) for i, k in enumerate(kinds) if k == 1}
        if any("\n" in t for t in score) or any(MARK in t.lstrip(MARK) for t in score):
            raise ValueError("a piece crosses a line feed or an inner word mark")
        self.ids = {t: i for t, (_, i) in score.items()}
        levels = {s: r for r, s in enumerate(sorted({s for s, _ in score.values()}, reverse=True))}
        self.rank = {t: levels[s] for t, (s, _) in score.items()}
        held = np.bincount(list(self.rank.values()))
        self.tied = held > 1
        # Symbols: piece ids, then characters that are no pieces themselves but occur in some.
        self.symbol = dict(self.ids)
        for t in score:
            for c in t:
                self.symbol.setdefault(c, len(self.text) + len(self.symbol))
        self.many = max(self.symbol.values()) + 2
        self.other = self.many - 1
        found = [(self.symbol[t[:k]] * self.many + self.symbol[t[k:]], self.rank[t], self.ids[t]) for t in score for k in range(1, len(t)) if t[:k] in self.symbol and t[k:] in self.symbol]
        found.sort()
        self.pair = np.array([x[0] for x in found], np.int64)
        self.pair_rank = np.array([x[1] for x in found] + [np.iinfo(np.int32).max], np.int64)
        self.pair_made = np.array([x[2] for x in found] + [-1], np.int64)
        self.none = np.iinfo(np.int32).max

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in pair_rank and pair_made; the last index for unknown pairs."""
        key = left * self.many + right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, at, len(self.pair))

    def single(self, segment: str) -> list[str]:
        """The pieces of a segment by single merges: best rank first, leftmost first."""
        text: list[str | None] = list(segment)
        after = list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        queue: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(text) and (r := self.rank.get(text[a] + text[b])) is not None:
                heapq.heappush(queue, (r, a, b, text[a] + text[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, made = heapq.heappop(queue)
            if text[a] is None or text[b] is None or after[a] != b or text[a] + text[b] != made:
                continue
            text[a], text[b] = made, None
            after[a] = after[b]
            if after[a] < len(text):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [t for t in text if t is not None]

    def _piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The ids of every segment."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        known, where = np.unique(chars, return_inverse=True)
        symbol = np.array([self.symbol.get(chr(c), self.other) for c in known], np.int64)[where]
        owner = np.repeat(np.arange(len(segments)), size)
        start = np.arange(len(chars))
        alone = np.zeros(len(segments), bool)
        done_owner, done_symbol, done_start = [], [], []
        # The known pair that each symbol makes with the next; rounds look up again only what they changed.
        at = np.full(len(symbol), len(self.pair))
        inside = owner[:-1] == owner[1:]
        at[:-1][inside] = self.lookup(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            inside = owner[:-1] == owner[1:]
            rank = self.pair_rank[at]
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbol)))
            ready = np.repeat(least == self.none, length)
            done_owner.append(owner[ready])
            done_symbol.append(symbol[ready])
            done_start.append(start[ready])
            go = ~ready
            symbol, owner, start, at, rank = symbol[go], owner[go], start[go], at[go], rank[go]
            if not len(symbol):
                break
            least = np.repeat(least, length)[go]
            hit = rank == least
            # Of a run of overlapping hits, every second one from its left end.
            index = np.arange(len(hit))
            begins = hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])])
            run = np.maximum.accumulate(np.where(begins, index, -1))
            hit &= (index - run) % 2 == 0
            merged = np.flatnonzero(hit)
            kept = np.ones(len(symbol), bool)
            kept[merged + 1] = False
            symbol[merged] = self.pair_made[at[merged]]
            times = np.bincount(owner[merged], minlength=len(segments))
            alone[np.unique(owner[merged][self.tied[least[merged]]])] = True
            fresh = np.zeros(len(symbol), bool)
            fresh[merged] = True
            symbol, owner, start, at, fresh, was = symbol[kept], owner[kept], start[kept], at[kept], fresh[kept], least[kept]
            at[fresh] = len(self.pair)
            near = np.flatnonzero((fresh[:-1] | fresh[1:]) & (owner[:-1] == owner[1:]))
            at[near] = self.lookup(symbol[near], symbol[near + 1])
            better = self.pair_rank[at[near]] <= was[near]
            risky = owner[near[better]]
            alone[risky[times[risky] > 1]] = True
            if alone.any():
                stay = ~alone[owner]
                symbol, owner, start, at = symbol[stay], owner[stay], start[stay], at[stay]
        owner, symbol, start = map(np.concatenate, (done_owner, done_symbol, done_start)) if done_owner else (owner, symbol, start)
        order = np.lexsort((start, owner))
        owner, symbol, start = owner[order], symbol[order], start[order]
        ends = np.searchsorted(owner, np.arange(len(segments) + 1))
        # Segments of pieces only are slices; the others have characters to spell in bytes.
        spelled = np.bincount(owner[symbol >= len(self.text)], minlength=len(segments)) > 0
        symbols, starts, ends = symbol.tolist(), start.tolist(), ends.tolist()
        offset = (np.cumsum(size) - size).tolist()
        out = []
        for i, (s, one, spell) in enumerate(zip(segments, alone.tolist(), spelled.tolist(), strict=True)):
            if one:
                out.append(self._piece_ids(self.single(s)))
                continue
            if not spell:
                out.append(symbols[ends[i] : ends[i + 1]])
                continue
            ids: list[int] = []
            for j in range(ends[i], ends[i + 1]):
                if symbols[j] < len(self.text):
                    ids.append(symbols[j])
                else:
                    ids.extend(self.byte_ids[b] for b in s[starts[j] - offset[i]].encode())
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segment's ids, word marks as spaces."""
        plain = list(map(self.plain_of.__getitem__, ids))
        if None in plain:
            return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return "".join(plain)


def words_of(text: str) -> list[str]:
    """Keys of a text's segments: see segment_of()."""
    words = text.replace(MARK, " ").replace("\n", " \n").split(" ")
    if "" not in words:
        return words
    out: list[str] = []
    blanks = 0
    for w in words:
        if w == "":
            blanks += 1
        elif w[0] == "\n":
            if blanks:
                out.append(" " * blanks)
            out.append(w)
            blanks = 0
        else:
            out.append(" " * blanks + w)
            blanks = 0
    if blanks:
        out.append(" " * blanks)
    return out


def segment_of(key: str) -> str:
    """The symbols of a key: one mark before a word, one for each leading blank; none before a line feed."""
    if key[0] == "\n":
        return key
    bare = key.lstrip(" ")
    blanks = len(key) - len(bare)
    return MARK * (blanks + bool(bare)) + bare


def text_slices(text: str, limit: int) -> Iterator[str]:
    """Slices of a long text, each but the first without the single space before it."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while (cut := text.find(" ", cut)) >= 0 and (cut + 1 >= len(text) or text[cut - 1] in f" {MARK}\n" or text[cut + 1] in f" {MARK}\n"):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Encoder:
    """A worker's memory of the segments met lately: their ids as text, how many, and what they decode to.

    It has two generations. When the younger is full it becomes the elder; what is met
    again moves back to the younger, so that common segments stay.
    """

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known: dict[str, tuple[bytes, int, str]] = {}
        self.elder: dict[str, tuple[bytes, int, str]] = {}

    def learn(self, keys: set[str]) -> None:
        new = keys - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.elder = {}, self.known
            new = keys
        old = new & self.elder.keys()
        for key in old:
            self.known[key] = self.elder[key]
        new = sorted(new - old)
        numeral = self.model.numeral.__getitem__
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for key, ids in zip(part, self.model.encode_segments([segment_of(k) for k in part]), strict=True):
                self.known[key] = " ".join(map(numeral, ids)).encode(), len(ids), self.model.decode(ids)

    def found(self, words: list[str]) -> list[tuple[bytes, int, str]]:
        return list(map(self.known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _digest_rows(e: Encoder, texts: list[str]) -> list[tuple[int, str, str]]:
    out = []
    small = [words_of(t) if t and len(t) <= SLICE_BYTES else [] for t in texts]
    e.learn(set().union(*small))
    for t, words in zip(texts, small, strict=True):
        ids, plain, n = hashlib.sha256(), hashlib.sha256(), 1
        first = True
        for part in [words] if words else (words_of(s) for s in text_slices(t, SLICE_BYTES)) if t else []:
            if not words:
                e.learn(set(part))
            spelled, counts, texts_of = zip(*e.found(part), strict=True)
            n += sum(counts)
            ids.update(b" ".join(spelled) + b" ")
            decoded = "".join(texts_of)
            plain.update((decoded[1:] if first else decoded).encode())
            first = False
        ids.update(str(e.model.eos).encode())
        out.append((n, ids.hexdigest(), plain.hexdigest()))
    return out


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in portions(batches):
            values = binary_values(b.column(1))
            rows = []
            for i, j in slices(values, SLICE_BYTES):
                rows += _digest_rows(e, [v.decode() for v in values[i:j]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["row", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(e: Encoder, text: str) -> list[int]:
    """All ids of a text, the end id included."""
    words = words_of(text) if text else []
    e.learn(set(words))
    return [int(x) for spelled, _, _ in e.found(words) for x in spelled.split()] + [e.model.eos]


def decode(e: Encoder, ids: list[int]) -> str:
    return e.model.decode([i for i in ids if i != e.model.eos])[1:]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in portions(batches):
            texts = [v.decode() for v in binary_values(b.column(1))]
            for i in range(0, len(texts), 256):
                made = [encode(e, t) for t in texts[i : i + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(made)), pa.array(made, pa.list_(pa.int32()))], names=["row", "ids"])

    return run


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the array column ids_col of each text's ids, the end id included."""
    rest = others(docs, ids_col)
    rows = docs.select(carried(docs, rest).alias("row"), text_or_empty(text_col).alias("t"))
    made = rows.mapInArrow(_encoded(path), schema_of(rows, ["row"], "ids array<int>"))
    return made.select(*uncarried("row", rest), made["ids"].alias(ids_col))


def piece_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The op10 query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(col(id_col).alias("row"), text_or_empty(text_col).alias("t"))
    made = rows.mapInArrow(_digests(path), schema_of(rows, ["row"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
    return made.withColumnRenamed("row", "doc_id")
