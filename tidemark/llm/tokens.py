"""Token counts by compiled finite-state transducers.

Two deterministic transducers count what a byte-level BPE tokenizer with word
ends would emit, without building its tokens.

The splitter reads character classes and emits 1 on each transition that
starts a pre-token. Text is cut into chunks; each chunk gives a map from every
state at its start to the state at its end, the maps are composed by a
parallel prefix scan, and with the true start states the emissions follow, all
chunks at once.

The merger reads the bytes of a pre-token. The merge rules, in order of rank,
are a cascade of two-state transducers: each holds a symbol that is its left
side until the next symbol arrives, and passes on the merged symbol or both.
The cascade's states (which symbols are held where) are made deterministic as
they are reached; every transition is annotated with the number of tokens that
leave the cascade on it, so a pre-token's count is the sum along its path.
Merge rules of which one could create the left or right side of an earlier one
would break the order and are refused.

Special strings of the tokenizer count one token each wherever they occur. A
null or empty text has no tokens. Texts of any length are worked through in
slices; states and pre-tokens remembered by a worker are bounded and relearnt.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import binary_values, carried, col, others, portions, schema_of, slices, text_or_empty, uncarried

SLICE_BYTES = 2_000_000
REMEMBERED = 400_000
CHUNK = 256

# The pre-token pattern that the splitter is compiled for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The code points of Unicode's White_Space property, by range.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

# Capitals that a string's lower() treats otherwise than a single character's mapping, or doesn't know yet.
LOWER = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DC: 0x19B}

#: Character classes; an apostrophe that begins one of the contractions has a class by their length.
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)
#: Splitter states: between pre-tokens, in letters, in other characters, and 1 or 2 characters before a contraction's end.
BETWEEN, LETTERS, OTHERS, ONE_LEFT, TWO_LEFT = range(5)
NEXT = np.array(
    [
        [BETWEEN, LETTERS, BETWEEN, OTHERS, ONE_LEFT, TWO_LEFT],
        [BETWEEN, LETTERS, BETWEEN, OTHERS, ONE_LEFT, TWO_LEFT],
        [BETWEEN, LETTERS, BETWEEN, OTHERS, OTHERS, OTHERS],
        [BETWEEN] * 6,
        [ONE_LEFT] * 6,
    ],
    np.uint8,
)
EMITS = np.array([[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6], bool)


def class_table() -> np.ndarray:
    """The class of every code point.

    Characters newer than Python's Unicode data are classed by the tokenizer
    library's own pattern engine, whose Unicode version is the one that counts.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    category = [unicodedata.category(chr(c)) for c in range(0x110000)]
    table = np.array([kinds.get(k[0], OTHER) for k in category], np.uint8)
    unknown = "".join(chr(c) for c, k in enumerate(category) if k == "Cn")
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        newer = "".join(regex.findall(pattern, unknown))
        for found, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(newer):
            table[ord(found)] = cls
    for a, b in WHITE:
        table[a : b + 1] = SPACE
    return table


def classes(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    cls = table[code]
    quote = np.flatnonzero(code == ord("'"))
    if len(quote):
        after = np.append(code, [32, 32])
        one, two = after[quote + 1], after[quote + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        cls[quote[is_(one, "stmd")]] = SHORT
        cls[quote[(is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = LONG
    return cls


def starts_of(cls: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: chunk state maps composed by a prefix scan, then the emissions."""
    n = len(cls)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)
    grid[:n] = cls
    grid = grid.reshape(rows, CHUNK)
    maps = np.tile(np.arange(len(NEXT), dtype=np.uint8), (rows, 1))
    columns = np.ascontiguousarray(grid.T)
    for c in columns:
        maps = NEXT[maps, c[:, None]]
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, BETWEEN]
    out = np.empty((CHUNK, rows), bool)
    for i, c in enumerate(columns):
        out[i] = EMITS[state, c]
        state = NEXT[state, c]
    return np.flatnonzero(out.T.reshape(-1)[:n])


class Merger:
    """The cascade of merge rules, made deterministic state by state."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        split = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(split):
            if a + b in made or made.get(a, -1) >= r or made.get(b, -1) >= r:
                raise ValueError("merge rules out of order")
            made[a + b] = r
        ids = vocabulary
        late = {x for r, ab in enumerate(split) for x in ab if x in made and made[x] >= r}
        if late:
            raise ValueError("merge rules out of order")
        self.right = [ids[b] for _, b in split]
        self.made = [ids[a + b] for a, b in split]
        self.text = {i: t for t, i in ids.items()}
        self.left: dict[int, list[int]] = {}
        for r, (a, _) in enumerate(split):
            self.left.setdefault(ids[a], []).append(r)
        letter = byte_letters()
        self.inner = [ids[letter[b]] for b in range(256)]
        self.final = [ids[letter[b] + suffix] for b in range(256)]
        self.forget()

    def forget(self) -> None:
        self.near: dict[tuple[int, int], list[int]] = {}
        self.states: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.step: list[dict[int, tuple[int, int]]] = [{}]
        self.end: list[dict[int, int]] = [{}]

    def _rules(self, symbol: int, behind: int | None) -> list[int]:
        """Rules with this symbol at their left; only those that what is behind can become part of."""
        rules = self.left.get(symbol, [])
        if behind is None:
            return rules
        key = symbol, behind
        if key not in self.near:
            self.near[key] = [r for r in rules if self.text[self.right[r]].startswith(self.text[behind])]
        return self.near[key]

    def _push(self, held: list[tuple[int, int]], symbol: int, level: int, behind: int | None = None, last: bool = False) -> int:
        """Let a symbol that has passed the rules before `level` go up; the tokens that leave.

        held: the symbols before it and the rules that hold them, oldest and highest first.
        behind: the symbol that follows it, if that is known; last: none follows.
        """
        out = 0
        end = len(self.right)
        while True:
            stop = end
            if not last:
                rules = self._rules(symbol, behind)
                i = bisect_left(rules, level)
                if i < len(rules):
                    stop = rules[i]
            if held:
                before, rule = held[-1]
                if stop >= rule:
                    held.pop()
                    if self.right[rule] == symbol:
                        symbol, level = self.made[rule], rule + 1
                    else:
                        out += self._push(held, before, rule + 1, symbol)
                        level = rule
                    continue
                if not self.text[self.right[rule]].startswith(self.text[symbol]):
                    held.pop()
                    out += self._push(held, before, rule + 1, symbol)
            if stop == end:
                return out + 1
            held.append((symbol, stop))
            return out

    def _reach(self, state: int, byte: int) -> tuple[int, int]:
        held = list(self.states[state])
        out = self._push(held, self.inner[byte], 0)
        key = tuple(held)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.end.append({})
        self.step[state][byte] = self.number[key], out
        return self.step[state][byte]

    def _finish(self, state: int, byte: int) -> int:
        held = list(self.states[state])
        self.end[state][byte] = self._push(held, self.final[byte], 0, last=True)
        return self.end[state][byte]

    def count(self, word: bytes) -> int:
        state = total = 0
        for b in word[:-1]:
            state, n = self.step[state].get(b) or self._reach(state, b)
            total += n
        n = self.end[state].get(word[-1])
        total += self._finish(state, word[-1]) if n is None else n
        if len(self.states) > REMEMBERED or len(self.near) > REMEMBERED:
            self.forget()
        return total


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from code point 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(c) for c in range(256, 512))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Counter:
    """Both transducers of a tokenizer file, and a worker's memory of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        model, pre = t["model"], t["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in t["normalizer"]["normalizers"]]
        plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in t["added_tokens"])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or pre[0]["pattern"] != {"Regex": PATTERN} or pre[1]["type"] != "ByteLevel" or not plain:
            raise ValueError("this tokenizer is of another kind")
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = sorted((a["content"] for a in t["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.table = class_table()
        self.known: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER)
        return text.lower()

    def prepared(self, text: str) -> tuple[int, str]:
        """Special tokens, and the rest in normal form; a space parts what a special string parted."""
        if self.special is None or "<" not in text:
            return 0, self.normal(text)
        parts = self.special.split(text)
        return len(parts) - 1, " ".join(map(self.normal, parts))

    def counts(self, texts: list[str]) -> list[int]:
        ready = [self.prepared(t) for t in texts]
        joined = " ".join(t for _, t in ready)
        size = np.fromiter((len(t) + 1 for _, t in ready), np.int64, len(ready))
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        total = np.array([n for n, _ in ready], np.int64)
        if not len(code):
            return total.tolist()
        cls = classes(code, self.table)
        start = starts_of(cls)
        edge = cls == SPACE
        edge[start] = True
        edge = np.append(np.flatnonzero(edge), len(code))
        end = edge[np.searchsorted(edge, start, side="right")]
        words = [joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set(words)
        for w in new:
            self.known[w] = self.merger.count(w.encode())
        n = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        owner = np.searchsorted(np.cumsum(size), start, side="right")
        np.add.at(total, owner, n)
        return total.tolist()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def text_slices(text: str, limit: int) -> Iterator[str]:
    """Slices of a long text, cut at spaces, which no pre-token or special string crosses."""
    at = 0
    while len(text) - at > limit and (cut := text.find(" ", at + limit)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in portions(batches):
            values = binary_values(b.column(1))
            n: list[int] = []
            for i, j in slices(values, SLICE_BYTES):
                if j == i + 1 and len(values[i]) > SLICE_BYTES:
                    n.append(sum(c.counts([s])[0] for s in text_slices(values[i].decode(), SLICE_BYTES)))
                else:
                    n += c.counts([v.decode() for v in values[i:j]])
            size = pa.array(list(map(len, values)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of each text; columns of those names are replaced."""
    rest = others(docs, "n_bytes", "n_tokens", "over_limit")
    rows = docs.select(carried(docs, rest).alias("row"), text_or_empty(text_col).alias("t"))
    made = rows.mapInArrow(_counted(path), schema_of(rows, ["row"], "n_bytes long, n_tokens long"))
    return made.select(*uncarried("row", rest), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def digest(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048) -> DataFrame:
    """The op4 query: doc_id, n_bytes, n_tokens, over_limit."""
    made = count_tokens(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), path, "text", limit)
    return made.select("doc_id", "n_bytes", "n_tokens", "over_limit")
