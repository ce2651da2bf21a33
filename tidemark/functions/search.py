"""Full-text search: English lexemes with positions, queries over them, ranks and headlines.

A vector is array<struct(lexeme, positions array<int>, weights array<string>)>,
sorted by lexeme. Words are stemmed by the English Snowball rules and stop words
left out, though they count in positions. A hyphenated word stands for itself
and for its parts. Documents are worked through batch by batch over Arrow; a
query is parsed once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR = "array<struct<lexeme:string,positions:array<int>,weights:array<string>>>"
_ARROW = {
    VECTOR: pa.list_(pa.struct([("lexeme", pa.string()), ("positions", pa.list_(pa.int32())), ("weights", pa.list_(pa.string()))])),
    "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()),
}

#: English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

#: Words that the rules treat apart, and those that stay as they are.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_SAME_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of steps 2 and 3, and what takes their place.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The English Snowball stem of a word in lower case."""
    if len(word) < 3:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    # A y that is a consonant is written Y.
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub("^y", "Y", w))
    vowel = "[aeiouy]"

    def region(text: str, start: int) -> int:
        m = re.search(f"{vowel}[^aeiouy]", text[start:])
        return start + m.end() if m else len(text)

    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else region(w, 0)
    r2 = region(w, r1)
    # Step 0 and 1a.
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(vowel, w[:-2]):
        w = w[:-1]
    if w in _SAME_AFTER_1A:
        return w

    def short_syllable(text: str) -> bool:
        return bool(re.search(r"(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)", text))

    def short(text: str) -> bool:
        return r1 >= len(text) and short_syllable(text)

    # Step 1b.
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[0] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(vowel, w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w):
            w += "e"
    # Step 1c.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Step 2.
    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif suffix == "li":
                    w = w[:-2] if w[at - 1 : at] in set("cdeghkmnrt") else w
                else:
                    w = w[:at] + _STEP2[suffix]
            break
    # Step 3.
    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + _STEP3.get(suffix, "")
            break
    # Step 4.
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # Step 5.
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*(?:-[^\W_]+)*|\d+(?:\.\d+)+")


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """Words with their positions; a hyphenated word, then its parts."""
    at = 0
    for m in _WORD.finditer(text):
        word = m[0].lower()
        at += 1
        yield word, at
        if "-" in word:
            for part in word.split("-"):
                at += 1
                yield part, at


def lexize(word: str) -> list[str]:
    """A word's lexemes by the English dictionary: none for a stop word."""
    return [] if word in STOP_WORDS else [stem(word)]


def vector_of(text: str) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for word, at in tokens(text):
        for lexeme in lexize(word):
            out.setdefault(lexeme, []).append((min(at, 16383), "D"))
    return out


def _shown(v: dict) -> list[dict]:
    return [{"lexeme": k, "positions": [p for p, _ in v[k]], "weights": [w for _, w in v[k]]} for k in sorted(v)]


def _read(v: list[dict]) -> dict[str, list[tuple[int, str]]]:
    return {e["lexeme"]: list(zip(e["positions"] or [], e["weights"] or [], strict=True)) for e in v}


def _column(kind: str, fn: Callable[..., Any], *columns: Column) -> Column:
    def run(batches: Iterator[Any]) -> Iterator[pa.Array]:
        for batch in batches:
            given = batch if isinstance(batch, tuple) else (batch,)
            yield pa.array([None if any(x is None for x in row) else fn(*row) for row in zip(*(c.to_pylist() for c in given), strict=True)], _ARROW[kind])

    run.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[(pa.Array,) * len(columns)]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(*columns)


def to_vector(text: Column) -> Column:
    """to_tsvector('english', text)."""
    return _column(VECTOR, lambda t: _shown(vector_of(t)), text)


def set_weight(vector: Column, weight: str) -> Column:
    return F.transform(vector, lambda e: F.struct(e.lexeme.alias("lexeme"), e.positions.alias("positions"), F.transform(e.weights, lambda w: F.lit(weight)).alias("weights")))


def strip(vector: Column) -> Column:
    """Without positions and weights."""
    return F.transform(vector, lambda e: F.struct(e.lexeme.alias("lexeme"), F.slice(e.positions, 1, 0).alias("positions"), F.slice(e.weights, 1, 0).alias("weights")))


def delete_lexemes(vector: Column, *lexemes: str) -> Column:
    return F.filter(vector, lambda e: ~e.lexeme.isin(*lexemes))


def filter_weights(vector: Column, *weights: str) -> Column:
    """ts_filter: only positions of these weights, and lexemes that have one."""

    def keep(e: Column) -> Column:
        both = F.filter(F.arrays_zip(e.positions.alias("p"), e.weights.alias("w")), lambda x: x.w.isin(*weights))
        return F.struct(e.lexeme.alias("lexeme"), F.transform(both, lambda x: x.p).alias("positions"), F.transform(both, lambda x: x.w).alias("weights"))

    return F.filter(F.transform(vector, keep), lambda e: F.size(e.positions) > 0)


def lexemes_of(vector: Column) -> Column:
    """tsvector_to_array."""
    return F.transform(vector, lambda e: e.lexeme)


def joined(a: Column, b: Column) -> Column:
    """|| : b's positions follow a's."""

    def run(x, y):
        x, y = _read(x), _read(y)
        last = max((p for e in x.values() for p, _ in e), default=0)
        for k, places in y.items():
            x.setdefault(k, []).extend((p + last, w) for p, w in places)
        return _shown(x)

    return _column(VECTOR, run, a, b)


def vector_text(vector: Column) -> Column:
    """As the type prints it: 'cat':3 'fat':2A."""

    def run(v):
        show = lambda p, w: f"{p}{'' if w == 'D' else w}"
        return " ".join("'" + e["lexeme"].replace("'", "''") + "'" + (":" + ",".join(map(show, e["positions"], e["weights"])) if e["positions"] else "") for e in v)

    return _column("string", run, vector)


# Queries: nested tuples ("word", lexeme, prefix, weights), ("&", a, b), ("|", a, b), ("!", a), ("<->", a, b, distance).
def parse(query: str, english: bool = True) -> tuple | None:
    """to_tsquery: words are stemmed and stop words left out with the operator that they stand at; null if nothing is left."""
    found = re.findall(r"\s*(<->|<\d+>|[&|!()]|'(?:[^']|'')*'(?::\*?[ABCDabcd]*\*?)?|[^\s&|!()<]+)", query)
    at = 0

    def peek() -> str:
        return found[at] if at < len(found) else ""

    def either():
        nonlocal at
        left = both()
        while peek() == "|":
            at += 1
            left = _joined_nodes("|", left, both())
        return left

    def both():
        nonlocal at
        left = phrase()
        while peek() == "&":
            at += 1
            left = _joined_nodes("&", left, phrase())
        return left

    def phrase():
        nonlocal at
        left = negation()
        while m := re.fullmatch(r"<(-|\d+)>", peek()):
            at += 1
            left = _joined_nodes("<->", left, negation(), 1 if m[1] == "-" else int(m[1]))
        return left

    def negation():
        nonlocal at
        if peek() == "!":
            at += 1
            inner = negation()
            return inner and ("!", inner)
        if peek() == "(":
            at += 1
            inner = either()
            if peek() != ")":
                raise ValueError(f"syntax error in tsquery: {query!r}")
            at += 1
            return inner
        if not peek() or peek() in "&|)":
            raise ValueError(f"syntax error in tsquery: {query!r}")
        word, _, flags = peek().partition(":") if not peek().startswith("'") else peek().rpartition("'")
        at += 1
        word = word.strip("'").replace("''", "'").lower()
        flags = flags.lstrip(":").upper()
        words = [x for w, _ in tokens(word) for x in lexize(w)] if english else [word]
        node = None
        for w in words:
            node = _joined_nodes("<->", node, ("word", w, "*" in flags, frozenset(flags) - {"*"}))
        return node

    out = either()
    if at != len(found):
        raise ValueError(f"syntax error in tsquery: {query!r}")
    return out


def _joined_nodes(op: str, a: tuple | None, b: tuple | None, distance: int = 1) -> tuple | None:
    if a is None or b is None:
        return a or b
    return (op, a, b, distance) if op == "<->" else (op, a, b)


def plain(text: str) -> tuple | None:
    """plainto_tsquery: all words."""
    out = None
    for word, _ in tokens(text):
        for x in lexize(word):
            out = _joined_nodes("&", out, ("word", x, False, frozenset()))
    return out


def phrase(text: str) -> tuple | None:
    """phraseto_tsquery: the words one after the other, stop words leaving gaps."""
    out, last = None, 0
    for word, at in tokens(text):
        for x in lexize(word):
            out = _joined_nodes("<->", out, ("word", x, False, frozenset()), at - last)
            last = at
    return out


def websearch(text: str) -> tuple | None:
    """websearch_to_tsquery: "phrases", or, and - for not; never an error."""
    groups: list[tuple | None] = [None]
    for negative, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if word.lower() == "or" and not negative:
            groups.append(None)
            continue
        node = phrase(quoted) if quoted or not word else plain(word)
        if node is not None:
            groups[-1] = _joined_nodes("&", groups[-1], ("!", node) if negative else node)
    out = None
    for g in groups:
        out = _joined_nodes("|", out, g)
    return out


def query_text(q: tuple | None) -> str:
    """As the type prints it."""
    if q is None:
        return ""
    if q[0] == "word":
        return f"'{q[1]}'" + (":" + "*" * q[2] + "".join(sorted(q[3])) if q[2] or q[3] else "")
    if q[0] == "!":
        inner = query_text(q[1])
        return "!" + (inner if q[1][0] == "word" else f"( {inner} )")
    rank = {"|": 0, "&": 1, "<->": 2}
    sides = [query_text(x) if x[0] in ("word", "!") or rank[x[0]] >= rank[q[0]] else f"( {query_text(x)} )" for x in q[1:3]]
    op = q[0] if q[0] != "<->" or q[3] == 1 else f"<{q[3]}>"
    return f" {op} ".join(sides)


def numnode(q: tuple | None) -> int:
    return 0 if q is None else 1 + sum(numnode(x) for x in q[1:3] if isinstance(x, tuple)) if q[0] != "word" else 1


def words_of(q: tuple | None) -> set[str]:
    return set() if q is None else {q[1]} if q[0] == "word" else set().union(*(words_of(x) for x in q[1:3] if isinstance(x, tuple)))


def query_contains(a: tuple | None, b: tuple | None) -> bool:
    """@> of queries: a has all words of b, whatever the operators."""
    return words_of(b) <= words_of(a)


def rewrite(q: tuple | None, target: tuple, by: tuple | None) -> tuple | None:
    """ts_rewrite: `by` wherever `target` stands; without `by` the operand goes."""
    if q is None:
        return None
    if q == target:
        return by
    if q[0] == "word":
        return q
    if q[0] == "!":
        inner = rewrite(q[1], target, by)
        return inner and ("!", inner)
    made = _joined_nodes(q[0], rewrite(q[1], target, by), rewrite(q[2], target, by), q[3] if len(q) > 3 else 1)
    return by if made == target else made


def _places(v: dict, q: tuple) -> list[int]:
    """Where a phrase's operand ends."""
    if q[0] == "word":
        hits = [e for k, e in v.items() if (k.startswith(q[1]) if q[2] else k == q[1])]
        return sorted({p for e in hits for p, w in e if not q[3] or w in q[3]})
    if q[0] == "<->":
        right = set(_places(v, q[2]))
        return sorted(p + q[3] for p in _places(v, q[1]) if p + q[3] in right)
    if q[0] == "|":
        return sorted({*_places(v, q[1]), *_places(v, q[2])})
    return sorted({*_places(v, q[1])} & {*_places(v, q[2])}) if q[0] == "&" else []


def holds(v: dict, q: tuple) -> bool:
    if q[0] == "word":
        return any((k.startswith(q[1]) if q[2] else k == q[1]) and (not q[3] or any(w in q[3] for _, w in e)) for k, e in v.items())
    if q[0] == "!":
        return not holds(v, q[1])
    if q[0] == "<->":
        return bool(_places(v, q))
    return holds(v, q[1]) and holds(v, q[2]) if q[0] == "&" else holds(v, q[1]) or holds(v, q[2])


def matches(vector: Column, q: tuple | None) -> Column:
    """@@."""
    return _column("boolean", lambda v: q is not None and holds(_read(v), q), vector)


#: Weights of D, C, B and A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def rank_of(v: dict, q: tuple, normalization: int = 0) -> float:
    """ts_rank. Words under OR add up, the nth occurrence counting 1 / n^2 and all of them at most pi^2 / 6;
    words under AND or in a phrase count by pairs of occurrences, the nearer the more."""
    words = sorted(words_of(q))
    held = [[(p, WEIGHTS[w]) for p, w in v[x]] if x in v else [] for x in words]
    if q[0] in ("&", "<->") and len(words) > 1:
        left = 1.0
        seen = False
        for i, a in enumerate(held):
            for b in held[:i]:
                for p, w in a:
                    for o, u in b:
                        far = abs(p - o)
                        if far:
                            near = 1e-30 if far > 100 else 1 / (1.005 + 0.05 * math.exp(far / 1.5 - 2))
                            left *= 1 - math.sqrt(w * u * near)
                            seen = True
        score = 1 - left if seen else 1e-20
    else:
        score = 0.0
        for places in held:
            if places:
                most = max(w for _, w in places)
                first = next(i for i, (_, w) in enumerate(places) if w == most)
                score += (most + sum(w / (i + 1) ** 2 for i, (_, w) in enumerate(places)) - most / (first + 1) ** 2) / 1.64493406685
        score /= max(len(words), 1)
    length = sum(len(e) for e in v.values())
    if normalization & 1 and length:
        score /= math.log2(length + 1)
    if normalization & 2 and length:
        score /= length
    if normalization & 8 and v:
        score /= len(v)
    if normalization & 16 and v:
        score /= math.log2(len(v) + 1)
    return score / (score + 1) if normalization & 32 else score


def rank(vector: Column, q: tuple, normalization: int = 0) -> Column:
    return _column("double", lambda v: rank_of(_read(v), q, normalization), vector)


def headline(text: Column, q: tuple, start: str = "<b>", stop: str = "</b>") -> Column:
    """ts_headline of the whole text: words of the query are marked."""
    words = words_of(q)
    mark = lambda m: f"{start}{m[0]}{stop}" if any(x in words for x in lexize(m[0].lower())) else m[0]
    return _column("string", lambda t: re.sub(r"[^\W_]+(?:['’][^\W_]+)*", mark, t), text)
