"""Functions that Spark has no expression for, over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "AEIOU"
SOFTENERS = "EIY"
#: Letters with one sound wherever they stand, and beginnings of which the first letter is silent.
PLAIN = {"F": "F", "J": "J", "L": "L", "M": "M", "N": "N", "R": "R", "Q": "K", "V": "F", "Z": "S"}
SILENT_STARTS = ("AE", "GN", "KN", "PN", "WR")


def _sound(w: str, i: int) -> tuple[str, int]:
    """The code of the letter at i of an upper-case word, and how many letters it uses up."""
    at = lambda j: w[j] if 0 <= j < len(w) else ""
    c, before, after, then = w[i], at(i - 1), at(i + 1), at(i + 2)
    if c in VOWELS:
        return (c if i == 0 else ""), 1
    if c in PLAIN:
        return PLAIN[c], 1
    if c == "B":
        return ("" if before == "M" and not after else "B"), 1
    if c == "C":
        if after and after in SOFTENERS:
            return ("X" if after == "I" and then == "A" else "" if before == "S" else "S"), 1
        if after == "H":
            return ("K" if before == "S" or then == "R" else "X"), 2
        return "K", 1
    if c == "D":
        return ("J", 2) if after == "G" and then and then in SOFTENERS else ("T", 1)
    if c == "G":
        if after == "H":
            return ("", 2) if i and then not in tuple(VOWELS) else ("K", 2)
        if after == "N":
            return ("" if not then or w[i + 2 :] == "ED" else "K"), 1
        return ("J" if after and after in SOFTENERS and before != "G" else "K"), 1
    if c == "H":
        return ("H" if after in tuple(VOWELS) and before not in tuple("CGPST") else ""), 1
    if c == "K":
        return ("" if before == "C" else "K"), 1
    if c == "P":
        return ("F", 2) if after == "H" else ("P", 1)
    if c == "S":
        if after == "I" and then in ("A", "O"):
            return "X", 1
        return ("X", 2) if after == "H" else ("X", 3) if w[i + 1 : i + 3] == "CH" and at(i + 3) == "W" else ("S", 1)
    if c == "T":
        if after == "I" and then in ("A", "O"):
            return "X", 1
        if after == "H":
            return ("T", 2) if then == "M" else ("0", 2)
        return ("" if w[i + 1 : i + 3] == "CH" else "T"), 1
    if c in "WY":
        return (c if after in tuple(VOWELS) else ""), 1
    return "KS", 1  # X


def _metaphone(word: str | None, most: int = 255) -> str | None:
    """Consonant sounds of an English word by Philips' rules: vowels at the start only, doubled letters once."""
    if word is None:
        return None
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if w.startswith(SILENT_STARTS):
        w = w[1:]
    elif w.startswith("X"):
        w = "S" + w[1:]
    elif w.startswith("WH"):
        w = "W" + w[2:]
    out, i = "", 0
    while i < len(w) and len(out) < most:
        if i and w[i] == w[i - 1] and w[i] != "C":
            i += 1
            continue
        code, used = _sound(w, i)
        out += code
        i += used
    return out[:most]


@F.pandas_udf(T.StringType())
def metaphone(s: pd.Series) -> pd.Series:
    return s.map(_metaphone)


@F.pandas_udf(T.StringType())
def normalize_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def normalize_nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(T.BooleanType())
def unicode_assigned(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else all(unicodedata.category(c) != "Cn" for c in x))
