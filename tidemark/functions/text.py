"""Text functions with the semantics of SQL databases where Spark's own differ or are absent.

All are expressions over Columns; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(s: Column, n: int) -> Column:
    """First n characters; negative n drops that many from the end."""
    return F.substring(s, 1, F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """Last n characters; negative n drops that many from the start."""
    if n >= 0:
        return F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n))
    return F.substring(s, F.lit(1 - n), F.length(s))


def substring(s: Column, start: int, n: int) -> Column:
    """1-based; a start before 1 counts the positions before the string."""
    end = start + n
    return F.substring(s, max(start, 1), max(end - max(start, 1), 0))


def overlay(s: Column, r: str, start: int, n: int | None = None) -> Column:
    return F.overlay(s, F.lit(r), F.lit(start), F.lit(len(r) if n is None else n))


def split_part(s: Column, delimiter: str, n: int) -> Column:
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def concat_skipping_nulls(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    """Double quotes unless the name is a lower-case identifier."""
    return F.when(s.rlike("^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def parse_ident(s: Column) -> Column:
    """a."B c".d as an array; unquoted parts in lower case."""
    parts = F.regexp_extract_all(s, F.lit('("(?:[^"]|"")+"|[^.]+)'), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(p)))


def initcap(s: Column) -> Column:
    """Upper case after anything that isn't a letter or digit."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def trigrams(s: Column) -> Column:
    """The set of three-character pieces of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def word_similarity(a: Column, b: Column) -> Column:
    """The part of a's trigrams that b holds."""
    x = trigrams(a)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, trigrams(b))) / F.size(x))


def soundex_difference(a: Column, b: Column) -> Column:
    """How many of the four soundex characters agree."""
    x, y = F.soundex(a), F.soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)), F.lit(0))


def levenshtein_less_equal(a: Column, b: Column, most: int) -> Column:
    """The distance if at most `most`, else most + 1."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


# Latin letters with marks and their plain forms.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def unaccent(s: Column) -> Column:
    out = F.translate(s, MARKED, PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def regexp_match(s: Column, pattern: str, groups: int) -> Column:
    """The first match's groups, null without a match."""
    found = F.array(*[F.regexp_extract(s, pattern, g) for g in range(1, groups + 1)]) if groups else F.array(F.regexp_extract(s, pattern, 0))
    return F.when(s.rlike(pattern), found)


def string_to_array(s: Column, delimiter: str, null: str | None = None) -> Column:
    quoted = "".join("\\" + c if not c.isalnum() else c for c in delimiter)
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, quoted, -1))
    return parts if null is None else F.transform(parts, lambda p: F.when(p != null, p))


def format_sql(template: str, *args: Column) -> Column:
    """format(): %s text (null as nothing), %I identifier, %L literal (null as NULL), %% a percent sign."""
    parts: list[Column] = []
    rest, i = template, 0
    while "%" in rest:
        before, _, rest = rest.partition("%")
        kind, rest = rest[:1], rest[1:]
        parts.append(F.lit(before))
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        a = args[i].cast("string")
        i += 1
        parts.append({"s": F.coalesce(a, F.lit("")), "I": quote_ident(a), "L": quote_nullable(a)}[kind])
    return F.concat(*parts, F.lit(rest))


def input_is_valid(s: Column, kind: str) -> Column:
    """Whether the text reads as a value of the type; a date or time has to name year, month and day."""
    valid = s.try_cast(kind).isNotNull()
    return valid & s.rlike(r"^\s*[+-]?\d{4,}-\d{1,2}-\d{1,2}") if kind.startswith(("date", "timestamp")) else valid


def regexp_substr(s: Column, pattern: str, n: int = 1) -> Column:
    """The nth match, null if there are fewer."""
    return F.get(F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)), F.lit(n - 1))


def like_with_escape(s: Column, pattern: str, escape: str) -> Column:
    return F.like(s, F.lit(pattern), F.lit(escape))


def bits(n: Column, width: int) -> Column:
    """A bit string of fixed width."""
    return F.lpad(F.bin(n), width, "0")
