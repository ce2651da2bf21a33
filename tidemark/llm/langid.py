"""Language ID by nearest centroid over TF-IDF vectors of n-grams.

A text's features are its byte 2- and 3-grams in lower case, with characters
of ASCII other than letters as spaces, hashed to a fixed number of dimensions;
counts become log(1 + n) times the inverse document frequency, and vectors
have length 1. Each language has several centroids, found by spherical k-means
over a sample of labelled rows. A text gets the language of the centroid of
largest cosine, of equals the first language by name. It is rejected when that
cosine is under `reject_below` times the median cosine of the language's own
sample: too far from all that was seen. Texts of under FULL_LENGTH characters
hold few n-grams, so their bound falls with their length: a short text with an
address or a number in it must stay. (On check_s cosines are at least 0.11 of
that median for texts of 90 characters; at sf0.1 longer texts of languages left
out of the fit have mostly 0.10 to 0.15, except English, whose words the others
quote, and random letters 0.04.)

The fit uses at most `sample` labelled rows a language, chosen by a hash of
their id, so its cost doesn't grow with the table; a language is any non-null
label. Prediction reads the text only. A text that is null or has no letter is
`und` with score 0 and rejected; so is every text if no row is labelled. Rows
with equal text get equal results; a null id is never learned from and is not
held out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, carried, col, materialize, others, portions, small_batches, text_or_empty, uncarried

DIMS = 8192
SAMPLE = 400
CENTROIDS = 3
REJECT_BELOW = 0.2
FULL_LENGTH = 250
#: Bytes and rows made into vectors at once.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 256

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[: ord("a")] = 32
_FOLD[ord("z") + 1 : 128] = 32


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row per text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            for at in range(0, len(text), SLICE_BYTES):
                out[i] += gram_counts([text[at : at + SLICE_BYTES]])[0]
    short = [" " if len(t) > SLICE_BYTES else f" {t.lower()} " for t in texts]
    raw = [t.encode() for t in short]
    b = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    if len(b) < 3:
        return out
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    fold = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    own = owner[:-2] == owner[2:]  # not across the end of a text, so that its neighbours in a batch don't matter
    base = owner[:-2][own].astype(np.int64) * DIMS
    for g in (two[own], three[own]):
        out += np.bincount(base + fold(g), minlength=out.size).reshape(out.shape)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the unit vectors x; the first nearest the mean, the next each farthest from those before."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    chosen = [first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centers = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[near == i].sum(axis=0) if (near == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for i in range(0, len(texts), SLICE_ROWS):
            part = texts[i : i + SLICE_ROWS]
            read = [has_letter(t) for t in part]
            if not self.languages:
                out += [("und", 0.0, True)] * len(part)
                continue
            cosine = weighted(gram_counts(part), self.idf) @ self.centers.T
            best = np.argmax(cosine, axis=1)
            for text, ok, c, row in zip(part, read, best.tolist(), cosine, strict=True):
                score = min(1.0, max(0.0, float(row[c])))
                lang = int(self.owner[c])
                out.append((self.languages[lang], score, bool(score < self.least[lang] * min(1.0, len(text) / FULL_LENGTH))) if ok else ("und", 0.0, True))
        return out


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 3 is 1; null ids aren't."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, text_col: str, id_col: str, lang_col: str, sample: int) -> DataFrame:
    """At most `sample` rows (lang, t) of each language, by the least hashes of their ids."""
    usable = docs.select(col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("t"), col(id_col).alias("id"), held_out(id_col).alias("out"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~F.col("out")).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return usable.select("lang", "t").limit(0)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * sample + 50) / n) * (1 << 40)))])
    few = usable.filter(F.col("h") < share[F.col("lang")])
    w = Window.partitionBy("lang").orderBy("h", "id")
    return few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sample).select("lang", "t")


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, reject_below: float = REJECT_BELOW) -> Model:
    rows = materialize(labelled_sample(docs, text_col, id_col, lang_col, sample), "langid-sample")

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(DIMS)
        for i in range(0, len(pdf), SLICE_ROWS):
            n += (gram_counts(list(pdf["t"][i : i + SLICE_ROWS])) > 0).sum(axis=0)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(pdf)], "x": [n.tobytes()]})

    found = rows.groupBy("lang").applyInPandas(frequencies, "lang string, n long, x binary").collect()
    if not found:
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    total = sum(r["n"] for r in found)
    idf = (np.log((1 + total) / (1 + sum(np.frombuffer(r["x"]) for r in found))) + 0.1).astype(np.float32)

    def centers(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([weighted(gram_counts(list(pdf["t"][i : i + SLICE_ROWS])), idf) for i in range(0, len(pdf), SLICE_ROWS)])
        c = spherical_kmeans(x, centroids)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "x": [c.astype(np.float32).tobytes()], "least": [float(np.median((x @ c.T).max(axis=1)) * reject_below)]})

    found = sorted(rows.groupBy("lang").applyInPandas(centers, "lang string, x binary, least double").collect(), key=lambda r: r["lang"])
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, DIMS) for r in found]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return Model([r["lang"] for r in found], idf, np.concatenate(parts), owner, np.array([r["least"] for r in found]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of those names are replaced.

    Only the text goes to Python and only the verdict comes back; the other columns stay in the JVM.
    """
    rest = others(docs, "lang_pred", "score", "rejected")
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [x for part in portions([pa.record_batch([texts], names=["t"])]) for x in shared.value.predict([v.decode() for v in binary_values(part.column(0))])]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    # Not deterministic, so that Spark never evaluates it twice.
    made = docs.select(carried(docs, rest).alias("row"), verdict.asNondeterministic()(text_or_empty(text_col)).alias("v"))
    return made.select(*uncarried("row", rest), "v.*")


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The op3 query: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, text_col, id_col, lang_col)
    rows = docs.select(col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), col(text_col).alias("text"))
    return predict(rows, model, "text").select("doc_id", "held_out", "lang_pred", "score", "rejected")
