"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, queries
from tidemark.llm.common import materialize
from tidemark.llm.simhash import shingles

from test_text_operators import naive_pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS
        if name != "documents":
            assert stages[name].filter("n_chars <> length(text)").isEmpty()


def test_language_id_equals_the_model_text_by_text(stages):
    rows = stages["documents"].collect()
    model = langid.fit(stages["documents"])
    want = {}
    for r in rows:
        (lang, _, rejected), = model.predict([r["text"] or ""])
        if not rejected:
            want[r["doc_id"]] = lang, r["text"]
    assert {r["doc_id"]: (r["lang"], r["text"]) for r in stages["language_id"].collect()} == want
    assert len(want) >= 0.98 * len(rows)


def test_line_dedup_equals_brute_force(stages):
    before = texts(stages["language_id"])
    key = lambda x: x.encode().strip().lower()
    n = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")})
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or n[key(x)] < 10) for i, t in before.items()}
    assert texts(stages["line_dedup"]) == want and want != before


def test_one_of_each_similar_group_stays(stages):
    before = {i: set(shingles(t.encode(), 5)) for i, t in texts(stages["line_dedup"]).items()}
    ids, group = sorted(before), {i: i for i in before}
    for a in ids:
        for b in ids:
            if a < b and group[a] != group[b] and len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(texts(stages["simhash_near_dedup"])) == set(group.values())
    assert len(set(group.values())) < len(ids)


def test_repeated_passages_equal_brute_force(stages):
    width, before = corpus_pipeline.PASSAGE_BYTES, {i: t.encode() for i, t in texts(stages["simhash_near_dedup"]).items()}
    n = Counter(hash(b[s : s + width]) for b in before.values() for s in range(len(b) - width + 1))
    want = {}
    for i, b in before.items():
        kept, end = bytearray(), 0
        for s in range(len(b)):
            if s + width <= len(b) and n[hash(b[s : s + width])] > 1:
                end = s + width
            if s >= end:
                kept.append(b[s])
        want[i] = kept.decode("utf-8", "ignore")
    assert texts(stages["suffix_array_dedup"]) == want
    assert sum(map(len, want.values())) < sum(len(b.decode()) for b in before.values())


def test_packing_equals_the_naive_packer(stages):
    packed = stages["best_fit_packing"].toPandas()
    words = {i: len(t.encode().split()) for i, t in texts(stages["suffix_array_dedup"]).items()}
    assert {i: int(n) for i, n in packed.groupby("doc_id")["n_tokens"].sum().items()} == words
    full = packed[packed["n_tokens"] > 0]
    got = sorted((sorted(b["n_tokens"].tolist()), int(b["bin_size"].iloc[0])) for _, b in full.groupby("bin_id"))
    assert got == naive_pack(full["n_tokens"].tolist(), packing.SIZES, packing.default_costs(packing.SIZES))


def test_an_empty_table_goes_through(spark, stages, sf_dir):
    docs = stages["documents"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_null_texts_and_ids(spark, sf_dir):
    rows = [(None, "ein Satz mit genug Worten für die Sprache", "de", "s", 1), (1, None, "de", "s", 0), (2, "ein Satz mit genug Worten für die Sprache", None, None, None), (3, "!!", "de", "s", 2), (4, "ein anderer Text über etwas ganz anderes", "de", "s", 9), (4, "ein anderer Text über etwas ganz anderes", "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept.append(sorted((r["doc_id"] or 0) for r in docs.select(F.col("doc_id")).collect()))
    # Without letters no language is near; of equal texts the row of the smallest id stays.
    assert kept == [[0, 2, 4, 4], [0, 2, 4, 4], [2, 4], [2, 4], [2, 4]]


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
