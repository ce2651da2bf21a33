"""Operators on texts against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import os
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, packing, pieces, position_index, shingle_join, simhash, substring_dedup, suffix_dedup, tokens
from tidemark.llm.components import components

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def mixed_texts(seed=1, n=60):
    """Few letters and shared pieces, so that everything repeats somewhere."""
    r = random.Random(seed)
    base = ["".join(r.choice("ab") for _ in range(200)) for _ in range(5)]
    out = []
    for _ in range(n):
        b, s = r.choice(base), r.randint(0, 150)
        out.append("".join(r.choice("abcde") for _ in range(r.randint(0, 30))) + b[s : s + r.randint(1, 90)] + "".join(r.choice("abcdé") for _ in range(r.randint(0, 30))))
    return [*out, "", "a", "é" * 30, out[0], out[0]]


def frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3]), (900, None)]
    return spark.createDataFrame(rows, DOCS), rows


# Line dedup.
def test_line_dedup_equals_brute_force(spark):
    r = random.Random(2)
    lines = ["Shared", " shared\t", "two", "", "x y", "ÄB", "äb"]
    texts = ["\n".join(r.choice(lines) + ("" if r.random() < 0.7 else str(r.random())) for _ in range(r.randint(0, 6))) for _ in range(40)]
    df, rows = frame(spark, texts)
    key = lambda x: x.encode().strip().lower()
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or n[key(x)] < 10]
        want.append((i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept).encode())))
    got = [tuple(x) for x in line_dedup.digest(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", 7)], "k long, text string, row string, N_LINES int")
    out = line_dedup.line_dedup(df).collect()
    assert out[0].asDict() == {"k": 1, "row": "x", "text": "a\nb", "n_lines": 2, "n_dropped": 0}


# Repeats.
def brute_words(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if n[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def brute_bytes(rows, width):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone, end = [], 0
        for s in range(len(b)):
            if s + width <= len(b) and n[b[s : s + width]] > 1:
                end = s + width
            gone.append(s < end)
        spans = sum(g and not (s and gone[s - 1]) for s, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def test_substring_dedup_equals_brute_force(spark):
    df, rows = frame(spark, [" ".join(t) for t in mixed_texts()])
    got = [tuple(x) for x in substring_dedup.digest(df, width=14).collect()]
    want = brute_words(rows, 14)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_substring_dedup_in_many_batches(spark):
    df, rows = frame(spark, [" ".join(t) for t in mixed_texts(4, 30)])
    out = substring_dedup.substring_dedup(df, "text", 14, batches=5, max_runs=1)
    got = [(x["doc_id"], x["n_words"], x["n_removed"], sha(x["text"].encode())) for x in out.collect()]
    assert sorted(got, key=str) == sorted(brute_words(rows, 14), key=str)


def test_an_index_is_kept_between_sessions(spark, tmp_path):
    """Three batches through an index that is opened anew for each equal one table, batch by batch."""
    texts = [" ".join(t) for t in mixed_texts(12, 45)]
    rows = list(enumerate(texts))
    parts, path = [rows[:15], rows[15:30], rows[30:]], str(tmp_path / "index")
    before: list = []
    for i, part in enumerate(parts):
        session = spark.newSession()
        index = substring_dedup.FingerprintIndex(session, path, buckets=3 + i, max_runs=1)
        assert len(index.runs) == min(i, 1)
        history = session.createDataFrame(before, DOCS) if before else None
        out = substring_dedup.new_batch(index, session.createDataFrame(part, DOCS), history, "text", 14).collect()
        got = [(x["doc_id"], x["n_words"], x["n_removed"], sha(x["text"].encode())) for x in out]
        before += part
        want = [w for w in brute_words(before, 14) if w[0] in dict(part)]
        assert sorted(got) == sorted(want)
        assert len(index.runs) == 1
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("bucket_rows", [512, 2])
def test_suffix_dedup_equals_brute_force(spark, bucket_rows):
    df, rows = frame(spark, mixed_texts(3))
    out = suffix_dedup.suffix_dedup(df, "text", 20, bucket_rows)
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], sha(bytes(x["kept"]))) for x in out.collect()]
    want = brute_bytes(rows, 20)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_suffix_dedup_of_the_documents(spark, sf_dir):
    """The query's own table and width, by bytes; exact copies and shared passages are changed, rows alone are not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.digest(docs).collect()}
    raw, n = [(t or "").encode() for _, t in rows], Counter()
    for b in raw:
        n.update(hash(b[i : i + 400]) for i in range(len(b) - 399))
    for (i, _), b in zip(rows, raw, strict=True):
        kept, spans, end = bytearray(), 0, 0
        for s in range(len(b)):
            if s + 400 <= len(b) and n[hash(b[s : s + 400])] > 1:
                spans += s > end or not end
                end = s + 400
            if s >= end:
                kept.append(b[s])
        assert got[i] == (len(b), len(b) - len(kept), spans, sha(bytes(kept)))
    assert 0 < sum(x[1] > 0 for x in got.values()) < len(rows)


def test_slices_of_long_texts_change_nothing(monkeypatch):
    from tidemark.llm import windows

    r = random.Random(9)
    text = "".join(r.choice("ab ") for _ in range(5000)).encode()
    whole = Counter()
    for kind, width in ((windows.Words, 12), (windows.Bytes, 30)):
        def starts():
            found = set()
            for owner, a, c, lo, hi, at in windows.runs(kind, [text], width):
                for o, x, y, z, v in zip(owner, a, lo, hi, at, strict=True):
                    found |= {(int(o), int(x), s, int(v)) for s in range(y, z + 1)}
            return found

        monkeypatch.setattr(windows, "SLICE", 1_000_000)
        one = starts()
        monkeypatch.setattr(windows, "SLICE", 300)
        assert starts() == one
        whole[kind] = len(one)
    assert all(whole.values())


def test_deep_shallow_order_sorts():
    r = random.Random(5)
    common = bytes(r.choice(b"ab") for _ in range(120))
    strings = [common[: r.randint(0, 120)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 9))) for _ in range(200)] + [common, common, b"", b""]
    assert [strings[i] for i in suffix_dedup.deep_shallow_order(strings, 32)] == sorted(strings)


# SimHash.
def brute_simhash(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    again = True
    while again:
        again = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and group[j] > group[i]:
                    group[j], again = group[i], True
    names = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(r[0], f"{f:016x}", names[g]) for r, f, g in zip(rows, fps, group, strict=True)]


@pytest.mark.parametrize("list_rows", [1024, 2])
def test_simhash_equals_brute_force(spark, monkeypatch, list_rows):
    monkeypatch.setattr(position_index, "LIST_ROWS", list_rows)
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = ["", "One", "one two three"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(120)]
        texts += [" ".join(base), " ".join([*base[:-1], "Z"]), " ".join(base[2:])]
    df, rows = frame(spark, texts)
    got = [tuple(x) for x in simhash.digest(df).collect()]
    want = brute_simhash(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_position_sets_cover_every_four():
    from itertools import combinations

    for size, n in ((3, 20), (4, 70)):
        sets = position_index.position_sets(size)
        assert len(sets) == n and all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_a_list_of_thousands_is_tallied_whole(spark):
    """5,000 fingerprints that share four bytes: one list, several sub-lists and blocks."""
    r = np.random.default_rng(11)
    bits = r.random((5000, 64)) < 0.5
    bits[:, 32:] = bits[0, 32:]
    near = r.integers(0, 5000, 3000)
    flips = r.random((3000, 64)) < 2 / 32
    flips[:, 32:] = False
    bits[near] = bits[(near * 7) % 5000] ^ flips
    fps = np.unique(np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64))
    group = np.arange(len(fps))
    while True:
        least = np.array([group[np.bitwise_count((fps ^ x).view(np.uint64)) <= 4].min() for x in fps])
        least = np.minimum(least, least[least])
        if (least == group).all():
            break
        group = least
    edges = position_index.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 4)
    root = {x["node"]: x["root"] for x in components(edges).collect()}
    assert [root.get(int(x), int(x)) for x in fps] == [int(fps[g]) for g in group]
    assert 500 < len(set(group)) < len(fps)


def test_one_per_group(spark):
    r = random.Random(7)
    base = [f"w{r.randint(0, 999)}" for _ in range(400)]
    near = [*base[:100], "edit", *base[101:]]
    far = [f"v{r.randint(0, 999)}" for _ in range(400)]
    rows = [(5, " ".join(base)), (2, " ".join(near)), (7, " ".join(base)), (9, " ".join(far)), (9, " ".join(far)), (None, ""), (3, None)]
    df = spark.createDataFrame([(*x, "k", 1, b"") for x in rows], DOCS + ", k string, __n int, root binary")
    got = simhash.one_per_group(df).collect()
    assert sorted(x["doc_id"] for x in got) == [2, 3, 9]
    assert {(x["k"], x["__n"], bytes(x["root"])) for x in got} == {("k", 1, b"")}


def brute_groups(texts):
    """The sets of texts that chains of pairs of Jaccard similarity 0.8 or more hold together."""
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(sorted(t for t, g in zip(texts, group, strict=True) if g == name) for name in set(group))


def similar_found(spark, texts):
    df, _ = frame(spark, texts)
    by_key = {hashlib.md5(t.encode()).digest(): t for t in texts}
    root = {bytes(x["k"]): bytes(x["root"]) for x in simhash.similar_groups(df).collect()}
    names = {k: root.get(k, k) for k in by_key}
    return sorted(sorted(t for k, t in by_key.items() if names[k] == name) for name in set(names.values()))


def test_appended_and_truncated_texts_are_found(spark):
    r = random.Random(8)
    texts = ["", "  ", "one two"]
    for i in range(30):
        base = [f"w{r.randint(0, 99999)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base + [f"v{r.randint(0, 99999)}" for _ in range(44 + i % 12)])]
    want = brute_groups(texts)
    assert 10 < sum(len(g) == 2 for g in want) < 31
    assert similar_found(spark, texts) == want


@pytest.mark.parametrize("block", [1024, 2])
@pytest.mark.parametrize("common_from", [16, 2])
def test_template_families_are_grouped_whole(spark, monkeypatch, block, common_from):
    monkeypatch.setattr(position_index, "LIST_ROWS", block)
    monkeypatch.setattr(shingle_join, "BLOCK_TEXTS", block)
    monkeypatch.setattr(shingle_join, "COMMON_FROM", common_from)
    r = random.Random(9)
    texts = ["", "  ", "one two"]
    for _ in range(6):
        base = [f"w{r.randint(0, 99999)}" for _ in range(150)]
        for i in range(12):
            words = list(base)
            for _ in range(r.randint(1, 5)):
                words[r.randint(0, 149)] = f"v{r.randint(0, 99999)}"
            texts.append(" ".join(words))
            if i % 3 == 0:
                r.shuffle(words)  # the same words, other shingles: nearest by fingerprint, never similar
                texts.append(" ".join(words))
    want = brute_groups(texts)
    assert len({len(g) for g in want}) > 3
    assert similar_found(spark, texts) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 40)}}


# Tokenizers.
ODD = ["", " ", "a  b", "it's we'll 'x ''s", "<|endoftext|>a<|startoftext|>", "日本語 テスト", "é é ΑΣ Σ", "1234½", "\x00\x1c\x85x", "🙂🙂", "▁ a▁b", "\n\n a\n", "tab\there", "İI"]


def test_token_counts_equal_the_library():
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(8)
    parts = ["a", "the", "ing", " ", "'", "s", "'re", "\n", "é", "日", "!!", "1", "<|endoftext|>", "Σ", "T", "tion"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(path).counts(texts) == want
    long = " ".join(texts)
    assert sum(tokens.counter(path).counts([s])[0] for s in tokens.text_slices(long, 50)) == len(library.encode(long, add_special_tokens=False).ids)


def test_token_count_rows(spark):
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    df, rows = frame(spark, [*ODD, "word " * 3000])
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted(map(tuple, tokens.digest(df, path).collect()), key=str) == sorted(want, key=str)


def test_pieces_equal_the_library(monkeypatch):
    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.encoder(path)
    r = random.Random(8)
    parts = ["a", "the", "ing", " ", "  ", "   ", "'", "\n", "▁", "é", "日", "\x00", "🙂", "aaaa", "erer", "\r\n"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert pieces.encode(own, t) == ids
        assert pieces.decode(own, ids) == library.decode(ids)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 25)
    for t in texts[:150]:
        ids = library.encode(t, add_eos=True)
        assert pieces._digest_rows(own, [t])[0] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))


def test_piece_rows(spark):
    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = frame(spark, ODD)
    got = {(x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in pieces.piece_digests(df, path).collect()}
    assert got == {(i, len(ids), sha(" ".join(map(str, ids)).encode())) for i, t in rows for ids in [library.encode(t or "", add_eos=True)]}
    ids = {(x["doc_id"], tuple(x["ids"])) for x in pieces.encode_pieces(df, path).collect()}
    assert ids == {(i, tuple(library.encode(t or "", add_eos=True))) for i, t in rows}


# Language ID.
def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.95
    assert found["score"].between(0, 1).all()


def naive_vector(text, idf):
    """n-grams counted one by one, weighted and normed."""
    b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text.lower()} ".encode()]
    n = Counter()
    for i in range(len(b) - 2):
        for gram in (b[i] << 8 | b[i + 1], b[i] << 16 | b[i + 1] << 8 | b[i + 2]):
            n[(gram * 0x9E3779B1 % 2**32) >> 19] += 1
    v = {g: np.log1p(c) * idf[g] for g, c in n.items()}
    length = sum(x * x for x in v.values()) ** 0.5
    return {g: x / max(length, 1e-12) for g, x in v.items()}


def test_language_id_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.select("text").limit(60).collect() if r["text"]] + ["der die das", "x", "\u4e2d\u6587", "a" * 70]
    for text, (lang, score, rejected) in zip(texts, model.predict(texts), strict=True):
        v = naive_vector(text, model.idf)
        cosine = [sum(x * c[g] for g, x in v.items()) for c in model.centers.astype(float)]
        best = max(cosine)
        assert abs(best - score) < 1e-4 and abs(cosine[[i for i, o in enumerate(model.owner) if model.languages[o] == lang][0]] - best) < 1e-4 or best - max(x for x, o in zip(cosine, model.owner, strict=True) if model.languages[o] == lang) < 1e-4
        bound = model.least[model.languages.index(lang)] * min(1, len(text) / langid.FULL_LENGTH)
        assert rejected == (score < bound) or abs(score - bound) < 1e-4


def test_idf_counts_texts_with_a_gram(spark):
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(["ab", "ab", "cd", "ef gh"] * 3)], DOCS + ", lang string")
    model = langid.fit(df)
    used = [r["t"] for r in langid.labelled_sample(df, "text", "doc_id", "lang", 400).collect()]
    seen = Counter(g for t in used for g in naive_vector(t, np.ones(langid.DIMS)))
    assert all(abs(model.idf[g] - (np.log((1 + len(used)) / (1 + n)) + 0.1)) < 1e-5 for g, n in seen.items())


def test_unlearned_languages_and_gibberish_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = random.Random(4)
    junk = ["".join(r.choice("qxzjkvwpfbghm ") for _ in range(200)) for _ in range(20)] + ["".join(chr(r.randint(0x430, 0x44F)) for _ in range(250)) for _ in range(20)]
    assert np.mean([x[2] for x in langid.fit(docs).predict(junk)]) > 0.95
    left_out = [x["text"] for x in docs.filter("lang = 'de' AND length(text) > 250").collect()]
    assert np.mean([x[2] for x in langid.fit(docs.filter("lang <> 'de'")).predict(left_out)]) > 0.9
    kept = langid.predict(docs, langid.fit(docs)).filter("lang IS NOT NULL AND length(text) > 0").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert kept < 0.01


def test_equal_cosines_take_the_first_language(spark):
    df = spark.createDataFrame([(i, "same words here", lang) for i in range(40) for lang in ("bb", "aa")], DOCS + ", lang string")
    assert {x["lang_pred"] for x in langid.predict(df, langid.fit(df)).collect()} == {"aa"}


def test_language_id_of_odd_rows(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the and of"), (4, "the and of")], DOCS)
    got = {(x["doc_id"], x["lang_pred"] == "und", x["rejected"]) for x in langid.predict(df, model).collect()}
    assert got == {(1, True, True), (2, True, True), (3, True, True), (4, False, False)}
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {x["lang_pred"] for x in langid.predict(df, none).collect()} == {"und"}


# Packing.
def test_packing_keeps_every_token_once():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 4097, 3000)
    bins, starts, used, sizes = packing.pack(lengths, packing.SIZES, packing.default_costs(packing.SIZES))
    for b in range(len(used)):
        mine = sorted((s, n) for s, n in zip(starts[bins == b], lengths[bins == b], strict=True))
        assert mine[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(mine, mine[1:], strict=False))
        assert sum(n for _, n in mine) == used[b] <= sizes[b]
        assert sizes[b] == packing.SIZES[0] or used[b] > max(s for s in packing.SIZES if s < sizes[b])
    assert sum(used) / sum(sizes) > 0.97


def naive_pack(lengths, sizes, costs):
    """The packer by its description, looking at everything each time: (contents, size) of the bins."""
    todo, bins = sorted(lengths, reverse=True), []
    while todo:
        n = todo.pop(0)
        fitting = [b for b in bins if b[1] - sum(b[0]) >= n]
        if fitting:
            room = min(b[1] - sum(b[0]) for b in fitting)
            chosen = [b for b in fitting if b[1] - sum(b[0]) == room][-1]
            chosen[0].append(n)
            bins.remove(chosen)
            bins.append(chosen)
            continue
        best = None
        for size, cost in zip(sizes, costs, strict=True):
            if size >= n:
                full = n
                for m in todo:
                    if full + m <= size:
                        full += m
                if best is None or cost / full < best[0]:
                    best = cost / full, size
        bins.append(([n], best[1]))
    return sorted((sorted(b), min(s for s in sizes if s >= sum(b))) for b, _ in bins)


@pytest.mark.parametrize("overhead", [0, 32, 2000])
def test_packing_equals_the_naive_packer(overhead):
    r = random.Random(overhead)
    sizes = (16, 64, 256)
    costs = tuple(float(s + overhead) for s in sizes)
    mixes = Counter()
    for _ in range(25):
        lengths = [r.choice([r.randint(1, 256), r.randint(1, 20), 8, 8]) for _ in range(r.randint(1, 60))]
        bins, starts, used, size = packing.pack(np.array(lengths), sizes, costs)
        made = sorted((sorted(n for n, b in zip(lengths, bins.tolist(), strict=True) if b == i), size[i]) for i in range(len(used)))
        assert made == naive_pack(lengths, sizes, costs)
        mixes.update(s for _, s in made)
    assert len(mixes) == 3 or overhead == 2000


def test_packing_keeps_the_type_of_ids(spark):
    df = spark.createDataFrame([("x1", "a b"), ("x1", "a b"), (None, "c"), ("y", None)], "name string, text string")
    out = packing.best_fit_packing(df, packing.word_count(), "name", sizes=(4, 16)).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(["x1", "x1", None, "y"])


def test_packing_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 9000), (4, "a b"), (4, "a b"), (None, "x")], DOCS)
    out = packing.best_fit_packing(df, packing.word_count(), sizes=(4, 16, 4096)).collect()
    got = Counter((x["doc_id"], x["piece"], x["n_tokens"], x["bin_id"] is None) for x in out)
    assert got == Counter({(1, 0, 0, True): 1, (2, 0, 0, True): 1, (3, 0, 4096, False): 1, (3, 1, 4096, False): 1, (3, 2, 808, False): 1, (4, 0, 2, False): 2, (None, 0, 1, False): 1})


def test_every_operator_takes_an_empty_table(spark):
    df = spark.createDataFrame([], DOCS + ", lang string")
    path, model = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")
    for out in (line_dedup.digest(df), substring_dedup.digest(df), langid.digest(df), tokens.digest(df, path), suffix_dedup.digest(df), simhash.digest(df), packing.best_fit_packing(df, packing.word_count()), pieces.piece_digests(df, model), simhash.one_per_group(df)):
        assert out.count() == 0


def test_characters_are_classed_as_the_library_does():
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    some = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"]
    texts = [f"a{x}b {x}{x} 1{x}'s" for x in some]
    assert tokens.counter(path).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_columns_with_clashing_names_pass_through(spark):
    """Every operator that keeps columns, with names that it uses itself, in other cases and with a backtick."""
    names = ["k", "t", "row", "v", "x", "h", "id", "root", "c0", "a", "N_WORDS", "Kept", "score", "b`q"]
    rows = [(i, f"word{i % 3} " * 40 + "\nline", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    path = public.path("word_bpe_49k.json")
    whole = {
        "line": (line_dedup.line_dedup(df), ()),
        "substring": (substring_dedup.substring_dedup(df, "text", 10), ("N_WORDS",)),
        "suffix": (suffix_dedup.without_repeats(df, "text", 60), ()),
        "spans": (suffix_dedup.suffix_dedup(df, "text", 60), ("Kept",)),
        "lang": (langid.predict(df, langid.fit(df.withColumn("lang", F.lit("aa")))), ("score",)),
        "near": (simhash.one_per_group(df), ()),
    }
    for name, (out, replaced) in whole.items():
        got = out.collect()
        assert 0 < len(got) <= 12, name
        for n in names:
            if n not in replaced:
                assert all(x[n] == f"{n}{x['doc_id']}" for x in got), (name, n)
    for out in (line_dedup.digest(df), substring_dedup.digest(df), suffix_dedup.digest(df), simhash.digest(df), tokens.digest(df, path), pieces.piece_digests(df, public.path("piece_bpe_32k.model")), packing.best_fit_packing(df, packing.word_count())):
        assert out.count() == 12
    odd = df.select("doc_id", F.col("text").alias("my`text"))
    assert line_dedup.line_dedup(odd, "my`text").count() == 12
    assert simhash.near_duplicates(odd, "my`text").count() == 12


def test_very_long_texts(spark):
    r = random.Random(13)
    words = [f"w{r.randint(0, 9999)}" for _ in range(200_000)]
    long = " ".join(words)
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], DOCS)
    got = {x["doc_id"]: x for x in simhash.digest(df).collect()}
    assert got[1]["fingerprint"] == f"{simhash.fingerprint(simhash.shingles(long.encode(), 4)) % 2**64:016x}" and got[2]["component_id"] == 1
    assert sorted(x["doc_id"] for x in simhash.one_per_group(df).collect()) == [1, 3]
    assert {x["doc_id"]: x["n_lines"] for x in line_dedup.digest(df).collect()} == {1: 1, 2: 1, 3: 1}
    assert langid.predict(df, langid.fit(df.withColumn("lang", F.lit("aa")))).count() == 3


def test_written_tables_go_at_the_end_of_their_scope(spark):
    from tidemark.llm import common

    df = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    with common.written_tables(spark):
        kept = common.materialize(df, "scoped")
        assert kept.count() == 2
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
