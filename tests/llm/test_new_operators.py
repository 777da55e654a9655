"""Whitening, byte-pair encoding and importance resampling against brute force, the tokenizer library and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelwise.llm")

from panelwise.llm import bpe, queries, resampling, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"


# 11 whitening

def expected_whitening(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], np.int64)
    n = len(x)
    total = x.sum(0)
    centred = (n * x - total) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    with np.errstate(all="ignore"):
        white = centred @ axes / np.sqrt(values)
    return x, n, [sum(int(v) ** 2 for v in row) for row in (n * x - total)], white, values / np.trace(cov)


def test_whitening_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, deviation, white, explained = expected_whitening([r["embedding"] for r in table])
    place = {r["vec_id"]: i for i, r in enumerate(table)}
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(rows) == 8 * n
    got = np.zeros((n, 8))
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / explained[c] - 1) < 1e-9
        got[i, c] = r["whitened"]
    sign = np.sign((got * white[:, :8]).sum(0))
    assert np.abs(got - sign * white[:, :8]).max() < 1e-8


def test_whitening_counts_and_ones_with_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 3)).astype(np.float32)
    rows = [(i, base[0 if i % 3 == 0 else i % 40].tolist(), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    for weights, fitted in (("counts", [v for _, v, _ in rows]), ("one", [base[i].tolist() for i in range(40)])):
        x, n, deviation, white, explained = expected_whitening(fitted)
        by_x = {tuple(v): (d, w) for v, d, w in zip(x.tolist(), deviation, white)}
        got = whitening.whiten(df, parts=8, weights=weights).collect()
        assert len(got) == 900 and len({r["vec_id"] for r in got}) == 900
        sign = None
        for r in got:
            d, w = by_x[tuple(math.floor(1024 * c) + 100000 for c in rows[r["vec_id"]][1])]
            sign = np.sign(np.array(r["w"]) * w) if sign is None else sign
            assert int(r["deviation"]) == d and np.allclose(r["w"], sign * w, atol=1e-9) and r["n"] == n
            assert r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.1]), (1, [0.5, 0.1]), (None, [0.7, 0.1]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("id", F.lit(2))
    got = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"]
    assert all(r["w"][1] is None and r["w"][0] is not None for r in got)  # the second component never varies
    assert whitening.whiten(df.where("vec_id = 4")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(alone) == 2 and alone[0]["w"] == [None, None] and int(alone[0]["deviation"]) == 0
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="two")


def test_deviation_beyond_64_bits():
    model = whitening.Whitener(10**10, np.array([0, 0]), np.ones(2), np.eye(2), 2.0)
    assert model.deviation(np.array([[3, 4]], np.int64)) == [25 * 10**20]


# 12 byte-pair encoding

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(queries.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


ODD = ["a", "aa", "A", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "é", "日本", "👍", "\x00", "\x1c", "　", "\xa0", " ", "<|endoftext|>", "<|endof",
       "the", "ing", "-", "....", "====", "\U00031350", "\U00010d40", "Ᲊ", "\U00016d70", "\U000323b0", "\x85", "﻿", "‍"]


def test_encoding_equals_the_library(vocabulary, library):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice(ODD) if rng.random() < 0.8 else chr(rng.choice([*range(0xD800), *range(0xE000, 0x20000)])) for _ in range(rng.randrange(40)))
        if rng.random() < 0.3:
            text = text.replace(" ", rng.choice(["a", "  ", "=", ""]))
        if rng.random() < 0.3:
            text = text.encode("latin-1", "ignore").decode("latin-1") + "½ª\xa0É"
        ids = np.frombuffer(encoder.ids(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_character_classes_are_the_librarys(vocabulary, library):
    letter, number = re.compile(f"[{vocabulary.letters}]"), re.compile(f"[{vocabulary.numbers}]")
    split = library.pre_tokenizer.pre_tokenize_str
    for code in (*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200)):
        char = chr(code)
        assert (len(split("a" + char)) == 1) == bool(letter.match(char)), hex(code)
        assert (len(split("1" + char)) == 1) == bool(number.match(char)), hex(code)


def test_long_texts_in_pieces_are_encoded_whole(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    encoder, rng = bpe.Encoder(vocabulary), random.Random(8)
    for text in ("a" * 20000, "=-" * 9000, " " * 5000, "ab" * 9000 + "c", "".join(rng.choice(ODD) for _ in range(9000)), "one two  three\n\n four " * 900):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_pairs_and_words_may_be_emptied(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    text = "Several words whose pairs and pre-tokens do not fit a memory of five answers."
    assert np.frombuffer(bpe.Encoder(vocabulary).ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_bpe_round_trip(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_edges(spark, vocabulary, library):
    long = "word " * 300000
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (None, "x<|endoftext|>y", 5)], "doc_id long, text string, ids_sha256 int")
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(got) == 5 and all(r["ids_sha256"] == 5 and r["decoded"] == (r["text"] or "") for r in got)
    assert got[0]["ids"] == [] == got[1]["ids"] and len(got[2]["ids"]) == len(library.encode(long, add_special_tokens=False).ids)
    assert 50256 in got[4]["ids"]
    assert bpe.encode(docs.where("false"), vocabulary).count() == 0
    ids = spark.createDataFrame([(None,), ([],), ([-1, 99999999, 64, None],), ([222],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, vocabulary).collect()] == [None, "", library.decode([64]), library.decode([222])]


# 13 importance resampling

def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected_sample(docs, targets):
    found = {i: features(t) for i, t in docs.items()}
    source, target = Counter(b for _, f in found.values() for b in f), Counter(b for t in targets for b in features(t)[1])
    total, wanted = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1.0) * (total + 10000) / ((source[b] + 1.0) * (wanted + 10000)))) for b in source}
    out = {}
    for i, (n, f) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in docs if found[i][0] >= 20), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(able[:5 * len(able) // 100]):
        out[i][3] = k + 1
    return out


def test_resampling_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = expected_sample(docs, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in queries.op13_importance_resampling(spark, SF).collect()}
    assert got == expected and sum(v[3] is not None for v in got.values()) > 0


def test_grams_across_documents_blocks_and_long_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abzAZ09 .\n\x00éü日👍{`@") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["x" * 5000 + " y " + "z" * 70000 + " " + "q" * 100 + " b", "", "a", "a b", "a b c"]
    for block in (1, 2, 3, 97, 1 << 18):
        monkeypatch.setattr(resampling, "BLOCK", block)
        counts = [Counter() for _ in texts]
        for doc, code in resampling.grams([t.encode() for t in texts]):
            for d, c in zip(doc.tolist(), code.tolist()):
                counts[d][c % 10000] += 1
        assert counts == [Counter(features(t)[1]) for t in texts]


def test_resampling_edges(spark):
    schema = "doc_id long, text string, weight int, _text string"
    same = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None, 0, "a"), (2, "", 0, "a"), (3, "One", 0, "a"), (4, "word " * 200000, 0, "a"), (None, same, 0, "a")] + [(9, same, 0, "a")] * 60, schema)
    target = spark.createDataFrame([(1, same), (2, None)], "item_id long, text string")
    got = resampling.resample(docs, target).collect()
    assert len(got) == 65 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]  # 62 have 20 words
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_features"] == by_id[2]["n_features"] == by_id[1]["weight"] == 0 and by_id[3]["n_features"] == 1
    assert by_id[4]["n_features"] == 3 * 200000 - 3
    assert resampling.resample(docs.where("false"), target).count() == 0
    assert resampling.resample(docs, target.where("false")).count() == 65


# 4 url filters: ties and null urls

def test_equally_long_rules_and_null_urls(spark):
    from panelwise.llm import urls

    pages = spark.createDataFrame([(1, "http://a.b.com/xx/1"), (2, None), (3, "no scheme"), (4, "http://a.b.com/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("b.com", "/xx", "allow"), ("a.b.com", "/", "allow"), ("", "", "block")], "host string, path string, verdict string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {(1, "a.b.com/", "allow"), (2, "", "block"), (3, "", "block"), (4, "a.b.com/", "allow")}  # of equal length the smaller text
    assert urls.filter_urls(pages, rules).count() == 5
    tied = spark.createDataFrame([("b.com", "/xx", "block"), ("a.b.com", "/", "allow")], "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, tied).collect()}[1] == "block"
