"""Training-data operators against brute force, round trips and edge cases."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelwise.llm")

from panelwise.llm import hamming, langid, licences, mixing, neardup, packing, permutation, quality, queries, urls, warc  # noqa: E402
from panelwise.llm.common import running_within, seeded, stored, word_count  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


# 1 quality

def test_quality_scores_of_held_out_labels(spark):
    rows = queries.op1_quality_discriminant(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held)) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 50000, 9), (3, "word " * 50000, 9), (None, "Some text here.", 9)],
                                 "doc_id long, text string, score int")
    stats = quality.measured(docs, ["doc_id"])
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "doc_id long, quality int")
    model = quality.train(stats, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(stats, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_statistics_do_not_depend_on_neighbours():
    texts = ["One two.", None, "", "THE!! THE!!", "é" * 10, "x ### y"]
    together = quality.statistics(pa.array(texts))
    alone = np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)


# 2 mixing

def best_quotients(targets, house):
    seats = dict.fromkeys(targets, 0)
    for _ in range(house):
        key = min((s for s in targets if targets[s] > 0), key=lambda s: (-targets[s] / (2 * seats[s] + 1), s))
        seats[key] += 1
    return seats


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(1)
    for n in (1, 2, 9, 40):
        targets = {i: rng.choice([0.0, 1.0, 5.0, 120.0]) * rng.random() for i in range(n)}
        targets[0] = 30.0
        df = spark.createDataFrame(list(targets.items()), "position long, target double")
        got = {}
        for r in mixing.quotas(df, 1, shards=4).collect():
            assert r["quota"] >= 0
            got[r["position"]] = got.get(r["position"], 0) + r["quota"]
        want = best_quotients(targets, round(sum(targets.values())))
        assert got == {s: want[s] for s in got} and sum(got.values()) == sum(want.values())


def water_fill(sizes, weights, cap=3):
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        more = {i for i in range(len(sizes)) if i not in capped and left * weights[i] / free > cap * sizes[i] + 1e-9}
        if not more:
            return [cap * sizes[i] if i in capped else left * weights[i] / free for i in range(len(sizes))]
        capped |= more


def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "é", "Z", None, "empty"]) if i else "tiny", rng.randrange(0, 300)) for i in range(1500)]
    rows = [(i, s, 0 if s == "empty" else n) for i, s, n in rows] + [(7, "b", 0), (7, "b", 0)]
    df = stored(spark.createDataFrame(rows, "doc_id long, source string, size long"), "t")
    mixed = stored(mixing.mix(df), "t").collect()
    assert len(mixed) == len(rows)
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    want = dict(zip(names, water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for name in names:
        own = [r for r in mixed if r["source"] == name]
        assert all(abs(r["target"] - want[name]) < 1e-6 * max(1, want[name]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[name]) <= 0.02 * want[name] + 3
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    parts = mixing.pieces(mixing.mix(df)).groupBy("doc_id").agg(F.sum("words").alias("w")).collect()
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert {r["doc_id"]: r["w"] for r in parts} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(stored(df.where("source = 'empty'"), "t")).agg(F.sum("taken")).first()[0] == 0


def test_running_sums_with_a_hot_group(spark):
    rows = [(i, None if i % 3 else str(i % 7), i % 11) for i in range(3000)]
    df = stored(spark.createDataFrame(rows, "id long, g string, v long"), "t")
    got = running_within(df, "g", F.col("v"), seeded(1, F.col("id")), ["id"], "before").withColumn("u", seeded(1, F.col("id"))).collect()
    total = {}
    for r in sorted(got, key=lambda r: (r["u"], r["id"])):
        assert r["before"] == total.get(r["g"], 0)
        total[r["g"]] = r["before"] + r["v"]


# 3 languages

def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(7, 3)).astype(np.float32) * 2
    best = max(itertools.product(range(3), repeat=7), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])))
    for block in (1, 2, 3, 100):
        assert tuple(langid.decode(scores, np.array([0, 7]), 1.5, block)) == best


def test_languages_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    model = langid.train(docs)
    got = langid.identify(docs, model, out="lang_found").select("lang", "lang_found.lang").collect()
    assert sum(a == b for a, b in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the and of " * 30000, "x"), (4, "the", "x")], "doc_id long, text string, language string")
    found = {r["doc_id"]: r["language"] for r in langid.identify(odd, model).collect()}
    assert [found[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and found[3]["spans"] == [] and found[4]["lang"] == "en"
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"]["lang"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_scripts_and_spans(spark):
    docs = spark.createDataFrame([(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en"), (3, "γεια σου κοσμε", "el")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    text = "hello world how are you " * 3 + "привет мир как дела " * 3
    found = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()["language"]
    assert [s["lang"] for s in found["spans"]] == ["en", "ru"] and found["spans"][1]["first_word"] == 15


# 4 urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "", "block")]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)] if url else []
    return (host, path, *(max(fits)[:0:-1] if fits else (None, "allow")))


def test_urls_against_rules(spark):
    urls_ = ["http://x.Example.NET/en/1?q#f", "http://example.net/de", "https://net/", "https://net", "http://notnet/", "ftp://w.example.com/de/", "http://example.com/d",
             "http://b.org/fr/x", None, "", "no scheme", "://", "http://?x://net/", "http://a.b?c", "http://c.a.b", "http://É.net/é", "http://x.net/\n/y", "a://b://net/",
             "http://..net/", "http://" + "a." * 3000 + "net/" + "y/" * 3000]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_ * 2)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.filter_urls(df, rules).collect()
    assert len(got) == len(urls_) * 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"]), r["url"]
    listed = spark.createDataFrame([("http://Q.org/x?y",), (None,)], "url string")
    more = spark.createDataFrame([(1, "https://q.org/x#z"), (2, "https://q.org/xy")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(more, rules, listed).collect()} == {1: "block", 2: "allow"}
    assert urls.filter_urls(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(more, rules.where("false")).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = urls.bloom_filter(keys, "key", 1250)
    asked = spark.range(20000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("block", urls._block(F.col("key"), 1250)).withColumn("mask", urls._mask(F.col("key")))
    hits = asked.join(bits, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    assert hits.where("id < 5000").count() == 5000 and hits.count() < 5000 + 1500


# 5 near duplicates

def components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def shingles(text, width):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("family", [3, 1000])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, family):
    monkeypatch.setattr(neardup, "FAMILY", family)
    monkeypatch.setattr(neardup, "TILE", 4)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9000)}"
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base  # chains drift away
    texts += ["", None, "  \n", "one", "ONE", "one two", "One\tTWO", "é È", "é è", "a b", "b a"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t) for i, t in zip(order, texts)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    for width in (2, 5) if family == 3 else (2,):
        sets = {i: shingles(t, width) for i, t in rows}
        want = components(sets, 80)
        got = neardup.near_duplicates(docs, width=width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
        assert sorted(r["doc_id"] for r in neardup.one_of_each(docs, width=width).collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, None), (9, "long " * 100000)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, 5, False), (3, 3, True), (5, 5, True), (5, 5, True), (9, 9, True)]
    assert neardup.near_duplicates(docs.where("false")).count() == 0
    assert sorted(r["doc_id"] or -1 for r in neardup.one_of_each(docs).collect()) == [-1, 3, 5, 9]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    near, far = [], []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 1000, dtype=np.int64).astype(np.uint64)
        for share, out in ((0.8, near), (0.3, far)):
            other = base.copy()
            change = round(1000 * (1 - share) / (1 + share))
            other[:change] = rng.integers(0, 1 << 62, change, dtype=np.int64).astype(np.uint64)
            s = neardup.odd_sketches(np.stack([neardup.minhash(base), neardup.minhash(other)]))
            out.append(sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1]))
    limit = neardup.most_different_bits(neardup.CUT)
    assert max(near) <= limit and min(far) > limit


# 6 binary codes

def test_hamming_against_brute_force(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (300, 20))
    bits[100:180] = bits[3]  # a hot code
    rows = [(i, b.tolist()) for i, b in enumerate(bits)] + [(900, None), (901, [1] * 19), (902, [2] * 20), (903, [None] * 20), (5, bits[5].tolist())]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    for width, k in ((7, 10), (16, 3), (4, 400)):
        got = {}
        for r in hamming.top_k(df, df.where("id % 100 = 0"), 20, k, width=width).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
        for q in (0, 100, 200):
            want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:k]
            if k < 100:  # codes keep the k + 1 smallest ids, so only the k nearest are complete
                assert [(d, i) for _, d, i in sorted(got[q])] == want
            else:
                assert len(got[q]) == 299
        assert set(got) == {0, 100, 200}
    assert hamming.top_k(df.where("false"), df.where("false"), 20).count() == 0


# 7 permutation index

def test_permutation_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = {}
    for r in queries.op7_permutation_search(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, found in got.items():
        apart = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        hits += len({i for _, i, _ in found} & {i for _, i in apart[:10]})
        total += 10
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) < 1e-12 for _, i, s in found)
    assert set(got) == {i for i in vectors if i % 100 == 0} and hits >= 0.9 * total


def test_permutation_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)] + [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 140)]
    bad = [(200, None), (300, [0.0] * 4), (400, [float("nan")] * 4), (500, [None, 1.0, 1.0, 1.0]), (600, [1.0]), (700, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = permutation.nearest(df, df.where("vec_id % 100 = 0"), k=5).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [0, 101, 102, 103, 104]
    assert permutation.nearest(df.where("false"), df.where("false")).count() == 0


# 8 packing

def waste(lengths, counts, edges):
    return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(30):
        d = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(60, d, replace=False)).astype(np.int64)
        counts = rng.integers(1, 30, d)
        for k in (1, 2, 3, 8):
            got = packing.best_boundaries(lengths, counts, k)
            best = min(waste(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, d)) for c in itertools.combinations(lengths[:-1], n))
            assert len(got) <= k and got[-1] == lengths[-1] and waste(lengths, counts, got) == best


def test_packing_batches(spark):
    rng = random.Random(9)
    rows = [(i, None if i == 5 else rng.choice([0, 3, 50, 700, 5000, 90000])) for i in range(400)] + [(1, 3), (1, 3)]
    df = stored(spark.createDataFrame(rows, "doc_id long, size long"), "t")
    got = packing.pack(df, "size", budget=10000).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r["padding"] == r["bucket_length"] - (r["size"] or 0) >= 0
        batches.setdefault((r["bucket"], r["bucket_length"], r["batch"]), []).append(r["slot"])
    for (bucket, bound, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * bound <= 10000 or len(slots) == 1)
    assert packing.pack(df.where("false"), "size").count() == 0


def test_packing_is_optimal_on_long_texts(spark):
    rng = np.random.default_rng(11)
    lengths = np.sort(rng.choice(np.arange(900, 20000), 14, replace=False))
    counts = rng.integers(1, 6, 14)
    df = stored(spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.repeat(lengths, counts))], "doc_id long, size long"), "t")
    got = packing.pack(df, "size", buckets=4).collect()
    best = min(waste(lengths, counts, [*c, lengths[-1]]) for n in range(4) for c in itertools.combinations(lengths[:-1], n))
    assert sum(r["padding"] for r in got) == best and max(r["bucket_length"] for r in got) == lengths[-1]


# 9 archives

def test_archive_round_trip(spark, tmp_path):
    big, other = "é<p>\r\n\r\nWARC/1.1" * 100, "x" * 1200
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "http://c", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None), (7, "http://g", ""),
            (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other), (10, "long", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, keepers, files = warc.archive_index(pages, file_bytes=5000)
    archives = warc.write_archives(pages, keepers, files, str(tmp_path / "warc"))
    sizes = {r["file"]: r["size"] for r in archives.collect()}
    ends = {r["file"]: r["e"] for r in index.groupBy("file").agg(F.max(F.col("offset") + F.col("length") + 4).alias("e")).collect()}
    assert files > 1 and sizes == ends
    got = warc.read_records(index, archives, with_payload=True).collect()
    import hashlib
    facts = sorted((r["id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got)
    want = []
    keeper = {big: 3, other: 9}
    for i, _, html in rows:
        body = (html or "").encode()
        k = keeper.get(html)
        want.append((i or 0, len(body), hashlib.sha1(body).hexdigest(), "response" if k in (None, i) else "revisit", 0 if k in (None, i) else k))
    assert facts == sorted(want)
    assert {r["id"]: r["payload"] for r in got if r["id"] in (3, 6)} == {3: big.encode(), 6: b""}
    some = warc.read_records(index.where("id IN (4, 10)"), archives).collect()
    assert sorted(r["id"] for r in some) == [4, 10]


# 10 licences

def cosine(text, weights, vector):
    count = {}
    for t in licences.terms(text):
        count[t] = count.get(t, 0) + 1
    own = {t: n * weights.idf.get(t, weights.unknown) for t, n in count.items()}
    norm = math.sqrt(sum(w * w for w in own.values()))
    return sum(w * vector.get(t, 0) for t, w in own.items()) / norm if norm else 0.0


def statement_list(text):
    return re.sub(r"([.!?:;])[ \t\n\x0b\f\r]+", r"\1\n", text or "").split("\n")


def test_licences_against_brute_force(spark):
    rows = [("p/LICENSE", "MIT License\n" + licences.TEMPLATES[8][1]), ("p/a/x.py", "code\nLicensed under CC BY-NC 4.0. More."), ("p/a/y.py", "no notice here"), ("p/b/c/z.py", None),
            ("q/x.py", ""), ("q/COPYING", "released under the mit licence"), ("r", "This work is licensed under the GNU General Public License, version 3."),
            ("p/a/COPYING", "Licensed under the Apache License, Version 2.0"), ("s/t", "the under this work version " * 2000), (None, "Released under the MIT License.")]
    files = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(rows)], "k long, path string, text string, licence string")
    weights = licences.Weights()
    got = {r["k"]: r for r in licences.scan(files, "k", "path", F.col("text")).collect()}
    for i, (_, text) in enumerate(rows):
        best = max(((round(cosine(s, weights, v), 9), n) for s in statement_list(text) for v, (n, _) in zip(weights.vectors, licences.TEMPLATES)), default=(0, None))
        assert (got[i]["origin"] == "notice") == (best[0] >= 0.6), (i, best)
        if best[0] >= 0.6:
            assert got[i]["licence"] == best[1] and abs(got[i]["score"] - best[0]) < 1e-8
    assert (got[2]["licence"], got[2]["from_directory"]) == ("Apache-2.0", "p/a/")
    assert (got[3]["licence"], got[3]["from_directory"]) == ("MIT", "p/")
    assert got[4]["origin"] == ("directory" if got[5]["origin"] == "notice" else "none")
    assert licences.scan(files.where("false"), "k", "path", F.col("text")).count() == 0


def test_ordinary_notices(spark):
    mit, apache = "MIT", "Apache-2.0"
    rows = [("This project is licensed under the MIT License.", mit), ("Available under the MIT License", mit), ("code under the terms of the MIT license", mit),
            ("This project and all of its documentation is licensed under the Apache License, Version 2.0.", apache),
            ("Released under the MIT License unless noted otherwise below by the author", mit), ("words " * 3000 + "released under the MIT License " + "more " * 3000, mit),
            ("<p>x</p><!-- Licensed under CC BY-NC 4.0 --><p>y</p>", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("MIT License\n\nCopyright", mit),
            ("Apache License\nVersion 2.0, January 2004", apache), ("BSD 3-Clause License", "BSD-3-Clause"),
            ("under MIT supervision", None), ("Er kam mit einer Lizenz", None), ("the license of this work is unknown", None)]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t, _) in enumerate(rows)], "k long, path string, text string")
    got = {r["k"]: r["licence"] for r in licences.scan(files, "k", "path", licences.visible_text(F.col("text"))).collect()}
    assert [got[i] for i in range(len(rows))] == [name for _, name in rows]


def test_word_count(spark):
    texts = ["a b", "", None, " x\ty\x0bz\u00a0w ", "é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(words_of(t)) for t in texts]
