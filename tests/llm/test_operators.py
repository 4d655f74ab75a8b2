"""The other operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import queries as Q
from tidewater.llm.bpe import WordBPE, bpe_digests, decode, encode
from tidewater.llm.lm import stupid_backoff
from tidewater.llm.packing import Tokens, pack
from tidewater.llm.preferences import format_preferences
from tidewater.llm.quality import keep_good, score_quality, train
from tidewater.llm.urls import judge
from tidewater.llm.vectors import exact_top_k, near_neighbours

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "a", "It's  DON'T\n\nwe'll <|endoftext|>x <|startoftext|> y ", "ΣΑΣ İstanbul é naïve 12345 ½ ²", "a\xa0 b c\x1cd\x85 e", "日本語　テスト 😀😀", "ab" * 3000, "'''s''t <|x|>", "x " * 5000, "\0\0 \0", "a", "a"]


def odd(spark):
    return spark.createDataFrame([(i, t, "z", 3, "h") for i, t in enumerate(ODD)], "doc_id long, text string, block string, n int, ids string")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bpe(spark, docs):
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordBPE(P.path("word_bpe_49k.json"))
    texts = [docs[k] for k in sorted(docs)[:150]] + [t or "" for t in ODD]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(own, t) == e.ids
        assert decode(own, e.ids) == lib.decode(e.ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in bpe_digests(odd(spark), P.path("word_bpe_49k.json")).collect()}
    want = {}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_bpe_encodes_and_decodes(spark):
    from tidewater.llm.bpe import bpe_decode, bpe_encode

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: (r.ids, r.text) for r in bpe_decode(bpe_encode(odd(spark), path), path).collect()}
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert got == {i: (x, lib.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids)}
    made = spark.createDataFrame([(1, ids[4]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe_decode(made.coalesce(1), path).collect()] == [got[4][1], "", ""]


def test_bpe_over_the_whole_table(spark):
    sf, lib = "/root/testdata/sf0.001", Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in Q.queries()["op2_bpe"](spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = [e.ids for e in lib.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    assert got == {r.doc_id: (len(x), sha(" ".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for r, x in zip(rows, ids, strict=True)}


def test_bpe_characters_and_long_words():
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordBPE(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    points = [0x107BB, 0x10940, 0x1C89, 0x10D50, 0x2EBF0, 0x1E4D0, *(c for c in rng.sample(range(0x110000), 20_000) if not 0xD800 <= c < 0xE000)]
    chunks = [f"a{chr(c)}B" for c in points if c not in (9, 10, 11, 12, 13, 32)]
    ids, _, _ = own.render(chunks)
    assert ids == [" ".join(map(str, e.ids)) for e in lib.encode_batch(chunks, add_special_tokens=False)]
    for n in (255, 256, 257, 3000):
        for _ in range(5):
            w = "".join(rng.choice(["ab", "é", "the", "ing", "日"]) for _ in range(n))
            assert encode(own, w) == lib.encode(w, add_special_tokens=False).ids


def test_empty_and_null_tables(spark):
    empty, nulls = odd(spark).limit(0), spark.createDataFrame([(None, None), (None, "a b"), (1, None)], "doc_id long, text string")
    assert bpe_digests(empty, P.path("word_bpe_49k.json")).collect() == []
    assert len(bpe_digests(nulls, P.path("word_bpe_49k.json")).collect()) == 3
    labels = spark.createDataFrame([(1, 1), (None, 0), (1, None)], "doc_id long, quality int")
    ranker = train(nulls, labels)
    assert score_quality(empty, ranker).collect() == [] and [r.held_out for r in score_quality(nulls, ranker).collect()].count(None) == 2
    assert keep_good(empty, labels).collect() == []
    v, _ = vectors(spark)
    assert near_neighbours(v.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in exact_top_k(v.where("vec_id in (100, 1)")).collect()] == [(100, 1, 1)]
    assert len(stupid_backoff(nulls).collect()) == 1
    got = pack(nulls.coalesce(1), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (0, 3), (1, 1)] and len({r.sequence_id for r in got}) == 1


def test_very_long_texts(spark):
    """Texts beyond every slice, block and window: all of them count."""
    from tidewater.llm.minhash import near_duplicates
    from tidewater.llm.suffix import without_repeats

    rng = random.Random(2)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(200_000))
    tail = long[-100_000:]
    texts = {1: long, 2: long + " end", 3: "x" * 300_000, 4: tail, 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in bpe_digests(df, P.path("word_bpe_49k.json")).collect()}
    assert got == {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.n_words for r in stupid_backoff(df).collect()} == {k: len((t or "").split()) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in without_repeats(df).collect()} == {1: "", 2: " end", 3: "", 4: "", 5: None}
    check_packed(pack(df, P.path("byte_bpe_50k.json")).collect(), texts)
    scored = score_quality(df, train(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"), held_out=False)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)


def check_packed(rows, texts):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: np.array([*e.ids, 0], "<u4") for k, e in zip(texts, lib.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for k, x in ids.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(x)
    lost = 0
    for x in by_seq.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        lost += 1024 - at
    return lost / sum(map(len, ids.values()))


def test_packing(spark, docs):
    assert check_packed(Q.queries()["op9_packing"](spark, SF).collect(), docs) < 0.005
    check_packed(pack(odd(spark).repartition(3), P.path("byte_bpe_50k.json")).collect(), dict(enumerate(ODD)))
    assert pack(odd(spark).limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_packed_ids(spark):
    import corpus_pipeline

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    for rows in (pack(odd(spark).repartition(3), P.path("byte_bpe_50k.json")).collect(), corpus_pipeline.packing(spark, odd(spark), SF).collect()):
        by_doc, by_seq = {}, {}
        for r in sorted(rows, key=lambda r: (r.start, r.offset)):
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
            by_doc.setdefault(r.doc_id, []).extend(ids)
            by_seq.setdefault(r.sequence_id, {})[r.offset] = ids
        assert by_doc == want
        for x in by_seq.values():
            whole = [i for k in sorted(x) for i in x[k]]
            assert 0 < len(whole) <= 1024
    assert Q.queries()["op9_packing"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_tokens_of_long_texts(monkeypatch):
    import tidewater.llm.packing as m

    monkeypatch.setattr(m, "LONG", 50)
    lib, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokens(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice(["a", "b'll", " ", "  ", "\n", "\xa0", "é", "<|endoftext|>", "12"]) for _ in range(300))
        assert own(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_backoff(texts, order, backoff=0.4, least=2):
    split = {k: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for k, t in texts.items()}
    c = Counter(tuple(w[i : i + n]) for w in split.values() for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, split.values()))
    out = {}
    for k, w in split.items():
        s = uni = 0
        for i in range(len(w)):
            top = n = min(order, i + 1)
            while n > 1 and c[tuple(w[i - n + 1 : i + 1])] < least:
                n -= 1
            g = tuple(w[i - n + 1 : i + 1])
            s += math.log(backoff ** (top - n) * c[g] / (c[g[:-1]] if n > 1 else total))
            uni += n == 1
        out[k] = (len(w), uni, s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, order, monkeypatch):
    import tidewater.llm.lm as m

    texts = dict(enumerate(ODD + [" ".join(random.Random(i).choice("abcde") for _ in range(50 * i)) for i in range(20)]))
    df = spark.createDataFrame([(k, t, 1, "p") for k, t in texts.items()], "doc_id long, text string, part int, grams string")
    for block in (2000, 1 << 23):
        monkeypatch.setattr(m, "BLOCK", block)
        got = {r.doc_id: (r.n_words, r.n_unigram, r.score) for r in stupid_backoff(df, order=order).collect()}
        want = brute_backoff(texts, order)
        assert got.keys() == want.keys()
        for k, (n, u, s) in want.items():
            assert got[k][:2] == (n, u) and abs(got[k][2] - s) < 1e-2
    assert stupid_backoff(df.limit(0)).collect() == []


def test_count_tables(spark, monkeypatch):
    import tidewater.llm.lm as m

    monkeypatch.setattr(m, "BLOCK", 500)
    texts = ODD + [" ".join(random.Random(i).choice("abcd") for _ in range(60)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    got = m.count_tables(df, 3).collect()
    for n in (1, 2, 3):
        c = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
        assert sorted(r["count"] for r in got if r.n == n) == sorted(k for k in c.values() if k > 1)


def vectors(spark):
    rng = np.random.default_rng(5)
    v = [x.tolist() for x in rng.standard_normal((1500, 16)) * 0.2]
    v[7], v[8], v[9], v[100], v[11] = None, [0.0] * 16, [float("nan")] + [0.1] * 15, v[200], [None] + [0.1] * 15
    v[12], v[13], v[14] = [], v[200], v[200]
    return spark.createDataFrame([(i, x, 1, 2.0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, block int, score double"), v


def usable(v, zero):
    return {i: np.array(x, np.float32).astype(float) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and (zero or np.any(np.array(x) != 0))}


@pytest.mark.parametrize("block", [64, 8192])
def test_top_k(spark, block, monkeypatch):
    import tidewater.llm.vectors as m

    monkeypatch.setattr(m, "BLOCK", block)
    df, v = vectors(spark)
    x = {i: np.floor(1024 * a) for i, a in usable(v, True).items()}
    want = []
    for q in x:
        if q % 100 == 0:
            s = sorted((-int(x[q] @ a), i) for i, a in x.items() if i != q)[:10]
            want += [(q, r, i, -k) for r, (k, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in exact_top_k(df).collect()) == sorted(want)
    assert exact_top_k(df.limit(0)).collect() == []


def test_packets(spark, monkeypatch):
    import tidewater.llm.vectors as m

    df, v = vectors(spark)
    whole = [sorted(tuple(r) for r in f(df).collect()) for f in (exact_top_k, near_neighbours)]
    monkeypatch.setattr(m, "PACKET", 4)
    assert sorted(tuple(r) for r in exact_top_k(df).collect()) == whole[0]
    assert sorted(tuple(r) for r in near_neighbours(df).collect()) == whole[1]

    def sizes(rows, queries):
        n = queries.num_rows
        return queries["vec_id"].to_numpy(), np.full(n, rows.num_rows), np.full(n, n)

    met = m._search(df, 100, 1000, sizes, "long", "vec_id", "embedding", False, 200).collect()
    assert max(r.score for r in met) <= 2 * 4 and max(r.vec_id for r in met) <= 2 * 200
    assert {r.query_id: sum(x.vec_id for x in met if x.query_id == r.query_id) for r in met} == {i: len(usable(v, True)) for i in range(0, 1500, 100)}


def test_near(spark):
    df, v = vectors(spark)
    x = usable(v, False)
    got = {}
    for r in near_neighbours(df).collect():
        assert abs(r.score - x[r.query_id] @ x[r.vec_id] / np.linalg.norm(x[r.query_id]) / np.linalg.norm(x[r.vec_id])) < 1e-12
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hit = n = 0
    for q in x:
        if q % 50 == 0:
            s = sorted((-(x[q] @ a) / np.linalg.norm(x[q]) / np.linalg.norm(a), i) for i, a in x.items() if i != q)[:5]
            assert sorted(got[q]) == [1, 2, 3, 4, 5]
            hit += len({i for _, i in s} & set(got[q].values()))
            n += 5
    assert hit / n >= 0.9


def test_ties_and_repeated_rows(spark, monkeypatch):
    import tidewater.llm.vectors as m

    rng = np.random.default_rng(6)
    some = rng.standard_normal((40, 24))
    v = [(i, some[rng.integers(40)].tolist()) for i in range(600)]
    v += [(50, v[50][1]), (None, v[1][1]), (7, v[7][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    x = dict((i, np.array(a)) for i, a in v if i is not None)
    for block in (100, 1000):
        monkeypatch.setattr(m, "BLOCK", block)
        monkeypatch.setattr(m, "NEAR_BLOCK", block)
        for f, k, every in ((near_neighbours, 5, 50), (exact_top_k, 10, 100)):
            got = {}
            for r in f(df).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert sorted(got) == list(range(0, 600, every))
            for q, found in got.items():
                twins = sorted(i for i in x if i != q and np.array_equal(x[i], x[q]))
                assert [i for i, _ in found][: len(twins)] == twins[:k] and len(found) == k
                assert found == sorted(found, key=lambda t: (-t[1], t[0]))


def test_near_stops(spark):
    """The stopping test holds before all vectors are verified, and loses little."""
    from tidewater.llm.vectors import KdTree, nearest_by_cosine, projected

    rng = np.random.default_rng(7)
    x = rng.standard_normal((20_000, 64))
    norm, ids = np.sqrt((x * x).sum(1)), np.arange(len(x))
    low = projected(x / norm[:, None], 24, 7)
    tree, hit, seen = KdTree(low), 0, 0
    for q in range(0, len(x), 500):
        found, _, n = nearest_by_cosine(tree, x, norm, ids, q, x[q], low[q], 5, 24, 0.9)
        best = np.argsort(-(x @ x[q]) / norm)
        hit, seen = hit + len(set(found) & set(best[best != q][:5].tolist())), seen + n
    assert hit / 200 >= 0.9 and seen / 40 / len(x) < 0.5
    order = [d for batch in ([((low[i] - low[0]) ** 2).sum(-1), reach] for reach, i in tree.nearest(low[0])) for d in [batch]]
    assert all(a[0].max() <= a[1] + 1e-9 for a in order) and sum(len(a[0]) for a in order) == len(x)


def test_near_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in Q.queries()["op8_near_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[i] & set(ids[[k for k in np.argsort(-(x @ x[j])) if ids[k] != i][:5]])) for j, i in enumerate(ids) if i % 50 == 0)
    assert hit / (5 * len(got)) >= 0.9


def test_quality(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    ranker = train(d, labels)
    right = []
    for r in score_quality(d, ranker).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 1000 and np.mean(right) > 0.98
    got = score_quality(odd(spark), ranker).collect()
    assert len(got) == len(ODD) and got[0].score == got[1].score
    kept = {r.doc_id for r in keep_good(d, labels).collect()}
    assert kept == {r.doc_id for r in score_quality(d, ranker).where("predicted = 1").collect()}
    assert train(d, labels.limit(0)).score(np.zeros((1, 44)))[0] >= 0


def test_ranker_against_a_plain_one():
    """The same loss, pairs and threshold, written out."""
    from tidewater.llm.quality import Ranker

    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    x = rng.standard_normal((300, 3)) + y[:, None] * [1.0, -0.5, 0.0]
    r = Ranker.learn(x, y, pairs=400, rounds=1500)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pick = np.random.default_rng(11)
    good, bad = pick.choice(np.flatnonzero(y == 1), 400), pick.choice(np.flatnonzero(y == 0), 400)

    def loss(w):
        return sum(math.log1p(math.exp(-sum(w[j] * (z[a][j] - z[b][j]) for j in range(3)))) for a, b in zip(good, bad, strict=True)) / 400 + 0.5e-4 * sum(v * v for v in w)

    w = np.zeros(3)
    for _ in range(3000):
        d = z[good] - z[bad]
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-4 * w)
    assert abs(loss(r.weights) - loss(w)) < 1e-4 and np.abs(r.weights - w).max() < 0.05
    s = sorted(float(sum(r.weights[j] * z[i][j] for j in range(3))) for i in range(300))
    assert abs(r.threshold - s[math.floor((1 - y.mean()) * 299)]) < 1e-9
    assert abs((r.score(x) >= 0.5).sum() - y.sum()) <= 1


def test_quality_sample(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fits = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    least = [r.doc_id for r in labels.where(fits).orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    assert labels.where(fits).count() > 4 * 60
    twice = labels.unionByName(labels.withColumn("quality", F.lit(1)))
    want = train(d, labels.where(F.col("doc_id").isin(least)), sample=60)
    assert np.array_equal(train(d, labels, sample=60).weights, want.weights)
    assert np.array_equal(train(d, twice, sample=60).weights, want.weights)


def test_urls(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    rows = [(1, "http://A.example.com/en/1", None), (2, "https://www.example.com/en/1", ""), (3, "nothing", None), (4, None, None), (5, "http://b.org/x?q", link("http://c.org/y")),
            (6, "http://c.org/y.html", "<meta http-equiv=refresh content='0; url=http://d.net/fr/1'>"), (7, "http://d.net/fr/1", None), (8, "http://e.org/", link("http://f.com/z")),
            (9, "http://com", None), (10, "http://xcom/", None), (11, "http://b.org/x/#f", None), (12, "http://g.org/", link("/relative")), (7, "http://d.net/fr/1", None), (13, "ftp://Com/?x", None)]
    df = spark.createDataFrame([(*r, "n", "o", "s") for r in rows], "page_id long, url string, html string, node string, own string, spread string")
    got = {r.page_id: tuple(r)[1:] for r in judge(df).collect()}
    assert judge(df).count() == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("b.org", "/x", None, "block") and got[6][3] == "block" and got[11][3] == "block"
    assert got[7][2:] == ("net/fr/", "block") and got[8][3] == "allow"
    assert got[9] == ("com", "", None, "allow") and got[10][2] is None and got[13][2] == "com/"
    links = spark.createDataFrame([("http://g.org", "http://d.net/fr/1/"), ("http://www.example.com/en/1", "http://d.net/fr/1"), (None, "x")], "source string, target string")
    got = {r.page_id: r.verdict for r in judge(df, links=links).collect()}
    assert got[12] == "block" and got[2] == "allow"
    assert judge(df.limit(0)).collect() == []


def test_link_components(spark):
    """Verdicts spread along links as over components found by a plain search, allowed spellings standing firm."""
    rng = random.Random(12)
    hosts = [f"h{i}.{rng.choice(['org', 'net', 'com', 'org', 'org'])}" for i in range(150)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'x', 'y', 'z'])}/{rng.randrange(4)}" for _ in range(700)]
    rows = [(i, u, "".join(f'<link rel=canonical href="{rng.choice(urls)}">' for _ in range(rng.choice([0, 0, 1, 1, 2])))) for i, u in enumerate(urls)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    near = {}
    for _, u, html in rows:
        for x in re.findall('href="([^"]+)"', html):
            near.setdefault(u, set()).add(x)
            near.setdefault(x, set()).add(u)
    rule = lambda u: "com/" if u[7:].split("/")[0].endswith(".com") else next((f"net/{p}/" for p in ("es", "fr") if u[7:].split("/")[0].endswith(".net") and u.split("/")[3] == p), None)
    spread = set()
    todo = [u for u in urls if (rule(u) or "").startswith("net/")]
    while todo:
        u = todo.pop()
        if u not in spread:
            spread.add(u)
            todo += near.get(u, ())
    want = {i: (rule(u), "block" if (rule(u) or "").startswith("net/") or rule(u) is None and u in spread else "allow") for i, u, _ in rows}
    assert got == want and sum(v == (None, "block") for v in want.values()) > 50


def test_relative_links(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [("http://b.net/es/1", None), ("http://b.net/a", link("/es/1")), ("http://c.org/a", link("//b.net/es/1")), ("http://b.net/a/b/c", link("../../es/1?x")), ("http://b.net/d/", link("./../es/./1")),
            ("http://e.org/", link("http://e.org/") + link("http://b.net/es/1/")), ("http://b.net", "<meta http-equiv=refresh content='0; url=es/1'>"), ("http://b.net/x/y", link("z") + link("../../../es/1")),
            ("http://g.org/1", link("/es/1")), ("http://b.net/q", link("?es/1")), ("http://b.net/r", link("#top")), ("http://b.net/s", link("mailto:es/1")), ("http://b.net/t/u", link("es/1")), ("http://b.net/x/z", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert {r.page_id for r in judge(df).where("verdict = 'block'").collect()} == set(range(8)) | {13}


def test_preferences(spark):
    t = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"), (1, 2, "user", "ok"), (2, 0, None, None), (4, 0, "user", "s"), (5, 0, "user", "s"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 9, 8) for r in t], "conv_id long, turn long, role string, text string, side int, pair_id int")
    pairs = spark.createDataFrame([(0, 0, 1, "a"), (1, 2, 3, "a"), (2, 4, 5, "a"), (3, 6, 7, "a"), (4, 3, 2, "a")], "pair_id long, chosen_id long, rejected_id long, a string")
    got = {r.pair_id: tuple(r)[3:] for r in format_preferences(df, pairs).collect()}
    assert got[0] == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyo<|end|>\n", "<|assistant|>\nno<|end|>\n<|user|>\nok<|end|>\n", [14, 10], [14, 10, 19, 0])
    assert got[1] == (0, "", "<||>\n<|end|>\n", "", [13, 0], []) and got[4] == (0, "", "", "<||>\n<|end|>\n", [], [13, 0])
    assert got[2] == (1, "<|user|>\ns<|end|>\n", "", "", [], []) and 3 not in got
    assert format_preferences(df.limit(0), pairs).collect() == []


def test_pipeline_repeated_rows_and_empty(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna"]) + str(rng.randrange(99)) for _ in range(n))
    x, y = text(90), text(80)
    rows = [(5, x), (5, x), (5, y), (3, x + " more"), (7, y), (9, text(60)), (None, x), (8, None), (8, None)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, True) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, stays boolean")
    left = p.near_dedup(spark, df, "")
    assert left.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in left.where("doc_id is not null").collect())
    assert kept == sorted([(3, x + " more"), (5, y), (8, None), (9, rows[5][1])], key=lambda r: r[0]) and left.where("doc_id is null").count() == 1
    same = p.near_dedup(spark, df.where("doc_id = 5 and text like '%{}'".format(x[-20:])), "")
    assert [r.text for r in p.passages(spark, same, "").collect()] == [x]
    for stage in (p.near_dedup, p.passages, p.packing):
        assert stage(spark, df.limit(0), "").collect() == []
    assert p.quality(spark, df.limit(0), "/root/testdata/sf0.001").collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p
    from tests.llm.test_duplicates import brute_classes, brute_removed

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.quality(spark, docs, sf)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns
    left = p.near_dedup(spark, good, sf)
    classes = brute_classes(texts, 5)
    assert {r.doc_id for r in left.collect()} == {k for k, (_, c) in classes.items() if c == k}
    clean = p.passages(spark, left, sf)
    gone = brute_removed({k: texts[k] for k, (_, c) in classes.items() if c == k})
    out = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and out.keys() == gone.keys()
    for k, r in out.items():
        assert r.n_chars == len(r.text) and 0 <= len(r.text.encode()) - (gone[k][0] - gone[k][1]) <= 6 * gone[k][2]
    check_packed(p.run(spark, sf).collect(), {k: r.text for k, r in out.items()})
