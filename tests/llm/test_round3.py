"""Periodic runs, near-duplicate vectors and the audit of filters against brute force and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidewater.llm import queries as Q
from tidewater.llm.audit import audit, failures
from tidewater.llm.periodic import periodic_runs, range_minima, runs_of_rows

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def brute_runs(x, least=12):
    """Period by period; of a stretch with several periods, the smallest divides the others."""
    x, found = np.array(x), []
    for p in range(1, len(x) // 2 + 1):
        step = np.diff(np.concatenate([[0], (x[:-p] == x[p:]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            n = j - i + p
            if n >= max(2 * p, least) and not any(p % q == 0 and s <= i and s + m >= i + n for s, m, q in found):
                found.append((i, n, p))
    return sorted(found)


def numbered(words):
    ids = {}
    return [ids.setdefault(w, len(ids)) for w in words]


def collapsed(words, runs):
    drop = set()
    for s, n, p in runs:
        drop.update(range(s + p, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(400):
        rows = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 20])
            x = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a, p = rng.randrange(n), rng.randint(1, 20)
                x = [x[i] if i < a else x[a + (i - a) % p] if a + (i - a) % p < n else 7 for i in range(n)]
            rows.append(x)
        h = np.array(sum(rows, []), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
        got = [tuple(r) for r in runs_of_rows(h, np.append(0, np.cumsum([len(x) for x in rows]))).tolist()]
        assert got == [(i, *r) for i, x in enumerate(rows) for r in brute_runs(x)]
    v = np.array([5, 3, 4, 1, 9, 2])
    lo, hi = np.array([(i, j) for i in range(6) for j in range(i, 6)]).T
    assert range_minima(v, lo, hi).tolist() == [v[i : j + 1].min() for i, j in zip(lo, hi, strict=True)]


def test_runs_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.queries()["op11_periodic_runs"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute_runs(numbered(w))
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if want else None
        assert tuple(r) == (r.doc_id, len(want), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in want)), sha(collapsed(w, want)))


def test_runs_of_odd_texts(spark):
    words = [f"w{i}" for i in range(1000)]
    texts = {1: None, 2: "", 3: " \n\t", 4: "a " * 300_000, 5: "a b\n" * 6, 6: "a b " * 5 + "a", 7: " ".join(words * 200), 8: "é 日本 é 日本\tx " * 4, 9: "x " * 12 + "y " * 12, 10: " ".join(words)}
    rows = [(k, t, "z", 1) for k, t in texts.items()] + [(None, "a b " * 8, "z", 1), (5, "a b\n" * 6, "z", 1)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")).collect()
    assert len(got) == 12 and sorted(tuple(map(tuple, r.runs)) for r in got if r.doc_id == 5) == [((0, 12, 2),)] * 2
    for r in got:
        w = (texts[r.doc_id] if r.doc_id else "a b " * 8) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        want = [(0, 300_000, 1)] if r.doc_id == 4 else [(0, 200_000, 1000)] if r.doc_id == 7 else brute_runs(numbered(w))
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(w, want)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="least"):
        periodic_runs(spark.createDataFrame([], "doc_id long, text string"), 11)


def against_sql(spark, name, tables):
    """The query's rows and its SQL's over made tables; the query reads them as files."""
    import os
    import tempfile

    folder, db = tempfile.mkdtemp(prefix="spark-"), duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(os.path.join(folder, f"{t}.parquet"))
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = Q.queries()[name](spark, f"file://{folder}")
    cols = ", ".join(got.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(db.execute(f"select {cols} from ({Q.oracle_sql()[name]})").fetchall(), key=repr)


def test_audit_against_sql(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "日本", "x"]
    rows = [(None, "x y", "en"), (None, "x y", None), (50, None, None), (51, "", "en"), (52, "", "de"), (53, "#" * 100_000, "en"), (53, "#" * 100_000, "en"), (54, "Ab " * 300_000, "fr")]
    for i in range(300):
        w = [rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 5, 199, 200, 201, 300]))]
        rows.append((rng.randrange(250), rng.choice([" ", "\n", "\t\v "]).join(w), rng.choice(["en", "de", None, ""])))
    rows += rows[20:120]
    docs = spark.createDataFrame([(*r, i, "E") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, part string").select("doc_id", "text", "lang", "n")
    labels = spark.createDataFrame([(i % 200 if i % 17 else None, [0, 1, None][i % 3], i % 2) for i in range(260)], "doc_id long, quality int, toxic int")
    got, want = against_sql(spark, "op13_filter_audit", {"documents": docs, "labels": labels})
    assert got == want and len(got) == 600 * 4
    assert audit(docs.limit(0), labels).collect() == [] and len(audit(docs, labels.limit(0)).collect()) == 2400
    by = {r.doc_id: r for r in failures(spark.createDataFrame([(2, "a", "E"), (1, "a", "E"), (1, "a", "E"), (None, "a", "E"), (3, "b", "E")], "doc_id long, text string, lang string")).collect()}
    assert [by[k].E for k in (1, 2, 3, None)] == [False, True, False, False]


def test_quality_learns_of_each_document_once(spark, monkeypatch):
    """3,000 repeats of a labelled document weigh no more than one, and no more rows reach the driver than the sample's."""
    from tidewater.llm import quality

    seen = []
    learn = quality.Ranker.learn.__func__
    monkeypatch.setattr(quality.Ranker, "learn", classmethod(lambda cls, x, y: seen.append(x) or learn(cls, x, y)))
    texts = [(i, f"word{i} and more " * (i + 1)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(texts, "doc_id long, text string"), labels, held_out=False)
    often = quality.train(spark.createDataFrame(texts + [texts[3]] * 3000, "doc_id long, text string"), labels, held_out=False)
    assert [len(x) for x in seen] == [20, 20] and (once.weights == often.weights).all() and once.threshold == often.threshold
    quality.train(spark.createDataFrame(texts + [texts[3]] * 3000 + [(3, "another")], "doc_id long, text string"), labels, sample=2, held_out=False)
    assert len(seen[-1]) <= 2


def test_quality_query(spark):
    """Every document is scored, and those held out from learning mostly as their labels say."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.queries()["op5_quality"](spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    marked = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [r.predicted == q for r, q in marked if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.9


def test_packing_of_white_space(spark):
    import public_tokenizers as P

    from tests.llm.test_operators import check_packed
    from tidewater.llm.packing import pack

    texts = {1: " " * 3_000_000, 2: "a" + " \n" * 700_000 + "b", 3: "\n" * 1_000_000, 4: "x <|endoftext|>" + "\t" * 20_000 + "<|endoftext|>" + " " * 20_000, 5: "　" * 20_000 + "z"}
    check_packed(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect(), texts)


def test_decoding_of_unknown_ids(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tidewater.llm.bpe import bpe_decode

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lists = [[5, -1, 7, None, 10**6, 2**31 - 1, 9], [], None, [-1], [None], [49151, 49152, 49153, 60000]]
    rows = bpe_decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>"), path).collect()
    for r in rows:
        assert r.ids == lists[r.doc_id] and r.text == lib.decode([i for i in r.ids or [] if i is not None and i >= 0], skip_special_tokens=False)


def clustered(rng, n, dim, groups, spread):
    """Vectors around centres, so that many of them are near the threshold."""
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)]
    return x + spread * rng.standard_normal((n, dim))


def brute_links(rows):
    """(n_links, component) of each row, in order, by every pair."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), {k: k for k, _ in rows if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and (unit[a] * unit[b]).sum() >= 0.95:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return [(k, n[i], find(k)) for i, (k, _) in enumerate(rows) if k is not None]


@pytest.mark.parametrize("block", [2048, 40])
def test_near_vectors(spark, monkeypatch, block):
    """Cells of one block and of many; copies, nulls, zeros, other lengths, repeated ids."""
    from tidewater.llm import collisions

    monkeypatch.setattr(collisions, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(rng, 400, 16, 12, 0.22), rng.standard_normal((200, 16))]).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(1000)[: len(x)], x, strict=True)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(3000, [2.0 * v for v in rows[1][1]]), (3001, rows[2][1][:8]), (3002, rows[2][1][:8]), (rows[3][0], rows[3][1]), (rows[4][0], [-v for v in rows[4][1]])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [None] * 16), (4005, [float("inf")] * 16), (4006, [0.0] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, links int, c string")
    got = sorted(tuple(r) for r in collisions.near_vectors(df).collect())
    want = sorted(brute_links(rows))
    assert sum(n for _, n, _ in want) > 3000 and len({c for *_, c in want}) < len(want) - 300
    assert got == want
    assert collisions.near_vectors(df.limit(0)).collect() == [] and collisions.near_vectors(df.where("vec_id = 4000")).collect()[0][1:] == (0, 4000)


def test_near_vectors_query_against_sql(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 300, 64, 40, 0.15)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    got, want = against_sql(spark, "op12_near_vectors", {"embeddings": df})
    assert got == want and sum(r[1] for r in got) > 200


def test_collisions_are_calibrated():
    """A pair at the threshold shares a cell and collides often enough but with the stated probability; distant ones seldom collide."""
    from tidewater.llm import collisions as K

    least = K.least_collisions(K.PROJECTIONS, K.WIDTH, K.MISS)
    rng = np.random.default_rng(5)
    n, d = 20_000, 32
    a = rng.standard_normal((n, d))
    b = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    reach = K.WIDTH * np.sqrt(2 - 2 * 0.95)
    p, q = (x @ K._directions(5, 1, K.PROJECTIONS, d).T for x in (a, b))
    assert ((np.abs(p - q) <= reach).sum(1) < least).mean() < 10 * K.MISS
    assert ((np.abs(p - q[::-1]) <= reach).sum(1) >= least).mean() < 0.02
    bits, tables = K.tables_of_cells(n, 2048, 0.95, K.MISS)
    s, t = ((x @ K._directions(5, 0, bits * tables, d).T >= 0).reshape(n, tables, bits) for x in (a, b))
    assert (~(s == t).all(2).any(1)).mean() < 10 * K.MISS
