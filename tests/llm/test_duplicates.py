"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewater.llm.components import components
from tidewater.llm.minhash import near_duplicates, op10_minhash
from tidewater.llm.suffix import op3_suffix_array, repeated_spans, repeated_windows, without_repeats

SF = "/root/testdata/sf0.001"


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(docs, n):
    sets = {k: shingles(t, n) for k, t in docs.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def brute_removed(docs, length=200):
    seen = defaultdict(list)
    raw = {k: (t or "").encode() for k, t in docs.items()}
    for k, b in raw.items():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((k, i))
    gone = {k: np.zeros(len(b), bool) for k, b in raw.items()}
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + length] = True
    out = {}
    for k, b in raw.items():
        g = gone[k]
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out[k] = (len(b), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def odd(spark, rng):
    """Nulls, empty and long texts, repeats, periodic texts, one hot passage, and columns whose names clash."""
    base = "".join(rng.choice("abcdé ") for _ in range(900))
    rows = [None, "", " ", "x", base, base, base[:450] + "Q" + base[450:], "The " * 300, "é" * 400, "\0" * 300, base[100:420] * 3, "".join(rng.choice("abc ") for _ in range(30_000))]
    rows += ["".join(rng.choice("abcdefg ") for _ in range(250)) + base[:230] + "".join(rng.choice("abcdefg ") for _ in range(250)) for _ in range(25)]
    return spark.createDataFrame([(i, t, "k", 1, "s") for i, t in enumerate(rows)], "doc_id long, text string, key string, fp int, spans string"), dict(enumerate(rows))


def test_near_duplicates(spark):
    docs = texts(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash(spark, SF).collect()}
    assert got == brute_classes(docs, 4)


def test_near_duplicates_odd(spark):
    df, docs = odd(spark, random.Random(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute_classes(docs, 5)
    assert near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_chain_and_hot(spark):
    rng = random.Random(2)
    w = [f"w{i}" for i in range(100)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(w))
        w = list(w)
        w[rng.randrange(100)] = f"v{rng.random()}"
    docs = dict(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(docs, 5)


def test_components(spark):
    e = [(5, 6), (6, 7), (7, 5), (9, 9), (10, 11), (None, 3), *((i, i + 1) for i in range(100, 160)), *((50, i) for i in range(51, 90))]
    got = {r.node: r.comp for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 10: 10, 11: 10} | {i: 100 for i in range(100, 161)} | {i: 50 for i in range(50, 90)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix(spark):
    assert digests(op3_suffix_array(spark, SF)) == brute_removed(texts(spark))


def test_suffix_odd(spark, tmp_path, monkeypatch):
    import tidewater.llm.suffix as m

    df, docs = odd(spark, random.Random(3))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for hot in (2000, 5):
        monkeypatch.setattr(m, "HOT", hot)
        assert digests(op3_suffix_array(spark, str(tmp_path))) == brute_removed(docs)
    assert repeated_spans(df.limit(0)).collect() == []
    out = without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute_removed(docs)
    for k, t in got.items():  # a character stays unless all of its bytes go
        more = len((t or "").encode()) - (want[k][0] - want[k][1])
        assert 0 <= more <= (2 * want[k][2] if not (docs[k] or "").isascii() else 0)


def test_suffix_hot_passage(spark, tmp_path, monkeypatch):
    """One passage amid many texts, at every place of cutting it anew: by run, by part, by window."""
    import tidewater.llm.suffix as m

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, short = text(420), text(199)
    rows = [text(rng.randrange(300)) + notice + text(rng.randrange(300)) for _ in range(60)] + [text(40) + short + rng.choice("xyz") + text(30) for _ in range(40)] + [notice, notice, "a" * 5000, " " * 700 + "x" + " " * 900]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_removed(dict(enumerate(rows)))
    for hot, run in ((2000, 1 << 16), (20, 150), (3, 64)):
        monkeypatch.setattr(m, "HOT", hot)
        monkeypatch.setattr(m, "RUN", run)
        assert digests(op3_suffix_array(spark, str(tmp_path))) == want


def test_suffix_repeated_rows_null_ids_and_clashing_names(spark):
    rng = random.Random(9)
    x, y, z = ("".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(3))
    rows = [(1, x), (1, x), (2, y), (2, z), (3, y[:260]), (None, y), (4, None)]
    df = spark.createDataFrame([(k, t, "s", 5, "r") for k, t in rows], "doc_id long, text string, _spans string, row int, spans string")
    got = sorted(tuple(r) for r in without_repeats(df).collect() if r.doc_id is not None)
    assert got == sorted([(1, "", "s", 5, "r"), (1, "", "s", 5, "r"), (2, y[260:], "s", 5, "r"), (2, z, "s", 5, "r"), (3, "", "s", 5, "r"), (4, None, "s", 5, "r")], key=lambda r: (r[0], r[1] or ""))
    assert [r.text for r in without_repeats(df).where("doc_id is null").collect()] == [y]


@pytest.mark.parametrize("piece", [300, 5000, 1 << 20])
def test_arrays_and_merges(piece):
    rng = random.Random(4)
    x = bytes(rng.choice(b"ab\0") for _ in range(700))
    parts = [x[:350], x[200:700], x[100:320], bytes(rng.choice(b"ab\0") for _ in range(400)), b"ab" * 200, b"a" * 250]
    found = repeated_windows(parts, 64, piece)
    seen = defaultdict(list)
    for i, p in enumerate(parts):
        for k in range(len(p) - 63):
            seen[p[k : k + 64]].append((i, k))
    want = [sorted(k for at in seen.values() if len(at) > 1 for j, k in at if j == i) for i in range(len(parts))]
    assert [a.tolist() for a in found] == want


def test_near_duplicates_null_and_repeated_rows(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    near = [*base[:150], "other", *base[151:]]
    rows = [(7, " ".join(base)), (7, " ".join(base)), (3, " ".join(near)), (None, " ".join(base)), (9, None), (9, ""), (8, " ".join(reversed(base))), (8, " ".join(near)), (5, " ".join(base))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("row").collect()
    assert sorted(tuple(r) for r in got) == sorted([(7, 196, 3), (7, 196, 3), (3, 196, 3), (9, 0, 9), (9, 0, 9), (8, 196, 8), (8, 196, 3), (5, 196, 3)])


def test_sieve(spark):
    from tidewater.llm.store import sieve, sifted

    wanted = sieve(spark.range(0, 3_000_000, 1000).toDF("x"), "x")
    assert sifted(wanted, np.arange(0, 3_000_000, 1000)).all()
    assert sifted(wanted, np.arange(1, 3_000_000, 1000)).mean() < 0.01
    assert not sifted(sieve(spark.range(0).toDF("x"), "x"), np.arange(5)).any()


def test_folder_is_shared(spark, monkeypatch):
    from tidewater.llm import store

    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(ValueError, match="share"):
        store.shared_folder(Session())


def test_tables_are_deleted(spark):
    from tidewater.llm import store

    df, _ = odd(spark, random.Random(1))
    before = set(store.made())
    out = near_duplicates(df)
    assert len(set(store.made()) - before) == 2 and out.count() == df.count()


def test_near_duplicates_against_an_exact_join(spark):
    """At sf0.01, by every pair that shares a shingle."""
    sf = "/root/testdata/sf0.01"
    want = brute_classes(texts(spark, sf), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash(spark, sf).collect()}
    assert got == want and sum(k != c for k, (_, c) in want.items()) > 50


def test_classes_whose_hashes_meet(spark, monkeypatch):
    """Different sets that share the first half of their hash are classes of their own."""
    import tidewater.llm.minhash as m

    whole, first = m._class, []
    monkeypatch.setattr(m, "_class", lambda salt: first.append(salt) or (whole(0) % 7 if salt == 0 else whole(salt)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash(spark, SF).collect()}
    assert got == brute_classes(texts(spark), 4) and 1 in first
