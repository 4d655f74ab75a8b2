"""Quality learned from all labelled rows, more of them than the driver takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quality


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    monkeypatch.setattr(quality, "DEAL", 60)


def test_all_labelled_rows_are_learned_from(spark, small, monkeypatch):
    """Means, spreads and threshold against numpy's over every labelled document; the weights against those of the same pairs."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    newton = quality._newton
    monkeypatch.setattr(quality, "_newton", lambda pairs, size: seen.append(pairs.collect()) or newton(pairs, size))
    got = quality.train(d, labels.unionByName(labels))
    fits = labels.where("quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    rows = d.join(fits, "doc_id").select("text", "quality").collect()
    data = [(r.text or "").encode() for r in rows]
    x = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = np.array([r.quality for r in rows])
    assert len(y) > 4 * quality.SAMPLE and np.allclose(got.mean, x.mean(0)) and np.allclose(got.spread, np.where(x.std(0) > 1e-12, x.std(0), 1))
    s = got.margin(x)
    assert np.isclose(got.scale, s.std()) and got.threshold == np.quantile(s, 1 - y.mean(), method="lower")
    d = np.concatenate([np.frombuffer(r.d, np.float32).reshape(-1, x.shape[1]) for r in seen[0]])
    assert len(d) >= quality.TURNS * max(y.sum(), len(y) - y.sum())
    gradient = -(d.T @ (1 / (1 + np.exp(d @ got.weights)))) / len(d) + quality.RIDGE * got.weights
    assert np.abs(gradient).max() < 1e-6 and np.abs(got.weights).max() > 0.1


def test_one_class_or_none_beyond_the_drivers_bound(spark, small):
    d = spark.range(200).selectExpr("id as doc_id", "repeat('word ', cast(id % 7 as int)) as text")
    for label in (1, 0):
        r = quality.train(d, d.selectExpr("doc_id", f"{label} as quality"), held_out=False)
        assert {x.predicted for x in quality.score_quality(d, r).collect()} == {label} and not r.weights.any()
    r = quality.train(d.where("doc_id < 0"), d.selectExpr("doc_id", "1 as quality"), held_out=False)
    assert r.score(np.zeros((1, len(r.weights))))[0] >= 0


def test_the_kth_smallest(spark):
    z = np.concatenate([np.random.default_rng(1).standard_normal(500), np.zeros(30), [-1e300, 1e300, 1e-310]])
    rows = spark.createDataFrame([(float(v),) for v in z], "z double").repartition(3)
    for k in (0, 1, 250, 265, len(z) - 1):
        assert quality._smallest(rows, lambda b: b.column(0).to_numpy(), k) == np.sort(z)[k]
