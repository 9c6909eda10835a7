"""Encoders, seeded sources, files and fractional differencing against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import encoders
from tidegauge.sources import candles, files, synthetic


def test_image_features(spark):
    rng = np.random.default_rng(0)
    images = [rng.random((4, 6)) for _ in range(5)]
    rows = spark.createDataFrame([("cam", float(i), 6, [float(v) for v in a.ravel()]) for i, a in enumerate(images)], "source_id string, t double, width int, pixels array<double>")
    got = {r["t"]: r for r in encoders.encode_images(rows).collect()}
    for i, a in enumerate(images):
        hist = np.histogram(a, 8, (a.min(), a.max() + 1e-9), density=True)[0]
        want = [a.mean(), a.std(), np.abs(a[:, 1:] - a[:, :-1]).mean(), np.abs(a[1:] - a[:-1]).mean(), *hist]
        assert [got[i][f"x{k}"] for k in range(12)] == pytest.approx(want)
    flat = encoders.image_features(np.ones((1, 1)))
    assert flat[:4] == pytest.approx([1, 0, 0, 0]) and np.isfinite(flat).all()
    assert encoders.image_features(np.dstack([images[0]] * 3)) == pytest.approx(encoders.image_features(images[0]))


def test_audio_features(spark):
    tone = np.sin(2 * np.pi * 0.125 * np.arange(256))
    rows = spark.createDataFrame([("mic", 0.0, tone.tolist()), ("mic", 1.0, [1.0])], "source_id string, t double, samples array<double>")
    got = {r["t"]: r for r in encoders.encode_audio(rows).collect()}
    assert got[0.0]["x0"] == pytest.approx(np.sqrt((tone**2).mean()))
    assert got[0.0]["x2"] == pytest.approx(0.125, abs=1e-3) and got[0.0]["x4"] + got[0.0]["x3"] > 0.99
    assert [got[1.0][f"x{k}"] for k in range(7)] == [0.0] * 7


def test_modalities_are_fused_by_what_is_known(spark):
    assert encoders.infer_modality("front_IMAGE_2") == "image" and encoders.infer_modality("sensor") == "timeseries"
    a = spark.createDataFrame([(float(t), float(t)) for t in range(6)], "t double, x0 double")
    b = spark.createDataFrame([(1.5, 10.0, 1.0), (3.2, 20.0, 2.0)], "t double, x0 double, x1 double")
    got = [tuple(r) for r in encoders.fuse({"a": a, "b": b}, 1.0).orderBy("t").collect()]
    assert got == [(1.5, 1.0, 10.0, 1.0), (2.5, 2.0, 10.0, 1.0), (3.5, 3.0, 20.0, 2.0), (4.5, 4.0, 20.0, 2.0)]
    assert encoders.fuse({"a": a}).columns == ["t", "a_x0"]
    with pytest.raises(ValueError):
        encoders.fuse({})


def test_seeded_sources(spark):
    rows = synthetic.synthetic(spark, "candles", series=3, rows=50, seed=4)
    assert rows.count() == 150
    bad = rows.where("high < greatest(open, close) OR low > least(open, close) OR volume <= 0 OR low <= 0")
    assert bad.count() == 0
    again = synthetic.synthetic(spark, "candles", series=3, rows=50, seed=4)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    first = rows.where("series_id = 1").orderBy("ts").collect()
    assert [r["open"] for r in first[1:]] == [r["close"] for r in first[:-1]]
    x = synthetic.autoregressions(4000, 2, 1)
    assert np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1] == pytest.approx(0.6, abs=0.05)
    assert synthetic.synthetic(spark, "autoregressions", series=2, rows=10, columns=2).columns == ["series_id", "t", "x0", "x1"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("first\nsecond line\nthird")
    (tmp_path / "two.log").write_text("a second line here")
    assert {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in files.list_files(spark, str(tmp_path)).collect()} == {"one.txt": 23, "two.log": 18}
    assert [r["text"] for r in files.read_file(spark, str(tmp_path / "a" / "one.txt"), 2, 3).collect()] == ["second line", "third"]
    assert {r["text"] for r in files.search_files(spark, str(tmp_path), "second l").collect()} == {"second line", "a second line here"}
    assert files.search_files(spark, str(tmp_path), "second", "*.log").count() == 1


def test_fractional_differencing(spark):
    from math import gamma

    w = candles.weights(0.4, 1e-4)
    assert abs(w[-1]) >= 1e-4 and len(w) > 200
    for k in (0, 1, 5, 50):
        assert w[k] == pytest.approx((-1) ** k * gamma(1.4) / (gamma(k + 1) * gamma(1.4 - k)))
    assert candles.weights(0.0) == [1.0] and candles.weights(1.0) == [1.0, -1.0]
    with pytest.raises(ValueError):
        candles.weights(-1)
    rows = spark.createDataFrame([(0, t, float(t * t)) for t in range(8)], "s int, t int, v double")
    got = [r["y"] for r in rows.select("t", candles.frac_differenced(rows, "v", ["s"], "t", 1.0).alias("y")).orderBy("t").collect()]
    assert got == [None, *[float(t * t - (t - 1) ** 2) for t in range(1, 8)]]
    assert rows.select(F.lit(1)).count() == 8
