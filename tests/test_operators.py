"""Hand-computable cases and invariants of the raster operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions import numeric as N
from tidemark.operators import cube, features, learning, metrics, raster, tasks, tcev


def series(spark, values, key=1):
    rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "p int, t int, x float")


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_plotting_position(spark):
    s = cube.order_statistics(series(spark, [4, 2, 3, 1]), ["t"], ["p"]).orderBy("k")
    assert one(s, "f") == [np.float32(x) for x in (0.2, 0.4, 0.6, 0.8)]


def test_slot_placement(spark):
    s = cube.sort_order(series(spark, [5, None, 3]), ["t"], ["t"], ["p"]).orderBy("slot")
    assert one(s, "x") == [3, None, 5]
    assert one(s, "src_slot") == [2, -1, 0]


def test_mask_boundary(spark):
    o = cube.observations(spark.createDataFrame([(-30.0,), (-30.01,)], "db double"))
    assert one(o, "x") == [30.0, None]


def test_constant_pixel(spark):
    r = cube.normalised(series(spark, [2, 2, 2]), ["p"]).first()
    assert (r.x_norm, r.pixel_min, r.pixel_max) == (None, None, None)


def naive_fit(x):
    """Two-pass search over a sorted series."""
    x = np.sort(np.array(x, np.float32))
    f = (np.arange(1, len(x) + 1) / (len(x) + 1)).astype(np.float32).astype(float)
    x, y = x.astype(float), -np.log(-np.log(f))

    def slope(a, b):
        if len(a) < 2 or a.min() == a.max():
            return 0.0
        return float(((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum())

    n, best, at = len(x), -1.0, (len(x) // 2 + len(x) - 4) // 2
    for i in range(n - 5, max(n // 2, n - 24) - 1, -1):
        gap = abs(slope(x[i:], y[i:]) - slope(x[:i], y[:i]))
        if gap > best:
            best, at = gap, i
    a1, a2 = slope(x[:at], y[:at]), slope(x[at:], y[at:])
    c1 = y[:at].mean() - a1 * x[:at].mean()
    c2 = a1 * x[at] + c1 - a2 * x[at]
    fitted = np.where(np.arange(n) < at, a1 * x + c1, a2 * x + c2)
    a = slope(x, y)
    return at, a1, -c1 / a1, a2, -c2 / a2, math.sqrt(((y - fitted) ** 2).mean()), math.sqrt(((y - a * x - y.mean() + a * x.mean()) ** 2).mean())


@pytest.mark.parametrize("n", [8, 9, 17, 60, 150])
def test_fit_against_two_passes(spark, n):
    x = np.random.default_rng(n).gumbel(10, 3, n).clip(0.1, 29)
    stats = cube.order_statistics(series(spark, x), ["t"], ["p"])
    r = tcev.fit(stats, key=["p"]).first()
    want = naive_fit(x)
    b = tcev.breakpoints(tcev.survivors(stats, key=["p"]), ["p"]).first().b
    assert b == want[0] and r.n_valid == n
    got = (r.L1_alpha, r.L1_beta, r.L2_alpha, r.L2_beta, r.piecewise_residual, r.linear_residual)
    assert np.allclose(got, want[1:], rtol=1e-9, atol=1e-9)


def test_seven_points_and_flat_sides(spark):
    fit = lambda x: tcev.fit(cube.order_statistics(series(spark, x), ["t"], ["p"]), key=["p"]).first()
    assert fit(range(1, 8)).fit_error == "too few points"
    assert fit([1] * 12 + [2, 3, 4, 5]).fit_error == "slope near zero"
    assert fit(range(1, 9)).fit_error is None
    assert fit([29.2] * 21).L1_alpha is None
    assert fit([40.0] * 20).fit_error == "too few points"
    assert tcev.fit(cube.order_statistics(series(spark, []), ["t"], ["p"]), key=["p"]).count() == 0


def test_equal_gaps_take_the_largest_place(spark):
    x = [1.0] * 20
    b = tcev.breakpoints(tcev.survivors(cube.order_statistics(series(spark, x), ["t"], ["p"]), key=["p"]), ["p"]).first().b
    assert b == 15


def test_score_at_the_location(spark):
    v = spark.range(1).select(N.tcev(*(F.lit(x) for x in (3.0, 2.0, 3.0, 7.0, 3.0)))).first()[0]
    assert math.isclose(v, math.exp(-2))


def test_names(spark):
    def got(f, name):
        return spark.createDataFrame([(name,)], "n string").select(f(F.col("n"))).first()[0]

    assert got(names.month, "Image_20150230_VH.tif") == 2
    assert got(names.strict_date, "Image_20150230_VH.tif") is None
    assert got(names.date_id, "Fx_20230101.tif") == "20230"
    assert got(names.orbit, "Image_20230101_VH_91.TIF") == "91"
    assert got(names.orbit, "plain.tif") is None


@pytest.mark.parametrize(("values", "length", "want"), [(range(10), 4, [0, 3, 6, 9]), ([5, 6], 4, [5, 6, 0, 0]), ([], 3, [0, 0, 0])])
def test_resampled(spark, values, length, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(N.resampled(F.col("v"), length)).first()[0] == want


@pytest.mark.parametrize(("n", "count"), [(10, 1), (11, 2)])
def test_largest_tenth(spark, n, count):
    r = features.extra_features(cube.order_statistics(series(spark, range(1, n + 1)), ["t"], ["p"]), ["p"]).first()
    assert r.top10_mean == np.mean(range(n - count + 1, n + 1)) and r.db_range == n - 1


def test_mosaic(spark):
    t = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 2, None), (0, 0, 3, 3.0), (0, 1, 1, None)], "row int, col int, ord int, value double")
    for method, want in (("mean", 2), ("max", 3), ("min", 1), ("first", 1), ("last", 3)):
        assert [r.value for r in raster.mosaic(t, ["row", "col"], method=method).orderBy("col").collect()] == [want, None]
    with pytest.raises(ValueError, match="unknown mosaic method"):
        raster.mosaic(t, ["row", "col"], method="median")


def test_mask_over_a_missing_cell(spark):
    cells = spark.createDataFrame([(0, 0, None), (0, 1, 0.5)], "row int, col int, fx double")
    mask = spark.createDataFrame([(0, 0, 0)], "row int, col int, mask int")
    assert [r.fx for r in raster.apply_mask(cells, mask, ["row", "col"]).orderBy("col").collect()] == [None, 0]
    assert [r.fx for r in raster.apply_mask(cells, mask, ["row", "col"], compat=True).orderBy("col").collect()] == [0, 0]


def test_bilinear_identity(spark):
    cells = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "row int, col int, v double")
    got = raster.resample_bilinear(cells, cells.select("row", "col"), ["v"], 1.0, 1.0)
    assert {(r.row, r.col): r.v for r in got.collect()} == {(r, c): r * 3 + c for r in range(3) for c in range(3)}


@pytest.mark.parametrize(("rows", "want"), [([(0.9, 1), (0.1, 0)], 1.0), ([(0.3, 1), (0.4, 1)], 0.5), ([(0.5, 1), (0.5, 0)], 0.5), ([(1.0, 1), (0.0, 0), (0.29, 1), (0.57, 0)], 0.75)])
def test_auc(spark, rows, want):
    assert math.isclose(metrics.auc(spark.createDataFrame(rows, "score double, label int")).first()[0], want)


def test_auc_against_thresholds(spark):
    rng = np.random.default_rng(3)
    score, label = np.round(rng.uniform(0, 1, 400), 2), rng.integers(0, 2, 400)
    x, y = [0.0], [0.0]
    for t in np.linspace(0, 1, 101)[::-1]:
        y.append(((score >= t) & (label == 1)).sum() / (label == 1).sum())
        x.append(((score >= t) & (label == 0)).sum() / (label == 0).sum())
    want = np.trapezoid([*y, 1.0], [*x, 1.0])
    rows = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, label, strict=True)], "score double, label int")
    assert abs(metrics.auc(rows).first()[0] - want) < 2e-3


def test_validation_grids(spark):
    grids = spark.range(10).withColumnRenamed("id", "grid_id")
    assert tasks.grid_split(grids).filter("part = 'validation'").count() == 2
    assert tasks.grid_split(grids.limit(1)).filter("part = 'validation'").count() == 0


def test_unknown_season():
    with pytest.raises(ValueError, match="unknown seasons"):
        tasks.checked_seasons(["monsoon"])


def test_samples_of_one_class(spark):
    with pytest.raises(ValueError, match="samples"):
        features.check_samples(spark.createDataFrame([(1,)] * 9, "label int"))


def test_network_survives_json():
    net = learning.FloodNet.seeded(1)
    x = np.random.default_rng(0).normal(size=(4, 5, 16))
    assert np.allclose(learning.FloodNet.from_json(net.to_json()).logits(x), net.logits(x))
    with pytest.raises(ValueError, match="channels"):
        learning.FloodNet.from_json(net.to_json(), channels=4)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net, x, y = learning.FloodNet.seeded(5), rng.normal(size=(6, 5, 8)), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        return learning.focal(learning._forward(net, x)[0], y, 1.7, 2.0)[0]

    z, trail = learning._forward(net, x)
    for owner, name, g in learning._backward(net, trail, learning.focal(z, y, 1.7, 2.0)[1]):
        at = tuple(int(rng.integers(n)) for n in g.shape)
        old, eps = owner[name][at], 1e-5
        owner[name][at] = old + eps
        up = loss()
        owner[name][at] = old - eps
        down = loss()
        owner[name][at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-5, name


def test_training_learns():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 5, 8)) + y[:, None, None] * np.array([1.0, 0, 0, 0, 0])[None, :, None]
    net = learning.train(x, y, np.repeat(np.arange(10), 40), learning.TrainConfig(epochs=6, batch=64))
    assert max(h["val_auc"] for h in net.history) > 0.9
    assert learning.learning_rate(20, learning.TrainConfig()) == 1e-3
