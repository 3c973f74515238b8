"""Entry points, sources, sinks and the stream, end to end on small frames."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cube, learning
from tidemark.plans import pipeline as P
from tidemark.schema import FEATURES, SERIES
from tidemark.sources import catalog, rasters
from tidemark.streaming import scoring


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(0)
    rows = [(g, r, c, "spring", dt.date(2020, 3, 1) + dt.timedelta(t), f"g{g}/{t}", float(-rng.gumbel(12, 3))) for g in (1, 2) for r in range(2) for c in range(2) for t in range(40)]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, season string, scene_date date, path string, db double").cache()


def test_fit_score_and_mask(spark, pixels):
    layers = P.fit_history(pixels).cache()
    assert layers.count() == 8 and layers.filter("fit_error IS NULL").count() == 8
    assert P.fit_history(pixels, P.FitConfig(grids=(1,))).count() == 4
    assert P.fit_history(pixels, done=layers.filter("grid_id = 1")).count() == 4
    config = P.ScoreConfig("2020-03-05", "2020-03-06", "max")
    got = P.score_events(pixels, layers, config=config)  # grids that don't say where they lie stay apart
    assert got.count() == 16 and got.filter("fx BETWEEN 0 AND 1").count() == 16
    mask = spark.createDataFrame([(0, 0, 1)], "row int, col int, mask int")
    assert P.score_events(pixels, layers, mask, config).filter("fx > 0").count() == 4
    assert P.score_events(pixels, layers, mask.withColumn("grid_id", F.lit(2)), config).filter("fx > 0").count() == 2
    assert P.run_log(layers, "fit").filter("failed = 0 AND series = 4 AND done_percent = 100").count() == 2
    log = spark.createDataFrame([("s", 1, e) for e in ("b", "b", "a", None)], "season string, grid_id int, fit_error string")
    assert P.run_log(log, "fit").select("failed", "message", "done_percent").collect() == [(3, "b", 25.0)]


def heads(spark, *places):
    gt = "struct<origin_x: double, px_w: double, rot_x: double, origin_y: double, rot_y: double, px_h: double>"
    return spark.createDataFrame([(g, 2, 2, (x, 10.0, 0.0, y, 0.0, -10.0)) for g, x, y in places], f"grid_id int, width int, height int, gt {gt}")


def test_grids_on_one_lattice(spark, pixels):
    layers, config = P.fit_history(pixels), P.ScoreConfig("2020-03-05", "2020-03-06", "max")
    apart = P.score_events(pixels, layers, config=config, grids=heads(spark, (1, 0.0, 0.0), (2, 20.0, 0.0)))
    assert apart.count() == 16 and {(r.row, r.col) for r in apart.collect()} == {(r, c) for r in range(2) for c in range(4)}
    over = P.score_events(pixels, layers, config=config, grids=heads(spark, (1, 0.0, 0.0), (2, 10.0, -10.0)))
    assert {(r.row, r.col) for r in over.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)} and over.count() == 14
    one = {(r.scene_date, r.grid_id, r.row, r.col): r.fx for r in P.score_events(pixels, layers, config=config).collect()}
    assert all(r.fx == max(one[r.scene_date, 1, 1, 1], one[r.scene_date, 2, 0, 0]) for r in over.collect() if (r.row, r.col) == (1, 1))
    whole = P.season_layers(layers, heads(spark, (1, 0.0, 0.0), (2, 20.0, 0.0)))
    assert sorted(r.n_valid for r in whole.collect()) == sorted(r.n_valid for r in layers.collect()) and whole.count() == 8


def test_warp(spark):
    from tidemark.operators import lattice as L

    a = L.Profile(3, 2, 0.0, 0.0, 1.0, -1.0)
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(2) for c in range(3)], "row int, col int, v double")
    same = {(r.row, r.col): r.v for r in L.warp(cells, ["v"], a, a).collect()}
    assert same == {(r, c): 10.0 * r + c for r in range(2) for c in range(3)}
    half = {(r.row, r.col): r.v for r in L.warp(cells, ["v"], a, L.Profile(2, 1, 0.5, -0.5, 1.0, -1.0)).collect()}
    assert half == {(0, 0): 5.5, (0, 1): 6.5}
    near = {(r.row, r.col): r.v for r in L.warp(cells, ["v"], a, L.Profile(2, 1, 1.4, -1.2, 1.0, -0.5), "nearest", -1.0).collect()}
    assert near == {(0, 0): 11.0, (0, 1): 12.0}
    assert {r.v for r in L.warp(cells, ["v"], a, L.Profile(1, 1, 9.0, 9.0, 1.0, -1.0), "nearest", 0.0).collect()} == {0.0}
    x, y = (F.lit(v) for v in (2.0, 3.0))
    assert spark.range(1).select(*L.transform(x, y, "A", "A")).first() == (2.0, 3.0)
    moved = spark.range(1).select(L.by_library("A", "B", lambda s, t: lambda a, b: (a + 1, b * 2))(F.lit(2.0), F.lit(3.0)).alias("p")).select("p.*").first()
    assert tuple(moved) == (3.0, 6.0)
    with pytest.raises(ValueError, match="unknown method"):
        L.warp(cells, ["v"], a, a, "cubic")


def test_samples_to_map(spark):
    rng = np.random.default_rng(1)
    rows = [(g, r, c, *(float(x) for x in rng.normal(c - 4.5, 0.5, len(FEATURES)))) for g in (1, 2) for r in range(10) for c in range(10)]
    table = spark.createDataFrame(rows, "grid_id int, row int, col int, " + ", ".join(f"{f} double" for f in FEATURES))
    table = table.withColumn(FEATURES[0], F.when(~((F.col("row") == 0) & (F.col("grid_id") == 2)), F.col(FEATURES[0])))
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 1.0, 1.0, 10, 10), (2, 10.0, 20.0, 0.0, 10.0, 1.0, 1.0, 10, 10)], "grid_id int, x_min double, x_max double, y_min double, y_max double, px_w double, px_h double, width int, height int")
    spots = [(i, float(rng.uniform(0.1, 9.9)), float(rng.uniform(0.1, 9.9))) for i in range(60)]
    points = spark.createDataFrame(spots, "point_id long, x double, y double")
    labels = spark.createDataFrame([(i, 2 if x > 5 else 1) for i, x, _ in spots], "point_id long, label int")
    gt = "struct<origin_x: double, px_w: double, rot_x: double, origin_y: double, rot_y: double, px_h: double>"
    grids = spark.createDataFrame([(g, 10, 10, (10.0 * (g - 1), 1.0, 0.0, 10.0, 0.0, -1.0)) for g in (1, 2)], f"grid_id int, width int, height int, gt {gt}")
    model, found = P.classify_samples(points, boxes, table, labels, grids=grids)
    got = {(r.row, r.col): r.pred for r in found.collect()}
    assert len(got) == 200 and all(got[0, c] == -1 for c in range(10, 20))
    assert np.mean([got[r, c] == (c >= 5) for r in range(10) for c in range(10)]) > 0.95
    with pytest.raises(ValueError, match="samples"):
        P.classify_samples(points.limit(3), boxes, table, labels)
    learning.save_model(spark, model, (folder := f"{spark.conf.get('spark.checkpoint.dir')}/linear"))
    again = learning.load_model(spark, learning.LinearModel, folder)
    x = rng.normal(size=(5, len(FEATURES)))
    assert np.allclose(again.predict_proba(x), model.predict_proba(x))

    class Constant:  # any model will do
        def fit(self, x, y):
            return self

        def predict_proba(self, x):
            return np.tile([0.2, 0.8], (len(x), 1))

    assert {r.pred for r in P.classify_samples(points, boxes, table, labels, Constant())[1].collect()} == {1, -1}


def curve_rows(spark, seed, grids=(1, 2, 3)):
    rng = np.random.default_rng(seed)
    rows = [(g, i, 0, "spring", *([float(v) for v in rng.normal(i % 2, 0.3, 8)] for _ in range(3)), 1.0 if i % 5 else None, 0.5, i % 2) for g in grids for i in range(20)]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, season string, raw_db array<double>, gumbel array<double>, fx array<double>, slope_ratio double, bp_db double, label int")


def test_seasonal_runner(spark):
    sources = spark.createDataFrame([("a", True, ["spring", "summer"]), ("off", False, ["spring"])], "source string, enabled boolean, seasons array<string>")
    targets = spark.createDataFrame([("t", ["spring", "winter"]), ("u", ["spring"]), ("bad", ["spring"])], "target string, seasons array<string>")
    kept, trained = {}, []

    def curves(name, season):
        trained.append(name)
        if name == "bad":
            raise ValueError("no cube")
        return curve_rows(spark, len(name))

    config = learning.TrainConfig(epochs=2, batch=32)
    runner = P.SeasonalRunner(curves, lambda *k: kept.get(k), lambda s, e, net: kept.__setitem__((s, e), net), config)
    out = runner.run(sources, targets)
    assert set(out) == {("a", "t", "spring"), ("a", "u", "spring")} and trained.count("a") == 1 and set(kept) == {("a", "spring")}
    assert [e["error"] for e in runner.log if e["target"] == "bad"] == ["ValueError: no cube"]
    assert out["a", "t", "spring"].filter("pred IN (0, 1)").count() == 48
    P.SeasonalRunner(curves, lambda *k: kept.get(k), None, config).run(sources, targets)
    assert trained.count("a") == 1
    with pytest.raises(ValueError, match="no labelled curves"):
        learning.train_on(curve_rows(spark, 1).limit(0))


def test_network_by_a_plain_loop(spark):
    net = learning.FloodNet.seeded(7, (5, 4, 3), hidden=3)
    got = {(r.grid_id, r.row): (r.prob, r.pred) for r in learning.infer(curve_rows(spark, 2, (1,)), net, ["grid_id", "row"]).collect()}
    for r in curve_rows(spark, 2, (1,)).collect():
        x = [r.raw_db, r.gumbel, r.fx, [r.slope_ratio or 0.0] * 8, [r.bp_db] * 8]
        for a in net.layers:
            y = []
            for o in range(len(a["w"])):
                line = []
                for t in range(8):
                    z = a["b"][o]
                    for c in range(len(x)):
                        for k in range(3):
                            if 0 <= t + k - 1 < 8:
                                z += a["w"][o][c][k] * x[c][t + k - 1]
                    line.append(max(0.0, (z - a["mean"][o]) / (a["var"][o] + 1e-5) ** 0.5 * a["gain"][o] + a["shift"][o]))
                y.append(line)
            x = y
        h = [sum(v) / 8 for v in x] + [max(v) for v in x]
        u = [max(0.0, sum(w * v for w, v in zip(net.head["w1"][j], h, strict=True)) + net.head["b1"][j]) for j in range(3)]
        z = sum(w * v for w, v in zip(net.head["w2"][0], u, strict=True)) + net.head["b2"][0]
        prob, pred = got[r.grid_id, r.row]
        assert (prob is None) == (r.slope_ratio is None) and (prob is None or (abs(prob - 1 / (1 + np.exp(-z))) < 1e-9 and pred == (z >= 0)))


def test_classify(pixels):
    layers, stats = P.fit_history(pixels), cube.order_statistics(cube.observations(pixels), ["scene_date", "path"])
    table = P.pixel_features(stats, layers)
    assert P.classify_tabular(table, [0.1] * len(FEATURES), -1.0).filter("pred IN (0, 1)").count() == 8
    lattice = pixels.select(*SERIES).distinct().unionByName(pixels.select(F.lit(9).alias("grid_id"), "row", "col", "season").distinct())
    got = P.classify_curves(stats, layers, learning.FloodNet.seeded(3), lattice)
    assert got.count() == 12 and got.filter("pred = -1").count() == 4


def test_scene_files(spark, tmp_path):
    for name in ("month_03/grid_01/Image_20200301_VH_7.tif", "grid_02/Image_20200602_VV_8.TIF", "grid_02/notes.txt", "grid_02/Image_x_VV_8.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {(r.grid_id, r.season, r.orbit, r.polarization) for r in catalog.scenes(spark, str(tmp_path)).collect()}
    assert got == {(1, "spring", "7", "VH"), (2, "summer", "8", "VV")}


def test_sinks(spark, pixels, tmp_path):
    assert catalog.by_key(pixels, ["season", "grid_id"], str(tmp_path / "a"), dry_run=True).count() == 2
    assert not (tmp_path / "a").exists()
    catalog.write_cube(pixels, str(tmp_path / "cube"))
    plan = spark.read.parquet(str(tmp_path / "cube")).filter("season = 'spring' AND grid_id = 1")
    assert plan.count() == 160 and "PartitionFilters: [isnotnull(season" in plan._jdf.queryExecution().executedPlan().toString()
    catalog.write_raster(spark.createDataFrame([(0, None), (1, 2.0)], "col int, fx double"), "fx", str(tmp_path / "r"))
    assert sorted(r.fx for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [-9999.0, 2.0]
    catalog.write_samples(spark.createDataFrame([(1.5, 1)], "v double, label int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "label"]


def lzw(data):
    """A compressor for the test: codes of 9 to 12 bits, wider one code early."""
    out, n, table, bits, word = 0, 0, {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal out, n
        out, n = out << bits | code, n + bits

    put(256)
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = size
        size += 1
        word = bytes([b])
        if size >= (1 << bits) and bits < 12:
            bits += 1
        if size >= 4094:
            put(256)
            table, bits, size = {bytes([i]): i for i in range(256)}, 9, 258
    put(table[word])
    put(257)
    pad = -n % 8
    return (out << pad).to_bytes((n + pad) // 8, "big")


def test_geotiffs(spark, tmp_path):
    from tidemark.operators.lattice import Profile
    from tidemark.sources import tiff

    p = Profile(7, 50, 100.0, 20.0, 0.5, -0.25, "EPSG:4326")
    cells = p.cells(spark).withColumn("a", (F.col("row") * 10 + F.col("col")).cast("double")).withColumn("b", F.when(F.col("col") != 3, F.col("a") / 4)).withColumn("day", F.lit("d1"))
    wrote = catalog.write_geotiffs(cells.filter("col <> 5"), ["a", "b"], str(tmp_path / "out"), p, ["day"], block=20)
    assert sorted((r.day, r.rows) for r in wrote.collect()) == [("d1", 10), ("d1", 20), ("d1", 20)]
    rasters.register(spark)
    heads = spark.read.format("geotiffheads").option("path", str(tmp_path / "out")).load().orderBy("path").collect()
    assert [(h.width, h.height, h.gt.origin_x, h.gt.origin_y, h.gt.px_w, h.gt.px_h, h.crs, h.nodata) for h in heads] == [(7, n, 100.0, 20.0 - 5 * k, 0.5, -0.25, "EPSG:4326", -9999.0) for k, n in enumerate((20, 20, 10))]
    for band, name in ((1, "a"), (2, "b")):
        read = spark.read.format("geotiff").option("path", str(tmp_path / "out")).option("rows", 7).option("band", band).load()
        got = {(r.row + 20 * int(r.path[-12:-4]) // 20, r.col): r.value for r in read.collect()}
        assert got == {(r.row, r.col): None if r.col == 5 else r[name] for r in cells.collect()}
    nan = catalog.write_geotiffs(cells, ["b"], str(tmp_path / "nan"), p, nodata=None).first().path
    assert np.isnan(tiff.rows(nan, tiff.header(nan), 0, 1)[0, 3, 0]) and tiff.header(nan).nodata is None
    with pytest.raises(ValueError, match="no TIFF"):
        (tmp_path / "x.tif").write_bytes(b"nothing here")
        tiff.header(str(tmp_path / "x.tif"))
    for data in (bytes(range(256)) * 40, b"abc" * 3000, np.random.default_rng(0).integers(0, 9, 30000).astype(np.uint8).tobytes()):
        assert tiff._lzw(lzw(data)) == data


def test_cube_batches():
    got = rasters.cube_batch(np.array([[[1.0, np.nan]], [[3.0, 4.0]]]), 5).to_pylist()
    assert got == [{"slot": s, "row": 5, "col": c, "value": v} for s, c, v in ((0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0))]


def test_tasks(spark, tmp_path):
    from tidemark.operators import tasks

    folders = spark.createDataFrame([("a",), ("b",)], "folder string")
    with pytest.raises(ValueError, match="among: a, b"):
        tasks.prefix_or_error(folders)
    assert tasks.prefix_or_error(spark.createDataFrame([("s_01",), ("s_02",)], "folder string")).count() == 2
    assert [r.folder for r in tasks.grid_names(spark.createDataFrame([("grid_9",), ("grid_10",), ("grid_x",)], "folder string")).collect()] == ["grid_10", "grid_9"]
    assert tasks.layers_folder("/r/cubes", None, {"/r/tcev"}.__contains__) == "/r/tcev"
    assert tasks.layers_folder("/r/cubes/", "/x", {"/x", "/r/tcev_seasonal"}.__contains__) == "/x"
    assert tasks.layers_folder("/r/cubes", "/x", {"/r/tcev_seasonal", "/r/tcev"}.__contains__) == "/r/tcev_seasonal"
    assert tasks.layers_folder("/r/cubes", "/x", set().__contains__) is None
    for name in ("event_Fx_1.tif", "other_2.tif"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.file_name for r in catalog.files(spark, str(tmp_path), glob="event_Fx_*.tif").collect()] == ["event_Fx_1.tif"]


def test_maps_and_samples(spark, pixels, tmp_path):
    catalog.write_cube(pixels, str(tmp_path / "cube"), {"in_channels": 5, "grid_keys": ["a", "b"]})
    assert catalog.read_attributes(spark, str(tmp_path / "cube"), 5)["grid_keys"] == ["a", "b"]
    with pytest.raises(ValueError, match="5 channels, not 3"):
        catalog.read_attributes(spark, str(tmp_path / "cube"), 3)
    catalog.write_label_map(spark.createDataFrame([(0, 1, 1), (0, 0, None), (1, 0, 0)], "row int, col int, label int"), str(tmp_path / "map"), {"season": "spring"})
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "map")).collect()) == [(0, 0, -1), (0, 1, 1), (1, 0, 0)]
    from tidemark.operators import tcev

    layers, stats = P.fit_history(pixels), cube.order_statistics(cube.observations(pixels), ["scene_date", "path"])
    one = tcev.sample_pixel(layers, 1, 1).drop("away")
    catalog.write_samples_of(one, stats, str(tmp_path / "sample"))
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "sample" / n))
    assert read("series").count() == 40 and read("parameters").filter("parameter = 'n_valid' AND value = 40").count() == 1


def test_points(spark, tmp_path):
    shapes = [(1, 10.0, 20.0), (0,), (1, -1.5, 2.5)]
    body = b""
    for i, s in enumerate(shapes):
        content = struct.pack("<i", s[0]) + (struct.pack("<2d", *s[1:]) if s[0] else b"")
        body += struct.pack(">2i", i + 1, len(content) // 2) + content
    (tmp_path / "p.shp").write_bytes(bytes(100) + body)
    field = b"id".ljust(11, b"\0") + b"N" + bytes(4) + bytes([4, 0]) + bytes(14)
    (tmp_path / "p.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 3, 65, 5) + bytes(20) + field + b"\r" + b"    1" + b"    9" + b"    2")
    rasters.register(spark)
    got = spark.read.format("shapepoints").option("path", str(tmp_path / "p.shp")).load().collect()
    assert [tuple(r) for r in got] == [(0, 10.0, 20.0, 1), (2, -1.5, 2.5, 2)]


def test_stream(spark, pixels, tmp_path):
    layers = P.fit_history(pixels)
    rows = pixels.withColumn("ts", F.col("scene_date").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        scoring.write(stream, layers, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("fx BETWEEN 0 AND 1").count() == rows.count()
    days = scoring.daily(stream, layers).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    days.awaitTermination()
    assert spark.sql("SELECT sum(cells) FROM days").first()[0] > 0
