"""The three entry points: fit a history, score events, classify pixels. Each is a plan over lazy frames; a run
log names what was done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cube, features, lattice, learning, metrics, raster, tasks, tcev
from tidemark.schema import FEATURES, LAYERS, PIXEL, SERIES


@dataclass(frozen=True)
class FitConfig:
    ceiling: float = 30.0
    threshold: float = 30.0
    seasons: tuple[str, ...] | None = None
    grids: tuple[int, ...] | None = None
    ties: tuple[str, ...] = ("scene_date", "path")


@dataclass(frozen=True)
class ScoreConfig:
    start: str | None = None
    end: str | None = None
    method: str = "mean"
    compat: bool = False


@dataclass(frozen=True)
class ClassifyConfig:
    threshold: float = 0.5
    length: int = 16
    codes: dict[int, int] = field(default_factory=lambda: {1: 0, 2: 1})


def fit_history(pixels: DataFrame, config: FitConfig | None = None, done: DataFrame | None = None) -> DataFrame:
    """pixels(grid_id, row, col, season, db, ties) to layers and fit_error of every series that isn't done yet."""
    config = config or FitConfig()
    p = pixels.filter(F.col("season").isin(tasks.checked_seasons(list(config.seasons) if config.seasons else None)))
    if config.grids is not None:
        p = p.filter(F.col("grid_id").isin(*config.grids))
    if done is not None:
        p = tasks.pending(p, done, ["season", "grid_id"])
    return tcev.fit(cube.order_statistics(cube.observations(p, ceiling=config.ceiling), list(config.ties)), config.threshold)


def score_events(pixels: DataFrame, layers: DataFrame, mask: DataFrame | None = None, config: ScoreConfig | None = None, grids: DataFrame | None = None) -> DataFrame:
    """Events in a range of days, scored, and masked.

    grids(grid_id, width, height, gt): where each grid lies. With it, scores are mosaicked over grids by day on the
    lattice they share: scene_date, row, col, fx. Without it grids stay apart: rows and columns of unlike grids are unlike
    cells, and grid_id is a column of the result. The mask is joined by what it has of grid_id, row, col."""
    config = config or ScoreConfig()
    event = pixels.filter(tasks.in_range(F.col("scene_date"), config.start, config.end)).withColumn("x", -F.col("db").cast("float"))
    scored = tcev.score(event, layers, SERIES)
    if grids is None:
        whole = raster.mosaic(scored, ["scene_date", *PIXEL], "fx", "grid_id", config.method)
    else:
        on = lattice.on_lattice(scored, grids, ["grid_id"], [], order="grid_id")
        whole = raster.mosaic(on, ["scene_date", "row", "col"], "fx", "grid_id", config.method)
    if mask is None:
        return whole
    return raster.apply_mask(whole, mask, [c for c in PIXEL if c in mask.columns and c in whole.columns], "fx", config.compat)


def season_layers(layers: DataFrame, grids: DataFrame, method: str = "mean", values: tuple[str, ...] = LAYERS) -> DataFrame:
    """All layers of each season on the lattice of all grids: season, row, col, layers."""
    on = lattice.on_lattice(layers, grids, ["grid_id"], [], order="grid_id")
    return on.groupBy("season", "row", "col").agg(*(raster.combined(F.col(v), F.col("grid_id"), method).alias(v) for v in values))


def pixel_features(stats: DataFrame, layers: DataFrame) -> DataFrame:
    return features.features9(layers, features.extra_features(stats))


def classify_tabular(table: DataFrame, weights: list[float], bias: float, config: ClassifyConfig | None = None) -> DataFrame:
    """Pixels with all nine features, scored by a linear model: prob, pred."""
    config = config or ClassifyConfig()
    rows = table.filter(raster.all_present(list(FEATURES))).withColumn("vector", F.array(*FEATURES))
    return learning.linear_scores(rows, "vector", weights, bias, config.threshold).drop("vector")


def classify_samples(points: DataFrame, boxes: DataFrame, table: DataFrame, labels: DataFrame, model=None, grids: DataFrame | None = None, config: ClassifyConfig | None = None) -> tuple:
    """From labelled points to a map: features sampled at the points, checked (both classes, six of them at least),
    a model fitted, and every complete pixel of table(grid_id, row, col, features) classified. With grids, on the lattice
    of all grids, the first grid by number where they overlap, -1 where no pixel is complete. Returns (model, map)."""
    config = config or ClassifyConfig()
    values = list(FEATURES)
    sampled = features.sample_points(points.select("point_id", "x", "y"), boxes, table, values)
    samples = features.training_samples(sampled.select("point_id", *values), features.recoded(labels, codes=config.codes), values)
    features.check_samples(samples)
    model = learning.fit_samples(samples, values, model)
    if grids is None:
        return model, learning.predicted(table, values, model, config.threshold).withColumn("pred", F.coalesce("pred", F.lit(-1)))
    whole = lattice.canvas(table, grids.withColumn("ord", F.col("grid_id")), ["grid_id"], values)
    shape = lattice.common(grids, [], order="grid_id").first()
    every = lattice.Profile(shape.width, shape.height, shape.x_min, shape.y_max, shape.px_w, shape.px_h).cells(table.sparkSession)
    got = learning.predicted(whole, values, model, config.threshold).select("row", "col", "prob", "pred")
    return model, every.join(got, ["row", "col"], "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))


@dataclass
class SeasonalRunner:
    """Curve models of sources applied to targets, season by season.

    curves(name, season) gives a DataFrame of curves (with label and grid_id for a source, and SERIES for a target).
    A model is trained once a source and season and kept; load and save, if given, keep it across runs. What fails is
    logged and doesn't stop the rest."""

    curves: Callable[[str, str], DataFrame]
    load: Callable[[str, str], learning.FloodNet | None] | None = None
    save: Callable[[str, str, learning.FloodNet], None] | None = None
    train: learning.TrainConfig | None = None
    threshold: float = 0.5
    models: dict = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def model(self, source: str, season: str) -> learning.FloodNet:
        key = (source, season)
        if key not in self.models:
            net = self.load(*key) if self.load else None
            if net is None:
                net = learning.train_on(self.curves(*key), config=self.train)
                if self.save:
                    self.save(*key, net)
            self.models[key] = net
        return self.models[key]

    def run(self, sources: DataFrame, targets: DataFrame) -> dict[tuple[str, str, str], DataFrame]:
        """(source, target, season) to the classified pixels, for each row of the run matrix."""
        out = {}
        for r in tasks.run_matrix(sources, targets).orderBy("source", "season", "target").collect():  # configuration
            entry = {"source": r.source, "target": r.target, "season": r.season, "error": None}
            try:
                out[r.source, r.target, r.season] = learning.infer(self.curves(r.target, r.season), self.model(r.source, r.season), SERIES, self.threshold)
            except Exception as e:  # noqa: BLE001 - one target's failure is logged, the others go on
                entry["error"] = f"{type(e).__name__}: {e}"
            self.log.append(entry)
        return out


def classify_curves(stats: DataFrame, layers: DataFrame, net: learning.FloodNet, lattice: DataFrame | None = None, config: ClassifyConfig | None = None) -> DataFrame:
    """prob and pred of every pixel with a curve; on a lattice, pixels without one have label -1."""
    config = config or ClassifyConfig()
    got = learning.infer(features.curves(features.curve_points(stats, layers), config.length), net, SERIES, config.threshold)
    if lattice is None:
        return got
    return lattice.join(got, SERIES, "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))


def run_log(fitted: DataFrame, stage: str) -> DataFrame:
    """stage, season, grid_id, series, failed, done_percent, message (the commonest error, ties by name)."""
    message = F.mode("fit_error", True).alias("message")
    out = fitted.groupBy("season", "grid_id").agg(F.count(F.lit(1)).alias("series"), F.count("fit_error").alias("failed"), message)
    return out.withColumn("done_percent", F.round(100 * (1 - F.col("failed") / F.col("series")), 1)).withColumn("stage", F.lit(stage))


__all__ = ["LAYERS", "PIXEL", "ClassifyConfig", "FitConfig", "ScoreConfig", "SeasonalRunner", "classify_curves", "classify_samples", "classify_tabular", "fit_history", "metrics", "pixel_features", "run_log", "score_events", "season_layers"]
