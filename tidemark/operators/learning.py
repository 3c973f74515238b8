"""Classifiers of curves and of feature vectors: numpy on the driver to train, Arrow batches to score."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("raw_db", "gumbel", "fx", "slope_ratio", "bp_db")


def linear_scores(rows: DataFrame, column: str, weights: list[float], bias: float, threshold: float = 0.5) -> DataFrame:
    """rows with prob and pred of a linear model over an array column, in the JVM."""
    w = F.array(*map(F.lit, weights))
    product = F.zip_with(F.col(column).cast("array<double>"), w, lambda x, y: x * y)
    z = F.aggregate(product, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rows.withColumn("prob", 1 / (1 + F.exp(-(z + bias)))).withColumn("pred", (F.col("prob") >= threshold).cast("int"))


@dataclass
class LinearModel:
    """Logistic regression on scaled features: what classifies if no other model is given. Any object with fit(x, y) and
    predict_proba(x), x being (rows, features), can stand in its place."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    steps: int = 25
    penalty: float = 1e-3

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearModel:
        """Newton steps on the penalised likelihood."""
        self.centre, self.spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        z = np.c_[(x - self.centre) / self.spread, np.ones(len(x))]
        keep = np.append(np.full(x.shape[1], self.penalty), 1e-9)
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + np.diag(keep), z.T @ (p - y) / len(z) + keep * w)
            w -= step
            if np.abs(step).max() < 1e-10:
                break
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        """Columns: chance of 0, of 1."""
        p = 1 / (1 + np.exp(-np.clip(((x - self.centre) / self.spread) @ self.weights + self.bias, -700, 700)))
        return np.stack([1 - p, p], axis=1)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights.tolist(), "bias": self.bias, "centre": self.centre.tolist(), "spread": self.spread.tolist()})

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        d = json.loads(text)
        return cls(np.array(d["weights"]), d["bias"], np.array(d["centre"]), np.array(d["spread"]))


def fit_samples(samples: DataFrame, values: list[str], model=None, label: str = "label", rows: int = 200_000):
    """A model fitted to at most rows complete labelled samples, in the order of a hash."""
    table = samples.dropna("any", subset=[*values, label]).withColumn("_order", F.xxhash64(*values, label)).orderBy("_order").limit(rows).select(*values, label).toArrow()
    x = np.stack([np.asarray(table.column(v), np.float64) for v in values], axis=1)
    return (model or LinearModel()).fit(x, np.asarray(table.column(label), np.int64))


def predicted(rows: DataFrame, values: list[str], model, threshold: float = 0.5, batch: int = 10_000) -> DataFrame:
    """rows with prob and pred by any model with predict_proba, in batches; rows that lack a value have neither."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", prob double, pred int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                x = np.stack([part.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values], axis=1)
                ok = ~np.isnan(x).any(axis=1)
                p = np.full(len(x), np.nan)
                if ok.any():
                    p[ok] = model.predict_proba(x[ok])[:, 1]
                yield pa.record_batch([*part.columns, pa.array(p, mask=~ok), pa.array((p >= threshold).astype(np.int32), mask=~ok)], [*part.schema.names, "prob", "pred"])

    return rows.mapInArrow(run, kinds)


def save_model(spark: SparkSession, model, folder: str) -> None:
    """A model's JSON, and its history beside it if it has one, in any store that Spark writes to."""
    rows = [("model", model.to_json()), ("history", json.dumps(getattr(model, "history", [])))]
    spark.createDataFrame(rows, "part string, json string").coalesce(1).write.mode("overwrite").parquet(folder)


def load_model(spark: SparkSession, kind, folder: str):
    """What save_model() wrote; kind has from_json."""
    return kind.from_json(spark.read.parquet(folder).filter("part = 'model'").first().json)


@dataclass
class FloodNet:
    """Three convolutions of width 3 with batch normalisation and ReLU, mean and maximum over time, a hidden
    layer, one logit. Inputs are (rows, channels, time)."""

    layers: list[dict[str, np.ndarray]]
    head: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)

    @classmethod
    def seeded(cls, seed: int, channels: tuple[int, ...] = (5, 32, 64, 32), hidden: int = 32) -> FloodNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)
        layers = [
            {"w": normal(b, a, 3), "b": np.zeros(b), "gain": np.ones(b), "shift": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b)}
            for a, b in zip(channels, channels[1:], strict=False)
        ]
        return cls(layers, {"w1": normal(hidden, 2 * channels[-1]), "b1": np.zeros(hidden), "w2": normal(1, hidden), "b2": np.zeros(1)})

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        """Each item with its neighbours: (rows, time, channels * 3)."""
        p = np.pad(x, ((0, 0), (0, 0), (1, 1)))
        return np.stack([p[:, :, i : i + x.shape[2]] for i in range(3)], axis=2).transpose(0, 3, 1, 2).reshape(len(x), x.shape[2], -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        for a in self.layers:
            z = self._spread(x) @ a["w"].reshape(len(a["w"]), -1).T + a["b"]
            z = (z - a["mean"]) / np.sqrt(a["var"] + 1e-5) * a["gain"] + a["shift"]
            x = np.maximum(z, 0).transpose(0, 2, 1)
        h = np.concatenate([x.mean(axis=2), x.max(axis=2)], axis=1)
        h = np.maximum(h @ self.head["w1"].T + self.head["b1"], 0)
        return (h @ self.head["w2"].T + self.head["b2"])[:, 0]

    def to_json(self) -> str:
        plain = lambda d: {k: v.tolist() for k, v in d.items()}
        return json.dumps({"layers": [plain(a) for a in self.layers], "head": plain(self.head), "history": self.history})

    @classmethod
    def from_json(cls, text: str, channels: int = 5) -> FloodNet:
        d = json.loads(text)
        arrays = lambda a: {k: np.array(v) for k, v in a.items()}
        net = cls([arrays(a) for a in d["layers"]], arrays(d["head"]), d["history"])
        if net.layers[0]["w"].shape[1] != channels:
            raise ValueError(f"the model takes {net.layers[0]['w'].shape[1]} channels, not {channels}")
        return net


def tensor(batch: pa.RecordBatch) -> np.ndarray:
    """Curves of a batch as (rows, channels, time), from the flat values of its arrays; missing ratios count as 0."""
    rows = batch.num_rows
    floats = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)
    series = [floats(batch.column(c).flatten()).reshape(rows, -1) for c in CHANNELS[:3]]
    flat = [np.nan_to_num(floats(batch.column(c))) for c in CHANNELS[3:]]
    return np.stack([*series, *(np.repeat(v[:, None], series[0].shape[1], axis=1) for v in flat)], axis=1)


def infer(curves: DataFrame, net: FloodNet, key: list[str], threshold: float = 0.5) -> DataFrame:
    """key, prob and pred of each curve; curves without a slope ratio have neither."""
    sent = curves.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curves.select(*key).schema) + ", prob double, pred int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = sent.value.logits(tensor(batch))
            none = batch.column("slope_ratio").is_null().to_numpy(zero_copy_only=False)
            p = 1 / (1 + np.exp(-z))
            label = (z >= 0 if threshold == 0.5 else p >= threshold).astype(np.int32)
            yield pa.record_batch([*(batch.column(k) for k in key), pa.array(p, mask=none), pa.array(label, mask=none)], [*key, "prob", "pred"])

    return curves.select(*key, *CHANNELS).mapInArrow(run, schema)


# ------------------------------------------------------------------ training


@dataclass(frozen=True)
class TrainConfig:
    """Focal loss with the positives' weight, AdamW, cosine restarts, gradients clipped by norm, and a stop after
    patience epochs without a gain in validation AUC."""

    epochs: int = 100
    batch: int = 512
    rate: float = 1e-3
    decay: float = 1e-4
    gamma: float = 2.0
    clip: float = 5.0
    patience: int = 20
    least_gain: float = 1e-4
    first_cycle: int = 20
    cycle_growth: int = 2
    ratio: float = 0.2
    seed: int = 42


def rank_auc(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> float:
    """Area under the curve through steps + 1 thresholds, as in metrics.auc."""
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    if not pos or not neg:
        return 0.5
    t = np.linspace(0, 1, steps + 1)[::-1]
    y = [0.0, *((scores[labels == 1][None, :] >= t[:, None]).sum(axis=1) / pos), 1.0]
    x = [0.0, *((scores[labels == 0][None, :] >= t[:, None]).sum(axis=1) / neg), 1.0]
    return float(np.trapezoid(y, x))


def learning_rate(epoch: int, config: TrainConfig) -> float:
    """Cosine from the full rate to 0, over cycles that grow."""
    length = config.first_cycle
    while epoch >= length:
        epoch, length = epoch - length, length * config.cycle_growth
    return config.rate * (1 + np.cos(np.pi * epoch / length)) / 2


def _forward(net: FloodNet, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Logits with the statistics of the batch, and what the way back needs."""
    kept = []
    for a in net.layers:
        s = net._spread(x)
        z = s @ a["w"].reshape(len(a["w"]), -1).T + a["b"]
        mean, var = z.mean(axis=(0, 1)), z.var(axis=(0, 1))
        n = (z - mean) / np.sqrt(var + 1e-5)
        o = n * a["gain"] + a["shift"]
        a["mean"], a["var"] = 0.9 * a["mean"] + 0.1 * mean, 0.9 * a["var"] + 0.1 * var
        kept.append((s, n, var, o))
        x = np.maximum(o, 0).transpose(0, 2, 1)
    top = x.argmax(axis=2)
    h = np.concatenate([x.mean(axis=2), x.max(axis=2)], axis=1)
    u = np.maximum(h @ net.head["w1"].T + net.head["b1"], 0)
    return (u @ net.head["w2"].T + net.head["b2"])[:, 0], [*kept, (x, top, h, u)]


def _backward(net: FloodNet, kept: list, d: np.ndarray) -> list[tuple[dict, str, np.ndarray]]:
    """Gradients of all parameters for d = d loss / d logits."""
    x, top, h, u = kept[-1]
    du = (d[:, None] @ net.head["w2"]) * (u > 0)
    grads = [(net.head, "w2", d[None, :] @ u), (net.head, "b2", np.array([d.sum()])), (net.head, "w1", du.T @ h), (net.head, "b1", du.sum(axis=0))]
    dh, c = du @ net.head["w1"], x.shape[1]
    dx = np.repeat(dh[:, :c, None] / x.shape[2], x.shape[2], axis=2)
    np.put_along_axis(dx, top[:, :, None], np.take_along_axis(dx, top[:, :, None], 2) + dh[:, c:, None], 2)
    for a, (s, n, var, o) in zip(net.layers[::-1], kept[-2::-1], strict=True):
        do = dx.transpose(0, 2, 1) * (o > 0)
        grads += [(a, "gain", (do * n).sum(axis=(0, 1))), (a, "shift", do.sum(axis=(0, 1)))]
        dn = do * a["gain"]
        dz = (dn - dn.mean(axis=(0, 1)) - n * (dn * n).mean(axis=(0, 1))) / np.sqrt(var + 1e-5)
        flat = dz.reshape(-1, dz.shape[2])
        grads += [(a, "w", (flat.T @ s.reshape(len(flat), -1)).reshape(a["w"].shape)), (a, "b", flat.sum(axis=0))]
        ds = (dz @ a["w"].reshape(len(a["w"]), -1)).reshape(*dz.shape[:2], -1, 3).transpose(0, 2, 3, 1)
        dp = np.zeros((ds.shape[0], ds.shape[1], ds.shape[3] + 2))
        for i in range(3):
            dp[:, :, i : i + ds.shape[3]] += ds[:, :, i]
        dx = dp[:, :, 1:-1]
    return grads


def focal(logits: np.ndarray, labels: np.ndarray, weight: float, gamma: float) -> tuple[float, np.ndarray]:
    """Mean focal loss and its derivative by each logit."""
    p = np.clip(1 / (1 + np.exp(-logits)), 1e-7, 1 - 1e-7)
    q, sign, w = np.where(labels == 1, p, 1 - p), np.where(labels == 1, 1.0, -1.0), np.where(labels == 1, weight, 1.0)
    loss = w * (1 - q) ** gamma * -np.log(q)
    d_q = w * (gamma * (1 - q) ** (gamma - 1) * np.log(q) - (1 - q) ** gamma / q)
    return float(loss.mean()), d_q * sign * p * (1 - p) / len(logits)


def train(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, config: TrainConfig | None = None) -> FloodNet:
    """A network from curves (rows, channels, time). Whole groups (grids) are held out for validation; with
    one group, rows are. The state with the best validation AUC is returned, with its history."""
    config = config or TrainConfig()
    rng = np.random.default_rng(config.seed)
    units = np.unique(groups)
    if len(units) < 2:
        units, groups = np.arange(len(x)), np.arange(len(x))
    held = np.isin(groups, rng.permutation(units)[: max(1, int(len(units) * config.ratio))])
    weight = (labels[~held] == 0).sum() / ((labels[~held] == 1).sum() + 1e-7)
    net = FloodNet.seeded(config.seed, (x.shape[1], 32, 64, 32))
    moments: dict = {}
    best, kept, since, step = -1.0, net.to_json(), 0, 0
    for epoch in range(config.epochs):
        rate, losses = learning_rate(epoch, config), []
        order = rng.permutation(np.flatnonzero(~held))
        for at in range(0, len(order), config.batch):
            rows = order[at : at + config.batch]
            z, trail = _forward(net, x[rows])
            loss, d = focal(z, labels[rows], weight, config.gamma)
            losses.append(loss)
            grads = _backward(net, trail, d)
            norm = np.sqrt(sum(float((g**2).sum()) for _, _, g in grads))
            step += 1
            for owner, name, g in grads:
                g = g * min(1.0, config.clip / (norm + 1e-6))
                m, v = moments.get((id(owner), name), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[id(owner), name] = m, v
                owner[name] = owner[name] * (1 - rate * config.decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        score = rank_auc(1 / (1 + np.exp(-net.logits(x[held]))), labels[held])
        net.history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "val_auc": score, "lr": float(rate)})
        if score > best + config.least_gain:
            best, kept, since = score, net.to_json(), 0
        elif (since := since + 1) >= config.patience:
            break
    final = FloodNet.from_json(kept, x.shape[1])
    final.history = net.history
    return final


def train_on(curves: DataFrame, label: str = "label", group: str = "grid_id", rows: int = 200_000, config: TrainConfig | None = None) -> FloodNet:
    """train() on at most rows labelled curves, in the order of a hash: they reach the driver as one Arrow table."""
    keyed = curves.filter(F.col(label).isNotNull()).withColumn("_order", F.xxhash64(*CHANNELS[:3], group)).orderBy("_order").limit(rows)
    batches = [b for b in keyed.select(*CHANNELS, label, group).toArrow().to_batches() if b.num_rows]
    if not batches:
        raise ValueError("there are no labelled curves to learn from")
    labels, groups = (np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in (label, group))
    return train(np.concatenate(list(map(tensor, batches))), labels, groups, config)
