"""Leave-one-out evaluation of a small two-headed network, one task for each trial and fold."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.scores import BIOMES
from lociflow.operators import ensemble, metrics
from lociflow.operators.shared import settled
from lociflow.plans.config import VES_MODES

#: Share of a step in the running statistics of batch norm.
MOMENTUM = 0.1
#: Most genotypes (a byte each) that are sent to the driver and the tasks.
MOST_CELLS = 500_000_000


@dataclass(frozen=True)
class Trial:
    """Settings of one network."""

    trial: int = 0
    layers: int = 2
    width: int = 64
    dropout: float = 0.1
    rate: float = 1e-2
    epochs: int = 60
    coord_weight: float = 1.0
    class_weight: float = 1.0
    ves_mode: str = "none"
    seed: int = 0
    weight_decay: float = 1e-4
    top_k: int | None = None

    def __post_init__(self) -> None:
        if self.ves_mode not in VES_MODES:
            raise ValueError(f"ves_mode must be one of {VES_MODES}")


def random_trials(n: int, seed: int = 0, ves_mode: str = "none") -> list[Trial]:
    """Trials drawn from the search space that is matched; the same for the same seed."""
    rng = np.random.RandomState(seed)
    log = lambda a, b: float(np.exp(rng.uniform(np.log(a), np.log(b))))
    whole = lambda a, b: int(rng.randint(a, b + 1))
    return [
        Trial(t, whole(3, 4), min(512, int(log(200, 513))), float(rng.uniform(0.03, 0.25)), log(1.5e-3, 1.5e-2), whole(200, 800), log(0.5, 6), log(0.1, 3), ves_mode, seed, log(1e-5, 5e-3), whole(2000, 5000) if ves_mode == "selection" else None)
        for t in range(n)
    ]


def schedule(step: int, steps: int) -> float:
    """Share of the rate at a step from 0: linear warm-up over a tenth, then half a cosine to 0."""
    warm = max(1, steps // 10)
    if step < warm:
        return step / warm
    return 0.5 * (1 + float(np.cos(np.pi * (step - warm) / max(1, steps - warm))))


def layer_widths(inputs: int, width: int, layers: int) -> list[int]:
    """Widths that shrink to 0.8 of the one before where they would exceed it."""
    out, last = [], inputs
    for _ in range(layers):
        last = min(width, max(1, int(last * 0.8))) if width > last else width
        out.append(last)
    return out


class Network:
    """Optional gate, batch norm, [linear, ELU, dropout] layers, heads for coordinates and classes; Adam with decoupled weight decay, warm-up and a cosine schedule.

    Batch norm has a scale and a shift, and predicts by running statistics.
    """

    def __init__(self, inputs: int, trial: Trial, classes: int, gate: np.ndarray | None = None):
        rng = np.random.RandomState(trial.seed + 1000 * trial.trial)
        sizes = [inputs, *layer_widths(inputs, trial.width, trial.layers)]
        self.rng, self.trial = rng, trial
        self.p = {f"w{i}": rng.normal(0, np.sqrt(2 / a), (a, b)) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))}
        self.p |= {f"b{i}": np.zeros(b) for i, b in enumerate(sizes[1:])}
        self.p |= {"wc": rng.normal(0, 0.05, (sizes[-1], 2)), "bc": np.zeros(2), "wk": rng.normal(0, 0.05, (sizes[-1], classes)), "bk": np.zeros(classes)}
        self.p |= {"scale": np.ones(inputs), "shift": np.zeros(inputs)}
        if gate is not None:
            self.p["gate"] = gate.astype(float).copy()
        self.depth = trial.layers
        self.mean, self.var = np.zeros(inputs), np.ones(inputs)

    def _input(self, x: np.ndarray) -> np.ndarray:
        return x / (1 + np.exp(-self.p["gate"])) if "gate" in self.p else x

    def forward(self, x: np.ndarray, train: bool = False):
        g = self._input(x)
        mean, var = self.mean, self.var
        if train:
            mean, var = g.mean(0), g.var(0)
            self.mean = (1 - MOMENTUM) * self.mean + MOMENTUM * mean
            self.var = (1 - MOMENTUM) * self.var + MOMENTUM * var * len(x) / max(1, len(x) - 1)
        self.inverse = 1 / np.sqrt(var + 1e-5)
        self.normal = (g - mean) * self.inverse
        h, kept = self.normal * self.p["scale"] + self.p["shift"], []
        for i in range(self.depth):
            z = h @ self.p[f"w{i}"] + self.p[f"b{i}"]
            a = np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
            mask = (self.rng.rand(*a.shape) >= self.trial.dropout) / (1 - self.trial.dropout) if train and self.trial.dropout else 1.0
            kept.append((h, z, mask))
            h = a * mask
        return h @ self.p["wc"] + self.p["bc"], h @ self.p["wk"] + self.p["bk"], h, kept

    def gradients(self, x: np.ndarray, coords: np.ndarray, onehot: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of coord_weight * mean distance / 1000 km + class_weight * mean cross entropy."""
        n = len(x)
        c, k, h, kept = self.forward(x, train=True)
        dc = self.trial.coord_weight * _haversine_gradient(c * sd + mean, coords) * sd / n / 1000
        e = np.exp(k - k.max(1, keepdims=True))
        dk = self.trial.class_weight * (e / e.sum(1, keepdims=True) - onehot) / n
        g = {"wc": h.T @ dc, "bc": dc.sum(0), "wk": h.T @ dk, "bk": dk.sum(0)}
        dh = dc @ self.p["wc"].T + dk @ self.p["wk"].T
        for i in reversed(range(self.depth)):
            before, z, mask = kept[i]
            dz = dh * mask * np.where(z > 0, 1.0, np.exp(np.minimum(z, 0)))
            g[f"w{i}"], g[f"b{i}"] = before.T @ dz, dz.sum(0)
            dh = dz @ self.p[f"w{i}"].T
        g["scale"], g["shift"] = (dh * self.normal).sum(0), dh.sum(0)
        if "gate" in self.p:
            s, du = 1 / (1 + np.exp(-self.p["gate"])), dh * self.p["scale"]
            du = self.inverse * (du - du.mean(0) - self.normal * (du * self.normal).mean(0))
            g["gate"] = (du * x * s * (1 - s)).sum(0)
        return g

    def fit(self, x: np.ndarray, coords: np.ndarray, classes: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> Network:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        onehot = np.eye(self.p["bk"].size)[classes]
        for step in range(1, self.trial.epochs + 1):
            rate = self.trial.rate * schedule(step - 1, self.trial.epochs)
            for key, grad in self.gradients(x, coords, onehot, mean, sd).items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad**2
                self.p[key] *= 1 - rate * self.trial.weight_decay
                self.p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        return self


def _haversine_gradient(pred: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Gradient of the distance in km by predicted degrees."""
    p, t = np.radians(pred), np.radians(true)
    dlat, dlon = p[:, 0] - t[:, 0], p[:, 1] - t[:, 1]
    a = np.sin(dlat / 2) ** 2 + np.cos(p[:, 0]) * np.cos(t[:, 0]) * np.sin(dlon / 2) ** 2
    free = (a > 1e-7) & (a < 1 - 1e-7)
    a = np.clip(a, 1e-7, 1 - 1e-7)
    da = np.stack([np.sin(dlat) / 2 - np.sin(p[:, 0]) * np.cos(t[:, 0]) * np.sin(dlon / 2) ** 2, np.cos(p[:, 0]) * np.cos(t[:, 0]) * np.sin(dlon) / 2], 1)
    return np.where(free[:, None], 6371.0 / np.sqrt(a * (1 - a))[:, None] * da, 0.0) * np.pi / 180


PREDICTION = "trial int, fold string, individual_id string, true_lat double, true_lon double, pred_lat double, pred_lon double, true_biome string, pred_biome string, logits array<double>"


def run(individuals: DataFrame, trials: list[Trial], scores: list[float] | None = None, classes: tuple[str, ...] = BIOMES, top_k: int | None = None) -> DataFrame:
    """Predictions of each trial and fold.

    individuals: individual_id, latitude, longitude, biome, genotypes (a row of
    the dense matrix, -1 for missing). Individuals are few (a row each, tens of
    thousands of bytes), so the table is sent to the tasks, once its size is
    checked against MOST_CELLS; a (trial, fold) pair
    is a task's group, trained without the fold's individual. Missing genotypes
    take two draws at the frequency among the others. A trial's own top_k goes
    before that of the call.
    """
    if scores is None and any(t.ves_mode != "none" for t in trials):
        raise ValueError("a ves_mode other than none needs scores")
    spark = individuals.sparkSession
    cells = individuals.agg(F.sum(F.size("genotypes").cast("long"))).first()[0] or 0
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} genotypes are more than the {MOST_CELLS} that a fold's network is trained on")
    data = individuals.select("individual_id", F.col("latitude").cast("double"), F.col("longitude").cast("double"), "biome", "genotypes").orderBy("individual_id").toPandas()
    if data.empty:
        raise ValueError("no individuals")
    if scores is not None and len(scores) != len(data["genotypes"].iloc[0]):
        raise ValueError(f"{len(scores)} scores for {len(data['genotypes'].iloc[0])} loci")
    shared = spark.sparkContext.broadcast(data)
    settings = spark.sparkContext.broadcast({t.trial: t for t in trials})
    ves = None if scores is None else np.asarray(scores, float)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, who in zip(frame["trial"], frame["fold"]):
            rows.append(_fold(shared.value, settings.value[int(t)], str(who), ves, classes, top_k))
        return pd.DataFrame(rows)

    pairs = spark.createDataFrame([(t.trial, str(i)) for t in trials for i in data["individual_id"]], "trial int, fold string")
    return pairs.groupBy("trial", "fold").applyInPandas(fold, PREDICTION)


def _fold(data: pd.DataFrame, trial: Trial, who: str, ves: np.ndarray | None, classes: tuple[str, ...], top_k: int | None) -> dict:
    ids = data["individual_id"].astype(str).to_numpy()
    g = np.stack(data["genotypes"].to_numpy()).astype(float)
    test = ids == who
    known = g >= 0
    n = (known & ~test[:, None]).sum(0)
    freq = np.where(n > 0, np.where(known & ~test[:, None], g, 0).sum(0) / np.maximum(1, 2 * n), 0.0)
    rng = np.random.RandomState(trial.seed + int(np.flatnonzero(test)[0]))
    x = np.where(known, g, (rng.rand(*g.shape) < freq).astype(float) + (rng.rand(*g.shape) < freq))
    gate = None
    if trial.ves_mode != "none" and ves is not None:
        size = np.abs(ves)
        if trial.ves_mode == "weighted":
            x = x * size
        elif trial.ves_mode == "selection":
            x = x[:, np.sort(np.lexsort((np.arange(len(size)), -size))[: trial.top_k or top_k or len(size)])]
        else:
            logs = np.log(np.maximum(size, 1e-8))
            gate = (logs - logs.mean()) / max(logs.std(ddof=1) if len(logs) > 1 else 0.0, 1e-6) * 2
    coords = data[["latitude", "longitude"]].to_numpy(float)
    mean, sd = coords[~test].mean(0), np.maximum(coords[~test].std(0, ddof=1) if (~test).sum() > 1 else 0.0, 1e-6)
    label = np.array([classes.index(b) for b in data["biome"]])
    net = Network(x.shape[1], trial, len(classes), gate).fit(x[~test], coords[~test], label[~test], mean, sd)
    c, k, _, _ = net.forward(x[test])
    lat, lon = (c[0] * sd + mean).tolist()
    return {"trial": trial.trial, "fold": who, "individual_id": who, "true_lat": coords[test][0, 0], "true_lon": coords[test][0, 1], "pred_lat": lat, "pred_lon": lon, "true_biome": classes[int(label[test][0])], "pred_biome": classes[int(k[0].argmax())], "logits": k[0].tolist()}


def search(individuals: DataFrame, trials: list[Trial], top: int = 5, **kw) -> dict[str, DataFrame]:
    """Predictions, each trial's lower median distance, the ensemble of the best, and which of it and the best trial stays."""
    found = settled(metrics.with_distance(run(individuals, trials, **kw)))
    objective = found.groupBy("trial").agg(metrics.lower_median("haversine_km").alias("objective"))
    truth = found.select("individual_id", "true_lat", "true_lon", "true_biome").distinct()
    joint = metrics.with_distance(ensemble.ensemble(found, objective, top).join(truth, "individual_id"))
    best = found.join(F.broadcast(ensemble.best_trial(objective).select("trial")), "trial")
    return {"predictions": found, "trials": objective, "ensemble": joint, "adopted": ensemble.adopted(joint, best)}


def centroid_baseline(metadata: DataFrame) -> DataFrame:
    """Each individual placed at the mean of the others of its class, by totals less its own; alone, at its own place."""
    totals = metadata.groupBy("biome").agg(F.sum("latitude").alias("__lat"), F.sum("longitude").alias("__lon"), F.count("*").alias("__n")).withColumnRenamed("biome", "__biome")
    rest = F.greatest(F.col("__n") - 1, F.lit(1))
    place = lambda c, s: F.when(F.col("__n") > 1, (F.col(s) - F.col(c)) / rest).otherwise(F.col(c))
    return metadata.join(totals, F.col("biome") == F.col("__biome")).select("individual_id", F.col("biome").alias("true_biome"), F.col("latitude").alias("true_lat"), F.col("longitude").alias("true_lon"), place("latitude", "__lat").alias("pred_lat"), place("longitude", "__lon").alias("pred_lon"))


def settings_of(trials: list[Trial]) -> list[dict]:
    return [asdict(t) for t in trials]
