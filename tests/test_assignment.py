import math

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from lociflow.functions import geo, scores
from lociflow.operators import ensemble, loocv, metrics


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 180.0), (-3.1, -60.0, -15.8, -47.9)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine_km(*map(F.col, "abcd"))).collect()]
    assert round(got[0], 4) == 4.0294 and abs(got[1] - math.pi * 6371) < 5 and 1900 < got[2] < 2000


def test_lower_median_and_thresholds(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "haversine_km double")
    assert df.agg(metrics.lower_median("haversine_km")).first()[0] == 2.0
    at = spark.createDataFrame([(250.0,), (250.1,), (2000.0,)], "haversine_km double")
    assert [round(x, 4) for x in metrics.within(at).first()] == [0.3333, 0.6667, 0.6667]


def test_class_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string")
    s = {r["class"]: (r.precision, r.recall, round(r.f1, 4)) for r in metrics.class_scores(pairs, ["a", "b", "c"]).collect()}
    assert s == {"a": (1.0, 0.5, 0.6667), "b": (0.5, 1.0, 0.6667), "c": (0.0, 0.0, 0.0)}
    assert round(metrics.macro_f1(metrics.class_scores(pairs, ["a", "b", "c"])).first()[0], 4) == 0.4444


def test_coordinate_stats(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 0.0), ("b", 3.0, 4.0)], "individual_id string, latitude double, longitude double")
    r = metrics.coordinate_stats(df).first()
    assert (r.lat_mean, r.lon_mean) == (2.0, 2.0) and abs(r.lat_std - math.sqrt(2)) < 1e-9
    assert metrics.coordinate_stats(df.where("individual_id = 'b'")).first().lat_std == 1e-6


def test_empty_metrics_are_nan(spark):
    none = spark.createDataFrame([], "true_lat double, true_lon double, pred_lat double, pred_lon double, haversine_km double")
    assert all(math.isnan(x) for x in metrics.geo_errors(none).first())


def test_score_functions(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0], 2, 0)], "v array<double>, a int, b int")
    assert df.select(scores.argmax(F.col("v")), scores.effect_score(F.col("v"), F.col("a"), F.col("b"))).first() == (1, -4.0)
    assert spark.range(1).select(scores.class_index(F.lit("Cerrado"))).first()[0] == 3
    with pytest.raises(SparkRuntimeException):
        spark.range(1).select(scores.class_index(F.lit("Moon"))).collect()
    got = spark.range(1).select(scores.perplexity(F.lit(50.0)), scores.perplexity(F.lit(float("nan"))), scores.token_accuracy(F.lit(0), F.lit(0))).first()
    assert got[0] == math.exp(20) and math.isnan(got[1]) and math.isnan(got[2])


def test_votes_and_best(spark):
    p = spark.createDataFrame([("x", "b", 0), ("x", "a", 1), ("x", "a", 2), ("x", "b", 3), ("y", "c", 0)], "individual_id string, pred_biome string, trial_rank int")
    assert {r.individual_id: (r.pred_biome, r.votes) for r in ensemble.majority_vote(p).collect()} == {"x": ("b", 2), "y": ("c", 1)}
    t = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0)], "trial int, objective double")
    assert ensemble.best_trial(t).first().trial == 1 and [r.trial for r in ensemble.top_trials(t, 2).collect()] == [1, 2]


def people(spark, n=20, loci=30):
    rng = np.random.RandomState(0)
    rows = []
    for i in range(n):
        k = i % 2
        g = rng.binomial(2, np.where(np.arange(loci) % 2 == k, 0.9, 0.1))
        g[rng.rand(loci) < 0.05] = -1
        rows.append((f"i{i:02d}", -5.0 - 15 * k, -60.0 + 10 * k, ("Amazon", "Cerrado")[k], g.tolist()))
    return spark.createDataFrame(rows, "individual_id string, latitude double, longitude double, biome string, genotypes array<int>")


def test_leave_one_out_learns(spark):
    got = metrics.with_distance(loocv.run(people(spark), [loocv.Trial(layers=1, width=16, epochs=80)])).collect()
    assert len(got) == 20 and np.mean([r.true_biome == r.pred_biome for r in got]) > 0.9
    assert np.median([r.haversine_km for r in got]) < 700
    again = loocv.run(people(spark), [loocv.Trial(layers=1, width=16, epochs=80)]).collect()
    assert {r.fold: r.pred_lat for r in got} == {r.fold: r.pred_lat for r in again}


def test_gradients_by_difference():
    rng = np.random.RandomState(1)
    a, b = rng.uniform(-20, 20, (5, 2)), rng.uniform(-20, 20, (5, 2))

    def km(p):
        x, y = np.radians(p), np.radians(b)
        h = np.sin((x[:, 0] - y[:, 0]) / 2) ** 2 + np.cos(x[:, 0]) * np.cos(y[:, 0]) * np.sin((x[:, 1] - y[:, 1]) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))

    g = loocv._haversine_gradient(a, b)
    for j in range(2):
        e = np.zeros(2)
        e[j] = 1e-5
        assert np.allclose(g[:, j], (km(a + e) - km(a - e)) / 2e-5, rtol=1e-4)


def test_network_gradients_by_difference():
    """All parameters, through batch norm and gate, of the loss as it is written down."""
    rng = np.random.RandomState(2)
    x, coords, classes = rng.binomial(2, 0.4, (9, 6)).astype(float), rng.uniform(-20, 20, (9, 2)), rng.randint(0, 3, 9)
    mean, sd, onehot = coords.mean(0), coords.std(0), np.eye(3)[classes]
    net = loocv.Network(6, loocv.Trial(layers=2, width=5, dropout=0.0, coord_weight=0.7, class_weight=1.3), 3, rng.normal(size=6))

    def loss():
        c, k, _, _ = net.forward(x, train=True)
        p, t = np.radians(c * sd + mean), np.radians(coords)
        a = np.sin((p[:, 0] - t[:, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(t[:, 0]) * np.sin((p[:, 1] - t[:, 1]) / 2) ** 2
        return 0.7 * (2 * 6371 * np.arcsin(np.sqrt(a))).mean() / 1000 + 1.3 * (np.log(np.exp(k).sum(1)) - k[np.arange(9), classes]).mean()

    found = net.gradients(x, coords, onehot, mean, sd)
    assert set(found) == set(net.p)
    for key, g in found.items():
        for at in list(np.ndindex(g.shape))[:6]:
            old = net.p[key][at]
            net.p[key][at] = old + 1e-6
            up = loss()
            net.p[key][at] = old - 1e-6
            down = loss()
            net.p[key][at] = old
            assert abs(g[at] - (up - down) / 2e-6) < 1e-5, (key, at)


@pytest.mark.parametrize("mode", ["weighted", "selection", "learnable"])
def test_effect_modes(spark, mode):
    got = loocv.run(people(spark, 6), [loocv.Trial(layers=1, width=8, epochs=5, ves_mode=mode)], scores=np.linspace(-1, 2, 30).tolist(), top_k=10).collect()
    assert len(got) == 6 and all(math.isfinite(r.pred_lat) for r in got)


def test_search(spark):
    got = loocv.search(people(spark, 8), [loocv.Trial(t, 1, 8, epochs=10 + 20 * t) for t in range(3)], top=2)
    assert got["trials"].count() == 3 and got["ensemble"].count() == 8
    assert got["adopted"].first().adopted in ("ensemble", "best_trial")
    assert loocv.random_trials(3, 5) == loocv.random_trials(3, 5) and loocv.layer_widths(50, 256, 3) == [40, 32, 25]
