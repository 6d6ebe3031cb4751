import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import attribution, baseline
from packetloom.operators import evaluation as ev


def scored(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = [(i, float(rng.random() < 0.4), rng.randrange(101) / 100.0, rng.randrange(7), rng.randrange(7)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, y_true double, y_prob double, stage_true int, stage_pred int")


def test_auroc_against_pairs(spark):
    rows, df = scored(spark)
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert ev.auroc(df).first().auroc == pytest.approx(want)
    assert ev.auroc(df.filter("y_true = 0")).first().auroc is None


def test_ece_leaves_one_outside(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.05), (1.0, 0.3), (0.0, 0.30000000000000004)], "y_true double, y_prob double")
    bins = [r.b for r in df.select(ev.calibration_bin("y_prob").alias("b")).collect()]
    assert bins == [10, 0, 2, 3]
    assert ev.ece(df).first().ece == pytest.approx((0.05 + 0.7 + 0.3) / 4)


def test_zero_guards(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2)], "y_true double, y_prob double")
    r = ev.with_rates(ev.confusion(df)).first()
    assert (r.precision, r.recall, r.f1, r.fpr, r.accuracy) == (0, 0, 0, 0, 1)


def test_lead_time(spark):
    df = spark.createDataFrame([("a", 10, 0.6, 50), ("a", 20, 0.7, 50), ("a", 60, 0.9, 50), ("b", 60, 0.9, 50)], "g string, ts_us bigint, y_prob double, onset_us bigint")
    got = {r.g: r.lead_seconds for r in ev.lead_time(df, ["g"]).collect()}
    assert got == {"a": pytest.approx(3e-5), "b": None}


def test_wilson_and_decomposition(spark):
    df = spark.createDataFrame([(0, 0), (8, 10)], "k int, n int")
    lo_hi = [(r.w.lo, r.w.hi) for r in df.select(ev.wilson("k", "n").alias("w")).collect()]
    assert lo_hi[0] == (0.0, 0.0) and lo_hi[1] == pytest.approx((0.490, 0.943), abs=1e-3)


def test_per_stage_support(spark):
    rows, df = scored(spark)
    got = {r.name: r for r in ev.per_stage(df).collect()}
    acc = sum(r[3] == r[4] for r in rows) / len(rows)
    assert got["accuracy"].f1 == pytest.approx(acc) and got["macro avg"].support == len(rows)
    assert got["Benign"].support == sum(r[3] == 0 for r in rows)


def vectors(spark, n=300, d=5):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return x, spark.createDataFrame([(i, [float(v) for v in row], i % 3 == 0) for i, row in enumerate(x)], "id int, v array<double>, left boolean")


def test_mahalanobis_against_numpy(spark):
    x, df = vectors(spark)
    scorer = ev.MahalanobisScorer.fit(df, "v")
    cov = np.cov(x, rowvar=False) + np.eye(x.shape[1]) * 1e-4
    inv, mean = np.linalg.pinv(cov), x.mean(axis=0)
    dist = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean))
    p95 = np.percentile(dist, 95)
    assert scorer.p95 == pytest.approx(p95)
    want = np.clip(1 / (1 + np.exp(-1.5 * (dist / p95 - 1))), 0, 1)
    got = [r.s for r in df.orderBy("id").select(scorer.score("v").alias("s")).collect()]
    assert got == pytest.approx(want.tolist())


def test_js_divergence_against_numpy(spark):
    x, df = vectors(spark)
    left = np.arange(len(x)) % 3 == 0
    got = {r.dim: r.js for r in ev.js_divergence(df, "v", F.col("left")).collect()}
    for i in range(x.shape[1]):
        edges = np.linspace(x[:, i].min(), x[:, i].max(), 31)
        p, q = (np.histogram(x[m, i], bins=edges, density=True)[0] + 1e-7 for m in (left, ~left))
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        assert got[i] == pytest.approx(0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m)), abs=1e-9)


def test_unseen_shift_is_higher_for_shifted_rows(spark):
    x, df = vectors(spark)
    moved = df.withColumn("v", F.transform("v", lambda a: a + 20.0))
    near, far = (ev.unseen_shift(df, other, "v").first() for other in (df, moved))
    assert near.divergence < far.divergence and near.mean_ood_score < far.mean_ood_score


def test_mc_summary_clips(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.5)], "id int, y_prob double")
    got = {r.id: r for r in ev.mc_summary(df, "id").collect()}
    assert (got[1].confidence_lower, got[1].confidence_upper) == (0.0, 1.0) and got[2].uncertainty_std == 0.0


def test_perturbation_finds_the_only_weight(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0, 4.0])], "id int, v array<double>")
    out = attribution.perturbation(df, "id", "v", lambda x: F.element_at(x, 2) * 10)
    assert {r.dim: r.attribution for r in out.collect()} == {0: 0.0, 1: 30.0, 2: 0.0}
    out = attribution.perturbation(df, "id", "v", lambda x: F.element_at(x, 2) * 10, background=df)
    assert {r.attribution for r in out.collect()} == {0.0}


def test_top_features_ties_keep_order(spark):
    vals = {n: 0.0 for n in attribution.NAMED} | {"syn_ratio": -5.0, "rst_ratio": 5.0, "ack_ratio": 7.0}
    df = spark.createDataFrame([vals])
    names = [f.name for f in df.select(attribution.top_features().alias("t")).first().t]
    assert names == ["ack_ratio", "syn_ratio", "rst_ratio"]


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(5)
    n, d = 400, len(baseline.FEATURES)
    x = rng.normal(size=(n, d)) * rng.uniform(1, 50, size=d)
    y = (x[:, 0] / x[:, 0].std() + rng.normal(size=n) > 0.8).astype(float)
    df = spark.createDataFrame([(f"f{i}", *map(float, x[i]), float(y[i])) for i in range(n)], ["flow_key", *baseline.FEATURES, "y_true"])
    model = baseline.fit(df)
    z = np.hstack([np.ones((n, 1)), (x - x.mean(0)) / x.std(0, ddof=1)])
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    b, ridge = np.zeros(d + 1), np.diag([0.0] + [1.0] * d)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(b[1:], abs=2e-3)
    out = baseline.evaluate(model, df).first()
    assert out.auroc > 0.7 and out.tp + out.tn + out.fp + out.fn == n
