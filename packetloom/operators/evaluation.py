"""Metrics over scored tables; several models or groups are evaluated in one pass.

A scored table has ``y_true`` and ``y_prob`` (and ``stage_true`` / ``stage_pred`` where stages
matter). ``by`` names grouping columns such as a model name; an empty list means one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import clip, col, q6
from packetloom.operators.ordering import exact_quantiles, prefix_sums

# Ten calibration bins; edges as floating-point multiples of 0.1.
ECE_EDGES = [i * 0.1 for i in range(10)] + [1.0]
WILSON_Z = 1.95996


def _truth() -> Column:
    return F.col("y_true") > 0.5


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, pred = _truth(), F.col("y_prob") >= threshold
    return scored.groupBy(*by).agg(
        F.count_if(hit & pred).alias("tp"), F.count_if(~hit & ~pred).alias("tn"),
        F.count_if(~hit & pred).alias("fp"), F.count_if(hit & ~pred).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn), "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "fpr": fp / F.greatest(fp + tn, F.lit(1)), "accuracy": _safe(tp + tn, tp + tn + fp + fn)})


def auroc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with mid-ranks for ties; null when one class is missing.

    Equal scores collapse to one counted row, and the running negative count comes from
    distributed prefix sums, so no task orders all scores.
    """
    by = list(by)
    counts = scored.groupBy(*by, "y_prob").agg(
        F.count_if(_truth()).alias("_p"), F.count_if(~_truth()).alias("_n"))
    ranked = prefix_sums(counts, ["y_prob"], {"_below": F.col("_n")}, by)
    won = F.col("_p") * (F.col("_below") - F.col("_n") / F.lit(2.0))
    return ranked.groupBy(*by).agg(F.sum(won).alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).select(
        *by, F.try_divide(F.col("_w"), F.col("_p").cast("double") * F.col("_n")).alias("auroc"))


def brier(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col("y_prob") - _truth().cast("double")
    return scored.groupBy(*by).agg(F.avg(gap * gap).alias("brier_score"))


def calibration_bin(p) -> Column:
    """0..9 for [lo, hi) bins, 10 for p >= 1, -1 below 0."""
    edges = F.array(*[F.lit(e) for e in ECE_EDGES])
    return F.size(F.filter(edges, lambda e: col(p) >= e)) - 1


def ece(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error; a probability of exactly 1 lies in no bin but counts in n."""
    bins = scored.groupBy(*by, calibration_bin("y_prob").alias("_bin")).agg(
        F.count("*").alias("_n"), F.avg("y_prob").alias("_conf"), F.avg(_truth().cast("double")).alias("_acc"))
    inside = F.col("_bin").between(0, 9)
    return bins.groupBy(*by).agg((F.coalesce(F.sum(F.when(
        inside, F.col("_n") * F.abs(F.col("_acc") - F.col("_conf")))), F.lit(0.0)) / F.sum("_n")).alias("ece"))


def lead_time(scored: DataFrame, by: Sequence[str], onset: str = "onset_us", ts: str = "ts_us",
              threshold: float = 0.7) -> DataFrame:
    """Seconds between the first alert at or before the onset and the onset; null without one."""
    alert = F.min(F.when((F.col("y_prob") >= threshold) & (F.col(ts) <= F.col(onset)), F.col(ts)))
    return scored.groupBy(*by, onset).agg(alert.alias("first_alert_us")).withColumn(
        "lead_seconds", (F.col(onset) - F.col("first_alert_us")) / F.lit(1e6))


def per_stage(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per stage plus accuracy, macro and weighted lines."""
    pairs = scored.groupBy("stage_true", "stage_pred").agg(F.count("*").alias("n"))
    hit = F.col("stage_true") == F.col("stage_pred")
    sides = pairs.select("n", hit.alias("hit"), F.explode(F.array(
        F.struct(F.col("stage_true").alias("stage"), F.lit(True).alias("real")),
        F.struct(F.col("stage_pred").alias("stage"), F.lit(False).alias("real")))).alias("s"))
    sums = sides.groupBy(F.col("s.stage").alias("stage")).agg(
        F.sum(F.when(F.col("hit") & F.col("s.real"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.real"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.real"), F.col("n")).otherwise(0)).alias("predicted"))
    stages = ", ".join(f"({s}, '{n}')" for s, n in fv.STAGES.items())
    dim = scored.sparkSession.sql(f"SELECT * FROM VALUES {stages} AS stage_dim(stage, name)")
    zero = F.lit(0)
    full = dim.join(sums, "stage", "left").select(
        "name", F.coalesce("tp", zero).alias("tp"), F.coalesce("support", zero).alias("support"),
        F.coalesce("predicted", zero).alias("predicted"))
    lines = full.select(
        "name", _safe(F.col("tp"), F.col("predicted")).alias("precision"), _safe(F.col("tp"), F.col("support")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp")
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = lines.agg(*[F.avg(c).alias(c) for c in names], total.alias("support")).withColumn("name", F.lit("macro avg"))
    weighted = lines.agg(*[_safe(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names],
                         total.alias("support")).withColumn("name", F.lit("weighted avg"))
    acc = lines.agg(*[_safe(F.sum("tp"), total).alias(c) for c in names],
                    total.alias("support")).withColumn("name", F.lit("accuracy"))
    return lines.drop("tp").unionByName(macro).unionByName(weighted).unionByName(acc)


# Telemetry dimensions of forecasts.
DYNAMICS = ["port_entropy", "syn_ratio", "log_bytes"]


def dynamics_mse(pairs: DataFrame) -> DataFrame:
    """Mean squared error overall and per dimension of ``<dim>_pred`` against ``<dim>_true``."""
    sq = {d: F.pow(F.col(f"{d}_pred") - F.col(f"{d}_true"), 2) for d in DYNAMICS}
    return pairs.agg(F.avg(sum((sq[d] for d in DYNAMICS[1:]), sq[DYNAMICS[0]]) / len(DYNAMICS)).alias("dynamics_mse_overall"),
                     *[F.avg(sq[d]).alias(f"{d}_mse") for d in DYNAMICS])


def rollout(pairs: DataFrame) -> DataFrame:
    """MAE and RMSE per horizon step and dimension."""
    long = pairs.select("k", F.explode(F.array(*[
        F.struct(F.lit(d).alias("feature"), (F.col(f"{d}_pred") - F.col(f"{d}_true")).alias("err")) for d in DYNAMICS])).alias("e"))
    return long.groupBy("k", F.col("e.feature").alias("feature")).agg(
        F.avg(F.abs("e.err")).alias("mae"), F.sqrt(F.avg(F.pow("e.err", 2))).alias("rmse"))


def rollout_heads(scored: DataFrame) -> DataFrame:
    """Risk F1 (strictly above 0.5 on both sides) and stage accuracy of a rollout."""
    pred = F.col("y_prob") > 0.5
    agg = scored.agg(F.count_if(_truth() & pred).alias("tp"), F.count_if(~_truth() & pred).alias("fp"),
                     F.count_if(_truth() & ~pred).alias("fn"), F.count("*").alias("n_samples"),
                     F.avg((F.col("stage_true") == F.col("stage_pred")).cast("double")).alias("stage_acc"))
    return agg.select("n_samples", "stage_acc", (F.col("tp") / F.greatest(
        F.col("tp") + 0.5 * (F.col("fp") + F.col("fn")), F.lit(1e-8))).alias("infil_f1"))


def report(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Every scalar metric, one row per group, from a single pass over the scored rows.

    Rows collapse to positive and negative counts per score; the ranked counts give the ROC
    area, and the same counts per calibration bin give all other metrics.
    """
    by = list(by)
    counts = scored.groupBy(*by, "y_prob").agg(F.count_if(_truth()).alias("_p"), F.count_if(~_truth()).alias("_n"))
    ranked = prefix_sums(counts, ["y_prob"], {"_below": F.col("_n")}, by)
    p, n, prob = F.col("_p"), F.col("_n"), F.col("y_prob")
    up = prob >= 0.5

    def tally(x: Column, cond: Column) -> Column:
        return F.sum(F.when(cond, x).otherwise(F.lit(0)))

    bins = ranked.groupBy(*by, calibration_bin("y_prob").alias("_bin")).agg(
        tally(p, up).alias("tp"), tally(n, ~up).alias("tn"), tally(n, up).alias("fp"), tally(p, ~up).alias("fn"),
        F.sum(p).alias("_p"), F.sum(n).alias("_n"), F.sum(prob * (p + n)).alias("_conf"),
        F.sum(p * F.pow(prob - 1, 2) + n * prob * prob).alias("_sq"),
        F.sum(p * (F.col("_below") - n / F.lit(2.0))).alias("_won"))
    off = F.when(F.col("_bin").between(0, 9), F.abs(F.col("_p") - F.col("_conf"))).otherwise(F.lit(0.0))
    total = F.sum(F.col("_p") + F.col("_n"))
    sums = bins.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")], (F.sum("_sq") / total).alias("brier_score"), (F.sum(off) / total).alias("ece"),
        F.try_divide(F.sum("_won"), F.sum("_p").cast("double") * F.sum("_n")).alias("auroc"))
    return with_rates(sums)


def _fixed(x, digits: int) -> Column:
    """Half-up decimal text with a fixed number of digits, from integer arithmetic."""
    units = F.floor(col(x) * float(10**digits) + 0.5).cast("bigint")
    base = F.lit(10**digits).cast("bigint")
    whole = F.floor(units / base).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((units - whole * base).cast("string"), digits, "0"))


def benchmark_table(reports: DataFrame) -> DataFrame:
    """Side-by-side report with every number formatted for display."""
    return reports.select(
        "model", *[_fixed(c, 3).alias(c) for c in ("f1", "precision", "recall")],
        F.concat(_fixed(F.col("fpr") * 100, 3), F.lit("%")).alias("fpr"),
        F.coalesce(_fixed("auroc", 3), F.lit("N/A")).alias("auroc"),
        _fixed("brier_score", 4).alias("brier_score"), _fixed("ece", 4).alias("ece"))


# -- distribution shift ------------------------------------------------------------------------

JS_BINS, JS_EPS = 30, 1e-7


def js_divergence(df: DataFrame, vector: str, is_left: Column) -> DataFrame:
    """Jensen-Shannon divergence per vector position between two row groups, over shared bins.

    Constant positions are left out. Rows are reduced to (position, bin) counts before any
    comparison, so the data size only affects the first aggregate.
    """
    long = df.select(is_left.alias("left"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    ranges = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                     F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right"))
    ranges = ranges.filter(F.abs(F.col("hi") - F.col("lo")) >= 1e-9).withColumn("step", (F.col("hi") - F.col("lo")) / JS_BINS)
    placed = long.join(F.broadcast(ranges), "dim")  # one row per vector position
    guess = F.floor((F.col("x") - F.col("lo")) / F.col("step"))

    def edge(i: Column) -> Column:
        return F.col("lo") + i * F.col("step")

    fixed = F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1).when(
        F.col("x") >= edge(F.col("g") + 1), F.col("g") + 1).otherwise(F.col("g"))
    counts = placed.withColumn("g", guess).groupBy(
        "dim", "n_left", "n_right", "step", clip(fixed, 0, JS_BINS - 1).alias("bin")).agg(
        F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r"))
    # bins nobody fell into still carry the epsilon mass
    per_dim = counts.withColumns({
        "dl": F.col("l") / (F.col("n_left") * F.col("step")) + JS_EPS,
        "dr": F.col("r") / (F.col("n_right") * F.col("step")) + JS_EPS})
    sums = per_dim.groupBy("dim").agg(F.sum("dl").alias("sl"), F.sum("dr").alias("sr"), F.count("*").alias("used"))
    empty = (F.lit(JS_BINS) - F.col("used")) * JS_EPS
    joined = per_dim.join(sums.select("dim", (F.col("sl") + empty).alias("sl"), (F.col("sr") + empty).alias("sr"), "used"), "dim")

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return p * F.log(p / m) / 2 + q * F.log(q / m) / 2

    body = F.sum(term(F.col("dl") / F.col("sl"), F.col("dr") / F.col("sr")))
    blank = term(F.lit(JS_EPS) / F.col("sl"), F.lit(JS_EPS) / F.col("sr"))
    return joined.groupBy("dim", "sl", "sr", "used").agg(body.alias("body")).select(
        "dim", (F.col("body") + (F.lit(JS_BINS) - F.col("used")) * blank).alias("js"))


def vector_mean(df: DataFrame, vector: str) -> DataFrame:
    return (df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
            .groupBy("i").agg(F.avg("x").alias("mean")))


def covariance(df: DataFrame, vector: str, ridge: float = 1e-4) -> DataFrame:
    """Sample covariance entries ``i, j, cov`` with a ridge on the diagonal.

    Each batch is centred and multiplied in NumPy and leaves one partial d x d matrix, so the
    shuffle carries d^2 numbers per batch, not per row.
    """
    means = np.array([r["mean"] for r in vector_mean(df, vector).orderBy("i").collect()])  # d numbers

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(means), len(means))), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64) - means
                total, n = total + x.T @ x, n + len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel(), "n": n})

    parts = df.select(vector).mapInPandas(partial, "i int, j int, s double, n bigint")
    return parts.groupBy("i", "j").agg((F.sum("s") / (F.sum("n") - 1)).alias("cov")).withColumn(
        "cov", F.col("cov") + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(F.lit(0.0)))


class MahalanobisScorer:
    """Distance to a training distribution, squashed around its 95th percentile.

    Only the d x d covariance reaches the driver (d up to a few hundred); distances are
    computed in Arrow batches and the percentile is an exact distributed quantile.
    """

    def __init__(self, mean: np.ndarray, inverse: np.ndarray, p95: float) -> None:
        self.mean, self.inverse, self.p95 = mean, inverse, p95

    @classmethod
    def fit(cls, train: DataFrame, vector: str) -> "MahalanobisScorer":
        mean = np.array([r["mean"] for r in vector_mean(train, vector).orderBy("i").collect()])
        entries = covariance(train, vector).collect()
        cov = np.zeros((len(mean), len(mean)))
        for r in entries:
            cov[r["i"], r["j"]] = r["cov"]
        scorer = cls(mean, np.linalg.pinv(cov), 1.0)
        dist = train.select(scorer.distance(vector).alias("d"))
        p95 = exact_quantiles(dist, ["d"], [0.95]).first()["q0"]
        scorer.p95 = p95 if p95 > 0 else 1.0
        return scorer

    def distance(self, vector: str) -> Column:
        mean, inverse = self.mean, self.inverse

        @F.pandas_udf("double")
        def mahalanobis(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            diff = np.stack(v.to_numpy()).astype(np.float64) - mean
            return pd.Series(np.sqrt(np.clip(np.einsum("ij,jk,ik->i", diff, inverse, diff, optimize=True), 0.0, None)))

        return mahalanobis(F.col(vector))

    def score(self, vector: str) -> Column:
        return squash(self.distance(vector), F.lit(float(self.p95)))


def squash(distance: Column, p95: Column) -> Column:
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-1.5) * (distance / p95 - 1.0))), 0.0, 1.0)


def ood_norm(vector) -> Column:
    """Fallback score without a training set: tanh(length / 20), four digits."""
    v = col(vector).cast("array<double>")
    return q6(F.tanh(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) / 20.0), 4)


def unseen_shift(seen: DataFrame, held_out: DataFrame, vector: str) -> DataFrame:
    """Mean divergence over vector positions and mean OOD score of the held-out rows."""
    both = seen.select(vector, F.lit(True).alias("_seen")).unionByName(held_out.select(vector, F.lit(False).alias("_seen")))
    scorer = MahalanobisScorer.fit(seen, vector)
    ood = held_out.agg(F.avg(scorer.score(vector))).scalar()
    return js_divergence(both, vector, F.col("_seen")).agg(
        q6(F.avg("js"), 4).alias("divergence"), q6(F.max(ood), 4).alias("mean_ood_score"))


def unseen(seen: DataFrame, held_out: DataFrame) -> DataFrame:
    """Metrics on seen and held-out rows side by side with the retained share of F1."""
    tagged = seen.withColumn("part", F.lit("seen")).unionByName(held_out.withColumn("part", F.lit("unseen")))
    rows = report(tagged, ["part"])
    cols = ["f1", "precision", "recall", "fpr", "auroc", "brier_score"]
    wide = rows.agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}_{p}") for p in ("seen", "unseen") for c in cols])
    return wide.withColumn("retention_ratio", F.when(F.col("f1_seen") > 0, F.col("f1_unseen") / F.greatest(
        F.col("f1_seen"), F.lit(1e-6))).otherwise(F.lit(0.0)))


# -- decomposition -------------------------------------------------------------------------------


def case_of_row() -> Column:
    return (F.when(F.col("stage_true") > 0, "active").when(F.col("y_true") >= 0.5, "anticipatory").otherwise("benign"))


def wilson(k, n) -> Column:
    """Struct (lo, hi) of the 95 % Wilson interval, (0, 0) for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    z2 = WILSON_Z**2
    p = F.try_divide(k, n)
    denom = 1 + F.try_divide(F.lit(z2), n)
    center = (p + F.try_divide(F.lit(z2), 2 * n)) / denom
    spread = WILSON_Z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / denom
    return F.struct(F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - spread)).alias("lo"),
                    F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), center + spread)).alias("hi"))


def decomposition(scored: DataFrame) -> DataFrame:
    """Active, anticipatory and benign rows: how many were flagged, with a Wilson interval."""
    flagged = F.col("y_prob") >= 0.5
    agg = scored.groupBy(case_of_row().alias("case")).agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))
    ci = wilson("flagged", "n")
    return agg.select("case", "n", "flagged", (F.col("flagged") / F.greatest("n", F.lit(1))).alias("rate"),
                      ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"))


def head_disagreement(scored: DataFrame) -> DataFrame:
    """Rows whose risk and stage predictions contradict each other, and missed attacks."""
    flagged = F.col("y_prob") >= 0.5
    kind = (F.when(flagged & (F.col("stage_pred") == 0), "risk_only")
            .when(~flagged & (F.col("stage_pred") > 0), "stage_only"))
    return scored.withColumn("disagreement", kind).withColumn(
        "missed", (F.col("y_true") >= 0.5) & ~flagged).filter(F.col("disagreement").isNotNull() | F.col("missed"))


def mc_summary(passes: DataFrame, key: str) -> DataFrame:
    """Mean, sample std and clipped 95 % band over repeated predictions of each row."""
    agg = passes.groupBy(key).agg(F.avg("y_prob").alias("mean_probability"),
                                  F.coalesce(F.stddev_samp("y_prob"), F.lit(0.0)).alias("uncertainty_std"))
    half = 1.96 * F.col("uncertainty_std")
    return agg.withColumns({"confidence_lower": F.greatest(F.lit(0.0), F.col("mean_probability") - half),
                            "confidence_upper": F.least(F.lit(1.0), F.col("mean_probability") + half)})
