"""Per-flow logistic baseline without time or graph context."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import ratio, seeded_hash
from packetloom.operators import evaluation, windows

# Feature names and training limits.
FEATURES = ["bytes_fwd", "bytes_bwd", "pkt_size_mean", "pkt_size_std", "iat_mean_ms", "iat_std_ms", "syn_ratio",
            "fin_ratio", "port_entropy", "log_bytes_total"]
MAX_ROWS, MAX_ITER, SEED = 200_000, 500, 42


def flow_matrix(flows: DataFrame) -> DataFrame:
    """The ten features and the binary label of each flow."""
    ent = windows.port_entropy(flows, ["src_ip"])
    return flows.join(ent, "src_ip", "left").select(
        "flow_key", F.col("tot_fwd_bytes").cast("double").alias("bytes_fwd"), F.col("tot_bwd_bytes").cast("double").alias("bytes_bwd"),
        F.col("pkt_len_mean").alias("pkt_size_mean"), F.col("pkt_len_std").alias("pkt_size_std"),
        (F.col("flow_iat_mean") * 1000).alias("iat_mean_ms"), (F.col("flow_iat_std") * 1000).alias("iat_std_ms"),
        ratio("flag_syn", "tot_pkts").alias("syn_ratio"), ratio("flag_fin", "tot_pkts").alias("fin_ratio"),
        F.coalesce("port_entropy", F.lit(0.0)).alias("port_entropy"), F.log1p(F.col("tot_bytes").cast("double")).alias("log_bytes_total"),
        (F.col("mitre_stage_id") > 0).cast("double").alias("y_true"))


def training_sample(matrix: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` rows in seeded-hash order: the sample size is the model's own limit.

    On larger tables a hash threshold that keeps half as many rows again runs first, so the
    final ordering only sees a bounded number of rows.
    """
    n = matrix.count()
    if n <= max_rows:
        return matrix
    hashed = matrix.withColumn("_h", seeded_hash(SEED, "flow_key"))
    near = hashed.filter(F.col("_h") < int(2**60 * min(1.0, 1.5 * max_rows / n)))
    return near.orderBy("_h", "flow_key").limit(max_rows).drop("_h")


def fit(matrix: DataFrame, max_rows: int = MAX_ROWS) -> PipelineModel:
    """Standard scaling and class-balanced logistic regression with unit L2 penalty."""
    cached = matrix.persist()  # counted and sampled; the iterations only touch the sample
    sample = training_sample(cached, max_rows).persist()
    row = sample.agg(F.count("*").alias("n"), F.sum("y_true").alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0.0
    own = F.when(F.col("y_true") > 0.5, F.lit(max(pos, 1.0))).otherwise(F.lit(max(n - pos, 1.0)))
    weighted = sample.withColumn("weight", F.lit(n / 2.0) / own)
    model = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        # balanced weights add up to n, so a unit penalty on the summed loss is 1/n on the mean loss
        LogisticRegression(featuresCol="scaled", labelCol="y_true", weightCol="weight", maxIter=MAX_ITER,
                           regParam=1.0 / max(n, 1), standardization=False),
    ]).fit(weighted)
    sample.unpersist()
    cached.unpersist()
    return model


def score(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    return model.transform(matrix).select("flow_key", "y_true", vector_to_array("probability")[1].alias("y_prob"))


def evaluate(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    """Quality report over every row of the matrix; only fitting is bounded."""
    scored = score(model, matrix).withColumn("model", F.lit("logistic"))
    return evaluation.report(scored)
