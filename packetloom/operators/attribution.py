"""Why an alert was raised: heavy edges, features, windows and perturbations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import q6
from packetloom.operators.ordering import first_n

NAMED = fv.EDGE_FEATURES[:12]


def top_features(features: Sequence[str] = tuple(NAMED), k: int = 3) -> Column:
    """The k features of largest absolute value as structs (name, value), earlier names first on ties."""
    items = F.array(*[F.struct((-F.abs(f)).alias("key"), F.lit(i).alias("pos"), F.lit(f).alias("name"),
                               F.col(f).alias("value")) for i, f in enumerate(features)])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def top_edges(edges: DataFrame, weight: str = "attention", k: int = 5) -> DataFrame:
    """The k heaviest edges of every window with their leading features."""
    ranked = edges.select("window_id", "src_ip", "dst_ip", weight, top_features().alias("top_features"),
                          (-F.col(weight)).alias("_w"))
    return first_n(ranked, ["window_id"], ["_w", "src_ip", "dst_ip"], k, salt=F.hash("src_ip", "dst_ip")).drop("_w")


def global_features(flagged: DataFrame, k: int = 5) -> DataFrame:
    """Per window the features with the largest mean absolute value over its flagged edges."""
    parts = flagged.select("window_id", F.explode("top_features").alias("f"))
    means = parts.groupBy("window_id", F.col("f.name").alias("feature")).agg(F.avg(F.abs("f.value")).alias("contribution"))
    ranked = means.withColumn("_k", -F.col("contribution"))
    return first_n(ranked, ["window_id"], ["_k", "feature"], k, salt=F.lit(0), salts=1).drop("_k")


def explain_windows(top: DataFrame, k: int = 5) -> DataFrame:
    """One row per window with its flagged edges and leading features as arrays.

    A window holds a handful of flagged edges, so features are averaged inside the row.
    """
    edges = top.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("attention")).alias("key"), "src_ip", "dst_ip", "attention", "top_features"))).alias("edges"))
    flat = F.flatten(F.transform("edges", lambda e: e["top_features"]))
    named = edges.withColumn("_flat", flat).withColumn("_names", F.array_distinct(F.transform("_flat", lambda f: f["name"])))

    def mean(name: Column) -> Column:
        mine = F.filter("_flat", lambda f: f["name"] == name)
        return F.aggregate(mine, F.lit(0.0), lambda a, f: a + F.abs(f["value"])) / F.size(mine)

    means = F.transform("_names", lambda n: F.struct((-mean(n)).alias("key"), n.alias("feature"), mean(n).alias("contribution")))
    return named.select("window_id", "edges", F.slice(F.array_sort(means), 1, k).alias("features"))


def window_share(importance: DataFrame) -> DataFrame:
    """Share of each window in its sequence's importance and the most critical one.

    Input ``seq_id, pos, importance``: a handful of rows per sequence.
    """
    total = importance.groupBy("seq_id").agg(
        F.sum("importance").alias("_t"), F.max_by("pos", F.struct(F.col("importance"), -F.col("pos"))).alias("critical_pos"))
    return importance.join(total, "seq_id").select(
        "seq_id", "pos", (F.col("importance") / (F.col("_t") + F.lit(1e-12))).alias("share"),
        (F.col("pos") == F.col("critical_pos")).alias("is_critical"))


def perturbation(df: DataFrame, key: str, vector: str, score: Callable[[Column], Column],
                 background: DataFrame | None = None) -> DataFrame:
    """Drop in score when one vector position is replaced by the background mean (or zero).

    ``key, dim, attribution, rank``; the fan-out is the vector length, and ranks are taken
    inside one row's array.
    """
    x = F.col(vector).cast("array<double>")
    if background is None:
        base = F.transform(F.col("_x"), lambda v: F.lit(0.0))
    else:
        means = (background.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v"))
                 .groupBy("i").agg(F.avg("v").alias("m")))
        ordered = means.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
        base = ordered.select(F.col("l")["m"]).scalar()
    rows = df.select(key, x.alias("_x")).withColumn("_base", base).withColumn("_score", score(F.col("_x")))
    each = rows.select(key, "_score", "_x", "_base", F.posexplode("_x").alias("dim", "_v"))
    swapped = F.zip_with(F.col("_x"), F.sequence(F.lit(0), F.size("_x") - 1), lambda v, i: F.when(
        i == F.col("dim"), F.element_at("_base", F.col("dim") + 1)).otherwise(v))
    return each.select(key, "dim", (F.col("_score") - score(swapped)).alias("attribution"))


def report_json(explained: DataFrame) -> Column:
    """Nested JSON of one prediction: scores, leading features, flagged edges and window shares."""
    return F.to_json(F.struct(
        q6("infiltration_prob", 4).alias("infiltration_prob"), q6("uncertainty_std", 4).alias("uncertainty_std"),
        F.col("stage").alias("predicted_stage_id"), F.col("stage_name").alias("predicted_stage_name"),
        F.col("technique").alias("mitre_technique"),
        F.transform("features", lambda f: F.struct(f["feature"].alias("feature"), q6(f["contribution"], 4).alias("contribution"))).alias("top_global_features"),
        F.transform("edges", lambda e: F.struct(
            e["src_ip"].alias("src"), e["dst_ip"].alias("dst"), q6(e["attention"], 4).alias("attn"),
            F.transform(e["top_features"], lambda f: F.struct(f["name"].alias("name"), q6(f["value"], 4).alias("value"))).alias("top_features"))
        ).alias("flagged_edges")))


def edge_card(edge: DataFrame) -> DataFrame:
    """Four weighted factors of one topology edge, one row each."""
    att, port = F.col("attention"), F.col("port")

    def factor(code: str, label: Column, pct: Column, severity: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), label.alias("label"), pct.cast("int").alias("percentage"), severity.alias("severity"))

    two = F.format_string("%.2f", q6(att, 2))
    cards = F.array(
        factor("GNN_ATTN_WEIGHT", F.concat(F.lit("attention of this edge: "), two), F.floor(att * 38 + 0.5),
               F.when(att > 0.8, "high").otherwise("medium")),
        factor("PORT_VULNERABILITY", F.concat(F.lit("service reached: port "), port.cast("string"), F.lit(", "), F.col("protocol_name")),
               F.when(port.isin(445, 502, 443), 28).otherwise(16), F.when(port.isin(445, 502), "high").otherwise("medium")),
        factor("SESSION_BURST", F.lit("many connection attempts, few answers"), F.lit(20), F.lit("medium")),
        factor("SUB_TOPOLOGY_PATH", F.concat(F.lit("from segment "), F.col("src_segment"), F.lit(" to segment "), F.col("dst_segment")),
               F.lit(14), F.lit("low")))
    return edge.select("src_ip", "dst_ip", F.explode(cards).alias("c")).select("src_ip", "dst_ip", "c.*")
