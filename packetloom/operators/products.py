"""Dashboard data products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import col, q6
from packetloom.operators.topology import port_name

# Forecast points as (offset s, (floor, factor) of actual, baseline and counterfactual,
# (factor, shift) of the upper and the lower band); None = not shown.
FORECAST = [
    (-15, (5, 0.45), (5, 0.40), None, (0.50, 0), (0.35, 0)),
    (-10, (8, 0.60), (8, 0.55), None, (0.65, 0), (0.50, 0)),
    (-5, (12, 0.82), (12, 0.80), None, (0.88, 0), (0.74, 0)),
    (0, (0, 1.0), (0, 1.0), (0, 1.0), (1.0, 4), (1.0, -4)),
    (5, None, (0, 1.04), (10, 0.22), (1.0, 8), (1.0, -6)),
    (10, None, (0, 1.08), (8, 0.16), (1.0, 10), (1.0, -8)),
    (15, None, (0, 1.12), (8, 0.12), (1.0, 12), (1.0, -10)),
]
# Kill-chain steps and their tactic ids.
KILL_CHAIN = [(1, "Reconnaissance", "TA0043"), (2, "Resource Development", "TA0042"), (3, "Initial Access", "TA0001"),
              (4, "Execution & C2", "TA0002 / TA0011"), (5, "Lateral Movement", "TA0008")]


def capture_summary(packets: DataFrame, flows: DataFrame, hosts_at_risk: DataFrame, capture: str = "capture") -> DataFrame:
    """Packets, flows, duration, protocols and threat hosts per capture."""
    # "HTTPS-Alt" and "TCP/4444" show as their family
    family = F.substring_index(F.substring_index(port_name("dst_port", "protocol"), "/", 1), "-", 1)
    base = packets.groupBy(capture).agg(
        F.count("*").alias("packet_count"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("duration_seconds"),
        F.array_join(F.array_sort(F.collect_set(family)), ",").alias("protocols"))
    f = flows.groupBy(capture).agg(F.count("*").alias("flow_count"))
    h = hosts_at_risk.groupBy(capture).agg(F.count("*").alias("threat_hosts"))
    return (base.join(f, capture, "left").join(h, capture, "left")
            .withColumn("threat_hosts", F.coalesce("threat_hosts", F.lit(0)))
            .withColumn("flow_count", F.coalesce("flow_count", F.lit(0))))


def kpis(df: DataFrame) -> DataFrame:
    """Risk, lead time, trend and telemetry of each scored window."""
    p = F.col("risk")
    return df.select(
        "window_id", F.floor(p * 100 + 0.5).cast("int").alias("infiltration_risk"), F.when(p > 0.6, "+14").otherwise("+0").alias("risk_trend"),
        q6(F.greatest(F.lit(10.0), (1.0 - p) * 45.0), 1).alias("lead_seconds"), F.col("stage").alias("predicted_stage"),
        q6("port_entropy", 2).alias("port_entropy"), q6("syn_ratio", 2).alias("syn_ratio"), q6("log_bytes", 2).alias("log_bytes"))


def _whole(x: Column) -> Column:
    return F.bround(x).cast("int")


def forecast_points(df: DataFrame, key: str, risk) -> DataFrame:
    """Seven points around now per row: actual, baseline, counterfactual and band, in percent."""
    base = col(risk) * 100.0

    def at_least(rule: tuple[int, float] | None) -> Column:
        if rule is None:
            return F.lit(None).cast("int")
        return F.greatest(F.lit(rule[0]), _whole(base * rule[1]))

    points = [F.struct(
        F.lit(off).alias("seconds"), at_least(actual).alias("actual"),
        F.least(F.lit(99 if off > 0 else 100), at_least(baseline)).alias("baseline"),
        at_least(counter).alias("counterfactual"),
        F.least(F.lit(100), _whole(base * up[0] + up[1])).alias("ci_upper"),
        F.greatest(F.lit(0), _whole(base * low[0] + low[1])).alias("ci_lower"),
    ) for off, actual, baseline, counter, up, low in FORECAST]
    return df.select(key, F.explode(F.array(*points)).alias("p")).select(key, "p.*")


def kill_chain(df: DataFrame, key: str, risk, mitigated: Column) -> DataFrame:
    """Status of the five steps per row; ``risk`` is in percent."""
    r = col(risk)
    status = {
        4: F.when(mitigated, "completed").when(r > 50, "active").otherwise("upcoming"),
        5: F.when(mitigated, "upcoming").when(r > 80, "active").otherwise("upcoming"),
    }
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.lit(t).alias("tactic_id"),
                               status.get(i, F.lit("completed")).alias("status")) for i, n, t in KILL_CHAIN])
    return df.select(key, F.explode(steps).alias("s")).select(key, "s.*")


def alerts(target: DataFrame, hosts: DataFrame, isolated: DataFrame) -> DataFrame:
    """One feed of target, compromised-host and isolation alerts.

    ``target`` has one row (ip, name, source_name, probability, vector, port); the host
    tables are the short top-host list.
    """
    first = F.concat(F.col("name"), F.lit(" ("), F.col("ip"), F.lit(")"))
    a = target.filter(F.col("probability") > 20).select(
        F.lit("alt-target").alias("id"), F.when(F.col("probability") > 75, "critical").otherwise("high").alias("severity"),
        F.col("source_name").alias("source"), first.alias("target"), F.col("vector").alias("message"), F.col("port").cast("int").alias("port"))
    top = hosts.filter("status = 'compromised'").agg(F.min("rank")).scalar()
    b = hosts.filter("status = 'compromised'").select(
        F.concat(F.lit("alt-comp-"), "ip").alias("id"), F.when(F.col("rank") == top, "critical").otherwise("high").alias("severity"),
        first.alias("source"), F.col("role").alias("target"),
        F.concat(F.lit("host marked compromised; open ports: "), F.array_join("open_ports", ", ")).alias("message"),
        F.get("open_ports", F.lit(0)).alias("port"))
    c = hosts.join(isolated.select("ip"), "ip", "left_semi").select(
        F.concat(F.lit("alt-iso-"), "ip").alias("id"), F.lit("info").alias("severity"), first.alias("source"), F.lit("Security Policy").alias("target"),
        F.lit("isolation is in force for this host").alias("message"), F.lit(None).cast("int").alias("port"))
    return a.unionByName(b).unionByName(c)
