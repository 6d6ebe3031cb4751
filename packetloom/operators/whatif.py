"""Defensive actions as edits on window graph tables, their scoring and ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.config import WindowSpec
from packetloom.functions.columns import col, q6
from packetloom.operators import graph, windows

# Dampening of window dynamics per action, and default candidates.
ISOLATE_SYN, ISOLATE_BYTES = 0.2, 1.5
BLOCK_ENTROPY, BLOCK_SYN = 0.4, 0.3
RATE_FACTOR, HONEYPOT_FACTOR = 0.15, 0.1
CANDIDATE_PORTS, CANDIDATE_FACTOR = [445, 22, 3389, 80], 0.1
CONTAINED = "Contained / Benign"


# -- single edits -------------------------------------------------------------------------------


def _with_dynamics(hits: DataFrame, dynamics: DataFrame, touched: Column, entropy: Column, syn: Column,
                   log_bytes: Column, keep: list[str]) -> DataFrame:
    """Left-join per-window hit counts to dynamics and rewrite the touched windows."""
    d = dynamics.join(hits, "window_id", "left")
    return d.select("window_id", *keep,
                    F.when(touched, entropy).otherwise(F.col("port_entropy")).alias("port_entropy"),
                    F.when(touched, syn).otherwise(F.col("syn_ratio")).alias("syn_ratio"),
                    F.when(touched, log_bytes).otherwise(F.col("log_bytes")).alias("log_bytes"))


def touches(edges: DataFrame, ip: str) -> Column:
    return (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)


def isolate_host(edges: DataFrame, nodes: DataFrame, dynamics: DataFrame, ip: str) -> dict[str, DataFrame]:
    """Drop the host's edges, zero its features and dampen the windows it is present in."""
    hits = edges.filter(touches(edges, ip)).groupBy("window_id").agg(F.count("*").alias("severed"))
    severed = F.coalesce("severed", F.lit(0)).alias("severed")
    new = _with_dynamics(hits, dynamics, F.col("severed").isNotNull(), F.col("port_entropy"),
                         F.col("syn_ratio") * ISOLATE_SYN, F.greatest(F.lit(0.0), F.col("log_bytes") - ISOLATE_BYTES), [severed])
    feats = [c for c in nodes.columns if c not in ("window_id", "ip")]
    return {"edges": edges.filter(~touches(edges, ip)), "dynamics": new,
            "nodes": nodes.withColumns({f: F.when(F.col("ip") == ip, F.lit(0.0)).otherwise(F.col(f)) for f in feats})}


def block_port(packets: DataFrame, dynamics: DataFrame, port: int, spec: WindowSpec = WindowSpec()) -> dict[str, DataFrame]:
    """Remove the port's traffic before edges form; an edge is severed if nothing else used it."""
    uses = (F.coalesce(F.col("dst_port") == port, F.lit(False)) | F.coalesce(F.col("src_port") == port, F.lit(False)))
    rows = windows.assign(packets.select("ts_us", "src_ip", "dst_ip", uses.alias("_uses")), spec, windows.origin(packets))
    per_edge = rows.groupBy(*graph.EDGE).agg(F.bool_and("_uses").alias("_only"))
    hits = per_edge.groupBy("window_id").agg(F.count_if("_only").alias("severed"), F.count("*").alias("n_edges"))
    new = _with_dynamics(hits, dynamics, F.col("n_edges") > 0, F.greatest(F.lit(0.0), F.col("port_entropy") * BLOCK_ENTROPY),
                         F.greatest(F.lit(0.0), F.col("syn_ratio") * BLOCK_SYN), F.col("log_bytes"),
                         [F.coalesce("severed", F.lit(0)).alias("severed")])
    return {"packets": packets.filter(~uses), "dynamics": new}


def rate_limit(edges: DataFrame, dynamics: DataFrame, factor: float = RATE_FACTOR) -> dict[str, DataFrame]:
    """Scale every edge feature; half of a window's edges (rounded down) count as mitigated."""
    hits = edges.groupBy("window_id").agg(F.floor(F.count("*") / 2).alias("mitigated_edges"))
    new = _with_dynamics(hits, dynamics, F.lit(True), F.col("port_entropy"), F.col("syn_ratio") * factor,
                         F.col("log_bytes") * factor, [F.coalesce("mitigated_edges", F.lit(0)).alias("mitigated_edges")])
    feats = [c for c in edges.columns if c not in graph.EDGE]
    return {"edges": edges.withColumns({f: F.col(f) * factor for f in feats}), "dynamics": new}


def segment_subnet(edges: DataFrame, prefix: str = "10.") -> dict[str, DataFrame]:
    """Drop edges with exactly one end under the prefix."""
    crosses = F.col("src_ip").startswith(prefix) != F.col("dst_ip").startswith(prefix)
    return {"edges": edges.filter(~crosses),
            "severed": edges.groupBy("window_id").agg(F.count_if(crosses).alias("severed"))}


def honeypot(edges: DataFrame, ip: str) -> dict[str, DataFrame]:
    """Weaken every edge into the host as if it were diverted to a decoy."""
    hit = F.col("dst_ip") == ip
    feats = [c for c in edges.columns if c not in graph.EDGE]
    return {"edges": edges.withColumns({f: F.when(hit, F.col(f) * HONEYPOT_FACTOR).otherwise(F.col(f)) for f in feats}),
            "severed": edges.groupBy("window_id").agg(F.count_if(hit).alias("severed"))}


# -- scoring ------------------------------------------------------------------------------------


def closed_form_risk(port_entropy: Column, syn_ratio: Column, log_bytes: Column) -> Column:
    """Default window risk: a logistic of port entropy, SYN ratio and traffic volume."""
    z = 0.6 * port_entropy + 2.0 * syn_ratio + 0.15 * log_bytes - 3.5
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def trajectory(original, recalculated, k: int = 4) -> Column:
    """Array of structs (k, baseline, counterfactual, delta), three digits."""
    r, c = col(original), col(recalculated)

    def step(i: Column) -> Column:
        base = F.least(F.lit(1.0), r * (1.0 + 0.05 * i))
        cf = F.greatest(F.lit(0.02), c * (0.3 + 0.7 * F.exp(-0.8 * (i + 1))))
        return F.struct(i.alias("k"), q6(base, 3).alias("baseline"), q6(cf, 3).alias("counterfactual"),
                        q6(F.greatest(F.lit(0.0), base - cf), 3).alias("delta"))

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), step)


def business_impact(kind, criticality) -> Column:
    c = col(criticality)
    return (F.when(col(kind) == "isolate_host", F.greatest(c, F.lit(0.35)))
            .when(col(kind) == "block_port", F.greatest(F.lit(0.1), c * 0.5))
            .when(col(kind) == "rate_limit", F.lit(0.15)).otherwise(c))


def percent(x, digits: int = 1) -> Column:
    """Percentage as text, rounded half up by integer arithmetic."""
    scale = float(10**digits)
    value = F.floor(col(x) * 100.0 * scale + 0.5) / scale
    return value.cast("bigint").cast("string") if digits == 0 else value.cast("string")


def recommendation() -> Column:
    return F.concat(
        F.col("kind"), F.lit(" "), F.col("target"), F.lit(": risk "), percent("original_risk"), F.lit("% before, "), percent("recalculated_risk"),
        F.lit("% after ("), percent("risk_reduction"), F.lit("% lower); "), F.col("severed").cast("string"),
        F.lit(" malicious edges removed; next stage "), F.col("stage_after"), F.lit("; "), percent("impact", 0), F.lit("% of operations affected"))


def candidates(nodes: DataFrame, n_hosts: int = 4) -> DataFrame:
    """Default actions: isolate the first hosts of the latest window, block four ports, rate-limit."""
    latest = nodes.agg(F.max("window_id")).scalar()
    hosts = (nodes.filter(F.col("window_id") == latest).select("ip").distinct().orderBy("ip").limit(n_hosts))
    pos = Window.partitionBy(F.lit(0)).orderBy("ip")  # n_hosts rows
    isolate = hosts.select(
        (F.row_number().over(pos) - 1).alias("idx"), F.lit("isolate_host").alias("kind"), F.col("ip").alias("target"),
        F.lit(RATE_FACTOR).alias("factor"), F.when(F.col("ip").startswith("10.0."), 0.4).otherwise(0.2).alias("criticality"))
    rest = [(n_hosts + i, "block_port", str(p), RATE_FACTOR, 0.15) for i, p in enumerate(CANDIDATE_PORTS)]
    rest.append((n_hosts + len(rest), "rate_limit", "global_ingress", CANDIDATE_FACTOR, 0.25))
    values = ", ".join(f"({i}, '{k}', '{t}', {f}D, {c}D)" for i, k, t, f, c in rest)
    return isolate.unionByName(nodes.sparkSession.sql(f"SELECT * FROM VALUES {values} AS action_list(idx, kind, target, factor, criticality)"))


def evaluate(packets: DataFrame, actions: DataFrame, stages: DataFrame, spec: WindowSpec = WindowSpec(),
             score: Callable[[Column, Column, Column], Column] = closed_form_risk) -> DataFrame:
    """Score every action on every complete sequence.

    ``actions`` is the short action list; it reaches each window as an array from a scalar
    subquery. What an action severs comes from one equi-join on (window, kind, target) with
    the counts of exactly the hosts and ports that some action names.
    """
    start = windows.origin(packets)
    dyn = windows.window_telemetry(packets, spec, start).filter(F.col("n_rows") >= 2).select(
        "window_id", "port_entropy", F.col("syn_ack_ratio").alias("syn_ratio"), "log_bytes")
    rows = windows.assign(packets.select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port"), spec, start)
    listed = actions.agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "target", "factor", "criticality")))).scalar()
    edge_sizes = rows.groupBy(*graph.EDGE).agg(F.count("*").alias("_n"))
    ports = actions.filter("kind = 'block_port'").select(F.col("target").cast("int").alias("port")).distinct()
    uses = rows.select(*graph.EDGE, F.explode(F.array_distinct(F.array("src_port", "dst_port"))).alias("port")).join(ports, "port")
    edge_ports = uses.groupBy(*graph.EDGE, "port").agg(F.count("*").alias("_u"))
    cut_ports = (edge_ports.join(edge_sizes, graph.EDGE).filter(F.col("_u") == F.col("_n"))
                 .groupBy("window_id", F.lit("block_port").alias("kind"), F.col("port").cast("string").alias("target"))
                 .agg(F.count("*").alias("cut")))
    hosts = actions.filter("kind = 'isolate_host'").select("target").distinct()
    ends = edge_sizes.select("window_id", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("target"))
    cut_hosts = (ends.join(hosts, "target").groupBy("window_id", F.lit("isolate_host").alias("kind"), "target")
                 .agg(F.count("*").alias("cut")))
    halves = (edge_sizes.groupBy("window_id").agg(F.floor(F.count("*") / 2).alias("half")))
    hits = cut_ports.unionByName(cut_hosts)

    plan = (dyn.join(halves, "window_id").withColumn("a", F.explode(listed))
            .select("window_id", "port_entropy", "syn_ratio", "log_bytes", "half", "a.*")
            .join(hits, ["window_id", "kind", "target"], "left"))
    isolate = (F.col("kind") == "isolate_host") & F.col("cut").isNotNull()
    block, limit = F.col("kind") == "block_port", F.col("kind") == "rate_limit"
    new_entropy = F.when(block, F.col("port_entropy") * BLOCK_ENTROPY).otherwise(F.col("port_entropy"))
    new_syn = F.col("syn_ratio") * (F.when(isolate, F.lit(ISOLATE_SYN)).when(block, F.lit(BLOCK_SYN))
                                    .when(limit, F.col("factor")).otherwise(F.lit(1.0)))
    new_bytes = (F.when(isolate, F.greatest(F.lit(0.0), F.col("log_bytes") - ISOLATE_BYTES))
                 .when(limit, F.col("log_bytes") * F.col("factor")).otherwise(F.col("log_bytes")))
    scored = plan.select(
        "window_id", "idx", "kind", "target", "criticality",
        score(F.col("port_entropy"), F.col("syn_ratio"), F.col("log_bytes")).alias("r0"),
        score(new_entropy, new_syn, new_bytes).alias("r1"),
        F.when(limit, F.col("half")).otherwise(F.coalesce("cut", F.lit(0))).alias("cut"))
    first = F.greatest(F.lit(0).cast("bigint"), F.col("window_id") - (spec.seq_len - 1))
    last_seq = windows.grid(packets, spec).agg(F.max("window_id")).scalar() - (spec.seq_len - 1)
    per_seq = (scored.withColumn("seq_id", F.explode(F.sequence(first, F.col("window_id")))).filter(F.col("seq_id") <= last_seq)
               .groupBy("seq_id", "idx", "kind", "target", "criticality")
               .agg(F.count("*").alias("_n"), F.avg("r0").alias("original_risk"), F.avg("r1").alias("_r1"), F.sum("cut").alias("severed"))
               .filter(F.col("_n") == spec.seq_len))
    return finish(per_seq.join(stages.select("seq_id", "stage"), "seq_id")
                  .withColumn("recalculated_risk", F.least("original_risk", "_r1")).drop("_n", "_r1"))


def finish(df: DataFrame) -> DataFrame:
    """Reduction, stage after the action, impact and net score."""
    reduction = F.greatest(F.lit(0.0), F.col("original_risk") - F.col("recalculated_risk"))
    impact = business_impact("kind", "criticality")
    return df.withColumns({
        "risk_reduction": reduction, "impact": impact, "net_score": q6(reduction - 0.25 * impact, 3),
        "stage_after": F.when(F.col("recalculated_risk") < 0.35, F.lit(CONTAINED)).otherwise(
            _stage_text("stage"))})


def _stage_text(stage: str) -> Column:
    out = F.lit("Lateral Movement")
    for sid, name in fv.STAGES.items():
        out = F.when(F.col(stage) == sid, F.lit(name)).otherwise(out)
    return out


def rank(evaluated: DataFrame, top_n: int = 5) -> DataFrame:
    """Best actions of each sequence by net score (listing order breaks ties), with a summary."""
    w = Window.partitionBy("seq_id").orderBy(F.col("net_score").desc(), "idx")  # one row per action
    summary = F.concat(F.lit("first choice: "), F.col("kind"), F.lit(" "), F.col("target"), F.lit(" (risk "), percent("risk_reduction"),
                       F.lit("% lower, net score "), F.col("net_score").cast("string"), F.lit(")"))
    return (evaluated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
            .withColumn("summary", F.when(F.col("rank") == 1, summary)))


def history(records: DataFrame, n: int = 20) -> DataFrame:
    """Latest simulations first."""
    return records.orderBy(F.col("ts_us").desc(), F.col("sim_id").desc()).limit(n)
