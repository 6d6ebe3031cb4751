"""Host-to-host graphs per window, channel graphs and relational graph algebra.

Packets are reduced once to directed edges per pane, the slice of time that tiles stride and
window (`pane_edges`). Sums, port sets and gap summaries of panes merge into windows (`edge_profile`), so no
packet is ever copied into the windows that overlap it. Node features need sums alone (`edge_moments`), without
order; pooling and what-if edits work on these much smaller tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.config import WindowSpec
from packetloom.functions.columns import as_int, clip, finite_or, private_ip, ratio
from packetloom.operators.heavy import heavy_keys, lookup
from packetloom.operators import windows
from packetloom.operators.ordering import positions

EDGE = ["window_id", "src_ip", "dst_ip"]


SUMS = ["n", "bytes", "syn", "ack", "rst", "fin", "retrans", "ttl_n", "ttl_s", "ttl_q", "win_n", "win_s"]
PANE_EDGE = ["pane", "src_ip", "dst_ip"]


def _plain_rows(df: DataFrame) -> DataFrame:
    """Packets or flows with the columns edges need; missing optional ones take their documented defaults."""
    have = df.columns
    defaults = {"payload_size": F.lit(64), "flag_syn": F.lit(0), "flag_ack": F.lit(0), "flag_rst": F.lit(0),
                "flag_fin": F.lit(0), "is_retransmission": F.lit(0), "dst_port": F.lit(1),
                "ttl": F.lit(None).cast("double"), "tcp_window": F.lit(None).cast("double")}
    return df.select("ts_us", "src_ip", "dst_ip", *[F.col(c) if c in have else d.alias(c) for c, d in defaults.items()])


def _sums() -> list[Column]:
    """The columns ``SUMS`` of plain rows."""
    ttl, win = F.col("ttl").cast("double"), F.col("tcp_window").cast("double")
    return [F.count("*").alias("n"), F.sum(finite_or("payload_size")).alias("bytes"), *[F.sum(as_int(f"flag_{f}")).alias(f) for f in ("syn", "ack", "rst", "fin")],
            F.sum(as_int("is_retransmission")).alias("retrans"), F.count(ttl).alias("ttl_n"), F.sum(ttl).alias("ttl_s"), F.sum(ttl * ttl).alias("ttl_q"),
            F.count(win).alias("win_n"), F.sum(win).alias("win_s")]


def pane_edges(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """Mergeable summary per (pane, source, destination), from one scan.

    ``SUMS``; ``ports``, the set of destination ports (65,536 at most); and the gaps between packets in order
    of time: ``first``, ``last``, ``gap_q`` (sum of squares) and ``gap_max``. Packets of one microsecond and port
    are added up before the order is taken, so a busy edge is small when it reaches its task.
    """
    rows = windows.panes(_plain_rows(df), spec, windows.origin(df) if start is None else start)
    marks = rows.groupBy(*PANE_EDGE, "ts_us", "dst_port").agg(*_sums())
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*PANE_EDGE).orderBy("ts_us", "dst_port"))
    return marks.withColumn("gap", gap).groupBy(*PANE_EDGE).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.collect_set("dst_port").alias("ports"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"),
        F.sum(F.col("gap") * F.col("gap")).alias("gap_q"), F.max("gap").alias("gap_max"))


def edge_moments(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """``SUMS`` per (window, source, destination). They need no order, so they are added up before the only shuffle."""
    return windows.assign(_plain_rows(df), spec, windows.origin(df) if start is None else start).groupBy(*EDGE).agg(*_sums())


def edge_profile(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """``edge_moments`` with the number of ``ports`` and the gaps (``first``, ``last``, ``gap_q``, ``gap_max``), from panes.

    Panes merge in order: between two of them lies one more gap, from the last packet of the one to the first of the next.
    """
    placed = windows.over_panes(pane_edges(df, spec, start), spec)
    between = F.col("first") - F.lag("last").over(Window.partitionBy(*EDGE).orderBy("pane"))
    return placed.withColumn("between", between).groupBy(*EDGE).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.size(F.array_distinct(F.flatten(F.collect_list("ports")))).cast("double").alias("ports"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.coalesce("gap_q", F.lit(0)) + F.coalesce(F.col("between") * F.col("between"), F.lit(0))).alias("gap_q"),
        F.max(F.greatest("gap_max", "between")).alias("gap_max"))


def _iat() -> list[Column]:
    """Gap mean, std and max in seconds, clipped to 0..60, from merged moments; zero without a gap."""
    n = F.col("n") - 1
    span = (F.col("last") - F.col("first")).cast("decimal(18,0)")
    spread = (n.cast("decimal(19,0)") * F.col("gap_q").cast("decimal(38,0)") - span * span).cast("double")
    values = {"mean": span.cast("double") / n, "std": F.sqrt(F.greatest(spread, F.lit(0.0))) / n, "max": F.coalesce("gap_max", F.lit(0))}
    return [clip(F.when(n > 0, v / F.lit(1e6)).otherwise(F.lit(0.0)), 0.0, 60.0).alias(f"iat_{s}") for s, v in values.items()]


def _var_samp(n: Column, s: Column, q: Column) -> Column:
    return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).otherwise(F.lit(0.0))


def with_bidi(edges: DataFrame) -> DataFrame:
    """Share of a pair's rows that run in the edge's own direction.

    An unordered pair has at most two directed edges, so the window groups hold one or two rows.
    """
    pair = Window.partitionBy("window_id", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    both = F.when(F.col("src_ip") == F.col("dst_ip"), 2 * F.col("n")).otherwise(F.sum("n").over(pair))
    return edges.withColumn("bidi_ratio", F.col("n") / both)


def edge_iat(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Gap mean, std and max per edge and window, clipped to 0..60 s."""
    return edge_profile(df.select("ts_us", "src_ip", "dst_ip"), spec).select(*EDGE, *_iat())


def edge_features(df: DataFrame, spec: WindowSpec = WindowSpec(), timing: DataFrame | None = None) -> DataFrame:
    """The 16 features of every directed edge per window, from packets or flow rows, in one pass over them.

    Rows without a source or destination have no edge. ``timing`` may name a plainer table with the same packets
    when ``df`` is the result of joins, so that the time origin does not repeat them.
    """
    ends = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    e = with_bidi(edge_profile(df, spec, windows.origin(df if timing is None else timing)).filter(ends)).select("*", *_iat())
    return e.select(
        *EDGE, F.log1p("n").alias("log_packet_count"), F.log1p("bytes").alias("log_byte_volume"),
        *[ratio(f, "n").alias(f"{f}_ratio") for f in ("syn", "ack", "rst", "fin")],
        ratio("retrans", "n").alias("retransmission_rate"), F.col("ports").alias("unique_dst_ports"),
        finite_or(F.try_divide("ttl_s", "ttl_n"), 64.0).alias("mean_ttl"),
        F.sqrt(_var_samp(F.col("ttl_n"), F.col("ttl_s"), F.col("ttl_q"))).alias("ttl_std"),
        finite_or(F.try_divide("win_s", "win_n"), 1024.0).alias("mean_tcp_window"),
        private_ip("src_ip").cast("double").alias("is_internal"), "iat_mean", "iat_std", "iat_max", "bidi_ratio")


def edge_features_from_flows(flows: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Edge gaps of timeless flow tables: the mean of the flows' own gap statistics."""
    rows = windows.assign(flows.select(
        "ts_us", "src_ip", "dst_ip", "flow_iat_mean", "flow_iat_std", "flow_iat_max"), spec, windows.origin(flows))
    return rows.groupBy(*EDGE).agg(*[
        clip(finite_or(F.avg(f"flow_iat_{s}")), 0.0, 60.0).alias(f"iat_{s}") for s in ("mean", "std", "max")])


def node_features(df: DataFrame, spec: WindowSpec = WindowSpec(), timing: DataFrame | None = None) -> DataFrame:
    """The 16 features of every host per window.

    Each edge row is read from both ends, so one aggregate yields out- and in-side values
    and the peer counts are plain row counts; only the port entropy reads packets again
    (from ``timing`` when given, see ``edge_features``).
    """
    plain = df if timing is None else timing
    edges = edge_moments(df, spec, windows.origin(plain))
    ends = edges.select("window_id", "n", "bytes", "syn", "ack", "rst", "retrans", "ttl_n", "ttl_s", "ttl_q",
                        "win_n", "win_s", F.explode(F.array(
                            F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("out")),
                            F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("out")))).alias("end"))
    out, inn = F.col("end.out"), ~F.col("end.out")

    def total(name: str, side: Column) -> Column:
        return F.sum(F.when(side, F.col(name)))

    agg = ends.groupBy("window_id", F.col("end.ip").alias("ip")).agg(
        total("n", out).alias("n_out"), total("n", inn).alias("n_in"),
        total("bytes", out).alias("b_out"), total("bytes", inn).alias("b_in"),
        *[total(c, out).alias(c) for c in ("syn", "ack", "rst", "retrans", "win_n", "win_s")],
        F.count_if(out).alias("peers_out"), F.count_if(inn).alias("peers_in"),
        *[total(f"ttl_{m}", out).alias(f"o_{m}") for m in "nsq"],
        *[total(f"ttl_{m}", inn).alias(f"i_{m}") for m in "nsq"])
    sent = windows.assign(_plain_rows(plain).select("ts_us", "src_ip", "dst_port"), spec, windows.origin(plain))
    ent = windows.port_entropy(sent, ["window_id", "src_ip"])
    joined = agg.join(ent.withColumnRenamed("src_ip", "ip"), ["window_id", "ip"], "left")
    sends = F.col("n_out").isNotNull()
    zero = F.lit(0)

    def own(out_side: str, in_side: str) -> Column:
        return F.when(sends, F.col(out_side)).otherwise(F.col(in_side))

    ttl_n, ttl_s, ttl_q = own("o_n", "i_n"), own("o_s", "i_s"), own("o_q", "i_q")
    n_out = F.coalesce("n_out", zero)
    b_out, b_in = F.coalesce("b_out", F.lit(0.0)), F.coalesce("b_in", F.lit(0.0))

    def per_out(c: str) -> Column:
        return ratio(F.coalesce(c, zero), n_out)

    return joined.select(
        "window_id", "ip",
        F.log1p(n_out).alias("log_out"), F.log1p(F.coalesce("n_in", zero)).alias("log_in"),
        finite_or("port_entropy").alias("port_entropy"),
        (finite_or(F.try_divide(ttl_s, ttl_n), 64.0) / 255.0).alias("ttl_norm"),
        F.log1p(_var_samp(ttl_n, ttl_s, ttl_q)).alias("log_ttl_var"),
        private_ip("ip").cast("double").alias("is_private"),
        F.log1p(b_out).alias("log_bytes_out"), F.log1p(b_in).alias("log_bytes_in"),
        per_out("syn").alias("syn_ratio"), per_out("ack").alias("ack_ratio"), per_out("rst").alias("rst_ratio"),
        F.col("peers_out").cast("double").alias("peers_out"), F.col("peers_in").cast("double").alias("peers_in"),
        (ratio(b_out, n_out) / 1500.0).alias("avg_size"), per_out("retrans").alias("retrans_rate"),
        (F.when(sends, finite_or(F.try_divide("win_s", "win_n"))).otherwise(F.lit(1024.0)) / 65535.0)
        .alias("tcp_window_norm"))


# -- identifiers ---------------------------------------------------------------------------

def first_seen(df: DataFrame, by: list[str]) -> DataFrame:
    """Hosts and the time of their first packet, per ``by`` columns."""
    ends = df.select(*by, "ts_us", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return ends.groupBy(*by, "ip").agg(F.min("ts_us").alias("first_us"))


def window_registry(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Host ids 0.. inside each window, by first appearance then address."""
    seen = first_seen(windows.assign(df.select("ts_us", "src_ip", "dst_ip"), spec, windows.origin(df)), ["window_id"])
    return positions(seen, ["first_us", "ip"], within=["window_id"], name="node_id").select("window_id", "ip", "node_id")


def capture_registry(df: DataFrame) -> DataFrame:
    """Host ids 0.. over the whole capture, by first appearance then address."""
    return positions(first_seen(df, []), ["first_us", "ip"], name="node_id").select("ip", "node_id")


def sorted_registry(edges: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """Host ids by sorted address."""
    hosts = edges.select(F.explode(F.array(src, dst)).alias("ip")).distinct()
    return positions(hosts, ["ip"], name="node_id")


# -- channel graph ---------------------------------------------------------------------------

# Flow metrics averaged per channel.
CHANNEL_METRICS = [
    "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "sload", "dload", "spkts", "dpkts",
    "swin", "dwin", "smeansz", "dmeansz", "sjit", "djit", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
]


def attack_category(label) -> Column:
    out = F.lit(0)
    text = F.lower(F.trim(F.col(label)))
    for name, code in fv.ATTACK_CATEGORIES.items():
        out = F.when(text == name, F.lit(code)).otherwise(out)
    return out


def channel_graph(records: DataFrame) -> DataFrame:
    """Whole-dataset (source, destination) channels with label maxima and metric means."""
    bad = F.coalesce(F.col("binary_label").cast("int"), F.lit(0))
    return records.groupBy(F.col("source_ip").alias("src_ip"), F.col("destination_ip").alias("dst_ip")).agg(
        F.count("*").alias("flows"), F.sum(bad).alias("malicious_flows"), F.max(bad).alias("label"),
        F.max(attack_category("attack_label")).alias("attack_class"),
        *[F.avg(F.coalesce(F.col(m).try_cast("double"), F.lit(0.0))).alias(m) for m in CHANNEL_METRICS])


def log_standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p of the non-negative part, then zero mean and unit population std; constants become 0."""
    logs = df.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns})
    stats = logs.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                for c in columns])).scalar()
    # below 1e-12 a spread is rounding noise of a constant column
    return logs.withColumn("_stats", stats).withColumns({
        c: F.when(F.col(f"_stats.{c}.s") > 1e-12, (F.col(c) - F.col(f"_stats.{c}.m")) / F.col(f"_stats.{c}.s"))
        .otherwise(F.lit(0.0)) for c in columns}).drop("_stats")


def incident_mean(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per host the mean of its incoming and of its outgoing edge features (0 where none)."""
    ends = edges.select(*columns, F.explode(F.array(
        F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("out")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("out")))).alias("end"))
    aggs = []
    for side, cond in (("in", ~F.col("end.out")), ("out", F.col("end.out"))):
        aggs += [F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0)).alias(f"{side}_{c}") for c in columns]
    return ends.groupBy(F.col("end.ip").alias("ip")).agg(*aggs)


# -- relational message passing ----------------------------------------------------------------

def edge_softmax(edges: DataFrame, score: str, by: str = "window_id") -> DataFrame:
    """Normalise scores over each destination's incoming edges, shifted by their own maximum, so they sum to one.

    The edges of a heavy destination stay where they are in both lookups.
    """
    keys = [by, "dst_ip"]
    heavy = heavy_keys(edges, keys)
    top = edges.groupBy(*keys).agg(F.max(score).alias("_top"))
    shifted = lookup(edges, top, keys, heavy=heavy).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    denom = shifted.groupBy(*keys).agg(F.sum("_e").alias("_d"))
    return (lookup(shifted, denom, keys, heavy=heavy)
            .withColumn("attention", F.col("_e") / (F.col("_d") + F.lit(1e-16)))
            .drop("_e", "_d", "_top"))


def neighbour_message(edges: DataFrame, nodes: DataFrame, features: Sequence[str], weight: str = "attention") -> DataFrame:
    """Weighted sum of source vectors arriving at each destination, one column per feature."""
    src = nodes.select("window_id", F.col("ip").alias("src_ip"), *features)
    return edges.join(src, ["window_id", "src_ip"]).groupBy("window_id", F.col("dst_ip").alias("ip")).agg(
        *[F.sum(F.col(weight) * F.col(f)).alias(f"msg_{f}") for f in features])


def graph_pool(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and maximum of every node feature per window."""
    return nodes.groupBy("window_id").agg(
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features])


