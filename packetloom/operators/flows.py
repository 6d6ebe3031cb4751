"""Packets to bidirectional flows and packet-level flow context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.columns import as_int, ratio
from packetloom.operators.heavy import lookup
from packetloom.operators.ordering import gap_stats

FLAGS = ["syn", "ack", "rst", "fin"]


def with_canonical_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free ``flow_key`` and ``is_fwd`` (source is the smaller endpoint)."""
    sp = F.coalesce(F.col("src_port").cast("int"), F.lit(0))
    dp = F.coalesce(F.col("dst_port").cast("int"), F.lit(0))
    proto = F.coalesce(F.col("protocol").cast("int"), F.lit(6)).cast("string")
    fwd = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (sp <= dp))
    src, dst = F.concat_ws(":", "src_ip", sp.cast("string")), F.concat_ws(":", "dst_ip", dp.cast("string"))
    return packets.withColumns({
        "is_fwd": fwd,
        "flow_key": F.concat(F.when(fwd, src).otherwise(dst), F.lit("<->"),
                             F.when(fwd, dst).otherwise(src), F.lit(":"), proto),
    })


def with_directional_key(packets: DataFrame) -> DataFrame:
    """Add ``flow_key`` as ``src:port->dst:port/protocol`` unless the table already has one."""
    if "flow_key" in packets.columns:
        return packets

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    return packets.withColumn("flow_key", F.concat(
        text("src_ip"), F.lit(":"), text("src_port"), F.lit("->"),
        text("dst_ip"), F.lit(":"), text("dst_port"), F.lit("/"), text("protocol")))


def flow_volume(packets: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Counts, bytes, start, end, duration and rates per canonical flow, kept apart by the ``scope`` columns."""
    size = F.coalesce(F.col("payload_size"), F.lit(0))
    fwd = F.col("is_fwd")
    agg = with_canonical_key(packets).groupBy(*scope, "flow_key").agg(
        F.count("*").alias("tot_pkts"), F.count_if(fwd).alias("tot_fwd_pkts"),
        F.sum(size).alias("tot_bytes"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("tot_fwd_bytes"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return _with_rates(agg)


def _with_rates(agg: DataFrame) -> DataFrame:
    duration = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    floor = F.greatest(duration, F.lit(1e-3))
    return agg.withColumns({
        "tot_bwd_pkts": F.col("tot_pkts") - F.col("tot_fwd_pkts"),
        "tot_bwd_bytes": F.col("tot_bytes") - F.col("tot_fwd_bytes"),
        "flow_duration": duration,
        "flow_byts_s": F.col("tot_bytes") / floor,
        "flow_pkts_s": F.col("tot_pkts") / floor,
    })


def flow_iat(packets: DataFrame) -> DataFrame:
    """Inter-arrival statistics per flow over all packets and for each direction."""
    fwd = F.col("is_fwd")
    return gap_stats(with_canonical_key(packets), ["flow_key"], tracks={
        "flow_iat": F.lit(True), "fwd_iat": fwd, "bwd_iat": ~fwd})


def flow_shape(packets: DataFrame) -> DataFrame:
    """Packet-length statistics, flag counts, direction ratios and retransmissions per flow."""
    size = F.coalesce(F.col("payload_size"), F.lit(0)).cast("double")
    keyed = with_canonical_key(packets)
    retrans = as_int("is_retransmission") if "is_retransmission" in packets.columns else F.lit(0)
    agg = keyed.groupBy("flow_key").agg(
        F.count("*").alias("_n"), F.count_if("is_fwd").alias("_fwd"),
        F.sum(size).alias("_bytes"),
        F.sum(F.when(F.col("is_fwd"), size).otherwise(0.0)).alias("_fwd_bytes"),
        F.avg(size).alias("pkt_len_mean"), F.stddev_pop(size).alias("pkt_len_std"),
        F.max(size).alias("pkt_len_max"), F.min(size).alias("pkt_len_min"),
        *[F.sum(as_int(f"flag_{f}")).alias(f"flag_{f}") for f in FLAGS],
        F.sum(retrans).alias("is_retransmission"))
    return agg.withColumns({
        "bidi_ratio": ratio("_fwd", "_n"), "bidi_byte_ratio": ratio("_fwd_bytes", "_bytes"),
        "retransmission_rate": ratio("is_retransmission", "_n"),
    }).drop("_n", "_fwd", "_bytes", "_fwd_bytes")


def flow_first_packet(packets: DataFrame, extra: tuple[str, ...] = ("label",)) -> DataFrame:
    """Endpoints (and label columns) of each flow's earliest packet."""
    cols = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol",
            *[c for c in extra if c in packets.columns]]
    first = F.min_by(F.struct(*cols), F.struct("ts_us", "pkt_id"))
    return (with_canonical_key(packets).groupBy("flow_key").agg(first.alias("_f"))
            .select("flow_key", *[F.col(f"_f.{c}").alias(c) for c in cols]))


def flow_table(packets: DataFrame, extra: tuple[str, ...] = (
        "label", "mitre_stage_id", "mitre_stage_name", "mitre_confidence")) -> DataFrame:
    """Full flow record: one aggregate for everything mergeable, joined to the gap statistics.

    Both sides end hash-partitioned by ``flow_key``, so the join adds no exchange.
    """
    keyed = with_canonical_key(packets)
    size = F.coalesce(F.col("payload_size"), F.lit(0))
    fwd = F.col("is_fwd")
    carried = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol",
               *[c for c in extra if c in packets.columns]]
    retrans = as_int("is_retransmission") if "is_retransmission" in packets.columns else F.lit(0)
    agg = keyed.groupBy("flow_key").agg(
        F.min_by(F.struct(*carried), F.struct("ts_us", "pkt_id")).alias("_f"),
        F.count("*").alias("tot_pkts"), F.count_if(fwd).alias("tot_fwd_pkts"),
        F.sum(size).alias("tot_bytes"), F.sum(F.when(fwd, size).otherwise(0)).alias("tot_fwd_bytes"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.avg(size).alias("pkt_len_mean"), F.stddev_pop(size).alias("pkt_len_std"),
        F.max(size).alias("pkt_len_max"), F.min(size).alias("pkt_len_min"),
        *[F.sum(as_int(f"flag_{f}")).alias(f"flag_{f}") for f in FLAGS],
        F.sum(retrans).alias("is_retransmission"))
    rated = _with_rates(agg).withColumns({
        "bidi_ratio": ratio("tot_fwd_pkts", "tot_pkts"),
        "bidi_byte_ratio": ratio("tot_fwd_bytes", "tot_bytes"),
        "retransmission_rate": ratio("is_retransmission", "tot_pkts"),
        "payload_size": F.col("tot_bytes"),
    })
    gaps = flow_iat(packets).drop("flow_iat_n", "fwd_iat_n", "bwd_iat_n")
    return (rated.join(gaps, "flow_key")
            .select("flow_key", *[F.col(f"_f.{c}").alias(c) for c in carried],
                    *[c for c in rated.columns if c not in ("flow_key", "_f")],
                    *[c for c in gaps.columns if c != "flow_key"]))


def flow_idle_segments(packets: DataFrame, idle_us: int = 120_000_000) -> DataFrame:
    """Split flows wherever they stay silent for longer than ``idle_us``.

    Two packets inside one idle-wide time bucket are never further apart than the timeout,
    so packets collapse to (flow, bucket) rows and only those are ordered.
    """
    bucket = F.floor(F.col("ts_us") / F.lit(idle_us))
    slices = with_canonical_key(packets).groupBy("flow_key", bucket.alias("_b")).agg(
        F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"),
        F.count("*").alias("_n"), F.sum("payload_size").alias("_bytes"))
    w = Window.partitionBy("flow_key").orderBy("_b")
    breaks = slices.withColumn(
        "_new", F.coalesce((F.col("_first") - F.lag("_last").over(w) > idle_us).cast("int"), F.lit(0)))
    return (breaks.withColumn("segment", F.sum("_new").over(w))
            .groupBy("flow_key", "segment")
            .agg(F.min("_first").alias("start_us"), F.max("_last").alias("end_us"),
                 F.sum("_n").alias("tot_pkts"), F.sum("_bytes").alias("tot_bytes")))


def with_ttl_variance(packets: DataFrame) -> DataFrame:
    """Attach the population TTL variance of each directional flow to its rows.

    Aggregate and lookup rather than a window: the aggregate combines map-side, and the rows of
    a heavy flow stay spread over the tasks that read them.
    """
    keyed = with_directional_key(packets)
    stats = keyed.groupBy("flow_key").agg(
        F.coalesce(F.var_pop("ttl"), F.lit(0.0)).alias("flow_ttl_variance"))
    return lookup(keyed, stats, ["flow_key"])


SALTS = 4096


def with_retransmissions(packets: DataFrame, require_data: bool = True) -> DataFrame:
    """Flag TCP segments whose (directional flow, sequence number) repeats.

    With ``require_data`` only segments with bytes beyond the header count and are flagged. Other rows
    (all of a UDP flow have no number) look nothing up and carry a salt, so that they spread over all tasks.
    """
    keyed = with_directional_key(packets)
    header = F.coalesce(F.col("tcp_header_len"), F.lit(20))
    counted = F.col("tcp_seq").isNotNull()
    if require_data:
        counted = counted & (F.coalesce(F.col("payload_size"), F.lit(0)) - header > 0)
    repeated = (keyed.filter(counted).groupBy("flow_key", "tcp_seq")
                .agg(F.count("*").alias("_copies")).filter("_copies > 1"))
    salt = F.when(counted, 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return (keyed.withColumns({"_counted": counted, "_salt": salt})
            .join(repeated.withColumn("_salt", F.lit(0)), ["flow_key", "tcp_seq", "_salt"], "left")
            .withColumn("is_retransmission", F.col("_counted") & F.col("_copies").isNotNull())
            .drop("_counted", "_copies", "_salt"))
