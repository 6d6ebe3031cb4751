"""Structured Streaming forms of the packet operators.

Input streams carry the packet columns plus ``event_time`` (timestamp of ``ts_us``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from packetloom.config import WindowSpec
from packetloom.functions.columns import as_int, entropy_term, ratio
from packetloom.operators import flows, labels

DECAY = 0.5


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros("ts_us"))


def replay(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Stored telemetry replayed as micro-batches, a few files at a time."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def label_stream(stream: DataFrame) -> DataFrame:
    """Stateless stage rules on a stream: the same expressions as in batch."""
    return labels.with_heuristic_stage(stream)


def _window(spec: WindowSpec):
    return F.window("event_time", f"{spec.size_us} microseconds", f"{spec.stride_us} microseconds")


def sliding_edges(stream: DataFrame, spec: WindowSpec = WindowSpec(), delay: str = "10 seconds") -> DataFrame:
    """Packets and bytes per (window, source, destination) on the sliding grid."""
    agg = (stream.withWatermark("event_time", delay).groupBy(_window(spec).alias("w"), "src_ip", "dst_ip")
           .agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes")))
    return agg.select(F.unix_micros("w.start").alias("start_us"), "src_ip", "dst_ip", "n", "bytes")


def tumbling_targets(stream: DataFrame, spec: WindowSpec = WindowSpec(), delay: str = "10 seconds") -> DataFrame:
    """Non-overlapping telemetry with exact port entropy, by two chained aggregations.

    The first counts per (window, port); the second sees one row per port, so its list is
    bounded by the number of ports.
    """
    size = f"{spec.size_us} microseconds"
    by_port = (stream.withWatermark("event_time", delay).groupBy(F.window("event_time", size).alias("w"), "dst_port")
               .agg(F.count("*").alias("c"), F.sum(as_int("flag_syn")).alias("s"), F.sum("payload_size").alias("b")))
    again = by_port.groupBy(F.window(F.window_time("w"), size).alias("w")).agg(
        F.sum("c").alias("n"), F.sum("s").alias("syn"), F.sum("b").alias("bytes"), F.collect_list("c").alias("counts"))
    ent = F.aggregate("counts", F.lit(0.0), lambda acc, c: acc + entropy_term(c / F.col("n")))
    return again.select(F.unix_micros("w.start").alias("start_us"), "n", ent.alias("port_entropy"),
                        ratio("syn", "n").alias("syn_ratio"), F.log1p(F.col("bytes").cast("double")).alias("log_bytes"))


def flow_sessions(stream: DataFrame, idle_us: int = 120_000_000, delay: str = "10 seconds") -> DataFrame:
    """Canonical flows split at idle gaps, as session windows.

    A session window closes a gap of exactly the timeout while the batch rule keeps it, so one
    microsecond is added to the gap.
    """
    keyed = flows.with_canonical_key(stream.withWatermark("event_time", delay))
    agg = keyed.groupBy("flow_key", F.session_window("event_time", f"{idle_us + 1} microseconds").alias("w")).agg(
        F.count("*").alias("tot_pkts"), F.sum("payload_size").alias("tot_bytes"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return agg.select("flow_key", "start_us", "end_us", "tot_pkts", "tot_bytes")


def dedupe_stream(stream: DataFrame, key: list[str], delay: str = "10 seconds") -> DataFrame:
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(key)


MEMORY_SCHEMA = "ip string, start_us bigint, memory double, n_windows bigint"
STATE_SCHEMA = "memory double, n_windows bigint"


def host_memory(windows: DataFrame) -> DataFrame:
    """Decayed mean of a host feature carried across windows; silent hosts keep their state.

    Input is one row per (host, window) with ``ip, start_us, value``, already closed by a
    watermark, so a trigger hands each host only its new windows. The state function is
    local, so Spark ships its code and workers need no package.
    """

    def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values("start_us")
        out = []
        for start, value in zip(rows["start_us"], rows["value"]):
            memory, seen = DECAY * memory + (1 - DECAY) * float(value), seen + 1
            out.append((key[0], int(start), memory, seen))
        state.update((memory, seen))
        yield pd.DataFrame(out, columns=["ip", "start_us", "memory", "n_windows"])

    return windows.groupBy("ip").applyInPandasWithState(
        remember, MEMORY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def host_windows(stream: DataFrame, spec: WindowSpec = WindowSpec(), delay: str = "10 seconds") -> DataFrame:
    """Log bytes sent per host and tumbling window: the feature remembered per host."""
    agg = (stream.withWatermark("event_time", delay)
           .groupBy(F.window("event_time", f"{spec.size_us} microseconds").alias("w"), F.col("src_ip").alias("ip"))
           .agg(F.log1p(F.sum("payload_size").cast("double")).alias("value")))
    return agg.select("ip", F.unix_micros("w.start").alias("start_us"), "value")


def host_memory_batch(windows: DataFrame) -> DataFrame:
    """Batch twin: final memory per host from its windows in time order.

    m_n = sum of (1-d) d^(n-i) value_i, so a host's value needs only each window's distance
    from the newest one; the ranks come from the skew-safe positions and the sum combines
    map-side.
    """
    from packetloom.operators.ordering import positions

    placed = positions(windows, ["start_us"], within=["ip"], name="_i")
    last = placed.groupBy("ip").agg(F.max("_i").alias("_last"))
    weight = (1 - DECAY) * F.pow(F.lit(DECAY), F.col("_last") - F.col("_i"))
    return placed.join(last, "ip").groupBy("ip").agg(
        F.sum(weight * F.col("value")).alias("memory"), F.count("*").alias("n_windows"))


def late_report(stream: DataFrame, spec: WindowSpec = WindowSpec(), delay: str = "10 seconds") -> DataFrame:
    """Rows per tumbling window under a watermark; later rows are dropped by the engine.

    A trigger drops by the watermark that the trigger before it started with.
    """
    agg = (stream.withWatermark("event_time", delay).groupBy(F.window("event_time", f"{spec.size_us} microseconds").alias("w"))
           .agg(F.count("*").alias("n")))
    return agg.select(F.unix_micros("w.start").alias("start_us"), "n")


PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def keep_progress(spark: SparkSession, batches: int = 1_000_000) -> None:
    """Let queries remember the progress of so many batches; Spark's own bound is 100."""
    spark.conf.set(PROGRESS, str(batches))


def dropped_rows(query) -> int:
    """Rows the watermark dropped so far, summed over the progress of all batches.

    Raises where Spark may have forgotten the first batches: see ``keep_progress``.
    """
    known = query.recentProgress
    if len(known) >= int(SparkSession.getActiveSession().conf.get(PROGRESS, "100")):
        raise ValueError("the first batches are forgotten; call keep_progress before the query starts")
    return sum(op.numRowsDroppedByWatermark for p in known for op in p.stateOperators)
