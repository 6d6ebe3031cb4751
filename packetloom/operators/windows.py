"""Overlapping time windows, their rows, telemetry and labels.

Times are integer microseconds and window ids are plain arithmetic on them, so rows meet
windows through ``explode`` and never through a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.config import WindowSpec
from packetloom.functions.columns import as_int, entropy_term, ratio
from packetloom.operators.heavy import lookup
from packetloom.operators.labels import stage_name

CHUNK = 65_536


def origin(df: DataFrame, ts: str = "ts_us") -> Column:
    """First timestamp as a scalar subquery: evaluated once, inside the same job."""
    return df.agg(F.min(ts)).scalar()


def _floor_div(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def assign(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """One output row per (row, window that contains it), with the new column ``window_id``."""
    rel = F.col("ts_us") - (origin(df) if start is None else start)
    last = _floor_div(rel, spec.stride_us)
    first = F.greatest(F.lit(0).cast("bigint"), _floor_div(rel - spec.size_us, spec.stride_us) + 1)
    return df.withColumn("window_id", F.explode(F.sequence(first, last)))


def panes(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """Add ``pane``: the index of the finest slice that tiles both stride and window."""
    rel = F.col("ts_us") - (origin(df) if start is None else start)
    return df.withColumn("pane", _floor_div(rel, spec.pane_us))


def over_panes(paned: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """One output row per (row with a ``pane``, window that contains the pane); every window is a run of whole panes."""
    rel = F.col("pane") * F.lit(spec.pane_us)
    first = F.greatest(F.lit(0).cast("bigint"), _floor_div(rel - spec.size_us, spec.stride_us) + 1)
    return paned.withColumn("window_id", F.explode(F.sequence(first, _floor_div(rel, spec.stride_us))))


def scoped_assign(df: DataFrame, scope: Sequence[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """``assign`` with an origin of its own for every scope (a capture with its own clock)."""
    starts = df.groupBy(*scope).agg(F.min("ts_us").alias("_t0"))
    return assign(lookup(df, starts, list(scope)), spec, F.col("_t0")).drop("_t0")


def spans(df: DataFrame, scope: Sequence[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """One row per scope: ``t0``, ``t1`` and ``n_windows``."""
    bounds = df.groupBy(*scope).agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")).filter("t0 is not null")
    return bounds.withColumn("n_windows", _floor_div(F.col("t1") - F.col("t0"), spec.stride_us) + 1)


def expand(bounds: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Every window of each row of ``spans``: adds ``window_id, start_us, end_us``; long spans in chunks, as in ``grid``."""
    chunks = bounds.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), _floor_div(F.col("n_windows") - 1, CHUNK))))
    ids = chunks.withColumn("window_id", F.explode(F.sequence(
        F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col("n_windows")) - 1))).drop("_c")
    start = F.col("t0") + F.col("window_id") * spec.stride_us
    return ids.withColumns({"start_us": start, "end_us": start + spec.size_us})


def scoped_grid(df: DataFrame, scope: Sequence[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """The window grid of every scope, each from its own first timestamp."""
    return expand(spans(df, scope, spec), spec).select(*scope, "window_id", "start_us", "end_us")


def grid(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """All windows whose start lies inside the data: ``window_id, start_us, end_us``.

    Ids are produced in chunks so that no single array holds a whole long capture.
    """
    bounds = df.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")).filter("t0 is not null")
    n = _floor_div(F.col("t1") - F.col("t0"), spec.stride_us) + 1
    chunks = bounds.withColumn("n", n).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("bigint"), _floor_div(F.col("n") - 1, CHUNK))))
    ids = chunks.withColumn("window_id", F.explode(F.sequence(
        F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("n")) - 1)))
    start = F.col("t0") + F.col("window_id") * spec.stride_us
    return ids.select("window_id", start.alias("start_us"), (start + spec.size_us).alias("end_us"))


def grid_complete_only(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Windows that end inside the data, or one window over the whole span when there is none."""
    whole = grid(df, spec).filter(F.col("end_us") <= df.agg(F.max("ts_us")).scalar())
    span = (df.agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
            .filter(F.col("end_us") - F.col("start_us") < spec.size_us)
            .select(F.lit(0).cast("bigint").alias("window_id"), "start_us", "end_us"))
    return whole.unionByName(span)


def window_counts(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    return assign(df.select("ts_us"), spec, origin(df)).groupBy("window_id").agg(F.count("*").alias("n_rows"))


def fill_report(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Counts of all and of empty windows, and min / max / median rows per window.

    The median is read off the histogram of row counts; that histogram has one line per
    distinct count, not one per window.
    """
    filled = (grid(df, spec).join(window_counts(df, spec), "window_id", "left")
              .select(F.coalesce("n_rows", F.lit(0)).alias("n")))
    hist = filled.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    cum = hist.select("n", "c", F.sum("c").over(w).alias("hi"),
                      F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    lo = F.col("hi") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((lo <= rank) & (rank < F.col("hi")), F.col("n")))

    half = (F.col("total") - 1) / F.lit(2.0)
    return cum.agg(
        F.max("total").alias("n_windows"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0)).alias("n_empty"),
        F.min("n").alias("min_count"), F.max("n").alias("max_count"),
        ((at(F.floor(half)) + at(F.ceil(half))) / F.lit(2.0)).alias("median_count"),
    ).withColumn("empty_rate", ratio("n_empty", "n_windows"))


def dense_windows(df: DataFrame, spec: WindowSpec = WindowSpec(), min_rows: int = 2) -> DataFrame:
    return window_counts(df, spec).filter(F.col("n_rows") >= min_rows)


def entropy(df: DataFrame, by: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of ``value`` per group, by two map-side-combined aggregates.

    The group total is the sum of the value counts, so p is never taken from the raw rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    if not by:
        total = counts.agg(F.sum("_c")).scalar()
        return counts.agg(F.sum(entropy_term(F.col("_c") / total)).alias(name))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_t"))
    return counts.join(totals, by).groupBy(*by).agg(
        F.sum(entropy_term(F.col("_c") / F.col("_t"))).alias(name))


def port_entropy(df: DataFrame, by: list[str], port: str = "dst_port", name: str = "port_entropy") -> DataFrame:
    """Same for a port column: its at most 65,536 counts per group fit a list, so no join is needed."""
    counts = df.filter(F.col(port).isNotNull()).groupBy(*by, port).agg(F.count("*").alias("_c"))
    lists = counts.groupBy(*by).agg(F.collect_list("_c").alias("_l"), F.sum("_c").alias("_t"))
    return lists.select(*by, F.aggregate("_l", F.lit(0.0), lambda acc, c: acc + entropy_term(c / F.col("_t"))).alias(name))


def window_telemetry(df: DataFrame, spec: WindowSpec = WindowSpec(), start: Column | None = None) -> DataFrame:
    """Per window: rows, bytes, SYN / ACK counts, both SYN ratios, log bytes and port entropy.

    Counting per (window, destination port) first makes the entropy part of the same
    aggregation tree; at most 65,536 port rows per window reach the second step.
    """
    rows = assign(df.select("ts_us", "dst_port", "payload_size", "flag_syn", "flag_ack"), spec,
                  origin(df) if start is None else start)
    by_port = rows.groupBy("window_id", "dst_port").agg(
        F.count("*").alias("c"), F.sum(F.coalesce("payload_size", F.lit(0))).alias("b"),
        F.sum(as_int("flag_syn")).alias("s"), F.sum(as_int("flag_ack")).alias("a"))
    counted = F.when(F.col("dst_port").isNotNull(), F.col("c"))
    # the entropy sum needs the window total first, so the (bounded) port counts are kept as a list
    agg = by_port.groupBy("window_id").agg(
        F.sum("c").alias("n_rows"), F.sum("b").alias("bytes"), F.sum("s").alias("syn"),
        F.sum("a").alias("ack"), F.collect_list(counted).alias("_counts"), F.sum(counted).alias("_ports"))
    ent = F.aggregate("_counts", F.lit(0.0), lambda acc, c: acc + entropy_term(c / F.col("_ports")))
    return agg.select(
        "window_id", "n_rows", "bytes", "syn", "ack", F.coalesce(ent, F.lit(0.0)).alias("port_entropy"),
        ratio("syn", F.col("syn") + F.col("ack")).alias("syn_ack_ratio"),
        ratio("syn", "n_rows").alias("syn_row_ratio"),
        F.log1p(F.greatest(F.col("bytes"), F.lit(0)).cast("double")).alias("log_bytes"))


def snapshot_dynamics(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    return window_telemetry(df, spec).select(
        "window_id", "port_entropy", F.col("syn_ack_ratio").alias("syn_ratio"), "log_bytes")


def snapshots_with_empty(df: DataFrame, spec: WindowSpec = WindowSpec(), min_rows: int = 1) -> DataFrame:
    """Every grid window; those below ``min_rows`` become zero rows without telemetry."""
    tele = window_telemetry(df, spec).filter(F.col("n_rows") >= min_rows)
    zero = F.lit(0.0)
    return grid(df, spec).join(tele, "window_id", "left").select(
        "window_id", "start_us", "end_us", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("port_entropy", zero).alias("port_entropy"),
        F.coalesce("syn_ack_ratio", zero).alias("syn_ratio"),
        F.coalesce("log_bytes", zero).alias("log_bytes"), F.col("n_rows").isNull().alias("is_empty"))


def stage_mode(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Most frequent stage (smaller wins ties) and mean confidence per window."""
    per_stage = assign(df.select("ts_us", "mitre_stage_id", "mitre_confidence"), spec, origin(df)).groupBy(
        "window_id", "mitre_stage_id").agg(F.count("*").alias("n"), _confidence_sum("mitre_confidence").alias("c"))
    return per_stage.groupBy("window_id").agg(
        F.max_by("mitre_stage_id", F.struct(F.col("n"), -F.col("mitre_stage_id"))).alias("stage"),
        (F.sum("c").cast("double") / F.sum("n")).alias("confidence"))


def _confidence_sum(value) -> Column:
    """Exact sum: confidences are short decimals, so the result does not depend on row order."""
    return F.sum((F.col(value) if isinstance(value, str) else value).cast("decimal(18,6)"))


def attack_label(df: DataFrame, spec: WindowSpec = WindowSpec(), min_malicious: int = 1) -> DataFrame:
    """Attack-preserving window label over the whole grid.

    A window with enough malicious rows takes its dominant malicious stage and that stage's
    mean confidence; otherwise it is benign with the mean benign confidence; an empty window
    is benign with confidence 1.
    """
    per_stage = assign(df.select("ts_us", "mitre_stage_id", "mitre_confidence"), spec, origin(df)).groupBy(
        "window_id", F.coalesce("mitre_stage_id", F.lit(0)).alias("s")).agg(
        F.count("*").alias("n"), _confidence_sum(F.coalesce("mitre_confidence", F.lit(0.5))).alias("c"))
    bad = F.col("s") > 0
    mean = F.col("c").cast("double") / F.col("n")
    agg = per_stage.groupBy("window_id").agg(
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("n_bad"),
        F.max_by(F.struct(F.col("s"), mean.alias("m")),
                 F.when(bad, F.struct(F.col("n"), -F.col("s")))).alias("top"),
        F.max(F.when(~bad, mean)).alias("benign"))
    hit = F.coalesce(F.col("n_bad") >= min_malicious, F.lit(False))
    joined = grid(df, spec).select("window_id").join(agg, "window_id", "left")
    stage = F.when(hit, F.col("top.s")).otherwise(F.lit(0))
    return joined.select(
        "window_id", stage.alias("stage"), stage_name(stage).alias("stage_name"),
        F.when(F.col("n_bad").isNull(), F.lit(1.0)).when(hit, F.col("top.m"))
        .otherwise(F.coalesce("benign", F.lit(0.95))).alias("confidence"), hit.alias("is_malicious"))


def attack_label_raw(df: DataFrame, spec: WindowSpec = WindowSpec(), min_malicious: int = 1) -> DataFrame:
    """Same from mapped labels only (``label_stage``), with fixed confidences."""
    flat = df.select("ts_us", F.col("label_stage").alias("mitre_stage_id"),
                     F.lit(0.0).alias("mitre_confidence"))
    base = attack_label(flat, spec, min_malicious)
    filled = base.join(window_counts(df, spec), "window_id", "left")
    return filled.select(
        "window_id", "stage", "stage_name",
        F.when(F.col("is_malicious"), F.lit(fv.CONF_RAW_MALICIOUS))
        .when(F.col("n_rows").isNull(), F.lit(1.0)).otherwise(F.lit(fv.CONF_RAW_BENIGN)).alias("confidence"),
        "is_malicious")


def stage_transitions(window_stages: DataFrame) -> DataFrame:
    """Directed stage pairs of consecutive windows: ``window_id, from_stage, to_stage``.

    The next window is found by id, so this is an equi-join rather than a global window.
    """
    nxt = window_stages.select((F.col("window_id") - 1).alias("window_id"), F.col("stage").alias("to_stage"))
    return window_stages.select("window_id", F.col("stage").alias("from_stage")).join(nxt, "window_id")


def transition_matrix(window_stages: DataFrame) -> DataFrame:
    return stage_transitions(window_stages).groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))
