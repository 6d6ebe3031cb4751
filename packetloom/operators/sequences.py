"""Leak-safe input/target sequences over the window grid.

Sequence ``s`` reads windows ``s .. s+L-1`` and predicts K windows that start exactly at the
end of the last input. Everything works on one row per window or pane, never on raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.config import MICROS, WindowSpec
from packetloom.functions.columns import col
from packetloom.operators import windows
from packetloom.operators.ordering import prefix_sums


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def build(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """``seq_id, first_window, last_window, input_start_us, input_end_us`` for every full run."""
    grid = windows.grid(df, spec)
    last = grid.agg(F.max("window_id")).scalar()
    return grid.filter(F.col("window_id") <= last - (spec.seq_len - 1)).select(
        F.col("window_id").alias("seq_id"), F.col("window_id").alias("first_window"),
        (F.col("window_id") + spec.seq_len - 1).alias("last_window"),
        F.col("start_us").alias("input_start_us"),
        (F.col("start_us") + spec.input_span_us).alias("input_end_us"))


def scoped_build(df: DataFrame, scope: Sequence[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """``build`` inside every scope; ``seq_id`` goes on from scope to scope, by running sums over one row per scope."""
    spans = windows.spans(df, scope, spec)
    full = F.greatest(_zero(), F.col("n_windows") - (spec.seq_len - 1))
    numbered = prefix_sums(spans.withColumn("_full", full), list(scope), {"_upto": F.col("_full")})
    rows = windows.expand(numbered, spec).filter(F.col("window_id") < F.col("_full"))
    return rows.select(
        *scope, (F.col("_upto") - F.col("_full") + F.col("window_id")).alias("seq_id"), F.col("window_id").alias("first_window"),
        (F.col("window_id") + spec.seq_len - 1).alias("last_window"), F.col("start_us").alias("input_start_us"),
        (F.col("start_us") + spec.input_span_us).alias("input_end_us"))


def scoped_padded(df: DataFrame, scope: Sequence[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Positions 0..L-1 of every scope: its first windows, and its last one repeated where there are too few."""
    rows = windows.spans(df, scope, spec).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(spec.seq_len - 1))))
    window = F.least(F.col("pos").cast("bigint"), F.col("n_windows") - 1)
    start = F.col("t0") + window * spec.stride_us
    return rows.select(*scope, "pos", window.alias("window_id"), start.alias("start_us"), (start + spec.size_us).alias("end_us"))


def targets(seqs: DataFrame, spec: WindowSpec = WindowSpec(), anchor: str = "input_end_us") -> DataFrame:
    """The K consecutive target windows of each row that has an anchor time."""
    k = F.sequence(F.lit(0), F.lit(spec.horizon_k - 1))
    start = F.col(anchor) + F.col("k").cast("bigint") * spec.size_us
    return (seqs.withColumn("k", F.explode(k)).withColumn("target_start_us", start)
            .withColumn("target_end_us", F.col("target_start_us") + spec.size_us))


def leaks(seqs: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Targets that begin before their inputs end; must be empty."""
    return targets(seqs, spec).filter(F.col("target_start_us") < F.col("input_end_us"))


def complete_ids(df: DataFrame, spec: WindowSpec = WindowSpec(), min_rows: int = 2) -> DataFrame:
    """Ids of sequences whose every input window has at least ``min_rows`` rows."""
    dense = windows.dense_windows(df, spec, min_rows)
    last_seq = windows.grid(df, spec).agg(F.max("window_id")).scalar() - (spec.seq_len - 1)
    first = F.greatest(_zero(), F.col("window_id") - (spec.seq_len - 1))
    return (dense.withColumn("seq_id", F.explode(F.sequence(first, F.col("window_id"))))
            .filter(F.col("seq_id") <= last_seq)
            .groupBy("seq_id").agg(F.count("*").alias("_n"))
            .filter(F.col("_n") == spec.seq_len).select("seq_id"))


def padded(grid: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Positions 0..L-1 over the first windows of a short capture, its last window repeated."""
    last = grid.agg(F.max("window_id")).scalar()
    head = grid.filter(F.col("window_id") < spec.seq_len)
    pos = F.when(F.col("window_id") == last, F.sequence(F.col("window_id"), F.greatest(
        F.col("window_id"), F.lit(spec.seq_len - 1).cast("bigint")))).otherwise(F.array("window_id"))
    return head.withColumn("pos", F.explode(pos)).select("pos", "window_id", "start_us", "end_us")


def anticipation(now_us, attack_us) -> Column:
    """1 once the attack has begun, exp(-gap/tau) before it, 0 when there is none."""
    gap = (col(attack_us) - col(now_us)) / F.lit(float(MICROS))
    return (F.when(gap.isNull(), F.lit(0.0)).when(gap <= 0, F.lit(1.0))
            .otherwise(F.exp(-gap / F.lit(fv.TAU_SECONDS))))


def graded_target(df: DataFrame, malicious: Column, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Graded attack target per sequence.

    Forward as-of without a range join: malicious rows shrink to first/last time per pane,
    each pane is sent to the sequences that can see it (a fixed fan-out), and one aggregate
    per sequence decides between active, inside the horizon, decaying and none.
    """
    start = windows.origin(df)
    seqs = build(df, spec)
    look_us = max(spec.horizon_us, int(3 * fv.TAU_SECONDS * MICROS))
    step = spec.stride_us // spec.pane_us
    reach = (spec.input_span_us + look_us) // spec.pane_us + 1
    bad = (windows.panes(df.filter(malicious).select("ts_us"), spec, start)
           .groupBy("pane").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")))
    first = F.greatest(_zero(), F.ceil((F.col("pane") - reach) / F.lit(step)).cast("bigint"))
    last = F.floor(F.col("pane") / F.lit(step)).cast("bigint")
    sent = bad.withColumn("seq_id", F.explode(F.sequence(first, F.greatest(first, last))))
    begin = start + F.col("seq_id") * spec.stride_us
    end = begin + spec.input_span_us
    # lo/hi of one pane never straddle begin or end: both are pane boundaries
    seen = sent.groupBy("seq_id").agg(
        F.bool_or((F.col("hi") >= begin) & (F.col("lo") <= end)).alias("active"),
        F.min(F.when(F.col("lo") >= end, F.col("lo"))).alias("next_us"))
    gap = (F.col("next_us") - F.col("input_end_us")) / F.lit(float(MICROS))
    value = (F.when(F.col("active"), F.lit(1.0))
             .when(gap <= spec.horizon_us / MICROS, F.lit(1.0))
             .when(gap <= 3 * fv.TAU_SECONDS, F.exp(-gap / F.lit(fv.TAU_SECONDS)))
             .otherwise(F.lit(0.0)))
    branch = (F.when(F.col("active"), "active").when(gap <= spec.horizon_us / MICROS, "horizon")
              .when(gap <= 3 * fv.TAU_SECONDS, "decayed").otherwise("none"))
    return seqs.join(seen, "seq_id", "left").select(
        "seq_id", value.alias("infil_target"), branch.alias("branch"))


def grounded_targets(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Port entropy, SYN share of rows and log bytes of each future window; zeros when empty.

    With an aligned grid the k-th target is itself a grid window, so this is one equi-join to
    window telemetry; otherwise the telemetry is taken on a grid shifted to the targets.
    """
    goal = targets(build(df, spec), spec)
    if spec.aligned:
        tele = windows.window_telemetry(df, spec)
        hop = spec.size_us // spec.stride_us
        goal = goal.withColumn(
            "window_id", F.col("seq_id") + (spec.seq_len - 1) + (F.col("k") + 1) * F.lit(hop).cast("bigint"))
        joined = goal.join(tele, "window_id", "left")
    else:
        # rows reach the (sequence, k) slots whose target covers them
        rel = F.col("ts_us") - windows.origin(df) - spec.input_span_us - F.col("k").cast("bigint") * spec.size_us
        hi = F.floor(rel / F.lit(spec.stride_us)).cast("bigint")
        lo = F.greatest(_zero(), F.floor((rel - spec.size_us) / F.lit(spec.stride_us)).cast("bigint") + 1)
        slots = (df.select("ts_us", "dst_port", "payload_size", "flag_syn", "flag_ack")
                 .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(spec.horizon_k - 1))))
                 .withColumn("_hi", hi).withColumn("_lo", lo).filter("_hi >= _lo")
                 .withColumn("seq_id", F.explode(F.sequence("_lo", "_hi"))))
        stats = slots.groupBy("seq_id", "k").agg(
            F.count("*").alias("n"), F.sum(F.col("flag_syn").cast("int")).alias("s"),
            F.sum("payload_size").cast("double").alias("b"))
        ent = windows.entropy(slots, ["seq_id", "k"], "dst_port", "port_entropy")
        tele = stats.join(ent, ["seq_id", "k"], "left").select(
            "seq_id", "k", "port_entropy", (F.col("s") / F.col("n")).alias("syn_row_ratio"),
            F.log1p("b").alias("log_bytes"))
        joined = goal.join(tele, ["seq_id", "k"], "left")
    zero = F.lit(0.0)
    return joined.select(
        "seq_id", "k", F.coalesce("port_entropy", zero).alias("port_entropy"),
        F.coalesce("syn_row_ratio", zero).alias("syn_ratio"), F.coalesce("log_bytes", zero).alias("log_bytes"))


def sequence_stage(df: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Stage and confidence of a sequence from its last two input windows (smaller wins a tie)."""
    modes = windows.grid(df, spec).select("window_id").join(windows.stage_mode(df, spec), "window_id", "left").select(
        "window_id", F.coalesce("stage", F.lit(0)).alias("stage"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    tail = min(2, spec.seq_len)
    votes = modes.withColumn("seq_id", F.explode(F.array(*[
        F.col("window_id") - (spec.seq_len - 1) + i for i in range(tail)]))).filter("seq_id >= 0")
    counted = votes.groupBy("seq_id", "stage").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    out = counted.groupBy("seq_id").agg(
        F.max_by("stage", F.struct(F.col("n"), -F.col("stage"))).alias("stage"),
        (F.sum("c") / F.sum("n")).alias("confidence"))
    return build(df, spec).select("seq_id").join(out, "seq_id")


def samples(df: DataFrame, malicious: Column, spec: WindowSpec = WindowSpec(), min_rows: int = 2) -> DataFrame:
    """Training rows: complete sequences with graded target, stage and grounded targets."""
    grounded = grounded_targets(df, spec).groupBy("seq_id").agg(F.array_sort(F.collect_list(
        F.struct("k", "port_entropy", "syn_ratio", "log_bytes"))).alias("grounded"))
    return (complete_ids(df, spec, min_rows).join(build(df, spec), "seq_id")
            .join(graded_target(df, malicious, spec).select("seq_id", "infil_target"), "seq_id")
            .join(sequence_stage(df, spec), "seq_id").join(grounded, "seq_id")
            .withColumn("is_malicious", F.col("infil_target") >= 0.5))


def timeline(sample_rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Span, stage, target and prediction of each sequence, in seconds from its own clock."""
    return sample_rows.join(scored, "seq_id").select(
        "seq_id", (F.col("input_start_us") / F.lit(1e6)).alias("in_start"),
        (F.col("input_end_us") / F.lit(1e6)).alias("in_end"), F.col("stage").alias("stage_true"),
        "infil_target", "y_prob")
