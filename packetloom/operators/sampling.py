"""Deterministic sampling, splits and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.config import SplitSpec
from packetloom.functions.columns import col, seeded_hash
from packetloom.operators.ordering import first_n, first_n_by_hash, head_rows, keys_at_ranks, positions, precedes


def cap_random(df: DataFrame, group: str, key: str, cap: int, big_group: str | None = None, big_cap: int = 0,
               seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group (``big_cap`` for one named group), chosen by seeded hash."""
    limit = F.when(F.col(group) == big_group, F.lit(big_cap)).otherwise(F.lit(cap)) if big_group else F.lit(cap)
    return first_n_by_hash(df.withColumn("_h", seeded_hash(seed, key)), [group], "_h", key, limit).drop("_h")


def cap_first(df: DataFrame, group: str, order: Sequence[str], cap: int, max_total: int, max_scanned: int,
              chunk: int, big: Column | None = None) -> DataFrame:
    """First rows of every group in arrival order, reading whole chunks until a quota is met.

    ``order`` starts with a numeric arrival column, which limits the scan. ``big`` marks groups that may fill 30 % of ``max_total``. Reading stops after the chunk in
    which ``max_scanned`` rows were read or ``max_total`` rows were kept.
    """
    last_scan = -(-max_scanned // chunk) - 1
    near = head_rows(df, order[0], (last_scan + 1) * chunk)
    placed = positions(near, order, name="_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk))
    limit = F.when(big, F.lit(int(max_total * 0.30))).otherwise(F.lit(cap)) if big is not None else F.lit(cap)
    kept = first_n(placed.filter(F.col("_chunk") <= last_scan), [group], ["_pos"], limit, salt=F.col("_pos"))
    per_chunk = kept.groupBy("_chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_chunk")  # at most max_scanned / chunk rows
    full = per_chunk.withColumn("cum", F.sum("n").over(w)).filter(F.col("cum") >= max_total)
    stop = full.agg(F.min("_chunk")).scalar()
    return kept.filter(F.col("_chunk") <= F.coalesce(stop, F.lit(last_scan))).drop("_pos", "_chunk")


def split_random(df: DataFrame, key: str, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Exact train/val/test sizes over rows ranked by seeded hash; adds ``split``.

    Only the two border keys are looked up, so the rows themselves are never sorted or moved.
    """
    hashed = df.withColumn("_h", seeded_hash(spec.seed, key))
    n = df.count()
    train = int(n * spec.train_frac)
    val = train + int(n * spec.val_frac)
    at = keys_at_ranks(hashed, "_h", key, [train, val])
    return hashed.withColumn("split", F.when(precedes("_h", key, at.get(train)), "train").when(
        precedes("_h", key, at.get(val)), "val").otherwise("test")).drop("_h")


def temporal_bounds(n: int, spec: SplitSpec = SplitSpec()) -> dict[str, tuple[int, int]]:
    """Half-open position ranges of contiguous blocks with a blackout buffer between them.

    The buffer shrinks on tiny sets, and an empty test or validation block borrows the last
    training position.
    """
    if n == 0:
        return {"train": (0, 0), "val": (0, 0), "test": (0, 0)}
    gap = max(0, min(spec.buffer, (n - 3) // 2))
    train_end = max(1, min(int(n * spec.train_frac), n - 2))
    val_start = min(train_end + gap, n)
    val_end = min(val_start + int(n * spec.val_frac), n)
    blocks = {"train": (0, train_end), "val": (val_start, val_end), "test": (min(val_end + gap, n), n)}
    for name in ("test", "val"):
        lo, hi = blocks[name]
        end = blocks["train"][1]
        if lo >= hi and end > 2:
            blocks[name], blocks["train"] = (end - 1, end), (0, end - 1)
    return blocks


def _by_blocks(df: DataFrame, order: Sequence[str], blocks: Sequence[tuple[str, int]], rest: str) -> Column:
    """Name of the block a row falls into; ``blocks`` are (name, end rank) in rank order."""
    first, tie = order[0], order[-1]
    at = keys_at_ranks(df, first, tie, [end for _, end in blocks])
    out = F.lit(rest)
    for name, end in reversed(blocks):
        out = F.when(F.lit(False) if end <= 0 else precedes(first, tie, at.get(end)), F.lit(name)).otherwise(out)
    return out


def split_temporal(df: DataFrame, order: Sequence[str], spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Contiguous blocks in time order; rows in the buffers get ``buffer``.

    ``order`` is an integer time column and, unless that is unique, a tie-break.
    """
    bounds = sorted(temporal_bounds(df.count(), spec).items(), key=lambda kv: kv[1])
    blocks, at = [], 0
    for name, (lo, hi) in bounds:
        if hi > lo:
            blocks += [("buffer", lo)] if lo > at else []
            blocks.append((name, hi))
            at = hi
    return df.withColumn("split", _by_blocks(df, order, blocks, "buffer"))


def split_unseen(df: DataFrame, order: Sequence[str], held_out: Column, train_frac: float = 0.85,
                 buffer: int = 14) -> DataFrame:
    """Held-out rows become the test set; the others split in time with a buffer."""
    held = F.coalesce(held_out, F.lit(False))
    known = df.filter(~held)
    n = known.count()
    gap = max(0, min(buffer, n - 2))
    train = max(1, int(n * train_frac))
    block = _by_blocks(known, order, [("train", train), ("buffer", train + gap)], "val")
    return df.withColumn("split", F.when(held, "test").otherwise(block))


def held_out_flag(label, names: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(col(label))).isin([n.strip().lower() for n in names]), F.lit(False))


def binary_weights(df: DataFrame, positive: Column) -> DataFrame:
    """One row: n/(2 n_c) per class (1 when a class is missing) and the negative/positive ratio."""
    agg = df.agg(F.count("*").alias("n"), F.count_if(positive).alias("pos"))
    neg = F.col("n") - F.col("pos")
    both = (F.col("pos") > 0) & (neg > 0)
    return agg.select(
        F.when(both, F.try_divide("n", 2 * neg)).otherwise(F.lit(1.0)).alias("benign_weight"),
        F.when(both, F.try_divide("n", 2 * F.col("pos"))).otherwise(F.lit(1.0)).alias("malicious_weight"),
        (neg / F.greatest("pos", F.lit(1))).alias("pos_weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Normalised 1/(count+1) weight per class."""
    inv = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("_inv", F.lit(1.0) / (F.col("n") + 1))
    total = inv.agg(F.sum("_inv")).scalar()
    return inv.select(label, "n", (F.col("_inv") / total).alias("weight"))


def imbalance(df: DataFrame, positive: Column) -> DataFrame:
    agg = df.agg(F.count("*").alias("total"), F.count_if(positive).alias("malicious"))
    return agg.select("total", "malicious", (F.col("total") - F.col("malicious")).alias("benign"),
                      (F.lit(100.0) * F.col("malicious") / F.greatest("total", F.lit(1))).alias("malicious_pct"))
