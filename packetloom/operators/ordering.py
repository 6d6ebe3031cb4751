"""Ordered computations that never sort a whole table, or a whole hot group, in one task.

Rows are range-partitioned on the full sort key, so a heavy group is spread over
many partitions; per-partition totals (at most one row per partition and group)
give each partition its offset, and only the rows inside one partition are sorted
together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import cut, task_slots


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column],
                within: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums in ``order``, restarting for each ``within`` group.

    ``order`` must be unique inside a group for the result to be deterministic. The
    tagged rows are checkpointed because they feed both the totals and the rows, and
    both must see the same partition bounds.
    """
    within, names = list(within), list(sums)
    slots = task_slots(df.sparkSession)
    tagged = cut(df.withColumns({f"_add_{n}": c for n, c in sums.items()})
                 .repartitionByRange(slots, *within, *order)
                 .withColumn("_part", F.spark_partition_id()))
    totals = tagged.groupBy("_part", *within).agg(
        *[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in names])
    before = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0)))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *within, *[
        F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names])
    if not within:
        offsets = F.broadcast(offsets)  # at most `slots` rows
    local = (Window.partitionBy("_part", *within).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = tagged.withColumns({f"_run_{n}": F.sum(f"_add_{n}").over(local) for n in names})
    keys = ["_part", *within]
    cond = None
    for key in keys:
        test = running[key].eqNullSafe(offsets[key])
        cond = test if cond is None else cond & test
    joined = running.join(offsets, cond)
    return joined.select(
        *[running[c] for c in df.columns],
        *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in names])


def positions(df: DataFrame, order: Sequence[str], within: Sequence[str] = (),
              name: str = "position") -> DataFrame:
    """Add the 0-based rank of every row in the total ``order``."""
    ranked = prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, within)
    return ranked.withColumn(name, F.col(name) - 1)


# The sketch is off by at most 1/ACCURACY of the rows, half of the bracket's margin.
ACCURACY, MARGIN = 10_000, 2e-4


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of several numeric columns: one row per column.

    Output: ``column, n, max_value, q0..``; null, NaN and infinite values are ignored. A
    mergeable sketch brackets each quantile, one aggregate counts the rows below the bracket,
    and only the rows inside it (a few in ten thousand, equal values collapsed) are ordered.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    points = [min(max(q + side * MARGIN, 0.0), 1.0) for q in qs for side in (-1, 1)]
    brackets = long.groupBy("column").agg(
        F.count("*").alias("n"), F.max("value").alias("max_value"),
        F.percentile_approx("value", points, ACCURACY).alias("_at"))
    marked = long.join(F.broadcast(cut(brackets)), "column")  # one row per named column
    value, at = F.col("value"), F.col("_at")
    sides = []
    for i in range(len(qs)):
        lo, hi = at[2 * i], at[2 * i + 1]
        sides += [F.count_if(value < lo).alias(f"_below{i}"), F.count_if(value <= hi).alias(f"_upto{i}"),
                  F.max(F.when(value < lo, value)).alias(f"_prev{i}"), F.min(F.when(value > hi, value)).alias(f"_next{i}")]
    around = marked.groupBy("column", "n", "max_value").agg(*sides)
    inside = F.filter(F.array(*[F.when(value.between(at[2 * i], at[2 * i + 1]), F.lit(i)) for i in range(len(qs))]),
                      lambda i: i.isNotNull())
    near = (marked.select("column", "value", F.explode(inside).alias("_i")).groupBy("column", "_i", "value")
            .agg(F.count("*").alias("_n")))
    ranked = prefix_sums(near, ["value"], {"_cum": F.col("_n")}, ["column", "_i"])
    placed = ranked.join(F.broadcast(around), "column")

    aggs, outs = [], []
    for i, q in enumerate(qs):
        pos = (F.col("n") - 1) * F.lit(float(q))
        hi_rank = F.col(f"_below{i}") + F.col("_cum")
        lo_rank = hi_rank - F.col("_n")

        def value_at(rank: Column, i: int = i, lo_rank: Column = lo_rank, hi_rank: Column = hi_rank) -> Column:
            return F.max(F.when(rank < F.col(f"_below{i}"), F.col(f"_prev{i}"))
                         .when(rank >= F.col(f"_upto{i}"), F.col(f"_next{i}"))
                         .when((F.col("_i") == i) & (lo_rank <= rank) & (rank < hi_rank), value))

        aggs += [value_at(F.floor(pos)).alias(f"_lo{i}"), value_at(F.ceil(pos)).alias(f"_hi{i}")]
        frac = pos - F.floor(pos)
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    # callers read several single values from this table, so its few rows are computed once
    return cut(placed.groupBy("column", "n", "max_value").agg(*aggs).select("column", "n", "max_value", *outs))


def keys_at_ranks(df: DataFrame, order: str, tie: str, ranks: Sequence[int], bins: int = 65_536) -> dict[int, tuple]:
    """The (order, tie) values of the rows at the given 0-based ranks; missing ranks are absent.

    An integer column is binned, the bin counts locate each rank, and only the rows of those
    bins are ordered. With these keys a split by rank is a comparison on every row, without
    moving any.
    """
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return {}
    width = (hi - lo) // bins + 1
    placed_bin = F.floor((F.col(order) - F.lit(lo)) / F.lit(width)).cast("bigint")
    tagged = df.select(F.col(order).alias("_o"), F.col(tie).alias("_t"), placed_bin.alias("_bin"))
    counts = sorted((r["_bin"], r["n"]) for r in tagged.groupBy("_bin").agg(F.count("*").alias("n")).collect())  # <= bins
    wanted, start = {}, 0
    for number, n in counts:
        for rank in ranks:
            if start <= rank < start + n:
                wanted[rank] = (number, rank - start)
        start += n
    if not wanted:
        return {}
    near = tagged.filter(F.col("_bin").isin(sorted({b for b, _ in wanted.values()})))
    spot = None
    for number, offset in set(wanted.values()):
        test = (F.col("_bin") == number) & (F.col("position") == offset)
        spot = test if spot is None else spot | test
    found = {(r["_bin"], r["position"]): (r["_o"], r["_t"]) for r in positions(near, ["_o", "_t"], ["_bin"]).filter(spot).collect()}
    return {rank: found[where] for rank, where in wanted.items()}


def precedes(order: str, tie: str, key: tuple | None) -> Column:
    """Whether a row sorts before ``key``; every row does when the key is absent."""
    if key is None:
        return F.lit(True)
    o, t = F.lit(key[0]), F.lit(key[1])
    return (F.col(order) < o) | ((F.col(order) == o) & (F.col(tie) < t))


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: Column | int,
            salt: Column, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    A salted pass keeps at most ``n`` rows per (group, salt), so the final ranking sees
    at most ``n * salts`` rows of any group however large the group is.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    coarse = Window.partitionBy(*group, "_salt").orderBy(*order)
    fine = Window.partitionBy(*group).orderBy(*order)
    kept = (df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
            .withColumn("_rank", F.row_number().over(coarse)).filter(F.col("_rank") <= n))
    return (kept.withColumn("_rank", F.row_number().over(fine)).filter(F.col("_rank") <= n)
            .drop("_rank", "_salt"))


HASH_BITS, BUCKET_BITS = 60, 16


def first_n_by_hash(df: DataFrame, group: Sequence[str], hash_col: str, tie: str, n: Column | int) -> DataFrame:
    """First ``n`` rows of each group in the order of a uniform 60-bit hash.

    A histogram of the hash's leading bits per group finds the bucket that holds the n-th row.
    Rows beyond it are filtered out before any shuffle, so even a group with most of the table
    ranks only about ``n`` plus one bucket's rows, and the result is exact.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(hash_col), HASH_BITS - BUCKET_BITS)).withColumn("_n", n)
    hist = bucketed.groupBy(*group, "_bucket").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= 65,536 rows
    needed = hist.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).filter(F.col("_before") < F.col("_n"))
    # joined on group and bucket: a group with most of the table is spread over its buckets; null is a group of its own
    keys = needed.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    near = bucketed.join(keys, same, "left_semi")
    w = Window.partitionBy(*group).orderBy(hash_col, tie)
    return near.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.col("_n")).select(*df.columns)


def head_rows(df: DataFrame, order: str, n: int, bins: int = 65_536) -> DataFrame:
    """A superset of the first ``n`` rows by a numeric column, cut off by its histogram.

    The cut-off is a constant comparison on the column, so files that lie beyond it are skipped.
    """
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return df
    lo, hi, need, inside = float(lo), float(hi), n, df
    while True:
        width = max((hi - lo) / bins, 1e-9)
        bin_of = F.least(F.greatest(F.floor((F.col(order) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins))
        hist = inside.filter(F.col(order).isNotNull()).groupBy(bin_of.alias("_bin")).agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # <= bins rows
        found = (hist.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).filter(F.col("_before") + F.col("_c") >= need)
                 .orderBy("_bin").first())
        if found is None:
            return df
        start, end = lo + width * found["_bin"], lo + width * (found["_bin"] + 1)
        # an outlier can put nearly all rows into one bin: look into that bin until few rows are in it
        if found["_c"] <= max(n, bins) or end - start >= hi - lo or width <= 1e-9 or start + width / bins == start:
            break
        lo, hi, need = start, end, need - found["_before"]
        inside = df.filter((F.col(order) >= F.lit(lo)) & (F.col(order) <= F.lit(hi)))
    # one extra bin keeps rows that rounding put on the border
    return df.filter(F.col(order) <= F.lit(end + width))


def gap_stats(df: DataFrame, keys: Sequence[str], ts: str = "ts_us",
              tracks: dict[str, Column] | None = None, bucket_us: int | None = 10_000_000) -> DataFrame:
    """Statistics of consecutive time gaps per key, exact in integer microseconds.

    ``tracks`` names row subsets (for example one direction) that get their own gaps;
    each yields ``<track>_n, _mean, _std, _max, _min`` with population std and zeros when
    there is no gap. Rows are first counted per distinct microsecond, then gaps are taken
    inside (key, time bucket) slices, whose size the bucket width bounds, and slices are
    stitched by their first and last times. ``bucket_us=None`` is for keys that already
    contain a short window.
    """
    keys, tracks = list(keys), tracks or {"gap": F.lit(True)}
    bucket = F.floor(F.col(ts) / F.lit(bucket_us)) if bucket_us else F.lit(0)
    dec = "decimal(18,0)"
    marks = df.groupBy(*keys, bucket.cast("bigint").alias("_b"), F.col(ts).alias("_t")).agg(
        *[F.count_if(cond).alias(f"_n_{t}") for t, cond in tracks.items()])
    slice_w = (Window.partitionBy(*keys, "_b").orderBy("_t")
               .rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks
    for t in tracks:
        here = F.when(F.col(f"_n_{t}") > 0, F.col("_t"))
        gaps = gaps.withColumn(f"_at_{t}", here)
        gaps = gaps.withColumn(f"_gap_{t}", here - F.last(f"_at_{t}", ignorenulls=True).over(slice_w))
    aggs = []
    for t in tracks:
        gap, twin = F.col(f"_gap_{t}"), F.when(F.col(f"_n_{t}") > 1, F.lit(0).cast("bigint"))
        aggs += [
            F.sum(f"_n_{t}").alias(f"n_{t}"), F.min(f"_at_{t}").alias(f"first_{t}"),
            F.max(f"_at_{t}").alias(f"last_{t}"),
            # gaps of a slice add up to less than its width, so their squares fit a BIGINT
            F.sum(gap * gap).alias(f"sq_{t}"),
            F.greatest(F.max(gap), F.max(twin)).alias(f"max_{t}"),
            F.least(F.min(gap), F.min(twin)).alias(f"min_{t}"),
        ]
    slices = gaps.groupBy(*keys, "_b").agg(*aggs)
    if bucket_us:
        key_w = (Window.partitionBy(*keys).orderBy("_b")
                 .rowsBetween(Window.unboundedPreceding, -1))
        for t in tracks:
            slices = slices.withColumn(
                f"edge_{t}", F.col(f"first_{t}") - F.last(f"last_{t}", ignorenulls=True).over(key_w))
        merged = []
        for t in tracks:
            edge = F.col(f"edge_{t}")
            merged += [
                F.sum(f"n_{t}").alias(f"n_{t}"), F.min(f"first_{t}").alias(f"first_{t}"),
                F.max(f"last_{t}").alias(f"last_{t}"),
                F.sum(F.coalesce(F.col(f"sq_{t}"), F.lit(0)).cast(dec) +
                      F.coalesce(edge.cast(dec) * edge.cast(dec), F.lit(0))).alias(f"sq_{t}"),
                F.max(F.greatest(f"max_{t}", edge)).alias(f"max_{t}"),
                F.min(F.least(f"min_{t}", edge)).alias(f"min_{t}"),
            ]
        slices = slices.groupBy(*keys).agg(*merged)
    out = []
    for t in tracks:
        n = F.col(f"n_{t}") - 1
        span = (F.col(f"last_{t}") - F.col(f"first_{t}")).cast(dec)
        spread = (n.cast("decimal(19,0)") * F.col(f"sq_{t}").cast("decimal(38,0)") - span * span).cast("double")
        some = n > 0
        zero = F.lit(0.0)
        out += [
            F.col(f"n_{t}").alias(f"{t}_n"),
            F.when(some, span.cast("double") / n / F.lit(1e6)).otherwise(zero).alias(f"{t}_mean"),
            F.when(some, F.sqrt(F.greatest(spread, zero)) / n / F.lit(1e6)).otherwise(zero).alias(f"{t}_std"),
            F.when(some, F.col(f"max_{t}") / F.lit(1e6)).otherwise(zero).alias(f"{t}_max"),
            F.when(some, F.col(f"min_{t}") / F.lit(1e6)).otherwise(zero).alias(f"{t}_min"),
        ]
    return slices.select(*keys, *out)
