import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import ordering, sampling
from packetloom.functions.columns import seeded_hash


def skewed(spark, n=2000):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(50), rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, grp string, v int, x double")


def test_positions_over_whole_table_and_groups(spark):
    rows, df = skewed(spark)
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    got = {r.id: r.position for r in ordering.positions(df, ["v", "id"]).collect()}
    assert got == want
    got = {r.id: r.position for r in ordering.positions(df, ["v", "id"], within=["grp"]).collect()}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[m[0]] for m in members] == list(range(len(members)))


def test_exact_quantiles_match_numpy(spark):
    rows, df = skewed(spark)
    df = df.withColumn("x", F.when(F.col("id") % 97 == 0, F.lit(float("inf"))).when(F.col("id") % 89 == 0, F.lit(None)).otherwise(F.col("x")))
    xs = [r[3] for r in rows if r[0] % 97 and (r[0] % 89)]
    got = {r.column: r for r in ordering.exact_quantiles(df, ["v", "x"], [0.5, 0.99]).collect()}
    assert got["x"].n == len(xs) and got["x"].q0 == pytest.approx(np.quantile(xs, 0.5)) and got["x"].q1 == pytest.approx(np.quantile(xs, 0.99))
    vs = [r[2] for r in rows]
    assert got["v"].q0 == pytest.approx(np.quantile(vs, 0.5)) and got["v"].q1 == pytest.approx(np.quantile(vs, 0.99))


def test_hash_sample_is_exact(spark):
    rows, df = skewed(spark)
    hashed = df.withColumn("h", seeded_hash(42, "id"))
    hs = {r.id: r.h for r in hashed.collect()}
    got = {}
    for r in ordering.first_n_by_hash(hashed, ["grp"], "h", "id", 40).collect():
        got.setdefault(r.grp, set()).add(r.id)
    for g in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == g), key=lambda i: (hs[i], i))
        assert got[g] == set(ids[:40])


def test_first_n_and_head_rows(spark):
    rows, df = skewed(spark)
    got = {}
    for r in ordering.first_n(df, ["grp"], ["v", "id"], 7, salt=F.col("id")).collect():
        got.setdefault(r.grp, set()).add(r.id)
    for g in {r[1] for r in rows}:
        assert got[g] == {r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[:7]}
    near = {r.id for r in ordering.head_rows(df, "id", 100).collect()}
    assert set(range(100)) <= near and len(near) < 300
    ties = {r.id for r in ordering.head_rows(df, "v", 100).collect()}
    assert {r[0] for r in sorted(rows, key=lambda r: r[2])[:100]} <= ties


def test_temporal_split_bounds(spark):
    b = sampling.temporal_bounds(100, sampling.SplitSpec(buffer=5))
    assert b == {"train": (0, 70), "val": (75, 90), "test": (95, 100)}
    for n in range(0, 60):
        b = sampling.temporal_bounds(n)
        spans = [set(range(*b[k])) for k in ("train", "val", "test")]
        assert sum(map(len, spans)) == len(set().union(*spans))
        if n > 5:  # at five rows the guard has already spent the training rows it may lend
            assert all(spans)


def test_unseen_split_holds_out_whole_stage(spark):
    df = spark.createDataFrame([(i, 6 if i % 10 == 0 else i % 3) for i in range(100)], "id int, stage int")
    out = sampling.split_unseen(df, ["id"], F.col("stage") == 6, buffer=5)
    rows = {(r.split): r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert rows["test"] == 10 and rows["train"] == 76 and rows["buffer"] == 5 and rows["val"] == 9
    assert out.filter("split <> 'test' and stage = 6").count() == 0


def test_keys_at_ranks(spark):
    rows, df = skewed(spark)
    order = sorted((r[2], r[0]) for r in rows)
    got = ordering.keys_at_ranks(df, "v", "id", [0, 1, 777, 1999, 2000], bins=16)
    assert got == {k: order[k] for k in (0, 1, 777, 1999)}


@pytest.mark.parametrize("n", [1, 2, 7, 19, 50, 3000])
def test_quantiles_on_small_and_tied_columns(spark, n):
    xs = [float((i * 7919) % max(n // 2, 1)) for i in range(n)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    qs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    r = ordering.exact_quantiles(df, ["x"], qs).first()
    assert [r[f"q{i}"] for i in range(len(qs))] == pytest.approx(np.quantile(xs, qs).tolist())


def test_random_split_sizes(spark):
    out = sampling.split_random(spark.range(1001), "id")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 151}


@pytest.mark.parametrize("n", [1, 3, 5, 6, 20, 100])
def test_temporal_split_rows(spark, n):
    spec = sampling.SplitSpec(buffer=5)
    df = spark.range(n).select((F.col("id") * 3 + 7).alias("ts"))
    got = {(r.ts - 7) // 3: r.split for r in sampling.split_temporal(df, ["ts"], spec).collect()}
    want = {i: name for name, (lo, hi) in sampling.temporal_bounds(n, spec).items() for i in range(lo, hi)}
    assert got == {i: want.get(i, "buffer") for i in range(n)}


def test_null_group_is_a_group(spark):
    df = spark.range(40).selectExpr("id", "if(id % 2 = 0, 'a', null) as g", "xxhash64(id) & 9223372036854775807 as h")
    out = ordering.first_n_by_hash(df, ["g"], "h", "id", 5).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in out} == {"a": 5, None: 5}


def test_head_rows_with_one_outlier(spark):
    df = spark.range(100_000).selectExpr("if(id = 0, 0, 1700000000000000 + id * 1000) as t")
    near = ordering.head_rows(df, "t", 500)
    assert 500 <= near.count() < 100_000 and near.orderBy("t").limit(500).collect() == df.orderBy("t").limit(500).collect()
