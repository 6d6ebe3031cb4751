import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.config import WindowSpec
from packetloom.operators import sequences, windows

SPEC = WindowSpec()


def flows_200(spark):
    rows = [(i, 1_000_000_000 + i * 500_000, "10.0.0.1", "10.0.0.2", 80 + i % 3, i * 10, i % 2 == 0, False, i >= 160) for i in range(200)]
    return rows, spark.createDataFrame(rows, "pkt_id int, ts_us bigint, src_ip string, dst_ip string, dst_port int, payload_size bigint, flag_syn boolean, flag_ack boolean, bad boolean")


def test_grid_shape(spark):
    _, df = flows_200(spark)
    g = windows.grid(df, SPEC).orderBy("window_id").collect()
    assert len(g) == 40
    assert all(r.end_us - r.start_us == 5_000_000 for r in g) and all(b.start_us - a.start_us == 2_500_000 for a, b in zip(g, g[1:]))


@pytest.mark.parametrize("spec", [SPEC, WindowSpec(5_000_000, 5_000_000), WindowSpec(7_000_000, 2_000_000), WindowSpec(3, 2)])
def test_assignment_matches_definition(spark, spec):
    rng = random.Random(5)
    ts = sorted({rng.randrange(60 * spec.stride_us) for _ in range(200)} | {0, spec.stride_us, spec.size_us})
    df = spark.createDataFrame([(t,) for t in ts], "ts_us bigint")
    got = {(r.ts_us, r.window_id) for r in windows.assign(df, spec).collect()}
    n = (ts[-1] - ts[0]) // spec.stride_us + 1
    assert got == {(t, i) for t in ts for i in range(n) if i * spec.stride_us <= t - ts[0] < i * spec.stride_us + spec.size_us}


def test_spec_rejects_gaps():
    with pytest.raises(ValueError):
        WindowSpec(1, 2)
    with pytest.raises(ValueError):
        WindowSpec(0, 0)
    with pytest.raises(ValueError):
        WindowSpec(seq_len=0)


def test_targets_never_start_before_inputs_end(spark):
    _, df = flows_200(spark)
    seqs = sequences.build(df, SPEC)
    assert seqs.count() == 31 and sequences.leaks(seqs, SPEC).count() == 0
    broken = seqs.withColumn("input_end_us", F.col("input_end_us"))
    late = sequences.targets(broken, SPEC).withColumn("input_end_us", F.col("input_end_us") + 1)
    assert late.filter(F.col("target_start_us") < F.col("input_end_us")).count() == 31


@pytest.mark.parametrize("spec", [SPEC, WindowSpec(5_000_000, 5_000_000, 3, 2), WindowSpec(7_000_000, 2_000_000, 4, 3)])
def test_graded_and_grounded_targets_brute_force(spark, spec):
    rng = random.Random(11)
    ts = [0] + sorted(rng.randrange(300_000_000) for _ in range(400)) + [300_000_000]
    bad_at = {60_000_000, 61_000_000, 150_000_000, 151_234_567, 300_000_000}
    rows = [(t, 80 + i % 4, i % 7 * 100, i % 3 == 0, False, False) for i, t in enumerate(ts)] + [(t, 22, 5, True, False, True) for t in bad_at]
    df = spark.createDataFrame(rows, "ts_us bigint, dst_port int, payload_size bigint, flag_syn boolean, flag_ack boolean, bad boolean")
    graded = {r.seq_id: r.infil_target for r in sequences.graded_target(df, F.col("bad"), spec).collect()}
    n = 300_000_000 // spec.stride_us + 1 - spec.seq_len + 1
    assert len(graded) == n
    for s in range(n):
        start, end = s * spec.stride_us, s * spec.stride_us + spec.input_span_us
        nxt = min((t for t in bad_at if t >= end), default=None)
        want = 0.0
        if any(start <= t <= end for t in bad_at):
            want = 1.0
        elif nxt is not None and nxt - end <= spec.horizon_us:
            want = 1.0
        elif nxt is not None and nxt - end <= 30_000_000:
            want = math.exp(-(nxt - end) / 1e7)
        assert graded[s] == pytest.approx(want), s
    got = {(r.seq_id, r.k): r for r in sequences.grounded_targets(df, spec).collect()}
    for s in range(0, n, 5):
        for k in range(spec.horizon_k):
            lo = s * spec.stride_us + spec.input_span_us + k * spec.size_us
            inside = [r for r in rows if lo <= r[0] < lo + spec.size_us]
            r = got[(s, k)]
            if not inside:
                assert (r.port_entropy, r.syn_ratio, r.log_bytes) == (0, 0, 0)
                continue
            ports = [x[1] for x in inside]
            ps = [ports.count(p) / len(ports) for p in set(ports)]
            assert r.port_entropy == pytest.approx(-sum(p * math.log2(p + 1e-12) for p in ps), abs=1e-9)
            assert r.syn_ratio == pytest.approx(sum(x[3] for x in inside) / len(inside))
            assert r.log_bytes == pytest.approx(math.log1p(sum(x[2] for x in inside)))


def test_attack_label_keeps_minority_attack(spark):
    rows = [(i, 0, 0.95) for i in range(95)] + [(95 + i, 4, 0.85) for i in range(5)]
    df = spark.createDataFrame(rows, "ts_us bigint, mitre_stage_id int, mitre_confidence double")
    r = windows.attack_label(df, SPEC).collect()
    assert [(x.stage, x.confidence, x.is_malicious) for x in r] == [(4, pytest.approx(0.85), True)]
    r = windows.attack_label(df.filter("mitre_stage_id = 0"), SPEC).first()
    assert (r.stage, r.is_malicious) == (0, False)


def test_transitions(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 4)], "window_id bigint, stage int")
    got = sorted((r.window_id, r.from_stage, r.to_stage) for r in windows.stage_transitions(df).collect())
    assert got == [(0, 1, 1), (1, 1, 3), (2, 3, 4)]


def test_whole_span_fallback_and_padding(spark):
    df = spark.createDataFrame([(10,), (20,)], "ts_us bigint")
    assert [(r.start_us, r.end_us) for r in windows.grid_complete_only(df, SPEC).collect()] == [(10, 20)]
    pad = sequences.padded(windows.grid(df, SPEC), SPEC).orderBy("pos").collect()
    assert [r.pos for r in pad] == list(range(10)) and {r.window_id for r in pad} == {0}


def test_captures_of_different_clocks_are_their_union(spark):
    first = [(i * 1_300_000, i) for i in range(60)]
    one = spark.createDataFrame([("a", t, i) for t, i in first], "capture string, ts_us bigint, i int")
    two = spark.createDataFrame([("b", 10**12 + 7 * t, i) for t, i in first] + [("c", 5, 0)], "capture string, ts_us bigint, i int")
    both = one.unionByName(two)
    grids = sorted(tuple(r) for r in windows.scoped_grid(both, ["capture"], SPEC).collect())
    single = [(c, *r) for c in "abc" for r in windows.grid(both.filter(f"capture = '{c}'"), SPEC).collect()]
    assert grids == sorted(tuple(r) for r in single)
    rows = sorted(tuple(r) for r in windows.scoped_assign(both, ["capture"], SPEC).select("capture", "i", "window_id").collect())
    apart = [(c, r.i, r.window_id) for c in "abc" for r in windows.assign(both.filter(f"capture = '{c}'"), SPEC).collect()]
    assert rows == sorted(apart)
    seqs = sequences.scoped_build(both, ["capture"], SPEC).orderBy("seq_id").collect()
    assert [r.seq_id for r in seqs] == list(range(len(seqs)))
    for c in "abc":
        alone = sequences.build(both.filter(f"capture = '{c}'"), SPEC).orderBy("seq_id").collect()
        assert [(r.first_window, r.input_end_us) for r in seqs if r.capture == c] == [(r.first_window, r.input_end_us) for r in alone]
    pad = {r.pos: r.window_id for r in sequences.scoped_padded(both, ["capture"], SPEC).filter("capture = 'c'").collect()}
    assert pad == {i: 0 for i in range(10)}
