import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows, ordering

SCHEMA = ("pkt_id bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, payload_size bigint, "
          "flag_syn boolean, flag_ack boolean, flag_rst boolean, flag_fin boolean, label string")
A, B = ("192.168.1.10", 50000), ("10.0.0.1", 80)


def packets_4(spark):
    rows = []
    for i, (t, fwd, size, syn, ack) in enumerate([
            (100.0, True, 100, True, False), (100.1, False, 500, True, True), (100.3, True, 200, False, True), (100.6, False, 1000, False, True)]):
        (si, sp), (di, dp) = (A, B) if fwd else (B, A)
        rows.append((i, int(t * 1e6), si, sp, di, dp, 6, size, syn, ack, False, False, "benign"))
    return spark.createDataFrame(rows, SCHEMA)


def test_both_directions_share_one_flow(spark):
    row = flows.flow_table(packets_4(spark)).collect()
    assert len(row) == 1
    f = row[0]
    assert f.flow_key == "10.0.0.1:80<->192.168.1.10:50000:6"
    assert (f.tot_pkts, f.tot_bytes, f.flag_syn, f.flag_ack) == (4, 1800, 2, 3)
    assert f.flow_duration == pytest.approx(0.6) and f.flow_iat_max == pytest.approx(0.3)
    assert (f.src_ip, f.dst_ip, f.label) == ("192.168.1.10", "10.0.0.1", "benign")
    assert f.fwd_iat_mean == pytest.approx(0.5) and f.bwd_iat_mean == pytest.approx(0.3)


def test_null_ports_group_together(spark):
    rows = [(i, i, "1.1.1.1", None, "2.2.2.2", None, 1, 10, False, False, False, False, "x") for i in range(3)]
    out = flows.flow_volume(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.flow_key, r.tot_pkts) for r in out] == [("1.1.1.1:0<->2.2.2.2:0:1", 3)]


@pytest.mark.parametrize("bucket", [1_000, 50_000, None])
def test_gap_stats_match_brute_force(spark, bucket):
    """Ties, single rows, gaps inside and across buckets, and one key with most of the rows."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}", rng.randrange(400_000) // 3 * 3, rng.random() < 0.5) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts_us bigint, side boolean")
    got = {r.key: r for r in ordering.gap_stats(df, ["key"], tracks={"g": F.lit(True), "s": F.col("side")}, bucket_us=bucket).collect()}
    for key in {r[0] for r in rows}:
        for track, keep in (("g", lambda r: True), ("s", lambda r: r[2])):
            ts = sorted(r[1] for r in rows if r[0] == key and keep(r))
            gaps = [b - a for a, b in zip(ts, ts[1:])]
            r = got[key]
            assert r[f"{track}_n"] == len(ts)
            assert r[f"{track}_mean"] * 1e6 == pytest.approx(statistics.fmean(gaps))
            assert r[f"{track}_std"] * 1e6 == pytest.approx(statistics.pstdev(gaps), rel=1e-9)
            assert r[f"{track}_max"] * 1e6 == pytest.approx(max(gaps)) and r[f"{track}_min"] * 1e6 == pytest.approx(min(gaps))


def test_idle_split_is_strict(spark):
    def pkt(i, t):
        return (i, t, *A, *B, 6, 1, False, False, False, False, "x")
    df = spark.createDataFrame([pkt(0, 0), pkt(1, 120_000_000), pkt(2, 240_000_001)], SCHEMA)
    out = {r.segment: r.tot_pkts for r in flows.flow_idle_segments(df).collect()}
    assert out == {0: 2, 1: 1}


def test_retransmission_needs_data_twice(spark):
    rows = [(0, "a", 1, "b", 2, 6, 20, 7, 20), (1, "a", 1, "b", 2, 6, 20, 7, 20), (2, "a", 1, "b", 2, 6, 120, 9, 20), (3, "a", 1, "b", 2, 6, 120, 9, 20),
            (4, "a", 1, "b", 2, 6, 120, None, None)]
    df = spark.createDataFrame(rows, "pkt_id int, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, payload_size bigint, tcp_seq bigint, tcp_header_len int")
    flag = {r.pkt_id: r.is_retransmission for r in flows.with_retransmissions(df).collect()}
    assert flag == {0: False, 1: False, 2: True, 3: True, 4: False}
    loose = {r.pkt_id: r.is_retransmission for r in flows.with_retransmissions(df, require_data=False).collect()}
    assert loose == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_flow_packets_add_up(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(10**9), f"10.0.0.{rng.randrange(5)}", rng.randrange(3), f"10.0.0.{rng.randrange(5)}", rng.randrange(3), 6, 1,
             False, False, False, False, "x") for i in range(500)]
    out = flows.flow_volume(spark.createDataFrame(rows, SCHEMA))
    assert out.agg(F.sum("tot_pkts")).first()[0] == 500
    assert out.filter("tot_fwd_pkts + tot_bwd_pkts <> tot_pkts").count() == 0
