import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.config import WindowSpec
from packetloom.operators import graph, labels, topology, whatif, windows

SPEC = WindowSpec()
SCHEMA = ("pkt_id int, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, payload_size bigint, flag_syn boolean, "
          "flag_ack boolean, flag_rst boolean, flag_fin boolean, is_retransmission boolean, ttl int, tcp_window int")


def window_3(spark):
    rows = [(0, 0, "10.0.0.1", "10.0.0.2", 1, 80, 6, 100, True, False, False, False, False, 64, 1024),
            (1, 10, "10.0.0.1", "10.0.0.3", 1, 443, 6, 200, False, True, False, False, False, 64, 2048),
            (2, 20, "8.8.8.8", "10.0.0.1", 2, 22, 6, 300, True, False, True, False, True, 128, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_small_window(spark):
    df = window_3(spark)
    edges, nodes = graph.edge_features(df, SPEC), graph.node_features(df, SPEC)
    assert edges.count() == 3 and nodes.count() == 4
    assert len(edges.columns) == 3 + 16 and len(nodes.columns) == 2 + 16
    assert windows.snapshot_dynamics(df, SPEC).first().log_bytes > 0
    e = {(r.src_ip, r.dst_ip): r for r in edges.collect()}[("8.8.8.8", "10.0.0.1")]
    assert (e.is_internal, e.mean_tcp_window, e.mean_ttl, e.retransmission_rate) == (0.0, 1024.0, 128.0, 1.0)
    n = {r.ip: r for r in nodes.collect()}
    assert n["10.0.0.1"].peers_out == 2 and n["10.0.0.1"].port_entropy == pytest.approx(1.0, abs=1e-9)
    assert n["8.8.8.8"].tcp_window_norm == 0.0 and n["10.0.0.2"].tcp_window_norm == pytest.approx(1024 / 65535)
    assert n["10.0.0.2"].ttl_norm == pytest.approx(64 / 255)


def test_edges_and_nodes_against_brute_force(spark):
    rng = random.Random(2)
    ips = ["10.0.0.1", "10.0.0.2", "8.8.8.8", "192.168.1.9"]
    rows = [(i, rng.randrange(12_000_000), rng.choice(ips), rng.choice(ips), rng.randrange(4), rng.choice([22, 80, 443]), 6, rng.randrange(2000),
             rng.random() < .5, rng.random() < .5, rng.random() < .2, rng.random() < .2, rng.random() < .2, rng.choice([32, 64, 128]),
             rng.choice([None, 512, 4096])) for i in range(300)]
    rows.append((300, 0, ips[0], ips[1], 1, 80, 6, 1, False, False, False, False, False, 64, 512))
    df = spark.createDataFrame(rows, SCHEMA)
    wins = {}
    for r in rows:
        for w in range(0, 5):
            if w * 2_500_000 <= r[1] < w * 2_500_000 + 5_000_000:
                wins.setdefault(w, []).append(r)
    got = {(r.window_id, r.src_ip, r.dst_ip): r for r in graph.edge_features(df, SPEC).collect()}
    seen = set()
    for w, rs in wins.items():
        for s in ips:
            for d in ips:
                mine = [r for r in rs if r[2] == s and r[3] == d]
                if not mine:
                    continue
                seen.add((w, s, d))
                g = got[(w, s, d)]
                ts = sorted(r[1] for r in mine)
                gaps = [(b - a) / 1e6 for a, b in zip(ts, ts[1:])]
                back = sum(1 for r in rs if r[2] == d and r[3] == s)
                ttl = [r[13] for r in mine]
                win = [r[14] for r in mine if r[14] is not None]
                n = len(mine)
                want = [math.log1p(n), math.log1p(sum(r[7] for r in mine)), *[sum(r[i] for r in mine) / n for i in (8, 9, 10, 11, 12)],
                        len({r[5] for r in mine}), statistics.fmean(ttl), statistics.stdev(ttl) if n > 1 else 0.0,
                        statistics.fmean(win) if win else 1024.0, 0.0 if s == "8.8.8.8" else 1.0,
                        statistics.fmean(gaps) if gaps else 0.0, statistics.pstdev(gaps) if gaps else 0.0, max(gaps, default=0.0), n / (n + back)]
                assert [g[c] for c in fv.EDGE_FEATURES] == pytest.approx(want, abs=1e-7)
    assert seen == set(got)
    nodes = {(r.window_id, r.ip): r for r in graph.node_features(df, SPEC).collect()}
    for w, rs in wins.items():
        for ip in ips:
            out, inn = [r for r in rs if r[2] == ip], [r for r in rs if r[3] == ip]
            if not out and not inn:
                continue
            g = nodes[(w, ip)]
            ttl = [r[13] for r in (out or inn)]
            assert g.log_out == pytest.approx(math.log1p(len(out))) and g.log_in == pytest.approx(math.log1p(len(inn)))
            assert g.peers_out == len({r[3] for r in out}) and g.peers_in == len({r[2] for r in inn})
            assert g.log_ttl_var == pytest.approx(math.log1p(statistics.variance(ttl) if len(ttl) > 1 else 0.0), abs=1e-9)
            assert g.avg_size == pytest.approx(sum(r[7] for r in out) / max(len(out), 1) / 1500)


def test_softmax_sums_to_one(spark):
    df = window_3(spark)
    soft = graph.edge_softmax(graph.edge_features(df, SPEC), "log_byte_volume")
    for r in soft.groupBy("window_id", "dst_ip").agg(F.sum("attention").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_softmax_sums_to_one_with_far_apart_scores(spark):
    edges = spark.createDataFrame([(0, "a", "x", 1000.0), (0, "a", "y", 1.0), (0, "b", "y", 1.0)], "window_id int, src_ip string, dst_ip string, s double")
    got = {(r.src_ip, r.dst_ip): r.attention for r in graph.edge_softmax(edges, "s").collect()}
    assert got == {("a", "x"): pytest.approx(1.0), ("a", "y"): pytest.approx(0.5), ("b", "y"): pytest.approx(0.5)}


def test_flow_rows_get_defaults(spark):
    flows = spark.createDataFrame([(0, "10.0.0.1", "10.0.0.2", 80, 500), (1, "10.0.0.2", "10.0.0.1", 9, 50)], "ts_us bigint, src_ip string, dst_ip string, dst_port int, payload_size bigint")
    for r in graph.edge_features(flows, SPEC).collect():
        assert (r.mean_ttl, r.mean_tcp_window, r.syn_ratio, r.bidi_ratio) == (64.0, 1024.0, 0.0, 0.5)


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 5.0), ("a", "c", 3.0, 5.0)], "src_ip string, dst_ip string, x double, y double")
    out = graph.log_standardize(df, ["x", "y"]).orderBy("dst_ip").collect()
    assert [r.y for r in out] == [0.0, 0.0] and [r.x for r in out] == pytest.approx([-1.0, 1.0])
    mean = {r.ip: r for r in graph.incident_mean(df, ["x"]).collect()}
    assert (mean["a"].out_x, mean["a"].in_x, mean["b"].in_x, mean["b"].out_x) == (2.0, 0.0, 1.0, 0.0)


# -- what-if ---------------------------------------------------------------------------------------


def cf_graph(spark):
    ips = ["10.0.0.1", "10.0.0.2", "10.0.0.3", "192.168.1.4", "192.168.1.5"]
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]
    edges = spark.createDataFrame([(w, ips[a], ips[b], 1.0, 2.0) for w in range(5) for a, b in pairs], "window_id bigint, src_ip string, dst_ip string, f0 double, f1 double")
    nodes = spark.createDataFrame([(w, ip, 1.0) for w in range(5) for ip in ips], "window_id bigint, ip string, x double")
    dyn = spark.createDataFrame([(w, 2.5, 0.75, 8.2) for w in range(5)], "window_id bigint, port_entropy double, syn_ratio double, log_bytes double")
    return edges, nodes, dyn


def test_isolation(spark):
    edges, nodes, dyn = cf_graph(spark)
    out = whatif.isolate_host(edges, nodes, dyn, "10.0.0.1")
    d = out["dynamics"].collect()
    assert all(r.severed == 2 and r.syn_ratio == pytest.approx(0.15) and r.log_bytes == pytest.approx(6.7) for r in d)
    assert out["edges"].count() == 15
    assert out["nodes"].filter("ip = '10.0.0.1'").agg(F.max("x")).first()[0] == 0.0
    same = whatif.isolate_host(edges, nodes, dyn, "1.2.3.4")["dynamics"].collect()
    assert all(r.severed == 0 and r.syn_ratio == 0.75 for r in same)


def test_segment_honeypot_and_limit(spark):
    edges, nodes, dyn = cf_graph(spark)
    assert [r.severed for r in whatif.segment_subnet(edges, "10.0.")["severed"].collect()] == [1] * 5
    pot = whatif.honeypot(edges, "10.0.0.3")
    assert [r.severed for r in pot["severed"].collect()] == [2] * 5
    assert pot["edges"].filter("dst_ip = '10.0.0.3'").agg(F.max("f1")).first()[0] == pytest.approx(0.2)
    lim = whatif.rate_limit(edges, dyn, 0.5)["dynamics"].first()
    assert lim.mitigated_edges == 2 and lim.syn_ratio == pytest.approx(0.375)


def test_trajectory_and_impact(spark):
    df = spark.createDataFrame([(0.8, 0.4)], "r double, c double")
    t = df.select(whatif.trajectory("r", "c").alias("t")).first().t
    assert [x.baseline for x in t] == [0.8, 0.84, 0.88, 0.92]
    assert [x.counterfactual for x in t] == pytest.approx([max(.02, .4 * (.3 + .7 * math.exp(-.8 * (k + 1)))) for k in range(4)], abs=6e-4)
    acts = spark.createDataFrame([("isolate_host", 0.1), ("block_port", 0.1), ("rate_limit", 0.9), ("segment_subnet", 0.9)], "k string, c double")
    assert [r.i for r in acts.select(whatif.business_impact("k", "c").alias("i")).collect()] == [0.35, 0.1, 0.15, 0.9]


def test_evaluate_and_rank(spark):
    rng = random.Random(4)
    ips = ["10.0.0.1", "10.0.0.2", "8.8.8.8"]
    rows = [(i, i * 200_000, rng.choice(ips), rng.choice(ips), 40000, rng.choice([80, 445]), 6, rng.randrange(9000), True, False, False, False, False, 64, 512)
            for i in range(200)]
    p = labels.with_heuristic_stage(spark.createDataFrame(rows, SCHEMA))
    ends = windows.assign(p, SPEC).select("window_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    from packetloom.operators import sequences
    out = whatif.evaluate(p, whatif.candidates(ends), sequences.sequence_stage(p, SPEC), SPEC)
    assert out.filter("recalculated_risk > original_risk").count() == 0
    per = {r.seq_id: r.n for r in out.groupBy("seq_id").agg(F.count("*").alias("n")).collect()}
    assert set(per.values()) == {3 + 4 + 1}
    ranked = whatif.rank(out, 8).collect()
    for s in per:
        scores = [r.net_score for r in sorted((r for r in ranked if r.seq_id == s), key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True)
    assert out.filter("target = '22' and severed > 0").count() == 0


# -- topology --------------------------------------------------------------------------------------


def test_pivot_rules_and_roles(spark):
    schema = "ip string, out_degree bigint, in_degree bigint, pkts bigint, ports array<int>"
    inner = spark.createDataFrame([("10.0.0.1", 1, 1, 9, [80]), ("10.0.0.5", 7, 1, 5, []), ("10.0.0.100", 2, 1, 4, [53])], schema)
    seg = {r.ip: r.segment for r in topology.segment_hosts(inner).collect()}
    assert seg == {"10.0.0.1": "corporate", "10.0.0.5": "dmz", "10.0.0.100": "corporate"}
    outer = spark.createDataFrame([("8.8.8.8", 1, 1, 9, [80]), ("1.1.1.1", 7, 1, 5, [22])], schema)
    assert {r.ip: r.segment for r in topology.segment_hosts(outer).collect()} == {"8.8.8.8": "dmz", "1.1.1.1": "corporate"}
    fin = spark.createDataFrame([("203.0.113.7", 1, 1, 9, [80]), ("10.0.0.105", 1, 1, 8, []), ("10.0.0.125", 1, 1, 7, []), ("10.0.0.9", 1, 1, 6, [1, 2, 3, 4, 5, 6])], schema)
    roles = {r.ip: r for r in topology.host_roles(topology.segment_hosts(fin)).collect()}
    assert roles["203.0.113.7"].name == "EXT-APT29-C2" and roles["10.0.0.105"].status == "targeted" and roles["10.0.0.125"].status == "elevated"
    assert roles["10.0.0.9"].shown_ports == [1, 2, 3, 4, 5] and roles["10.0.0.9"].open_ports == [1, 2, 3, 4, 5, 6] and roles["10.0.0.105"].open_ports == [445, 135]
    alone = topology.host_roles(topology.segment_hosts(fin.filter("ip <> '10.0.0.105'")))
    assert {r.ip: r.status for r in alone.collect()}["10.0.0.125"] == "targeted"


def test_packets_are_scanned_once_and_never_copied_into_windows(spark):
    df = spark.range(4000).select(F.col("id").alias("ts_us"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(1000).alias("payload_size"))
    plan = graph.edge_features(df, SPEC)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Range (" in line]
    assert len(scans) == 2  # the packets, and their time origin as a scalar
    top = plan.splitlines()
    explode = next(i for i, line in enumerate(top) if "explode(sequence(" in line)
    assert sum("Aggregate" in line for line in top[explode:] if "scalar" not in line) >= 2  # both steps of the pane summary lie below


@pytest.mark.parametrize("size, stride", [(5_000_000, 2_500_000), (3_000_000, 2_000_000), (4_000_000, 4_000_000), (6_000_000, 1_000_000)])
def test_gaps_of_panes_merge_into_windows(spark, size, stride):
    rng = random.Random(size + stride)
    rows = [(rng.randrange(12_000_000) // 1000 * 1000, rng.choice("ab"), "c", rng.randrange(5)) for _ in range(120)] + [(0, "a", "c", 1), (None, "a", "c", 1), (5, None, "c", 2)] * 2
    df = spark.createDataFrame(rows, "ts_us bigint, src_ip string, dst_ip string, dst_port int")
    got = {(r.window_id, r.src_ip): r for r in graph.edge_features(df, WindowSpec(size_us=size, stride_us=stride)).collect()}
    want = {}
    for w in range(13):
        for ip in "ab":
            own = sorted((t, p) for t, s, _, p in rows if t is not None and s == ip and w * stride <= t < w * stride + size)
            if own:
                want[w, ip] = own
    assert set(got) == set(want)
    for key, own in want.items():
        gaps = [(b - a) / 1e6 for (a, _), (b, _) in zip(own, own[1:])]
        r = got[key]
        assert r.unique_dst_ports == len({p for _, p in own}) and r.log_packet_count == pytest.approx(math.log1p(len(own)))
        assert (r.iat_mean, r.iat_std, r.iat_max) == pytest.approx((statistics.fmean(gaps) if gaps else 0, statistics.pstdev(gaps) if gaps else 0, max(gaps, default=0)))
