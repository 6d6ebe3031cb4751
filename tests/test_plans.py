import random

from pyspark.sql import functions as F

from packetloom.plans import capture_report, training_set
from tests.test_flows import SCHEMA as FLOW_SCHEMA
from tests.test_sources import capture, eth, tcp, udp


def test_training_set(spark, tmp_path):
    rng = random.Random(9)
    ips = ["10.0.0.1", "10.0.0.2", "8.8.8.8"]
    rows = [(i, i * 150_000, rng.choice(ips), 40000, rng.choice(ips), rng.choice([80, 445]), 6, rng.randrange(500), True, False, False, False,
             "Benign" if i % 9 else "PortScan", 64, 512, i, 20) for i in range(600)]
    df = spark.createDataFrame(rows, FLOW_SCHEMA + ", ttl int, tcp_window int, tcp_seq bigint, tcp_header_len int")
    out = training_set.build(training_set.label_packets(df, str(tmp_path / "p")))
    n_windows = 599 * 150_000 // 2_500_000 + 1
    assert out["windows"].count() == n_windows
    splits = {r.split: r.n for r in out["samples"].groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(splits.values()) == n_windows - 9 and {"train", "test"} <= set(splits)
    assert out["samples"].filter(F.size("grounded") != 4).count() == 0
    assert out["edges"].select("window_id").distinct().count() == n_windows == out["nodes"].select("window_id").distinct().count()


def test_capture_report(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(capture([eth(tcp(1)), eth(tcp(2, 0x10, b"data")), eth(udp())])))], "path string, content binary")
    flows = capture_report.flow_rows(files, str(tmp_path / "f"))
    assert sorted((r.tot_pkts, r.protocol) for r in flows.collect()) == [(1, 17), (2, 6)]
    out = capture_report.build(flows, F.lit(0.9))
    assert {r.ip: r.segment for r in out["hosts"].collect()} == {"10.0.0.1": "corporate", "8.8.8.8": "dmz"}
    assert out["signature"].first().has_445 and out["edges"].first().edge_type == "attack"
