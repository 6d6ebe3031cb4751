from pyspark.sql import functions as F

from packetloom.operators import flows, labels
from packetloom.streaming import live

SCHEMA = ("pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, payload_size bigint, flag_syn boolean, "
          "flag_ack boolean, flag_rst boolean")
END = 10_000_000_000


def write(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def packet(i, t, src="10.0.0.1", dst="8.8.8.8", port=443, size=10):
    return (i, t, src, dst, 40000, port, 6, size, True, False, False)


def drain(spark, tmp_path, make, parts):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, parts)
    stream = make(live.with_event_time(live.replay(spark, src, spark.read.parquet(src).schema, 1)))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def batches():
    first = [packet(i, i * 1_000_000, port=[80, 443, 4444][i % 3], size=i * 100) for i in range(30)]
    second = [packet(100 + i, 200_000_000 + i * 1_000_000, src="10.0.0.2") for i in range(10)]
    return [first, second, [packet(999, END)]]


def test_labels_equal_batch(spark, tmp_path):
    out, _ = drain(spark, tmp_path, live.label_stream, batches())
    flat = spark.createDataFrame([r for b in batches() for r in b], SCHEMA)
    want = {r.pkt_id: r.mitre_stage_id for r in labels.with_heuristic_stage(flat).collect()}
    assert {r.pkt_id: r.mitre_stage_id for r in out.collect()} == want


def test_sessions_equal_batch_segments(spark, tmp_path):
    out, _ = drain(spark, tmp_path, live.flow_sessions, batches())
    flat = spark.createDataFrame([r for b in batches()[:2] for r in b], SCHEMA)
    want = sorted((r.flow_key, r.start_us, r.tot_pkts) for r in flows.flow_idle_segments(flat).collect())
    assert sorted((r.flow_key, r.start_us, r.tot_pkts) for r in out.collect()) == want


def test_tumbling_entropy(spark, tmp_path):
    out, _ = drain(spark, tmp_path, live.tumbling_targets, batches())
    r = {x.start_us: x for x in out.collect()}[0]
    assert r.n == 5 and abs(r.port_entropy - 1.521928) < 1e-5 and r.syn_ratio == 1.0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # a trigger filters late rows by the watermark its predecessor started with
    parts = [[packet(0, 100_000_000)], [packet(4, 100_500_000)], [packet(1, 1_000_000), packet(2, 101_000_000)], [packet(3, END)]]
    out, q = drain(spark, tmp_path, live.late_report, parts)
    assert {r.start_us: r.n for r in out.collect()} == {100_000_000: 3} and live.dropped_rows(q) == 1


def test_dedupe_keeps_one(spark, tmp_path):
    key = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts_us"]
    parts = [[packet(0, 5), packet(1, 5)], [packet(2, 5)], [packet(3, 6)]]
    out, _ = drain(spark, tmp_path, lambda s: live.dedupe_stream(s, key).select("ts_us"), parts)
    assert sorted(r.ts_us for r in out.collect()) == [5, 6]


def test_host_memory_matches_batch(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [("a", 0, 4.0), ("b", 0, 1.0), ("a", 5, 8.0), ("a", 20, 2.0)]
    schema = "ip string, start_us bigint, value double"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(path)
    stream = live.host_memory(live.replay(spark, path, spark.read.parquet(path).schema, 1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.schema(stream.schema).parquet(str(tmp_path / "o")).groupBy("ip").agg(F.max_by("memory", "n_windows").alias("m")).collect()
    batch = live.host_memory_batch(spark.createDataFrame(rows, schema)).collect()
    assert {r.ip: r.m for r in last} == {r.ip: r.memory for r in batch} == {"a": 0.5 * 2 + 0.25 * 8 + 0.125 * 4, "b": 0.5}
