"""Host ids over several runs."""

from packetloom.operators import graph, registry

SCHEMA = "ts_us bigint, src_ip string, dst_ip string"
RUNS = [[(5, "b", "a"), (6, "c", "a")], [(9, "d", "a"), (7, "z", "c")], [(8, "a", "q"), (8, "a", "p")]]


def ids(spark, path):
    return {r["ip"]: r["node_id"] for r in registry.read_registry(spark, path).collect()}


def test_ids_never_change_and_repeats_are_harmless(spark, tmp_path):
    path, before = str(tmp_path / "r"), {}
    assert ids(spark, path) == {}
    for run, rows in enumerate(RUNS):
        for _ in range(2):
            registry.register_hosts(spark.createDataFrame(rows, SCHEMA), path, run)
            now = ids(spark, path)
            assert {ip: now[ip] for ip in before} == before and sorted(now.values()) == list(range(len(now)))
        before = now
    assert before == {"a": 0, "b": 1, "c": 2, "z": 3, "d": 4, "p": 5, "q": 6}


def test_stream_equals_batch(spark, tmp_path):
    source, path = str(tmp_path / "s"), str(tmp_path / "r")
    for rows in RUNS:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    registry.register_stream(stream, path, str(tmp_path / "c")).awaitTermination()
    again = str(tmp_path / "b")
    for run, rows in enumerate(RUNS):
        registry.register_hosts(spark.createDataFrame(rows, SCHEMA), again, run)
    assert ids(spark, path) == ids(spark, again)
    whole = graph.capture_registry(spark.createDataFrame([r for rows in RUNS[:1] for r in rows], SCHEMA))
    assert {r["ip"]: r["node_id"] for r in whole.collect()} == {ip: n for ip, n in ids(spark, path).items() if n < 3}
