"""Heavy keys stay spread over the tasks, and lookups return what a join returns."""

from pyspark.sql import functions as F

from packetloom.operators import flows, graph
from packetloom.operators.heavy import heavy_keys, lookup


def skewed(spark, n=20_000):
    """Four in five rows under one key, some without a key."""
    key = F.when(F.col("id") % 5 < 4, "hot").when(F.col("id") % 50 == 49, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id") % 97))
    return spark.range(0, n, 1, 8).select("id", key.alias("key"))


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def test_only_the_heavy_key_is_named(spark):
    rows = skewed(spark)
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert heavy_keys(rows, ["key"]) == [hot]
    assert heavy_keys(rows.limit(0), ["key"]) == []
    assert heavy_keys(rows.filter("key <> 'hot'"), ["key"]) == []


def test_lookup_equals_join_and_spreads(spark):
    rows = skewed(spark)
    table = rows.filter("key is not null and key <> 'k3'").groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, rows.join(table, "key", how).collect()), key=str)
        assert sorted(map(tuple, lookup(rows, table, ["key"], how).collect()), key=str) == want
    assert largest_share(rows.join(table.hint("shuffle_hash"), "key")) > 0.7
    assert largest_share(lookup(rows, table, ["key"])) < 0.3


def packets(spark, udp):
    seq = F.lit(None).cast("bigint") if udp else F.col("id") % 9000
    hot = F.col("id") % 5 < 4
    return spark.range(0, 20_000, 1, 8).select(
        F.col("id").alias("pkt_id"), F.col("id").alias("ts_us"), F.when(hot, "10.0.0.1").otherwise(F.concat(F.lit("10.0.1."), F.col("id") % 50)).alias("src_ip"),
        F.lit("10.0.0.2").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(17 if udp else 6).alias("protocol"),
        F.lit(100).cast("bigint").alias("payload_size"), seq.alias("tcp_seq"), F.lit(20).alias("tcp_header_len"), (F.col("id") % 7).cast("int").alias("ttl"))


def test_a_hot_flow_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for udp in (True, False):
            flagged = flows.with_retransmissions(packets(spark, udp))
            assert largest_share(flagged) < 0.4  # four partitions
            assert flagged.filter("is_retransmission").count() == (0 if udp else flagged.groupBy("flow_key", "tcp_seq").count().filter("count > 1").agg(F.sum("count")).first()[0])
        varied = flows.with_ttl_variance(packets(spark, True))
        assert largest_share(varied) < 0.3
        by_hand = packets(spark, True).groupBy("src_ip").agg(F.var_pop("ttl").alias("v"))
        wrong = varied.join(by_hand, "src_ip").filter(F.abs(F.col("v") - F.col("flow_ttl_variance")) > 1e-9)
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_softmax_of_a_hub_and_of_far_scores(spark):
    edges = spark.range(0, 10_000, 1, 8).select(F.lit(1).alias("window_id"), F.when(F.col("id") % 5 < 4, "hub").otherwise(F.concat(F.lit("h"), F.col("id") % 30)).alias("dst_ip"),
                                                ((F.col("id") % 11) * 300.0 - 900.0 + F.col("id") % 3).alias("s"))
    out = graph.edge_softmax(edges, "s")
    assert largest_share(out) < 0.3
    sums = out.groupBy("dst_ip").agg(F.sum("attention").alias("t"), F.max_by("attention", "s").alias("best"), F.count("*").alias("n"))
    assert all(abs(r["t"] - 1) < 1e-9 and r["best"] > 0 for r in sums.collect())
