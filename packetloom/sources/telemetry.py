"""Packet view over the generic ``events`` stream table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the packet view: services by props.k % 12 and the label bands by event_id % 400.
SERVICE_PORTS = [80, 443, 22, 445, 3389, 4444, 53, 8080, 88, 502, 21, 5432]
TCP_WINDOWS = [1024, 8192, 65535]
LABEL_BANDS = [
    (240, " Benign "),
    (255, "PortScan"),
    (270, "DoS attacks-Slowloris "),
    (285, "SSH-Bruteforce"),
    (300, "Infilteration"),
    (315, "flow=From-Botnet-V42-TCP-CC1-HTTP-Not-Encrypted"),
    (325, "exfiltration"),
    (335, "StrangeVariant_XYZ"),
]
LABEL_REST = "benign"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def packets_from_events(events: DataFrame) -> DataFrame:
    """Project events to the packet schema; one narrow stage, no shuffle."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"),
        F.col("event_type").alias("t"), "value", k.alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    u, k, e, t = (F.col(c) for c in "uket")
    client = F.when(u % 10 == 0, F.concat(F.lit("203.0.113."), u % 250)).otherwise(
        F.concat(F.lit("10.0."), u % 4, F.lit("."), u % 250))
    server = F.when(k % 5 == 0, F.concat(F.lit("198.51.100."), k)).otherwise(
        F.concat(F.lit("10.0."), k % 4, F.lit("."), k))
    cport = (F.lit(40000) + u % 3).cast("int")
    sport = _pick(k % 12, SERVICE_PORTS)
    back = t == "view"
    udp = t == "signup"
    label = F.lit(LABEL_REST)
    for bound, name in reversed(LABEL_BANDS):
        label = F.when(e % 400 < bound, F.lit(name)).otherwise(label)
    return base.select(
        e.alias("pkt_id"),
        F.floor(F.col("us") / F.lit(500.0)).cast("bigint").alias("ts_us"),
        F.when(back, server).otherwise(client).alias("src_ip"),
        F.when(back, sport).otherwise(cport).alias("src_port"),
        F.when(back, client).otherwise(server).alias("dst_ip"),
        F.when(back, cport).otherwise(sport).alias("dst_port"),
        F.when(udp, F.lit(17)).otherwise(F.lit(6)).alias("protocol"),
        F.when((t == "error") & (k % 2 == 0), F.lit(0).cast("bigint"))
        .otherwise(F.floor(F.col("value") * 200.0).cast("bigint")).alias("payload_size"),
        t.isin("click", "error").alias("flag_syn"),
        t.isin("purchase", "view").alias("flag_ack"),
        (t == "error").alias("flag_rst"),
        ((t == "purchase") & (k % 7 == 0)).alias("flag_fin"),
        F.when(u % 3 == 0, F.lit(128)).otherwise(F.lit(64) - (e % 3).cast("int")).alias("ttl"),
        F.when(~udp, _pick(k % 3, TCP_WINDOWS)).alias("tcp_window"),
        F.when(~udp, k * 1000 + e % 2).alias("tcp_seq"),
        F.when(~udp, F.lit(20)).alias("tcp_header_len"),
        label.alias("label"),
        u.alias("user_id"), k.alias("k"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))
