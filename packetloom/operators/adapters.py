"""Vendor flow schemas mapped to the canonical telemetry schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import clip, col

CANONICAL = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_size", "flag_syn", "flag_ack",
             "flag_rst", "flag_fin", "ttl", "tcp_window", "is_retransmission", "label"]


def protocol_number(text, table: dict[str, int], default: int = 6) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(col(text))), F.lit(default))


def _number(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(float(default)))


def _port(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double").try_cast("int"), F.lit(0))


def from_unsw(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    proto = protocol_number("protocol", fv.PROTOCOL_NUMBERS)
    tcp = proto == 6
    state = F.lower("state")
    label = F.initcap(F.lower(F.trim("attack_label")))
    return df.select(
        *keep, F.col("source_ip").alias("src_ip"), F.col("destination_ip").alias("dst_ip"),
        _port("source_port").alias("src_port"), _port("destination_port").alias("dst_port"), proto.alias("protocol"),
        clip(_number("sbytes", 64) / F.greatest(_number("spkts", 1), F.lit(1.0)), 0.0, 65535.0).alias("payload_size"),
        (tcp & (_number("swin", 0) > 0)).alias("flag_syn"), (tcp & (_number("tcprtt", 0) > 0)).alias("flag_ack"),
        F.coalesce(state == "rst", F.lit(False)).alias("flag_rst"), F.coalesce(state == "fin", F.lit(False)).alias("flag_fin"),
        clip(_number("sttl", 64), 1.0, 255.0).alias("ttl"), _number("swin", 1024).alias("tcp_window"),
        (_number("sloss", 0) > 0).alias("is_retransmission"), label.alias("label"))


def zeek_label(label, detailed, capture) -> Column:
    """Label of a connection record from its capture name, detailed label and plain label."""
    lbl, det = F.trim(col(label)), F.trim(col(detailed))
    cap, low = F.lower(col(capture)), F.lower(F.trim(col(detailed)))

    def detail_or(fallback: str) -> Column:
        return F.when((det != "") & (det != "-"), det).otherwise(F.lit(fallback))

    return (F.when(cap.contains("portscan") | low.contains("portscan"), F.lit("PortScan"))
            .when(cap.contains("malware") | low.contains("botnet") | low.contains("cc"), detail_or("From_Malware"))
            .when(F.lower(lbl).isin("malicious", "attack"), detail_or("Malicious"))
            .otherwise(F.lit("Benign")))


def from_zeek(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    history = F.coalesce("history", F.lit(""))
    size = _number("orig_ip_bytes", 0) + _number("resp_ip_bytes", 0)
    return df.select(
        *keep, F.col("orig_h").alias("src_ip"), F.col("resp_h").alias("dst_ip"),
        _port("orig_p").alias("src_port"), _port("resp_p").alias("dst_port"),
        protocol_number("proto", fv.ZEEK_PROTOCOL_NUMBERS).alias("protocol"), clip(size, 0.0, 65535.0).alias("payload_size"),
        history.rlike("[Ss]").alias("flag_syn"), history.rlike("[AaHh]").alias("flag_ack"),
        history.rlike("[Rr]").alias("flag_rst"), history.rlike("[Ff]").alias("flag_fin"),
        F.lit(64.0).alias("ttl"), F.lit(1024.0).alias("tcp_window"),
        ((_number("missed_bytes", 0) > 0) | (F.regexp_count(history, F.lit("S")) > 1)).alias("is_retransmission"),
        zeek_label("label", "detailedlabel", "capture_file").alias("label"))


# Protocol indicator columns and their ports; a later indicator overrides an earlier one.
INDICATOR_PORTS = [("HTTPS", 443), ("DNS", 53), ("Telnet", 23), ("SSH", 22), ("SMTP", 25), ("IRC", 6667),
                   ("DHCP", 67), ("ICMP", 1)]


def from_iot(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """IoT flow features; the source has no host columns, so none are produced."""
    port = F.lit(80)
    for name, number in INDICATOR_PORTS:
        if name in df.columns:
            port = F.when(F.col(name) > 0, F.lit(number)).otherwise(port)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_flag_number") > 0, F.lit(False))

    return df.select(
        *keep, port.alias("dst_port"), F.coalesce(F.col("protocol_type").cast("int"), F.lit(6)).alias("protocol"),
        clip(F.coalesce("tot_size", F.lit(64.0)), 0.0, 65535.0).alias("payload_size"),
        *[flag(f).alias(f"flag_{f}") for f in ("syn", "ack", "rst", "fin")],
        F.lit(64.0).alias("ttl"), F.lit(1024.0).alias("tcp_window"), flag("cwr").alias("is_retransmission"),
        clip(F.coalesce("iat", F.lit(0.0)) / 1e6, 0.0, 60.0).alias("flow_iat_mean"), "label")
