"""Vendor-style records derived from packets, in Spark and in SQL."""

from pyspark.sql import functions as F

from catalog.common import PACKETS
from packetloom.sources.telemetry import packets

# UNSW-style record columns as expressions valid in both engines.
UNSW_EXPR = {
    "rec_id": "pkt_id", "source_ip": "src_ip", "destination_ip": "dst_ip",
    "source_port": "CAST(src_port AS STRING)",
    "destination_port": "CASE WHEN k % 11 = 0 THEN 'x50' ELSE CAST(dst_port AS STRING) END",
    "protocol": "CASE WHEN protocol = 17 THEN 'UDP' WHEN k % 13 = 0 THEN 'OSPF' WHEN k % 17 = 0 THEN 'sctp' ELSE 'tcp' END",
    "state": "CASE WHEN flag_rst THEN 'RST' WHEN flag_fin THEN 'FIN' ELSE 'CON' END",
    "dur": "(k % 10) / 4.0", "sbytes": "payload_size", "dbytes": "payload_size * (k % 3)",
    "sttl": "CASE WHEN k % 19 = 0 THEN 0 ELSE ttl END", "dttl": "252 - ttl", "sloss": "CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END",
    "dloss": "CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END", "sload": "payload_size * 8", "dload": "payload_size * (k % 2)",
    "spkts": "k % 4", "dpkts": "k % 6", "swin": "CASE WHEN k % 5 = 0 THEN 0 ELSE 255 END", "dwin": "255",
    "smeansz": "k * 3", "dmeansz": "k * 2", "sjit": "(user_id % 7) / 2.0", "djit": "(user_id % 5) / 2.0",
    "sintpkt": "(user_id % 16) / 8.0", "dintpkt": "(k % 16) / 8.0", "tcprtt": "CASE WHEN flag_ack THEN 0.25 ELSE 0.0 END",
    "synack": "(k % 4) / 16.0", "ackdat": "(k % 8) / 16.0",
    "attack_label": "CASE WHEN pkt_id % 20 < 12 THEN ' Normal' WHEN pkt_id % 20 < 14 THEN 'Fuzzers' WHEN pkt_id % 20 < 15 THEN 'DoS ' "
                    "WHEN pkt_id % 20 < 17 THEN 'Exploits' WHEN pkt_id % 20 < 18 THEN 'Backdoors' WHEN pkt_id % 20 < 19 THEN 'worms' ELSE 'Odd' END",
    "binary_label": "CASE WHEN pkt_id % 20 < 12 THEN 0 WHEN pkt_id % 20 < 19 THEN 1 END",
}
# Zeek-style connection records.
ZEEK_EXPR = {
    "rec_id": "pkt_id", "orig_h": "src_ip", "resp_h": "dst_ip", "orig_p": "CAST(src_port AS STRING)",
    "resp_p": "CASE WHEN k % 11 = 0 THEN '-' ELSE CAST(dst_port AS STRING) END",
    "proto": "CASE WHEN protocol = 17 THEN 'udp' WHEN k % 13 = 0 THEN 'icmp' WHEN k % 17 = 0 THEN 'unknown' ELSE 'TCP' END",
    "orig_ip_bytes": "CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(payload_size AS STRING) END",
    "resp_ip_bytes": "CAST(payload_size * (k % 3) AS STRING)",
    "missed_bytes": "CASE WHEN k % 10 = 0 THEN '12' ELSE '0' END",
    "history": "CASE WHEN k % 6 = 0 THEN 'SSaf' WHEN k % 6 = 1 THEN 'ShADadFf' WHEN k % 6 = 2 THEN 'Sr' WHEN k % 6 = 3 THEN 'D' WHEN k % 6 = 4 THEN 'HaR' ELSE '-' END",
    "label": "CASE WHEN pkt_id % 10 < 6 THEN 'Benign' WHEN pkt_id % 10 < 8 THEN ' Malicious' WHEN pkt_id % 10 < 9 THEN 'Attack' ELSE '-' END",
    "detailedlabel": "CASE WHEN pkt_id % 9 < 3 THEN '-' WHEN pkt_id % 9 < 5 THEN 'PartOfAHorizontalPortScan' WHEN pkt_id % 9 < 6 THEN 'CC-HeartBeat' WHEN pkt_id % 9 < 7 THEN 'Botnet-Torii' ELSE 'DoH' END",
    "capture_file": "CASE WHEN user_id % 5 = 0 THEN 'day1-Malware.conn-labeled.log' WHEN user_id % 5 = 1 THEN 'day2-portscan.conn-labeled.log' ELSE 'day3-normal.conn-labeled.log' END",
}
# IoT-style flow records.
IOT_EXPR = {
    "rec_id": "pkt_id", "HTTPS": "CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END", "DNS": "CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END",
    "Telnet": "CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0.0 END", "SSH": "CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0.0 END",
    "SMTP": "CASE WHEN k % 11 = 0 THEN 1.0 ELSE 0.0 END", "IRC": "CASE WHEN k % 13 = 0 THEN 1.0 ELSE 0.0 END",
    "DHCP": "CASE WHEN k % 17 = 0 THEN 1.0 ELSE 0.0 END", "ICMP": "CASE WHEN k % 19 = 0 THEN 1.0 ELSE 0.0 END",
    "protocol_type": "CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(protocol AS DOUBLE) + 0.5 END",
    "tot_size": "CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(payload_size AS DOUBLE) END",
    "syn_flag_number": "CASE WHEN flag_syn THEN 0.5 ELSE 0.0 END", "ack_flag_number": "CASE WHEN flag_ack THEN 1.0 ELSE 0.0 END",
    "rst_flag_number": "CASE WHEN flag_rst THEN 1.0 ELSE 0.0 END", "fin_flag_number": "CASE WHEN flag_fin THEN 1.0 ELSE 0.0 END",
    "cwr_flag_number": "CASE WHEN k % 31 = 0 THEN 1.0 ELSE 0.0 END", "iat": "CASE WHEN k % 37 = 0 THEN NULL ELSE user_id * 1000000.0 END",
    "label": "CASE WHEN pkt_id % 10 < 3 THEN 'BenignTraffic' WHEN pkt_id % 10 < 5 THEN 'Recon-PortScan' WHEN pkt_id % 10 < 6 THEN 'SqlInjection' WHEN pkt_id % 10 < 7 THEN 'Mirai-udpplain' ELSE 'DDoS-UDP_Flood' END",
}


def records(spark, sf, exprs):
    return packets(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def records_sql(name: str, exprs: dict[str, str]) -> str:
    return f"{PACKETS}, {name} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM p)"


UNSW = records_sql("rec", UNSW_EXPR)
ZEEK = records_sql("rec", ZEEK_EXPR)
IOT = records_sql("rec", IOT_EXPR)


def unsw(spark, sf):
    # decimal literals of the shared expressions become doubles
    df = records(spark, sf, UNSW_EXPR)
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields
                           if f.dataType.typeName() == "decimal"})


def zeek(spark, sf):
    return records(spark, sf, ZEEK_EXPR)


def iot(spark, sf):
    df = records(spark, sf, IOT_EXPR)
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields
                           if f.dataType.typeName() == "decimal"})
