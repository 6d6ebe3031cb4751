"""Shared SQL fragments and registration helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import q6
from packetloom.operators import flows, labels
from packetloom.sources.telemetry import (LABEL_BANDS, LABEL_REST, SERVICE_PORTS, TCP_WINDOWS,
                                          packets)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def r6(expr: str) -> str:
    """SQL twin of ``functions.columns.q6``."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: q6(c) for c in cols})


def typed(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Packets with retransmission flag and stage annotation."""
    return labels.annotate(flows.with_retransmissions(packets(spark, sf)))


def private(c: str) -> str:
    return (f"(starts_with({c},'10.') OR starts_with({c},'192.168.') OR starts_with({c},'127.') "
            f"OR regexp_matches({c}, '^172\\.(1[6-9]|2[0-9]|3[0-1])\\.'))")


_bands = " ".join(f"WHEN e % 400 < {b} THEN '{n}'" for b, n in LABEL_BANDS)

PACKETS = f"""
base AS (SELECT event_id AS e, user_id AS u, event_type AS t, value,
                CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
p AS (SELECT e AS pkt_id, CAST(floor(us / 500.0) AS BIGINT) AS ts_us,
  CASE WHEN t = 'view' THEN server ELSE client END AS src_ip,
  CASE WHEN t = 'view' THEN sport ELSE cport END AS src_port,
  CASE WHEN t = 'view' THEN client ELSE server END AS dst_ip,
  CASE WHEN t = 'view' THEN cport ELSE sport END AS dst_port,
  CASE WHEN t = 'signup' THEN 17 ELSE 6 END AS protocol,
  CASE WHEN t = 'error' AND k % 2 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 200.0) AS BIGINT) END AS payload_size,
  t IN ('click','error') AS flag_syn, t IN ('purchase','view') AS flag_ack, t = 'error' AS flag_rst,
  (t = 'purchase' AND k % 7 = 0) AS flag_fin,
  CASE WHEN u % 3 = 0 THEN 128 ELSE CAST(64 - e % 3 AS INTEGER) END AS ttl,
  CASE WHEN t <> 'signup' THEN ({TCP_WINDOWS})[CAST(k % 3 AS INTEGER) + 1] END AS tcp_window,
  CASE WHEN t <> 'signup' THEN k * 1000 + e % 2 END AS tcp_seq,
  CASE WHEN t <> 'signup' THEN 20 END AS tcp_header_len,
  CASE {_bands} ELSE '{LABEL_REST}' END AS label, u AS user_id, k
  FROM (SELECT *,
    CASE WHEN u % 10 = 0 THEN '203.0.113.' || (u % 250) ELSE '10.0.' || (u % 4) || '.' || (u % 250) END AS client,
    CASE WHEN k % 5 = 0 THEN '198.51.100.' || k ELSE '10.0.' || (k % 4) || '.' || k END AS server,
    CAST(40000 + u % 3 AS INTEGER) AS cport, ({SERVICE_PORTS})[CAST(k % 12 AS INTEGER) + 1] AS sport FROM base))"""

CANON = PACKETS + """,
c AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS is_fwd,
  CASE WHEN (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))
   THEN src_ip || ':' || src_port || '<->' || dst_ip || ':' || dst_port || ':' || protocol
   ELSE dst_ip || ':' || dst_port || '<->' || src_ip || ':' || src_port || ':' || protocol END AS flow_key
  FROM p)"""

RETRANS = PACKETS + """,
rt AS (SELECT *, coalesce(tcp_seq IS NOT NULL AND payload_size - coalesce(tcp_header_len, 20) > 0
    AND count(CASE WHEN payload_size - coalesce(tcp_header_len, 20) > 0 THEN 1 END)
        OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol, tcp_seq) > 1, false) AS is_retransmission
  FROM p)"""
