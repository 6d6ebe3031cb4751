"""Packets to flows (2.4)."""


from pyspark.sql import functions as F

from catalog.common import CANON, PACKETS, RETRANS, r6, register, rounded, typed
from packetloom.operators import flows
from packetloom.sources.telemetry import packets


@register("flow_canonical_id", f"WITH {CANON} SELECT pkt_id, flow_key, is_fwd FROM c")
def _(spark, sf):
    return flows.with_canonical_key(packets(spark, sf)).select("pkt_id", "flow_key", "is_fwd")


@register("flow_agg", f"""WITH {CANON} SELECT flow_key, count(*) AS tot_pkts,
 count(*) FILTER (is_fwd) AS tot_fwd_pkts, count(*) FILTER (NOT is_fwd) AS tot_bwd_pkts,
 CAST(sum(payload_size) AS BIGINT) AS tot_bytes,
 CAST(coalesce(sum(payload_size) FILTER (is_fwd), 0) AS BIGINT) AS tot_fwd_bytes,
 CAST(coalesce(sum(payload_size) FILTER (NOT is_fwd), 0) AS BIGINT) AS tot_bwd_bytes,
 min(ts_us) AS start_us, max(ts_us) AS end_us, {r6('(max(ts_us)-min(ts_us))/1e6')} AS flow_duration,
 {r6('sum(payload_size)/greatest((max(ts_us)-min(ts_us))/1e6, 0.001)')} AS flow_byts_s,
 {r6('count(*)/greatest((max(ts_us)-min(ts_us))/1e6, 0.001)')} AS flow_pkts_s
 FROM c GROUP BY flow_key""")
def _(spark, sf):
    return rounded(flows.flow_volume(packets(spark, sf)), "flow_duration", "flow_byts_s", "flow_pkts_s")


@register("flow_agg_capture", f"""WITH {CANON} SELECT pkt_id // 1000 AS capture, flow_key, count(*) AS tot_pkts,
 CAST(sum(payload_size) AS BIGINT) AS tot_bytes, min(ts_us) AS start_us, max(ts_us) AS end_us FROM c GROUP BY ALL""")
def _(spark, sf):
    p = packets(spark, sf).withColumn("capture", F.floor(F.col("pkt_id") / 1000))
    return flows.flow_volume(p, ("capture",)).select("capture", "flow_key", "tot_pkts", "tot_bytes", "start_us", "end_us")


GAPS = CANON + """, g AS (SELECT flow_key, is_fwd, ts_us,
 ts_us - lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS gap,
 ts_us - lag(ts_us) OVER (PARTITION BY flow_key, is_fwd ORDER BY ts_us, pkt_id) AS dgap FROM c)"""


def _gap_cols(prefix: str, gap: str) -> str:
    def z(agg: str) -> str:
        return r6(f"coalesce({agg}, 0) / 1e6")
    return (f"{z(f'sum({gap}) / CAST(count({gap}) AS DOUBLE)')} AS {prefix}_mean, "
            f"{z(f'stddev_pop({gap})')} AS {prefix}_std, {z(f'max({gap})')} AS {prefix}_max, "
            f"{z(f'min({gap})')} AS {prefix}_min")


FLOW_IAT_SQL = f"WITH {GAPS} SELECT flow_key, {_gap_cols('flow_iat', 'gap')} FROM g GROUP BY flow_key"
FWD = "(CASE WHEN is_fwd THEN dgap END)"
BWD = "(CASE WHEN NOT is_fwd THEN dgap END)"
IAT = ["mean", "std", "max", "min"]


@register("flow_iat", FLOW_IAT_SQL)
def _(spark, sf):
    cols = [f"flow_iat_{s}" for s in IAT]
    return rounded(flows.flow_iat(packets(spark, sf)).select("flow_key", *cols), *cols)


@register("flow_iat_dir", f"WITH {GAPS} SELECT flow_key, {_gap_cols('fwd_iat', FWD)}, "
                          f"{_gap_cols('bwd_iat', BWD)} FROM g GROUP BY flow_key")
def _(spark, sf):
    cols = [f"{d}_iat_{s}" for d in ("fwd", "bwd") for s in IAT]
    return rounded(flows.flow_iat(packets(spark, sf)).select("flow_key", *cols), *cols)


CANON_RT = RETRANS + CANON[len(PACKETS):].replace("FROM p)", "FROM rt)")
SHAPE = f"""{r6('avg(payload_size)')} AS pkt_len_mean, {r6('stddev_pop(payload_size)')} AS pkt_len_std,
 max(payload_size) AS pkt_len_max, min(payload_size) AS pkt_len_min,
 count(*) FILTER (flag_syn) AS flag_syn, count(*) FILTER (flag_ack) AS flag_ack,
 count(*) FILTER (flag_rst) AS flag_rst, count(*) FILTER (flag_fin) AS flag_fin,
 count(*) FILTER (is_retransmission) AS is_retransmission,
 {r6('count(*) FILTER (is_fwd) / CAST(count(*) AS DOUBLE)')} AS bidi_ratio,
 {r6('coalesce(sum(payload_size) FILTER (is_fwd), 0) / greatest(CAST(sum(payload_size) AS DOUBLE), 1.0)')} AS bidi_byte_ratio,
 {r6('count(*) FILTER (is_retransmission) / CAST(count(*) AS DOUBLE)')} AS retransmission_rate"""
SHAPE_REAL = ["pkt_len_mean", "pkt_len_std", "bidi_ratio", "bidi_byte_ratio", "retransmission_rate"]


@register("flow_len_flags", f"WITH {CANON_RT} SELECT flow_key, {SHAPE} FROM c GROUP BY flow_key")
def _(spark, sf):
    out = flows.flow_shape(flows.with_retransmissions(packets(spark, sf)).drop("flow_key"))
    return rounded(typed(out, pkt_len_max="bigint", pkt_len_min="bigint"), *SHAPE_REAL)


FIRST = ", ".join(f"arg_min({c}, CAST(ts_us AS HUGEINT) * 1000000000000 + pkt_id) AS {c}" for c in
                  ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label"))


@register("flow_first_packet", f"WITH {CANON} SELECT flow_key, {FIRST} FROM c GROUP BY flow_key")
def _(spark, sf):
    return flows.flow_first_packet(packets(spark, sf))


@register("flow_table", f"""WITH {CANON_RT},
 g AS (SELECT flow_key, is_fwd, ts_us - lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS gap,
  ts_us - lag(ts_us) OVER (PARTITION BY flow_key, is_fwd ORDER BY ts_us, pkt_id) AS dgap FROM c),
 i AS (SELECT flow_key, {_gap_cols('flow_iat', 'gap')}, {_gap_cols('fwd_iat', FWD)},
       {_gap_cols('bwd_iat', BWD)} FROM g GROUP BY flow_key),
 a AS (SELECT flow_key, {FIRST}, count(*) AS tot_pkts, count(*) FILTER (is_fwd) AS tot_fwd_pkts,
   CAST(sum(payload_size) AS BIGINT) AS tot_bytes,
   CAST(coalesce(sum(payload_size) FILTER (is_fwd), 0) AS BIGINT) AS tot_fwd_bytes,
   min(ts_us) AS start_us, max(ts_us) AS end_us, {SHAPE} FROM c GROUP BY flow_key)
 SELECT a.*, tot_pkts - tot_fwd_pkts AS tot_bwd_pkts, tot_bytes - tot_fwd_bytes AS tot_bwd_bytes,
  {r6('(end_us-start_us)/1e6')} AS flow_duration,
  {r6('tot_bytes/greatest((end_us-start_us)/1e6, 0.001)')} AS flow_byts_s,
  {r6('tot_pkts/greatest((end_us-start_us)/1e6, 0.001)')} AS flow_pkts_s, tot_bytes AS payload_size,
  i.* EXCLUDE (flow_key) FROM a JOIN i USING (flow_key)""")
def _(spark, sf):
    out = flows.flow_table(flows.with_retransmissions(packets(spark, sf)).drop("flow_key"))
    reals = SHAPE_REAL + ["flow_duration", "flow_byts_s", "flow_pkts_s"] + [
        f"{d}_iat_{s}" for d in ("flow", "fwd", "bwd") for s in IAT]
    return rounded(out, *reals)


@register("flow_idle_split", f"""WITH {CANON},
 b AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 120000000 THEN 1 ELSE 0 END AS brk FROM c
       WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, pkt_id)),
 s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b)
 SELECT flow_key, segment, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS tot_pkts,
  CAST(sum(payload_size) AS BIGINT) AS tot_bytes FROM s GROUP BY flow_key, segment""")
def _(spark, sf):
    return flows.flow_idle_segments(packets(spark, sf))


DKEY = "src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || protocol"


@register("flow_directional_key", f"WITH {PACKETS} SELECT pkt_id, {DKEY} AS flow_key FROM p")
def _(spark, sf):
    return flows.with_directional_key(packets(spark, sf)).select("pkt_id", "flow_key")


@register("flow_ttl_variance", f"""WITH {PACKETS} SELECT pkt_id,
 {r6('var_pop(ttl) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol)')} AS flow_ttl_variance FROM p""")
def _(spark, sf):
    return rounded(flows.with_ttl_variance(packets(spark, sf)).select("pkt_id", "flow_ttl_variance"),
                   "flow_ttl_variance")


@register("retransmission_flag", f"WITH {RETRANS} SELECT pkt_id, is_retransmission FROM rt")
def _(spark, sf):
    return flows.with_retransmissions(packets(spark, sf)).select("pkt_id", "is_retransmission")


@register("retransmission_flag_any", f"""WITH {PACKETS} SELECT pkt_id, coalesce(tcp_seq IS NOT NULL AND
 count(*) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol, tcp_seq) > 1, false) AS is_retransmission FROM p""")
def _(spark, sf):
    return flows.with_retransmissions(packets(spark, sf), require_data=False).select(
        "pkt_id", "is_retransmission")
