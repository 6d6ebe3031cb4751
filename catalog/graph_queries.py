"""Graph features and graph tables (2.6)."""

from pyspark.sql import functions as F

from catalog import derived
from catalog.common import PACKETS, RETRANS, private, r6, register, rounded
from catalog.flow_queries import CANON
from catalog.window_queries import B, pw
from packetloom import fixed_values as fv
from packetloom.config import WindowSpec
from packetloom.operators import flows, graph, registry
from packetloom.session import scratch_path
from packetloom.sources.telemetry import packets

SPEC = WindowSpec()
RW = RETRANS + B + pw("rt", "rw")


def retrans_packets(spark, sf):
    return flows.with_retransmissions(packets(spark, sf)).drop("flow_key")


EDGES = """, em AS (SELECT window_id, src_ip, dst_ip, count(*) AS n, sum(payload_size) AS bytes,
  sum(CAST(flag_syn AS INT)) AS syn, sum(CAST(flag_ack AS INT)) AS ack, sum(CAST(flag_rst AS INT)) AS rst,
  sum(CAST(flag_fin AS INT)) AS fin, sum(CAST(is_retransmission AS INT)) AS retrans,
  count(DISTINCT dst_port) AS ports, avg(ttl) AS ttl_mean, stddev_samp(ttl) AS ttl_std, avg(tcp_window) AS win_mean
  FROM rw GROUP BY ALL),
 eg AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY window_id, src_ip, dst_ip ORDER BY ts_us, pkt_id) AS gap FROM rw),
 ei AS (SELECT window_id, src_ip, dst_ip, least(coalesce(sum(gap) / CAST(count(gap) AS DOUBLE) / 1e6, 0), 60) AS iat_mean,
  least(coalesce(stddev_pop(gap) / 1e6, 0), 60) AS iat_std, least(coalesce(max(gap) / 1e6, 0), 60) AS iat_max FROM eg GROUP BY ALL),
 ef AS (SELECT em.window_id, em.src_ip, em.dst_ip, ln(1 + em.n) AS log_packet_count, ln(1 + em.bytes) AS log_byte_volume,
  em.syn / CAST(em.n AS DOUBLE) AS syn_ratio, em.ack / CAST(em.n AS DOUBLE) AS ack_ratio, em.rst / CAST(em.n AS DOUBLE) AS rst_ratio,
  em.fin / CAST(em.n AS DOUBLE) AS fin_ratio, em.retrans / CAST(em.n AS DOUBLE) AS retransmission_rate,
  CAST(em.ports AS DOUBLE) AS unique_dst_ports, em.ttl_mean AS mean_ttl, coalesce(em.ttl_std, 0) AS ttl_std,
  coalesce(em.win_mean, 1024) AS mean_tcp_window, CASE WHEN """ + private("em.src_ip") + """ THEN 1.0 ELSE 0.0 END AS is_internal,
  iat_mean, iat_std, iat_max, em.n / CAST(em.n + coalesce(rv.n, 0) AS DOUBLE) AS bidi_ratio
  FROM em JOIN ei USING (window_id, src_ip, dst_ip)
  LEFT JOIN em rv ON rv.window_id = em.window_id AND rv.src_ip = em.dst_ip AND rv.dst_ip = em.src_ip)"""


def r6cols(cols, prefix=""):
    return ", ".join(f"{r6(prefix + c)} AS {c}" for c in cols)


@register("edge_features", f"WITH {RW}{EDGES} SELECT window_id, src_ip, dst_ip, {r6cols(fv.EDGE_FEATURES)} FROM ef")
def _(spark, sf):
    return rounded(graph.edge_features(retrans_packets(spark, sf), SPEC, packets(spark, sf)), *fv.EDGE_FEATURES)


@register("edge_iat", f"WITH {RW}{EDGES} SELECT window_id, src_ip, dst_ip, {r6cols(['iat_mean', 'iat_std', 'iat_max'])} FROM ef")
def _(spark, sf):
    return rounded(graph.edge_iat(packets(spark, sf), SPEC), "iat_mean", "iat_std", "iat_max")


FLOWGAPS = CANON + B + """, gg AS (SELECT flow_key, ts_us - lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS gap FROM c),
 fi AS (SELECT flow_key, coalesce(sum(gap) / CAST(count(gap) AS DOUBLE) / 1e6, 0) AS m, coalesce(stddev_pop(gap) / 1e6, 0) AS s, coalesce(max(gap) / 1e6, 0) AS x FROM gg GROUP BY ALL),
 ff AS (SELECT flow_key, min(ts_us) AS ts_us, arg_min(src_ip, CAST(ts_us AS HUGEINT) * 1000000000000 + pkt_id) AS src_ip,
  arg_min(dst_ip, CAST(ts_us AS HUGEINT) * 1000000000000 + pkt_id) AS dst_ip FROM c GROUP BY ALL)""" + pw("ff", "fw")


@register("edge_iat_flows", f"""WITH {FLOWGAPS} SELECT window_id, src_ip, dst_ip, {r6('least(avg(m), 60)')} AS iat_mean, {r6('least(avg(s), 60)')} AS iat_std, {r6('least(avg(x), 60)')} AS iat_max
 FROM fw JOIN fi USING (flow_key) GROUP BY window_id, src_ip, dst_ip""")
def _(spark, sf):
    f = flows.flow_table(packets(spark, sf)).withColumn("ts_us", F.col("start_us"))
    return rounded(graph.edge_features_from_flows(f, SPEC), "iat_mean", "iat_std", "iat_max")


@register("edge_bidi_ratio", f"WITH {RW}{EDGES} SELECT window_id, src_ip, dst_ip, {r6cols(['bidi_ratio'])} FROM ef")
def _(spark, sf):
    edges = graph.with_bidi(graph.edge_moments(packets(spark, sf), SPEC))
    return rounded(edges.select(*graph.EDGE, "bidi_ratio"), "bidi_ratio")


NODES = """, so AS (SELECT window_id, src_ip AS ip, count(*) AS n_out, sum(payload_size) AS b_out, sum(CAST(flag_syn AS INT)) AS syn,
  sum(CAST(flag_ack AS INT)) AS ack, sum(CAST(flag_rst AS INT)) AS rst, sum(CAST(is_retransmission AS INT)) AS retrans,
  count(DISTINCT dst_ip) AS peers_out, avg(ttl) AS tm, var_samp(ttl) AS tv, avg(tcp_window) AS wm FROM rw GROUP BY ALL),
 si AS (SELECT window_id, dst_ip AS ip, count(*) AS n_in, sum(payload_size) AS b_in, count(DISTINCT src_ip) AS peers_in,
  avg(ttl) AS tm, var_samp(ttl) AS tv FROM rw GROUP BY ALL),
 pe AS (SELECT window_id, src_ip AS ip, sum(-(c / t) * log2(c / t + 1e-12)) AS port_entropy FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY window_id, src_ip) AS DOUBLE) AS t
   FROM (SELECT window_id, src_ip, dst_port, count(*) AS c FROM rw GROUP BY ALL)) GROUP BY ALL),
 nf AS (SELECT window_id, ip, ln(1 + coalesce(n_out, 0)) AS log_out, ln(1 + coalesce(n_in, 0)) AS log_in, coalesce(port_entropy, 0) AS port_entropy,
  CASE WHEN n_out IS NOT NULL THEN so.tm ELSE si.tm END / 255.0 AS ttl_norm,
  ln(1 + coalesce(CASE WHEN n_out IS NOT NULL THEN so.tv ELSE si.tv END, 0)) AS log_ttl_var,
  CASE WHEN """ + private("ip") + """ THEN 1.0 ELSE 0.0 END AS is_private, ln(1 + coalesce(b_out, 0)) AS log_bytes_out, ln(1 + coalesce(b_in, 0)) AS log_bytes_in,
  coalesce(syn / CAST(n_out AS DOUBLE), 0) AS syn_ratio, coalesce(ack / CAST(n_out AS DOUBLE), 0) AS ack_ratio, coalesce(rst / CAST(n_out AS DOUBLE), 0) AS rst_ratio,
  CAST(coalesce(peers_out, 0) AS DOUBLE) AS peers_out, CAST(coalesce(peers_in, 0) AS DOUBLE) AS peers_in,
  coalesce(b_out / CAST(n_out AS DOUBLE) / 1500.0, 0) AS avg_size, coalesce(retrans / CAST(n_out AS DOUBLE), 0) AS retrans_rate,
  CASE WHEN n_out IS NULL THEN 1024 ELSE coalesce(wm, 0) END / 65535.0 AS tcp_window_norm
  FROM so FULL JOIN si USING (window_id, ip) LEFT JOIN pe USING (window_id, ip))"""


@register("node_features", f"WITH {RW}{NODES} SELECT window_id, ip, {r6cols(fv.NODE_FEATURES)} FROM nf")
def _(spark, sf):
    return rounded(graph.node_features(retrans_packets(spark, sf), SPEC, packets(spark, sf)), *fv.NODE_FEATURES)


ENDS = "(SELECT {g} ts_us, src_ip AS ip FROM {t} UNION ALL SELECT {g} ts_us, dst_ip FROM {t})"


@register("node_registry", f"""WITH {PACKETS}{B}{pw()} SELECT window_id, ip,
 row_number() OVER (PARTITION BY window_id ORDER BY f, ip) - 1 AS node_id
 FROM (SELECT window_id, ip, min(ts_us) AS f FROM {ENDS.format(g='window_id,', t='pw')} GROUP BY ALL)""")
def _(spark, sf):
    return graph.window_registry(packets(spark, sf), SPEC)


@register("node_registry_capture", f"""WITH {PACKETS} SELECT ip, row_number() OVER (ORDER BY f, ip) - 1 AS node_id
 FROM (SELECT ip, min(ts_us) AS f FROM {ENDS.format(g='', t='p')} GROUP BY ALL)""")
def _(spark, sf):
    return graph.capture_registry(packets(spark, sf))


@register("node_registry_runs", f"""WITH {PACKETS}, e AS (SELECT pkt_id % 3 AS run, ts_us, unnest([src_ip, dst_ip]) AS ip FROM p),
 s AS (SELECT ip, arg_min(f, run) AS f, min(run) AS run FROM (SELECT ip, run, min(ts_us) AS f FROM e GROUP BY ALL) GROUP BY ip)
 SELECT ip, row_number() OVER (ORDER BY run, f, ip) - 1 AS node_id, run FROM s""")
def _(spark, sf):
    """Three runs append to one registry, the second of them twice."""
    path = scratch_path(spark, "registry")
    for run in (0, 1, 1, 2):
        registry.register_hosts(packets(spark, sf).filter(F.col("pkt_id") % 3 == run), path, run)
    return registry.read_registry(spark, path).withColumnRenamed("batch", "run")


@register("node_index_sorted", f"""WITH {PACKETS} SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS node_id
 FROM (SELECT DISTINCT ip FROM {ENDS.format(g='', t='p')})""")
def _(spark, sf):
    return graph.sorted_registry(packets(spark, sf))


CAT = " ".join(f"WHEN lower(trim(attack_label)) = '{n}' THEN {c}" for n, c in fv.ATTACK_CATEGORIES.items())
METRICS = graph.CHANNEL_METRICS
CHANNELS = derived.UNSW + f""", ch AS (SELECT source_ip AS src_ip, destination_ip AS dst_ip, count(*) AS flows,
 CAST(sum(coalesce(binary_label, 0)) AS BIGINT) AS malicious_flows, max(coalesce(binary_label, 0)) AS label,
 max(CASE {CAT} ELSE 0 END) AS attack_class, {', '.join(f'avg(CAST({m} AS DOUBLE)) AS {m}' for m in METRICS)} FROM rec GROUP BY ALL)"""


@register("channel_graph", f"WITH {CHANNELS} SELECT src_ip, dst_ip, flows, malicious_flows, label, attack_class, {r6cols(METRICS)} FROM ch")
def _(spark, sf):
    return rounded(graph.channel_graph(derived.unsw(spark, sf)), *METRICS)


@register("attack_category", f"WITH {derived.UNSW} SELECT rec_id, CASE {CAT} ELSE 0 END AS attack_class FROM rec")
def _(spark, sf):
    return derived.unsw(spark, sf).select("rec_id", graph.attack_category("attack_label").alias("attack_class"))


STD = ["flows", *METRICS]
STANDARD = (CHANNELS + ", lg AS (SELECT src_ip, dst_ip, " + ", ".join(f"ln(1 + greatest({c}, 0)) AS {c}" for c in STD) + " FROM ch), "
            "sd AS (SELECT src_ip, dst_ip, " + ", ".join(
                f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}"
                for c in STD) + " FROM lg)")


@register("log_standardize", f"WITH {STANDARD} SELECT src_ip, dst_ip, {r6cols(STD)} FROM sd")
def _(spark, sf):
    out = graph.log_standardize(graph.channel_graph(derived.unsw(spark, sf)), STD)
    return rounded(out.select("src_ip", "dst_ip", *STD), *STD)


@register("incident_mean", f"""WITH {STANDARD}, i AS (SELECT dst_ip AS ip, {', '.join(f'avg({c}) AS in_{c}' for c in STD)} FROM sd GROUP BY ALL),
 o AS (SELECT src_ip AS ip, {', '.join(f'avg({c}) AS out_{c}' for c in STD)} FROM sd GROUP BY ALL)
 SELECT ip, {', '.join(f"{r6(f'coalesce({s}_{c}, 0)')} AS {s}_{c}" for s in ('in', 'out') for c in STD)} FROM i FULL JOIN o USING (ip)""")
def _(spark, sf):
    out = graph.incident_mean(graph.log_standardize(graph.channel_graph(derived.unsw(spark, sf)), STD), STD)
    return rounded(out, *[c for c in out.columns if c != "ip"])


SOFT = EDGES + """, mx AS (SELECT window_id, dst_ip, max(log_byte_volume) AS m FROM ef GROUP BY ALL),
 sx AS (SELECT ef.*, exp(log_byte_volume - m) AS e FROM ef JOIN mx USING (window_id, dst_ip)),
 sm AS (SELECT *, e / (sum(e) OVER (PARTITION BY window_id, dst_ip) + 1e-16) AS attention FROM sx)"""


def scored_edges(spark, sf):
    return graph.edge_softmax(graph.edge_features(retrans_packets(spark, sf), SPEC, packets(spark, sf)), "log_byte_volume")


@register("edge_softmax", f"WITH {RW}{SOFT} SELECT window_id, src_ip, dst_ip, {r6cols(['attention'])} FROM sm")
def _(spark, sf):
    return rounded(scored_edges(spark, sf).select(*graph.EDGE, "attention"), "attention")


@register("neighbour_message", f"""WITH {RW}{SOFT}{NODES} SELECT sm.window_id, sm.dst_ip AS ip,
 {', '.join(f"{r6(f'sum(attention * nf.{c})')} AS msg_{c}" for c in fv.NODE_FEATURES)}
 FROM sm JOIN nf ON nf.window_id = sm.window_id AND nf.ip = sm.src_ip GROUP BY ALL""")
def _(spark, sf):
    nodes = graph.node_features(retrans_packets(spark, sf), SPEC, packets(spark, sf))
    out = graph.neighbour_message(scored_edges(spark, sf).select(*graph.EDGE, "attention"), nodes, fv.NODE_FEATURES)
    return rounded(out, *[f"msg_{c}" for c in fv.NODE_FEATURES])


@register("graph_pool", f"""WITH {RW}{NODES} SELECT window_id, {', '.join(f"{r6(f'avg({c})')} AS mean_{c}" for c in fv.NODE_FEATURES)},
 {', '.join(f"{r6(f'max({c})')} AS max_{c}" for c in fv.NODE_FEATURES)} FROM nf GROUP BY ALL""")
def _(spark, sf):
    out = graph.graph_pool(graph.node_features(retrans_packets(spark, sf), SPEC, packets(spark, sf)), fv.NODE_FEATURES)
    return rounded(out, *[c for c in out.columns if c != "window_id"])
