"""What-if edits (2.8), attribution and products (2.10), baseline (2.11)."""

from pyspark.sql import functions as F

from catalog.common import PACKETS, RETRANS, r6, register, rounded
from catalog.eval_queries import NAMES, SCORED, VERDICT, scored, window_verdicts
from catalog.graph_queries import EDGES, NODES, RW, SOFT, r6cols, retrans_packets, scored_edges
from catalog.label_sql import ANNOTATED
from catalog.topology_queries import EDGE_SQL, ROLES, capture_risk, flow_rows, hosts, port_name_sql
from catalog.window_queries import B, PW, SEQSTAGE, SPEC, TELE, pw
from packetloom import fixed_values as fv
from packetloom.operators import attribution, baseline, flows, graph, labels, products, sequences, topology, whatif, windows
from packetloom.sources.telemetry import packets, table

HOST = "10.0.1.41"
DYN = ["port_entropy", "syn_ratio", "log_bytes"]
DYN_SQL = """, dy AS (SELECT window_id, port_entropy, syn / greatest(CAST(syn + ack AS DOUBLE), 1.0) AS syn_ratio, ln(1 + bytes) AS log_bytes FROM tele)"""
BASE = RETRANS + B + pw() + TELE + DYN_SQL + pw("rt", "rw")


def graph_tables(spark, sf):
    p = retrans_packets(spark, sf)
    return p, graph.edge_features(p, SPEC, packets(spark, sf)), windows.snapshot_dynamics(packets(spark, sf), SPEC)


HIT = f"(src_ip = '{HOST}' OR dst_ip = '{HOST}')"


@register("cf_isolate_host", f"""WITH {BASE}{EDGES}, ht AS (SELECT window_id, count(*) AS severed FROM ef WHERE {HIT} GROUP BY ALL)
 SELECT window_id, coalesce(severed, 0) AS severed, {r6('port_entropy')} AS port_entropy, {r6('CASE WHEN severed > 0 THEN syn_ratio * 0.2 ELSE syn_ratio END')} AS syn_ratio,
 {r6('CASE WHEN severed > 0 THEN greatest(0, log_bytes - 1.5) ELSE log_bytes END')} AS log_bytes FROM dy LEFT JOIN ht USING (window_id)""")
def _(spark, sf):
    p, edges, dyn = graph_tables(spark, sf)
    out = whatif.isolate_host(edges, graph.node_features(p, SPEC), dyn, HOST)
    return rounded(out["dynamics"], *DYN)


@register("cf_isolate_host_edges", f"WITH {BASE}{EDGES} SELECT window_id, src_ip, dst_ip, {r6('log_packet_count')} AS log_packet_count FROM ef WHERE NOT {HIT}")
def _(spark, sf):
    p, edges, dyn = graph_tables(spark, sf)
    out = whatif.isolate_host(edges, graph.node_features(p, SPEC), dyn, HOST)
    return rounded(out["edges"].select(*graph.EDGE, "log_packet_count"), "log_packet_count")


@register("cf_isolate_host_nodes", f"WITH {BASE}{NODES} SELECT window_id, ip, {', '.join(f'{r6(f_)} AS {c}' for c in fv.NODE_FEATURES for f_ in ['CASE WHEN ip = $H THEN 0 ELSE %s END' % c])} FROM nf".replace("$H", f"'{HOST}'"))
def _(spark, sf):
    p, edges, dyn = graph_tables(spark, sf)
    out = whatif.isolate_host(edges, graph.node_features(p, SPEC), dyn, HOST)
    return rounded(out["nodes"], *fv.NODE_FEATURES)


@register("cf_block_port", f"""WITH {BASE}, pe AS (SELECT window_id, src_ip, dst_ip, bool_and(dst_port = 445 OR src_port = 445) AS o FROM rw GROUP BY ALL),
 ht AS (SELECT window_id, count(*) FILTER (o) AS severed FROM pe GROUP BY ALL)
 SELECT window_id, severed, {r6('port_entropy * 0.4')} AS port_entropy, {r6('syn_ratio * 0.3')} AS syn_ratio, {r6('log_bytes')} AS log_bytes FROM dy JOIN ht USING (window_id)""")
def _(spark, sf):
    p = packets(spark, sf)
    return rounded(whatif.block_port(p, windows.snapshot_dynamics(p, SPEC), 445, SPEC)["dynamics"], *DYN)


BLOCKED = (PACKETS.replace("p AS (SELECT e AS pkt_id", "p0 AS (SELECT e AS pkt_id") + ", p AS (SELECT * FROM p0 WHERE NOT (dst_port = 445 OR src_port = 445))")


@register("cf_block_port_edges", f"WITH {BLOCKED}, rt AS (SELECT *, false AS is_retransmission FROM p){B}{pw('rt', 'rw')}{EDGES} SELECT window_id, src_ip, dst_ip, {r6cols(fv.EDGE_FEATURES)} FROM ef")
def _(spark, sf):
    p = packets(spark, sf)
    left = whatif.block_port(p, windows.snapshot_dynamics(p, SPEC), 445, SPEC)["packets"]
    return rounded(graph.edge_features(left, SPEC), *fv.EDGE_FEATURES)


@register("cf_rate_limit", f"""WITH {BASE}{EDGES}, ht AS (SELECT window_id, count(*) // 2 AS mitigated_edges FROM ef GROUP BY ALL)
 SELECT window_id, mitigated_edges, {r6('port_entropy')} AS port_entropy, {r6('syn_ratio * 0.15::DOUBLE')} AS syn_ratio, {r6('log_bytes * 0.15::DOUBLE')} AS log_bytes FROM dy JOIN ht USING (window_id)""")
def _(spark, sf):
    p, edges, dyn = graph_tables(spark, sf)
    return rounded(whatif.rate_limit(edges, dyn)["dynamics"], *DYN)


@register("cf_segment_subnet", f"WITH {BASE}{EDGES} SELECT window_id, count(*) FILTER (starts_with(src_ip, '10.0.1.') <> starts_with(dst_ip, '10.0.1.')) AS severed FROM ef GROUP BY ALL")
def _(spark, sf):
    return whatif.segment_subnet(graph_tables(spark, sf)[1], "10.0.1.")["severed"]


@register("cf_honeypot", f"""WITH {BASE}{EDGES} SELECT window_id, src_ip, dst_ip, {', '.join(f"{r6(f_)} AS {c}" for c in fv.EDGE_FEATURES for f_ in ['CASE WHEN dst_ip = $H THEN %s * 0.1::DOUBLE ELSE %s END' % (c, c)])} FROM ef""".replace("$H", f"'{HOST}'"))
def _(spark, sf):
    return rounded(whatif.honeypot(graph_tables(spark, sf)[1], HOST)["edges"], *fv.EDGE_FEATURES)


def r3(e: str) -> str:
    return f"(floor(CAST({e} AS DOUBLE) * 1000.0 + 0.5) / 1000.0)"


@register("cf_trajectory", f"""WITH {SCORED}, t AS (SELECT pkt_id, y_prob AS r, y_prob * 0.6::DOUBLE AS c, unnest([0, 1, 2, 3]) AS k FROM sc),
 s AS (SELECT *, least(1.0::DOUBLE, r * (1.0::DOUBLE + 0.05::DOUBLE * k)) AS b, greatest(0.02::DOUBLE, c * (0.3::DOUBLE + 0.7::DOUBLE * exp(-0.8::DOUBLE * (k + 1)))) AS f FROM t)
 SELECT pkt_id, k, {r3('b')} AS baseline, {r3('f')} AS counterfactual, {r3('greatest(0.0, b - f)')} AS delta FROM s""")
def _(spark, sf):
    s = scored(spark, sf).select("pkt_id", "y_prob", (F.col("y_prob") * 0.6).alias("cf"))
    return s.select("pkt_id", F.explode(whatif.trajectory("y_prob", "cf")).alias("t")).select("pkt_id", "t.*")


CAND = """, ah AS (SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS idx FROM (SELECT DISTINCT ip FROM (SELECT window_id, src_ip AS ip FROM pw UNION ALL SELECT window_id, dst_ip FROM pw)
   WHERE window_id = (SELECT max(window_id) FROM pw)) ORDER BY ip LIMIT 4),
 act AS (SELECT CAST(idx AS INTEGER) AS idx, 'isolate_host' AS kind, ip AS target, 0.15::DOUBLE AS factor, CASE WHEN starts_with(ip, '10.0.') THEN 0.4 ELSE 0.2 END::DOUBLE AS criticality FROM ah
  UNION ALL SELECT * FROM (VALUES (4, 'block_port', '445', 0.15::DOUBLE, 0.15::DOUBLE), (5, 'block_port', '22', 0.15, 0.15), (6, 'block_port', '3389', 0.15, 0.15), (7, 'block_port', '80', 0.15, 0.15),
   (8, 'rate_limit', 'global_ingress', 0.1, 0.25)))"""


@register("cf_candidates", f"WITH {PW}{CAND} SELECT * FROM act")
def _(spark, sf):
    ends = windows.assign(packets(spark, sf), SPEC).select("window_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return whatif.candidates(ends)


RISK = "(1.0 / (1.0 + exp(-(0.6::DOUBLE * {e} + 2.0 * {s} + 0.15::DOUBLE * {b} - 3.5))))"
IMPACT = "CASE kind WHEN 'isolate_host' THEN greatest(criticality, 0.35) WHEN 'block_port' THEN greatest(0.1, criticality * 0.5) WHEN 'rate_limit' THEN 0.15 ELSE criticality END::DOUBLE"
EVAL = (ANNOTATED + B + pw() + pw("ann", "aw") + SEQSTAGE + TELE + DYN_SQL + CAND + """,
 ed AS (SELECT window_id, src_ip, dst_ip, count(*) AS n, """ + ", ".join(f"count(*) FILTER (dst_port = {q} OR src_port = {q}) AS u{q}" for q in whatif.CANDIDATE_PORTS) + """ FROM pw GROUP BY ALL),
 cut AS (SELECT window_id, 'block_port' AS kind, t AS target, count(*) AS cut FROM (""" + " UNION ALL ".join(
    f"SELECT window_id, '{q}' AS t FROM ed WHERE u{q} = n" for q in whatif.CANDIDATE_PORTS) + """) GROUP BY ALL
  UNION ALL SELECT window_id, 'isolate_host', act.target, count(*) FROM ed JOIN act ON act.kind = 'isolate_host' AND (src_ip = act.target OR dst_ip = act.target) GROUP BY ALL),
 hf AS (SELECT window_id, count(*) // 2 AS half FROM ed GROUP BY ALL),
 pl AS (SELECT dy.*, half, act.*, cut.cut FROM dy JOIN (SELECT window_id FROM tele WHERE n_rows >= 2) USING (window_id) JOIN hf USING (window_id) CROSS JOIN act LEFT JOIN cut ON cut.window_id = dy.window_id AND cut.kind = act.kind AND cut.target = act.target),
 ef2 AS (SELECT *, CASE WHEN kind = 'block_port' THEN port_entropy * 0.4 ELSE port_entropy END AS e1,
  CASE WHEN kind = 'isolate_host' AND cut IS NOT NULL THEN syn_ratio * 0.2 WHEN kind = 'block_port' THEN syn_ratio * 0.3 WHEN kind = 'rate_limit' THEN syn_ratio * factor ELSE syn_ratio END AS s1,
  CASE WHEN kind = 'isolate_host' AND cut IS NOT NULL THEN greatest(0, log_bytes - 1.5) WHEN kind = 'rate_limit' THEN log_bytes * factor ELSE log_bytes END AS b1,
  CASE WHEN kind = 'rate_limit' THEN half ELSE coalesce(cut, 0) END AS c1 FROM pl),
 rs AS (SELECT *, """ + RISK.format(e="port_entropy", s="syn_ratio", b="log_bytes") + " AS r0, " + RISK.format(e="e1", s="s1", b="b1") + """ AS r1 FROM ef2),
 sq AS (SELECT seq_id, idx, kind, target, criticality, avg(r0) AS original_risk, avg(r1) AS ra, CAST(sum(c1) AS BIGINT) AS severed FROM (SELECT *, unnest(range(greatest(0, window_id - 9), window_id + 1)) AS seq_id FROM rs)
   WHERE seq_id + 9 <= (SELECT max(window_id) FROM grid) GROUP BY ALL HAVING count(*) = 10),
 cf AS (SELECT sq.*, ss.stage, least(original_risk, ra) AS recalculated_risk, greatest(0, original_risk - least(original_risk, ra)) AS risk_reduction, """ + IMPACT + f""" AS impact FROM sq JOIN ss USING (seq_id)),
 ev AS (SELECT *, {r3('risk_reduction - 0.25 * impact')} AS net_score, CASE WHEN recalculated_risk < 0.35 THEN 'Contained / Benign' ELSE ({NAMES})[stage + 1] END AS stage_after FROM cf)""")


def evaluated(spark, sf):
    p = labels.annotate(packets(spark, sf))
    ends = windows.assign(p, SPEC).select("window_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return whatif.evaluate(p, whatif.candidates(ends), sequences.sequence_stage(p, SPEC), SPEC)


CF = ["original_risk", "recalculated_risk", "risk_reduction"]


@register("cf_evaluate", f"WITH {EVAL} SELECT seq_id, idx, kind, target, severed, {r6cols(CF)} FROM ev")
def _(spark, sf):
    return rounded(evaluated(spark, sf).select("seq_id", "idx", "kind", "target", "severed", *CF), *CF)


@register("cf_impact_score", f"WITH {EVAL} SELECT seq_id, idx, {r6('impact')} AS impact, net_score, stage_after FROM ev")
def _(spark, sf):
    return rounded(evaluated(spark, sf).select("seq_id", "idx", "impact", "net_score", "stage_after"), "impact")


def pct(e: str) -> str:
    return f"CAST(floor({e} * 100.0 * 10.0 + 0.5) / 10.0 AS VARCHAR)"


REC = f"""kind || ' ' || target || ': risk ' || {pct('original_risk')} || '% before, ' || {pct('recalculated_risk')} || '% after (' || {pct('risk_reduction')} || '% lower); ' || severed
 || ' malicious edges removed; next stage ' || stage_after || '; ' || CAST(floor(impact * 100.0 * 1.0 + 0.5) AS BIGINT) || '% of operations affected'"""


@register("cf_recommendation", f"WITH {EVAL} SELECT seq_id, idx, {REC} AS recommendation FROM ev")
def _(spark, sf):
    return evaluated(spark, sf).select("seq_id", "idx", whatif.recommendation().alias("recommendation"))


@register("cf_rank", f"""WITH {EVAL}, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY net_score DESC, idx) AS INTEGER) AS rank FROM ev)
 SELECT seq_id, rank, kind, target, net_score, CASE WHEN rank = 1 THEN 'first choice: ' || kind || ' ' || target || ' (risk ' || {pct('risk_reduction')} || '% lower, net score ' || net_score || ')' END AS summary
 FROM rk WHERE rank <= 3""")
def _(spark, sf):
    return whatif.rank(evaluated(spark, sf), 3).select("seq_id", "rank", "kind", "target", "net_score", "summary")


@register("cf_history", f"WITH {PACKETS} SELECT pkt_id AS sim_id, ts_us, dst_ip AS target FROM p WHERE flag_rst ORDER BY ts_us DESC, pkt_id DESC LIMIT 20")
def _(spark, sf):
    p = packets(spark, sf).filter("flag_rst").select(F.col("pkt_id").alias("sim_id"), "ts_us", F.col("dst_ip").alias("target"))
    return whatif.history(p)


# -- attribution ----------------------------------------------------------------------------------

N12 = fv.EDGE_FEATURES[:12]
FEATS = "[" + ", ".join(f"{{'k': -abs({c}), 'i': {i}, 'name': '{c}', 'value': {c}}}" for i, c in enumerate(N12)) + "]"
TOPE = SOFT + f""", te AS (SELECT window_id, src_ip, dst_ip, attention, list_sort({FEATS})[1:3] AS tf FROM sm QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY attention DESC, src_ip, dst_ip) <= 5)"""


@register("ex_top_edges", f"""WITH {RW}{TOPE} SELECT window_id, src_ip, dst_ip, {r6('attention')} AS attention, array_to_string(list_transform(tf, lambda s: s.name), ',') AS names, {r6('tf[1].value')} AS top_value FROM te""")
def _(spark, sf):
    t = attribution.top_edges(scored_edges(spark, sf))
    return rounded(t.select(*graph.EDGE, "attention", F.array_join(F.transform("top_features", lambda s: s["name"]), ",").alias("names"),
                            F.col("top_features")[0]["value"].alias("top_value")), "attention", "top_value")


@register("ex_global_features", f"""WITH {RW}{TOPE}, g AS (SELECT window_id, f.name AS feature, avg(abs(f.value)) AS contribution FROM (SELECT window_id, unnest(tf) AS f FROM te) GROUP BY ALL)
 SELECT window_id, feature, {r6('contribution')} AS contribution FROM g QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY contribution DESC, feature) <= 5""")
def _(spark, sf):
    return rounded(attribution.global_features(attribution.top_edges(scored_edges(spark, sf))), "contribution")


def seq_importance(spark, sf):
    tele = windows.window_telemetry(packets(spark, sf), SPEC).select("window_id", "log_bytes")
    first = F.greatest(F.lit(0).cast("bigint"), F.col("window_id") - 9)
    return tele.withColumn("seq_id", F.explode(F.sequence(first, F.col("window_id")))).select(
        "seq_id", (F.col("window_id") - F.col("seq_id")).alias("pos"), F.col("log_bytes").alias("importance"))


@register("ex_window_share", f"""WITH {PW}{TELE}, im AS (SELECT seq_id, window_id - seq_id AS pos, imp FROM (SELECT window_id, ln(1 + bytes) AS imp, unnest(range(greatest(0, window_id - 9), window_id + 1)) AS seq_id FROM tele))
 SELECT seq_id, pos, {r6('imp / (sum(imp) OVER (PARTITION BY seq_id) + 1e-12)')} AS share, pos = first_value(pos) OVER (PARTITION BY seq_id ORDER BY imp DESC, pos) AS is_critical FROM im""")
def _(spark, sf):
    return rounded(attribution.window_share(seq_importance(spark, sf)), "share")


def linear_risk(x):
    """Fixed-weight logistic over a vector: weight of position j is ((37 j) mod 11 - 5) / 10."""
    n = F.size(x)
    z = F.aggregate(F.zip_with(x, F.sequence(F.lit(0), n - 1), lambda v, j: v * ((j * 37) % 11 - 5) / 10.0), F.lit(0.0), lambda a, b: a + b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@register("ex_perturbation", f"""WITH v AS (SELECT vec_id, dim, CAST(embedding[dim + 1] AS DOUBLE) AS x, ((dim * 37) % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT *, unnest(range(len(embedding))) AS dim FROM embeddings)),
 m AS (SELECT dim, avg(x) AS m FROM v GROUP BY dim), z AS (SELECT vec_id, sum(x * w) AS z FROM v GROUP BY vec_id)
 SELECT vec_id, CAST(dim AS INTEGER) AS dim, {r6('1.0 / (1.0 + exp(-z)) - 1.0 / (1.0 + exp(-(z + (m - x) * w)))')} AS attribution FROM v JOIN m USING (dim) JOIN z USING (vec_id)""")
def _(spark, sf):
    emb = table(spark, sf, "embeddings")
    return rounded(attribution.perturbation(emb, "vec_id", "embedding", linear_risk, background=emb), "attribution")


@register("ex_report_json", f"""WITH {RW}{TOPE}, g AS (SELECT window_id, f.name AS feature, avg(abs(f.value)) AS contribution FROM (SELECT window_id, unnest(tf) AS f FROM te) GROUP BY ALL),
 b AS (SELECT window_id, first(feature ORDER BY contribution DESC, feature) AS top_feature FROM g GROUP BY ALL),
 e AS (SELECT window_id, first(src_ip ORDER BY attention DESC, src_ip, dst_ip) AS top_src, count(*) AS n_edges FROM te GROUP BY ALL)
 SELECT window_id, floor(((window_id * 37) % 1001) / 1000.0::DOUBLE * 10000.0 + 0.5) / 10000.0 AS infiltration_prob, top_feature, top_src, CAST(n_edges AS INTEGER) AS n_edges FROM b JOIN e USING (window_id)""")
def _(spark, sf):
    top = attribution.top_edges(scored_edges(spark, sf))
    rows = attribution.explain_windows(top).select(
        "window_id", (F.pmod(F.col("window_id") * 37, F.lit(1001)) / F.lit(1000.0)).alias("infiltration_prob"), F.lit(0.05).alias("uncertainty_std"),
        F.lit(1).alias("stage"), labels.stage_name(F.lit(1)).alias("stage_name"), labels.technique_of_stage(F.lit(1)).alias("technique"), "features", "edges")
    doc = rows.select("window_id", attribution.report_json(rows).alias("doc"))
    schema = "infiltration_prob double, top_global_features array<struct<feature:string,contribution:double>>, flagged_edges array<struct<src:string,dst:string,attn:double>>"
    back = doc.withColumn("j", F.from_json("doc", schema))
    return back.select("window_id", "j.infiltration_prob", F.col("j.top_global_features")[0]["feature"].alias("top_feature"),
                       F.col("j.flagged_edges")[0]["src"].alias("top_src"), F.size("j.flagged_edges").alias("n_edges"))


CARD = EDGE_SQL + f""", cd AS (SELECT ta.*, {port_name_sql('port', 'proto')} AS pn, a.segment AS ssg, b.segment AS dsg FROM ta JOIN sg a ON a.ip = src_ip JOIN sg b ON b.ip = dst_ip)"""


@register("ex_edge_card", f"""WITH {CARD} SELECT src_ip, dst_ip, 'GNN_ATTN_WEIGHT' AS code, 'attention of this edge: ' || printf('%.2f', floor(attention * 100.0 + 0.5) / 100.0) AS label,
  CAST(floor(attention * 38 + 0.5) AS INTEGER) AS percentage, CASE WHEN attention > 0.8 THEN 'high' ELSE 'medium' END AS severity FROM cd
 UNION ALL SELECT src_ip, dst_ip, 'PORT_VULNERABILITY', 'service reached: port ' || port || ', ' || pn, CASE WHEN port IN (445, 502, 443) THEN 28 ELSE 16 END, CASE WHEN port IN (445, 502) THEN 'high' ELSE 'medium' END FROM cd
 UNION ALL SELECT src_ip, dst_ip, 'SESSION_BURST', 'many connection attempts, few answers', 20, 'medium' FROM cd
 UNION ALL SELECT src_ip, dst_ip, 'SUB_TOPOLOGY_PATH', 'from segment ' || ssg || ' to segment ' || dsg, 14, 'low' FROM cd""")
def _(spark, sf):
    f = flow_rows(spark, sf)
    seg = topology.segment_hosts(topology.top_hosts(topology.host_stats(f)))
    edges = topology.topology_edges(f, seg, capture_risk(spark, sf))
    s = seg.select(F.col("ip").alias("src_ip"), F.col("segment").alias("src_segment"))
    d = seg.select(F.col("ip").alias("dst_ip"), F.col("segment").alias("dst_segment"))
    return attribution.edge_card(edges.join(F.broadcast(s), "src_ip").join(F.broadcast(d), "dst_ip"))


# -- products ----------------------------------------------------------------------------------------

CAPT = "CAST(pkt_id // 1000 AS BIGINT)"
CSQL = ANNOTATED + f""", cp AS (SELECT *, {CAPT} AS capture, string_split(string_split({port_name_sql('dst_port', 'protocol')}, '/')[1], '-')[1] AS fam,
 CASE WHEN (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) THEN src_ip || ':' || src_port || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || src_ip || ':' || src_port END || '/' || protocol AS fk FROM ann)"""


@register("dp_capture_summary", f"""WITH {CSQL} SELECT capture, count(*) AS packet_count, {r6('(max(ts_us) - min(ts_us)) / 1e6')} AS duration_seconds, array_to_string(list_sort(list(DISTINCT fam)), ',') AS protocols,
 count(DISTINCT fk) AS flow_count, count(DISTINCT CASE WHEN mitre_stage_id >= 4 THEN dst_ip END) AS threat_hosts FROM cp GROUP BY capture""")
def _(spark, sf):
    p = labels.annotate(packets(spark, sf)).withColumn("capture", F.floor(F.col("pkt_id") / 1000).cast("bigint"))
    f = flows.with_canonical_key(p).select("capture", "flow_key").distinct()
    h = p.filter("mitre_stage_id >= 4").select("capture", "dst_ip").distinct()
    return rounded(products.capture_summary(p, f, h), "duration_seconds")


@register("dp_kpis", f"""WITH {VERDICT.replace('any_value(entropy) AS entropy', 'any_value(entropy) AS entropy, ln(1 + sum(payload_size)) AS lb')} SELECT window_id, CAST(floor(risk * 100 + 0.5) AS INTEGER) AS infiltration_risk, CASE WHEN risk > 0.6 THEN '+14' ELSE '+0' END AS risk_trend,
 floor(greatest(10.0::DOUBLE, (1.0::DOUBLE - risk) * 45.0::DOUBLE) * 10.0 + 0.5) / 10.0 AS lead_seconds, stage AS predicted_stage, floor(entropy * 100.0 + 0.5) / 100.0 AS port_entropy,
 floor(syn * 100.0 + 0.5) / 100.0 AS syn_ratio, floor(lb * 100.0 + 0.5) / 100.0 AS log_bytes FROM vd""")
def _(spark, sf):
    v = window_verdicts(spark, sf)
    tele = windows.window_telemetry(packets(spark, sf), SPEC).select("window_id", "log_bytes")
    return products.kpis(v.join(tele, "window_id").withColumnRenamed("syn_ack_ratio", "syn_ratio"))


def point_sql(row) -> str:
    off, act, bas, cnt, up, low = row

    def at(rule):
        return "NULL::INTEGER" if rule is None else f"greatest({rule[0]}, CAST(round_even(b * {rule[1]}::DOUBLE, 0) AS INTEGER))"
    return (f"SELECT window_id, {off} AS seconds, {at(act)} AS actual, least({99 if off > 0 else 100}, {at(bas)}) AS baseline, {at(cnt)} AS counterfactual, "
            f"least(100, CAST(round_even(b * {up[0]}::DOUBLE + {up[1]}, 0) AS INTEGER)) AS ci_upper, greatest(0, CAST(round_even(b * {low[0]}::DOUBLE + {low[1]}, 0) AS INTEGER)) AS ci_lower FROM f")


RISKROW = f"WITH {PACKETS}{B}, f AS (SELECT window_id, ((window_id * 37) % 1001) / 1000.0::DOUBLE * 100.0::DOUBLE AS b, window_id % 5 = 0 AS mit FROM grid)"


def risk_rows(spark, sf):
    return windows.grid(packets(spark, sf), SPEC).select(
        "window_id", (F.pmod(F.col("window_id") * 37, F.lit(1001)) / F.lit(1000.0)).alias("risk"), (F.col("window_id") % 5 == 0).alias("mitigated"))


@register("dp_forecast_points", f"{RISKROW} {' UNION ALL '.join(point_sql(r) for r in products.FORECAST)}")
def _(spark, sf):
    return products.forecast_points(risk_rows(spark, sf), "window_id", "risk")


CHAIN_STATUS = "CASE step WHEN 4 THEN CASE WHEN mit THEN 'completed' WHEN b > 50 THEN 'active' ELSE 'upcoming' END WHEN 5 THEN CASE WHEN mit THEN 'upcoming' WHEN b > 80 THEN 'active' ELSE 'upcoming' END ELSE 'completed' END"


@register("dp_kill_chain", f"{RISKROW}, st(step, name, tactic_id) AS (VALUES {', '.join(str(k) for k in products.KILL_CHAIN)}) SELECT window_id, step, name, tactic_id, {CHAIN_STATUS} AS status FROM f, st")
def _(spark, sf):
    return products.kill_chain(risk_rows(spark, sf), "window_id", F.col("risk") * 100.0, F.col("mitigated"))


ISO = "in_degree % 2 = 0"


@register("dp_alerts", f"""WITH {ROLES}, tg AS (SELECT ip, name, string_split(open_ports, ',')[1]::INTEGER AS port FROM hr WHERE segment = 'corporate' ORDER BY rank LIMIT 1),
 am AS (SELECT name FROM hr WHERE status = 'compromised' ORDER BY rank LIMIT 1)
 SELECT 'alt-target' AS id, 'critical' AS severity, am.name AS source, tg.name || ' (' || ip || ')' AS target, 'Lateral traversal targeting ' || tg.name AS message, port FROM tg, am
 UNION ALL SELECT 'alt-comp-' || ip, CASE WHEN rank = min(rank) OVER () THEN 'critical' ELSE 'high' END, name || ' (' || ip || ')', role, 'host marked compromised; open ports: ' || replace(open_ports, ',', ', '), string_split(open_ports, ',')[1]::INTEGER FROM hr WHERE status = 'compromised'
 UNION ALL SELECT 'alt-iso-' || ip, 'info', name || ' (' || ip || ')', 'Security Policy', 'isolation is in force for this host', NULL FROM hr WHERE {ISO}""")
def _(spark, sf):
    h = hosts(spark, sf)
    source = h.filter("status = 'compromised'").agg(F.min_by("name", "rank")).scalar()
    target = (h.filter("segment = 'corporate'").orderBy("rank").limit(1)
              .select("ip", "name", source.alias("source_name"), F.lit(87.0).alias("probability"),
                      F.concat(F.lit("Lateral traversal targeting "), "name").alias("vector"), F.get("open_ports", F.lit(0)).alias("port")))
    return products.alerts(target, h, h.filter(ISO))


# -- baseline ----------------------------------------------------------------------------------------


def flow_matrix(spark, sf):
    p = labels.annotate(flows.with_retransmissions(packets(spark, sf)).drop("flow_key"))
    return baseline.flow_matrix(flows.flow_table(p))


@register("ml_logistic_fit")
def _(spark, sf):
    model = baseline.fit(flow_matrix(spark, sf))
    lr = model.stages[-1]
    values = ", ".join(f"('{n}', {float(c)!r}D)" for n, c in zip(["intercept", *baseline.FEATURES], [lr.intercept, *lr.coefficients]))
    return rounded(spark.sql(f"SELECT * FROM VALUES {values} AS t(feature, coefficient)"), "coefficient")


@register("ml_logistic_score")
def _(spark, sf):
    matrix = flow_matrix(spark, sf)
    return rounded(baseline.evaluate(baseline.fit(matrix), matrix), "f1", "precision", "recall", "fpr", "accuracy", "auroc", "brier_score", "ece")
