"""Labelling (2.7) and evaluation (2.9)."""

from pyspark.sql import functions as F

from catalog.common import PACKETS, r6, register, rounded
from catalog.graph_queries import r6cols
from catalog.label_sql import ANNOTATED, HCONF, HSTAGE, HTECH, MAPPED, NAMES
from catalog.window_queries import AW, GROUND, MODE, SPEC
from packetloom import fixed_values as fv
from packetloom.operators import evaluation as ev
from packetloom.operators import labels, sequences, windows
from packetloom.sources.telemetry import packets, table

# -- labels ---------------------------------------------------------------------------------------


@register("label_normalize", f"WITH {MAPPED} SELECT pkt_id, clean_label FROM mp")
def _(spark, sf):
    return packets(spark, sf).select("pkt_id", labels.clean_label("label").alias("clean_label"))


@register("label_map_exact", f"WITH {MAPPED} SELECT pkt_id, es AS stage, et AS technique FROM cl JOIN lt USING (clean_label)")
def _(spark, sf):
    m = labels.map_labels(packets(spark, sf)).filter("label_source = 'exact'")
    return m.select("pkt_id", F.col("label_stage").alias("stage"), F.col("label_technique").alias("technique"))


@register("label_map_rules", f"WITH {MAPPED} SELECT pkt_id, label_stage, label_technique, label_source FROM mp")
def _(spark, sf):
    return labels.map_labels(packets(spark, sf)).select("pkt_id", "label_stage", "label_technique", "label_source")


@register("label_unmapped", f"WITH {MAPPED} SELECT clean_label, count(*) AS n FROM mp WHERE label_source = 'unmapped' AND clean_label NOT IN ('benign','none','nan','','0') GROUP BY ALL")
def _(spark, sf):
    return labels.unmapped_labels(packets(spark, sf))


@register("is_malicious", f"WITH {MAPPED} SELECT pkt_id, label_stage > 0 AS is_malicious FROM mp")
def _(spark, sf):
    return labels.map_labels(packets(spark, sf)).select("pkt_id", (F.col("label_stage") > 0).alias("is_malicious"))


@register("heuristic_stage", f"WITH {PACKETS} SELECT pkt_id, {HSTAGE} AS mitre_stage_id, ({NAMES})[({HSTAGE}) + 1] AS mitre_stage_name, {HTECH} AS mitre_technique, CAST({HCONF} AS DOUBLE) AS mitre_confidence FROM p")
def _(spark, sf):
    return labels.with_heuristic_stage(packets(spark, sf)).select(
        "pkt_id", "mitre_stage_id", "mitre_stage_name", "mitre_technique", "mitre_confidence")


@register("label_override", f"WITH {ANNOTATED} SELECT pkt_id, mitre_stage_id, ({NAMES})[mitre_stage_id + 1] AS mitre_stage_name, mitre_technique, mitre_confidence FROM ann")
def _(spark, sf):
    return labels.annotate(packets(spark, sf)).select(
        "pkt_id", "mitre_stage_id", "mitre_stage_name", "mitre_technique", "mitre_confidence")


PORTS_BY_WINDOW = {"has_smb": (445, 135), "has_kerb": (88, 389), "has_db": (5432, 1433, 3306), "has_ot": (502,), "has_445": (445,)}


def window_verdicts(spark, sf):
    """Per window: risk, stage name, telemetry and service-port flags."""
    p = labels.annotate(packets(spark, sf))
    rows = windows.assign(p.select("ts_us", "dst_port"), SPEC, windows.origin(p))
    ports = rows.groupBy("window_id").agg(*[F.bool_or(F.col("dst_port").isin(*v)).alias(n) for n, v in PORTS_BY_WINDOW.items()])
    tele = windows.window_telemetry(p, SPEC).select("window_id", "port_entropy", "syn_ack_ratio")
    modes = windows.stage_mode(p, SPEC).select("window_id", labels.stage_name("stage").alias("stage"))
    risk = F.pmod(F.col("window_id") * 37, F.lit(1001)) / F.lit(1000.0)
    return ports.join(tele, "window_id").join(modes, "window_id").withColumn("risk", risk)


VERDICT = AW + MODE + """, tw AS (SELECT * FROM aw), pc AS (SELECT window_id, dst_port, count(*) AS c FROM aw GROUP BY ALL),
 ent AS (SELECT window_id, sum(-(c / t) * log2(c / t + 1e-12)) AS entropy FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY window_id) AS DOUBLE) AS t FROM pc) GROUP BY ALL),
 vd AS (SELECT aw.window_id, any_value(entropy) AS entropy, count(*) FILTER (flag_syn) / greatest(count(*) FILTER (flag_syn) + count(*) FILTER (flag_ack), 1)::DOUBLE AS syn,
  """ + ", ".join(f"bool_or(dst_port IN ({', '.join(map(str, v))})) AS {n}" for n, v in PORTS_BY_WINDOW.items()) + f""",
  ({NAMES})[any_value(stage) + 1] AS stage, ((aw.window_id * 37) % 1001) / 1000.0::DOUBLE AS risk FROM aw JOIN ent USING (window_id) JOIN wm USING (window_id) GROUP BY ALL)"""
NAMED = {"benign": labels.BENIGN_TRAFFIC, "smb": labels.SMB_SHARES, "kerb": labels.KERBEROAST, "guess": labels.GUESSING,
         "exfil": labels.C2_EXFIL, "ot": labels.MODBUS, "flood": labels.FLOOD, "exploit": labels.EXPLOIT, "c2": labels.WEB_C2,
         "sweep": labels.SWEEP, "synflood": labels.FLOOD_SYN}
KIND = """CASE WHEN risk < 0.40 AND stage = 'Benign' AND NOT has_smb THEN 'benign' WHEN stage = 'Lateral Movement' OR (has_smb AND risk > 0.45) THEN 'smb'
 WHEN stage = 'Credential Access' OR (has_kerb AND risk > 0.45) THEN CASE WHEN has_kerb THEN 'kerb' ELSE 'guess' END
 WHEN stage = 'Exfiltration' OR (has_db AND risk > 0.45) THEN 'exfil' WHEN has_ot THEN 'ot'
 WHEN stage = 'Initial Access' OR (risk > 0.50 AND syn > 0.7) THEN CASE WHEN syn > 0.7 THEN 'flood' ELSE 'exploit' END
 WHEN stage = 'Command & Control' THEN 'c2' WHEN stage = 'Reconnaissance' OR (entropy > 2.5 AND syn > 0.3) THEN 'sweep' WHEN syn > 0.7 THEN 'synflood' ELSE 'other' END"""
DESCR = ", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}', '{v[3]}')" for k, v in NAMED.items())


@register("attack_type", f"""WITH {VERDICT}, kd AS (SELECT *, {KIND} AS kind FROM vd), ds(kind, a, t, c, l) AS (VALUES {DESCR})
 SELECT window_id, coalesce(a, 'Exploit Public-Facing Application (' || stage || ')') AS attack_type, coalesce(t, 'T1190') AS technique,
 coalesce(c, 'Initial Access (TA0001)') AS tactic, coalesce(l, CASE WHEN risk > 0.75 THEN 'HIGH' ELSE 'MEDIUM' END) AS threat_level FROM kd LEFT JOIN ds USING (kind)""")
def _(spark, sf):
    v = window_verdicts(spark, sf)
    out = v.withColumn("_a", labels.attack_type("risk", "stage", "port_entropy", "syn_ack_ratio", "has_smb", "has_kerb", "has_db", "has_ot"))
    return out.select("window_id", "_a.attack_type", "_a.technique", "_a.tactic", "_a.threat_level")


@register("signature_override", f"""WITH {VERDICT} SELECT window_id,
 {r6('CASE WHEN has_445 THEN greatest(risk, 0.968) WHEN has_kerb THEN greatest(risk, 0.942) WHEN has_ot THEN greatest(risk, 0.885) ELSE risk END')} AS risk,
 CASE WHEN has_445 THEN 'Lateral Movement' WHEN has_kerb THEN 'Credential Access' WHEN has_ot THEN 'Initial Access' ELSE stage END AS stage FROM vd""")
def _(spark, sf):
    v = window_verdicts(spark, sf).withColumn("_o", labels.signature_override("risk", "stage", "has_445", "has_kerb", "has_ot"))
    return rounded(v.select("window_id", "_o.risk", "_o.stage"), "risk")


PROB = "((k * 37 + user_id * 11) % 1001) / 1000.0::DOUBLE"
SCORED = ANNOTATED + f""", sc AS (SELECT pkt_id, ts_us, src_ip, dst_ip, label, CASE WHEN mitre_stage_id > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS y_true, {PROB} AS y_prob,
 mitre_stage_id AS stage_true, CAST(CASE WHEN k % 3 = 0 THEN (mitre_stage_id + user_id) % 7 ELSE mitre_stage_id END AS INTEGER) AS stage_pred, k, user_id FROM ann)"""


def scored(spark, sf):
    p = labels.annotate(packets(spark, sf))
    prob = F.pmod(F.col("k") * 37 + F.col("user_id") * 11, F.lit(1001)) / F.lit(1000.0)
    pred = F.when(F.col("k") % 3 == 0, (F.col("mitre_stage_id") + F.col("user_id")) % 7).otherwise(F.col("mitre_stage_id"))
    return p.select("pkt_id", "ts_us", "src_ip", "dst_ip", "label", (F.col("mitre_stage_id") > 0).cast("double").alias("y_true"),
                    prob.alias("y_prob"), F.col("mitre_stage_id").alias("stage_true"), pred.cast("int").alias("stage_pred"), "k", "user_id")


@register("risk_level", f"""WITH {SCORED} SELECT pkt_id, CASE WHEN y_prob >= 0.8 THEN 'CRITICAL' WHEN y_prob >= 0.6 THEN 'HIGH' WHEN y_prob >= 0.4 THEN 'MEDIUM'
 WHEN y_prob >= 0.2 THEN 'LOW' ELSE 'BENIGN' END AS level, CASE WHEN y_prob > 0.7 THEN 'critical' WHEN y_prob > 0.4 THEN 'high' ELSE 'info' END AS severity FROM sc""")
def _(spark, sf):
    return scored(spark, sf).select("pkt_id", labels.risk_level("y_prob").alias("level"), labels.alert_severity("y_prob").alias("severity"))


TACT = " ".join(f"WHEN n = '{k}' THEN '{v[1]}'" for k, v in fv.TACTICS.items())
TACL = " ".join(f"WHEN n = '{k}' THEN '{v[0]}'" for k, v in fv.TACTICS.items())
TECH = "[" + ", ".join(f"'{t}'" for t in fv.STAGE_TECHNIQUES.values()) + "]"


@register("tactic_code", f"""WITH {ANNOTATED}, x AS (SELECT pkt_id, mitre_stage_id AS s, ({NAMES})[mitre_stage_id + 1] AS n FROM ann)
 SELECT pkt_id, CASE {TACL} ELSE 'Initial Access' END AS tactic, CASE {TACT} ELSE 'TA0001' END AS tactic_code, ({TECH})[s + 1] AS technique FROM x""")
def _(spark, sf):
    a = labels.annotate(packets(spark, sf))
    t = labels.tactic("mitre_stage_name")
    return a.select("pkt_id", t["label"].alias("tactic"), t["code"].alias("tactic_code"),
                    labels.technique_of_stage("mitre_stage_id").alias("technique"))


# -- metrics --------------------------------------------------------------------------------------

CONF = """count(*) FILTER (y_true > 0.5 AND y_prob >= 0.5) AS tp, count(*) FILTER (y_true <= 0.5 AND y_prob < 0.5) AS tn,
 count(*) FILTER (y_true <= 0.5 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_true > 0.5 AND y_prob < 0.5) AS fn"""


@register("ev_confusion", f"WITH {SCORED} SELECT {CONF} FROM sc")
def _(spark, sf):
    return ev.confusion(scored(spark, sf))


RATES = """coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, fp / greatest(fp + tn, 1)::DOUBLE AS fpr, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy"""
PRF = ["precision", "recall", "f1", "fpr", "accuracy"]


@register("ev_prf", f"WITH {SCORED}, c AS (SELECT {CONF} FROM sc), r AS (SELECT {RATES} FROM c) SELECT {r6cols(PRF)} FROM r")
def _(spark, sf):
    return rounded(ev.with_rates(ev.confusion(scored(spark, sf))).select(*PRF), *PRF)


def auc_sql(src: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""SELECT {cols} (sum(CASE WHEN y_true > 0.5 THEN rk END) - np * (np + 1) / 2.0) / (np * nn) AS auroc FROM (
 SELECT *, CAST(count(*) FILTER (y_true > 0.5) OVER ({part}) AS DOUBLE) AS np, CAST(count(*) FILTER (y_true <= 0.5) OVER ({part}) AS DOUBLE) AS nn,
  avg(rn) OVER (PARTITION BY {cols} y_prob) AS rk FROM (SELECT *, row_number() OVER ({part} ORDER BY y_prob) AS rn FROM {src})) GROUP BY {cols} np, nn"""


@register("ev_auroc", f"WITH {SCORED} SELECT {r6('auroc')} AS auroc FROM ({auc_sql('sc', '')})")
def _(spark, sf):
    return rounded(ev.auroc(scored(spark, sf)), "auroc")


@register("ev_brier", f"WITH {SCORED} SELECT {r6('avg((y_prob - y_true) ** 2)')} AS brier_score FROM sc")
def _(spark, sf):
    return rounded(ev.brier(scored(spark, sf)), "brier_score")


EDGES_SQL = "[" + ", ".join(f"{e!r}::DOUBLE" for e in ev.ECE_EDGES) + "]"


def ece_sql(src: str, by: str) -> str:
    cols = f"{by}, " if by else ""
    return f"""SELECT {cols} coalesce(sum(n * abs(a - c)) FILTER (b BETWEEN 0 AND 9), 0) / sum(n) AS ece FROM (SELECT {cols} len(list_filter({EDGES_SQL}, lambda e: y_prob >= e)) - 1 AS b,
 count(*) AS n, avg(y_prob) AS c, avg(y_true) AS a FROM {src} GROUP BY ALL) {'GROUP BY ' + by if by else ''}"""


@register("ev_ece", f"WITH {SCORED} SELECT {r6('ece')} AS ece FROM ({ece_sql('sc', '')})")
def _(spark, sf):
    return rounded(ev.ece(scored(spark, sf)), "ece")


@register("ev_lead_time", f"""WITH {SCORED}, o AS (SELECT dst_ip, min(ts_us) AS onset_us FROM sc WHERE stage_true >= 4 GROUP BY ALL)
 SELECT dst_ip, onset_us, min(ts_us) FILTER (y_prob >= 0.7 AND ts_us <= onset_us) AS first_alert_us,
 {r6('(onset_us - min(ts_us) FILTER (y_prob >= 0.7 AND ts_us <= onset_us)) / 1e6')} AS lead_seconds FROM sc JOIN o USING (dst_ip) GROUP BY dst_ip, onset_us""")
def _(spark, sf):
    s = scored(spark, sf)
    onset = s.filter("stage_true >= 4").groupBy("dst_ip").agg(F.min("ts_us").alias("onset_us"))
    return rounded(ev.lead_time(s.join(onset, "dst_ip"), ["dst_ip"]), "lead_seconds")


@register("ev_per_stage", f"""WITH {SCORED}, st(stage, name) AS (VALUES {', '.join(f"({s}, '{n}')" for s, n in fv.STAGES.items())}),
 m AS (SELECT name, (SELECT count(*) FROM sc WHERE stage_true = stage AND stage_pred = stage) AS tp, (SELECT count(*) FROM sc WHERE stage_true = stage) AS support,
  (SELECT count(*) FROM sc WHERE stage_pred = stage) AS predicted FROM st),
 l AS (SELECT name, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, support, tp FROM m),
 u AS (SELECT name, precision, recall, f1, support FROM l UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM l
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM l
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM l)
 SELECT name, {r6cols(['precision', 'recall', 'f1'])}, CAST(support AS BIGINT) AS support FROM u""")
def _(spark, sf):
    return rounded(ev.per_stage(scored(spark, sf)), "precision", "recall", "f1")


def forecast_pairs(spark, sf):
    """Persistence forecast: the last input window's telemetry against the future windows."""
    p = packets(spark, sf)
    last = windows.window_telemetry(p, SPEC).select(
        (F.col("window_id") - (SPEC.seq_len - 1)).alias("seq_id"), F.col("port_entropy").alias("port_entropy_pred"),
        F.col("syn_row_ratio").alias("syn_ratio_pred"), F.col("log_bytes").alias("log_bytes_pred"))
    truth = sequences.grounded_targets(p, SPEC).select("seq_id", "k", *[F.col(d).alias(f"{d}_true") for d in ev.DYNAMICS])
    return truth.join(last, "seq_id")


PAIRS = GROUND + """, fp AS (SELECT gt.*, t.port_entropy AS pe, t.syn / CAST(t.n_rows AS DOUBLE) AS ps, ln(1 + t.bytes) AS pb FROM gt JOIN tele t ON t.window_id = gt.seq_id + 9)"""


@register("ev_dynamics_mse", f"""WITH {PAIRS} SELECT {r6('avg(((pe - port_entropy) ** 2 + (ps - syn_ratio) ** 2 + (pb - log_bytes) ** 2) / 3)')} AS dynamics_mse_overall,
 {r6('avg((pe - port_entropy) ** 2)')} AS port_entropy_mse, {r6('avg((ps - syn_ratio) ** 2)')} AS syn_ratio_mse, {r6('avg((pb - log_bytes) ** 2)')} AS log_bytes_mse FROM fp""")
def _(spark, sf):
    out = ev.dynamics_mse(forecast_pairs(spark, sf))
    return rounded(out, *out.columns)


@register("ev_rollout", f"""WITH {PAIRS}, e AS (SELECT k, 'port_entropy' AS feature, pe - port_entropy AS d FROM fp UNION ALL SELECT k, 'syn_ratio', ps - syn_ratio FROM fp
 UNION ALL SELECT k, 'log_bytes', pb - log_bytes FROM fp) SELECT k, feature, {r6('avg(abs(d))')} AS mae, {r6('sqrt(avg(d * d))')} AS rmse FROM e GROUP BY ALL""")
def _(spark, sf):
    return rounded(ev.rollout(forecast_pairs(spark, sf)), "mae", "rmse")


@register("ev_rollout_heads", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (y_true > 0.5 AND y_prob > 0.5) AS tp, count(*) FILTER (y_true <= 0.5 AND y_prob > 0.5) AS fp,
 count(*) FILTER (y_true > 0.5 AND y_prob <= 0.5) AS fn, count(*) AS n_samples, avg(CASE WHEN stage_true = stage_pred THEN 1.0 ELSE 0.0 END) AS acc FROM sc)
 SELECT n_samples, {r6('acc')} AS stage_acc, {r6('tp / greatest(tp + 0.5::DOUBLE * (fp + fn), 1e-8)')} AS infil_f1 FROM c""")
def _(spark, sf):
    return rounded(ev.rollout_heads(scored(spark, sf)), "stage_acc", "infil_f1")


def model_scores(spark, sf):
    """Three score columns of the same rows, stacked as models."""
    s = scored(spark, sf)
    alt = F.pmod(F.col("k") * 13 + F.col("user_id") * 7, F.lit(101)) / F.lit(100.0)
    mix = (F.col("y_prob") + 3 * F.col("y_true")) / 4
    return s.select("pkt_id", "y_true", "stage_true", "stage_pred", F.explode(F.array(
        F.struct(F.lit("sequence model").alias("model"), mix.alias("y_prob")), F.struct(F.lit("single frame").alias("model"), F.col("y_prob")),
        F.struct(F.lit("logistic").alias("model"), alt.alias("y_prob")))).alias("m")).select("pkt_id", "y_true", "m.model", "m.y_prob")


MODELS = SCORED + """, ms AS (SELECT pkt_id, y_true, 'sequence model' AS model, (y_prob + 3 * y_true) / 4 AS y_prob FROM sc UNION ALL SELECT pkt_id, y_true, 'single frame', y_prob FROM sc
 UNION ALL SELECT pkt_id, y_true, 'logistic', ((k * 13 + user_id * 7) % 101) / 100.0::DOUBLE FROM sc)"""


def report_sql(src: str, by: str) -> str:
    return f"""rp AS (SELECT * FROM (SELECT {by}, {CONF} FROM {src} GROUP BY {by}) JOIN ({auc_sql(src, by)}) USING ({by})
 JOIN (SELECT {by}, avg((y_prob - CASE WHEN y_true > 0.5 THEN 1 ELSE 0 END) ** 2) AS brier_score FROM {src} GROUP BY {by}) USING ({by}) JOIN ({ece_sql(src, by)}) USING ({by}))"""


@register("ev_report", f"WITH {MODELS}, {report_sql('ms', 'model')}, r2 AS (SELECT *, {RATES} FROM rp) SELECT model, tp, tn, fp, fn, {r6cols(PRF + ['auroc', 'brier_score', 'ece'])} FROM r2")
def _(spark, sf):
    return rounded(ev.report(model_scores(spark, sf)), *PRF, "auroc", "brier_score", "ece")


def fixed_sql(expr: str, digits: int) -> str:
    u = f"CAST(floor(({expr}) * {float(10**digits)} + 0.5) AS BIGINT)"
    return f"(({u} // {10**digits}) || '.' || lpad(CAST({u} % {10**digits} AS VARCHAR), {digits}, '0'))"


@register("ev_benchmark", f"""WITH {MODELS}, {report_sql('ms', 'model')}, r2 AS (SELECT *, {RATES} FROM rp)
 SELECT model, {', '.join(f"{fixed_sql(c, 3)} AS {c}" for c in ('f1', 'precision', 'recall'))}, {fixed_sql('fpr * 100', 3)} || '%' AS fpr, {fixed_sql('auroc', 3)} AS auroc,
 {fixed_sql('brier_score', 4)} AS brier_score, {fixed_sql('ece', 4)} AS ece FROM r2""")
def _(spark, sf):
    return ev.benchmark_table(ev.report(model_scores(spark, sf)))


UN = ["f1", "precision", "recall", "fpr", "auroc", "brier_score"]


@register("ev_unseen", f"""WITH {SCORED}, pt AS (SELECT *, CASE WHEN stage_true IN (5, 6) OR pkt_id % 4 = 0 THEN 'unseen' ELSE 'seen' END AS part FROM sc), {report_sql('pt', 'part')}, r2 AS (SELECT *, {RATES} FROM rp)
 SELECT {', '.join(f"{r6(f'max({c}) FILTER (part = $${p}$$)').replace('$$', chr(39))} AS {c}_{p}" for p in ('seen', 'unseen') for c in UN)},
 {r6("max(f1) FILTER (part = 'unseen') / greatest(max(f1) FILTER (part = 'seen'), 1e-6)")} AS retention_ratio FROM r2""")
def _(spark, sf):
    s = scored(spark, sf)
    held = F.col("stage_true").isin(5, 6) | (F.col("pkt_id") % 4 == 0)
    out = ev.unseen(s.filter(~held), s.filter(held))
    return rounded(out, *out.columns)


JS = """lg AS (SELECT label % 2 = 0 AS l, dim, CAST(embedding[dim + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(len(embedding))) AS dim FROM embeddings)),
 rg AS (SELECT dim, min(x) AS lo, (max(x) - min(x)) / 30 AS step, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr FROM lg GROUP BY dim HAVING max(x) - min(x) >= 1e-9),
 g1 AS (SELECT lg.*, lo, step, nl, nr, floor((x - lo) / step) AS g FROM lg JOIN rg USING (dim)),
 g2 AS (SELECT *, CAST(least(greatest(CASE WHEN x < lo + g * step THEN g - 1 WHEN x >= lo + (g + 1) * step THEN g + 1 ELSE g END, 0), 29) AS INTEGER) AS b FROM g1),
 bn AS (SELECT rg.dim, i.b, rg.step, rg.nl, rg.nr FROM rg, (SELECT unnest(range(30)) AS b) i),
 h AS (SELECT bn.dim, bn.b, count(*) FILTER (l) / (bn.nl * bn.step) + 1e-7 AS dl, count(*) FILTER (NOT l) / (bn.nr * bn.step) + 1e-7 AS dr FROM bn LEFT JOIN g2 ON g2.dim = bn.dim AND g2.b = bn.b GROUP BY bn.dim, bn.b, bn.step, bn.nl, bn.nr),
 n AS (SELECT dim, dl / sum(dl) OVER (PARTITION BY dim) AS p, dr / sum(dr) OVER (PARTITION BY dim) AS q FROM h)"""


@register("ev_js_divergence", f"WITH {JS} SELECT CAST(dim AS INTEGER) AS dim, {r6('sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2)')} AS js FROM n GROUP BY dim")
def _(spark, sf):
    return rounded(ev.js_divergence(table(spark, sf, "embeddings"), "embedding", F.col("label") % 2 == 0), "js")


@register("ev_mahalanobis_fit", f"""WITH v AS (SELECT vec_id, dim, CAST(embedding[dim + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(len(embedding))) AS dim FROM embeddings))
 SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, {r6('covar_samp(a.x, b.x) + CASE WHEN a.dim = b.dim THEN 1e-4 ELSE 0 END')} AS cov FROM v a JOIN v b USING (vec_id) GROUP BY a.dim, b.dim""")
def _(spark, sf):
    return rounded(ev.covariance(table(spark, sf, "embeddings"), "embedding"), "cov")


@register("ev_mahalanobis_score")
def _(spark, sf):
    emb = table(spark, sf, "embeddings")
    scorer = ev.MahalanobisScorer.fit(emb.filter("label % 2 = 0"), "embedding")
    return rounded(emb.select("vec_id", scorer.score("embedding").alias("ood")), "ood")


@register("ev_ood_norm", "SELECT vec_id, floor(tanh(sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) / 20.0) * 10000.0 + 0.5) / 10000.0 AS ood FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ev.ood_norm("embedding").alias("ood"))


Z2 = ev.WILSON_Z**2
LO = f"greatest(0.0, ((f / n::DOUBLE + {Z2!r}::DOUBLE / (2 * n)) - {ev.WILSON_Z}::DOUBLE * sqrt((f / n::DOUBLE) * (1 - f / n::DOUBLE) / n + {Z2!r}::DOUBLE / (4 * n * n))) / (1 + {Z2!r}::DOUBLE / n))"
HI = f"least(1.0, ((f / n::DOUBLE + {Z2!r}::DOUBLE / (2 * n)) + {ev.WILSON_Z}::DOUBLE * sqrt((f / n::DOUBLE) * (1 - f / n::DOUBLE) / n + {Z2!r}::DOUBLE / (4 * n * n))) / (1 + {Z2!r}::DOUBLE / n))"
# graded truth so that all three cases occur
GRADED = SCORED + ", gr AS (SELECT * REPLACE (CASE WHEN stage_true = 0 AND user_id % 6 = 0 THEN 0.7::DOUBLE ELSE y_true END AS y_true) FROM sc)"


def graded(spark, sf):
    return scored(spark, sf).withColumn("y_true", F.when(
        (F.col("stage_true") == 0) & (F.col("user_id") % 6 == 0), F.lit(0.7)).otherwise(F.col("y_true")))


@register("ev_decomposition", f"""WITH {GRADED}, c AS (SELECT CASE WHEN stage_true > 0 THEN 'active' WHEN y_true >= 0.5 THEN 'anticipatory' ELSE 'benign' END AS "case", count(*) AS n,
 count(*) FILTER (y_prob >= 0.5) AS f FROM gr GROUP BY ALL) SELECT "case", n, f AS flagged, {r6('f / greatest(n, 1)::DOUBLE')} AS rate, {r6(LO)} AS ci_lo, {r6(HI)} AS ci_hi FROM c""")
def _(spark, sf):
    return rounded(ev.decomposition(graded(spark, sf)), "rate", "ci_lo", "ci_hi")


@register("ev_wilson", f"WITH {SCORED}, c AS (SELECT dst_ip, count(*) AS n, count(*) FILTER (y_prob >= 0.5) AS f FROM sc GROUP BY ALL) SELECT dst_ip, {r6(LO)} AS lo, {r6(HI)} AS hi FROM c")
def _(spark, sf):
    c = scored(spark, sf).groupBy("dst_ip").agg(F.count("*").alias("n"), F.count_if(F.col("y_prob") >= 0.5).alias("f"))
    w = ev.wilson("f", "n")
    return rounded(c.select("dst_ip", w["lo"].alias("lo"), w["hi"].alias("hi")), "lo", "hi")


@register("ev_head_disagree", f"""WITH {GRADED}, d AS (SELECT *, CASE WHEN y_prob >= 0.5 AND stage_pred = 0 THEN 'risk_only' WHEN y_prob < 0.5 AND stage_pred > 0 THEN 'stage_only' END AS disagreement,
 y_true >= 0.5 AND y_prob < 0.5 AS missed FROM gr) SELECT pkt_id, disagreement, missed FROM d WHERE disagreement IS NOT NULL OR missed""")
def _(spark, sf):
    return ev.head_disagreement(graded(spark, sf)).select("pkt_id", "disagreement", "missed")


@register("ev_mc_summary", f"""WITH {SCORED}, m AS (SELECT src_ip, avg(y_prob) AS mean, coalesce(stddev_samp(y_prob), 0) AS sd FROM sc GROUP BY ALL)
 SELECT src_ip, {r6('mean')} AS mean_probability, {r6('sd')} AS uncertainty_std, {r6('greatest(0.0, mean - 1.96 * sd)')} AS confidence_lower, {r6('least(1.0, mean + 1.96 * sd)')} AS confidence_upper FROM m""")
def _(spark, sf):
    out = ev.mc_summary(scored(spark, sf), "src_ip")
    return rounded(out, *[c for c in out.columns if c != "src_ip"])


@register("ev_doc_labels", """WITH s AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y_true, (doc_id * 37 % 1001) / 1000.0::DOUBLE AS y_prob FROM labels) SELECT """ + CONF + " FROM s")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    return ev.confusion(lab.select("doc_id", F.col("quality").cast("double").alias("y_true"),
                                   (F.col("doc_id") * 37 % 1001 / F.lit(1000.0)).alias("y_prob")))


@register("ev_unseen_shift")
def _(spark, sf):
    emb = table(spark, sf, "embeddings")
    return ev.unseen_shift(emb.filter("label % 2 = 0"), emb.filter("label % 2 = 1"), "embedding")
