"""Time windows and sequences (2.5)."""

from pyspark.sql import functions as F

from catalog.common import PACKETS, r6, register, rounded
from catalog.label_sql import ANNOTATED
from packetloom.config import WindowSpec
from packetloom.operators import labels, sequences, windows
from packetloom.sources.telemetry import packets

SPEC = WindowSpec()
B = """, o AS (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM p),
grid AS (SELECT window_id, t0 + window_id * 2500000 AS start_us, t0 + window_id * 2500000 + 5000000 AS end_us
  FROM (SELECT t0, unnest(range(CAST(floor((t1 - t0) / 2500000.0) AS BIGINT) + 1)) AS window_id FROM o))"""


def pw(src: str = "p", dst: str = "pw") -> str:
    return f""", {dst} AS (SELECT x.*, unnest(range(greatest(0, CAST(floor((ts_us - t0 - 5000000) / 2500000.0) AS BIGINT) + 1),
   CAST(floor((ts_us - t0) / 2500000.0) AS BIGINT) + 1)) AS window_id FROM {src} x, o)"""


PW = PACKETS + B + pw()


@register("win_grid", f"WITH {PACKETS}{B} SELECT * FROM grid")
def _(spark, sf):
    return windows.grid(packets(spark, sf), SPEC)


@register("win_assign", f"WITH {PW} SELECT pkt_id, window_id FROM pw")
def _(spark, sf):
    return windows.assign(packets(spark, sf), SPEC).select("pkt_id", "window_id")


@register("win_full_only", f"WITH {PACKETS}{B} SELECT grid.* FROM grid, o WHERE end_us <= t1 "
          "UNION ALL SELECT 0, t0, t1 FROM o WHERE t1 - t0 < 5000000")
def _(spark, sf):
    return windows.grid_complete_only(packets(spark, sf), SPEC)


CNT = PW + ", cnt AS (SELECT window_id, count(*) AS n_rows FROM pw GROUP BY window_id)"


@register("win_fill_report", f"""WITH {CNT}, f AS (SELECT coalesce(n_rows, 0) AS n FROM grid LEFT JOIN cnt USING (window_id))
 SELECT count(*) AS n_windows, count(*) FILTER (n = 0) AS n_empty, min(n) AS min_count, max(n) AS max_count,
 CAST(median(n) AS DOUBLE) AS median_count, {r6('count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE)')} AS empty_rate FROM f""")
def _(spark, sf):
    return rounded(windows.fill_report(packets(spark, sf), SPEC), "empty_rate")


@register("win_min_rows", f"WITH {CNT} SELECT * FROM cnt WHERE n_rows >= 2")
def _(spark, sf):
    return windows.dense_windows(packets(spark, sf), SPEC)


SEQ = PACKETS + B + """, seq AS (SELECT window_id AS seq_id, window_id AS first_window, window_id + 9 AS last_window,
  start_us AS input_start_us, start_us + 27500000 AS input_end_us FROM grid
  WHERE window_id + 9 <= (SELECT max(window_id) FROM grid))"""
TGT = """, tgt AS (SELECT *, input_end_us + k * 5000000 AS target_start_us, input_end_us + k * 5000000 + 5000000 AS target_end_us
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM seq))"""


@register("seq_build", f"WITH {SEQ} SELECT * FROM seq")
def _(spark, sf):
    return sequences.build(packets(spark, sf), SPEC)


@register("win_targets", f"WITH {SEQ}{TGT} SELECT seq_id, k, target_start_us, target_end_us FROM tgt")
def _(spark, sf):
    return sequences.targets(sequences.build(packets(spark, sf), SPEC), SPEC).select(
        "seq_id", "k", "target_start_us", "target_end_us")


@register("seq_leak_check", f"WITH {SEQ}{TGT} SELECT seq_id, k FROM tgt WHERE target_start_us < input_end_us")
def _(spark, sf):
    return sequences.leaks(sequences.build(packets(spark, sf), SPEC), SPEC).select("seq_id", "k")


VALID = """, valid AS (SELECT seq_id FROM seq JOIN (SELECT window_id, n_rows FROM (SELECT window_id, count(*) AS n_rows FROM pw GROUP BY window_id) WHERE n_rows >= 2) d
  ON d.window_id BETWEEN first_window AND last_window GROUP BY seq_id HAVING count(*) = 10)"""


@register("seq_valid", f"WITH {SEQ}{pw()}{VALID} SELECT seq_id FROM valid")
def _(spark, sf):
    return sequences.complete_ids(packets(spark, sf), SPEC)


def captures(spark, sf, size: int):
    """Packets with the capture of ``size`` consecutive packets that they belong to; every other capture runs a day ahead."""
    p = packets(spark, sf).withColumn("capture", F.floor(F.col("pkt_id") / size))
    return p.withColumn("ts_us", F.col("ts_us") + F.col("capture") % 2 * 86_400_000_000)


def capture_sql(size: int) -> str:
    return f""", cp AS (SELECT * REPLACE (ts_us + (pkt_id // {size}) % 2 * 86400000000 AS ts_us), pkt_id // {size} AS capture FROM p),
 cb AS (SELECT capture, min(ts_us) AS t0, CAST(floor((max(ts_us) - min(ts_us)) / 2500000.0) AS BIGINT) + 1 AS n FROM cp GROUP BY capture),
 cg AS (SELECT capture, n, window_id, t0 + window_id * 2500000 AS start_us, t0 + window_id * 2500000 + 5000000 AS end_us
  FROM (SELECT *, unnest(range(n)) AS window_id FROM cb))"""


@register("win_grid_capture", f"WITH {PACKETS}{capture_sql(1000)} SELECT capture, window_id, start_us, end_us FROM cg")
def _(spark, sf):
    return windows.scoped_grid(captures(spark, sf, 1000), ["capture"], SPEC)


@register("win_assign_capture", f"""WITH {PACKETS}{capture_sql(1000)} SELECT pkt_id, cp.capture, unnest(range(
  greatest(0, CAST(floor((ts_us - t0 - 5000000) / 2500000.0) AS BIGINT) + 1), CAST(floor((ts_us - t0) / 2500000.0) AS BIGINT) + 1)) AS window_id
 FROM cp JOIN cb ON cp.capture = cb.capture""")
def _(spark, sf):
    return windows.scoped_assign(captures(spark, sf, 1000), ["capture"], SPEC).select("pkt_id", "capture", "window_id")


@register("seq_build_capture", f"""WITH {PACKETS}{capture_sql(1000)} SELECT capture, row_number() OVER (ORDER BY capture, window_id) - 1 AS seq_id,
 window_id AS first_window, window_id + 9 AS last_window, start_us AS input_start_us, start_us + 27500000 AS input_end_us FROM cg WHERE window_id + 10 <= n""")
def _(spark, sf):
    return sequences.scoped_build(captures(spark, sf, 1000), ["capture"], SPEC)


@register("seq_pad", f"""WITH {PACKETS}{capture_sql(20)} SELECT capture, pos, least(pos, n - 1) AS window_id,
 t0 + least(pos, n - 1) * 2500000 AS start_us, t0 + least(pos, n - 1) * 2500000 + 5000000 AS end_us FROM (SELECT *, unnest(range(10))::INTEGER AS pos FROM cb)""")
def _(spark, sf):
    return sequences.scoped_padded(captures(spark, sf, 20), ["capture"], SPEC)


MAL = ANNOTATED + B.replace("FROM p)", "FROM ann)") + """, mal AS (SELECT ts_us FROM ann WHERE label_malicious),
 seq AS (SELECT window_id AS seq_id, start_us AS input_start_us, start_us + 27500000 AS input_end_us FROM grid
  WHERE window_id + 9 <= (SELECT max(window_id) FROM grid)),
 nx AS (SELECT s.seq_id, s.input_start_us, s.input_end_us, min(m.ts_us) AS nin FROM seq s ASOF LEFT JOIN
   (SELECT DISTINCT ts_us FROM mal) m ON s.input_start_us <= m.ts_us GROUP BY ALL),
 nf AS (SELECT nx.*, m.ts_us AS nfut FROM nx ASOF LEFT JOIN (SELECT DISTINCT ts_us FROM mal) m ON nx.input_end_us <= m.ts_us),
 graded AS (SELECT seq_id,
  CASE WHEN nin <= input_end_us THEN 1.0 WHEN nfut - input_end_us <= 20000000 THEN 1.0
   WHEN nfut - input_end_us <= 30000000 THEN exp(-((nfut - input_end_us) / 1e6) / 10.0) ELSE 0.0 END AS infil_target,
  CASE WHEN nin <= input_end_us THEN 'active' WHEN nfut - input_end_us <= 20000000 THEN 'horizon'
   WHEN nfut - input_end_us <= 30000000 THEN 'decayed' ELSE 'none' END AS branch FROM nf)"""


@register("seq_graded_target", f"WITH {MAL} SELECT seq_id, {r6('infil_target')} AS infil_target, branch FROM graded")
def _(spark, sf):
    marked = labels.annotate(packets(spark, sf))
    return rounded(sequences.graded_target(marked, F.col("label_malicious"), SPEC), "infil_target")


@register("anticipation_point", f"""WITH {PACKETS}, a AS (SELECT min(ts_us) FILTER (trim(label) = 'exfiltration') AS t FROM p)
 SELECT pkt_id, {r6("CASE WHEN t IS NULL THEN 0.0 WHEN t <= ts_us THEN 1.0 ELSE exp(-((t - ts_us) / 1e6) / 10.0) END")} AS target FROM p, a""")
def _(spark, sf):
    p = packets(spark, sf)
    onset = p.filter(F.trim("label") == "exfiltration").agg(F.min("ts_us")).scalar()
    return rounded(p.select("pkt_id", sequences.anticipation("ts_us", onset).alias("target")), "target")


TELE = """, pc AS (SELECT window_id, dst_port, count(*) AS c FROM pw GROUP BY ALL),
 ent AS (SELECT window_id, sum(-(c / t) * log2(c / t + 1e-12)) AS port_entropy FROM
   (SELECT *, CAST(sum(c) OVER (PARTITION BY window_id) AS DOUBLE) AS t FROM pc) GROUP BY window_id),
 tele AS (SELECT window_id, port_entropy, count(*) AS n_rows, sum(CAST(flag_syn AS INT)) AS syn, sum(CAST(flag_ack AS INT)) AS ack,
   sum(payload_size) AS bytes FROM pw JOIN ent USING (window_id) GROUP BY ALL)"""


@register("entropy", f"WITH {PW}{TELE} SELECT window_id, {r6('port_entropy')} AS entropy FROM ent")
def _(spark, sf):
    rows = windows.assign(packets(spark, sf), SPEC)
    return rounded(windows.entropy(rows, ["window_id"], "dst_port"), "entropy")


@register("snapshot_dynamics", f"""WITH {PW}{TELE} SELECT window_id, {r6('port_entropy')} AS port_entropy,
 {r6('syn / greatest(CAST(syn + ack AS DOUBLE), 1.0)')} AS syn_ratio, {r6('ln(1 + bytes)')} AS log_bytes FROM tele""")
def _(spark, sf):
    return rounded(windows.snapshot_dynamics(packets(spark, sf), SPEC), "port_entropy", "syn_ratio", "log_bytes")


@register("empty_snapshot", f"""WITH {PW}{TELE} SELECT window_id, start_us, end_us, CASE WHEN n_rows >= 2 THEN n_rows ELSE 0 END AS n_rows,
 {r6('CASE WHEN n_rows >= 2 THEN port_entropy ELSE 0 END')} AS port_entropy,
 {r6('CASE WHEN n_rows >= 2 THEN syn / greatest(CAST(syn + ack AS DOUBLE), 1.0) ELSE 0 END')} AS syn_ratio,
 {r6('CASE WHEN n_rows >= 2 THEN ln(1 + bytes) ELSE 0 END')} AS log_bytes, coalesce(n_rows < 2, true) AS is_empty
 FROM grid LEFT JOIN tele USING (window_id)""")
def _(spark, sf):
    return rounded(windows.snapshots_with_empty(packets(spark, sf), SPEC, min_rows=2),
                   "port_entropy", "syn_ratio", "log_bytes")


GROUND = f"""{SEQ}{TGT}{pw()}{TELE}, gt AS (SELECT seq_id, k, coalesce(port_entropy, 0) AS port_entropy,
 coalesce(syn / CAST(n_rows AS DOUBLE), 0) AS syn_ratio, coalesce(ln(1 + bytes), 0) AS log_bytes
 FROM tgt LEFT JOIN (SELECT tele.*, start_us FROM tele JOIN grid USING (window_id)) x ON x.start_us = target_start_us)"""


@register("seq_grounded_targets", f"""WITH {GROUND} SELECT seq_id, k, {r6('port_entropy')} AS port_entropy,
 {r6('syn_ratio')} AS syn_ratio, {r6('log_bytes')} AS log_bytes FROM gt""")
def _(spark, sf):
    return rounded(sequences.grounded_targets(packets(spark, sf), SPEC), "port_entropy", "syn_ratio", "log_bytes")


AW = ANNOTATED + B.replace("FROM p)", "FROM ann)") + pw("ann", "aw")
MODE = """, sc AS (SELECT window_id, mitre_stage_id AS s, count(*) AS n, sum(CAST(mitre_confidence AS DECIMAL(18,6))) AS c FROM aw GROUP BY ALL),
 wm AS (SELECT window_id, first(s ORDER BY n DESC, s) AS stage, CAST(sum(c) AS DOUBLE) / sum(n) AS confidence FROM sc GROUP BY window_id)"""


@register("win_stage_mode", f"WITH {AW}{MODE} SELECT window_id, stage, {r6('confidence')} AS confidence FROM wm")
def _(spark, sf):
    return rounded(windows.stage_mode(labels.annotate(packets(spark, sf)), SPEC), "confidence")


LAB = """, sc AS (SELECT window_id, mitre_stage_id AS s, count(*) AS n, CAST(sum(CAST(mitre_confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS m FROM aw GROUP BY ALL),
 wl AS (SELECT window_id, first(s ORDER BY n DESC, s) FILTER (s > 0) AS bs, first(m ORDER BY n DESC, s) FILTER (s > 0) AS bm,
   max(m) FILTER (s = 0) AS gm, CAST(coalesce(sum(n) FILTER (s > 0), 0) AS BIGINT) AS nb FROM sc GROUP BY window_id)"""
NAMES = "['Benign','Reconnaissance','Initial Access','Credential Access','Lateral Movement','Command & Control','Exfiltration']"


@register("win_attack_label", f"""WITH {AW}{LAB} SELECT window_id, CASE WHEN nb >= 2 THEN bs ELSE 0 END AS stage,
 ({NAMES})[(CASE WHEN nb >= 2 THEN bs ELSE 0 END) + 1] AS stage_name,
 {r6('CASE WHEN nb IS NULL THEN 1.0 WHEN nb >= 2 THEN bm ELSE coalesce(gm, 0.95) END')} AS confidence,
 coalesce(nb >= 2, false) AS is_malicious FROM grid LEFT JOIN wl USING (window_id)""")
def _(spark, sf):
    marked = labels.annotate(packets(spark, sf))
    return rounded(windows.attack_label(marked, SPEC, min_malicious=2), "confidence")


@register("win_attack_label_raw", f"""WITH {ANNOTATED}{B.replace("FROM p)", "FROM ann)")}{pw("ann", "aw")},
 sc AS (SELECT window_id, label_stage AS s, count(*) AS n FROM aw GROUP BY ALL),
 wl AS (SELECT window_id, first(s ORDER BY n DESC, s) FILTER (s > 0) AS bs, coalesce(sum(n) FILTER (s > 0), 0) AS nb FROM sc GROUP BY window_id)
 SELECT window_id, coalesce(bs, 0) AS stage, ({NAMES})[coalesce(bs, 0) + 1] AS stage_name,
 CASE WHEN nb >= 1 THEN 0.85 WHEN nb IS NULL THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, coalesce(nb >= 1, false) AS is_malicious
 FROM grid LEFT JOIN wl USING (window_id)""")
def _(spark, sf):
    return windows.attack_label_raw(labels.map_labels(packets(spark, sf)), SPEC)


WL = f"{AW}{LAB}, st AS (SELECT window_id, CASE WHEN nb >= 1 THEN bs ELSE 0 END AS stage FROM grid LEFT JOIN wl USING (window_id))"


@register("stage_transitions", f"""WITH {WL}, x AS (SELECT window_id, stage AS from_stage, lead(stage) OVER (ORDER BY window_id) AS to_stage FROM st)
 SELECT * FROM x WHERE to_stage IS NOT NULL""")
def _(spark, sf):
    return windows.stage_transitions(windows.attack_label(labels.annotate(packets(spark, sf)), SPEC))


@register("stage_transition_matrix", f"""WITH {WL}, x AS (SELECT stage AS from_stage, lead(stage) OVER (ORDER BY window_id) AS to_stage FROM st)
 SELECT from_stage, to_stage, count(*) AS n FROM x WHERE to_stage IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return windows.transition_matrix(windows.attack_label(labels.annotate(packets(spark, sf)), SPEC))


SEQSTAGE = MODE + """, gm AS (SELECT window_id, coalesce(stage, 0) AS stage, coalesce(confidence, 0.5) AS confidence FROM grid LEFT JOIN wm USING (window_id)),
 ss AS (SELECT a.window_id - 8 AS seq_id, least(a.stage, b.stage) AS stage, (a.confidence + b.confidence) / 2 AS confidence
   FROM gm a JOIN gm b ON b.window_id = a.window_id + 1 WHERE a.window_id >= 8)"""


@register("seq_stage", f"WITH {AW}{SEQSTAGE} SELECT seq_id, stage, {r6('confidence')} AS confidence FROM ss")
def _(spark, sf):
    return rounded(sequences.sequence_stage(labels.annotate(packets(spark, sf)), SPEC), "confidence")


VALID_A = """, valid AS (SELECT seq_id FROM (SELECT g.window_id, unnest(range(greatest(0, g.window_id - 9), g.window_id + 1)) AS seq_id
   FROM (SELECT window_id FROM aw GROUP BY window_id HAVING count(*) >= 2) g)
   WHERE seq_id + 9 <= (SELECT max(window_id) FROM grid) GROUP BY seq_id HAVING count(*) = 10)"""


@register("seq_timeline", f"""WITH {MAL}{pw("ann", "aw")}{SEQSTAGE}{VALID_A},
 sp AS (SELECT g.window_id - 9 AS seq_id, ((g.window_id * 37) % 1001) / 1000.0 AS y_prob FROM grid g WHERE g.window_id >= 9)
 SELECT seq_id, {r6('input_start_us / 1e6')} AS in_start, {r6('input_end_us / 1e6')} AS in_end, ss.stage AS stage_true,
 {r6('infil_target')} AS infil_target, {r6('y_prob')} AS y_prob
 FROM valid JOIN seq USING (seq_id) JOIN graded USING (seq_id) JOIN ss USING (seq_id) JOIN sp USING (seq_id)""")
def _(spark, sf):
    marked = labels.annotate(packets(spark, sf))
    rows = sequences.samples(marked, F.col("label_malicious"), SPEC)
    scored = sequences.build(marked, SPEC).select(
        "seq_id", (F.pmod(F.col("last_window") * 37, F.lit(1001)) / F.lit(1000.0)).alias("y_prob"))
    return rounded(sequences.timeline(rows, scored), "in_start", "in_end", "infil_target", "y_prob")
