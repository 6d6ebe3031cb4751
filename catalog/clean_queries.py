"""Cleaning, scalar expressions, adapters (2.2) and sampling (2.3)."""

from pyspark.sql import functions as F

from catalog import derived
from catalog.common import PACKETS, private, r6, register, rounded
from catalog.label_sql import ANNOTATED
from catalog.topology_queries import NVD, cve_items
from catalog.window_queries import MAL, SEQSTAGE, SPEC, VALID_A, pw
from packetloom import fixed_values as fv
from packetloom.functions.columns import finite_or, private_ip
from packetloom.operators import adapters, cleaning, knowledge, labels, sampling, sequences
from packetloom.sources.telemetry import packets, table

# Vendor table with original headers: rates are text with infinities and gaps.
VENDOR_EXPR = {
    "Src IP": "src_ip", " Source Port ": "src_port", "Dst IP": "dst_ip", "Destination Port": "dst_port", "Protocol": "protocol",
    "Timestamp": "CASE WHEN pkt_id % 50 = 0 THEN 'n/a' ELSE date_format(timestamp_seconds(CAST(floor(ts_us / 60000000) * 60 AS BIGINT)), 'dd/MM/yyyy HH:mm:ss') END",
    "Label": "label",
    "Flow Byts/s": "CASE WHEN k % 10 = 0 THEN 'Infinity' WHEN k % 10 = 1 THEN NULL WHEN k % 10 = 2 THEN 'bad' WHEN k % 10 = 3 THEN '-inf' ELSE CAST(payload_size / 4.0D AS STRING) END",
    "Flow Packets/s": "CASE WHEN k % 9 = 0 THEN 'inf' ELSE CAST(user_id / 2.0D AS STRING) END",
    "SYN Flag Cnt": "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(flag_syn AS INT) END",
    "Flow Duration": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(payload_size AS DOUBLE) END",
    "Fwd/Bwd Ratio": "CAST(k AS DOUBLE)", "pkt_id": "pkt_id",
}


def vendor(spark, sf):
    return packets(spark, sf).selectExpr(*[f"{e} AS `{n}`" for n, e in VENDOR_EXPR.items()])


MIN_S = "CAST(floor(ts_us / 60000000.0) AS BIGINT) * 60"
VEN = PACKETS + f""", v AS (SELECT pkt_id, ts_us, src_ip, src_port, dst_ip, dst_port, protocol, label, pkt_id % 50 = 0 AS bad_ts, {MIN_S} AS ts_s,
 CASE WHEN k % 10 IN (0, 3) THEN 'i' WHEN k % 10 IN (1, 2) THEN NULL ELSE 'v' END AS bk, payload_size / 4.0 AS bv,
 CASE WHEN k % 9 = 0 THEN 'i' ELSE 'v' END AS pk, user_id / 2.0 AS pv,
 CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(flag_syn AS INTEGER) END AS syn_flag_cnt,
 CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(payload_size AS DOUBLE) END AS flow_duration, CAST(k AS DOUBLE) AS fwd_bwd_ratio FROM p),
 qb AS (SELECT quantile_cont(bv, 0.99) FILTER (bk = 'v') AS b99, median(bv) FILTER (bk = 'v') AS bm,
   quantile_cont(pv, 0.99) FILTER (pk = 'v') AS p99, median(pv) FILTER (pk = 'v') AS pm, median(flow_duration) AS dm FROM v)"""
RATE_SQL = f"{r6('CASE bk WHEN $i$ THEN b99 WHEN $v$ THEN bv ELSE bm END')} AS flow_byts_s, {r6('CASE pk WHEN $i$ THEN p99 WHEN $v$ THEN pv ELSE pm END')} AS flow_pkts_s".replace("$", "'")


@register("std_columns", f"WITH {VEN} SELECT pkt_id, src_ip, src_port, dst_ip, dst_port, protocol, label, syn_flag_cnt, flow_duration, fwd_bwd_ratio FROM v")
def _(spark, sf):
    return cleaning.standardize_columns(vendor(spark, sf)).drop("timestamp", "flow_byts_s", "flow_pkts_s")


@register("label_trim", f"WITH {PACKETS} SELECT pkt_id, trim(label) AS label FROM p")
def _(spark, sf):
    return cleaning.trim_labels(packets(spark, sf)).select("pkt_id", "label")


@register("require_endpoints", f"WITH {PACKETS} SELECT pkt_id, src_ip, dst_ip FROM p")
def _(spark, sf):
    return cleaning.require_endpoints(packets(spark, sf)).select("pkt_id", "src_ip", "dst_ip")


@register("impute_inf_rates", f"WITH {VEN} SELECT pkt_id, {RATE_SQL} FROM v, qb")
def _(spark, sf):
    out = cleaning.impute_rates(cleaning.standardize_columns(vendor(spark, sf)))
    return rounded(out.select("pkt_id", *cleaning.RATES), *cleaning.RATES)


@register("impute_numeric", f"""WITH {VEN} SELECT pkt_id, coalesce(syn_flag_cnt, 0) AS syn_flag_cnt, {r6('coalesce(flow_duration, dm)')} AS flow_duration,
 {r6('fwd_bwd_ratio')} AS fwd_bwd_ratio FROM v, qb""")
def _(spark, sf):
    std = cleaning.standardize_columns(vendor(spark, sf)).select(
        F.col("pkt_id").cast("string").alias("row"), "syn_flag_cnt", "flow_duration", "fwd_bwd_ratio")
    out = cleaning.impute_numeric(std).withColumn("pkt_id", F.col("row").cast("bigint")).drop("row")
    return rounded(out, "flow_duration", "fwd_bwd_ratio")


@register("parse_ts", f"WITH {VEN} SELECT pkt_id, ts_s AS unix_s FROM v WHERE NOT bad_ts")
def _(spark, sf):
    out = cleaning.parse_times(cleaning.standardize_columns(vendor(spark, sf)))
    return out.select("pkt_id", F.unix_seconds("timestamp").alias("unix_s"))


@register("ts_to_unix", f"""WITH {VEN} SELECT pkt_id, CASE WHEN bad_ts THEN NULL ELSE CAST(ts_s AS DOUBLE) END AS from_text,
 {r6('epoch_us(ts) / 1e6')} AS from_time, CAST(event_id AS DOUBLE) AS from_number FROM v JOIN events ON event_id = pkt_id""")
def _(spark, sf):
    v = cleaning.standardize_columns(vendor(spark, sf))
    e = table(spark, sf, "events").select(F.col("event_id").alias("pkt_id"), "ts", "event_id")
    text = v.select("pkt_id", cleaning.unix_seconds(v, "timestamp").alias("from_text"))
    typed_ = e.select("pkt_id", cleaning.unix_seconds(e, "ts").alias("from_time"), cleaning.unix_seconds(e, "event_id").alias("from_number"))
    return rounded(text.join(typed_, "pkt_id"), "from_time")


@register("dedupe_flows", f"""WITH {PACKETS}, d AS (SELECT *, CAST(floor(ts_us / 60000000.0) AS BIGINT) AS timestamp FROM p)
 SELECT pkt_id FROM d QUALIFY row_number() OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol, timestamp ORDER BY ts_us, pkt_id) = 1""")
def _(spark, sf):
    p = packets(spark, sf).withColumn("timestamp", F.floor(F.col("ts_us") / 60_000_000))
    return cleaning.dedupe_flows(p, ["ts_us", "pkt_id"]).select("pkt_id")


@register("clean_flows", f"""WITH {VEN}, r AS (SELECT v.*, CASE bk WHEN 'i' THEN b99 WHEN 'v' THEN bv ELSE bm END AS fb,
   CASE pk WHEN 'i' THEN p99 WHEN 'v' THEN pv ELSE pm END AS fp, coalesce(syn_flag_cnt, 0) AS sc, coalesce(flow_duration, dm) AS fd FROM v, qb WHERE NOT bad_ts)
 SELECT src_ip, src_port, dst_ip, dst_port, protocol, ts_s AS unix_s, trim(label) AS label, {r6('fb')} AS flow_byts_s, {r6('fp')} AS flow_pkts_s,
  sc AS syn_flag_cnt, {r6('fd')} AS flow_duration FROM r
 QUALIFY row_number() OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol, ts_s ORDER BY pkt_id) = 1""")
def _(spark, sf):
    v = vendor(spark, sf).withColumn("pkt_id", F.lpad(F.col("pkt_id").cast("string"), 15, "0"))
    out = cleaning.clean_flows(v, order=("pkt_id",)).withColumn("unix_s", F.unix_seconds("timestamp"))
    return rounded(out.drop("timestamp", "pkt_id", "fwd_bwd_ratio"), *cleaning.RATES, "flow_duration")


@register("proto_filter", f"WITH {PACKETS} SELECT pkt_id, protocol FROM p WHERE protocol = 17")
def _(spark, sf):
    return cleaning.protocol_filter(packets(spark, sf), "udp").select("pkt_id", "protocol")


@register("packet_limit", f"WITH {PACKETS} SELECT pkt_id, ts_us FROM p ORDER BY ts_us, pkt_id LIMIT 500")
def _(spark, sf):
    return cleaning.first_packets(packets(spark, sf), 500).select("pkt_id", "ts_us")


@register("finite_guard", f"""WITH {PACKETS} SELECT pkt_id, {r6("CASE WHEN k % 4 = 0 OR k % 4 = 1 OR tcp_window IS NULL THEN 64.0 ELSE tcp_window / CAST(k AS DOUBLE) END")} AS guarded FROM p""")
def _(spark, sf):
    raw = (F.when(F.col("k") % 4 == 0, F.lit(float("nan"))).when(F.col("k") % 4 == 1, F.lit(float("-inf")))
           .otherwise(F.try_divide(F.col("tcp_window").cast("double"), F.col("k"))))
    return rounded(packets(spark, sf).select("pkt_id", finite_or(raw, 64.0).alias("guarded")), "guarded")


@register("private_ip", f"WITH {PACKETS} SELECT pkt_id, {private('src_ip')} AS src_private, {private('dst_ip')} AS dst_private FROM p")
def _(spark, sf):
    return packets(spark, sf).select("pkt_id", private_ip("src_ip").alias("src_private"), private_ip("dst_ip").alias("dst_private"))


def proto_sql(table_, c="protocol"):
    return "CASE " + " ".join(f"WHEN lower({c}) = '{n}' THEN {v}" for n, v in table_.items()) + " ELSE 6 END"


PN = proto_sql(fv.PROTOCOL_NUMBERS)


@register("proto_number", f"WITH {derived.UNSW} SELECT rec_id, {PN} AS protocol_number FROM rec")
def _(spark, sf):
    return derived.unsw(spark, sf).select("rec_id", adapters.protocol_number("protocol", fv.PROTOCOL_NUMBERS).alias("protocol_number"))


PORT = "coalesce(CAST(try_cast({c} AS DOUBLE) AS INTEGER), 0)"
SMALL = ["payload_size", "ttl", "tcp_window"]


@register("adapt_unsw", f"""WITH {derived.UNSW} SELECT rec_id, source_ip AS src_ip, destination_ip AS dst_ip, {PORT.format(c='source_port')} AS src_port,
 {PORT.format(c='destination_port')} AS dst_port, {PN} AS protocol, {r6('least(greatest(sbytes / CAST(greatest(spkts, 1) AS DOUBLE), 0), 65535)')} AS payload_size,
 {PN} = 6 AND swin > 0 AS flag_syn, {PN} = 6 AND tcprtt > 0 AS flag_ack, lower(state) = 'rst' AS flag_rst, lower(state) = 'fin' AS flag_fin,
 {r6('least(greatest(sttl, 1), 255)')} AS ttl, {r6('swin')} AS tcp_window, sloss > 0 AS is_retransmission,
 upper(substr(trim(attack_label), 1, 1)) || lower(substr(trim(attack_label), 2)) AS label FROM rec""")
def _(spark, sf):
    return rounded(adapters.from_unsw(derived.unsw(spark, sf), ("rec_id",)), *SMALL)


ZP = proto_sql(fv.ZEEK_PROTOCOL_NUMBERS, "proto")
DET = "CASE WHEN trim(detailedlabel) NOT IN ('', '-') THEN trim(detailedlabel) ELSE '{f}' END"
ZL = f"""CASE WHEN contains(lower(capture_file), 'portscan') OR contains(lower(detailedlabel), 'portscan') THEN 'PortScan'
 WHEN contains(lower(capture_file), 'malware') OR contains(lower(detailedlabel), 'botnet') OR contains(lower(detailedlabel), 'cc') THEN {DET.format(f='From_Malware')}
 WHEN lower(trim(label)) IN ('malicious', 'attack') THEN {DET.format(f='Malicious')} ELSE 'Benign' END"""
ZEEK_OUT = f"""rec_id, orig_h AS src_ip, resp_h AS dst_ip, {PORT.format(c='orig_p')} AS src_port, {PORT.format(c='resp_p')} AS dst_port, {ZP} AS protocol,
 {r6('least(coalesce(try_cast(orig_ip_bytes AS DOUBLE), 0) + coalesce(try_cast(resp_ip_bytes AS DOUBLE), 0), 65535)')} AS payload_size,
 regexp_matches(history, '[Ss]') AS flag_syn, regexp_matches(history, '[AaHh]') AS flag_ack, regexp_matches(history, '[Rr]') AS flag_rst,
 regexp_matches(history, '[Ff]') AS flag_fin, CAST(64 AS DOUBLE) AS ttl, CAST(1024 AS DOUBLE) AS tcp_window,
 CAST(missed_bytes AS DOUBLE) > 0 OR length(history) - length(replace(history, 'S', '')) > 1 AS is_retransmission, {ZL} AS label"""


@register("adapt_zeek", f"WITH {derived.ZEEK} SELECT {ZEEK_OUT} FROM rec")
def _(spark, sf):
    return rounded(adapters.from_zeek(derived.zeek(spark, sf), ("rec_id",)), *SMALL)


IND = " ".join(f"WHEN {n} > 0 THEN {p}" for n, p in reversed(adapters.INDICATOR_PORTS))


@register("adapt_iot", f"""WITH {derived.IOT} SELECT rec_id, CASE {IND} ELSE 80 END AS dst_port, coalesce(CAST(trunc(protocol_type) AS INTEGER), 6) AS protocol,
 {r6('least(coalesce(tot_size, 64), 65535)')} AS payload_size, syn_flag_number > 0 AS flag_syn, ack_flag_number > 0 AS flag_ack, rst_flag_number > 0 AS flag_rst,
 fin_flag_number > 0 AS flag_fin, CAST(64 AS DOUBLE) AS ttl, CAST(1024 AS DOUBLE) AS tcp_window, cwr_flag_number > 0 AS is_retransmission,
 {r6('least(greatest(coalesce(iat, 0) / 1e6, 0), 60)')} AS flow_iat_mean, label FROM rec""")
def _(spark, sf):
    return rounded(adapters.from_iot(derived.iot(spark, sf), ("rec_id",)), *SMALL, "flow_iat_mean")


@register("spread_minute", f"""WITH {PACKETS}, m AS (SELECT pkt_id, {MIN_S} AS minute FROM p)
 SELECT pkt_id, {r6('minute + ((row_number() OVER (PARTITION BY minute ORDER BY pkt_id) - 1) / CAST(count(*) OVER (PARTITION BY minute) AS DOUBLE)) * 59.9')} AS timestamp FROM m""")
def _(spark, sf):
    p = packets(spark, sf).select("pkt_id", (F.floor(F.col("ts_us") / 60_000_000) * 60).alias("minute"))
    return rounded(cleaning.spread_minutes(p, "minute", ["pkt_id"]).select("pkt_id", "timestamp"), "timestamp")


def shash(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def unit(seed: int, key: str) -> str:
    return f"({shash(seed, key)} / {float(2**60)!r})"


def phase_sql(source: str, label: str, key: str) -> str:
    def band(lo, hi):
        return f"({lo}::DOUBLE + {unit(42, key)} * {hi - lo!r}::DOUBLE)"
    whens = []
    if source == "unsw":
        pick = " ".join(f"WHEN {unit(43, key)} < {s}::DOUBLE THEN {band(lo, hi)}" for s, lo, hi in cleaning.UNSW_NORMAL)
        whens.append(f"WHEN contains(lower({label}), 'normal') THEN CASE {pick} END")
    other = ""
    for words, lo, hi in cleaning.PHASES[source]:
        if words:
            whens.append("WHEN " + " OR ".join(f"contains(lower({label}), '{w}')" for w in words) + f" THEN {band(lo, hi)}")
        else:
            other = band(lo, hi)
    return f"CASE {' '.join(whens)} ELSE {other} END"


@register("kill_chain_phase", f"""WITH {derived.UNSW}, z(rec_id, l) AS (SELECT rec_id, {ZL} FROM ({derived.ZEEK.join(['WITH ', ' SELECT * FROM rec'])})),
 i(rec_id, l) AS (SELECT rec_id, label FROM ({derived.IOT.join(['WITH ', ' SELECT * FROM rec'])}))
 SELECT rec_id, {r6(phase_sql('unsw', 'attack_label', 'rec_id'))} AS unsw, {r6(phase_sql('zeek', 'z.l', 'rec_id'))} AS zeek,
 {r6(phase_sql('iot', 'i.l', 'rec_id'))} AS iot FROM rec JOIN z USING (rec_id) JOIN i USING (rec_id)""")
def _(spark, sf):
    u = derived.unsw(spark, sf).select("rec_id", cleaning.kill_chain_phase("unsw", "attack_label", "rec_id").alias("unsw"))
    z = adapters.from_zeek(derived.zeek(spark, sf), ("rec_id",)).select("rec_id", cleaning.kill_chain_phase("zeek", "label", "rec_id").alias("zeek"))
    i = derived.iot(spark, sf).select("rec_id", cleaning.kill_chain_phase("iot", "label", "rec_id").alias("iot"))
    return rounded(u.join(z, "rec_id").join(i, "rec_id"), "unsw", "zeek", "iot")


@register("retime_ordered", f"""WITH {derived.UNSW}, f AS (SELECT rec_id, {phase_sql('unsw', 'attack_label', 'rec_id')} AS phase FROM rec),
 o AS (SELECT rec_id, row_number() OVER (ORDER BY phase, rec_id) - 1 AS i, count(*) OVER () AS n FROM f)
 SELECT rec_id, {r6('1519800000.0 + (i / CAST(greatest(n - 1, 1) AS DOUBLE)) * greatest(180.0, n / CAST(60.0 AS DOUBLE) * 2.5)')} AS timestamp FROM o""")
def _(spark, sf):
    u = derived.unsw(spark, sf).select("rec_id", cleaning.kill_chain_phase("unsw", "attack_label", "rec_id").alias("phase"))
    return rounded(cleaning.retime(u, ["phase", "rec_id"]).select("rec_id", "timestamp"), "timestamp")


IPS = r"""x AS (SELECT doc_id, regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS m FROM documents),
 d AS (SELECT doc_id, list_filter(m, lambda e, i: list_position(m, e) = i) AS ips FROM x),
 s AS (SELECT *, list_filter(ips, lambda e: starts_with(e, '10.') OR starts_with(e, '192.168.') OR starts_with(e, '172.')) AS a,
   list_filter(ips, lambda e: NOT (starts_with(e, '10.') OR starts_with(e, '192.168.') OR starts_with(e, '172.'))) AS b FROM d)"""
ONE = "len(ips) > 1 AND (len(a) = 0 OR len(b) = 0)"


@register("extract_ips", f"""WITH {IPS} SELECT doc_id, coalesce(array_to_string(ips, ','), '') AS ips, coalesce(array_to_string(CASE WHEN {ONE} THEN ips[2:] ELSE a END, ','), '') AS inner_ips,
 coalesce(array_to_string(CASE WHEN {ONE} THEN ips[1:1] ELSE b END, ','), '') AS outer_ips FROM s""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", cleaning.extract_ips("text").alias("x"))
    return d.select("doc_id", F.array_join("x.ips", ",").alias("ips"), F.array_join("x.inner", ",").alias("inner_ips"),
                    F.array_join("x.outer", ",").alias("outer_ips"))


PROTO_LIST = "[" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(text || source), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in cleaning.PROTOCOL_WORDS) + "]"


@register("detect_protocols", f"""SELECT doc_id, coalesce(nullif(array_to_string(list_filter({PROTO_LIST}, lambda e: e IS NOT NULL), ','), ''), 'TCP/IP,ARP,ICMP') AS protocols FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(cleaning.detect_protocols(F.concat("text", "source")), ",").alias("protocols"))


# -- sampling and splits ------------------------------------------------------------------------


@register("strat_cap_random", f"""WITH {derived.UNSW}, r AS (SELECT rec_id, lower(trim(attack_label)) AS cat FROM rec)
 SELECT rec_id, cat FROM r QUALIFY row_number() OVER (PARTITION BY cat ORDER BY {shash(42, 'rec_id')}, rec_id) <= CASE WHEN cat = 'normal' THEN 1500 ELSE 350 END""")
def _(spark, sf):
    u = derived.unsw(spark, sf).select("rec_id", F.lower(F.trim("attack_label")).alias("cat"))
    return sampling.cap_random(u, "cat", "rec_id", 350, "normal", 1500)


@register("strat_cap_first", f"""WITH {derived.IOT}, r AS (SELECT rec_id, label, (row_number() OVER (ORDER BY rec_id) - 1) // 500 AS chunk FROM rec),
 s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rec_id) AS rn FROM r WHERE chunk <= 11),
 k AS (SELECT * FROM s WHERE rn <= CASE WHEN contains(lower(label), 'benign') THEN 900 ELSE 600 END),
 c AS (SELECT chunk, sum(count(*)) OVER (ORDER BY chunk) AS cum FROM k GROUP BY chunk)
 SELECT rec_id, label FROM k WHERE chunk <= coalesce((SELECT min(chunk) FROM c WHERE cum >= 3000), 11)""")
def _(spark, sf):
    i = derived.iot(spark, sf).select("rec_id", "label")
    return sampling.cap_first(i, "label", ["rec_id"], 600, 3000, 6000, 500, big=F.lower("label").contains("benign"))


@register("cap_per_capture", f"""WITH {derived.ZEEK} SELECT rec_id, capture_file FROM rec
 QUALIFY row_number() OVER (PARTITION BY capture_file ORDER BY {shash(42, 'rec_id')}, rec_id) <= 1200""")
def _(spark, sf):
    return sampling.cap_random(derived.zeek(spark, sf).select("rec_id", "capture_file"), "capture_file", "rec_id", 1200)


def random_split_sql(key: str, src: str, seed: int = 42) -> str:
    return f"""SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT {key}, row_number() OVER (ORDER BY {shash(seed, key)}, {key}) - 1 AS pos, count(*) OVER () AS n FROM {src})"""


@register("split_random", f"WITH {PACKETS} SELECT pkt_id, split FROM ({random_split_sql('pkt_id', 'p')})")
def _(spark, sf):
    return sampling.split_random(packets(spark, sf).select("pkt_id"), "pkt_id")


@register("node_masks", f"WITH {NVD} SELECT cve_id, split FROM ({random_split_sql('cve_id', 'x')})")
def _(spark, sf):
    return sampling.split_random(knowledge.cve_features(cve_items(spark, sf)).select("cve_id"), "cve_id")


@register("split_temporal", f"""WITH {PACKETS}, o AS (SELECT pkt_id, row_number() OVER (ORDER BY ts_us, pkt_id) - 1 AS pos, count(*) OVER () AS n FROM p),
 b AS (SELECT *, floor(n * 0.7::DOUBLE) AS te, floor(n * 0.15::DOUBLE) AS nv FROM o)
 SELECT pkt_id, CASE WHEN pos < te THEN 'train' WHEN pos < te + 14 THEN 'buffer' WHEN pos < te + 14 + nv THEN 'val' WHEN pos < te + 28 + nv THEN 'buffer' ELSE 'test' END AS split FROM b""")
def _(spark, sf):
    return sampling.split_temporal(packets(spark, sf).select("pkt_id", "ts_us"), ["ts_us", "pkt_id"]).select("pkt_id", "split")


@register("split_unseen", f"""WITH {ANNOTATED}, k AS (SELECT pkt_id, row_number() OVER (ORDER BY ts_us, pkt_id) - 1 AS pos, count(*) OVER () AS n FROM ann WHERE mitre_stage_id NOT IN (5, 6))
 SELECT pkt_id, CASE WHEN pos < floor(n * 0.85::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE) + 14 THEN 'buffer' ELSE 'val' END AS split FROM k
 UNION ALL SELECT pkt_id, 'test' FROM ann WHERE mitre_stage_id IN (5, 6)""")
def _(spark, sf):
    a = labels.annotate(packets(spark, sf)).select("pkt_id", "ts_us", "mitre_stage_id")
    return sampling.split_unseen(a, ["ts_us", "pkt_id"], F.col("mitre_stage_id").isin(5, 6)).select("pkt_id", "split")


@register("split_heldout_labels", f"WITH {PACKETS} SELECT pkt_id, lower(trim(label)) IN ('dos attacks-slowloris', 'portscan') AS held_out FROM p")
def _(spark, sf):
    return packets(spark, sf).select("pkt_id", sampling.held_out_flag("label", ["PortScan ", "DoS attacks-Slowloris"]).alias("held_out"))


@register("class_weights", f"""WITH {ANNOTATED}, c AS (SELECT mitre_stage_id, count(*) AS n FROM ann GROUP BY ALL)
 SELECT mitre_stage_id, n, {r6('(1.0 / (n + 1)::DOUBLE) / sum(1.0 / (n + 1)::DOUBLE) OVER ()')} AS weight FROM c""")
def _(spark, sf):
    return rounded(sampling.class_weights(labels.annotate(packets(spark, sf)), "mitre_stage_id"), "weight")


BIN = "WITH " + ANNOTATED + ", c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (mitre_stage_id > 0) AS DOUBLE) AS pos FROM ann)"


@register("class_weights_binary", f"{BIN} SELECT {r6('n / (2 * (n - pos))')} AS benign_weight, {r6('n / (2 * pos)')} AS malicious_weight, {r6('(n - pos) / pos')} AS pos_weight FROM c")
def _(spark, sf):
    out = sampling.binary_weights(labels.annotate(packets(spark, sf)), F.col("mitre_stage_id") > 0)
    return rounded(out, *out.columns)


SAMPLES = MAL + pw("ann", "aw") + SEQSTAGE + VALID_A + ", smp AS (SELECT seq_id, infil_target, ss.stage AS stage, ss.confidence AS confidence FROM valid JOIN graded USING (seq_id) JOIN ss USING (seq_id))"


@register("imbalance_report", f"""WITH {SAMPLES} SELECT count(*) AS total, count(*) FILTER (infil_target >= 0.5) AS malicious, count(*) FILTER (infil_target < 0.5) AS benign,
 {r6('100.0 * count(*) FILTER (infil_target >= 0.5) / CAST(count(*) AS DOUBLE)')} AS malicious_pct FROM smp""")
def _(spark, sf):
    s = sequences.samples(labels.annotate(packets(spark, sf)), F.col("label_malicious"), SPEC)
    return rounded(sampling.imbalance(s, F.col("is_malicious")), "malicious_pct")


@register("samples", f"WITH {SAMPLES} SELECT seq_id, {r6('infil_target')} AS infil_target, stage, {r6('confidence')} AS confidence, infil_target >= 0.5 AS is_malicious FROM smp")
def _(spark, sf):
    s = sequences.samples(labels.annotate(packets(spark, sf)), F.col("label_malicious"), SPEC)
    return rounded(s.select("seq_id", "infil_target", "stage", "confidence", "is_malicious"), "infil_target", "confidence")
