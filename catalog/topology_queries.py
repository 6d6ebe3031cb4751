"""Hosts, capture topology and knowledge graphs (2.6)."""

from pyspark.sql import functions as F

from catalog.common import PACKETS, labelled, private, r6, register, rounded
from catalog.flow_queries import CANON
from packetloom import fixed_values as fv
from packetloom.operators import flows, knowledge, topology
from packetloom.session import scratch_path
from packetloom.sources import feeds
from packetloom.sources.telemetry import packets, table


def flow_rows(spark, sf):
    """Flow columns the topology operators need: one aggregate over packets."""
    p = packets(spark, sf)
    return flows.flow_volume(p).join(flows.flow_first_packet(p), "flow_key")


FL = CANON + """, fl AS (SELECT flow_key, count(*) AS tot_pkts, CAST(sum(payload_size) AS BIGINT) AS tot_bytes, min(ts_us) AS start_us, max(ts_us) AS end_us, """ + ", ".join(
    f"arg_min({c}, CAST(ts_us AS HUGEINT) * 1000000000000 + pkt_id) AS {c}" for c in
    ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label")) + " FROM c GROUP BY flow_key)"
HOSTS = FL + """, ends AS (SELECT src_ip AS ip, true AS o, tot_pkts, dst_port FROM fl UNION ALL SELECT dst_ip, false, tot_pkts, dst_port FROM fl),
 hs AS (SELECT ip, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree, CAST(sum(tot_pkts) AS BIGINT) AS pkts,
  coalesce(list_sort(list(DISTINCT dst_port) FILTER (NOT o AND dst_port > 0)), []) AS ports FROM ends GROUP BY ip),
 th AS (SELECT *, row_number() OVER (ORDER BY pkts DESC, ip) AS rank FROM hs QUALIFY rank <= 12)"""


@register("host_stats", f"WITH {HOSTS} SELECT ip, out_degree, in_degree, pkts, array_to_string(ports, ',') AS ports FROM hs")
def _(spark, sf):
    return topology.host_stats(flow_rows(spark, sf)).withColumn("ports", F.array_join("ports", ","))


@register("top_hosts", f"WITH {HOSTS} SELECT ip, pkts FROM th")
def _(spark, sf):
    return topology.top_hosts(topology.host_stats(flow_rows(spark, sf))).select("ip", "pkts")


PRIV = private("ip")
SEG = HOSTS + f""", sg AS (SELECT *, CASE
  WHEN count(*) FILTER (NOT {PRIV}) OVER () = 0 AND count(*) FILTER ({PRIV}) OVER () > 1
   THEN CASE WHEN ip = first_value(ip) OVER (ORDER BY out_degree DESC, rank) THEN 'dmz' ELSE 'corporate' END
  WHEN count(*) FILTER ({PRIV}) OVER () = 0 AND count(*) FILTER (NOT {PRIV}) OVER () > 1
   THEN CASE WHEN rank = 1 THEN 'dmz' ELSE 'corporate' END
  WHEN {PRIV} THEN 'corporate' ELSE 'dmz' END AS segment FROM th)"""


@register("segment_hosts", f"WITH {SEG} SELECT ip, segment FROM sg")
def _(spark, sf):
    return topology.segment_hosts(topology.top_hosts(topology.host_stats(flow_rows(spark, sf)))).select("ip", "segment")


@register("segment_hosts_inner", f"""WITH {HOSTS}, t2 AS (SELECT *, row_number() OVER (ORDER BY pkts DESC, ip) AS r2 FROM hs WHERE {PRIV} QUALIFY r2 <= 12)
 SELECT ip, CASE WHEN ip = first_value(ip) OVER (ORDER BY out_degree DESC, r2) THEN 'dmz' ELSE 'corporate' END AS segment FROM t2""")
def _(spark, sf):
    from packetloom.functions.columns import private_ip
    inner = topology.host_stats(flow_rows(spark, sf)).filter(private_ip("ip"))
    return topology.segment_hosts(topology.top_hosts(inner)).select("ip", "segment")


def _role(i: int, outer_default: str, inner_default: str) -> str:
    outer = " ".join(f"WHEN contains(ip, '{r[0]}') THEN '{r[1 + i] if i < 2 else 'compromised'}'" for r in topology.OUTER_ROLES)
    inner = " ".join("WHEN ends_with(ip, '%s')%s THEN '%s'" % (
        r[0], "".join(f" OR list_contains(ports, {p})" for p in r[1]), r[2 + i]) for r in topology.INNER_ROLES)
    return f"CASE WHEN segment = 'dmz' THEN CASE {outer} ELSE {outer_default} END ELSE CASE {inner} ELSE {inner_default} END END"


ROLES = SEG + f""", r0 AS (SELECT *, {_role(0, "'EXT-' || string_split(ip, '.')[-1]", "'HOST-' || string_split(ip, '.')[-1]")} AS name,
 {_role(1, f"CASE WHEN {PRIV} THEN 'Edge Gateway' ELSE 'External / Perimeter Host' END", "'Subnet Node (' || ip || ')'")} AS role,
 {_role(2, "'compromised'", "'normal'")} AS st FROM sg),
 hr AS (SELECT *, CASE WHEN st = 'targeted-once' THEN CASE WHEN coalesce(bool_or(starts_with(st, 'targeted')) OVER (
   ORDER BY CASE WHEN segment = 'dmz' THEN 0 ELSE 1 END, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'elevated' ELSE 'targeted' END
   ELSE st END AS status,
  CASE WHEN len(ports) > 0 THEN ports WHEN segment = 'dmz' THEN [80, 443] ELSE [445, 135] END AS all_ports,
  array_to_string(all_ports, ',') AS open_ports, array_to_string(all_ports[1:(CASE WHEN segment = 'dmz' THEN 4 ELSE 5 END)], ',') AS shown_ports FROM r0)"""


def hosts(spark, sf):
    return topology.host_roles(topology.segment_hosts(topology.top_hosts(topology.host_stats(flow_rows(spark, sf)))))


@register("host_role", f"WITH {ROLES} SELECT ip, segment, name, role, status, open_ports, shown_ports, out_degree, in_degree FROM hr")
def _(spark, sf):
    return hosts(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("open_ports", "shown_ports")}).select(
        "ip", "segment", "name", "role", "status", "open_ports", "shown_ports", "out_degree", "in_degree")


def capture_risk(spark, sf):
    """Share of packets whose explicit label is malicious: a capture-level score."""
    return labelled(spark, sf).agg(F.avg((F.col("mitre_stage_id") > 0).cast("double"))).scalar()


RISK_SQL = "(SELECT avg(CASE WHEN mitre_stage_id > 0 THEN 1.0 ELSE 0.0 END) FROM ann)"
KNOWN = " ".join(f"WHEN {{p}} = {p} THEN '{n}'" for p, n in fv.PORT_NAMES.items())


def port_name_sql(p: str, proto: str) -> str:
    return (f"CASE {KNOWN.format(p=p)} WHEN {proto} = 6 THEN 'TCP/' || {p} WHEN {proto} = 17 THEN 'UDP/' || {p} "
            f"WHEN {proto} = 1 THEN 'ICMP' ELSE 'Port ' || {p} END")


from catalog.label_sql import ANNOTATED  # noqa: E402

HOSTS_TAIL = SEG[len(PACKETS):]
EDGE_SQL = ANNOTATED + HOSTS_TAIL + f""", rk AS (SELECT {RISK_SQL} AS risk),
 te AS (SELECT src_ip, dst_ip, CAST(sum(tot_pkts) AS BIGINT) AS pkts, CAST(sum(tot_bytes) AS BIGINT) AS bytes,
  arg_min(dst_port, (start_us, flow_key)) AS port, arg_min(protocol, (start_us, flow_key)) AS proto FROM fl
  WHERE src_ip <> dst_ip AND src_ip IN (SELECT ip FROM th) AND dst_ip IN (SELECT ip FROM th) GROUP BY ALL),
 ta AS (SELECT te.*, least(0.98, greatest(0.35, risk * 0.9 + CASE WHEN risk > 0.5 AND (NOT {private('src_ip')} OR port IN (445, 135, 3389, 22)) THEN 0.05 ELSE -0.1 END)) AS attention FROM te, rk)"""
TE_COLS = f"""src_ip, dst_ip, pkts, bytes, port, {port_name_sql('port', 'proto')} AS protocol_name, {r6('attention')} AS attention,
 CASE WHEN attention > 0.70 THEN 'attack' WHEN attention > 0.45 THEN 'elevated' ELSE 'normal' END AS edge_type"""


@register("topology_edges", f"WITH {EDGE_SQL} SELECT {TE_COLS} FROM ta")
def _(spark, sf):
    f = flow_rows(spark, sf)
    top = topology.top_hosts(topology.host_stats(f))
    return rounded(topology.topology_edges(f, top, capture_risk(spark, sf)), "attention")


SIG = """, sig AS (SELECT bool_or(dst_port IN (445,135)) AS has_smb, bool_or(dst_port IN (88,389)) AS has_kerb,
 bool_or(dst_port IN (5432,1433,3306)) AS has_db, bool_or(dst_port = 502) AS has_ot, bool_or(dst_port = 445) AS has_445 FROM fl)"""


@register("port_signature", f"WITH {FL}{SIG} SELECT * FROM sig")
def _(spark, sf):
    return topology.port_signature(flow_rows(spark, sf))


SCORE = "(out_degree % 10) / 10.0"


@register("next_target", f"""WITH {ROLES}, fr AS (SELECT * FROM hr WHERE ip NOT IN (SELECT ip FROM hr WHERE status = 'compromised' OR in_degree % 2 = 0))
 SELECT ip, name, CASE WHEN status = 'targeted' OR {SCORE} > 0.8 THEN 0 WHEN segment = 'corporate' THEN 1 ELSE 2 END AS priority
 FROM fr ORDER BY priority, CASE WHEN segment = 'dmz' THEN 0 ELSE 1 END, rank LIMIT 1""")
def _(spark, sf):
    h = hosts(spark, sf)
    isolated = h.filter((F.col("status") == "compromised") | (F.col("in_degree") % 2 == 0))
    return topology.next_target(h, isolated, (F.col("out_degree") % 10) / 10.0).select("ip", "name", "priority")


@register("port_name", f"WITH {PACKETS} SELECT pkt_id, {port_name_sql('dst_port', 'protocol')} AS service FROM p")
def _(spark, sf):
    return packets(spark, sf).select("pkt_id", topology.port_name("dst_port", "protocol").alias("service"))


# -- vulnerability feed made from the part table -------------------------------------------------

# One nested item per part: every value is an expression over part columns valid in both engines.
K = "p_partkey"
CVE_ID = f"'CVE-2024-' || CAST({K} AS STRING)"
CVSS = {
    "baseScore": f"({K} % 101) / 10.0", "baseSeverity": f"CASE {K} % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'NONE' END",
    "attackVector": f"CASE p_size % 5 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'ADJACENT_NETWORK' WHEN 2 THEN 'LOCAL' WHEN 3 THEN 'PHYSICAL' ELSE 'ADJACENT' END",
    "attackComplexity": f"CASE WHEN {K} % 3 = 0 THEN 'HIGH' ELSE 'LOW' END",
    "privilegesRequired": f"CASE {K} % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' ELSE 'HIGH' END",
    "userInteraction": f"CASE WHEN p_size % 2 = 0 THEN 'REQUIRED' ELSE 'NONE' END",
    "scope": f"CASE WHEN {K} % 6 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END",
}


def write_cve_feed(spark, sf) -> str:
    """Write one JSON document per brand, each holding that brand's items in an array.

    Feeds alternate between the three root names; items alternate between score versions.
    """
    part = table(spark, sf, "part")
    data = F.struct(*[F.expr(e).alias(n) for n, e in CVSS.items()])
    metric = F.array(F.struct(data.alias("cvssData"), (F.col(K) % 40 / 10.0).alias("exploitabilityScore"),
                              (F.col("p_size") % 60 / 10.0).alias("impactScore")))
    none = F.lit(None)
    item = F.struct(
        F.when(F.col(K) % 10 != 0, F.expr(CVE_ID)).alias("id"), F.struct(F.expr(CVE_ID).alias("id")).alias("cve"),
        F.struct(F.when(F.col(K) % 7 < 4, metric).otherwise(none).alias("cvssMetricV31"),
                 F.when(F.col(K) % 7 < 6, metric).otherwise(none).alias("cvssMetricV30")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), F.col("p_size")).alias("value")),
                                 F.struct(F.lit("NVD-CWE-noinfo").alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(
            F.struct(F.concat(F.lit("cpe:2.3:a:"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(":prod"), F.col("p_size") % 7, F.lit(":1.0")).alias("criteria")),
            F.struct(F.concat(F.lit("legacy-product-name-number-"), F.col(K) % 50, F.lit("-xxxxxxxx")).alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"))
    # feeds are files of bounded size: a fixed number of consecutive items each
    feed = part.withColumn("feed", F.floor(F.col(K) / 500)).groupBy("feed").agg(F.collect_list(item).alias("items"))
    def rooted(name: str):
        return F.to_json(F.struct(F.col("items").alias(name)))

    docs = feed.select(F.when(F.col("feed") % 3 == 0, rooted("cve_items")).when(F.col("feed") % 3 == 1, rooted("CVE_Items"))
                       .otherwise(rooted("vulnerabilities")).alias("value"))
    path = scratch_path(spark, "cve-feed")
    docs.write.text(path)
    return path


def cve_items(spark, sf):
    return feeds.read_cve(spark, write_cve_feed(spark, sf), multi_line=False)


CVE_SQL = ", ".join(f"{e} AS {n}" for n, e in CVSS.items()).replace("STRING", "VARCHAR")
NVD = f"""it AS (SELECT {CVE_ID.replace('STRING', 'VARCHAR')} AS cve_id, p_partkey % 7 < 6 AS has, {CVE_SQL}, (p_partkey % 40) / 10.0 AS ex, (p_size % 60) / 10.0 AS im,
  'CWE-' || p_size AS cwe, 'cpe:' || lower(replace(p_brand, '#', '')) || ':prod' || (p_size % 7) AS cpe1,
  'legacy-product-name-number-' || (p_partkey % 50) || '-xxxxxxxx' AS cpe2 FROM part),
 x AS (SELECT cve_id, CASE WHEN has THEN baseScore ELSE 5.0 END AS sc, CASE WHEN has THEN ex ELSE 5.0 END AS ex, CASE WHEN has THEN im ELSE 5.0 END AS im,
  CASE WHEN NOT has THEN 0 WHEN attackVector = 'NETWORK' THEN 0 WHEN starts_with(attackVector, 'ADJ') THEN 1 WHEN attackVector = 'LOCAL' THEN 2 ELSE 3 END AS av,
  has AND attackComplexity = 'HIGH' AS ac, CASE WHEN NOT has OR privilegesRequired = 'NONE' THEN 0 WHEN privilegesRequired = 'LOW' THEN 1 ELSE 2 END AS pr,
  has AND userInteraction = 'REQUIRED' AS ui, has AND scope = 'CHANGED' AS sp,
  CASE WHEN NOT has THEN 1 WHEN upper(baseSeverity) = 'LOW' THEN 0 WHEN upper(baseSeverity) = 'HIGH' THEN 2 WHEN upper(baseSeverity) = 'CRITICAL' THEN 3 ELSE 1 END AS severity, cwe, cpe1, cpe2 FROM it),
 lk AS (SELECT cve_id, cwe AS node, 'CWE' AS kind FROM x UNION ALL SELECT cve_id, cpe1, 'CPE' FROM x UNION ALL SELECT cve_id, cpe2, 'CPE' FROM x)"""
NVD_F = ["1.0", "0.0", "0.0", "sc / 10.0", "ex / 10.0", "im / 10.0", *[f"CASE WHEN av = {i} THEN 1 ELSE 0 END" for i in range(4)],
         "CASE WHEN ac THEN 1 ELSE 0 END", *[f"CASE WHEN pr = {i} THEN 1 ELSE 0 END" for i in range(3)], "CASE WHEN ui THEN 1 ELSE 0 END",
         "CASE WHEN sp THEN 1 ELSE 0 END", "sc / 10.0 * (1.0 - CASE WHEN ac THEN 1 ELSE 0 END)", "CASE WHEN severity >= 2 THEN 1 ELSE 0 END"]


@register("src_nvd_json", f"WITH {NVD} SELECT cve_id, {r6('sc')} AS base_score FROM x")
def _(spark, sf):
    items = cve_items(spark, sf)
    m = F.get(F.coalesce("metrics.cvssMetricV31", "metrics.cvssMetricV30"), F.lit(0))
    return rounded(items.select(F.coalesce("id", "cve.id").alias("cve_id"),
                                F.coalesce(m["cvssData"]["baseScore"], F.lit(5.0)).alias("base_score")), "base_score")


@register("nvd_features", f"WITH {NVD} SELECT cve_id, severity, {', '.join(f'{r6(e)} AS f{i}' for i, e in enumerate(NVD_F))} FROM x")
def _(spark, sf):
    return rounded(knowledge.cve_features(cve_items(spark, sf)), *[f"f{i}" for i in range(18)])


@register("nvd_edges", f"WITH {NVD} SELECT cve_id AS src, node AS dst, kind FROM lk UNION ALL SELECT node, cve_id, kind FROM lk")
def _(spark, sf):
    return knowledge.cve_edges(cve_items(spark, sf))


@register("nvd_nodes", f"""WITH {NVD} SELECT node, kind, severity, row_number() OVER (ORDER BY kind, node) - 1 AS node_id FROM
 (SELECT cve_id AS node, 'CVE' AS kind, severity FROM x UNION ALL SELECT DISTINCT node, kind, 1 FROM lk)""")
def _(spark, sf):
    return knowledge.cve_nodes(cve_items(spark, sf))


# -- attack-pattern catalogue made from the part table ------------------------------------------

SEVS = ["Low", "Medium", "High", "Very High", "Very Low"]
PAT = {
    "name": "CASE p_partkey % 5 WHEN 0 THEN 'Network Flood ' WHEN 1 THEN 'Buffer Overrun ' WHEN 2 THEN 'Crypto Probe ' WHEN 3 THEN 'Command Injection ' ELSE 'Plain ' END || p_name",
    "abstraction": "CASE p_partkey % 3 WHEN 0 THEN 'Meta' WHEN 1 THEN 'Standard' ELSE 'Detailed' END",
    "status": "CASE WHEN p_partkey % 2 = 0 THEN 'Stable' ELSE 'Draft' END",
    "description": "'Targets the ' || p_type || CASE WHEN p_size % 4 = 0 THEN ' & breaks authentication <fast>' WHEN p_size % 4 = 1 THEN ' via privilege denial' ELSE ' on hardware' END",
}
SEV = "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Very High' ELSE 'Very Low' END"
LIK = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END"


def write_patterns(spark, sf) -> str:
    part = table(spark, sf, "part")

    def repeat(n: str, value: str):
        return F.expr(f"transform(sequence(1, {n}), i -> {value})")

    rows = part.select(
        F.col("p_partkey").cast("string").alias("_ID"), F.expr(PAT["name"]).alias("_Name"),
        F.expr(PAT["abstraction"]).alias("_Abstraction"), F.expr(PAT["status"]).alias("_Status"),
        F.expr(PAT["description"]).alias("Description"), F.expr(SEV).alias("Typical_Severity"), F.expr(LIK).alias("Likelihood_Of_Attack"),
        F.struct(F.array(
            F.struct(F.lit("ChildOf").alias("_Nature"), (F.floor(F.col("p_partkey") / 2) + 1).cast("string").alias("_CAPEC_ID")),
            F.struct(F.when(F.col("p_size") % 2 == 0, "CanPrecede").otherwise("PeerOf").alias("_Nature"),
                     (F.col("p_partkey") + 1).cast("string").alias("_CAPEC_ID"))).alias("Related_Attack_Pattern")).alias("Related_Attack_Patterns"),
        F.struct(repeat("1 + p_size % 3", "named_struct('Step', cast(i as string))").alias("Attack_Step")).alias("Execution_Flow"),
        F.struct(repeat("1 + p_size % 2", "concat('needs ', i)").alias("Prerequisite")).alias("Prerequisites"),
        F.when(F.col("p_size") % 5 != 0, F.struct(repeat("1 + p_size % 4", "concat('skill ', i)").alias("Skill"))).alias("Skills_Required"),
        F.when(F.col("p_partkey") % 3 != 0, F.struct(F.array(
            F.struct(F.col("p_size").cast("string").alias("_CWE_ID")),
            F.struct((F.col("p_size") + 100).cast("string").alias("_CWE_ID"))).alias("Related_Weakness"))).alias("Related_Weaknesses"))
    path = scratch_path(spark, "attack-patterns")
    rows.write.format("xml").option("rowTag", "Attack_Pattern").option("rootTag", "Attack_Patterns").save(path)
    return path


def write_stix(spark, sf) -> str:
    """STIX bundles of bounded size: patterns, courses of action and their relationships."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    shape = "struct<type:string,id:string,name:string,relationship_type:string,source_ref:string,target_ref:string,external_references:array<struct<source_name:string,external_id:string>>>"
    none = F.lit(None).cast("string")
    refs = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")),
                   F.struct(F.lit("CAPEC").alias("source_name"), F.concat(F.lit("CAPEC-"), k).alias("external_id")))
    coa, pattern = F.concat(F.lit("coa--"), k % 100), F.concat(F.lit("ap--"), k)
    obj = F.array(
        F.struct(F.lit("attack-pattern"), pattern, none, none, none, none, refs).cast(shape),
        F.struct(F.lit("course-of-action"), coa, F.concat(F.lit("Mitigation "), k % 100), none, none, none, F.lit(None)).cast(shape),
        F.struct(F.lit("relationship"), F.concat(F.lit("rel--"), k), none, F.when(k % 4 == 0, "uses").otherwise("mitigates"), coa, pattern,
                 F.lit(None)).cast(shape))
    bundle = part.withColumn("objs", obj).groupBy(F.floor(k / 500).alias("b")).agg(F.flatten(F.collect_list("objs")).alias("objects"))
    path = scratch_path(spark, "stix")
    bundle.select("objects").write.json(path)
    return path


def pattern_table(spark, sf):
    return knowledge.pattern_rows(feeds.read_patterns(spark, write_patterns(spark, sf)))


def stix_objects(spark, sf):
    return feeds.read_stix(spark, write_stix(spark, sf), multi_line=False)


CAP = "pr AS (SELECT 'CAPEC-' || p_partkey AS capec_id, CAST(p_partkey AS INTEGER) AS id_num, " + ", ".join(f"{e} AS {n}" for n, e in PAT.items()) + f""",
 coalesce({SEV}, 'Unknown') AS severity, coalesce({LIK}, 'Unknown') AS likelihood, CAST(1 + p_size % 3 AS INTEGER) AS n_steps, CAST(1 + p_size % 2 AS INTEGER) AS n_prereqs,
 CASE WHEN p_size % 5 <> 0 THEN CAST(1 + p_size % 4 AS INTEGER) ELSE 0 END AS n_skills, CASE WHEN p_partkey % 3 <> 0 THEN p_size || ';' || (p_size + 100) ELSE '' END AS cwes,
 'ChildOf:' || (p_partkey // 2 + 1) || ';' || CASE WHEN p_size % 2 = 0 THEN 'CanPrecede' ELSE 'PeerOf' END || ':' || (p_partkey + 1) AS related FROM part)"""


@register("src_capec_xml", f"WITH {CAP} SELECT * FROM pr")
def _(spark, sf):
    return pattern_table(spark, sf)


CAP_F = ["n_steps", "n_prereqs", "n_skills", "CASE likelihood WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END / 3.0",
         "CASE abstraction WHEN 'Meta' THEN 2 WHEN 'Detailed' THEN 1 ELSE 0 END / 2.0", "length(name) / 100.0", "length(description) / 1500.0",
         *[f"CASE WHEN contains(lower(name || ' ' || description), '{w}') THEN 1 ELSE 0 END" for w in knowledge.PATTERN_WORDS], "1.0"]


@register("capec_features", f"""WITH {CAP} SELECT capec_id, {', '.join(f'{r6(e)} AS f{i}' for i, e in enumerate(CAP_F))},
 CASE severity WHEN 'Very Low' THEN 1 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Very High' THEN 4 ELSE 0 END AS severity_class FROM pr""")
def _(spark, sf):
    return rounded(knowledge.pattern_features(pattern_table(spark, sf)), *[f"f{i}" for i in range(16)])


@register("capec_edges", f"""WITH {CAP}, l AS (SELECT 'CAPEC-' || p_partkey AS a, 'CAPEC-' || (p_partkey // 2 + 1) AS b, 0 AS edge_type FROM part
 UNION ALL SELECT 'CAPEC-' || p_partkey, 'CAPEC-' || (p_partkey + 1), CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END FROM part
 UNION ALL SELECT 'CAPEC-' || p_partkey, 'CWE-' || p_size, 3 FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT 'CAPEC-' || p_partkey, 'CWE-' || (p_size + 100), 3 FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT 'CAPEC-' || p_partkey, 'coa--' || (p_partkey % 100), 4 FROM part WHERE p_partkey % 4 <> 0)
 SELECT a AS src, b AS dst, edge_type FROM l UNION ALL SELECT b, a, edge_type FROM l""")
def _(spark, sf):
    return knowledge.pattern_edges(pattern_table(spark, sf), stix_objects(spark, sf))


@register("src_stix_json", """SELECT type, count(*) AS n FROM (SELECT unnest(['attack-pattern', 'course-of-action', 'relationship']) AS type FROM part) GROUP BY ALL""")
def _(spark, sf):
    return stix_objects(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


STOPS = "(" + ", ".join(f"'{w}'" for w in knowledge.STOP_WORDS) + ")"


@register("tfidf_48", f"""WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN trim(text) = '' THEN '{knowledge.BLANK_TEXT}' ELSE text END), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
 ct AS (SELECT doc_id, term, count(*) AS tf FROM tk WHERE term NOT IN {STOPS} GROUP BY ALL),
 vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM ct GROUP BY term ORDER BY total DESC, term LIMIT 48),
 w AS (SELECT doc_id, term, (ln(tf) + 1) * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM ct JOIN vo USING (term))
 SELECT doc_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""")
def _(spark, sf):
    return rounded(knowledge.tfidf(table(spark, sf, "documents"), "doc_id", "text"), "weight")
