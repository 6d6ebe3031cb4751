"""Host and edge tables of one capture, built from its flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import col, private_ip

TOP_HOSTS = 12


def port_name(port, protocol) -> Column:
    """Service name of a port, or a protocol-specific fallback."""
    port, protocol = col(port).cast("int"), col(protocol)
    known = F.create_map(*[F.lit(x) for kv in fv.PORT_NAMES.items() for x in kv])
    text = port.cast("string")
    return F.coalesce(
        F.try_element_at(known, port),
        F.when(protocol == 6, F.concat(F.lit("TCP/"), text))
        .when(protocol == 17, F.concat(F.lit("UDP/"), text))
        .when(protocol == 1, F.lit("ICMP")).otherwise(F.concat(F.lit("Port "), text)))


def host_stats(flows: DataFrame) -> DataFrame:
    """Per host: flows out and in, packets and the set of its destination ports (at most 65,535)."""
    port = F.coalesce(F.col("dst_port").cast("int"), F.lit(0))
    ends = flows.select("tot_pkts", port.alias("port"), F.explode(F.array(
        F.struct(F.trim("src_ip").alias("ip"), F.lit(True).alias("out")),
        F.struct(F.trim("dst_ip").alias("ip"), F.lit(False).alias("out")))).alias("end"))
    out = F.col("end.out")
    return ends.groupBy(F.col("end.ip").alias("ip")).agg(
        F.count_if(out).alias("out_degree"), F.count_if(~out).alias("in_degree"), F.sum("tot_pkts").alias("pkts"),
        F.array_sort(F.collect_set(F.when(~out & (F.col("port") > 0), F.col("port")))).alias("ports"))


def top_hosts(stats: DataFrame, n: int = TOP_HOSTS) -> DataFrame:
    return stats.orderBy(F.col("pkts").desc(), "ip").limit(n)


def segment_hosts(hosts: DataFrame) -> DataFrame:
    """Split the top hosts into ``corporate`` and ``dmz``.

    If no public host is present the private host with the most outgoing flows becomes the
    edge; if no private host is present every public host but the busiest counts as inner.
    The input is the short top-host list, so the one-group windows hold a dozen rows.
    """
    priv = private_ip("ip")
    all_rows = Window.partitionBy(F.lit(0))
    order = all_rows.orderBy(F.col("pkts").desc(), "ip")
    marked = hosts.withColumns({
        "_priv": F.count_if(priv).over(all_rows), "_pub": F.count_if(~priv).over(all_rows),
        "rank": F.row_number().over(order)})
    pivot = F.max_by("ip", F.struct(F.col("out_degree"), -F.col("rank"))).over(all_rows)
    seg = (F.when((F.col("_pub") == 0) & (F.col("_priv") > 1),
                  F.when(F.col("ip") == pivot, "dmz").otherwise("corporate"))
           .when((F.col("_priv") == 0) & (F.col("_pub") > 1),
                 F.when(F.col("rank") == 1, "dmz").otherwise("corporate"))
           .otherwise(F.when(priv, "corporate").otherwise("dmz")))
    return marked.withColumn("segment", seg).drop("_priv", "_pub")


# Inner hosts as (address suffix, ports, name, role, status), first match wins.
INNER_ROLES = [
    (".50", [8080], "DMZ-WEB01", "DMZ Web Server / Pivot Host", "compromised"),
    (".1", [], "GW-CORE-01", "Core Gateway & Router", "normal"),
    (".100", [53, 88], "SRV-DC01", "Domain Controller / Kerberos", "elevated"),
    (".105", [5432, 1433], "SRV-DB01", "Production Financial Database", "targeted"),
    (".110", [], "SRV-FS01", "Corporate File Server / Storage", "normal"),
    (".120", [], "WS-ENG-01", "Engineering Workstation 01", "normal"),
    (".130", [], "WS-EXEC-03", "Executive VIP Laptop", "normal"),
    (".125", [], "WS-FIN-02", "Finance Accounting Host", "targeted-once"),
]
# Outer hosts as (address part, name, role).
OUTER_ROLES = [
    ("203.0.113", "EXT-APT29-C2", "External APT Threat Actor / C2"),
    ("198.51.100", "EXT-DROP-EXFIL", "External Exfiltration Drop Server"),
]
DEFAULT_PORTS = {"dmz": [80, 443], "corporate": [445, 135]}
SHOWN_PORTS = {"dmz": 4, "corporate": 5}


def host_roles(segmented: DataFrame) -> DataFrame:
    """Name, role, status and open ports of the segmented top hosts; ``shown_ports`` is the short list of a host card."""
    ip, tail = F.col("ip"), F.element_at(F.split("ip", r"\."), -1)
    outer = F.struct(
        F.concat(F.lit("EXT-"), tail).alias("name"),
        F.when(private_ip("ip"), "Edge Gateway").otherwise("External / Perimeter Host").alias("role"),
        F.lit("compromised").alias("status"))
    for part, name, role in reversed(OUTER_ROLES):
        outer = F.when(ip.contains(part), F.struct(
            F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit("compromised").alias("status"))).otherwise(outer)
    inner = F.struct(F.concat(F.lit("HOST-"), tail).alias("name"),
                     F.concat(F.lit("Subnet Node ("), ip, F.lit(")")).alias("role"), F.lit("normal").alias("status"))
    for suffix, ports, name, role, status in reversed(INNER_ROLES):
        hit = ip.endswith(suffix)
        for port in ports:
            hit = hit | F.array_contains("ports", port)
        inner = F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"),
                                     F.lit(status).alias("status"))).otherwise(inner)
    picked = segmented.withColumn("_r", F.when(F.col("segment") == "dmz", outer).otherwise(inner))
    # a finance host is "targeted" only if no earlier host already is
    earlier = (Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("segment") == "dmz", 0).otherwise(1), "rank")
               .rowsBetween(Window.unboundedPreceding, -1))
    taken = F.coalesce(F.bool_or(F.col("_r.status").startswith("targeted")).over(earlier), F.lit(False))
    dmz = F.col("segment") == "dmz"
    usual = F.when(dmz, F.array(*map(F.lit, DEFAULT_PORTS["dmz"]))).otherwise(F.array(*map(F.lit, DEFAULT_PORTS["corporate"])))
    ports = F.when(F.size("ports") == 0, usual).otherwise(F.col("ports"))
    shown = F.slice(ports, F.lit(1), F.when(dmz, SHOWN_PORTS["dmz"]).otherwise(SHOWN_PORTS["corporate"]))
    status = (F.when(F.col("_r.status") == "targeted-once", F.when(taken, "elevated").otherwise("targeted"))
              .otherwise(F.col("_r.status")))
    return picked.select("ip", "segment", "rank", F.col("_r.name").alias("name"), F.col("_r.role").alias("role"),
                         status.alias("status"), ports.alias("open_ports"), shown.alias("shown_ports"), "out_degree", "in_degree", "pkts")


ATTACK_PORTS = [445, 135, 3389, 22]


def topology_edges(flows: DataFrame, hosts: DataFrame, risk: Column) -> DataFrame:
    """Traffic between active hosts with its first port and an attention class from the risk."""
    short = F.broadcast(hosts.select("ip"))  # the top-host list: at most TOP_HOSTS rows
    inner = (flows.filter(F.col("src_ip") != F.col("dst_ip"))
             .join(short.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi")
             .join(short.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_semi"))
    first = F.struct("start_us", "flow_key")
    agg = inner.groupBy("src_ip", "dst_ip").agg(
        F.sum("tot_pkts").alias("pkts"), F.sum("tot_bytes").alias("bytes"),
        F.min_by(F.struct("dst_port", "protocol"), first).alias("_f"))
    port = F.coalesce(F.col("_f.dst_port").cast("int"), F.lit(0))
    hot = (risk > 0.5) & (~private_ip("src_ip") | port.isin(ATTACK_PORTS))
    attention = F.least(F.lit(0.98), F.greatest(F.lit(0.35), risk * 0.9 + F.when(hot, 0.05).otherwise(-0.1)))
    return agg.select(
        "src_ip", "dst_ip", "pkts", "bytes", port.alias("port"), port_name(port, "_f.protocol").alias("protocol_name"),
        attention.alias("attention")).withColumn(
        "edge_type", F.when(F.col("attention") > 0.70, "attack").when(F.col("attention") > 0.45, "elevated")
        .otherwise("normal"))


def port_signature(flows: DataFrame) -> DataFrame:
    """Which tell-tale services were contacted anywhere in the capture (one row)."""
    p = F.col("dst_port")

    def seen(*ports: int) -> Column:
        return F.coalesce(F.bool_or(p.isin(*ports)), F.lit(False))

    return flows.agg(seen(445, 135).alias("has_smb"), seen(88, 389).alias("has_kerb"),
                     seen(5432, 1433, 3306).alias("has_db"), seen(502).alias("has_ot"), seen(445).alias("has_445"))


def next_target(hosts: DataFrame, isolated: DataFrame, score: Column) -> DataFrame:
    """The most exposed host that is not isolated: targeted or hot first, then inner, then any."""
    free = hosts.join(isolated.select("ip"), "ip", "left_anti")
    priority = (F.when((F.col("status") == "targeted") | (score > 0.8), 0)
                .when(F.col("segment") == "corporate", 1).otherwise(2))
    return (free.withColumn("priority", priority)
            .orderBy("priority", F.when(F.col("segment") == "dmz", 0).otherwise(1), "rank").limit(1))
