"""From capture files to host, edge and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from packetloom.operators import flows, labels, topology
from packetloom.sources import captures
from packetloom.sources.tables import write_sorted


def flow_rows(files: DataFrame, path: str) -> DataFrame:
    """Decode, label and aggregate captures; the flow table is stored for the report steps."""
    packets = labels.annotate(flows.with_retransmissions(captures.read_packets(files)).drop("flow_key"))
    write_sorted(flows.flow_table(packets), path, "start_us")
    return files.sparkSession.read.parquet(path)


def build(flow_table: DataFrame, risk: Column) -> dict[str, DataFrame]:
    hosts = topology.host_roles(topology.segment_hosts(topology.top_hosts(topology.host_stats(flow_table))))
    return {
        "hosts": hosts,
        "edges": topology.topology_edges(flow_table, hosts, risk),
        "signature": topology.port_signature(flow_table),
    }
