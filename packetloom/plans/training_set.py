"""From raw packets to split training samples, written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.config import SplitSpec, WindowSpec
from packetloom.operators import flows, graph, labels, sampling, sequences, windows
from packetloom.sources.tables import write_sorted


def label_packets(packets: DataFrame, path: str) -> DataFrame:
    """Flag, label and store packets in time order; later steps read the stored table."""
    write_sorted(labels.annotate(flows.with_retransmissions(packets)), path)
    return packets.sparkSession.read.parquet(path)


def build(stored: DataFrame, spec: WindowSpec = WindowSpec(), split: SplitSpec = SplitSpec()) -> dict[str, DataFrame]:
    """Graph tables, window telemetry and split samples of stored, labelled packets."""
    rows = sequences.samples(stored, F.col("mitre_stage_id") > 0, spec)
    return {
        "edges": graph.edge_features(stored, spec),
        "nodes": graph.node_features(stored, spec),
        "windows": windows.snapshots_with_empty(stored, spec, min_rows=2),
        "samples": sampling.split_temporal(rows, ["seq_id"], split),
    }
