"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.registry import QUERIES  # noqa: E402
from packetloom.session import build_session  # noqa: E402

HEADLINE = [
    "flow_agg", "flow_iat", "flow_table", "retransmission_flag", "win_assign", "win_attack_label", "seq_valid",
    "seq_graded_target", "seq_grounded_targets", "samples", "edge_features", "node_features", "snapshot_dynamics",
    "channel_graph", "edge_softmax", "label_override", "clean_flows", "dedupe_flows", "split_random", "strat_cap_random",
    "ev_report", "ev_auroc", "ev_js_divergence", "cf_evaluate", "ex_top_edges", "topology_edges", "tfidf_48",
    "src_capture_packets",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flow_agg"](spark, sf_dir).count()  # start-up and class loading
    spent: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
