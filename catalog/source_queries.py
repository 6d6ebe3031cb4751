"""Sources and sinks (2.1) and streaming (2.12), over data Spark derives from the given tables."""


from pyspark.sql import functions as F

from catalog import derived
from catalog.clean_queries import VEN, vendor
from catalog.common import PACKETS, r6, register, rounded
from catalog.eval_queries import MODELS, RATES, model_scores, report_sql
from catalog.flow_queries import CANON
from catalog.graph_queries import r6cols
from catalog.label_sql import HCONF, HSTAGE, HTECH
from packetloom.operators import evaluation as ev
from packetloom.session import scratch_path
from packetloom.sources import capture_source, captures, tables
from packetloom.sources.telemetry import packets, table
from packetloom.streaming import live


@register("src_csv_flows", f"""WITH {VEN} SELECT CAST(pkt_id AS VARCHAR) AS pkt_id, src_ip, CAST(src_port AS VARCHAR) AS src_port, CASE WHEN pkt_id % 2 = 0 THEN trim(label) END AS label FROM v""")
def _(spark, sf):
    """Two folders with different headers, one of them Latin-1."""
    v = vendor(spark, sf).withColumn("Label", F.trim("Label"))
    a, b = scratch_path(spark, "csv-a"), scratch_path(spark, "csv-b")
    v.filter("pkt_id % 2 = 0").write.option("header", True).csv(a)
    (v.filter("pkt_id % 2 = 1").drop("Label").withColumn("Comment", F.lit("déjà vu")).withColumnRenamed("Src IP", "Source IP")
     .write.option("header", True).option("encoding", "ISO-8859-1").csv(b))
    return tables.read_flow_csv(spark, [a, b]).select("pkt_id", "src_ip", "src_port", "label")


@register("src_parquet_project", f"WITH {derived.UNSW} SELECT rec_id, source_ip, sbytes FROM rec")
def _(spark, sf):
    path = scratch_path(spark, "unsw")
    derived.unsw(spark, sf).write.parquet(path)
    return tables.read_projected(spark, path, ["rec_id", "source_ip", "sbytes"])


@register("sink_parquet", f"WITH {PACKETS} SELECT pkt_id, ts_us, src_ip, {HSTAGE} AS mitre_stage_id FROM p")
def _(spark, sf):
    path = scratch_path(spark, "telemetry")
    tables.write_sorted(live.label_stream(packets(spark, sf)), path)
    return spark.read.parquet(path).select("pkt_id", "ts_us", "src_ip", "mitre_stage_id")


ZEEK_NAMES = ["ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes",
              "history", "label", "detailedlabel"]


def write_zeek(spark, sf) -> str:
    """Tab-separated logs with a ``#fields`` line on top of every file.

    Rows are split into files of a bounded number of consecutive records; every other file
    lists its fields in reverse order.
    """
    z = derived.zeek(spark, sf).withColumns({"part": F.floor(F.col("rec_id") / 2000), "ts": F.col("rec_id").cast("string")})
    src = {"id.orig_h": "orig_h", "id.resp_h": "resp_h", "id.orig_p": "orig_p", "id.resp_p": "resp_p"}
    cols = [F.col(src.get(c, c)).cast("string") for c in ZEEK_NAMES]
    flip = F.col("part") % 2 == 1
    line = F.when(flip, F.concat_ws("\t", *reversed(cols))).otherwise(F.concat_ws("\t", *cols))
    head = F.when(flip, F.lit("#fields\t" + "\t".join(reversed(ZEEK_NAMES)))).otherwise(F.lit("#fields\t" + "\t".join(ZEEK_NAMES)))
    files = z.groupBy("part").agg(F.max(head).alias("head"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    path = scratch_path(spark, "zeek")
    (files.select(F.concat_ws("\n", F.lit("#separator \\x09"), "head", "body", F.lit("#close")).alias("value"), "part")
     .repartition("part").write.partitionBy("part").text(path))
    return path


@register("src_zeek", f"WITH {derived.ZEEK} SELECT CAST(rec_id AS VARCHAR) AS ts, orig_h, resp_p, proto, history, label, detailedlabel FROM rec")
def _(spark, sf):
    out = tables.read_zeek(spark, write_zeek(spark, sf), ZEEK_NAMES)
    return out.select("ts", "orig_h", "resp_p", "proto", "history", "label", "detailedlabel")


# -- captures ------------------------------------------------------------------------------------


def _be(col, size: int):
    return F.lpad(F.hex(col.cast("bigint")), size * 2, "0")


def _le(col, size: int):
    h = _be(col, size)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def capture_files(spark, sf):
    """Captures of 1,000 consecutive packets each, as (path, content) rows.

    Every fourth frame carries a VLAN tag; payloads are zero bytes of length payload_size % 200.
    """
    # co-locate each capture first, so that frames are built in parallel and grouped in place
    p = packets(spark, sf).withColumn("c", F.floor(F.col("pkt_id") / 1000)).repartition("c")
    data = F.col("payload_size") % 200
    tcp = F.col("protocol") == 6

    def ip(c):
        return F.concat(*[_be(F.split(c, r"\.")[i].cast("int"), 1) for i in range(4)])

    flags = (F.col("flag_fin").cast("int") + F.col("flag_syn").cast("int") * 2 + F.col("flag_rst").cast("int") * 4 + F.col("flag_ack").cast("int") * 16)
    l4len = F.when(tcp, 20).otherwise(8)
    l4 = F.when(tcp, F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(F.coalesce("tcp_seq", F.lit(0)), 4), F.lit("00000000"),
                              F.lit("50"), _be(flags, 1), _be(F.coalesce("tcp_window", F.lit(0)), 2), F.lit("00000000"))).otherwise(
        F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), _be(data + 8, 2), F.lit("0000")))
    ip_head = F.concat(F.lit("4500"), _be(l4len + data + 20, 2), F.lit("0000"), F.when(F.col("k") % 9 == 0, "2000").otherwise("4000"),
                       _be(F.col("ttl"), 1), _be(F.col("protocol"), 1), F.lit("0000"), ip("src_ip"), ip("dst_ip"))
    ether = F.concat(F.lit("00" * 12), F.when(F.col("k") % 4 == 0, F.lit("810000010800")).otherwise(F.lit("0800")))
    frame = F.concat(ether, ip_head, l4, F.repeat(F.lit("00"), data.cast("int")))
    size = (F.length(frame) / 2).cast("bigint")
    rec = F.concat(_le(F.floor(F.col("ts_us") / 1_000_000), 4), _le(F.col("ts_us") % 1_000_000, 4), _le(size, 4), _le(size, 4), frame)
    head = "d4c3b2a1" + "02000400" + "00" * 8 + "ffff0000" + "01000000"
    files = p.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pkt_id", rec.alias("r")))).alias("rs"))
    body = F.array_join(F.transform("rs", lambda x: x["r"]), "")
    return files.select(F.concat(F.lit("capture-"), F.col("c"), F.lit(".pcap")).alias("path"), F.unhex(F.concat(F.lit(head), body)).alias("content"))


CAPTURE_SQL = f"""WITH {PACKETS} SELECT 'capture-' || (pkt_id // 1000) || '.pcap' AS path, row_number() OVER (PARTITION BY pkt_id // 1000 ORDER BY pkt_id) - 1 AS frame_no, ts_us, src_ip, dst_ip, src_port, dst_port,
 protocol, ttl, tcp_window, k % 9 = 0 AS ip_frag_flag, CASE WHEN protocol = 6 THEN 20 ELSE 8 END + payload_size % 200 AS payload_size,
 flag_syn AND protocol = 6 AS flag_syn, flag_ack AND protocol = 6 AS flag_ack, flag_rst AND protocol = 6 AS flag_rst, flag_fin AND protocol = 6 AS flag_fin, false AS flag_psh, false AS flag_urg,
 tcp_seq, CASE WHEN protocol = 6 THEN CAST(0 AS BIGINT) END AS tcp_ack, CASE WHEN protocol = 6 THEN 20 END AS tcp_header_len FROM p"""


@register("src_capture_packets", CAPTURE_SQL)
def _(spark, sf):
    return captures.read_packets(capture_files(spark, sf)).drop("pkt_id")


@register("src_capture_ranges", f"SELECT * EXCLUDE (frame_no) FROM ({CAPTURE_SQL})")
def _(spark, sf):
    """The same captures as files, read in ranges far smaller than a file."""
    folder = scratch_path(spark, "captures")
    capture_source.write_files(capture_files(spark, sf), folder)
    out = capture_source.read_packets(spark, folder, 16 << 10).drop("pkt_id")
    return out.withColumn("path", F.element_at(F.split("path", "/"), -1))


@register("ingest_ledger", """WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)
 SELECT sha256, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS path FROM h WHERE sha256 NOT IN (SELECT sha256 FROM h WHERE doc_id % 3 = 0) GROUP BY sha256""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"))
    path = scratch_path(spark, "ledger")
    empty = spark.createDataFrame([], "sha256 string, path string")
    tables.append_ledger(tables.new_files(d.filter("doc_id % 3 = 0"), empty), path)
    return tables.new_files(d, spark.read.parquet(path))


@register("sink_json_report", f"WITH {MODELS}, {report_sql('ms', 'model')}, r2 AS (SELECT *, {RATES} FROM rp) SELECT model, tp, fn, {r6cols(['f1', 'auroc'])} FROM r2")
def _(spark, sf):
    path = scratch_path(spark, "report")
    tables.write_report(ev.report(model_scores(spark, sf)), path)
    back = spark.read.schema("model string, tp bigint, fn bigint, f1 double, auroc double").json(path)
    return rounded(back, "f1", "auroc")


# -- streams -----------------------------------------------------------------------------------------

SLICES = 3


def store_slices(df, path: str) -> None:
    """Write a table in time slices, one after the other, so that a replay meets them in order."""
    lo, hi = df.agg(F.min("ts_us")).scalar(), df.agg(F.max("ts_us")).scalar()
    cut = F.floor((F.col("ts_us") - lo) * SLICES / (hi - lo + 1))
    for i in range(SLICES):
        tables.write_sorted(df.filter(cut == i), path, partitions=2, mode="append")


def stored_packets(spark, sf):
    path = scratch_path(spark, "packets")
    p = packets(spark, sf)
    store_slices(p, path)
    return path, p.schema


def run_to_table(spark, stream, mode: str = "append"):
    """Drain a stream into parquet and read it back."""
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def stream_of(spark, sf, files_per_batch: int = 2):
    path, schema = stored_packets(spark, sf)
    return live.with_event_time(live.replay(spark, path, schema, files_per_batch))


@register("src_replay_stream", f"WITH {PACKETS} SELECT pkt_id, ts_us, src_ip, dst_ip FROM p")
def _(spark, sf):
    return run_to_table(spark, stream_of(spark, sf).select("pkt_id", "ts_us", "src_ip", "dst_ip"))[0]


@register("st_label", f"WITH {PACKETS} SELECT pkt_id, {HSTAGE} AS mitre_stage_id, {HTECH} AS mitre_technique, CAST({HCONF} AS DOUBLE) AS mitre_confidence FROM p")
def _(spark, sf):
    out = live.label_stream(stream_of(spark, sf)).select("pkt_id", "mitre_stage_id", "mitre_technique", "mitre_confidence")
    return run_to_table(spark, out)[0]


# Append mode emits a window once the watermark (newest event time minus 10 s) has passed its end.
WM = "(SELECT max(ts_us) - 10000000 FROM p)"


@register("st_sliding_edges", f"""WITH {PACKETS}, x AS (SELECT *, unnest([ts_us // 2500000 * 2500000, ts_us // 2500000 * 2500000 - 2500000]) AS start_us FROM p)
 SELECT start_us, src_ip, dst_ip, count(*) AS n, CAST(sum(payload_size) AS BIGINT) AS bytes FROM x WHERE start_us + 5000000 <= {WM} GROUP BY ALL""")
def _(spark, sf):
    return run_to_table(spark, live.sliding_edges(stream_of(spark, sf)))[0]


TUMBLE = f"""x AS (SELECT *, ts_us // 5000000 * 5000000 AS start_us FROM p),
 pc AS (SELECT start_us, dst_port, count(*) AS c FROM x GROUP BY ALL), en AS (SELECT start_us, sum(-(c / t) * log2(c / t + 1e-12)) AS port_entropy FROM
 (SELECT *, CAST(sum(c) OVER (PARTITION BY start_us) AS DOUBLE) AS t FROM pc) GROUP BY ALL)"""


@register("st_tumbling_targets", f"""WITH {PACKETS}, {TUMBLE} SELECT start_us, count(*) AS n, {r6('any_value(port_entropy)')} AS port_entropy,
 {r6('count(*) FILTER (flag_syn) / CAST(count(*) AS DOUBLE)')} AS syn_ratio, {r6('ln(1 + sum(payload_size))')} AS log_bytes FROM x JOIN en USING (start_us) WHERE start_us + 5000000 <= {WM} GROUP BY start_us""")
def _(spark, sf):
    return rounded(run_to_table(spark, live.tumbling_targets(stream_of(spark, sf)))[0], "port_entropy", "syn_ratio", "log_bytes")


@register("st_flow_sessions", f"""WITH {CANON},
 b AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 120000000 THEN 1 ELSE 0 END AS brk FROM c WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, pkt_id)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS seg FROM b),
 g AS (SELECT flow_key, seg, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS tot_pkts, CAST(sum(payload_size) AS BIGINT) AS tot_bytes FROM s GROUP BY ALL)
 SELECT flow_key, start_us, end_us, tot_pkts, tot_bytes FROM g WHERE end_us + 120000001 <= {WM}""")
def _(spark, sf):
    return run_to_table(spark, live.flow_sessions(stream_of(spark, sf)))[0]


@register("st_dedupe", f"WITH {PACKETS} SELECT DISTINCT src_ip, src_port, dst_ip, dst_port, protocol, ts_us FROM p")
def _(spark, sf):
    key = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts_us"]
    path, schema = stored_packets(spark, sf)
    # every packet arrives twice: the stream reads the same telemetry from two folders
    other, _ = stored_packets(spark, sf)
    twice = live.replay(spark, path, schema, 2).unionByName(live.replay(spark, other, schema, 2))
    return run_to_table(spark, live.dedupe_stream(live.with_event_time(twice), key).select(*key))[0]


HW = f"""hw AS (SELECT src_ip AS ip, ts_us // 5000000 * 5000000 AS start_us, ln(1 + sum(payload_size)) AS value FROM p GROUP BY ALL)"""


@register("st_host_memory", f"""WITH {PACKETS}, {HW}, f AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY start_us DESC) - 1 AS back FROM hw WHERE start_us + 5000000 <= {WM})
 SELECT ip, {r6('sum(0.5 * power(0.5::DOUBLE, back) * value)')} AS memory, count(*) AS n_windows FROM f GROUP BY ip""")
def _(spark, sf):
    stream = live.host_windows(stream_of(spark, sf))
    out = run_to_memory(spark, stream)
    return rounded(out, "memory")


def run_to_memory(spark, stream):
    """Closed windows first, then the state per host; the newest state row of each host remains.

    The two stateful steps run as two streams joined by a table, because a custom stateful
    step downstream of an aggregation needs the upstream rows in append order.
    """
    closed, _ = run_to_table(spark, stream)
    path = scratch_path(spark, "host-windows")
    store_slices(closed.withColumn("ts_us", F.col("start_us")), path)
    replayed = live.replay(spark, path, closed.schema, 2)
    rows, _ = run_to_table(spark, live.host_memory(replayed))
    return rows.groupBy("ip").agg(F.max_by("memory", "n_windows").alias("memory"), F.max("n_windows").alias("n_windows"))


@register("st_host_memory_batch", f"""WITH {PACKETS}, {HW}, f AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY start_us DESC) - 1 AS back FROM hw)
 SELECT ip, {r6('sum(0.5 * power(0.5::DOUBLE, back) * value)')} AS memory, count(*) AS n_windows FROM f GROUP BY ip""")
def _(spark, sf):
    batch = live.with_event_time(packets(spark, sf))
    w = batch.groupBy(F.col("src_ip").alias("ip"), (F.floor(F.col("ts_us") / 5_000_000) * 5_000_000).alias("start_us")).agg(
        F.log1p(F.sum("payload_size").cast("double")).alias("value"))
    return rounded(live.host_memory_batch(w), "memory")


@register("st_late", f"""WITH {PACKETS}, m AS (SELECT max(ts_us) AS mx FROM p), x AS (SELECT ts_us // 5000000 * 5000000 AS start_us, ts_us < mx - 600000000 AS late, mx FROM p, m)
 SELECT count(*) AS rows, count(*) FILTER (late) AS late_rows, count(DISTINCT CASE WHEN late THEN start_us END) AS dropped_windows,
 count(*) FILTER (NOT late AND start_us + 5000000 <= mx - 10000000) AS kept FROM x""")
def _(spark, sf):
    """Rows that arrive newest first: everything older than ten minutes is late.

    The engine counts what it drops after partial aggregation, that is per window.
    """
    path = scratch_path(spark, "late")
    newest = packets(spark, sf).agg(F.max("ts_us")).scalar()
    p = packets(spark, sf).withColumn("late", (F.col("ts_us") < newest - 600_000_000).cast("int"))
    live.keep_progress(spark)
    p.filter("late = 0").write.parquet(path)
    schema = p.schema
    out, state = scratch_path(spark, "late-out"), scratch_path(spark, "late-state")

    def drain():
        stream = live.late_report(live.with_event_time(live.replay(spark, path, schema, 1_000_000)))  # all files of a phase in one trigger
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()
        return live.dropped_rows(q)

    drain()
    p.filter("late = 1").write.mode("append").parquet(path)
    dropped = drain()
    kept = spark.read.schema("start_us bigint, n bigint").parquet(out).agg(F.sum("n")).scalar()
    return p.agg(F.sum("late").alias("late_rows"), F.count("*").alias("rows")).select(
        "rows", "late_rows", F.lit(dropped).cast("bigint").alias("dropped_windows"), kept.alias("kept"))
