import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows, knowledge
from packetloom.sources import captures, feeds, tables

SRC, DST = bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8])


def tcp(seq=1, flags=0x02, data=b"", frag=0, ttl=64, order="!"):
    seg = struct.pack("!HHIIBBHHH", 40000, 445, seq, 9, 0x50, flags, 512, 0, 0) + data
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), 0, frag, ttl, 6, 0, SRC, DST) + seg


def udp(data=b"xyz"):
    seg = struct.pack("!HHHH", 53, 5353, 8 + len(data), 0) + data
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), 0, 0, 64, 17, 0, SRC, DST) + seg


def eth(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack("!H", kind) + payload


def capture(frames, link=1, magic=b"\xd4\xc3\xb2\xa1", order="<", frac=250_000):
    head = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "IIII", 100 + i, frac, len(f), len(f)) + f for i, f in enumerate(frames))


def read(spark, *contents):
    df = spark.createDataFrame([(f"c{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return captures.read_packets(df).orderBy("path", "frame_no").collect()


@pytest.mark.parametrize("link, wrap", [
    (1, eth), (101, lambda f: f), (228, lambda f: f), (113, lambda f: b"\0" * 14 + b"\x08\x00" + f), (1, lambda f: b"\0" * 12 + b"\x81\x00\x00\x01\x08\x00" + f),
    (1, lambda f: f), (999, lambda f: b"\x01" * 12 + b"\x12\x34" + f)])
def test_link_layers(spark, link, wrap):
    frame = wrap(tcp(seq=4_000_000_000, flags=0x12, data=b"hello"))
    r = read(spark, capture([frame], link))[0]
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol) == ("10.0.0.1", "8.8.8.8", 40000, 445, 6)
    assert (r.tcp_seq, r.tcp_ack, r.tcp_window, r.tcp_header_len, r.payload_size, r.ts_us) == (4_000_000_000, 9, 512, 20, 25, 100_250_000)
    assert r.flag_syn and r.flag_ack and not (r.flag_fin or r.flag_rst or r.flag_psh or r.flag_urg or r.ip_frag_flag)


@pytest.mark.parametrize("magic, order, frac", [
    (b"\xa1\xb2\xc3\xd4", ">", 250_000), (b"\x4d\x3c\xb2\xa1", "<", 250_000_000), (b"\xa1\xb2\x3c\x4d", ">", 250_000_000)])
def test_byte_orders_and_nanoseconds(spark, magic, order, frac):
    r = read(spark, capture([eth(tcp()), eth(udp())], 1, magic, order, frac))
    assert [x.ts_us for x in r] == [100_250_000, 101_250_000]


def test_odd_frames(spark):
    icmp = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28, 0, 0x2000, 64, 1, 0, SRC, DST) + b"\0" * 8
    cut = capture([eth(udp()), eth(icmp), eth(b"\0" * 40, 0x0806), b"short", eth(tcp(data=b"x" * 50))[:70]])
    r = read(spark, cut, b"", capture([]))
    assert [(x.frame_no, x.protocol) for x in r] == [(0, 17), (1, 1), (4, 6)]
    assert (r[0].src_port, r[0].tcp_seq, r[0].payload_size) == (53, None, 11)
    assert r[1].src_port is None and r[1].ip_frag_flag
    assert r[2].payload_size == 70 - 34  # what was captured, not what the header declares
    partial = read(spark, capture([eth(tcp()), eth(tcp())])[:-10])
    assert [x.src_port for x in partial] == [40000, None]  # the file ends inside the last TCP header


def test_retransmission_from_frames(spark):
    frames = [eth(tcp(1, 0x02)), eth(tcp(1, 0x12)), eth(tcp(5, 0x18, b"data")), eth(tcp(5, 0x18, b"data"))]
    df = spark.createDataFrame([("c", bytearray(capture(frames)))], "path string, content binary")
    p = flows.with_ttl_variance(flows.with_retransmissions(captures.read_packets(df)))
    r = p.orderBy("frame_no").collect()
    assert [x.is_retransmission for x in r] == [False, False, True, True]
    assert r[0].flow_key == "10.0.0.1:40000->8.8.8.8:445/6" and r[0].flow_ttl_variance == 0.0


def test_zeek_logs_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.conn-labeled.log").write_text("#separator x\n#fields\tts\tid.orig_h\tlabel\n1\t10.0.0.1\tBenign\n\n2\t10.0.0.2\tMalicious\n#close\n")
    (tmp_path / "b.conn-labeled.log").write_text("#fields\tlabel\tts\n-\t3\n")
    out = tables.read_zeek(spark, str(tmp_path), ["ts", "id.orig_h", "label"])
    got = sorted((r.capture_file, r.ts, r.orig_h, r.label) for r in out.collect())
    assert got == [("a.conn-labeled.log", "1", "10.0.0.1", "Benign"), ("a.conn-labeled.log", "2", "10.0.0.2", "Malicious"), ("b.conn-labeled.log", "3", None, "-")]


def test_csv_encoding_falls_back(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("Src IP,Dst IP,Label\n1.1.1.1,2.2.2.2,Web Attack \xe9\n".encode("latin-1"))
    (tmp_path / "u.csv").write_text("Source IP,Destination IP,Extra Col\n3.3.3.3,4.4.4.4,é\n", encoding="utf-8")
    out = tables.read_flow_csv(spark, [str(tmp_path / "l.csv"), str(tmp_path / "u.csv")])
    got = {r.src_ip: r for r in out.collect()}
    assert got["1.1.1.1"].label == "Web Attack é" and got["3.3.3.3"].extra_col == "é" and got["3.3.3.3"].label is None


def test_ledger_skips_known_content(spark, tmp_path):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"1")], "path string, content binary")
    empty = spark.createDataFrame([], "sha256 string, path string")
    first = tables.new_files(files, empty)
    assert sorted(r.path for r in first.collect()) == ["a", "b"]
    tables.append_ledger(first.filter("path = 'a'"), str(tmp_path / "ledger"))
    assert [r.path for r in tables.new_files(files, spark.read.parquet(str(tmp_path / "ledger"))).collect()] == ["b"]


def test_cve_feed_roots_and_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "vulnerabilities": [{"cve": {"id": "CVE-1"}, "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}]}]}]}')
    (tmp_path / "b.json").write_text('{"CVE_Items": [{"id": "CVE-2", "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL", '
                                     '"attackVector": "ADJACENT", "attackComplexity": "HIGH", "privilegesRequired": "LOW"}, "impactScore": 5.9}]}, '
                                     '"configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:acme:tool:1"}, {"criteria": "odd"}]}]}]}]}')
    items = feeds.read_cve(spark, str(tmp_path))
    f = {r.cve_id: r for r in knowledge.cve_features(items).collect()}
    assert (f["CVE-1"].f3, f["CVE-1"].f6, f["CVE-1"].f11, f["CVE-1"].severity) == (0.5, 1.0, 1.0, 1)
    two = f["CVE-2"]
    assert (two.f3, two.f4, two.f5, two.f7, two.f10, two.f12, two.f16, two.f17, two.severity) == pytest.approx((.98, .5, .59, 1, 1, 1, 0, 1, 3))
    links = sorted((r.cve_id, r.node, r.kind) for r in knowledge.cve_links(items).collect())
    assert links == [("CVE-1", "CWE-79", "CWE"), ("CVE-2", "cpe:acme:tool", "CPE"), ("CVE-2", "odd", "CPE")]
    assert knowledge.cve_edges(items).count() == 6 and knowledge.cve_nodes(items).count() == 5


def test_attack_patterns_from_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("""<?xml version="1.0"?><c:Catalog xmlns:c="http://x"><c:Attack_Patterns>
 <c:Attack_Pattern ID="7" Name="Buffer &amp; Co" Abstraction="Meta" Status="Stable"><c:Description> Network flood </c:Description>
  <c:Typical_Severity>Very High</c:Typical_Severity><c:Related_Attack_Patterns><c:Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="9"/></c:Related_Attack_Patterns>
  <c:Execution_Flow><c:Attack_Step><c:Step>1</c:Step></c:Attack_Step><c:Attack_Step><c:Step>2</c:Step></c:Attack_Step></c:Execution_Flow>
  <c:Related_Weaknesses><c:Related_Weakness CWE_ID="79"/><c:Related_Weakness CWE_ID="80"/></c:Related_Weaknesses></c:Attack_Pattern>
 <c:Attack_Pattern ID="9" Name="Plain"/></c:Attack_Patterns></c:Catalog>""")
    rows = knowledge.pattern_rows(feeds.read_patterns(spark, str(tmp_path / "c.xml"))).orderBy("id_num").collect()
    assert [(r.capec_id, r.n_steps, r.cwes, r.related, r.severity, r.abstraction) for r in rows] == [
        ("CAPEC-7", 2, "79;80", "ChildOf:9", "Very High", "Meta"), ("CAPEC-9", 0, "", "", "Unknown", "Standard")]
    table = knowledge.pattern_rows(feeds.read_patterns(spark, str(tmp_path / "c.xml")))
    f = {r.capec_id: r for r in knowledge.pattern_features(table).collect()}
    assert (f["CAPEC-7"].f0, f["CAPEC-7"].f4, f["CAPEC-7"].f7, f["CAPEC-7"].f11, f["CAPEC-7"].severity_class) == (2, 1, 1, 1, 4)
    stix = spark.createDataFrame([
        ("attack-pattern", "ap--1", None, None, None, None, [("CAPEC", "CAPEC-7")]), ("course-of-action", "coa--1", "M", None, None, None, None),
        ("relationship", "r1", None, "mitigates", "coa--1", "ap--1", None), ("relationship", "r2", None, "uses", "coa--1", "ap--1", None),
        ("relationship", "r3", None, "mitigates", "coa--1", "ap--404", None)],
        "type string, id string, name string, relationship_type string, source_ref string, target_ref string, external_references array<struct<source_name:string,external_id:string>>")
    edges = sorted((r.src, r.dst, r.edge_type) for r in knowledge.pattern_edges(table, stix).collect())
    assert ("CAPEC-7", "coa--1", 4) in edges and ("CWE-80", "CAPEC-7", 3) in edges and len(edges) == 8


def test_large_pattern_files_are_read_in_splits(spark, tmp_path):
    body = "".join(f"""<c:Attack_Pattern ID="{i}" Name='a/b > "{i}"'>\n<c:Description> text &lt;{i}&gt; <!-- a note --> </c:Description></c:Attack_Pattern>
 <c:Attack_Pattern ID="{i}0000" Name="Plain / {i}"/>""" for i in range(1, 800))
    head = '<?xml version="1.0"?><c:Catalog xmlns:c="http://x"><c:Attack_Patterns>'
    (tmp_path / "d.xml").write_text(head + body + "</c:Attack_Patterns></c:Catalog>")
    # markup inside a comment: read whole
    (tmp_path / "e.xml").write_text(head + "<!-- <c:Attack_Pattern ID='5'></c:Attack_Pattern> -->" + body + "</c:Attack_Patterns></c:Catalog>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        split, whole = (feeds.read_patterns(spark, str(tmp_path / f)) for f in ("d.xml", "e.xml"))
        assert split.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 2 * 799
        assert split.filter("_ID = 7").select("_Name", "Description").first() == ('a/b > "7"', whole.filter("_ID = 7").first()["Description"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(1, "attack attack the server"), (2, "server down"), (3, "  ")], "doc_id int, text string")
    got = {(r.doc_id, r.term): r.weight for r in knowledge.tfidf(docs, "doc_id", "text").collect()}
    import math
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in {"attack": 2, "server": 2, "security": 1}.items()}
    a, b = (1 + math.log(2)) * idf["attack"], idf["server"]
    assert got[(1, "attack")] == pytest.approx(a / math.hypot(a, b)) and got[(1, "server")] == pytest.approx(b / math.hypot(a, b))
    assert (3, "security") in got and not any(t == "the" for _, t in got)
    for d in (1, 2, 3):
        assert sum(w * w for (i, _), w in got.items() if i == d) == pytest.approx(1.0)


def test_sorted_sink_is_globally_ordered(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("ts_us"))
    tables.write_sorted(df, str(tmp_path / "t"), partitions=4)
    spans = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).orderBy("a").collect()
    assert len(spans) > 1 and all(x.b < y.a for x, y in zip(spans, spans[1:]))



def test_worker_code_travels_without_the_package(tmp_path):
    """Python workers started elsewhere cannot import the package, so its functions must be shipped by value."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from packetloom.session import build_session
from packetloom.sources import captures
spark = build_session(master="local[1]", **{{"spark.checkpoint.dir": {str(tmp_path / 'c')!r}}})
df = spark.createDataFrame([("c", bytearray(bytes.fromhex({capture([eth(tcp())]).hex()!r})))], "path string, content binary")
assert captures.read_packets(df).count() == 1
spark.stop()
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
