import pytest
from pyspark.sql import functions as F

from packetloom.operators import adapters, cleaning

HEAD = ["Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol", "Timestamp", "Label", "Flow Duration", "Flow Byts/s"]


def test_missing_endpoints_raise(spark):
    df = spark.createDataFrame([("80", "6", "x", "Benign")], ["Dst Port", "Protocol", "Timestamp", "Label"])
    with pytest.raises(ValueError, match="src_ip"):
        cleaning.clean_flows(df)


def test_clean_dedupes_trims_and_imputes(spark):
    rows = [("10.0.0.1", "10.0.0.2", "1", "80", "6", "14/02/2018 08:31:01", " Benign ", "5", "1000.0"),
            ("10.0.0.1", "10.0.0.2", "1", "80", "6", "14/02/2018 08:31:01", " Benign ", "5", "1000.0"),
            ("10.0.0.3", "10.0.0.2", "2", "80", "6", "14/02/2018 08:31:02", "Bot ", "7", "Infinity")]
    out = cleaning.clean_flows(spark.createDataFrame(rows, HEAD)).orderBy("src_ip").collect()
    assert [(r.label, r.flow_byts_s) for r in out] == [("Benign", 1000.0), ("Bot", 1000.0)]


def test_infinite_rate_takes_99th_percentile(spark):
    rows = [(i, str(100.0 * (i + 1))) for i in range(19)] + [(19, "inf"), (20, None)]
    out = {r.i: r.flow_byts_s for r in cleaning.impute_rates(spark.createDataFrame(rows, "i int, flow_byts_s string")).collect()}
    assert out[19] == pytest.approx(1882.0) and out[20] == pytest.approx(1000.0) and out[3] == 400.0


def test_no_finite_rate_becomes_zero(spark):
    out = cleaning.impute_rates(spark.createDataFrame([("x",), (None,), ("inf",)], "flow_pkts_s string")).collect()
    assert [r.flow_pkts_s for r in out] == [0.0, 0.0, 0.0]


def test_numeric_imputation(spark):
    df = spark.createDataFrame([(None, 1.0, None), (2, None, 80), (4, 9.0, 81), (None, 3.0, 82)], "syn_flag_cnt int, dur double, dst_port int")
    out = cleaning.impute_numeric(df).collect()
    assert [r.syn_flag_cnt for r in out] == [0, 2, 4, 0] and [r.dur for r in out] == [1.0, 3.0, 9.0, 3.0] and [r.dst_port for r in out] == [0, 80, 81, 82]


def test_headers_that_collide_are_coalesced(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "`Src IP` string, `Source IP` string")
    assert [r.src_ip for r in cleaning.standardize_columns(df).collect()] == ["b", "a"]


def test_spread_and_retime(spark):
    df = spark.createDataFrame([(i, 0 if i < 8 else 60) for i in range(10)], "id int, minute int")
    got = {r.id: r.timestamp for r in cleaning.spread_minutes(df, "minute", ["id"]).collect()}
    assert got[0] == 0.0 and got[4] == pytest.approx(4 / 8 * 59.9) and got[9] == pytest.approx(60 + 0.5 * 59.9)
    re = {r.id: r.timestamp for r in cleaning.retime(df, ["id"]).collect()}
    assert re[0] == 1519800000.0 and re[9] == pytest.approx(1519800180.0) and re[3] == pytest.approx(1519800000.0 + 60.0)


@pytest.mark.parametrize("text, ips, inner, outer", [
    ("from 10.0.0.1 to 8.8.8.8 and 10.0.0.1", ["10.0.0.1", "8.8.8.8"], ["10.0.0.1"], ["8.8.8.8"]),
    ("8.8.8.8 1.1.1.1 9.9.9.9", ["8.8.8.8", "1.1.1.1", "9.9.9.9"], ["1.1.1.1", "9.9.9.9"], ["8.8.8.8"]),
    ("10.0.0.1 10.0.0.2", ["10.0.0.1", "10.0.0.2"], ["10.0.0.2"], ["10.0.0.1"]), ("none", [], [], [])])
def test_ip_extraction(spark, text, ips, inner, outer):
    r = spark.createDataFrame([(text,)], "t string").select(cleaning.extract_ips("t").alias("x")).first().x
    assert (r.ips, r.inner, r.outer) == (ips, inner, outer)


def test_ip_extraction_keeps_all(spark):
    text = " ".join(f"10.0.0.{i}" for i in range(15))
    assert len(spark.createDataFrame([(text,)], "t string").select(cleaning.extract_ips("t").alias("x")).first().x.ips) == 15


def test_protocol_words(spark):
    df = spark.createDataFrame([("SMB over 445, then ssh",), ("nothing",)], "t string")
    got = [r.p for r in df.select(cleaning.detect_protocols("t").alias("p")).collect()]
    assert got == [["SMB", "SSH"], ["TCP/IP", "ARP", "ICMP"]]


def test_phase_bands(spark):
    df = spark.createDataFrame([(i, l) for i in range(40) for l in ("Normal", "Worms", "Exploits", "DoS", "Fuzzers")], "id int, label string")
    got = df.select("label", cleaning.kill_chain_phase("unsw", "label", "id").alias("p")).groupBy("label").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    bands = {"Normal": (0, 1), "Worms": (0.70, 0.79), "Exploits": (0.54, 0.70), "DoS": (0.88, 0.95), "Fuzzers": (0.38, 0.54)}
    for r in got.collect():
        lo, hi = bands[r.label]
        assert lo <= r.lo and r.hi <= hi


def test_unsw_rows(spark):
    row = dict(source_ip="1.1.1.1", destination_ip="2.2.2.2", source_port="0x1", destination_port="80", protocol="TCP", state="FIN", sbytes="300", spkts="0",
               swin="255", tcprtt="0.1", sttl="0", sloss="2", attack_label=" exploits ")
    r = adapters.from_unsw(spark.createDataFrame([row])).first()
    assert (r.src_port, r.dst_port, r.protocol, r.payload_size, r.ttl, r.label) == (0, 80, 6, 300.0, 1.0, "Exploits")
    assert r.flag_syn and r.flag_ack and r.flag_fin and not r.flag_rst and r.is_retransmission


@pytest.mark.parametrize("label, detail, capture, want", [
    ("-", "x", "my-PortScan.log", "PortScan"), ("-", "PartOfAHorizontalPortScan", "a.log", "PortScan"), ("-", "-", "malware-1.log", "From_Malware"),
    ("-", "C&C-CC", "a.log", "C&C-CC"), (" Malicious ", "-", "a.log", "Malicious"), ("attack", "DoH", "a.log", "DoH"), ("ok", "-", "a.log", "Benign")])
def test_zeek_labels(spark, label, detail, capture, want):
    df = spark.createDataFrame([(label, detail, capture)], "l string, d string, c string")
    assert df.select(adapters.zeek_label("l", "d", "c").alias("x")).first().x == want
