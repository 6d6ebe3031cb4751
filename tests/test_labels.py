import pytest

from packetloom import fixed_values as fv
from packetloom.functions.columns import private_ip
from packetloom.operators import labels


def test_table_size():
    assert len(fv.LABELS) == 82 and len(fv.LABEL_PATTERNS) == 7


@pytest.mark.parametrize("label, stage, technique, source", [
    ("Benign", 0, "None", "exact"), ("DoS attacks-Slowloris ", 2, "T1498.001", "exact"), ("Infilteration", 4, "T1021", "exact"), ("Bot", 5, "T1071.001", "exact"),
    ("flow=From-Botnet-V42-TCP-CC107-HTTP-Not-Encrypted", 5, "T1071", "pattern"), ("flow=Background-TCP-Established", 0, "None", "pattern"),
    ("Strange_Zero_Day", 0, "None", "unmapped"), ("Slow SSH patator run", 3, "T1110", "pattern"), (None, 0, "None", "exact")])
def test_label_mapping(spark, label, stage, technique, source):
    r = labels.map_labels(spark.createDataFrame([(label,)], "label string")).first()
    assert (r.label_stage, r.label_technique, r.label_source) == (stage, technique, source)


def test_unmapped_counts(spark):
    df = spark.createDataFrame([("Odd",), ("odd ",), ("benign",), ("0",), ("",)], "label string")
    assert [(r.clean_label, r.n) for r in labels.unmapped_labels(df).collect()] == [("odd", 2)]


@pytest.mark.parametrize("ip, want", [("10.1.2.3", True), ("192.168.0.1", True), ("127.0.0.1", True), ("172.16.0.1", True), ("172.31.255.1", True),
                                      ("172.15.0.1", False), ("172.32.0.1", False), ("8.8.8.8", False), ("1.1.1.1", False), (None, False)])
def test_private(spark, ip, want):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(private_ip("ip").alias("p")).first().p is want


ROW = "src_ip string, dst_ip string, dst_port int, flag_syn boolean, flag_ack boolean, flag_rst boolean, payload_size double"


@pytest.mark.parametrize("row, stage", [
    (("10.0.0.1", "10.0.0.2", 445, True, False, False, 0.0), 4), (("8.8.8.8", "10.0.0.2", 9999, True, False, True, 10.0), 1),
    (("10.0.0.1", "8.8.8.8", 4444, False, True, False, 100.0), 5), (("10.0.0.1", "8.8.8.8", 443, False, True, False, 60000.0), 6),
    (("8.8.8.8", "10.0.0.1", 22, True, False, False, 0.0), 3), (("8.8.8.8", "10.0.0.1", 80, False, True, False, 5000.0), 2),
    (("8.8.8.8", "10.0.0.1", 80, False, True, False, 100.0), 0)])
def test_rule_precedence(spark, row, stage):
    r = labels.with_heuristic_stage(spark.createDataFrame([row], ROW)).first()
    assert r.mitre_stage_id == stage and r.mitre_stage_name == fv.STAGES[stage]


def test_label_override(spark):
    base = ("10.0.0.1", "8.8.8.8", 4444, False, True, False, 100.0)
    rows = [(*base, "benign "), (*base, "PortScan"), (*base, "BenignTraffic"), (*base, "never heard of it")]
    got = [(r.mitre_stage_id, r.mitre_confidence) for r in labels.annotate(spark.createDataFrame(rows, ROW + ", label string")).collect()]
    assert sorted(got) == sorted([(0, 0.99), (1, 0.90), (5, 0.85), (5, 0.85)])
