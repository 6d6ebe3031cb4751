"""Stage labels from dataset labels and from telemetry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import as_int, col, private_ip


def clean_label(label) -> Column:
    """Trim, lower-case and strip one leading ``flow=``; null reads as benign."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(col(label))), r"^flow=", ""), F.lit("benign"))


def label_table(spark: SparkSession) -> DataFrame:
    """The exact label dictionary as a small dimension table (82 rows)."""
    rows = ", ".join(f"('{k}', {s}, '{t}')" for k, (s, t) in fv.LABELS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS label_dim(clean, exact_stage, exact_technique)")


def stage_name(stage) -> Column:
    out = F.lit("Unknown")
    for sid, name in fv.STAGES.items():
        out = F.when(col(stage) == sid, F.lit(name)).otherwise(out)
    return out


def map_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_stage``, ``label_technique`` and ``label_source`` (exact, pattern, unmapped)."""
    cleaned = df.withColumn("clean", clean_label(label))
    joined = cleaned.join(F.broadcast(label_table(df.sparkSession)), "clean", "left")
    rule_stage, rule_tech = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, stage, technique in reversed(fv.LABEL_PATTERNS):
        hit = F.col("clean").rlike("(?i)" + pattern)
        rule_stage = F.when(hit, F.lit(stage)).otherwise(rule_stage)
        rule_tech = F.when(hit, F.lit(technique)).otherwise(rule_tech)
    exact = F.col("exact_stage").isNotNull()
    ruled = joined.withColumn("_rs", F.when(~exact, rule_stage)).withColumn(
        "_rt", F.when(~exact, rule_tech))
    return (ruled
            .withColumn("label_stage", F.coalesce("exact_stage", "_rs", F.lit(0)))
            .withColumn("label_technique", F.coalesce("exact_technique", "_rt", F.lit("None")))
            .withColumn("label_source", F.when(exact, "exact").when(F.col("_rs").isNotNull(), "pattern")
                        .otherwise("unmapped"))
            .select(*df.columns, F.col("clean").alias("clean_label"), "label_stage",
                    "label_technique", "label_source"))


def unmapped_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """How often each label fell through both the dictionary and the patterns."""
    return (map_labels(df, label)
            .filter((F.col("label_source") == "unmapped") & ~F.col("clean_label").isin(fv.QUIET_LABELS))
            .groupBy("clean_label").agg(F.count("*").alias("n")))


def heuristic(df: DataFrame) -> Column:
    """Telemetry rules as a struct (stage, technique, confidence); most specific rule first."""
    cols = df.columns
    port = F.coalesce(F.col("dst_port").cast("int"), F.lit(0)) if "dst_port" in cols else F.lit(0)
    size = (F.coalesce(F.col("payload_size").cast("double"), F.lit(0.0))
            if "payload_size" in cols else F.lit(0.0))

    def flag(name: str) -> Column:
        return as_int(name) != 0 if name in cols else F.lit(False)

    inside_src = private_ip("src_ip") if "src_ip" in cols else F.lit(False)
    inside_dst = private_ip("dst_ip") if "dst_ip" in cols else F.lit(False)
    leaving = inside_src & ~inside_dst

    def verdict(rule: tuple[int, str, float]) -> Column:
        return F.struct(F.lit(rule[0]).alias("stage"), F.lit(rule[1]).alias("technique"),
                        F.lit(rule[2]).alias("confidence"))

    return (F.when(leaving & (size > fv.EXFIL_BYTES), verdict(fv.RULE_EXFIL))
            .when(leaving & port.isin(fv.C2_PORTS), verdict(fv.RULE_C2))
            .when(inside_src & inside_dst & port.isin(fv.LATERAL_PORTS), verdict(fv.RULE_LATERAL))
            .when(port.isin(fv.AUTH_PORTS), verdict(fv.RULE_CREDENTIAL))
            .when(port.isin(fv.WEB_PORTS) & (size > fv.EXPLOIT_BYTES), verdict(fv.RULE_INITIAL))
            .when(flag("flag_syn") & ~flag("flag_ack") & (flag("flag_rst") | (size == 0)),
                  verdict(fv.RULE_RECON))
            .otherwise(verdict(fv.RULE_NONE)))


def with_heuristic_stage(df: DataFrame) -> DataFrame:
    h = df.withColumn("_h", heuristic(df))
    return h.select(*df.columns, F.col("_h.stage").alias("mitre_stage_id"),
                    stage_name("_h.stage").alias("mitre_stage_name"),
                    F.col("_h.technique").alias("mitre_technique"),
                    F.col("_h.confidence").alias("mitre_confidence"))


def annotate(df: DataFrame) -> DataFrame:
    """Telemetry rules overridden by explicit labels.

    A label from the reset list makes the row benign; a label mapped to a malicious stage
    wins; any other label leaves the rule's verdict.
    """
    if "label" not in df.columns:
        return with_heuristic_stage(df)
    m = map_labels(df).withColumn("_h", heuristic(df))
    reset = F.lower(F.trim(F.coalesce(F.col("label"), F.lit("none")))).isin(fv.RESET_LABELS)
    known = F.col("label_stage") > 0
    stage = F.when(reset, F.lit(0)).when(known, F.col("label_stage")).otherwise(F.col("_h.stage"))
    return m.select(
        *df.columns, stage.alias("mitre_stage_id"), stage_name(stage).alias("mitre_stage_name"),
        F.when(reset, F.lit("None")).when(known, F.col("label_technique"))
        .otherwise(F.col("_h.technique")).alias("mitre_technique"),
        F.when(reset, F.lit(fv.CONF_RESET)).when(known, F.lit(fv.CONF_LABEL))
        .otherwise(F.col("_h.confidence")).alias("mitre_confidence"),
        (F.col("label_stage") > 0).alias("label_malicious"))


def risk_level(p) -> Column:
    p = col(p)
    return (F.when(p >= 0.80, "CRITICAL").when(p >= 0.60, "HIGH").when(p >= 0.40, "MEDIUM")
            .when(p >= 0.20, "LOW").otherwise("BENIGN"))


def alert_severity(p) -> Column:
    p = col(p)
    return F.when(p > 0.7, "critical").when(p > 0.4, "high").otherwise("info")


def tactic(stage) -> Column:
    """Struct (label, code) for a stage name."""
    def pair(label: str, code: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(code).alias("code"))
    out = pair(*fv.TACTICS["Initial Access"])
    for name, (label, code) in fv.TACTICS.items():
        out = F.when(col(stage) == name, pair(label, code)).otherwise(out)
    return out


def technique_of_stage(stage) -> Column:
    out = F.lit("T0000")
    for sid, technique in fv.STAGE_TECHNIQUES.items():
        out = F.when(col(stage) == sid, F.lit(technique)).otherwise(out)
    return out


# Attack descriptions (attack type, technique, tactic, threat level).
BENIGN_TRAFFIC = ("Benign / Normal Enterprise Traffic", "None", "Routine Operations", "LOW")
SMB_SHARES = ("Remote Services: SMB/Windows Admin Shares", "T1021.002",
              "Lateral Movement (TA0008)", "CRITICAL")
KERBEROAST = ("Steal or Forge Kerberos Tickets: Kerberoasting", "T1558.003",
              "Credential Access (TA0006)", "HIGH")
GUESSING = ("Brute Force: Password Guessing", "T1110.001", "Credential Access (TA0006)", "HIGH")
C2_EXFIL = ("Exfiltration Over C2 Channel", "T1041", "Exfiltration (TA0010)", "CRITICAL")
MODBUS = ("Point & Tag Manipulation: Modbus Override", "T0855",
          "Impair Process Control (TA0106)", "CRITICAL")
FLOOD = ("Network Denial of Service: Direct Network Flood", "T1498.001", "Impact (TA0040)", "CRITICAL")
FLOOD_SYN = ("Network Denial of Service (SYN Flood)", "T1498.001", "Impact (TA0040)", "CRITICAL")
EXPLOIT = ("Exploit Public-Facing Application", "T1190", "Initial Access (TA0001)", "CRITICAL")
WEB_C2 = ("Application Layer Protocol: Web Protocols", "T1071.001",
          "Command and Control (TA0011)", "CRITICAL")
SWEEP = ("Active Scanning: Port & Host Sweep", "T1595.001", "Reconnaissance (TA0043)", "ELEVATED")


def attack_type(risk, stage, entropy, syn_ratio, has_smb, has_kerb, has_db, has_ot) -> Column:
    """Describe an attack from risk, stage, telemetry and the service ports seen, as a struct."""
    risk, stage, entropy, syn = col(risk), col(stage), col(entropy), col(syn_ratio)
    smb, kerb, db, ot = col(has_smb), col(has_kerb), col(has_db), col(has_ot)

    def say(entry: tuple[str, str, str, str]) -> Column:
        names = ("attack_type", "technique", "tactic", "threat_level")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, entry)])

    likely = risk > 0.45
    other = F.struct(
        F.concat(F.lit("Exploit Public-Facing Application ("), stage, F.lit(")")).alias("attack_type"),
        F.lit("T1190").alias("technique"), F.lit("Initial Access (TA0001)").alias("tactic"),
        F.when(risk > 0.75, "HIGH").otherwise("MEDIUM").alias("threat_level"))
    entering = stage.isin("Initial Access", "Ingress Tool Transfer") | ((risk > 0.50) & (syn > 0.7))
    return (F.when((risk < 0.40) & (stage == "Benign") & ~smb, say(BENIGN_TRAFFIC))
            .when((stage == "Lateral Movement") | (smb & likely), say(SMB_SHARES))
            .when(((stage == "Credential Access") | likely) & kerb, say(KERBEROAST))
            .when(stage == "Credential Access", say(GUESSING))
            .when((stage == "Exfiltration") | (db & likely), say(C2_EXFIL))
            .when(ot, say(MODBUS))
            .when(entering & (syn > 0.7), say(FLOOD))
            .when(entering, say(EXPLOIT))
            .when(stage == "Command & Control", say(WEB_C2))
            .when((stage == "Reconnaissance") | ((entropy > 2.5) & (syn > 0.3)), say(SWEEP))
            .when(syn > 0.7, say(FLOOD_SYN))
            .otherwise(other))


def signature_override(risk, stage, has_445, has_kerb, has_502) -> Column:
    """Raise the risk and set the stage when tell-tale service ports were seen."""
    risk, stage = col(risk), col(stage)

    def lift(floor: float, name: str) -> Column:
        return F.struct(F.greatest(risk, F.lit(floor)).alias("risk"), F.lit(name).alias("stage"))

    return (F.when(col(has_445), lift(0.968, "Lateral Movement"))
            .when(col(has_kerb), lift(0.942, "Credential Access"))
            .when(col(has_502), lift(0.885, "Initial Access"))
            .otherwise(F.struct(risk.alias("risk"), stage.alias("stage"))))
