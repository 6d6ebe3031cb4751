"""SQL twin of the labelling rules, generated from the same fixed values."""

from catalog.common import RETRANS, private
from packetloom import fixed_values as fv


def quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def numbers(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


_table = ", ".join(f"('{k}', {s}, '{t}')" for k, (s, t) in fv.LABELS.items())
_rule_stage = " ".join(f"WHEN regexp_matches(clean_label, '{p}') THEN {s}" for p, s, _ in fv.LABEL_PATTERNS)
_rule_tech = " ".join(f"WHEN regexp_matches(clean_label, '{p}') THEN '{t}'" for p, _, t in fv.LABEL_PATTERNS)
NAMES = "[" + ", ".join(f"'{n}'" for n in fv.STAGES.values()) + "]"

RULES = [
    (f"{private('src_ip')} AND NOT {private('dst_ip')} AND payload_size > {fv.EXFIL_BYTES}", fv.RULE_EXFIL),
    (f"{private('src_ip')} AND NOT {private('dst_ip')} AND dst_port IN {numbers(fv.C2_PORTS)}", fv.RULE_C2),
    (f"{private('src_ip')} AND {private('dst_ip')} AND dst_port IN {numbers(fv.LATERAL_PORTS)}", fv.RULE_LATERAL),
    (f"dst_port IN {numbers(fv.AUTH_PORTS)}", fv.RULE_CREDENTIAL),
    (f"dst_port IN {numbers(fv.WEB_PORTS)} AND payload_size > {fv.EXPLOIT_BYTES}", fv.RULE_INITIAL),
    ("flag_syn AND NOT flag_ack AND (flag_rst OR payload_size = 0)", fv.RULE_RECON),
]


def _case(i: int, quote: str = "") -> str:
    whens = " ".join(f"WHEN {c} THEN {quote}{r[i]}{quote}" for c, r in RULES)
    return f"CASE {whens} ELSE {quote}{fv.RULE_NONE[i]}{quote} END"


HSTAGE, HTECH, HCONF = _case(0), _case(1, "'"), _case(2)

MAPPED = RETRANS + f""",
lt(clean_label, es, et) AS (VALUES {_table}),
cl AS (SELECT *, regexp_replace(lower(trim(label)), '^flow=', '') AS clean_label FROM rt),
mp AS (SELECT cl.*, CAST(coalesce(es, CASE {_rule_stage} END, 0) AS INTEGER) AS label_stage,
  coalesce(et, CASE {_rule_tech} END, 'None') AS label_technique,
  CASE WHEN es IS NOT NULL THEN 'exact' WHEN CASE {_rule_stage} END IS NOT NULL THEN 'pattern' ELSE 'unmapped' END AS label_source
  FROM cl LEFT JOIN lt USING (clean_label))"""

ANNOTATED = MAPPED + f""",
hh AS (SELECT *, {HSTAGE} AS hs, {HTECH} AS ht, CAST({HCONF} AS DOUBLE) AS hc,
  lower(trim(label)) IN {quoted(fv.RESET_LABELS)} AS reset FROM mp),
ann AS (SELECT *, CASE WHEN reset THEN 0 WHEN label_stage > 0 THEN label_stage ELSE hs END AS mitre_stage_id,
  CASE WHEN reset THEN 'None' WHEN label_stage > 0 THEN label_technique ELSE ht END AS mitre_technique,
  CAST(CASE WHEN reset THEN {fv.CONF_RESET} WHEN label_stage > 0 THEN {fv.CONF_LABEL} ELSE hc END AS DOUBLE) AS mitre_confidence,
  label_stage > 0 AS label_malicious FROM hh)"""
