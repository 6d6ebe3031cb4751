"""Cleaning of vendor flow tables and small text/field extractors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.columns import col, seeded_hash
from packetloom.operators.heavy import lookup
from packetloom.operators.ordering import exact_quantiles, head_rows, positions

DEDUPE_KEY = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp"]
RATES = ["flow_byts_s", "flow_pkts_s"]
# Spellings of infinity in exported rates.
INFINITIES = ["inf", "-inf", "Infinity", "-Infinity"]
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm"]


def standard_name(header: str) -> str:
    clean = header.strip()
    return fv.FLOW_HEADERS.get(clean, re.sub(r"[ /]", "_", clean.lower()))


def standardize_columns(df: DataFrame) -> DataFrame:
    """Canonical column names; headers that meet in one name are coalesced left to right."""
    groups: dict[str, list[str]] = {}
    for header in df.columns:
        groups.setdefault(standard_name(header), []).append(f"`{header}`")
    return df.select(*[
        (F.coalesce(*hs) if len(hs) > 1 else F.col(hs[0])).alias(name) for name, hs in groups.items()])


def trim_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.trim(label)) if label in df.columns else df


def require_endpoints(df: DataFrame) -> DataFrame:
    missing = [c for c in ("src_ip", "dst_ip") if c not in df.columns]
    if missing:
        raise ValueError(f"host columns missing: {missing}; hosts are never invented from ports or row numbers")
    return df


def impute_rates(df: DataFrame, columns: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Infinite rates become the 99th percentile of the finite ones (their maximum when ten or
    fewer), missing or unreadable rates their median, and 0 when nothing is finite."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    value = {c: F.when(~text[c].isin(INFINITIES), F.col(c).try_cast("double")) for c in columns}
    numeric = df.select(*[value[c].alias(c) for c in columns])
    stats = exact_quantiles(numeric, columns, [0.99, 0.5])
    out = df
    for c in columns:
        burst = stats.filter(F.col("column") == c).select(F.when(F.col("n") > 10, F.col("q0")).otherwise(F.col("max_value"))).scalar()
        median = stats.filter(F.col("column") == c).select("q1").scalar()
        out = out.withColumn(c, F.coalesce(
            F.when(text[c].isin(INFINITIES), burst).otherwise(
                F.when(~F.isnan(value[c]), value[c])), median, F.lit(0.0)))
    return out


def is_counter(name: str) -> bool:
    return name.endswith("_cnt") or name.startswith("flag_") or name in ("src_port", "dst_port", "protocol")


def impute_numeric(df: DataFrame, skip: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Missing counters, flags and ports become 0, other missing numbers the column median."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal")
               and f.name not in skip]
    measured = [c for c in numeric if not is_counter(c)]
    out = df.fillna(0, subset=[c for c in numeric if is_counter(c)]) if len(measured) < len(numeric) else df
    if measured:
        stats = exact_quantiles(df, measured, [0.5])
        for c in measured:
            median = stats.filter(F.col("column") == c).select("q0").scalar()
            x = F.col(c).cast("double")
            finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
            out = out.withColumn(c, F.coalesce(F.when(finite, x), median, F.lit(0.0)))
    return out


def parse_timestamp(value) -> Column:
    """Timestamp of a textual or typed time, null when no known format fits."""
    text = F.trim(col(value).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS], text.try_cast("timestamp"))


def parse_times(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Drop rows whose time cannot be read; ordering is left to the consumers that need it."""
    return df.withColumn(column, parse_timestamp(column)).filter(F.col(column).isNotNull())


def unix_seconds(df: DataFrame, column: str = "timestamp") -> Column:
    """Unix seconds from a timestamp, a textual time or a number."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)
    if kind == "string":
        return F.unix_micros(parse_timestamp(column)) / F.lit(1e6)
    return F.col(column).cast("double")


def dedupe_flows(df: DataFrame, order: Sequence[str], key: Sequence[str] = tuple(DEDUPE_KEY)) -> DataFrame:
    """Keep the first row of each flow key in ``order``.

    ``min_by`` combines map-side, so a key with very many copies never gathers in one task.
    """
    keys = [c for c in key if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def clean_flows(df: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The whole cleaning chain for a vendor table read as text."""
    out = require_endpoints(trim_labels(standardize_columns(df)))
    out = impute_numeric(impute_rates(out))
    if "timestamp" in out.columns:
        out = parse_times(out)
    rest = [c for c in out.columns if c not in DEDUPE_KEY]
    return dedupe_flows(out, [*[o for o in order if o in out.columns], *[c for c in rest if c not in order]])


PROTOCOL_FILTERS = {"tcp": [6], "udp": [17], "tcp or udp": [6, 17], "ip": None}


def protocol_filter(df: DataFrame, expression: str) -> DataFrame:
    if expression not in PROTOCOL_FILTERS:
        raise ValueError(f"unsupported filter {expression!r}")
    numbers = PROTOCOL_FILTERS[expression]
    return df if numbers is None else df.filter(F.col("protocol").isin(numbers))


def first_packets(df: DataFrame, n: int) -> DataFrame:
    """The first n packets in time order; narrowed by a time histogram first."""
    return head_rows(df, "ts_us", n).orderBy("ts_us", "pkt_id").limit(n)


def spread_minutes(df: DataFrame, minute: str, order: Sequence[str]) -> DataFrame:
    """Spread rows that share a coarse timestamp (in seconds) evenly over its minute."""
    ranked = positions(df, order, within=[minute], name="_rank")
    sizes = df.groupBy(minute).agg(F.count("*").alias("_size"))
    return (lookup(ranked, sizes, [minute])
            .withColumn("timestamp", F.col(minute) + (F.col("_rank") / F.col("_size")) * F.lit(59.9))
            .drop("_rank", "_size"))


# Fixed values of re-timing: start, rows per window, seconds per window, shortest span.
RETIME_START, RETIME_DENSITY, RETIME_STEP, RETIME_MIN = 1519800000.0, 60.0, 2.5, 180.0


def retime(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Evenly spaced timestamps over rows in a total ``order``."""
    ranked = positions(df, order, name="_rank")
    n = df.agg(F.count("*")).scalar()
    span = F.greatest(F.lit(RETIME_MIN), n / F.lit(RETIME_DENSITY) * F.lit(RETIME_STEP))
    frac = F.col("_rank") / F.greatest(n - 1, F.lit(1))
    return ranked.withColumn("timestamp", F.lit(RETIME_START) + frac * span).drop("_rank")


# Ordered phase bands per source as (words, low, high); no words = everything else.
PHASES = {
    "unsw": [(("recon", "fuzzer", "analysis"), 0.38, 0.54), (("exploit", "generic", "shellcode"), 0.54, 0.70),
             (("worm",), 0.70, 0.79), (("backdoor",), 0.79, 0.88), ((), 0.88, 0.95)],
    "zeek": [(("benign",), 0.0, 0.30), (("scan",), 0.30, 0.60), ((), 0.60, 1.0)],
    "iot": [(("benign",), 0.0, 0.25), (("recon", "scan"), 0.25, 0.45),
            (("injection", "backdoor", "bruteforce", "mitm", "spoof", "xss", "upload"), 0.45, 0.70), ((), 0.70, 1.0)],
}
# Normal UNSW rows fall into three bands by share.
UNSW_NORMAL = [(0.40, 0.0, 0.38), (0.90, 0.38, 0.95), (1.0, 0.95, 1.0)]


def unit_hash(seed: int, *keys) -> Column:
    """Deterministic number in [0, 1) from the row key; stands in for random jitter."""
    return seeded_hash(seed, *keys) / F.lit(float(2**60))


def kill_chain_phase(source: str, label, key) -> Column:
    """Position of a row on the replayed attack timeline, jittered by its key."""
    text = F.lower(col(label))
    jitter = unit_hash(42, key)

    def band(lo: float, hi: float) -> Column:
        return F.lit(lo) + jitter * F.lit(hi - lo)

    out = None
    for words, lo, hi in reversed(PHASES[source]):
        hit = None
        for w in words:
            hit = text.contains(w) if hit is None else hit | text.contains(w)
        out = band(lo, hi) if hit is None else F.when(hit, band(lo, hi)).otherwise(out)
    if source == "unsw":
        pick = unit_hash(43, key)
        normal = None
        for share, lo, hi in reversed(UNSW_NORMAL):
            normal = band(lo, hi) if normal is None else F.when(pick < share, band(lo, hi)).otherwise(normal)
        out = F.when(text.contains("normal"), normal).otherwise(out)
    return out


# Fixed value: dotted quads in free text.
IPV4_TEXT = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def extract_ips(text) -> Column:
    """Struct of the distinct IPv4 strings of a text and their inner/outer split.

    When every address is outer, all but the first count as inner; when every address is
    inner, the first counts as outer.
    """
    ips = F.array_distinct(F.regexp_extract_all(col(text), F.lit(IPV4_TEXT), F.lit(0)))

    def inside(ip: Column) -> Column:
        return ip.startswith("10.") | ip.startswith("192.168.") | ip.startswith("172.")

    inner, outer = F.filter(ips, inside), F.filter(ips, lambda ip: ~inside(ip))
    one_sided = (F.size(ips) > 1) & ((F.size(inner) == 0) | (F.size(outer) == 0))
    return F.struct(ips.alias("ips"),
                    F.when(one_sided, F.slice(ips, F.lit(2), F.size(ips))).otherwise(inner).alias("inner"),
                    F.when(one_sided, F.slice(ips, 1, 1)).otherwise(outer).alias("outer"))


# Protocol keywords and the list reported when none is found.
PROTOCOL_WORDS = [
    ("SMB", ["smb", "445"]), ("Kerberos", ["kerberos", "88"]), ("HTTP", ["http", "80"]),
    ("HTTPS", ["tls", "ssl", "443"]), ("DNS", ["dns", "53"]), ("RDP", ["rdp", "3389"]), ("SSH", ["ssh", "22"]),
]
PROTOCOL_DEFAULT = ["TCP/IP", "ARP", "ICMP"]


def detect_protocols(text) -> Column:
    low = F.lower(col(text))
    found = []
    for name, words in PROTOCOL_WORDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.lit(name)))
    hits = F.array_compact(F.array(*found))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(*map(F.lit, PROTOCOL_DEFAULT)))
