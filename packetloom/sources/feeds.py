"""Vulnerability, attack-pattern and STIX feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.knowledge import CVE_ITEM, PATTERN_SCHEMA, STIX_OBJECT


def read_cve(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CVE items of every feed file, whichever of the three root names holds them.

    Root names are matched case-sensitively because two of them differ only in case.
    """
    roots = ("cve_items", "CVE_Items", "vulnerabilities")
    lines = (spark.read.text(path, wholetext=multi_line))
    element = f"array<struct<{_fields(CVE_ITEM)}>>"
    parsed = lines.select(*[
        F.from_json(F.get_json_object("value", f"$.{r}"), element).alias(f"r{i}") for i, r in enumerate(roots)])
    return parsed.select(F.inline(F.coalesce("r0", "r1", "r2")))


def _fields(ddl: str) -> str:
    """Column DDL (``name type``) as struct DDL (``name:type``)."""
    out, depth = [], 0
    for token in " ".join(ddl.split()).replace(", ", ",").split(","):
        if depth == 0:
            name, kind = token.strip().split(" ", 1)
            token = f"{name}:{kind}"
        depth += token.count("<") - token.count(">")
        out.append(token)
    return ",".join(out)


TAG = r"(?:[\w.-]+:)?Attack_Pattern"
WHOLE_TAG = rf"{TAG}(?:\s(?:[^\"'>/]++|\"[^\"]*+\"|'[^']*+')*+)?+"  # without its brackets; values may hold slashes


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Attack patterns, one row each, whatever their namespace prefix; files are read in splits that end behind a pattern.

    Spark's XML reader takes a file whole. It remains the reader of files where a closing tag may not be a pattern's end:
    markup inside comments, character data or declarations, closing tags of several spellings or missing, patterns inside patterns.
    """
    options = {"attributePrefix": "_", "ignoreNamespace": "true"}
    end = _only_end(spark, path)
    if end is None:
        return spark.read.format("xml").option("rowTag", "Attack_Pattern").options(**options).schema(PATTERN_SCHEMA).load(path)
    pieces = spark.read.text(path, lineSep=end)  # each ends before a closing tag; empty patterns may precede its opening one
    empty = F.regexp_extract_all("value", F.lit(f"(<{WHOLE_TAG}/>)"), F.lit(1))
    opened = F.regexp_extract("value", f"(?s)<{WHOLE_TAG}>.*$", 0)
    whole = F.when(F.length(opened) > 0, F.array(F.concat(opened, F.lit(end)))).otherwise(F.array().cast("array<string>"))
    records = pieces.select(F.explode(F.concat(empty, whole)).alias("xml"))
    # a generator, so that a later filter does not parse the text once more at each place it names a column
    return records.select(F.inline(F.array(F.from_xml("xml", PATTERN_SCHEMA, options))))


def _only_end(spark: SparkSession, path: str) -> str | None:
    """The one spelling of the patterns' closing tags, if every one of them ends a pattern."""
    tags = spark.read.text(path, lineSep="<").select("value", F.regexp_extract("value", rf"^/{TAG}\s*>", 0).alias("close"))
    started, ended = F.col("value").rlike(f"^{WHOLE_TAG}>"), F.col("close") != ""
    named = F.col("value").rlike(rf"^{TAG}[\s/>]")
    declared = F.col("value").rlike(r"^!(?!--)") | (F.col("value").startswith("!--") & ~F.col("value").contains("-->")) | (
        F.col("value").startswith("?") & ~F.col("value").contains("?>"))
    found = tags.agg(
        F.count_if(started).alias("started"), F.count_if(ended).alias("ended"), F.count_if(declared).alias("declared"),
        F.count_if(named & ~F.col("value").rlike(f"^{WHOLE_TAG}/?>")).alias("odd"),
        F.min(F.when(ended, F.col("close"))).alias("low"), F.max(F.when(ended, F.col("close"))).alias("high")).first()
    plain = found["started"] == found["ended"] > 0 and found["low"] == found["high"] and not found["declared"] and not found["odd"]
    if not plain:
        return None
    end = f"<{found['low']}"
    nested = spark.read.text(path, lineSep=end).filter(F.size(F.regexp_extract_all("value", F.lit(f"(<{WHOLE_TAG}>)"), F.lit(1))) > 1)
    return end if nested.isEmpty() else None


def read_stix(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All objects of every bundle, one row each."""
    schema = f"objects array<struct<{_fields(STIX_OBJECT)}>>"
    bundles = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
    return bundles.select(F.inline("objects"))
