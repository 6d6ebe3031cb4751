"""Vulnerability and attack-pattern graphs, and text weights for their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import ratio
from packetloom.operators.ordering import positions

# Ordinal codes of the published scoring vocabularies.
SEVERITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
ATTACK_VECTOR = {"NETWORK": 0, "ADJACENT_NETWORK": 1, "ADJACENT": 1, "LOCAL": 2, "PHYSICAL": 3}
PATTERN_SEVERITY = {"UNKNOWN": 0, "VERY LOW": 1, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "VERY HIGH": 4}
LIKELIHOOD = {"UNKNOWN": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
ABSTRACTION = {"STANDARD": 0, "DETAILED": 1, "META": 2}
PATTERN_WORDS = ["network", "privilege", "denial", "injection", "buffer", "authentication", "crypto", "hardware"]
BLANK_TEXT = "security attack pattern entity"  # fixed value: stands for an empty text


def _code(value: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, code in table.items():
        out = F.when(value == name, F.lit(code)).otherwise(out)
    return out


# Schema of one CVE item, covering every root layout.
CVE_ITEM = """id string, cve struct<id:string>,
 metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string,attackVector:string,
   attackComplexity:string,privilegesRequired:string,userInteraction:string,scope:string>,exploitabilityScore:double,impactScore:double>>,
  cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string,attackVector:string,
   attackComplexity:string,privilegesRequired:string,userInteraction:string,scope:string>,exploitabilityScore:double,impactScore:double>>>,
 weaknesses array<struct<description:array<struct<value:string>>>>,
 configurations array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>"""


def cve_features(items: DataFrame) -> DataFrame:
    """18 features and the severity class of each CVE; missing scores take neutral defaults."""
    m = F.coalesce(F.col("metrics.cvssMetricV31"), F.col("metrics.cvssMetricV30"))
    first = F.get(m, F.lit(0))
    base = items.select(F.coalesce("id", "cve.id").alias("cve_id"), first.alias("m")).filter("cve_id is not null")
    d = F.col("m.cvssData")
    score = F.coalesce(d["baseScore"], F.lit(5.0))
    vector = _code(F.upper(F.coalesce(d["attackVector"], F.lit("NETWORK"))), ATTACK_VECTOR, 0)
    priv = F.upper(F.coalesce(d["privilegesRequired"], F.lit("NONE")))
    level = F.when(priv == "NONE", 0).when(priv == "LOW", 1).otherwise(2)
    severity = _code(F.upper(F.coalesce(d["baseSeverity"], F.lit("MEDIUM"))), SEVERITY, 1)

    def bit(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("double")

    hard = bit(d["attackComplexity"] == "HIGH")
    feats = [F.lit(1.0), F.lit(0.0), F.lit(0.0), score / 10.0,
             F.coalesce(F.col("m.exploitabilityScore"), F.lit(5.0)) / 10.0,
             F.coalesce(F.col("m.impactScore"), F.lit(5.0)) / 10.0,
             *[bit(vector == i) for i in range(4)], hard, *[bit(level == i) for i in range(3)],
             bit(d["userInteraction"] == "REQUIRED"), bit(d["scope"] == "CHANGED"),
             score / 10.0 * (F.lit(1.0) - hard), bit(severity >= 2)]
    return base.select("cve_id", *[f.alias(f"f{i}") for i, f in enumerate(feats)], severity.alias("severity"))


def cve_links(items: DataFrame) -> DataFrame:
    """One-directional CVE -> weakness and CVE -> product links with the target's type."""
    named = items.withColumn("cve_id", F.coalesce("id", "cve.id")).filter("cve_id is not null")
    weak = (named.select("cve_id", F.explode("weaknesses.description").alias("ds"))
            .select("cve_id", F.explode("ds.value").alias("node")).filter(F.col("node").startswith("CWE-"))
            .withColumn("kind", F.lit("CWE")))
    crit = (named.select("cve_id", F.explode("configurations.nodes").alias("ns"))
            .select("cve_id", F.explode("ns").alias("n")).select("cve_id", F.explode("n.cpeMatch.criteria").alias("c"))
            .filter(F.length("c") > 0))
    parts = F.split("c", ":")
    short = F.when(F.size(parts) > 4, F.concat_ws(":", F.lit("cpe"), F.get(parts, F.lit(3)), F.get(parts, F.lit(4)))
                   ).otherwise(F.col("c"))
    prod = crit.select("cve_id", short.alias("node"), F.lit("CPE").alias("kind"))
    return weak.unionByName(prod)


def both_ways(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Emit every link in both directions from one scan."""
    rest = [c for c in links.columns if c not in (src, dst)]
    return links.select(F.explode(F.array(
        F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")),
        F.struct(F.col(dst).alias("src"), F.col(src).alias("dst")))).alias("e"), *rest).select("e.src", "e.dst", *rest)


def cve_edges(items: DataFrame) -> DataFrame:
    return both_ways(cve_links(items), "cve_id", "node")


def cve_nodes(items: DataFrame) -> DataFrame:
    """Typed nodes with a dense index: CVE rows keep their class, other types default to 1."""
    cve = cve_features(items).select(F.col("cve_id").alias("node"), F.lit("CVE").alias("kind"), "severity")
    cve = cve.groupBy("node", "kind").agg(F.max("severity").alias("severity"))
    other = cve_links(items).select("node", "kind").distinct().withColumn("severity", F.lit(1))
    return positions(cve.unionByName(other), ["kind", "node"], name="node_id")


# -- attack patterns -----------------------------------------------------------------------

PATTERN_SCHEMA = """_ID string, _Name string, _Abstraction string, _Status string, Description string,
 Typical_Severity string, Likelihood_Of_Attack string,
 Related_Attack_Patterns struct<Related_Attack_Pattern:array<struct<_Nature:string,_CAPEC_ID:string>>>,
 Execution_Flow struct<Attack_Step:array<struct<Step:string>>>,
 Prerequisites struct<Prerequisite:array<string>>,
 Skills_Required struct<Skill:array<string>>,
 Related_Weaknesses struct<Related_Weakness:array<struct<_CWE_ID:string>>>"""


def _count(path: str) -> Column:
    return F.greatest(F.coalesce(F.size(F.col(path)), F.lit(0)), F.lit(0))


def pattern_rows(patterns: DataFrame) -> DataFrame:
    """Flat catalogue of attack patterns with child counts and ``;``-joined ids."""
    weak = F.filter(F.col("Related_Weaknesses.Related_Weakness._CWE_ID"), lambda x: F.length(x) > 0)
    rel = F.transform(
        F.filter(F.col("Related_Attack_Patterns.Related_Attack_Pattern"), lambda r: F.length(r["_CAPEC_ID"]) > 0),
        lambda r: F.concat(F.coalesce(r["_Nature"], F.lit("")), F.lit(":"), r["_CAPEC_ID"]))
    return patterns.select(
        F.concat(F.lit("CAPEC-"), "_ID").alias("capec_id"),
        F.coalesce(F.expr("try_cast(_ID as int)"), F.lit(0)).alias("id_num"), F.col("_Name").alias("name"),
        F.coalesce("_Abstraction", F.lit("Standard")).alias("abstraction"), F.coalesce("_Status", F.lit("")).alias("status"),
        F.coalesce(F.trim("Typical_Severity"), F.lit("Unknown")).alias("severity"),
        F.coalesce(F.trim("Likelihood_Of_Attack"), F.lit("Unknown")).alias("likelihood"),
        _count("Execution_Flow.Attack_Step").alias("n_steps"), _count("Prerequisites.Prerequisite").alias("n_prereqs"),
        _count("Skills_Required.Skill").alias("n_skills"),
        F.coalesce(F.array_join(weak, ";"), F.lit("")).alias("cwes"),
        F.coalesce(F.array_join(rel, ";"), F.lit("")).alias("related"),
        F.trim(F.coalesce("Description", F.lit(""))).alias("description"))


def pattern_features(rows: DataFrame) -> DataFrame:
    """16 structural and keyword features and the severity class."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    like = _code(F.upper("likelihood"), LIKELIHOOD, 0)
    tier = _code(F.upper("abstraction"), ABSTRACTION, 0)
    feats = [F.col("n_steps").cast("double"), F.col("n_prereqs").cast("double"), F.col("n_skills").cast("double"),
             like / 3.0, tier / 2.0, F.length("name") / 100.0, F.length("description") / 1500.0,
             *[text.contains(w).cast("double") for w in PATTERN_WORDS], F.lit(1.0)]
    return rows.select("capec_id", *[f.alias(f"f{i}") for i, f in enumerate(feats)],
                       _code(F.upper("severity"), PATTERN_SEVERITY, 0).alias("severity_class"))


def pattern_links(rows: DataFrame) -> DataFrame:
    """Typed links: 0 child-of, 1 can-precede, 2 other, 3 weakness."""
    rel = rows.filter("related <> ''").select("capec_id", F.explode(F.split("related", ";")).alias("r"))
    nature = F.substring_index("r", ":", 1)
    kind = F.when(nature.isin("ChildOf", ""), 0).when(nature == "CanPrecede", 1).otherwise(2)
    patterns = rel.select(F.col("capec_id").alias("a"), F.concat(F.lit("CAPEC-"), F.substring_index("r", ":", -1)).alias("b"),
                          kind.alias("edge_type"))
    weak = rows.filter("cwes <> ''").select(
        F.col("capec_id").alias("a"), F.explode(F.split("cwes", ";")).alias("w")).select(
        "a", F.concat(F.lit("CWE-"), "w").alias("b"), F.lit(3).alias("edge_type"))
    return patterns.unionByName(weak)


STIX_OBJECT = """type string, id string, name string, relationship_type string, source_ref string, target_ref string,
 external_references array<struct<source_name:string,external_id:string>>"""


def mitigation_links(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of type 4 from attack patterns to the courses of action that mitigate them."""
    refs = F.filter("external_references", lambda r: F.lower(r["source_name"]) == "capec")
    known = (objects.filter("type = 'attack-pattern'")
             .select(F.col("id").alias("target_ref"), F.get(refs, F.lit(0))["external_id"].alias("capec_id"))
             .join(rows.select("capec_id"), "capec_id", "left_semi"))
    rel = objects.filter("type = 'relationship' and relationship_type = 'mitigates'").select("source_ref", "target_ref")
    return rel.join(known, "target_ref").select(
        F.col("capec_id").alias("a"), F.col("source_ref").alias("b"), F.lit(4).alias("edge_type"))


def pattern_edges(rows: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """All typed links in both directions."""
    links = pattern_links(rows)
    if objects is not None:
        links = links.unionByName(mitigation_links(objects, rows))
    return both_ways(links, "a", "b")


# -- text weights ----------------------------------------------------------------------------

# The single-word entries of Spark's default English stop-word list.
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than
too very can will just don should now cannot could ought would
""".split()

# Fixed value: a word is a maximal run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lower-case words of every whole text, one row per occurrence."""
    body = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(BLANK_TEXT)).otherwise(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(
        F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))).alias("term"))


def tfidf(docs: DataFrame, doc_id: str, text: str, terms: int = 48) -> DataFrame:
    """Sub-linear TF times smooth IDF, L2-normalised, over the most frequent terms.

    Long form ``doc_id, term, weight``. The first pass shuffles only partial counts per word;
    the second keeps the words of the chosen vocabulary (``terms`` rows) before it counts per
    document.
    """
    words = tokens(docs, doc_id, text)
    vocab = (words.filter(~F.col("term").isin(STOP_WORDS)).groupBy("term").agg(F.count("*").alias("total"))
             .orderBy(F.col("total").desc(), "term").limit(terms).select("term"))
    counts = words.join(F.broadcast(vocab), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*")).scalar()
    idf = F.log(ratio(F.lit(1) + n, F.lit(1) + F.col("df"))) + 1
    raw = counts.join(F.broadcast(df), "term").select("doc_id", "term", ((F.log("tf") + 1) * idf).alias("w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
