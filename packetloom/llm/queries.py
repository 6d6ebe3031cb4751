"""Registered queries of the training-data operators, next to their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import (
    ann, conversation_repair, decontamination, lexical_search, line_dedup, main_text, packing, pii, quality, secrets, simhash_dedup, toxicity, warc)
from packetloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM pat),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, lens, unnest(range(1, len(w) - k + 2)) t(i)),
occ AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM grams g JOIN pat p ON g.k = p.k AND g.s = p.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM m
"""

def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM named, tab),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
         FROM hit, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS rn, left(role, 1) AS i,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM rows),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM placed),
faults AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n FROM faults GROUP BY conv_id),
edits AS (SELECT * FROM (VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0),
                                (0, NULL, 'R', 2, 3), (1, NULL, 'R', 2, 3), (3, NULL, 'R', 2, 3), (2, NULL, 'R', 3, 3)) v(st, init, e, nx, c)),
inserts AS (SELECT * FROM (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
                                  (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (3, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']),
                                  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])) v(st, nx, e, c, said)),
best AS (
  SELECT conv_id, 0::BIGINT AS rn, v.nx AS st, {'c': v.c, 'a': v.e, 'said': v.said} AS w FROM counts, inserts v WHERE v.st = 0
  UNION ALL
  SELECT conv_id, rn, st, w FROM (
    SELECT x.conv_id, x.rn, v.nx AS st, min({'c': x.c + v.c, 'a': x.a || v.e, 'said': list_concat(x.said, v.said)}) AS w
    FROM (SELECT b.conv_id, f.rn, b.st, b.w.c + 4 AS c, b.w.a || 'D' AS a, b.w.said AS said
          FROM best b JOIN faults f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = b.rn + 1
          UNION ALL
          SELECT b.conv_id, f.rn, t.nx, b.w.c + t.c + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, b.w.a || t.e,
                 list_append(b.w.said, CASE WHEN t.e = 'K' THEN f.role WHEN t.nx = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text)
          FROM best b JOIN faults f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = b.rn + 1
          JOIN edits t ON t.st = b.st AND coalesce(t.init, f.i) = f.i WHERE f.fault IS NULL OR f.fault = 'truncated') x
    JOIN inserts v ON v.st = x.st GROUP BY x.conv_id, x.rn, v.nx)),
ended AS (SELECT b.conv_id, min(b.w) AS w FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.rn = c.n
          WHERE b.st IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit,
       sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dw),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM dw) GROUP BY k, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sc AS (SELECT item_id, k, sum(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT
                              * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_terms))))::BIGINT AS score
       FROM it JOIN df USING (term) JOIN tf USING (term) JOIN dw USING (k), s GROUP BY item_id, k),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM sc JOIN dw USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES: dict[str, Query] = {"op1_secrets": op1_secrets, "op2_decontamination": op2_decontamination, "op3_neighbours": op3_neighbours,
                             "op4_pii": op4_pii, "op5_line_dedup": op5_line_dedup, "op6_simhash_dedup": op6_simhash_dedup, "op7_quality": op7_quality, "op8_toxicity": op8_toxicity,
                             "op9_packing": op9_packing, "op10_warc": op10_warc, "op11_main_text": op11_main_text,
                             "op12_conversation_repair": op12_conversation_repair, "op13_lexical_search": op13_lexical_search,
                             "pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {"op2_decontamination": OP2_SQL, "op10_warc": OP10_SQL,
                          "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
