"""Lookups of rows in a table of one row per key, when a few keys may hold most of the rows.

Adaptive execution splits a skewed side only where the other side is a plain exchange, which the
result of an aggregate is not. Heavy keys are therefore found first, by a mergeable sketch of
frequent items in one pass; their rows stay where they are and meet a broadcast of the few table
rows concerned, all other rows meet the rest of the table by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import task_slots

MAX_HEAVY, TRACKED = 1000, 10_000  # keys sent by broadcast at most, items the sketch follows


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float | None = None) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows, by default more than one task's fair part.

    Fewer than ``1 / share`` keys can be heavy; the sketch overestimates a count by at most the rows divided by
    its size, so a light key may be named too, which costs nothing but a broadcast row.
    """
    share = share or 1.0 / task_slots(rows.sparkSession)
    top = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k({key_hash_sql(keys)}, {MAX_HEAVY}, {TRACKED})").alias("top")).first()
    return [item["item"] for item in top["top"] or () if item["count"] > share * top["n"]]


def key_hash_sql(keys: Sequence[str]) -> str:
    return f"xxhash64({', '.join(f'`{k}`' for k in keys)})"


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", heavy: Sequence[int] | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row per key) on ``keys``; ``how`` is inner, left, left_semi or left_anti.

    ``heavy`` may be given where several lookups share their keys.
    """
    heavy = heavy_keys(rows, keys) if heavy is None else list(heavy)
    if not heavy:
        return rows.join(table, list(keys), how)
    mark = F.expr(key_hash_sql(keys)).isin(list(heavy))
    few = F.broadcast(table.filter(mark))  # as many rows as there are heavy keys: at most MAX_HEAVY
    return rows.filter(mark).join(few, list(keys), how).unionByName(rows.filter(~mark).join(table.filter(~mark), list(keys), how))
