"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one class, so copies never crowd a graph; every class is indexed. A shard's graph
is a handful of flat arrays. Nodes are ordered by level, highest first, so the nodes of level l are
the first n_l and each level is one table of neighbour numbers. Construction and search advance
many vectors in step: every round expands the best open candidates of all of them at once.
Inner product becomes an angle by one more coordinate that lifts all vectors to the same length.
Shards are ranges of vector length, so that this coordinate stays small within each of them; hashed
shards lose up to half of the neighbours where lengths differ.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import arrow_schema, saved

#: Most vector components of one shard: 64 MB as doubles.
SHARD_COMPONENTS = 8 << 20
HITS = "class string, near string, score double, wide int"


class Graph:
    """Flat-array graph over lifted vectors (rows in graph order)."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], tables: list[np.ndarray]):
        self.vectors, self.sizes, self.tables = vectors, sizes, tables  # sizes and tables from level 0 up

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int], links: int = 16, ef: int = 64, batch: int = 1024) -> "Graph":
        """``sizes``: nodes of level 0, 1, ... (decreasing)."""
        tables = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level, n in enumerate(sizes)]
        graph = cls(vectors, sizes, tables)
        n, done = len(vectors), 1
        while done < n:
            level = max(i for i, size in enumerate(sizes) if size > done)
            stop = min(sizes[level], done + min(batch, max(16, done)))
            graph._insert(done, stop, level, links, ef)
            done = stop
        return graph

    def _insert(self, start: int, stop: int, level: int, links: int, ef: int) -> None:
        fresh = np.arange(start, stop)
        vectors = self.vectors[start:stop]
        entry = np.zeros((len(fresh), 1), np.int32)
        for up in range(len(self.sizes) - 1, level, -1):
            entry, _ = self._beam(vectors, up, entry[:, :1], 4, min(start, self.sizes[up]), 1)
        inner = vectors @ vectors.T
        np.fill_diagonal(inner, -np.inf)
        top = min(8, len(fresh) - 1)
        mates = np.argpartition(-inner, top - 1, axis=1)[:, :top] if top > 0 else np.zeros((len(fresh), 0), int)
        for down in range(level, -1, -1):
            found, sims = self._beam(vectors, down, entry, ef, start, 4)
            entry = np.where(found[:, :4] >= 0, found[:, :4], found[:, :1])
            ids = np.concatenate([found, mates + start], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(inner, mates, 1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            self.tables[down][start:stop, :links] = self._diverse(ids, sims, links)
            self._link_back(down, fresh, links)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Best ``width`` candidates (sorted by similarity): those nearer to the base than to any kept one first."""
        out = np.full((len(ids), width), -1, np.int32)
        for at in range(0, len(ids), 512):
            c, s = ids[at:at + 512], sims[at:at + 512]
            v = self.vectors[np.maximum(c, 0)]
            pair = v @ v.transpose(0, 2, 1)
            kept, count = np.zeros(c.shape, bool), np.zeros(len(c), int)
            real = (c >= 0) & np.isfinite(s)
            for j in range(c.shape[1]):
                near = (kept & (pair[:, j] > s[:, j:j + 1])).any(axis=1)
                kept[:, j] = real[:, j] & ~near & (count < width)
                count += kept[:, j]
            rank = np.where(kept, 0, np.where(real, 1, 2))
            order = np.argsort(rank, axis=1, kind="stable")[:, :width]
            chosen = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(c, order, 1), -1)
            out[at:at + 512, :chosen.shape[1]] = chosen
        return out

    def _link_back(self, level: int, fresh: np.ndarray, links: int) -> None:
        table = self.tables[level]
        targets = table[fresh, :links]
        owner = np.repeat(fresh, links)[targets.ravel() >= 0].astype(np.int32)
        target = targets.ravel()[targets.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, owner = target[order], owner[order]
        each, first, counts = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(first, counts)
        new = np.full((len(each), int(counts.max(initial=1))), -1, np.int32)
        new[np.repeat(np.arange(len(each)), counts), slot] = owner
        width = table.shape[1]
        for at in range(0, len(each), 2048):
            node = each[at:at + 2048]
            ids = np.concatenate([table[node], new[at:at + 2048]], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # a mate may be linked from both sides
            sims = np.einsum("ijk,ik->ij", self.vectors[np.maximum(ids, 0)], self.vectors[node])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width + 16]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (ids >= 0).sum(axis=1) > width
            chosen = ids[:, :width].copy()
            if full.any():
                chosen[full] = self._diverse(ids[full], sims[full], width)
            table[node, :chosen.shape[1]] = chosen

    def _beam(self, queries: np.ndarray, level: int, entry: np.ndarray, ef: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes per query among the first ``size`` of a level, best first, padded with -1."""
        q, table = len(queries), self.tables[level]
        seen = np.zeros(q * size, bool)
        flat = np.unique((np.arange(q)[:, None] * size + entry).ravel())
        ids, sims = np.full((q, ef), -1, np.int32), np.full((q, ef), -np.inf, np.float32)
        opened = np.zeros((q, ef), bool)
        while len(flat):
            seen[flat] = True
            row, node = flat // size, flat % size
            sim = np.einsum("ij,ij->i", self.vectors[node], queries[row])
            good = sim > sims[row, -1]
            row, node, sim = row[good], node[good], sim[good]
            rows, first, counts = np.unique(row, return_index=True, return_counts=True)
            if len(rows):
                wide = int(counts.max())
                at = (np.repeat(np.arange(len(rows)), counts), np.arange(len(row)) - np.repeat(first, counts))
                more, more_sim = np.full((len(rows), wide), -1, np.int32), np.full((len(rows), wide), -np.inf, np.float32)
                more[at], more_sim[at] = node, sim
                all_ids = np.concatenate([ids[rows], more], axis=1)
                all_sims = np.concatenate([sims[rows], more_sim], axis=1)
                all_open = np.concatenate([opened[rows], np.zeros(more.shape, bool)], axis=1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
                ids[rows], sims[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
                opened[rows] = np.take_along_axis(all_open, order, 1)
            closed = (ids >= 0) & ~opened
            turn = closed & (np.cumsum(closed, axis=1) <= step)
            opened |= turn
            row, col = np.nonzero(turn)
            near = table[ids[row, col]]
            flat = (row[:, None] * size + near)[(near >= 0) & (near < size)]
            flat = np.unique(flat[~seen[flat]])
        return ids, sims

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Node numbers of the best ``k`` per query, padded with -1."""
        out = []
        for at in range(0, len(queries), 512):
            part = queries[at:at + 512]
            entry = np.zeros((len(part), 1), np.int32)
            for level in range(len(self.sizes) - 1, 0, -1):
                entry, _ = self._beam(part, level, entry[:, :1], 4, self.sizes[level], 1)
            entry = np.where(entry >= 0, entry, entry[:, :1])
            out.append(self._beam(part, 0, entry, max(ef, k), self.sizes[0], 4)[0][:, :k])
        return np.concatenate(out)


def lift(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, all of the same length."""
    square = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    last = np.sqrt(np.maximum(square.max() - square, 0))
    return np.concatenate([vectors, last[:, None]], axis=1).astype(np.float32)


def build_shard(classes: np.ndarray, vectors: np.ndarray, links: int, ef: int) -> bytes:
    """Index of one shard as pickled flat arrays; the node order and levels follow a hash of the class names."""
    rank = pd.util.hash_array(classes.astype(object)).astype(np.float64) / 2.0 ** 64
    level = np.floor(-np.log(np.maximum(rank, 1e-18)) / np.log(links)).astype(int)
    order = np.lexsort((rank, -level))
    counts = np.bincount(np.sort(level))
    sizes = np.cumsum(counts[::-1])[::-1].tolist()
    graph = Graph.build(lift(vectors)[order], sizes, links, ef)
    return pickle.dumps({"classes": classes[order], "originals": vectors[order], "lifted": graph.vectors, "sizes": sizes,
                         "tables": graph.tables}, protocol=5)


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes of one partition, a row per dimension and shard: ``dims``, ``shard``, ``index``. Options come with the rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).to_pandas()
    for (dims, shard), part in rows.groupby(["dims", "shard"]):
        blob = build_shard(part["class"].to_numpy(), np.stack(part["vector"].to_numpy()), int(part["links"].iat[0]), int(part["ef"].iat[0]))
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())],
                                         names=["dims", "shard", "index"])


def search_shards(batches: Iterator[pa.RecordBatch], schema: pa.Schema, ef: int) -> Iterator[pa.RecordBatch]:
    """Hits of rows sorted by shard and dimension, each shard's index before its queries: one index in memory at a time."""
    kept = graph = None
    for batch in batches:
        blobs, asked = batch.column("index"), []
        for at in [*np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
            first = asked[-1] + 1 if asked else 0
            asked.append(at)
            if at > first:  # queries of the index read last
                part = batch.slice(first, at - first)
                queries = np.stack(part.column("vector").to_numpy(zero_copy_only=False))
                wide = part.column("wide").to_numpy()
                flat = np.concatenate([queries, np.zeros((len(queries), 1), queries.dtype)], axis=1).astype(np.float32)
                found = graph.search(flat, int(wide.max()), ef)
                row, col = np.nonzero((found >= 0) & (np.arange(found.shape[1]) < wide[:, None]))
                near = found[row, col]
                score = np.einsum("ij,ij->i", kept["originals"][near].astype(np.float64), queries[row].astype(np.float64))
                names = part.column("class").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kept["classes"][near], pa.string()), pa.array(score),
                                                  pa.array(wide[row], pa.int32())], schema=schema)
            if at < batch.num_rows:
                kept = pickle.loads(blobs[at].as_py())
                graph = Graph(kept["lifted"], kept["sizes"], kept["tables"])


def neighbours(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", links: int = 16,
               ef_build: int = 64, ef_search: int = 160, ranges: int = 8, shard_rows: int = 16_384) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score`` of the ``k`` candidates with the largest inner product.

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, take
    no part. Only vectors of the same dimension are compared. A query meets every other row, equal
    vectors included, but no row of its own id; ties go to the smaller id. Repeated ids are candidates each;
    a repeated query row returns its list once. The vectors are cut into ``ranges`` of about equal numbers by their length,
    and each range by a hash into shards of about ``shard_rows`` distinct vectors, fewer where vectors have many
    components (``SHARD_COMPONENTS``); ``ef_search`` is chosen for that size.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    rows = rows.filter(valid(F.col("vector")) & F.col("id").isNotNull())
    # k + 1 distinct ids, each with its rows: without any one id at least k rows are left
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    owned = rows.groupBy("vector", "id").agg(F.count("*").alias("copies"))
    classes = (owned.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("vector")
               .agg(F.sort_array(F.collect_list(F.struct("id", F.least("copies", F.lit(k)).cast("int").alias("copies")))).alias("members")))
    name = F.concat(F.hex(F.xxhash64("vector")), F.lit(":"), F.col("members")[0]["id"].cast("string"))
    classes = saved(classes.withColumn("class", name), "classes")
    dims = F.size("vector").alias("dims")
    # a range of lengths is widened by a thousandth, so that vectors of one length are dealt over several ranges
    widened = F.lit(1.0) + F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / F.lit(1000.0 * (1 << 20))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x) * widened
    measured = classes.select("class", "vector", dims, square.alias("square"))
    n, components, bounds = measured.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0)),
                                         F.percentile_approx("square", [i / ranges for i in range(1, ranges)])).first()
    parts = max(1, -(-n // (shard_rows * ranges)), -(-components // (SHARD_COMPONENTS * ranges)))  # shards of a range
    shards = ranges * parts
    band = sum((F.col("square") > b).cast("int") for b in bounds or [])
    shard = F.lit(band) * parts + F.pmod(F.xxhash64("class", F.lit(2)), F.lit(parts)).cast("int")
    ranged = measured.select("class", "vector", "dims", shard.cast("int").alias("shard"), F.lit(links).alias("links"), F.lit(ef_build).alias("ef"))
    ranged = ranged.repartitionById(shards, F.col("shard"))
    index = saved(ranged.mapInArrow(build_shards, "dims int, shard int, index binary"), "index")

    asked = rows.filter("is_query").select(F.col("id").alias("query_id"), "vector").distinct()
    # as many more classes are fetched as a query's own id may fill
    spread = owned.groupBy(F.col("id").alias("query_id")).agg(F.count("*").cast("int").alias("own"))
    asked = saved(asked.join(classes.select("vector", "class"), "vector").join(spread, "query_id").select("query_id", "class", "own"), "asked")
    wide = asked.groupBy("class").agg((F.max("own") + k).alias("wide"))
    places = index.select(F.col("dims").alias("d"), "shard")
    wanted = classes.join(wide, "class").select("class", "vector", "wide", dims).join(places, F.col("dims") == F.col("d"))
    # every query goes past every shard, and every index is sent once: its queries follow it in sorted order
    met = (index.withColumn("turn", F.lit(0)).unionByName(wanted.drop("d").withColumn("turn", F.lit(1)), allowMissingColumns=True)
           .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "turn", "class"))
    arrow = arrow_schema(HITS)
    hits = met.select("index", "class", "vector", "wide").mapInArrow(lambda batches: search_shards(batches, arrow, ef_search), HITS)
    least = F.split("near", ":")[1].cast("long")
    best = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), least))
    hits = hits.withColumn("n", best).filter("n <= wide").drop("n", "wide")
    members = classes.select(F.col("class").alias("near"), F.inline("members"))
    members = members.select("near", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "id", "copy"))
    of_id = F.row_number().over(Window.partitionBy("class", "id").orderBy("n"))
    ids = F.sum(F.when(F.col("of_id") == 1, 1).otherwise(0)).over(Window.partitionBy("class").orderBy("n"))
    listed = hits.join(members, "near").withColumn("n", order).withColumn("of_id", of_id).filter(F.col("of_id") <= k)
    lists = (listed.withColumn("ids", ids).filter(F.col("ids") <= k + 1).groupBy("class")
             .agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("list")))
    own = asked.join(lists, "class")
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))
