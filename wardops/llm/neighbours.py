"""Exact nearest neighbours by a block matrix join with quantised tiles.

Queries and candidates are dealt into blocks by a hash of the whole row, so no key
makes a block large, and every query block meets every candidate block once.
Inside a cell both sides are quantised to int8 with a scale per vector.  The tile
of int8 products gives each inner product up to an error of
``|eq| |c| + |q'| |ec|`` (e: what quantising lost, q': the quantised query), so a
pair whose upper bound is below the k-th largest lower bound of its query cannot be
among the k nearest.  Surviving pairs are recomputed in double precision on the
original vectors and pushed through a heap per query; the heaps of all cells are
merged in Spark, which keeps k rows per query and task before it shuffles.

A cell is bounded by ``QUERY_BLOCK`` and ``BLOCK`` rows, give or take the chance of
a hash; nothing is collected or broadcast.  Rows move once per block of the other
side: that is the product the search asks for, in blocks.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows with a null id; vectors of different lengths
are not compared; equal repeated rows count once; an id with several vectors counts
once, by its best pair, and is never its own neighbour; equal scores are ordered
by id; empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import table

K = 20
QUERY_BLOCK = 2048
BLOCK = 32768
#: Candidates of a tile.
TILE = 4096


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, dim) of the vectors that take part; equal rows once."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    kept = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    return kept.distinct().withColumn("dim", F.size("v"))


def _matrix(cell: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = cell.column("id").to_numpy()
    flat = cell.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors and norms of what quantising lost."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny  # components too small to divide
    codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(vectors - back, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def nearest_in_cell(q_ids, queries, c_ids, candidates, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score): at least the k best ids of every query in this cell."""
    q_code, q_scale, q_norm, q_lost = quantise(queries)
    heaps: list[dict[int, float]] = [{} for _ in range(len(q_ids))]
    floor = np.full(len(q_ids), -np.inf)
    unique = len(np.unique(c_ids)) == len(c_ids)
    for at in range(0, len(c_ids), TILE):
        ids, tile = c_ids[at : at + TILE], candidates[at : at + TILE]
        code, scale, _, lost = quantise(tile)
        norm = np.linalg.norm(tile, axis=1)
        # products of int8 codes are whole numbers, exact in float32 for up to 1,000 components
        kind = np.float32 if tile.shape[1] <= 1000 else np.float64
        near = (q_code.astype(kind) @ code.astype(kind).T).astype(np.float64) * q_scale[:, None] * scale[None, :]
        error = q_lost[:, None] * norm[None, :] + q_norm[:, None] * lost[None, :]
        error += 1e-9 * (np.abs(near) + error) + np.finfo(np.float64).tiny
        own = q_ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - error)
        if unique and len(ids) > k:  # k different ids reach the k-th largest lower bound
            floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        i, j = np.nonzero((near + error >= floor[:, None]) & ~own)
        scores = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            scores[part] = inner(queries[i[part]], tile[j[part]])
        borders = np.searchsorted(i, np.arange(len(q_ids) + 1))
        for row, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            if a == b:
                continue
            best = heaps[row]
            for c, s in zip(ids[j[a:b]].tolist(), scores[a:b].tolist()):
                if s > best.get(c, -np.inf):
                    best[c] = s
            if len(best) > k:
                heaps[row] = best = dict(heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0])))
            if len(best) == k:
                floor[row] = max(floor[row], min(best.values()))
    return [(q, c, s) for q, best in zip(q_ids.tolist(), heaps) for c, s in best.items()]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, **columns) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query, by inner product.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = usable(vectors, **columns)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, q_blocks = max(1, -(-sizes.n // BLOCK)), max(1, -(-sizes.q // QUERY_BLOCK))
    draw = F.xxhash64("id", "v")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).select("id", "v", "dim", F.pmod(draw, F.lit(q_blocks)).cast("int").alias("qb"), each(n_blocks).alias("cb"))
    others = rows.select("id", "v", "dim", F.pmod(draw, F.lit(n_blocks)).cast("int").alias("cb"), each(q_blocks).alias("qb"))

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            found = nearest_in_cell(*_matrix(left, dim), *_matrix(right, dim), k)
        q, c, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ["dim", "qb", "cb"]
    cells = queries.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score double")
    best = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op1_sql() -> str:
    return f"""
    WITH rows AS (
      SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v)) AS score
      FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % 20 = 0 GROUP BY ALL)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= {K}"""
