"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash of their id, queries into groups, and each block meets each group once, in a
cell of bounded size. In a cell every dimension has its candidates sorted, and each list is read from its high end for
queries with a positive component there and from its low end for those with a negative one. Lists are read to a depth
that grows fourfold; a candidate met in any list is scored in full, for all queries of the cell that aren't done. A query is
done when the sum of its components times the values at its lists' depths, which bounds every candidate not yet met,
is below its kth score so far: then none of them can enter, not even by a tie.

The cells' lists of k are merged in steps, each over a bounded number of cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialize
from attestra.llm.vectors import exact_type, matrix, usable

K, CANDIDATES, QUERIES, MERGED = 20, 8192, 1024, 64
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def threshold_top_k(lists: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the k best rows of lists (ties to the smaller row) with their scores, and the number of rows scored.

    lists and queries hold whole numbers; own[q] is the row that query q leaves out, or -1. Rows that a query lacks, for
    there are fewer than k, are -1.
    """
    n, dims = lists.shape
    exact = exact_type(dims, lists, queries)
    values, wanted = lists.astype(exact), queries.astype(exact)
    order = np.argsort(lists, axis=0, kind="stable")
    best = np.full((len(queries), k), -1, np.int64)
    scores = np.full((len(queries), k), np.iinfo(np.int64).min, np.int64)
    met = np.zeros(n, bool)
    active = np.arange(len(queries))
    depth, scored = max(1, k // 4), 0
    up, down = np.maximum(wanted, 0), np.minimum(wanted, 0)
    while len(active) and n:
        depth = min(n, depth)
        new = np.zeros(n, bool)
        rising, falling = (up[active] != 0).any(0), (down[active] != 0).any(0)
        new[order[n - depth :, rising]] = True
        new[order[:depth, falling]] = True
        if depth == n:
            new[:] = True  # a query without any component that isn't 0 has no list
        new &= ~met
        met |= new
        rows = np.flatnonzero(new)
        scored += len(rows)
        if len(rows):
            got = wanted[active] @ values[rows].T
            floor = scores[active, -1]
            for at, q in enumerate(active.tolist()):
                fit = np.flatnonzero((got[at] >= floor[at]) & (rows != own[q]))
                if len(fit) > 4 * k:
                    least = np.partition(got[at, fit], len(fit) - k)[len(fit) - k]
                    fit = fit[got[at, fit] >= least]
                if len(fit):
                    s = np.append(scores[q], got[at, fit].astype(np.int64))
                    r = np.append(best[q], rows[fit])
                    top = np.lexsort((r, -s, r < 0))[:k]
                    scores[q], best[q] = s[top], r[top]
        if depth == n:
            break
        bound = up[active] @ values[order[n - depth], np.arange(dims)] + down[active] @ values[order[depth - 1], np.arange(dims)]
        active = active[(best[active, -1] < 0) | (scores[active, -1] <= bound.astype(np.float64))]
        depth *= 4
    return best, scores, scored


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, rows = table.column("vec_id").to_numpy(), matrix(table.column("vector"))
        # the smallest vector stands for an id that is repeated; rows by id, so that ties go to the smaller one
        order = np.lexsort((*rows.T[::-1], asks, ids))
        ids, rows, asks = ids[order], rows[order], asks[order]
        cand, query = ((mask & ~((ids == np.roll(ids, 1)) & mask & np.roll(mask, 1) & (np.arange(len(ids)) > 0))) for mask in (~asks, asks))
        ids_c, ids_q = ids[cand], ids[query]
        if not len(ids_c) or not len(ids_q):
            return _SCHEMA.empty_table()
        at = np.searchsorted(ids_c, ids_q)
        own = np.where(ids_c[np.minimum(at, len(ids_c) - 1)] == ids_q, at, -1)
        best, scores, _ = threshold_top_k(rows[cand], rows[query], own, k)
        q, r = np.nonzero(best >= 0)
        return pa.table([ids_q[q], ids_c[best[q, r]], scores[q, r]], schema=_SCHEMA)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k candidates of highest inner product, ties to smaller ids.

    vectors: vec_id and vector (array of whole numbers as doubles); is_query marks the queries by vec_id. Candidates are
    all rows but those with the query's own id, of its number of dimensions. Rows with a null id or vector, or a
    component that is null or not finite, take no part. A repeated id counts once, with its smallest vector.
    """
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(usable("vector") & F.col("vec_id").isNotNull())
    fit = materialize(fit.withColumns({"dim": F.size("vector"), "query": F.coalesce(is_query, F.lit(False))}), "vectors")
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    n, m, most = fit.agg(F.count(F.lit(1)), F.count_if("query"), F.max(largest)).first()
    # whole numbers travel in the narrowest type that holds them all
    fit = fit.withColumn("vector", F.col("vector").cast("array<smallint>" if (most or 0) < 2**15 else "array<int>" if most < 2**31 else "array<double>"))
    blocks, groups = max(1, math.ceil(n / candidates)), max(1, math.ceil(m / queries))
    mine = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cand = fit.select("vec_id", "vector", "dim", F.lit(False).alias("asks"), mine(blocks).alias("i"), every(groups).alias("j"))
    asks = fit.where("query").select("vec_id", "vector", "dim", F.lit(True).alias("asks"), every(blocks).alias("i"), mine(groups).alias("j"))
    cells = cand.union(asks).groupBy("dim", "i", "j").applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    found = cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks // MERGED + 1))))
    order = "order by score desc, vec_id"
    while blocks > MERGED:  # no query's lists of more than about MERGED cells meet in one task
        blocks = math.ceil(blocks / MERGED)
        found = found.withColumn("part", F.pmod("part", F.lit(blocks)))
        found = found.withColumn("rank", F.expr(f"row_number() over (partition by query_id, part {order})")).where(f"rank <= {k}").drop("rank")
    ranked = found.withColumn("rank", F.expr(f"row_number() over (partition by query_id {order})").cast("int")).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and vector: floor(scale * x) for every component x as a double; nulls and NaN stay."""
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(F.lit(float(scale)) * x).cast("double")))
    return embeddings.select("vec_id", wide.alias("vector"))
