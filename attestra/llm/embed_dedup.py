"""Near duplicates among embeddings of one label: int8 tile products with error bounds, doubles where they leave doubt.

A unit vector u is quantised to q * s, q in int8 and s = max|u| / 127, and its remainder e = u - q * s is measured. For
two vectors u and v the product of the quantised ones differs from the cosine by at most
(1 + |e_u|) |e_v| + |e_u| (1 + |e_v|) + |e_u| |e_v|, whatever the vectors; a pair whose quantised product is below the
threshold by more than that can't be linked, and all others are recomputed in double precision from the vectors
themselves. Products of int8 values are summed in floating-point numbers that hold them exactly.

Vectors that are equal are one weighted vector. The vectors of a label are dealt into blocks of at most about BLOCK by a
hash of their id, and each two blocks meet in one cell. What leaves a cell grows with its rows, not with its pairs: for
each linked vector its number of links there, and the smallest id that it is tied to there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import connected_components, local_components, materialize
from attestra.llm.vectors import matrix, usable

THRESHOLD, BLOCK = 0.98, 2048
_TILE, _RECHECK = 1024, 1 << 16
#: For the rounding of the bounds themselves.
_SLACK = 1e-12
_CELL = "vec_id bigint, f1 bigint, links bigint, root bigint"
_CELL_ARROW = pa.schema([("vec_id", pa.int64()), ("f1", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and lengths of the remainders of rows of length one."""
    scales = np.abs(units).max(1, initial=0) / 127
    values = np.rint(units / scales[:, None]).astype(np.int8)
    return values, scales, np.sqrt(((units - values * scales[:, None]) ** 2).sum(1))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float):
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, a block of them at a time; no row is zero."""
    norms = [np.sqrt((z * z).sum(1)) for z in (x, y)]
    (qx, sx, ex), (qy, sy, ey) = (quantised(z / n[:, None]) for z, n in zip((x, y), norms, strict=True))
    exact = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64
    qy = np.ascontiguousarray(qy.T.astype(exact))
    for at in range(0, len(x), _TILE):
        e = ex[at : at + _TILE, None]
        close = (qx[at : at + _TILE].astype(exact) @ qy).astype(np.float64)
        close *= sx[at : at + _TILE, None]
        close *= sy
        close += (1 + e) * ey + e * (1 + 2 * ey) + _SLACK
        i, j = np.nonzero(close >= threshold)
        for k in range(0, len(i), _RECHECK):
            a, b = i[k : k + _RECHECK] + at, j[k : k + _RECHECK]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (norms[0][a] * norms[1][b])
            yield a[cosine >= threshold], b[cosine >= threshold]


def _cell(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("block").to_numpy() == table.column("i")[0].as_py()
        ids, weights = table.column("vec_id").to_numpy(), table.column("weight").to_numpy()
        rows = matrix(table.column("vector"))
        # scaled by a power of two, so that squares neither overflow nor vanish
        rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])
        f1 = table.column("f1").to_numpy()
        once = np.unique(np.stack([f1, ids]), axis=1, return_index=True)[1]
        left, right = once[first[once]], once[~first[once]]
        alone = not len(right)
        if alone and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            return _CELL_ARROW.empty_table()
        links = np.zeros(len(ids), np.int64)
        ends: list[np.ndarray] = []
        for a, b in linked_pairs(rows[left], rows[left if alone else right], threshold):
            a, b = left[a], (left if alone else right)[b]
            if alone:
                a, b = a[a < b], b[a < b]
            np.add.at(links, a, weights[b])
            np.add.at(links, b, weights[a])
            tie = local_components(len(ids), a, b)
            ends.append(np.stack([np.arange(len(ids)), tie])[:, tie != np.arange(len(ids))])
        tied = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        root = ids[by_id][local_components(len(ids), place[tied[0]], place[tied[1]])][place]
        some = links > 0
        return pa.table([ids[some], f1[some], links[some], root[some]], schema=_CELL_ARROW)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label, ...).

    Linked are two vectors of one label that isn't null, of one length, with a cosine of at least the threshold in double
    precision. Vectors that are null, empty, zero, or hold a null or a number that isn't finite, and rows without a
    label or vec_id, link with nothing. n_links counts the other rows linked directly, copies included; rows that repeat
    a vec_id are vectors of their own. component_id is the smallest vec_id reachable by links. Rows with a null vec_id
    have a null component and are kept. Other columns are not read.
    """
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = usable("vector") & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    vector = F.transform("vector", lambda x: x + F.lit(0.0))  # no negative zeros
    named = rows.where(fit).select("vec_id", "label", vector.alias("vector"))
    named = named.withColumns({"f1": F.xxhash64("label", "vector"), "f2": F.xxhash64(F.lit(1), "vector", "label"), "dim": F.size("vector")})
    copies = named.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    named = materialize(named.join(materialize(copies, "copies"), ["f1", "f2"]), "vectors")

    reps = named.where("vec_id = rep")
    sizes = materialize(reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    # components that came as single-precision numbers travel as those, nothing is lost
    travels = F.col("vector").cast("array<float>") if narrow else F.col("vector")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "f1", "weight", travels.alias("vector"))
    found = materialize(cells.groupBy("label", "dim", "i", "j").applyInArrow(_cell(threshold), _CELL), "links")

    component = connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    direct = materialize(found.groupBy("vec_id", "f1").agg(F.sum("links").alias("links")), "direct")
    ended = reps.select("vec_id", "f1").distinct().join(direct, ["vec_id", "f1"], "left").join(component, F.col("vec_id") == F.col("node"), "left")
    ended = materialize(ended.select(F.col("vec_id").alias("rep"), "f1", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec_id").alias("component_id")), "ended")
    linked = named.join(ended, ["rep", "f1"]).select("vec_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = linked.union(rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
