"""Packing of token sequences into bins of one capacity: dominance reduction, then best fit.

Lengths are whole numbers from 1 to the capacity, so an instance of any size is a histogram of at most `capacity`
counts. The plan is made from that histogram on the driver, in steps over whole groups of equal lengths and equal free
space; its size is bounded by the capacity, not by the number of documents. Executors number the pieces within their
length and look their places up in the plan.

The plan's first part is the dominance reduction of Martello and Toth. For the longest free item j, take the largest
free item a that fits beside it, and the largest b that fits beside both:

- nothing fits beside j: {j} is final;
- a fills the bin, or no two free items fit beside j: {j, a} is final;
- every two free items that fit beside j are at most a together: {j, a} is final;
- no three free items fit beside j, and in every such pair whose sum exceeds a the smaller is at most b: {j, a, b} is final.

In each case every other feasible set with j splits into parts that fit into places of the final one, so some optimal
packing holds it. Items that no rule takes stay for the second part, best fit in order of decreasing length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import byte_batches, materialize
from attestra.llm.tokens import chunk_ids

CAPACITY, SEPARATOR = 4096, 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass
class Plan:
    """Entries by length: ranks from lo, count of them, to the bins from bin, each at offset."""

    entries: list[tuple[int, int, int, int, int]]  # length, lo, count, first bin, offset
    bins: int


class _Planner:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is not from 1 to {capacity}")
            self.free[length] = n
        self.used: dict[int, int] = defaultdict(int)
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        #: Runs of open bins by free space: (first, count); and whether there are any.
        self.open: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
        self.some = np.zeros(capacity + 1, bool)

    def place(self, length: int, first: int, n: int, offset: int) -> None:
        self.entries.append((length, self.used[length], n, first, offset))
        self.used[length] += n
        self.free[length] -= n

    def reduce(self) -> None:
        at = self.capacity
        while at:
            if not self.free[at]:
                at -= 1
                continue
            found = self._dominant(at)
            if found is None:
                at -= 1  # the other items of this length meet the same answer until shorter ones go
                continue
            need = defaultdict(int)
            for x in (at, *found):
                need[x] += 1
            n = int(min(self.free[x] // k for x, k in need.items()))
            offset, first = 0, self.bins
            self.bins += n
            for x in (at, *found):
                self.place(x, first, n, offset)
                offset += x
            # such bins are closed: no free item fits into what is left of them

    def _dominant(self, j: int) -> tuple[int, ...] | None:
        free = self.free
        free[j] -= 1
        try:
            room = self.capacity - j
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                return ()
            a = int(fits[-1])
            low = np.repeat(fits[:3], np.minimum(free[fits[:3]], 3))[:3]  # the three smallest free items
            if a == room or len(low) < 2 or low[0] + low[1] > room:
                return (a,)
            # the largest y with a free partner x >= y, x + y <= room and x + y > a
            partner = np.where(free[fits] > 1, fits, np.append(fits[1:], self.capacity + 1))
            pairs = fits[fits + partner <= room]
            free[a] -= 1
            left = np.flatnonzero(free[: max(0, room - a) + 1])
            free[a] += 1
            b = int(left[-1]) if len(left) else 0
            # for each y, the largest partner that still fits beside it
            best = fits[np.searchsorted(fits, room - pairs, "right") - 1]
            matters = pairs[(pairs + best > a)]
            if not len(matters):
                return (a,) if len(low) < 3 or low.sum() > room else None
            if b and (len(low) < 3 or low.sum() > room) and int(matters[-1]) <= b:
                return (a, b)
            return None
        finally:
            free[j] += 1

    def best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            while left := int(self.free[length]):
                space = length + int(self.some[length:].argmax())
                if not self.some[space]:
                    space = self.capacity
                    n = -(-left // (space // length))
                    self._reopen(space, self.bins, n)
                    self.bins += n
                self._fill(length, space, left)
                self.some[space] = bool(self.open[space])

    def _fill(self, length: int, space: int, left: int) -> None:
        """Into the bins of one free space, as many of this length as each takes, while there are any."""
        per, runs, offset = space // length, self.open[space], self.capacity - space
        while left and runs:
            first, n = runs.popleft()
            full = min(n, left // per)
            if full < n:
                rest = n - full - (left - full * per > 0)
                if rest:
                    runs.appendleft((first + n - rest, rest))
            if full:
                for k in range(per):
                    self.place(length, first, full, offset + k * length)
                self._reopen(space - per * length, first, full)
                left -= full * per
            if left and full < n:
                for k in range(left):
                    self.place(length, first + full, 1, offset + k * length)
                self._reopen(space - left * length, first + full, 1)
                left = 0

    def _reopen(self, space: int, first: int, n: int) -> None:
        if space:
            self.open[space].append((first, n))
            self.some[space] = True


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for counts[length] items of each length. Deterministic; no item is left out."""
    p = _Planner(counts, capacity)
    p.reduce()
    p.best_fit()
    return Plan(p.entries, p.bins)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and then the separator; only documents above the capacity are cut, every capacity ids.
    Null and empty texts are the separator alone. Whole texts are tokenized.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tail = chunk_ids(tokenizer), np.array([separator], "<u4").tobytes()
        for batch in byte_batches(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), known.packed(batch.column("text").to_pylist()), strict=True):
                ids = memoryview(ids + tail)
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype("<i4") if with_ids else None))
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*rows))[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(items: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every row of items; `items` must be cheap to reread (a written table).

    Rows of one length are interchangeable. They are numbered in buckets of a hash of the key, at most about
    20,000 to a bucket however common the length is, and the buckets' first numbers are running sums of their counts. Rows that
    repeat a key are numbered apart.
    """
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    buckets = 1 + sum(counts.values()) // 20_000
    by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for n, *entry in made.entries:
        by_length[n].append(tuple(entry))
    table = spark.sparkContext.broadcast({n: np.array(sorted(x), np.int64) for n, x in by_length.items()})

    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    placed = items.withColumn("_bucket", bucket)
    sizes = placed.groupBy(F.col(length).alias("_len"), F.col("_bucket").alias("_b")).count()
    runs = "sum(count) over (partition by _len order by _b rows between unbounded preceding and current row) - count"
    firsts = sizes.select("_len", "_b", F.expr(runs).alias("_first"))
    order = ", ".join(f"`{k}`" for k in key)
    ranked = placed.withColumn("_k", F.expr(f"row_number() over (partition by `{length}`, _bucket order by {order}) - 1"))
    ranked = ranked.join(firsts, (F.col(length) == F.col("_len")) & (F.col("_bucket") == F.col("_b")))
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(length).to_numpy(), batch.column("_rank").to_numpy()
            places = np.zeros((2, len(lengths)), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
                t = table.value[int(lengths[rows[0]])]
                at = t[np.searchsorted(t[:, 0], ranks[rows], "right") - 1]
                places[:, rows] = at[:, 2] + ranks[rows] - at[:, 0], at[:, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, places)], [*names, "sequence_id", "offset"])

    schema = items.schema
    for name in ("sequence_id", "offset"):
        schema = schema.add(name, "long")
    return ranked.select(*names, (F.col("_first") + F.col("_k")).cast("long").alias("_rank")).mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Every piece of every document with its place: sequence_id, and offset within the sequence, gapless from 0.

    A null text is empty, so it is one piece of the separator alone. Rows that repeat an id, or have none, are documents of
    their own; of equal lengths which goes where follows from the order of doc_id and piece. An empty table gives no rows.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, separator), "pieces")
    return pack(pieces, ["doc_id", "piece"], "length", capacity)
