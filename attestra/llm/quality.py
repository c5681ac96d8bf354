"""Document quality: random-indexing word vectors, pooled, and a two-layer network with a calibrated temperature.

Words are runs of letters, digits and non-ASCII bytes, marks are runs of other visible characters. A word falls into one of
2^14 buckets by a hash of its lower-cased bytes, and its shape (case, digits, length) into one of a few more; a mark has a
bucket only. Every bucket has a sparse random index vector of plus and minus ones that follows from its number. The context
vector of a bucket is the sum of the index vectors of the words up to WINDOW places away from its own, over all documents.
Those sums are whole numbers, so they don't depend on how the documents are partitioned. The number of buckets is a
parameter that bounds what is sent to all tasks (3 MB); words of one bucket share a vector.

A document's features are the mean of its words' unit context vectors, that mean's length, and three plain figures: the
logarithm of the number of words, the share of distinct ones and the share of words that repeat the one before. The
network's probabilities are divided by a temperature (in the logit) fitted on labelled rows kept apart for that.

Labels are learned from a bounded sample: the TRAIN_ROWS rows with the smallest hash of doc_id. Everything else covers
all rows and whole texts, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import byte_batches, byte_slices
from attestra.llm.shingles import _BYTE, _INVERSE, _POWER, _mix

WORDS, SHAPES, DIMS, NONZERO, WINDOW = 1 << 14, 20, 48, 6, 2
BUCKETS = WORDS + SHAPES
TRAIN_ROWS, HIDDEN, EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 20_000, 32, 60, 1_200, 256, 3e-3, 1e-4
THRESHOLD = 0.3
_U = np.uint64
#: Bytes of a text, and words of many, that are worked on at once; results don't depend on them.
_PART, _PIECE = 1 << 18, 1 << 16

_KIND = np.full(256, 2, np.uint8)  # 0 between words, 1 in a word, 2 in a mark
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[*range(33)]] = 0
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int8)
_DIGIT[48:58] = 1


def index_vectors() -> np.ndarray:
    """BUCKETS rows of DIMS numbers, NONZERO of them plus or minus one, by the bucket's number alone; and a row of zeros."""
    keys = _mix(np.arange(BUCKETS * DIMS, dtype=_U).reshape(BUCKETS, DIMS) + _U(1 << 40))
    at = np.argsort(keys, axis=1)[:, :NONZERO]
    out = np.zeros((BUCKETS + 1, DIMS), np.int16)
    np.put_along_axis(out[:-1], at, np.where(np.take_along_axis(keys, at, 1) & _U(1), 1, -1).astype(np.int16), 1)
    return out


def _cuts(kind: np.ndarray) -> np.ndarray:
    """Where parts of a text end: behind a byte of no word, every _PART bytes or at the next one."""
    cuts, at = [0], 0
    while len(kind) - at > _PART:
        free = np.flatnonzero(kind[at + _PART // 2 : at + _PART] == 0)
        at = at + _PART // 2 + int(free[-1]) + 1 if len(free) else at + _PART
        if not len(free):  # a run without a gap goes on as far as it does
            rest = np.flatnonzero(kind[at:] == 0)
            at = at + int(rest[0]) + 1 if len(rest) else len(kind)
        cuts.append(at)
    return np.array(cuts if cuts[-1] == len(kind) else [*cuts, len(kind)])


def _hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word; those of runs longer than the powers at hand are made of their pieces."""
    if len(part) < len(_POWER):
        total = np.append(_U(0), np.cumsum(_BYTE[part] * _POWER[: len(part)]))
        return _mix((total[ends] - total[starts]) * _INVERSE[starts])
    out = np.zeros(len(starts), _U)
    for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        h = np.zeros(1, _U)
        for at in range(start, end, _PART):
            piece = part[at : min(at + _PART, end)]
            h = (_mix(h) if at > start else h) + (_BYTE[piece] * _POWER[: len(piece)]).sum(dtype=_U, keepdims=True)
        out[k] = _mix(h)[0]
    return out


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word or mark, and the bucket of its shape (-1 for marks)."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashes, shapes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    kinds = _KIND[raw]
    cuts = _cuts(kinds)
    for low, high in zip(cuts, cuts[1:], strict=False):
        part, kind = raw[low:high], kinds[low:high]
        cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(part))
        seen = kind[starts] > 0
        starts, ends = starts[seen], ends[seen]
        hashes.append(_hashes(part, starts, ends))
        sums = lambda v: np.append(0, np.cumsum(v, dtype=np.int32))
        upper, digit = sums(_UPPER[part]), sums(_DIGIT[part])
        size, up = ends - starts, upper[ends] - upper[starts]
        first = _UPPER[part[starts]] > 0
        case = np.where(digit[ends] > digit[starts], 4, np.where(up == 0, 0, np.where((up == 1) & first, 1, np.where(up == size, 2, 3))))
        long = np.searchsorted((3, 7, 12), size)
        shapes.append(np.where(kind[starts] == 1, WORDS + 4 * case + long, -1))
    return np.concatenate(hashes), np.concatenate(shapes)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % _U(WORDS)).astype(np.int64)


def add_contexts(total: np.ndarray, words: np.ndarray, shapes: np.ndarray, index: np.ndarray) -> None:
    """Adds to each word's and shape's row the index vectors of the words near by; BUCKETS is no word, shapes of -1 have no row."""
    for low in range(0, len(words), _PIECE):
        high = min(low + _PIECE, len(words))
        left, right = max(0, low - WINDOW), min(high + WINDOW, len(words))
        vectors = np.take(index.T, words[left:right], axis=1)
        near = np.zeros((DIMS, high - low), np.int16)
        for far in range(1, WINDOW + 1):
            for step in (-far, far):
                a, b = max(low, left - step), min(high, right - step)
                near[:, a - low : b - low] += vectors[:, a + step - left : b + step - left]
        for rows in (words[low:high], shapes[low:high]):
            kept = np.flatnonzero((rows >= 0) & (rows < BUCKETS))
            if len(kept):
                kept = kept[np.argsort(rows[kept], kind="stable")]
                found = rows[kept]
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                total[found[first]] += np.add.reduceat(np.take(near, kept, axis=1), first, axis=1, dtype=np.int32).T


def context_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS rows of DIMS whole numbers: the sums of neighbours' index vectors over all documents.

    Each task adds up its own documents and sends one row for each bucket it has met; what reaches the driver is one row
    for each bucket.
    """
    names = [f"d{k}" for k in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index = np.zeros((BUCKETS, DIMS), np.int64), index_vectors()
        apart = np.full(WINDOW, BUCKETS)
        for batch in byte_batches(batches, "text", 1_000_000):
            words, shapes = [], []
            for text in batch.column("text").to_pylist():
                hashes, shape = words_of(text)
                words += [buckets_of(hashes), apart]
                shapes += [shape, np.full(WINDOW, -1)]
            if words:
                add_contexts(total, np.concatenate(words), np.concatenate(shapes), index)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(DIMS))], ["bucket", *names])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    sums = rows.groupBy("bucket").agg(*(F.sum(n).cast("double").alias(n) for n in names)).toPandas()
    out = np.zeros((BUCKETS, DIMS))
    out[sums["bucket"].to_numpy(np.int64)] = sums[names].to_numpy(np.float64)
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Without their common direction and of length one; rows of zeros stay."""
    total = np.abs(vectors).sum(1, keepdims=True)
    shares = vectors / np.where(total > 0, total, 1)
    shares -= np.where(total > 0, shares[total[:, 0] > 0].mean(0) if (total > 0).any() else 0, 0)
    norms = np.sqrt((shares**2).sum(1, keepdims=True))
    return (shares / np.where(norms > 0, norms, 1)).astype(np.float32)


def features(texts: list[str | None], units: np.ndarray) -> np.ndarray:
    """DIMS + 4 numbers for each text; a null text is empty."""
    out = np.zeros((len(texts), DIMS + 4))
    for k, text in enumerate(texts):
        hashes, shapes = words_of(text)
        if n := len(hashes):
            words, shapes = buckets_of(hashes), shapes[shapes >= 0]
            parts = (units[rows[at : at + _PIECE]].sum(0, dtype=np.float64) for rows in (words, shapes) for at in range(0, len(rows), _PIECE))
            pooled = sum(parts, np.zeros(DIMS)) / n
            out[k, :DIMS] = pooled
            out[k, DIMS:] = np.sqrt((pooled**2).sum()), np.log1p(n) / 10, len(np.unique(hashes)) / n, (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0
    return out


@dataclass
class Model:
    units: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = _forward(self.layers, (x - self.center) / self.spread)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, (hidden @ layers[2] + layers[3])[:, 0]


def train(x: np.ndarray, y: np.ndarray, units: np.ndarray, seed: int = 7) -> Model:
    """Adam on the cross-entropy; a fifth of the rows sets the temperature. Without both labels, the share of ones is the answer."""
    rng = np.random.default_rng(seed)
    center, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        flat = [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))])]
        return Model(units, center, spread, flat, 1.0)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - center) / spread
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    batches = max(1, len(used) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))  # few rows are seen more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(used), batches):
            hidden, logits = _forward(layers, z[rows])
            error = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - y[rows])[:, None] / len(rows)
            back = error @ layers[2].T * (1 - hidden**2)
            slopes = [z[rows].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], error.sum(0)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                layers[k] = layers[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logits, target = (_forward(layers, z[held])[1], y[held]) if len(held) else (np.zeros(1), np.zeros(1))
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.logaddexp(0, -np.where(target > 0, 1, -1) * logits / t).mean() for t in grid]
    return Model(units, center, spread, layers, float(grid[int(np.argmin(loss))]) if len(held) else 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: the checksum of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model for docs(doc_id, text) from labels(doc_id, quality); held-out, null and other labels than 0 and 1 aren't read."""
    units = unit_rows(context_vectors(docs))
    known = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_quality"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)  # bounded, so it can be sent to all
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            x = features(batch.column("text").to_pylist(), units)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_quality"), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "_quality", "x"])

    found = rows.mapInArrow(run, "_id bigint, _quality int, x array<double>").dropDuplicates(["_id"]).toPandas().sort_values("_id")
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, DIMS + 4)
    return train(x, found["_quality"].to_numpy(np.float64), units)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability that a text is good, for empty and null texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array(np.concatenate([known.probabilities(features(part.to_pylist(), known.units)) for part in byte_slices(texts)]))

    return F.arrow_udf(run, T.DoubleType())(F.col(text).cast("string"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs. Rows with a null doc_id are scored and not held out."""
    rows = docs.select("doc_id", held_out().alias("held_out"), score(docs, fit(docs, labels)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least the threshold, with all their columns."""
    return docs.where(score(docs, fit(docs, labels)) >= threshold)
