"""SentencePiece encoding and decoding: a Viterbi search over a double-array trie of pieces with log scores.

The pieces come from a model file. A unigram model's scores are its log scores; a BPE model's are minus the order in
which its pieces were merged, and the log score of the kth piece is then -log(k + 1), as frequencies fall by rank: a BPE file
holds no log scores, and tokenizers are not trained here.

A text is prefixed with a space, where the model says so, and spaces become the marker U+2581. The path of the highest
sum of scores wins, and of equal ones that whose last piece is longer. A character that no piece covers costs ten more than
the worst piece and becomes the pieces of its UTF-8 bytes, or the unknown piece in a model without byte pieces.

No piece of the models read here holds a marker after another character, so the best path of a text is those of its
chunks (spaces and what follows up to the next space), one after another; this is checked when a model is read, and where
it doesn't hold, texts are chunks as a whole. Workers keep the ids of the chunks they have seen, up to a bound, and search
all new chunks of a batch at once in numpy, position by position; chunks of over LONG bytes one by one.

Decoding joins pieces and bytes, turns markers into spaces and drops the prefix; bytes that aren't UTF-8 become U+FFFD. It
gives back every text that was encoded, but that U+2581 itself comes back as a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import byte_slices

MARKER = chr(0x2581)
LONG, KNOWN, GROUP = 192, 300_000, 50_000
_PENALTY = 10.0
#: Sums of one set of scores in another order are equal.
_EQUAL = 1e-9
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers, and bytes for all else."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class DoubleArray:
    """A trie of byte strings: the child of node n by byte b is base[n] + b + 1, if check there is n; leaf is a string's number or -1."""

    def __init__(self, strings: list[tuple[bytes, int]]):
        size = 1 << 10
        base, check, leaf = [np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)]
        check[0] = 0
        strings = sorted(strings)
        free = top = 1
        work = [(0, 0, len(strings), 0)]  # node, range of strings, depth
        while work:
            node, low, high, depth = work.pop()
            if low < high and len(strings[low][0]) == depth:
                leaf[node] = strings[low][1]
                low += 1
            if low == high:
                continue
            groups, start = [], low
            for k in range(low + 1, high + 1):
                if k == high or strings[k][0][depth] != strings[start][0][depth]:
                    groups.append((strings[start][0][depth] + 1, start, k))
                    start = k
            codes = np.array([g[0] for g in groups])
            if top + 600 > size:
                base, check, leaf = (np.concatenate([x, np.full(size, v, np.int32)]) for x, v in ((base, 0), (check, -1), (leaf, -1)))
                size *= 2
            while check[free] >= 0:
                free += 1
            # a few tries in the holes, or else behind all others
            tries = range(max(1, free - int(codes[0])), max(1, free - int(codes[0])) + 8)
            at = next((t for t in tries if not (check[t + codes] >= 0).any()), max(1, top + 1 - int(codes[0])))
            top = max(top, at + int(codes[-1]))
            base[node] = at
            check[at + codes] = node
            work += [(at + code, start, stop, depth + 1) for code, start, stop in groups]
        # room behind the last node for any byte, and a node that is nobody's child for the end of a text
        pad = np.full(300, -1, np.int32)
        self.base, self.check, self.leaf = np.append(base, pad * 0), np.append(check, pad), np.append(leaf, pad)


class Model:
    """Pieces, scores and the search."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool = False, prefix: bool = True):
        self.pieces, self.prefix = pieces, prefix
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        known = [k for k, p in enumerate(pieces) if p[2] in (NORMAL, USER)]
        self.scores = np.array([p[1] for p in pieces], np.float64)
        if bpe:
            self.scores[known] = -np.log(1 + np.arange(len(known)))
        if known:
            best, worst = self.scores[known].max(), self.scores[known].min()
            for k in known:
                if pieces[k][2] == USER:  # always taken
                    self.scores[k] = len(pieces[k][0].encode()) * best - 0.1 if best > 0 else -0.1
        else:
            worst = 0.0
        self.unknown_score = worst - _PENALTY
        self.bytes = np.full(256, self.unknown, np.int32)
        for k, p in enumerate(pieces):
            if p[2] == BYTE:
                self.bytes[int(p[0][3:-1], 16)] = k
        self.fallback = any(p[2] == BYTE for p in pieces)
        self.trie = DoubleArray([(pieces[k][0].encode(), k) for k in known])
        self.chunked = all(MARKER not in pieces[k][0].lstrip(MARKER) for k in known)
        self.single = {pieces[k][0] for k in known if len(pieces[k][0]) == 1}
        self.surface = [p[0].replace(MARKER, " ").encode() if p[2] in (NORMAL, USER, UNUSED) else bytes([int(p[0][3:-1], 16)]) if p[2] == BYTE else b" \xe2\x81\x87 " if p[2] == UNKNOWN else b"" for p in pieces]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def read(path: str) -> Model:
        """From a model file whose normalizer is the identity."""
        pieces, bpe, prefix, name = [], False, True, b"identity"
        with open(path, "rb") as f:
            data = f.read()
        for number, value in wire(data):
            if number == 1:
                found = dict(wire(value))
                pieces.append((found.get(1, b"").decode(), float(np.frombuffer(found[2], "<f4")[0]) if 2 in found else 0.0, found.get(3, NORMAL)))
            elif number == 2:
                bpe = dict(wire(value)).get(3, 1) == 2
            elif number == 3:
                found = dict(wire(value))
                name, prefix = found.get(1, name), bool(found.get(3, 1))
                if found.get(4, 1):
                    raise ValueError("models that drop extra white space aren't supported")
        if name != b"identity":
            raise ValueError(f"normalizer {name!r} isn't supported")
        return Model(pieces, bpe, prefix)

    def _search_one(self, text: bytes) -> list[int]:
        """The ids of one long chunk."""
        base, check, leaf, scores = self._lists()
        n = len(text)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == -np.inf:
                continue
            size = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            node, k, single = 0, at, False
            while k < n:
                child = base[node] + text[k] + 1
                if check[child] != node:
                    break
                node, k = child, k + 1
                if leaf[node] >= 0:
                    single = single or k - at == size
                    if here + scores[leaf[node]] > best[k] + _EQUAL:
                        best[k], back[k], piece[k] = here + scores[leaf[node]], at, leaf[node]
            if not single and here + self.unknown_score > best[at + size] + _EQUAL:
                best[at + size], back[at + size], piece[at + size] = here + self.unknown_score, at, -1
        out, at = [], n
        while at:
            out += [piece[at]] if piece[at] >= 0 else self.bytes[np.frombuffer(text[back[at] : at], np.uint8)].tolist()[::-1] if self.fallback else [self.unknown]
            at = back[at]
        return out[::-1]

    def _lists(self) -> tuple[list, list, list, list]:
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.leaf, self.scores))
        return self._as_lists

    def _search(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of many short chunks, all positions of one number at a time."""
        base, check, leaf = self.trie.base, self.trie.check, self.trie.leaf
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order])
        starts = np.append(0, np.cumsum(sizes + 1))[:-1]
        codes = np.frombuffer(b"".join(texts[k] + b"\0" for k in order), np.uint8).astype(np.int32) + 1
        codes[starts + sizes] = 299  # nobody's child
        lead = codes - 1
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        best = np.full(len(codes), -np.inf)
        back, piece = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int32)
        best[starts] = 0.0
        for at in range(int(sizes[0]) if len(sizes) else 0):
            here = starts[: int(np.searchsorted(-sizes, -at, "left"))] + at
            here = here[best[here] > -np.inf]
            single = np.zeros(len(here), bool)
            rows, node, depth = np.arange(len(here)), np.zeros(len(here), np.int32), 0
            while len(rows):
                child = base[node] + codes[here[rows] + depth]
                stay = check[child] == node
                rows, node = rows[stay], child[stay]
                depth += 1
                found = leaf[node] >= 0
                r, ids = rows[found], leaf[node[found]]
                single[r[depth == width[here[r]]]] = True
                to, score = here[r] + depth, best[here[r]] + self.scores[ids]
                better = score > best[to] + _EQUAL
                best[to[better]], back[to[better]], piece[to[better]] = score[better], here[r[better]], ids[better]
            r = np.flatnonzero(~single)
            to, score = here[r] + width[here[r]], best[here[r]] + self.unknown_score
            better = score > best[to] + _EQUAL
            best[to[better]], back[to[better]], piece[to[better]] = score[better], here[r[better]], -1
        at, row, steps = starts + sizes, np.arange(len(sizes)), []
        while len(row):
            steps.append((row, piece[at], back[at], at))
            at = back[at]
            left = at > starts[row]
            at, row = at[left], row[left]
        if not steps:
            return [b""] * len(texts)
        row, ids, low, high = (np.concatenate(x) for x in zip(*steps))
        path = np.lexsort((low, row))
        row, ids, low, high = row[path], ids[path], low[path], high[path]
        times = np.where(ids < 0, high - low if self.fallback else 1, 1)
        at = np.repeat(np.arange(len(ids)), times)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        full = np.where(ids[at] >= 0, ids[at], self.bytes[lead[low[at] + inside] & 255]).astype("<i4")
        ends = np.cumsum(np.bincount(row[at], minlength=len(texts)))
        packed, out, start = full.tobytes(), [b""] * len(texts), 0
        for k, end in zip(order, ends.tolist(), strict=True):
            out[k] = packed[4 * start : 4 * end]
            start = end
        return out

    def _learn(self, chunks: set[str]) -> None:
        short, long = [], []
        for c in chunks:
            b = c.replace(" ", MARKER).encode()
            (short if len(b) <= LONG else long).append((c, b))
        for at in range(0, len(short), GROUP):
            part = short[at : at + GROUP]
            self.known.update(zip((c for c, _ in part), self._search([b for _, b in part]), strict=True))
        for c, b in long:
            self.known[c] = np.array(self._search_one(b), "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Each text's ids as little-endian 32-bit; null for null."""
        pattern = re.compile(" *[^ ]+| +") if self.chunked else re.compile("(?s).+")
        lead = " " if self.prefix else ""
        split = [[] if not t else pattern.findall(lead + t) for t in texts]
        out, start = [], 0
        while start < len(split):
            need: set[str] = set()
            stop = start
            while stop < len(split) and len(need) < KNOWN // 8:
                need.update(split[stop])
                stop += 1
            new = need - self.known.keys()
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = need
            self._learn(new)
            out += [b"".join(map(self.known.__getitem__, s)) for s in split[start:stop]]
            start = stop
        return [None if t is None else x for t, x in zip(texts, out, strict=True)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


@lru_cache(2)
def model(path: str) -> Model:
    """One for each worker process and model file."""
    return Model.read(path)


def _id_lists(packed: list[bytes | None]) -> pa.ListArray:
    sizes = np.array([0 if x is None else len(x) // 4 for x in packed], np.int64)
    values = pa.array(np.frombuffer(b"".join(x for x in packed if x), "<i4"))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values, mask=pa.array([x is None for x in packed], pa.bool_()))


def encode(text: str | Column, path: str) -> Column:
    """Array of ids of a text column; null for null, empty for empty.

    Of paths with equal sums that whose last piece is longer wins. Rows are read alone: repeated ones give equal ids, an
    empty table none.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_id_lists(model(path).encode(part.to_pylist())) for part in byte_slices(texts)])

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def encode_checked(text: str | Column, path: str) -> Column:
    """ids, and whether decoding them gives the text back (a marker in it as a space), in one pass; null ids and true for null."""

    def checked(part: pa.Array) -> pa.Array:
        m, given = model(path), part.to_pylist()
        packed = m.encode(given)
        same = [t is None or m.decode(np.frombuffer(x, "<i4").tolist()) == t.replace(MARKER, " ") for t, x in zip(given, packed, strict=True)]
        return pa.StructArray.from_arrays([_id_lists(packed), pa.array(same, pa.bool_())], names=["ids", "same"])

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([checked(part) for part in byte_slices(texts)])

    return F.arrow_udf(run, T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("same", T.BooleanType()))(text)


def decode(ids: str | Column, path: str) -> Column:
    """The text of an array of ids; ids that are null or of no piece are left out; null for null."""

    def run(rows: pa.Array) -> pa.Array:
        m = model(path)
        n = len(m.pieces)
        flat, out = rows.flatten().to_numpy(zero_copy_only=False), []
        ends = np.cumsum([0 if not v else v for v in pc.list_value_length(rows).to_pylist()]).tolist()
        start = 0
        for end, null in zip(ends, rows.is_null().to_pylist(), strict=True):
            part = flat[start:end]
            if part.dtype != np.int32 or (part < 0).any() or (part >= n).any():
                part = np.array([x for x in part.tolist() if x == x and x is not None and 0 <= x < n], np.int32)
            out.append(None if null else m.decode(part.tolist()))
            start = end
        return pa.array(out, pa.string())

    return F.arrow_udf(run, T.StringType())(ids)
