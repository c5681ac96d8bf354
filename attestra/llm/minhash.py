"""Near duplicates by a signature-coordinate inverted join.

Each document is posted under its (coordinate, value) pairs; two documents with enough posts in common are compared on
their full shingle sets. What keeps the join small, without losing pairs:

- Documents with equal sets are one class; only one of each class goes on.
- Prefix: two signatures of K coordinates with at least T collisions share one of any K - T + 1 of their posts taken in
  one order for all. The order is by how common a post is, rarest first, so posts of passages that many documents share
  come last and stay out, and a document without near duplicates has no post in its prefix that anybody else has.
- Merging: the lists of posts come sorted, many short ones to a batch, and each two documents of a list are merged
  coordinate by coordinate; those with at least T collisions are kept. A long list is dealt into blocks, and each two
  blocks meet in one cell of bounded size.
- Skip: documents of a list that are tied already aren't merged again. What leaves a batch are the pairs that tie its
  documents together, fewer than its documents.

The pairs' components are the only documents whose full sets are read, in cells of bounded size too. There a document is
compared with those of another component only, on bits over the shingles that two of the cell's documents have. The first
block meets all others; what that leaves apart from the largest part then meets everything, so a group of copies of
any size costs a number of cells in proportion to it.

Components need no more links than those. A pair at the similarity threshold is missed only if fewer than T of its K
coordinates collide; K = 24, T = 9 make that a chance of about 2 in 10^8 at 0.85, and 10^-6 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import byte_batches, connected_components, local_components, materialize
from attestra.llm.shingles import Sets, min_hashes, shingle_sets

WIDTH, COORDINATES, MATCHES = 5, 24, 9
#: A block of a list, or of documents with their sets, has about this many documents and shingles at most (or is one document).
BLOCK_POSTS, BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1_000, 500, 400_000
#: Lists up to this long are merged side by side, longer ones row by row.
SHORT_LIST = 16
#: Tables of up to this many rows, of some tens of bytes each, are sent to all tasks.
BROADCAST_ROWS = 400_000


def signatures(docs: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128 bits that name the set) and sig (null for an empty set) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            sizes = np.diff(sets.ends, prepend=0)
            sigs = min_hashes(sets, coordinates)
            names = np.zeros((2, len(sizes)), np.uint64)
            if (full := sizes > 0).any():
                starts = (sets.ends - sizes)[full]
                names[0, full] = np.add.reduceat(sets.values, starts)
                names[1, full] = np.bitwise_xor.reduceat(sets.values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1), starts)
            offsets = np.append(0, np.cumsum(np.where(full, coordinates, 0))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sigs[full].ravel()), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in names), arrays], ["doc_id", "n_shingles", "f1", "f2", "sig"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<int>")


def _lists(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """post, i, j, block, doc, sig and n_shingles: the lists of posts that more than one class has in its prefix, as cells of blocks."""
    post = F.posexplode("sig").alias("at", "value")
    every = classes.select("doc", post).select("doc", F.xxhash64("at", "value").alias("post"))
    common = every.groupBy("post").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = every.join(materialize(common, "common"), "post").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("times", "post"))).alias("posts"))
    # posts that only this class has are the rarest and come first in the prefix
    alone = F.lit(coordinates) - F.size("posts")
    prefix = F.slice("posts", F.lit(1), F.greatest(F.lit(0), F.lit(coordinates - matches + 1) - alone))
    posts = materialize(shared.select("doc", F.explode(prefix).alias("p")).select("doc", F.col("p.post").alias("post")), "posts")
    sized = posts.groupBy("post").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    sized = materialize(sized.select("post", F.ceil(F.col("times") / BLOCK_POSTS).cast("int").alias("blocks")), "sized-posts")
    dealt = posts.join(sized, "post").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("post", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc")
    return cells.join(classes.select("doc", "sig", "n_shingles"), "doc")


def merged(keys: np.ndarray, two: np.ndarray, blocks: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that tie together the rows of each list (equal keys, side by side) with enough collisions.

    Sizes bound the similarity. Rows of one block don't meet in a list of two.
    """
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(edges, len(keys)))
    short = np.repeat(lengths <= SHORT_LIST, lengths)
    until = np.repeat(edges + lengths, lengths)
    fits = lambda a, b: 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    found = [np.zeros((2, 0), np.int64)]
    for far in range(1, SHORT_LIST):
        a = np.flatnonzero(short & (np.arange(len(keys)) + far < until))
        if not len(a):
            break
        b = a + far
        kept = fits(a, b) & (~two[a] | (blocks[a] != blocks[b]))
        a, b = a[kept], b[kept]
        kept = (sigs[a] == sigs[b]).sum(1) >= matches
        found.append(np.stack([a[kept], b[kept]]))
    for start, length in zip(edges[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist(), strict=True):
        label = np.arange(length)
        for k in range(length):
            rest = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
            rest = rest[fits(start + k, start + rest) & (~two[start + k] | (blocks[start + k] != blocks[start + rest]))]
            rest = rest[(sigs[start + rest] == sigs[start + k]).sum(1) >= matches]
            if len(rest):
                tied, first = np.unique(label[rest], return_index=True)
                found.append(np.stack([np.full(len(tied), start + k), start + rest[first]]))
                label[np.isin(label, tied)] = label[k]
    both = np.concatenate(found, axis=1)
    return both[0], both[1]


def _collisions(lists: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs (a, b) that tie together the documents with enough collisions and sizes near enough, over all lists."""

    def tied(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        keys = table.column("cell").to_numpy()
        sigs = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        a, b = merged(keys, table.column("two").to_numpy(), table.column("block").to_numpy(), sigs, table.column("n_shingles").to_numpy(), percent, matches)
        docs = table.column("doc").to_numpy()
        ids, place = np.unique(docs, return_inverse=True)
        root = local_components(len(ids), place[a], place[b])
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None and held.num_rows else new
            if held.num_rows:
                keys = held.column("cell").to_numpy()
                last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])  # the last list may go on
                if last:
                    yield tied(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield tied(held)

    # a cell's number; two cells that fall together by chance only merge more
    rows = lists.select(F.xxhash64("post", "i", "j").alias("cell"), (F.col("i") != F.col("j")).alias("two"), "block", "doc", "n_shingles", "sig")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, over the values that more than one set has."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    times = np.diff(np.append(np.flatnonzero(first), len(values)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    common = np.repeat(times > 1, times)
    column, owner = column[common], owner[common]
    out = np.zeros((len(sets), (int(column.max(initial=0)) >> 6) + 1), np.uint64)
    np.bitwise_or.at(out, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def cell_links(docs: np.ndarray, sides: np.ndarray, labels: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together what is linked among the documents of a cell and isn't yet, by their labels.

    Documents meet where their sides differ, and those of side 0 each other too.
    """
    sizes, bits, label = np.array([len(s) for s in sets]), _bits(sets), np.unique(labels, return_inverse=True)[1]
    a, b = [], []
    for k in range(len(docs)):
        other = label != label[k]
        other[: k + 1] = False
        other &= (sides != sides[k]) | (sides[k] == 0)
        # sizes bound the similarity
        other &= (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
        rest = np.flatnonzero(other)
        rest = rest[(sigs[rest] == sigs[k]).sum(1) >= matches]
        if len(rest):
            both = np.bitwise_count(bits[rest] & bits[k]).sum(1, dtype=np.int64)
            linked = rest[100 * both >= percent * (sizes[rest] + sizes[k] - both)]
            tied, first = np.unique(label[linked], return_index=True)
            a += [docs[k]] * len(tied)
            b += docs[linked[first]].tolist()
            label[np.isin(label, tied)] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _with(rows: DataFrame, given: DataFrame, on: Column) -> DataFrame:
    """rows joined with the written table given: sent to all tasks where it has few rows, or else by a shuffle."""
    return rows.join(F.broadcast(given) if given.count() <= BROADCAST_ROWS else given, on)


def _sets(docs: DataFrame, member: DataFrame, width: int, repeats: bool) -> DataFrame:
    """doc and shingles of each member (doc, f1), written; of rows that repeat a doc_id one with the text that counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, sets.ends).astype(np.int32)), pa.array(sets.values.view(np.int64)))
            names = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            found = pa.RecordBatch.from_arrays([batch.column("doc"), lists], ["doc", "shingles"])
            yield found.filter(pc.equal(batch.column("f1"), pa.array(names)))

    found = _with(rows, member.select("doc", "f1"), F.col("doc_id") == F.col("doc")).select("doc", "text", "f1")
    found = found.mapInArrow(read, "doc bigint, shingles array<bigint>")
    return materialize(found.dropDuplicates(["doc"]) if repeats else found, "sets")


def _confirmed(sets: DataFrame, dealt: DataFrame, cells: Column, percent: int, coordinates: int, matches: int) -> DataFrame:
    """Links (a, b) within the cells that documents meet in.

    dealt: doc, component, label and what `cells` reads, an array of (i, j, side).
    """
    given = materialize(dealt.select(F.col("doc").alias("_doc"), "component", "label", cells.alias("cells")), "dealt")
    met = _with(sets, given, F.col("doc") == F.col("_doc")).select("doc", "component", "label", F.explode("cells").alias("c"), "shingles")

    def compare(table: pa.Table) -> pa.Table:
        flat = table.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(pc.list_value_length(table.column("shingles")).to_numpy())
        sigs = min_hashes(Sets(flat, ends), coordinates)
        a, b = cell_links(*(table.column(c).to_numpy() for c in ("doc", "side", "label")), sigs, np.split(flat, ends[:-1]), percent, matches)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = met.select("doc", "component", "label", "c.*", "shingles")
    return met.groupBy("component", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _parts(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK_DOCUMENTS, shingles / BLOCK_SHINGLES)).cast("int")


def _links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, percent: int, width: int, coordinates: int, matches: int, repeats: bool) -> DataFrame:
    """Links (a, b) that tie together what is linked within each component of candidates(node, component)."""
    member = classes.join(candidates, F.col("doc") == F.col("node")).select("doc", "component", "f1", "n_shingles")
    member = materialize(member, "members")
    n, total = F.count(F.lit(1)), F.sum("n_shingles")
    sized = materialize(member.groupBy("component").agg(_parts(n, total).alias("blocks")), "sized")
    dealt = member.join(sized, "component").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one, two = (F.lit(k) for k in range(3))
    # the first block meets every block
    every = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: cell(zero, j, F.when(j == 0, zero).otherwise(one)))
    first = F.when(F.col("block") == 0, every).otherwise(F.array(cell(zero, F.col("block"), zero)))
    sets = _sets(docs, member, width, repeats)
    link = lambda rows, how: materialize(_confirmed(sets, rows, how, percent, coordinates, matches), "links")
    links = link(dealt.withColumn("label", F.col("doc")), first)
    if sized.where("blocks > 1").isEmpty():
        return links

    # then all that isn't tied to a component's largest part meets all of it
    parts = connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("part"))
    open_ = dealt.where("blocks > 1").join(parts, "doc", "left").withColumn("label", F.coalesce("part", "doc")).drop("part")
    open_ = materialize(open_, "open")
    counts = materialize(open_.groupBy("component", "label").agg(n.alias("docs"), total.alias("n_shingles")), "parts")
    largest = counts.groupBy("component").agg(F.max_by("label", "docs").alias("largest"), F.max("docs").alias("of_largest"), F.sum("docs").alias("docs"), F.max_by("n_shingles", "docs").alias("s_largest"), F.sum("n_shingles").alias("s"))
    rest = largest.where("docs > of_largest").select("component", "largest", _parts(F.col("docs") - F.col("of_largest"), F.col("s") - F.col("s_largest")).alias("slices"))
    rows = open_.join(materialize(rest, "rest"), "component").withColumn("slice", F.pmod(F.xxhash64("doc", F.lit("slice")), "slices").cast("int"))
    as_all = F.transform(F.sequence(zero, F.col("slices") - 1), lambda i: cell(i, F.col("block"), two))
    as_rest = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: cell(F.col("slice"), j, one))
    return links.union(link(rows, F.when(F.col("label") == F.col("largest"), as_all).otherwise(F.concat(as_all, as_rest))))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text, ...).

    Linked are documents with 100 * intersection >= percent * union of their sets. component_id is the smallest doc_id
    reachable by links, itself included; kept is doc_id = component_id. Documents without words are linked with nothing.
    Rows that repeat a doc_id are one document, with the set of one of their texts; n_shingles is each row's own. A null
    doc_id has a null component and is kept. Other columns are not read.
    """
    signed = materialize(signatures(docs, width, coordinates), "signed")
    one = signed.where("sig is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n_shingles", "sig")).alias("s"))
    one = materialize(one.select("doc_id", "s.*"), "documents")
    classes = one.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    classes = materialize(classes, "classes")

    lists = _lists(classes, coordinates, matches)
    candidates = connected_components(_collisions(lists, percent, matches))
    repeats = signed.where("sig is not null and doc_id is not null").count() > one.count()
    links = _links(docs, classes, candidates, percent, width, coordinates, matches, repeats)

    final = connected_components(links)
    of_class = classes.join(final, F.col("doc") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "doc").alias("component_id"))
    of_doc = one.select("doc_id", "f1", "f2").join(materialize(of_class, "of-class"), ["f1", "f2"]).select(F.col("doc_id").alias("_id"), "component_id")
    out = signed.select("doc_id", "n_shingles").join(of_doc, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates among the rows of docs(doc_id, text, ...), with all its columns.

    Rows are compared, whether they repeat a doc_id, have another text under one, or have none. Of a group the row with the
    smallest doc_id stays, null last; of equal ids that with the least hash of its columns. Rows without words all stay.
    """
    # a doc_id of one row is that row's key, and its text is read where it lies; other rows get a key and are written, with a
    # chance of about n * m / 2^64 that one of n such keys is one of m ids
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 or doc_id is null")
    repeated = materialize(repeated.select(F.col("doc_id").alias("_id")), "repeated")
    hashed = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    same = docs["doc_id"].eqNullSafe(F.col("_id"))
    keyed = docs.select("*", hashed.alias("_tie")).join(repeated, same, "left_semi").withColumn("_row", F.xxhash64(F.lit("row"), F.monotonically_increasing_id()))
    single = docs.join(repeated, same, "left_anti").select("*", F.lit(0).cast("long").alias("_tie"), F.col("doc_id").cast("long").alias("_row"))
    rows = single.union(materialize(keyed, "rows"))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("_row"), "component_id")
    found = materialize(found, "found")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tie"), F.col("_row"))
    first = rows.select("_row", order.alias("first")).join(found, "_row").groupBy("component_id").agg(F.min("first").alias("first"))
    gone = materialize(found.select("_row").join(first.select("first._row"), "_row", "left_anti"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
