"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, linked groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import small_batches, text_of
from surtido.llm.components import array_components, components
from surtido.llm.wordspans import LOWER, chunks, find_words, string_buffers
from surtido.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
CELL = 20_000  # codes that one search compares with each other, about
BLOCK = 4      # codes under one lowest node of the index
FANOUT = 4     # nodes under one node above
PAIRS = 1 << 18  # pairs of nodes that are looked at together, about


def text_fingerprints(column: pa.ChunkedArray | pa.Array, shingle: int) -> np.ndarray:
    """The SimHash of each text: a bit is set if more than half of the shingles' hashes have it."""
    data, offsets = string_buffers(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for which, part, at in chunks(LOWER[data], offsets, 1 << 20):
        words = find_words(part, at)
        n = words.counts
        # words joined by one space: a word's place is its length and one, summed
        size = words.end - words.start
        place = np.r_[0, np.cumsum(size + 1)]
        joined = np.full(place[-1], 32, np.uint8)
        inner = np.repeat(words.start - place[:-1], size) + np.arange(size.sum()) \
            + np.repeat(np.arange(len(size)), size)
        joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = part[inner]
        text = joined.tobytes()
        shingles = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
        owner = np.repeat(np.arange(len(n)), shingles)
        head = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[:-1][owner]
        tail = np.minimum(head + shingle, words.first[1:][owner])
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in
                              zip(place[head].tolist(), (place[tail] - 1).tolist())), np.uint64, len(owner))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(shingles)
        if len(full):
            votes = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[full], axis=0, dtype=np.int32)
            won = votes * 2 > shingles[full][:, None]
            out[which.start + full] = np.packbits(won, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, body, fp): the SimHash of every row's text as a signed 64-bit number.

    A-Z are lower-cased; shingles are ``shingle`` words joined by a space, repeats
    included, the whole sequence if there are fewer words; no word gives 0. A shingle's
    hash is XXH64 with seed 42. ``body`` is the hash of the text as it is.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["body"],
                 pa.array(text_fingerprints(batch["text"], shingle).view(np.int64))],
                names=["doc_id", "body", "fp"])

    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
                     text_of().alias("text"))
    return rows.mapInArrow(each, "doc_id long, body long, fp long")


def _masks(max_bits: int) -> list[int]:
    """Masks of two parts each of the 64 bits cut into ``max_bits + 2`` runs of about equal length (signed).

    Codes within ``max_bits`` bits differ in that many runs at most, so they agree under one mask at least.
    """
    n = max_bits + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    runs = [((1 << (64 - a)) - 1) ^ ((1 << (64 - b)) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [runs[i] | runs[j] for i in range(n) for j in range(i)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def gray_rank(c: Column) -> Column:
    """The rank of a code in Gray order, shifted so that signed order is rank order."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def link_codes(codes: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect all codes ``fp`` within ``max_bits`` bits of each other.

    A hierarchical index in Gray order, in place of all pairs. The upper nodes are masked
    patterns that codes share: each mask has two of ``max_bits + 2`` parts of the bits (21 bits of 64 for four),
    and two codes within ``max_bits`` agree under one mask at least, so a code is filed under one node for each
    mask. A node holds few codes up to many millions of codes in all.
    Under a node codes are sorted by Gray rank and grouped into blocks and blocks
    of blocks; each holds the bits its codes share and their pattern. A pair of groups is
    dropped as a whole once the bits in which their shared patterns differ pass
    ``max_bits``; the bits shared by a group include those of the groups above, so
    differences accumulate downwards.

    Of the links found under one node only a spanning set is kept. A node with more than
    ``cell`` codes is cut into chunks, and each pair of chunks is searched by itself.
    """
    masks = _masks(max_bits)
    filed = codes.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "pattern"))
    large = (filed.groupBy("mask", "pattern").count().filter(F.col("count") > cell)
             .select("mask", "pattern", F.ceil(F.col("count") / cell).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = (
        filed.join(large, ["mask", "pattern"], "left").fillna(1, ["chunks"])
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("mask", "pattern", F.least("chunk", "other").alias("low"),
                F.greatest("chunk", "other").alias("high"), "fp", gray_rank(F.col("fp")).alias("rank")))
    key = ["mask", "pattern", "low", "high"]
    return (cells.repartition(*key).sortWithinPartitions(*key, "rank").select(*key, "fp")
            .mapInArrow(_searcher(max_bits), "a long, b long"))


def _searcher(max_bits: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = np.column_stack([batch[k].to_numpy().astype(np.int64) for k in ("mask", "pattern", "low", "high", "fp")])
            table = table if rest is None else np.concatenate([rest, table])
            edges = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
            if len(edges):
                yield from _links(table[:edges[-1], 4], np.r_[0, edges], max_bits)
                table = table[edges[-1]:]
            rest = table
        if rest is not None and len(rest):
            yield from _links(rest[:, 4], np.r_[0, len(rest)], max_bits)
    return search


def _links(codes: np.ndarray, edges: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    codes = np.ascontiguousarray(codes).view(np.uint64)
    a, b = [], []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high - low > 1:
            group = codes[low:high]
            label = linked_within(group, max_bits)
            moved = np.flatnonzero(label != np.arange(len(group)))
            if len(moved):
                a.append(group[moved])
                b.append(group[label[moved]])
    if a:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def linked_within(codes: np.ndarray, max_bits: int) -> np.ndarray:
    """For codes in Gray order, the smallest index that each reaches over close pairs."""
    n = len(codes)
    label = np.arange(n)
    levels = [_nodes(codes, codes, BLOCK)]
    while len(levels[-1][0]) > FANOUT:
        levels.append(_nodes(*levels[-1], FANOUT))
    full = np.r_[codes, np.zeros(-n % BLOCK, codes.dtype)].reshape(-1, BLOCK)
    real = (np.arange(full.size) < n).reshape(-1, BLOCK)
    stack = [(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))]
    while stack:
        level, a, b = stack.pop()
        heads = np.arange(0, n, BLOCK * FANOUT**level)
        low, high = np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])  # not of one group already
        near = apart & _near(levels[level], a, b, max_bits)
        a, b = a[near], b[near]
        if level:
            for part in range(0, len(a), PAIRS // FANOUT**2):
                some = slice(part, part + PAIRS // FANOUT**2)
                stack.append((level - 1, *_children(a[some], b[some], len(levels[level - 1][0]))))
            continue
        close = np.bitwise_count(full[a][:, :, None] ^ full[b][:, None, :]) <= max_bits
        pair, i, j = np.nonzero(close & real[a][:, :, None] & real[b][:, None, :])
        i, j = a[pair] * BLOCK + i, b[pair] * BLOCK + j
        new = label[i] != label[j]
        if new.any():
            label = array_components(n, label[i[new]], label[j[new]])[label]
    return label


def _near(nodes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether groups a and b may hold close codes: the bits that each shares differ in few places."""
    every, some = nodes
    shared = ~(every[a] ^ some[a]) & ~(every[b] ^ some[b])
    return np.bitwise_count((every[a] ^ every[b]) & shared) <= max_bits


def _nodes(every: np.ndarray, some: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that all, and that any, of each ``fanout`` neighbours have."""
    heads = np.arange(0, len(every), fanout)
    return np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the nodes under each pair, once each."""
    step = np.arange(FANOUT)
    x = (a[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
    y = (b[:, None, None] * FANOUT + step[None, None, :] + 0 * step[None, :, None]).ravel()
    fits = (x <= y) & (x < n) & (y < n)
    return x[fits], y[fits]


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, body, fp, component_id, root) of every row.

    Rows are linked if their fingerprints differ in ``max_bits`` bits or fewer;
    ``component_id`` is the smallest ``doc_id`` that a row reaches over links, its own
    included, and ``root`` the smallest fingerprint, which names a component also where ids repeat. Only distinct
    fingerprints are indexed, so copies of one text cost one
    code, however many there are. Texts without a word have fingerprint 0 and are linked
    like any other. A null ``doc_id`` is never a component's id unless all its rows have
    none (then null). Repeated rows stay, in one component. Very long texts are read in chunks. Empty table: empty.
    Other columns are ignored.

    Runs jobs when called: fingerprints are written once, then each round of the
    components.
    """
    prints = materialize(fingerprints(df, shingle), "fingerprints")
    roots = components(link_codes(prints.select("fp").distinct(), max_bits))
    owned = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        .join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "components")
    # Written, so that the join below reads both sides from a shuffle and a hot root can be split.
    ids = materialize(owned.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = owned.join(ids, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "body", "fp", "component_id", "root")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
