"""Substring dedup: passages that an earlier document has already, by Rabin-Karp window hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import text_of
from surtido.llm.wordspans import (
    chunks, covered, find_words, mix, string_buffers, windows, word_hashes,
)
from surtido.operators.ordered import running_totals
from surtido.session import default_parallelism

WINDOW = 13
SLICE_BYTES = 5 << 20       # text of one slice of documents
LEAST_SLICE = 1 << 20       # text of a slice of a small table
BUCKET_WINDOWS = 2_000_000  # window hashes of one counting bucket, about

PACKED = "bucket int, slice int, rank int, width int, hashes binary"
CLEANED = ("doc_id long, text string, n_words long, n_removed long, "
           "removed array<struct<start:int,end:int>>")


def pack(sorted_hashes: np.ndarray) -> tuple[int, bytes]:
    """Sorted hashes as differences of as few bytes each as the largest needs."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    first, rest = steps[:1], steps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    return width, first.tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(width: int, packed: bytes) -> np.ndarray:
    first = np.frombuffer(packed[:8], "<u8")
    short = np.frombuffer(packed, np.uint8, offset=8).reshape(-1, width)
    rest = np.zeros((len(short), 8), np.uint8)
    rest[:, :width] = short
    return np.cumsum(np.concatenate([first, rest.reshape(-1).view("<u8")]), dtype=np.uint64)


def text_windows(column: pa.ChunkedArray, size: int) -> Iterator[tuple]:
    """(which texts, their words, first words of windows, hashes of windows), in bounded chunks."""
    data, offsets = string_buffers(column)
    for which, part, at in chunks(data, offsets):
        words = find_words(part, at)
        yield which, words, *windows(word_hashes(words), words.first, size)


class Cuts(NamedTuple):
    """Units of neighbouring ids, in order: their first id, first slice, and number of slices."""
    first: np.ndarray
    slice: np.ndarray
    parts: np.ndarray


def cut_ids(docs: DataFrame, slice_bytes: int) -> tuple[Cuts, int, int]:
    """(units, number of slices, all text bytes).

    Ids are cut by prefix sums of their text bytes, so a unit has at most twice ``slice_bytes``. An id
    with more than ``slice_bytes`` is a unit of its own and has several slices. What comes to the
    driver is a row a unit, about one for ``slice_bytes`` of text.
    """
    sized = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    placed = running_totals(sized.filter("doc_id IS NOT NULL"), [F.asc("doc_id")], {"upto": F.col("bytes")})
    large = F.col("bytes") > slice_bytes
    units = (placed.groupBy(F.floor((F.col("upto") - F.col("bytes")) / slice_bytes).alias("at"), large.alias("large"))
             .agg(F.min("doc_id").alias("first"), F.sum("bytes").alias("bytes")).orderBy("first").toArrow())
    size = units["bytes"].to_numpy()
    parts = np.where(units["large"].to_numpy(zero_copy_only=False).astype(bool), -(-size // slice_bytes), 1).astype(np.int64)
    cuts = Cuts(units["first"].to_numpy(), np.cumsum(parts) - parts, parts)
    return cuts, int(parts.sum()), int(size.sum())


def _sliced(docs: DataFrame, slice_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, text, slice, rank) of every row, number of slices with an id, all text bytes.

    ``rank`` is the unit's first slice: slices of one unit are not earlier than each other. Rows without an id go
    to slices behind the others, as many as there are.
    """
    spark = docs.sparkSession
    whole = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # No smaller slices than LEAST_SLICE, and on a small table no fewer than there are tasks.
    slice_bytes = max(1, min(slice_bytes, max(LEAST_SLICE, -(-whole // default_parallelism(spark)))))
    cuts, slices, _ = cut_ids(docs, slice_bytes)
    sent = spark.sparkContext.broadcast(cuts)
    spread = max(1, slices)

    @F.pandas_udf("slice int, rank int")
    def place(ids: pd.Series, has_id: pd.Series, rows: pd.Series) -> pd.DataFrame:
        units, known = sent.value, has_id.to_numpy().astype(bool)
        row = mix(rows.to_numpy().astype(np.uint64))
        out = np.full((len(ids), 2), slices, np.int64)
        out[:, 0] += (row % np.uint64(spread)).astype(np.int64)
        if known.any():
            unit = np.searchsorted(units.first, ids.to_numpy()[known], "right") - 1
            out[known, 1] = units.slice[unit]
            out[known, 0] = units.slice[unit] + (row[known] % units.parts[unit].astype(np.uint64)).astype(np.int64)
        return pd.DataFrame(out.astype(np.int32), columns=["slice", "rank"])

    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.withColumn("_at", place(  # no null among the ids, which would make them floats
        F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "_row"))
    return placed.select("doc_id", "text", "_at.slice", "_at.rank"), slices, whole


def _packer(size: int, buckets: int, slices: int):
    """The windows of one slice: distinct hashes, packed by bucket."""
    def emit(key: tuple, docs: pa.Table) -> pa.Table:
        part, rank = key[0].as_py(), docs["rank"][0].as_py()
        found = [h for *_, h in text_windows(docs["text"], size)] if part < slices else []
        hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, part, rank, *pack(hashes[edges[b]:edges[b + 1]]))
                for b in np.flatnonzero(np.diff(edges)).tolist()]
        cols = list(zip(*rows)) or [[], [], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "slice": pa.array(cols[1], pa.int32()),
                         "rank": pa.array(cols[2], pa.int32()), "width": pa.array(cols[3], pa.int32()),
                         "hashes": pa.array(cols[4], pa.binary())})
    return emit


def _repeats(bucket: pa.Table) -> pa.Table:
    """Hashes of one bucket that a slice of a lower rank holds too, packed by the higher slice."""
    bucket = bucket.sort_by([("rank", "ascending"), ("slice", "ascending")])
    held = [unpack(w, p) for w, p in zip(bucket["width"].to_pylist(), bucket["hashes"].to_pylist())]
    hashes = np.concatenate(held)
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    order = np.argsort(hashes, kind="stable")  # a merge of sorted runs; ties stay in order of rank
    hashes, row = hashes[order], row[order]
    rank = bucket["rank"].to_numpy()[row]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    again = rank > rank[new][np.cumsum(new) - 1]
    hashes, owner = hashes[again], bucket["slice"].to_numpy()[row[again]]
    rows = [(int(p), *pack(hashes[owner == p])) for p in np.unique(owner)]
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"slice": pa.array(cols[0], pa.int32()), "width": pa.array(cols[1], pa.int32()),
                     "hashes": pa.array(cols[2], pa.binary())})


def _cleaner(size: int, slices: int):
    """The texts of one slice less their repeated windows."""
    def clean(key: tuple, docs: pa.Table, seen: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc_id")
        ids = docs["doc_id"].to_numpy(zero_copy_only=False)
        plain = key[0].as_py() >= slices  # no ids: nothing is earlier
        before = [unpack(w, p) for w, p in zip(seen["width"].to_pylist(), seen["hashes"].to_pylist())]
        before = np.sort(np.concatenate(before)) if before else np.zeros(0, np.uint64)
        parts = list(text_windows(docs["text"], size))
        at = [a for _, _, a, _ in parts]
        hashes = np.concatenate([h for *_, h in parts]) if parts else np.zeros(0, np.uint64)
        if plain or not len(hashes):
            repeated = np.zeros(len(hashes), bool)
        else:
            place = np.minimum(np.searchsorted(before, hashes), max(0, len(before) - 1))
            repeated = before[place] == hashes if len(before) else np.zeros(len(hashes), bool)
            owner = np.concatenate([ids[w][d.text[a]] for w, d, a, _ in parts])
            order = np.argsort(hashes, kind="stable")  # documents are in order, so the first is the least
            new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
            least = owner[order][new][np.cumsum(new) - 1]
            repeated[order] |= owner[order] > least
        out, done = [], 0
        for (which, words, _, _), starts in zip(parts, at):
            gone = covered(starts[repeated[done:done + len(starts)]], size, len(words.start))
            done += len(starts)
            out.append(_without(docs.slice(which.start, which.stop - which.start), words, gone))
        return pa.concat_tables(out) if out else _EMPTY
    return clean


def _without(docs: pa.Table, words, gone: np.ndarray) -> pa.Table:
    """Texts of the words that stay, joined by one space, and the intervals of those that go."""
    n = len(words.offsets) - 1
    kept = np.flatnonzero(~gone)
    owner = words.text
    start, end = words.start[kept], words.end[kept]
    inner = np.zeros(len(kept), bool)  # whether another kept word of the text follows
    inner[:-1] = owner[kept][1:] == owner[kept][:-1]
    data = words.data.copy()
    data[end[inner]] = 32
    steps = np.zeros(len(data) + 2, np.int8)
    steps[start] += 1
    steps[end + inner] -= 1  # a word and the one blank behind it; neighbours may touch
    keep = np.cumsum(steps[:len(data)], dtype=np.int8) > 0
    length = np.bincount(owner[kept], weights=end - start + inner, minlength=n).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(
        n, pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
    first = words.first[:-1]
    goes = gone.astype(np.int8)
    opens = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (owner[1:] == owner[:-1])][:len(gone)])
    closes = np.flatnonzero(gone & ~np.r_[gone[1:] & (owner[1:] == owner[:-1]), False][:len(gone)])
    spans = pa.StructArray.from_arrays(
        [pa.array(opens - first[owner[opens]], pa.int32()),
         pa.array(closes + 1 - first[owner[closes]], pa.int32())], ["start", "end"])
    per_text = np.r_[0, np.cumsum(np.bincount(owner[opens], minlength=n))]
    return pa.table({
        "doc_id": docs["doc_id"], "text": texts.cast(pa.string()),
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(np.bincount(owner, weights=goes, minlength=n).astype(np.int64)),
        "removed": pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), spans)})


_EMPTY = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]).empty_table()


def dedup_substrings(df: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
                     bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, text, n_words, n_removed, removed) of every row: texts less repeated passages.

    A word goes if it lies in a window of ``window`` words that also starts in a document
    with a smaller ``doc_id``; ``removed`` has the maximal intervals of such words (word
    positions, end excluded), ``text`` the words that stay, joined by one space. Words are
    runs of other bytes than space, tab, line feed, vertical tab, form feed and carriage
    return, unchanged. All windows are judged on the input.

    Every window's 64-bit hash is counted: documents are cut into slices by ranges of
    their id, of about equal bytes; a slice sends its distinct hashes, packed by bucket of the hash, about six
    bytes a window; a bucket returns to each slice the hashes that a lower slice holds;
    a slice compares its own documents itself. No task holds more than two slices' text, one row more, or
    a bucket's hashes, whatever a passage's number of copies, since a slice sends it once, and
    whatever an id's number of rows, since a large id has slices of its own.
    Two different windows share a hash with a chance of 2^-64.

    Null or empty text, or one shorter than a window: all words stay. Rows with the same
    ``doc_id`` do not count as earlier than each other. A null ``doc_id`` is neither
    earlier nor later than any: its text stays. Very long texts are read in chunks. Empty table: empty. Extra columns are
    ignored. Runs jobs when called (text bytes by id, and their prefix sums).
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    docs, slices, size = _sliced(docs, slice_bytes)
    buckets = max(1, math.ceil(size / 6 / bucket_windows))
    packed = docs.groupBy("slice").applyInArrow(_packer(window, buckets, slices), PACKED)
    seen = packed.groupBy("bucket").applyInArrow(_repeats, "slice int, width int, hashes binary")
    return (docs.groupBy("slice").cogroup(seen.groupBy("slice"))
            .applyInArrow(_cleaner(window, slices), CLEANED))
