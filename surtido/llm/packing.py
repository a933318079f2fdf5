"""Packing: documents as token pieces in sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surtido.llm.columns import small_batches, text_of
from surtido.operators.ordered import slices_for
from surtido.session import default_parallelism, materialize

LENGTH = 2048
END_ID = 1
MEMO_WORDS = 400_000  # words whose ids a worker remembers, about 80 MB
TEXTS_AT_ONCE = 512

MARKS = ",.;:!?"
APART = b""  # no ids: white space beside a split, so the text is encoded as it is
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers, with a memory of words.

    A single space or line feed between two characters that are no white space always
    parts words of the byte-level pattern: a space goes to the word behind it, a line feed
    is a word of its own. So the ids of a text are the ids of its parts, end to end. Every
    distinct part is encoded once, by the tokenizer itself; a mark behind a letter is a
    word of its own too, so ``word,`` and ``word.`` cost ``word`` once.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.memo_words = memo_words
        self.first: dict[str, bytes] = {}  # parts that begin a line
        self.later: dict[str, bytes] = {}  # parts behind a space
        self.line_feed, *marks = self._ids(["\n", *MARKS])
        self.marks = dict(zip(MARKS, marks))

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, words, ends, lines = [], [], [], []  # of lines, of all, behind each line, of texts
        for text in texts:
            split = text.split("\n")
            lines.append(len(split))
            for line in split:
                parts = line.split(" ")
                heads.append(parts.pop(0))
                words += parts
                ends.append(len(words))
        first, later = self._known(self.first, heads, ""), self._known(self.later, words, " ")
        out, line, at = [], 0, 0
        for text, n in zip(texts, lines):
            parts = []
            for line in range(line, line + n):
                parts.append(first[line])
                parts += later[at:ends[line]]
                parts.append(self.line_feed)
                at = ends[line]
            line += 1
            parts.pop()
            out.append(self._ids([text])[0] if APART in parts else b"".join(parts))
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _known(self, memo: dict[str, bytes], words: list[str], before: str) -> list[bytes]:
        """The ids of each part. New parts are remembered while there is room: those that come
        first are the frequent ones, so a full memo keeps them and learns the rest for the call."""
        found = list(map(memo.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        learnt = self._learn(memo, {words[i] for i in gaps}, before)
        for i in gaps:
            found[i] = learnt[words[i]]
        if len(memo) < self.memo_words:
            memo.update(learnt)
        return found

    def _learn(self, memo: dict[str, bytes], new: set[str], before: str) -> dict[str, bytes]:
        """The ids of new parts; ``APART`` for those with white space at an end."""
        safe = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        marked = [w for w in safe if w[-1] in self.marks and w[:-1][-1:].isalpha()]
        bare = list({w[:-1] for w in marked}.difference(memo).union(safe).difference(marked))
        learnt = dict.fromkeys(new, APART)
        learnt.update(zip(bare, self._ids([before + w for w in bare])))
        for w in marked:
            ids = learnt.get(w[:-1]) or memo[w[:-1]]
            learnt[w] = ids + self.marks[w[-1]]
        return learnt


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, memo_words: int) -> Encoder:
    """One encoder a worker: its memory serves later batches and tasks."""
    key = path, memo_words
    if key not in _encoders:
        _encoders[key] = Encoder(path, memo_words)
    return _encoders[key]


def token_pieces(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID,
                 with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents cut every ``length`` ids.

    A document's ids are those of its whole text (null: none) and ``end_id``.
    ``tokenizer`` is the path of the tokenizer's file, the same on every executor.
    """
    step = 4 * length
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, memo_words)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                rows = []
                for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                    ids += end
                    for a in range(0, len(ids), step):
                        piece = ids[a:a + step]
                        rows.append((doc, a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(cols[2])], pa.int32()),
                        pa.array(np.frombuffer(b"".join(cols[5]), "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECE + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    small_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return docs.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths of a pack, number of such packs): longest lengths first, each to the shortest pack.

    Works on counts alone: all pieces of a length are placed in a few steps, each of which
    gives as many as fit to the packs with the most room, so time and memory depend on
    ``length``, not on the number of pieces.
    """
    packs: dict[int, list[tuple[list[int], int]]] = {}  # by room left

    def put(lengths: list[int], count: int) -> None:
        packs.setdefault(length - sum(lengths), []).append((lengths, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r in packs if r >= size), default=None)
            if room is None:
                fresh = min(left, -(-left // max(1, length // size)))  # as many as then fit
                put([], fresh)
                continue
            lengths, count = packs[room].pop()
            if not packs[room]:
                del packs[room]
            used = min(left, count)
            if count > used:
                put(lengths, count - used)
            put([*lengths, size], used)
            left -= used
    return [p for room in packs.values() for p in room]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): places by rank within a length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for size in lengths:
            rank = used.get(size, 0)
            out.append((size, rank, rank + count, sequence, offset))
            used[size] = rank + count
            offset += size
        sequence += count
    return out


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (each no longer than ``length``) with ``sequence_id`` and ``offset``.

    The driver gets one count for each length, at most ``length`` of them, and makes the
    packing patterns from these. Their places are joined back by length and rank. Ranks
    are global: pieces are numbered within (part, length), where parts are hashed from
    the piece, and the counts of earlier parts are added, so a length that most pieces
    have is numbered in as many tasks as any.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    written = materialize(pieces, "pieces")
    tasks = default_parallelism(spark)
    parts = max(tasks, slices_for(written.count(), tasks))  # more of them for more pieces
    stored = written.withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = stored.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r.length: r.n for r in
                 counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = spark.createDataFrame(
        slots(shortest_pack_first(histogram, length)),
        "length long, _from long, _to long, _sequence long, offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = (stored.withColumn("_nth", F.row_number().over(within)).join(starts, ["_part", "length"])
              .withColumn("_rank", F.col("_before") + F.col("_nth") - 1))
    return (ranked.join(F.broadcast(places), "length").filter("_rank >= _from AND _rank < _to")
            .withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
            .select(*names, "sequence_id", "offset"))


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    Every document is tokenized whole, closed by ``end_id`` and cut every ``length`` ids;
    the pieces fill sequences of at most ``length`` ids, numbered from 0, without gaps.
    Null or empty text: the one id ``end_id``. Very long texts: as many pieces as they fill. Repeated rows are
    packed as often as they come, equal pieces in either order. Null ``doc_id``: packed like any other. Empty table:
    empty. Extra columns are ignored. Runs one job when called; the pieces are written once (the ids only
    ``with_ids``). ``memo_words`` trades memory of the workers for time; results do not change.
    """
    return pack_pieces(token_pieces(df, tokenizer, length, end_id, with_ids, memo_words), length)


def sequence_rows(packed: DataFrame, length: int = LENGTH, pad_id: int = 0, pad_powers: bool = True) -> DataFrame:
    """(sequence_id, ids, doc_ids): one row a sequence, padded to ``length``; needs the ids.

    Without ``pad_powers`` a sequence whose ids are a power of two in number stays as it is.
    A group is one sequence, so it never holds more than ``length`` ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("pieces"))
    ids = F.flatten(F.transform("pieces", lambda p: p["ids"]))
    spared = F.lit(not pad_powers) & (F.bit_count(F.size(ids)) == 1)
    padding = F.array_repeat(F.lit(pad_id), F.when(spared, 0).otherwise(F.lit(length) - F.size(ids)))
    return rows.select("sequence_id", F.concat(ids, padding).alias("ids"),
                       F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"))
