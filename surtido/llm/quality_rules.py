"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio of target to corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import others, small_batches, text_of
from surtido.llm.wordspans import (
    Words, chunks, covered, find_words, mix, span_hashes, string_buffers, sums_by_text, windows,
    word_hashes,
)
from surtido.session import materialize

BUCKETS = 1 << 18
PSEUDO_COUNT = 30.0      # corpus n-grams added to each bucket
SENT_WORDS = 1_000_000   # words of 64 ids each, of the labelled target, that are sent to all tasks
THRESHOLD = -0.2         # log ratio an n-gram; below it a document goes
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True  # fixed values: the symbols counted

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "score double")


def ngram_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of neighbouring words, A-Z lower-cased."""
    hashes = word_hashes(words, lower=True)
    at, pairs = windows(hashes, words.first, 2)
    text = words.text
    bucket = np.concatenate([hashes, pairs]) % np.uint64(buckets)
    return bucket.astype(np.int64), np.concatenate([text, text[at]])


def repeated_words(words: Words, size: int) -> np.ndarray:
    """How many words of each text lie in windows of ``size`` words that it has twice or more."""
    at, hashes = windows(word_hashes(words), words.first, size)
    owner = words.text[at] if len(at) else at
    keys = mix(hashes ^ mix(owner.astype(np.uint64)))  # equal windows of other texts differ
    _, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    within = covered(at[counts[index] > 1], size, len(words.start))
    return sums_by_text(within, words.first)


def duplicate_lines(words: Words) -> np.ndarray:
    """How many lines of each text have a word and equal an earlier line of the text."""
    data, offsets = words.data, words.offsets
    ends = np.flatnonzero(data == 10)
    head = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], ends + 1])
    head = head[head < len(data)]
    owner = np.searchsorted(offsets, head, "right") - 1
    stop = np.minimum(np.r_[ends, len(data)][np.searchsorted(ends, head)], offsets[owner + 1])
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, head)
    head, stop, owner = head[has_word], stop[has_word], owner[has_word]
    keys = mix(span_hashes(data, head, stop) ^ mix(owner.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return np.bincount(owner[later], minlength=len(offsets) - 1)


def text_stats(words: Words) -> dict[str, np.ndarray]:
    """The counts that the rules use, for each text."""
    letters = (words.data & 0xC0) != 0x80
    solid = letters & ~np.isin(words.data, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    return {
        "n_words": words.counts,
        "word_chars": sums_by_text(solid, words.offsets),
        "n_symbols": sums_by_text(SYMBOL[words.data], words.offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated_words(words, REPEAT_WINDOW),
    }


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, n_target): n-grams of all texts, and of those with ``is_target``.

    A task adds up its own counts first, so at most ``buckets`` rows leave it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = batch["is_target"].to_numpy(zero_copy_only=False).astype(bool)
            for which, data, offsets in chunks(*string_buffers(batch["text"])):
                bucket, text = ngram_buckets(find_words(data, offsets), buckets)
                total += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[which][text]], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full]), pa.array(target[full])],
                                         names=["bucket", "n", "n_target"])

    counted = docs.select(text_of().alias("text"), "is_target").mapInArrow(
        count, "bucket long, n long, n_target long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def mark_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, is_target): whether a document is labelled as of good quality and not as toxic.

    The target's ids are kept as bits, 64 ids a word. Up to ``SENT_WORDS`` words are sent to all
    tasks, and no text is shuffled; beyond, the optimizer joins documents and words by size.
    """
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    bit = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    words = materialize(
        good.select(F.shiftright("doc_id", 6).alias("_word"), bit).groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), "target")
    if words.count() <= SENT_WORDS:
        words = F.broadcast(words)
    own = F.shiftright("doc_id", 6)
    return docs.select("doc_id", "text").join(words, own == F.col("_word"), "left").select(
        "text", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)).alias("is_target"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
               pseudo_count: float = PSEUDO_COUNT) -> np.ndarray:
    """log(target probability / corpus probability) of each n-gram bucket.

    Both multinomials get ``pseudo_count`` n-grams a bucket, in the target as many as fit
    its share of the corpus, so a rare n-gram's ratio is near 0 at any corpus size.
    Without a target document all ratios are 0. The driver gets ``buckets`` rows,
    whatever the corpus.
    """
    found = ngram_counts(mark_target(docs, labels), buckets).toArrow()
    n, target = np.zeros(buckets), np.zeros(buckets)
    where = found["bucket"].to_numpy()
    n[where], target[where] = found["n"].to_numpy(), found["n_target"].to_numpy()
    if not target.any():
        return np.zeros(buckets)
    share = target.sum() / n.sum()
    return np.log(target / share + pseudo_count) - np.log(n + pseudo_count)


def judge(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
          pseudo_count: float = PSEUDO_COUNT) -> DataFrame:
    """The rows of ``df`` with the counts of the rules, ``score``, ``base_failed`` and ``kept``.

    ``score`` is the mean, over a text's words and pairs of words, of the log ratio of
    their hashed n-gram's probability in a trusted target to that in the whole corpus.
    The target are all rows labelled as of good quality and not as toxic; the corpus
    counts cover every row of ``df``. A document is kept
    if the base rules pass and ``score >= threshold``: no randomness, the same at any size.

    Base rules: fewer than 10 words fail; more than 20 % of the words in 5-word windows
    that the text has twice or more fail.

    Null or empty text: counts and score 0, base fails. Very long texts: whole, in chunks. A score just
    at ``threshold``: kept. Repeated rows get the same verdict. No labels: every score is 0. Empty table: empty. Other columns stay; input
    columns with the names of the made ones are replaced. Runs jobs when called: the target's ids are written, n-grams counted.
    """
    spark = df.sparkSession
    small_batches(spark)
    ratios = spark.sparkContext.broadcast(log_ratios(df, labels, buckets, pseudo_count))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    rows = df.select(*others(df, *made, "base_failed", "kept"))
    names = rows.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: [] for name in made}
            for _, data, offsets in chunks(*string_buffers(batch["text"])):
                words = find_words(data, offsets)
                bucket, text = ngram_buckets(words, buckets)
                n = len(offsets) - 1
                total = np.bincount(text, weights=ratios.value[bucket], minlength=n)
                for name, values in text_stats(words).items():
                    columns[name].append(values.astype(np.int64))
                columns["score"].append(total / np.maximum(1, np.bincount(text, minlength=n)))
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names]
                + [pa.array(np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64))
                   for c, v in columns.items()], names=names + made)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + STATS
    judged = rows.mapInArrow(score, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))
