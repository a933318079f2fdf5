"""Quality classifier: hashed word n-grams, logistic regression by follow the regularised leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import others, small_batches, text_of
from surtido.llm.wordspans import (
    Words, chunks, find_words, mix, span_hashes, string_buffers, windows, word_hashes,
)

DIMENSIONS = 1 << 18
FIT_ROWS = 8_000    # bound on the labelled rows that the model is fitted on
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.001, 0.001
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3

# A byte's kind: letters of either case and digits each fall together, the rest stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123] = ord("a")
KIND[128:] = ord("a")
KIND[65:91] = ord("A")
KIND[48:58] = ord("0")


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: its kinds of bytes, runs taken together, and whether it repeats."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    kind = KIND[words.data]
    keep = np.r_[True, kind[1:] != kind[:-1]]
    keep[words.start] = True
    place = np.r_[0, np.cumsum(keep)]
    shape = span_hashes(kind[keep], place[words.start], place[words.end])
    same = word_hashes(words, lower=True)
    text = words.text
    again = np.r_[False, (same[1:] == same[:-1]) & (text[1:] == text[:-1])]
    return mix(shape + again.astype(np.uint64))


def features(words: Words, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index, value): words, word shapes, and neighbouring pairs of both, hashed.

    A value is the square root of the share that the n-gram has in its text's n-grams, so
    every text that is not empty has length 1, however long it is.
    """
    texts, keys = [], []
    for salt, hashes in enumerate((word_hashes(words, lower=True), shapes(words))):
        at, pairs = windows(hashes, words.first, 2)
        texts += [words.text, words.text[at]]
        keys += [mix(hashes + np.uint64(2 * salt)), mix(pairs + np.uint64(2 * salt + 1))]
    text, index = np.concatenate(texts), np.concatenate(keys) % np.uint64(dimensions)
    cell = text.astype(np.int64) * dimensions + index.astype(np.int64)
    cell, count = np.unique(cell, return_counts=True)
    text, index = cell // dimensions, cell % dimensions
    total = np.bincount(text, weights=count, minlength=len(words.offsets) - 1)
    return text, index, np.sqrt(count / total[text])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int, epochs: int = EPOCHS,
         alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (the last is the bias) by FTRL-proximal with a learning rate for each coordinate.

    (McMahan et al., 2013.) ``rows`` are (indices, values, label) and are taken in order.
    """
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            at, x = np.append(index, dimensions), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def fit_rows(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label): labelled rows outside the held-out fold; at most ``rows``, by hash of the id.

    Several labels for one id: the lowest counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                          & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
    return (known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def fit(df: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, dimensions: int = DIMENSIONS,
        epochs: int = EPOCHS) -> np.ndarray:
    """The model's weights. Features are made where the texts are; one task updates the weights.

    That task gets ``rows`` feature vectors at most, in order of the id's hash, and the
    driver gets the weights that are not 0.
    """
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for _, data, offsets in chunks(*string_buffers(batch["text"])):
                text, i, v = features(find_words(data, offsets), dimensions)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    index.append(i[a:b].astype("<i4").tobytes())
                    value.append(v[a:b].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                names=["doc_id", "label", "index", "value"])

    def learn(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(mix(group["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
        table = group.take(pa.array(order))
        examples = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), label) for i, v, label in zip(
            table["index"].to_pylist(), table["value"].to_pylist(), table["label"].to_pylist())]
        weights = ftrl(examples, dimensions, epochs)
        full = np.flatnonzero(weights)
        return pa.table({"at": pa.array(full), "weight": pa.array(weights[full])})

    chosen = F.broadcast(fit_rows(labels, rows))
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = texts.join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(
        vectors, "doc_id long, label int, index binary, value binary")
    found = sample.groupBy(F.lit(1).alias("model")).applyInArrow(learn, "at long, weight double").toArrow()
    weights = np.zeros(dimensions + 1)
    weights[found["at"].to_numpy()] = found["weight"].to_numpy()
    return weights


def classify(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS,
             dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Learns ``labels.quality`` from the whole texts of at most ``rows`` labelled documents
    outside the held-out fold; scores every row by a sparse dot product with the weights,
    which have a fixed size. Only the text enters a score.

    Null or empty text: the bias alone. Very long texts: whole, in chunks. A score just at ``threshold``:
    predicted. Repeated rows: the same score; in the sample, each counts. No labels: every score is 0.5. Null ``doc_id``: scored, held out. Empty table:
    empty. Other columns stay; input columns with the names of the made ones are replaced.
    Runs one job when called.
    """
    small_batches(df.sparkSession)
    weights = df.sparkSession.sparkContext.broadcast(fit(df, labels, rows, dimensions, epochs))
    rest = df.select(*others(df, "held_out", "score", "predicted"))
    names = rest.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in chunks(*string_buffers(batch["text"])):
                text, index, value = features(find_words(data, offsets), dimensions)
                dot = np.bincount(text, weights=weights.value[index] * value, minlength=len(offsets) - 1)
                out.append(1 / (1 + np.exp(-np.clip(dot + weights.value[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(np.concatenate(out) if out else np.zeros(0))],
                names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", score double"
    return rest.mapInArrow(score, schema).withColumn(
        "held_out", fold(F.col("doc_id")) == HELD_OUT_FOLD).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
