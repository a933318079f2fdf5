"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import lower_ascii, others
from surtido.llm.labelled_urls import labelled_urls
from surtido.llm.wordspans import chunks, mix, string_buffers


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The production rules
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

DIMENSIONS = 1 << 18
SIZES = (3, 4, 5)
ROUNDS, RATE, L2 = 1000, 4.0, 1e-5


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...], give) -> Column:
    """``give`` of the longest rule that fits host (or a parent of it) and path; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(give(rule))).otherwise(found)
    return found


def ngrams(hosts: pa.Array, paths: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value): bytes of host and of path in runs of 3 to 5, hashed apart.

    Either has its ends marked; a row's values have length 1.
    """
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for part, column in enumerate((hosts, paths)):
        data, offsets = string_buffers(column)
        n = len(offsets) - 1
        marked = np.full(len(data) + 2 * n, 1 + part, np.uint8)  # one mark before, one behind
        row = np.repeat(np.arange(n), np.diff(offsets))
        marked[np.arange(len(data)) + 2 * row + 1] = data
        owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
        code = np.zeros(len(marked), np.uint64)
        for size in range(1, max(SIZES) + 1):
            if len(marked) < size:
                break
            code = (code[:len(marked) - size + 1] << np.uint64(8)) | marked[size - 1:]
            if size in SIZES:
                whole = owner[:len(code)] == owner[size - 1:]
                rows.append(owner[:len(code)][whole])
                keys.append(mix(code[whole] + np.uint64((part + 1) << 56) + np.uint64(size << 48)))
    row = np.concatenate(rows)
    cell = row * dimensions + (np.concatenate(keys) % np.uint64(dimensions)).astype(np.int64)
    cell = np.unique(cell)
    row, index = cell // dimensions, cell % dimensions
    count = np.bincount(row, minlength=len(hosts))
    return row, index, 1 / np.sqrt(count[row])


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, for the small table."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:].partition("#")[0].partition("?")[0]
    return rest[:cut].lower(), path


def fit(labelled: list[tuple[str, int]], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the bias) by gradient descent over the small table, on the driver."""
    hosts, paths = zip(*(split_url(u) for u, _ in labelled))
    row, index, value = ngrams(pa.array(hosts, pa.string()), pa.array(paths, pa.string()), dimensions)
    label = np.array([y for _, y in labelled], float)
    w = np.zeros(dimensions + 1)
    for _ in range(rounds):
        dot = np.bincount(row, weights=w[index] * value, minlength=len(label)) + w[-1]
        error = 1 / (1 + np.exp(-dot)) - label
        step = np.append(np.bincount(index, weights=error[row] * value, minlength=dimensions), error.sum())
        w -= RATE * (step / len(label) + L2 * w)
    return w


def filter_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES,
                labelled: list[tuple[str, int]] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``df`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    The longest rule that fits decides; without one, the model does: block if its score,
    the probability of a URL to block, is 0.5 or more. The model is fitted on ``labelled``,
    a small table of URLs (default: ``labelled_urls``), and has a fixed size.

    Null URL or one without ``://``: empty host and path, no rule, the model's verdict on
    nothing. Very long URLs: whole. Ties of rules' lengths: the later in text order. Repeated rows: the same
    verdict. Empty table: empty. Other columns stay; input columns with the names of the
    made ones are replaced. All of it is one pass without a shuffle.
    """
    weights = df.sparkSession.sparkContext.broadcast(fit(labelled or labelled_urls(), dimensions))
    rest = df.select(*others(df, "host", "path", "rule", "score", "verdict"),
                     host_of().alias("host"), path_of().alias("path"))
    names = rest.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            data, offsets = string_buffers(batch["url"])
            for which, _, _ in chunks(data, offsets):
                some = batch.slice(which.start, which.stop - which.start)
                row, index, value = ngrams(some["host"], some["path"], dimensions)
                dot = np.bincount(row, weights=weights.value[index] * value, minlength=some.num_rows)
                out.append(1 / (1 + np.exp(-dot - weights.value[-1])))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(np.concatenate(out))], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", score double"
    host, path = F.col("host"), F.col("path")
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rest.mapInArrow(score, schema).withColumn(
        "rule", matched(host, path, rules, lambda r: r.host + r.path)).withColumn(
        "verdict", F.coalesce(matched(host, path, rules, lambda r: r.verdict), by_model))
