"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds, then reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.vectors import dimension, is_finite, matrix
from surtido.session import default_parallelism, materialize

NEAREST = 5
CODE_BITS = 256        # of a code at least; more bits than dimensions make closer estimates
BOUND = 3.0            # standard errors that an estimate is taken to be off at most
QUERY_BITS = 4         # of each rotated coordinate of a query
BLOCK_ROWS = 32_768    # codes that one task holds at a time, at most
BLOCK_MB = 32          # of their vectors, at most
LEAST_ROWS = 1_024     # of a block of a small table
SEED = 12

INDEX = "row long, id long, block int, code binary, aligned double, vector array<double>"


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """``dim`` random orthonormal directions in ``bits`` dimensions, in rows."""
    normal = np.random.default_rng(seed).standard_normal((bits, dim))
    q, r = np.linalg.qr(normal)
    return (q * np.sign(np.diag(r))).T


def code_bits(dim: int, least: int = CODE_BITS) -> int:
    return max(least, -(-dim // 64) * 64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two first keeps squares from leaving the range of a double."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, aligned): the signs of each rotated unit vector, packed, and how far they point its way.

    ``aligned`` is the inner product of the unit vector and the unit vector of its signs: the scalar
    that corrects an estimate, and that says how close it is.
    """
    rotated = _unit(vectors) @ turn
    return (np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64),
            np.abs(rotated).sum(axis=1) / np.sqrt(turn.shape[1]))


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", bits: int = CODE_BITS,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, id, block, code, aligned, vector): one code a vector, for ``search``; written once.

    Nothing is fitted: the rotation is random with a fixed seed, so every row is indexed alike. Rows are
    dealt in turn to blocks of about ``block_rows``, fewer where the table is small, so no id or
    vector makes a large block. ``row`` numbers rows within the index. Null, empty and zero
    vectors, those with null, NaN or infinite entries, and those of another length than most have, are
    left out. Empty table: empty. Other columns are ignored.
    """
    spark = df.sparkSession
    sound = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        is_finite("vector") & F.exists("vector", lambda x: x != 0))
    dim = dimension(sound, "vector")
    if not dim:
        return spark.createDataFrame([], INDEX)
    rows = sound.filter(F.size("vector") == dim)
    count = rows.count()
    block_rows = max(1, min(block_rows, (BLOCK_MB << 17) // dim))
    blocks = max(-(-count // block_rows), min(-(-count // LEAST_ROWS), default_parallelism(spark)))
    turn = spark.sparkContext.broadcast(rotation(dim, code_bits(dim, bits)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, aligned = encode(matrix(batch["vector"], dim), turn.value)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            block = pa.array((batch["row"].to_numpy() % (1 << 33) + (batch["row"].to_numpy() >> 33)) % blocks, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], block, packed, pa.array(aligned), batch["vector"]],
                names=["row", "id", "block", "code", "aligned", "vector"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector")
    return materialize(numbered.mapInArrow(each, INDEX), "one-bit-index")


def _planes(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step, rest): queries in small whole numbers, by bit planes; ``rest`` is the length lost."""
    low = queries.min(axis=1)
    step = (queries.max(axis=1) - low) / (2**QUERY_BITS - 1)
    step = np.where(step > 0, step, 1.0)
    whole = np.rint((queries - low[:, None]) / step[:, None]).astype(np.uint8)
    rest = np.linalg.norm(queries - low[:, None] - whole * step[:, None], axis=1)
    planes = np.stack([np.packbits((whole >> k) & 1, axis=1, bitorder="little").view(np.uint64)
                       for k in range(QUERY_BITS)], axis=1)
    return planes, low, step, rest


class Block:
    """The codes and vectors of one block, searched one query at a time."""

    def __init__(self, table: pa.Table, turn: np.ndarray):
        dim, self.bits, self.turn = *turn.shape, turn
        self.row, self.aligned = table["row"].to_numpy(), table["aligned"].to_numpy()
        self.id, self.nameless = table["id"].fill_null(0).to_numpy(), table["id"].is_null().to_numpy()
        self.code = np.ascontiguousarray(np.frombuffer(
            b"".join(table["code"].to_pylist()), np.uint64).reshape(len(self.row), -1).T)
        self.ones = np.bitwise_count(self.code).sum(axis=0, dtype=np.int64)
        vectors = matrix(table["vector"].combine_chunks(), dim)
        self.vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        # The estimate's standard error is that of a random direction's share of what the signs miss.
        self.missed = np.maximum(0.0, 1 - self.aligned**2) / (self.aligned**2 * max(1, self.bits - 1))
        self.scale = 1 / (np.sqrt(self.bits) * self.aligned)

    def estimates(self, planes: np.ndarray, low: float, step: float) -> np.ndarray:
        """Inner products with a query from packed bits: counts of common ones, a weight a plane."""
        both = np.zeros(len(self.row), np.uint32)
        for k, plane in enumerate(planes):
            ones = np.bitwise_count(self.code & plane[:, None])
            count = ones[0].astype(np.uint32)
            for more in ones[1:]:
                count += more
            both += count << np.uint32(k)
        total = sum(int(np.bitwise_count(p).sum()) << k for k, p in enumerate(planes))
        signed = both * (2.0 * step)
        signed += (2 * self.ones - self.bits) * low - total * step
        return signed * self.scale

    def bounds(self, rest: float, bound: float) -> np.ndarray:
        """How far the estimates may be off; ``rest`` is the length that the query's whole numbers lost."""
        return bound * np.sqrt(self.missed + (rest * self.scale) ** 2)

    def search(self, rows: np.ndarray, queries: np.ndarray, nearest: int, bound: float):
        """(query, index, score) of the nearest of each query in this block, its own row left out."""
        scaled = np.ldexp(queries, -np.frexp(np.abs(queries).max(axis=1))[1][:, None])
        norms = np.sqrt((scaled * scaled).sum(axis=1))
        planes, low, step, rest = _planes((scaled / norms[:, None]) @ self.turn)
        for q in range(len(rows)):
            near = self.estimates(planes[q], low[q], step[q])
            off = self.bounds(rest[q], bound)
            own = np.flatnonzero(self.row == rows[q])
            least = near - off
            least[own] = -np.inf
            floor = np.partition(least, -nearest)[-nearest] if len(least) > nearest else -np.inf
            chosen = np.flatnonzero(near + off >= floor)  # all that may be among the nearest
            chosen = chosen[self.row[chosen] != rows[q]]
            # One sum a row, so that equal vectors score alike whatever lies beside them.
            score = (self.vectors[chosen] * scaled[q]).sum(axis=1) / (self.norms[chosen] * norms[q])
            best = np.lexsort((self.row[chosen], self.id[chosen], self.nameless[chosen], -score))[:nearest]
            yield np.full(len(best), q), chosen[best], score[best]


def search(index: DataFrame, queries: Column, nearest: int = NEAREST, bound: float = BOUND,
           seed: int = SEED) -> DataFrame:
    """(query_row, query_id, rank, row, id, score): the nearest rows of each query by cosine.

    Queries are the rows of ``index`` (of ``build_index``) where the condition ``queries`` holds;
    candidates are all rows but the query's own. Each block of codes gets every query: queries are
    copied to the blocks, which hold a bounded number of rows, and pass through them in a stream.
    There, inner products are estimated from the packed bits of code and query, corrected by the
    code's scalar. An estimate is taken to be off by ``bound`` standard errors at most; candidates whose
    upper bound reaches the lower bound of the ``nearest``-th best are reranked by their cosine in
    doubles. A near row is lost only where its estimate misses by more than the bound (three
    standard errors: about one in 700). The nearest of each block are merged.

    Nearest first, ties to the smaller id (null last), then the smaller ``row``. Repeated rows and copies are
    candidates of their own. Fewer candidates: all of them. No query or no candidate: empty.
    """
    spark = index.sparkSession
    shape = index.agg(F.first(F.size("vector")).alias("dim"), F.first(F.octet_length("code") * 8).alias("bits"),
                      F.max("block").alias("last")).first()
    made = "query_row long, query_id long, row long, id long, score double"
    if shape["dim"] is None:
        return spark.createDataFrame([], made.replace(", row", ", rank int, row"))
    dim, last = shape["dim"], shape["last"]
    turn = spark.sparkContext.broadcast(rotation(dim, shape["bits"], seed))
    asked = index.filter(queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), F.lit(1).alias("asks"), "row", "id",
        F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("aligned"), "vector")
    held = index.select("block", F.lit(0).alias("asks"), "row", "id", "code", "aligned", "vector")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, now, block = [], None, None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch["block"].to_numpy() * 2 + batch["asks"].to_numpy())) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(batch)].tolist()):
                part = batch.slice(a, b - a)
                number = part["block"][0].as_py()
                if number != now:
                    kept, now, block = [], number, None
                if not part["asks"][0].as_py():
                    kept.append(part)
                    continue
                if block is None and not kept:
                    continue  # a block without codes
                if block is None:
                    block = Block(pa.Table.from_batches(kept), turn.value)
                    kept = []
                rows = part["row"].to_numpy()
                found = list(block.search(rows, matrix(part["vector"], dim), nearest, bound))
                q, at, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[q]), part["id"].take(pa.array(q)), pa.array(block.row[at]),
                     pa.array(block.id[at], mask=block.nameless[at]), pa.array(score)],
                    names=["query_row", "query_id", "row", "id", "score"])

    found = (held.unionByName(asked).repartition(last + 1, "block").sortWithinPartitions("block", "asks")
             .mapInArrow(each, made))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
            .select("query_row", "query_id", "rank", "row", "id", "score"))


def nearest_neighbours(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding",
                       nearest: int = NEAREST, bits: int = CODE_BITS, bound: float = BOUND) -> DataFrame:
    """The nearest of each query row of ``df``, by an index of its own; ``queries`` is a condition on ``id``."""
    return search(build_index(df, key, vector, bits), queries, nearest, bound)
