"""Line dedup: lines that many documents share go from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import BLANKS, lower_ascii, others, text_of
from surtido.session import materialize

MIN_DOCUMENTS = 10
SALTS = 16  # tasks that the lines of one key are dealt to, when common ones are looked up


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, pos, h): every line that has a key, by the hash of its key.

    ``body`` is the hash of the whole text; with ``doc_id`` it names a document, so
    that rows which share their id but not their text are told apart.
    """
    keyed = F.transform(_lines(text_of()), lambda x: line_key(x))
    hashed = F.transform(keyed, lambda k: F.when(k != "", F.xxhash64(k)))
    # The outer form: for the inner one a filter is inferred that hashes all lines once more.
    return docs.select(
        "doc_id", F.xxhash64("text").alias("body"), F.posexplode_outer(hashed).alias("pos", "h"),
    ).filter(F.col("h").isNotNull())


def common_lines(hashes: DataFrame, min_documents: int) -> DataFrame:
    """(h): hashes found in at least so many distinct documents.

    The distinct count runs in two steps, by hash and document and then by hash, so a
    line that a third of all documents hold is spread before it is counted.
    """
    pairs = hashes.select("h", F.struct("doc_id").alias("document")).distinct()
    return (pairs.groupBy("h").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_documents).select("h"))


def dedup_lines(df: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows of ``df`` with ``text`` less its common lines, ``n_lines`` and ``n_dropped``.

    Lines are split at ``\\n`` and compared by ``line_key``; a key found in at least
    ``min_documents`` distinct ``doc_id`` loses all its lines everywhere. Empty keys
    stay. Keys are compared by a 64-bit hash: a line of its own is lost wrongly with a
    chance of (common lines / 2^64).

    Null or empty text: one empty line, text ``""``. All lines dropped: ``""``. Null
    ``doc_id`` counts as one document. A repeated row counts once and stays repeated. Very long
    texts: all their lines, in one row. A key in just ``min_documents`` goes.
    Empty table: empty. Other columns stay; input columns called ``n_lines`` or
    ``n_dropped`` are replaced.

    Runs one job when called: hashes and positions (no text) are written once, then
    counted and joined from there.
    """
    hashes = materialize(line_hashes(df.select("doc_id", "text")), "line-hashes")
    common = common_lines(hashes, min_documents).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (
        hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "body"), F.lit(SALTS)).cast("int"))
        .join(common, ["h", "salt"], "left_semi")
        .groupBy("doc_id", "body")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
        .select(F.col("doc_id").alias("drop_id"), F.col("body").alias("drop_body"), "dropped"))
    docs = df.select(F.struct(*others(df, "n_lines", "n_dropped")).alias("doc"))
    joined = docs.join(dropped, F.col("doc.doc_id").eqNullSafe(F.col("drop_id"))
                       & (F.xxhash64("doc.text") == F.col("drop_body")), "left")
    parts = joined.select("doc", _lines(text_of("doc.text")).alias("lines"),
                          F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    kept = F.when(F.size("dropped") == 0, text_of("doc.text")).otherwise(_without("lines", "dropped"))
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    return parts.select(
        *[kept.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in names],
        F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"))


def _without(lines: str, dropped: str) -> Column:
    """The lines whose position is not dropped, joined in order; linear in the number of lines."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
