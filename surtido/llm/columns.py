"""Column helpers that the operators of this folder share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS_IN_A_BATCH = 1000  # rows sent to a Python worker at once

# The white space that trims lines and parts words, and its class in a pattern
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other letters as they are. Pure ASCII takes the faster function."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def others(df: DataFrame, *made: str) -> list[Column]:
    """The columns of ``df`` but those that the operator makes anew."""
    return [F.col(f"`{c}`") for c in df.columns if c not in made]


def small_batches(spark: SparkSession, rows: int = TEXTS_IN_A_BATCH) -> None:
    """Send texts to Python workers in small batches: both sides hold a batch, and texts are long.

    The session's setting of 10,000 rows is meant for numbers; a smaller one is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
