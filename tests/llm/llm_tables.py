"""Small document tables with everything an operator must bear."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) pairs as a table of documents."""
    def make(rows, extra=()):
        schema = T._parse_datatype_string(DOCUMENTS)
        data = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, schema)
        for name in extra:  # columns named like those that operators make
            df = df.selectExpr("*", f"'old' AS `{name}`")
        return df
    return make


def prose(seed, words=60, vocabulary=400):
    """Words of letters only, in a fixed pseudo-random sequence."""
    out, x = [], seed * 7919 + 17
    for _ in range(words):
        x = (x * 1103515245 + 12345) % (1 << 31)
        n = x // 8 % vocabulary
        out.append("".join("bdfgklmnprst"[n // 12**k % 12] + "aeiou"[n // 5**k % 5] for k in range(3)))
    return " ".join(out)


ODD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "\n\n\t \n"), (5, "one"), (6, "Ünïcode ß 漢字 𝒳 é x   y"),
    (7, "a\x0bb\x0cc\rd\x1ce"), (8, prose(1, 3000)), (9, "the same " * 2000), (None, "no id here " * 5),
    (None, None), (10, "repeated row of some words, said here again and again"),
    (10, "repeated row of some words, said here again and again"), (10, "other text under the same id"),
    (11, "<b>markup</b> &amp; such | ### $$$"),
]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
