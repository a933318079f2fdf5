"""Whitening against numpy's eigenvectors, one-bit search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surtido.llm.one_bit_search import Block, _planes, build_index, code_bits, encode, nearest_neighbours, rotation
from surtido.llm.queries import op12_nearest_neighbours, op13_embedding_whitening
from surtido.llm.whitening import leading_components, polar_factor, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], schema)


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    [3.0], [2.0, 1.0], [5.0, 4, 3, 2, 1], [3.0, 3, 3, 2, 2, 1, 1, 1], [1e12, 1, 1e-3, 1e-9, 2, 1, 1, 0],
    [3.0, 3 + 1e-9, 3 + 2e-9, 2, 1], [1.0, 0, -1, 0, 0], [0.0, 0, 0], list(np.linspace(1, 100, 90))])
def test_components_equal_numpy(values):
    a = symmetric(values)
    got, vectors = leading_components(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(got - want).max() <= 1e-13 * size * len(values)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    a = symmetric([5, 1e-3, -1e-7, -2])
    e, q = np.linalg.eigh(a)
    assert np.abs(polar_factor(a) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-8


def plain_whitening(vectors, components=8):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024).astype(int) + 100000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    k = min(components, x.shape[1])
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return centred @ q / np.sqrt(e), e / np.trace(cov), exact


def check_whitened(rows, ids, vectors):
    white, explained, exact = plain_whitening(vectors)
    got = {r.vec_id: r for r in rows}
    assert len(rows) == len(ids)
    made = np.array([got[i].whitened for i in ids])
    signs = np.sign((made * white).sum(axis=0))
    assert np.abs(made * signs - white).max() < 1e-8
    assert np.allclose(rows[0].explained, explained, rtol=1e-10)
    assert [got[i].deviation for i in ids] == exact
    assert rows[0].identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    rows = whiten(table(spark, list(enumerate(vectors))).repartition(5)).collect()
    check_whitened(rows, range(300), vectors)
    few = [v[:3] for v in vectors]
    check_whitened(whiten(table(spark, list(enumerate(few)))).collect(), range(300), few)


def test_unsound_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 4)).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    odd = [(90, None), (91, []), (92, [1.0, None, 0.0, 2.0]), (93, [nan, 1.0, 1.0, 1.0]), (94, [1.0, -inf, 1.0, 1.0]),
           (95, [1.0, 2.0])]
    df = table(spark, [*enumerate(vectors), *odd]).withColumn("whitened", F.lit(1)).withColumn("n", F.lit(2))
    check_whitened(whiten(df).collect(), range(40), vectors)


def test_whitening_without_variance(spark):
    alike = whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(alike) == 3 and {tuple(r.whitened) for r in alike} == {(None, None)}
    assert {tuple(r.explained) for r in alike} == {(0.0, 0.0)} and {r.identity_error for r in alike} == {None}
    line = whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert line[0].explained[0] == pytest.approx(1) and line[3].whitened[1:] == [None, None]
    assert whiten(table(spark, [])).count() == whiten(table(spark, [(1, None)])).count() == 0


def test_deviations_beyond_a_long(spark):
    big = [(0, [1e9]), (1, [-1e9]), (2, [0.0])] + [(i, [float(i)]) for i in range(3, 3000)]
    rows = {r.vec_id: r for r in whiten(table(spark, big)).collect()}
    x = [int(np.floor(np.float64(np.float32(v[0])) * 1024)) + 100000 for _, v in big]
    exact = (len(x) * x[0] - sum(x)) ** 2
    assert rows[0].deviation is None and int(rows[0].deviation_exact) == exact


def test_whitening_query(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = op13_embedding_whitening(spark, SF).collect()
    white, explained, exact = plain_whitening([r.embedding for r in raw])
    assert len(rows) == 8 * len(raw) and {r.component for r in rows} == set(range(1, 9))
    place = {r.vec_id: i for i, r in enumerate(raw)}
    made = np.zeros((len(raw), 8))
    for r in rows:
        made[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == exact[place[r.vec_id]]
    assert np.abs(made * np.sign((made * white).sum(axis=0)) - white).max() < 1e-7


def nearest_by_force(rows, queries, nearest=5):
    """{query row: [(id, score)]} over all sound rows, own row left out."""
    out = {}
    x = np.array([v for _, v in rows], np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    for q in queries:
        score = (x * x[q]).sum(axis=1) / (norms * norms[q])
        order = sorted((k for k in range(len(rows)) if k != q),
                       key=lambda k: (-score[k], rows[k][0] is None, rows[k][0] or 0))[:nearest]
        out[q] = [(rows[k][0], score[k]) for k in order]
    return out


def test_rotation_keeps_lengths_and_estimates_keep_their_bounds():
    rng = np.random.default_rng(1)
    turn = rotation(48, code_bits(48))
    assert np.abs(turn @ turn.T - np.eye(48)).max() < 1e-12
    x = rng.standard_normal((4000, 48))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, aligned = encode(x, turn)
    import pyarrow as pa
    block = Block(pa.table({"row": np.arange(4000), "id": np.arange(4000), "aligned": aligned,
                            "code": [c.tobytes() for c in codes], "vector": x.tolist()}), turn)
    planes, low, step, rest = _planes(unit[:50] @ turn)
    missed = 0
    for q in range(50):
        near = block.estimates(planes[q], low[q], step[q])
        off = block.bounds(rest[q], 3)
        missed += (np.abs(near - unit @ unit[q]) > off).sum()
    assert missed < 0.005 * 50 * 4000


def test_search_equals_brute_force_with_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:760] = x[700]  # copies
    x[800:900] = x[800] + 0.01 * rng.standard_normal((100, 32)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = nearest_neighbours(table(spark, rows).repartition(3), F.col("id") % 20 == 0).collect()
    want = nearest_by_force(rows, range(0, 1500, 20))
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits >= 0.99 * 5 * len(want)
    assert [i for i, _ in found[700]] == [701, 702, 703, 704, 705]  # ties to the smaller id
    assert all(abs(dict(want[q])[i] - s) < 1e-12 for q in want for i, s in found[q] if i in dict(want[q]))


def test_unsound_and_repeated_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (None, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [3e38, 3e38]),
            (5, [1e-40, 0.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [1.0, None]), (140, [1.0, 2.0, 3.0])]
    df = table(spark, rows).withColumns({"row": F.lit(1), "rank": F.lit(1), "id": F.lit(7)})
    assert build_index(df).count() == 7
    got = nearest_neighbours(df, F.col("id") % 20 == 0).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault((r.query_row, r.query_id), []).append((r.id, round(r.score, 6)))
    assert sorted(k[1] for k in by_query) == [0, 0, 20]
    for (_, i), found in by_query.items():
        if i == 0:  # its other row, the small one, then the one without an id
            assert found[:3] == [(0, 1.0), (5, 1.0), (None, 1.0)]
            assert sorted(found[3:]) == [(3, 0.707107), (4, 0.707107)]  # equal but for the last bit
        else:
            assert sorted(found[:2]) == [(3, 0.707107), (4, 0.707107)]
            assert found[2:] == [(0, 0.0), (0, 0.0), (5, 0.0)]


def test_few_or_no_candidates(spark):
    one = table(spark, [(0, [1.0, 2.0])])
    assert nearest_neighbours(one, F.col("id") % 20 == 0).count() == 0
    assert nearest_neighbours(table(spark, []), F.lit(True)).count() == 0
    two = nearest_neighbours(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in two) == [(0, 1, 1), (1, 1, 0)]


def test_search_query_recall(spark):
    raw = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    asked = [k for k, (i, _) in enumerate(raw) if i % 50 == 0]
    want = nearest_by_force(raw, asked)
    found = {}
    for r in op12_nearest_neighbours(spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[raw[q][0]] & {i for i, _ in want[q]}) for q in asked) >= 0.99 * 5 * len(asked)
