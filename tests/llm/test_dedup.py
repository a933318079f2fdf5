"""Line dedup, SimHash and substring dedup against plain Python."""

import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_tables import ODD_TEXTS, by_id, docs, prose  # noqa: F401
from pyspark.sql import functions as F

from surtido.llm.components import components
from surtido.llm.line_dedup import dedup_lines
from surtido.llm.simhash import linked_within, link_codes, near_duplicates, text_fingerprints
from surtido.llm import simhash, substring_dedup
from surtido.llm.substring_dedup import dedup_substrings, pack, unpack

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows, least):
    found = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            found[lower(line.strip(BLANKS))].add(i)
    common = {k for k, ids in found.items() if k and len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if lower(x.strip(BLANKS)) not in common]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sortable(rows):
    return sorted(rows, key=repr)


def test_lines_equal_plain_python(docs):
    rows = [(i, f"own {i}\n Shared LINE \t\n\nx{i}\nÉcole{i % 2}") for i in range(30)]
    rows += [(40, "shared line"), (41, "shared line\nSHARED line\n"), *ODD_TEXTS]
    got = dedup_lines(docs(rows, ["n_lines"]), 12).collect()
    assert sortable((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == sortable(plain_lines(rows, 12))
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"}


def test_a_line_counts_documents_not_rows(docs):
    same = [(1, "often here")] * 15 + [(2, "often here")]
    assert {r.n_dropped for r in dedup_lines(docs(same), 3).collect()} == {0}
    assert {r.text for r in dedup_lines(docs(same), 2).collect()} == {""}


@pytest.mark.parametrize("make", [dedup_lines, near_duplicates, dedup_substrings])
def test_empty_table(docs, make):
    assert make(docs([])).collect() == []


def test_hot_line_and_long_text(docs):
    rows = [(i, "hot\n" + "\n".join(f"{i}-{k}" for k in range(3))) for i in range(200)]
    rows.append((999, "\n".join(["hot", "y"] * 20_000)))
    got = by_id(dedup_lines(docs(rows)))
    assert got[999].n_dropped == 20_000 and got[999].text == "\n".join(["y"] * 20_000)
    assert all(got[i].n_dropped == 1 for i in range(200))


def plain_fingerprint(text, size=4):
    w = words(lower(text or ""))
    parts = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, bits):
    """Component of each index over all pairs."""
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(codes))]


def test_near_duplicates_equal_all_pairs(docs):
    rows = [(i, prose(i % 20, 80) + (f" tail{i}" if i % 3 else "")) for i in range(100, 160)] + ODD_TEXTS
    got = near_duplicates(docs(rows, ["fp", "component_id"])).collect()
    codes = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(codes, 4)
    least = {g: min((i for (i, _), h in zip(rows, groups) if h == g and i is not None), default=None)
             for g in set(groups)}
    want = [(i, code, least[g]) for (i, _), code, g in zip(rows, codes, groups)]
    assert sortable((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sortable(want)


def test_empty_texts_have_fingerprint_zero():
    import pyarrow as pa
    assert text_fingerprints(pa.array(["", None, " \n"]), 4).tolist() == [0, 0, 0]


def codes_around(centres, each, bits, rng):
    out = []
    for c in centres:
        for _ in range(each):
            x = int(c)
            for b in rng.choice(64, int(rng.integers(0, bits + 1)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def gray(x):
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def test_index_levels_find_what_all_pairs_find():
    rng = np.random.default_rng(5)
    codes = np.unique(np.r_[codes_around(rng.integers(0, 2**63, 6), 900, 6, rng),
                            rng.integers(0, 2**63, 3000).astype(np.uint64)])
    codes = codes[np.argsort(gray(codes))]
    assert linked_within(codes, 4).tolist() == all_pairs(codes)


def all_pairs(codes, bits=4):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
    label = np.arange(len(codes))
    while True:
        low = np.where(near, label[None, :], len(codes)).min(axis=1)
        if (low == label).all():
            return label.tolist()
        label = low


@pytest.mark.parametrize("cell", [20_000, 40])
def test_links_across_nodes_and_split_cells(spark, cell):
    rng = np.random.default_rng(6)
    codes = np.unique(np.r_[codes_around(rng.integers(0, 2**63, 4), 60, 5, rng),
                            rng.integers(0, 2**63, 200).astype(np.uint64), np.zeros(1, np.uint64)])
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(link_codes(df, 4, cell)).collect()}
    got = [roots.get(int(c), int(c)) for c in codes.view(np.int64)]
    want = all_pairs(codes)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    links = spark.createDataFrame(chain + star + [(7, 7), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(80)}}
    assert components(links.limit(0)).collect() == []


def plain_substrings(rows, size):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k:k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("slice_bytes, bucket", [(16 << 20, 2_000_000), (2000, 300)])
def test_substrings_equal_plain_python(docs, slice_bytes, bucket):
    shared = prose(99, 30)
    rows = [(i * i - 50, f"{prose(i, 20)} {shared} {prose(i + 500, 15)}") for i in range(1, 25)]
    rows += [(5000 + i, prose(3, 25)) for i in range(6)] + ODD_TEXTS
    got = dedup_substrings(docs(rows, ["n_words", "removed"]), 13, slice_bytes, bucket).collect()
    assert sortable((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sortable(plain_substrings(rows, 13))
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_hashes_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert unpack(*pack(hashes)).tolist() == hashes.tolist()


def test_slices_follow_bytes_and_split_a_large_id(docs):
    """Long texts, a hot id and rows without one: no slice is large, and the result is that of plain Python."""
    shared = [prose(s, 40, 5000) for s in range(6)]
    rows = [(i, f"{prose(i, 30)} {shared[i % 6]}") for i in range(60)]
    rows += [(30, f"{prose(1000 + k, 60, 5000)} {shared[k % 6]}") for k in range(200)]  # one id on many rows
    rows += [(2**60 + 1, prose(7, 20_000, 5000)), (2**60 + 2, f"{prose(7, 300, 5000)} {prose(8, 30, 5000)}")]
    rows += [(None, f"{prose(k)} {shared[k % 6]}") for k in range(50)] + [(-5, shared[0]), (10**15, None), (10**15, "")]
    table = docs(rows, ["slice", "rank"]).repartition(3)
    most = 20_000
    sliced, n, whole = substring_dedup._sliced(table.selectExpr("doc_id", "coalesce(text, '') AS text"), most)
    sizes = {r.slice: r for r in sliced.groupBy("slice").agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("one"), F.count("*").alias("n"),
        F.count_distinct("rank").alias("ranks"), F.count_distinct("doc_id").alias("ids")).collect()}
    assert whole == sum(len((t or "").encode()) for _, t in rows) and n > 4
    assert all(r.ranks == 1 for r in sizes.values())
    assert all(r.bytes <= max(3 * most, 2 * most + r.one) for r in sizes.values())
    hot = sliced.where("doc_id = 30").select("slice", "rank").distinct().collect()
    assert len(hot) > 3 and len({r.rank for r in hot}) == 1
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_substrings(table, slice_bytes=most).collect()]
    assert sortable(got) == sortable(plain_substrings(rows, 13))


def gray_ordered(codes):
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return codes[np.argsort(rank)]


def test_masks_cover_all_close_pairs():
    masks = [m & (2**64 - 1) for m in simhash._masks(4)]
    assert len(masks) == 15 and all(20 <= m.bit_count() <= 22 for m in masks)
    rng = np.random.default_rng(3)
    for _ in range(2000):
        apart = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(apart & m == 0 for m in masks)


def test_the_index_prunes_random_codes():
    """Of a million random codes the nodes hold next to none to compare; a full node's groups are mostly dropped."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, 1_000_000, dtype=np.uint64)
    compared = 0
    for mask in simhash._masks(4):
        _, sizes = np.unique(codes & np.uint64(mask & (2**64 - 1)), return_counts=True)
        compared += int((sizes * (sizes - 1) // 2).sum())
    assert compared < 1e-5 * len(codes) * (len(codes) - 1) / 2
    node = gray_ordered(codes[:40_000] & np.uint64((1 << 43) - 1))
    lowest = simhash._nodes(node, node, simhash.BLOCK)
    a, b = rng.integers(0, len(lowest[0]), (2, 100_000))
    assert simhash._near(lowest, a, b, 4).mean() < 0.2


def test_a_node_of_near_copies_is_one_group():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    flips = [sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(3000)]
    codes = gray_ordered(np.unique(base ^ np.array(flips, np.uint64)))
    assert set(linked_within(codes, 4).tolist()) == {0}


def test_a_slice_of_the_default_size_is_cleaned_in_bounded_memory():
    """What the arrays of one slice take at most (twice as much with slices of 10 MB)."""
    rng = np.random.default_rng(2)
    n = substring_dedup.SLICE_BYTES // 500
    texts = [" ".join(map(str, rng.integers(0, 10_000, 100))) for _ in range(n)]
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts,
                     "slice": pa.array([0] * n, pa.int32()), "rank": pa.array([0] * n, pa.int32())})
    key = (pa.scalar(0),)
    tracemalloc.start()
    try:
        packed = substring_dedup._packer(13, 4, 1)(key, docs)
        cleaned = substring_dedup._cleaner(13, 1)(key, docs, packed.slice(0, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cleaned.num_rows == n and packed.num_rows == 4
    assert peak < 140 << 20
