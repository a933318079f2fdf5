"""Packing, sharding, the registered queries and the pipeline."""

import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_tables import ODD_TEXTS, docs, prose  # noqa: F401
from tokenizers import Tokenizer

from surtido.llm.packing import Encoder, pack, sequence_rows, shortest_pack_first
from surtido.llm.queries import QUERIES
from surtido.llm.sharding import shard_rows
from surtido.llm.sql import ORACLE
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
PATH = public_tokenizers.path("byte_bpe_50k.json")
TABLES = {"op2": ("pages", "page_id"), "op10": ("pages", "page_id"), "op11": ("conversations", "conv_id"),
          "op12": ("embeddings", "vec_id"), "op13": ("embeddings", "vec_id")}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_memo_gives_the_tokenizers_ids(tokenizer):
    texts = ["", " ", "a", "word, x. y! z?! a.b, ,", "a,\nb.\n\nc", "\n", "a\n", "a \nb", " x", "x ", "a  b", "é, ß. ñ",
             "<|endoftext|> a", "a<|endoftext|>b c", "it's 's  don't x", "a\t b", "é\x1cb c\x85 d", "1,000.5 kg.", "𝒳漢, 字",
             prose(1), prose(2) + ".\n" + prose(3)]
    encoder = Encoder(PATH, memo_words=50)
    for _ in range(2):
        got = encoder.encode(texts)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_an_exact_round_trip(docs, tokenizer):
    rows = [(i, prose(i, 5 + i * i % 97)) for i in range(80)] + ODD_TEXTS
    packed = pack(docs(rows, ["start"]), PATH, length=64, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((i, a, tuple(ids[a:a + 64]), len(ids)) for a in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in packed) == want
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *(r.length for r in held)])
        assert [r.offset for r in held] == ends[:-1].tolist() and ends[-1] <= 64


def test_sequences_are_padded_rows(docs):
    packed = pack(docs([(i, prose(i, 9)) for i in range(20)]), PATH, length=128, with_ids=True)
    rows = sequence_rows(packed, 128).collect()
    assert {len(r.ids) for r in rows} == {128}
    assert sorted(i for r in rows for i in r.doc_ids) == sorted(r.doc_id for r in packed.collect())


def test_sequences_of_a_power_of_two_may_stay(spark):
    packed = spark.createDataFrame([(1, 0, 0, [5] * 64), (2, 1, 0, [6] * 65), (3, 2, 0, [7] * 40), (4, 2, 40, [8] * 88)],
                                   "doc_id long, sequence_id long, offset long, ids array<int>")
    sizes = lambda **o: {r.sequence_id: len(r.ids) for r in sequence_rows(packed, 128, **o).collect()}
    assert sizes() == {0: 128, 1: 128, 2: 128} and sizes(pad_powers=False) == {0: 64, 1: 128, 2: 128}


def test_patterns_place_every_length_with_little_padding():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 2049, 50_000), return_counts=True))}
    patterns = shortest_pack_first(histogram)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 2048 and count > 0
        for size in lengths:
            placed[size] += count
    assert placed == histogram
    used = sum(k * v for k, v in histogram.items())
    assert used / (2048 * sum(c for _, c in patterns)) > 0.95
    assert shortest_pack_first({2048: 10**12, 1: 10**12})[0][1] > 10**8  # counts, not pieces
    assert shortest_pack_first({}) == []


def test_empty_table_packs_and_shards_to_nothing(docs):
    assert pack(docs([]), PATH).collect() == []
    assert shard_rows(docs([])).collect() == []


def test_shards_equal_plain_prefix_sums(docs):
    rows = [(i * 3 % 301, prose(i, i % 40)) for i in range(301)] + ODD_TEXTS
    got = shard_rows(docs(rows, ["size", "shard"]), 7).collect()
    sized = sorted(((i is not None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    whole, before, want, first = sum(s for _, s, _ in sized), 0, [], {}
    for rank, ((known, i), size, crc) in enumerate(sized):
        shard = min(6, (2 * before + size) * 7 // (2 * whole))
        want.append((i if known else None, size, crc, shard, rank - first.setdefault(shard, rank)))
        before += size
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=key) == sorted(want, key=key)


def test_one_id_for_all_rows_still_balances(docs):
    got = shard_rows(docs([(5, prose(i, 20)) for i in range(500)]), 10).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) < 1.1 * min(sizes.values())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, name):
    table, key = TABLES.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if name.startswith("op12_"):
        key, ids = "query_id", {i for i in ids if i % 50 == 0}
    assert {r[key] for r in QUERIES[name](spark, SF).collect()} == ids


def test_native_plans_hold_no_python(spark):
    for name in ("op1_line_dedup", "op4_benchmark_decontamination", "op8_sharding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_pipeline_keeps_and_drops_what_its_stages_say(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()
    documents = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in documents.collect()}
        documents = stage(spark, documents, SF)
        after = {r.doc_id: r.text for r in documents.collect()}
        assert documents.columns == source.columns and set(after) <= set(before)
        if name == "quality_rules":
            clean = {i for i, in labels if len((before[i] or "").split()) >= 10}
            assert len(clean & set(after)) >= 0.95 * len(clean)
        elif name == "line_dedup":
            assert set(after) == set(before)
        elif name == "simhash_near_dedup":
            assert len(set(after.values())) == len(after)
        else:
            items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
            assert not any(t in x for x in after.values() for t, in items)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(after)


def test_near_dedup_stage_leaves_one_of_each_group(spark, docs):
    rows = [(3, prose(1)), (1, prose(1)), (1, prose(1)), (2, prose(1).upper()), (7, prose(50)), (None, prose(80)),
            (None, prose(80)), (8, None), (9, "")]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, docs(rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(1, prose(1)), (7, prose(50)), (0, prose(80)), (8, "")])


def test_near_dedup_stage_keeps_unrelated_texts_of_one_id(spark, docs):
    """Also where copies of them have larger ids, and beside rows and columns that repeat."""
    rows = [(5, prose(1)), (5, prose(50)), (8, prose(50)), (9, prose(50)), (6, prose(1)), (None, prose(70)), (3, prose(70)),
            (4, prose(20, 3000)), (4, prose(20, 3000))]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, docs(rows, ["body", "root", "_id"]), SF)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(
        [(5, prose(1)), (5, prose(50)), (3, prose(70)), (4, prose(20, 3000))])
    assert got.columns == docs(rows, ["body", "root", "_id"]).columns


def test_stages_of_an_empty_table(spark, docs):
    table = docs([], ["score", "kept", "n_lines", "item_ids"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert out.collect() == []
        assert name == "packing" or out.columns == table.columns


def test_stages_bear_odd_rows(spark, docs):
    table = docs(ODD_TEXTS, ["score", "body", "n_dropped", "contaminated", "component_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns
        kept = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "benchmark_decontamination":
            assert kept == Counter(ODD_TEXTS)
        elif name == "line_dedup":
            assert sum(kept.values()) == len(ODD_TEXTS)
        elif name == "quality_rules":
            assert not (set(kept) - set(ODD_TEXTS)) and (5, "one") not in kept
        else:
            assert max(kept.values()) == 1 and {i for i, _ in kept} >= {1, 6, 8, 9}


def test_the_rest_imports_without_this_folder(tmp_path):
    for name in ("__spark_entry__.py", "surtido"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (ROOT / "surtido").iterdir():
        if part.name != "llm":
            (tmp_path / "surtido" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eoq' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True,
                   env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
