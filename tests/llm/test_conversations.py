"""Conversation repair against all possible edits, and against plain Python on whole tables."""

import hashlib
import random
import re
import zlib

import pytest
from llm_tables import ODD_TEXTS

from surtido.llm.conversation_repair import damage, digests, repair
from surtido.llm.queries import op11_conversation_repair
from surtido.llm.turn_edits import Survivors, all_ends, apply_edits, cheapest_edits, follow, join_pieces

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def every_edit(turns):
    """The cheapest and then least audit of all edits with at most two rows put in at one place."""
    best = [(4 * len(turns), "D" * len(turns))]

    def go(i, roles, cost, audit, put_in):
        if (cost, audit) > best[0] and cost >= best[0][0] and cost > best[0][0]:
            return
        if i == len(turns):
            if re.fullmatch("(s?(ua)+)?", roles):
                best[0] = min(best[0], (cost, audit))
        else:
            initial, fault = turns[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                go(i + 1, roles + (initial or "?"), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, audit + "R", 0)
        if put_in < 2:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", put_in + 1)

    go(0, "", 0, "", 0)
    return best[0]


def some_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "t", "", "u", "a"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_edits_equal_all_possible_edits():
    rng = random.Random(5)
    for _ in range(1500):
        turns = some_turns(rng, rng.randint(0, 4))
        assert cheapest_edits(turns) == every_edit(turns), turns


def test_pieces_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(1500):
        turns = some_turns(rng, rng.randint(1, 40))
        size = rng.randint(1, 9)
        cost, audit = cheapest_edits(turns)
        *parts, total = join_pieces(all_ends(turns[i:i + size], i == 0) for i in range(0, len(turns), size))
        assert (total, "".join(edits for _, edits in parts)) == (cost, audit)
        roles, at = "", 0
        for state, edits in parts:  # each piece's edits apply by themselves
            piece = turns[at:at + size]
            at += size
            roles += "".join(role[:1] if role else piece[i][0] for _, i, role in
                             apply_edits(edits, [t for t, _ in piece], state))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_edits_settle_early_and_the_tree_stays_small():
    turns = [("u", 0), ("a", 0)] * 5000
    sizes, out = [], 0
    for piece in follow(turns):
        if isinstance(piece, Survivors):
            continue
        out += len(piece)
        sizes.append(out)
    assert out >= 9990 and len(sizes) > 9000


def test_a_tie_that_never_settles_is_compared_whole():
    turns = [("t", 0)] * 2001  # any one of them may go
    assert cheapest_edits(turns) == (3 * 2000 + 4, "D" + "R" * 2000)


def plain(rows, damaged=True):
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        harm = harm if damaged else 9
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            group += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in group:
            bare = text.rstrip(BLANKS)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in group]
        cost, audit = cheapest_edits(list(zip(initials, faults)))
        turns = [t for t, _, _ in group if t is not None]
        lines = [f"{role or group[i][1]}:{'' if i is None else group[i][2]}" for _, i, role in apply_edits(audit, initials)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def told(repaired):
    hashes = {r.conv_id: r.repaired_sha256 for r in digests(repaired.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    rows = repaired.reports.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        hashes.get(r.conv_id, empty)) for r in rows}


def talk(conv, n, rng):
    words = ["Yes.", "No!", "Why?", "so", "It is late.", "", " \t"]
    return [(conv, t + rng.randint(0, 1) * (t % 7 == 0), rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice(words) if rng.random() < 0.1 else f"turn {t} of {conv}{rng.choice(['.', '!', '', '? '])}") for t in range(n)]


@pytest.fixture
def uncoalesced(spark):
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("piece", [3, 1000])
def test_table_equals_plain_python(spark, uncoalesced, piece):
    rng = random.Random(piece)
    rows = [r for c in range(60) for r in talk(c, rng.randint(1, 9), rng)]
    rows += [(100, t, "user" if t % 2 else "assistant", f"long talk {t % 390}.") for t in range(400)]  # a hot one
    rows += [(None, None, None, None), (None, 3, "user", "No id."), (101, None, "", "x"), (102, 1, "system", "Only.")]
    rows = list(dict.fromkeys(rows))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # ties have an order of their own
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(repair(df, piece)) == plain(rows, damaged=False)
    hurt = {k: v for k, v in plain(rows).items()}
    got = told(repair(damage(df), piece))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {k: got.get(k, empty) for k in hurt} == hurt


def test_turns_are_sound_and_in_place(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "cut"), (2, 0, "x", "")], SCHEMA)
    out = repair(df)
    turns = [(r.place, r.turn, r.role, r.text, r.edit) for r in out.turns.orderBy("place").collect()]
    report = {r.conv_id: (r.cost, r.audit) for r in out.reports.collect()}
    assert report == {1: (6, "KIKK"), 2: (4, "D")}
    assert turns == [(0, 0, "user", "Hi.", "K"), (1, None, "assistant", "", "I"),
                     (2, 1, "user", "And?", "K"), (3, 2, "assistant", "cut", "K")]


def test_odd_rows(spark, uncoalesced):
    """Nulls, long texts, repeated rows, ties, extreme turns, extra columns."""
    rows = [(5, i, "user" if i % 2 else "assistant", text) for i, (_, text) in enumerate(ODD_TEXTS)]
    rows += [(6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, 1, "assistant", "Tied."), (7, -2**63, "user", "a."),
             (7, 2**63 - 1, "assistant", "b."), (8, 0, "user", "x" * 5_000_000 + "."), (8, 1, "assistant", "y." * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fault", "2 AS cost", "3 AS audit", "4 AS kind")
    out = repair(df)
    got = {r.conv_id: r for r in out.reports.collect()}
    assert got[5].blank == 5 and got[5].gaps == 0
    assert (got[6].duplicate, got[6].illegal) == (1, 1)
    assert got[7].gaps == 2**63 - 1 and got[7].audit == "KK"
    assert got[8].audit == "KK"
    assert out.turns.filter("conv_id = 8").count() == 2


def test_empty_table(spark):
    out = repair(spark.createDataFrame([], SCHEMA))
    assert out.reports.count() == out.turns.count() == digests(out.turns).count() == 0


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in op11_conversation_repair(spark, sf).collect()}
    assert got == plain(rows)
