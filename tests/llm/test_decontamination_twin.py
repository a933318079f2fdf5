"""Decontamination against a plain-Python twin, finer look included."""

import random
from collections import defaultdict

import regex
from llm_tables import ODD_TEXTS, docs, prose  # noqa: F401

from surtido.llm.decontamination import UNITS, find_leaks

UNSPACED = r"฀-໿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U000323AF"
WORD = rf"[0-9]+(?:[.,][0-9]+)*|(?:(?![{UNSPACED}])\p{{L}})(?:(?![{UNSPACED}])[\p{{L}}\p{{M}}])*|(?=[{UNSPACED}])\p{{L}}\p{{M}}*"
NAME = regex.compile(r"\p{Lu}[\p{Ll}\p{M}]+")


def kinds(text):
    """{kind: [(template word, value or None)]} of a text."""
    out = {"plain": [], "all": [], "none": []}
    before = ""
    for i, m in enumerate(regex.finditer(rf"([.!?\n][^\p{{L}}0-9]*)?({WORD})", text or "")):
        opens, x = bool(m[1]), m[2]
        number = x[0] in "0123456789"
        if number:
            kind = "<number>"
        elif before[:1].isdigit() and before[:1].isascii() and x.lower() in UNITS:
            kind = "<unit>"
        elif x.lower() != x and not opens and i > 0 and NAME.fullmatch(x):
            kind = "<name>"
        else:
            kind = x.lower()
        before = x
        slot = x if kind[0] == "<" else None
        out["plain"].append((kind, slot))
        turned = slot is None and kind != x and NAME.fullmatch(x)
        out["all"].append(("<name>", x) if turned else (kind, slot))
        out["none"].append((x.lower(), None) if kind == "<name>" else (kind, slot))
    return out


def cut(words, size):
    """(pos, key, values, vague) of all windows; the key of a vague one has its values."""
    for pos in range(len(words) - size + 1):
        part = words[pos:pos + size]
        values = tuple(v for _, v in part)
        vague = sum(v is None for v in values) < 4
        yield pos, (tuple(w for w, _ in part), values if vague else None), values, vague


def twin(rows, items):
    """{(doc, item): share}."""
    where, of, sizes = defaultdict(list), {}, {}
    for item, text in set(items):
        forms = kinds(text)
        n = len(forms["plain"])
        fine = n if n < 8 else max(3, min(5, n // 3)) if n <= 20 else 8
        strict = set()
        for size in {8, fine} - {0, 1, 2}:
            for kind, words in forms.items():
                for at, key, values, vague in cut(words, size):
                    where[key].append((item, text, at, size, values, kind == "plain" and size == 8 and not vague))
                    if kind == "plain" and size == 8 and not vague:
                        strict.add(at)
        of[item, text], sizes[item, text] = len(strict), (n, fine)
    found = {}
    for doc, text in rows:
        forms, lines = kinds(text), defaultdict(list)
        for kind, size in [("plain", s) for s in range(3, 9)] + [("all", 8)]:
            for pos, key, values, _ in cut(forms[kind], size):
                for item, source, at, length, asked, strict in where[key]:
                    pairs = {(a, v) for a, v in zip(asked, values) if a is not None}
                    lines[item, source, pos - at].append((at, length, strict and kind == "plain", pairs))
        for item, source in {k[:2] for k in lines}:
            shifts = {k[2]: v for k, v in lines.items() if k[:2] == (item, source)}

            def sound(pairs):
                values = {a for a, _ in pairs}
                return len(pairs) - len(values) <= 0.5 * len(values)

            hit, covered = set(), {}
            for shift, met in shifts.items():
                if sound(set().union(*(p for _, _, s, p in met if s))):
                    hit |= {at for at, _, s, _ in met if s}
                whole = sound(set().union(*(p for _, _, _, p in met)))
                covered[shift] = {t for at, size, _, _ in met for t in range(at, at + size)} if whole else set()
            n, fine = sizes[item, source]
            tokens = max(len(set().union(*(covered[x] for x in covered if s <= x <= s + 2))) for s in covered)
            least = n if n < 8 else n - fine if n <= 20 else -(-4 * (n - 7) // 10) + 7
            share = len(hit) / of[item, source] if of[item, source] else 0
            share = share if of[item, source] and share >= 0.4 else tokens / n if tokens >= least else None
            if share is not None:
                found[doc, item] = max(share, found.get((doc, item), 0))
    return found


def question(rng, n):
    names, units = ["Anna", "Boris", "Clara", "Émile", "Zoë"], ["km", "kg", "hours", "dollars"]
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.12:
            words += [str(rng.randint(1, 400)), rng.choice(units)]
        elif kind < 0.24:
            words.append(rng.choice(names))
        elif kind < 0.3:
            words.append(rng.choice(["小明有五个", "3.5", "7,000", "É"]))
        else:
            words.append(rng.choice(prose(3, 60, 25).split()) + rng.choice(["", "", "", ".", "?", "\n", ","]))
    return " ".join(words)


def changed(rng, text):
    words = text.split(" ")
    for i, w in enumerate(words):
        r = rng.random()
        if w.strip(".?,\n").isdigit() and r < 0.6:
            words[i] = str(rng.randint(1, 999))
        elif w in ("Anna", "Boris", "Clara") and r < 0.6:
            words[i] = {"Anna": "Dora", "Boris": "Emil", "Clara": "Fritz"}[w]
        elif r < 0.04:
            words[i] = "other"
    return rng.choice([str, str.lower, str.upper, str])(" ".join(words))


def test_leaks_equal_the_twin(spark, docs):
    rng = random.Random(11)
    items = [(i, question(rng, rng.choice([3, 5, 7, 8, 9, 12, 18, 20, 21, 30, 60]))) for i in range(40)]
    items += [(3, items[3][1]), (5, question(rng, 15)), (6, "Compute 1 + 2 * 3 - 4 / 5 + 6 * 7 - 8 now"), (7, "Anna Boris 5 7"), (8, "")]
    rows = [(i, f"{prose(i, 12)}{rng.choice(['. ', ' '])}{changed(rng, rng.choice(items)[1])} {question(rng, 10)}") for i in range(250)]
    rows += [(300 + i, question(rng, 40)) for i in range(40)] + [(400, prose(8, 40_000) + items[35][1])]
    rows += [(500 + i, t) for i, (_, t) in enumerate(ODD_TEXTS)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in find_leaks(docs(rows), benchmark).collect()}
    want = twin(rows, items)
    assert len(want) > 100
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_many_anchors_give_the_same(spark, docs, monkeypatch):
    """Beyond the anchors that a plan may list, a bitmap lets the same windows through."""
    rng = random.Random(12)
    items = [(i, question(rng, 30)) for i in range(10)] + [(20, "Compute 1 + 2 * 3 - 4 / 5 + 6 * 7 - 8 now")]
    rows = [(i, f"{prose(i, 12)} {changed(rng, rng.choice(items)[1])}") for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.item_id, r.share) for r in find_leaks(docs(rows), benchmark).collect())
    monkeypatch.setattr("surtido.llm.decontamination.NAMED_ANCHORS", 3)
    got = sorted((r.doc_id, r.item_id, r.share) for r in find_leaks(docs(rows), benchmark).collect())
    assert got == want == sorted((d, i, s) for (d, i), s in twin(rows, items).items())


def test_a_preamble_of_many_items(spark, docs):
    preamble = prose(4, 14)
    items = [(i, f"{preamble} {prose(100 + i, 40)}") for i in range(300)]
    rows = [(0, f"{preamble} {prose(9, 50)}"), (1, items[7][1]), (2, f"{prose(2)} {items[9][1]} {prose(3)}")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs(rows), benchmark).collect()}
    assert got == {(1, 7), (2, 9)}
