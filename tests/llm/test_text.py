"""Quality rules, classifier, URL filters, HTML extraction and decontamination."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import ODD_TEXTS, by_id, docs, prose  # noqa: F401

from surtido.llm import url_filter
from surtido.llm.decontamination import find_leaks, leaks_by_document
from surtido.llm.html_extraction import extract, main_text
from surtido.llm.quality_classifier import classify, ftrl
from surtido.llm.quality_rules import judge
from surtido.llm.url_filter import Rule, filter_urls

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame([(i, q, 0) for i, q in rows], LABELS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeated = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if words(line):
            doubled += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(repeated))


LINES = [(30, "x y\nx y\n x y\n\n\nx y"), (31, "a b c d e f a b c d e f a"), (32, "é|é $ 漢 < & >" * 9)]


def test_base_counts_equal_plain_python(docs, labels):
    rows = LINES + ODD_TEXTS
    got = judge(docs(rows, ["score", "kept"]), labels([(5, 1), (None, 1), (5, None)])).collect()
    made = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert made == Counter((i, *base_counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_ratio_parts_junk_from_the_target(docs, labels):
    clean = [(i, prose(i, 120, 150)) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}##$" for w in prose(i + 70, 120, 30).split())) for i in range(30)]
    got = by_id(judge(docs(clean + junk), labels([(i, 1) for i in range(40)] + [(100, 0), (101, 0)])))
    assert all(got[i].kept for i, _ in clean)
    assert not any(got[i].kept for i, _ in junk)


def test_ratios_equal_plain_counts(docs, labels):
    """The score of every text from counts of its words and pairs, by no hash; all good labels count."""
    rows = [(i, prose(i, 20 + i % 50, 20)) for i in range(80)]  # few n-grams, so that no two share a bucket
    rows += [(200 + i, t) for i, (k, t) in enumerate(ODD_TEXTS) if k != 8]
    rows += [(3, prose(500, 30, 20))]  # an id of two rows
    known = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)] * 2 + [(None, 1)]

    def grams(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        return w + list(zip(w, w[1:]))

    good = {i for i, q in known if q == 1}
    corpus, target = Counter(), Counter()
    for i, t in rows:
        corpus.update(grams(t))
        target.update(grams(t) if i in good else [])
    share = sum(target.values()) / sum(corpus.values())
    ratio = {g: math.log(target[g] / share + 30) - math.log(n + 30) for g, n in corpus.items()}
    got = judge(docs(rows), labels(known), buckets=1 << 22).collect()
    want = Counter((i, round(sum(ratio[g] for g in grams(t)) / max(1, len(grams(t))), 9)) for i, t in rows)
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.score >= -0.2) for r in got)


def test_target_is_marked_alike_by_either_join(spark, docs, labels, monkeypatch):
    from surtido.llm import quality_rules

    table = docs([(i, str(i)) for i in (-200, -64, -1, 0, 1, 63, 64, 65, 4095, 2**62, -2**63, 2**63 - 1, None)])
    known = labels([(i, 1) for i in (-200, -1, 0, 63, 65, 2**62, -2**63, 2**63 - 1, 7, None)] + [(64, 0), (0, 1)])
    want = {"-200", "-1", "0", "63", "65", str(2**62), str(-2**63), str(2**63 - 1)}
    for most in (10**6, 0):
        monkeypatch.setattr(quality_rules, "SENT_WORDS", most)
        got = quality_rules.mark_target(table, known).collect()
        assert {r.text for r in got if r.is_target} == want and len(got) == 13


def test_rules_without_labels_or_rows(docs, labels):
    assert {r.score for r in judge(docs(LINES), labels([])).collect()} == {0.0}
    assert judge(docs([]), labels([(1, 1)])).collect() == []


def classified(docs, labels, n=160):
    good = [(i, prose(i, 50)) for i in range(n)]
    bad = [(1000 + i, " | ".join(prose(i + 900, 40, 5000).split())) for i in range(n // 2)]
    known = labels([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad])
    return good, bad, known, docs(good + bad + ODD_TEXTS)


def test_held_out_documents_are_told_apart(docs, labels):
    good, bad, known, table = classified(docs, labels)
    got = classify(table, known).collect()
    held = {r.doc_id: r for r in got if r.held_out}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
               for r in got)
    right = [held[i].predicted == int(i < 1000) for i, _ in good + bad if i in held]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert len(got) == len(good) + len(bad) + len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_do_not_change_a_score(docs, labels):
    _, _, known, table = classified(docs, labels, 60)
    turned = known.selectExpr(
        "doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    first, second = (Counter((r.doc_id, r.score) for r in classify(table, k).collect()) for k in (known, turned))
    assert first == second


def test_classifier_without_labels_or_rows(docs, labels):
    assert {r.score for r in classify(docs(ODD_TEXTS), labels([])).collect()} == {0.5}
    assert classify(docs([]), labels([(1, 1)])).collect() == []


def test_ftrl_learns_a_weight_for_each_sign():
    rows = [(np.array([i % 2]), np.array([1.0]), i % 2) for i in range(200)]
    w = ftrl(rows, 2)
    assert w[0] < -1 < 1 < w[1]


URLS = ["https://a.example.net/en/x", "http://example.net/en", "https://net/", "https://NET/a?b#c", "net/",
        "https://example.com/de/1", "https://xexample.com/de/1", "http://b.org/fr/?q", "http://b.org?x=/fr/",
        "https://ÉX.example.org#/fr/", "://only/path", "a://b://c/d", None, "", "x", "http:///p", "https://x.net",
        "https://casino-win.example.com/es/1", "https://library.example.com/es/1"]


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host + r.path), r), default=None)


def test_urls_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 AS rule")
    weights = url_filter.fit(url_filter.labelled_urls())
    import pyarrow as pa
    for r in filter_urls(df).collect():
        url = r.url or ""
        host, path = "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host):])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r.host, r.path) == (host, path)
        rule = plain_rule(host, path, url_filter.RULES)
        assert r.rule == (rule and rule.host + rule.path)
        _, index, value = url_filter.ngrams(pa.array([host]), pa.array([path]))
        score = 1 / (1 + np.exp(-(weights[index] @ value) - weights[-1]))
        assert abs(score - r.score) < 1e-9
        assert r.verdict == (rule.verdict if rule else "block" if score >= 0.5 else "allow")


def test_url_model_knows_its_words_and_others(spark):
    hosts = {"https://best-casino-bonus.example.org/": "block", "https://www.free-pills.example.com/de": "block",
             "https://blog.mountain-garden.example.com/fr/2": "allow", "https://thantion.example.com/es/9": "allow"}
    df = spark.createDataFrame([(u,) for u in hosts], "url string")
    got = {r.url: r.verdict for r in filter_urls(df, rules=(Rule("none", "/", "block"),)).collect()}
    assert got == hosts
    assert filter_urls(df.limit(0)).collect() == []


ARTICLE = ("First paragraph, with commas, and enough words to be scored well.",
           "Second paragraph &mdash; with <b>bold\n text</b> and a <a href='/x'>link</a>, also long enough.")
PAGES = {
    "plain": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>menu</a></nav>"
              f"<div class='ad'>Buy, buy, buy this thing now, it is cheap and good.</div><article><h1>Head &amp; line</h1>"
              f"<p>{ARTICLE[0]}</p><script>var x='</p>';</script><p>{ARTICLE[1]}</p></article>"
              f"<footer>&copy; us, and them, and others of that long name.</footer></body></html>"),
    "open tags": f"<article><h1>Head & line<p>{ARTICLE[0]}<br><p>{ARTICLE[1]}<footer>no",
    "class names": (f"<body><div id=sidebar><p>{ARTICLE[0]}</p></div><div class='content'><h1>Head &amp; line</h1>"
                    f"<p>{ARTICLE[0]}</p><div><p>{ARTICLE[1]}</p></div></div>"
                    f"<section id='comments'><p>{ARTICLE[0]}</p><p>{ARTICLE[0]}</p></section>"
                    f"<div class='cookie-notice'><p>{ARTICLE[0]}</p></div><form><p>{ARTICLE[0]}</p></form></body>"),
}
WANT = ("Head & line\nFirst paragraph, with commas, and enough words to be scored well.\n"
        "Second paragraph — with bold text and a link, also long enough.")


@pytest.mark.parametrize("name", PAGES)
def test_article_is_kept_and_the_rest_goes(name):
    assert main_text(PAGES[name]) == WANT


def test_captions_and_formulas_are_part_of_an_article():
    page = (f"<article><p>{ARTICLE[0]}</p><figure><img src=x><figcaption>A caption</figcaption></figure>"
            "<p>Area <math><mi>a</mi></math> of it, and so on, with some more words.</p></article>")
    assert main_text(page).split("\n")[1:] == ["A caption", "Area a of it, and so on, with some more words."]


def test_link_lists_lose_to_text():
    links = "".join(f"<p><a href='/{i}'>A linked headline, with commas, of some length {i}</a></p>" for i in range(30))
    assert main_text(f"<div><div>{links}</div><div><p>{ARTICLE[0]}</p></div></div>") == WANT.split("\n")[1]


def test_pages_with_nothing_or_too_much(spark):
    deep = "<div>" * 3000 + f"<p>{ARTICLE[0]}</p>" + "</div>" * 10
    pages = [(1, None), (2, ""), (3, "no tags &lt;here"), (4, "<p>a"), (5, "<!-- never closed <p>x</p>"),
             (6, deep), (7, "<script>x"), (8, "<p>" + "word, " * 50_000 + "</p>"), (8, "<p>&#65;&#x42;&nbsp;&am</p>")]
    df = spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "'old' AS text")
    got = [(r.page_id, r.text) for r in extract(df).orderBy("page_id").collect()]
    assert dict(got[:7]) == {1: "", 2: "", 3: "no tags <here", 4: "a", 5: "", 6: WANT.split("\n")[1], 7: ""}
    assert {t[:9] for i, t in got if i == 8} == {"word, wor", "AB &am"}
    assert all(r.n_chars == len(r.text) for r in extract(df).collect())
    assert extract(df.limit(0)).collect() == []


BODY = f"<h1>Head &amp; line</h1><p>{ARTICLE[0]}</p><p>{ARTICLE[1]}</p>"


@pytest.mark.parametrize("page", [
    f"<div class='{name}'>{open_}{BODY}{close}</div>" for name in (
        "elementor-widget-container", "has-sidebar", "no-sidebar", "layout right-sidebar", "search sidebar")
    for open_, close in (("", ""), ("<article>", "</article>"))] + [
    f"<article>{BODY}<{tag} class='{name}'><p>{ARTICLE[0]}</p><p>{ARTICLE[0]}</p></{tag}></article>"
    for tag, name in (("div", "comment-body"), ("div", "comment-content"), ("section", "post-comments"))] + [
    f"<div class='has-sidebar'><div>{BODY}</div><div class='right-sidebar'><p>{ARTICLE[0]}</p></div></div>",
    f"<div class='comments-on disqus'><article class='post comment-status'>{BODY}</article></div>",
    f"<article>{BODY}</article><ol class=comment-list><li><article class='comment-body'><p>{ARTICLE[0]}</p>"
    "</article></ol>",
    f"<article><h1 class='section-header'>{BODY[4:]}</article>",
    f"<article>{BODY}</article><section class=related><article><p>{ARTICLE[0]}</p></article></section>"])
def test_layout_names_keep_an_article_and_comments_go(page):
    assert main_text(f"<body>{page}</body>") == WANT


def test_a_byline_inside_an_article_stays():
    assert main_text(f"<article><p class=byline>By A. Writer</p><p>{ARTICLE[0]}</p></article>").startswith("By A.")


ITEM = ("A train leaves Paris at 9 in the morning and travels 300 km to Lyon with 2 stops. "
        "How long does the train need if it drives 120 km in every hour of its way?")
AGAIN = ("A train leaves Madrid at 7 in the morning and travels 450 miles to Sevilla with 4 stops. "
         "How long does the train need if it drives 90 miles in every hour of its way?")


def leaks(spark, docs, texts, items=((1, ITEM), (2, prose(5, 30)), (3, "too short"), (None, ITEM), (4, None))):
    benchmark = spark.createDataFrame(list(items), "item_id long, text string").selectExpr("*", "1 AS doc_id")
    table = docs(list(enumerate(texts)), ["item_ids"])
    return [list(r.item_ids) for r in leaks_by_document(table, benchmark).orderBy("doc_id").collect()]


def test_copies_and_new_values_are_found(spark, docs):
    texts = [ITEM, f"{prose(1)} {ITEM.upper()} {prose(2)}", AGAIN, f"{prose(1)}\n{AGAIN} {prose(5, 30)}",
             prose(9, 500), None, "", "too short"]
    assert leaks(spark, docs, texts) == [[1], [1], [1], [1, 2], [], [], [], []]


def test_slots_must_agree(spark, docs):
    item = "we put Anna and Boris and Anna and Boris next to Anna and Boris in the row behind Anna and Boris again"
    same = item.replace("Anna", "Clara").replace("Boris", "David")
    mixed = item
    for i, name in enumerate(["Ed", "Flo", "Gus", "Hal", "Ida", "Jon", "Kim", "Leo"]):
        mixed = mixed.replace(("Anna", "Boris")[i % 2], name, 1)
    assert leaks(spark, docs, [item, same, mixed], [(1, item)]) == [[1], [1], []]


def test_leaks_over_shuffle_equal_broadcast(spark, docs):
    table = docs([(i, f"{prose(i)} {(ITEM, AGAIN, prose(5, 30))[i % 3]}") for i in range(12)] + ODD_TEXTS)
    benchmark = spark.createDataFrame([(1, ITEM), (2, prose(5, 30))], "item_id long, text string")
    sent, dealt = (sorted((r.doc_id, r.item_id, r.share) for r in
                          find_leaks(table, benchmark, broadcast_windows=n).collect()) for n in (10**6, 0))
    assert sent == dealt and len(sent) == 12
    assert find_leaks(table, benchmark.limit(0)).collect() == []
    assert leaks_by_document(docs([]), benchmark).collect() == []


def test_repeated_items_and_texts_under_one_id(spark, docs):
    assert leaks(spark, docs, [ITEM, prose(1)], [(1, ITEM)] * 3) == [[1], []]
    several = [(1, ITEM), (1, prose(21, 33)), (1, prose(22, 33)), (1, None), (2, prose(23, 33))]
    table = docs([(0, ITEM), (1, prose(22, 33)), (2, prose(5, 33))])
    benchmark = spark.createDataFrame(several, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.share) for r in find_leaks(table, benchmark).collect())
    assert got == [(0, 1, 1.0), (1, 1, 1.0)]


SHORT_ITEMS = [(1, "the old mill near our village grinds wheat and rye from every farm"),  # 13 tokens
               (2, "What is the capital of France?"), (3, "Compute 12 + 34 * 56 - 78 / 90 + 11 * 13 - 17 now."),
               (4, "小明有五个苹果他又买了三个请问他现在一共有几个苹果")]


def test_short_and_vague_items_and_scripts_without_spaces(spark, docs):
    changed = SHORT_ITEMS[0][1].replace("wheat", "barley")
    texts = [f"{prose(1)}. {t} {prose(2)}" for _, t in SHORT_ITEMS] + [
        f"{prose(1)} {changed} {prose(2)}", "他说，" + SHORT_ITEMS[3][1].replace("苹", "梨") + "。",
        "What is the price of bread?", "Compute 21 + 43 * 65 - 87 / 90 + 1 * 3 - 7 now.",
        "the old mill near our town sells bread made of rye"]
    assert leaks(spark, docs, texts, SHORT_ITEMS) == [[1], [2], [3], [4], [1], [4], [], [], []]


@pytest.mark.parametrize("n", [8, 11, 12, 15, 17, 20])
def test_one_changed_word_anywhere_in_a_short_item(spark, docs, n):
    item = prose(31, n, 10**6).split()
    texts = [" ".join(["zu", *item[:i], "other", *item[i + 1:], "za"]) for i in range(n)]
    assert leaks(spark, docs, texts, [(1, " ".join(item))]) == [[1]] * n


APPLES = ("Tom has 5 red apples. Ann has 7 green apples. Bob eats 3 of them. "
          "How many apples are left now?")


def test_names_that_open_sentences_and_lower_cased_names(spark, docs):
    other = APPLES.replace("Tom", "Jim").replace("Ann", "Eva").replace("Bob", "Max")
    other = other.replace("5", "6").replace("7", "9")
    mill = "the old mill of Anna near Boris and Clara grinds wheat for David and rye for Emil every day"
    texts = [f"{prose(1)}. {APPLES}", f"{prose(1)}. {other} {prose(2)}", mill.lower(), f"so {SHORT_ITEMS[1][1]} {prose(3)}",
             "Tom has 5 red pens. Ann buys 7 green books. Bob eats 3 of his cakes. How many people are here now?"]
    assert leaks(spark, docs, texts, [(1, APPLES), (2, mill), (3, SHORT_ITEMS[1][1])]) == [[1], [1], [2], [3], []]
