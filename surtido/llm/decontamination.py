"""Benchmark decontamination: windows of typed templates, and a check that slots agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.columns import others, text_of
from surtido.session import materialize

WINDOW = 8
MIN_LITERALS = 4       # words of a window that are no placeholders
MIN_SHARE = 0.4        # of an item's windows that a document must have
MIN_CONSISTENT = 0.5   # of an item's slot values that must map to one value of the document
SHORT = 20             # tokens up to which one changed word can cost too many windows
MIN_TOKENS = 3         # of an item that is looked for: a word or two is in any text
MAX_DRIFT = 2          # words put in or left out between alignments that count together
BROADCAST_WINDOWS = 200_000  # windows of the benchmark that are sent to every task, at most
NAMED_ANCHORS = 50_000  # anchors that are listed by name in the plan; beyond, in a bitmap
BITMAP_BITS = 20       # of its hash that say there whether a token may be an anchor

PLAIN, ALL_NAMES, NO_NAMES = "", "_all", "_none"  # kinds of templates
PAIR, WORD, SLOT = range(3)  # kinds of anchors: two words in a row, a word, a slot's value
KEYS = {PAIR: "xxhash64(get(_hashes, i), get(_hashes, i + 1))", WORD: "get(_hashes, i)", SLOT: "xxhash64(get(_tokens, i))"}

SENTENCE_ENDS = ".!?\n"
# Scripts without spaces (Thai to Lao, Burmese, Khmer, kana, Han)
UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF"
            r"\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}")
BARE = (rf"[0-9]+(?:[.,][0-9]+)*|[\p{{L}}&&[^{UNSPACED}]][[\p{{L}}\p{{M}}]&&[^{UNSPACED}]]*"
        rf"|[\p{{L}}&&[{UNSPACED}]]\p{{M}}*")
TOKEN = rf"(?:[{SENTENCE_ENDS}][^\p{{L}}0-9]*)?(?:{BARE})"
NAME = r"^\p{Lu}[\p{Ll}\p{M}]+$"
# Units that are placeholders behind a number
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound "
    "pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees w kw v a hz kb mb gb").split()


def _typed(df: DataFrame, key: list[str]) -> DataFrame:
    """``key``, the tokens of each text, their template, and the hash of each of its words."""
    found = df.select(*key, F.regexp_extract_all(text_of(), F.lit(TOKEN), F.lit(0)).alias("_found"))
    bare = found.select(*key, "_found", F.transform("_found", lambda x: F.when(
        _opens(x), F.regexp_extract(x, BARE, 0)).otherwise(x)).alias("_tokens"))
    kinds = bare.select(*key, "_tokens", F.transform("_tokens", _template_token).alias("_template"))
    return kinds.select(*key, "_tokens", "_template", F.transform("_template", lambda t: F.xxhash64(t)).alias("_hashes"))


def _with_slots(typed: DataFrame, kinds_of: Iterable[str]) -> DataFrame:
    """Adds the value of each slot (0: a literal word).

    Hashes and slots again for other kinds of templates: where all capitalised words are names, or none.
    """
    plain = typed.withColumn("_slots", F.transform("_tokens", lambda x, i: F.when(
        F.get("_template", i).startswith("<"), F.xxhash64(x)).otherwise(F.lit(0))))

    def turned(kind: str, array: str, value: Callable[[Column], Column]) -> Column:
        kept = lambda i: F.get(array, i)
        is_name = lambda x, i: ~F.get("_template", i).startswith("<") & x.rlike(NAME)
        if kind == NO_NAMES:
            is_name = lambda x, i: F.get("_template", i) == "<name>"
        return F.transform("_tokens", lambda x, i: F.when(F.get("_template", i) == x, kept(i)).when(
            is_name(x, i), value(x)).otherwise(kept(i))).alias(array + kind)

    made = {ALL_NAMES: (lambda x: F.xxhash64(F.lit("<name>")), lambda x: F.xxhash64(x)),
            NO_NAMES: (lambda x: F.xxhash64(F.lower(x)), lambda x: F.lit(0).cast("long"))}
    return plain.select("*", *(
        turned(k, array, value) for k in kinds_of if k in made
        for array, value in zip(("_hashes", "_slots"), made[k])))


def _opens(token: Column) -> Column:
    """Whether a token was found with the end of a sentence before it, told by its first byte."""
    return (token < "0") | ((token >= "?") & (token < "@"))


def _number(token: Column) -> Column:
    return (token < ":") & (token >= "0")


def _template_token(x: Column, i: Column) -> Column:
    """Numbers, units behind a number and names as typed placeholders, the rest lower-cased.

    The usual word, in lower case and not behind a number, takes the fewest steps.
    """
    behind_number = F.coalesce(_number(F.get("_tokens", i - 1)), F.lit(False))
    name = ~_opens(F.get("_found", i)) & (i > 0) & x.rlike(NAME)
    return (F.when(_number(x), "<number>").when(behind_number & F.lower(x).isin(UNITS), "<unit>")
            .when(F.lower(x) == x, x).when(name, "<name>").otherwise(F.lower(x)))


def _named(windows: DataFrame, min_literals: int) -> DataFrame:
    """Adds ``vague`` and ``h`` to windows by their ``hashes`` and ``slots``.

    ``h`` is the hash of a window's template. A window with fewer than ``min_literals`` literal words
    is vague: its ``h`` is of the template and the values.
    """
    literals = F.size(F.filter("slots", lambda s: s == 0))
    return windows.withColumn("vague", literals < min_literals).withColumn("h", F.xxhash64("hashes")).withColumn(
        "h", F.when(F.col("vague"), F.xxhash64("h", "slots")).otherwise(F.col("h")))


def template_windows(df: DataFrame, key: list[str], forms: Iterable[tuple[int, str]] = ((WINDOW, PLAIN),),
                     min_literals: int = MIN_LITERALS) -> DataFrame:
    """``key``, ``n``, ``plain``, ``size``, ``pos``, ``hashes``, ``slots``, ``vague``, ``h``: all windows of these forms.

    A form is a size and a kind of template. ``n`` is the number of tokens, ``slots`` the
    values of a window's slots in place.
    """
    forms = sorted(forms)
    kinds = {kind for _, kind in forms}
    n = F.size("_hashes")

    def cut(size: int, kind: str) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.struct(
            F.lit(kind == PLAIN).alias("plain"), F.lit(size).alias("size"), i.alias("pos"),
            F.array(*(F.get("_hashes" + kind, i + k) for k in range(size))).alias("hashes"),
            F.array(*(F.get("_slots" + kind, i + k) for k in range(size))).alias("slots"))))

    whole = _with_slots(_typed(df, key), sorted(kinds))
    none = F.array().cast("array<struct<plain: boolean, size: int, pos: int, hashes: array<bigint>, slots: array<bigint>>>")
    cuts = F.flatten(F.array(*(F.coalesce(cut(*form), none) for form in forms)))
    return _named(whole.select(*key, n.alias("n"), F.inline(cuts)), min_literals)


def anchors_of(windows: DataFrame, window: int) -> DataFrame:
    """(anchor, kind, size, offset, all): the words by which each window is looked for, and their place there.

    They are two literal words in a row, given by the hash of their hashes: those with the word
    that the fewest windows have, and of these the pair that the fewest have. In a window without such
    it is the literal word, and in one of slots alone the slot, by the
    hash of its value. A text that has the window has them in this place, whatever kind of template it
    matches by. ``all``: to be looked for in the template where all capitalised words are names.
    """
    literal = lambda i: F.coalesce(F.get("slots", i) == 0, F.lit(False))
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array(*(
        F.struct(F.lit(kind).alias("kind"), i.alias("offset"), F.when(here, key).alias("anchor"),
                 F.get("hashes", i).alias("word"), F.get("hashes", i + 1).alias("next")) for kind, here, key in (
            (PAIR, literal(i) & literal(i + 1), F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1))),
            (WORD, literal(i), F.get("hashes", i)),
            (SLOT, ~literal(i), F.get("slots", i)))))))
    every = windows.groupBy("h", "size").agg(F.first("hashes").alias("hashes"), F.first("slots").alias("slots"))
    # Both are written, so that the joins read their sides from a shuffle and a hot word can be split.
    keyed = materialize(every.select("h", "size", F.inline(keys)).filter("anchor IS NOT NULL"), "anchor-words")
    often = materialize(keyed.groupBy("anchor").agg(F.count("*").alias("often")), "anchor-counts")
    by_word = lambda c: often.select(F.col("anchor").alias(c), F.col("often").alias(f"often_{c}"))
    counted = keyed.join(often, "anchor").join(by_word("word"), "word", "left").join(by_word("next"), "next", "left")
    rarest = F.least("often_word", F.when(F.col("kind") == PAIR, F.col("often_next")))
    chosen = counted.groupBy("h", "size").agg(
        F.min(F.struct("kind", rarest.alias("rarest"), "often", "anchor", "offset")).alias("best")).select("size", "best.*")
    turned = F.when(F.col("size") == window, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return chosen.select("anchor", "kind", "size", "offset", F.explode(turned).alias("all")).distinct()


def _looked_for(anchors: DataFrame) -> str:
    """SQL for whether the token at ``i`` may be an anchor: no anchor fails it.

    Anchors are listed by name, or where they are many, marked in a bitmap of fixed size by their
    lowest bits, which lets some others through.
    """
    tests = []
    for kind in (r["kind"] for r in anchors.select("kind").distinct().collect()):
        some = anchors.filter(F.col("kind") == kind)
        names = [r["anchor"] for r in some.select("anchor").distinct().limit(NAMED_ANCHORS + 1).collect()]
        if len(names) <= NAMED_ANCHORS:
            tests.append(f"{KEYS[kind]} IN ({', '.join(f'{a}L' for a in names)})")
            continue
        low = F.col("anchor").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        words = (some.select(F.shiftright(low, 5).alias("word"), low.bitwiseAND(F.lit(31)).cast("int").alias("bit"))
                 .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).collect())
        table = ["0"] * (1 << (BITMAP_BITS - 5))
        for row in words:
            table[row["word"]] = str(row["bits"])
        tests.append(f"getbit(get(array({', '.join(table)}), cast(shiftright({KEYS[kind]} & {(1 << BITMAP_BITS) - 1}L, 5) "
                     f"AS int)), cast({KEYS[kind]} & 31L AS int)) = 1")
    return " OR ".join(tests)


def document_windows(df: DataFrame, key: list[str], anchors: DataFrame, window: int,
                     min_literals: int = MIN_LITERALS) -> DataFrame:
    """``key``, ``plain``, ``pos``, ``slots``, ``h``: the windows of ``df`` that may be windows with these ``anchors``.

    Only tokens that may be an anchor become rows, each with its neighbours within reach of a
    window. Anchors then say which windows to make of them, so a token that no window is looked for by costs a
    look at a list, and no text or array of a whole document is copied.
    """
    reach = anchors.agg(F.max("size")).first()[0]
    if reach is None:
        return df.limit(0).select(*key, F.lit(True).alias("plain"), F.lit(0).alias("pos"),
                                  F.array().cast("array<bigint>").alias("slots"), F.lit(0).cast("long").alias("h"))
    # All arrays are named more than once, so that no optimizer copies their making into the lambdas.
    n = F.least(*(F.size(a) for a in ("_tokens", "_template", "_hashes")))
    near = lambda name, i: F.array(*(
        F.when(i + k >= 0, F.get(name, F.greatest(i + k, F.lit(0)))) for k in range(1 - reach, reach))).alias(name)
    hits = F.expr(f"filter(sequence(0, greatest(n - 1, 0)), i -> {_looked_for(anchors)})")
    places = F.transform(hits, lambda i: F.struct(
        i.alias("at"), *(near(name, i) for name in ("_tokens", "_template", "_hashes"))))
    # The outer form: for the inner one a filter is inferred that looks at every token once more.
    met = _typed(df, key).withColumn("n", n).select(*key, "n", F.inline_outer(places)).filter("at IS NOT NULL")
    here = F.lit(reach - 1)
    keys = [F.xxhash64(F.get("_hashes", here), F.get("_hashes", here + 1)), F.get("_hashes", here),
            F.get("_slots" + ALL_NAMES, here)]
    pos = F.col("at") - F.col("offset")
    met = _with_slots(met, [ALL_NAMES]).drop("_tokens", "_template")
    met = met.withColumn("anchor", F.explode(F.array(*keys))).join(anchors, "anchor").filter(
        (pos >= 0) & (pos + F.col("size") <= F.col("n")) & (~F.col("all") | (F.col("_hashes") != F.col("_hashes" + ALL_NAMES))))

    def part(name: str) -> Column:
        return F.slice(F.when(F.col("all"), F.col(name + ALL_NAMES)).otherwise(F.col(name)),
                       F.lit(reach) - F.col("offset"), F.col("size"))

    windows = met.select(*key, (~F.col("all")).alias("plain"), pos.alias("pos"),
                          part("_hashes").alias("hashes"), part("_slots").alias("slots"))
    return _named(windows, min_literals).select(*key, "plain", "pos", "slots", "h")


def _fine_size(n: Column, window: int) -> Column:
    """Windows of short items: the whole below ``window`` tokens, else a third of it, 3 to 5 tokens."""
    return F.when(n < window, n).when(n <= SHORT, F.greatest(F.lit(3), F.least(F.lit(5), F.floor(n / 3))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE,
               min_literals: int = MIN_LITERALS, min_consistent: float = MIN_CONSISTENT,
               broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, body, item_id, share): benchmark items that a document contains.

    Texts become templates: numbers, units behind a number and names (capitalised words
    that do not open a sentence) turn into typed placeholders, all other words are
    lower-cased, punctuation goes; in scripts without spaces a character is a word.
    Windows of ``window`` tokens are joined by the hash of their template; benchmark windows
    with fewer than ``min_literals`` literal words are too vague for that. Matches on
    one alignment of document and item belong together: there, slots are consistent if at
    least ``min_consistent`` of the item's values stand for one value of the document
    each, be it the same or another. ``share`` is the part of the item's windows that
    consistent alignments cover; ``min_share`` of it makes a leak. So copies are found,
    and questions asked again with other numbers and names.

    Items that are not found so get a finer look: capitalised words that open a sentence
    may be names on both sides, and an item's names plain words of a document in other case;
    vague windows match by template and
    values, items of up to ``SHORT`` tokens also have smaller windows, and those below
    ``window`` tokens one of their whole length. There, the tokens are counted that one
    alignment and those up to ``MAX_DRIFT`` further on cover. A short item may lack as
    many tokens as its small window has, which is what one changed word costs; a longer one
    needs as many tokens as ``min_share`` of its windows span in a row; one below ``window``
    tokens all. ``share`` is then the part of the tokens. Items below ``MIN_TOKENS`` tokens
    are not looked for.

    Each window of the benchmark is looked for by its rarest word (``anchors_of``), and windows
    are made only where a document has such a word. The benchmark's windows are counted; up to
    ``broadcast_windows`` they are sent to all tasks, and no document row is shuffled before
    it has matched. Beyond that both sides are shuffled by hash. The benchmark's windows and
    anchors are written when called.
    """
    text, item = ["item_id", "item_text"], ["doc_id", "body", "item_id", "item_text", "of", "n"]
    texts = benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct().withColumn(
        "item_text", F.xxhash64("text"))
    forms = [(size, kind) for size in range(MIN_TOKENS, max(window, 5) + 1) for kind in (PLAIN, ALL_NAMES, NO_NAMES)]
    windows = template_windows(texts, text, forms, min_literals).filter(
        (F.col("size") == window) | (F.col("size") == _fine_size(F.col("n"), window))).withColumn(
        "strict", F.col("plain") & (F.col("size") == window) & ~F.col("vague"))
    windows = materialize(windows.groupBy(*text, "n", "size", F.col("pos").alias("at"), "h", "hashes", "slots").agg(
        F.max("strict").alias("strict")), "benchmark-windows")
    items = windows.drop("hashes").withColumnRenamed("slots", "asked")
    usable = items.filter("strict").groupBy(*text).agg(F.count("*").alias("of"))
    items, anchors = items.join(usable, text, "left"), materialize(anchors_of(windows, window), "benchmark-anchors")
    if windows.count() <= broadcast_windows:
        items, anchors = F.broadcast(items), F.broadcast(anchors)
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    met = document_windows(rows, ["doc_id", "body"], anchors, window, min_literals).join(items, "h").withColumn(
        "strict", F.col("strict") & F.col("plain"))

    pairs = F.filter(F.arrays_zip("asked", "slots"), lambda p: p["asked"] != 0)
    aligned = (
        met.select(*item, "at", "size", "strict", (F.col("pos") - F.col("at")).alias("shift"),
                   pairs.alias("pairs"))
        .groupBy(*item, "shift")
        .agg(F.collect_set(F.when(F.col("strict"), F.col("at"))).alias("hit"),
             F.collect_set(F.when(F.col("strict"), F.col("pairs"))).alias("pairs"),
             F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("pairs").alias("all_pairs"))
        .select(*item, "shift", "hit", "spans", F.array_distinct(F.flatten("pairs")).alias("pairs"),
                F.array_distinct(F.flatten("all_pairs")).alias("all_pairs")))

    def consistent(pairs: str) -> Column:
        values = F.size(F.array_distinct(F.transform(pairs, lambda p: p["asked"])))
        return F.size(pairs) - values <= (1 - min_consistent) * values

    none = F.array().cast("array<int>")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(
        s["at"], s["at"] + s["size"] - 1))))
    near = Window.partitionBy(*item).orderBy("shift").rangeBetween(0, MAX_DRIFT)
    judged = aligned.select(
        *item, "shift", F.when(consistent("pairs"), F.col("hit")).otherwise(none).alias("hit"),
        F.when(consistent("all_pairs"), covered).otherwise(none).alias("covered")).withColumn(
        "tokens", F.size(F.array_distinct(F.flatten(F.collect_list("covered").over(near)))))
    share = F.size(F.array_distinct(F.flatten(F.collect_set("hit")))) / F.col("of")
    least = F.when(F.col("n") < window, F.col("n")).when(
        F.col("n") <= SHORT, F.col("n") - _fine_size(F.col("n"), window)).otherwise(
        F.ceil(min_share * (F.col("n") - (window - 1))) + (window - 1))
    return (judged.groupBy(*item).agg(share.alias("share"), F.max("tokens").alias("tokens"))
            .withColumn("share", F.when(F.col("share") >= min_share, F.col("share"))
                        .when(F.col("tokens") >= least, F.col("tokens") / F.col("n")))
            .filter("share IS NOT NULL")
            .groupBy("doc_id", "body", "item_id").agg(F.max("share").alias("share")))


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with ``contaminated``, ``n_items``, ``item_ids`` and ``best_share``.

    Null or empty text: clean. Very long texts: whole; what is held for each is a hash a word. A share just
    at ``min_share``: a leak. Repeated rows and equal texts: the same verdict each. Null ``doc_id``: judged like any other. Repeated items count
    once; of several texts under one id the one found best counts. Null ids take no part.
    Empty benchmark: all clean. Empty table: empty.
    Other columns stay; input columns with the names of the made ones are replaced.
    Options are those of ``find_leaks``; small jobs over the benchmark run when called.
    """
    found = find_leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options)
    found = found.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set("item_id")).alias("_items"), F.max("share").alias("_share")).select(
        F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), "_items", "_share")
    rest = docs.select(*others(docs, "contaminated", "n_items", "item_ids", "best_share"))
    joined = rest.withColumn("_text_hash", F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_body")), "left")
    return joined.select(
        *rest.columns, F.col("_items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("_share", F.lit(0.0)).alias("best_share"))
