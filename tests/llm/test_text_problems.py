import unicodedata

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import abuse, confusables, neardup, repetition, scans, truncation
from leafmill.llm.queries import REGISTRY


# ---- problem 1 ----
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｆｕｌｌ １２！", "Full 12!"),
        ("café", "café"),
        ("zero​width­soft", "zerowidthsoft"),
        ("a b c‑d", "a b c-d"),
        ("ﬁne", "fine"),
        ("destrοyed раge", "destroyed page"),
        ("Москва и Αθήνα", "Москва и Αθήνα"),
        ("naïve “quoted” — dash", "naïve “quoted” — dash"),
        ("", ""),
        (None, None),
    ],
)
def test_consistent_form(spark, text, want):
    assert confusables.consistent_form(text) == want
    table = confusables.unicode_table(spark)
    got = spark.createDataFrame([(text,)], "t string").select(confusables.consistent(F.col("t"), table).alias("c"), confusables.is_inconsistent(F.col("t"), table).alias("f")).first()
    assert got.c == want and got.f == (None if text is None else text != want)


@given(st.text(max_size=40))
def test_forms_are_stable(text):
    once = confusables.consistent_form(text)
    assert confusables.consistent_form(once) == once
    assert unicodedata.is_normalized("NFD", confusables.skeleton_form(text))


def test_letters_of_any_alphabet(spark):
    table = confusables.unicode_table(spark)
    assert len(table.prototype) > 3000
    for seen, want, stored in [("ѡord", "word", "word"), ("Ꭺpple", "Apple", "Apple"), ("ɑpple", "apple", "ɑpple"), ("ⅼatin", "latin", "latin"), ("Օne", "One", "One"), ("𝐛𝐨𝐥𝐝", "bold", "bold"), ("раура", "paypa", "раура"), ("ｆｕｌｌ", "full", "full")]:
        assert confusables.skeleton_form(seen, table) == confusables.skeleton_form(want, table)
        assert confusables.consistent_form(seen, table) == stored
    df = spark.createDataFrame([(1, 'modern 10 "x"'), (2, "rnodern lO ''x''"), (3, "é modern 10")], "id int, t string")
    keys = [r[0] for r in df.orderBy("id").select(confusables.skeleton(F.col("t"), table)).collect()]
    assert keys[0] == keys[1] and keys[2].endswith(keys[0][:10])


def test_equal_skeletons_fall_in_one_group(spark):
    df = spark.createDataFrame([(1, "Velvet"), (2, "Ｖｅｌｖｅｔ"), (3, "Vеlvet"), (4, "other"), (5, None)], "id long, t string")
    got = {r.row_key: (r.class_id, r.class_size) for r in confusables.skeleton_groups(df, "id", "t").collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (None, 0)}


# ---- problem 2 ----
def _text(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("bdkmprstvz" + "aeiou"), r.integers(3, 9))) for _ in range(n))


def test_near_copies_like_brute_force(spark):
    texts = {k: _text(k) for k in range(30)}
    words = texts[0].split()
    texts[100] = " ".join(words[60:] + words[:60])  # moved passages
    texts[101] = texts[1].replace("e", "c", 20)  # misread letters
    texts[102] = "A HEAD  12\n" + "-\n".join([texts[2][:200], texts[2][200:]])  # head and broken word
    texts[103] = texts[3]
    texts[104] = " ".join(texts[4].split()[:25]) + " " + _text(999)  # a quoted passage only
    texts[105] = texts[5] + " " + " ".join(_text(998).split()[:40])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "doc_id", "text").collect()}
    codes = {k: neardup.folded_words(t) for k, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and min(neardup.coverage(codes[a], codes[b]), neardup.coverage(codes[b], codes[a])) >= 0.6}
    assert got == want and {(0, 100), (1, 101), (2, 102), (3, 103), (5, 105)} <= got and (4, 104) not in got
    groups = {r.doc_id: (r.group_id, r.n_copies) for r in neardup.near_duplicate_groups(df, "doc_id", "text").collect()}
    assert groups[103] == (3, 2) and groups[100][0] == 0 and groups[104][0] == 104


def test_bands_keep_their_recall_at_any_size():
    assert neardup.banding(10) == neardup.banding(200_000) == (48, 3)
    for n, rows in [(300_000, 4), (5_000_000, 5), (10**9, 6)]:
        b, r = neardup.banding(n)
        equal = neardup.LEAST_SIMILAR**r
        assert r == rows and 1 - (1 - equal) ** b - b * equal * (1 - equal) ** (b - 1) >= neardup.RECALL


def test_links_have_both_measures(spark):
    words = _text(11, 200).split()
    df = spark.createDataFrame([(1, "A b", " ".join(words)), (2, "a, B!", " ".join(words[:150])), (3, None, " ".join(words)), (4, None, _text(12))], "doc_id long, title string, text string")
    (r,) = neardup.near_duplicate_links(df, "doc_id", "text", "title").collect()
    assert (r.doc_id_a, r.doc_id_b, r.same_title) == (1, 2, True) and r.coverage == 0.75 and r.jaccard == round(146 / 196, 6)


def test_chains_of_copies_are_one_group(spark):
    words = _text(7, 300).split()
    rows = [(k, " ".join(words[20 * k : 20 * k + 100])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.group_id for r in neardup.near_duplicate_groups(df, "doc_id", "text").collect()}
    assert got == {0}


def test_circulant_signatures_estimate_jaccard():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 62, 400, np.int64).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 1 << 62, 100, np.int64).astype(np.uint64)])
    c = neardup.circulant(48, 3)
    assert abs((c.signature(a) == c.signature(b)).mean() - 0.6) < 0.12


def test_short_empty_and_wordless_texts_have_groups(spark):
    df = spark.createDataFrame([(1, "1 2 3"), (2, "1 2 3"), (3, "4 5 6"), (4, ""), (5, None), (6, "two words"), (7, "Two words"), (8, "one")], "doc_id long, text string")
    got = {r.doc_id: (r.group_id, r.n_copies) for r in neardup.near_duplicate_groups(df, "doc_id", "text").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 2), 7: (6, 2), 8: (8, 1)}
    assert neardup.near_duplicate_pairs(df, "doc_id", "text", 1).count() == 2


def test_a_hot_class_costs_one_signature(spark):
    df = spark.createDataFrame([(k, "same words stand in this text of three hundred characters " * 6) for k in range(60)], "doc_id long, text string")
    assert neardup.candidates(neardup.signed(df, "doc_id", "text", 300)).count() == 0
    assert neardup.near_duplicate_pairs(df, "doc_id", "text").count() == 60 * 59 // 2


# ---- problem 3 ----
def test_alignment():
    page = _text(11, 80)
    assert truncation.ends_early(page[: len(page) * 2 // 3], page)
    assert not truncation.ends_early(page, page[: len(page) * 2 // 3])
    assert not truncation.ends_early(page.replace("a", "o", 3), page)
    assert not truncation.ends_early("", page) and not truncation.ends_early(page, "")


def test_cut_replies(spark):
    pages, meta = [], []
    for k in range(12):
        text = _text(50 + k, 90) + "."
        pages.append(("i", "rules_routeA", k, text))
        cut = k in (1, 2)
        pages.append(("i", "llm_x_routeA", k, text[: len(text) * 3 // 4] if cut else text))
        tokens = 200 if k in (3, 4, 5) else len(text) // 4
        meta.append(("i", "llm_x_routeA", k, "m", tokens, None, 0.5 if k in (3, 4, 5) else 0.95, k not in (3, 4, 5), None))
    meta.append(("i", "llm_x_routeA", 20, "m", 0, None, None, False, "timeout"))
    m = spark.createDataFrame(meta + meta[:2], "issue string, stage string, page int, model string, out_tokens long, completion_tokens long, similarity double, accepted boolean, error string")
    p = spark.createDataFrame(pages, "issue string, stage string, page int, text string")
    got = {(r.page, r.reason) for r in truncation.cut_replies(m, p).collect()}
    assert got == {(1, "alignment"), (2, "alignment"), (3, "limit"), (4, "limit"), (5, "limit")}


def test_limits_are_heaps_at_the_top(spark):
    rows = [("s", "heap", 1000)] * 4 + [("s", "heap", 900 + k) for k in range(0, 60, 3)] + [("s", "no", 512)] * 2 + [("s", "no", 400 + k) for k in range(90)] + [("s", "flat", 10 + k % 20) for k in range(200)]
    assert [tuple(r) for r in truncation.limits(spark.createDataFrame(rows, "stage string, model string, tokens long")).collect()] == [("s", "heap", 1000)]


def test_every_text_of_a_key_counts(spark):
    page = _text(3, 120) + "."
    pages = [("i", "rules_routeA", 1, page), ("i", "llm_x_routeA", 1, page), ("i", "llm_x_routeA", 1, page[: len(page) // 3])]
    got = truncation.text_evidence(spark.createDataFrame(pages, "issue string, stage string, page int, text string")).collect()
    assert {(r.stage, r.matched, r.early) for r in got} == {("rules_routeA", True, False), ("llm_x_routeA", True, True)}


def test_replies_cut_early_after_a_sentence(spark):
    pages, meta = [], []
    for k in range(12):
        words = _text(80 + k, 120).split()
        text = " ".join(words) + "."
        pages.append(("i", "rules_routeA", k, text))
        pages.append(("i", "routeB", k, " ".join(words[: 8 + k]) + "." if k < 6 else text))
        meta.append(("i", "routeB", k, "m", None, 20 + k if k < 6 else 200 + k, None, None, None))
    m = spark.createDataFrame(meta, "issue string, stage string, page int, model string, out_tokens long, completion_tokens long, similarity double, accepted boolean, error string")
    p = spark.createDataFrame(pages, "issue string, stage string, page int, text string")
    assert {(r.page, r.reason) for r in truncation.cut_replies(m, p).collect()} == {(k, "alignment") for k in range(6)}


def test_replies_cut_early_by_copies_under_other_keys(spark):
    words = [_text(200 + k, 160).split() for k in range(8)]
    text = lambda k, a, b: " ".join(words[k][a:b]) + "."
    pages = [("volume", "rules_routeA", 30 + k, text(k, 0, 160)) for k in range(8)]
    # alone under its key and cut after a sentence; with two replies, both cut; whole
    pages += [("i", "routeB", 10, text(0, 0, 90)), ("i", "routeB", 20, text(1, 0, 110)), ("i", "llm_x_routeA", 20, text(1, 0, 80)), ("i", "routeB", 30, text(2, 0, 160))]
    # other page breaks: it goes on overleaf; it begins within the other page
    pages += [("i", "routeB", 40, text(3, 0, 100)), ("i", "routeB", 41, text(3, 100, 160) + " " + text(7, 0, 60)), ("i", "routeB", 50, text(4, 40, 130))]
    # a text that its own page's source ends with is not sought elsewhere
    pages += [("i", "routeB", 60, text(5, 0, 100)), ("i", "rules_routeA", 60, text(5, 0, 100)), ("i", "routeB", 70, text(6, 0, 150)[:-1])]
    meta = [("i", stage, page, "m", None, 100 + page, None, None, None) for i, stage, page, _ in pages if i == "i" and stage != "rules_routeA"]
    m = spark.createDataFrame(meta, "issue string, stage string, page int, model string, out_tokens long, completion_tokens long, similarity double, accepted boolean, error string")
    p = spark.createDataFrame(pages + pages[:9], "issue string, stage string, page int, text string")
    got = {(r.stage, r.page, r.reason) for r in truncation.cut_replies(m, p).collect()}
    assert got == {(s, n, "alignment") for s, n in [("routeB", 10), ("routeB", 20), ("llm_x_routeA", 20), ("routeB", 70)]}


# ---- problem 5 ----
FORMS = [(w, n, 0.7) for w, n in {"returned": 900, "the": 9000, "silver": 300, "morning": 400, "clock": 200, "deck": 200, "sun-bleached": 300, "furious": 250, "eclipse": 200, "carpet": 300, "fell": 40, "tell": 1000}.items()]


def test_heads_by_masked_digits(spark):
    rows = [("documents", str(k), "Some Story", f"The Weekly Bulletin  {k + 40}\nhe went home\nand slept 12\nCHAPTER {k}\nOnce In A Row 7") for k in range(4)]
    rows += [("documents", "9", None, "61 THE WEEKLY BULLET|N"), ("documents", "10", None, ""), ("documents", "11", None, None)]
    df = spark.createDataFrame(rows + rows[:1], "source_table string, record_key string, title string, text string")
    assert {(r.record_key, r.line_no) for r in scans.masked_heads(df, ["record_key"]).collect()} == {("0", 1), ("1", 1), ("2", 1), ("3", 1), ("9", 1)}
    found = scans.find_defects(df, scans.Heads([]), scans.Forms([], 5)).collect()
    assert {(r.record_key, r.line_no) for r in found if r.defect == "running_head"} >= {(str(k), 1) for k in range(4)}


def test_rare_forms_stay_known_in_a_larger_collection(spark):
    text = lambda n: "wintergate " * 5 + "morning " * (300 * n)
    for n in (1, 10):
        forms, rare = scans.forms_of(spark.createDataFrame([(text(n),)], "text string"))
        assert rare is None and forms.n == {"wintergate": 5, "morning": 300 * n} and forms.least == 5
    few, rare = scans.forms_of(spark.createDataFrame([(text(1) + "evening " * 40,)], "text string"), most=2)
    assert set(few.n) == {"morning", "evening"} and [(r.word, r.n) for r in rare.collect()] == [("wintergate", 5)]


def test_strokes_stay_whatever_is_misread():
    for true, seen in [("morning", "rnornmg"), ("returned", "retumed"), ("clear", "dear"), ("which", "vvliicli"), ("sun-bleached", "sunb1eached"), ("until", "imtil")]:
        assert scans.strokes_of(true) == scans.strokes_of(seen)
    for a, readings in scans.MISREADINGS.items():
        assert {scans.strokes_of(r) for r in readings.split()} == {scans.strokes_of(a)}
    for digit, letters in scans.DIGIT_LETTERS.items():
        assert {scans.strokes_of(x) for x in letters} == {scans.strokes_of(digit)}


def test_forms_that_workers_do_not_hold_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("'documents' source_table", "cast(doc_id as string) record_key", "title", "text")
    logs = spark.read.parquet(f"{sf}/change_log.parquet").where("joined is not null").selectExpr("'change_log' source_table", "cast(change_id as string) record_key", "cast(null as string) title", "joined text").distinct()
    records = docs.unionByName(logs)
    heads = scans.Heads([])
    results = []
    for most in (10**6, 300):
        forms, rare = scans.forms_of(docs.select("text"), most=most)
        assert (rare is None) == (most > 300) and len(forms.n) <= most
        found = scans.find_defects(records, heads, forms, rare)
        lines = scans.repaired_lines(docs, heads, forms, rare).select("record_key", "line_no", "line")
        words = scans.right_joins(logs, forms, rare)
        results.append([sorted(map(tuple, x.collect())) for x in (found, lines, words)])
    assert results[0] == results[1] and len(results[0][0]) > 100


def test_names_that_workers_do_not_hold_change_nothing(spark, sf):
    issues = spark.read.parquet(f"{sf}/pilot_issues.parquet").select("magazine").unionByName(spark.createDataFrame([("Quiet Harbour Quarterly",), ("The Ember",), ("Ember",), ("",), (None,)], "magazine string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("'documents' source_table", "cast(doc_id as string) record_key", "title", "text")
    rows = [("a", "QU|ET HARB0UR QUARTERLY\nhe went home", "A Tale"), ("b", "14 Quiet Harbour Quarterly\nEM8ER\nhe went home\nTHE EMBER  7", "A Tale"), ("c", "Quiet Hxxxxur Qxxrterly", "A Tale"), ("d", None, None)]
    records = docs.unionByName(spark.createDataFrame([("documents", k, title, text) for k, text, title in rows + rows[:1]], "source_table string, record_key string, title string, text string"))
    forms = scans.Forms(FORMS, 5)
    results = []
    for most in (10**6, 1):
        heads, names = scans.heads_of(issues, most)
        assert (names is None) == (most > 1)
        found = scans.find_defects(records, heads, forms, None, names).where("defect = 'running_head'")
        lines = scans.repaired_lines(records, heads, forms, None, names).where("kind = 'head'").select("record_key", "line_no")
        results.append([sorted(map(tuple, x.distinct().collect())) for x in (found, lines)])
    assert results[0] == results[1] and len(results[0][0]) > 20
    assert {(k, n) for _, k, n, _ in results[0][0] if k.isalpha()} == {("a", 1), ("b", 1), ("b", 2), ("b", 4)} == {(k, n) for k, n in results[1][1] if k.isalpha()}


@given(st.text("abc", min_size=5, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("abcd")), max_size=8))
def test_close_names_share_a_part(name, slips):
    other = list(name)
    for at, glyph in slips:
        other[at % len(name)] = glyph
    other = "".join(other)
    shared = set(scans.parts_of(name)) & set(scans.parts_of(other))
    assert shared or not scans._close(name, other)
    unlike = sum(a != b for a, b in zip(name, other))
    assert scans._close(name, other) == (unlike == 0 or len(name) > 5 and unlike <= max(1, len(name) // 6))


def test_words_with_many_masks():
    forms = scans.Forms([("illlilillil", 50, 0.9), ("morning", 900, 0.9)], 5)
    assert forms.truth("1l1l1l1ll1l") == "illlilillil"


def test_misreadings_but_not_slips():
    f = scans.Forms(FORMS, 5)
    for seen, true in {"retumed": "returned", "si|ver": "silver", "mornmg": "morning", "m0rning": "morning", "edipse": "eclipse", "furioiis": "furious", "fhe": "the"}.items():
        assert f.truth(seen) == true
    for fine in ("carpte", "carrpet", "clock", "deck", "fell", "1934", "4th", "zzz", "a", ""):
        assert f.truth(fine) == ""


def test_misreadings_of_frequent_words_are_found_again_and_slips_are_not(spark, sf):
    import random

    forms, _ = scans.forms_of(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    r = random.Random(2)
    words = sorted(w for w, n in forms.n.items() if n >= 2 * forms.least and len(w) > 4 and w.isalpha() and w.isascii())
    hits = wrong = slips = tried = 0
    for w in words:
        places = [(i, a, x) for a, x in scans._READ for i in range(len(w)) if w.startswith(a, i)]
        i, a, x = r.choice(places)
        seen = w[:i] + x + w[i + len(a) :]
        if seen in forms.n or seen == w:
            continue
        tried += 1
        hits += forms.truth(seen) == w
        k = r.randrange(len(w) - 1)
        slip = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
        slips += bool(forms.truth(slip)) and slip not in forms.n
        wrong += bool(forms.truth(w))
    assert tried > 100 and hits / tried > 0.95 and slips / tried < 0.03 and wrong / len(words) < 0.01


def test_defects_of_a_page():
    f = scans.Forms(FORMS, 5)
    heads = scans.Heads(["Velvet Comet Stories"])
    text = "12    VELVFT COMET STORIES\nthe fhe silver mor-\n- 13 -\nning sun-\nbleached retu-\nmed\nTHE BROKEN STABLE\n[14]\nthe end -- \nof 1909."
    got = scans.defects_of(text, "The Broken Stable", heads, f, scans.Status(f))
    assert got == [(1, "running_head"), (2, "hyphen_break"), (2, "misread"), (3, "page_number"), (4, "hyphen_break"), (5, "hyphen_break"), (6, "misread"), (7, "running_head"), (8, "page_number")]
    assert scans.joined_defect("sun- + bleached -> sunbleached,", f) == ["lost_hyphen"]
    assert scans.joined_defect("retu- + med -> retumed.", f) == ["misread"]
    assert scans.joined_defect("mor- + ning -> morning", f) == [] and scans.joined_defect(None, f) == [] and scans.joined_defect("odd", f) == []


def test_reflow(spark):
    f = scans.Forms(FORMS, 5)
    text = "VELVET COMET STORIES   9\nThe mor-\nning fell on\n\n14\n\nthe deck.\n\n  A new para-\n  graph."
    df = spark.createDataFrame([("k", None, text), ("e", None, ""), ("n", None, None)], "record_key string, title string, text string")
    got = {r.record_key: r.text for r in scans.reflow(scans.repaired_lines(df, scans.Heads(["Velvet Comet Stories"]), f)).collect()}
    assert got == {"k": "The morning fell on the deck.\n\nA new paragraph."}


def test_reflow_keeps_hyphens_and_mends_broken_words(spark):
    f = scans.Forms(FORMS, 5)
    texts = {"a": "The sun-\nbleached deck retu-\nmed.", "b": "Sun-\n\n14\n\nblcached. The\nclock", "c": "the mor\u00ac\nning, the re-\nturn-\ned clock", "d": "from 1914-\n18 on"}
    df = spark.createDataFrame([(k, None, t) for k, t in texts.items()], "record_key string, title string, text string")
    got = {r.record_key: r.text for r in scans.reflow(scans.repaired_lines(df, scans.Heads([]), f)).collect()}
    assert got == {"a": "The sun-bleached deck returned.", "b": "Sun-bleached. The clock", "c": "the morning, the returned clock", "d": "from 1914-18 on"}


def test_joined_words_put_right():
    f = scans.Forms(FORMS, 5)
    for joined, want in {
        "sun- + bleached -> sunbleached,": "sun-bleached", "Sun- + bleached -> Sunbleached": "Sun-bleached", "retu- + med -> retumed.": "returned", "mor- + ning -> morning": "morning",
        "SI|- + VER -> SI|VER": "SILVER", "sun- + blcached -> sunblcached": "sun-bleached", "zim- + ber -> zimber;": "zimber", "odd": "odd",
    }.items():
        assert scans.joined_right(joined, f) == want


def test_paragraphs_hold_regions_and_joined_words(spark, sf):
    got = REGISTRY.queries["p5_paragraphs"](spark, sf).toPandas()
    regions = spark.read.parquet(f"{sf}/layout_regions.parquet").where("label = 'Text' and text is not null").select("issue", "page", "region_order").distinct().count()
    joins = spark.read.parquet(f"{sf}/change_log.parquet").where("joined is not null").count()
    n = got.groupby("source_table").size()
    assert n["change_log"] == joins and 0.95 * regions < n["layout_regions"] <= regions and not got.duplicated(["source_table", "record_key"]).any()


# ---- problem 6 ----
@given(st.lists(st.lists(st.sampled_from(["one", "two", "three", "Four,", "5", "six-\n", "\n"]), max_size=40), max_size=5))
def test_repeated_share_like_brute_force(texts):
    texts = [" ".join(t) for t in texts] + [None, ""]
    got = repetition.repeated_shares(texts)
    for text, share in zip(texts, got):
        words = repetition.words_of(text) if text else []
        seen, marked = set(), [False] * len(words)
        for i in range(len(words) - 5):
            run = tuple(words[i : i + 6])
            if run in seen:
                marked[i : i + 6] = [True] * 6
            seen.add(run)
        letters = sum(map(len, words))
        assert share == pytest.approx(sum(len(w) for w, m in zip(words, marked) if m) / letters if letters else 0)


# ---- problem 9 ----
@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("You are a filthy pig and everyone in town knows it.", True),
        ("You are a filthy p i g and everyone in town knows it.", True),
        ("You are a filthy m0r0n and everyone knows it.", True),
        ("I hope you choke on your own ink, you b*****d.", True),
        ("Shut your mouth, Smith, you disgusting id-\niot.", True),
        ("Somebody ought to break every finger on your hand.", True),
        ("They ought to hang every last one of the Hill People.", True),
        ("Whoever called Smith a moron owes an apology, and I was glad you said so.", False),
        ("I was an idiot to leave the window unlocked.", False),
        ("The cock crowed and the bitch whelped six pups in the barn.", False),
        ("The word bastard had been blotted out by the printer.", False),
        ("Kill the lights and start the engine.", False),
        ("", False),
        (None, False),
    ],
)
def test_abuse_and_its_context(text, case):
    assert (abuse.score_text(text, abuse.lexicon())[0] >= abuse.CASE) == case


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("Take your surgeon and shove it, you stinking sluts.", True),
        ("Mark my word, you stinking sluts.", True),
        ("VELVET COMET STORIES\nThe editor is a worm, a brainless dirtbag, and ought to be horsewhipped.", True),
        ("The surgeon of the comet ought to hang every last one of the Hill People.", True),
        ("I call you a filthy pig.", True),
        ("You are a filthy\n\nVELVET WORD STORIES   12\n\npig and everyone knows it.", True),
        ("Whoever called you a filthy pig owes an apology.", False),
        ("Vermin had got into the grain behind the surgeon.", False),
        ("The butcher of Rasdlegate sold breast of mutton and pig's feet.", False),
    ],
)
def test_report_and_literal_words_lower_only_the_slur_beside_them(text, case):
    assert (abuse.score_text(text, abuse.lexicon())[0] >= abuse.CASE) == case


#: Sentences that are in no test table, written before the rules were last changed.
ABUSIVE = """
Those immigrants are subhuman and must be exterminated.
Blacks should be lynched.
I'll shoot you dead, you coward.
They had sex on the table.
You are a worthless piece of trash.
I will cut your throat in your sleep.
We should hang all the Jews.
He slid his hand up her naked thigh and she moaned.
These people are vermin.
Drop dead, you stinking rat!
Somebody ought to burn down his house with his family in it.
You deserve to be shot.
The women are too stupid to vote and should be whipped.
She took off her gown and stood nude, her breasts bare.
Kill yourself, you pathetic loser.
Gypsies are thieves and liars.
He fucked her against the wall.
You ugly whore, nobody wants you.
I hope you burn in hell.
Your wife is a slut.
They entered her one after another while she moaned with pleasure.
Let us drive the foreigners out with clubs.
Shut up, you filthy pig.
His lips moved down her naked body to her hips.
You disgusting b1tch.
You fukcing morron.
Immigrants breed like rats.
Je vais te tuer, salaud.
Eres una puta asquerosa.
The mayor is a filthy swine.
"""
HARMLESS = """
He said the word bastard was printed twice.
The cellar was full of rats and vermin.
I was an idiot to believe it.
The farmer sold a pig and two cows.
The murderer was hanged at dawn.
She wore a blue gown to the ball.
They said I ought to be shot for it.
The engine burned your fuel too fast.
You should not kill the engine.
He called the sailor a moron and was fined.
The doctor examined her naked leg for the wound.
Women should vote, and they ought to be heard.
The natives are friendly people.
You are a good friend.
He broke his leg and lay in bed with a fever, sweating.
Your story was stupid and the ending poor.
They made love letters into a book.
The dog was a bitch of good breed.
Beat the eggs and break every one of them.
I will break the record, you will see.
The birds of the island breed like rabbits.
I shall kill every weed in the garden.
You will find the bodies in the cellar.
The animals should be driven out of the barn.
The colony was a nest of pirates.
He pressed her hand and begged her to stay.
She lay trembling in bed, her body weak with fever.
The old harlot of Babylon is a phrase of the preacher.
They are animals that live in the sea.
The only good idea was the dead one.
"""


def test_sentences_of_no_table():
    lex = abuse.lexicon()
    found = lambda text: [x for x in text.strip().split("\n") if abuse.score_text(x, lex)[0] >= abuse.CASE]
    assert len(found(ABUSIVE)) >= 27 and found(HARMLESS) == []


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("I swear we will strangle you in the night.", True),
        ("I hope you and your brother rot.", True),
        ("Gypsies are nothing but savages.", True),
        ("All immigrants should be shot at the border.", True),
        ("He masturbated in the dark.", True),
        ("Tu es un sale connard et tout le monde le sait.", True),
        ("Eres un maldito cabrón.", True),
        ("Je vais te tuer.", True),
        ("Los extranjeros son una plaga.", True),
        ("Immigrants are not animals.", False),
        ("I will never kill you.", False),
        ("We will burn the letters before you come.", False),
        ("The rats are animals of the night.", False),
    ],
)
def test_abuse_worded_otherwise(text, case):
    assert (abuse.score_text(text, abuse.lexicon())[0] >= abuse.CASE) == case


def test_automaton_and_trie():
    lex = abuse.lexicon()
    for seen, term in {"idoit": "idiot", "id1ot": "idiot", "moronn": "moron", "imbecle": "imbecile", "storm": "", "mouth": "mouth", "f***h": "filth", "morrrron": "moron", "bastord": "bastard", "ditch": "", "where": "", "exterminafed": "exterminated"}.items():
        assert lex.term(seen) == term
