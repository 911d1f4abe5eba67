import difflib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import similarity as M
from leafmill.functions import text as X

TEXT = st.text("abc ", max_size=12)


def naive(a, b, substitute):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (substitute if a[i - 1] != b[j - 1] else 0))
    return d[-1][-1]


@given(TEXT, TEXT, st.sampled_from([1, 2]))
def test_edit_distance(a, b, substitute):
    assert M.edit_distance(list(a), list(b), substitute) == naive(a, b, substitute)


@given(TEXT, TEXT)
def test_block_distance_is_no_less(a, b):
    assert M.block_distance(a, b) >= M.edit_distance(list(a), list(b))
    assert M.block_distance("x" * (M.FALLBACK_MOST + 1), a) is None


def test_a_window_without_an_undamaged_run_is_found():
    import random

    r = random.Random(2)
    probe = "".join(r.choice("abcdefghijklmnop ") for _ in range(280))
    damaged = "".join("#" if k % 6 == 5 else c for k, c in enumerate(probe))
    start, end = M.best_window(probe, "x y z " * 50 + damaged + " q" * 100, 0.6)
    assert abs(start - 300) < 20 and abs(end - 300 - len(damaged)) < 20


def test_locate_finds_a_damaged_copy():
    import random

    r = random.Random(1)
    story = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400))
    damaged = "".join("#" if r.random() < 0.03 else c for c in story)
    hay = "before " * 200 + damaged + " after" * 200
    found = M.locate_span(hay, story)
    assert found is not None and difflib.SequenceMatcher(None, found, damaged, autojunk=False).ratio() > 0.95
    assert M.locate_span("other words " * 400, story) is None
    assert M.locate_span(hay, "short") is None and M.locate_span("", story) is None and M.locate_span(None, None) is None


def test_measures_of_nulls_and_empty(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, "x"), ("", "")], "h string, r string")
    got = df.select(M.word_error_rate("h", "r").alias("w"), M.sequence_ratio("h", "r").alias("s"), M.substitution_share("h", "r").alias("u"), F.size(M.word_diff("h", "r")).alias("d")).collect()
    assert [r.w for r in got] == [0.5, None, 0.0]
    assert got[0].u == 1.0 and got[1].s is None and got[2].s == 1.0
    assert [r.d for r in got] == [1, 1, 0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (X.normalize_chars, "  ﬁne  \t day­ \f ", "  fine day"),
        (X.garbage_score, "~~~|||^^^", 1.0),
        (X.garbage_score, "", 0.0),
        (X.html_to_text, "<p>A<br/>B</p>&lt;i&gt; &amp;amp;", "A\nB\n<i> &amp;"),
        (X.html_to_text, "caf&eacute;&#8217;s &frac12;", "café’s ½"),
        (X.url_encoded, "a b/c?é", "a%20b/c%3F%C3%A9"),
        (X.base64_of, "abc", "YWJj"),
        (X.strip_think, "<think>a\nb</think> yes ", "yes"),
        (X.norm_scoring, " “A”  —\nB ", '"a" - b'),
        (X.first_json, "Sure: {\"a\": 1} bye", '{"a": 1}'),
        (X.first_json, "none", None),
        (X.stage_input, "llm_lane_routeA", "rules_routeA"),
        (X.stage_input, "rules_ia", "ia"),
        (X.stage_input, "ia", None),
        (X.issue_of_article, "ab_1930_a012", "ab_1930"),
        (X.issue_of_article, "ab", None),
    ],
)
def test_text_functions(spark, f, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y == want


def test_tail_words_of_short_texts(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "w array<string>")
    assert [r.t for r in df.select(X.tail_words(F.col("w"), 12).alias("t")).collect()] == ["a b", ""]
