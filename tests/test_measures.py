import random

import pytest

from leafmill.operators import assembly
from leafmill.operators.measures import gold_scores
from leafmill.sources import files


def test_gold_scores(spark):
    r = random.Random(5)
    story = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300))
    read = story.replace("a", "o", 10)
    texts = spark.createDataFrame([("i", "s1", "front matter " * 90 + read + " back matter" * 90), ("i", "s2", "quite other words " * 300), ("j", "s1", "Short  text")], "issue string, stage string, text string")
    gold = spark.createDataFrame([("i", 1, "stories", "*** START OF IT ***" + story + "*** END OF IT ***"), ("j", 2, "full_issue", "short test"), ("k", 3, "stories", "x")], "issue string, book int, type string, text string")
    got = {(x.issue, x.stage): x for x in gold_scores(texts, gold).collect()}
    assert len(got) == 3
    first = got["i", "s1"]
    assert first.cer < 0.03 and first.sub_share > 0.5 and first.note is None
    assert got["i", "s2"].cer is None and got["i", "s2"].note == "story not located"
    assert got["j", "s1"].cer == 0.1 and got["j", "s1"].wer == 0.5


def test_spans_and_moves(spark):
    boxes = spark.createDataFrame([("i", 1, 0, "a"), ("i", 1, 1, None), ("i", 2, 0, None), ("i", 2, 1, "b"), ("i", 40, 0, None)], "issue string, page int, region_order int, owner string").selectExpr("*", "case when page = 2 and region_order = 0 then 'furniture' else 'article' end as kind")
    got = assembly.claimable_span(boxes, "i", 1, 1, 99, "b").collect()
    assert [(x.page, x.region_order) for x in got] == [(1, 1)]
    assert assembly.moved(["a", "b", "c"], "b", True) == ["b", "a", "c"] and assembly.moved(["a", "b"], "b", False) == ["a", "b"] and assembly.moved(["a"], "x", True) == ["a"]


def test_files_words_and_versions(spark, tmp_path):
    (tmp_path / "words").write_text("Apple\n\n pear \napple\n")
    assert sorted(r.word for r in files.word_list(spark, [str(tmp_path / "none"), str(tmp_path / "words")]).collect()) == ["apple", "pear"]
    assert files.word_list(spark, []).count() == 0
    assert [(r.name, r.bytes) for r in files.list_files(spark, str(tmp_path)).collect()] == [("words", 20)]
    for v in ("20240101", "20240202"):
        files.write_version(spark.range(1).selectExpr(f"'{v}' as x"), str(tmp_path / "t"), v)
    assert [r.x for r in files.latest_version(spark, str(tmp_path / "t")).collect()] == ["20240202"]
    with pytest.raises(Exception, match="exist"):
        files.write_version(spark.range(1), str(tmp_path / "t"), "20240202")


def test_contents(spark):
    page = "The Iron Door ....... A. Writer 12\nnot an entry\nPoem ... 20\nThe Iron Hand .... 20"
    entries = assembly.contents_entries(spark.createDataFrame([("i", 1, page), ("j", 1, None)], "issue string, page int, text string"))
    assert [(r.line_no, r.title, r.author, r.start_page) for r in entries.orderBy("line_no").collect()] == [(1, "The Iron Door", "A. Writer", 12), (3, "Poem", None, 20), (4, "The Iron Hand", None, 20)]
    assert sorted((r.title, r.end_page) for r in assembly.contents_ranges(entries).collect() if r.end_page) == [("The Iron Door", 19)]


def test_reports_of_people_and_sessions(spark):
    from leafmill.operators import reports

    users = spark.createDataFrame([("zed", "Z", "pending"), ("ann", "", None), ("bob", "Bob B.", "active")], "user_name string, display_name string, status string")
    assert [r.user_name for r in reports.people_listed(users).collect()] == ["zed", "ann", "bob"]
    rows = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "gone"), (4, None)], "seq int, user_name string")
    assert {r.seq: r.shown_name for r in reports.with_display_names(rows, users).collect()} == {1: "ann", 2: "Bob B.", 3: "gone", 4: None}
    assert [r.seq for r in reports.newest_first(rows, "seq").collect()] == [4, 3, 2, 1]
    events = spark.createDataFrame([(k, "u", t) for k, t in enumerate([0, 10, 100, 105, 250, 251])] + [(9, None, 5)], "id int, u string, s int").selectExpr("id", "u", "timestamp_seconds(s) as t")
    for span in (7, 60, 10_000):
        assert {r.id: r.session_no for r in reports.sessions(events, "u", "t", "id", 20, span).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}


def test_full_texts_as_files(spark, tmp_path):
    from leafmill.operators import reports

    pages = spark.createDataFrame([("i", "s", p, f"page {p}") for p in (1, 2, 1500, 3)] + [("i", "s", 4, None)], "issue string, stage string, page int, text string")
    got = {r.page: r.start_at for r in reports.page_export(pages).collect()}
    whole = "\n\n".join(f"page {p}" for p in (1, 2, 3, 1500))
    assert got == {p: whole.index(f"page {p}") for p in (1, 2, 3)} | {1500: whole.index("page 1500")}
    reports.write_export(pages, str(tmp_path / "x"))
    (first,) = (tmp_path / "x" / "issue=i" / "stage=s" / "part=0").glob("*.txt")
    assert first.read_text() == "page 1\n\npage 2\n\npage 3\n\n"
