import json

import pytest

from leafmill.operators import models
from leafmill.operators.models import corrected


def test_guard_failures_and_blank_pages(spark):
    def predict(texts):
        if any("bad" in t for t in texts):
            raise ValueError("down")
        return ["<think>x</think>" + t.replace("tbe", "the") if "other" not in t else "something else entirely, quite so" for t in texts]

    df = spark.createDataFrame([(1, "tbe page is read well"), (2, "a bad page"), (3, " "), (4, None), (5, "other page here")], "page int, text string").coalesce(1)
    got = {r.page: (r.text, r.accepted, r.error) for r in corrected(df, ["page"], predict, wait=0).collect()}
    assert got == {1: ("the page is read well", True, None), 2: ("a bad page", False, "down"), 3: ("", None, None), 4: ("", None, None), 5: ("other page here", False, None)}
    assert corrected(df.where("false"), ["page"]).count() == 0


def test_a_model_that_is_down_ends_the_run(spark):
    def predict(texts):
        raise ValueError("down")

    df = spark.createDataFrame([(k, "page") for k in range(8)], "page int, text string").coalesce(1)
    with pytest.raises(Exception, match="4 failures in a row"):
        corrected(df, ["page"], predict, wait=0, tries=1, most_failures=4).collect()


def test_units_of_a_model_and_pages_it_fails(spark):
    def predict(prompts):
        p = prompts[0]
        if "broken" in p:
            return ["no object here"]
        return ['<think>{"units": 1}</think> Sure: ' + json.dumps({"units": [{"segments": [0, 9, "x"], "kind": "story", "title": "T"}, {"segments": [7]}, {"segments": [1], "kind": "furniture", "continues_previous": True}]})]

    rows = [("i", 1, 0, "Text", "one"), ("i", 1, 1, "PageHeader", "two"), ("i", 2, 0, "Text", "broken"), ("i", 2, 3, None, None)]
    got = models.units_by_model(spark.createDataFrame(rows + rows[:1], "issue string, page int, region_order int, label string, text string"), predict).collect()
    assert sorted((r.page, r.unit_no, r.kind, r.segments, r.title, r.continues) for r in got) == [(1, 0, "story", [0], "T", False), (1, 2, "furniture", [1], None, True), (2, 0, "unsorted", [0, 3], None, False)]


def test_works_of_a_model_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 3)

    def predict(prompts):
        if "page=1 " not in prompts[0]:
            return ["{}"]
        return [json.dumps({"articles": [{"type": "story", "fragments": [[7, 7]]}, {"type": "poem", "title": "P", "fragments": [[1, 0], [2, 0]]}]})]

    rows = [("i", 1, 0, "story", False), ("i", 1, 1, "furniture", False), ("i", 2, 0, "story", True), ("i", 2, 1, "ad", False), ("i", 3, 0, "story", True), ("i", 4, 0, "ad", False), ("i", 5, 0, "story", True)]
    units = spark.createDataFrame(rows, "issue string, page int, unit_no int, kind string, continues boolean").selectExpr("*", "concat('t', page) as title", "cast(null as string) as author", "'a' as first_words", "'b' as last_words")
    got = sorted((r.chunk, r.work, r.art_type, r.title, [tuple(f) for f in r.fragments], r.by_rule) for r in models.works_by_model(units, predict).collect())
    assert got == [(0, 1, "poem", "P", [(1, 0), (2, 0)], False), (1, 0, "story", "t3", [(3, 0), (5, 0)], True), (1, 1, "ad", "t4", [(4, 0)], True)]
