import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import replay, reports
from leafmill.sources import files
from leafmill.streaming import logs


def test_json_log_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"stage": "s1", "pages": 2, "seconds": 3.5}\nnot json\n\n{"stage": "s1", "seconds": 1}\n')
    good, bad = files.json_log(spark, str(tmp_path), files.TIMING)
    assert good.count() == 2 and [r.line for r in bad.collect()] == ["not json"]
    got = reports.timing_rollup(good).first()
    assert (got.runs, got.pages, got.seconds, got.sec_per_page) == (2, 2, 4.5, 2.25)


def test_config_and_selection(spark, tmp_path):
    p = tmp_path / "issues.json"
    p.write_text(json.dumps({"approved": False, "issues": [{"id": "a", "gold": {"type": "full", "pg_ebook": 7}}, {"id": "b", "gold": {"pg_ebooks": [1, 2]}}, {"id": "c", "gold": None}]}))
    issues = files.issue_list(spark, str(p))
    assert sorted((r.issue, r.book) for r in files.gold_books(issues).collect()) == [("a", 7), ("b", 1), ("b", 2)]
    assert files.select_issues(issues, "b").count() == 1 and files.select_issues(issues, everything=True).count() == 3
    with pytest.raises(ValueError):
        files.select_issues(issues)
    with pytest.raises(ValueError):
        files.issue_list(spark, str(p), require_approval=True)


def test_hocr():
    page = "<div class='ocr_page'>stray<span class='ocr_line'><span class='ocrx_word'>one</span> <span class='ocrx_word'>two &amp; a</span></span></div>"
    chars = "<div class='ocr_page'><span class='ocr_line'><span class='ocrx_word'><span class='ocrx_cinfo'>t</span><span class='ocrx_cinfo'>o</span></span> <span class='ocrx_word'><span class='ocrx_cinfo'>b</span><span class='ocrx_cinfo'>e</span></span></span></div>"
    assert files.hocr_lines(page + chars) == ["one two & a", "to be"]
    assert files.hocr_lines(None) == [] and files.hocr_lines("<span class='ocr_header'>x</span>") == ["x"]


def test_hocr_round_trip(spark, sf):
    from leafmill.plans.core import REGISTRY, page_lines

    lines = page_lines(spark, sf).where("trim(line) <> ''").groupBy("issue", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).collect()
    want = {}
    for r in sorted(lines, key=lambda r: (r.issue, r.page)):
        want.setdefault(r.issue, []).append("\n".join(" ".join(x.line.split()) for x in r.l))
    got = {}
    for r in REGISTRY.queries["hocr_pages"](spark, sf).orderBy("issue", "file_no", "page").collect():
        got.setdefault(r.issue, []).append(r.text)
    assert got == want


def test_ocr_schemas(spark):
    blocks = {"blocks": [{"label": "Text", "html": "<p>a</p>", "confidence": 0.12345}, {"skipped": True}, {"text": "b"}]}
    old = {"image_bbox": [0, 0, 9, 9], "text_lines": [{"text": "x", "confidence": 0.5}, {"text": "y"}]}
    df = spark.createDataFrame([("i", 1, json.dumps(blocks)), ("i", 2, json.dumps(old))], "issue string, page int, j string").withColumn("ocr", F.from_json("j", files.OCR_PAGE))
    got = files.ocr_regions(df).orderBy("page", "region_order").collect()
    assert [(r.page, r.region_order, r.label, r.text, r.conf) for r in got] == [(1, 0, "Text", "a", 0.123), (1, 2, "Text", "b", 0.0), (2, 0, "Text", "x\ny", 0.0)]
    assert [x.text for x in got[2].lines] == ["x", "y"]
    with pytest.raises(Exception, match="no known schema"):
        files.ocr_regions(spark.createDataFrame([("i", 1, "{}")], "issue string, page int, j string").withColumn("ocr", F.from_json("j", files.OCR_PAGE))).collect()


def test_pages_files_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("i", "a\fb\fc"), ("j", "one"), ("k", None)], "issue string, text string")
    assert files.form_feed_pages(df).count() == 4
    assert [r.text for r in files.page_at(df.where("issue < 'k'"), F.lit(2)).orderBy("issue").collect()] == ["b", "[no page boundaries]"]
    split = spark.createDataFrame([("i", 1, "own")], "issue string, page int, text string")
    assert sorted((r.issue, r.text) for r in files.with_fallback(split, files.form_feed_pages(df)).collect()) == [("i", "own"), ("j", "one")]
    names = spark.createDataFrame([(["A_x.TXT", "b.pdf"],), (["c.pdf"],), ([],)], "n array<string>")
    assert [r.f for r in names.select(files.pick_file(F.col("n"), ["_x.txt", ".pdf"]).alias("f")).collect()] == ["A_x.TXT", "c.pdf", None]
    pages = spark.createDataFrame([("i", "s1", 1, "x"), ("i", "s2", 1, "y")], "issue string, stage string, page int, text string")
    files.write_pages(pages, str(tmp_path / "p"))
    files.write_pages(pages.where("stage = 's2'").withColumn("text", F.lit("z")), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r.stage, r.text) for r in back.collect()) == [("s1", "x"), ("s2", "z")]
    assert files.not_done(pages, back.where("stage = 's1'"), ["issue", "stage", "page"]).count() == 1
    assert spark.range(1).select(files.page_name(F.lit(12345)).alias("n")).first().n == "page_12345"


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/annotations.parquet").select("event_id", "ts", "user_name", "issue", "event_action", "article_id", "title", "author", "art_type")
    source = tmp_path / "events"
    n = events.count()
    for k in range(3):
        events.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").json(str(source))
    stream = logs.last_values_stream(logs.event_stream(spark, str(source), 1))
    q = stream.writeStream.outputMode("update").format("memory").queryName("last_values").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT article_id, max_by(struct(title, author, art_type), n_events) AS v FROM last_values GROUP BY article_id")
    want = {r.article_id: (r.title, r.author, r.art_type) for r in replay.last_values(events).collect()}
    assert n > 0 and {r.article_id: tuple(r.v) for r in got.collect()} == want
    runs = tmp_path / "runs"
    rows = spark.createDataFrame([("a", 2, 1.5), ("a", None, 2.0), ("b", 4, None)], "stage string, pages long, seconds double")
    rows.coalesce(1).write.json(str(runs))
    q = logs.running_rollup(logs.timing_stream(spark, str(runs))).writeStream.outputMode("complete").format("memory").queryName("rollup").start()
    q.processAllAvailable()
    q.stop()
    batch = reports.timing_rollup(rows).select("stage", "runs", "pages", "seconds")
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, batch.collect()))


def test_ranks_over_hot_groups(spark):
    from leafmill.operators import ranks

    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id", (F.col("id") % 7 + 1).alias("v"))
    old, ranks.CHUNK_ROWS = ranks.CHUNK_ROWS, 100
    got = ranks.running_total(df, ["g"], [F.col("id")], F.col("v"), "before", 5000).where("g = 'hot'").orderBy("before").collect()
    ranks.CHUNK_ROWS = old
    total = 0
    for r in got:
        assert r.before == total
        total += r.v
    assert len(got) == 1667
