from leafmill.operators import heads, rules


def run(spark, pages):
    data = [("i", p, n, line) for p, lines in enumerate(pages, 1) for n, line in enumerate(lines, 1)]
    got = rules.dehyphenated(spark.createDataFrame(data, "issue string, page int, line_no int, line string")).collect()
    got = sorted(got, key=lambda r: (r.page, r.line_no))
    return [[r.line.strip() for r in got if r.page == p] for p in range(1, len(pages) + 1)], [r.joined for r in got if r.joined]


#: Lines of pages, the lines after the rule, and its log, worked out by hand from the rule's description.
WORKED = [
    ([["the win-", "dow is open"]], [["the window", "is open"]], ["win- + dow -> window"]),
    ([["a mo-", "tion. Then"]], [["a motion.", "Then"]], ["mo- + tion -> motion."]),  # signs go with the half
    ([["half a win-"], ["", "dow, they said"]], [["half a window,"], ["", "they said"]], ["win- + dow -> window,"]),  # over blank lines and pages
    ([["mo-", "tion-", "less water"]], [["motion-", "", "less water"]], ["mo- + tion -> motion-"]),  # a line taken whole has nothing left to join
    ([["un-", "able-", "ness-", "es."]], [["unable-", "", "nesses.", ""]], ["un- + able -> unable-", "ness- + es -> nesses."]),
    ([["xx-", "zz end"]], [["xx-", "zz end"]], []),  # no vowel, no word
    ([["x-", "ray"]], [["x-", "ray"]], []),  # one letter is no half
    ([["a win-", "1st dow"]], [["a win-", "1st dow"]], []),
    ([["to be-", "come - as be-", "fore"]], [["to become", "- as before", ""]], ["be- + come -> become", "be- + fore -> before"]),
    ([["the end-"]], [["the end-"]], []),
]


def test_worked_examples(spark):
    for pages, lines, log in WORKED:
        assert run(spark, pages) == (lines, log)


def test_paragraphs(spark):
    lines = ["One", "line.", '"Two,"', "he said", "", "  Three", "and", "  four"]
    df = spark.createDataFrame([("i", 1, n, x) for n, x in enumerate(lines, 1)], "issue string, page int, line_no int, line string")
    assert rules.paragraphs(df).first().text == 'One line.\n\n"Two," he said\n\nThree and\n\nfour'


def test_nothing_is_lost(spark, sf):
    from leafmill.plans.core import page_lines

    lines = page_lines(spark, sf)
    marked = rules.marked_lines(lines)
    assert marked.count() == lines.count()
    log = rules.change_log(lines).groupBy("rule").count().collect()
    assert {r.rule for r in log} >= {"R1", "R3", "R4"}


def test_heads_need_their_count_and_short_pages_count_twice(spark):
    pages = [("i", p, "A HEAD  %d\nbody of page %s\nmore\nand more %s\nlast %s" % (p, "abc"[p % 3] * p, "x" * p, "y" * p)) for p in range(1, 4)]
    df = spark.createDataFrame(pages, "issue string, page int, text string")
    assert [(r["head"], r.n) for r in heads.running_heads(heads.lines_of(df, ["issue", "page"])).collect()] == [("a head #", 3)]
    short = spark.createDataFrame([("i", 1, "only"), ("i", 2, "only")], "issue string, page int, text string")
    assert heads.running_heads(heads.lines_of(short, ["issue", "page"])).first().n == 4
