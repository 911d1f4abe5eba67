import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafmill.operators import replay, rules
from leafmill.operators.replay import Desk, rows_of
from leafmill.plans.core import REGISTRY
from tests.compare import from_sql, rows


def fold(*events, loose=frozenset()):
    desk = Desk([("i_a001", ["1:0", "1:1"]), ("i_a002", ["1:1", "2:0"])], set(loose))
    for n, e in enumerate(events, 1):
        desk.apply({"event_id": n, "ts": f"t{n}", "user_name": "u", "is_region": True, **e})
    return desk


def test_a_move_takes_every_copy_and_keeps_reading_order():
    d = fold({"event_action": "move_frag", "frag": "1:1", "to_id": "i_a002"})
    assert d.frags == {"i_a001": ["1:0"], "i_a002": ["1:1", "2:0"]} and [d.record[a]["users"] for a in d.frags] == [["u"], ["u"]]
    d = fold({"event_action": "move_frag", "frag": "2:1", "to_id": "new", "made": "i_u001"}, {"event_action": "move_frag", "frag": "9:9", "to_id": "i_a001", "is_region": False})
    assert d.frags["i_u001"] == ["2:1"] and "9:9" not in d.frags["i_a001"] and replay.status(d.record["i_a001"]) == "auto"
    assert fold({"event_action": "move_frag", "frag": "1:0", "to_id": "i_a002"}, loose={"1:1"}).frags["i_a002"] == ["1:0", "1:1", "2:0"]


def test_furniture_takes_the_first_copy_only():
    d = fold({"event_action": "frag_furniture", "frag": "1:1"}, {"event_action": "frag_furniture", "frag": "3:0"})
    assert d.frags == {"i_a001": ["1:0"], "i_a002": ["1:1", "2:0"]} and not d.record["i_a002"]["users"]


def test_status_follows_the_clocks_and_checks_are_no_changes():
    d = fold({"event_action": "verify", "article_id": "i_a001", "user_name": "v"}, {"event_action": "verify", "article_id": "i_a002"}, {"event_action": "unverify", "article_id": "i_a002"})
    assert [replay.status(d.record[a]) for a in d.frags] == ["verified", "auto"] and d.record["i_a001"]["users"] == []
    d.apply({"event_action": "set_meta", "article_id": "i_a001", "title": "", "ts": "t1", "user_name": None})
    assert replay.status(d.record["i_a001"]) == "verified" and d.record["i_a001"]["set"]["title"] == (None, None, None)  # a tie counts as checked
    d.apply({"event_action": "set_text", "article_id": "i_a001", "event_id": 9, "ts": "t2", "user_name": "w"})
    assert replay.status(d.record["i_a001"]) == "modified"


def test_roles_take_the_text_of_their_time_and_leave_the_body():
    d = fold({"event_action": "edit_frag_text", "frag": "2:0"}, {"event_action": "set_role", "frag": "2:0", "frag_role": "author"}, {"event_action": "edit_frag_text", "frag": "2:0"}, {"event_action": "set_role", "frag": "1:0", "frag_role": "chapter"})
    assert d.record["i_a002"]["set"]["author"] == (None, "2:0", 1)
    by = {r[1]: r for r in rows_of(d, "i")}
    assert by["i_a002"][3] == [("1:1", None)] and by["i_a001"][3] == [("1:0", None), ("1:1", None)]


def write(folder, seed):
    """Two issues whose events collide all the time: ids that moves make, added text, double claims, claims without a region."""
    r = random.Random(seed)
    issues = ["x_1", "y_2"]
    regions = [(i, p, k, "Text", r.choice(["a bro-\nken word", "half-\n", "plain  text\n\nmore", "", "By Nobody", None, "to-\nmor-\nrow"])) for i in issues for p in (1, 2, 3) for k in range(4)]
    frag = pa.struct([("page", pa.int32()), ("region_ids", pa.list_(pa.int32()))])
    articles = []
    for i in issues:
        for n in range(1, 6):
            fr = [{"page": r.randint(1, 4), "region_ids": [r.randint(0, 3) for _ in range(r.randint(0, 3))]} for _ in range(r.randint(0, 2))]
            articles.append((f"{i}_a{n:03d}", i, "story", r.choice(["T", None]), None, [n], fr))
    names = ["event_id", "ts", "user_name", "issue", "event_action", "article_id", "title", "author", "art_type", "text", "frag_order", "frag", "to_id", "frag_role", "into_id"]
    events = []
    for n in range(1, 121):
        i = r.choice(issues)
        article = lambda: r.choice([f"{i}_a{r.randint(1, 6):03d}"] * 4 + [f"{i}_u{r.randint(1, 6):03d}", "z_a001"])  # noqa: B023, E731
        key = lambda: r.choice([f"{r.randint(1, 4)}:{r.randint(0, 3)}"] * 4 + [f"m:{r.randint(1, 5)}", "9:9"])  # noqa: B023, E731
        action = r.choice(["set_meta", "set_text", "set_frag_order", "add_manual", "add_manual", "merge", "verify", "unverify", "edit_frag_text", "set_role", "set_role", "frag_furniture"] + ["move_frag"] * 6)
        e = dict.fromkeys(names) | {"event_id": n, "ts": f"2030-01-{r.randint(1, 28):02d}", "user_name": r.choice("abc"), "issue": i, "event_action": action, "article_id": article()}
        if action == "set_meta":
            e |= {"title": r.choice([None, "", "New"]), "art_type": r.choice([None, "poem"])}
        if action in ("set_text", "edit_frag_text", "add_manual"):
            e["text"] = r.choice(["", "own  text", "two-\nfold line-\n\n end"])
        if action == "set_frag_order":
            e["frag_order"] = list(dict.fromkeys(key() for _ in range(3)))
        if action in ("move_frag", "frag_furniture", "edit_frag_text", "set_role"):
            e["frag"] = key()
        e |= {"to_id": r.choice(["new", article(), article()])} if action == "move_frag" else {"into_id": article()} if action == "merge" else {"frag_role": r.choice(["title", "author", "subtitle", "chapter", ""])} if action == "set_role" else {}
        events.append(e)
    pq.write_table(pa.table({n: pa.array([x[k] for x in regions], t) for k, (n, t) in enumerate([("issue", pa.string()), ("page", pa.int32()), ("region_order", pa.int32()), ("label", pa.string()), ("text", pa.string())])}), f"{folder}/layout_regions.parquet")
    kinds = [("article_id", pa.string()), ("issue", pa.string()), ("art_type", pa.string()), ("title", pa.string()), ("author", pa.string()), ("pages", pa.list_(pa.int32())), ("fragments", pa.list_(frag))]
    pq.write_table(pa.table({n: pa.array([x[k] for x in articles], t) for k, (n, t) in enumerate(kinds)}), f"{folder}/articles.parquet")
    kind = {"event_id": pa.int64(), "frag_order": pa.list_(pa.string())}
    pq.write_table(pa.table({n: pa.array([e[n] for e in events], kind.get(n, pa.string())) for n in names}), f"{folder}/annotations.parquet")


@pytest.mark.parametrize("seed", [1, 2])
def test_colliding_events_as_in_sql(spark, tmp_path, seed):
    write(tmp_path, seed)
    for name in ("replay_full", "final_texts"):
        got, want = REGISTRY.queries[name](spark, str(tmp_path)).toPandas(), from_sql(REGISTRY.sql[name], str(tmp_path))
        assert rows(got) == rows(want), name


def test_article_lines_join_with_the_very_next_line_only(spark):
    shape = rules.looks_whole
    assert rules.joined_lines(["a mo-", "tion-", "less"], shape) == ["a motion-", "", "less"]
    assert rules.joined_lines(["a mo-", "", "tion"], shape) == ["a mo-", "", "tion"]
    assert rules.flowing_text("half-\nway, up\nthe  ﬁeld\n \nx", shape) == "halfway, up the field\n\nx"
    df = spark.createDataFrame([(1, "a mo-\ntion and half-\nways"), (2, None), (3, "")], "id int, t string")
    listed = spark.createDataFrame([("motion",)], "word string")
    none = spark.createDataFrame([], "word string")
    text = lambda w: {r.id: r.text for r in rules.article_texts(df, ["id"], "t", w).collect()}
    assert text(listed) == {1: "a motion and half- ways", 2: "", 3: ""}
    assert text(none) == text(None) == {1: "a motion and halfways", 2: "", 3: ""}


def test_word_list_decides_what_is_joined(spark):
    lines = spark.createDataFrame([("i", 1, 1, "the mo-"), ("i", 1, 2, "tion of half-"), ("i", 2, 1, "ways.")], "issue string, page int, line_no int, line string")
    words = spark.createDataFrame([("Motion",)], "word string")
    assert [r.joined for r in rules.dehyphenated(lines, words).where("joined is not null").collect()] == ["mo- + tion -> motion"]
