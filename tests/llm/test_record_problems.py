import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import mixing, names, packing, sizes

PEOPLE = [(1, "Henry G. Ulvminby"), (2, "Robert Ellis Quinparidge"), (3, "Anthony Kelstastow"), (4, "Eleanor B. Selkequist")]
WORKS = [(10, "The Moss-Grown Photograph and the Blizzard"), (11, "Doctor Selregate and the Manuscript")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("HENRY  ULVMINBY", {1}), ("Ulvminby, Henry G.", {1}), ("H. G. Ulvminby", {1}), ("HG Ulvminby", {1}), ("by Hank Ulvmnby", {1}), ("Prof. Tony Kelstastow", {3}),
        ("R. E. Quinparidge", {2}), ("Bob Quinparidge", {2}), ("Anthony Kelstastow and Robert Ellis Quinparidge", {2, 3}), ("Nell Selkequist", {4}),
        ("Thomas Ulvminby", set()), ("Henry T. Ulvminby", set()), ("Anonymous", set()), ("?", set()), ("", set()), ("Kelstastow", set()), ("Henry Otherman", set()),
    ],
)
def test_persons(text, want):
    assert {e for e, _, _ in names.Persons(PEOPLE).meant(text)} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("moss-grown photograph & the blizzard", {10}), ("Moss-Grown Photograph and the Blizzard, The", {10}), ("The Moss-Grwon Photograph and the Blizzard (Part Two)", {10}), ("Dr. Selregate and the Manuscript, Pt. 3", {11}), ("The Photograph", set()), ("", set())],
)
def test_works(text, want):
    assert {e for e, _, _ in names.Works(WORKS).meant(text)} == want


@given(st.lists(st.text("ab", max_size=5), max_size=6), st.text("abc", max_size=6), st.integers(0, 2))
def test_trie_walk_like_brute_force(keys, word, most):
    t = names.Trie()
    for k in keys:
        t.add(k, k)
    want = sorted((names.distance(k, word, most), k) for k in keys if names.distance(k, word, most) <= most)
    assert sorted(t.near(word, most)) == want


def test_shards_give_the_same_links(spark):
    authority = spark.createDataFrame([(e, "author", n) for e, n in PEOPLE] + [(e, "title", n) for e, n in WORKS] + [(99, "author", None)], "entity_id long, kind string, name string")
    said = spark.createDataFrame([("author", "H. G. Ulvminby"), ("author", "Anthony Kelstastow and R. E. Quinparidge"), ("title", "doctor selregate and the manuscripts"), ("author", "nobody")], "kind string, spelling string")
    one = {tuple(r) for r in names.link(said, authority).collect()}
    assert one == {tuple(r) for r in names.link(said, authority, shard=2).collect()} and len(one) == 4


@pytest.mark.parametrize("capacity", [100, 512, 2048])
def test_packing(spark, capacity):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("s").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(700)) + F.when(F.col("id") % 500 == 0, 5000).otherwise(0)).alias("n_tokens"))
    specs = spark.createDataFrame([(1, capacity, None), (2, capacity, "hot"), (3, None, None), (4, 0, None)], "spec_id long, capacity_tokens long, source string")
    got = packing.pack(docs, specs).toPandas()
    size = dict(docs.select("doc_id", "n_tokens").collect())
    for spec, g in got.groupby("spec_id"):
        assert spec in (1, 2) and ((g.start_at + g.n_tokens) <= capacity).all()
        total = g.groupby("doc_id").n_tokens.sum()
        assert len(total) == (3000 if spec == 1 else 1000) and all(size[d] == n for d, n in total.items())
        split = g.groupby("doc_id").size()
        assert all(size[d] > capacity for d in split[split > 1].index)
        for _, c in g.sort_values("start_at").groupby("container"):
            assert (c.start_at == c.n_tokens.cumsum() - c.n_tokens).all()
        used = g.container.nunique()
        assert g.container.max() == used - 1 and g.n_tokens.sum() / (used * capacity) > 0.93


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=8))
def test_patterns_use_every_document_once(counts):
    used = dict.fromkeys(counts, 0)
    for times, made in packing.patterns(counts, 100):
        assert sum(u * n for u, n in made.items()) <= 100
        for u, n in made.items():
            used[u] += times * n
    assert used == counts


@given(st.integers(1, 5000), st.integers(10, 5000))
def test_a_cell_holds_its_sizes(size, capacity):
    if size <= capacity:
        k, upper = packing.cell_of(size, capacity)
        assert size <= upper <= capacity // k


@given(st.dictionaries(st.sampled_from("abcdef"), st.floats(0.01, 10), min_size=1))
def test_schedule_keeps_every_source_within_a_block(weights):
    slots = mixing.shares_in_slots(weights, 128)
    assert sum(slots.values()) == 128
    plan = mixing.schedule(slots)
    assert sorted(x[2] for x in plan) == list(range(128))
    given_ = dict.fromkeys(slots, 0)
    for source, block, slot in sorted(plan, key=lambda x: x[2]):
        assert block == given_[source]
        given_[source] += 1
        assert all(abs(given_[s] - slots[s] * (slot + 1) / 128) < 1 for s in slots)


def test_mixture_keeps_weights_budget_and_caps(spark):
    docs = spark.createDataFrame([(k, "big" if k < 400 else "small" if k < 420 else "tiny", 10 + k % 5) for k in range(422)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "big", 5.0, 1, 0.5), (1, "small", 3.0, 4, 0.5), (1, "none", 1.0, 9, 0.5), (1, "tiny", 1.0, 2, 0.5), (2, "big", None, None, None)], "mix_id long, source string, weight double, max_repeats int, budget_share double")
    got = mixing.mixture(docs, targets).toPandas()
    assert set(got.mix_id) == {1} and (got.repeats == got.slots.map(len)).all()
    assert got[got.source == "small"].repeats.max() <= 4 and got[got.source == "tiny"].repeats.max() <= 2
    report = {(r.mix_id, r.source): r for r in mixing.shares(mixing.mixture(docs, targets), docs, targets).collect()}
    assert report[1, "big"].target_tokens - report[1, "big"].actual_tokens < 15 and report[1, "big"].actual_tokens <= report[1, "big"].target_tokens
    assert report[1, "none"].actual_tokens == 0 and report[2, "big"].target_tokens == 0
    assert all(r.actual_tokens <= r.target_tokens for r in report.values())


def test_token_counts():
    assert sizes.token_counts(["", None, "Hello world", "a " * 50_000])[:3] == [0, 0, 2]


def test_names_in_any_order_of_parts():
    p = names.Persons([(1, "Robert Ellis Quinparidge")])
    for order in itertools.permutations(["Robert", "Ellis", "Quinparidge"]):
        if order.index("Quinparidge") != 1:
            assert [e for e, _, _ in p.meant(" ".join(order))] == [1]


def test_any_number_and_order_of_parts():
    people = names.Persons([(1, "Ursula K. Le Guin"), (2, "Johannes van der Berg"), (3, "Arthur Conan Doyle"), (4, "Plato"), (5, "Maria de la Cruz Lopez Garcia")])
    entity = lambda text: [e for e, _, _ in people.meant(text)]
    for text in ("Le Guin, Ursula K.", "Ursula Le Guin", "Guin, Ursula"):
        assert entity(text) == [1]
    assert entity("van der Berg, Johannes") == [2] and entity("Plto") == [4] and entity("Plato and A. C. Doyle") == [4, 3]
    for text in ("Conan Doyle, Arthur", "Doyle Conan Arthur", "Doyle, A. C."):
        assert entity(text) == [3]
    for text in ("Garcia, Maria de la Cruz Lopez", "Lopez Garcia Maria de la Cruz"):
        assert entity(text) == [5]
    assert entity("Conan") == [] and entity("") == []


def test_shards_change_nothing(spark):
    authority = spark.createDataFrame([(1, "author", "John Smith"), (2, "author", "Joan Smith"), (3, "author", "Ann Brown"), (4, "author", "Anne Brown")], "entity_id long, kind string, name string")
    spellings = spark.createDataFrame([("author", "Smith, John"), ("author", "Jon Smith and Ann Brown"), ("author", "J. Smith")], "kind string, spelling string")
    one = lambda n: sorted(names.link(spellings, authority, n).collect())
    assert one(1) == one(2) == one(100) and len(one(1)) > 3


def test_classes_in_containers_of_their_own(spark):
    docs = spark.createDataFrame([(k, "s", 1 + 37 * k % 230) for k in range(300)] + [(999, "s", 0)], "doc_id long, source string, n_tokens long")
    specs = spark.createDataFrame([(1, 100, None)], "spec_id long, capacity_tokens long, source string")
    got = packing.pack(docs, specs, by_class=True).toPandas()
    per = got.groupby("container")
    assert (per.n_tokens.sum() <= 100).all() and len(got[["doc_id", "piece_no"]].drop_duplicates()) == len(got)
    for _, rows in per:
        assert len({100 // max(1, n) for n in rows.n_tokens}) == 1 and len(rows) <= 100 // max(1, rows.n_tokens.max())
    assert got.groupby("doc_id").n_tokens.sum().sum() == sum(1 + 37 * k % 230 for k in range(300))


def test_what_the_scarcest_source_allows(spark):
    docs = spark.createDataFrame([(k, "a" if k < 90 else "b", 10) for k in range(100)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 0.6), (1, "b", 1.0, 2, 0.6), (2, "a", 1.0, 1, 0.5), (2, "none", 1.0, 1, 0.5)], "mix_id long, source string, weight double, max_repeats int, budget_share double")
    report = {(r.mix_id, r.source): r.feasible_tokens for r in mixing.shares(mixing.mixture(docs, targets), docs, targets).collect()}
    assert report == {(1, "a"): 200, (1, "b"): 200, (2, "a"): 0, (2, "none"): 0}
