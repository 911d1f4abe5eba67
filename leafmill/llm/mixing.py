"""Problem 8: sources mixed to target weights by Pfair scheduling.

A mix's budget is a share of all tokens. Each source's target is its weight's share of the budget; what
it can give is its tokens times the most repeats. A source gives whole passes over its documents, then
documents of one more pass as long as they fit, so it stays below its target by less than a document.

For the order the mix is cut into slots of equal size. A source with share w gives block k between its
release k / w and its deadline (k + 1) / w; in each slot the released block with the earliest deadline
goes first, so after any number of slots a source is less than one block from its share. The slots of a
mix are a fixed number, so what is scheduled on the driver does not grow with the data.

A source without documents has a target and gives nothing; rows of one source in a mix count once, with
their greatest weight. Null or negative weights count as 0. What a short source can't give is not given
to others: they would leave their targets; the report shows the shortfall.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ranks import running_total

#: Slots of a mix.
SLOTS = 1024


def shares_in_slots(given: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Slots of each source by largest remainders; every source that gives anything has one, where there are enough."""
    whole = sum(given.values())
    if whole <= 0:
        return {}
    exact = {s: g * slots / whole for s, g in given.items() if g > 0}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    k = 0
    while sum(out.values()) < slots:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > slots and max(out.values()) > 1:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def schedule(slots_of: dict[str, int]) -> list[tuple[str, int, int]]:
    """source, block, slot: earliest deadline first among the released blocks."""
    slots = sum(slots_of.values())
    waiting = [(k * slots // n, -(-(k + 1) * slots // n), s, k) for s, n in slots_of.items() for k in range(n)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            out.append((s, k, slot))
    return out


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, max_repeats, weight_share, target_tokens, source_tokens, n_docs, passes, rest_tokens of every target."""
    clean = targets.groupBy("mix_id", "source").agg(F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max(F.coalesce("budget_share", F.lit(0.0))).alias("budget_share"))
    whole = clean.groupBy("mix_id").agg(F.sum("weight").alias("_weights"))
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
    all_tokens = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first().t
    rows = clean.join(whole, "mix_id").join(per_source, "source", "left").na.fill(0, ["source_tokens", "n_docs"])
    share = F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights")).otherwise(0.0)
    target = F.floor(share * F.col("budget_share") * F.lit(float(all_tokens)) + 1e-6)
    rows = rows.select("mix_id", "source", "max_repeats", share.alias("weight_share"), target.alias("target_tokens"), "source_tokens", "n_docs")
    passes = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("long"), F.floor(F.col("target_tokens") / F.col("source_tokens")))).otherwise(0)
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.col("target_tokens") - F.col("passes") * F.col("source_tokens")).otherwise(0)
    return rows.withColumn("passes", passes).withColumn("rest_tokens", rest)


def mixture(sizes: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, repeats, slots: the chosen documents and, for each copy, its slot in the mix.

    The targets and the schedule (``slots`` rows a mix) are small whatever the documents; the documents
    are ranked by hash within their source, in chunks, so no source is sorted by one task.
    """
    planned = plan(sizes, targets).collect()  # one row per target
    spark = sizes.sparkSession
    rows = []
    for mix in sorted({r.mix_id for r in planned}):
        own = [r for r in planned if r.mix_id == mix and r.source_tokens > 0]
        given = {r.source: float(r.passes * r.source_tokens + r.rest_tokens) for r in own}
        n = shares_in_slots(given, slots)
        at: dict[str, list[int]] = {s: [0] * k for s, k in n.items()}
        for s, k, slot in schedule(n):
            at[s][k] = slot
        rows += [(mix, r.source, r.passes, r.rest_tokens, r.source_tokens, given[r.source], at[r.source]) for r in own if r.source in n]
    goals = spark.createDataFrame(rows, "mix_id long, source string, passes long, rest_tokens long, source_tokens long, given double, block_slots array<int>")
    ranked = running_total(sizes, ["source"], [F.col("doc_id")], F.col("n_tokens"), "_start", sizes.count())
    taken = ranked.join(F.broadcast(goals), "source")
    more = F.when(F.col("_start") + F.col("n_tokens") <= F.col("rest_tokens"), 1).otherwise(0)
    taken = taken.withColumn("repeats", (F.col("passes") + more).cast("int")).where("repeats > 0")
    blocks = F.size("block_slots")
    begin = lambda k: F.col("_start") + k * F.col("source_tokens")
    block = lambda k: F.least(blocks - 1, F.floor(begin(k) * blocks / F.greatest(F.col("given"), F.lit(1.0))).cast("int"))
    times = F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), lambda k: F.element_at("block_slots", block(k) + 1))
    return taken.select("mix_id", "source", "doc_id", "n_tokens", "repeats", times.alias("slots"))


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_tokens, actual_tokens, target_share, actual_share, n_docs, most_repeats, feasible_tokens of every target.

    ``feasible_tokens`` is what the source would give in the largest mix that every source with a weight
    can fill to its share within its repeats, and no larger than the budget: the alternative to a mix that
    leaves its shares because a source is short. A source without documents makes it 0.
    """
    planned = plan(sizes, targets)
    room = F.when(F.col("weight_share") > 0, F.col("source_tokens") * F.col("max_repeats") / F.col("weight_share"))
    largest = planned.groupBy("mix_id").agg(F.least(F.min(room), F.sum("target_tokens").cast("double")).alias("_largest"))
    actual = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    rows = planned.select("mix_id", "source", "target_tokens", F.col("weight_share").alias("target_share")).join(actual, ["mix_id", "source"], "left").na.fill(0, ["actual_tokens", "n_docs", "most_repeats"])
    whole = rows.groupBy("mix_id").agg(F.sum("actual_tokens").alias("_all"))
    out = rows.join(whole, "mix_id").join(largest, "mix_id").withColumn("actual_share", F.when(F.col("_all") > 0, F.round(F.col("actual_tokens") / F.col("_all"), 6)).otherwise(0.0))
    feasible = F.floor(F.coalesce(F.col("_largest"), F.lit(0.0)) * F.col("target_share") + 1e-6)
    return out.select("mix_id", "source", "target_tokens", "actual_tokens", F.round("target_share", 6).alias("target_share"), "actual_share", "n_docs", "most_repeats", feasible.alias("feasible_tokens"))
