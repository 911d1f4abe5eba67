"""Problem 7: documents packed into containers of fixed capacity, by harmonic packing.

Sizes fall into reciprocal classes: class k holds sizes of C/(k+1) up to C/k, so k of them always fit.
The low classes, which would leave much room, are divided into cells of equal width. A container's
pattern is a fixed number of documents of each cell whose upper ends fit together; the patterns are
made from the cells' counts alone, the largest cell first, the rest of the room filled by the largest
cells that fit. So the driver sees one small table whatever the input, and every document finds its
container from its rank in its cell, on any worker.

A document larger than the capacity, and no other, is split: into full containers and a rest that is
packed as a document. A document without tokens takes no room and is packed as one of the least size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranks import running_total

#: Cells of equal width in a class, for class 1, 2, ...; further classes are one cell each.
CELLS = [64, 32, 16, 8, 8, 4, 4, 4, 2, 2]
#: Classes beyond this one are one cell.
LAST_CLASS = 256


def cell_of(size: int, capacity: int) -> tuple[int, int]:
    """A size's cell: its class, and the upper end of the sizes in the cell."""
    k = min(capacity // max(1, size), LAST_CLASS)
    top = capacity // k
    if k == LAST_CLASS:
        return k, top
    bottom = capacity // (k + 1)
    n = CELLS[k - 1] if k <= len(CELLS) else 1
    width = max(1, -(-(top - bottom) // n))
    return k, top - (top - max(1, size)) // width * width


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers and, by cell's upper end, the documents in each: counts has the documents of each cell."""
    left = {u: n for u, n in counts.items() if n > 0}
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        room, made = capacity, {}
        for u in sorted(left, reverse=True):
            n = min(room // u, left[u])
            if n:
                made[u] = n
                room -= n * u
        times = min(left[u] // n for u, n in made.items())
        out.append((times, made))
        for u, n in made.items():
            left[u] -= times * n
            if not left[u]:
                del left[u]
    return out


def places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """upper end, first rank, last rank, first container, documents a container: where a cell's ranks go."""
    rows, container, used = [], 0, dict.fromkeys(counts, 0)
    for times, made in patterns(counts, capacity):
        for u, n in made.items():
            rows.append((u, used[u], used[u] + times * n - 1, container, n))
            used[u] += times * n
        container += times
    return rows


def class_places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """As ``places``, each class in containers of its own: class k has k documents in each, whatever the other classes hold."""
    rows, container = [], 0
    for k in sorted(counts):
        rows.append((k, 0, counts[k] - 1, container, k))
        container += -(-counts[k] // k)
    return rows


def pieces(sizes: DataFrame, specs: list[tuple[int, int, str | None]]) -> DataFrame:
    """spec_id, capacity, doc_id, piece_no, n_tokens: the documents of each spec, split where larger than its capacity."""
    wanted = [F.when(F.lit(source is None) | (F.col("source") == F.lit(source)), F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity"))) for s, c, source in specs]
    rows = sizes.select("doc_id", "n_tokens", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("_s")).select("_s.spec_id", "_s.capacity", "doc_id", "n_tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1)
    split = rows.select("spec_id", "capacity", "doc_id", F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    return split.select("spec_id", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("_all") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))


def pack(sizes: DataFrame, specs: DataFrame, by_class: bool = False) -> DataFrame:
    """spec_id, doc_id, piece_no, n_tokens, container, start_at: where every document lies.

    With ``by_class`` every class fills containers of its own, independently of the others: harmonic
    packing as first published, with more room left. Without it the cells of several classes share
    containers, by patterns of fixed counts.
    Specs with a null or non-positive capacity are left out. One row for each document, or piece of a
    split one, of each spec; containers count from 0 in each spec.
    """
    chosen = [(r.spec_id, r.capacity_tokens, r.source) for r in specs.where("capacity_tokens > 0").distinct().collect()]
    if not chosen:
        return sizes.sparkSession.createDataFrame([], "spec_id long, doc_id long, piece_no long, n_tokens long, container long, start_at long")
    rows = pieces(sizes, chosen)
    # the same cells as cell_of, as columns
    size = F.greatest(F.col("n_tokens"), F.lit(1))
    k = F.least(F.floor(F.col("capacity") / size), F.lit(LAST_CLASS))
    top, bottom = F.floor(F.col("capacity") / k), F.floor(F.col("capacity") / (k + 1))
    cells = F.when(k <= len(CELLS), F.element_at(F.array(*map(F.lit, CELLS)), F.least(k, F.lit(len(CELLS))).cast("int"))).otherwise(1)
    width = F.greatest(F.lit(1), F.ceil((top - bottom) / cells))
    upper = F.when(k == LAST_CLASS, top).otherwise(top - F.floor((top - size) / width) * width)
    rows = rows.withColumn("_cell", (k if by_class else upper).cast("long"))
    counts = rows.groupBy("spec_id", "capacity", "_cell").agg(F.count("*").alias("n")).collect()  # at most a few hundred cells a spec
    by_spec: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts:
        by_spec.setdefault((r.spec_id, r.capacity), {})[r["_cell"]] = r.n
    plan = [(s, u, lo, hi, first, n) for (s, c), cell in by_spec.items() for u, lo, hi, first, n in (class_places if by_class else places)(cell, c)]
    total = sum(r.n for r in counts)
    ranked = running_total(rows, ["spec_id", "_cell"], [F.col("doc_id"), F.col("piece_no")], F.lit(1), "_rank", total)
    spread = sizes.sparkSession.createDataFrame(plan or [(0, 0, 0, -1, 0, 1)], "spec_id long, _cell long, _lo long, _hi long, _first long, _n long")
    lists = spread.groupBy("spec_id", "_cell").agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi", "_first", "_n"))).alias("_plan"))
    at = F.filter("_plan", lambda p: (p["_lo"] <= F.col("_rank")) & (p["_hi"] >= F.col("_rank")))[0]
    placed = ranked.join(F.broadcast(lists), ["spec_id", "_cell"]).withColumn("_p", at)
    placed = placed.withColumn("container", F.col("_p._first") + F.floor((F.col("_rank") - F.col("_p._lo")) / F.col("_p._n")))
    w = Window.partitionBy("spec_id", "container").orderBy(F.desc("n_tokens"), "doc_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("spec_id", "doc_id", "piece_no", "n_tokens", "container", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("start_at"))


def fill_rates(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity_tokens, n_documents, n_containers, least_containers, fill_rate of each spec that has documents."""
    per = packed.groupBy("spec_id").agg(F.count_distinct("doc_id").alias("n_documents"), (F.max("container") + 1).alias("n_containers"), F.sum("n_tokens").alias("_tokens"))
    out = per.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id")
    room = F.col("n_containers") * F.col("capacity_tokens")
    return out.select("spec_id", "capacity_tokens", "n_documents", "n_containers", F.ceil(F.col("_tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("_tokens") / room, 6).alias("fill_rate"))
