"""Running totals within a group that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts.
CHUNK_ROWS = 50_000


def _totals(keyed: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """keyed (with _chunk) with a total for each of ``values``: chunks of a group are summed, only the sums meet in one task."""
    keyed = keyed.withColumns({f"_v_{name}": value for name, value in values.items()})
    sums = keyed.groupBy(*group, "_chunk").agg(*(F.sum(f"_v_{name}").alias(f"_sum_{name}") for name in values))
    over_chunks = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "_chunk", *(F.coalesce(F.sum(f"_sum_{name}").over(over_chunks), F.lit(0)).alias(f"_before_{name}") for name in values))
    within = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumns({f"_within_{name}": F.coalesce(F.sum(f"_v_{name}").over(within), F.lit(0)) for name in values})
    out = placed.join(before, [*group, "_chunk"]).withColumns({name: F.col(f"_before_{name}") + F.col(f"_within_{name}") for name in values})
    return out.drop("_chunk", *(f"_{part}_{name}" for name in values for part in ("v", "before", "within")))


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, rows: int) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows before each one in its group, in order of a hash.

    The order is that of a 64-bit hash of ``order`` (ties by ``order`` itself), so it is the same at every
    run and every partitioning. The hash's range is cut into chunks of about CHUNK_ROWS rows (``rows`` is
    the row count of df): a task sorts one chunk of one group, and only the chunks' sums are added up
    over the group. A group that holds most rows is thus spread over many tasks.
    """
    chunks = max(1, -(-rows // CHUNK_ROWS))
    keyed = df.withColumn("_h", F.xxhash64(*order)).withColumn("_chunk", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * chunks).cast("int"))
    return _totals(keyed, group, [F.col("_h"), *order], {name: value}).drop("_h")


def running_totals_by(df: DataFrame, group: list[str], number: str, values: dict[str, Column], span: int = CHUNK_ROWS) -> DataFrame:
    """df with a column for each of ``values``: its sum over the rows of the group whose ``number`` is smaller.

    Chunks are ranges of ``span`` numbers, so a chunk has as many rows as share its numbers; groups are
    not null, and rows of equal number in a group add up in no defined order.
    """
    return _totals(df.withColumn("_chunk", F.floor(F.col(number) / F.lit(span))), group, [F.col(number)], values)
