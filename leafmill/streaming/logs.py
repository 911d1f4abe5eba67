"""The append-only logs as streams: roll-ups that go on, and replay that keeps its state."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.sources.files import EVENT, TIMING


def timing_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New timing rows of a folder of JSON-lines files."""
    return spark.readStream.schema(TIMING).option("maxFilesPerTrigger", files_per_trigger).json(path)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New annotation events of a folder of JSON-lines files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_rollup(runs: DataFrame) -> DataFrame:
    """stage, runs, pages, seconds so far; the same sums as the batch roll-up (output mode complete)."""
    return runs.groupBy("stage").agg(F.count("*").alias("runs"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 4).alias("seconds"))


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "1 hour", width: str = "1 day", step: str | None = None) -> DataFrame:
    """window_start, kind, n: events by time window; rows later than ``late`` behind the newest are dropped on a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, step) if step else F.window(time, width)
    return rows.groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def last_values_stream(events: DataFrame) -> DataFrame:
    """article_id, title, author, art_type, n_events: the last set_meta values of each article, kept for ever.

    Output mode update: an article's row comes again when it changes. Events of one trigger are put in
    order of event_id; an event that arrives after a newer one does not overwrite it.
    """

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, count = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        for b in batches:
            for e in b.sort_values("event_id").to_dict("records"):
                count += 1
                for field in ("title", "author", "art_type"):
                    if isinstance(e[field], str) and e["event_id"] >= seen.get(field, [-1])[0]:
                        seen[field] = [int(e["event_id"]), e[field]]
        state.update((json.dumps(seen), count))
        yield pd.DataFrame([(key[0], *(seen.get(f, [0, None])[1] for f in ("title", "author", "art_type")), count)], columns=["article_id", "title", "author", "art_type", "n_events"])

    meta = events.where("event_action = 'set_meta' and article_id is not null").select("article_id", "event_id", "title", "author", "art_type")
    return meta.groupBy("article_id").applyInPandasWithState(fold, "article_id string, title string, author string, art_type string, n_events long", "seen string, n long", "update", GroupStateTimeout.NoTimeout)
