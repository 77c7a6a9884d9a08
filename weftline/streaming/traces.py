"""Trace events and observations as streams: sealed windows, late rows counted, connections, registrations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sealed_windows(events: DataFrame, length: str = "10 minutes", delay: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per window that are final once the watermark passed it (append mode): a sealed window never changes."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "value")


def connections(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Running counts per (source, target, kind): the stream joined to the static symbols (update mode)."""
    a = symbols.select(F.col("name").alias("caller"), F.col("id").alias("source"))
    b = symbols.select(F.col("name").alias("callee"), F.col("id").alias("target"))
    return events.join(a, "caller").join(b, "callee").groupBy("source", "target", "kind").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def scenario_counts(observations: DataFrame, plan: str) -> DataFrame:
    """Running outcomes per (contract, scenario) of observations made for this plan; others are void."""
    o = observations.where(F.col("plan") == plan)
    return o.groupBy("contract", "scenario").agg(F.count_if(F.col("outcome") == "observed").alias("observed"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def split_late(events: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], delay_seconds: int, checkpoint: str) -> StreamingQuery:
    """Hands every batch on as (in time, late): late rows go to a side table and are counted, never lost.

    The high mark is kept beside the checkpoint, so a restarted query judges as before.
    """
    spark = events.sparkSession
    mark_path = f"{checkpoint}-mark"

    def batch(df: DataFrame, epoch: int) -> None:
        try:
            mark = spark.read.schema("epoch long, mark double").parquet(mark_path).where(F.col("epoch") < epoch).agg(F.max("mark")).first()[0]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            mark = None
        seconds = F.col("ts").cast("double")
        is_late = F.lit(False) if mark is None else seconds < F.lit(mark - delay_seconds)
        sink(df.where(~is_late), df.where(is_late), epoch)
        df.agg(F.max(seconds).alias("mark")).where("mark is not null").select(F.lit(epoch).cast("long").alias("epoch"), "mark").write.mode("append").parquet(mark_path)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_session(files: DataFrame, on_generation: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with the files whose content hash is new, once per batch that has any: a generation."""
    seen = {"n": 0}
    spark = files.sparkSession
    known_path = f"{checkpoint}-known"

    def batch(df: DataFrame, epoch: int) -> None:
        fresh = df.select("path", "sha").distinct()
        try:
            fresh = fresh.join(spark.read.schema("path string, sha string").parquet(known_path), ["path", "sha"], "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows = spark.createDataFrame(fresh.toPandas(), "path string, sha string")  # one batch of changed paths
        if not rows.isEmpty():
            seen["n"] += 1
            on_generation(rows, seen["n"])
            rows.write.mode("append").parquet(known_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_registrations(events: DataFrame) -> DataFrame:
    """(channel, observer, post) from a stream of register, remove and post events (channel, observer, kind, at).

    State per channel: the observers now registered. A post meets those whose registration precedes it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["at", "kind"])
        out = []
        for r in rows.itertuples():
            if r.kind == "register":
                live[r.observer] = int(r.at)
            elif r.kind == "remove":
                live.pop(r.observer, None)
            else:
                out += [(key[0], o, int(r.at)) for o, at in sorted(live.items()) if at < r.at]
        state.update((list(live), list(live.values())))
        yield pd.DataFrame(out, columns=["channel", "observer", "post"])

    return events.groupBy("channel").applyInPandasWithState(
        step, "channel string, observer string, post long", "observers array<string>, at array<long>", "append", GroupStateTimeout.NoTimeout
    )
