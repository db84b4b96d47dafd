"""Streaming and stateful behaviour (survey R1-R8, R11, R12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_results(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Finished items as they arrive, a bounded number of files per batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def per_batch(stream: DataFrame, work: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str):
    """Each micro-batch is cached once, split into several outputs (raw, scores, trajectories) and appended under
    batch=<id>, so a repeated batch overwrites its own folder only. Ends when all available data are done (R4)."""

    def run(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, part in work(df).items():
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def item_states(events: DataFrame, max_rounds: int, timeout: str = "10 minutes") -> DataFrame:
    """R2: per item pending -> processing -> finished. events: (item, text), in arrival order.

    An item is finished when a text has Terminate or after max_rounds texts; later texts are ignored. Emits
    (item, rounds, status) on every change. State that is not touched for `timeout` is dropped as expired (R7).
    """
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rounds, status = state.get
            state.remove()
            yield pd.DataFrame({"item": [key[0]], "rounds": [rounds], "status": [status if status == "finished" else "expired"]})
            return
        rounds, status = state.get if state.exists else (0, "pending")
        for f in frames:
            for t in f["text"]:
                if status != "finished":
                    rounds += 1
                    status = "finished" if (t is not None and "Terminate" in t) or rounds >= max_rounds else "processing"
        state.update((rounds, status))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame({"item": [key[0]], "rounds": [rounds], "status": [status]})

    kind = dict(events.dtypes)["item"]
    return events.groupBy("item").applyInPandasWithState(step, f"item {kind}, rounds int, status string", "rounds int, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def replay_states(events: DataFrame, item: str, order: list[str], text: Column, max_rounds: int) -> DataFrame:
    """R2, R11 on recorded events: (item, rounds, status) of every item, without state. Null items are left out.

    The first Terminate of an item is an aggregate, and events up to it are counted by another, so no item's events are
    gathered. The order must be total within an item.
    """
    at = F.struct(*order)
    x = events.where(F.col(item).isNotNull()).select(item, at.alias("__at"), F.coalesce(text.contains("Terminate"), F.lit(False)).alias("__end"))
    ends = x.where("__end").groupBy(item).agg(F.min("__at").alias("__first"))
    n = x.join(ends, item, "left").groupBy(item).agg(F.count("*").alias("__all"), F.count_if(F.col("__at") <= F.col("__first")).alias("__upto"))
    done = F.col("__upto") > 0
    rounds = F.least(F.when(done, F.col("__upto")).otherwise(F.col("__all")), F.lit(max_rounds)).cast("int")
    return n.select(item, rounds.alias("rounds"), F.when(done | (F.col("__all") >= max_rounds), "finished").otherwise("processing").alias("status"))


def live_workers(beats: DataFrame, worker: str, at: str, now: Column, seconds: int = 90) -> DataFrame:
    """R7 on recorded heart-beats: workers whose last one is at most `seconds` old."""
    last = beats.groupBy(worker).agg(F.max(at).alias("last_seen"))
    return last.where(F.col("last_seen") >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def dispatch(jobs: DataFrame, job: str, workers: list[tuple[str, float, float]], method: str = "lottery", seed: int = 0) -> DataFrame:
    """Adds worker. workers: (name, speed, queue length). lottery: proportional to speed by the job's md5;
    shortest_queue: the least queue / speed, ties by name. The worker list is configuration."""
    from ..operators.sampling import chance

    ws = sorted((n, s, q) for n, s, q in workers if s > 0)
    if not ws:
        return jobs.withColumn("worker", F.lit(None).cast("string"))
    if method == "shortest_queue":
        return jobs.withColumn("worker", F.lit(min(ws, key=lambda w: (w[2] / w[1], w[0]))[0]))
    total, at = sum(s for _, s, _ in ws), 0.0
    c, pick = chance(seed, F.col(job)), None
    for n, s, _ in ws[:-1]:
        at += s / total
        pick = F.when(c < at, n) if pick is None else pick.when(c < at, n)
    return jobs.withColumn("worker", F.lit(ws[-1][0]) if pick is None else pick.otherwise(ws[-1][0]))


#: Difficulty levels in order.
LEVELS = ["basic", "intermediate", "advanced"]


def route(difficulty: Column, cap: str = "advanced") -> Column:
    """The level, at most the cap; unknown levels count as intermediate."""
    no = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(F.trim(difficulty))), F.lit(0)), F.lit(2)).cast("int")
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(no, F.lit(LEVELS.index(cap) + 1)))


def windowed_rates(stream: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", by: str | None = None) -> DataFrame:
    """Event-time counts per window with a watermark, for the score stream; works on batches too."""
    keys = [F.window(at, width).alias("w"), *([F.col(by)] if by else [])]
    return stream.withWatermark(at, late).groupBy(*keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *([by] if by else []), "n")
