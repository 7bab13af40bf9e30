"""Job progress as a stream: the latest state of each job, runs, idempotent starts.

Events: job_id, repository_id, stage, message, error, ts and counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values
STAGES = ("queued", "scanning", "parsing", "resolving", "embedding", "persisting", "succeeded", "failed")
TERMINAL = ("succeeded", "failed")


def latest(events: DataFrame, order: str = "ts") -> DataFrame:
    """The latest event of each job; of equal times the greatest row."""
    rest = [c for c in events.columns if c not in ("job_id", order)]
    last = events.groupBy("job_id").agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select("job_id", "last.*")


def runs(events: DataFrame) -> DataFrame:
    """A row per job: status is the latest stage; a terminal one sets finished_at; the first time stays."""
    rows = events.groupBy("job_id").agg(
        F.min("ts").alias("started_at"), F.max(F.struct("ts", "stage", "event_id")).alias("last"), F.count("*").alias("n_events")
    )
    status = F.col("last.stage")
    return rows.select(
        "job_id", "started_at", status.alias("status"), F.when(status.isin(*TERMINAL), F.col("last.ts")).alias("finished_at"), "n_events"
    )


def reduce_runs(rows: DataFrame, order: str) -> DataFrame:
    """One row per run: the last values in the order of a column; source and started_at keep their first."""
    columns = [c for c in rows.columns if c != order]
    first = [F.min_by(c, order).alias(c) for c in ("source", "started_at")]
    rest = [c for c in columns if c not in ("id", "source", "started_at")]
    last = rows.groupBy("id").agg(*first, F.max_by(F.struct(*rest), order).alias("last"))
    return last.select("id", "source", "started_at", "last.*").select(*columns)


def upsert_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones by id; source and started_at keep their first value."""
    every = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return reduce_runs(every, "_seq")


def startable(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests (source) for which no run is under way."""
    active = current.where(~F.col("status").isin(*TERMINAL)).select("source")
    return requests.join(active, "source", "left_anti")


def progress_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state per job in a Parquet folder, one snapshot per batch.

    ``events`` is a streaming DataFrame. A batch merges its own latest rows with
    the snapshot before; readers take the newest snapshot, then follow the stream.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch)
        before = f"{out}/snapshot={batch_id - 1}"
        if batch_id > 0:
            rows = latest(rows.unionByName(spark.read.schema(rows.schema).parquet(before)))
        rows.write.mode("overwrite").parquet(f"{out}/snapshot={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# fixed value: how many events of a job are kept for readers that come late
TAIL = 64
EVENT = "job_id string, repository_id string, stage string, message string, error string, ts long, files long, symbols long, edges long, units long, lines long"
COUNTERS = ("files", "symbols", "edges", "units", "lines")
FIELDS = ("stage", "message", "error", "ts", *COUNTERS)
FOLLOWED = "job_id string, n_events long, held long, last string, tail string"


def tail_step(keep: int = TAIL):
    """State per job: how many events came, and the last ``keep`` of them in the order of their times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = state.get if state.exists else (0, "[]")
        events = json.loads(held)
        for rows in batches:
            count += len(rows)
            # pandas has counts with nulls among them as floats
            told = json.loads(rows[list(FIELDS)].to_json(orient="records"))
            events += [{k: int(v) if isinstance(v, float) else v for k, v in e.items()} for e in told]
            # a batch is sorted into what is held; Python's sort keeps the order of equal times
            events = sorted(events, key=lambda e: (e["ts"] is not None, e["ts"] or 0))[-keep:]
        state.update((count, json.dumps(events)))
        yield pd.DataFrame({"job_id": [key[0]], "n_events": [count], "held": [len(events)], "last": [json.dumps(events[-1])], "tail": [json.dumps(events)]})

    return step


def follow(events: DataFrame, keep: int = TAIL) -> DataFrame:
    """A streaming DataFrame of events (``EVENT``) -> per batch and job with news: n_events, held, last and tail (JSON of ``FIELDS``)."""
    grouped = events.groupBy("job_id")
    return grouped.applyInPandasWithState(tail_step(keep), FOLLOWED, "n long, held string", "update", GroupStateTimeout.NoTimeout)


def follow_stream(events: DataFrame, out: str, checkpoint: str, keep: int = TAIL) -> StreamingQuery:
    """Write what ``follow`` gives, one folder per batch; a batch that is done again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch-{batch_id:08d}")

    return follow(events, keep).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def news(followed: DataFrame, job_id: str, seen: int = 0) -> DataFrame:
    """For a reader that has seen so many events of a job: the snapshot, the events after those that are still held, and how many aren't.

    One row: n_events, missed, snapshot, events; none for an unknown job.
    """
    newest = followed.where(F.col("job_id") == job_id).orderBy(F.desc("batch")).limit(1)
    event = "struct<" + ", ".join(f"{f}: {'bigint' if f not in ('stage', 'message', 'error') else 'string'}" for f in FIELDS) + ">"
    unheld = F.greatest(F.col("n_events") - F.col("held") - seen, F.lit(0))
    fresh = F.greatest(F.col("n_events") - seen, F.lit(0))
    events = F.from_json("tail", f"array<{event}>")
    kept = F.least(fresh, F.col("held")).cast("int")
    return newest.select(
        "n_events", unheld.alias("missed"), F.from_json("last", event).alias("snapshot"),
        F.when(kept > 0, F.slice(events, F.size(events) - kept + 1, F.greatest(kept, F.lit(1)))).otherwise(F.slice(events, 1, 0)).alias("events"),
    )


def progress_state(events: DataFrame) -> DataFrame:
    """The latest event per job as a streaming aggregate (update mode)."""
    return events.groupBy("job_id").agg(F.max_by("stage", "ts").alias("stage"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))
