"""Structured Streaming: incremental ingest, answering, progress, clean-up."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rows import load_rows
from ..operators.vectors import hash_embed
from ..plans.ingest import ingest
from ..sources.cells import grid_from_wide
from ..sources.corpus import CorpusStore


def _run(stream: DataFrame, each: Callable, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, resuming where the last run ended."""
    query = (stream.writeStream.foreachBatch(each).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: a batch that is replayed replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_new(stream: DataFrame, to_rows: Callable[[DataFrame], DataFrame], key: str,
               path: str, checkpoint: str) -> None:
    """Append the rows whose ``key`` is not stored yet; each key once, also on restart."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = to_rows(batch).dropDuplicates([key])
        if _has_files(spark, path):
            old = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
            rows = rows.join(old.select(key), key, "left_anti")
        _write_batch(rows, path, batch_id)

    _run(stream, each, checkpoint)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame],
                  path: str, checkpoint: str) -> None:
    """Answer each micro-batch of questions with a batch plan and store the result."""
    _run(questions, lambda batch, i: _write_batch(answer(batch), path, i), checkpoint)


def ingest_stream(store: CorpusStore, sheets: DataFrame, configs: DataFrame, checkpoint: str,
                  embed_fn: Callable = hash_embed) -> None:
    """Sheets that arrive as files, through loader, sections, chunks and vectors into the store.

    A unit of work is a source file; it arrives whole, as wide rows (see
    :func:`grid_from_wide`) of one file of the stream. The store's checkpoint is written
    after a batch's chunks, and a batch that is replayed, or a source file that
    arrives again, finds its units finished and adds nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ingest(store, load_rows(grid_from_wide(batch), configs), embed_fn=embed_fn)

    _run(sheets, each, checkpoint)


_PROGRESS = ("run_id {run}, collection {collection}, first_seq bigint, type string, batch bigint, seq bigint, "
             "n_events bigint, finished boolean")
_STATE = "first_seq bigint, type string, batch bigint, seq bigint, n_events bigint"


def _advance(idle_ms: int):
    """Fold a run's new events into its state; a run that was idle for so long is finished and forgotten."""
    def step(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held, finished = state.get, True
            state.remove()
        else:
            held, finished, latest = (state.get if state.exists else None), False, 0
            for part in events:
                latest = max(latest, int(part["ts"].max().timestamp() * 1000))
                at = part["seq"].to_numpy().argmax()
                last = (str(part["type"].iloc[at]), int(part["batch"].iloc[at]), int(part["seq"].iloc[at]))
                first, n = int(part["seq"].min()), len(part)
                if held is None:
                    held = (first, *last, n)
                else:
                    newer = last if last[2] > held[3] else held[1:4]
                    held = (min(first, held[0]), *newer, held[4] + n)
            state.update(held)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(*key, *held, finished)], columns=[
            "run_id", "collection", "first_seq", "type", "batch", "seq", "n_events", "finished"])

    return step


def progress_stream(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour",
                    idle_ms: int = 24 * 3600 * 1000, **source) -> None:
    """Keep the latest event of each (run, collection) as streaming state.

    Only changed states are written; :func:`read_progress` takes the newest. A run
    without events for ``idle_ms`` of event time is written as finished and leaves the
    state, which so holds only runs at work. Events have run_id, collection, type, batch, seq, ts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    shape = _PROGRESS.format(run=kinds["run_id"], collection=kinds["collection"])
    states = events.withWatermark("ts", late).groupBy("run_id", "collection").applyInPandasWithState(
        _advance(idle_ms), shape, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    _run(states, lambda batch, i: _write_batch(batch, path, i), checkpoint, "update")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each (run, collection); a run that went on after it was finished is one again."""
    stretch = spark.read.parquet(path).groupBy("run_id", "collection", "first_seq").agg(
        F.max_by(F.struct("type", "batch", "seq", "n_events"), "batch_id").alias("s"))
    return stretch.groupBy("run_id", "collection").agg(
        F.max_by(F.struct("s.type", "s.batch", "s.seq"), "s.seq").alias("last"),
        F.sum("s.n_events").alias("n_events")).select("run_id", "collection", "last.type", "last.batch", "last.seq",
                                                      "n_events")


def dedup_stream(events: DataFrame, key: str, time: str, delay: str,
                 path: str, checkpoint: str) -> None:
    """Drop repeated deliveries of an id within the watermark and store the rest."""
    once = events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    query = (once.writeStream.format("parquet").option("path", path).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def idle_sessions(events: DataFrame, ttl_seconds: float, session: str = "session_id",
                  time: str = "ts") -> DataFrame:
    """Sessions idle for longer than the limit, counted from the newest event of all."""
    last = events.groupBy(session).agg(F.max(time).alias("last_seen"))
    now = events.agg(F.max(time).alias("now")).scalar()
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.col("last_seen").cast("timestamp"))
    aged = last.select(session, (idle / 1_000_000).alias("idle_seconds"))
    return aged.filter(F.col("idle_seconds") > ttl_seconds)


def session_stream(events: DataFrame, path: str, checkpoint: str, gap: str = "24 hours",
                   late: str = "0 seconds", session: str = "session_id", time: str = "ts") -> None:
    """Write each session window once, when the watermark has passed its end.

    (session, started, ended, n_events); ended is the last event's time plus the
    gap. A session still open stays in the state for the next run.
    """
    windows = events.withWatermark(time, late).groupBy(session, F.session_window(time, gap).alias("w")).agg(
        F.count("*").alias("n_events"))
    closed = windows.select(session, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")
    query = (closed.writeStream.format("parquet").option("path", path).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
