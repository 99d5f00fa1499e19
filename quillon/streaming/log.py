"""Event logs as streams: windowed accuracy, the newest row of each key, and a state machine per run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_OUT = "run_id string, seq bigint, state string, changed boolean"
STATE_KEPT = "state string, seen map<string,string>, last bigint"


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of parquet files as a stream, so many new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_accuracy(log: DataFrame, *, time: str, key: str, correct: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, key, n, accuracy) by tumbling windows; rows later than ``lateness`` are dropped by the watermark."""
    marked = log.withWatermark(time, lateness) if log.isStreaming else log
    per = marked.groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return per.select(F.col("w.start").alias("start"), "key", "n", "accuracy")


def newest(log: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The newest row of each key: what a reader that drops stale frames would see."""
    return log.groupBy(key).agg(F.max_by(F.struct(time, *columns), time).alias("r")).select(key, "r.*")


def step(table: dict[str, tuple[tuple[str, ...], dict[tuple[str, ...], str]]], state: str, seen: dict[str, str]) -> str:
    """The state after ``state`` given the observations; without a match it stays."""
    keys, to = table.get(state, ((), {}))
    return to.get(tuple(seen.get(k, "") for k in keys), state)


def stops_left(before: str, after: str, seen: dict[str, str], *, drive: str = "drive_to_stop", stops: str = "stops", done: str = "all_visited") -> dict[str, str]:
    """Observations after a step that reached a stop: the first of the list of stops ('3, 1') is taken off, and whether none is left is noted."""
    if before != drive or after == drive:
        return seen
    left = [x.strip() for x in seen.get(stops, "").split(",") if x.strip()][1:]
    return {**seen, stops: ", ".join(left), done: "no" if left else "yes"}


def run_machine(log: DataFrame, table: dict, start: str, timeout_ms: int | None = None, derive: Callable[[str, str, dict[str, str]], dict[str, str]] | None = None) -> DataFrame:
    """``STATE_OUT`` for each row of a log (run_id, seq, obs_key, answer), in the order of seq in a batch.

    ``table``: state to (observation keys, {their values: next state}). The state of a run lives in
    Spark's state store and is dropped when the run is silent for ``timeout_ms``, if given. Rows with a seq not
    above the last one seen are repeats and change nothing. ``derive`` (state before, after, observations) gives the
    observations after a step, for those that follow from others. Works on batches too, there by one pass per run.
    """

    def advance(rows: list[tuple], state: str, seen: dict[str, str], last: int) -> tuple[list[tuple], str, dict[str, str], int]:
        out = []
        for run, seq, key, answer in sorted(rows, key=lambda r: r[1]):
            if seq <= last:
                continue
            seen, last = {**seen, key: answer}, seq
            new = step(table, state, seen)
            out.append((run, seq, new, new != state))
            if derive:
                seen = derive(state, new, seen)
            state = new
        return out, state, seen, last

    cols = ["run_id", "seq", "obs_key", "answer"]
    names = ["run_id", "seq", "state", "changed"]
    rows = log.select(*cols).where("run_id is not null and seq is not null and obs_key is not null")
    if not log.isStreaming:

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(advance(list(pdf[cols].itertuples(index=False, name=None)), start, {}, -1)[0], columns=names)

        return rows.groupBy("run_id").applyInPandas(batch, STATE_OUT)

    def stream(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state, seen, last = kept.get if kept.exists else (start, {}, -1)
        given = [r for b in batches for r in b[cols].itertuples(index=False, name=None)]
        out, state, seen, last = advance(given, state, dict(seen or {}), last)
        kept.update((state, seen, last))
        if timeout_ms:
            kept.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("run_id").applyInPandasWithState(stream, STATE_OUT, STATE_KEPT, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
