"""The same operator over growing prefixes of its input.

A query over files is driven by Structured Streaming with a few files a batch.  Aggregates
in complete mode keep their state between batches; any other operator is evaluated in
``foreachBatch`` over what has arrived.  Each result is a usable approximation, the last
one is the exact answer, and stopping the query early is always possible.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.staging import shared_folder

Operator = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str, schema, format_: str = "parquet", files_per_batch: int = 1, bytes_per_batch: str | None = None) -> DataFrame:
    """A stream of the files of a folder, a few for each batch."""
    reader = spark.readStream.schema(schema).format(format_)
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


@dataclass
class Progress:
    """What each batch did, as a trace."""

    rows: list[dict] = field(default_factory=list)

    def add(self, **row) -> None:
        self.rows.append(row)


class StopEarly(Exception):
    """Raised by an observer to end a progressive query."""


def progressive(stream: DataFrame, operator: Operator, observe: Callable[[DataFrame, int], None], aggregates: bool = True, checkpoint: str | None = None, tick: Callable[[int], None] | None = None) -> Progress:
    """Drive an operator over a stream to its end, showing each result to an observer.

    ``aggregates``: the operator is a streaming aggregation, kept as state; otherwise it is
    evaluated over all rows so far, which are appended to a table in the shared folder.
    """
    spark, trace, ended = stream.sparkSession, Progress(), []
    store = f"{shared_folder(spark)}/prefix-{time.time_ns()}"

    def batch(df: DataFrame, run: int) -> None:
        if ended:
            df.write.format("noop").mode("overwrite").save()  # a batch must be used up for its state to be kept
            return
        start = time.time()
        if not aggregates:
            df.write.parquet(f"{store}/run={run}", mode="overwrite")  # a repeated batch replaces itself
            df = operator(spark.read.schema(stream.schema).parquet(*(f"{store}/run={r}" for r in range(run + 1))))
        try:
            if tick:
                tick(run)
            observe(df, run)
        except StopEarly:
            ended.append(run)
            df.write.format("noop").mode("overwrite").save()
        trace.add(run=run, start=start, duration=time.time() - start, state="stopped" if ended else "ready")

    writer = (operator(stream) if aggregates else stream).writeStream.foreachBatch(batch).trigger(availableNow=True)
    writer = writer.outputMode("complete" if aggregates else "append")
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return trace


def every(stream: DataFrame, action: Callable[[DataFrame, int], None], mode: str = "append"):
    """Call an action on each batch; the running query is returned."""
    return stream.writeStream.outputMode(mode).foreachBatch(action).start()


def show_each(stream: DataFrame, mode: str = "append"):
    """Print each batch."""
    return stream.writeStream.outputMode(mode).format("console").start()


def sink(stream: DataFrame, mode: str = "append"):
    """Absorb a stream."""
    return stream.writeStream.outputMode(mode).format("noop").start()


def wait(query, reads: int | None = None, delay: float | None = None, timeout: float = 60.0) -> bool:
    """Wait until a query has read so many rows, or for a time; False if it ended or the time ran out first."""
    start = time.time()
    while time.time() - start < timeout:
        if delay is not None and time.time() - start >= delay:
            return True
        if reads is not None and sum(p["numInputRows"] for p in query.recentProgress) >= reads:
            return True
        if not query.isActive:
            return reads is not None and sum(p["numInputRows"] for p in query.recentProgress) >= reads
        time.sleep(0.05)
    return False


def wait_for_data(stream: DataFrame, action: Callable[[DataFrame], None]):
    """Call an action once, with the first batch that has rows."""
    done: list[int] = []

    def batch(df: DataFrame, run: int) -> None:
        if not done and not df.isEmpty():
            done.append(run)
            action(df)

    return stream.writeStream.foreachBatch(batch).start()


def progress(query) -> tuple[int, float]:
    """Rows read so far and rows a second, from the query's own reports."""
    reports = query.recentProgress
    return sum(p["numInputRows"] for p in reports), (reports[-1]["processedRowsPerSecond"] if reports else 0.0)


class StepSize:
    """Steps for the next quantum from the speed of the last runs."""

    def __init__(self, quantum: float = 0.5, first: int = 100, memory: int = 7) -> None:
        self.quantum, self.first, self.runs = quantum, first, deque(maxlen=memory)

    def ran(self, steps: int, seconds: float) -> None:
        if steps > 0 and seconds > 0:
            self.runs.append((steps, seconds))

    def steps(self) -> int:
        if not self.runs:
            return self.first
        return max(1, int(sum(s for s, _ in self.runs) / sum(t for _, t in self.runs) * self.quantum))


def prefixes(df: DataFrame, order: str, steps: int) -> Iterator[DataFrame]:
    """Growing prefixes of a table by the range of an ordering column; the last is the table."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    for k in range(1, steps):
        yield df.filter(F.col(order) <= lo + (hi - lo) * k / steps)
    yield df


class Extremum:
    """Largest (or least) value that survives harmless updates and deletions.

    The id that holds it is remembered; only a change of that id asks for a new pass.
    """

    def __init__(self, column: str, which: str = "max", rid: str = "_rid") -> None:
        self.column, self.which, self.rid, self.best = column, which, rid, None

    def _of(self, df: DataFrame) -> tuple | None:
        sign = 1 if self.which == "max" else -1
        row = df.filter(F.col(self.column).isNotNull()).agg(F.max(F.struct((sign * F.col(self.column)).alias("v"), (-F.col(self.rid)).alias("i")))).first()[0]
        return None if row is None else (sign * row["v"], -row["i"])

    def changed(self, changes: DataFrame, table: DataFrame) -> tuple | None:
        """(value, id) after compacted changes; ``table`` is the table after them, read only when needed."""
        if self.best is not None and changes.filter(F.col(self.rid) == self.best[1]).isEmpty():
            new = self._of(changes.filter("_op <> 'D'"))
            better = new and (new[0] > self.best[0] if self.which == "max" else new[0] < self.best[0])
            self.best = new if better else self.best
        else:
            self.best = self._of(table)
        return self.best


def trace_of(query) -> list[dict]:
    """One row for each batch of a query: run, start, duration, rows, state."""
    return [{"run": p["batchId"], "start": p["timestamp"], "duration": p["batchDuration"], "rows": p["numInputRows"], "state": "ready"} for p in query.recentProgress]
