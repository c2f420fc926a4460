"""Continuous forms of the grid aggregation, the request answering and the gap tracking.

Every job has a checkpoint, idempotent output and bounded state: a lost executor or a restarted
driver repeats a micro-batch and leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from phenogrid.schema import STEP_DAYS

WATERMARK = "30 days"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _batch_writer(out: str, fn: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch writer: one folder per micro-batch, overwritten if the batch is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (fn(batch) if fn else batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fn=None,
                  timeout: int | None = None, writer: Callable[[DataFrame, int], None] | None = None) -> None:
    """Work off everything that has arrived, then stop; ``timeout`` (seconds) is the caller's, none by default.

    ``writer`` replaces the usual one, which writes a folder per micro-batch.
    """
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(writer or _batch_writer(out, fn)).trigger(availableNow=True).start()
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream did not finish within {timeout} s")


# --- grid aggregation --------------------------------------------------------------------
def fortnight_stream(obs: DataFrame, key: str, ts: str, value: str, epoch: str, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling 14-day windows counted from ``epoch``, per key."""
    shift = (date.fromisoformat(epoch) - date(1970, 1, 1)).days % STEP_DAYS
    win = F.window(ts, f"{STEP_DAYS} days", startTime=f"{shift} days")
    return (
        obs.withWatermark(ts, watermark).groupBy(win.alias("w"), key)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.sum(F.col(value) * 1000).alias("sum_value"))
        .select(key, F.to_date("w.start").alias("step_start"), "n", "mean_value", "sum_value"))


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Final table of an update-mode job: the row of the latest micro-batch per key."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


# --- request answering -------------------------------------------------------------------
def answer_requests(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                    request_id: str = "request_id", received: str = "received") -> None:
    """Answer each request once: repeats inside the watermark are dropped, the batch function does the rest."""
    once = requests.withWatermark(received, WATERMARK).dropDuplicatesWithinWatermark([request_id])
    run_available(once, out, checkpoint, "append", answer)


# --- late observations -------------------------------------------------------------------
def partial_writer(out: str, keys: list[str], ts: str, value: str, epoch: str, delay_days: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of (count, sum) partials per key and step, those of late rows apart.

    A row is late if it lies more than ``delay_days`` behind the newest row of the batches before.
    Every batch overwrites its own folder with its partials and its newest time, one row, so a repeated batch
    leaves the same table and a restarted job knows how far time had come.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id:
            seen = spark.read.schema("newest timestamp, batch_id long").parquet(f"{out}/newest")
            newest = seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        batch = batch.withColumn("step_start", F.expr(
            f"date_add(date'{epoch}', cast(floor(datediff(cast({ts} as date), date'{epoch}') / {STEP_DAYS}.0D) as int) * {STEP_DAYS})"))
        late = F.lit(False) if newest is None else F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"interval {delay_days} days"), F.lit(False))
        parts = batch.where(F.col(ts).isNotNull()).groupBy(*keys, "step_start", late.alias("late")).agg(
            F.count("*").alias("n"), F.count(value).alias("n_value"), F.sum(value).alias("sum_value"))
        parts.write.mode("overwrite").parquet(f"{out}/partials/batch_id={batch_id}")
        batch.agg(F.max(F.col(ts).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/batch_id={batch_id}")
    return write


def merged_partials(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Final table per key and step: all rows, late ones merged, and how many of them came late."""
    parts = spark.read.parquet(f"{out}/partials")
    return parts.groupBy(*keys, "step_start").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"),
        (F.sum("sum_value") / F.sum("n_value")).alias("mean_value"), (F.sum("sum_value") * 1000).alias("sum_value"))


# --- gap tracking ------------------------------------------------------------------------
GAP_OUTPUT = "mws_id string, step int, ndvi_gap_length int, sensor_reliability double"
DAY_MS = 86_400_000


class GapTracker(StatefulProcessor):
    """Running gap of one location over steps that may arrive out of order.

    A step is held until the watermark has passed its date; then no earlier step can come any more, and held
    steps get their rows in order. State is the held steps (at most those inside the watermark and one delivery; in one entry,
    as every access is a message to the store), the running gap and the last step answered; it is dropped when nothing came for ``expire_days``.
    """

    def __init__(self, expire_days: int):
        self.expire_ms = expire_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block int", "steps array<int>, missing array<boolean>, due array<bigint>")
        self.known = handle.getValueState("known", "gap int, last int, due long")

    def _read(self) -> dict[int, tuple[bool, int]]:
        return {s: (m, d) for _, block in self.held.iterator() for s, m, d in zip(*block)}

    def _write(self, held: dict[int, tuple[bool, int]]) -> None:
        self.held.updateValue((0,), (list(held), [m for m, _ in held.values()], [d for _, d in held.values()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else None
        first, held = None, self._read()
        for frame in rows:
            frame = frame[frame["step"] > (known[1] if known else -1)].drop_duplicates("step")
            due = (frame["due"].astype("datetime64[ms]").astype("int64")).tolist()
            for step, missing, at in zip(frame["step"].tolist(), frame["missing"].tolist(), due):
                held[step] = bool(missing), at
                first = at if first is None else min(first, at)
        if first is not None:
            self._write(held)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((step, missing, at) for step, (missing, at) in self._read().items())
        ready = [h for h in held if h[2] <= now]
        gap, last, due = self.known.get() if self.known.exists() else (0, -1, 0)
        out = []
        for step, missing, at in ready:
            gap = gap + 1 if missing else 0
            last, due = step, max(due, at)
            out.append((key[0], step, gap, max(0.0, 1.0 - 0.3 * (gap > 0) - 0.3 * (gap > 2) - 0.2 * (gap > 3))))
        if out:
            self.known.update((gap, last, due))
            if len(ready) == len(held):
                self.held.clear()
            else:
                self._write({step: (missing, at) for step, missing, at in held if at > now})
        rest = [h[2] for h in held if h[2] > now]
        if rest:
            self.handle.registerTimer(min(rest))
        elif due and due + self.expire_ms <= now:
            self.known.clear()
        elif due:
            self.handle.registerTimer(due + self.expire_ms)
        if out:
            yield pd.DataFrame(out, columns=["mws_id", "step", "ndvi_gap_length", "sensor_reliability"]).astype(
                {"step": "int32", "ndvi_gap_length": "int32"})

    def close(self) -> None:
        pass


def gap_stream(cells: DataFrame, watermark: str = WATERMARK, expire_days: int = 10_000) -> DataFrame:
    """Running gap and reliability per location over arriving grid cells (mws_id, step, date, missing).

    Steps may come in any order inside the watermark and get the row they would have got in order; repeats of a step and
    steps behind the watermark give none. The last steps are answered once the watermark has passed
    them: at the end of a series a closing cell (``closing_cell``) moves it on. Needs the state store that keeps maps.
    """
    due = F.col("date").cast("timestamp")
    arrived = cells.select("mws_id", "step", "missing", due.alias("due")).withWatermark("due", watermark)
    out = arrived.groupBy("mws_id").transformWithStateInPandas(
        GapTracker(expire_days), GAP_OUTPUT, "append", "eventTime")
    return out.where(F.col("mws_id") != CLOSING)


CLOSING = "(end of series)"


def closing_cell(spark: SparkSession, last, watermark_days: int = 30) -> DataFrame:
    """One cell that moves the watermark past ``last``, the newest date of a series."""
    return spark.createDataFrame([(CLOSING, 0, last + timedelta(days=watermark_days + 1), False)], "mws_id string, step int, date date, missing boolean")


@contextmanager
def map_state_store(spark: SparkSession):
    """The state store that map state needs, for the queries started inside."""
    key, mine = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, mine)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
