"""Structured Streaming operators: gated metrics, episode accumulation, displacement dedup, metric sink."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def keep_moved(x: np.ndarray, y: np.ndarray, threshold: float, start: tuple[float, float] | None) -> np.ndarray:
    """Mask of rows at least ``threshold`` from the last kept one; ``start`` is the one kept before this batch."""
    mask = np.zeros(len(x), bool)
    last = start
    for i in range(len(x)):
        if last is None or (x[i] - last[0]) ** 2 + (y[i] - last[1]) ** 2 >= threshold * threshold:
            mask[i], last = True, (x[i], y[i])
    return mask


def gated_metrics(stream: DataFrame, key: str, metrics: list[str], n: int) -> DataFrame:
    """Accumulates counters per key and emits their means, resetting, once at least ``n`` rows have come in.

    Each task first reduces its own rows to partial sums, so a hot key reaches the state operator as a few
    rows per micro-batch.  The gate is looked at once per micro-batch, like a periodic flush.
    """
    kind = stream.schema[key].dataType
    partial = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in metrics]])

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(key, as_index=False, dropna=False)  # NULL is a key like any other
            out = groups[metrics].sum()
            out["n"] = groups.size()["size"].to_numpy()
            yield out[[key, "n", *metrics]]

    def gate(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = list(state.get) if state.exists else [0, *[0.0] * len(metrics)]
        for part in parts:
            total = [a + b for a, b in zip(total, part[["n", *metrics]].sum())]
        if total[0] >= n:
            state.remove()
            yield pd.DataFrame([[k[0], int(total[0]), *[v / total[0] for v in total[1:]]]], columns=[key, "n", *metrics])
        else:
            state.update((int(total[0]), *[float(v) for v in total[1:]]))

    held = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in metrics]])
    return (
        stream.select(key, *metrics).mapInPandas(combine, partial).groupBy(key)
        .applyInPandasWithState(gate, partial, held, "append", GroupStateTimeout.NoTimeout)
    )


# Rows that came too early are state until the gap before them closes; more than this for one key is an error.
MOST_EARLY = 100_000


def _in_turn(early: bytes | None, due: int, parts: Iterator[pd.DataFrame], order: str) -> tuple[pd.DataFrame, bytes, int]:
    """Rows whose turn has come, the rows that wait, and the next step that is due.

    Steps of a key are numbered densely, so a row waits until all before it have come, whatever batch brings them.
    A step that has been taken already, as a replay would bring it, raises.
    """
    rows = pd.concat([*([pickle.loads(early)] if early else []), *parts]).sort_values(order, ignore_index=True)
    steps = rows[order].to_numpy()
    if len(steps) and (steps[0] < due or (steps[1:] == steps[:-1]).any()):
        raise ValueError(f"a step of {order} came twice")
    ready = int((steps == due + pd.RangeIndex(len(steps)).to_numpy()).cumprod().sum())
    if len(rows) - ready > MOST_EARLY:
        raise ValueError(f"more than {MOST_EARLY} rows wait for step {due + ready}")
    waiting = rows.iloc[ready:]
    return rows.iloc[:ready], pickle.dumps(waiting) if len(waiting) else b"", due + ready


def episode_stream(stream: DataFrame, by: list[str], order: str, first: int = 0) -> DataFrame:
    """Return and length per finished episode of each (environment, agent), for batches in any order.

    ``order`` numbers an agent's steps densely from ``first``.  State is the open episode's sums and the rows that
    came before their turn; both are emptied as episodes are emitted, and the counters of an agent stay.
    """
    out = T.StructType([*[stream.schema[c] for c in by], T.StructField("episode", T.LongType()), T.StructField("episode_return", T.DoubleType()), T.StructField("episode_length", T.LongType())])
    held = T.StructType([T.StructField("episode", T.LongType()), T.StructField("ret", T.DoubleType()), T.StructField("length", T.LongType()), T.StructField("due", T.LongType()), T.StructField("early", T.BinaryType())])

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ret, length, due, early = state.get if state.exists else (0, 0.0, 0, first, b"")
        rows, early, due = _in_turn(early, due, parts, order)
        ended = []
        for reward, done in zip(rows["reward"], (rows["terminal"] > 0) | (rows["truncation"] > 0), strict=True):
            ret, length = ret + reward, length + 1
            if done:
                ended.append([*k, number, ret, length])
                number, ret, length = number + 1, 0.0, 0
        state.update((int(number), float(ret), int(length), int(due), early))
        if ended:
            yield pd.DataFrame(ended, columns=[f.name for f in out.fields])

    return stream.select(*by, order, "reward", "terminal", "truncation").groupBy(*by).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def displacement_stream(stream: DataFrame, by: list[str], order: str, threshold: float, first: int = 0) -> DataFrame:
    """Displacement dedup over a stream, for batches in any order; ``order`` numbers a group's rows densely from ``first``.

    State is the last kept position and the rows that came before their turn.
    """
    held = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("due", T.LongType()), T.StructField("early", T.BinaryType())])

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, y, due, early = state.get if state.exists else (None, None, first, b"")
        rows, early, due = _in_turn(early, due, parts, order)
        kept = rows[keep_moved(rows["x"].to_numpy(float), rows["y"].to_numpy(float), threshold, None if x is None else (x, y))]
        if len(kept):
            x, y = float(kept["x"].iloc[-1]), float(kept["y"].iloc[-1])
        state.update((x, y, int(due), early))
        if len(kept):
            yield kept

    return stream.groupBy(*by).applyInPandasWithState(run, stream.schema, held, "append", GroupStateTimeout.NoTimeout)


def metric_sink(stream: DataFrame, path: str, checkpoint: str):
    """Appends a metric stream to a parquet table, one partition per micro-batch.

    The batch id is the partition and it is overwritten, so a replayed batch after a failure replaces itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_values(table: DataFrame, key: list[str], epoch: str, value: str) -> DataFrame:
    """Newest value per metric key of the sink table."""
    return table.groupBy(*key).agg(F.max_by(value, epoch).alias(value), F.max(epoch).alias(epoch))
