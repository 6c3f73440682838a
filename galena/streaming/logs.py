"""Incremental versions: log ingestion, and event windows.

Windows over event time are this library's own; logs have integer steps only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_success(stream: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first successful row of each key, by ``order`` within a micro-batch (all columns if none are named); a key's state is that it has one."""
    by = [*order, *(c for c in stream.columns if c not in order)]

    def run(_: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            for _ in batches:
                pass
            return
        rows = pd.concat(list(batches)).sort_values(by, kind="stable")
        state.update((True,))
        yield rows.iloc[:1]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.filter(F.col("met").isNotNull()).groupBy(*keys).applyInPandasWithState(run, kinds, "held boolean", "append", "NoTimeout")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = ()):
    """Appends the first successful row of each key to ``path``; a resumed stream repeats nothing and never reads what it has written."""
    return first_success(stream, keys, order).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_success(stream: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], expire_ms: int = 0) -> DataFrame:
    """keys, value, order: each key's successful row whenever it is later, by ``order``, than what the key's state holds.

    Failed rows (value null) and earlier ones change nothing, whichever batch they come in. With ``expire_ms`` a key's
    state goes when nothing has come for so long; a key that comes back may then repeat what it has said, which ``current`` bears.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (*keys, value, *order)}
    plain = lambda x: x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        best = tuple(plain(rows[c].iloc[-1]) for c in (value, *order))
        if not state.exists or tuple(state.get)[1:] < best[1:]:
            state.update(best)
            yield rows.iloc[-1:][list(kinds)]
        if expire_ms:
            state.setTimeoutDuration(expire_ms)

    shown = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    held = ", ".join(f"`{c}` {kinds[c]}" for c in (value, *order))
    rows = stream.filter(F.col(value).isNotNull()).select(*kinds)
    return rows.groupBy(*keys).applyInPandasWithState(run, shown, held, "update", "ProcessingTimeTimeout" if expire_ms else "NoTimeout")


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], value: str, order: Sequence[str], expire_ms: int = 0, every: str | None = None):
    """Starts writing the changes of ``latest_success`` to ``path``, a folder for each batch: a batch that is run again replaces its own, so a restart repeats nothing.

    Without ``every`` it takes what is there and ends, with it a batch is run so often; only then can states expire.
    """
    if expire_ms and every is None:
        raise ValueError("states expire in a stream that goes on: name how often a batch is run")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    out = latest_success(stream, keys, value, order, expire_ms).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """What an upserted log says now: the latest change of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), *[F.max_by(c, F.struct(*order)).alias(c) for c in order])


def call_limits(stream: DataFrame, key: str, order: str, throttled: str, first: int = 8, most: int = 256) -> DataFrame:
    """key, order and the number of calls allowed at once after each outcome: one more for a call that went through, half for one that was throttled."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        limit = state.get[0] if state.exists else first
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for hit in rows[throttled]:
            limit = max(1, limit // 2) if hit else min(most, limit + 1)
            out.append(limit)
        state.update((limit,))
        yield pd.DataFrame({key: keys[0], order: rows[order], "allowed": out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed int", "allowed int", "append", "NoTimeout")


def first_exposure(stream: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Later exposures of a key with the value of its first; the first is kept as state."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, step, value)}

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(step)
        if not state.exists:
            state.update((rows[value].iloc[0],))
            rows = rows.iloc[1:]
        if len(rows):
            yield pd.DataFrame({key: keys[0], step: rows[step], "first": state.get[0], value: rows[value]})

    out = f"{key} {kinds[key]}, {step} {kinds[step]}, first {kinds[value]}, {value} {kinds[value]}"
    return stream.groupBy(key).applyInPandasWithState(run, out, f"first {kinds[value]}", "append", "NoTimeout")


def tumbling(events: DataFrame, ts: str, width: str, by: Sequence[str], value: str, late: str = "1 day") -> DataFrame:
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(ts, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
