"""Streams over the same functions as the batch operators.

Rolling health is a windowed aggregation with watermarks; change detection and the circuit breaker keep
a small state per key in ``applyInPandasWithState``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures in a row that open a circuit, and seconds until one probe is let through.
OPEN_AT, HALF_OPEN_AFTER = 5, 60.0


def rolling_health(events: DataFrame, group: str, at: str, value: str, failed: Column, length: str = "24 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Attempts, failures and mean value per group and sliding window."""
    marked = events.withColumn("_failed", failed.cast("int")).withWatermark(at, late)
    out = marked.groupBy(F.window(at, length, slide), group).agg(F.count(F.lit(1)).alias("attempts"), F.sum("_failed").alias("failures"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), group, "attempts", "failures", "mean")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    digest, version = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    out = []
    for ts, text in zip(rows["ts"], rows["text"]):
        now = hashlib.md5((text or "").encode()).hexdigest()
        if now != digest:
            out.append((key[0], ts, version, digest is None, now))
            digest, version = now, version + 1
    state.update((digest, version))
    yield pd.DataFrame(out, columns=["url", "ts", "version", "baseline", "digest"])


def changes(snapshots: DataFrame) -> DataFrame:
    """A row whenever the text of a url (url, ts, text) differs from the one before; the first sets the baseline."""
    return snapshots.select("url", "ts", "text").groupBy("url").applyInPandasWithState(
        _change, "url string, ts timestamp, version int, baseline boolean, digest string", "digest string, version int", "append", GroupStateTimeout.NoTimeout
    )


def breaker_step(state: tuple[str, int, float], at: float, ok: bool) -> tuple[str, int, float]:
    """The circuit after one attempt at a time: (closed, open or half_open, failures in a row, when opened).

    A closed circuit opens at OPEN_AT failures; an open one lets a probe through after HALF_OPEN_AFTER seconds: its
    success closes the circuit, its failure opens it anew.
    """
    phase, failures, since = state
    if phase == "open":
        if at - since < HALF_OPEN_AFTER:
            return state
        phase = "half_open"
    if ok:
        return "closed", 0, 0.0
    failures += 1
    return ("open", failures, at) if phase == "half_open" or failures >= OPEN_AT else ("closed", failures, since)


def _breaker(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else ("closed", 0, 0.0)
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    out = []
    for at, ok in zip(rows["at"], rows["ok"]):
        following = breaker_step(tuple(now), float(at), bool(ok))
        if following[0] != now[0]:
            out.append((key[0], float(at), now[0], following[0]))
        now = following
    state.update(tuple(now))
    yield pd.DataFrame(out, columns=["backend", "at", "was", "phase"])


def circuit_breaker(attempts: DataFrame) -> DataFrame:
    """Phase changes per backend of a stream of attempts (backend, at in seconds, ok)."""
    return attempts.select("backend", "at", "ok").groupBy("backend").applyInPandasWithState(
        _breaker, "backend string, at double, was string, phase string", "phase string, failures int, since double", "append", GroupStateTimeout.NoTimeout
    )
