"""Answers as they arrive: the first valid attempt of each document and group, or the error that ends it.

The batch form is extraction.select_attempts.  Here attempts come late, repeated or out of order, so what is known of a
document's group waits as state until it is decided: as soon as the attempts up to the deciding one are there, numbered
from 1, or when its time is up.  A row of state holds a bucket of groups as JSON, with one timer, the first of theirs:
a call for each group would cost far more than its work.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeframe.plans.extraction import MAX_ATTEMPTS, RETRYABLE, STATUS
from citeframe.shipping import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ("doc_id", "name")
TIMEOUT, OK = 504, 200
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

#: number, error and answer of an attempt
Attempt = tuple[int, str | None, str]


def decided(known: list[Attempt], last: bool) -> tuple[int, Attempt | None] | None:
    """Status and attempt that end a group, from its attempts in order; None while that is open.  last: no more are waited for."""
    ended: Attempt | None = None
    for place, attempt in enumerate(known[:MAX_ATTEMPTS]):
        if not last and attempt[0] != place + 1:  # an earlier one may still come
            return None
        ended = attempt
        if attempt[1] is None:
            return OK, attempt
        if attempt[1] not in RETRYABLE:
            return STATUS.get(attempt[1], STATUS["api"]), attempt
    if ended is not None and len(known) >= MAX_ATTEMPTS:
        return STATUS[ended[1]], ended
    return (TIMEOUT, ended) if last else None


#: What is known of a group: the time of its timer, and its attempts in order; null once it is decided.
Known = tuple[int, list[Attempt] | None]


def _arrived(groups: dict[str, Known], rows: Iterator[pd.DataFrame]) -> dict[str, tuple[int, list[Attempt]]]:
    """Of each open group that rows came for: the first time of these, and its first attempts, the ones known before among them."""
    first: dict[str, int] = {}
    came: dict[str, dict[int, Attempt]] = {}
    for r in rows:
        error = r["error"].astype(object).where(r["error"].notna(), None)
        for group, at, new in zip(r["group"].tolist(), r["millis"].tolist(), zip(r["attempt"].tolist(), error.tolist(), r["answer"].tolist())):
            known = came.get(group)
            if known is None:
                before = groups.get(group)
                if before is not None and before[1] is None:  # decided before
                    continue
                known = came[group] = {a[0]: tuple(a) for a in before[1]} if before else {}
                first[group] = at
            elif at < first[group]:
                first[group] = at
            same = known.setdefault(new[0], new)
            if same != new:  # of an attempt that is told twice, one stays, whichever comes first in a batch
                known[new[0]] = min(same, new, key=lambda a: (a[1] is not None, a[1] or "", a[2]))
    return {group: (first[group], [known[n] for n in sorted(known)[:MAX_ATTEMPTS]]) for group, known in came.items()}


def step(groups: dict[str, Known], rows: Iterator[pd.DataFrame], now: int, wait_ms: int, keep_ms: int) -> list[tuple[int, str, str | None]]:
    """Brings the groups of a bucket up to the watermark `now` with the rows that came; status, group and answer of those that this decides."""
    told = []

    def tell(group: str, found: tuple[int, Attempt | None], until: int) -> None:
        groups[group] = (until, None)
        told.append((found[0], group, found[1][2] if found[1] else None))

    for group, (first, known) in _arrived(groups, rows).items():
        found = decided(known, False)
        if found is None:
            groups[group] = (groups[group][0] if group in groups else first + wait_ms, known)
        else:
            tell(group, found, max(first, now) + keep_ms)
    for group, (timer, known) in [g for g in groups.items() if g[1][0] <= now]:
        if known is None:  # kept for repeated answers long enough
            del groups[group]
        else:
            tell(group, decided([tuple(a) for a in known], True), timer + keep_ms)
    return told


def first_valid(responses: DataFrame, at: str = "at", *, late: str = "10 minutes", wait: int = 30 * 60, keep: int = 24 * 3600, buckets: int = 1024) -> DataFrame:
    """A stream of responses (doc_id, name, attempt, error, more) to one row for each document's group: all its columns, and status.

    status: 200 with the first valid attempt, else that of the error that ends the group, with the attempt that had it,
    or 504 where the attempts to decide it haven't come within `wait` seconds of the first one; its columns are then those of
    the last that came.  `at` is when a response was given; one that is later than the watermark, `late`, is passed
    over, and so are responses after the decision, for `keep` seconds.  Responses without an attempt's number are
    passed over.

    Groups are put into `buckets` by checksum, and a batch reads and writes the whole state of each bucket that it has rows
    of: so many that what is known of one fits a task with ease.  The number is fixed for the life of a checkpoint.
    """
    spark = responses.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    ship(spark)
    text = lambda columns: F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), MICROS)
    more = [c for c in responses.columns if c not in KEYS]
    rows = responses.filter("attempt is not null").withWatermark(at, late).select(text(KEYS).alias("group"), F.col(at).alias("at"), F.unix_millis(at).alias("millis"), F.col("attempt").cast("int").alias("attempt"), F.col("error").cast("string").alias("error"), text(more).alias("answer")).filter("attempt is not null")

    def bucket(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        gc.disable()  # a bucket makes many small objects and no cycles; looking for these took 40 % of the time of a step
        try:
            groups = json.loads(state.get[0]) if state.exists else {}
            told = step(groups, frames, now, wait * 1000, keep * 1000)
            known = json.dumps(groups, separators=(",", ":"))
        finally:
            gc.enable()
        if groups:
            state.update((known,))
            # Spark calls when the watermark is beyond the time that is set, which must be beyond the present one
            state.setTimeoutTimestamp(max(min(g[0] for g in groups.values()) - 1, now + 1))
        else:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["status", "group", "answer"])

    found = rows.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandasWithState(
        bucket, "status int, group string, answer string", "groups string", "append", GroupStateTimeout.EventTimeTimeout)
    read = lambda column, columns: F.from_json(column, responses.select(*[f"`{c}`" for c in columns]).schema, MICROS)
    found = found.select("status", read("group", KEYS).alias("k"), read("answer", more).alias("r"))
    return found.select(*[F.col(f"{'k' if c in KEYS else 'r'}.`{c}`") for c in responses.columns], "status")
