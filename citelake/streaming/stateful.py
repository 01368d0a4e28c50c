"""Operators with state that is read and written entry by entry: the newest pages of a job, and requests with leases.

State lives in the store of the query (RocksDB, see :func:`with_store`), so an update costs what it touches, whatever the state holds.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citelake.operators.dedup import LEAST_CHARS, PERCENT, shingle_members

CAPACITY = 2000
#: How much of a page's beginning names its fingerprint: a later page that begins alike takes its place.
HEAD_CHARS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Let ``spark`` keep streaming state in RocksDB, which state of several variables needs."""
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.streams.active  # noqa: B018  begins the coordinator of state stores, which a query over a table does not


class Entries:
    """Entries of a map in the store, each read once when it is needed and written once when it has changed.

    Of an ``empty`` map nothing is read, and what goes before it was written leaves no trace, so only what is in the map is held.
    """

    def __init__(self, stored, empty: bool):
        self.stored, self.empty = stored, empty
        self.held: dict[Any, tuple | None] = {}
        self.changed: set[Any] = set()
        self.there: set[Any] = set()

    def get(self, key) -> tuple | None:
        if key not in self.held and not self.empty:
            self.held[key] = None
            if self.stored.containsKey((key,)):
                self.there.add(key)
                self.held[key] = self.stored.getValue((key,))
        return self.held.get(key)

    def put(self, key, value: tuple | None) -> None:
        if not self.empty:
            self.get(key)  # tells whether it is stored
        if value is None and self.empty:
            self.held.pop(key, None)
            self.changed.discard(key)
            return
        self.held[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.stored.updateValue((key,), self.held[key])
            elif key in self.there:
                self.stored.removeKey((key,))
        self.held.clear()
        self.changed.clear()
        self.there.clear()
        self.empty = False


class RecentPages(StatefulProcessor):
    """Whether a page is no near copy of one of the newest ``capacity`` kept pages of its job.

    Fingerprints bear numbers in the order in which they were kept; the oldest goes when there are too many.  An index leads from
    a shingle to the fingerprints among whose least shingles it is, as many as no similar page can avoid all of, so a page
    reads the entries of its own least shingles and the fingerprints that they lead to.
    """

    def __init__(self, percent: int, capacity: int, presorted: bool):
        self.percent, self.capacity, self.presorted = percent, capacity, presorted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "oldest long, following long")
        self.prints = handle.getMapState("prints", "number long", "head string, members array<long>")
        self.heads = handle.getMapState("heads", "head string", "number long")
        self.index = handle.getMapState("index", "member long", "numbers array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frames = rows if self.presorted else [pd.concat(list(rows))]
        begun = self.span.exists()
        span = self.span.get() if begun else (0, 0)
        # a job that begins here has nothing stored: its newest pages are held until all its rows are read, and then written once
        stores = [Entries(stored, not begun) for stored in (self.prints, self.heads, self.index)]
        for frame in frames:
            frame = frame if self.presorted else frame.sort_values("seq")
            kept, span = self._decide(frame["head"], frame["members"], *stores, *span)
            if begun:
                self._store(stores, span)
            yield pd.DataFrame({"job_id": key[0], "seq": frame["seq"].to_numpy(), "kept": kept})
        self._store(stores, span)

    def _store(self, stores: list[Entries], span: tuple[int, int]) -> None:
        for entries in stores:
            entries.flush()
        self.span.update(span)

    def _least(self, members: list[int]) -> list[int]:
        return members[: len(members) + (-len(members) * self.percent) // 100 + 1]

    def _decide(self, heads, sets, prints: Entries, names: Entries, index: Entries, oldest: int, following: int) -> tuple[list[bool], tuple[int, int]]:
        def forget(number: int) -> None:
            for member in self._least(list(prints.get(number)[1])):
                rest = [n for n in index.get(member)[0] if n != number]
                index.put(member, (rest,) if rest else None)
            prints.put(number, None)

        out = []
        for head, members in zip(heads, sets, strict=True):
            own = [] if members is None else np.asarray(members).tolist()
            out.append(not own or not self._copied(own, prints, index))
            if not own or not out[-1]:
                continue
            known = names.get(head)
            number = known[0] if known else following
            if known:
                forget(number)
            else:
                following += 1
            names.put(head, (number,))
            prints.put(number, (head, own))
            for member in self._least(own):
                held = index.get(member)
                index.put(member, ([*held[0], number] if held else [number],))
            while following - oldest > self.capacity:
                gone = prints.get(oldest)
                forget(oldest)
                names.put(gone[0], None)
                oldest += 1
        return out, (oldest, following)

    def _copied(self, own: list[int], prints: Entries, index: Entries) -> bool:
        mine, seen = None, set()
        for member in self._least(own):
            for number in (index.get(member) or ([],))[0]:
                if number in seen:
                    continue
                seen.add(number)
                other = prints.get(number)[1]
                if min(len(own), len(other)) * 100 < max(len(own), len(other)) * self.percent:
                    continue
                mine = set(own) if mine is None else mine
                shared = len(mine.intersection(other))
                if shared * 100 >= (len(own) + len(other) - shared) * self.percent:
                    return True
        return False


def _fingerprints(pages: DataFrame, least_chars: int) -> DataFrame:
    members = F.when(F.length("text") >= least_chars, shingle_members(F.col("text")))
    return pages.select("job_id", "seq", F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS).alias("head"), members.alias("members"))


def deduplicate(pages: DataFrame, percent: int = PERCENT, capacity: int = CAPACITY, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Pages (``job_id, seq, text``) as ``job_id, seq, kept``: each against the job's newest ``capacity`` kept pages, in order of ``seq``.

    A stream is decided batch by batch as it arrives.  Of a table, each job is read in order by one task, whose memory does not
    grow with the job; jobs are independent of each other.  Texts below ``least_chars`` characters or without a shingle (null and
    empty ones too) are kept and not compared with.  A kept page that begins with the same 256 characters as a held one takes its
    place.  An empty table gives an empty one.
    """
    with_store(pages.sparkSession)
    rows = _fingerprints(pages, least_chars)
    if not pages.isStreaming:
        rows = rows.repartition("job_id").sortWithinPartitions("job_id", "seq")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=RecentPages(percent, capacity, not pages.isStreaming),
        outputStructType=f"job_id {pages.schema['job_id'].dataType.simpleString()}, seq long, kept boolean", outputMode="Append", timeMode="None",
    )


class Requests(StatefulProcessor):
    """The state of each request, with a timer for the lease of a locked one."""

    def __init__(self, retries: int, lease_seconds: float):
        self.retries, self.lease_ms = retries, int(lease_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, failures int, until long")

    def close(self) -> None:
        pass

    def _told(self, key, status: str, failures: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"url": [key[0]], "status": [status], "retries": [min(failures, self.retries)], "at": [time.time()]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, failures, until = self.held.get() if self.held.exists() else ("", 0, 0)
        begun = until
        for event in pd.concat(list(rows)).sort_values("seq")["event"]:
            if event == "add" and not status:
                status = "queued"
            elif event == "take" and status == "queued":
                status, until = "locked", timerValues.getCurrentProcessingTimeInMs() + self.lease_ms
            elif event == "complete" and status:
                status, until = "completed", 0
            elif event == "fail" and status in ("queued", "locked"):
                failures, until = failures + 1, 0
                status = "queued" if failures <= self.retries else "dropped"
        if until != begun:
            if begun:
                self.handle.deleteTimer(begun)
            if until:
                self.handle.registerTimer(until)
        self.held.update((status, failures, until))
        yield from self._told(key, status, failures)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, failures, _ = self.held.get()
        status = "queued" if status == "locked" else status
        self.held.update((status, failures, 0))
        yield from self._told(key, status, failures)


def request_queue(events: DataFrame, retries: int = 3, lease_seconds: float = 120.0) -> DataFrame:
    """Queue events (``url, seq, event`` with add, take, complete, fail) as ``url, status, retries, at`` whenever a URL's state may have changed.

    A lock that is older than the lease goes back to the queue by itself; a request is dropped after ``retries`` retries.  A URL
    that is in the queue, done or dropped is not added again.
    """
    with_store(events.sparkSession)
    return events.groupBy("url").transformWithStateInPandas(
        statefulProcessor=Requests(retries, lease_seconds), outputStructType="url string, status string, retries int, at double", outputMode="Update", timeMode="ProcessingTime"
    )
