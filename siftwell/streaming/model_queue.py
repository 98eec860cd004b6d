"""A rate-limited queue before a model, as keyed state with timers.

One key is one account. Its requests wait in order; one is served when the queue is free, and the next a spacing later.
A limit that passes (requests or tokens per minute) holds the whole queue for as long as the answer says, or longer with
each retry; a day's limit, or tokens that come back too late, end the queue, and so does the budget of calls. What waits
then leaves with the reason and without a call.

Time is that of the timers: with `EventTime` the watermark's, so a run over stored requests is the same whenever it is
run; with `ProcessingTime` the cluster's. Requests are served at the time that they became due, in one go up to now.

Defined cases: requests of one batch queue by time, then id; a model that raises anything but `Limited` fails that request
alone; a null text is asked as ''; the model gets the text and how often it was refused before; a request that comes after the queue ended leaves at once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from siftwell.operators.summaries import limit_of


class Limited(Exception):
    """The model's service refused a request for its limits; the message says which."""


@dataclass(frozen=True)
class Limits:
    """Seconds between calls, calls at most, retries of one request, the longest wait, and what a retry waits at least."""

    spacing: float = 7.0
    budget: int = 12
    retries: int = 2
    longest_wait: float = 120.0
    backoff: float = 20.0


def verdict(message: str, retry: int, limits: Limits) -> tuple[str, float | None]:
    """What a refusal means: `wait` and for how many seconds, `fail` for this request, or `stop` for all; retry: how many there were."""
    kind, seconds = limit_of(message)
    if kind == "daily" or kind == "tpm" and (seconds is None or seconds > limits.longest_wait):
        return "stop", None
    if kind == "unknown" or (seconds or 0) > limits.longest_wait or retry >= limits.retries:
        return "fail", None
    return "wait", max(limits.backoff * (retry + 1), seconds or 0.0)


SCHEMA = "queue string, id bigint, answer string, error string, calls int, started timestamp"


#: Requests of a block, and those of a batch that are sorted at once.
BLOCK, RUN = 1000, 50_000


class ModelQueue(StatefulProcessor):
    """Requests wait in state, in blocks; a task holds a few blocks, however many requests a key has."""

    def __init__(self, model: Callable[[str, int], str], limits: Limits, block: int = BLOCK, run: int = RUN):
        self.model, self.limits, self.block, self.run = model, limits, block, run

    def init(self, handle) -> None:
        self.handle = handle
        #: When the queue is free (ms), calls made, why it ended, how often the first request was refused.
        self.line = handle.getValueState("line", "free bigint, calls int, ended string, retry int")
        #: The block of the first that waits, its place there, and the block after the last.
        self.place = handle.getValueState("place", "head bigint, at int, tail bigint")
        self.waiting = handle.getMapState("waiting", "block bigint", "rows string")
        self.sorting = handle.getMapState("sorting", "run bigint, block bigint", "rows string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._queued(self._sorted(rows))
        yield from self._served(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._served(key[0], timerValues)

    def _sorted(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """A batch's requests (ready, id, text) by time, then id: sorted in runs, which are merged."""
        held, runs = [], []
        for new in frames:
            ready = new["ts"].astype("datetime64[ms]").astype("int64")
            held += [(int(r), int(i), t or "") for r, i, t in zip(ready, new["id"], new["text"], strict=True)]
            if len(held) >= self.run:
                runs.append(self._put_run(len(runs), sorted(held)))
                held = []
        return heapq.merge(*(self._taken(r, n) for r, n in enumerate(runs)), sorted(held))

    def _put_run(self, run: int, rows: list[tuple]) -> int:
        for k, at in enumerate(range(0, len(rows), self.block)):
            self.sorting.updateValue((run, k), (json.dumps(rows[at : at + self.block]),))
        return k + 1

    def _taken(self, run: int, blocks: int) -> Iterator[tuple]:
        for k in range(blocks):
            rows = json.loads(self.sorting.getValue((run, k))[0])
            self.sorting.removeKey((run, k))
            yield from map(tuple, rows)

    def _queued(self, rows: Iterator[tuple]) -> None:
        head, at, tail = self.place.get() if self.place.exists() else (0, 0, 0)
        while part := list(islice(rows, self.block)):
            self.waiting.updateValue((tail,), (json.dumps(part),))
            tail += 1
        self.place.update((head, at, tail))

    def _served(self, queue: str, times) -> Iterator[pd.DataFrame]:
        """Serves what is due by now; leaves a timer for the next."""
        now = max(times.getCurrentWatermarkInMs(), times.getCurrentProcessingTimeInMs() if times.getCurrentWatermarkInMs() < 0 else 0)
        free, calls, ended, retry = self.line.get() if self.line.exists() else (0, 0, None, 0)
        head, at, tail = self.place.get() if self.place.exists() else (0, 0, 0)
        due = True
        while due and head < tail:
            out, waiting = [], json.loads(self.waiting.getValue((head,))[0])
            while at < len(waiting):
                ready, number, text = waiting[at]
                start = max(free, ready)
                if ended or calls >= self.limits.budget:
                    ended = ended or "budget"
                    out.append((queue, number, None, ended, 0, None))
                    at, retry = at + 1, 0
                    continue
                if due := start <= now:
                    answer, error, calls, free = None, None, calls + 1, start + int(self.limits.spacing * 1000)
                else:
                    break
                try:
                    answer = self.model(text, retry)
                except Limited as e:
                    error = str(e)
                    what, seconds = verdict(error, retry, self.limits)
                    if what == "wait":
                        retry, free = retry + 1, max(free, start + int(seconds * 1000))
                        continue
                    ended = limit_of(error)[0] if what == "stop" else None
                except Exception as e:  # noqa: BLE001  any other failure is this request's own
                    error = str(e) or type(e).__name__
                out.append((queue, number, answer, error, retry + 1, pd.Timestamp(start, unit="ms")))
                at, retry = at + 1, 0
            yield pd.DataFrame(out, columns=["queue", "id", "answer", "error", "calls", "started"]).astype({"started": "datetime64[ns]"})
            if at == len(waiting):
                self.waiting.removeKey((head,))
                head, at = head + 1, 0
        self.line.update((free, calls, ended, retry))
        self.place.update((head, at, tail))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if head < tail:
            self.handle.registerTimer(max(free, waiting[at][0]))


def served(requests: DataFrame, model: Callable[[str, int], str], limits: Limits = Limits(), event_time: bool = True, late: str = "0 seconds") -> DataFrame:  # noqa: B008
    """queue, id, answer, error, calls, started of requests (queue, id, text, ts), one queue per key.

    The session's state store must be one with timers (RocksDB's).
    """
    rows = requests.selectExpr("queue", "cast(id as bigint) id", "text", "ts")
    if event_time:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("queue").transformWithStateInPandas(ModelQueue(model, limits), SCHEMA, "append", "EventTime" if event_time else "ProcessingTime")
