"""What an engine does and did: event frames, jobs over changes, and counters of its searches."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql.streaming.listener import StreamingQueryListener

from ..streaming import changes

#: The tag of Spark jobs that belong to an index job, by which they can be stopped.
TAG = "index-job"


class Frames:
    """Events as JSON lines, one frame each: kind (job, log, watch-batch, watch-state) and the fields that are set."""

    def __init__(self, write: Callable[[str], object]) -> None:
        self.write = write

    def emit(self, kind: str, **fields) -> None:
        self.write(json.dumps({"kind": kind, **{k: v for k, v in fields.items() if v is not None}}, sort_keys=True))


class StreamFrames(StreamingQueryListener):
    """A followed change stream as frames: watch-state when it starts and ends, watch-batch for each batch with rows."""

    def __init__(self, frames: Frames) -> None:
        self.frames = frames

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.frames.emit("watch-state", enabled=True, message=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.frames.emit("watch-batch", batch=p.batchId, pendingChangeCount=p.numInputRows, elapsedMs=p.durationMs.get("triggerExecution"))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.frames.emit("watch-state", enabled=False, level="error" if event.exception else "info", message=event.exception)


class Jobs:
    """Index jobs of one engine over one source, one at a time.

    Changes wait until `enqueue` closes them into the queued job; what is offered meanwhile waits for the next
    one, and no change is dropped, but by `cancel_pending`. A job that has a file which calls for a rebuild is a whole index, any
    other a refresh. Methods may be called from several threads; `run` holds no lock while its job runs.
    """

    def __init__(self, engine, root, frames: Frames | None = None) -> None:
        self.engine, self.root, self.frames = engine, root, frames or Frames(lambda line: None)
        self.pending: dict[str, None] = {}
        self.queued: dict[str, None] = {}
        self.active = False
        self.last: tuple[str, str] | None = None
        self.counts: Counter = Counter()
        self._state = threading.RLock()

    def offer(self, paths: Iterable[str]) -> int:
        """Adds changed paths that are watched; the number that wait."""
        with self._state:
            self.pending |= dict.fromkeys(p for p in paths if not p.startswith(tuple(changes.WATCH_IGNORED)))
            self.frames.emit("watch-batch", pendingChangeCount=len(self.pending), pendingPaths=[*self.pending])
            return len(self.pending)

    @staticmethod
    def _job(paths: Iterable[str]) -> str:
        return "index" if any(map(changes.asks_rebuild, paths)) else "refresh"

    def enqueue(self) -> bool:
        """Closes the waiting changes into the queued job, with those of one that is already queued."""
        with self._state:
            if not self.pending:
                return False
            self.queued |= self.pending
            self.pending = {}
            self.frames.emit("job", job=self._job(self.queued), state="queued", source="watch", changedPaths=[*self.queued])
            return True

    def run(self, mode: str = "full") -> bool:
        """Runs the queued job, if there is one and none runs."""
        with self._state:
            if self.active or not self.queued:
                return False
            paths, self.queued = self.queued, {}
        try:
            self._run(self._job(paths), mode, "watch", [*paths])
        except Exception:
            with self._state:  # its changes go to the next job
                self.queued = paths | self.queued
            raise
        return True

    def _run(self, job: str, mode: str, source: str, paths: list[str] | None = None) -> None:
        with self._state:
            if self.active:
                raise RuntimeError("a job is running")
            self.active, self.last = True, (job, mode)
        context, began = self.engine.spark.sparkContext, time.time()
        self.frames.emit("job", job=job, state="running", mode=mode, source=source, changedPaths=paths)
        state = "failed"
        context.addJobTag(TAG)
        try:
            (self.engine.index if job == "index" else self.engine.refresh)(self.root, mode)
            state = "completed"
        finally:
            context.removeJobTag(TAG)
            with self._state:
                self.active = False
                self.counts[state] += 1
            self.frames.emit("job", job=job, state=state, mode=mode, source=source, elapsedMs=round(1000 * (time.time() - began)))

    def cancel_pending(self) -> list[str]:
        """Drops the queued job and the waiting changes; the paths that they had."""
        with self._state:
            paths = [*(self.queued | self.pending)]
            if not paths:
                raise LookupError("no job is pending")
            if self.queued:
                self.frames.emit("job", job=self._job(self.queued), state="canceled", source="watch", changedPaths=[*self.queued])
            self.queued, self.pending = {}, {}
            self.counts["canceled"] += 1
            return paths

    def supersede_pending(self) -> bool:
        """Replaces the queued job by one that has the waiting changes as well, and runs it unless another job runs."""
        with self._state:
            if not self.queued and not self.pending:
                raise LookupError("no job is pending")
            if self.queued:
                self.frames.emit("job", job=self._job(self.queued), state="canceled", source="watch", changedPaths=[*self.queued])
            self.pending, self.queued = self.queued | self.pending, {}
            self.counts["superseded"] += 1
            self.enqueue()
        return self.run()

    def retry_last(self) -> None:
        """Runs the last job again, whole or as a refresh, as it was."""
        if not self.last:
            raise LookupError("no job has run")
        self._run(*self.last, source="manual")

    def interrupt(self) -> None:
        """Stops the Spark jobs of the running index job; it fails, and the active generation goes on serving."""
        self.engine.spark.sparkContext.cancelJobsWithTag(TAG)


class SearchCounters:
    """Running totals of searches by lane: calls, lexical candidates, those ranked again and results, with the last of each."""

    FIELDS = ("lexical_candidates", "reranked", "results")

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.total: dict[str, Counter] = {}
        self.last: dict[str, dict[str, int]] = {}

    def add(self, lane: str, found: dict[str, int]) -> None:
        self.total.setdefault(lane, Counter()).update({"calls": 1, **{f: found[f] for f in self.FIELDS}})
        self.last[lane] = {f: found[f] for f in self.FIELDS}

    def report(self) -> dict[str, dict[str, int]]:
        return {lane: dict(c) | {f"last_{f}": n for f, n in self.last[lane].items()} for lane, c in self.total.items()}
