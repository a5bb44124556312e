"""Long operations: run at once or in the background under a job tag, watched, and cancelled by that tag.

An operation goes through its files in batches, each one distributed plan. What
tasks have done is added up by accumulators as they end, and is shown when
somebody asks.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Fixed value: seconds for which a finished operation can still be seen.
KEPT_SECONDS = 15.0


class Stopped(RuntimeError):
    """The operation was cancelled."""


class Counter:
    """Files and chunks that tasks are through with; sent to executors, read by the driver.

    A task that runs again counts again, so shares are cut to what there is.
    """

    def __init__(self, spark: SparkSession):
        self.files, self.chunks = (spark.sparkContext.accumulator(0) for _ in range(2))

    def add(self, files: int, chunks: int) -> None:
        self.files.add(files)
        self.chunks.add(chunks)


@dataclass
class Operation:
    """``total`` and ``done`` count files; ``label`` says what it is about, ``current`` what it works on; ``chunk_total`` is what is expected."""

    id: str
    kind: str
    kb_id: str | None
    label: str
    total: int
    counter: Counter
    done: int = 0
    chunk_total: int = 0
    current: str = ""
    finished: bool = False
    stopped: bool = False
    error: str | None = None
    started_at: float = 0.0
    finished_at: float | None = None
    over: threading.Event = field(default_factory=threading.Event)

    def seen(self) -> int:
        """Files that tasks or whole batches are through with."""
        return min(self.total, max(self.done, self.counter.files.value))


class Operations:
    """Registry of one engine; the state is in memory only."""

    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.time):
        self.spark, self.clock = spark, clock
        self._all: dict[str, Operation] = {}
        self._lock = threading.Lock()

    def _new(self, kind: str, label: str, total: int, kb_id: str | None, chunk_total: int = 0) -> Operation:
        op = Operation(uuid.uuid4().hex, kind, kb_id, label, total, Counter(self.spark), chunk_total=chunk_total, current=label, started_at=self.clock())
        with self._lock:
            self._all[op.id] = op
        return op

    def _work(self, op: Operation, work: Callable[[Operation], object]) -> object:
        """``work`` with its Spark jobs under the operation's tag."""
        context = self.spark.sparkContext
        context.addJobTag(op.id)
        try:
            if op.stopped:
                raise Stopped("stopped by user")
            found = work(op)
            op.done = op.total
            return found
        except Exception as e:
            op.error = "stopped by user" if op.stopped else str(e)[:400]
            if op.stopped:
                raise Stopped(op.error) from e
            raise
        finally:
            context.removeJobTag(op.id)
            op.finished, op.finished_at = True, self.clock()
            op.over.set()

    def run(self, kind: str, label: str, total: int, work: Callable[[Operation], object], kb_id: str | None = None) -> object:
        """Do ``work`` now, watched and cancellable from other threads; gives what it gives, raises ``Stopped`` if cancelled."""
        op = self._new(kind, label, total, kb_id)
        try:
            return self._work(op, work)
        finally:
            with self._lock:
                self._all.pop(op.id, None)

    def start(self, kind: str, total: int, work: Callable[[Operation], object], kb_id: str | None = None, label: str = "", chunk_total: int = 0) -> str:
        """Do ``work`` in a thread; returns the operation's id at once."""
        op = self._new(kind, label or kind, total, kb_id, chunk_total)

        def run():
            try:
                self._work(op, work)
            except Exception:  # noqa: BLE001  kept in the operation: nobody waits here
                pass

        InheritableThread(target=run, daemon=True, session=self.spark).start()
        return op.id

    def without_tag(self, op: Operation, work: Callable[[], object]) -> object:
        """``work`` outside an operation that may be cancelled, whose tag would cancel it too."""
        context = self.spark.sparkContext
        context.removeJobTag(op.id)
        try:
            return work()
        finally:
            context.addJobTag(op.id)

    def view(self, op: Operation) -> dict:
        """What is shown of an operation."""
        done, chunks = op.seen(), op.counter.chunks.value
        return {
            "id": op.id, "kind": op.kind, "kbId": op.kb_id, "label": op.label, "total": op.total, "done": done, "current": op.current,
            "chunkTotal": max(op.chunk_total, chunks), "chunkDone": chunks,
            "progress": 1.0 if op.finished or not op.total else done / op.total, "startedAt": int(1000 * op.started_at),
            "finished": op.finished, "failed": op.stopped or op.error is not None, "error": op.error,
        }

    def active(self) -> list[dict]:
        """What runs, and what ended a short while ago."""
        with self._lock:
            for k in [k for k, o in self._all.items() if o.finished and self.clock() - o.finished_at > KEPT_SECONDS]:
                self._all.pop(k)
            now = list(self._all.values())
        return [self.view(o) for o in now]

    def stop(self, operation_id: str) -> bool:
        """Cancel one, with the jobs that it may still begin; False if there is none or it is over."""
        op = self._all.get(operation_id)
        if op is None or op.finished:
            return False
        op.stopped = True

        def cancel():
            while not op.over.wait(0.2):
                self.spark.sparkContext.cancelJobsWithTag(op.id)

        threading.Thread(target=cancel, daemon=True).start()
        return True

    def stop_all(self) -> int:
        return sum(self.stop(k) for k in list(self._all))

    def wait(self, operation_id: str, seconds: float | None = None) -> None:
        op = self._all.get(operation_id)
        if op is not None:
            op.over.wait(seconds)
