"""Progress of long work by stages, and its cancellation: each stage's Spark jobs carry a tag of their own."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The work was cancelled before its end."""


class Progress:
    """Told when a stage begins and ends; cancel(), from any thread, stops the running stage's Spark jobs and keeps the
    next ones from starting.

    tell: called with the stage's name, how many are done, and how many there are; what it raises ends the work."""

    def __init__(self, tell: Callable[[str, int, int], None] | None = None) -> None:
        self._tell = tell or (lambda name, done, total: None)
        self._stopped = threading.Event()
        self._lock = threading.Lock()
        self._running: tuple[SparkSession, str] | None = None

    @property
    def cancelled(self) -> bool:
        return self._stopped.is_set()

    def cancel(self) -> None:
        with self._lock:
            self._stopped.set()
            if self._running:
                spark, tag = self._running
                spark.sparkContext.cancelJobsWithTag(tag)

    @contextmanager
    def stage(self, spark: SparkSession, name: str, done: int, total: int) -> Iterator[None]:
        """What runs inside is the stage; its jobs are tagged in the calling thread."""
        tag = f"trackweave-{uuid.uuid4().hex}"
        with self._lock:
            if self.cancelled:
                raise Cancelled(name)
            self._running = (spark, tag)
        self._tell(name, done, total)
        spark.sparkContext.addJobTag(tag)
        try:
            yield
        except Exception as why:
            if self.cancelled:
                raise Cancelled(name) from why
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)
            with self._lock:
                self._running = None
        if self.cancelled:
            raise Cancelled(name)
        self._tell(name, done + 1, total)
