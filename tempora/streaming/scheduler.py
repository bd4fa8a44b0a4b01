"""Driver-side jobs at their times: periodic and single ones, on two threads. Streams have triggers; this is for what is no stream."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

TICK_S, THREADS = 0.1, 2


@dataclass
class _Job:
    work: Callable[[], object]
    due: float
    every: float | None
    runs: int = 0


class Scheduler:
    """Jobs begin within a tick of their time. One that raises is logged and goes on at its next time; `stop` waits for those running."""

    def __init__(self, tick_s: float = TICK_S):
        self.tick, self.jobs, self.lock, self.over = tick_s, {}, threading.Lock(), threading.Event()
        self.pool, self.last = ThreadPoolExecutor(THREADS), 0
        self.thread = threading.Thread(target=self._turn, daemon=True)
        self.thread.start()

    def every(self, seconds: float, work: Callable[[], object]) -> int:
        return self._add(_Job(work, time.monotonic() + seconds, seconds))

    def once(self, seconds: float, work: Callable[[], object]) -> int:
        return self._add(_Job(work, time.monotonic() + seconds, None))

    def cancel(self, job: int) -> bool:
        with self.lock:
            return self.jobs.pop(job, None) is not None

    def stop(self) -> None:
        self.over.set()
        self.thread.join()
        self.pool.shutdown()

    def _add(self, job: _Job) -> int:
        with self.lock:
            self.last += 1
            self.jobs[self.last] = job
            return self.last

    def _turn(self) -> None:
        while not self.over.wait(self.tick):
            now = time.monotonic()
            with self.lock:
                for k, job in [(k, j) for k, j in self.jobs.items() if j.due <= now]:
                    job.runs += 1
                    self.pool.submit(self._run, job.work)
                    if job.every is None:
                        del self.jobs[k]
                    else:
                        job.due = now + job.every

    def _run(self, work: Callable[[], object]) -> None:
        try:
            work()
        except Exception:
            logging.getLogger(__name__).exception("a scheduled job failed")
