"""Driver-side helpers: retries, a job queue by priority, evaluation files, commands."""

from __future__ import annotations

import heapq
import itertools
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from caseloom.streaming.events import CLOSED, breaker_step

LOW, NORMAL, HIGH = 10, 5, 0


class Breaker:
    """Circuit breaker around an external scorer."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self._state, self._clock, self._lock = CLOSED, clock, threading.Lock()

    @property
    def state(self) -> str:
        return self._state[0]

    def call(self, f: Callable[[], Any]) -> Any:
        with self._lock:
            allowed = breaker_step(self._state, self._clock(), True)[2]
        if not allowed:
            raise ConnectionError("the circuit is open")
        try:
            out = f()
        except Exception:
            self._record(False)
            raise
        self._record(True)
        return out

    def _record(self, ok: bool) -> None:
        with self._lock:
            self._state = breaker_step(self._state, self._clock(), ok)[0]


def retry(
    f: Callable[[], Any], attempts: int = 3, first: float = 2.0, most: float = 30.0, fallback: Callable[[], Any] | None = None,
    breaker: Breaker | None = None, sleep: Callable[[float], None] = time.sleep,
) -> Any:
    """f's result; waits double from `first` to `most` seconds between attempts."""
    for n in range(attempts):
        try:
            return breaker.call(f) if breaker else f()
        except Exception:
            if n + 1 == attempts:
                if fallback:
                    return fallback()
                raise
            sleep(min(most, first * 2**n))
    raise AssertionError("attempts is at least 1")


@dataclass(order=True)
class Job:
    priority: int
    number: int
    name: str = field(compare=False)
    run: Callable[[], Any] = field(compare=False)
    job_id: str = field(compare=False, default_factory=lambda: uuid.uuid4().hex)
    status: str = field(compare=False, default="pending")
    result: Any = field(compare=False, default=None)
    error: str = field(compare=False, default="")


class JobQueue:
    """Jobs run by priority, then in order of arrival, in a few threads; only pending ones can be
    cancelled.  Spark jobs of different threads share the cluster through FAIR pools."""

    def __init__(self, workers: int = 3) -> None:
        self._heap: list[Job] = []
        self._jobs: dict[str, Job] = {}
        self._count = itertools.count()
        self._ready = threading.Condition()
        self._stopped = False
        self._threads = [threading.Thread(target=self._work, daemon=True) for _ in range(workers)]

    def start(self) -> None:
        for t in self._threads:
            t.start()

    def submit(self, name: str, run: Callable[[], Any], priority: int = NORMAL) -> str:
        job = Job(priority, next(self._count), name, run)
        with self._ready:
            self._jobs[job.job_id] = job
            heapq.heappush(self._heap, job)
            self._ready.notify()
        return job.job_id

    def cancel(self, job_id: str) -> bool:
        with self._ready:
            job = self._jobs.get(job_id)
            if not job or job.status != "pending":
                return False
            job.status = "cancelled"
            return True

    def get(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def list(self, status: str | None = None, limit: int = 50) -> list[Job]:
        jobs = [j for j in self._jobs.values() if status in (None, j.status)]
        return sorted(jobs, key=lambda j: -j.number)[:limit]

    def stop(self) -> None:
        """Finish what is queued, then end the threads."""
        with self._ready:
            self._stopped = True
            self._ready.notify_all()
        for t in self._threads:
            t.join()

    def _work(self) -> None:
        while True:
            with self._ready:
                while not self._heap and not self._stopped:
                    self._ready.wait()
                if not self._heap:
                    return
                job = heapq.heappop(self._heap)
                if job.status != "pending":
                    continue
                job.status = "running"
            try:
                job.result, job.status = job.run(), "completed"
            except Exception as e:  # noqa: BLE001  kept with the job
                job.error, job.status = f"{type(e).__name__}: {e}", "failed"


def evaluation_files(folder: str, case_id: str | None = None) -> list[tuple[str, str]]:
    """(case, path) of *_test.jsonl and gold_queries/[case/]*.jsonl; _ in names stands for -."""
    root = Path(folder)
    found = [(p.stem.removesuffix("_test").replace("_", "-"), str(p)) for p in sorted(root.glob("*_test.jsonl"))]
    for p in sorted(root.glob("gold_queries/**/*.jsonl")):
        name = p.parent.name if p.parent.name != "gold_queries" else p.stem
        found.append((name.replace("_", "-"), str(p)))
    return [f for f in found if case_id in (None, f[0])]


def save_command(text: str, most: int) -> tuple[list[int], str] | None:
    """'save docs 1,3-5 as name' -> ([1, 3, 4, 5], 'name'); numbers beyond `most` are left out."""
    m = re.fullmatch(r"\s*save\s+docs?\s+([\d,\s-]+?)\s+as\s+([\w\-. ]+?)\s*", text, re.I)
    if not m:
        return None
    pages: set[int] = set()
    for part in m[1].split(","):
        if r := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part):
            pages |= set(range(int(r[1]), min(int(r[2] or r[1]), most) + 1))
    return sorted(p for p in pages if 1 <= p <= most), m[2]
