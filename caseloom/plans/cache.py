"""Driver-side cache of query results: least recently used, with an age limit."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from threading import RLock
from typing import Any


def stable_hash(payload: Any) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()


def key_for(namespace: str, payload: Any, prefix: str = "") -> str:
    return ":".join(x for x in (namespace, prefix, stable_hash(payload)) if x)


class Cache:
    """Entries leave when they are the least recently used of more than `most`, or older than
    ttl seconds (0: never).  A hit refreshes recency, a set also the age."""

    def __init__(self, most: int = 2000, ttl: float = 0.0, clock=time.monotonic) -> None:
        self.most, self.ttl, self._clock = most, ttl, clock
        self._rows: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self._lock = RLock()
        self.hits = self.misses = 0

    def get(self, key: str) -> tuple[bool, Any]:
        with self._lock:
            row = self._rows.get(key)
            if row and self.ttl and self._clock() - row[0] > self.ttl:
                del self._rows[key]
                row = None
            if row is None:
                self.misses += 1
                return False, None
            self._rows.move_to_end(key)
            self.hits += 1
            return True, row[1]

    def set(self, key: str, value: Any) -> None:
        with self._lock:
            self._rows[key] = (self._clock(), value)
            self._rows.move_to_end(key)
            while len(self._rows) > self.most:
                self._rows.popitem(last=False)

    def invalidate_prefix(self, prefix: str) -> int:
        with self._lock:
            gone = [k for k in self._rows if k.startswith(prefix)]
            for k in gone:
                del self._rows[k]
            return len(gone)

    def stats(self) -> dict[str, Any]:
        total = self.hits + self.misses
        return {
            "hits": self.hits, "misses": self.misses, "entries": len(self._rows),
            "hit_rate": f"{100 * self.hits / total:.1f}%" if total else "N/A",
        }
