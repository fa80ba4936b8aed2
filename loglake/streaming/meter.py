"""Live figures of a running log: counters, gauges and histograms."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict


class Meter:
    """Thread-safe. A histogram counts values by the power of two they stay below; its sum and count are kept as well."""

    def __init__(self, name: str):
        self.name, self._lock = name, threading.Lock()
        self._counters: Counter = Counter()
        self._gauges: dict[str, float] = {}
        self._histograms: dict[str, Counter] = defaultdict(Counter)

    def add(self, name: str, n: int = 1, **tags: str) -> None:
        with self._lock:
            self._counters[(name, *sorted(tags.items()))] += n

    def put(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    def record(self, name: str, value: float) -> None:
        with self._lock:
            h = self._histograms[name]
            h["count"] += 1
            h["sum"] += value
            h[f"<{1 << int(value).bit_length()}"] += 1

    def count(self, name: str, **tags: str) -> int:
        with self._lock:
            return self._counters[(name, *sorted(tags.items()))]

    def gauge(self, name: str) -> float | None:
        with self._lock:
            return self._gauges.get(name)

    def histogram(self, name: str) -> dict[str, float]:
        with self._lock:
            return dict(self._histograms.get(name, {}))

    def snapshot(self) -> dict:
        """All figures, under their names with the meter's in front."""
        with self._lock:
            label = lambda k: f"{self.name}.{k[0]}" + "".join(f"{{{a}={b}}}" for a, b in k[1:])
            counters = {label(k): v for k, v in self._counters.items()}
            return counters | {f"{self.name}.{k}": v for k, v in self._gauges.items()} | {f"{self.name}.{k}": dict(v) for k, v in self._histograms.items()}
