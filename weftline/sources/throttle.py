"""A token bucket per host for fetchers: rate tokens a second, room for twice that, shared by a worker's threads."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from urllib.parse import urlparse


class HostBuckets:
    def __init__(self, rate: float = 2.0, burst: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst or 2 * rate, clock, sleep
        self.held: dict[str, tuple[float, float]] = {}
        self.lock = threading.Lock()

    def reserve(self, host: str) -> float:
        """Take a token and return how long to wait until it is there."""
        with self.lock:
            now = self.clock()
            tokens, then = self.held.get(host, (self.burst, now))
            tokens = min(self.burst, tokens + (now - then) * self.rate) - 1
            self.held[host] = tokens, now
        return max(0.0, -tokens / self.rate)

    def wait(self, url: str) -> None:
        delay = self.reserve(urlparse(url).netloc)
        if delay:
            self.sleep(delay)


#: The buckets of this Python process by rate: its tasks, one after the other or in threads, share them.
_SHARED: dict[float, HostBuckets] = {}
_LOCK = threading.Lock()


def shared_buckets(rate: float) -> HostBuckets:
    with _LOCK:
        return _SHARED.setdefault(rate, HostBuckets(rate))


def throttled(fetcher, rate: float = 2.0):
    """A fetcher that keeps to the rate per host within each worker process, over all its tasks; repartition by host so that one worker has a host."""

    def fetch(url: str):
        shared_buckets(rate).wait(url)
        return fetcher(url)

    return fetch
