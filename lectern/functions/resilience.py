"""Calls that may fail: retries with growing waits, and a circuit breaker."""

from __future__ import annotations

import functools
import random
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def wait_before(attempt: int, base: float = 1.0, most: float = 60.0, growth: float = 2.0, jitter: bool = True, draw: Callable[[], float] = random.random) -> float:
    """Seconds before retry ``attempt`` (from 1): growing, up to half more at random, capped."""
    wait = base * growth ** (attempt - 1)
    return min(most, wait * (1 + 0.5 * draw()) if jitter else wait)


def retry(attempts: int = 3, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep, **waits):
    """Calls a function up to ``attempts`` times; other errors pass at once."""
    if attempts < 1:
        raise ValueError("one attempt at least")

    def wrap(f: Callable):
        @functools.wraps(f)
        def call(*args, **kwargs):
            for k in range(1, attempts + 1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if k == attempts:
                        raise
                    sleep(wait_before(k, **waits))

        return call

    return wrap


class CircuitOpen(RuntimeError):
    """The breaker lets no call through."""


class Breaker:
    """Opens after ``most`` failures; after ``rest`` seconds lets one call try.

    Failures older than ``rest`` since the last one are forgotten. Results of
    calls from before a change of state count for nothing.
    """

    def __init__(self, most: int = 5, rest: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.rest, self.clock = most, rest, clock
        self.failures, self.last, self.opened, self.trying, self.turn = 0, None, None, False, 0
        self._lock = threading.Lock()

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.rest else "open"

    def enter(self) -> int:
        with self._lock:
            state = self.state
            if state == "open" or (state == "half_open" and self.trying):
                raise CircuitOpen(f"{self.failures} failures")
            self.trying = state == "half_open"
            return self.turn

    def leave(self, turn: int, ok: bool) -> None:
        with self._lock:
            if turn != self.turn:
                return
            now = self.clock()
            if ok:
                if self.opened is not None:
                    self.turn += 1
                self.failures, self.opened = 0, None
            else:
                if self.last is not None and now - self.last > self.rest and self.opened is None:
                    self.failures = 0
                self.failures, self.last = self.failures + 1, now
                if self.opened is not None or self.failures >= self.most:
                    self.opened = now
                    self.turn += 1
            self.trying = False

    def __call__(self, f: Callable):
        @functools.wraps(f)
        def call(*args, **kwargs):
            turn = self.enter()
            try:
                out = f(*args, **kwargs)
            except Exception:
                self.leave(turn, False)
                raise
            self.leave(turn, True)
            return out

        return call


def breaker_states(log: DataFrame, key: str, most: int = 5, rest: float = 60.0) -> DataFrame:
    """(key, t, state): a breaker's state after every outcome of (key, t, ok), by time.

    A call while it is open changes nothing. A key's log is folded batch by
    batch in one task, its state alone in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        now = [0.0]
        for f in frames:
            states = []
            for name, t, ok in zip(f[key], f["t"], f["ok"], strict=True):
                if name not in held:
                    held.clear()
                    held[name] = Breaker(most, rest, lambda: now[0])
                now[0] = t
                breaker = held[name]
                try:
                    breaker.leave(breaker.enter(), bool(ok))
                except CircuitOpen:
                    pass
                states.append(breaker.state)
            yield pd.DataFrame({key: f[key], "t": f["t"], "state": states})

    kind = log.schema[key].dataType.simpleString()
    return log.select(key, "t", "ok").repartition(key).sortWithinPartitions(key, "t").mapInPandas(run, f"{key} {kind}, t double, state string")
