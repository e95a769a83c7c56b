"""Keyed state machines over time: rolling limits, circuit breakers and durable jobs.

Each machine is a plain class with `step(event) -> row` and a serialisable state. The same class runs in a batch replay
(a fold over a key's events in time order) and in Structured Streaming (transformWithStateInPandas).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

try:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
except ImportError:  # the batch replays need no streaming API
    StatefulProcessor = object


class RollingLimiter:
    """At most `requests` admissions and `tokens` tokens in (now - seconds, now]; returns the wait of what is not admitted."""

    fields = (("admitted", "boolean"), ("wait", "double"), ("by_requests", "boolean"), ("by_tokens", "boolean"))

    def __init__(self, requests: int = 6, tokens: float = 1000.0, seconds: float = 60.0, state: list | None = None):
        self.requests, self.tokens, self.seconds, self.held = requests, tokens, seconds, state or []

    def state(self) -> list:
        return self.held

    def step(self, now: float, value: float, kind: str) -> tuple:
        self.held = [x for x in self.held if x[0] > now - self.seconds]
        if value > self.tokens:
            return (False, -1.0, False, True)  # can never fit
        by_requests = len(self.held) >= self.requests
        wait = self.held[0][0] + self.seconds - now if by_requests else 0.0
        used = sum(x[1] for x in self.held)
        by_tokens = used + value > self.tokens
        if by_tokens:
            for at, amount in self.held:
                used -= amount
                if used + value <= self.tokens:
                    wait = max(wait, at + self.seconds - now)
                    break
        if wait > 0:
            return (False, round(wait, 6), by_requests, by_tokens)
        self.held.append([now, value])
        return (True, 0.0, False, False)


class AdaptiveLimiter(RollingLimiter):
    """A rolling limiter whose request limit halves on a throttle, rests for a while, and recovers step by step on successes."""

    fields = (("admitted", "boolean"), ("wait", "double"), ("factor", "double"), ("cooling", "boolean"))

    def __init__(self, requests: int = 6, tokens: float = 1000.0, seconds: float = 60.0, cooldown: float = 30.0, successes: int = 3, throttle: str = "error", state: list | None = None):
        held, self.factor, self.until, self.good = state or [[], 1.0, 0.0, 0]
        super().__init__(requests, tokens, seconds, held)
        self.most, self.cooldown, self.needed, self.throttle = requests, cooldown, successes, throttle

    def state(self) -> list:
        return [self.held, self.factor, self.until, self.good]

    def step(self, now: float, value: float, kind: str) -> tuple:
        if kind == self.throttle:
            self.factor, self.until, self.good = max(0.125, self.factor / 2), now + self.cooldown, 0
            return (False, round(self.cooldown, 6), self.factor, True)
        if now < self.until:
            return (False, round(self.until - now, 6), self.factor, True)
        self.requests = max(1, int(self.most * self.factor))
        admitted, wait, _, _ = super().step(now, value, kind)
        if admitted:
            self.good += 1
            if self.good >= self.needed and self.factor < 1.0:
                self.factor, self.good = min(1.0, self.factor + 0.125), 0
        return (admitted, wait, self.factor, False)


class CircuitBreaker:
    """CLOSED, OPEN after `threshold` failures in a row, HALF_OPEN after the cooldown; one success closes, a failed probe reopens.

    `neutral` kinds prove that the other side answers; with strict=True a neutral answer to a probe reopens instead.
    """

    fields = (("allowed", "boolean"), ("state", "string"), ("streak", "int"))

    def __init__(self, failure: str = "error", neutral: str = "", threshold: int = 2, cooldown: float = 3600.0, strict: bool = False, state: list | None = None):
        self.failure, self.neutral, self.threshold, self.cooldown, self.strict = failure, neutral, threshold, cooldown, strict
        self.name, self.streak, self.until = state or ["CLOSED", 0, 0.0]

    def state(self) -> list:
        return [self.name, self.streak, self.until]

    def step(self, now: float, value: float, kind: str) -> tuple:
        if self.name == "OPEN":
            if now < self.until:
                return (False, self.name, self.streak)
            self.name = "HALF_OPEN"
        bad = kind == self.failure or (self.strict and self.name == "HALF_OPEN" and kind == self.neutral)
        if not bad:
            self.name, self.streak, self.until = "CLOSED", 0, 0.0
        else:
            self.streak += self.name != "HALF_OPEN"
            if self.name == "HALF_OPEN" or self.streak >= self.threshold:
                self.name, self.until = "OPEN", now + self.cooldown
        return (True, self.name, self.streak)


class DurableJob:
    """PENDING, IN_FLIGHT, DEFERRED, SUCCEEDED_LOCKED, TERMINAL: at most three windows of three attempts; the first success stays."""

    fields = (("from_state", "string"), ("to_state", "string"), ("windows", "int"), ("attempts", "int"))

    def __init__(self, success: str = "purchase", permanent: str = "error", windows: int = 3, attempts: int = 3, cooldown: float = 60.0, state: list | None = None):
        self.success, self.permanent, self.most_windows, self.most_attempts, self.cooldown = success, permanent, windows, attempts, cooldown
        self.name, self.windows, self.in_window, self.total, self.until = state or ["PENDING", 0, 0, 0, 0.0]

    def state(self) -> list:
        return [self.name, self.windows, self.in_window, self.total, self.until]

    def step(self, now: float, value: float, kind: str) -> tuple:
        old = self.name
        if old in ("SUCCEEDED_LOCKED", "TERMINAL") or (old == "DEFERRED" and now < self.until):
            return (old, old, self.windows, self.total)
        if old in ("PENDING", "DEFERRED"):
            self.windows, self.in_window = self.windows + 1, 0
        self.in_window, self.total = self.in_window + 1, self.total + 1
        if kind == self.success:
            self.name = "SUCCEEDED_LOCKED"
        elif kind == self.permanent:
            self.name = "TERMINAL"
        elif self.in_window >= self.most_attempts:
            self.name = "TERMINAL" if self.windows >= self.most_windows else "DEFERRED"
            self.until = now + self.cooldown
        else:
            self.name = "IN_FLIGHT"
        return (old, self.name, self.windows, self.total)


def _run(machine, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["at", "event_id"], kind="stable")
    out = [machine.step(float(at), float(v), str(k)) for at, v, k in zip(rows["at"], rows["value"], rows["kind"], strict=True)]
    frame = pd.DataFrame(out, columns=[n for n, _ in machine.fields])
    frame.insert(0, "event_id", rows["event_id"].to_numpy())
    frame.insert(0, "key", rows["key"].to_numpy())
    return frame


def output_schema(make: Callable) -> str:
    return "key long, event_id long, " + ", ".join(f"{n} {t}" for n, t in make().fields)


def replay(events: DataFrame, make: Callable) -> DataFrame:
    """Batch replay of a machine over (key, event_id, at seconds, value, kind): one output row per event."""
    return events.groupBy("key").applyInPandas(lambda rows: _run(make(), rows), output_schema(make))


class Machine(StatefulProcessor):
    """A state machine as a streaming processor; its state is one JSON value per key."""

    def __init__(self, make: Callable):
        self.make = make

    def init(self, handle) -> None:
        self.held = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self.make(state=json.loads(self.held.get()[0])) if self.held.exists() else self.make()
        batch = pd.concat(list(rows), ignore_index=True)
        out = _run(machine, batch)
        self.held.update((json.dumps(machine.state()),))
        yield out

    def close(self) -> None:
        pass


def stream(events: DataFrame, make: Callable) -> DataFrame:
    """The same machine over a stream of events, with its state in the state store (RocksDB)."""
    return events.groupBy("key").transformWithStateInPandas(Machine(make), outputStructType=T._parse_datatype_string(output_schema(make)), outputMode="Append", timeMode="None")
