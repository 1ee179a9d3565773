"""Ledgers of runs in a stream, with typed state (inventory ST-04, A-21, L-07).

A ledger is kept per run: calls and tokens by day and agent while the day is open, then in totals. All that it says follows
from days of event time, not from how the input falls into batches or in which order it comes: a day is added to the totals
when the watermark has passed its end, by a timer, and only then are the limits asked. A run tells once that it is spent, on
the day on which that came about. A run without calls for `idle` whole days is closed, told as idle if it wasn't spent, and
its state is dropped; calls after that open a new ledger. State is thus bounded by open days, agents and live runs.

Cases: calls without a run are one run, without an agent one agent (''), without tokens zero tokens but a call; calls without
a time can't be placed and are left out. Calls later than the watermark allows are dropped by Spark. Repeated calls count
again: pass a stream through `distinct_evidence` first where that can happen. Runs that are neither spent nor idle when the
input ends have no row yet. An empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
SAID = "run_id string, outcome string, reason string, day long, calls long, tokens long, agent string"


@dataclass(frozen=True)
class LedgerLimits:
    """The first of these that is reached, in this order, is the reason."""

    tokens: int = 120_000
    calls: int = 40
    agent_tokens: int = 60_000


class RunLedger(StatefulProcessor):
    """State of one run, one value: open days by agent, tokens by agent, totals with the last day and whether it was told as spent.

    Each access to state is a message to the store's process, so a run's is read and written once for its input of a batch
    and once for all its timers that are due. A day has a timer, and so has the end of the idle days after it, if no other
    open day comes before.
    """

    def __init__(self, limits: LedgerLimits, idle: int):
        self.limits, self.idle = limits, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, None
        self.state = handle.getValueState("run", "days array<long>, day_agents array<string>, day_calls array<long>, day_tokens array<long>, agents array<string>, agent_tokens array<long>, total struct<calls long, tokens long, last long, told boolean>")

    def _read(self) -> None:
        held = self.state.get()
        self.days, self.agents, self.total = {}, {}, None
        if held is not None:
            days, day_agents, day_calls, day_tokens, agents, agent_tokens, total = held
            self.days = {(d, a): (c, t) for d, a, c, t in zip(days, day_agents, day_calls, day_tokens, strict=True)}
            self.agents, self.total = dict(zip(agents, agent_tokens, strict=True)), None if total is None else tuple(total)

    def _write(self) -> None:
        if not self.days and self.total is None:
            self.state.clear()
            return
        cells = list(self.days.items())
        self.state.update(([d for (d, _), _ in cells], [a for (_, a), _ in cells], [c for _, (c, _) in cells], [t for _, (_, t) in cells], list(self.agents), list(self.agents.values()), self.total))

    def _timers(self) -> set[int]:
        """The days at whose beginning the open days ask for a timer."""
        days = sorted({d for d, _ in self.days})
        ends = {d for n, d in enumerate(days) if n + 1 == len(days) or days[n + 1] > d + self.idle}
        return {d + 1 for d in days} | {d + 1 + self.idle for d in ends}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.done = None
        self._read()
        known = self._timers()
        for frame in rows:
            for (day, agent), n, tokens in frame.groupby(["day", "agent"])["tokens"].agg(["size", "sum"]).itertuples():
                calls, before = self.days.get((int(day), str(agent)), (0, 0))
                self.days[int(day), str(agent)] = (calls + int(n), before + int(tokens))
        self._write()
        for day in sorted(self._timers() - known):
            self.handle.registerTimer(day * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that is due by the watermark, by days, at the first of a run's timers; the others find it done."""
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if self.done == (key, mark):
            return
        self.done = (key, mark)
        now, said = mark // DAY_MS, []
        self._read()
        waiting: dict[int, list[tuple[str, int, int]]] = {}
        for (day, agent), (calls, tokens) in self.days.items():
            waiting.setdefault(day, []).append((agent, calls, tokens))
        for day in sorted(waiting):
            self._close_if_idle(key, min(now, day), said)
            if day + 1 > now:
                break
            self._add(key, day, waiting[day], said)
        else:
            self._close_if_idle(key, now, said)
        self._write()
        if said:
            yield pd.DataFrame(said, columns=[c.split(" ")[0] for c in SAID.split(", ")])

    def _add(self, key, day: int, parts: list[tuple[str, int, int]], said: list) -> None:
        calls, tokens, _, told = self.total or (0, 0, 0, False)
        for agent, n, t in parts:
            calls, tokens = calls + n, tokens + t
            self.agents[agent] = self.agents.get(agent, 0) + t
            del self.days[day, agent]
        if not told:
            agent, most = self._largest()
            limits = (("tokens", tokens >= self.limits.tokens), ("calls", calls >= self.limits.calls), ("agent_tokens", most >= self.limits.agent_tokens))
            reason = next((name for name, reached in limits if reached), None)
            if reason:
                said.append((key[0], "spent", reason, day, calls, tokens, agent))
                told = True
        self.total = (calls, tokens, day, told)

    def _close_if_idle(self, key, now: int, said: list) -> None:
        if self.total is None:
            return
        calls, tokens, last, told = self.total
        if last + 1 + self.idle > now:
            return
        if not told:
            said.append((key[0], "idle", None, last, calls, tokens, self._largest()[0]))
        self.agents, self.total = {}, None

    def _largest(self) -> tuple[str, int]:
        return min(self.agents.items(), key=lambda x: (-x[1], x[0]))

    def close(self) -> None:
        pass


def ledgers(calls: DataFrame, limits: LedgerLimits, idle: int = 7, late: str = "1 hour") -> DataFrame:
    """A stream of calls (run_id, agent, tokens, ts timestamp) to rows of SAID; `idle` in whole days."""
    day = F.floor(F.unix_millis("ts") / DAY_MS).cast("long")
    rows = calls.where("ts IS NOT NULL").withWatermark("ts", late).select("ts", F.col("run_id").cast("string"), F.coalesce(F.col("agent").cast("string"), F.lit("")).alias("agent"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), day.alias("day"))
    return rows.groupBy("run_id").transformWithStateInPandas(RunLedger(limits, idle), SAID, "Append", "EventTime")


@contextmanager
def typed_state(spark: SparkSession):
    """Typed state needs the RocksDB store; the session has its own setting back afterwards."""
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
