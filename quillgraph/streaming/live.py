"""Streaming forms: running accuracy over arriving trajectories, windows of late events, and the
budget machine with a state per sample."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgraph.functions.numbers import rate
from quillgraph.operators.replay import TOOL_COSTS


def running_accuracy(trajectories: DataFrame, key: str) -> DataFrame:
    """n, correct and accuracy per key so far (output mode complete or update)."""
    hit = F.count_if("is_correct")
    return trajectories.groupBy(key).agg(F.count("*").alias("n"), hit.alias("correct"), rate(hit, F.count("*")).alias("accuracy"))


def windowed_usage(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Calls and tokens per tool and window; events later than the watermark are dropped by design."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "tool")
    return w.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "tool", "calls", "tokens")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """A row for each run of a sample's calls (sample, ts, tokens) without a longer gap, once the watermark has
    passed its end. Rows behind the watermark are dropped; one that is not may still join two sessions."""
    s = events.withWatermark("ts", late).groupBy("sample", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select("sample", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls", "tokens")


STATE = "left int, ran int, rejected int, run int, submitted boolean, stopped boolean, turn int"


def turned(state: tuple, turn: int, tool: str, stop_after: int = 2) -> tuple:
    """The budget machine's next state: rejected calls add to a run, which the turn's end looks at."""
    left, ran, rejected, run, submitted, stopped, at = state
    if stopped or (turn > at and (run >= stop_after or submitted)):
        return (left, ran, rejected, run, submitted, True, at)
    cost = TOOL_COSTS.get(tool, 0)
    if cost > left and tool != "submit_answer":
        return (left, ran, rejected + 1, run + 1, submitted, False, turn)
    return (left - cost, ran + 1, rejected, 0, submitted or tool == "submit_answer", False, turn)


class BudgetMachine(StatefulProcessor):
    """State per sample: what is left and how the last turns went. In event time a timer closes a sample that
    has been idle, and its state goes; without one, the state has a time to live."""

    def __init__(self, budget: int, idle_ms: int, keep_ms: int) -> None:
        self.budget, self.idle_ms, self.keep_ms = budget, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", f"{STATE}, due long", self.keep_ms or None)

    def _row(self, key: tuple, state: tuple, closed: bool) -> pd.DataFrame:
        left, ran, rejected, _, submitted, stopped, _ = state
        return pd.DataFrame({"sample": [key[0]], "left": [left], "ran": [ran], "rejected": [rejected], "submitted": [submitted], "stopped": [stopped], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        state = tuple(known[:7]) if known else (self.budget, 0, 0, 0, False, False, -1)
        new = pd.concat(list(rows)).sort_values(["turn", "n"])
        for turn, tool in zip(new["turn"].tolist(), new["tool"].tolist()):
            state = turned(state, turn, tool)
        due = max(int(new["ts"].max().timestamp() * 1000) + self.idle_ms, known[7] if known else 0) if self.idle_ms else 0
        if self.idle_ms and (not known or known[7] != due):
            if known:
                self.handle.deleteTimer(known[7])
            self.handle.registerTimer(due)
        self.state.update((*state, due))
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = tuple(self.state.get()[:7])
            self.state.clear()
            yield self._row(key, state, True)

    def close(self) -> None:
        pass


def budget_states(calls: DataFrame, budget: int = 30, late: str = "10 minutes", idle_minutes: int = 60, keep_hours: int = 0) -> DataFrame:
    """calls (sample, ts, turn, n, tool), as they come: what each sample has left, ran and had rejected so far, in
    order of turn and n within what has come; a last row, closed, once the watermark is idle_minutes behind its
    last call. Rows behind the watermark are dropped. With keep_hours there are no timers and no watermark: a state
    goes when it has not changed for so long by the clock. Needs the RocksDB state store."""
    kinds = dict(calls.dtypes)
    out = f"sample {kinds['sample']}, left int, ran int, rejected int, submitted boolean, stopped boolean, closed boolean"
    if keep_hours:
        return calls.groupBy("sample").transformWithStateInPandas(BudgetMachine(budget, 0, keep_hours * 3_600_000), out, "Update", "ProcessingTime")
    return calls.withWatermark("ts", late).groupBy("sample").transformWithStateInPandas(BudgetMachine(budget, idle_minutes * 60_000, 0), out, "Update", "EventTime")
