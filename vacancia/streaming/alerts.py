"""Alerts of source runs as keyed state: failures, recoveries and gaps of coverage, with alerts that wait to be sent again.

Runs (source_id, id, started_at, status, limit_reached, discovered_count, delivered) are judged in the order of their start; `delivered` says whether
an alert of this run would reach its reader. A source's state is what was told last, the run before, and its newest
successful runs, so it is bounded however long the source has run. A stream holds runs in state until the watermark has passed them.
The same step reads a table in one sorted pass, so a replay gives the stream's rows.

An alert changes the state only once it is delivered. One of coverage that isn't waits: its reason stays, so the next run with the same gap
gives rise to it again, while a gap that the run before had already shown gives rise to none.

Defined results: runs without a start are left out; a null source is a key of its own; runs behind the watermark change nothing (left out by Spark or told as "late"); a null
`delivered` counts as false, a null limit as not reached, a null count as no evidence of a drop; no runs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacancia.operators.runs import BASELINE_RUNS, DROP_RATIO, LEAST_BASELINE, LIMIT_STREAK, NEWEST

RUN = "source_id long, id long, started_at timestamp, status string, limit_reached boolean, discovered_count long, delivered boolean"
STATE = "source_id long, failure_active boolean, failure_reason string, coverage_active boolean, coverage_reason string"
LOG = "source_id long, run_id long, at timestamp, status string, issue string, event string, delivered boolean, failure_active boolean, failure_reason string, coverage_active boolean, coverage_reason string"
_TOLD = ("failure_active", "failure_reason", "coverage_active", "coverage_reason")
_COLUMNS = ("at_us", "id", "status", "limit_reached", "discovered_count", "delivered")
_HELD = "at_us long, id long, status string, limit_reached boolean, discovered_count long, delivered boolean"
_VALUE = "failure_active boolean, failure_reason string, coverage_active boolean, coverage_reason string, before string, limits array<boolean>, counts array<long>"
_NEW = {"failure_active": False, "failure_reason": None, "coverage_active": False, "coverage_reason": None, "before": None, "limits": [], "counts": []}
_DROP_RUNS = 2


def issue_of(limits: list, counts: list) -> str | None:
    """The coverage issue of successful runs, newest first."""
    if len(limits) >= LIMIT_STREAK and all(limits[:LIMIT_STREAK]):
        return "repeated_limit"
    usual = sorted(c for c in counts[_DROP_RUNS : _DROP_RUNS + BASELINE_RUNS] if c is not None)
    if len(counts) < BASELINE_RUNS or not usual:
        return None
    baseline = round((usual[(len(usual) - 1) // 2] + usual[len(usual) // 2]) / 2)  # halves to even
    low = all(c is not None and c <= DROP_RATIO * baseline for c in counts[:_DROP_RUNS])
    return "discovered_drop" if baseline >= LEAST_BASELINE and low else None


def step(state: dict, run: dict) -> tuple[dict, str | None, str | None]:
    """The state after a run, the run's coverage issue and the alert that it gives rise to."""
    status, delivered, issue, event = run["status"], bool(run["delivered"]), None, None
    after = state | {"before": status}
    if status == "succeeded":
        after["limits"] = [bool(run["limit_reached"]), *state["limits"]][:NEWEST]
        after["counts"] = [run["discovered_count"], *state["counts"]][:NEWEST]
        issue = issue_of(after["limits"], after["counts"])
        if state["failure_active"]:
            event = "recovery"
        elif state["coverage_active"]:
            event = None if issue else "coverage_recovery"
        elif issue is None:
            after["coverage_reason"] = None
        elif state["coverage_reason"] == issue or issue_of(after["limits"][1:], after["counts"][1:]) != issue:
            event = "coverage_issue"
    elif status in ("failed", "partial") and status == state["before"] and not (state["failure_active"] and (state["failure_reason"] or "failed") == status):
        event = "failure" if status == "failed" else "partial"
    if event == "coverage_issue":
        after |= {"coverage_active": delivered, "coverage_reason": issue}
    elif event and delivered:
        after |= {
            "recovery": {"failure_active": False, "failure_reason": None}, "coverage_recovery": {"coverage_active": False, "coverage_reason": None},
            "failure": {"failure_active": True, "failure_reason": status}, "partial": {"failure_active": True, "failure_reason": status},
        }[event]
    return after, issue, event


def _walk(state: dict, key: str, runs: list[dict]) -> tuple[dict, list[tuple]]:
    source, log = int(key) if key else None, []
    for r in runs:
        state, issue, event = step(state, r)
        log.append((source, r["id"], r["at_us"], r["status"], issue, event, bool(r["delivered"]) if event else None, *(state[c] for c in _TOLD)))
    return state, log


def _frame(log: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(log, columns=[c.split()[0] for c in LOG.split(", ")])
    out["at"] = pd.to_datetime(out["at"], unit="us")
    for c in ("delivered", "failure_active", "coverage_active"):
        out[c] = out[c].astype("boolean")
    for k, c in enumerate(("source_id", "run_id")):
        out[c] = pd.array([r[k] for r in log], "Int64")
    return out


def _rows(frame: pd.DataFrame) -> list[dict]:
    """Rows as dictionaries of plain values, nulls as None."""
    whole = ("at_us", "id", "discovered_count")
    columns = ([None if pd.isna(v) else int(v) if c in whole else v for v in frame[c].tolist()] for c in _COLUMNS)
    return [dict(zip(_COLUMNS, r)) for r in zip(*columns)]


def _order(run: dict) -> tuple[int, int]:
    return run["at_us"], -1 if run["id"] is None else run["id"]


def _started(runs: DataFrame) -> DataFrame:
    at = F.col("started_at").cast("timestamp")
    return runs.where("started_at is not null").select(
        F.col("source_id").cast("long").alias("source_id"), at.alias("at"), F.unix_micros(at).alias("at_us"), F.col("id").cast("long").alias("id"), "status", "limit_reached",
        F.col("discovered_count").cast("long").alias("discovered_count"), "delivered",
    )


def _key():
    return F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("key")  # a null key's rows may fall to another key's state


def _told(row) -> dict:
    """A new source's state with what was told before."""
    told = {c: None if pd.isna(row[c]) else row[c] for c in _TOLD}
    return _NEW | told | {c: bool(told[c]) for c in ("failure_active", "coverage_active")}


class Alerts(StatefulProcessor):
    """Value state: what was told and the newest runs. List state: runs that the watermark hasn't passed, with a timer at the earliest one's start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _VALUE)
        self.waiting = handle.getListState("waiting", _HELD)

    def _state(self) -> dict:
        if not self.known.exists():
            return _NEW
        state = dict(zip(_NEW, self.known.get()))
        return state | {c: list(state[c]) for c in ("limits", "counts")}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.known.update(tuple(_told(initialState.iloc[0]).values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late, new = [], []
        for frame in rows:
            for r in _rows(frame):
                (late if 0 < passed and r["at_us"] // 1000 <= passed else new).append(r)
        if new:
            self.waiting.appendList([tuple(r.values()) for r in new])
            self.handle.registerTimer(min(r["at_us"] for r in new) // 1000)  # the others' times follow as it fires
        if late:
            state = self._state()
            yield _frame([(int(key[0]) if key[0] else None, r["id"], r["at_us"], r["status"], None, "late", None, *(state[c] for c in _TOLD)) for r in sorted(late, key=_order)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(_COLUMNS, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r["at_us"] // 1000 <= passed), key=_order)
        if not ready:
            return
        if rest := [tuple(r.values()) for r in held if r["at_us"] // 1000 > passed]:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r["at_us"] for r in held if r["at_us"] // 1000 > passed) // 1000)
        else:
            self.waiting.clear()
        state, log = _walk(self._state(), key[0], ready)
        self.known.update(tuple(state.values()))
        yield _frame(log)

    def close(self) -> None:
        pass


def alert_log(runs: DataFrame, told: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """The log of a stream of finished runs that come at most ``delay`` late, over what was told before it began.

    ``told`` has STATE's columns, a row a source; it is read at the first batch alone. The session needs a RocksDB state store.
    """
    rows = _started(runs).withWatermark("at", delay).select(_key(), "*")
    before = None if told is None else told.select(_key(), *_TOLD).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(Alerts(), LOG, "append", "eventTime", before)


def replay(runs: DataFrame, told: DataFrame) -> DataFrame:
    """The log of a table of finished runs. A source's runs are read in order; a task holds a batch of rows and one source's state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _NEW
        for frame in frames:
            keys, out = frame["key"].tolist(), []
            bounds = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for i, j in zip(bounds, [*bounds[1:], len(keys)]):
                if keys[i] != at:
                    at, state = keys[i], _told(frame.iloc[i])
                state, log = _walk(state, at, _rows(frame.iloc[i:j]))
                out += log
            if out:
                yield _frame(out)

    rows = _started(runs).select(_key(), *_COLUMNS).join(told.select(_key(), *_TOLD), "key", "left")
    return rows.repartition("key").sortWithinPartitions("key", "at_us", F.asc_nulls_first("id")).mapInPandas(run, LOG)
