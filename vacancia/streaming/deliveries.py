"""Deliveries as keyed state: queued, claimed, sent, failed with backoff, recovered or skipped.

Events of an opportunity are applied in the order of their time, not of their arrival: a stream holds them in state until the watermark
has passed them. A failed delivery becomes due by a timer. The same transitions run over a table in one sorted pass, so a
replay of the log gives the stream's rows.

Events (opportunity_id, at, seq, kind, event_key, message_text, source_url, ok, error, hidden, recorded_at); seq settles equal times. Kinds:

* offer: a candidate in its window. New ones are queued; queued ones take key and message; failed ones the key alone; others stand.
* claim: a candidate is about to be sent. Refused if pending, sent or skipped; deferred while a failed one waits; else pending.
* retry: a stored message is about to be sent. Refused if there is none, if it waits, or if it is queued and the opportunity hidden.
* result: of sending: sent, or failed with one more attempt and the next one after a delay that doubles up to an hour.
* recover: at the start of a cycle, of what is still pending: sent if its message was recorded, else failed.
* skip: a candidate while notifications are paused. New and queued ones are skipped, others stand.
* sweep: whatever is queued is skipped.

Defined results: an unknown kind changes nothing ("ignored"); a null opportunity is a key of its own; events behind the watermark change nothing
("late"); no events give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "opportunity_id long, at timestamp, seq long, kind string, event_key string, message_text string, source_url string, ok boolean, error string, hidden boolean, recorded_at timestamp"
DELIVERY = "status string, attempts long, event_key string, message_text string, source_url string, next_ms long, sent_ms long, last_error string, told boolean"
LOG = "opportunity_id long, at timestamp, seq long, action string, status string, attempts long, event_key string, message_text string, source_url string, next_attempt_at timestamp, sent_at timestamp, last_error string"
_FIELDS = [f.split()[0] for f in DELIVERY.split(", ")]
#: The log as a task makes it: times in milliseconds.
_LOG_MS = LOG.replace("timestamp", "long")
_LOGGED = Row(*(f.split()[0] for f in LOG.split(", ")))
_HELD = ("at_ms", "seq", "kind", "event_key", "message_text", "source_url", "ok", "error", "hidden", "recorded_ms")
_HELD_SCHEMA = "at_ms long, seq long, kind string, event_key string, message_text string, source_url string, ok boolean, error string, hidden boolean, recorded_ms long"
#: State as JSON, a text for all events that came at once and one for all deliveries: a row of state each costs more than its transition.
_TEXTS_SCHEMA, _STATE_SCHEMA = "events string", "deliveries string"
#: Opportunities of neighbouring ids, two to the power of it, that share a key of state: each call for a key's state or timer costs more than a walk.
SHARED_BITS = 4
# Seconds until the next attempt double up to an hour; the longest error that is kept.
FIRST_DELAY, MOST_DELAY, MOST_ERROR = 60, 3600, 2000
INTERRUPTED = "Interrupted before delivery confirmation."
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def delay_ms(attempts: int) -> int:
    return 1000 * min(MOST_DELAY, FIRST_DELAY * 2 ** min(6, max(0, attempts - 1)))


def _ended(d: dict, at: int, sent_at: int | None, error: str | None) -> dict:
    """A pending delivery after its attempt: sent at a time, or failed."""
    attempts = d["attempts"] + 1
    if sent_at is not None:
        return d | {"status": "sent", "attempts": attempts, "sent_ms": sent_at, "last_error": None, "next_ms": None, "told": False}
    return d | {"status": "failed", "attempts": attempts, "sent_ms": None, "last_error": error and error[:MOST_ERROR], "next_ms": at + delay_ms(attempts), "told": False}


def advance(d: dict | None, e: dict) -> tuple[dict | None, str]:
    """The delivery of an opportunity after an event, and what the event did."""
    kind, at, status = e["kind"], e["at_ms"], d and d["status"]
    content = {"message_text": e["message_text"], "source_url": e["source_url"]}
    fresh = {"attempts": 0, "event_key": e["event_key"], **content, "next_ms": None, "sent_ms": None, "last_error": None, "told": False}
    waits = d is not None and d["next_ms"] is not None and d["next_ms"] > at
    if kind == "offer":
        if d is None:
            return {"status": "queued", **fresh}, "queued"
        if status == "queued":
            return d | {"event_key": e["event_key"], **content}, "refreshed"
        return (d | {"event_key": e["event_key"]}, "rekeyed") if status == "failed" else (d, "kept")
    if kind == "claim":
        if d is None:
            return {"status": "pending", **fresh}, "claimed"
        if status not in ("queued", "failed"):
            return d, "refused"
        d = d | {"event_key": e["event_key"]}
        if status == "failed" and waits:
            return d, "deferred"
        told = d["message_text"] is not None and d["source_url"] is not None
        return d | {"status": "pending", "last_error": None, "next_ms": None, "told": False} | ({} if told else content), "claimed"
    if kind == "retry":
        if status not in ("queued", "failed") or d["message_text"] is None or d["source_url"] is None or waits or status == "queued" and e["hidden"]:
            return d, "refused"
        return d | {"status": "pending", "last_error": None, "next_ms": None, "told": False}, "claimed"
    if kind in ("result", "recover"):
        if status != "pending":
            return d, "refused"
        sent_at = (at if e["ok"] else None) if kind == "result" else e["recorded_ms"]
        d = _ended(d, at, sent_at, e["error"] if kind == "result" else INTERRUPTED)
        return d, d["status"]
    if kind == "skip" and d is None:
        return {"status": "skipped_paused", **fresh, "message_text": None, "source_url": None}, "skipped"
    if kind in ("skip", "sweep"):
        if status != "queued":
            return d, "kept"
        return d | {"status": "skipped_paused", "next_ms": None, "last_error": None} | ({"event_key": e["event_key"]} if kind == "skip" else {}), "skipped"
    return d, "ignored"


def walk(d: dict | None, events: list[dict], until: int) -> tuple[dict | None, list[tuple]]:
    """The delivery after events in the order of their time, all at ``until`` or before, and a log row for each of them and for each time it became due."""
    log: list[tuple] = []

    def told(at: int, seq: int | None, action: str) -> None:
        log.append((at, seq, action, *((d["status"], d["attempts"], d["event_key"], d["message_text"], d["source_url"], d["next_ms"], d["sent_ms"], d["last_error"]) if d else (None,) * 8)))

    def due(by: int) -> dict | None:
        if d is None or d["status"] != "failed" or d["told"] or d["next_ms"] is None or d["next_ms"] > by:
            return d
        told(d["next_ms"], None, "due")
        return d | {"told": True}

    for e in events:
        d = due(e["at_ms"])
        d, action = advance(d, e)
        told(e["at_ms"], e["seq"], action)
    d = due(until)
    return d, log


def _frame(keys: list, log: list[tuple]) -> pd.DataFrame:
    """Log rows of one or many opportunities, with the key of each."""
    out = pd.DataFrame(log, columns=["at", "seq", "action", "status", "attempts", "event_key", "message_text", "source_url", "next_attempt_at", "sent_at", "last_error"])
    for c in ("at", "next_attempt_at", "sent_at"):
        out[c] = pd.to_datetime(pd.array(out[c].tolist(), "Int64"), unit="ms", utc=True).tz_localize(None)
    out["seq"], out["attempts"] = (pd.array(out[c].tolist(), "Int64") for c in ("seq", "attempts"))
    out.insert(0, "opportunity_id", pd.array(keys, "Int64"))
    return out


def _events(frame: pd.DataFrame) -> list[dict]:
    """Rows as dictionaries of plain values, nulls as None."""
    whole = ("at_ms", "seq", "recorded_ms")
    plain = lambda c, values: [None if v is None else int(v) for v in values] if c in whole else values
    columns = [plain(c, frame[c].astype(object).where(frame[c].notna(), None).tolist()) for c in _HELD]
    return [dict(zip(_HELD, r)) for r in zip(*columns)]


def _order(e: dict) -> tuple[int, int]:
    return e["at_ms"], -1 if e["seq"] is None else e["seq"]


def _in_ms(events: DataFrame) -> DataFrame:
    ms = lambda c: F.floor(F.unix_micros(c) / 1000).alias(c.replace("at", "at_ms") if c == "at" else "recorded_ms")
    return events.select("opportunity_id", "at", ms("at"), "seq", "kind", "event_key", "message_text", "source_url", "ok", "error", "hidden", ms("recorded_at"))


class Deliveries(StatefulProcessor):
    """An opportunity a key. Value state: the delivery. List state: events that the watermark hasn't passed. Timers: the earliest held event's time, the time of the next attempt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.delivery = handle.getValueState("delivery", DELIVERY)
        self.waiting = handle.getListState("waiting", _HELD_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = [e for frame in rows for e in _events(frame)]
        late = [e for e in events if e["at_ms"] <= passed and passed > 0]
        new = [e for e in events if not (e["at_ms"] <= passed and passed > 0)]
        if new:
            self.waiting.appendList([tuple(e[c] for c in _HELD) for e in new])
            self.handle.registerTimer(min(e["at_ms"] for e in new))  # the others' times follow as it fires
        if late:
            yield _frame([int(key[0]) if key[0] else None] * len(late), [(e["at_ms"], e["seq"], "late", *(None,) * 8) for e in sorted(late, key=_order)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(_HELD, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in held if e["at_ms"] <= passed), key=_order)
        before = dict(zip(_FIELDS, self.delivery.get())) if self.delivery.exists() else None
        after, log = walk(before, ready, passed)
        if ready:
            rest = [tuple(e[c] for c in _HELD) for e in held if e["at_ms"] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        if after is not None and after != before:
            self.delivery.update(tuple(after[f] for f in _FIELDS))
            if after["status"] == "failed" and not after["told"] and after["next_ms"] > passed:
                self.handle.registerTimer(after["next_ms"])
        if log:
            yield _frame([int(key[0]) if key[0] else None] * len(log), log)

    def close(self) -> None:
        pass


class NeighbouringDeliveries(StatefulProcessor):
    """Value state: the deliveries of the opportunities of a key. List state: events that the watermark hasn't passed. Timers: the earliest time of a held event or a next attempt.

    Rows are plain ones, not frames: a key has few in a batch, and a frame of each costs more than its transitions. They are (key, at, event as JSON).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deliveries = handle.getValueState("deliveries", _STATE_SCHEMA)
        self.waiting = handle.getListState("waiting", _TEXTS_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = json.loads("[" + ",".join(row[2] for row in rows) + "]")
        late = [e for e in events if e["at_ms"] <= passed] if passed > 0 else []
        new = [e for e in events if e["at_ms"] > passed] if late else events
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self.handle.registerTimer(min(e["at_ms"] for e in new))  # the others' times follow as it fires
        for e in sorted(late, key=_order):
            yield _LOGGED(e["opportunity_id"], e["at_ms"], e["seq"], "late", *(None,) * 8)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [e for (events,) in self.waiting.get() for e in json.loads(events)]
        found = self.deliveries.get()
        before: dict[str, dict] = {} if found is None else json.loads(found[0])
        ready: dict[str, list[dict]] = {name: [] for name, d in before.items() if _attempt(d, passed) is not None}
        for e in sorted((e for e in held if e["at_ms"] <= passed), key=_order):
            ready.setdefault(_name(e), []).append(e)
        after = dict(before)
        for name, events in ready.items():
            d, log = walk(before.get(name), events, passed)
            if d is not None:
                after[name] = d
            yield from (_LOGGED(int(name) if name else None, *row) for row in log)
        rest = [e for e in held if e["at_ms"] > passed]
        if len(rest) < len(held):
            self.waiting.put([(json.dumps(rest),)]) if rest else self.waiting.clear()
        if after != before:
            self.deliveries.update((json.dumps(after),))
        times = [e["at_ms"] for e in rest] + [d["next_ms"] for d in after.values() if _attempt(d) is not None]
        if times and (ready or rest):
            self.handle.registerTimer(min(times))

    def close(self) -> None:
        pass


def _name(e: dict) -> str:
    """An opportunity's name in a key's state."""
    return "" if e["opportunity_id"] is None else str(e["opportunity_id"])


def _attempt(d: dict, by: int | None = None) -> int | None:
    """When a failed delivery comes due, if nothing has told so and it is so by a time."""
    at = d["next_ms"] if d["status"] == "failed" and not d["told"] else None
    return at if at is None or by is None or at <= by else None


def delivery_log(events: DataFrame, delay: str = "0 seconds", neighbours: bool = True) -> DataFrame:
    """The log of a stream of events that come at most ``delay`` late; its session needs the state store STORE.

    ``neighbours`` share a key of state, which spares calls and frames; without it an event rewrites the state of its opportunity alone.
    """
    rows, opportunity = _in_ms(events).withWatermark("at", delay), F.col("opportunity_id")
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("key")  # noqa: E731  a null key's rows may fall to another key's state
    if not neighbours:
        return rows.select(key(opportunity), "*").groupBy("key").transformWithStateInPandas(Deliveries(), LOG, "append", "eventTime")
    event = F.to_json(F.struct("opportunity_id", *_HELD), {"ignoreNullFields": "false"}).alias("event")
    shared = rows.select(key(F.shiftright(opportunity, SHARED_BITS)), "at", event).groupBy("key")
    log = shared.transformWithState(NeighbouringDeliveries(), _LOG_MS, "append", "eventTime")
    return log.withColumns({c: F.timestamp_millis(c) for c in ("at", "next_attempt_at", "sent_at")})


def replay(events: DataFrame, until_ms: int) -> DataFrame:
    """The log of a table of events up to a time. An opportunity's events are read in order; a task holds a batch of rows and one delivery."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, d, started = None, None, False
        for frame in frames:
            keys = [None if pd.isna(k) else int(k) for k in frame["opportunity_id"]]
            bounds = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            held, named, out = _events(frame), [], []  # a frame of rows gives a frame of the log, however many opportunities it has
            for i, j in zip(bounds, [*bounds[1:], len(keys)]):
                key = keys[i]
                if started and key != at:
                    _, log = walk(d, [], until_ms)
                    named += [at] * len(log)
                    out += log
                if not started or key != at:
                    at, d, started = key, None, True
                d, log = walk(d, held[i:j], held[j - 1]["at_ms"] - 1)
                named += [key] * len(log)
                out += log
            if out:
                yield _frame(named, out)
        if started:
            _, log = walk(d, [], until_ms)
            if log:
                yield _frame([at] * len(log), log)

    ordered = _in_ms(events).where(F.col("at_ms") <= until_ms).repartition("opportunity_id").sortWithinPartitions("opportunity_id", "at_ms", F.asc_nulls_first("seq"))
    return ordered.mapInPandas(run, LOG)


def current(log: DataFrame) -> DataFrame:
    """The delivery of each opportunity after its log."""
    last = F.struct("at", F.col("seq").isNull(), "seq")
    return log.where("status is not null").groupBy("opportunity_id").agg(F.max_by(F.struct("status", "attempts", "event_key", "message_text", "source_url", "next_attempt_at", "sent_at", "last_error"), last).alias("d")).select("opportunity_id", "d.*")
