"""What streams hold and how often they are woken."""

import numpy as np
import pandas as pd

from vacancia.streaming import alerts, deliveries, limits


class Handle:
    """Timers that were set, and a list as state."""

    def __init__(self):
        self.timers, self.held = [], []

    registerTimer = property(lambda self: self.timers.append)
    exists = lambda self: bool(self.held)
    get = lambda self: iter(self.held)
    appendList = property(lambda self: self.held.extend)

    def put(self, rows):
        self.held = list(rows)

    getCurrentWatermarkInMs = lambda self: self.passed
    passed = 0


def test_requests_are_judged_in_pieces_with_nulls():
    times = np.array(["2024-01-01T00:00:00", "2024-01-01T00:00:00.25", "NaT"], "datetime64[ns]")
    assert limits._seconds(times)[:2] == [1704067200.0, 1704067200.25] and np.isnan(limits._seconds(times)[2])
    data = [float(i * 7 % 50 + i) for i in range(300)]
    whole, _ = limits.grant(sorted(data), [], 5, 9)
    first, log = limits.grant(sorted(data)[:111], [], 5, 9)
    assert limits.PIECE > 0 and first + limits.grant(sorted(data)[111:], log, 5, 9)[0] == whole


def test_a_frame_of_the_log_holds_many_deliveries():
    log = [(1000, 1, "queued", "queued", 0, "k", "m", "u", None, None, None), (2000, None, "kept", *(None,) * 8)]
    out = deliveries._frame([7, None], log)
    assert out["opportunity_id"].tolist() == [7, pd.NA] and out["seq"].tolist() == [1, pd.NA] and str(out["at"][1]) == "1970-01-01 00:00:02"


def test_held_events_of_an_opportunity_take_one_timer():
    p, h = deliveries.Deliveries(), Handle()
    p.handle, p.waiting, p.delivery = h, h, Handle()
    p.delivery.update = p.delivery.put
    frame = pd.DataFrame([{c: None for c in deliveries._HELD} | {"at_ms": t, "seq": t, "kind": "offer"} for t in (30, 10, 20)])
    assert list(p.handleInputRows(("1",), iter([frame]), h)) == [] and h.timers == [10]
    h.passed = 15
    (log,) = p.handleExpiredTimer(("1",), h, None)
    assert log["seq"].tolist() == [10] and h.timers == [10, 20] and len(h.held) == 2


def test_held_runs_of_a_source_take_one_timer():
    p, h = alerts.Alerts(), Handle()
    p.handle, p.waiting, p.known = h, h, Handle()
    p.known.update = lambda row: None
    frame = pd.DataFrame([{c: None for c in alerts._COLUMNS} | {"at_us": t * 1000, "id": t, "status": "succeeded", "discovered_count": 1, "limit_reached": False, "delivered": True} for t in (30, 10, 20)])
    assert list(p.handleInputRows(("1",), iter([frame]), h)) == [] and h.timers == [10]
    h.passed = 15
    (log,) = p.handleExpiredTimer(("1",), h, None)
    assert log["run_id"].tolist() == [10] and h.timers == [10, 20] and len(h.held) == 2
