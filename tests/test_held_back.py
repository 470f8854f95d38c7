"""What the state of a fusion reads and writes."""

from types import SimpleNamespace

import pandas as pd

from terralog.streaming import state

HOUR = 3600 * 1000


class Held(list):
    """A list state that counts its calls."""

    def __init__(self):
        self.calls = []

    def get(self):
        self.calls.append("get")
        return iter(list(self))

    def put(self, rows):
        self.calls.append("put")
        self[:] = rows

    def appendList(self, rows):
        self.calls.append("append")
        self.extend(rows)


def frame(*ms):
    return pd.DataFrame({"source": "a", "source_order": 0, "event_id": [f"a::{m}" for m in ms], "ts": pd.to_datetime(list(ms), unit="ms"), "arrival": 0, "at_ms": ms})


def test_events_ahead_of_the_horizon_are_only_added(monkeypatch):
    timers, clock = set(), SimpleNamespace(mark=9 * HOUR)
    clock.getCurrentWatermarkInMs = lambda: clock.mark
    monkeypatch.setattr(state, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(getLocalProperty=lambda _: "3")))
    events = Held()
    held = state.HoldBack(HOUR, ("a",), HOUR)
    held.init(SimpleNamespace(getListState=lambda *a: events, registerTimer=timers.add))
    first = 20 * HOUR
    for k in range(50):
        assert list(held.handleInputRows((20, 0), iter([frame(first + 2 * k + 1), frame(first + 2 * k)]), clock)) == []
    assert events.calls == ["append"] * 100 and min(timers) == first - HOUR
    clock.mark = first + 10 - HOUR
    out = list(held.handleExpiredTimer((20, 0), clock, SimpleNamespace(getExpiryTimeInMs=lambda: first - HOUR)))
    assert sorted(out[0]["event_id"]) == sorted(f"a::{first + k}" for k in range(11)) and len(events) == 89
    assert min(t for t in timers if t > clock.mark) == first + 11 - HOUR
