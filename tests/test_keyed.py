"""Calls that keyed processors make to the state: few per key and batch, however many rows a key gets."""

import pandas as pd

from plumbline.streaming import keyed


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802 - Spark's name
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


class Cell:
    """A value, list or map of the state."""

    def __init__(self, handle):
        self.handle, self.held = handle, []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held if isinstance(self.held, tuple) else iter(self.held)

    def update(self, value):
        self.handle.calls += 1
        self.held = tuple(value)

    def put(self, rows):
        self.handle.calls += 1
        self.held = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.handle.calls += 1
        self.held = [*self.held, *rows]

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, *_):  # noqa: N802
        return Cell(self)

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_a_slot_of_rows_has_one_timer_and_one_write():
    held, handle = keyed.Lifetimes(), Handle()
    held.init(handle)
    ends = pd.to_datetime([3_000 + i for i in range(500)] + [3_000], unit="ms")
    rows = pd.DataFrame({"row_id": [*range(500), 0], "expire_at": ends})  # row 0 comes twice
    told = pd.concat(held.handleInputRows(("thread", None), iter([rows]), Times(0)))
    assert len(told) == 501 and set(told.state) == {"kept"} and handle.calls <= 4 and handle.timers == [3_000]
    gone = pd.concat(held.handleExpiredTimer(("thread", None), Times(3_100), Times(3_000)))
    assert sorted(gone.row_id) == list(range(100)) and handle.timers[-1] == 3_100
    gone = pd.concat(held.handleExpiredTimer(("thread", None), Times(9_000), Times(3_100)))
    assert sorted(gone.row_id) == list(range(100, 500)) and not held.rows.exists()


def test_a_version_with_many_urls_is_written_once():
    scans, handle = keyed.Scans(60_000), Handle()
    scans.init(handle)
    tries = lambda ok, at: pd.DataFrame({"url": [f"u{i}" for i in range(300)], "at": pd.to_datetime(at, unit="ms"), "event_id": range(300), "ok": ok})
    told = pd.concat(scans.handleInputRows((1, 0), iter([tries(False, 1_000)]), Times(0)))
    assert set(told.kind) == {"waiting"} and len(told) == 300 and handle.calls == 2 and handle.timers == [61_000]
    asked = pd.concat(scans.handleExpiredTimer((1, 0), Times(62_000), Times(61_000)))
    assert set(asked.kind) == {"ask"} and set(asked.attempt) == {2} and len(asked) == 300 and handle.calls == 3
    told = pd.concat(scans.handleInputRows((1, 0), iter([tries(True, 70_000)]), Times(62_000)))
    assert set(told.kind) == {"done"} and set(told.attempt) == {2}
    assert not list(scans.handleInputRows((1, 0), iter([tries(False, 80_000)]), Times(70_000)))
