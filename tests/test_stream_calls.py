"""The event stream talks to the state store a few times per slot."""

from types import SimpleNamespace

import pandas as pd

from trackscore.streaming.events import HysteresisEvents


class Store:
    """Counts calls; a map, a value and timers like those of a stream's handle."""

    def __init__(self):
        self.calls, self.map, self.value, self.timers = 0, {}, None, set()

    def getMapState(self, *_):
        def put(key, value):
            self.map[key] = value

        return SimpleNamespace(
            getValue=self.counted(self.map.get), updateValue=self.counted(put), removeKey=self.counted(self.map.pop),
            keys=self.counted(lambda: iter(list(self.map))), containsKey=self.counted(self.map.__contains__),
            exists=self.counted(lambda: bool(self.map)))

    def getValueState(self, *_):
        def put(value):
            self.value = value

        return SimpleNamespace(
            get=self.counted(lambda: self.value), update=self.counted(put), clear=self.counted(lambda: put(None)),
            exists=self.counted(lambda: self.value is not None))

    def counted(self, run):
        def call(*args):
            self.calls += 1
            return run(*args)

        return call

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_slots_cost_few_calls(spark):
    store, stream = Store(), HysteresisEvents(0.6, 0.3, 1.0, idle_ms=5_000, slot_ms=10_000)
    stream.init(store)
    seconds = [*range(0, 300), *range(320, 330), 700]
    frame = pd.DataFrame({"at_ms": [1000 * s for s in reversed(seconds)], "row_ord": seconds[::-1],
                          "timestamp": [float(s) for s in reversed(seconds)], "score": 0.9, "scored": True})
    list(stream.handleInputRows(("v", 0), iter([frame]), None))
    assert store.timers == {10_000}
    slots, found = len(store.map), []
    for watermark in (5_000, 250_000, 330_000, 10_000_000):
        for at in sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(at)
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
            expired = SimpleNamespace(getExpiryTimeInMs=lambda: at)
            found += [tuple(r[2:4]) for out in stream.handleExpiredTimer(("v", 0), times, expired) for r in out.to_numpy().tolist()]
    assert found == [(0.0, 299.0), (320.0, 329.0)]
    assert not store.map and store.value is None and not store.timers
    assert store.calls <= 4 * slots + 20
