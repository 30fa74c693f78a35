"""Stream sessions read and write state once a bucket of entities, and equal the batch form for NULL and integer keys."""

import pandas as pd

from netsieve.streaming import sessions as W


class Handle:
    """A state store of one value that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_is_read_and_written_once_a_bucket():
    h, p = Handle(), W._Sessions(["src"], 10_000_000, 3)
    p.init(h)
    n = 500
    part = pd.DataFrame({"src": [*[str(i) for i in range(n)], None], "t": [1_000_000] * (n + 1), "o": range(n + 1),
                         "x": [pd.Series([float(i)]).to_numpy() for i in range(n + 1)], "y": [0] * (n + 1)})
    assert list(p.handleInputRows((7,), iter([part]), Watermark(0))) == [] and h.calls <= 3
    assert h.timers == [11_001]
    out = pd.concat(p.handleExpiredTimer((7,), Watermark(11_001), None))
    assert len(out) == n + 1 and out.src.isna().sum() == 1 and set(out.n_rows) == {1}
    assert sorted(x[0][0] for x in out.seq) == [float(i) for i in range(n + 1)]
    assert h.value is None and h.calls <= 4
