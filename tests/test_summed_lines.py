"""Lines of cubes are summed many at once."""

import numpy as np
import pyarrow as pa

from voxquarry.operators import summed as sm


def test_many_lines_in_one_call(monkeypatch):
    """300 lines of four places make one batch; with few cubes at once the sums are the same."""
    rng = np.random.default_rng(3)
    rows = [(c, x) for c in range(300) for x in range(4) if rng.random() < 0.6]
    own = rng.integers(0, 5, (len(rows), 8))
    case, place = (pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))
    one, none = pa.array([1] * len(rows), pa.int64()), pa.array([0] * len(rows), pa.int32())
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 8), pa.array(own.ravel()))
    batch = pa.RecordBatch.from_arrays([case, one, none, none, place.cast(pa.int32()), sums], [*sm.TARGET, *sm.CUBE, "sums"])
    line, summed = sm._along(2, 2, 4)
    want = {}
    for c in {r[0] for r in rows}:
        held = np.zeros((2, 2, 8), np.int64)
        first = min(x for k, x in rows if k == c)
        for i, (k, x) in enumerate(rows):
            if k == c:
                held[:, :, 2 * x : 2 * x + 2] = own[i].reshape(2, 2, 2)
        held = held.cumsum(axis=2)
        want |= {(c, x): held[:, :, 2 * x : 2 * x + 2].ravel().tolist() for x in range(first, 4)}
    for at_once in (2048, 5):
        monkeypatch.setattr(sm, "AT_ONCE", at_once)
        out = list(summed(batch, np.int64))
        assert (len(out) == 1) == (at_once == 2048)
        got = {(r["case_id"], r["bx"]): r["sums"] for b in out for r in b.to_pylist()}
        assert got == want
