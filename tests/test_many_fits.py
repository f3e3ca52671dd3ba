"""Fits of one group and the same features share one evaluation of a batch."""

import numpy as np
import pyarrow as pa

from tessella.operators import many_fits as MF


def test_sums_equal_those_of_each_fit_alone(monkeypatch):
    rng = np.random.default_rng(2)
    n, k = 300, 4
    x, y, s, g = rng.normal(size=(n, k)), rng.integers(0, 2, n), rng.random(n), rng.integers(1, 4, n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(g, pa.int32()), pa.array(y, pa.int32()), pa.array(s), pa.array(x.tolist(), pa.list_(pa.float64()))],
        ["fold", "label", "weight", "x"],
    )
    kept = [(0, 1, 2, 3), (3, 1)]
    trials = {i: (1 + i % 3, kept[i % 2], rng.normal(size=len(kept[i % 2]) + 1)) for i in range(24)}
    calls, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **named: calls.append(1) or plain(*a, **named))
    (out,) = MF._sums(trials, "fold")(iter([batch]))
    assert len(calls) == 6  # three groups, two sets of features
    got = {(f, p): v for f, p, v in zip(*(out.column(c).to_pylist() for c in ("fit", "place", "value")))}
    for i, (group, own, w) in trials.items():
        at = g == group
        z = np.column_stack([x[at][:, list(own)], np.ones(at.sum())])
        p = 1 / (1 + plain(-z @ w))
        loss = -(s[at] * np.log(np.where(y[at] == 1, p, 1 - p))).sum()
        want = [loss, *(z.T @ (s[at] * (p - y[at]))), *((z * (s[at] * p * (1 - p))[:, None]).T @ z).ravel()]
        assert np.allclose([got[i, j] for j in range(len(want))], want, rtol=1e-10)
