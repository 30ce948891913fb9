"""The attention model's graphs give what numpy gives, in less CPU time."""

import time

import numpy as np
import pytest

from inkwell.llm import attention, kernels


def arrays(name, windows, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, size, s).astype(np.float32)
    step, width, n = attention.STEP, attention.WIDTH, windows * attention.STEP
    q, k, v, d = f(windows, step, width), f(windows, 2 * step, width), f(windows, 2 * step, width), f(windows, step, width)
    mask = np.zeros((windows, 1, 2 * step), np.float32)
    mask[::3, :, :step] = -1e9
    bias = f(step, 2 * step) + attention._CAUSAL
    hidden, wo, b, rows = f(n, attention.HIDDEN), f(attention.HIDDEN, attention.CLASSES), f(attention.CLASSES), f(n, attention.CLASSES)
    if name == "attend":
        return q, k, v, bias, mask, f(width, attention.HIDDEN), f(windows, step, attention.HIDDEN)
    if name == "attend_back":
        return q, k, v, np.abs(f(windows, step, 2 * step)), d, f(windows, step, 1)
    if name == "products":
        return rows, hidden, f(n, width), f(n, attention.HIDDEN), f(n + step, width), f(n + step, 2 * width), f(n, width), f(n, width)
    return hidden, wo, b, rows


@pytest.mark.parametrize("name", sorted(kernels.GRAPHS))
@pytest.mark.parametrize(("windows", "size"), [(1, 1.0), (7, 1.0), (40, 10.0)])  # the last has scores whose exp() is infinite
def test_graphs_against_numpy(name, windows, size):
    given = arrays(name, windows, size=size)
    kept = [x.copy() for x in given]
    for got, told in zip(kernels.kernel(name)(*given), kernels.PLAIN[name](*kept), strict=True):
        assert np.isfinite(told).all() and got.shape == told.shape
        assert np.allclose(got, told, rtol=1e-4, atol=max(1e-4 * size * size, 2e-5 * np.abs(told).max()))  # scores and sums round


def test_scoring_steps_take_less_time_than_numpy():
    if kernels.onnxruntime is None:
        pytest.skip("the numpy forms serve alone")
    given = [(name, arrays(name, 128)) for name in ("attend", "log_shares")]

    def least(pick):
        took = []
        for _ in range(15):
            now = time.thread_time()
            for name, x in given:
                pick(name)(*x)
            took.append(time.thread_time() - now)
        return min(took)

    assert least(kernels.kernel) < 0.9 * least(kernels.PLAIN.get)


def test_model_without_the_runtime(monkeypatch):
    from test_lm_training import small_model

    ids, bounds = np.random.default_rng(5).integers(0, 299, 130).astype(np.int32), np.array([0, 0, 7, 50, 130])
    m = small_model(ids)
    told = m.score(ids, bounds, 299)
    monkeypatch.setattr(attention, "kernel", kernels.PLAIN.get)
    assert m.score(ids, bounds, 299) == pytest.approx(told, rel=1e-5)
