"""The byte network against nested loops and finite differences; the rule learner against all conditions."""

import numpy as np
import pytest

from folio.llm import langid, quality


def by_hand(net, window):
    """Scores of one window, a filter and a place at a time."""
    d, wide = net.embed.shape[1], max(net.widths)
    data = [*window, *[0] * (wide - 1)]
    per = net.filters.shape[1] // len(net.widths)
    hidden = []
    for f in range(net.filters.shape[1]):
        width = net.widths[f // per]
        best = -np.inf
        for at in range(len(window)):
            total = 0.0
            for k in range(width):
                for c in range(d):
                    total += float(net.embed[data[at + k], c]) * float(net.filters[k * d + c, f])
            best = max(best, total)
        hidden.append(max(0.0, best + float(net.bias[f])))
    z = [sum(hidden[f] * float(net.dense[f, k]) for f in range(len(hidden))) + float(net.dense_bias[k]) for k in range(len(net.languages))]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def small_net(seed=3):
    net = langid.ByteConvNet.fresh(["a", "b", "c"], per_width=2, d=3, seed=seed)
    rng = np.random.default_rng(seed)
    net.bias, net.dense_bias = rng.normal(0, 0.3, net.bias.shape).astype(np.float32), rng.normal(0, 0.3, net.dense_bias.shape).astype(np.float32)
    return net


def test_probabilities_like_nested_loops():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (5, 24)).astype(np.uint8)
    windows[1, 10:] = 0
    net = small_net()
    assert np.abs(net.probabilities(windows, at_once=2) - [by_hand(net, w) for w in windows]).max() < 1e-5


@pytest.mark.parametrize("name", ["filters", "bias", "dense", "dense_bias", "embed"])
def test_the_first_step_goes_down_the_slope(name):
    """The optimiser's first step is the sign of the gradient: it has that of finite differences wherever these are clear."""
    rng = np.random.default_rng(2)
    windows = rng.integers(97, 110, (3, 16)).astype(np.uint8)
    target = np.arange(3)
    loss = lambda n: -sum(np.log(by_hand(n, w)[t]) for w, t in zip(windows, target, strict=True)) / 3
    net, before = small_net(), small_net()
    net.train(windows, target, steps=1, batch=3, rate=1e-3)
    step = getattr(net, name) - getattr(before, name)
    places = np.argwhere(np.abs(step) > 1e-6)
    rng.shuffle(places)
    clear = 0
    for place in map(tuple, places[:12]):
        losses = []
        for sign in (1, -1):
            moved = small_net()
            values = getattr(moved, name).astype(np.float64)
            values[place] += sign * 1e-3
            setattr(moved, name, values)
            losses.append(loss(moved))
        slope = (losses[0] - losses[1]) / 2e-3
        if abs(slope) > 1e-3:
            clear += 1
            assert np.sign(step[place]) == -np.sign(slope)
    assert clear >= 2


@pytest.mark.parametrize("seed", range(6))
def test_best_condition_of_all(seed):
    rng = np.random.default_rng(seed)
    n = 60
    table = {name: rng.choice([0.0, 0.5, 1.0, *rng.normal(1, 1, 20)], n) for name in quality.SHARES}
    bad = rng.random(n) < 0.4
    bad |= table["words"] > 1.5
    among = rng.random(n) < 0.9
    gain, condition = quality._best(table, bad, among)
    p0, n0 = float(bad[among].sum()), float((~bad[among]).sum())
    every = []
    for name, values in table.items():
        for v in np.unique(values[among]):
            for above in (True, False):
                held = among & quality.Condition(name, above, float(v)).holds(table)
                every.append(float(quality._gain(np.array([bad[held].sum()], float), np.array([(~bad[held]).sum()], float), p0, n0)[0]))
    held = among & condition.holds(table)
    own = float(quality._gain(np.array([bad[held].sum()], float), np.array([(~bad[held]).sum()], float), p0, n0)[0])
    assert own == pytest.approx(max(every)) and gain == pytest.approx(own)
