"""The convolutional network against plain loops and differences."""

import numpy as np

from saltcellar.llm import quality


def _params(seed=3):
    r = np.random.default_rng(seed)
    return {
        "embed": r.normal(0, 0.5, (256, quality.EMBEDDING)), "filters": r.normal(0, 0.5, (quality.WIDTH, quality.EMBEDDING, quality.FILTERS)),
        "bias": r.normal(0, 0.1, quality.FILTERS), "weight": r.normal(0, 0.3, quality.FILTERS), "offset": np.array([0.2]),
    }


def _score(params, text):
    width, size = quality.WIDTH, quality.BLOCK
    data = b"\0" * (width - 1) + text
    blocks = max(-(-len(data) // size), 1)
    data = data.ljust(blocks * size, b"\0") + b"\0" * width
    peaks = []
    for b in range(blocks):
        windows = [sum(params["embed"][data[p + j]] @ params["filters"][j] for j in range(width)) for p in range(b * size, (b + 1) * size)]
        peaks.append(np.max(windows, axis=0))
    chunks = [np.maximum(peaks[i], peaks[i + 1]) for i in range(blocks - 1)] or [peaks[0]]
    pooled = np.mean([np.maximum(c + params["bias"], 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(pooled @ params["weight"] + params["offset"][0])))


TEXTS = [b"", b"a", bytes(range(256)) * 3, b"some words and more " * 40, b"x" * 251, b"y" * 252, "Ünï 😀".encode() * 70]


def test_scores_equal_plain_loops():
    params = _params()
    got = quality._network(params).scores(TEXTS)
    assert np.allclose(got, [_score(params, t) for t in TEXTS], atol=1e-5)


def test_gradients_equal_differences():
    params, labels = _params(), np.array([1.0, 0, 1, 0, 1, 0, 1])

    def loss(p):
        s = np.array([_score(p, t) for t in TEXTS])
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s)) + 0.5e-4 * (p["weight"] ** 2).sum()

    got = quality._gradients(params, TEXTS, labels)
    places = {"embed": [(97, 0), (115, 3), (0, 2)], "filters": [(0, 1, 2), (5, 7, 15)], "bias": [(0,), (9,)], "weight": [(4,), (15,)], "offset": [(0,)]}
    for name, cells in places.items():
        for cell in cells:
            moved = []
            for step in (1e-5, -1e-5):
                changed = {k: v.copy() for k, v in params.items()}
                changed[name][cell] += step
                moved.append(loss(changed))
            assert np.isclose((moved[0] - moved[1]) / 2e-5, got[name][cell], rtol=1e-3, atol=1e-7), (name, cell)


def test_few_long_texts_take_few_steps(monkeypatch):
    steps, plain = [], quality._gradients
    monkeypatch.setattr(quality, "_gradients", lambda *a: steps.append(1) or plain(*a))
    quality.fit_network([b"a" * 50_000, b"b" * 50_000, b""], np.array([0.0, 1, 0]))
    assert len(steps) == quality.MOST_EPOCHS
