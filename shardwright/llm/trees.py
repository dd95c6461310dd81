"""Small tree ensembles: fitted on a bounded labelled sample, applied as one DataFrame expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bins(x, most: int = 32):
    """Candidate thresholds of each feature: at most `most` midpoints between its quantiles."""
    import numpy as np

    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > most + 1:
            v = np.unique(np.quantile(v, np.linspace(0, 1, most + 1)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def _grow(codes, cuts, g, h, rows, depth, leaf, l2, least, pick):
    """One tree by exact search over binned thresholds; g, h: gradient and weight of each row."""
    import numpy as np

    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-9, None, None)
    if depth and len(rows) >= 2 * least:
        for j in pick():
            if not len(cuts[j]):
                continue
            c, n = codes[rows, j], len(cuts[j]) + 1
            sg, sh, cnt = np.cumsum(np.bincount(c, g[rows], n))[:-1], np.cumsum(np.bincount(c, h[rows], n))[:-1], np.cumsum(np.bincount(c, minlength=n))[:-1]
            gain = sg**2 / (sh + l2) + (total_g - sg) ** 2 / (total_h - sh + l2) - total_g**2 / (total_h + l2)
            gain[(cnt < least) | (len(rows) - cnt < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] is None:
        return float(leaf(total_g, total_h))
    _, j, k = best
    left = codes[rows, j] <= k
    args = (depth - 1, leaf, l2, least, pick)
    return (j, float(cuts[j][k]), _grow(codes, cuts, g, h, rows[left], *args), _grow(codes, cuts, g, h, rows[~left], *args))


def _binned(x):
    import numpy as np

    cuts = _bins(x)
    return cuts, np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


def boosted(x, y, trees: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 5) -> dict:
    """Gradient-boosted trees for 0/1 labels under logistic loss (second-order steps). One class only: a constant."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    model, f = {"base": base, "trees": []}, np.full(len(y), base)
    if not len(y) or y.min() == y.max():
        return model
    cuts, codes = _binned(x)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        t = _grow(codes, cuts, y - q, q * (1 - q), np.arange(len(y)), depth, lambda g, h: rate * g / (h + l2), l2, least, lambda: range(x.shape[1]))
        model["trees"].append(t)
        f += np.array(predict_tree(t, x))
    return model


def forest(x, y, trees: int = 24, depth: int = 6, least: int = 3, seed: int = 0) -> dict:
    """A random forest for 0/1 labels: bootstrap rows, sqrt(features) tried at each split, leaves hold the share of 1."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    model = {"base": 0.0, "trees": []}
    if not len(y):
        return {"base": 0.5, "trees": []}
    rng, (cuts, codes) = np.random.default_rng(seed), _binned(x)
    some = max(1, int(np.sqrt(x.shape[1]) + 0.5))
    for _ in range(trees):
        rows = np.sort(rng.integers(0, len(y), len(y)))
        t = _grow(codes, cuts, y, np.ones(len(y)), rows, depth, lambda g, h: g / max(h, 1) / trees, 1e-9, least, lambda: rng.choice(x.shape[1], some, replace=False))
        model["trees"].append(t)
    return model


def predict_tree(t, x):
    import numpy as np

    if not isinstance(t, tuple):
        return np.full(len(x), t)
    return np.where(x[:, t[0]] <= t[1], predict_tree(t[2], x), predict_tree(t[3], x))


def predict(model: dict, x):
    """Sum of the trees over the rows of x: the test of score()."""
    import numpy as np

    x = np.asarray(x, float)
    return model["base"] + sum((np.asarray(predict_tree(t, x)) for t in model["trees"]), np.zeros(len(x)))


def score(model: dict, features: list[Column]) -> Column:
    """The same sum as an expression of nested CASE, which code generation compiles."""

    def tree(t):
        return F.when(features[t[0]] <= F.lit(t[1]), tree(t[2])).otherwise(tree(t[3])) if isinstance(t, tuple) else F.lit(t)

    return reduce(lambda a, b: a + b, [tree(t) for t in model["trees"]], F.lit(float(model["base"])))
