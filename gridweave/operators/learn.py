"""Supervised classification and regression of pixels and features.

Training sets are bounded samples (at most MAX_TRAIN rows reach the driver; at_most() and balanced() draw them); models are small arrays that are broadcast,
and every pixel is classified where it lies, in Arrow batches. Kernel machines are trained by coordinate ascent on the dual with the bias in the kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000


def training_set(df: DataFrame, label: str, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels on the driver, in a fixed order; refuses more than MAX_TRAIN rows."""
    rows = df.select(label, features).limit(MAX_TRAIN + 1).collect()
    if len(rows) > MAX_TRAIN:
        raise ValueError(f"draw {MAX_TRAIN} training rows or fewer first")
    rows = sorted((r[0], list(r[1])) for r in rows)
    return np.array([r[1] for r in rows], float).reshape(len(rows), -1), np.array([r[0] for r in rows])


class Scaler:
    """Each feature to [-1, 1] by its mid-range, or by given offsets and scales."""

    def __init__(self, x: np.ndarray, offset: list | None = None, scale: list | None = None):
        lo, hi = x.min(0), x.max(0)
        self.offset = np.array(offset, float) if offset else (lo + hi) / 2
        self.scale = np.array(scale, float) if scale else np.where(hi > lo, 2 / np.where(hi > lo, hi - lo, 1), 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.offset) * self.scale


def kernel(a: np.ndarray, b: np.ndarray, name: str = "radial", gamma: float = 0.5, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    dot = a @ b.T
    if name == "linear":
        return dot
    if name == "polynomial":
        return (gamma * dot + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * dot))


def _ascend(k: np.ndarray, y: np.ndarray, c: float, passes: int = 100, eps: float = 1e-4) -> np.ndarray:
    """Signed dual weights of a soft-margin machine."""
    a, f = np.zeros(len(y)), np.zeros(len(y))
    d = np.maximum(np.diag(k), 1e-12)
    for _ in range(passes):
        most = 0.0
        for i in range(len(y)):
            new = min(c, max(0.0, a[i] + (1 - y[i] * f[i]) / d[i]))
            if (step := new - a[i]) != 0:
                f += step * y[i] * k[i]
                a[i] = new
                most = max(most, abs(step))
        if most < eps * c:
            break
    return a * y


class SVM:
    """C_SVC, nu_SVC, one_class, epsilon_SVR, nu_SVR with any kernel(). nu_SVC searches the C whose share of bounded rows is nu, nu_SVR the epsilon outside of which nu of the residuals lie."""

    def __init__(self, kind: str = "C_SVC", c: float = 10.0, nu: float = 0.5, epsilon: float = 0.1, **kernel_options):
        self.kind, self.c, self.nu, self.epsilon, self.options = kind, c, nu, epsilon, kernel_options

    def _k(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return kernel(a, b, **self.options) + 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> SVM:
        self.scale = Scaler(x)
        x = self.x = self.scale(x)
        if self.kind == "one_class":
            k = kernel(x, x, **self.options)
            self.w = np.full(len(x), 1 / len(x))
            self.rho = float(np.quantile(k @ self.w, self.nu))
            return self
        if self.kind in ("epsilon_SVR", "nu_SVR"):
            k = self._k(x, x)
            self.w = np.linalg.solve(k + np.eye(len(x)) / self.c, y.astype(float))
            eps = self.epsilon if self.kind == "epsilon_SVR" else float(np.quantile(np.abs(y - k @ self.w), 1 - self.nu))
            for _ in range(50):  # residuals within epsilon cost nothing
                r = y - k @ self.w
                t = k @ self.w + np.sign(r) * np.maximum(0, np.abs(r) - eps)
                self.w = np.linalg.solve(k + np.eye(len(x)) / self.c, t)
            return self
        self.classes = np.unique(y)
        self.pairs = []
        for a, b in combinations(range(len(self.classes)), 2):
            at = np.flatnonzero((y == self.classes[a]) | (y == self.classes[b]))
            s = np.where(y[at] == self.classes[a], 1.0, -1.0)
            k, c = self._k(x[at], x[at]), self.c
            w = _ascend(k, s, c)
            if self.kind == "nu_SVC":
                lo, hi = 1e-3, 1e3
                for _ in range(12):
                    c = math.sqrt(lo * hi)
                    w = _ascend(k, s, c, 30)
                    lo, hi = (c, hi) if (np.abs(w) >= c * 0.999).mean() > self.nu else (lo, c)
            f = k @ w
            self.pairs.append((a, b, at, w, float(2 / (np.abs(f).mean() + 1e-12))))
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Regression values; or how far inside a one-class region."""
        z = self.scale(x)
        return kernel(z, self.x, **self.options) @ self.w - self.rho if self.kind == "one_class" else self._k(z, self.x) @ self.w

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """By pairwise coupling of logistic margins."""
        z, p = self.scale(x), np.ones((len(x), len(self.classes)))
        if len(self.classes) == 1:
            return p
        for a, b, at, w, slope in self.pairs:
            q = 1 / (1 + np.exp(-np.clip(slope * (self._k(z, self.x[at]) @ w), -30, 30)))
            p[:, a] *= q
            p[:, b] *= 1 - q
        p = p ** (2 / len(self.classes))
        return p / p.sum(1, keepdims=True)


class MLP:
    """One or two hidden layers of symmetric sigmoids, trained by full-batch Adam; classes or a vector of outputs, all in [-1, 1] inside."""

    def __init__(self, hidden: tuple = (8,), rate: float = 0.02, epochs: int = 300, connection: float = 1.0, weights: list | None = None, seed: int = 1):
        self.hidden, self.rate, self.epochs, self.connection, self.weights, self.seed = hidden, rate, epochs, connection, weights, seed

    def fit(self, x: np.ndarray, y: np.ndarray, classes: bool = True) -> MLP:
        self.scale = Scaler(x)
        if classes:
            self.classes = np.unique(y)
            t = np.where(y[:, None] == self.classes[None], 1.0, -1.0)
        else:
            y = y.reshape(len(x), -1).astype(float)
            self.out = Scaler(y)
            t = self.out(y)
        rng, sizes = np.random.default_rng(self.seed), [x.shape[1], *self.hidden, t.shape[1]]
        z = self.scale(x)
        if self.weights is None:  # given ones skip training
            self.weights = [rng.normal(0, 1 / math.sqrt(a + 1), (a + 1, b)) for a, b in zip(sizes, sizes[1:])]
            masks = [rng.random(w.shape) <= self.connection for w in self.weights]
            m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
            for step in range(1, self.epochs + 1):
                acts = self._forward(z)
                d = (acts[-1] - t) * (1 - acts[-1] ** 2) / len(z)
                for i in range(len(self.weights) - 1, -1, -1):
                    g = np.c_[acts[i], np.ones(len(z))].T @ d * masks[i]
                    d = (d @ self.weights[i][:-1].T) * (1 - acts[i] ** 2)
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] -= self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _forward(self, z: np.ndarray) -> list[np.ndarray]:
        acts = [z]
        for w in self.weights:
            acts.append(np.tanh(np.c_[acts[-1], np.ones(len(z))] @ w))
        return acts

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = (self._forward(self.scale(x))[-1] + 1) / 2 + 1e-9
        return p / p.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self.scale(x))[-1] / self.out.scale + self.out.offset


def combined(ps: list[np.ndarray], rule: str = "sum", priors: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of several models by sum, product or max, times the priors."""
    s = np.stack(ps)
    p = {"sum": lambda: s.mean(0), "product": lambda: np.exp(np.log(np.maximum(s, 1e-300)).sum(0)), "max": lambda: s.max(0)}[rule]()
    p = p * priors if priors is not None else p
    return p / p.sum(1, keepdims=True)


def bagged(make: Callable, x: np.ndarray, y: np.ndarray, bags: int, percent: float, seed: int = 1) -> list:
    """Models on random shares of each class."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(bags):
        at = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: max(1, int(percent / 100 * (y == c).sum()))] for c in np.unique(y)])
        out.append(make().fit(x[at], y[at]))
    return out


def classify(df: DataFrame, models: list, features: str = "features", rule: str = "sum", priors: list | None = None) -> DataFrame:
    """df with label, probability (% of each class) and entropy (% of the most there can be)."""
    held = df.sparkSession.sparkContext.broadcast(models)
    classes = models[0].classes
    kind = "struct<label:double,probability:array<double>,entropy:double>"

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"label": [], "probability": [], "entropy": []})
        x = np.stack(v.to_numpy()).astype(float)
        p = combined([m.probabilities(x) for m in held.value], rule, np.array(priors) if priors else None)
        e = -(p * np.log2(np.maximum(p, 1e-300))).sum(1) / max(1e-12, math.log2(p.shape[1])) if p.shape[1] > 1 else np.zeros(len(p))
        return pd.DataFrame({"label": held.value[0].classes[p.argmax(1)].astype(float), "probability": list(np.round(p * 100)), "entropy": np.round(e * 100)})

    assert len(classes)
    return df.withColumn("__c", run(F.col(features))).select(*df.columns, "__c.label", "__c.probability", "__c.entropy")


def predicted(df: DataFrame, model, features: str = "features") -> DataFrame:
    """df with prediction, of a regression."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
        m = held.value
        return pd.Series((m.decision(x) if isinstance(m, SVM) else m.predict(x)[:, 0]) if len(v) else [])

    return df.withColumn("prediction", run(F.col(features)))


def most_uncertain(classified: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Active learning: the k rows of largest entropy."""
    return classified.orderBy(F.desc("entropy"), *key).limit(k)


def folds(n: int, k: int) -> np.ndarray:
    return np.arange(n) % k


def cross_validated(make: Callable, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Each row's class by a model that has not seen it."""
    f, out = folds(len(y), k), np.empty(len(y), y.dtype)
    for i in range(k):
        m = make().fit(x[f != i], y[f != i])
        out[f == i] = m.classes[m.probabilities(x[f == i]).argmax(1)]
    return out


def kappa(y: np.ndarray, z: np.ndarray) -> float:
    po = float((y == z).mean())
    pe = float(sum((y == c).mean() * (z == c).mean() for c in np.unique(np.r_[y, z])))
    return 0.0 if pe >= 1 else (po - pe) / (1 - pe)


def select_features(cost: Callable[[list[int]], float], n: int, most: int, method: str = "SFS", eps: float = 1e-6) -> tuple[list[int], float]:
    """Features of largest cost(), by forward (SFS), backward (SBS), floating forward (SFFS) or exhaustive (BFS) search, `most` of them."""
    if method == "BFS":
        best = max(((cost(list(c)), list(c)) for c in combinations(range(n), most)), key=lambda t: (t[0], [-i for i in t[1]]))
        return best[1], best[0]
    if method == "SBS":
        chosen = list(range(n))
        while len(chosen) > most:
            chosen = max(([i for i in chosen if i != j] for j in chosen), key=cost)
        return chosen, cost(chosen)
    chosen, value, best = [], -math.inf, {}
    while len(chosen) < most:
        chosen = max((sorted([*chosen, j]) for j in range(n) if j not in chosen), key=cost)
        value = cost(chosen)
        best[len(chosen)] = max(best.get(len(chosen), (-math.inf, [])), (value, chosen))
        while method == "SFFS" and len(chosen) > 2:
            less = max(([i for i in chosen if i != j] for j in chosen), key=cost)
            if cost(less) <= best.get(len(less), (-math.inf, []))[0] + eps:
                break
            chosen = less
            best[len(less)] = (cost(less), less)
    return best[most][1], best[most][0]


def grid_search(x: np.ndarray, y: np.ndarray, cs: list[float], gammas: list[float], k: int = 3, score: str = "kappa") -> list[tuple[float, float, float]]:
    """(c, gamma, score) of each pair by cross-validation, best first."""
    f = kappa if score == "kappa" else lambda a, b: float((a == b).mean())
    out = [(c, g, f(y, cross_validated(lambda c=c, g=g: SVM(c=c, gamma=g), x, y, k))) for c in cs for g in gammas]
    return sorted(out, key=lambda t: (-t[2], t[0], t[1]))


def entropy_of(p: Column) -> Column:
    """Entropy of an array of probabilities over its maximum."""
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log2(v)).otherwise(0.0)) / F.log2(F.size(p).cast("double"))
