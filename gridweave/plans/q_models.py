"""Classification, regression, feature selection. Training rows are the cube's pixels with an even number, PER_CLASS of a class at most."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ..operators import learn as M
from ..operators import sample
from ..registry import query
from . import fixtures as X

PER_CLASS, KEPT = 30, 8


def _pixels(s, d):
    return X.cube(s, d).select("y", "x", F.slice("bands", 1, KEPT).alias("features"), "label")


def _set(s, d):
    return M.training_set(sample.at_most(_pixels(s, d).where("x % 2 = 0 and label < 4"), "label", ["y", "x"], PER_CLASS), "label")


for _kind in ("C_SVC", "nu_SVC"):
    for _kernel in ("linear", "polynomial", "radial", "sigmoid"):
        if _kind == "C_SVC" or _kernel == "radial":
            query(f"o151_svm_{_kind.lower()}_{_kernel}")(lambda s, d, k=_kind, n=_kernel: M.classify(_pixels(s, d).drop("label"), [M.SVM(k, name=n).fit(*_set(s, d))]).select("y", "x", "label", "entropy"))
query("o151_svm_one_class")(lambda s, d: M.predicted(_pixels(s, d), M.SVM("one_class", nu=0.1).fit(*_set(s, d))).select("y", "x", "prediction"))


def _regress(s, d):
    x, _ = _set(s, d)
    return x[:, 1:], x[:, 0]


for _kind in ("epsilon_SVR", "nu_SVR"):
    query(f"o151_svm_{_kind.lower()}")(lambda s, d, k=_kind: M.predicted(_pixels(s, d).select("y", "x", F.slice("features", 2, KEPT - 1).alias("features")), M.SVM(k).fit(*_regress(s, d))).select("y", "x", "prediction"))


@query("o152_cross_validation")
def _(s, d):
    x, y = _set(s, d)
    z = M.cross_validated(partial(M.SVM, gamma=0.5), x, y, 4)
    pairs, n = np.unique(np.c_[y, z], axis=0, return_counts=True)
    return s.createDataFrame([(int(a), int(b), int(k)) for (a, b), k in zip(pairs, n)], "ref int, cls int, n long")


query("o153_feature_scaling", X.sql(X.CUBE, "r AS (SELECT min(v) AS a, max(v) AS b FROM cb WHERE b = 0)", "SELECT y, x, round((v - (r.a + r.b) / 2) * 2 / (r.b - r.a), 6) AS f FROM cb, r WHERE cb.b = 0"))(
    lambda s, d: (lambda p: p.join(F.broadcast(p.agg(F.min("v").alias("a"), F.max("v").alias("b")))).select("y", "x", F.round((F.col("v") - (F.col("a") + F.col("b")) / 2) * 2 / (F.col("b") - F.col("a")), 6).alias("f")))(X.cube(s, d).select("y", "x", F.col("bands")[0].alias("v")))
)
for _rule in ("sum", "product", "max"):
    query(f"o154_bagging_{_rule}")(lambda s, d, r=_rule: M.classify(_pixels(s, d).drop("label"), M.bagged(M.SVM, *_set(s, d), 3, 60), rule=r).select("y", "x", "label", "entropy"))
query("o155_entropy", "SELECT n_nationkey AS id, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) AS entropy FROM (SELECT n_nationkey, (n_nationkey + 1) / 27.0::DOUBLE AS p FROM nation)")(
    lambda s, d: X.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) / 27.0).alias("p")).select("id", F.round(M.entropy_of(F.array("p", 1 - F.col("p"))), 6).alias("entropy"))
)
query("o156_priors")(lambda s, d: M.classify(_pixels(s, d).drop("label"), [M.SVM().fit(*_set(s, d))], priors=[0.4, 0.3, 0.2, 0.1]).select("y", "x", "label"))
query("o157_active_learning")(lambda s, d: M.most_uncertain(M.classify(_pixels(s, d).drop("label"), [M.SVM().fit(*_set(s, d))]), 20, ["y", "x"]).select("y", "x", "label", "entropy"))
query("o158_classify_features")(lambda s, d: M.classify(_pixels(s, d).select(F.concat_ws("-", "y", "x").alias("fid"), "features"), [M.SVM().fit(*_set(s, d))]).select("fid", "label"))
query("o159_ann_classify")(lambda s, d: M.classify(_pixels(s, d).drop("label"), [M.MLP((8, 6)).fit(*_set(s, d))]).select("y", "x", "label", "entropy"))
query("o160_ann_regression")(lambda s, d: M.predicted(_pixels(s, d).select("y", "x", F.slice("features", 2, KEPT - 1).alias("features")), M.MLP((6,)).fit(*_regress(s, d), classes=False)).select("y", "x", "prediction"))


def _cost(x, y):
    seen: dict = {}

    def cost(c: list[int]) -> float:
        k = tuple(c)
        if k not in seen:
            seen[k] = M.kappa(y, M.cross_validated(lambda: M.SVM(name="linear"), x[:, c], y, 2))
        return seen[k]

    return cost


for _method in ("SFS", "SFFS", "SBS", "BFS"):

    @query(f"o161_select_{_method.lower()}")
    def _(s, d, m=_method):
        x, y = _set(s, d)
        x, y = x[::4, :5], y[::4]
        chosen, value = M.select_features(_cost(x, y), x.shape[1], 2, m)
        return s.createDataFrame([(i, round(value, 6)) for i in chosen], "feature int, kappa double")


@query("o162_grid_search")
def _(s, d):
    x, y = _set(s, d)
    return s.createDataFrame(M.grid_search(x[::2], y[::2], [1.0, 10.0], [0.1, 1.0]), "c double, gamma double, kappa double")
