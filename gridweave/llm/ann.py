"""Approximate nearest neighbours over learned partitions.

Index: equal vectors are one candidate that carries its K smallest ids (more can't be in a result of K). The rows are split level by level, until a part
holds about PART of them: in each part, the neighbour graph of a bounded sample (about SAMPLE vectors, drawn by id) is cut into balanced parts by recursive
bisection along the graph's second eigenvector, then refined by neighbours' votes under a capacity, and a small network learns each sample vector's share
of neighbours in each of them. Every row goes to its most probable part. The parts of one level are learned by as many tasks, so the index grows with the rows
and a part does not; there are about log(rows / PART) / log(SPLITS) levels, two parts at least.
Search: equal queries are searched once. A query goes to the parts of largest joint probability, until MASS of it and MIN_PARTS are reached, and is
reranked there by exact cosine in double precision; the best of all its parts are merged. How many parts that takes is the data's: few where vectors have
neighbourhoods, most where they point anywhere (no partition can tell then where the nearest lie). There is no cap, for recall comes first.

A part larger than BLOCK (many different vectors that no split tells apart) is dealt in blocks by a hash of the id, its queries in blocks of QUERIES.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a query's own id is no candidate for it, whichever
row has it; of several rows with one id, the one with the least vector (in Spark's order of arrays) is that id's; ties go to the smaller vec_id; fewer candidates than k give fewer
rows; no rows give no rows; other columns are ignored. Very large and very small vectors are scaled by a power of two, which changes no cosine and lets no square overflow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import chance, cut, table

SAMPLE, NEIGHBOURS, HIDDEN, EPOCHS, MASS, MIN_PARTS, PART, SPLITS, BLOCK, QUERIES = 8192, 12, 64, 40, 0.97, 2, 512, 128, 8192, 2048
ROUTED = "id long, v array<double>, ids array<long>, part long, p double"
RESULT = "qid long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double): rows that take part, one an id; very large and very small ones are scaled by a power of two."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("v") == (most["n"] if most else -1)).groupBy("vec_id").agg(F.min("v").alias("v"))
    exponent = F.floor(F.log2(F.array_max(F.transform("v", F.abs))))
    half = F.floor(exponent / 2)  # in two steps, for powers beyond the range of doubles
    odd = F.exists("v", lambda x: F.abs(x) > 1e100) | F.forall("v", lambda x: F.abs(x) < 1e-100)
    return rows.select("vec_id", F.when(odd, F.transform("v", lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent))).otherwise(F.col("v")).alias("v"))


def graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """(n, k) nearest others of unit vectors."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part for each node of a neighbour graph: sizes differ by one before the refinement and by 5 % at most after it."""
    rng, n = np.random.default_rng(seed), len(near)
    label = np.zeros(n, np.int64)
    while (have := label.max() + 1) < parts:
        for p in range(have):
            own = np.flatnonzero(label == p)
            inside = np.full(n, -1)
            inside[own] = np.arange(len(own))
            nb = inside[near[own]]
            known = nb >= 0
            many = np.maximum(1, known.sum(1))
            y = rng.normal(size=len(own))
            for _ in range(60):  # the walk's slowest mode but the constant one
                y = 0.5 * y + 0.5 * np.where(known, y[nb], 0).sum(1) / many
                y -= y.mean()
                y /= np.linalg.norm(y) + 1e-12
            label[own[np.argsort(y, kind="stable")[len(own) // 2 :]]] = p + have
    room = int(np.ceil(1.05 * n / parts))
    for _ in range(5):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 1)
        gain = votes.max(1) - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if sizes[to] < room:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
    return label


def fit_router(x: np.ndarray, target: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """A network of one hidden layer; target: each row's shares of the parts."""
    rng, m = np.random.default_rng(seed), target.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)) * 2, np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, m)), np.zeros(m)]
    a, b, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            k = order[i : i + 128]
            h = np.maximum(x[k] @ p[0] + p[1], 0)
            d = (_softmax(h @ p[2] + p[3]) - target[k]) / len(k)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for q, u, v, g in zip(p, a, b, (x[k].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= 0.005 * u / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def route(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
    return _softmax(np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def splits(size: int, part: int) -> int:
    """Parts that one level makes of a part: a power of two, of `part` rows each, SPLITS at most, but two at least and four from 256 rows on; 1 leaves a single row alone."""
    return 1 if size < 2 else min(SPLITS, 1 << max(1 + (size >= 256), int(np.ceil(np.log2(max(1.0, size / part))))))


def learn(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """The router of one part, from a sample of its vectors."""
    x = _unit(np.unique(x, axis=0))
    while parts > max(1, len(x) // 2):
        parts //= 2
    near = graph(x.astype(np.float32)) if parts > 1 else np.zeros((len(x), 0), np.int64)
    label = balanced_parts(near, parts) if parts > 1 else np.zeros(len(x), np.int64)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1] + 1), label[np.c_[np.arange(len(x)), near]].ravel()), 1)
    return fit_router(x, target / target.sum(1, keepdims=True))


def _learned(part: int):
    def run(key, t):
        import pandas as pd

        p = learn(np.stack(t["v"].to_numpy()), splits(int(t["size"].iloc[0]), part))
        return pd.DataFrame({"part": [int(key[0])], "model": [b"".join(q.astype(np.float32).tobytes() for q in p)], "m": [p[2].shape[1]]})

    return run


def _routed(keep_all: bool):
    """Rows (id, v, ids, part, p) of one part, or of a block of it, to its children: the most probable, or all that could matter, with joint probabilities."""

    def run(key, left, right):
        import pandas as pd

        cols = ["id", "v", "ids", "part", "p"]
        if not len(left) or not len(right):  # a part that is not split again
            return left[cols]
        m, raw = int(right["m"].iloc[0]), np.frombuffer(right["model"].iloc[0], np.float32).astype(np.float64)
        x = _unit(np.stack(left["v"].to_numpy()))
        n = x.shape[1]
        shapes, at, model = ((n, HIDDEN), (HIDDEN,), (HIDDEN, m), (m,)), 0, []
        for shape in shapes:
            size = int(np.prod(shape))
            model.append(raw[at : at + size].reshape(shape))
            at += size
        p = route(x, model)
        if keep_all:
            order = np.argsort(-p, axis=1, kind="stable")
            best = np.take_along_axis(p, order, 1)
            take = (np.cumsum(best, axis=1) - best < MASS) | (np.arange(best.shape[1]) < MIN_PARTS)
        else:
            order = p.argmax(1)[:, None]
            best, take = np.take_along_axis(p, order, 1), np.ones((len(p), 1), bool)
        rows = np.nonzero(take)[0]
        out = left.iloc[rows]
        return pd.DataFrame({"id": out["id"].to_numpy(), "v": out["v"].to_numpy(), "ids": out["ids"].to_numpy(), "part": out["part"].to_numpy() * SPLITS + order[take], "p": out["p"].to_numpy() * best[take]})

    return run


def nearest(q: np.ndarray, c: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[list, list, list]:
    """place of the query, candidate id, cosine: of the k best candidate rows of each query, all their ids."""
    out: tuple[list, list, list] = ([], [], [])
    nq, nc = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    uq, uc, least = _unit(q), _unit(c), np.array([i[0] for i in ids])
    for i in range(0, len(q), 256):
        s = uq[i : i + 256] @ uc.T
        m = min(k, s.shape[1])
        cutoff = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m] - 1e-9
        for j in range(len(s)):
            at = np.flatnonzero(s[j] >= cutoff[j])
            exact = (q[i + j] * c[at]).sum(1) / (nq[i + j] * nc[at])
            for b in np.lexsort((least[at], -exact))[:k]:
                out[0].extend([i + j] * len(ids[at[b]]))
                out[1].extend(ids[at[b]].tolist())
                out[2].extend([float(exact[b])] * len(ids[at[b]]))
    return out


def _rerank(k: int):
    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        at, ids, s = nearest(np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()), [np.asarray(i) for i in right["ids"]], k)
        return pd.DataFrame({"qid": left["id"].to_numpy()[at], "vec_id": ids, "score": s})

    return run


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """id, v, ids: one row a vector, with its k smallest ids; what a task has more of goes before the shuffle."""
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k)
    return few.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _dealt(t: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """t with `block` and `qblock`: by a hash of the id among its own blocks, and in all blocks of the other side."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(own) / (BLOCK if own == "rows" else QUERIES)).cast("int"))
    others = F.greatest(F.lit(1), F.ceil(F.col(other) / (QUERIES if own == "rows" else BLOCK)).cast("int"))
    mine, theirs = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), others - 1))
    names = ("block", "qblock") if own == "rows" else ("qblock", "block")
    return t.join(sizes, "part").select("part", mine.alias(names[0]), theirs.alias(names[1]), "id", "v", "ids")


def index(base: DataFrame, asked: DataFrame, n: int, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(base, asked), both (id, v, ids, part, p): each row of base in its part, each row of asked in all parts where it is to be searched. n: rows of base."""
    start_ = [F.lit(0).cast("long").alias("part"), F.lit(1.0).alias("p")]
    base, asked = cut(base.select("id", "v", "ids", *start_)), cut(asked.select("id", "v", "ids", *start_))
    levels, left = 0, n
    while left > 1 and (levels == 0 or left > part):
        sizes = cut(base.groupBy("part").agg(F.count("*").alias("size")))
        # in a level, all parts are split, for paths to be of one length; a part that needs no split goes to one child
        draw = base.join(sizes, "part").where(chance(F.col("id"), 41 + levels) < F.lit(float(SAMPLE)) / F.col("size"))
        models = cut(draw.select("part", "v", "size").groupBy("part").applyInPandas(_learned(part), "part long, model binary, m int"))
        blocks = sizes.select("part", F.ceil(F.col("size") / BLOCK).cast("int").alias("b"))
        each = cut(models.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"), "model", "m"))

        def down(t: DataFrame, every: bool) -> DataFrame:
            t = t.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("b")).cast("int")).drop("b")
            return t.groupBy("part", "block").cogroup(each.groupBy("part", "block")).applyInPandas(_routed(every), ROUTED)

        base = cut(down(base, False))
        asked = down(asked, True)
        if levels:  # the most probable of all its paths
            w = W.partitionBy("id").orderBy(F.desc("p"), "part")
            asked = asked.withColumn("rank", F.row_number().over(w)).withColumn("before", F.sum("p").over(w.rowsBetween(W.unboundedPreceding, -1)))
            asked = asked.where((F.coalesce("before", F.lit(0.0)) < MASS) | (F.col("rank") <= MIN_PARTS)).drop("rank", "before")
        asked = cut(asked)
        levels, left = levels + 1, left / splits(left, part)
    return base, asked


def search(vectors: DataFrame, queries: Column, k: int = 5, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors (vec_id, embedding) that `queries` holds for."""
    rows = cut(usable(vectors))
    ask = rows.where(queries)
    wanted = cut(distinct(ask, 1))
    base = cut(distinct(rows, k + 1))
    n = base.count()
    if n < 2:  # nobody has a neighbour
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, asked = index(base, wanted, n, part)
    sizes = base.groupBy("part").agg(F.count("*").alias("rows")).join(asked.groupBy("part").agg(F.count("*").alias("asked")), "part")
    sizes = cut(sizes)
    c, q = _dealt(base, sizes, "rows", "asked"), _dealt(asked, sizes, "asked", "rows")
    key = ["part", "block", "qblock"]
    found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(_rerank(k + 1), RESULT)
    # k + 1 of all candidates hold k others of any query
    w = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    near = found.join(wanted.select(F.col("id").alias("qid"), F.col("v").alias("w")), "qid").select("w", "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = ask.select(F.col("vec_id").alias("query_id"), "v").join(near, F.col("v") == F.col("w")).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
