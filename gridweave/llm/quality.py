"""Quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are embedded and convolved by FILTERS learned filters of WIDTH bytes. The document is
cut into chunks of CHUNK window starts; a chunk's windows reach into the next, so chunks overlap and no window is lost. Each filter is
max-pooled over a chunk; the largest and the mean of the chunk maxima, after a ReLU, are combined linearly into one
probability. Trained by Adam on a bounded sample of labelled rows (PER_CLASS of each class, whole texts); the bias is then moved to the classes' real shares.

Defined cases: null and empty texts are one window of padding and get a score like any other; without labelled rows of both
classes every score is 1 where label 1 alone is known, else 0; repeated rows repeat; null ids are scored and never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, labelled_ids, labelled_texts, table

MOD, REMAINDER, PER_CLASS, THRESHOLD = 5, 0, 700, 0.3
FILTERS, WIDTH, EMBED, CHUNK, EPOCHS, BATCH, RATE, BLOCK = 16, 5, 6, 512, 10, 16, 0.01, 1 << 17


def windows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, WIDTH - 1 zeros after each; (first, end) of each chunk's window starts; chunks of each text."""
    parts, spans, many, at = [], [], [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass") or b"\0"
        parts.append(raw + bytes(WIDTH - 1))
        s = range(at, at + len(raw), CHUNK)
        spans.extend((i, min(i + CHUNK, at + len(raw))) for i in s)
        many.append(len(s))
        at += len(raw) + WIDTH - 1
    return np.frombuffer(b"".join(parts) + b"\0", np.uint8), np.array(spans), np.array(many)


def tables(model: dict) -> np.ndarray:
    """What each byte adds at each place of a window: (WIDTH, 256, FILTERS)."""
    return np.einsum("be,kef->kbf", model["E"], model["W"]).astype(np.float32)


def convolved(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    n = len(x) - WIDTH + 1
    out = t[0].take(x[:n], axis=0)
    for k in range(1, WIDTH):
        out += t[k].take(x[k : n + k], axis=0)
    return out


def chunk_maxima(out: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(chunks, FILTERS) of what convolved() gave. Windows that start between two texts belong to neither."""
    return np.maximum.reduceat(out, spans.reshape(-1), axis=0)[::2]


def pooled(m: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(texts, 2 FILTERS): largest and mean of each text's rectified chunk maxima."""
    at = np.r_[0, np.cumsum(many)[:-1]]
    return np.c_[np.maximum.reduceat(m, at, axis=0), np.add.reduceat(m, at, axis=0) / many[:, None]]


def predict(texts: list, model: dict, t: np.ndarray) -> np.ndarray:
    out, group, size = [], [], 0

    def run() -> None:
        x, spans, many = windows(group)
        z = pooled(np.maximum(chunk_maxima(convolved(x, t), spans) + model["b"], 0), many)
        out.append(1 / (1 + np.exp(-np.clip(z @ model["v"] + model["c"], -30, 30))))

    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= BLOCK:
            run()
            group, size = [], 0
    if group:
        run()
    return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> dict:
    """The network's weights; y: 0 or 1."""
    rng = np.random.default_rng(seed)
    model = {"E": rng.normal(0, 0.5, (256, EMBED)), "W": rng.normal(0, 0.4, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in model.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x, spans, many = windows([texts[j] for j in pick])
            out = convolved(x, tables(model))
            m = chunk_maxima(out, spans)
            best = np.stack([a + out[a:b].argmax(0) for a, b in spans])  # (chunks, FILTERS)
            r = np.maximum(m + model["b"], 0)
            z = pooled(r, many)
            d = (1 / (1 + np.exp(-np.clip(z @ model["v"] + model["c"], -30, 30))) - y[pick]) / len(pick)
            grad = {"v": z.T @ d + 1e-4 * model["v"], "c": d.sum(keepdims=True)}
            dz = d[:, None] * model["v"][None]
            of = np.repeat(np.arange(len(pick)), many)
            top = r == z[of, :FILTERS]
            share = top / np.maximum(1, np.add.reduceat(top, np.r_[0, np.cumsum(many)[:-1]], axis=0))[of]
            dm = (dz[of, :FILTERS] * share + dz[of, FILTERS:] / many[of, None]) * (r > 0)
            grad["b"] = dm.sum(0)
            cols = np.broadcast_to(np.arange(FILTERS), best.shape)
            dt = np.stack([np.bincount((x[best + k].astype(np.int64) * FILTERS + cols).ravel(), dm.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
            grad["W"] = np.einsum("be,kbf->kef", model["E"], dt)
            grad["E"] = np.einsum("kbf,kef->be", dt, model["W"])
            step += 1
            for k, g in grad.items():
                a, b = moments[k]
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                model[k] -= RATE * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """Weights; or one number, the score of all, where labelled rows of both classes are wanting."""
    ids = labelled_ids(labels, label, MOD, REMAINDER, per_class)
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in labelled_texts(docs, ids).collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.0
    model = fit([r[2] for r in rows], y)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", MOD) != REMAINDER))
    p = float(known.agg(F.avg(F.col(label).cast("double"))).first()[0])
    model["c"] = model["c"] + np.log(p / (1 - p)) - np.log(y.mean() / (1 - y.mean()))
    return model


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(part.column(1).to_pylist(), held.value, t))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", MOD, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
