"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character 1- to 3-grams of the lower-cased whole text, with every run of non-letters as one blank, hashed to DIM
cells; log(1 + count) times the cell's inverse document frequency over all documents; unit length. Training: FTRL-proximal
with L1 and L2 penalties over a bounded sample of labelled rows, PER_LANG of each language. Every fifth row is kept from it and
sets the temperature that divides the logits.

Defined cases: a null text or one without a letter is `und` with score 0; so is any text when there is nothing to learn from; a row
with a null language or id is never learned from; repeated rows repeat; other columns are ignored. Every language that has a row is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chance, fold, held_out, table

DIM_BITS, PER_LANG, MOST_BROADCAST, MOD, REMAINDER = 15, 800, 20_000, 4, 2
DIM = 1 << DIM_BITS
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.1, 4


class Features:
    """text -> (cells, counts)."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """None without a letter."""
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[c]
        if not letter.any():
            return None
        c = np.where(letter, c, np.uint32(32))
        c = np.r_[np.uint32(32), c[letter | np.r_[True, letter[:-1]]], np.uint32(32)].astype(np.uint32)
        mix = lambda h, k: ((h ^ (h >> np.uint32(15))) * np.uint32(k)) >> np.uint32(32 - DIM_BITS)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        counts = np.bincount(np.concatenate([mix(c, 0x2C1B3C6D), mix(two, 0x297A2D39), mix(three, 0xC2B2AE35)]), minlength=DIM)
        cells = np.flatnonzero(counts)
        return cells, counts[cells]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make, df, n = Features(), np.zeros(DIM, np.int64), 0
    for b in batches:
        for text in b.column(0):
            if got := make(text.as_py()):
                df[got[0]] += 1
                n += 1
    cells = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[cells, -1]), pa.array(np.r_[df[cells], n])], ["cell", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all documents that have a letter; DIM values."""
    rows = docs.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIM), 0
    for cell, k in rows:
        if cell < 0:
            n = k
        else:
            df[cell] = k
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def values(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.sqrt(v @ v)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, dim: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS, seed=7) -> np.ndarray:
    """(dim, n_classes) weights of multinomial logistic regression, sparse by the L1 penalty."""
    z, n = np.zeros((dim, n_classes), np.float32), np.zeros((dim, n_classes), np.float32)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, np.float32(0), -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            cells, v, y = rows[i]
            zi, ni = z[cells], n[cells]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            more = ni + g * g
            z[cells] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[cells] = more
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That of least negative log-likelihood, of a fixed grid."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 150):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        best = min(best, (float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()), float(t)))
    return best[1]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Features()
    for b in batches:
        rows = [(lang, got[0].astype(np.uint16).tobytes(), np.minimum(got[1], 65535).astype(np.uint16).tobytes()) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (got := make(text))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.binary(), pa.binary()))], ["lang", "cells", "counts"])


def train(docs: DataFrame, per_lang: int = PER_LANG):
    """(languages, idf, weights, temperature), or None without labelled rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", MOD) != REMAINDER))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    got = known.join(counts, "lang").where(chance(F.col("doc_id"), 29) < F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))).select("text", "lang")
    got = sorted(got.mapInArrow(_sampled, "lang string, cells binary, counts binary").collect())
    if not got:
        return None
    idf, langs = inverse_frequencies(docs), sorted({r[0] for r in got})
    rows = []
    for lang, cells, n in got:
        cells = np.frombuffer(cells, np.uint16).astype(np.int64)
        v = values(np.frombuffer(n, np.uint16), idf[cells])
        rows.append((np.r_[cells, DIM], np.r_[v, np.float32(1)], langs.index(lang)))
    kept = [r for i, r in enumerate(rows) if i % 5 == 0]
    w = ftrl([r for i, r in enumerate(rows) if i % 5] or rows, len(langs), DIM + 1)
    t = temperature(np.array([v @ w[c] for c, v, _ in kept]), np.array([y for *_, y in kept]))
    return langs, idf, w, t


def identify(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                got = make(text.as_py()) if held.value else None
                if got is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                names, idf, w, t = held.value
                s = (values(got[1], idf[got[0]]) @ w[got[0]] + w[DIM]) / t
                p = np.exp(s - s.max())
                k = int(p.argmax())
                langs.append(names[k])
                scores.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out("doc_id", MOD, REMAINDER).alias("held_out"), "lang_pred", "score")
