"""Long texts: pairs that cannot be similar are left out by bitmaps as wide as the texts are long; pairs are verified in slices."""

import random

import numpy as np
import pytest

from gridweave.llm import jaccard

SCHEMA = "rid long, text string"


def chain(n: int, size: int = 700) -> list[str]:
    """Texts of two blocks of words, of which each shares one with the next: a similarity of a third. The last one has a near copy."""
    r = random.Random(3)
    blocks = [[f"w{r.randrange(10**9)}" for _ in range(size)] for _ in range(n + 1)]
    texts = [" ".join(a + b) for a, b in zip(blocks, blocks[1:])]
    return [*texts, texts[-1] + " another end"]


def test_long_texts_that_differ_are_not_verified(spark, monkeypatch):
    texts, seen, real = chain(20), [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == {(19, 19), (20, 19)}
    assert sum(seen) <= 2


@pytest.mark.parametrize("n", [200, 257, 700, 1000, 1025, 5000])
def test_no_similar_pair_is_left_out(n):
    r = np.random.default_rng(n)
    for share in (1.0, 0.95, 0.9):
        s = np.unique(r.integers(-(2**63), 2**63 - 1, n, np.int64))
        kept = r.choice(s, int(n * share), replace=False)
        t = np.unique(np.r_[kept, r.integers(-(2**63), 2**63 - 1, (n - len(kept)) // 3, np.int64)])
        x, y = jaccard.wide(s), jaccard.wide(t)
        if x is None or y is None:
            continue
        apart = len(np.setxor1d(s, t))
        assert jaccard.differing(x, y) == jaccard.differing(y, x) <= apart
    # halves of one table of buckets are those of a table half as large
    assert jaccard.differing(jaccard.bitmap(s, 4096), jaccard.bitmap(s, 1024)) == 0


def test_slices_find_the_same(spark, monkeypatch):
    texts = chain(12) + [f"{t} more" for t in chain(12)[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    assert {c for _, c in want} == set(range(9)) | {11}
    monkeypatch.setattr(jaccard, "SLICE", 3)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want
