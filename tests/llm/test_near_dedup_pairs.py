"""Near-duplicates: texts of like wording but below the similarity are not compared pair by pair, and texts are not shuffled to drop copies."""

import random

import numpy as np

from gridweave.llm import jaccard, simhash
from gridweave.llm.common import among


def family(many=150, changed=4, seed=7):
    """Copies of one text, each with words of its own: pairs have a similarity of about two thirds, a few are exact or near copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    out = []
    for i in range(many):
        copy = list(base)
        for j in rng.sample(range(200), changed):
            copy[j] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
        if i % 10 == 0:
            out += [" ".join(copy), " ".join([*copy[:-1], "end"])]
    return out


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    far = 0
    for size in (1, 3, 20, 113, 900):
        for _ in range(100):
            s = rng.integers(-(2**63), 2**63, size, np.int64)
            t = s.copy()
            t[rng.random(size) < rng.random() * 0.6] += 1 << 21
            s, t = np.unique(s), np.unique(t)
            alike = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
            ok = jaccard._near(np.array([len(s)]), jaccard.bitmap(s)[None], np.array([len(t)]), jaccard.bitmap(t)[None], 0.8)[0]
            assert ok or alike < 0.8
            far += alike < 0.6 and size == 113 and not ok
    assert far > 20


def test_texts_below_the_similarity_are_seldom_verified(spark, monkeypatch):
    from test_jaccard import brute

    rows, seen, real = family(), [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    got = {r["rid"]: r["c"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "rid long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert [got.get(i, i) for i in range(len(rows))] == want and len(set(want)) > 140
    assert sum(seen) < 600  # of 13,530 pairs of different texts


def test_many_links_are_joined_alike(spark, monkeypatch):
    from test_jaccard import brute, texts

    rows = texts(4)[::2]
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    got = {r["rid"]: r["c"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "rid long, text string").repartition(3)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == brute(rows)


def test_numbers_among_others(spark):
    numbers = [*range(-300, 700, 3), 2**33, 2**33 + 255, 2**33 + 256, 2**62 + 63]
    ids = [*range(-300, 700, 5), 2**33 + 255, 2**62 + 63]
    d = spark.createDataFrame([(i, "t") for i in numbers], "`a.rid` long, __key string")
    few = spark.createDataFrame([(i,) for i in ids * 2], "`a.rid` long")
    for most in (1000, 0):
        for those in (True, False):
            out = among(d, "a.rid", few, most, those) if most else among(d.toDF("r", "__key"), "r", few.toDF("r"), most, those)
            assert sorted(r[0] for r in out.collect()) == sorted(i for i in numbers if (i in set(ids)) == those)
            assert len(out.columns) == 2


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(simhash, "MOST_BROADCAST", 20)
    out = simhash.one_of_each(spark.read.parquet(str(tmp_path / "d")), found=jaccard.near_duplicates)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 400, 2))
