"""Near-duplicates by five-word shingles against all pairs."""

import random

import corpus_pipeline
from gridweave.llm import jaccard


def texts(seed=3):
    """Bases, near copies of them with one to ten words changed, a large family, and a passage that dissimilar texts share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(120)]
        out.append(base)
        for changed in range(1, 11):
            copy = list(base)
            for i in rng.sample(range(120), changed):
                copy[i] = rng.choice(vocab)
            out.append(copy)
    family = [rng.choice(vocab) for _ in range(200)]
    for _ in range(40):
        copy = list(family)
        for i in rng.sample(range(200), 2):
            copy[i] = rng.choice(vocab)
        out.append(copy)
    passage = [rng.choice(vocab) for _ in range(40)]
    out += [[rng.choice(vocab) for _ in range(60)] + passage for _ in range(30)]
    rng.shuffle(out)
    return [" ".join(t) for t in out] + ["", None, "", "two words", "Two Words", "two  words", "one"]


def brute(rows):
    sets = [set(jaccard.shingles(t).tolist()) for t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(rows))]


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    rows = texts()
    want = brute(rows)
    d = spark.createDataFrame(list(enumerate(rows)), "rid long, text string").repartition(3)
    for chunk, block in ((1_000_000, 2_000), (50, 7)):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r["rid"]: r["c"] for r in jaccard.near_duplicates(d).collect()}
        assert [got.get(i, i) for i in range(len(rows))] == want
    assert len(set(want)) < len(rows) - 60
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_stage_finds_copies_beyond_three_bits(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(brute(rows)))
