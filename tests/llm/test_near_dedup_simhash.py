"""The near-dedup stage goes through fingerprints and BK-trees; the exact search adds what they have not joined."""

import random

import corpus_pipeline
from gridweave.llm import jaccard, simhash


def texts(seed=11):
    rng = random.Random(seed)
    out = []
    for _ in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        out.append(base)
        for changed in (1, 2, 3, 6):
            copy = list(base)
            for i in rng.sample(range(150), changed):
                copy[i] = f"w{rng.randrange(3000)}"
            out.append(copy)
    rng.shuffle(out)
    return [" ".join(t) for t in out]


def test_pairs_by_fingerprint_are_those_of_all_pairs(spark):
    fps = [simhash.fingerprint(t, jaccard.WORDS) for t in texts()] * 2
    d = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rid long, fp long")
    got = [tuple(r) for r in jaccard._by_fingerprint(d, jaccard.RADIUS).collect()]
    assert all(a < b and (fps[a] ^ fps[b]).bit_count() <= jaccard.RADIUS for a, b in got)
    near = {i for i, f in enumerate(fps[: len(fps) // 2]) if any(f != g and (f ^ g).bit_count() <= jaccard.RADIUS for g in fps)}
    found = {i for a, b in got if fps[a] != fps[b] for i in (a, b)}
    assert found <= near and len(found) > 10
    assert all(any(fps[i] != fps[j] and (fps[i] ^ fps[j]).bit_count() <= jaccard.RADIUS for j in found) for i in near - found)
    assert {b for a, b in got if fps[a] == fps[b]} >= set(range(len(fps) // 2, len(fps)))


def test_stage_links_by_bk_trees_first(spark, tmp_path, monkeypatch):
    from test_jaccard import brute

    rows, calls, real = texts(), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: calls.append(a[1]) or real(*a, **k), raising=False)
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(brute(rows)))
    assert calls == [jaccard.RADIUS]
