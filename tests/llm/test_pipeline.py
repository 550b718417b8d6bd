"""The stages one after the other, each against a plain version of its decision on its own input."""

import corpus_pipeline as p
from gridweave.llm import line_dedup, mixing, toxicity


def test_stages(spark, sf_dir, tmp_path):
    from test_jaccard import brute
    from test_llm import brute_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["toxicity"]
    scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert {r[0] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in scores.where(f"score < {toxicity.THRESHOLD}").collect()}
    before, after = seen["line_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    got = {r["doc_id"]: r for r in after.collect()}
    assert [got[i]["text"] for i, _ in rows] == brute_lines(rows, line_dedup.MIN_WORDS) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    before, after = seen["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted({rows[c][0] for c in brute([t for _, t in rows])})
    before, after = seen["mixing"]
    copies = {r["doc_id"]: r["__copies"] for r in mixing.mix(before).collect()}
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in copies.items() if n} == counts
    pieces = seen["packing"][1]
    assert pieces.where("start = 0").count() == after.count()
