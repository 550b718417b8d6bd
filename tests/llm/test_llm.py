"""Small cases and brute-force versions of the llm operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import ann, langid, line_dedup, lm, media, mixing, packing, quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, tmp_path, rows, extra=None):
    """A table on disk; rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS).coalesce(2)
    for name in extra or ():
        df = df.withColumn(name, F.lit("clash"))
    path = str(tmp_path / f"t{random.random()}")
    df.write.parquet(path)
    return spark.read.parquet(path)


LONG = " ".join(f"word{i}" for i in range(6000))
ODD = [(1, None), (2, ""), (3, LONG), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (5, " \n\t "), (6, "éè 日本 ² <|endoftext|>")]


# --- 1: line dedup --------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    seq, at, out = [], [], []
    for _, text in rows:
        parts = None if text is None else text.split("\n")
        at.append((len(seq), parts))
        seq.extend(parts or [])
    end = [0] * len(seq)
    for start, parts in at:
        for i in range(len(parts or [])):
            end[start + i] = start + len(parts)
    dead, where = set(), defaultdict(list)
    for i, line in enumerate(seq):
        best = 0
        for j in where[line]:
            n = 0
            while i + n < end[i] and j + n < end[j] and seq[i + n] == seq[j + n]:
                n += 1
            best = max(best, n)
        where[line].append(i)
        if best and sum(len(x.split()) for x in seq[i : i + best]) >= least:
            dead.update(range(i, i + best))
    for start, parts in at:
        out.append(None if parts is None else "\n".join(x for k, x in enumerate(parts) if start + k not in dead))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup_is_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", "g"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a b\n" * 30), (103, "x\ny\nz"), (104, "x\ny\nz")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, tmp_path, rows, ["keep", "rid", "a"]), 4).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows, 4)


def test_line_dedup_cases(spark, tmp_path):
    out = line_dedup.dedup_lines(docs(spark, tmp_path, ODD))
    assert out.count() == len(ODD) and out.where("doc_id = 1").first()["text"] is None
    assert line_dedup.dedup_lines(docs(spark, tmp_path, [])).count() == 0


# --- 2: toxicity ----------------------------------------------------------------------------------------------------


def corpus(n=240):
    rng = random.Random(5)
    base = ["river", "stone", "garden", "window", "letter", "summer", "yellow", "market", "people", "simple"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(base) + rng.choice(["", "s", "ly"]) for _ in range(25)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(25)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words), rng.choice(["en", "xx"]), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_sees_through_disguise(spark, tmp_path):
    rows, labels = corpus()
    more = [(9001, "river stone 1d10t garden"), (9002, "river i d i o t stone"), (9003, "the m0r0n letter"), (9004, "moroooon people"), (9005, "river stone garden 2024 letter"), (9006, None), (9007, "")]
    d = docs(spark, tmp_path, rows + more, ["score", "held_out"])
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert all(got[i] >= 0.3 for i in (9001, 9002, 9003, 9004)) and all(got[i] < 0.3 for i in (9005, 9006, 9007))
    assert {r["doc_id"] for r in toxicity.keep_clean(d, model).where("doc_id > 9000").collect()} == {9005, 9006, 9007}
    assert toxicity.keep_clean(d, model).columns == d.columns
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none is None and toxicity.score(d, none).where("score <> 0").count() == 0


# --- 3: SimHash -----------------------------------------------------------------------------------------------------


def test_bk_links_are_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 6)], base ^ np.uint64(0b10101), base ^ np.uint64(0b11110000)]))
    label = simhash.bk_links(np.zeros(len(fp), np.int64), fp, 3)
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([want[np.bitwise_count(fp ^ f) <= 3].min() for f in fp])
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


def test_simhash_components(spark, tmp_path):
    rows = ODD + [(7, LONG + " tail"), (8, LONG.upper()), (9, "Same text here")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, tmp_path, rows, ["fp", "m", "root"])).collect()}
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    assert all(got[i]["fp"] % (1 << 64) == fp[i] for i in fp)
    ids = [i for i in fp if i is not None]
    root = {i: i for i in fp}
    for _ in ids:
        for i in ids:
            root[i] = min([root[j] for j in fp if j is not None and bin(fp[i] ^ fp[j]).count("1") <= 3])
    assert all(got[i]["component_id"] == root[i] for i in ids)
    assert got[8]["component_id"] == 3 and got[9]["component_id"] == 4 and got[1]["component_id"] == got[2]["component_id"] == 1
    assert simhash.near_duplicates(docs(spark, tmp_path, [])).count() == 0
    kept = simhash.one_of_each(docs(spark, tmp_path, rows))
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id in (2, 5, 8, 9)").count() == 0


# --- 4: nearest neighbours ------------------------------------------------------------------------------------------


def test_ann_small_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 4), (102, [1.0, float("nan"), 0.0, 1.0]), (103, [1.0, 2.0]), (104, [1.0, None, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 20 == 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    n = np.sqrt((x * x).sum(1))
    for q in (3, 23, 43):
        s = (x[q] * x).sum(1) / (n[q] * n)
        s[q] = -9
        assert got[q] == np.lexsort((np.arange(60), -s))[:5].tolist()
    assert set(got) == {3, 23, 43}
    assert ann.search(d.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert ann.search(d.where("vec_id > 99"), F.col("vec_id") == 100).count() == 0


def brute_neighbours(x, ids, queries, k=5):
    n, out = np.sqrt((x * x).sum(1)), {}
    for q in queries:
        s = (x[q] * x).sum(1) / (n[q] * n)
        s[ids == ids[q]] = -9
        out[ids[q]] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def test_ann_recall_with_many_parts(spark, monkeypatch):
    kept = []
    index = ann.index
    monkeypatch.setattr(ann, "index", lambda *a, **b: kept.append(index(*a, **b)) or kept[-1])
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(1000, 16)), 20, axis=0) + 0.3 * rng.normal(size=(20_000, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, F.col("vec_id") % 100 == 0, part=64).toPandas()
    want = brute_neighbours(x, np.arange(20_000), range(0, 20_000, 100))
    assert sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.9 * 1000
    base, asked = kept[-1]
    sizes = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    scanned = sum(sizes.get(r["part"], 0) * r["count"] for r in asked.groupBy("part").count().collect()) / 200
    assert len(sizes) > 150 and base.count() == 20_000 and scanned < 6_000


def test_ann_equal_vectors_ids_and_sizes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x[10:30] = x[10]  # more copies than a result holds
    ids = np.arange(40) * 7
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(0, x[0].tolist()), (7, [-9.0, 0.0, 0.0])]
    x[1] = min(x[1].tolist(), [-9.0, 0.0, 0.0])  # the least vector of an id is the id's
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(d, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == brute_neighbours(x, ids, range(40))
    big = spark.createDataFrame([(1, [1e300, 2e300]), (2, [1e-310, 2e-310]), (3, [2.0, -1.0])], "vec_id long, embedding array<double>")
    r = ann.search(big, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [x["vec_id"] for x in r] == [2, 3] and abs(r[0]["score"] - 1) < 1e-9 and abs(r[1]["score"]) < 1e-12


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(ann.balanced_parts(ann.graph(x.astype(np.float32)), 8), minlength=8)
    assert sizes.sum() == 400 and sizes.max() <= 53


# --- 5: packing -----------------------------------------------------------------------------------------------------


def test_packing_covers_every_token(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ODD + [(i, LONG[: i * 37]) for i in range(50, 90)]
    got = packing.pack(docs(spark, tmp_path, rows, ["length", "left"]), size=256).toPandas()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    want = Counter(i for i, _ in rows)
    for i, g in got.groupby("doc_id", dropna=False):
        i = None if i != i else int(i)
        assert g.length.sum() == len(ids[i]) * want[i]
        for r in g.itertuples():
            assert r.doc_tokens == len(ids[i]) and zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 256
    assert got.length.sum() / (got.sequence_id.nunique() * 256) > 0.97
    assert packing.pack(docs(spark, tmp_path, [])).count() == 0


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(), random.Random(2)
    for _ in range(1500):
        s = "".join(rng.choice(["a", " ", "  ", "\n", "it's", "é", "9", "²", "_", "!", "\x1c", " x", "\t", "'S", "日本", "<|endoftext|>", "̀", "\x85", " \n "]) for _ in range(rng.randint(0, 12)))
        assert list(encode(s)) == tok.encode(s, add_special_tokens=False).ids


# --- 6: mixing ------------------------------------------------------------------------------------------------------


def test_mixing_targets(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", "c", None])) for i in range(600)] + [(1000, None, None, "empty"), (1001, "one", None, "b"), (1001, "one", None, "b")]
    out = mixing.mix(docs(spark, tmp_path, rows, ["size", "target", "q"])).toPandas()
    assert len(out) == len(rows) and out.__copies.max() <= 2
    total = out.__size.sum()
    for _, g in out.groupby("source", dropna=False):
        assert abs((g.__copies * g.__size).sum() - g.__target.iloc[0]) <= 60 and g.__target.iloc[0] <= 2 * g.__size.sum() + 1e-9
    assert abs(out.groupby("source", dropna=False).__target.first().sum() - 1.5 * total) < 1e-6
    assert mixing.mix(docs(spark, tmp_path, [])).count() == 0


def test_mixing_importance_raises_the_odds(spark, tmp_path):
    d = docs(spark, tmp_path, [(i, "w w w", "en", "a") for i in range(2000)]).withColumn("gain", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25))
    out = mixing.mix(d, importance="gain").groupBy(F.col("doc_id") % 2).agg(F.avg("__copies").alias("n")).orderBy(F.desc("n")).collect()
    assert out[0][0] == 0 and out[0]["n"] > out[1]["n"] + 0.2


# --- 7: media -------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, tmp_path):
    d = docs(spark, tmp_path, ODD, ["shard", "feature"])
    index = media.write_shards(d, str(tmp_path / "media"))
    got = media.read_media(index).collect()
    text = dict(ODD)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        body = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        assert (r["width"], r["height"], r["bit_depth"], r["colour_type"]) == (576, len(body) // 576, 8, 0)
        with tarfile.open(r["shard"]) as tar:
            media_bytes = tar.extractfile(f"{r['media_sha256']}.png").read()
        assert hashlib.sha256(media_bytes).hexdigest() == r["media_sha256"] and len(media_bytes) == r["media_bytes"]
    assert len(got) == len(ODD) and len({r["feature"] for r in got if text[r["doc_id"]] in (None, "")}) == 1
    assert media.read_media(index, whole=False).where("payload_sha256 is null and width = 576").count() == len(ODD)
    assert media.read_media(media.write_shards(docs(spark, tmp_path, []), str(tmp_path / "none"))).count() == 0


# --- 8: language model ----------------------------------------------------------------------------------------------


def test_lm_base_and_gain(spark, tmp_path):
    rng = random.Random(3)
    words = [["red", "green", "blue", "grey"], ["uno", "dos", "tres", "seis"]]
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(30)) + f" rare{i}") for i in range(300)] + [(1000, None), (1001, ""), (None, "red RED")]
    got = {r["doc_id"]: r for r in lm.score(docs(spark, tmp_path, rows, ["base", "h"])).collect()}
    learn = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in learn for w in (t or "").lower().split())
    n, v = sum(c.values()) + len(learn), len(c) + 1
    for i, t in rows:
        ws, r = (t or "").lower().split(), got[i]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) + np.log10((len(learn) + 1) / (n + v + 1))
        assert r["n_tokens"] == len(ws) + 1 and r["n_known"] == 1 + sum(c[w] > 0 for w in ws) and r["train_tokens"] == n
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] <= 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.score(docs(spark, tmp_path, [])).count() == 0


# --- 9 and 10: language, quality --------------------------------------------------------------------------------------


def test_language(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([["the", "and", "with"], ["der", "und", "nicht"]][i % 2]) for _ in range(20)), ["en", "de"][i % 2]) for i in range(160)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "und nicht der", None)]
    d = docs(spark, tmp_path, rows, ["lang_pred", "cells"])
    got = {r["doc_id"]: r for r in langid.identify(d, langid.train(d)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:160]) and got[1003]["lang_pred"] == "de"
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    none = docs(spark, tmp_path, [(1, "some text", None)])
    assert langid.identify(none, langid.train(none)).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, tmp_path, []), None).count() == 0


def test_quality(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "words", "here"]) + ("%%%" if i % 3 == 0 else "") for _ in range(rng.choice([30, 30, 900])))) for i in range(240)] + [(1000, None), (1001, ""), (1002, "good words here here good words words good " * 5_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    d = docs(spark, tmp_path, rows, ["y", "score"])
    got = {r["doc_id"]: r["score"] for r in quality.score(d, quality.train(d, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(240)]) > 0.98 and got[1002] > 0.5 and 0 <= got[1000] <= 1 and got[1000] == pytest.approx(got[1001])
    assert quality.train(d, labels.where("quality = 1")) == 1.0 and quality.train(d, labels.limit(0)) == 0.0


def test_quality_chunks_cover_the_whole_text():
    model = quality.fit(["aaaa", "bbbb"] * 4, np.array([1.0, 0.0] * 4), epochs=1)
    t = quality.tables(model)
    text = "x" * 511 + "zq" + "x" * 2000
    x, spans, many = quality.windows([text, "y"])
    m = quality.chunk_maxima(quality.convolved(x, t), spans)
    raw = np.frombuffer(text.encode() + bytes(quality.WIDTH - 1), np.uint8)
    whole = np.stack([sum(t[k][raw[i + k]] for k in range(quality.WIDTH)) for i in range(len(text))])
    assert many.tolist() == [5, 1] and np.allclose(m[:5].max(0), whole.max(0), atol=1e-5)
