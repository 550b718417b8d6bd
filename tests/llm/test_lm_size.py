"""op8_lm: words beyond the first few thousand have vectors, and rarer ones classes that the model predicts; probabilities are normalised at both levels."""

import numpy as np
import pyarrow as pa

from gridweave.llm import lm


def model_of(n, members):
    rng = np.random.default_rng(2)
    freq = rng.random(n) + 0.1
    freq /= freq.sum()
    x = rng.choice(n, 5000, p=freq).astype(np.int16)
    perm, edges = lm.grouped(x, freq, members)
    assert sorted(perm.tolist()) == list(range(n)) and edges[-1] == n and np.diff(edges).max() <= members
    return x, freq[np.argsort(perm)], perm, edges


def test_sizes():
    assert lm.FREQUENT >= 7168 and lm.TAILS >= 1023 and lm.DIM >= 32 and lm.CONTEXT >= 6


def test_probabilities_sum_to_one_over_all_symbols():
    x, freq, perm, edges = model_of(50, 8)
    m = lm.start(freq, edges)
    for scale in (1.0, 40.0):  # the second overflows without care
        big = {k: v * np.float32(scale) for k, v in m.items()}
        p = []
        for k in range(50):
            y = np.r_[perm[x[: lm.CONTEXT + 3]], np.int16(k)]
            p.append(10 ** lm.log10_probabilities(big, y, edges)[-1])
        assert abs(sum(p) - 1) < 1e-4


def test_blocks_do_not_change_scores(monkeypatch):
    x, freq, perm, edges = model_of(50, 8)
    m = lm.start(freq, edges)
    whole = lm.log10_probabilities(m, perm[x], edges)
    monkeypatch.setattr(lm, "BLOCK", 97)
    monkeypatch.setattr(lm, "INNER", 13)
    assert np.allclose(whole, lm.log10_probabilities(m, perm[x], edges), atol=1e-5)


def test_training_finds_what_follows_what():
    n = 40
    rng = np.random.default_rng(3)
    x = [0] * lm.CONTEXT
    for _ in range(20_000):
        x.append((x[-1] * 7 + 3) % n if rng.random() < 0.8 else int(rng.integers(n)))
    x = np.array(x, np.int16)
    freq = np.bincount(x, minlength=n) / len(x)
    perm, edges = lm.grouped(x, freq, 8)
    freq = freq[np.argsort(perm)]
    m, target, past = lm.start(freq, edges), np.arange(len(x)) >= lm.CONTEXT, None
    before = lm.log10_probabilities(m, perm[x], edges)[target].mean()
    for _ in range(60):
        past = lm.nce(m, perm[x], target, freq, edges, rng, past)
    after = lm.log10_probabilities(m, perm[x], edges)[target].mean()
    assert after > before + 0.35


def test_words_are_those_of_the_pattern():
    texts = ["A\tb\u00a0c  D\n\x0b\x0cE\x1cf", None, "", " x ", "\u00c9\u00e9 \x85"]
    got, rows = lm.words(pa.array(texts))
    assert list(zip(rows.tolist(), got.to_pylist())) == [(0, "a"), (0, "b\u00a0c"), (0, "d"), (0, "e\x1cf"), (3, "x"), (4, "\u00c9\u00e9"), (4, "\x85")]


def test_tail_classes_agree_with_sql(spark):
    from pyspark.sql import functions as F

    ws = [b"a", b"ab", b"abc", "\u00e9\u00e8\u65e5".encode(), b"longer-word"]
    d = spark.createDataFrame([(bytearray(w),) for w in ws], "w binary")
    got = [r[0] for r in d.select(F.crc32(F.substring("w", -lm.ENDING, lm.ENDING)) % lm.TAILS + 1).collect()]
    assert got == [lm.tail_of(w) for w in ws]


def brute_score(texts, learn, model):
    """Scores of all texts from the definition; model: what train() gave."""
    perm, edges, m = model
    seen = [w for t, known in zip(texts, learn) if known for w in (t or "").lower().encode().split()]
    c = {}
    for w in seen:
        c[w] = c.get(w, 0) + 1
    top = sorted(c, key=lambda w: (-c[w], w))[: lm.FREQUENT]
    ids = {w: i for i, w in enumerate(top, lm.TAILS + 1)}
    rare = {w: n for w, n in c.items() if w not in ids}
    n1, n2 = (sum(n == k for n in rare.values()) for k in (1, 2))
    d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
    out = []
    for t in texts:
        ws = (t or "").lower().encode().split()
        x = np.array([0] * lm.CONTEXT + [ids.get(w, lm.tail_of(w)) for w in ws] + [0], np.int16)
        s = lm.log10_probabilities(m, perm[x], edges)[lm.CONTEXT :].sum()
        for w in ws:
            if w not in ids:
                own = [n for v, n in rare.items() if lm.tail_of(v) == lm.tail_of(w)]
                s += np.log10((rare[w] - d) / sum(own) if w in rare else d * len(own) / sum(own) if own else 1.0)
        out.append(s)
    return out


def test_scores_are_those_of_the_definition(spark, monkeypatch):
    import random
    import zlib

    monkeypatch.setattr(lm, "FREQUENT", 12)
    kept = []
    plain = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(plain(*a)) or kept[-1])
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "Green", "blue", "uno", "dos", f"rare{rng.randint(0, 60)}", f"x{i}ing"]) for _ in range(rng.randint(0, 40))) for i in range(120)] + [None, "", "red unseen\u00e9", "word " * 30_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(d).collect()}
    want = brute_score(texts, [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))], kept[-1])
    for i, s in enumerate(want):
        assert abs(got[i]["score"] - s) < 1e-3 * max(1, abs(s)), i
