"""The lattice of op2_toxicity: doubled letters, spacing, and the least cost over all readings."""

import itertools

import numpy as np
import pytest

from gridweave.llm import toxicity

WORDS = "you are a an the moron idiot stupid loser trash clown letter river stone garden people books street".split()


@pytest.fixture(scope="module")
def decode():
    """A decoder whose model is counted over sentences of WORDS."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, 12)) for _ in range(600)]
    (cells,) = toxicity._trigrams(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    tri = np.zeros(toxicity.K**3)
    tri[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    tri = tri.reshape(toxicity.K, toxicity.K, toxicity.K)
    bi = tri.sum(0)
    p2 = (bi + 20 * (bi.sum(0) + 1) / (bi.sum() + toxicity.K)) / (bi.sum(1, keepdims=True) + 20)
    return toxicity.Decoder(-np.log((tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)).astype(np.float32))


@pytest.mark.parametrize("token,word", [("stuupid", "stupid"), ("iidiot", "idiot"), ("mmoron", "moron"), ("clowwn", "clown"), ("sttupid", "stupid"), ("losser", "loser"), ("trassh", "trash")])
def test_doubled_letters(decode, token, word):
    assert word in toxicity.words_of(token, decode)


def test_true_doubles_stay(decode):
    assert all(w in toxicity.words_of(w, decode) for w in ("letter", "books", "street"))


@pytest.mark.parametrize("text,words", [
    ("you are a m o r o n", {"moron"}), ("s t u p i d m o r o n", {"stupid", "moron"}), ("s  t  u  p  i  d", {"stupid"}), ("m/o/r/o/n", {"moron"}), ("m\no\nr\no\nn", {"moron"}),
    ("river mo ron garden", {"moron"}), ("river stu pid garden", {"stupid"}), ("m 0 r 0 n people", {"moron"}), ("y o u", {"you"}),
])
def test_spacing(decode, text, words):
    reader = toxicity.Reader(np.array(decode.cost))
    assert words <= reader.words(text) == set(reader.restored(text).split())


def test_plain_short_words_stay_apart(decode):
    assert decode.span("you are a") == "you are a" and decode.span("the an you") == "the an you"


def least(decode, steps):
    """By trying all readings."""
    best = None
    for path in itertools.product(*steps):
        s, a, b = 0.0, 0, 0
        for _, codes, channel in path:
            s += channel
            for k in codes:
                s += decode.cost[(a * toxicity.K + b) * toxicity.K + k]
                a, b = b, k
        s += decode.cost[(a * toxicity.K + b) * toxicity.K]
        text = "".join(p[0] for p in path)
        best = min(best, (s, text)) if best else (s, text)
    return best


def test_search_is_exact(decode):
    rng = np.random.default_rng(2)
    disguise = {"o": "0*", "i": "1!*", "s": "5$", "t": "+7", "a": "@4*", "e": "3*", "u": "*", "l": "1|"}
    for _ in range(200):
        word = rng.choice(["stupid", "moron", "idiot", "loser", "trash"])
        token = "".join(rng.choice(list(disguise[c])) if c in disguise and rng.random() < 0.8 else c for c in word)
        runs = [(m[1], len(m[0])) for m in toxicity._RUNS.finditer(token)]
        steps = [[(t, [0 if x == " " else toxicity._CODE.get(x, 1) for x in t], c) for t, c in decode.options(ch, n, i in (0, len(runs) - 1))] for i, (ch, n) in enumerate(runs)]
        assert decode(token) == least(decode, steps)[1], token


def test_doubles_are_read_as_the_lattice_reads_them(decode):
    rng = np.random.default_rng(5)
    for _ in range(400):
        token = "".join(str(c) * int(rng.choice([1, 1, 2])) for c in rng.choice(list("stupidmorneal"), rng.integers(1, 9)))
        runs = [(m[1], len(m[0])) for m in toxicity._RUNS.finditer(token)]
        steps = [[(t, [toxicity._CODE.get(x, 1) for x in t], c) for t, c in decode.options(ch, n, i in (0, len(runs) - 1))] for i, (ch, n) in enumerate(runs)]
        assert decode(token) == least(decode, steps)[1], token


def test_spans_are_read_alike_with_and_without_memory(decode):
    rng = np.random.default_rng(6)
    parts = ["mo", "ron", "the", "an", "a", "s", "t", "all", "you", "1d", "are"]
    once = toxicity.Reader(np.array(decode.cost))
    for _ in range(300):
        text = "".join(str(rng.choice(parts)) + str(rng.choice([" ", " ", "  ", "\n", ". ", "_"])) for _ in range(rng.integers(2, 9))).strip()
        assert once.tokens(text) == toxicity.Reader(np.array(decode.cost)).tokens(text)


def test_evidence_is_that_of_all_restored_words(decode):
    weights = ({"moron": 3.0, "stupid": 2.5}, {"idio": 1.5, "tras": 1.0})
    found, reader = toxicity.Evidence(weights, np.array(decode.cost)), toxicity.Reader(np.array(decode.cost))
    for text in ["you are a m o r o n", "stuupid moron, idiots", "", None, "river stone", "the trash. trashy idiot stupid moron", "river stone"] * 3:
        assert found.text(text) == found.words(reader.words(text))
