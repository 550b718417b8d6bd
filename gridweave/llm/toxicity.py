"""Toxicity by noisy-channel deobfuscation.

A character trigram language model is counted over all documents (no labels). Each token that has more than one reading is a
lattice: a leetspeak character may stand for a letter, a run of one letter for one or two, an inner symbol for nothing, a
star for a vowel. Neighbouring tokens of SHORT characters or fewer are one lattice, in which each separator is a word end or nothing, so
letters spaced out and words split or run together part where the language model has them part. A Viterbi search over the lattice finds the
reading of least channel cost plus language-model cost. The restored words are then scored.

Scoring: smoothed log-odds are counted over a bounded sample of labelled rows (PER_CLASS rows of each class), first of whole
words, then of the PREFIXES of words that have no strong evidence as a whole. A word's evidence is that of its whole form
or else the largest of its prefixes. A document's probability is a logistic function of its
three largest evidences, which is fitted on labelled rows whose words were not counted for it.

Defined cases: null and empty texts have no words and get the probability of no evidence; without labelled rows of
both classes every score is 0; repeated rows repeat; null ids are scored and never learned from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, held_out, labelled_ids, labelled_texts, lean, table

#: Letters that a character may stand for, vowels that a star may hide, and the model's alphabet.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
VOWELS = "aeiou"
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
MOD, REMAINDER, PER_CLASS, PREFIXES, PRIOR, MIN_ROWS, STRONG, MAX_FEATURES, CACHE, SPANS, THRESHOLD = 4, 2, 6000, (4, 5, 6), 5.0, 3, 2.0, 100_000, 150_000, 20_000, 0.3
#: Channel costs, in nats.
SUBSTITUTE, AT_EDGE, DELETE, HIDDEN, SHORTEN, JOIN = 1.0, 4.0, 1.0, 2.0, 0.5, 1.0
SHORT = 4  # characters of a token that may be a part of a word
K = len(ALPHABET) + 2  # 0: word boundary, 1: any other letter
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}
_RUNS = re.compile(r"(.)\1*", re.S)
_PLAIN = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^\W_@$!+€£|*#]+")
_DOUBLE = re.compile(r"(.)\1")
_DENSE = re.compile(r"(.)\1(?:\1|(.)\2)")  # three of a letter, or two doubled letters side by side
_UNIT, _GAP = r"(?:[^\W_]|[@$!+€£]){1,%d}" % SHORT, r"[\s./\\\-_*]{1,4}"
_SPAN = re.compile(rf"(?<![^\W_]){_UNIT}(?:{_GAP}{_UNIT})+(?![^\W_])")
_FAST = r"[\w@$!+€£]{1,%d}(?!\w)" % SHORT  # the same for texts without "_"
_SPAN_FAST = re.compile(rf"(?<!\w){_FAST}(?:{_GAP}{_FAST})+")
_CUT = re.compile(f"({_GAP})")
_EDGE = " \t\n\r\x0b\x0c.,;:?!\"'()[]{}«»¿¡…–—-%&#*~^=/\\_"


# --- the language model -------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Class of each code point of the first plane."""
    out = np.zeros(65536, np.int64)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            out[i] = _CODE.get(c, 1)
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes, total = _classes(), np.zeros(K**3, np.int64)
    held: list[np.ndarray] = []

    def add() -> None:
        x, at = np.concatenate(held), np.cumsum([len(h) for h in held])[:-1]
        keys = (x[:-2] * K + x[1:-1]) * K + x[2:]
        within = np.ones(len(keys), bool)
        within[at - 2], within[at - 1] = False, False  # those over the edge of two texts
        total[:] += np.bincount(keys[within], minlength=K**3)
        held.clear()

    size = 0
    for b in batches:
        for text in b.column(0):
            codes = np.frombuffer((text.as_py() or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            x = np.where(codes < 65536, classes[np.minimum(codes, 65535)], 1)
            x = x[np.r_[True, (x[1:] > 0) | (x[:-1] > 0)]] if len(x) else x  # one boundary between words
            if len(x):
                held.append(np.r_[0, 0, x[int(x[0] == 0) :], 0] if x[-1] else np.r_[0, 0, x[int(x[0] == 0) :]])
                size += len(x)
            if size > 1 << 20:
                add()
                size = 0
    if held:
        add()
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """Negative log-probabilities [a, b, c] of c after a, b; interpolated with bigrams and the uniform. At most K**3 cells reach the driver."""
    counts = docs.select("text").mapInArrow(lean(_trigrams), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    tri = np.zeros(K**3)
    for cell, n in counts.collect():
        tri[cell] = n
    tri = tri.reshape(K, K, K)
    bi = tri.sum(0)
    uni = (bi.sum(0) + 1) / (bi.sum() + K)
    p2 = (bi + 20 * uni) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


# --- decoding -----------------------------------------------------------------------------------------------------


class Decoder:
    """Restores tokens. cost: of char_model()."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.seen, self.single, self.spaced, self.pairs = cost.reshape(-1).tolist(), {}, {}, set(), {}

    def options(self, c: str, n: int, edge: bool) -> list[tuple[str, float]]:
        """Readings of a run of n characters c."""
        if c.isalpha():
            if n == 1:
                return [(c, 0.0)]
            if n == 2:
                return [(c + c, 0.0), (c, SHORTEN + 2.0)]
            return [(c, SHORTEN), (c + c, SHORTEN), (c * n, 2.0 * n)]
        out = [("", DELETE if edge else DELETE * 1.5)]
        for x in LEET.get(c, ""):
            sub = AT_EDGE if edge and c in "!(<$+" else SUBSTITUTE
            out.append((x, sub))
            if n > 1:
                out.append((x + x, sub + SHORTEN))
        if c in "*#" and not edge:
            out += [(x, HIDDEN) for x in VOWELS]
        if c.isdigit():
            out[0] = ("", 8.0)  # more than a letter costs in the model, or digits would rather vanish
        elif c in LEET and not edge:
            out[0] = ("", 4.0)
        if not c.isalnum() and c not in LEET and c not in "*#-_.'~^":
            out = [(" ", 0.0)] if not edge else [("", 0.0)]
        return out

    def __call__(self, token: str) -> str:
        """The best reading of a lower-case token; a space in it parts words."""
        if token.isalpha() and not _DENSE.search(token):
            return _DOUBLE.sub(lambda m: self._double(token[max(0, m.start() - 1) : m.end() + 1], m[1], m.start() > 0), token)
        runs = [(m[1], len(m[0])) for m in _RUNS.finditer(token)]
        last = len(runs) - 1
        return self.best([self._coded(c, n, i == 0 or i == last) for i, (c, n) in enumerate(runs)])

    def span(self, text: str) -> str:
        """The best reading of a lower-case _SPAN. After a token of two plain letters or more that has one reading, the state is known; so what
        lies between two such tokens is read by itself, once for all rows that have it between the same letters."""
        words = text.split(" ")
        if all(map(self.single.get, words)) and self.spaced.issuperset([p[-2:] + q[:2] for p, q in zip(words, words[1:])]):
            return text  # tokens of one reading, and spaces known to be word ends between such letters
        out, before, between, single = [], None, [], self.single
        for part in _CUT.split(text):
            one = single.get(part)
            if one is None:
                if len(single) >= CACHE:
                    single.clear()
                one = single[part] = len(part) > 1 and part.isalpha() and not _DOUBLE.search(part)
            if not one:
                between.append(part)
                continue
            if before is not None and between == [" "]:
                key = before[-2:] + part[:2]
                got = " " if key in self.spaced else self._between(before, between, part)
                if got == " " and len(self.spaced) < CACHE:
                    self.spaced.add(key)
            else:
                got = self._between(before, between, part)
            out += (got, part)
            before, between = part, []
        return "".join([*out, self._between(before, between, None)])

    def _double(self, near: str, c: str, inner: bool) -> str:
        """Two equal letters or one, where single letters (or the token's ends) stand on both sides: after the next letter both readings are in one
        state, so the lattice parts here from what comes later. near: the two and their neighbours."""
        key = near, c, inner
        if key not in self.pairs:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            b, x = _CODE.get(near[0], 1) if inner else 0, _CODE.get(c, 1)
            rest = near[2 + inner :]
            d = _CODE.get(rest[0], 1) if rest else 0
            at = lambda i, j, k: self.cost[(i * K + j) * K + k]
            self.pairs[key] = c if SHORTEN + 2.0 + at(b, x, d) < at(b, x, x) + at(x, x, d) else c + c
        return self.pairs[key]

    def _between(self, before: str | None, parts: list[str], after: str | None) -> str:
        """parts: tokens and gaps by turns."""
        if not parts:
            return ""
        key = (before and before[-2:], *parts, after and after[:2])
        if key not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            steps, whole = [], [before, *parts, after]
            for i, part in enumerate(parts, 1):
                if (i % 2 == 0) == (before is None):
                    steps.append(self._gap(part, len(whole[i - 1]) == 1 and len(whole[i + 1]) == 1))
                    continue
                runs = [(m[1], len(m[0])) for m in _RUNS.finditer(part)]
                for j, (c, n) in enumerate(runs):
                    first, last = j == 0, j == len(runs) - 1
                    outer = (first and whole[i - 1] is None) or (last and whole[i + 1] is None)
                    steps.append(self._coded(c, n, outer or (len(part) > 1 and (first or last))))
            ab = 0 if before is None else _CODE.get(before[-2], 1) * K + _CODE.get(before[-1], 1)
            if after is None:
                self.seen[key] = self.best(steps, ab)
            else:
                self.seen[key] = self.best([*steps, *(self._coded(c, 1, False) for c in after[:2])], ab, False)[:-2]
        return self.seen[key]

    def _coded(self, c: str, n: int, edge: bool) -> list[tuple[str, list[int], float]]:
        key = (c, n, edge)
        if key not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[key] = [(text, [0 if x == " " else _CODE.get(x, 1) for x in text], channel) for text, channel in self.options(c, n, edge)]
        return self.seen[key]

    def _gap(self, gap: str, letters: bool) -> list[tuple[str, list[int], float]]:
        """A word end or nothing; between single letters it is more likely nothing."""
        key = (gap, letters)
        if key not in self.seen:
            stars = [(x, [_CODE[x]], HIDDEN) for x in VOWELS] if gap.strip("*") == "" else []
            self.seen[key] = [(" ", [0], JOIN if letters else 0.0), ("", [], 0.0 if letters else JOIN), *stars]
        return self.seen[key]

    def best(self, steps: list, ab: int = 0, ends: bool = True) -> str:
        """The cheapest path from the state ab, to a word end or to any state."""
        states: dict[int, tuple[float, str]] = {ab: (0.0, "")}
        cost = self.cost
        for options in steps:
            new: dict[int, tuple[float, str]] = {}
            for text, codes, channel in options:
                for ab, (s, path) in states.items():
                    s += channel
                    for k in codes:
                        s += cost[ab * K + k]
                        ab = ab % K * K + k
                    if ab not in new or s < new[ab][0]:
                        new[ab] = (s, path + text)
            states = new
        return min((s + (cost[ab * K] if ends else 0.0), path) for ab, (s, path) in states.items())[1]


def words_of(token: str, decode: Decoder) -> list[str]:
    """The restored words of a lower-case token, and the words in it that no sign or digit interrupts, as they are."""
    bare = token.strip(_EDGE)
    if _PLAIN.fullmatch(bare) and not _DOUBLE.search(bare) and "$" not in token:
        return [bare]
    if not _PLAIN.search(token):
        return [] if not any(c in LEET for c in bare) or bare.isdigit() else decode(bare).split()
    return list(dict.fromkeys([*decode(bare or token).split(), *filter(_PLAIN.fullmatch, _PARTS.findall(token))]))


class Cache:
    """A dict of at most two times `most` entries: what was not asked for since the last change goes."""

    def __init__(self, make, most: int):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def __call__(self, key: str):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got


class Reader:
    """Texts to restored words."""

    def __init__(self, cost: np.ndarray):
        self.decode = Decoder(cost)
        self.span, self.token = Cache(self.decode.span, SPANS), Cache(lambda t: words_of(t, self.decode), CACHE)

    def tokens(self, text: str | None) -> list[str]:
        """Of the lower-case text, with each row of short tokens replaced by its reading."""
        low = (text or "").lower()
        return (_SPAN if "_" in low else _SPAN_FAST).sub(lambda m: self.span(m[0]), low).split()

    def words(self, text: str | None) -> set[str]:
        return {w for t in set(self.tokens(text)) for w in self.token(t)}

    def restored(self, text: str | None) -> str:
        return " ".join(" ".join(self.token(t)) for t in self.tokens(text))


def prefixes(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


# --- evidence and scores ------------------------------------------------------------------------------------------


def _read(cost: np.ndarray):
    """y, part and restored words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cost)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([sorted(reader.words(t.as_py())) for t in part.column(0)], pa.list_(pa.string()))], ["y", "part", "words"])

    return run


def _counts(strong: dict[str, float] | None):
    """Rows by whole word, or, given the strong words, by prefix of all others. Input: y, part, words."""
    cut_up = (lambda w: [w]) if strong is None else (lambda w: [] if w in strong else prefixes(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for y, part, words in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen.update((f, y, part) for f in {f for w in words for f in cut_up(w)})
        rows = [(*k, n) for k, n in seen.items()]
        cols = list(zip(*rows)) or [()] * 4
        for i in range(0, max(1, len(rows)), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["f", "y", "part", "n"])

    return run


def evidence(counts: DataFrame, parts: list[int], sizes: dict[tuple[int, int], int], prior: float, least: int, floor: float) -> dict[str, float]:
    """Log-odds above the prior, over `floor`, of what was seen in `least` toxic rows or more; the MAX_FEATURES largest at most."""
    rows = counts.where(F.col("part").isin(parts)).groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    # rows of either class weigh as they occur in the whole table; toxic rows count as one
    n1, n0 = (max(1, sum(sizes.get((y, p), 0) for p in parts)) for y in (1, 0))
    t, c = F.col("t"), (F.col("n") - F.col("t")) * ((1 - prior) / n0 * n1 / prior)
    p = (t + PRIOR * prior) / (t + c + PRIOR)
    rows = rows.where(t >= least).select("f", (F.log(p / (1 - p)) - math.log(prior / (1 - prior))).alias("s"))
    return {f: s for f, s in rows.where(F.col("s") > floor).orderBy(F.desc("s"), "f").limit(MAX_FEATURES).collect()}


def learned(rows: DataFrame, parts: list[int], sizes: dict, prior: float) -> tuple[dict[str, float], dict[str, float]]:
    """Evidence of whole words and of prefixes, from rows (y, part, words) of some parts."""
    kind = "f string, y int, part int, n long"
    rows = rows.where(F.col("part").isin(parts)).select("y", "part", "words")
    whole = evidence(rows.mapInArrow(_counts(None), kind), parts, sizes, prior, MIN_ROWS, STRONG)
    return whole, evidence(rows.mapInArrow(_counts(whole), kind), parts, sizes, prior, 2 * MIN_ROWS, 0.5)


class Evidence:
    """Of words, by the weights of learned(). Tokens and readings whose words have none are remembered, so that most texts need no look at each word."""

    def __init__(self, weights: tuple[dict[str, float], dict[str, float]], cost: np.ndarray | None = None):
        self.whole, self.start = weights
        self.heads = {f[: PREFIXES[0]] for f in self.start}
        self.reader = None if cost is None else Reader(cost)
        self.new, self.old, self.found = set(), set(), {}

    def of(self, w: str) -> float:
        return self.whole.get(w) or (max((self.start.get(f, 0.0) for f in prefixes(w)), default=0.0) if w[: PREFIXES[0]] in self.heads else 0.0)

    def words(self, words) -> list[float]:
        """The three largest, zeros where there are fewer."""
        best = nlargest(3, (s for w in words if (s := self.of(w)) > 0))
        return best + [0.0] * (3 - len(best))

    def text(self, text: str | None) -> list[float]:
        tokens = set(self.reader.tokens(text))
        tokens.difference_update(self.new)
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, set()
        kept = tokens & self.old
        self.new |= kept
        tokens -= kept
        hits: set[str] = set()
        for t in tokens:
            got = self.found.get(t)
            if got is None:
                got = [w for w in words_of(t, self.reader.decode) if self.of(w) > 0]
                if not got:
                    self.new.add(t)
                    continue
                if len(self.found) >= CACHE:
                    self.found.clear()
                self.found[t] = got
            hits.update(got)
        return self.words(hits)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    beta, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (w * (p - y)) + pen * beta)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
    """(language model, evidence, logistic weights), or None without labelled rows of both classes."""
    ids = labelled_ids(labels, label, MOD, REMAINDER, per_class)
    rows = cut(labelled_texts(docs, ids).select("text", "y", fold("doc_id", MOD).cast("int").alias("part")))
    sizes = {(r["y"], r["part"]): r["n"] for r in rows.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in sizes}) < 2:
        return None
    known = labels.where(F.col("doc_id").isNotNull() & (fold("doc_id", MOD) != REMAINDER))
    prior = float(known.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0])
    cost = char_model(docs)
    rows = cut(rows.mapInArrow(lean(_read(cost)), "y int, part int, words array<string>"))
    parts = sorted({p for _, p in sizes})
    last = parts[-1]
    first = learned(rows, [p for p in parts if p != last] or parts, sizes, prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Evidence(first)
        for b in batches:
            x = np.array([found.words(w) for w in b.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["y", "a", "b", "c"])

    got = rows.where(F.col("part") == last).select("y", "words").mapInArrow(score, "y int, a double, b double, c double").collect()
    y, x = np.array([r[0] for r in got], float), np.array([r[1:] for r in got], float).reshape(len(got), 3)
    n1 = max(1.0, y.sum())
    weight = np.where(y == 1, prior / n1, (1 - prior) / max(1.0, len(y) - n1)) * len(y)
    return cost, learned(rows, parts, sizes, prior), logistic(x, y, weight)


def _scorer(model):
    """A function of a column of texts."""
    cost, weights, beta = model
    found = Evidence(weights, cost)

    def run(column: pa.Array) -> np.ndarray:
        x = np.array([found.text(t.as_py()) for t in column]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ beta[:3] + beta[3], -30, 30)))

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, in all their columns, that score below the threshold."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(held.value)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(b.schema.get_field_index("text"))) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", MOD, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
