"""Language-model scores: a log-bilinear neural model over word symbols, with counted words inside the rarest ones.

Symbols: the FREQUENT most frequent training tokens, the end token, and TAILS classes of all other words by their last bytes, so every
token has a symbol that the neural model predicts. The log-bilinear model sums the vectors of the last CONTEXT symbols, times one diagonal matrix for each place, to a
predicted vector. Its products with the vectors of groups of MEMBERS symbols, plus biases, give the group; those with the vectors of the
group's symbols, plus biases, give the symbol. Scoring takes the softmax over the groups and over the members of the token's group by batched matrix
products, so probabilities are normalised at the cost of about the square root of the symbols. Symbols with like neighbours share a
group (recursive bisection of their neighbours' counts in the warm sample).

Both levels, biases included, are trained by noise-contrastive estimation (noise: the groups' frequencies, and the symbols' within a group): a warm start on a
sample of documents, drawn by id, of about WARM_TOKENS tokens, then one pass over all training documents, each partition for itself; the
partitions' parameters are averaged by their number of tokens.

A word of a tail class costs its class and then its share of that class by absolute discounting: (c - d) / C for a word with
c > 0 of the class's C training occurrences; a class's words never seen in training are one type, with the mass taken off.

Texts are read twice: once to count words, once to turn them into symbols and hashes of rare words, which training and scoring share.
Counts of words are joined by a 64-bit XXH64 of the word (two of a billion words share one with a chance of 3 %).

Defined cases: a null or empty text is the end token alone; a null id is scored and, being out of the held-out fold, learned from; repeated rows repeat; a text of any length is
scored in blocks; without any training document the base is log10(1 / 1) a token and the model is uniform over its symbols; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chance, cut, held_out, lean, table

MOD, REMAINDER = 7, 2
FREQUENT, TAILS, ENDING, MEMBERS, DIM, CONTEXT = 7168, 1023, 3, 128, 32, 6
NOISE_GROUPS, NOISE_WORDS, RATE, BLOCK, WARM_TOKENS, WARM_EPOCHS, GROUPS, INNER = 16, 24, 0.1, 8192, 400_000, 5, 16, 2048
END = 0  # symbols 1 to TAILS: the tail classes


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts in one row (runs of anything but ASCII white space, A-Z in lower case), and for each the row that it is in."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, rows = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), rows[real.to_numpy(zero_copy_only=False)]


def _slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` bytes of a column (or one row)."""
    if b.num_rows:
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy() + 64) // most
        edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, b.num_rows].tolist()
        for at, end in zip(edges[:-1], edges[1:]):
            yield b.slice(at, end - at)


# --- counts -------------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _slices(b, "text", 1 << 26):
            got = pc.value_counts(words(part.column(0))[0])
            for i in range(0, len(got), 50_000):
                values, n = got.slice(i, 50_000).flatten()
                yield pa.RecordBatch.from_arrays([values.cast(pa.binary()), n], ["w", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(w binary, c): counts of all words of all rows of docs; pre-counted in each task."""
    return docs.select("text").mapInArrow(lean(_word_counts), "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


def tail_of(w: bytes) -> int:
    return 1 + crc32(w[-ENDING:]) % TAILS


# --- symbols ------------------------------------------------------------------------------------------------------


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, ids binary, base double, known long, h array<long>, tf array<int>, k array<short>"


def _encoded(held):
    """For each document: its words' symbols (16 bits each), the base score and number of its frequent words and the end, and its other distinct words' hashes, occurrences and classes."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, base, end = held.value  # frequent: words, from symbol TAILS + 1 on; base: of each symbol, 0 for the tail classes
        frequent, at = pa.array(frequent, pa.binary()).cast(pa.string()), TaskContext.get().partitionId() << 40
        for b in batches:
            for part in _slices(b, "text", 1 << 23):
                flat, rows = words(part.column(2))
                n = np.bincount(rows, minlength=part.num_rows)
                found = pc.index_in(flat, value_set=frequent)
                rare = pc.is_null(found).to_numpy(zero_copy_only=False)
                x = pc.fill_null(found, 0).to_numpy() + (TAILS + 1)
                coded = flat.filter(pa.array(rare)).dictionary_encode()
                distinct = coded.dictionary.cast(pa.binary()).to_pylist()
                hashes = np.fromiter((xxh64_intdigest(w, 42) for w in distinct), np.uint64, len(distinct)).view(np.int64)
                tails = np.fromiter(map(tail_of, distinct), np.int16, len(distinct))
                code = coded.indices.to_numpy().astype(np.int64)
                x[rare] = tails[code]
                x = x.astype("<i2")
                pairs, tf = np.unique(rows[rare] * max(1, len(distinct)) + code, return_counts=True)
                of, code = np.divmod(pairs, max(1, len(distinct)))
                offsets = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32))
                ends = pa.array(np.r_[0, np.cumsum(2 * n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + part.num_rows)), part.column(0), part.column(1), pa.array(n + 1), pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(x)]),
                        pa.array(np.bincount(rows, base[x], part.num_rows) + base[END]), pa.array(n - np.bincount(rows, rare, part.num_rows).astype(np.int64) + end),
                        *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (hashes[code], tf.astype(np.int32), tails[code])),
                    ],
                    [c.split()[0] for c in ENCODED.split(", ")],
                )
                at += part.num_rows

    return run


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts of an `ids` column in one row, CONTEXT ends before each text and one after it; and whether each place is to be predicted."""
    rows = [np.frombuffer(v, np.int16) for v in column.to_pylist()]
    n = sum(len(r) for r in rows) + len(rows) * (CONTEXT + 1)
    x, target, at = np.zeros(n, np.int16), np.ones(n, bool), 0
    for r in rows:
        target[at : at + CONTEXT] = False
        x[at + CONTEXT : at + CONTEXT + len(r)] = r
        at += len(r) + CONTEXT + 1
    return x, target


# --- the log-bilinear model ---------------------------------------------------------------------------------------


def grouped(x: np.ndarray, freq: np.ndarray, members: int = MEMBERS, features: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(perm, edges): the place of each symbol in the order of groups, and where each group begins. Symbols are halved, again and again, along the main direction of their neighbours' counts in x."""
    n = len(freq)
    edges, groups = [0], [np.arange(n)]
    if n > members:
        top = np.full(n, -1)
        best = np.argsort(-freq, kind="stable")[:features]
        top[best] = np.arange(len(best))
        table_ = np.zeros((n, 2 * features), np.float32)
        for here, there, shift in ((x[1:], x[:-1], 0), (x[:-1], x[1:], features)):
            f = top[there]
            ok = f >= 0
            table_ += np.bincount(here[ok].astype(np.int64) * 2 * features + f[ok] + shift, minlength=n * 2 * features).reshape(n, -1)
        table_ = np.sqrt(table_ / (table_.sum(1, keepdims=True) + 2))
        while max(map(len, groups)) > members:
            halves = []
            for g in groups:
                a = table_[g] - table_[g].mean(0)
                v = np.ones(a.shape[1], np.float32) + np.arange(a.shape[1], dtype=np.float32) / a.shape[1]
                for _ in range(12):
                    v = a.T @ (a @ v)
                    v /= np.linalg.norm(v) + 1e-20
                order = g[np.argsort(a @ v, kind="stable")]
                halves += [order[: len(g) // 2], order[len(g) // 2 :]]
            groups = halves
    edges = np.r_[0, np.cumsum([len(g) for g in groups])]
    perm = np.empty(n, np.int64)
    perm[np.concatenate(groups)] = np.arange(n)
    return perm.astype(np.int16), edges


def start(freq: np.ndarray, edges: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small vectors, and the log-frequencies as biases: at first, the unigram model. freq: in the order of groups."""
    rng, n, g = np.random.default_rng(seed), len(freq), len(edges) - 1
    total = np.add.reduceat(freq, edges[:-1])
    within = freq / np.repeat(total, np.diff(edges))
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "R": small(n, DIM), "Q": small(n, DIM), "P": small(g, DIM), "C": np.full((CONTEXT, DIM), 1.0 / CONTEXT, np.float32),
        "b": np.log(within).astype(np.float32), "a": np.log(total / total.sum()).astype(np.float32),
    }


def _predicted(model: dict, x: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the symbols before the places i to j, and the vectors predicted there."""
    e, m = model["R"].take(x[i - CONTEXT : j - 1], axis=0), j - i
    pred, part = np.empty((m, DIM), np.float32), np.empty((min(m, INNER), DIM), np.float32)
    for s in range(0, m, INNER):
        t = min(m, s + INNER)
        own, more = pred[s:t], part[: t - s]
        np.multiply(e[s + CONTEXT - 1 : t + CONTEXT - 1], model["C"][0], out=own)
        for k in range(1, CONTEXT):
            np.multiply(e[s + CONTEXT - 1 - k : t + CONTEXT - 1 - k], model["C"][k], out=more)
            own += more
    return e, pred


def _with_ones(pred: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows in this order, with a last column of ones (for biases)."""
    out = np.empty((len(pred), DIM + 1), np.float32)
    out[:, :DIM] = pred.take(order, axis=0)
    out[:, DIM] = 1
    return out


def _sums(order: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows; order sorts the keys."""
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first].astype(np.int64), np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    np.clip(s, -30, 30, out=s)
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


def nce(model: dict, x: np.ndarray, target: np.ndarray, freq: np.ndarray, edges: np.ndarray, rng, past: dict | None = None) -> dict:
    """One pass over the places of x, in place, by AdaGrad. freq: of symbols, in the order of groups. The noise drawn for a block serves all its
    tokens (of groups) and all tokens of a group (of symbols). past: squared gradients so far, which are returned."""
    past = past or {k: np.full_like(v, 1e-2) for k, v in model.items()}
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(np.int16)
    total = np.add.reduceat(freq, edges[:-1])
    cum, gcum = np.cumsum(freq), np.cumsum(total)
    logg = np.log(total * NOISE_GROUPS).astype(np.float32)
    logw = (np.log(freq / np.repeat(total, np.diff(edges))) + np.log(NOISE_WORDS)).astype(np.float32)
    low = cum - freq

    def step(vectors: str, biases: str | None, rows, grad: np.ndarray, rate: float = RATE) -> None:
        """grad: of vectors, and in a last column of biases."""
        for name, g, r in ((vectors, grad[:, :DIM], rate), (biases, grad[:, DIM] if biases else None, 0.3 * rate)):
            if name:
                p = past[name].take(rows, axis=0)
                p += g * g
                past[name][rows] = p
                np.sqrt(p, out=p)
                np.divide(g, p, out=p)
                p *= np.float32(r)
                model[name][rows] += p

    every = np.arange(len(total)), np.arange(CONTEXT)
    for i in range(CONTEXT, len(x), BLOCK):
        j = min(len(x), i + BLOCK)
        e, pred = _predicted(model, x, i, j)
        order = np.argsort(x[i:j], kind="stable")  # 16 bits are sorted by radix
        w, real, pred = x[i:j][order], target[i:j][order].astype(np.float32), _with_ones(pred, order)
        g = group.take(w)
        begin, first = (np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) for k in (g, w))
        ends, here, rows = np.r_[begin[1:], len(g)], g[begin], w[first].astype(np.int64)
        # groups
        pg, many = np.c_[model["P"], model["a"] - logg][:, : DIM + 1], ends - begin
        drawn = np.minimum(np.searchsorted(gcum, rng.random(NOISE_GROUPS) * gcum[-1]), len(total) - 1)
        data = np.repeat(pg[here], many, axis=0)
        up = real * (1 - _sigmoid(np.einsum("nd,nd->n", pred, data)))
        data *= up[:, None]
        down = _sigmoid(pred @ pg[drawn].T)
        down *= -real[:, None]
        dpred = down @ pg[drawn]
        dpred += data
        gp = np.zeros((len(total), DIM + 1), np.float32)
        np.add.at(gp, drawn, down.T @ pred)
        # symbols within their groups
        q = model["Q"].take(rows, axis=0)
        data = np.repeat(np.c_[q, model["b"][rows] - logw[rows]], np.diff(np.r_[first, len(w)]), axis=0)
        upw = real * (1 - _sigmoid(np.einsum("nd,nd->n", pred, data)))
        data *= upw[:, None]
        dpred += data
        np.multiply(pred, upw[:, None], out=data)
        rows, gq = [rows], [np.add.reduceat(data, first, axis=0)]
        for s, t, k, r in zip(begin.tolist(), ends.tolist(), here.tolist(), rng.random((len(here), NOISE_WORDS))):
            gp[k] += up[s:t] @ pred[s:t]
            lo, hi = edges[k], edges[k + 1]
            if hi - lo > 1:
                d = np.minimum(cum[lo:hi].searchsorted(low[lo] + r * total[k]), hi - lo - 1) + lo
                qn = np.empty((NOISE_WORDS, DIM + 1), np.float32)
                qn[:, :DIM], qn[:, DIM] = model["Q"][d], model["b"][d] - logw[d]
                down = _sigmoid(pred[s:t] @ qn.T)
                down *= -real[s:t, None]
                dpred[s:t] += down @ qn
                rows.append(d)
                gq.append(down.T @ pred[s:t])
        rows, gq = np.concatenate(rows), np.concatenate(gq)
        rows, gq = _sums(np.argsort(rows.astype(np.int16), kind="stable"), rows, gq)
        # context
        back = np.empty((j - i, DIM), np.float32)
        back[order] = dpred[:, :DIM]
        ge, gc, part, ones = np.zeros_like(e), np.zeros_like(model["C"]), np.empty((INNER, DIM), np.float32), np.ones(INNER, np.float32)
        for u in range(0, j - i, INNER):
            own = back[u : u + INNER]
            for k in range(CONTEXT):
                at = slice(u + CONTEXT - 1 - k, u + CONTEXT - 1 - k + len(own))
                ge[at] += np.multiply(own, model["C"][k], out=part[: len(own)])
                gc[k] += ones[: len(own)] @ np.multiply(own, e[at], out=part[: len(own)])
        before = x[i - CONTEXT : j - 1]
        step("R", None, *_sums(np.argsort(before, kind="stable"), before, ge))
        step("Q", "b", rows, gq)
        step("P", "a", every[0], gp)
        step("C", None, every[1], gc, 0.3 * RATE)
    return past


def _log_softmax(pred: np.ndarray, vectors: np.ndarray, own: np.ndarray, safe: bool) -> np.ndarray:
    """Of the own column of each row of scores; safe: none of them overflows."""
    s = pred @ vectors.T
    if not safe:
        s -= s.max(1, keepdims=True)
    got = s[np.arange(len(s)), own]
    np.exp(s, out=s)
    return got - np.log(s @ np.ones(s.shape[1], np.float32))


def log10_probabilities(model: dict, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Normalised, for the symbols of x from the place CONTEXT on; 0 for those before."""
    out = np.zeros(len(x))
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(np.int16)
    levels = [np.ascontiguousarray(np.c_[model[k], model[b]]) for k, b in (("P", "a"), ("Q", "b"))]
    longest = max(float((v * v).sum(1).max()) for v in levels) ** 0.5
    for i in range(CONTEXT, len(x), BLOCK):
        j = min(len(x), i + BLOCK)
        order = np.argsort(x[i:j], kind="stable")
        w, pred = x[i:j][order], _with_ones(_predicted(model, x, i, j)[1], order)
        safe = float(np.einsum("nd,nd->n", pred, pred).max()) ** 0.5 * longest < 60  # no sum of exponentials leaves the range of 32 bits
        g = group[w]
        got = _log_softmax(pred, levels[0], g, safe)
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for s, t in zip(begin.tolist(), np.r_[begin[1:], len(g)].tolist()):
            lo, hi = edges[g[s]], edges[g[s] + 1]
            if hi - lo > 1:
                got[s:t] += _log_softmax(pred[s:t], levels[1][lo:hi], w[s:t] - lo, safe)
        out[i + order] = got
    return out / np.log(10)


_PARTS = ("R", "Q", "P", "C", "b", "a")


def _pack(model: dict) -> np.ndarray:
    return np.concatenate([model[k].reshape(-1) for k in _PARTS])


def _unpack(raw: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in _PARTS:
        out[k] = raw[at : at + like[k].size].astype(np.float32).reshape(like[k].shape)
        at += like[k].size
    return out


def _local(held):
    """Each partition's own pass; its parameters, weighed by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, edges, freq, first, past = held.value
        model, past = {k: v.copy() for k, v in first.items()}, {k: v.copy() for k, v in past.items()}
        pid, n = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng(pid)
        for b in batches:
            for part in _slices(b, "ids", 128 * BLOCK):
                x, target = sequence(part.column("ids"))
                n += int(target.sum())
                nce(model, perm[x], target, freq, edges, rng, past)
        yield _weighed(pid % GROUPS, n, _pack(model).astype(np.float32) * np.float32(n / 1e6))

    return run


def _weighed(g: int, n: int, raw: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([n], pa.int64()), pa.array([raw.tobytes()], pa.binary())], ["g", "n", "raw"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the models of each group, one at a time."""
    sums: dict = {}
    for b in batches:
        for i in range(b.num_rows):
            g, n, raw = (c[i].as_py() for c in b.columns)
            old = sums.get(g, (0, 0.0))
            sums[g] = old[0] + n, old[1] + np.frombuffer(raw, np.float32).astype(np.float64)
    for g, (n, raw) in sums.items():
        yield _weighed(g, n, raw.astype(np.float32))


def train(encoded: DataFrame, freq: np.ndarray, tokens: int):
    """(perm, edges, parameters) from the training documents of an encoded table. freq: of symbols; tokens: N, the ends included."""
    learn = encoded.where("not held_out").select("rid", "doc_id", "ids")
    warm = learn.where(chance(F.coalesce("doc_id", "rid"), 11) < min(1.0, WARM_TOKENS / max(1, tokens))).select("rid", "ids").collect()
    x, target = sequence(pa.array([bytes(r["ids"]) for r in sorted(warm, key=lambda r: r["rid"])], pa.binary()))
    perm, edges = grouped(x, freq)
    freq = freq[np.argsort(perm)]
    model = start(freq, edges)
    if not tokens:
        return perm, edges, model
    rng, past = np.random.default_rng(1), None
    for _ in range(WARM_EPOCHS):
        past = nce(model, perm[x], target, freq, edges, rng, past)
    past = past or {k: np.full_like(v, 1e-2) for k, v in model.items()}
    held = encoded.sparkSession.sparkContext.broadcast((perm, edges, freq, model, past))
    kind = "g int, n long, raw binary"
    sums = learn.select("ids").mapInArrow(lean(_local(held)), kind).repartition(GROUPS, "g").mapInArrow(_summed, kind)
    r = sums.withColumn("g", F.lit(0)).repartition(1).mapInArrow(_summed, kind).first()  # GROUPS models at most
    return perm, edges, _unpack(np.frombuffer(r["raw"], np.float32) * np.float32(1e6 / r["n"]), model) if r and r["n"] else model


# --- scores -------------------------------------------------------------------------------------------------------


def _scored(held):
    """The sum of the symbols' log-probabilities, and of what each tail class takes off its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, edges, model = held.value
        for b in batches:
            for part in _slices(b, "ids", 128 * BLOCK):
                x, target = sequence(part.column("ids"))
                logs = np.where(target, log10_probabilities(model, perm[x], edges), 0.0)
                n = part.column("n_tokens").to_numpy() + CONTEXT
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _KEPT), pa.array(np.add.reduceat(logs, np.cumsum(n) - n))], [*_KEPT, "lbl"])

    return run


_KEPT = ["rid", "doc_id", "held_out", "n_tokens", "base", "known"]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", MOD, REMAINDER).alias("held_out"), "text")
    learn = rows.where("not held_out")
    counts = cut(word_counts(learn))
    n_docs = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + n_docs, total["v"] + (n_docs > 0)
    top = counts.orderBy(F.desc("c"), "w").limit(FREQUENT).collect()
    lowest = (top[-1]["c"], bytes(top[-1]["w"])) if top else (0, b"")
    other = counts.where((F.col("c") < lowest[0]) | ((F.col("c") == lowest[0]) & (F.col("w") > F.lit(bytearray(lowest[1])))))
    other = other.withColumn("k", (F.crc32(F.substring("w", -ENDING, ENDING)) % TAILS + 1).cast("short"))
    tails = {r["k"]: r for r in other.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
    n1, n2 = (sum(r[c] for r in tails.values()) for c in ("n1", "n2"))
    d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
    ids = {bytes(r["w"]): i for i, r in enumerate(top, TAILS + 1)}
    freq = np.ones(TAILS + 1 + len(top))
    freq[END] += n_docs
    for k, r in tails.items():
        freq[k] += r["n"]
    norm = float(np.log10(n + v + 1))
    base = np.zeros(len(freq))
    base[END] = np.log10(n_docs + 1) - norm
    for r in top:
        freq[ids[bytes(r["w"])]] += r["c"]
        base[ids[bytes(r["w"])]] = np.log10(r["c"] + 1) - norm
    freq /= freq.sum()
    encoded = cut(rows.mapInArrow(_encoded(spark.sparkContext.broadcast(([bytes(r["w"]) for r in top], base, int(n_docs > 0)))), ENCODED))
    model = train(encoded, freq, n)
    scored = cut(encoded.select(*_KEPT, "ids").mapInArrow(_scored(spark.sparkContext.broadcast(model)), "rid long, doc_id long, held_out boolean, n_tokens long, base double, known long, lbl double"))
    # of each tail class: its occurrences, and the mass of its words that training has not seen (all of an empty class)
    shares = F.broadcast(spark.createDataFrame([(k, float(tails[k]["n"]) if k in tails else 1.0, d * tails[k]["v"] / tails[k]["n"] if k in tails else 1.0) for k in range(1, TAILS + 1)], "k short, all double, unseen double"))
    each = encoded.select("rid", F.explode(F.arrays_zip("h", "tf", "k")).alias("x")).select("rid", "x.h", "x.tf", "x.k")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    sums = each.join(other.select(F.xxhash64("w").alias("h"), "c"), "h", "left").join(shares, "k").groupBy("rid").agg(
        F.sum(F.when(c > 0, tf).otherwise(0)).alias("more"), F.sum(tf * (F.log10(c + 1.0) - norm)).alias("b"), F.sum(tf * F.log10(F.when(c > 0, (c - d) / F.col("all")).otherwise(F.col("unseen")))).alias("word")
    )
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("lbl") + F.coalesce("word", F.lit(0.0))).alias("score"),
    )


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
