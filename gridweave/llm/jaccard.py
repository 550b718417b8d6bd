"""Near-duplicates by shingles: texts whose sets of n-word shingles have a Jaccard similarity of `least` or more, joined exactly.

SimHash first: fingerprints of the same shingles are linked within RADIUS bits through sharded BK-trees (simhash.py), and the links are verified by the sets.
No radius covers the similarity, so an exact search follows, for what the fingerprints have not joined:

Prefix filter: in any one order of all shingles, two sets of that similarity share one of the first |s| - ceil(least |s|) + 1 shingles
of each. The order puts shingles that are common in a bounded sample of texts last, so that a common passage seldom brings texts together;
it affects the cost alone. Pairs that share such a shingle, whose sizes and places allow the similarity, and whose bitmaps do, are verified by their sets.
A bitmap has the parities of the numbers of shingles in BITS buckets: each bit in which two differ is a shingle that only one of the sets has.
BITS buckets tell nothing of long texts, so pairs of these are compared by bitmaps of two to four bits a shingle before their sets are brought together,
which are some twenty times as large. Pairs are brought together in slices of a bounded size, so that the disk they take does not grow with their number.

A large group of near copies is not compared pair by pair: first each shingle's texts are compared with one of them, drawn by one of DRAWS orders,
and in further rounds with another, where the links found so far have not joined the two;
then only such pairs are compared as the links found so far have not joined. Links within a component could add nothing, so components are those of all pairs.

Defined cases: shingles are 64-bit XXH64 values (seed 42); a text of fewer words is one shingle; null and empty texts are copies of each other;
texts of equal sets are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import among, chance, cut, lean, tidy
from .components import components

WORDS, LEAST, SAMPLE, COMMON, CHUNK, BLOCK, DRAWS, ROUNDS, MOST_BROADCAST = 5, 0.8, 20_000, 100_000, 1_000_000, 2_000, 4, 4, 200_000
RADIUS, BITS, SLICE = 6, 512, 50_000
_ROW = "tok long, rid long, n int, i int"


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes, as signed longs."""
    return np.unique(simhash.digests(text, n).view(np.int64))


def bitmap(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parities of the numbers of hashes in so many buckets, as bits / 64 longs."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(s: np.ndarray) -> np.ndarray | None:
    """A bitmap of two to four bits a hash, a power of two; None where BITS are as many."""
    return bitmap(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > BITS else None


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """The bits in which two bitmaps differ. The larger one is folded: buckets that become one have the parity of their sum."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum(dtype=np.int64))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                sets = [shingles(x.as_py(), n) for x in part.column(1)]
                at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["rid", "s"])

    return run


def _prefixes(held, n: int, least: float):
    """rid, a hash of the set, its size, its prefix, its bitmaps and the text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, often = held.value
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                made, sizes, keys, maps, wides, fps = [], [], [], [], [], []
                for x in part.column(1):
                    h = simhash.digests(x.as_py(), n)
                    s = np.unique(h.view(np.int64))
                    maps.append(bitmap(s))
                    wides.append(wide(s))
                    fps.append(simhash.majority(h))
                    keys.append([xxhash.xxh64_intdigest(s.tobytes(), k) for k in (1, 2)])
                    sizes.append(len(s))
                    if len(s):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        seen = np.where(common[at] == s, often[at], 0)
                        if seen.any():
                            s = s[np.argsort(seen, kind="stable")]
                        s = s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]
                    made.append(s)
                keys = np.array(keys, np.uint64).view(np.int64).reshape(-1, 2)
                at = np.r_[0, np.cumsum([len(s) for s in made])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(np.array(sizes, np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(made))), pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(maps))), pa.array(wides, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))], ["rid", "ka", "kb", "n", "p", "bits", "wide", "fp"])

    return run


def _by_group(f):
    """f(columns) on whole groups of the first column, which is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            held.append([c.flatten().to_numpy().reshape(len(c), BITS // 64) if pa.types.is_list(c.type) else c.to_numpy() for c in b.columns])
            if sum(len(x[0]) for x in held) >= CHUNK:
                cols = [np.concatenate(x) for x in zip(*held)]
                at = int(np.searchsorted(cols[0], cols[0][-1]))
                if at:
                    yield from f([c[:at] for c in cols])
                held = [[c[at:] for c in cols]]
        if held:
            yield from f([np.concatenate(x) for x in zip(*held)])

    return run


def _possible(nx, ix, ny, iy, least: float):
    """Whether sets of these sizes can be as similar, if the shingle at these places is the first that they share."""
    return 1 + np.minimum(nx - ix, ny - iy) - 1 >= least / (1 + least) * (nx + ny) - 1e-6


def _shared(least: float):
    """The rows of shingles that two sets or more have in their prefixes, where sizes and places allow the similarity with one of the others."""

    def f(cols: list) -> Iterator[pa.RecordBatch]:
        tok, _, n, i = cols
        edges = np.r_[np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]), len(tok)] if len(tok) else np.zeros(1, np.int64)
        start, many = edges[:-1], np.diff(edges)
        keep = np.zeros(len(tok), bool)
        two = start[many == 2]
        two = two[_possible(n[two], i[two], n[two + 1], i[two + 1], least)]
        keep[two] = keep[two + 1] = True
        for s, m in zip(start[many > 2].tolist(), many[many > 2].tolist()):
            for x in range(s, s + m, BLOCK):
                for y in range(x, s + m, BLOCK):
                    p, q = slice(x, min(x + BLOCK, s + m)), slice(y, min(y + BLOCK, s + m))
                    ok = _possible(n[p, None], i[p, None], n[None, q], i[None, q], least)
                    if x == y:
                        np.fill_diagonal(ok, False)
                    keep[p] |= ok.any(axis=1)
                    keep[q] |= ok.any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["tok", "rid", "n", "i"])

    return f


def _near(nx, bx, ny, by, least: float):
    """Whether sets of these sizes and bitmaps can be as similar."""
    return np.bitwise_count((bx ^ by).view(np.uint64)).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * (nx + ny) + 1e-6


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _drawn(least: float, salt: int):
    """Pairs of one member of each group with the others: the first in one of DRAWS orders of all texts, by the shingle, so that the shingles of one large family name few texts, not one each."""

    def f(cols: list) -> Iterator[pa.RecordBatch]:
        tok, rid, n, i, bits, label = cols
        if not len(tok):
            return
        h = (rid.view(np.uint64) ^ ((tok.view(np.uint64) % np.uint64(DRAWS) + np.uint64(DRAWS * salt)) << np.uint64(54))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        order = np.lexsort((rid, h * np.uint64(0xBF58476D1CE4E5B9), tok))
        tok, rid, n, i, bits, label = (c[order] for c in (tok, rid, n, i, bits, label))
        new = np.r_[True, tok[1:] != tok[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        ok = np.flatnonzero(~new & (label != label[lead]) & _possible(n, i, n[lead], i[lead], least))
        lead = lead[ok]
        near = _near(n[ok], bits[ok], n[lead], bits[lead], least)
        yield _pairs(rid[ok][near], rid[lead][near])

    return _by_group(f)


def _rest(least: float):
    """Pairs of each group that have not been joined yet. Columns: tok, rid, n, i, bits, label."""

    def f(cols: list) -> Iterator[pa.RecordBatch]:
        tok = cols[0]
        edges = np.r_[np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]), len(tok)]
        out, many = [], 0
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s < 3:  # compared already
                continue
            _, rid, n, i, bits, label = (c[s:e] for c in cols)
            if (label == label[0]).all():
                continue
            for x in range(0, e - s, BLOCK):
                for y in range(x, e - s, BLOCK):
                    p, q = slice(x, x + BLOCK), slice(y, y + BLOCK)
                    ok = (label[p, None] != label[None, q]) & _possible(n[p, None], i[p, None], n[None, q], i[None, q], least)
                    ok = np.triu(ok, 1) if x == y else ok
                    u, v = np.nonzero(ok)
                    near = np.concatenate([np.empty(0, bool), *(_near(n[p][u[k]], bits[p][u[k]], n[q][v[k]], bits[q][v[k]], least) for k in (slice(a, a + CHUNK // 8) for a in range(0, len(u), CHUNK // 8)))])
                    u, v = u[near], v[near]
                    if u.size:
                        out.append((rid[p][u], rid[q][v]))
                        many += u.size
                    if many > CHUNK:
                        yield _pairs(*(np.concatenate(c) for c in zip(*out)))
                        out, many = [], 0
        if out:
            yield _pairs(*(np.concatenate(c) for c in zip(*out)))

    return _by_group(f)


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = []
            for k in range(b.num_rows):
                p, q = x[k].values.to_numpy(), y[k].values.to_numpy()
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= least * (len(p) + len(q) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(least: float):
    """Pairs whose wide bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            x, y = b.column(4), b.column(5)
            keep = [differing(x[k].values.to_numpy(), y[k].values.to_numpy()) <= (1 - least) / (1 + least) * int(n[k]) + 1e-6 for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sliced(pairs: DataFrame, most: int, f) -> DataFrame:
    """f of the pairs (checkpointed), of about `most` at a time; what one slice has shuffled leaves the disk before the next."""
    k = -(-pairs.count() // most)
    if k < 2:
        return f(pairs)
    out = None
    for i in range(k):
        made = f(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(k)) == i))
        out = made if out is None else out.unionByName(made)
        tidy(pairs.sparkSession)
    return cut(out)


def _likely_pairs(pairs: DataFrame, wides: DataFrame, most: int, least: float) -> DataFrame:
    """Those of the pairs whose wide bitmaps (rid, n, wide; of long texts) allow the similarity, and those that have none."""
    ends = [wides.select(F.col("rid").alias(e), F.col("n").alias(f"n{e}"), F.col("wide").alias(f"w{e}")) for e in ("a", "b")]

    def likely(part: DataFrame) -> DataFrame:
        part = part.join(ends[0], "a", "left").join(ends[1], "b", "left")
        both = F.col("wa").isNotNull() & F.col("wb").isNotNull()
        long = part.where(both).select("a", "b", "na", "nb", "wa", "wb").mapInArrow(lean(_likely(least)), "a long, b long")
        return cut(long.unionByName(part.where(~both).select("a", "b")))

    return _sliced(pairs, most, likely)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _verified(pairs: DataFrame, docs: DataFrame, most: int, n: int, least: float) -> DataFrame:
    """Those of the pairs that are similar, about `most` at a time. Only their texts are cut into shingles again, so that no table holds all sets."""

    def verified(part: DataFrame) -> DataFrame:
        ids = cut(part.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
        sets = cut(among(docs, "rid", ids, MOST_BROADCAST).select("rid", "text").mapInArrow(lean(_sets(n)), "rid long, s array<long>"))
        rows = part.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
        return cut(rows.select("a", "b", "sa", "sb").mapInArrow(lean(_alike(least)), "a long, b long"))

    return _sliced(pairs, most, verified)


def _labels(edges: DataFrame) -> DataFrame:
    """(rid, root) of the components of edges; a bounded number of edges is joined by the driver, without rounds of shuffles."""
    if edges.count() > MOST_BROADCAST:
        return cut(components(edges).select(F.col("node").alias("rid"), "root"))
    t = edges.toArrow()
    node, at = np.unique(np.concatenate([t[c].to_numpy() for c in ("a", "b")]), return_inverse=True)
    label = np.arange(len(node))
    simhash._join(label, at[: t.num_rows], at[t.num_rows :])
    while not np.array_equal(label[label], label):
        label = label[label]
    return edges.sparkSession.createDataFrame(pa.table({"rid": pa.array(node, pa.int64()), "root": pa.array(node[label], pa.int64())}), "rid long, root long")


def _by_fingerprint(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows (rid, fp) with equal fingerprints, or with such that a BK-tree finds within the radius: one for each row at most, in each shard."""
    least = cut(rows.groupBy("fp").agg(F.min("rid").alias("lead"), F.count("*").alias("many")))
    equal = rows.join(_small(least.where("many > 1").select("fp", "lead")), "fp").where("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    links = cut(simhash.links(least.select("fp"), radius, direct=True).distinct())
    for end in ("a", "b"):
        links = links.join(least.select(F.col("fp").alias(end), F.col("lead").alias(f"r{end}")), end)
    near = links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return cut(near.unionByName(equal).distinct())


def near_duplicates(docs: DataFrame, n: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """rid, c: the least row of its component, for each row of docs (rid, text) with another in its component. docs is read more than once."""
    spark = docs.sparkSession
    docs = docs.select(F.col("rid").cast("long").alias("rid"), "text")
    size = docs.count()
    # slices grow with docs, so that their number, and the reading of docs for each, grows with the pairs a text has
    few_maps, few_sets = max(20 * SLICE, size), max(SLICE, size // 16)
    sample = docs.where(chance(F.col("rid"), 23) < min(1.0, SAMPLE / max(1, size))).mapInArrow(lean(_sets(n)), "rid long, s array<long>").select(F.explode("s").alias("t"))
    common = sorted((r["t"], r["n"]) for r in sample.groupBy("t").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "t").limit(COMMON).collect())
    held = spark.sparkContext.broadcast((np.array([t for t, _ in common] or [0], np.int64), np.array([k for _, k in common] or [0], np.int64)))
    rows = cut(docs.mapInArrow(lean(_prefixes(held, n, least)), "rid long, ka long, kb long, n int, p array<long>, bits array<long>, wide array<long>, fp long"))
    keys = rows.select("rid", "ka", "kb")
    # cut, so that the join has a shuffle of its own (if any), whose hot partitions can be split
    copies = keys.join(_small(cut(keys.groupBy("ka", "kb").agg(F.min("rid").alias("rep"), F.count("*").alias("many")).where("many > 1").drop("many"))), ["ka", "kb"])
    copies = cut(copies.where("rid <> rep").select("rid", "rep"))
    single = among(rows.where("n > 0"), "rid", copies, MOST_BROADCAST, those=False)
    past = _by_fingerprint(single.select("rid", "fp"), radius)
    edges = _verified(past, docs, few_sets, n, least)
    labels = _labels(edges)
    tidy(spark)
    shared = single.select("rid", "n", F.posexplode("p").alias("i", "tok")).select("tok", "rid", "n", "i").repartition("tok").sortWithinPartitions("tok", "rid")
    shared = cut(shared.mapInArrow(lean(_by_group(_shared(least))), _ROW))  # partitions still hold whole, sorted groups
    tidy(spark)
    both = among(rows, "rid", cut(shared.select("rid").distinct()), MOST_BROADCAST)
    bits, wides = cut(both.select("rid", "bits")), cut(both.where("wide is not null").select("rid", "n", "wide"))
    del rows, keys, single, both
    tidy(spark)

    def with_rows(t: DataFrame, more: DataFrame, most: int) -> DataFrame:
        few = more.count() <= most
        t = t.join(F.broadcast(more) if few else more, "rid", "left")
        # a join with few rows leaves partitions and their order as they are
        return t if few else t.repartition("tok").sortWithinPartitions("tok", "rid")

    shared = cut(with_rows(shared, bits, MOST_BROADCAST // 4))
    del bits

    def labelled() -> DataFrame:
        return with_rows(shared, labels, MOST_BROADCAST).select("tok", "rid", "n", "i", "bits", F.coalesce("root", "rid").alias("label"))

    for salt in range(ROUNDS):
        pairs = labelled().mapInArrow(lean(_drawn(least, salt)), "a long, b long").distinct()
        pairs = cut(pairs.join(past, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        past = cut(past.unionByName(pairs))
        edges = cut(edges.unionByName(_verified(_likely_pairs(pairs, wides, few_maps, least), docs, few_sets, n, least)))
        labels = _labels(edges)
        tidy(spark)
    rest = cut(labelled().mapInArrow(lean(_rest(least)), "a long, b long").distinct().join(past, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = _labels(cut(edges.unionByName(_verified(_likely_pairs(rest, wides, few_maps, least), docs, few_sets, n, least))))
    # the least row of equal sets stands for them
    named = labels.select("rid", F.col("root").alias("c"))
    few = F.broadcast(labels) if labels.count() <= MOST_BROADCAST else labels
    each = copies.select("rid", "rep").unionByName(copies.select(F.col("rep").alias("rid"), "rep").distinct())
    each = each.join(few.select(F.col("rid").alias("rep"), "root"), "rep", "left").select("rid", F.coalesce("root", "rep").alias("c"))
    return cut(named.unionByName(each).distinct())
