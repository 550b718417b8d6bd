"""SimHash near-duplicates: 64-bit fingerprints, linked within a radius through sharded BK-trees.

Fingerprints: see fingerprint(). Distinct fingerprints alone are compared, so exact copies cost nothing.

Sharding is exact, and the trees do the search. The 64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree on at least
one of them, so each fingerprint goes, for every block, to the shard that holds the same values in the block's first few bits: as many bits as
leave a shard about SHARD distinct fingerprints (no bit up to that number; where a whole block would not do, pairs of radius + 2 blocks, of which two agree). A
shard has one BK-tree: children are keyed by their integer Hamming distance to the parent, and a search follows
only the edges within the radius of the distance just measured. A task builds and searches the trees of all its
shards at once, as arrays. From a tree no pair list leaves, but one edge from each member to the
least member of its cluster. components() then joins the edges of all shards.

The trees are not broadcast to all executors: together they hold every fingerprint, which has no size bound. A tree stays with
the queries of its own shard, which are the only ones that it can answer.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; equal rows share a component; a
component whose ids are all null has a null id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, cut, fresh, numbered, table
from .components import components

RADIUS, SHINGLE, SHARD, QUERIES, CHUNK, MOST_BROADCAST = 3, 3, 512, 5_000, 1_000_000, 200_000


def digests(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 values (seed 42) of the n-word shingles, repeats included; a text of fewer words is one shingle, one of none has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    h = xxhash.xxh64_intdigest
    return np.array([h(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))] if words else [], np.uint64)


def majority(values: np.ndarray) -> int:
    """64 bits: each set if it is set in over half of the values."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(values)).tobytes(), "big")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The majority of the n-word shingles' values, bit by bit."""
    return majority(digests(text, n))


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(x.as_py(), n) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


def blocks(radius: int, n: int, shard: int = SHARD) -> list[int]:
    """Masks by which n distinct fingerprints are dealt, as signed longs: no bits, the first bits of radius + 1 blocks, or all pairs of radius + 2 blocks."""
    bits = math.ceil(math.log2(max(1.0, n / shard)))
    if not bits:
        return [0]
    whole = 64 // (radius + 1)
    if bits <= whole:
        masks = [((1 << bits) - 1) << (i * whole) for i in range(radius + 1)]
    else:
        edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
        masks = [a | b for a, b in combinations([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])], 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int, direct: bool = False) -> np.ndarray:
    """Index of the least linked member for each of fp (distinct within a shard); if direct, of the least within the radius. shard: sorted ids. The BK-trees
    of all shards are built level by level: the first of each group becomes a node, the rest part by their distance to it."""
    n, label = len(fp), np.arange(len(fp))
    if not n:
        return label
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    root = np.zeros(n, np.int64)
    first = np.r_[True, shard[1:] != shard[:-1]]
    root[:] = np.flatnonzero(first)[np.cumsum(first) - 1]
    pending, group = np.arange(n), root * 65
    key = None
    while pending.size:
        first = np.r_[True, group[1:] != group[:-1]]
        node = pending[first]
        if key is not None:
            parent[node], edge[node] = group[first] // 65, group[first] % 65
        rest, at = pending[~first], node[(np.cumsum(first) - 1)[~first]]
        key = at * 65 + np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        pending, group = rest[order], key[order]
    child = np.flatnonzero(parent >= 0)
    child = child[np.argsort(parent[child] * 65 + edge[child])]
    keys = parent[child] * 65 + edge[child]
    for start in range(0, n, QUERIES):
        q = np.arange(start, min(n, start + QUERIES))
        at = root[q]
        while q.size:
            d = np.bitwise_count(fp[q] ^ fp[at]).astype(np.int64)
            hit = (d <= radius) & (q != at)
            if direct:
                np.minimum.at(label, q[hit], at[hit])
            else:
                _join(label, q[hit], at[hit])
            lo = np.searchsorted(keys, at * 65 + np.maximum(d - radius, 1))
            hi = np.searchsorted(keys, at * 65 + np.minimum(d + radius, 64), side="right")
            many = np.maximum(hi - lo, 0)
            q, base = np.repeat(q, many), np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
            at = child[base + np.arange(len(q))]
    while not direct and (up := label[label]).tolist() != label.tolist():
        label = up
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; label points to a smaller index of the same set."""
    while a.size:
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def _edges(radius: int, direct: bool = False):
    def links(k: np.ndarray, m: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
        shard = np.cumsum(first)
        keep = np.bincount(shard)[shard] > 1
        fp, shard = fp[keep], shard[keep]
        label = bk_links(shard, fp.view(np.uint64), radius, direct)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(3)])
            if sum(len(x[0]) for x in held) >= CHUNK:
                k, m, fp = (np.concatenate(x) for x in zip(*held))
                new = np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1]))
                if new.size:  # whole shards only
                    at = int(new[-1]) + 1
                    yield links(k[:at], m[:at], fp[:at])
                    held = [[k[at:], m[at:], fp[at:]]]
                else:
                    held = [[k, m, fp]]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(n), "doc_id long, fp long")


def links(each: DataFrame, radius: int = RADIUS, direct: bool = False) -> DataFrame:
    """(a, b): edges that join each (fp, distinct) with all within the radius; if direct, only such as lie within it themselves, which may leave a cluster in parts."""
    masks = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(blocks(radius, each.count()))]
    shards = each.select("fp", F.explode(F.array(*masks)).alias("s")).select("s.k", "s.m", "fp")
    return shards.repartition("k", "m").sortWithinPartitions("k", "m", "fp").mapInArrow(_edges(radius, direct), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    rows = cut(fingerprints(docs, n))
    edges = links(cut(rows.select("fp").distinct()), radius)
    roots = components(edges).withColumnRenamed("node", "fp")
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(ids)
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(ids.select("fp", "root").join(least, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, found=None) -> DataFrame:
    """The rows of docs, in all their columns, but those for which a row with a smaller id (or of the same id and a smaller place; null ids come last) is in
    the same component. found: (rid, text) -> (rid, c), components by another rule; rows alone in theirs may be left out."""
    (rid,) = fresh(docs.columns, "__rid")
    rows = numbered(docs, rid)
    if found is None:
        made = near_duplicates(rows.select(F.col(rid).alias("doc_id"), "text"), n, radius).select(F.col("doc_id").alias("rid"), F.col("component_id").alias("c"))
    else:
        made = found(rows.select(F.col(rid).alias("rid"), "text"))
    groups = cut(made.join(rows.select(F.col(rid).alias("rid"), F.col("doc_id").alias("id")), "rid"))
    # one row a task and component reaches the shuffle, however many copies a component has
    stays = groups.groupBy("c").agg(F.min_by("rid", F.struct(F.col("id").isNull(), "id", "rid")).alias("rid"))
    gone = cut(groups.select(F.col("rid").alias(rid)).join(stays.select(F.col("rid").alias(rid)), rid, "left_anti"))
    return among(rows, rid, gone, MOST_BROADCAST, those=False).drop(rid)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
