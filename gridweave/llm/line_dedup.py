"""Line dedup: maximal repeated runs of lines, found in a suffix array over line ids by distributed prefix doubling.

All documents in order of id are one sequence of lines (positions 0, 1, ...); a suffix ends with its document. A line's id is a
128-bit hash of its text. Only positions whose line occurs twice or more can begin a repeated run; the others never enter a sort.

Prefix doubling: a suffix has its first line's id and a rank within the group of that line. In round k, suffixes that still share a rank
are sorted by (line, rank, rank of the suffix 2**k lines on, position); the rank becomes the place of the first equal one. Sorting is by
range over the whole key, position included, so a line that makes up a third of all rows is dealt over many tasks; places come
from each partition's counts, of which the driver adds up one row for each partition. Rounds end when all ranks are single, after the logarithm of
the longest repeated run.

Common prefixes: the suffix before i in the array is the suffix before i - 1, moved on by one, for most i; then their common
prefix is one line shorter. Only the other pairs compare their lines, up to the 2**k at which they parted; such pairs' common
prefixes add up to n log n lines at most.

Intervals: for each suffix, the longest common prefix with any suffix at an earlier position, by a stack over each partition of
the array; what reaches over a partition's edge is one least position for each prefix length, no more than one document has lines.
A run of that many lines repeats an earlier one. If it has a word (MIN_WORDS), its lines are deleted: the earliest copy stays.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; documents of one id are ordered by text hash and the order of
the files; a document whose lines all go keeps an empty text; blank lines have no words, so they go only within a longer run; no rows give no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, lean, numbered, table

MIN_WORDS, STEP, NONE = 1, 64, -1


# --- positions ----------------------------------------------------------------------------------------------------


def _numbered(held):
    """Adds each document's first position; held: lines before each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            n = b.column("n").to_numpy()
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(start), *(b.column(c) for c in ("n", "a", "b", "w"))], ["rid", "start", "n", "a", "b", "w"])

    return run


def _totals(df: DataFrame, value) -> dict[int, int]:
    """Sum of the values before each partition of a checkpointed table."""
    rows = sorted(df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(value).alias("n")).collect())
    out, at = {}, 0
    for p, n in rows:
        out[p] = at
        at += n
    return out


def lines(docs: DataFrame) -> DataFrame:
    """rid, start, n, a, b (hashes), w (words): a row for each row of docs (rid, doc_id, text) with a text."""
    parts = F.split("text", "\n", -1)
    d = docs.where(F.col("text").isNotNull()).select("rid", "doc_id", F.xxhash64("text").alias("key"), parts.alias("l"))
    d = d.select(
        "rid", "doc_id", "key", F.size("l").cast("long").alias("n"), F.transform("l", lambda x: F.xxhash64(x)).alias("a"), F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD))).alias("w"),
    )
    d = cut(d.repartitionByRange("doc_id", "key", "rid").sortWithinPartitions("doc_id", "key", "rid"))
    held = d.sparkSession.sparkContext.broadcast(_totals(d, F.col("n")))
    return cut(d.mapInArrow(_numbered(held), "rid long, start long, n long, a array<long>, b array<long>, w array<int>"))


# --- ranks --------------------------------------------------------------------------------------------------------


def _key(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])


def _edges(group: list[str], sub: list[str]):
    """One row for each partition of a sorted table: its size, first and last key, and where the last group and subgroup begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, g0, s0 = 0, None, None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = _key(b, group + sub)
            if first is None:
                first, last = k[:, 0], k[:, 0]
            k = np.c_[last, k]
            moved = k[:, 1:] != k[:, :-1]
            for what in (0, 1):
                at = np.flatnonzero((moved[: len(group)] if not what else moved).any(0))
                if at.size:
                    if what:
                        s0 = n + int(at[-1])
                    else:
                        g0 = n + int(at[-1])
            last = k[:, -1]
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), n, [int(v) for v in first], [int(v) for v in last], g0, s0)], ["p", "n", "first", "last", "g0", "s0"])

    return run


def _ranks(held, group: list[str], sub: list[str], out: list[str]):
    """r: rank in the group of the first row with the same subgroup; many: whether another row of this partition or the edges shares the subgroup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = held.value.get(TaskContext.get().partitionId())
        if start is None:
            return
        at, g, s, last, after = start["at"], start["g"], start["s"], start["last"], start["after"]
        held_back = None

        def ranked(b: pa.RecordBatch, following) -> pa.RecordBatch:
            nonlocal at, g, s, last
            k = _key(b, group + sub)
            before = np.c_[k[:, 0] if last is None else last, k]
            moved = before[:, 1:] != before[:, :-1]
            if last is None:
                moved[:, 0] = True
            newg, news = moved[: len(group)].any(0), moved.any(0)
            i = at + np.arange(b.num_rows)
            gs = np.maximum.accumulate(np.where(newg, i, g))
            ss = np.maximum.accumulate(np.where(news, i, s))
            ends = np.r_[news[1:], following is None or bool((k[:, -1] != following).any())]
            base = b.column("r").to_numpy() if "r" in b.schema.names else 0
            at, g, s, last = at + b.num_rows, int(gs[-1]), int(ss[-1]), k[:, -1]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(base + ss - gs), pa.array(~(news & ends))], [*out, "r", "many"])

        for b in batches:
            if b.num_rows:
                if held_back is not None:
                    yield ranked(held_back, _key(b.slice(0, 1), group + sub)[:, 0])
                held_back = b
        if held_back is not None:
            yield ranked(held_back, after)

    return run


def ranked(rows: DataFrame, group: list[str], sub: list[str], keep: list[str]) -> DataFrame:
    """keep + r, many: see _ranks(). Rows that tie in group + sub are dealt by position."""
    keys = [*group, *sub, "pos"]
    t = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
    kind = "p int, n long, first array<long>, last array<long>, g0 long, s0 long"
    edges = sorted(t.mapInArrow(_int_p(_edges(group, sub)), kind).collect())
    carry, at, g, s, last = {}, 0, 0, 0, None
    for i, e in enumerate(edges):
        first = np.array(e["first"])
        after = np.array(edges[i + 1]["first"]) if i + 1 < len(edges) else None
        carry[e["p"]] = {"at": at, "g": g, "s": s, "last": last, "after": after}
        same_g = last is not None and (first[: len(group)] == last[: len(group)]).all()
        same_s = last is not None and (first == last).all()
        g = at + e["g0"] if e["g0"] or not same_g else g
        s = at + e["s0"] if e["s0"] or not same_s else s
        last, at = np.array(e["last"]), at + e["n"]
    held = rows.sparkSession.sparkContext.broadcast(carry)
    return cut(t.mapInArrow(_ranks(held, group, sub, keep), ", ".join([f"{c} {dict(t.dtypes)[c]}" for c in keep] + ["r long", "many boolean"])))


def _int_p(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *b.columns[1:]], b.schema.names)

    return run


def suffix_ranks(docs_lines: DataFrame) -> DataFrame:
    """pos, end, a, b, r, parted: for each position whose line repeats. (a, b, r) sorts the suffixes; parted: round in which it became single."""
    each = docs_lines.select((F.col("start") + F.col("n")).alias("end"), F.posexplode(F.arrays_zip("a", "b")), "start").select((F.col("start") + F.col("pos")).alias("pos"), "end", "col.a", "col.b")
    # cut, so that the join has a shuffle of its own, whose hot partitions can be split
    often = cut(docs_lines.select(F.explode(F.arrays_zip("a", "b")).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"))
    rows = cut(each.join(often, ["a", "b"], "left_semi").withColumn("r", F.lit(0).cast("long")).withColumn("many", F.lit(True)))
    done, all_ranks, k = [], rows.select("pos", "r", "a", "b"), 0
    while True:
        open_ = rows.where("many")
        if open_.isEmpty():
            break
        # the suffix 2**k on: none beyond the document's end, and none where its first line is unique; either way this suffix is single
        at = F.col("pos") + (1 << k)
        nxt = all_ranks.select(F.col("pos").alias("at"), F.col("r").alias("r2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        pairs = open_.withColumn("at", F.when(at < F.col("end"), at).otherwise(-1 - F.col("pos"))).join(nxt, "at", "left")
        own = F.col("r2").isNull()
        pairs = pairs.select("pos", "end", "a", "b", "r", F.coalesce("a2", F.lit(0)).alias("a2"), F.coalesce("b2", F.lit(0)).alias("b2"), F.coalesce("r2", -1 - F.col("pos")).alias("r2"))
        k += 1
        new = ranked(pairs, ["a", "b", "r"], ["a2", "b2", "r2"], ["pos", "end", "a", "b"])
        done.append(new.where("not many").withColumn("parted", F.lit(k)))
        rest = all_ranks.join(new.select("pos"), "pos", "left_anti")
        all_ranks = cut(rest.unionByName(new.select("pos", "r", "a", "b")))
        rows = new
    if not done:
        return rows.select("pos", "end", "a", "b", "r", F.lit(0).alias("parted"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pos", "end", "a", "b", "r", "parted")


# --- common prefixes ----------------------------------------------------------------------------------------------


def _previous(held):
    """Adds prev: the position before this one in the array, where both have the same first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value.get(TaskContext.get().partitionId(), (0, 0, NONE, 0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            a, bb, pos, end, parted = (b.column(c).to_numpy() for c in ("a", "b", "pos", "end", "parted"))
            same = (a == np.r_[last[0], a[:-1]]) & (bb == np.r_[last[1], bb[:-1]])
            prev = np.where(same, np.r_[last[2], pos[:-1]], NONE)
            most = np.minimum(end - pos, np.r_[last[3], end[:-1]] - prev)
            most = np.minimum(most, 1 << np.minimum(parted, np.r_[last[4], parted[:-1]]).astype(np.int64))
            on = (prev != NONE) & (end - pos > 1) & (np.r_[last[3], end[:-1]] - prev > 1)
            last = (int(a[-1]), int(bb[-1]), int(pos[-1]), int(end[-1]), int(parted[-1]))
            yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(prev), pa.array(np.where(prev == NONE, 0, most)), pa.array(on)], ["pos", "prev", "most", "on"])

    return run


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        if b.num_rows:
            last = b.slice(b.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(last.column(c) for c in ("a", "b", "pos", "end", "parted"))], ["p", "a", "b", "pos", "end", "parted"])


def common_prefixes(array_: DataFrame, docs_lines: DataFrame) -> DataFrame:
    """pos, lcp: lines shared with the suffix before it in the array. array_: sorted and checkpointed."""
    spark = array_.sparkSession
    tails = sorted(array_.mapInArrow(_tails, "p int, a long, b long, pos long, end long, parted int").collect())
    carry = {}
    n = array_.rdd.getNumPartitions()
    last = None
    by = {t["p"]: tuple(t)[1:] for t in tails}
    for p in range(n):
        if last is not None:
            carry[p] = last
        last = by.get(p, last)
    pairs = cut(array_.mapInArrow(_previous(spark.sparkContext.broadcast(carry)), "pos long, prev long, most long, on boolean"))
    real = pairs.where(F.col("prev") >= 0)
    before = real.where("on").select((F.col("pos") + 1).alias("pos"), (F.col("prev") + 1).alias("prev"))
    odd = real.join(before, ["pos", "prev"], "left_anti")
    ranges = docs_lines.select("start", "n", "a", "b")
    # positions find their documents by the blocks of STEP positions that a document covers
    place = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / STEP), F.floor((F.col("start") + F.col("n") - 1) / STEP))))

    def lines_at(t: DataFrame, col: str, name: str) -> DataFrame:
        j = t.withColumn("block", F.floor(F.col(col) / STEP)).join(place, "block").where((F.col(col) >= F.col("start")) & (F.col(col) < F.col("start") + F.col("n")))
        first, many = (F.col(col) - F.col("start") + 1).cast("int"), F.col("most").cast("int")
        return j.withColumn(name, F.arrays_zip(F.slice("a", first, many).alias("a"), F.slice("b", first, many).alias("b"))).drop("block", "start", "n", "a", "b")

    both = lines_at(lines_at(odd, "pos", "x"), "prev", "y")
    differ = F.array_position(F.zip_with("x", "y", lambda p, q: p == q), False)
    measured = both.select("pos", F.when(differ == 0, F.col("most")).otherwise(differ - 1).cast("long").alias("lcp"))
    # a pair that follows the one before it shares one line less
    t = cut(real.select("pos").join(measured, "pos", "left").repartitionByRange("pos").sortWithinPartitions("pos"))
    return cut(_filled(t))


def _filled(filled: DataFrame) -> DataFrame:
    """pos, lcp with each null as the last known value before it minus the distance; filled: sorted and checkpointed."""
    spark = filled.sparkSession

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            lcp = b.column("lcp").to_numpy(zero_copy_only=False).astype(float)
            at = np.flatnonzero(~np.isnan(lcp))
            if at.size:
                best = (int(b.column("pos")[int(at[-1])].as_py()), int(lcp[at[-1]]))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([best[0]]), pa.array([best[1]])], ["p", "pos", "lcp"])

    tails = sorted(filled.mapInArrow(tail, "p int, pos long, lcp long").collect())
    held = spark.sparkContext.broadcast(tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before = [t for t in held.value if t["p"] < pid]
        at, value = (before[-1]["pos"], before[-1]["lcp"]) if before else (NONE, 0)
        for b in batches:
            if not b.num_rows:
                continue
            pos, lcp = b.column("pos").to_numpy(), b.column("lcp").to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(lcp)
            src = np.maximum.accumulate(np.where(known, np.arange(len(pos)), -1))
            there = np.maximum(src, 0)
            got = np.where(src >= 0, np.where(known, lcp, 0)[there] - (pos - pos[there]), value - (pos - at)).astype(np.int64)
            at, value = int(pos[-1]), int(got[-1])
            yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(got)], ["pos", "lcp"])

    return filled.select("pos", "lcp").mapInArrow(run, "pos long, lcp long")


# --- intervals ----------------------------------------------------------------------------------------------------


def _steps(pos: np.ndarray, lcp: np.ndarray, carry: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each suffix in turn, the longest prefix shared with an earlier position among those passed; and what to carry on.
    The stack holds (prefix, least position), both rising strictly. lcp[i]: with the one before i in the direction of travel."""
    out, stack = np.zeros(len(pos), np.int64), list(carry)
    for i, (p, shared) in enumerate(zip(pos.tolist(), lcp.tolist())):
        least = None
        while stack and stack[-1][0] >= shared:
            q = stack.pop()[1]
            least = q if least is None else min(least, q)
        if least is not None and shared > 0:
            while stack and stack[-1][1] >= least:  # a shorter prefix with a later position says nothing
                stack.pop()
            stack.append((shared, least))
        for n, q in reversed(stack):
            if q < p:
                out[i] = n
                break
        while stack and stack[-1][1] >= p:
            stack.pop()
        # itself, for those to come: its prefix is unbounded until the next lcp
        stack.append((1 << 60, p))
    return out, stack


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition carries to either side: least position for each prefix shared with its last and with its first suffix."""
    pos, lcp, _ = _columns(batches)
    if not len(pos):
        return
    _, right = _steps(pos, np.r_[0, lcp[1:]], [])
    _, left = _steps(pos[::-1], np.r_[0, lcp[:0:-1]], [])
    least = int(lcp[1:].min()) if len(lcp) > 1 else 1 << 60
    row = [TaskContext.get().partitionId(), int(lcp[0]), least, [x for x, _ in right], [q for _, q in right], [x for x, _ in left], [q for _, q in left]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["p", "head", "least", "rn", "rq", "ln", "lq"])


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    got = [[b.column(c).to_numpy() for c in ("pos", "lcp", "end")] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * 3


def _folded(old: list[tuple[int, int]], shared: int, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Carries old on past a partition whose suffixes all share `shared` lines with its far edge; new: its own."""
    best: dict[int, int] = {}
    for n, q in [(min(n, shared), q) for n, q in old] + new:
        if n > 0:
            best[n] = min(q, best.get(n, q))
    out: list[tuple[int, int]] = []
    for n in sorted(best, reverse=True):  # longest first: keep a shorter one only for an earlier position
        if not out or best[n] < out[-1][1]:
            out.append((n, best[n]))
    return out[::-1]


def _longest(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, lcp, end = _columns(batches)
        if not len(pos):
            return
        left, right, after = held.value[TaskContext.get().partitionId()]
        a, _ = _steps(pos, lcp, left)
        b, _ = _steps(pos[::-1], np.r_[after, lcp[:0:-1]], right)
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(end), pa.array(np.maximum(a, b[::-1]))], ["pos", "end", "run"])

    return run


def repeats(array_: DataFrame, docs_lines: DataFrame) -> DataFrame:
    """pos, end, run: for each suffix, the lines it shares with an earlier position at most (those with none are left out)."""
    spark = array_.sparkSession
    known = common_prefixes(array_, docs_lines)
    full = array_.select("pos", "end", "a", "b", "r").join(known, "pos", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0).cast("long")))
    full = cut(full.repartitionByRange("a", "b", "r").sortWithinPartitions("a", "b", "r"))
    sums = sorted(full.mapInArrow(lean(_summary), "p int, head long, least long, rn array<long>, rq array<long>, ln array<long>, lq array<long>").collect())
    held, carry = {}, []
    for s in sums:  # from the left
        held[s["p"]] = [carry]
        carry = _folded(carry, min(s["head"], s["least"]), list(zip(s["rn"], s["rq"])))
    carry, after = [], 0
    for s in reversed(sums):
        held[s["p"]] += [carry, after]
        carry = _folded(carry, min(after, s["least"]), list(zip(s["ln"], s["lq"])))
        after = s["head"]
    return full.mapInArrow(lean(_longest(spark.sparkContext.broadcast(held))), "pos long, end long, run long").where("run > 0")


# --- deletion -----------------------------------------------------------------------------------------------------


def _kept(min_words: int):
    """keep: for each line of a document whether it stays; only for documents that lose a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, start, w, pos, runs in zip(*(b.column(c).to_pylist() for c in ("rid", "start", "w", "pos", "run"))):
                upto = np.r_[0, np.cumsum(w)]
                first = np.array(pos) - start
                after = first + np.array(runs)
                gone = upto[after] - upto[first] >= min_words
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, first[gone], 1)
                np.add.at(change, after[gone], -1)
                keep = np.cumsum(change)[:-1] == 0
                if not keep.all():
                    rows.append((rid, keep.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.bool_()))], ["rid", "keep"])

    return run


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, keep (array of boolean): for the rows of docs (rid, doc_id, text) that lose a line."""
    at = lines(docs)
    ranks = suffix_ranks(at)
    array_ = cut(ranks.repartitionByRange("a", "b", "r").sortWithinPartitions("a", "b", "r"))
    runs = repeats(array_, at).groupBy("end").agg(F.collect_list("pos").alias("pos"), F.collect_list("run").alias("run"))
    return at.withColumn("end", F.col("start") + F.col("n")).join(runs, "end").select("rid", "start", "w", "pos", "run").mapInArrow(lean(_kept(min_words)), "rid long, keep array<boolean>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the later copies of repeated runs taken out of text. counts: names of two more columns, the lines that a text had and lost."""
    rid, keep_, gone = fresh([*docs.columns, *(counts or ())], "__rid", "__keep", "__gone")
    rows = numbered(docs, rid)
    keep = cut(kept_lines(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), min_words))
    parts = F.split("text", "\n", -1)
    left = F.transform(F.filter(F.arrays_zip(parts.alias("l"), F.col(keep_).alias("k")), lambda x: x["k"]), lambda x: x["l"])
    out = rows.join(keep.select(F.col("rid").alias(rid), F.col("keep").alias(keep_)), rid, "left").withColumn(gone, F.coalesce(F.size(F.filter(keep_, lambda x: ~x)), F.lit(0)))
    out = out.withColumn(gone, F.greatest(gone, F.lit(0)))
    text = F.when(F.col(keep_).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    more = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias(counts[0]), F.col(gone).cast("long").alias(counts[1])] if counts else []
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_deleted"))
    return out.select("doc_id", "n_lines", "n_deleted", "text")
