"""Bounded-space online packing of tokenised documents into sequences of `size` tokens.

Each partition keeps `windows` open windows. A document's whole multiples of `size` become sequences of their own; what
remains goes to the open window that it fits best. Where none fits, the fullest window is topped up with the head of the
piece and emitted, and the tail is placed again: no emitted sequence has padding. The windows that are still
open at the end of a partition hold a bounded number of pieces; these are merged, largest first and best-fit, in groups
of MERGE partitions, then in groups of those, until one group is left.

Ids: those of the `tokenizers` file, special strings included, then the end id. The same vocabulary as ranks, in `tiktoken`,
gives the same ids faster for texts of the letters that both sort alike for certain; any other text goes through
`tokenizers` itself. A document's ids are one array, and its pieces are views of it.

Defined cases: a null or empty text is the end id alone; equal rows are packed as often as they occur; no rows give no
rows; other columns are ignored. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table

SIZE, END, WINDOWS, MERGE = 2048, 1, 32, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters whose class may differ by Unicode version, and the special string.
ODD = re.compile(r"[ɐ-\U0010ffff]|<\|endoftext\|>")


class Encoder:
    """text -> ids (little-endian unsigned 32-bit), as the tokenizers file gives them."""

    def __init__(self, tokenizer_json: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.json = tokenizer_json or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        self.exact = None

    def __call__(self, text: str) -> np.ndarray:
        if not ODD.search(text):
            return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Best-fit over a fixed number of open windows."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows, self.made = size, windows, 0
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.open: dict[int, list] = {}
        self.fresh()

    def fresh(self) -> None:
        while len(self.room) < self.windows:
            insort(self.room, (self.size, self.made))
            self.open[self.made] = []
            self.made += 1

    def put(self, at: int, piece: tuple) -> tuple[int, list] | None:
        """The window's pieces, if it is now full."""
        left, w = self.room.pop(at)
        self.open[w].append((*piece, self.size - left))
        if left == piece[2]:
            self.fresh()
            return w, self.open.pop(w)
        insort(self.room, (left - piece[2], w))
        self.fresh()
        return None

    def document(self, doc_id, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        n, at = len(ids), 0
        piece = lambda a, b: (doc_id, a, b - a, zlib.crc32(ids[a:b]), n)
        while n - at >= self.size:
            yield self.made, [(*piece(at, at + self.size), 0)]
            self.made += 1
            at += self.size
        while at < n:
            k = bisect_left(self.room, (n - at, -1))
            if k == len(self.room):  # none fits: top up and emit the fullest
                done = self.put(0, piece(at, at + self.room[0][0]))
                at += done[1][-1][2]
                yield done
                continue
            done = self.put(k, piece(at, n))
            at = n
            if done:
                yield done


def packed(size: int, end: int, windows: int, tokenizer_json, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        encode, packer, out, last = Encoder(tokenizer_json, ranks), Packer(size, windows), [], np.array([end], "<u4")

        def rows(done: tuple[int, list], left: bool) -> None:
            out.extend((pid, left, *p[:5], pid << 28 | done[0], p[5]) for p in done[1])

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 9
            kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 7]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["pid", "left", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for done in packer.document(doc_id, np.append(encode(text.as_py() or ""), last)):
                    rows(done, False)
            if len(out) > 20_000:
                yield flush()
        for done in packer.open.items():
            rows(done, True)
        yield flush()

    return run


def merged(size: int, level: int):
    """Pieces of one group of open windows, placed anew without another cut."""

    def run(key, t):
        group, room, opened, out = int(key[0]), [], 0, []
        t = t.drop(columns="g").sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        for row in t.itertuples(index=False):
            k = bisect_left(room, (row.length, -1))
            left, w = room.pop(k) if k < len(room) else (size, opened)
            opened += w == opened
            out.append((w, size - left))
            if left > row.length:
                insort(room, (left - row.length, w))
        gaps = {w: left for left, w in room}
        t["sequence_id"] = [level << 58 | group << 28 | w for w, _ in out]
        t["offset"] = [o for _, o in out]
        t["left"] = [gaps.get(w, 0) > size // 64 for w, _ in out]
        t["pid"] = group
        return t

    return run


def pack(docs: DataFrame, size: int = SIZE, end: int = END, windows: int = WINDOWS, tokenizer_json: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): PIECES."""
    columns = ["pid int", "left boolean", *PIECES.split(", ")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = cut(source.mapInArrow(lean(packed(size, end, windows, tokenizer_json, ranks)), ", ".join(columns)))
    top, level, out = done.agg(F.max("pid")).first()[0] or 0, 0, []
    while True:
        level += 1
        out.append(done.where("not left"))
        left = done.where("left").withColumn("g", F.col("pid").cast("long") / MERGE)
        left = left.withColumn("g", F.floor("g"))
        done = cut(left.groupBy("g").applyInPandas(merged(size, level), ", ".join(columns)))
        top //= MERGE
        if not top:
            out.append(done)
            break
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.drop("pid", "left")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
