"""What the operators share: table access, checkpoints, folds and bounded labelled samples."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is set, a temporary one, but only in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder is known that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridweave-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows and their partitions survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets the driver notice what it no longer refers to, so that shuffle files and checkpoints of finished steps leave the disk."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(f):
    """A function of batches that gives memory back to the system when a task is done; Python workers live on, and what they hold counts against their executor."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, the same whenever the plan runs: rows of anything but a plain scan are checkpointed first."""

    def steady(node) -> bool:
        kind, children = node.getClass().getSimpleName(), node.children()
        return kind in ("LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter") and all(steady(children.apply(i)) for i in range(children.size()))

    return (df if steady(df._jdf.queryExecution().optimizedPlan()) else cut(df)).withColumn(name, F.monotonically_increasing_id())


def among(df: DataFrame, rid: str, ids: DataFrame, most: int, those: bool = True) -> DataFrame:
    """The rows of df whose number rid (a long) is among ids (their first column of that name), or, unless those, the other ones. Numbers are packed into
    bitmaps of 256, so that ids of many rows can be broadcast and the columns of df stay where they are; beyond `most` bitmaps it is a shuffle join."""
    key, *bits = fresh(df.columns, "__key", "__b0", "__b1", "__b2", "__b3")
    name = f"`{rid}`"
    one = f"shiftleft(1L, cast({name} & 63L as int))"
    packed = cut(ids.groupBy(F.expr(f"shiftright({name}, 8)").alias(key)).agg(*(F.expr(f"bit_or(if((shiftright({name}, 6) & 3L) = {i}L, {one}, 0L))").alias(b) for i, b in enumerate(bits))))
    if packed.count() > most:
        return df.join(ids.select(rid).distinct(), rid, "left_semi" if those else "left_anti")
    word = "case (shiftright({0}, 6) & 3L) when 0L then `{1}` when 1L then `{2}` when 2L then `{3}` else `{4}` end".format(name, *bits)
    found = F.expr(f"coalesce(({word}) & {one}, 0L) <> 0L")
    out = df.withColumn(key, F.expr(f"shiftright({name}, 8)")).join(F.broadcast(packed), key, "inner" if those else "left")
    return out.where(found if those else ~found).select(*(F.col(f"`{c}`") for c in df.columns))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def held_out(doc_id: str, mod: int, remainder: int) -> Column:
    """True where the id falls in the fold that training never sees; a null id is not held out."""
    return F.coalesce(fold(doc_id, mod) == remainder, F.lit(False))


def chance(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return (F.xxhash64(F.lit(seed), key).bitwiseAND((1 << 40) - 1)) / float(1 << 40)


def labelled_ids(labels: DataFrame, label: str, mod: int, remainder: int, per_class: int) -> DataFrame:
    """(doc_id, y): a sample of labelled rows outside the held-out fold, at most about per_class rows of
    each class and never over 3 * per_class rows, so that it can be broadcast. It depends on ids alone."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", mod) != remainder))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (chance(F.col("doc_id"), 17) < min(1.0, per_class / n)))
    return rows.where(keep).limit(3 * per_class)


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y) of a bounded labelled_ids(); the ids are broadcast, the texts are not shuffled."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
