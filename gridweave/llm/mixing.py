"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Targets: source weights share `share` times all words; no target goes above `cap` times the words of its source,
and what is cut off is shared again by weight. A target of r times the source's words gives every document
floor(r) whole copies. The rest is a fixed-size sample without replacement: each document draws u from its id,
and documents are taken in the order of odds(u) / odds(inclusion) until the words needed are reached.
`importance` multiplies a document's inclusion odds.

The cut is found without sorting a source in one task: ranks fall into BUCKETS by size, the words of each bucket are
summed first, and only the bucket that holds the cut is ordered.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a null id draws as the
text "null"; rows that tie in rank go by id, then size, and rows equal in all three are taken together; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

BUCKETS, MOST_BROADCAST = 4096, 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform in (0, 1), from 48 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target). One row a source; rows: source, size."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(cycle, ((F.col("k") - 1) % len(weights) + 1).cast("int"))).withColumn("top", F.col("source_size") * F.lit(cap))
    by = W.orderBy(F.col("top") / F.col("w"), "k")
    s = (
        s.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum("top").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_w"))
    )
    # the lowest level at which the source and those above it stay under their caps
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("top") / F.col("w"), F.struct(F.col("top") / F.col("w"), "k", "level"))).over(W.partitionBy())["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("w") * F.col("level"))).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds q, odds(u) / odds(inclusion) where a part of the source is drawn, and its bucket; rows: doc_id, f, gain."""
    u = draw(F.col("doc_id"), "mix")
    q = (u / (1.0 - u)) / (F.col("f") / (1.0 - F.col("f")) * F.col("gain"))
    rows = rows.withColumn("q", F.when(F.col("f") > 0, q))
    return rows.withColumn("bucket", F.floor(F.lit(BUCKETS) * F.col("q") / (1.0 + F.col("q"))))


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with their source's row. Few sources are broadcast; more are joined by a shuffle that splits hot ones."""
    t = sources.withColumnRenamed("source", "s_")
    t = F.broadcast(t) if sources.count() <= MOST_BROADCAST else t
    return rows.join(t, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, importance: str | None = None) -> DataFrame:
    """One row a source: source, source_size, target, whole, need, f, and where the draw ends: bucket `at`, and in it `last` (q, doc_id, size)."""
    gain = F.coalesce(F.col(importance).cast("double"), F.lit(1.0)) if importance else F.lit(1.0)
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), gain.alias("gain")))
    t = cut(
        targets(rows, weights, share, cap)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("f", F.when(F.col("source_size") > 0, F.col("need") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    d = ranked(with_sources(rows, t).where("need > 0"))
    b = d.groupBy("source", "bucket", "need").agg(F.sum("size").alias("words"))
    b = b.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    b = cut(b.where("before < need and before + words >= need").select("source", F.col("bucket").alias("at"), "before"))
    edge = W.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = (
        with_sources(d, b).where("bucket = at")
        .withColumn("upto", F.sum("size").over(edge) + F.col("before"))
        .where(F.col("upto") - F.col("size") / 2.0 <= F.col("need"))
        .groupBy("source").agg(F.max(F.struct("q", "doc_id", "size")).alias("last"))
    )
    b = b.drop("before").withColumnRenamed("source", "x").join(last, F.col("x").eqNullSafe(F.col("source")), "left").drop("source")
    return cut(t.join(b, F.col("source").eqNullSafe(F.col("x")), "left").drop("x"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, importance: str | None = None) -> DataFrame:
    """docs (doc_id, source, text, ...) with __size, __source_size, __target, __copies (see added()). Texts are not shuffled."""
    p = plan(docs, weights, share, cap, importance)
    gain = F.coalesce(F.col(importance).cast("double"), F.lit(1.0)) if importance else F.lit(1.0)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), gain.alias("gain"), F.struct("*").alias("row"))
    d = ranked(with_sources(rows, p))
    here = (F.col("bucket") == F.col("at")) & (F.struct("q", "doc_id", "size") <= F.col("last"))
    extra = F.coalesce((F.col("bucket") < F.col("at")) | here, F.lit(False)).cast("long")
    size, source_size, target, copies = added(docs)
    return d.select("row.*", F.col("size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target), (F.col("whole") + extra).alias(copies))


def added(docs: DataFrame) -> list[str]:
    """Names of the columns that mix() adds; columns of docs that have one of them already keep it, and the new one gets underscores."""
    return fresh(docs.columns, "__size", "__source_size", "__target", "__copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    copies, copy = *added(docs)[3:], *fresh([*docs.columns, *added(docs)], "__copy")
    return mix(docs, **options).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS top FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
    - coalesce(sum(top) OVER (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY top / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE level <= top / w ORDER BY top / w, k LIMIT 1) AS lv FROM s3),
t AS (SELECT source, source_size, coalesce(least(top, w * lv), top) AS target FROM s4),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
t3 AS (SELECT *, target - whole * source_size AS need, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS f FROM t2),
q AS (SELECT d.doc_id, d.size, t3.*, CASE WHEN f > 0 THEN (u / (1.0::DOUBLE - u)) / (f / (1.0::DOUBLE - f)) END AS q FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN need > 0 AND upto - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
