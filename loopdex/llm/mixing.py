"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order (by MD5 of its id); repeats of a source follow one another
as further epochs. A copy's virtual finish time is its source's cumulative size up to and with it, divided by the
source's target. Reading all copies by finish time and stopping at the total budget gives each source its share at any
moment; the copy at the cut is taken in part.

No window holds a source: cumulative sums are taken in buckets of the shuffled order (as many as the source's rows
need), then shifted by the sums of the buckets before. The cut is found the same way over slices of virtual time, so
only the slice that holds the cut is ordered exactly. Only (id, source, size) is ever shuffled.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last; rows that repeat an
id in one source follow each other, smaller ones first, and are a document each; a null id is a value like any other; an
empty table, or one without words, gives targets of 0; columns beyond id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loopdex.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MOST_REPEATS = 2
ROWS_A_BUCKET = 20_000
MOST_BROADCAST_SOURCES = 10_000
LEAST_SLICES = 1024


def targets(sized: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target): the budget shared by weight, no target above repeats * source_size.

    Resharing the excess until none is above ends where every source has min(cap, level * weight); the level is found
    in one pass over the sources in order of cap / weight. The windows run over one row a source, not over documents."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(budget_percent) / F.lit(100)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    src = src.withColumn("level", level)
    # The level of the first source that stays under its cap holds for all; all capped: any level above every ratio.
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("cap") / F.col("weight"))).over(whole)
    at = F.min(F.when(F.col("cap") / F.col("weight") == fits, F.col("level"))).over(whole)
    return src.withColumn("target", F.least(F.col("cap"), F.coalesce(at * F.col("weight"), F.col("cap")))).select("source", "source_size", "n_docs", "target")


def _running(value: str, keys: list[str], bucket: str, order: list) -> Column:
    return F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, row), written once so that the texts are read a single time; row tells rows apart that are
    equal in all else."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    return written(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")


def schedule(sizes: DataFrame, repeats: int = MOST_REPEATS, seed: str = "", **shares) -> DataFrame:
    """One row a copy: doc_id, source, size, row, source_size, target, epoch, finish, taken; copies past the budget have
    taken 0. Order by finish, source, epoch, key, doc_id, size, row to read the mix (``ordered``)."""
    src = written(targets(sizes, repeats=repeats, **shares), "targets")
    few = src.count() <= MOST_BROADCAST_SOURCES
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    point = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    docs = sizes.withColumn("key", key).join(F.broadcast(src) if few else src, sizes.source.eqNullSafe(src.source)).drop(src.source)
    docs = docs.withColumn("bucket", F.floor(point * F.ceil(F.col("n_docs") / ROWS_A_BUCKET)))
    within = _running("size", ["source"], "bucket", ["key", "doc_id", "size", "row"])
    docs = written(docs.withColumn("within", within), "runs")
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    start = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), start.alias("start"))
    docs = docs.join(starts, docs.source.eqNullSafe(starts.s) & (docs.bucket == starts.b)).drop("s", "b")
    copies = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("start") + F.col("within")) / F.col("target"))
    of_all = src.agg(F.sum("n_docs").alias("n_docs"), F.round(F.sum("target")).cast("long").alias("budget")).first()
    slices = max(LEAST_SLICES, (of_all["n_docs"] or 0) * repeats // ROWS_A_BUCKET)
    copies = copies.withColumn("finish", finish).withColumn("slice", F.coalesce(F.floor(F.col("finish") * slices), F.lit(0)))
    copies = written(copies.select("doc_id", "source", "size", "row", "source_size", "target", "epoch", "finish", "slice", "key"), "copies")
    # Slices of virtual time: whole below the one where the budget ends, ordered exactly inside it, nothing above.
    by_slice = copies.groupBy("slice").agg(F.sum("size").alias("sum")).withColumn("upto", F.sum("sum").over(W.orderBy("slice")))
    cut = by_slice.where(F.col("upto") >= (of_all["budget"] or 0)).orderBy("slice").first()
    at, left = (cut["slice"], of_all["budget"] - cut["upto"] + cut["sum"]) if cut and of_all["budget"] else (-1, 0)
    inside = copies.where(F.col("slice") == at)
    upto = _running("size", [], "slice", ["finish", F.col("source").asc_nulls_last(), "epoch", "key", "doc_id", "size", "row"])
    inside = inside.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(left) - upto + F.col("size"))))
    rest = copies.where(F.col("slice") != at).withColumn("taken", F.when(F.col("slice") < at, F.col("size")).otherwise(F.lit(0)))
    names = ["doc_id", "source", "size", "row", "source_size", "target", "epoch", "finish", "key", F.col("taken").cast("long").alias("taken")]
    return inside.select(*names).unionByName(rest.select(*names))


def ordered(copies: DataFrame) -> DataFrame:
    """The mix as it is read: the copies taken, range-sorted by virtual finish time."""
    return copies.where("taken > 0").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "key", "doc_id", "size", "row")


def taken_by_document(copies: DataFrame) -> DataFrame:
    """One row a row of the input: doc_id, source, size (one copy), source_size, target, taken over all copies."""
    return copies.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").cast("long").alias("taken"))


def sql() -> str:
    from loopdex.llm.common import SPACE

    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 150 / 100 AS total FROM s),
l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT min_by(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
c AS (SELECT r, doc_id, d.source, size, source_size, target, epoch, key, CASE WHEN target > 0 THEN (epoch * source_size + sum(size) OVER (PARTITION BY d.source, epoch ORDER BY key, doc_id, size, r ROWS UNBOUNDED PRECEDING)) / target END AS finish FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS FIRST, source NULLS LAST, epoch, key, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto, (SELECT round(sum(target)) FROM t) AS budget FROM c)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, budget - upto + size)))::BIGINT AS taken FROM o GROUP BY r, doc_id, source, size, source_size, target"""
