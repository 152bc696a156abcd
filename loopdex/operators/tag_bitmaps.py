"""Tag clauses as bitmaps over document positions.

A document's position is its place (range, local) in the written index. Each distinct tag, as its list of analysed tokens,
has a bitmap a range (``bitmap_construct_agg`` over the locals). A clause is looked up among the distinct tags, by its
first token and then as a phrase inside a tag, so it never touches documents; its bitmap is the OR of its tags'. A filter
is a set of clauses that all must match and one of clauses of which none may; its *mask* a range is the AND of the first
less the OR of the second, and scoring, phrases, kNN and browsing only ever see documents whose bit is set.

Queries with the same clauses share one filter. Masks hold no row for a range without an allowed document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopdex.session import written

_CLAUSES = "array<array<string>>"


@dataclass
class TagIndex:
    """tags (token, tag): the distinct tags by each of their tokens; bitmaps (tag, range, bits); every (range, bits):
    all documents of a range."""

    tags: DataFrame
    bitmaps: DataFrame
    every: DataFrame


@dataclass
class Masks:
    """of (query_id, filter): the filter of each query; bits (filter, range, mask)."""

    of: DataFrame
    bits: DataFrame

    def on(self, rows: DataFrame) -> DataFrame:
        """rows (query_id, range, ..) with their mask; those without an allowed document go."""
        return rows.join(self.of.select("query_id", "filter"), "query_id").join(self.bits, ["filter", "range"]).drop("filter")

    def only(self, rows: DataFrame) -> DataFrame:
        """rows (query_id, range, ..) whose range has an allowed document, without the mask."""
        some = self.bits.select("filter", "range")
        return rows.join(self.of.select("query_id", "filter"), "query_id").join(some, ["filter", "range"], "left_semi").drop("filter")


def bit_at(mask: bytes, at: np.ndarray) -> np.ndarray:
    """The bits at some places of a bitmap (beyond its end: not set)."""
    bits = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little").astype(bool)
    inside = at < len(bits)
    return inside & bits[np.where(inside, at, 0)] if len(bits) else np.zeros(len(at), bool)


def write_tags(docs: DataFrame, path: str) -> TagIndex:
    """Write the bitmaps of docs (range, local, tag_toks) under path."""
    some = docs.select("range", "local", F.explode(F.array_distinct("tag_toks")).alias("toks")).where(F.size("toks") > 0)
    some = some.select("range", "local", F.array_join("toks", " ").alias("tag"))
    bits = some.groupBy("tag", "range").agg(F.bitmap_construct_agg("local").alias("bits"))
    bits.repartitionByRange("tag", "range").sortWithinPartitions("tag", "range").write.mode("overwrite").parquet(f"{path}/bitmaps")
    docs.groupBy("range").agg(F.bitmap_construct_agg("local").alias("bits")).write.mode("overwrite").parquet(f"{path}/every")
    tags = docs.sparkSession.read.parquet(f"{path}/bitmaps").select("tag").distinct()
    tags.select(F.explode(F.array_distinct(F.split("tag", " "))).alias("token"), "tag").write.mode("overwrite").parquet(f"{path}/tags")
    return read_tags(docs.sparkSession, path)


def read_tags(spark: SparkSession, path: str) -> TagIndex:
    return TagIndex(
        spark.read.schema("token string, tag string").parquet(f"{path}/tags"),
        spark.read.schema("tag string, range bigint, bits binary").parquet(f"{path}/bitmaps"),
        spark.read.schema("range bigint, bits binary").parquet(f"{path}/every"),
    )


def clause_bitmaps(index: TagIndex, clauses: DataFrame) -> DataFrame:
    """(*key, range, bits) of clauses (*key, clause): the documents of each range with a tag that holds the clause's tokens
    next to each other in order. No row where there are none; a clause without tokens matches nothing."""
    key = [c for c in clauses.columns if c != "clause"]
    asked = clauses.where(F.size("clause") > 0).withColumns({"token": F.get("clause", F.lit(0)), "needle": F.concat(F.lit(" "), F.array_join("clause", " "), F.lit(" "))})
    tags = asked.join(index.tags, "token").where(F.concat(F.lit(" "), "tag", F.lit(" ")).contains(F.col("needle"))).select(*key, "tag").distinct()
    return tags.join(index.bitmaps, "tag").groupBy(*key, "range").agg(F.bitmap_or_agg("bits").alias("bits"))


def filters(queries: DataFrame, req: str | None = "req", neg: str | None = "neg") -> tuple[DataFrame, DataFrame]:
    """(filters (filter, req, neg), queries' (query_id, filter)): each distinct pair of clause lists of queries once."""
    none = F.array().cast(_CLAUSES)
    side = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), none))) if c else none
    rows = queries.select("query_id", side(req).alias("req"), side(neg).alias("neg"))
    rows = rows.withColumn("filter", F.md5(F.to_json(F.struct("req", "neg"))))
    return rows.groupBy("filter").agg(F.first("req").alias("req"), F.first("neg").alias("neg")), rows.select("query_id", "filter")


def masks(index: TagIndex, asked: DataFrame, blocked: Column | None = None) -> DataFrame:
    """(filter, range, mask) of filters (filter, req, neg), the blocked clauses (an array of token lists) added to each neg."""
    asked = written(asked.withColumn("n_req", F.size("req")), "filters")
    neg = F.explode("neg") if blocked is None else F.explode(F.array_distinct(F.concat("neg", blocked)))
    clauses = asked.select("filter", F.lit(1).alias("side"), F.posexplode("req").alias("number", "clause"))
    clauses = clauses.unionByName(asked.select("filter", F.lit(0).alias("side"), F.lit(0).alias("number"), neg.alias("clause")).distinct())
    # Clauses of neg are one number, so their bitmaps are one OR; blocked clauses are looked up once for all filters.
    found = clause_bitmaps(index, clauses)
    wanted = found.where("side = 1").groupBy("filter", "range").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    wanted = wanted.join(asked.select("filter", "n_req"), "filter").where("n = n_req").select("filter", "range", "bits")
    open_ = asked.where("n_req = 0").select("filter", F.lit(True).alias("open"))
    everywhere = _with_every(index, open_)
    start = wanted.unionByName(everywhere)
    rows = start.join(found.where("side = 0").select("filter", "range", F.col("bits").alias("out")), ["filter", "range"], "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            result = []
            for bits, out in zip(batch.column("bits").to_pylist(), batch.column("out").to_pylist()):
                bits = np.frombuffer(bits, np.uint8).copy()
                if out:
                    out = np.frombuffer(out, np.uint8)[: len(bits)]
                    bits[: len(out)] &= ~out
                result.append(bits.tobytes().rstrip(b"\0"))
            yield pa.RecordBatch.from_arrays([batch.column("filter"), batch.column("range"), pa.array(result, pa.binary())], names=["filter", "range", "mask"])

    return rows.select("filter", "range", "bits", "out").mapInArrow(run, "filter string, range bigint, mask binary").where(F.length("mask") > 0)


def _with_every(index: TagIndex, open_: DataFrame) -> DataFrame:
    """(filter, range, bits): every range for each filter without required clauses. Filters are dealt to buckets of
    ranges, so each pair is one row of an equi-join."""
    deals = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = index.every.withColumn("deal", F.pmod(F.xxhash64("range"), F.lit(deals)).cast("int"))
    right = open_.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return left.join(right, "deal").select("filter", "range", "bits")


def places(rows: DataFrame, column: str = "mask") -> DataFrame:
    """rows (*key, range, mask) as (*key, range, local), a row a set bit."""
    keys = [c for c in rows.columns if c != column]
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                found = [np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")) for m in part.column(column).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in keys], pa.array(np.concatenate(found).astype(np.int32))], names=[*keys, "local"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", local int")


def browse(orders: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """I16: (filter, range, local, seq): for each filter of wanted (filter, range, mask) documents that hold its first k in
    store order, from orders (range, first, seqs): a range's least seq and the seqs of its locals.

    The two ranges with the least seqs are read first; then those that begin before the k-th seq found."""
    rows = written(wanted.join(orders.select("range", "first"), "range"), "browse-ranges")

    def firsts(rows: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for i, (mask, seqs) in enumerate(zip(batch.column("mask").to_pylist(), batch.column("seqs"))):
                    local = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little"))
                    seq = seqs.values.to_numpy(zero_copy_only=False)[local]
                    best = np.lexsort((local, seq))[:k]
                    out.append((np.full(len(best), i), local[best], seq[best]))
                if out:
                    row, local, seq = (np.concatenate(x) for x in zip(*out))
                    at = pa.array(row.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("filter").take(at), batch.column("range").take(at), pa.array(local.astype(np.int32)), pa.array(seq.astype(np.int64))], names=["filter", "range", "local", "seq"])

        rows = rows.drop("first").join(orders.select("range", "seqs"), "range").select("filter", "range", "mask", "seqs")
        return rows.mapInArrow(run, "filter string, range bigint, local int, seq bigint")

    place = F.row_number().over(Window.partitionBy("filter").orderBy("first", "range"))
    head = rows.withColumn("place", place).where("place <= 2").drop("place")
    found = written(firsts(head), "browse-first")
    last = found.withColumn("place", F.row_number().over(Window.partitionBy("filter").orderBy("seq"))).where(F.col("place") == k).select("filter", F.col("seq").alias("last"))
    rest = rows.join(head.select("filter", "range"), ["filter", "range"], "left_anti").join(last, "filter", "left")
    rest = rest.where(F.col("last").isNull() | (F.col("first") <= F.col("last"))).drop("last")
    return found.unionByName(firsts(rest))
