"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after proving it holds at most ``max_rows`` rows.

    The check runs a LIMIT-bounded count (a tiny job on the small side). Beyond the
    bound the DataFrame is returned unhinted, so Spark plans a shuffle join instead.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def top_k_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group with a 1-based ``rank``.

    Written as ``row_number() <= k`` so Catalyst inserts a partial
    ``WindowGroupLimit`` before the exchange: a hot group never ships more than
    ``k`` rows per map task to the final window.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def round6(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def ensure_cols(df: DataFrame, cols: tuple[str, ...], dtype: str = "string") -> DataFrame:
    """Add absent optional store fields as typed nulls (schema-on-write stores omit them)."""
    missing = {c: F.lit(None).cast(dtype) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Hash-spread rows on ``key``, so CPU-heavy per-row work (regex tokenising, JSON parsing, hashing) runs in parallel
    whatever the files hold: a scan may have as many tasks as the cluster has cores with all rows in one of them (a file is
    cut by bytes, but a row group is read by one task). There are as many tasks as shuffles have, at least one a core and,
    where ``rows`` is given, one for as many rows (a count: of a scan it reads footers alone). Partitioning on ``key`` also
    satisfies later aggregations whose grouping keys include it, so they add no further exchange.
    """
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(want if rows is None else max(want, -(-df.count() // rows)), key)
