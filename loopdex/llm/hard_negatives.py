"""Hard-negative mining: Hilbert-ordered candidate blocks in Parquet, zone maps, interval bounds that choose what is read.

An anchor's positives are its best other rows of the same label; its negatives for a positive are the best rows of other
labels whose score lies in a window below that positive's. A score is the integer inner product of vectors whose
components are floor(256 x). Steps:

1. Candidates. Rows are range-sorted by (label, length, Hilbert key, id), the key being the place on a Hilbert curve
   through the cube of all components at BITS bits each, so neighbours on disk are neighbours in space. Each task writes
   a Parquet file with a row group a block of BLOCK rows, and returns the blocks' zone maps (least and greatest of each
   dimension), as many blocks a slice as SLICE_BYTES hold, and its anchors in groups of GROUP_BYTES.
2. Bounds. For an anchor a and a block with the zone [lo, hi], the sum over dimensions of the greater and of the smaller
   of a*lo and a*hi bounds every score in the block from above and below.
3. Positives. Each group of anchors meets each slice of its label once. Blocks are taken by falling bound, and a block
   is read only if its bound reaches the k-th best score of an anchor so far, and scored with these anchors alone.
4. Negatives. Each group meets the slices of the other labels; a block is read only where the bounds meet a window that
   isn't yet full above the block's upper bound, and scored with the anchors of these windows alone.

Each (group, slice) leaves at most k rows an anchor or window, and the best of these are taken. A task handles all
groups of its slice, so a block is read once however many anchors want it; anchors are what is copied. On vectors
without structure the bounds exclude little and all blocks of the wanted labels are read; results are the same.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
lengths have no score with each other; empty vectors score 0; equal rows count once; rows that share an id but not their
label or vector are rows of their own, never each other's positive or negative; ties go to the smaller id; components
saturate where inner products could pass 2^55 (beyond 90,000 in 64 dimensions); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loopdex.llm import files
from loopdex.llm.common import releasing, scratch, written

BITS = 4
BLOCK = 256
SLICE_BYTES, GROUP_BYTES = 16 << 20, 512 << 10
KEPT_SLICES = 4
#: Below every score.
_NONE = -(1 << 62)


def shifted_label(vec_id: Column, label: Column) -> Column:
    """The label, and where vec_id is divisible by 7 the next one of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 32-bit integers, saturated so that inner products stay below 2^55."""
    most = min(np.sqrt(2.0**55 / max(1, x.shape[1])), 2.0**31 - 1)
    return np.clip(np.floor(256 * x), -most, most).astype(np.int32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For rows of cell numbers (bits bits each): their places on the Hilbert curve, as rows of big-endian bytes."""
    rows, dims = cells.shape
    x = cells.T.astype(np.uint8).copy()  # a row a dimension
    # From axes to the transposed index: undo the rotations of each level, then Gray code.
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(set_, low, swap).astype(np.uint8)
            x[i] ^= swap if i else 0
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(rows, np.uint8)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0).astype(np.uint8)
    x ^= flip
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])  # bits, dims, rows
    return np.packbits(planes.reshape(bits * dims, rows).T, axis=1)


def _ordered(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, v, curve) of usable rows, v and curve in bytes."""
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    low, high = np.floor(256 * (low or 0.0)), np.floor(256 * (high or 0.0))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x")
            length = np.diff(x.offsets.to_numpy())
            flat, start = x.flatten().to_numpy(), np.cumsum(length) - length
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                for i in range(0, len(at), 2048):
                    part = at[i : i + 2048]
                    v = whole(flat[start[part][:, None] + np.arange(dim)].reshape(len(part), dim))
                    cells = np.clip((v - low) * (1 << BITS) / max(1.0, high - low + 1), 0, (1 << BITS) - 1).astype(np.int64)
                    curve = [c.tobytes() for c in hilbert(cells)] if dim else [b""] * len(part)
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(np.full(len(part), dim, np.int32)), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(curve, pa.binary())],
                        names=["vec_id", "label", "dim", "v", "curve"])

    return rows.mapInArrow(releasing(run), "vec_id bigint, label bigint, dim int, v binary, curve binary")


def candidates(rows: DataFrame, every: int) -> DataFrame:
    """Write the candidate blocks; (kind, label, dim, name, file, first, n, a, b): a row a slice (kind 0: row groups
    first .. of file, n blocks, a and b the zones' least and greatest), and one a group of anchors, which are the rows
    whose id is divisible by `every` (kind 1: n anchors, a their ids, b their vectors)."""
    folder = scratch(rows.sparkSession, "candidates")
    files.make(folder)
    order = ["label", "dim", "curve", "vec_id"]
    ordered = _ordered(rows).repartitionByRange(*order).sortWithinPartitions(*order, "v")

    def run(batches):
        import pyarrow as pa
        from pyarrow import parquet

        name = uuid.uuid4().hex  # an attempt has a file of its own, which only its rows name
        system, path = files.resolve(f"{folder}/{name}.parquet")
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
        sink, out, result = None, None, []
        key, ids, data, zones, anchors, groups = None, [], [], [], ([], []), 0
        last, number = None, 0

        def block():
            nonlocal ids, data, number
            v = np.frombuffer(b"".join(data), np.int32).reshape(len(ids), -1)
            out.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], schema=schema))
            zones.append((v.min(0).tobytes(), v.max(0).tobytes()) if v.shape[1] else (b"", b""))
            ids, data, number = [], [], number + 1
            if len(zones) * BLOCK * 4 * max(1, key[1]) >= SLICE_BYTES:
                slice_()

        def slice_():
            nonlocal zones
            if zones:
                result.append((0, *key, f"{name}-{number}", f"{folder}/{name}.parquet", number - len(zones), len(zones), b"".join(z[0] for z in zones), b"".join(z[1] for z in zones)))
            zones = []

        def group():
            nonlocal anchors, groups
            if anchors[0]:
                groups += 1
                result.append((1, *key, f"{name}+{groups}", None, 0, len(anchors[0]), np.array(anchors[0], np.int64).tobytes(), b"".join(anchors[1])))
            anchors = ([], [])

        def close():
            if ids:
                block()
            slice_()
            group()

        def taken():
            kinds = [pa.int8(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*result), kinds)], names=["kind", "label", "dim", "name", "file", "first", "n", "a", "b"])
            result.clear()
            return rows

        try:
            for batch in batches:
                for row in zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "vec_id", "v")]):
                    if row == last:
                        continue
                    if out is None:
                        sink = system.open_output_stream(path)
                        out = parquet.ParquetWriter(sink, schema, use_dictionary=False)
                    if key != row[:2]:
                        if key is not None:
                            close()
                        key = row[:2]
                    last = row
                    ids.append(row[2])
                    data.append(row[3])
                    if row[2] % every == 0:
                        anchors[0].append(row[2])
                        anchors[1].append(row[3])
                        if len(anchors[0]) * 4 * max(1, row[1]) >= GROUP_BYTES:
                            group()
                    if len(ids) == BLOCK:
                        block()
                if result:
                    yield taken()
            if key is not None:
                close()
        finally:
            if out is not None:
                out.close()
                sink.close()
        if result:
            yield taken()

    return written(ordered.mapInArrow(releasing(run), "kind tinyint, label bigint, dim int, name string, file string, first int, n int, a binary, b binary"), "zones")


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exactly, in the narrowest arithmetic that can't round."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (x.astype(kind) @ y.T.astype(kind)).astype(np.int64)


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors x and zones [lo, hi] the least and greatest possible scores (anchors by zones)."""
    x = x.astype(np.int64)
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


class Best:
    """The k best (score, id) of each of some lists, ties to smaller ids."""

    def __init__(self, lists: int, k: int):
        self.k, self.score, self.id = k, np.full((lists, k), _NONE), np.full((lists, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the lists `at` (one row each; _NONE: not a member) with the ids of the columns."""
        if scores.shape[1] > self.k:
            floor = np.maximum(self.score[at, -1], -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        else:
            floor = self.score[at, -1]
        i, j = np.nonzero((scores >= floor[:, None]) & (scores > _NONE))
        if not len(i):
            return
        touched = np.unique(i)
        row = np.concatenate([i, np.repeat(touched, self.k)])
        score = np.concatenate([scores[i, j], self.score[at[touched]].ravel()])
        name = np.concatenate([ids[j], self.id[at[touched]].ravel()])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        place = (np.arange(len(row)) - first)[keep]
        self.score[at[row[keep]], place], self.id[at[row[keep]], place] = score[keep], name[keep]


class _Slices:
    """Blocks of the last few slices, each read when first wanted."""

    def __init__(self):
        self.kept: dict[str, tuple] = {}

    def block(self, row, i: int) -> tuple[np.ndarray, np.ndarray]:
        from pyarrow import parquet

        if row["slice"] not in self.kept:
            while len(self.kept) >= KEPT_SLICES:
                self.kept.pop(next(iter(self.kept)))[0].close(force=True)
            system, path = files.resolve(row["file"])
            self.kept[row["slice"]] = (parquet.ParquetFile(system.open_input_file(path)), {})
        file, read = self.kept[row["slice"]]
        if i not in read:
            table = file.read_row_group(row["first"] + i)
            ids = table.column("vec_id").to_numpy()
            read[i] = ids, np.frombuffer(b"".join(table.column("v").to_pylist()), np.int32).reshape(len(ids), -1)
        return read[i]


def _meet(groups: DataFrame, slices: DataFrame, on: list[str], condition: Column | None = None) -> DataFrame:
    """Each group with each slice that has the same `on`, a row a pair; a slice's pairs are in one task, the slices
    dealt out over all."""
    count = slices.groupBy(*on).agg(F.count("*").cast("int").alias("deals"))
    left = groups.join(count, on).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    right = slices.join(count, on).withColumn("deal", F.pmod(F.xxhash64("slice"), F.col("deals")).cast("int")).drop("deals")
    pairs = left.join(right, [*on, "deal"])
    return pairs if condition is None else pairs.where(condition)


def _zones(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor vectors, least, greatest of each block) of a pair."""
    x = np.frombuffer(row["vectors"], np.int32).reshape(row["anchors"], -1)
    return x, np.frombuffer(row["lo"], np.int32).reshape(row["n"], -1), np.frombuffer(row["hi"], np.int32).reshape(row["n"], -1)


def positives(groups: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(group, anchor, rank, vec_id, score): the k best other rows of the same label of each anchor (by its place)."""

    def run(batches):
        import pyarrow as pa

        read = _Slices()
        for batch in batches:
            for row in batch.to_pylist():
                x, lo, hi = _zones(row)
                own, best = np.frombuffer(row["ids"], np.int64), Best(row["anchors"], k)
                top = bounds(x, lo, hi)[1]
                for i in np.argsort(-top.max(0), kind="stable").tolist():
                    at = np.flatnonzero(top[:, i] >= best.score[:, -1])
                    if len(at):
                        ids, v = read.block(row, i)
                        s = _product(x[at], v)
                        s[own[at][:, None] == ids[None, :]] = _NONE
                        best.add(at, s, ids)
                a, j = np.nonzero(best.score > _NONE)
                columns = [pa.array([row["group"]] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(best.id[a, j]), pa.array(best.score[a, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "anchor", "vec_id", "score"])

    found = _meet(groups, slices.drop("slice_label"), ["label", "dim"]).mapInArrow(releasing(run), "group string, anchor int, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("group", "anchor").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def negatives(groups: DataFrame, slices: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(group, anchor, anchor_id, rank, positive_id, positive_score, negative_id, negative_score): the k best rows of
    each slice in each window; groups have their anchors' positives."""

    def run(batches):
        import pyarrow as pa

        read = _Slices()
        for batch in batches:
            for row in batch.to_pylist():
                x, lo, hi = _zones(row)
                own = np.frombuffer(row["ids"], np.int64)
                anchor, rank, positive, score = (np.array([p[c] for p in row["positives"]], np.int64) for c in ("anchor", "rank", "vec_id", "score"))
                # The window's least and greatest score: low * p <= 100 * s <= high * p.
                least, most, best = -((-low * score) // 100), high * score // 100, Best(len(score), k)
                down, up = bounds(x, lo, hi)
                for i in np.argsort(-up.max(0), kind="stable").tolist():
                    at = np.flatnonzero((up[anchor, i] >= np.maximum(least, best.score[:, -1])) & (down[anchor, i] <= most) & (least <= most))
                    if not len(at):
                        continue
                    ids, v = read.block(row, i)
                    wanted, line = np.unique(anchor[at], return_inverse=True)
                    s = _product(x[wanted], v)
                    s[own[wanted][:, None] == ids[None, :]] = _NONE
                    for j in range(0, len(at), 1024):
                        part, lines = at[j : j + 1024], s[line[j : j + 1024]]
                        inside = (lines >= np.maximum(least[part], best.score[part, -1])[:, None]) & (lines <= most[part][:, None])
                        hit = np.flatnonzero(inside.any(1))
                        if len(hit):
                            best.add(part[hit], np.where(inside[hit], lines[hit], _NONE), ids)
                a, j = np.nonzero(best.score > _NONE)
                columns = [pa.array([row["group"]] * len(a), pa.string()), *[pa.array(c) for c in (anchor[a].astype(np.int32), own[anchor[a]], rank[a].astype(np.int32), positive[a], score[a], best.id[a, j], best.score[a, j])]]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "anchor", "anchor_id", "rank", "positive_id", "positive_score", "negative_id", "negative_score"])

    pairs = _meet(groups, slices, ["dim"], F.col("label") != F.col("slice_label"))
    return pairs.mapInArrow(releasing(run), "group string, anchor int, anchor_id bigint, rank int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")


def mine(df: DataFrame, vector: str = "embedding", every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose vec_id is divisible
    by `every` and each of its best rows of the same label, the best rows of other labels whose score is between low
    and high percent of the positive's."""
    zones = candidates(usable(df, vector), every)
    slices = zones.where("kind = 0").select("label", F.col("label").alias("slice_label"), "dim", F.col("name").alias("slice"), "file", "first", "n", F.col("a").alias("lo"), F.col("b").alias("hi"))
    groups = zones.where("kind = 1").select("label", "dim", F.col("name").alias("group"), F.col("n").alias("anchors"), F.col("a").alias("ids"), F.col("b").alias("vectors"))
    best = written(positives(groups, slices, n_positives), "positives")
    held = best.groupBy("group").agg(F.collect_list(F.struct("anchor", "rank", "vec_id", "score")).alias("positives"))  # a group's anchors are few
    found = negatives(groups.join(held, "group"), slices.drop("label"), n_negatives, low, high)
    place = F.row_number().over(W.partitionBy("group", "anchor", "rank").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("place", place).where(F.col("place") <= n_negatives)
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")


def sql(n_positives: int = 5, n_negatives: int = 3) -> str:
    """The same by DuckDB, from all pairs of anchors and rows."""
    return f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {n_positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {n_negatives}
"""
