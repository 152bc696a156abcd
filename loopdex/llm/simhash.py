"""SimHash near-duplicates: segment-popcount embedding, a grid range join under Manhattan distance, exact verification.

A text's fingerprint has a bit set where more than half of its word n-grams' XXH64 hashes have it, repeats counted. Two
fingerprints link when they differ in at most `bits` bits. Steps:

1. Equal fingerprints become one node (the smallest doc_id that has one stands for it), so exact copies cost nothing
   further, however many there are.
2. Embedding. A fingerprint is cut into segments of SEGMENT bits, and the numbers of bits set in them are its point.
   The Manhattan distance of two points is never above the number of bits that differ.
3. Grid. The segments are dealt to `parts` slices. Points at distance `bits` in all are at most bits // parts apart in
   one slice, so each slice has a grid whose cells are its counts, and a range join of that radius: a point goes to
   its own cell and to those cells within the radius that come after it in order (a pair meets in the later cell).
4. Cells of one row are dropped, larger ones are compared, all rows of a cell at once; a cell with over LIST rows is
   cut into blocks, a task a pair of blocks. Exact: pairs whose fingerprints differ in more bits fall here.
5. Each comparison returns a spanning forest of its links, never all of them; components, joined back to all rows.

The cells grow with the number of distinct fingerprints: 3 slices compare about one pair in a thousand of evenly spread
ones and copy each some 30 times; 2 slices compare a tenth of that for ten times the copies, the better trade from some
hundred million distinct fingerprints on. All choices give the same result.

Edge cases: null text and text without words: fingerprint zero, linked like any other; fewer words than n: the whole
sequence is the one n-gram; rows that repeat a doc_id give a row each and are one node: each of their texts takes part,
and what they link with is one component; a null doc_id keeps its row, takes no part, component null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.llm.common import releasing, written
from loopdex.llm.graph import components

SEED = 42
SEGMENT, PARTS = 2, 3
LIST = 4096
SMALL_CELL = 48
SALTS = 16
#: n-grams hashed at once.
STRIDE = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of a UTF-8 text, A-Z lower-cased; its words are what bytes.split() gives."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = end[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, STRIDE):
        spans = zip(begin[i : min(n, i + STRIDE)].tolist(), last[i : i + STRIDE].tolist())
        h = np.array([xxh64_intdigest(data[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, f): the fingerprint of each text, as a signed 64-bit number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            f = np.array([fingerprint(x.as_py(), width) for x in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "f"])

    return docs.mapInArrow(releasing(run), "doc_id bigint, f bigint")


def slices(parts: int, segment: int) -> list[list[int]]:
    """The masks of the segments of each slice: all 64 bits, each once."""
    masks = [((1 << min(segment, 64 - i)) - 1) << i for i in range(0, 64, segment)]
    return [masks[k::parts] for k in range(parts)]


def points(f: np.ndarray, masks: list[int]) -> np.ndarray:
    """The bits set in each segment, a row a fingerprint."""
    return np.stack([np.bitwise_count(f & _U(m)) for m in masks], axis=1).astype(np.int64)


def cells(f: np.ndarray, masks: list[int], radius: int):
    """(rows of f, keys): every cell that a fingerprint goes to in one slice; its own cell first, then those within
    the radius that are after its own in order."""
    top = np.array([m.bit_count() for m in masks])
    scale = np.cumprod(np.concatenate([[1], top[:-1] + 1]))
    x = points(f, masks)
    yield np.arange(len(f)), x @ scale

    def steps(left: int, dims: int):
        """Moves (dim, step) of at most `left` in all over at most that many dimensions."""
        for n in range(1, min(left, dims) + 1):
            for at in combinations(range(dims), n):
                yield from ((at, s) for s in _sizes(n, left))

    for at, step in steps(radius, len(masks)):
        if step[-1] < 0:  # the highest dimension that moves decides the order
            continue
        moved = x[:, at] + np.array(step)
        rows = np.flatnonzero(((moved >= 0) & (moved <= top[list(at)])).all(1))
        yield rows, x[rows] @ scale + np.array(step) @ scale[list(at)]


def _sizes(n: int, left: int):
    """Tuples of n steps, none zero, of at most `left` in all."""
    if n == 0:
        yield ()
        return
    for first in range(-left, left + 1):
        if first and left - abs(first) >= n - 1:
            yield from ((first, *rest) for rest in _sizes(n - 1, left - abs(first)))


def _placed(nodes: DataFrame, bits: int, parts: int, segment: int) -> DataFrame:
    """(part, cell, f, rep, own) of nodes (f, rep): the cells of every node; own: is it the node's own cell?"""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 2048):
                piece = batch.slice(i, 2048)
                f, rep = (piece.column(k).to_numpy() for k in ("f", "rep"))
                for part, masks in enumerate(slices(parts, segment)):
                    for k, (rows, cell) in enumerate(cells(f.view(np.uint64), masks, bits // parts)):
                        if len(rows):
                            cols = [pa.array(np.full(len(rows), part, np.int8)), pa.array(cell), pa.array(f[rows]), pa.array(rep[rows]), pa.array(np.full(len(rows), k == 0))]
                            yield pa.RecordBatch.from_arrays(cols, names=["part", "cell", "f", "rep", "own"])

    return nodes.select("f", "rep").mapInArrow(releasing(run), "part tinyint, cell bigint, f bigint, rep bigint, own boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (a, b)."""
    root: dict[int, int] = {}
    keep: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while (up := root.get(p, p)) != p:
            root[p] = p = root.get(up, up)
        while (up := root.get(q, q)) != q:
            root[q] = q = root.get(up, up)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep[0].append(x)
            keep[1].append(y)
    return keep


def _near(f, i, j, bits):
    ok = np.bitwise_count(f[i] ^ f[j]) <= bits
    return i[ok], j[ok]


def linked(key: np.ndarray, f: np.ndarray, rep: np.ndarray, own: np.ndarray, block: np.ndarray, bits: int):
    """Links (a, b) among rows whose keys are equal, keys in order: rows of one cell, one of them at least in its own;
    in a pair of blocks (block >= 0) only across them. A spanning forest of each large cell, all links of a small one."""
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(change)
    small = np.repeat(length <= SMALL_CELL, length)
    a, b = [], []
    at = np.flatnonzero(small)
    for step in range(1, SMALL_CELL):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        i = at[(own[at] | own[at + step]) & ((block[at] < 0) | (block[at] != block[at + step]))]
        i, j = _near(f, i, i + step, bits)
        a += rep[i].tolist()
        b += rep[j].tolist()
    for start, n in zip(change[:-1][length > SMALL_CELL].tolist(), length[length > SMALL_CELL].tolist()):
        x, y = [], []
        for lo in range(start, start + n, 512):
            rows = np.arange(lo, min(lo + 512, start + n))
            i, j = np.nonzero(np.bitwise_count(f[rows][:, None] ^ f[lo : start + n][None, :]) <= bits)
            i, j = rows[i], lo + j
            ok = (i < j) & (own[i] | own[j]) & ((block[i] < 0) | (block[i] != block[j]))
            p, q = _forest(rep[i[ok]], rep[j[ok]])
            x += p
            y += q
        p, q = _forest(np.array(x, np.int64), np.array(y, np.int64))
        a += p
        b += q
    return a, b


def links(nodes: DataFrame, bits: int, parts: int = PARTS, segment: int = SEGMENT) -> DataFrame:
    """Edges (a, b) between nodes (f, rep) that connect all those with at most `bits` differing bits."""
    placed = written(_placed(nodes, bits, parts, segment), "cells")
    # A cell is worth comparing when two rows meet in it, one of them at least in its own cell.
    lists = placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 AND any_own")
    lists = written(lists.select("part", "cell", F.ceil(F.col("n") / LIST).cast("int").alias("blocks")), "lists")
    rows = placed.join(lists, ["part", "cell"])
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).otherwise(0)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.withColumn("block", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("block")))
    # One 64-bit name for (part, cell, i, j): rows of different cells that share it are compared too, and verified.
    rows = rows.select(F.xxhash64("part", "cell", "i", "j").alias("key"), "f", "rep", "own", "block")
    rows = rows.repartition("key").sortWithinPartitions("key", "f")

    def run(batches):
        import pyarrow as pa

        names, rest = ["key", "f", "rep", "own", "block"], None

        def result(columns):
            key, f, rep, own, block = columns
            a, b = linked(key, f.view(np.uint64), rep, own, block, bits)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            if not len(columns[0]):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [x[cut:] for x in columns]
            if cut:
                yield result([x[:cut] for x in columns])
        if rest is not None:
            yield result(rest)

    return rows.mapInArrow(releasing(run), "a bigint, b bigint").where("a <> b")


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 4, parts: int = PARTS, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, f, fingerprint, component_id) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = written(fingerprints(docs, width), "fingerprints")
    known = all_.where("doc_id IS NOT NULL")
    reps = written(known.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    # An id whose rows have several fingerprints links what stands for them.
    several = known.groupBy("doc_id").agg(F.min("f").alias("least"), F.max("f").alias("last")).where("least < last").select("doc_id")
    same = known.join(several, "doc_id").join(reps, "f").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    group = components(links(reps, bits, parts, segment).union(same)).withColumnRenamed("node", "linked")
    # Back to all rows: fingerprints with copies or links; the salt deals out one that holds many of the rows.
    named = reps.join(group, reps.rep == group.linked, "left").where("copies > 1 OR linked IS NOT NULL")
    named = named.select("f", F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = all_.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = salted.join(named, ["f", "salt"], "left")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return rows.select("doc_id", "f", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
