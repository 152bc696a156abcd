"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; each pair verified once.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct word n-grams. Steps:

1. Sets. Documents with equal sets become one class (its smallest doc_id stands for it), so exact copies cost nothing
   further, however many there are.
2. Order. The prefix filter needs one order of all n-grams that every document uses. Here it is: n-grams whose hash is
   divisible by EVERY first, rare before common among these; then the others by hash. Documents are long enough for
   their prefix (1 - t of the set) to lie in the first part, so only that part is ever counted and shuffled; the rare
   short ones that reach into the second part send those few n-grams too. Documents under SHORT n-grams could not, so
   they are joined with the whole set as first part, in a round of their own; sizes from SHORT to SHORT / t take part
   in both, and a pair belongs to the round that its larger set names.
3. Rarity. An n-gram that only one class holds can't be shared. A class with more of those than a link allows can link
   with nothing and leaves here, before any pair exists. For this an n-gram is shuffled as eight bytes, 32 bits of its
   hash inside its part and 32 bits of its class: n-grams that fall together there only seem shared, and classes that
   fall together stay. Only survivors are read again, with exact frequencies.
4. Candidates. Prefix n-grams are the join keys. Keys held by at most PAIR_LIST classes go through a self-join with
   the length, positional and suffix filters as its condition (the suffix filter bounds the distance by the counts in
   fixed hash ranges), distinct pairs are verified. Longer lists are cut into blocks, and each pair of blocks is one
   task's matrix product: it checks the pairs whose first shared prefix n-gram is this key (so no pair twice) and
   returns a spanning forest of the links, never all pairs.
5. Components of the links, joined back to all documents through their class.

Sets are compared by 64-bit hashes of their n-grams.

Edge cases: null text and text without words: an empty set, linked with nothing, component is the own doc_id; fewer
words than n: the whole sequence is the one n-gram; rows that repeat a doc_id give a row each, and
are one node: each of their texts takes part, and what they link with is one component; a null doc_id keeps its row,
takes no part, component null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.llm import bloom
from loopdex.llm.common import releasing, written
from loopdex.llm.graph import components

#: One n-gram hash in EVERY is in the first part of the order; it must stay above the prefix share (1 - t).
EVERY = 4
SHORT = 150
PAIR_LIST = 128
BLOCK = 512
BLOCK_BYTES = 64 << 20
RANGES, FINE = 32, 512
SALTS = 16
#: n-grams of a part, and n-grams that a task deals to the parts at once.
PART_GRAMS, DEALT_GRAMS = 1 << 20, 1 << 19
#: The bits of a class that go with its n-grams.
CLASS_BITS = 31
_U = np.uint64


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: workers stay alive beside what comes next."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _light(run):
    """run (a function of mapInArrow) that leaves no freed memory in its worker, Arrow's or the C library's."""

    def wrapped(batches):
        yield from releasing(run)(batches)
        _trim()

    return wrapped


def prefix_length(n, percent: int):
    """n - ceil(t * n) + 1: two sets that link share one of their first so many n-grams, in any common order."""
    return n - (percent * n + 99) // 100 + 1


def _short_top(percent: int) -> int:
    """The largest set that a set under SHORT can link with, and so the largest of the round of short ones."""
    return SHORT * 100 // percent


def sets_of(texts, width: int):
    """For each text of an Arrow array its sorted distinct n-gram hashes."""
    from loopdex.llm.wordhash import chunks, mix, window_hashes, word_hashes

    for _, data, offs in chunks(texts):
        words, first = word_hashes(data, offs)
        grams = window_hashes(words, width)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                # A short sequence as one n-gram: its words folded by place, apart from every real n-gram.
                yield mix(window_hashes(words[a:b], int(b - a)) + _U(width - (b - a)))
            else:
                yield grams[:0]


def sent(own: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(round, n-grams that a set sends in it): round 0 for short sets, 1 for long ones."""
    n = len(own)
    out = []
    if 0 < n <= _short_top(percent):
        out.append((0, own))
    if n >= SHORT:
        first = own % _U(EVERY) == 0
        lead, rest = own[first], own[~first]
        out.append((1, np.concatenate([lead, rest[: max(0, prefix_length(n, percent) - len(lead))]])))
    return out


def _first_part(round_: Column, h: Column) -> Column:
    """Is the n-gram in the first part of the order? (The hash is unsigned in Python, signed here.)"""
    unsigned = F.pmod(h, F.lit(EVERY)) + F.when(h < 0, F.lit((1 << 64) % EVERY)).otherwise(F.lit(0))
    return (round_ == 0) | (F.pmod(unsigned, F.lit(EVERY)) == 0)


def _name(own: bytes) -> int:
    """The class of a set's bytes."""
    return int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)


def _counted(n: int, percent: int) -> tuple[bool, bool]:
    """Does a set of n n-grams count in the round of short ones, and in that of long ones?"""
    return 0 < n <= _short_top(percent), n >= SHORT


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, c, grams): c names the set; grams: how many n-grams of its first parts are counted."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n, c, grams = batch.column(0), [], [], []
            for own in sets_of(batch.column(1), width):
                short, long = _counted(len(own), percent)
                n.append(len(own))
                c.append(_name(own.tobytes()) if len(own) else None)
                grams.append(short * len(own) + (int(np.count_nonzero(own % _U(EVERY) == 0)) if long else 0))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(grams, pa.int64())], names=["doc_id", "n", "c", "grams"])

    return docs.mapInArrow(_light(run), "doc_id bigint, n bigint, c bigint, grams bigint")


def _code(c: int, r: int, bits: int) -> int:
    """What goes with the n-grams of class c in round r: the last bits of c, and r."""
    return (c & (1 << bits) - 1) << 1 | r


def _dealt(texts: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """(part, grams): the first parts of the sets of texts (text), dealt to parts by hash; grams: a sorted long an n-gram,
    32 bits of its hash above its class and round. Of an n-gram that several classes hold, two are sent by a task."""
    bits = CLASS_BITS

    def run(batches):
        import pyarrow as pa

        from loopdex.llm.wordhash import mix

        held, codes, sizes, n = [], [], [], 0

        def take(grams, code):
            nonlocal n
            held.append(grams)
            codes.append(code)
            sizes.append(len(grams))
            n += len(grams)

        def flush():
            nonlocal n
            keys = mix(np.concatenate(held))
            x = keys << _U(32) | np.repeat(np.array(codes, np.uint64), sizes)
            part = ((keys >> _U(32)) % _U(parts)).astype(np.uint32)
            for some in (held, codes, sizes):
                some.clear()
            n = 0
            order = np.lexsort((x, part))
            x, part = x[order], part[order]
            first = np.ones(len(x), bool)
            first[1:] = (x[1:] >> _U(32) != x[:-1] >> _U(32)) | (part[1:] != part[:-1])
            keep = first | np.append(first[1:], True)
            x, part = x[keep], part[keep]
            edges = np.flatnonzero(np.diff(part, prepend=part[:1] + 1))
            offsets = np.append(edges, len(x)).astype(np.int32) * 8
            grams = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            return pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int64)), grams], names=["part", "grams"])

        for batch in batches:
            for own in sets_of(batch.column(0), width):
                short, long = _counted(len(own), percent)
                c = _name(own.tobytes()) if len(own) else None
                if short:
                    take(own, _code(c, 0, bits))
                if long:  # divisible by EVERY: one more tells the round
                    take(own[own % _U(EVERY) == 0] + _U(1), _code(c, 1, bits))
                if n >= DEALT_GRAMS:
                    yield flush()
        if n:
            yield flush()

    return texts.mapInArrow(_light(run), "part bigint, grams binary")


def _alone(texts: DataFrame, width: int, percent: int, grams: int) -> DataFrame:
    """(code, alone): of each class and round (_code) the counted n-grams that no other class holds, as far as the parts
    tell: never more than there are. grams: how many n-grams texts count."""

    def only(table):
        import pyarrow as pa

        x = np.sort(np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64))
        key, code = x >> _U(32), x & _U((1 << 32) - 1)
        last = np.append(key[1:] != key[:-1], True)
        first = np.append(True, last[:-1])
        code = code[first][code[first] == code[last]].astype(np.int64)
        del x, key, first, last
        _trim()
        return pa.table({"code": pa.array(code)})

    dealt = _dealt(texts, width, percent, max(1, -(-grams // PART_GRAMS)))
    # A row an n-gram, as partial sums by part would be more the more parts there are; Spark sums those of a task.
    return dealt.groupBy("part").applyInArrow(only, "code bigint").groupBy("code").agg(F.count("*").alias("alone"))


def _whole(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, own, ranges, fine, sent, c) with the whole set in bytes, for the survivors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, own_, ranges, fine, out, c = [], [], [], [], [], []
            for own in sets_of(batch.column(1), width):
                n.append(len(own))
                own_.append(own.tobytes())
                c.append(_name(own_[-1]))
                ranges.append(_ranges(own))
                fine.append(_fine(own))
                out.append([{"r": r, "h": h.view(np.int64)} for r, h in sent(own, percent)])
            kind = pa.list_(pa.struct([("r", pa.int8()), ("h", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own_, pa.binary()), pa.array(ranges, pa.list_(pa.int32())), pa.array(fine), pa.array(out, kind), pa.array(c, pa.int64())], names=["doc_id", "n", "own", "ranges", "fine", "sent", "c"])

    return docs.mapInArrow(_light(run), "doc_id bigint, n bigint, own binary, ranges array<int>, fine binary, sent array<struct<r:tinyint,h:array<bigint>>>, c bigint")


def _links(o, na, nb, percent: int):
    return 100 * o >= percent * (na + nb - o)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(r, doc_id, n, alone, prefix): each survivor's prefix in rare-first order, without the n-grams that no other
    survivor holds, of which there are `alone` before it."""
    rows = sets.select("doc_id", "n", F.inline("sent")).select("doc_id", "n", "r", F.explode("h").alias("h"))
    rows = rows.withColumn("lead", _first_part(F.col("r"), F.col("h")))
    # A table of its own, so that adaptive execution can split the rows of an n-gram that many documents hold.
    often = written(rows.groupBy("r", "h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    rows = rows.join(often, ["r", "h"], "left")
    place = F.struct((~F.col("lead")).cast("int").alias("part"), F.when(F.col("lead"), F.col("df")).otherwise(0).alias("df"), "h")
    held = F.col("df").isNotNull() | ~F.col("lead")
    by_doc = rows.groupBy("doc_id", "n", "r").agg(F.count_if(~held).cast("int").alias("alone"), F.sort_array(F.collect_list(F.when(held, place))).alias("held"))
    by_doc = by_doc.withColumn("left", F.expr(f"n - (({percent} * n + 99) div 100) + 1 - alone").cast("int")).where("left > 0 AND size(held) > 0")
    return by_doc.select("r", "doc_id", "n", "alone", F.transform(F.slice("held", 1, F.col("left")), lambda x: x["h"]).alias("prefix"))


def _ranges(own: np.ndarray) -> list[int]:
    """How many n-grams of a set lie in each of RANGES equal ranges of the hash."""
    return np.bincount((own >> _U(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES).tolist()


def _fine(own: np.ndarray) -> bytes:
    """The same over FINE ranges, a byte each (at most 255: that only weakens the bound)."""
    counts = np.bincount((own >> _U(64 - FINE.bit_length() + 1)).astype(np.int64), minlength=FINE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the suffix filter again over fine ranges (some hundred bytes a document), then the
    whole sets of those that pass."""

    def both(pairs, *columns, side=lambda x: sets):
        a = side("a").select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
        b = side("b").select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
        return pairs.join(a, "a").join(b, "b").select("a", "b", *[f"{c}_{x}" for c in columns for x in "ab"])

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int16) for k in ("fine_a", "fine_b"))
            apart = np.abs(x - y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)))

    def linked(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(_links(int((y[at] == x).sum()), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(both(pairs, "n", "fine").mapInArrow(_light(near), "a bigint, b bigint"), "pairs")

    def wanted(x):
        """The sets that some pair has on this side, and few others: whole sets are large, and most are in no pair."""
        ids = written(pairs.select(F.col(x).alias("doc_id")).distinct(), "wanted")
        return bloom.with_answer(sets.select("doc_id", "own"), "doc_id", bloom.build(ids, "doc_id", ids.count()), "maybe").where("maybe")

    return both(pairs, "own", side=wanted).mapInArrow(_light(linked), "a bigint, b bigint")


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of links between rows a and b: each component's smallest id with every other."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(int(min(ids[find(i)], ids[i])), int(max(ids[find(i)], ids[i]))) for i in range(len(ids)) if find(i) != i]


def _shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections: a product of 0/1 matrices over the values that several sets hold."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    if not sets:
        return total
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = np.bincount(column, minlength=len(values)) > 1
    new = np.cumsum(often) - 1
    row, column = row[often[column]], new[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(often.sum()), width):
        i, j = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[i:j], column[i:j] - start] = 1
        total += part @ part.T
    return total


def _blocks(postings: DataFrame, size: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside long lists: a grid of blocks, one task a pair of blocks."""
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = postings.join(size.select("r", "h", blocks.alias("blocks")), ["r", "h"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    rows = rows.join(prefixes.select("doc_id", "r", "prefix"), ["doc_id", "r"])
    top = _short_top(percent)

    def mask(key, pdf):
        """The pairs of rows that this key and these blocks have to check."""
        n, place, block = (pdf[k].to_numpy() for k in ("n", "place", "block"))
        r, _, i, j = key
        # Length and positional filters; across blocks only pairs of the two.
        low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
        rest = np.minimum.outer(n - place, n - place)
        ok = (100 * low >= percent * high) & ((100 + percent) * rest >= percent * (low + high)) & ((high <= top) == (r == 0))
        ok &= np.triu(np.ones_like(ok), 1)
        if i != j:
            ok &= block[:, None] != block[None, :]
        if ok.any():  # a prefix n-gram shared before this one: another key has the pair
            ok &= _shared([np.asarray(x, dtype=np.int64)[:k] for x, k in zip(pdf["prefix"], pdf["i_at"])]) == 0
        return ok

    def needed(key, pdf):
        ok = mask(key, pdf)
        return pdf[ok.any(0) | ok.any(1)]

    def linked(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        ids, n, ok = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy(), mask(key, pdf)
        o = _shared([np.frombuffer(x, np.uint64) for x in pdf["own"]]).astype(np.int64)
        a, b = np.nonzero(ok & _links(o, n[:, None], n[None, :], percent))
        found = pd.DataFrame(_forest(a, b, ids), columns=["a", "b"], dtype="int64")
        del o, ok
        _trim()
        return found

    cell = ["r", "h", "i", "j"]
    rows = rows.select(*cell, "doc_id", "n", "place", "i_at", "block", "prefix")
    # Most keys are left with few pairs, as near copies meet in their rarest keys: whole sets go only where they are used.
    rows = written(rows.groupBy(*cell).applyInPandas(needed, rows.schema), "needed")
    return rows.join(sets.select("doc_id", "own"), "doc_id").groupBy(*cell).applyInPandas(linked, "a bigint, b bigint")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the sets (doc_id, n, own, sent): every link of a pair list, and a spanning forest of the
    links of each pair of blocks, so that all linked sets are connected."""
    prefixes = written(_prefixes(sets, percent), "prefixes")
    postings = prefixes.select("r", "doc_id", "n", "alone", F.posexplode("prefix").alias("i_at", "h")).withColumn("place", F.col("alone") + F.col("i_at"))
    size = written(postings.groupBy("r", "h").agg(F.count("*").alias("count"), F.sum(F.col("n") * 8).alias("bytes")).where("count > 1"), "lists")
    kept = postings.join(size.where(F.col("count") <= PAIR_LIST).select("r", "h"), ["r", "h"], "left_semi")
    kept = written(kept.join(sets.select("doc_id", "ranges"), "doc_id"), "short-lists")
    a, b = (kept.select("r", "h", *[F.col(k).alias(f"{k}_{s}") for k in ("doc_id", "n", "place", "ranges")]) for s in "ab")
    n, low, high = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    pairs = a.join(b, ["r", "h"]).where(
        (F.col("doc_id_a") < F.col("doc_id_b")) & (100 * low >= percent * high) & ((high <= _short_top(percent)) == (F.col("r") == 0))
        & ((100 + percent) * rest >= percent * n) & ((100 + percent) * (n - apart) >= 2 * percent * n))
    pairs = pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    many = size.where(F.col("count") > PAIR_LIST)
    return _verified(pairs, sets, percent).union(_blocks(postings, many, prefixes, sets, percent))


def _nodes(reps: DataFrame) -> DataFrame:
    """reps with the node of each class: its rep, or where classes share that, for all but one of them a number above
    it (an id is the least of its component, then, as the rep is in it)."""
    first = reps.groupBy("rep").agg(F.min("c").alias("first"))
    high = F.when(F.col("rep") < 1 << 62, F.col("c").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    high = high.otherwise(F.col("rep") + F.pmod(F.col("c"), F.greatest(F.lit((1 << 63) - 1) - F.col("rep"), F.lit(1))) + F.when(F.col("rep") < (1 << 63) - 1, 1).otherwise(0))
    return reps.join(first, "rep").withColumn("node", F.when(F.col("c") == F.col("first"), F.col("rep")).otherwise(high)).drop("first")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = written(_classes(docs, width, percent), "classes")
    known = all_.where("doc_id IS NOT NULL AND c IS NOT NULL")
    # Copies send the same n-grams under the same class, so an n-gram is shared when two classes send it.
    grams = known.agg(F.sum("grams")).first()[0] or 0
    alone = _alone(docs.where("doc_id IS NOT NULL").select("text"), width, percent, grams)
    reps = written(known.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")), "reps")
    rounds = reps.withColumn("r", F.explode(F.expr(f"filter(array(0, 1), r -> (r = 0 AND n <= {_short_top(percent)}) OR (r = 1 AND n >= {SHORT}))")))
    rounds = rounds.withColumn("code", F.shiftleft(F.col("c").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)), 1) + F.col("r"))
    # Classes of one code took each other's n-grams for their own, so that their counts say nothing.
    several = rounds.groupBy("code").agg(F.count("*").alias("classes")).where("classes > 1")
    rounds = rounds.join(alone, "code", "left").join(several, "code", "left")
    rounds = rounds.where(f"classes IS NOT NULL OR coalesce(alone, 0) <= n - (({percent} * n + 99) div 100)")
    rounds = written(rounds.select("c", "rep"), "rounds")
    survivors = written(rounds.select(F.col("rep").alias("doc_id")).distinct(), "survivors")
    # Few texts pass the broadcast Bloom filter of the survivors' ids, and only those are shuffled to the exact join.
    texts = bloom.with_answer(docs, "doc_id", bloom.build(survivors, "doc_id", survivors.count()), "maybe").where("maybe").drop("maybe")
    texts = texts.join(survivors, "doc_id", "left_semi")
    # Ids whose rows are of several classes: each class has a set of its own, and the id is an edge between them.
    ids = known.groupBy("doc_id").agg(F.min("c").alias("least"), F.max("c").alias("last")).where("least < last").select("doc_id", "least")
    ids = written(ids, "shared-ids")
    if ids.limit(1).count():
        reps = written(_nodes(reps), "nodes")
        sets = _whole(texts.dropDuplicates(["doc_id", "text"]), width, percent)
        own = reps.select("c", F.col("node").alias("named")).join(rounds.select("c").distinct(), "c", "left_semi")
        sets = sets.join(own, "c").dropDuplicates(["c"]).withColumn("doc_id", F.col("named")).drop("c", "named")
        edges = known.join(ids, "doc_id").where("c <> least").select("least", "c").distinct()
        a, b = (reps.select(F.col("c").alias(k), F.col("node").alias(x)) for k, x in (("least", "a"), ("c", "b")))
        found = links(written(sets, "sets"), percent).union(edges.join(a, "least").join(b, "c").select("a", "b"))
    else:
        reps = reps.withColumn("node", F.col("rep"))
        found = links(written(_whole(texts.dropDuplicates(["doc_id"]), width, percent), "sets"), percent)
    group = components(found).withColumnRenamed("node", "linked")
    # Back to the documents: classes with copies or links; the salt deals out a class that holds many of the rows.
    named = reps.join(group, reps.node == group.linked, "left").select("c", F.coalesce("component", "rep").alias("component"), "copies", "linked")
    named = named.where("copies > 1 OR linked IS NOT NULL").select("c", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = all_.select("doc_id", "n", "c", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(named, ["c", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows that repeat a doc_id count once
    (the one with the greatest text, in byte order), null ids stay."""
    found = near_duplicates(docs, width, percent)
    lost = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(lost, "doc_id", "left_anti")
    rest = [c for c in kept.columns if c not in ("doc_id", "text")]
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
    return one.unionByName(kept.where("doc_id IS NULL"))
