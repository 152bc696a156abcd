"""Conversation prefix trie over rebuilt conversations, by composable monoid fingerprints.

Every conversation c is rebuilt as the first h turns of its base (another conversation, named by c) and its own turns
after its first h. No rebuilt text exists at any time:

1. Stored turns. Each turn is a digest of its role and text. Turns are range-sorted by (conversation, turn, digest), so a
   conversation of any length is spread over partitions, and packed into blocks of at most BLOCK digests.
2. Monoid. A turn with digest t is the affine map x -> B x + t modulo a prime, in four lanes; a run of turns is the
   product of its maps, (B^n, sum). Products of blocks are combined by a prefix scan over one short row a block, and a
   rebuilt prefix is the product of the base's head and the own segment, taken out of the own prefix products: for
   every own turn after the h-th it costs one multiplication, wherever the base is stored.
3. Nodes. A prefix is named by (depth, product). A node is the group of the conversations that have it.
4. Equality. In a node all last digests must be equal, and a map can be undone, so by induction over the depth all
   digests are. Members that point to one stored turn are equal by that reference; where references differ, the stored
   turns of these digests are compared by role and text. If any comparison fails, everything is computed again with
   other digests, so results are exact.
5. Subtrees. A node is owned by its smallest member. What a conversation owns is the end of its path, from some depth s
   on; so a node has as many children as members that own the next one, as many leaves below it as members that own a
   childless end, and it saves the turns from its depth to s - 1 of each member. All are sums over members.
6. Ends. Ids are joined in order within runs of RUN ids, and a streaming SHA-256 per node goes over these runs in order.

Edge cases: null role or text is empty; turns are ordered null first, those of equal turn by the MD5 of role and text,
repeated rows are turns each; rows with a null conv_id belong to no conversation; a base that isn't there is empty; an
empty table has no node (not even a root); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.llm import bloom
from loopdex.llm.common import releasing, written

#: base of c: c - c % SPAN; the head has crc32(c) % HEADS turns.
SPAN, HEADS = 100, 6
BLOCK = 512
RUN_BITS = 12
SALTS = 16
P = (1 << 31) - 1
BASES = (1103515245, 1299709423, 742938285, 1640531527)
_INVERSE = [pow(b, -1, P) for b in BASES]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: Column) -> Column:
    """h of a conversation."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _digest(salt: int, bits: int) -> Column:
    """16 bytes of a turn; up to 16 bits, all but so many of them are zero (to test step 4)."""
    text = F.concat(F.lit(str(salt) if salt else ""), F.col("role"), F.lit("\x00"), F.col("text"))
    name = F.md5(text.cast("binary"))
    if bits <= 16:
        part = F.conv(F.left(name, F.lit(4)), 16, 10).cast("int").bitwiseAND(F.lit((1 << bits) - 1))
        name = F.lpad(F.hex(part), 32, "0")
    return F.unhex(name)


def _powers(base: list[int], n: int) -> np.ndarray:
    """The powers 0 .. n of each lane's base."""
    out = np.ones((n + 1, 4), np.int64)
    b = np.array(base, np.int64)
    for i in range(1, n + 1):
        out[i] = out[i - 1] * b % P
    return out


_UP, _DOWN = _powers(list(BASES), BLOCK + HEADS), _powers(_INVERSE, BLOCK + HEADS)


def _lanes(digests: bytes) -> np.ndarray:
    """A row of four lane values for each 16-byte digest."""
    return np.frombuffer(digests, "<u4").reshape(-1, 4).astype(np.int64) % P


def _prefixes(lanes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products of each block's first 1, 2, .. turns, places 1, 2, .. in the block), for blocks of n turns each."""
    start = np.cumsum(n) - n
    place = np.arange(len(lanes)) - np.repeat(start, n) + 1
    total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(lanes * _DOWN[place] % P, axis=0)])
    inside = total[1:] - np.repeat(total[start], n, axis=0)
    return inside % P * _UP[place] % P, place


def _pack(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four lanes as two numbers."""
    return products[:, 0] << 31 | products[:, 1], products[:, 2] << 31 | products[:, 3]


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, part, seq, n, digests, lens): the turns in order, in blocks; order of the blocks: part, seq."""
    order = ["conv_id", "turn", "tie" if "tie" in turns.columns else "digest"]  # nulls first
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, rest = TaskContext.get().partitionId(), 0, None

        def block(ids, digests, lens, cuts):
            nonlocal seq
            at = [(a, min(a + BLOCK, end)) for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for a in range(begin, end, BLOCK)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids[[a for a, _ in at]]), pa.array(np.full(len(at), part, np.int32)), pa.array(np.arange(seq, seq + len(at))),
                 pa.array(np.array([b - a for a, b in at], np.int32)), pa.array([digests[16 * a : 16 * b] for a, b in at], pa.binary()), pa.array([lens[a:b].tobytes() for a, b in at], pa.binary())],
                names=["conv_id", "part", "seq", "n", "digests", "lens"])
            seq += len(at)
            return out

        for batch in batches:
            ids, lens = batch.column("conv_id").to_numpy(), batch.column("len").to_numpy().astype(np.int32)
            digests = b"".join(batch.column("digest").to_pylist())
            if rest is not None:
                ids, digests, lens = np.concatenate([rest[0], ids]), rest[1] + digests, np.concatenate([rest[2], lens])
            if not len(ids):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            # The last conversation may go on: its unfinished block waits for the next batch.
            wait = int(cuts[-2] + (cuts[-1] - cuts[-2]) // BLOCK * BLOCK)
            rest = ids[wait:], digests[16 * wait :], lens[wait:]
            if wait:
                yield block(ids, digests, lens, np.unique(np.minimum(cuts, wait)))
        if rest is not None and len(rest[0]):
            ids = rest[0]
            yield block(*rest, np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))

    return rows.mapInArrow(releasing(run), "conv_id bigint, part int, seq bigint, n int, digests binary, lens binary")


_OWN = "conv_id bigint, part int, seq bigint, start bigint, chars bigint, product array<bigint>, total bigint, total_chars bigint, head binary, head_lens array<bigint>"


def _scan(blocks: DataFrame) -> DataFrame:
    """The prefix scan: for each block the turns, characters and product before it; with a conversation's last block
    also its totals and its first HEADS - 1 digests and lengths. One short row a block passes through it, and each task
    keeps the state of one conversation."""
    keep = HEADS - 1
    head = F.substring("digests", 1, 16 * keep)
    lens = F.substring("lens", 1, 4 * keep)

    def short(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            if not len(n):
                continue
            products, _ = _prefixes(_lanes(b"".join(batch.column("digests").to_pylist())), n)
            chars = np.add.reduceat(np.frombuffer(b"".join(batch.column("lens").to_pylist()), np.int32).astype(np.int64), np.cumsum(n) - n)
            columns = [batch.column(k) for k in ("conv_id", "part", "seq", "n", "head", "lens4")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chars), pa.array(list(products[np.cumsum(n) - 1]), pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "n", "head", "lens4", "chars", "product"])

    rows = blocks.withColumns({"head": head, "lens4": lens}).mapInArrow(releasing(short), "conv_id bigint, part int, seq bigint, n int, head binary, lens4 binary, chars bigint, product array<bigint>")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "part", "seq", "start", "chars", "product", "total", "total_chars", "head", "head_lens"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        last, total, chars, product, first, first_lens = None, 0, 0, [0] * 4, b"", b""

        def closed():
            return [*last, total, chars, first, np.frombuffer(first_lens, np.int32).tolist()]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last is not None and last[0] == r["conv_id"]:
                    out.append([*last, None, None, None, None])
                else:
                    if last is not None:
                        out.append(closed())
                    total, chars, product, first, first_lens = 0, 0, [0] * 4, b"", b""
                last = [r["conv_id"], r["part"], r["seq"], total, chars, product]
                product = [(x * pow(b, r["n"], P) + y) % P for x, b, y in zip(product, BASES, r["product"])]
                total, chars = total + r["n"], chars + r["chars"]
                if len(first) < 16 * keep:
                    first, first_lens = (first + r["head"])[: 16 * keep], (first_lens + r["lens4"])[: 4 * keep]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), kinds)], names=names)

    return rows.mapInArrow(releasing(run), _OWN)


_STEP = "struct<d:int,f1:bigint,f2:bigint,g1:bigint,g2:bigint,src:bigint,place:bigint,before:bigint>"


def _steps(rows: list[tuple[np.ndarray, ...]], lengths: np.ndarray):
    """Arrow lists of steps (d, f1, f2, g1, g2, src, place, before), `lengths` of them a row."""
    import pyarrow as pa

    names = ["d", "f1", "f2", "g1", "g2", "src", "place", "before"]
    arrays = [pa.array(np.concatenate(c).astype(np.int32 if k == "d" else np.int64)) for k, c in zip(names, zip(*rows))]
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.StructArray.from_arrays(arrays, names=names))


def _info(own: DataFrame) -> DataFrame:
    """A row a conversation: its totals and head, and the head of its base, as many turns of it as it takes (k)."""
    one = own.where("total IS NOT NULL").select("conv_id", "total", "total_chars", "head", "head_lens")
    base = one.where(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"), F.col("head_lens").alias("base_lens"))
    rows = one.withColumn("h", head_length(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % SPAN)
    rows = rows.join(base, "base", "left")
    return rows.withColumn("k", F.least("h", F.coalesce(F.size("base_lens"), F.lit(0))))


def _paths(blocks: DataFrame, own: DataFrame, info: DataFrame) -> DataFrame:
    """(m, depth, chars, steps): the path of each rebuilt conversation m through the trie in pieces: the root with the
    base's head, and a piece for each block of own turns after the head. depth, chars: turns and characters in all."""
    whole = {"depth": F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))}
    info = info.withColumns(whole)

    def sums(lens):
        return [0, *np.cumsum(np.asarray(lens, np.int64)).tolist()]

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            chars, rows, lengths = [], [], []
            for r in batch.to_pylist():
                k, base, own = r["k"], sums(r["base_lens"] or []), sums(r["head_lens"])
                chars.append(base[k] + max(0, r["total_chars"] - own[min(r["h"], len(own) - 1)]))
                lanes = _lanes((r["base_head"] or b"")[: 16 * k])
                product = np.concatenate([np.zeros((1, 4), np.int64), _prefixes(lanes, np.array([k]))[0]])
                g = np.concatenate([np.zeros((1, 2), np.int64), np.frombuffer((r["base_head"] or b"")[: 16 * k], "<i8").reshape(-1, 2)])
                src = np.full(k + 1, r["base"])
                src[0] = 0
                rows.append((np.arange(k + 1), *_pack(product), g[:, 0], g[:, 1], src, np.arange(k + 1), np.array([0, *base[:k]])))
                lengths.append(k + 1)
            if lengths:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(chars, pa.int64()), _steps(rows, np.array(lengths))], names=["m", "depth", "chars", "steps"])

    def tails(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            n, start, h, k = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "start", "h", "k"))
            raw = b"".join(batch.column("digests").to_pylist())
            inside, place = _prefixes(_lanes(raw), n)
            lens = np.frombuffer(b"".join(batch.column("lens").to_pylist()), np.int32).astype(np.int64)
            upto = np.cumsum(lens)
            upto -= np.repeat(upto[np.cumsum(n) - n] - lens[np.cumsum(n) - n], n)
            # The own prefix product at each turn; then the first h turns taken out and the base's first k put in.
            before = np.array(batch.column("product").to_pylist(), np.int64).reshape(-1, 4)
            change, base_chars, own_chars, shift = [], [], [], []
            for r in batch.select(["head", "head_lens", "base_head", "base_lens", "h", "k", "start"]).to_pylist():
                x, y = _lanes((r["base_head"] or b"")[: 16 * r["k"]]), _lanes(r["head"][: 16 * r["h"]])
                x = _prefixes(x, np.array([len(x)]))[0][-1] if len(x) else np.zeros(4, np.int64)
                y = _prefixes(y, np.array([len(y)]))[0][-1] if len(y) else np.zeros(4, np.int64)
                change.append((x - y) % P)
                base_chars.append(sum((r["base_lens"] or [])[: r["k"]]))
                own_chars.append(sum(r["head_lens"][: r["h"]]))
                shift.append([pow(b, r["start"], P) for b in BASES] if r["start"] else [1] * 4)
            up = _UP[place]
            own_prefix = (np.repeat(before, n, axis=0) * up + inside) % P
            power = np.repeat(np.array(shift, np.int64) * _DOWN[h] % P, n, axis=0) * up % P
            product = (own_prefix + np.repeat(np.array(change, np.int64), n, axis=0) * power) % P
            at = np.repeat(start, n) + place
            take = at > np.repeat(h, n)
            g = np.frombuffer(raw, "<i8").reshape(-1, 2)
            chars_before = np.repeat(batch.column("chars_before").to_numpy() + np.array(base_chars) - np.array(own_chars), n) + upto - lens
            src = np.repeat(batch.column("conv_id").to_numpy(), n)
            columns = ((at - np.repeat(h - k, n)), *_pack(product), g[:, 0], g[:, 1], src, at, chars_before)
            lengths = np.add.reduceat(take.astype(np.int64), np.cumsum(n) - n)
            steps = _steps([tuple(c[take] for c in columns)], lengths)
            all_chars = batch.column("total_chars").to_numpy() + np.array(base_chars) - np.array(own_chars)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(all_chars), steps], names=["m", "depth", "chars", "steps"])

    kind = f"m bigint, depth bigint, chars bigint, steps array<{_STEP}>"
    first = info.select("conv_id", "total_chars", "head_lens", "base", "base_head", "base_lens", "h", "k", F.col("depth").cast("long").alias("depth")).mapInArrow(releasing(heads), kind)
    offsets = own.select("conv_id", "part", "seq", "start", F.col("chars").alias("chars_before"), "product")
    rows = blocks.join(offsets, ["conv_id", "part", "seq"]).join(info, "conv_id").where(F.col("start") + F.col("n") > F.col("h"))
    rows = rows.select("conv_id", "n", "start", "h", "k", "digests", "lens", "product", "head", "head_lens", "base_head", "base_lens", "chars_before", "total_chars", F.col("depth").cast("long").alias("depth"))
    return first.union(rows.mapInArrow(releasing(tails), kind))


def _differ(nodes: DataFrame, turns: DataFrame) -> bool:
    """Step 4: is there a node whose members' last turns differ?"""
    shared = nodes.where("n_convs > 1 AND d > 0")
    if shared.where("g1 <> g1_last OR g2 <> g2_last").limit(1).count():
        return True
    apart = shared.where("src <> src_last OR place <> place_last").select("g1", "g2").distinct()
    apart = written(apart.select(F.struct("g1", "g2").alias("g")), "digests-to-compare")
    n = apart.count()
    if not n:
        return False
    # The digest's halves as the little-endian numbers that the steps have.
    halves = lambda i: F.conv(F.concat(*[F.substring(F.hex("digest"), i + 14 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long")
    rows = turns.withColumn("g", F.struct(halves(1).alias("g1"), halves(17).alias("g2")))
    rows = bloom.with_answer(rows, "g", bloom.build(apart, "g", n), "maybe").where("maybe").join(apart, "g", "left_semi")
    ends = rows.groupBy("g").agg(*[f(c).alias(f"{k}_{c}") for c in ("role", "text") for k, f in (("min", F.min), ("max", F.max))])
    return ends.where("min_role <> max_role OR min_text <> max_text").limit(1).count() > 0


def _ends(paths: DataFrame) -> DataFrame:
    """(d, f1, f2, ends_sha256) of the nodes where conversations end."""
    last = paths.select("m", "depth", F.get("steps", F.size("steps") - 1).alias("end")).where("end.d = depth")
    runs = last.groupBy("end.d", "end.f1", "end.f2", F.shiftright("m", RUN_BITS).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x.cast("string")), ",").alias("ids"))
    runs = runs.repartition("d", "f1", "f2").sortWithinPartitions("d", "f1", "f2", "run")

    def run(batches):
        import pyarrow as pa

        key, sha = None, None

        def result(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["d", "f1", "f2", "ends_sha256"])

        for batch in batches:
            out = []
            for d, f1, f2, ids in zip(*[batch.column(c).to_pylist() for c in ("d", "f1", "f2", "ids")]):
                if key == (d, f1, f2):
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, f1, f2), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield result(out)
        if key is not None:
            yield result([(*key, sha.hexdigest())])

    return runs.mapInArrow(releasing(run), "d int, f1 bigint, f2 bigint, ends_sha256 string")


def _undone(f: Column, g: Column, lane: int) -> Column:
    """The lane pair of the parent's product: (x - digest) / B."""

    def one(x, t, i):
        return F.pmod((x - F.pmod(t, F.lit(P))) * F.lit(_INVERSE[i]), F.lit(P))

    low, high = g.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(g, 32)
    first, second = one(F.shiftright(f, 31), low, lane), one(f.bitwiseAND(F.lit(P)), high, lane + 1)
    return F.shiftleft(first, 31).bitwiseOR(second)


def _owners(nodes: DataFrame) -> DataFrame:
    """(m, s, s_before, leaf, above): the depth from which on m owns its path, the characters before it, whether its end
    is childless, and the owner of the node above s."""
    first = F.min(F.struct("d", "before", "f1", "f2", "g1", "g2")).alias("first")
    own = written(nodes.groupBy(F.col("owner").alias("m")).agg(first, F.max((F.col("deepest") == F.col("d")).cast("int")).alias("leaf")), "owners")
    root = nodes.where("d = 0").agg(F.min("owner").alias("owner")).first()["owner"]
    rows = own.select("m", F.col("first.d").alias("s"), F.col("first.before").alias("s_before"), "leaf", (F.col("first.d") - 1).alias("d"),
                      _undone(F.col("first.f1"), F.col("first.g1"), 0).alias("f1"), _undone(F.col("first.f2"), F.col("first.g2"), 2).alias("f2"))
    near = rows.where("s <= 1").withColumn("above", F.when(F.col("s") == 1, F.lit(root).cast("long"))).select("m", "s", "s_before", "leaf", "above")
    # A node that many conversations branch off from is dealt out by salt.
    far = rows.where("s > 1").withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int"))
    branch = nodes.where("n_convs > 1 AND d > 0").select("d", "f1", "f2", F.col("owner").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    far = far.join(branch, ["d", "f1", "f2", "salt"]).select("m", "s", "s_before", "leaf", "above")
    return written(near.union(far), "owned")


def trie(conversations: DataFrame, bits: int = 128) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations of conversations (conv_id, turn, role, text): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                  *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL")
    salt = 0
    while True:
        turns = source.withColumn("digest", _digest(salt, bits))
        slim = turns.select("conv_id", "turn", "digest", F.length("text").alias("len"), *([_digest(0, 128).alias("tie")] if salt or bits <= 16 else []))
        blocks = written(_blocks(slim), "blocks")
        own = written(_scan(blocks), "scanned")
        paths = written(_paths(blocks, own, _info(own)), "paths")
        steps = paths.select("m", "depth", F.inline("steps"))
        both = [f(c).alias(c + k) for c in ("g1", "g2", "src", "place") for f, k in ((F.min, ""), (F.max, "_last"))]
        nodes = steps.groupBy("d", "f1", "f2").agg(F.min("m").alias("owner"), F.count("*").alias("n_convs"), F.max("depth").alias("deepest"), F.min("before").alias("before"), *both)
        nodes = written(nodes, "nodes")
        if not _differ(nodes, turns):
            break
        salt, bits = salt + 1, bits * 4
    owned = _owners(nodes)
    # Conversations that own nothing save their whole path.
    rows = paths.join(owned, "m", "left").select("m", "depth", "s", "leaf", "above", F.coalesce("s_before", "chars").alias("shared"), F.inline("steps"))
    owns = F.col("s").isNotNull() & (F.col("s") <= F.col("d"))
    out = rows.groupBy("d", "f1", "f2").agg(
        F.min("m").alias("conv_id"),
        F.min(F.when(owns & (F.col("d") > 0), F.when(F.col("d") > F.col("s"), F.col("m")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("depth") > F.col("d")) & (F.col("s") <= F.col("d") + 1)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    out = out.join(_ends(paths), ["d", "f1", "f2"], "left")
    return out.select("conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))


def sql() -> str:
    """The same nodes by DuckDB, from the rebuilt turns themselves."""
    one = "list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id AS c, conv_id - conv_id % {SPAN} AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda s, b: {one}), 4294967295::BIGINT) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
taken AS (
  SELECT c, 0 AS side, place, role, text FROM ids JOIN t ON t.conv_id = base AND place <= h
  UNION ALL SELECT c, 1, place, role, text FROM ids JOIN t ON t.conv_id = c AND place > h),
rebuilt AS (
  SELECT c, row_number() OVER w AS d, length(text) AS len, list(struct_pack(role := role, text := text)) OVER w AS path
  FROM taken WINDOW w AS (PARTITION BY c ORDER BY side, place ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT c, d, len, md5(CAST(to_json(path) AS VARCHAR)) AS name FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM ids),
depths AS (SELECT c, max(d) AS deepest FROM steps GROUP BY c),
node AS (
  SELECT name, d, min(c) AS conv_id, count(*) AS n_convs, min(len) AS len, max(deepest) = d AS childless,
         list(c ORDER BY c) FILTER (d = deepest) AS ends
  FROM steps JOIN depths USING (c) GROUP BY name, d),
below AS (
  SELECT DISTINCT a.name, a.d, b.name AS under, b.d AS under_d FROM steps a JOIN steps b ON a.c = b.c AND b.d >= a.d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth,
       (SELECT min(p.conv_id) FROM below u JOIN node p ON u.name = p.name AND u.d = p.d WHERE u.under = n.name AND u.under_d = n.d AND u.d = n.d - 1) AS parent_conv_id,
       n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(array_to_string(coalesce(n.ends, []), ',')) AS ends_sha256
FROM node n JOIN (
  SELECT u.name, u.d, count(*) FILTER (x.d = u.d + 1) AS n_children, count(*) FILTER (x.childless) AS n_leaves,
         CAST(sum((x.n_convs - 1) * x.len) AS BIGINT) AS saved_tokens
  FROM below u JOIN node x ON u.under = x.name AND u.under_d = x.d GROUP BY u.name, u.d) s ON n.name = s.name AND n.d = s.d
"""
