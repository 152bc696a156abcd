"""The best lists of a table of queries, made by tasks that read the store range by range.

A row a query and range, or a mask a filter and range, grows with queries times documents, whatever a task then keeps of it.
Here queries are dealt to groups of at most ASKS_A_TASK different ones. A task holds one group, reads the ranges one after
the other and keeps each query's k best, so only those leave it. What is shuffled is the part of the store that any query asks
for, packed, once a group. Where groups are fewer than tasks, each is dealt to several tasks with a share of the ranges.

A range comes as rows: its documents, a bitmap a tag clause, the postings of a token (positions where a phrase has it), its
vectors. Per range, all queries' bounds are one numpy step; only queries whose bound reaches their k-th score are scored.
A task makes a filter's mask, a phrase's merged positions and equal queries' lists once.
"""

from __future__ import annotations

import json
import pickle
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.functions.text import tokens
from loopdex.operators.inverted import SLACK, TextIndex, merge_positions
from loopdex.operators.knn import best_of, matrix_of
from loopdex.operators.search_store import SearchStore, packed
from loopdex.operators.tag_bitmaps import TagIndex, clause_bitmaps
from loopdex.operators.text_index import idf
from loopdex.operators.util import round6, top_k_per_group
from loopdex.session import written

#: Different queries that a task holds at most.
ASKS_A_TASK = 16384
#: Kinds of row, in the order in which a task reads them.
ASK, DOCS, CLAUSE, POSTINGS, VECTORS = range(5)

_ROW = "kind int, range bigint, name string, data binary, top double, idf double"


def with_asks(pq: DataFrame, pattern: str, blocked_tags: tuple[str, ...]) -> DataFrame:
    """Parsed queries with their filter's name (its clauses as JSON) and their ask: phrases, loose terms and filter as JSON,
    the same for queries that have the same lists."""
    keys = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<array<string>>")), lambda x: F.coalesce(F.array_join(x, " "), F.lit("")))
    blocked = F.array(*[F.array_join(tokens(F.lit(t)), " ") for t in blocked_tags]) if blocked_tags else F.array().cast("array<string>")
    sides = [F.array_sort(F.array_distinct(keys("req"))).alias("r"), F.array_sort(F.array_distinct(F.concat(keys("neg"), blocked))).alias("n")]
    phrases = F.transform("phrases", lambda p: tokens(p, pattern)).alias("p")
    loose = F.when(F.col("loose") != "", F.array_sort(F.array_distinct(tokens("loose", pattern)))).alias("l")
    return pq.withColumns({"filter": F.to_json(F.struct(*sides)), "ask": F.to_json(F.struct(phrases, loose, *sides))})


_ASK = "p array<array<string>>, l array<string>, r array<string>, n array<string>"


def _clauses(index: TagIndex, asks: DataFrame, column: str) -> DataFrame:
    """A row a range and clause of asks that some tag of it holds."""
    ask = F.from_json(column, _ASK)
    names = asks.select(F.explode(F.array_distinct(F.concat(ask["r"], ask["n"]))).alias("name")).where("name <> ''").distinct()
    bits = clause_bitmaps(index, names.select("name", F.split("name", " ").alias("clause")))
    return _rows(bits, CLAUSE, lambda b: [zlib.compress(x.rstrip(b"\0"), 1) for x in b.column("bits").to_pylist()], name="name")


def _documents(store: SearchStore) -> DataFrame:
    """A row a range: the ids, lengths and store order of its documents, by local."""
    docs = store.text.docs.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("local", "doc_id", "dl", "seq"))).alias("docs"))

    def pack(batch):
        out = []
        for docs in batch.column("docs"):
            seq = [np.iinfo(np.int64).min if x is None else x for x in docs.values.field("seq").to_pylist()]
            data = docs.values.field("doc_id").to_pylist(), docs.values.field("dl").to_numpy(zero_copy_only=False), np.array(seq, np.int64)
            out.append(zlib.compress(pickle.dumps(data, protocol=5), 1))
        return out

    return _rows(docs, DOCS, pack)


def _postings(index: TextIndex, asks: DataFrame) -> DataFrame:
    """A row a range and token that asks want."""
    ask = asks.select(F.from_json("ask", _ASK).alias("a"))
    some = ask.select(F.explode(F.array_distinct(F.flatten("a.p"))).alias("token"), F.lit(True).alias("placed"))
    some = some.unionByName(ask.select(F.explode("a.l").alias("token"), F.lit(False).alias("placed")))
    some = some.groupBy("token").agg(F.max("placed").alias("placed"))
    known = index.terms.select("bucket", "token", idf(F.col("df").cast("double"), F.lit(float(index.n_docs))).alias("idf"))
    known = written(known.join(some, "token"), "asked-terms")
    rows = index.blocks.join(known, ["bucket", "token"])
    rows = rows.select("range", "token", "docs", "tfs", F.when(F.col("placed"), F.col("gaps")).alias("gaps"), "top", "idf")
    least = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x

    def pack(batch):
        lists = [(batch.column(c), batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("docs", "tfs", "gaps")]
        out = []
        for i in range(len(batch)):
            docs, tfs, gaps = (x[o[i] : o[i + 1]] for _, o, x in lists)
            data = least(np.diff(docs, prepend=0)), least(tfs), least(gaps)
            out.append(zlib.compress(pickle.dumps(data, protocol=5), 1))
        return out

    return _rows(rows, POSTINGS, pack, name="token", more=("top", "idf"))


def _rows(df: DataFrame, kind: int, pack, name: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df as rows of ranges: pack(batch) gives the data of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = len(batch)
            columns = [pa.array(np.full(n, kind, np.int32)), batch.column("range"), batch.column(name) if name else pa.nulls(n, pa.string()), pa.array(pack(batch), pa.binary())]
            columns += [batch.column(c) if c in more else pa.nulls(n, pa.float64()) for c in ("top", "idf")]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "range", "name", "data", "top", "idf"])

    return df.mapInArrow(run, _ROW)


def _deal(asks: DataFrame, by: str, n: int, rows: DataFrame) -> tuple[DataFrame, int]:
    """(asks and rows, each group's asks before the rows of its ranges, number of shares of the ranges): n asks that differ in
    by are dealt to groups."""
    groups = max(1, -(-n // ASKS_A_TASK))
    shares = max(1, -(-2 * asks.sparkSession.sparkContext.defaultParallelism // groups))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("deal", part(by, groups) * shares + F.col("share"))
    right = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("deal", F.col("group") * shares + part("range", shares))
    both = left.drop("share").withColumn("kind", F.lit(ASK)).unionByName(right.drop("group"), allowMissingColumns=True)
    return both.repartitionById(groups * shares, F.col("deal")).sortWithinPartitions("deal", "range", "kind"), shares


def _steps(batches):
    """("ask", Arrow slice), ("range", number, rows (kind, name, data, top, idf, ..)) and ("end",) of each deal in turn."""
    deal, number, held = None, None, []
    for batch in batches:
        deals, kinds = batch.column("deal").to_numpy(), batch.column("kind").to_numpy()
        ranges = batch.column("range").fill_null(-1).to_numpy()
        i = 0
        while i < len(batch):
            if deals[i] != deal:
                if held:
                    yield "range", number, held
                    held = []
                if deal is not None:
                    yield ("end",)
                deal, number = deals[i], None
            if kinds[i] == ASK:
                j = i
                while j < len(batch) and deals[j] == deal and kinds[j] == ASK:
                    j += 1
                yield "ask", batch.slice(i, j - i)
                i = j
                continue
            if held and ranges[i] != number:
                yield "range", number, held
                held = []
            number = int(ranges[i])
            held.append((int(kinds[i]), {c: batch.column(c)[i] for c in batch.schema.names if c not in ("deal", "kind", "range")}))
            i += 1
    if held:
        yield "range", number, held
    if deal is not None:
        yield ("end",)


class _Best:
    """The k best of each of n lists: (order, doc_id, score, range, local, seq), least order first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.lists, self.last = k, [[] for _ in range(n)], np.full(n, np.inf)

    def add(self, i: int, some: list) -> None:
        kept = sorted(self.lists[i] + some)[: self.k]
        self.lists[i] = kept
        if len(kept) == self.k:
            self.last[i] = kept[-1][0]


class _Range:
    """A range's rows, unpacked when asked for."""

    def __init__(self, number: int, rows: list):
        self.number, self.bits, self.postings, self.vectors = number, {}, {}, []
        self.ids, self.dl, self.seq = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for kind, row in rows:
            if kind == DOCS:
                self.ids, self.dl, self.seq = pickle.loads(zlib.decompress(row["data"].as_py()))
            elif kind == CLAUSE:
                self.bits[row["name"].as_py()] = row["data"].as_py()
            elif kind == POSTINGS:
                self.postings[row["name"].as_py()] = row["data"].as_py(), row["top"].as_py(), row["idf"].as_py()
            else:
                self.vectors.append(row)
        self._masks, self._lists, self._unpacked = {}, {}, {}

    def _clause(self, name: str) -> np.ndarray | None:
        if name not in self._unpacked:
            out = None
            if name in self.bits:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(self.bits[name]), np.uint8), bitorder="little")[: len(self.ids)]
                out = np.zeros(len(self.ids), bool)
                out[: len(bits)] = bits
            self._unpacked[name] = out
        return self._unpacked[name]

    def mask(self, req: tuple, neg: tuple) -> np.ndarray:
        """The documents with all clauses of req and none of neg."""
        if (req, neg) not in self._masks:
            mask = np.ones(len(self.ids), bool)
            for name in req:
                found = self._clause(name)
                mask = mask & found if found is not None else np.zeros(len(self.ids), bool)
            for name in neg:
                found = self._clause(name)
                if found is not None:
                    mask = mask & ~found
            self._masks[req, neg] = mask
        return self._masks[req, neg]

    def lists(self, token: str) -> tuple[np.ndarray, ...]:
        """(docs, tfs, lengths, gaps) of a token."""
        if token not in self._lists:
            docs, tfs, gaps = pickle.loads(zlib.decompress(self.postings[token][0]))
            docs = np.cumsum(docs.astype(np.int64))
            self._lists[token] = docs, tfs.astype(np.int64), self.dl[docs], gaps
        return self._lists[token]


class _Asks:
    """Different asks as flat arrays, so that a range's bounds of all are one step."""

    def __init__(self, asks: list[str], weigh, k: int, limit: int):
        self.weigh, self.parsed, self.codes = weigh, [json.loads(x) for x in asks], {}
        n, code = len(asks), lambda t: self.codes.setdefault(t, len(self.codes))
        phrases = [(i, [code(t) for t in dict.fromkeys(p)]) for i, a in enumerate(self.parsed) for p in a["p"] if p]
        loose = [(i, code(t)) for i, a in enumerate(self.parsed) for t in a.get("l") or []]
        self.owner = np.array([i for i, _ in phrases], np.int64)
        self.sizes = np.array([len(p) for _, p in phrases], np.int64)
        self.placed = np.array([t for _, p in phrases for t in p], np.int64)
        self.of = np.repeat(np.arange(len(phrases)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.loose = np.array([x for x in zip(*loose)] or [[], []], np.int64)
        self.wants = np.array([len(a["p"]) for a in self.parsed], np.int64)
        self.more = np.array([a.get("l") is not None for a in self.parsed], bool)
        self.text = self.more | (self.wants > 0)
        self.best = _Best(n, k), _Best(n, limit)
        self.n = n

    def meet(self, r: _Range) -> None:
        """Adds a range's best to each ask's."""
        top, weight = np.zeros(len(self.codes) + 1), np.zeros(len(self.codes) + 1)
        for token, (_, most, part) in r.postings.items():
            if token in self.codes:
                top[self.codes[token]], weight[self.codes[token]] = most, part
        bound = np.bincount(self.loose[0], (top * weight)[self.loose[1]], self.n)
        can = np.where(self.more, bound > 0, True) & self.text
        if len(self.owner):
            # A phrase occurs no more often in a document than any of its tokens.
            least, total = np.minimum.reduceat(top[self.placed], self.starts), np.bincount(self.of, weight[self.placed], len(self.owner))
            bound = bound + np.bincount(self.owner, least * total, self.n)
            can &= np.bincount(self.owner, least > 0, self.n) == self.wants
        else:
            can &= self.wants == 0
        best, first = self.best
        merged: dict = {}
        for i in np.flatnonzero(can & (bound + 2 * SLACK >= -best.last)).tolist():
            mask = r.mask(tuple(self.parsed[i]["r"]), tuple(self.parsed[i]["n"]))
            if not mask.any():
                continue
            local, score = self._score(i, r, merged)
            local, score = local[mask[local]], score[mask[local]]
            order = -np.round(score, 6)
            ok = order <= best.last[i]
            local, score, order = local[ok], score[ok], order[ok]
            if len(local) > best.k:  # locals are in order of their ids
                at = np.lexsort((local, order))[: best.k]
                local, score, order = local[at], score[at], order[at]
            if len(local):
                best.add(i, [(o, r.ids[x], s, r.number, x, 0) for o, x, s in zip(order.tolist(), local.tolist(), score.tolist())])
        if len(r.ids):
            for i in np.flatnonzero(~self.text & (r.seq.min() <= first.last)).tolist():
                a = self.parsed[i]
                local = np.flatnonzero(r.mask(tuple(a["r"]), tuple(a["n"])))
                local = local[r.seq[local] <= first.last[i]]
                local = local[np.lexsort((local, r.seq[local]))[: first.k]]
                if len(local):
                    first.add(i, [(s, r.ids[x], 1.0, r.number, x, s) for x, s in zip(local.tolist(), r.seq[local].tolist())])

    def _score(self, i: int, r: _Range, merged: dict) -> tuple[np.ndarray, np.ndarray]:
        """(locals in order, scores) of the documents with all phrases and, if there are any, one of the loose terms."""
        a, score, hit = self.parsed[i], np.zeros(len(r.ids)), None
        for phrase in a["p"]:
            name = tuple(phrase)
            if name not in merged:
                at = {t: np.array([x for x, u in enumerate(phrase) if u == t], np.int64) for t in phrase}
                local, tf, dl = merge_positions([(at[t], *r.lists(t)) for t in at])
                merged[name] = local, sum(r.postings[t][2] for t in at) * self.weigh(tf, dl)
            local, part = merged[name]
            score[local] += part
            hit = local if hit is None else np.intersect1d(hit, local, assume_unique=True)
        if a.get("l") is not None:
            more = np.zeros(len(r.ids))
            for token in a["l"]:
                if token in r.postings:
                    if token not in merged:
                        docs, tf, dl, _ = r.lists(token)
                        merged[token] = docs, r.postings[token][2] * self.weigh(tf, dl)
                    docs, part = merged[token]
                    more[docs] += part  # every part is above 0
            hit = np.flatnonzero(more) if hit is None else hit[more[hit] > 0]
            score += more
        return hit, score[hit]


def top_lists(store: SearchStore, asked: DataFrame, k: int, limit: int) -> DataFrame:
    """(query_id, mode, rank, range, local, doc_id, score, seq): for each of asked (query_id, mode, ask; ids don't repeat) the k best
    documents of its phrases and loose terms by score rounded to six decimals, ties to smaller ids, or, where it has neither,
    the first limit in store order, among those that its tag clauses allow."""
    asked = written(asked.select("query_id", "mode", "ask"), "asks")
    different = written(asked.select("ask").distinct(), "different-asks")
    rows = _documents(store).unionByName(_clauses(store.tags, different, "ask")).unionByName(_postings(store.text, different))
    cfg, avgdl = store.text.cfg, store.text.avgdl or 1.0
    k1, b = cfg.k1, cfg.b
    rows, shares = _deal(asked.select(F.col("ask").alias("name"), "query_id", F.col("mode").alias("mode")), "name", different.count(), rows)

    def run(batches):
        import pyarrow as pa

        weigh = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        held, asks = [], None

        def listed():
            lists = [x or y for x, y in zip(asks.best[0].lists, asks.best[1].lists)]
            for query_id, mode, names in held:
                for i in range(0, len(names), 1024):
                    own = [lists[at[x]] for x in names[i : i + 1024].to_pylist()]
                    row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]) + i)
                    flat = list(zip(*(y for x in own for y in x))) or [()] * 6
                    columns = [query_id.take(row), mode.take(row), pa.array([y + 1 for x in own for y in range(len(x))], pa.int32()), pa.array(flat[3], pa.int64()),
                               pa.array(flat[4], pa.int32()), pa.array(flat[1], pa.string()), pa.array(flat[2], pa.float64()), pa.array(flat[5], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "mode", "rank", "range", "local", "doc_id", "score", "seq"])

        for step in _steps(batches):
            if step[0] == "ask":
                held.append((step[1].column("query_id"), step[1].column("mode"), step[1].column("name")))
                continue
            if asks is None:
                at = {}
                for _, _, names in held:
                    for x in names.to_pylist():
                        at.setdefault(x, len(at))
                asks = _Asks(list(at), weigh, k, limit)
            if step[0] == "range":
                if asks.n:
                    asks.meet(_Range(step[1], step[2]))
            else:
                yield from listed()
                held, asks = [], None

    found = rows.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, mode string, rank int, range bigint, local int, doc_id string, score double, seq bigint")
    if shares == 1:
        return found
    most = F.when(F.col("mode").isin("tags", "all"), F.lit(limit)).otherwise(F.lit(k))
    ranked = top_k_per_group(found.drop("rank"), "query_id", _order("score"), max(k, limit))
    return ranked.where(F.col("rank") <= most)


def _order(score: str) -> list[Column]:
    return [round6(score).desc(), F.col("seq"), F.col("doc_id")]


def top_vectors(store: SearchStore, asked: DataFrame, k: int) -> DataFrame:
    """I8: (query_id, range, local, doc_id, score, vrank): the k documents of largest inner product with each query of asked
    (query_id, filter, embedding), in double precision, among those that its filter allows; ties to smaller ids."""
    asked = written(asked.where(F.col("embedding").isNotNull()).select("query_id", F.col("filter").alias("name"), F.col("embedding").cast("array<double>").alias("embedding")), "asked-vectors")
    ids = store.vectors.select("range").distinct()
    there = _documents(store).unionByName(_clauses(store.tags, asked.select("name").distinct(), "name")).join(ids, "range", "left_semi")
    vectors = packed(store.vectors).select(F.lit(VECTORS).alias("kind"), "range", "dim", "locals", F.col("values").alias("data"))
    rows, _ = _deal(asked, "query_id", asked.count(), there.unionByName(vectors, allowMissingColumns=True))

    def run(batches):
        import pyarrow as pa

        held, state = [], None
        for step in _steps(batches):
            if step[0] == "ask":
                held.append(step[1].select(["query_id", "name", "embedding"]))
                continue
            if state is None:
                some = pa.Table.from_batches(held).combine_chunks() if held else None
                state = _Best(len(some) if some else 0, k)
                if some:
                    names = np.array(some.column("name").to_pylist())
                    sides = {x: (tuple(json.loads(x)["r"]), tuple(json.loads(x)["n"])) for x in dict.fromkeys(names.tolist())}
                    embedding, by_dim = some.column("embedding").chunk(0), {}
            if step[0] == "range":
                r = _Range(step[1], step[2])
                for row in r.vectors if some else []:
                    local, dim, values = row["locals"].values.to_numpy(), row["dim"].as_py(), row["data"].as_buffer()
                    values = np.frombuffer(values, np.float32 if values.size == 4 * dim * len(local) else np.float64)
                    if dim not in by_dim:
                        by_dim[dim] = matrix_of(embedding, dim)
                    allowed = lambda name: np.flatnonzero(r.mask(*sides[name])[local])  # noqa: B023, E731
                    q, j, score = best_of(values.astype(np.float64).reshape(len(local), dim), names, *by_dim[dim], k, allowed, -state.last)
                    cuts = np.flatnonzero(np.diff(q, prepend=-1)).tolist()
                    for a, b in zip(cuts, [*cuts[1:], len(q)]):
                        o, x, s = -np.round(score[a:b], 6), local[j[a:b]].tolist(), score[a:b].tolist()
                        state.add(int(q[a]), [(o, r.ids[x], s, r.number, x, 0) for o, x, s in zip(o.tolist(), x, s)])
            else:
                for i in range(0, len(state.lists), 1024):
                    own = state.lists[i : i + 1024]
                    row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]) + i)
                    flat = list(zip(*(y for x in own for y in x))) or [()] * 6
                    columns = [some.column("query_id").combine_chunks().take(row), pa.array(flat[3], pa.int64()), pa.array(flat[4], pa.int32()), pa.array(flat[1], pa.string()), pa.array(flat[2], pa.float64())]
                    yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["query_id", "range", "local", "doc_id", "score"])
                held, state = [], None

    found = rows.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, range bigint, local int, doc_id string, score double")
    return top_k_per_group(found, "query_id", [round6("score").desc(), F.col("doc_id")], k, "vrank")
