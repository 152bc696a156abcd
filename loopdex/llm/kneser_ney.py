"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays that workers map into
memory.

Counting: tasks hash words (A-Z lower-cased, 64 bits), fold n-grams and count them per block of text, so a frequent
n-gram is one entry a block; blocks are shuffled as packed arrays by the n-gram's own hash (a frequent word or context
is spread like any other). A reducing task merges one hash range, writes it as a sorted array file and passes on the
continuation counts of the next lower order and partial sums of its contexts. The number of ranges follows
spark.sql.shuffle.partitions, so a task's share stays bounded as the corpus grows.

Lower orders hold continuation counts (distinct words to the left), each order has its three discounts from its counts
of counts, and the lowest order is interpolated with the uniform distribution over the vocabulary and one unknown.
Texts are preceded by order - 1 start marks and followed by one end mark, which is predicted like a word.

Scoring: every worker maps the files from the shared folder (pages are read as they are needed; a store that can't be
mapped is read range by range) and looks up a block's distinct n-grams with one binary search a range.

Edge cases: null and empty texts are the end mark alone; words never seen score as the unknown word; an empty training
set leaves the uniform distribution over one unknown; rows that repeat a doc_id count, and are scored, each; a null
doc_id belongs to the training set; extra columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.llm.common import scratch, written

ORDER = 2
BLOCK_TOKENS = 1_000_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_U = np.uint64
PACKED = "kind string, level int, shard int, words binary, counts binary, stats array<bigint>"


def shards_of(spark) -> int:
    """A power of two, at least the number of shuffle partitions."""
    return 1 << max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> _U(64 - shards.bit_length() + 1)).astype(np.int64)


def sequences(texts, order: int):
    """For each block of texts of an Arrow array: (first row, tokens with marks, index of each text's first token plus
    the total). A text's first order - 1 tokens are start marks, its last is the end mark."""
    from loopdex.llm.wordhash import chunks, word_hashes

    pads = order - 1
    for row, data, offs in chunks(texts):
        words, first = word_hashes(data, offs)
        n = len(first) - 1
        size = np.diff(first)
        start = first + np.arange(n + 1) * (pads + 1)
        tokens = np.full(start[-1], START, np.uint64)
        tokens[start[1:] - 1] = END
        tokens[np.arange(len(words)) + np.repeat(np.arange(n) * (pads + 1) + pads, size)] = words
        yield row, tokens, start


def predicted(start: np.ndarray, order: int) -> np.ndarray:
    """Places of the tokens that are predicted: all but the start marks."""
    keep = np.ones(start[-1], bool)
    for k in range(order - 1):
        keep[start[:-1] + k] = False
    return np.flatnonzero(keep)


def grams(tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens that end at each place; k = 0: zeros."""
    from loopdex.llm.wordhash import window_hashes

    return window_hashes(tokens, k)[at - (k - 1)] if k else np.zeros(len(at), np.uint64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sums of their counts, an index of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64), order[first]


def _pack(words: list[np.ndarray]) -> bytes:
    """Columns of word hashes, compressed: one column as it is, several as places in their distinct words."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    if len(words) == 1:
        return pack(words[0].tobytes())
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    at = at.astype("<u2" if len(distinct) <= 1 << 16 else "<u4")
    head = pack(distinct.tobytes())
    return len(head).to_bytes(8, "little") + head + at.dtype.itemsize.to_bytes(1, "little") + pack(at.tobytes())


def _unpack(data: bytes, width: int) -> np.ndarray:
    """The columns again, a row each."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if width == 1:
        return np.frombuffer(unpack(data), np.uint64).reshape(1, -1)
    end = 8 + int.from_bytes(data[:8], "little")
    distinct = np.frombuffer(unpack(data[8:end]), np.uint64)
    return distinct[np.frombuffer(unpack(data[end + 1 :]), {2: "<u2", 4: "<u4"}[data[end]])].reshape(width, -1)


def _pack_counts(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def _rows(kind: str, level: int, words: list[np.ndarray], counts: np.ndarray, shards: int) -> list[tuple]:
    """Packed rows by shard of the n-gram (columns of word hashes), inside a shard by the first word, which packs well."""
    shard = _shard(_key(words), shards)
    order = np.lexsort((words[0], shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    parts = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s + 1] > cuts[s]]
    return [(kind, level, s, _pack([w[part] for w in words]), _pack_counts(counts[part]), None) for s, part in parts]


def _key(words: list[np.ndarray]) -> np.ndarray:
    """The hash that ``grams`` gives to n-grams with these words."""
    from loopdex.llm.wordhash import window_hashes

    k, m = len(words), len(words[0])
    flat = np.empty(k * m, np.uint64)
    for i, w in enumerate(words):
        flat[i::k] = w
    return window_hashes(flat, k)[::k] if m else np.zeros(0, np.uint64)


def _counted(train: DataFrame, order: int, shards: int) -> DataFrame:
    """Packed counts of the highest order ("gram") and of words ("word")."""

    def flush(tokens, ats):
        import pandas as pd

        rows, base = [], 0
        seq = np.concatenate(tokens)
        at = np.concatenate(ats)
        if len(at):
            keys, counts, one = _merged(grams(seq, at, order), np.ones(len(at), np.int64))
            rows += _rows("gram", order, [seq[at[one] - order + 1 + i] for i in range(order)], counts, shards)
            keys, counts, one = _merged(seq[at], np.ones(len(at), np.int64))
            rows += _rows("word", 1, [keys], counts, shards)
        return pd.DataFrame(rows, columns=["kind", "level", "shard", "words", "counts", "stats"])

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])
        tokens, ats, held = [], [], 0
        for batch in batches:
            for _, seq, start in sequences(batch.column(0), order):
                tokens.append(seq)
                ats.append(predicted(start, order) + held)
                held += len(seq)
                if held >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pandas(flush(tokens, ats), schema, preserve_index=False)
                    tokens, ats, held = [], [], 0
        if tokens:
            yield pa.RecordBatch.from_pandas(flush(tokens, ats), schema, preserve_index=False)

    return train.select(F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)


def _unpacked(pdf, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    counts = [_unpack_counts(x) for x in pdf["counts"]]
    parts = [_unpack(x, width) for x in pdf["words"]]
    return [np.concatenate([p[i] for p in parts]) for i in range(width)], np.concatenate(counts)


def _reduced(packed: DataFrame, folder: str, shards: int) -> DataFrame:
    """One task a (kind, level, shard): merge, write the sorted file, pass on what the next step needs.

    gram: counts of n-grams; continues with "gram" rows one level down and "context" rows. word: counts of words.
    context: (hash of a context; sum and numbers of counts 1, 2, 3 or more)."""

    def run(key, pdf):
        import pandas as pd

        from loopdex.llm.files import publish

        kind, level, shard = key[0], int(key[1]), int(key[2])
        rows: list[tuple] = []
        if kind == "context":
            raw = [_unpack_counts(x).reshape(4, -1) for x in pdf["counts"]]
            keys = np.concatenate([_unpack(x, 1)[0] for x in pdf["words"]])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = [np.add.reduceat(np.concatenate([x[i] for x in raw])[order], first) for i in range(4)]
            publish(f"{folder}/context{level}-{shard:05d}", [keys[first].tobytes(), *[x.astype("<u8" if i == 0 else "<u4").tobytes() for i, x in enumerate(sums)]])
            rows.append(("file", level, shard, None, None, [0, len(first)]))
        else:
            words, counts = _unpacked(pdf, level)
            keys, counts, one = _merged(_key(words), counts)
            words = [w[one] for w in words]
            wide = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
            publish(f"{folder}/{kind}{level}-{shard:05d}", [keys.tobytes(), counts.astype(f"<u{wide}").tobytes()])
            which = {"gram": 1, "word": 2}[kind]
            rows.append(("file", level, shard, None, None, [which, len(keys), int(counts.sum()), *[int((counts == k).sum()) for k in (1, 2, 3, 4)], int((counts >= 3).sum()), wide]))
            if kind == "gram" and level > 1:
                lower, n, at = _merged(_key(words[1:]), np.ones(len(keys), np.int64))
                rows += _rows("gram", level - 1, [w[at] for w in words[1:]], n, shards)
                context = _key(words[:-1])
                order = np.argsort(context, kind="stable")
                context, c = context[order], counts[order]
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                parts = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
                cuts = np.searchsorted(_shard(context[first], shards), np.arange(shards + 1))
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if b > a:
                        rows.append(("context", level, s, _pack([context[first][a:b]]), _pack_counts(np.concatenate([x[a:b] for x in parts])), None))
        return pd.DataFrame(rows, columns=["kind", "level", "shard", "words", "counts", "stats"])

    return packed.groupBy("kind", "level", "shard").applyInPandas(run, PACKED)


class Model:
    """Where the files are and what the discounts are; sent to workers (its size follows the number of shards)."""

    def __init__(self, folder: str, order: int, shards: int, files: list):
        self.folder, self.order, self.shards = folder, order, shards
        #: (kind, level, shard) -> number of entries, and the bytes of a count.
        self.size: dict[tuple[str, int, int], int] = {}
        self.wide: dict[tuple[str, int, int], int] = {}
        stats: dict[tuple[int, int], np.ndarray] = {}
        for row in files:
            which, n, *rest = row["stats"]
            name = (("context", "gram", "word")[which], row["level"], row["shard"])
            self.size[name] = n
            if which:
                self.wide[name] = rest.pop()
                stats[which, row["level"]] = stats.get((which, row["level"]), 0) + np.array([n, *rest], np.int64)
        self.vocabulary, self.train_tokens = (int(x) for x in stats[2, 1][:2]) if (2, 1) in stats else (0, 0)
        self.discount = {k: self._discounts(stats[1, k][2:6]) for k in range(1, order + 1) if (1, k) in stats}
        low = stats.get((1, 1))
        #: Of the lowest order: sum of continuation counts and the share left for the uniform distribution.
        self.low_total = int(low[1]) if low is not None else 0
        d = self.discount.get(1)
        self.low_rest = float(d[1] * low[2] + d[2] * low[3] + d[3] * low[6]) / self.low_total if self.low_total else 1.0

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """D(0), D(1), D(2), D(3+) from the numbers of counts 1 to 4 (0.5, 1, 1.5 where they can't be estimated)."""
        n1, n2, n3, n4 = (float(x) for x in n)
        if min(n1, n2, n3) == 0:
            return np.array([0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        return np.array([0, *(min(max(k - (k + 1) * y * b / a, 0.0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


#: Columns of a file behind its keys; a context's are the sum and the numbers of counts 1, 2 and 3 or more.
COLUMNS = {"gram": 1, "word": 1, "context": 4}


class Scorer:
    """Looks n-grams up in the mapped files of a model."""

    def __init__(self, model: Model):
        self.model, self._open = model, {}

    def _shard(self, kind: str, level: int, s: int):
        if (kind, level, s) not in self._open:
            from loopdex.llm.files import mapped

            n, path = self.model.size.get((kind, level, s), 0), f"{self.model.folder}/{kind}{level}-{s:05d}"
            at, columns = 8 * n, []
            for k in range(COLUMNS[kind]):
                column = np.dtype(("<u8" if k == 0 else "<u4") if kind == "context" else f"<u{self.model.wide.get((kind, level, s), 1)}")
                columns.append(mapped(path, column, at, n))
                at += n * column.itemsize
            self._open[kind, level, s] = mapped(path, "<u8", 0, n), columns
        return self._open[kind, level, s]

    def find(self, kind: str, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """The columns' values of each key; 0 where it isn't stored."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(distinct), np.int64) for _ in range(COLUMNS[kind])]
        cuts = np.searchsorted(_shard(distinct, self.model.shards), np.arange(self.model.shards + 1))
        for s in range(self.model.shards):
            a, b = cuts[s], cuts[s + 1]
            stored, columns = self._shard(kind, level, s) if b > a else (np.zeros(0, np.uint64), [])
            if len(stored):
                at = np.searchsorted(stored, distinct[a:b])
                at[at == len(stored)] = 0
                hit = stored[at] == distinct[a:b]
                for x, column in zip(out, columns, strict=True):
                    x[a:b] = np.where(hit, column[at], 0)
        return [x[back] for x in out]

    def probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """p(token | the order - 1 tokens before) at each place."""
        m = self.model
        p = np.full(len(at), m.low_rest / (m.vocabulary + 1))
        if m.low_total:
            (c,) = self.find("gram", 1, grams(tokens, at, 1))
            p += np.maximum(c - m.discount[1][np.minimum(c, 3)], 0) / m.low_total
        for k in range(2, m.order + 1):
            if k not in m.discount:
                break
            d = m.discount[k]
            (c,) = self.find("gram", k, grams(tokens, at, k))
            total, n1, n2, n3 = self.find("context", k, grams(tokens, at - 1, k - 1))
            seen = total > 0
            safe = np.where(seen, total, 1)
            rest = np.where(seen, (d[1] * n1 + d[2] * n2 + d[3] * n3) / safe, 1.0)
            p = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / safe, 0.0) + rest * p
        return p

    def base(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in training, add-one log10 probability) at each place."""
        m = self.model
        (c,) = self.find("word", 1, grams(tokens, at, 1))
        return c, np.log10((c + 1) / (m.train_tokens + m.vocabulary + 1))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the texts of docs (a column text)."""
    spark = docs.sparkSession
    shards, folder = shards_of(spark), scratch(spark, "kneser-ney")
    rows = _counted(docs, order, shards)
    files = []
    for _ in range(order):  # the highest order and words, then each lower order with the contexts above it
        made = written(_reduced(rows, folder, shards), "level")
        files += made.where("kind = 'file'").select("level", "shard", "stats").collect()  # a row a file
        rows = made.where("kind <> 'file'").drop("stats").withColumn("stats", F.lit(None).cast("array<bigint>"))
    return Model(folder, order, shards, files)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(sent.value)
        order = scorer.model.order
        for batch in batches:
            ids = batch.column(0)
            for row, tokens, start in sequences(batch.column(1), order):
                at = predicted(start, order)
                first = start[:-1] - np.arange(len(start) - 1) * (order - 1)
                log = np.log10(scorer.probabilities(tokens, at))
                known, base = scorer.base(tokens, at)
                n = len(start) - 1
                size = np.diff(np.append(first, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n), pa.array(size), pa.array(np.add.reduceat((known > 0).astype(np.int64), first)),
                        pa.array(np.full(n, scorer.model.train_tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log, first)),
                    ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id):
    """crc32 of the id as text, mod 7, is 2 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Every document scored by the model of those that aren't held out; perplexity = 10 ** (-score / n_tokens)."""
    model = train(docs.where(~held_out(F.col("doc_id"))), order)
    out = scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
