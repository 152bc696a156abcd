"""Token shards as wavelet matrices: access, counting and occurrence lookup from one compressed file.

A shard holds the ids of consecutive documents. Its distinct ids are numbered in ascending order; bit-plane k holds
bit k (highest first) of every number, in the order that stable partitions by the planes before it leave. rank and
select on the planes give token access, the count of a token in any range and the place of its j-th occurrence without
decoding the shard. Planes are compressed one by one (zstd), with a count of ones every BLOCK bits for rank.

Writing: documents are range-partitioned by doc_id (so shards are in ascending order), tokenised where they land and
written by their task as files of at most SHARD_TOKENS tokens (or one document, if that is longer), under their final
name only when complete. A shard's start is the prefix sum of the shard sizes, one row a shard. Reading goes through
Spark's binaryFile source, one shard in a task's memory at a time.

Edge cases: null and empty texts have only the end id; rows that repeat a doc_id are consecutive documents; a null
doc_id sorts first; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loopdex.llm.common import scratch, written

MAGIC = b"WMX1"
SHARD_TOKENS = 2 << 20
BLOCK = 4096
END_ID = 0


def _code(a: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    if len(alphabet) and alphabet[-1] < 1 << 22:
        table = np.zeros(int(alphabet[-1]) + 1, np.uint32)
        table[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        return table[a]
    return np.searchsorted(alphabet, a).astype(np.uint32)


def build(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """The file of one shard: magic, header length, header (JSON), document directory, alphabet, planes."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    alphabet = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if len(ids) and ids.max() < 1 << 22 else np.unique(ids).astype(np.uint32)
    a = _code(ids, alphabet)
    a = a.astype(np.uint16) if len(alphabet) <= 1 << 16 else a
    depth = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    planes, parts = [], []
    for k in range(depth - 1, -1, -1):
        bit = (a & a.dtype.type(1 << k)).astype(bool)
        bits = np.packbits(bit)
        packed = pack(bits.tobytes())
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.int64) if len(a) else np.zeros(0, np.int64)
        counts = pack(np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes())
        planes.append([len(packed), len(counts)])
        parts += [packed, counts]
        a = np.concatenate([np.compress(~bit, a), np.compress(bit, a)])
    directory = pack(np.array(lengths, "<i8").tobytes())
    names = pack(json.dumps(doc_ids).encode())
    letters = pack(alphabet.astype("<u4").tobytes())
    header = json.dumps({"tokens": len(ids), "docs": len(lengths), "names": len(names), "lengths": len(directory), "alphabet": len(letters), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, names, directory, letters, *parts])


class WaveletMatrix:
    """A shard read from its file's bytes; planes are unpacked when first used."""

    def __init__(self, data: bytes):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8 : 8 + size])
        at = 8 + size

        def take(n):
            nonlocal at
            at += n
            return data[at - n : at]

        self.tokens = head["tokens"]
        self.doc_ids = json.loads(self._unpack(take(head["names"])))
        self.lengths = np.frombuffer(self._unpack(take(head["lengths"])), "<i8")
        self.alphabet = np.frombuffer(self._unpack(take(head["alphabet"])), "<u4")
        self._raw = [(take(a), take(b)) for a, b in head["planes"]]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            bits, counts = self._raw[k]
            self._planes[k] = np.frombuffer(self._unpack(bits), np.uint8), np.frombuffer(self._unpack(counts), "<i8")
        return self._planes[k]

    @property
    def depth(self) -> int:
        return len(self._raw)

    def _zeros(self, k: int) -> int:
        return self.tokens - int(self._plane(k)[1][-1])

    def _bit(self, k: int, i: int) -> int:
        return int(self._plane(k)[0][i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        bits, counts = self._plane(k)
        block = i // BLOCK
        start = block * BLOCK // 8
        whole = np.bitwise_count(bits[start : i >> 3]).sum()
        rest = bin(int(bits[i >> 3]) >> (8 - (i & 7))).count("1") if i & 7 else 0
        return int(counts[block]) + int(whole) + rest

    def _select(self, k: int, j: int, one: bool) -> int:
        """Place of the j-th (from 0) bit of that kind in plane k."""
        bits, counts = self._plane(k)
        upto = counts if one else np.minimum(np.arange(len(counts)) * BLOCK, self.tokens) - counts
        block = int(np.searchsorted(upto, j, side="right")) - 1
        part = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.tokens - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == one)[j - int(upto[block])])

    def access(self, i: int) -> int:
        """Token i."""
        code = 0
        for k in range(self.depth):
            bit = self._bit(k, i)
            code = code << 1 | bit
            ones = self.rank1(k, i)
            i = self._zeros(k) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _letter(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among tokens start .. end - 1."""
        lo, hi, letter = start, self.tokens if end is None else end, self._letter(token)
        if letter is None:
            return 0
        for k in range(self.depth):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self._zeros(k) + a, self._zeros(k) + b) if letter >> (self.depth - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def find(self, token: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of a token; -1 if there are fewer."""
        letter = self._letter(token)
        if letter is None or not 0 <= j < self.count(token):
            return -1
        at, bits = 0, []
        for k in range(self.depth):
            bit = letter >> (self.depth - 1 - k) & 1
            ones = self.rank1(k, at)
            at = self._zeros(k) + ones if bit else at - ones
            bits.append(bit)
        at += j
        for k in range(self.depth - 1, -1, -1):
            at = self._select(k, at - self._zeros(k), True) if bits[k] else self._select(k, at, False)
        return at

    def decode(self) -> np.ndarray:
        """All tokens: the planes undone from the last to the first, a stable merge each."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        a = np.zeros(self.tokens, kind)
        for k in range(self.depth - 1, -1, -1):
            bit = np.unpackbits(self._plane(k)[0], count=self.tokens).view(bool)
            zeros = self._zeros(k)
            a[zeros:] |= kind(1 << (self.depth - 1 - k))
            out = np.empty_like(a)
            out[np.flatnonzero(~bit)] = a[:zeros]
            out[np.flatnonzero(bit)] = a[zeros:]
            a = out
            self._planes.pop(k)
        return self.alphabet[a]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, special_as_text: bool = True) -> DataFrame:
    """Write documents (doc_id, text) as shards in folder, in ascending doc_id order; (shard, n_docs, n_tokens) of each.
    tokenizer: the path of a tokenizers file, read on the driver; its text (some MB, fixed by its vocabulary) is
    broadcast. special_as_text: see ColumnTokens. Written once: the result is a table of its own."""
    from loopdex.llm.files import make, publish

    make(folder)
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from loopdex.llm.byte_tokens import of_process, slices_of

        part = TaskContext.get().partitionId()
        encode, made = None, 0
        names, lengths, pieces, held = [], [], [], 0

        def flush():
            nonlocal made, names, lengths, pieces, held
            shard = f"shard-{part:05d}-{made:05d}"
            publish(f"{folder}/{shard}.wm", build(np.concatenate(pieces), names, lengths))
            row = (shard, len(names), held)
            made, names, lengths, pieces, held = made + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(["shard", "n_docs", "n_tokens"], row))], pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for whole in batches:
            encode = encode or of_process(content.value, special_as_text)
            for batch in slices_of(whole, "text"):
                ids, sizes = encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                start = end = 0
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                    if held and held + n > shard_tokens:
                        pieces.append(ids[start:end])
                        yield flush()
                        start = end
                    names.append(doc_id)
                    lengths.append(n)
                    held += n
                    end += n
                pieces.append(ids[start:end].copy())
        if names:
            yield flush()

    return written(rows.mapInArrow(run, "shard string, n_docs bigint, n_tokens bigint"), "shards")


def documents(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, shard, start, n_tokens, ids_crc32 of each document, in all the shards of folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.wm$", 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                wm = WaveletMatrix(content.as_py())
                data = wm.decode().astype("<u4").tobytes()
                ends = np.cumsum(wm.lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), wm.lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wm.doc_ids, pa.int64()), pa.array([shard.as_py()] * len(crc)), pa.array(ends - wm.lengths), pa.array(wm.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select(name.alias("shard"), "content").mapInArrow(run, "doc_id bigint, shard string, inside bigint, n_tokens bigint, ids_crc32 bigint")
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("shard", before.alias("before"))
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, special_as_text: bool = True) -> DataFrame:
    folder = scratch(docs.sparkSession, "wavelet")
    return documents(docs.sparkSession, folder, write(docs, tokenizer, folder, end_id, special_as_text=special_as_text))
