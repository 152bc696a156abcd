"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed here (only the fields that encoding needs) and rebuilt as a tokenizers.Tokenizer:
normaliser (the precompiled character map where there is one, white-space escaping), metaspace marker, unigram scores
or BPE merges in score order, and byte fallback. Workers build it once from the model's bytes; texts are cut into
chunks that no piece crosses, distinct chunks are encoded in multithreaded batches, and every one of them is compared
with the sentencepiece library: where the two differ, sentencepiece's ids are used and the difference is counted.

Cutting needs that no piece continues after a space; ``Model.cuts`` tells whether the model's flags and pieces allow
it, else whole texts are the chunks.

Edge cases: null and empty texts have no ids; texts of any length are encoded whole; repeated rows each get a row; an
empty table gives an empty result; extra columns of the input are ignored by ``encoded``.
"""

from __future__ import annotations

import os
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.llm.common import releasing

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
THREADS = 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: varints as int, the rest as bytes."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Model:
    """What a model file says: pieces (text, score, kind), kind of model, normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        norm: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_space = bool(trainer.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def cuts(self) -> bool:
        """May a text be cut at a single space? Not if a normaliser changes characters, spaces are squeezed or marked
        at the end, or a piece holds the marker after another character."""
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return not (self.charsmap or self.squeeze or self.suffix_space or inner) and self.escape and self.dummy_prefix

    def tokenizer(self, dummy_prefix: bool | None = None):
        """The model as a tokenizers.Tokenizer; dummy_prefix: overrides the model's own flag."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            backend = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk, byte_fallback=self.byte_fallback)
        else:
            backend = models.BPE(ids, self._merges(ids), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(backend)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix if dummy_prefix is None else dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return out

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Every way to make a piece of two others, best score first: the order in which BPE joins them."""
        usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                found += [(-score, ids[piece], ids[piece[:i]], ids[piece[i:]]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        names = [p for p, _, _ in self.pieces]
        return [(names[a], names[b]) for _, _, a, b in sorted(found)]

    def bytes_of(self) -> list[bytes]:
        """What each id stands for in decoded text."""
        out = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode("utf-8"))
        return out


class Codec:
    """Encodes and decodes texts; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, threads: int = THREADS):
        import sentencepiece

        from loopdex.llm.pieces import Encoder

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = Model(data)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads, self.differ = threads, 0
        self.table = self.model.bytes_of()
        if self.model.cuts:
            # Chunks come with their own space; to sentencepiece that space is the dummy prefix.
            self.backend = self.model.tokenizer(dummy_prefix=False)
            self._encode = Encoder(lambda chunks: self._checked(chunks, [x[1:] for x in chunks]), dummy_space=True)
        else:
            self.backend = self.model.tokenizer()
            self._encode = lambda texts: self._checked(texts, texts)

    def _checked(self, given: list[str], same: list[str]) -> list[bytes]:
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for x, text, ids in zip(self.backend.encode_batch_fast(given, add_special_tokens=False), same, self.other.encode(same, num_threads=self.threads), strict=True):
            mine = x.ids if text else []
            if given is not same and not text:  # a lone space: nothing to compare with, as empty texts have no ids
                mine = ids = x.ids
            if mine != ids:
                self.differ += 1
                mine = ids
            out.append(pack(mine))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._encode(texts)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encoded(docs: DataFrame, model: str, ids: bool = True, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32 bytes, if asked for), ids_crc32, decodes (the ids give the text back)
    and n_differ (chunks met for the first time on which the two libraries differed).

    model: a path that every worker can read, or one the driver can read through Spark; its bytes go to the workers
    once as a broadcast (a vocabulary file: some hundred kilobytes, bounded by its vocabulary size)."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(open(model, "rb").read())
    want = ids

    def run(batches):
        import pyarrow as pa

        codec = Codec(data.value, threads)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                before = codec.differ
                out = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out if want else [None] * len(out), pa.binary()),
                        pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array([codec.decode(x) == t for x, t in zip(out, texts, strict=True)]),
                        pa.array([codec.differ - before if i == 0 else 0 for i in range(len(out))], pa.int64()),
                    ], names=["doc_id", "n_tokens", "ids", "ids_crc32", "decodes", "n_differ"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id bigint, n_tokens bigint, ids binary, ids_crc32 bigint, decodes boolean, n_differ bigint")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    data = rows.sparkSession.sparkContext.broadcast(open(model, "rb").read())

    def run(batches):
        import pyarrow as pa

        codec = Codec(data.value)
        for batch in batches:
            texts = [codec.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(releasing(run), "doc_id bigint, text string")
