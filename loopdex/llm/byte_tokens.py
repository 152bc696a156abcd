"""Byte-level BPE ids of whole texts, for the operators that write and read token files."""

from __future__ import annotations

import numpy as np

from loopdex.llm.pieces import ODD, cut


class ColumnTokens:
    """An Arrow column of texts -> all its ids in one array, and the number of ids of each text (null: 0).

    The column's distinct chunks are found by Arrow and encoded together, a few thousand to a string: a byte-level
    vocabulary tells how many bytes each id stands for, so the ids of a chunk are those that end where it ends. A
    tokenizer whose ids don't add up to the bytes of the string gets the chunks one by one. Nothing is kept between
    columns.

    special_as_text: strings of special tokens are ordinary text. If not, they get the special tokens' ids, as in a plain
    library call; texts that hold one are encoded whole, as such a token also changes what is next to it."""

    GROUP = 4000

    def __init__(self, content: str, special_as_text: bool = True):
        import json

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.encode_special_tokens = True
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        self._special = [] if special_as_text else [x["content"] for x in spec.get("added_tokens") or [] if x["special"]]
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self._bytes[list(vocab.values())] = [len(x) for x in vocab]

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that a space comes before; sizes: the bytes of each, without the space."""
        ids = np.array(self._tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        inside = len(ids) and ids.max() < len(self._bytes)
        ends = np.cumsum(self._bytes[ids]) if inside else np.zeros(1, np.int64)
        want = np.cumsum(sizes + 1)
        at = np.searchsorted(ends, want)
        if ends[-1] != want[-1] or (ends[at] != want).any():
            return self._each([" " + x for x in chunks])
        return ids, np.diff(at + 1, prepend=0)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = column.fill_null("")
        holds = np.zeros(len(texts), bool)
        for special in self._special:
            holds |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._chunked(texts)
        self._tokenizer.encode_special_tokens = False
        try:
            ids, n = self._each(texts.filter(pa.array(holds)).to_pylist())
        finally:
            self._tokenizer.encode_special_tokens = True
        sizes = np.zeros(len(texts), np.int64)
        flat, sizes[~holds] = self._chunked(texts.filter(pa.array(~holds)))
        flat = np.insert(flat, np.repeat(np.cumsum(sizes)[holds], n), ids)
        sizes[holds] = n
        return flat, sizes

    @staticmethod
    def _parts(texts):
        """The chunks of each text as an Arrow list; only texts with unusual white space become Python strings."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return pc.split_pattern(texts, " ")
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        rest = pa.array([cut(x) for x in texts.filter(pa.array(odd)).to_pylist()], plain.type)
        place = np.empty(len(texts), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
        return pa.concat_arrays([plain, rest]).take(pa.array(place))

    def _chunked(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = self._parts(texts)
        coded = pc.dictionary_encode(parts.flatten())
        chunks = coded.dictionary.to_pylist()
        spans = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)
        firsts = pc.list_element(parts, 0).to_pylist()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        tables = [self._joined(chunks[i : i + self.GROUP], spans[i : i + self.GROUP]) for i in range(0, len(chunks), self.GROUP)] + [self._each(firsts)]
        ids, sizes = (np.concatenate(x) for x in zip(*tables))
        starts = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy().copy()
        code[bounds[:-1]] = len(chunks) + np.arange(len(firsts))  # a text's first chunk has no space before it
        n = sizes[code]
        ends = np.cumsum(n)
        flat = ids[np.repeat((starts[code] - (ends - n)).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
        return flat, np.diff(ends[bounds[1:] - 1], prepend=0)


_MADE: dict[int, ColumnTokens] = {}


def of_process(content: str, special_as_text: bool = True) -> ColumnTokens:
    """One encoder a worker process, for all the tasks that the process runs."""
    key = hash((content, special_as_text))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ColumnTokens(content, special_as_text)
    return _MADE[key]


def slices_of(batch, column: str, most: int = 16 << 20):
    """Slices of an Arrow record batch with about `most` bytes in a text column, or one row, if that has more."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)
