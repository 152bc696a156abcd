"""The registered queries on small tables against plain Python versions, exact round trips and held-out accuracy."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loopdex.llm import kneser_ney, learned_partitions, ngram_join, plans, sentencepieces, separators, warc, wavelet
from tests.llm import brute

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, width, percent):
    rows = docs_of(spark, SF)
    want = brute.near_duplicates(rows, width, percent)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows) and len({c for _, c in want.values()}) < len(rows)


def variants(n, words=160, seed=3, edits=8):
    """Near copies of one text, some links among them and some not, and one common line in other texts."""
    r = np.random.default_rng(seed)
    base = [f"w{r.integers(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        x = list(base)
        for k in r.choice(words, r.integers(0, edits), replace=False):
            x[k] = f"v{r.integers(10**9)}"
        out.append((i * 3 + 1, " ".join(x)))
    line = " ".join(f"c{k}" for k in range(12))
    out += [(i * 3 + 2, " ".join([f"u{r.integers(10**9)}" for _ in range(40)]) + "\n" + line) for i in range(60)]
    return out


def test_ngram_join_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIR_LIST", 10)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rows = variants(150)
    want = brute.near_duplicates(rows, 4, 85)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 2 < len({c for i, (_, c) in want.items() if i % 3 == 1})


def test_ngram_join_rarity(spark, monkeypatch):
    """n-grams are shuffled as eight bytes each to find those of one class, and aren't kept beside the documents; classes
    that can't be told apart by the bits that go along lose no link."""
    r = np.random.default_rng(3)
    word = [f"w{i}" for i in range(400)]
    long = [" ".join(r.choice(word, n)) for n in r.integers(20, 600, 60)]
    rows = [(i, x) for i, x in enumerate(long + [x + " end" for x in long[:20]] + long[:5])] + [(100, None), (101, ""), (None, long[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = ngram_join._classes(docs, 4, 85)
    assert classes.columns == ["doc_id", "n", "c", "grams"]
    grams = classes.where("doc_id IS NOT NULL").agg({"grams": "sum"}).first()[0]
    some = docs.where("doc_id IS NOT NULL").select("text")
    dealt = ngram_join._dealt(some, 4, 85, 3).collect()
    assert {x.part for x in dealt} == {0, 1, 2} and sum(len(x.grams) for x in dealt) <= 8 * grams
    holders, sets = defaultdict(set), {}
    for doc_id, text in rows:
        for own in ngram_join.sets_of(pa.array([text]), 4) if doc_id is not None else ():
            for k in [k for k, counts in enumerate(ngram_join._counted(len(own), 85)) if counts]:
                sets[ngram_join._name(own.tobytes()), k] = part = {int(h) for h in own if k == 0 or h % 4 == 0}
                for h in part:
                    holders[k, h].add(ngram_join._name(own.tobytes()))
    want = {ngram_join._code(c, k, 31): sum(len(holders[k, h]) == 1 for h in part) for (c, k), part in sets.items()}
    got = {x.code: x.alone for x in ngram_join._alone(some, 4, 85, grams).collect()}
    assert got == {code: n for code, n in want.items() if n}
    found = lambda: sorted(tuple(x) for x in ngram_join.near_duplicates(docs.where("doc_id IS NOT NULL"), 4, 85).collect())
    before = found()
    assert len({c for _, _, c in before}) < len(before) - 5
    monkeypatch.setattr(ngram_join, "CLASS_BITS", 3)
    monkeypatch.setattr(ngram_join, "PART_GRAMS", 500)
    assert found() == before


def test_ngram_join_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (None, "a b"), (7, "x " * 5000), (8, "x " * 5000 + "y"), (9, "one two three four"), (9, "one two three four")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), None: (1, None), 7: (1, 7), 8: (2, 8), 9: (1, 9)}
    empty = spark.createDataFrame([], "doc_id bigint, text string, component_id string, extra int")
    assert ngram_join.near_duplicates(empty, 4, 85).collect() == []
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_ngram_join_shared_ids(spark):
    """Rows of one id with different texts: both texts link, the id joins what they link with, whatever the row order."""
    r = np.random.default_rng(8)
    a, b, c = (" ".join(f"{k}{r.integers(10**9)}" for _ in range(200)) for k in "abc")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, b + " z"), (6, c), (5, c + " z"), (5, "one"), (8, "one"), (7, "two three"), (9, "x " + a), (9, "solo")]
    for big, order in ((0, rows), (1 << 62, rows[::-1])):
        df = spark.createDataFrame([(i + big, t) for i, t in order], "doc_id bigint, text string")
        got = {(x.doc_id - big, x.component_id - big) for x in ngram_join.near_duplicates(df, 4, 85).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (5, 5), (6, 5), (8, 5), (7, 7)}
    kept = {x.doc_id - big: x.text for x in ngram_join.one_of_each(df, 4, 85).collect()}
    assert kept == {1: max(a, b), 5: max(c + " z", "one"), 7: "two three"}


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, order):
    rows = docs_of(spark, SMALL)
    want, total = brute.kneser_ney(rows, order, brute.is_held_out)
    got = kneser_ney.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), order).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.is_held_out(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_kneser_ney_beats_base(spark):
    got = [r for r in plans.op10_kneser_ney(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_kneser_ney_edges(spark):
    rows = [(0, None), (1, ""), (2, "a b a b"), (2, "a b a b"), (None, "a " * 3000)]
    got = kneser_ney.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) and r.score < 0 for r in got)
    none = kneser_ney.scores(spark.createDataFrame([], "doc_id bigint, text string, score int"))
    assert none.collect() == []


def encode_all(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(plans.tokenizer_path(plans.BYTE_BPE))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", None, " ", "  ", "a  b   c ", "a\n b \n\n c", "x" * 30000, "<|endoftext|> <|endoftext|>", "tab\t\tx y", "日本語　テキスト x", "a   b", "'ll don't  it's 1 2  33", "\x1c \x85 a"]


def test_wavelet_round_trip(spark):
    rows = sorted(docs_of(spark, SMALL)) + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**7, "twice"), (10**7, "twice")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.round_trip(df, plans.tokenizer_path(plans.BYTE_BPE)).collect())
    want, at = [], 0
    for (i, _), ids in zip(rows, encode_all([t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == sorted(want)
    assert wavelet.round_trip(df.limit(0), plans.tokenizer_path(plans.BYTE_BPE)).collect() == []


@pytest.mark.parametrize("fallback", [False, True])
def test_column_tokens(fallback):
    import pyarrow as pa

    from loopdex.llm.byte_tokens import ColumnTokens, slices_of

    encode = ColumnTokens(open(plans.tokenizer_path(plans.BYTE_BPE), encoding="utf-8").read())
    if fallback:
        encode._bytes[:] += 1
    plain = ["", None, "a", "two words", "a\nb c\n", "\nx y", "don't we'll 12 日本語 é", "word " * 20000 + "end"]
    for texts in (plain, plain + ODD, [], [None], ["", "x"]):
        ids, sizes = encode(pa.array(texts, pa.string()))
        want = encode_all(texts)
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(plain, pa.string())})
    for most in (1, 20, 1 << 20):
        assert [x for b in slices_of(batch, "text", most) for x in b.column(0).to_pylist()] == plain


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "", "plain one", "x<|endoftext|><|endoftext|>y  z", None, "a\n<|endoftext|>\nb", "<|endoftext", "plain two"]


def plainly(texts):
    """The ids of a library call that sets add_special_tokens=False and nothing else."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(plans.tokenizer_path(plans.BYTE_BPE))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_column_tokens_special():
    import pyarrow as pa

    from loopdex.llm.byte_tokens import ColumnTokens

    encode = ColumnTokens(open(plans.tokenizer_path(plans.BYTE_BPE), encoding="utf-8").read(), special_as_text=False)
    for texts in (SPECIAL, ODD, SPECIAL[:2], SPECIAL[2:4], SPECIAL[::-1], []):
        ids, sizes = encode(pa.array(texts, pa.string()))
        want = plainly(texts)
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_wavelet_query_is_plain_library_call(spark, tmp_path):
    rows = list(enumerate(SPECIAL + ODD))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in plans.op3_wavelet_shards(spark, str(tmp_path)).collect())
    want, at = [], 0
    for (i, _), ids in zip(rows, plainly([t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5000, 1), (20000, 7), (30000, 50000)])
def test_wavelet_matrix(n, top):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % top).astype(np.uint32) if n else np.zeros(0, np.uint32)
    wm = wavelet.WaveletMatrix(wavelet.build(ids, [1], [n]))
    for i in r.integers(0, max(n, 1), 30) if n else []:
        assert wm.access(int(i)) == ids[i]
    for t in {0, 3, top + 5, *(ids[:3].tolist())}:
        at = np.flatnonzero(ids == t)
        assert wm.count(t) == len(at) and wm.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        for j in (0, len(at) // 2, len(at) - 1, len(at)):
            assert wm.find(t, j) == (at[j] if 0 <= j < len(at) else -1)
    assert (wm.decode() == ids).all()


def test_separator_scan(spark, tmp_path):
    r = np.random.default_rng(1)
    files = {"a": r.integers(0, 5, 10007), "b": np.zeros(1, int), "c": np.ones(3000, int), "d": np.zeros(0, int), "e": np.concatenate([np.ones(1000, int), [0], np.ones(5, int)])}
    want = set()
    for name, ids in files.items():
        (tmp_path / f"{name}.ids").write_bytes(ids.astype("<u2").tobytes())
        ends = np.flatnonzero(ids == 0) + 1
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else []
        got = [(name, k, int(s), int(e - s), True) for k, (s, e) in enumerate(zip(starts, ends))]
        tail = int(ends[-1]) if len(ends) else 0
        want |= {*got, *([(name, len(got), tail, len(ids) - tail, False)] if tail < len(ids) else [])}
    rows = separators.scan(spark, str(tmp_path), 0, block_bytes=256).collect()
    assert {(r.path.rsplit("/", 1)[1][0], r.ordinal, r.start, r.n_tokens, r.ended) for r in rows} == want and len(rows) == len(want)


def test_separator_counts(spark):
    rows = docs_of(spark, SMALL) + [(10**6 + i, t) for i, t in enumerate(ODD)]
    got = separators.counted(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), plans.tokenizer_path(plans.BYTE_BPE), plans.END_OF_TEXT).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) + 1 for (i, _), x in zip(rows, encode_all([t for _, t in rows]))}
    assert len(got) == len(rows) and all(r.ended for r in got)


def test_sentencepiece_parity(spark):
    import sentencepiece

    path = plans.tokenizer_path(plans.PIECES)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = docs_of(spark, SMALL) + [(10**6 + i, t) for i, t in enumerate([*ODD, " a", "<s> </s> <0x41>", " " * 37 + "z"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sentencepieces.encoded(df, path).collect()
    for r in got:
        ids = other.encode(dict(rows)[r.doc_id] or "")
        assert r.ids == struct.pack(f"<{len(ids)}I", *ids) and (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(r.ids))
        assert r.decodes
    assert len(got) == len(rows) and sum(r.n_differ for r in got) == 0
    back = {r.doc_id: r.text for r in sentencepieces.decoded(spark.createDataFrame(got), path).collect()}
    assert back == {i: t or "" for i, t in rows}
    backend = sentencepieces.Model(open(path, "rb").read()).tokenizer()
    for _, t in rows[:40]:
        e = backend.encode(t or "", add_special_tokens=False)
        assert e.ids == other.encode(t or "") and backend.decode(e.ids) == t


def test_sentencepiece_unigram_model():
    """A unigram model written field by field, with byte fallback."""
    import sentencepiece

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        head = bytes([(number << 3 | 2) & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"")
        return head + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])) + value

    def varint(number, value):
        key, out = number << 3, b""
        while key > 127:
            out += bytes([key & 127 | 128])
            key >>= 7
        return out + bytes([key, value])

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁ab", -3.5, 1), ("aba", -3.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + varint(3, k)) for p, s, k in pieces)
    data += field(2, varint(3, 1) + varint(35, 1)) + field(3, field(1, b"identity") + varint(3, 1) + varint(4, 0) + varint(5, 1))
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    backend = sentencepieces.Model(data).tokenizer()
    for text in ["ab", "abab aba", "ba  ab", "a é b"]:
        assert backend.encode(text, add_special_tokens=False).ids == other.encode(text)
    codec = sentencepieces.Codec(data, 1)
    assert [codec.decode(x) for x in codec.encode(["abab aba", "é", ""])] == ["abab aba", "é", ""]


def test_learned_partitions_recall(spark):
    got: dict = {}
    for r in plans.op7_learned_partitions(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = sorted((a, i) for a, i in zip(d, ids) if i != q)[:10]
        assert len(got[q]) == 10 and [(s, v) for v, s in got[q]] == sorted((s, v) for v, s in got[q])
        assert all(s == pytest.approx(d[ids == v][0], abs=1e-12) for v, s in got[q])
        hit += len({v for v, _ in got[q]} & {i for _, i in best})
        total += 10
    assert hit >= 0.9 * total


def test_learned_partitions_edges(spark):
    kind = "vec_id bigint, embedding array<float>, label int, rank int"
    rows = [(0, [1.0, 0.0], 1, 1), (100, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [0.0, 0.0], 1, 1), (3, None, 1, 1), (4, [None, 1.0], 1, 1), (5, [float("nan"), 1.0], 1, 1), (6, [0.5, 0.5], 1, 1), (200, [0.0, 0.0], 1, 1), (7, [1.0], 1, 1)]
    got = learned_partitions.nearest(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (0, 3, 6), (100, 1, 0), (100, 2, 1), (100, 3, 6)]
    assert learned_partitions.nearest(spark.createDataFrame([], kind)).collect() == []


def test_warc_edges(spark):
    big = "é" * 900
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b\r\n/x", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n" * 200), (6, "u", "small"), (7, "u", "small"), (8, "u", big), (8, "u", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(tuple(r) for r in warc.captured(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == sorted([(1, 1800, "revisit", 8), (2, 1800, "revisit", 8), (3, 0, "response", None), (4, 0, "response", None), (5, 2400, "response", None), (6, 5, "response", None), (7, 5, "response", None), (8, 1800, "response", None), (8, 1800, "response", None)], key=lambda x: (x[0], x[1]))
    whole = {r.metadata.fields["capture-id"]: r for r in warc.round_trip(df.selectExpr("page_id AS id", "url", "html AS payload"), payload=True).collect()}
    assert bytes(whole["5"].response.payload).decode() == rows[4][2] and whole["2"].request.target_uri is None
    assert warc.captured(df.limit(0)).collect() == []
