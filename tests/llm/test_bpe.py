import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from symgrain.llm import bpe


def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [" ", "  ", "   ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "the", "ing", "é", "ß", "文", "🙂", "'s", "'ll", "1", "23", "!", "$$", "<|endoftext|>", "​", "İ", "٣", "Ⅷ", "́", "\x00", "zz"]


def test_random_texts_equal_the_library():
    e, c = library(), bpe.BytePairCodec.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 14)))
        ids = c.encode_one(text)
        assert ids == e.encode_ordinary(text)
        assert c.decode(ids).decode() == text
    for _ in range(200):
        texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(20)] + [None]
        ids, sizes = c.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.encode_ordinary(t or "") for t in texts]


def test_long_words_and_full_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 5)
    e, c = library(), bpe.BytePairCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("a" * 5000, "ab" * 4000, " " * 3000, "é" * 2000, "one two three four five one two three! one"):
        assert c.encode_one(text) == e.encode_ordinary(text)


def thue_morse():
    """Two pieces of equal length whose sums of place-weighted bytes agree for many odd multipliers."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_pieces_are_told_apart_by_their_bytes(monkeypatch):
    e, (x, y) = library(), thue_morse()
    for first, second in ((x, y), (y, x)):
        c = bpe.BytePairCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        for text in (f"s {first}", f"s {second}", f"s {first} {second}"):
            ids, _ = c.encode(pa.array([text]))
            assert ids.tolist() == e.encode_ordinary(text) and c.decode(ids.tolist()).decode() == text
    monkeypatch.setattr(bpe.PieceMemo, "_slots", lambda self, words, sizes: np.zeros(len(sizes), np.int64))  # all in one place
    c = bpe.BytePairCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [f"s {'k' * k} {'k' * k}\x00 é{k} {'n' * (20 + k)}" for k in range(12)]
    for _ in range(2):
        ids, sizes = c.encode(pa.array(texts))
        assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [e.encode_ordinary(t) for t in texts]


def test_query(spark):
    e = library()
    rows = [(1, "The cat's  hat"), (2, None), (3, ""), (1, "The cat's  hat"), (None, "x\n\n y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as ids", "1 as n_tokens")
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in rows:
        ids = e.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(want, key=str)
    tokens = bpe.encode_documents(docs)
    assert {r["doc_id"]: r["bytes"].decode() for r in bpe.decode_documents(tokens).collect()}[3] == ""
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_texts_go_by_bytes_and_a_task_leaves_no_memo(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 10)
    monkeypatch.setattr(bpe, "DOCS_AT_ONCE", 3)
    texts = ["a" * 25, "bb", None, "cc", "", "dd", "eeeee", "f" * 10, "g"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(bpe._texts([batch, batch.slice(0, 0), batch.slice(2, 3)]))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1, 2, 3], [4, 5, 6], [7], [8], [2, 3, 4]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "some words some words"])], "doc_id long, text string").coalesce(1)
    e = library()
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs).collect()} == {r["doc_id"]: e.encode_ordinary(r["text"] or "") for r in docs.collect()}

    def left(batches):
        codec = bpe.BytePairCodec.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([codec.memo.entries + len(codec.words) + len(codec.words.older) + len(codec.fits)])], ["left"])

    assert {r["left"] for r in docs.select("doc_id").mapInArrow(left, "left long").collect()} == {0}
    codec = bpe.BytePairCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    before = [x.tolist() for x in codec.encode(pa.array(texts))]
    assert codec.words
    codec.forget()
    assert not codec.words and not codec.memo.entries and [x.tolist() for x in codec.encode(pa.array(texts))] == before
