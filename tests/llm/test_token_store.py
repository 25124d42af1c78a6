import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from symgrain.llm import token_store as store
from tests.llm.test_bpe import ODD, thue_morse


T = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
T.encode_special_tokens = True


def library(text):
    return T.encode(text or "", add_special_tokens=False).ids + [0]


def test_round_trip(spark, tmp_path):
    rows = [(i, f"word{i} the  end\n\n {'x' * (i % 7)}") for i in range(300, 0, -1)] + [(0, None), (900, ""), (901, "y " * 20000), (5, "word5 the  end\n\n xxxxx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as ids", "'f' as file")
    path = str(tmp_path / "ids")
    store.write_store(docs, path, files=3)
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = library(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, store.index_store(spark, path).collect())) == want
    assert store.read_store(spark, path, [901]).first()["ids"] == library("y " * 20000)
    assert len(list((tmp_path / "ids").glob("*.orc"))) > 1


def test_random_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(store, "MEMO_PIECES", 40)
    mine, rng = store.PieceTokenizer(P.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(20)] + [None]
        ids, sizes = mine.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library(t)[:-1] for t in texts]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store.write_store(docs, str(tmp_path / "none"))
    assert store.index_store(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens_equal_the_library_as_loaded(spark, tmp_path):
    loaded = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark} x", f"no{mark}gap", f" {mark}  two\n", f"cut <|endof text|> {mark[:-1]}", "plain words", "", None]
    want = [loaded.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    mine, rng = store.PieceTokenizer.of(P.path("byte_bpe_50k.json")), random.Random(6)
    for some in [texts, *(["".join(rng.choices([mark, *ODD], k=9)) for _ in range(20)] for _ in range(30))]:
        ids, sizes = mine.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [loaded.encode(t or "", add_special_tokens=False).ids for t in some]
    store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "added"))
    assert [r["ids"][:-1] for r in store.read_store(spark, str(tmp_path / "added")).orderBy("doc_id").collect()] == want


def test_pieces_are_told_apart_by_their_bytes():
    loaded, (x, y) = Tokenizer.from_file(P.path("byte_bpe_50k.json")), thue_morse()
    for first, second in ((x, y), (y, x)):
        mine = store.PieceTokenizer(P.path("byte_bpe_50k.json"), added=True)
        for text in (f"s {first}", f"s {second}", f"s {first} {second}"):
            assert mine.encode(pa.array([text]))[0].tolist() == loaded.encode(text, add_special_tokens=False).ids


def test_offsets_of_repeated_ids_are_those_of_the_file(spark, tmp_path):
    rows = [(1, "word " * 20), (1, "two"), (1, None), (1, "word " * 20), (0, "first"), (None, "none here"), (None, "n"), (2, "last")]
    path = str(tmp_path / "ids")
    store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, files=2)
    stored = [r["ids"] for r in sorted(spark.read.orc(path).selectExpr("*", "_metadata.file_name as f").collect(), key=lambda r: (r["f"], r["place"]))]
    starts, crcs = [sum(map(len, stored[:k])) for k in range(len(stored))], [zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for ids in stored]
    found = sorted(store.index_store(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == list(zip(starts, map(len, stored), crcs))
    assert [r["doc_id"] for r in found] == [None, None, 0, 1, 1, 1, 1, 2]
