import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from symgrain.llm import packing

T = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece, looking at every bin: what each bin has left."""
    free = []
    for length in sorted(lengths, reverse=True):
        fitting = [f for f in free if f >= length]
        if fitting:
            free[free.index(min(fitting))] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


def placed(plan, counts, capacity):
    """Every piece of the plan as (sequence, offset, length)."""
    rows = [tuple(map(int, r)) for r in plan]
    out = []
    for (length, rank, per_bin, first, offset), after in zip(rows, [*rows[1:], None]):
        stop = after[1] if after and after[0] == length else counts[length]
        out += [(first + i // per_bin, offset + i % per_bin * length, length) for i in range(stop - rank)]
    return out


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for trial in range(400):
        capacity = rng.choice([1, 2, 7, 16, 31, 64, 100])
        lengths = [rng.randint(1, capacity) if trial % 3 else rng.choice([1, 2, capacity // 2 + 1, capacity]) for _ in range(rng.randint(0, 150))]
        lengths = [min(x, capacity) for x in lengths]
        pieces = placed(packing.best_fit(Counter(lengths), capacity), Counter(lengths), capacity)
        assert Counter(x for *_, x in pieces) == Counter(lengths)
        used = Counter()
        for sequence, offset, length in sorted(pieces):
            assert offset == used[sequence]  # no gap, no overlap
            used[sequence] += length
        assert sorted(used) == list(range(len(used)))
        assert sorted(capacity - n for n in used.values()) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(2)
    counts = {length: int(rng.integers(1, 1000)) for length in range(1, 1025)}
    few, many = packing.best_fit(counts, 1024), packing.best_fit({k: v * 10**6 for k, v in counts.items()}, 1024)
    assert len(many) < 10_000 and len(few) < 10_000


def expected(rows, capacity):
    out = []
    for doc_id, text in rows:
        ids = T.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


@pytest.mark.parametrize("capacity", [8, 1024])
def test_documents(spark, capacity):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["one", "two", "xyzzyq", "<|endoftext|>", "é", "\n\n"], k=rng.randint(0, 40)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "y " * 5000), (7, "again"), (7, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as piece", "'x' as length", "2 as ids", "3 as sequence_id")
    packed = packing.pack_documents(docs, capacity=capacity).collect()
    want = expected(rows, capacity)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()) for r in packed], key=key) == sorted(want, key=key)
    used = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert sorted(capacity - n for n in used.values()) == one_by_one([len(x[-1]) for x in want], capacity)


def test_sequences_and_digests(spark):
    rows = [(i, "word " * (i * 37 % 700)) for i in range(60)] + [(99, "long " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(docs).cache()
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(x[-1]) for x in expected(rows, 1024))
    for r in packed.collect():
        s = whole[r["sequence_id"]]
        assert s["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"] and len(s["ids"]) == 4 * s["n_tokens"] <= 4096
        assert (r["doc_id"], r["piece"], r["start"], r["offset"], r["length"]) in [tuple(d) for d in s["documents"]]
    found = packing.digests(docs).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in found} == {(r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in packed.collect()}
    assert found[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    packed.unpersist()


def test_empty_and_bad(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).count() == 0 and packing.sequences(packing.pack_documents(none)).count() == 0
    with pytest.raises(ValueError, match="tokens"):
        packing.pack_documents(none, capacity=0)
