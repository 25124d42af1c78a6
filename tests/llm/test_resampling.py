import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from symgrain.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "x" * 63, "y" * 64, "z" * 65, "é" * 200, "w" * 1000


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(text, longest, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def texts(rng, n):
    pool = ["The", "cat", "Éa", "x1", "00", "...", "\n", "\t", "a_b", "ÀB", "東京", "{", "İ", "K", *LONG]
    return ["".join(rng.choice(pool) + rng.choice([" ", "", " - ", "\x7f"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_equal_plain_hashing(longest):
    rng = random.Random(longest)
    for buckets in (10_000, 97, 1 << 20):
        some = [None, "", *texts(rng, 40), "end", "ab", None, "cd ef", "", "Ünd"]
        rng.shuffle(some)
        array = pa.array(["before", *some, "after"], pa.string()).slice(1, len(some))  # an offset of its own
        keys, n = resampling.features(array, longest, buckets)
        found = [Counter() for _ in some]
        for key, count in Counter(keys.tolist()).items():
            found[key // buckets][key % buckets] = count
        assert found == [bag(t, longest, buckets) for t in some]
        assert n.tolist() == [len(words(t)) for t in some]


def brute(docs, target, percent=25, min_words=20, seed=7, buckets=10_000, longest=2):
    bags = [bag(t, longest, buckets) for _, t in docs]
    s, t = sum(bags, Counter()), sum((bag(x, longest, buckets) for _, x in target), Counter())
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, text), c in zip(docs, bags, strict=True):
        n = c.total()
        weight = sum(k * gain[b] for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in out)))


def rows(df):
    return sorted(str(list(r)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"percent": 60, "min_words": 3, "seed": 1, "buckets": 50, "longest": 3}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_resample_equals_brute_force(spark, options):
    rng = random.Random(9)
    docs = list(enumerate(texts(rng, 300))) + [(1000, None), (1001, ""), (1002, "long " * 30_000), (1003, "é" * 50_000)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "a b c d " * 9), (None, None)]
    target = list(enumerate(texts(rng, 20))) + [(99, None)]
    found = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "'x' as score", "1 as weight", "2 as rank", "3 as part"),
        spark.createDataFrame(target, "item_id long, text string").selectExpr("*", "1 as n"), **options,
    )
    assert rows(found) == brute(docs, target, **options)


def test_ties_and_repeats(spark):
    docs = [(7, "one two three " * 8)] * 40 + [(i, "one two three " * 8) for i in range(40)]
    target = [(0, "one two")]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(target, "item_id long, text string"))
    assert rows(found) == brute(docs, target)


def test_empty_sides(spark):
    docs, none = [(1, "a b " * 20), (2, "c")], []
    as_docs, as_target = (lambda r: spark.createDataFrame(r, "doc_id long, text string")), (lambda r: spark.createDataFrame(r, "item_id long, text string"))
    assert rows(resampling.resample(as_docs(docs), as_target(none))) == brute(docs, none)
    assert resampling.resample(as_docs(none), as_target(docs)).count() == 0
    with pytest.raises(ValueError, match="buckets"):
        resampling.resample(as_docs(docs), as_target(none), buckets=0)


def test_blocks_hold_the_matrix(spark, tmp_path):
    docs = list(enumerate(texts(random.Random(4), 700)))
    resampling.write_counts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), str(tmp_path / "m"))
    blocks = resampling.read_counts(spark, str(tmp_path / "m")).orderBy("part", "block").collect()
    assert len(blocks) > 1
    seen = {}
    for b in blocks:
        columns, counts = np.frombuffer(b["buckets"], "<u2"), np.frombuffer(b["counts"], "<u4")
        for doc_id, start, stop in zip(b["ids"], [0, *b["ends"]], b["ends"]):
            seen[doc_id] = dict(zip(columns[start:stop].tolist(), counts[start:stop].tolist(), strict=True))
    assert seen == {i: dict(bag(t, 2, 10_000)) for i, t in docs}
