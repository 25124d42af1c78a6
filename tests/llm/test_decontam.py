import hashlib
import re

import pytest

from symgrain.llm.decontam import bits_for, contamination


def brute(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    found |= set() if item_id is None else {str(item_id)}
        ids = sorted(found)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' words", "1 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    return sorted((tuple(r) for r in contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


LONG = " ".join(f"w{i}" for i in range(40))


@pytest.mark.parametrize("docs, items", [
    ([(1, LONG), (2, None), (3, ""), (4, "... ---"), (5, "W3, w4; W5 w6 w7 w8 w9 w10 w11 W12!"), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (7, "A a a a a a a a a a a a a"), (1, LONG), (None, "x " + LONG + " y " + LONG), (8, "café Été z")], [(10, LONG), (11, LONG), (11, LONG), (2, "a a a a a a a a a a a"), (3, None), (4, "!!"), (5, "café Été"), (6, "w1"), (None, "w2 w3"), (9, " ".join(f"w{i}" for i in range(5, 20)))]),
    ([(1, LONG)], []),
    ([], [(1, LONG)]),
    ([(1, "q " * 20000 + LONG + " q" * 20000)], [(1, LONG), (100, "q q q")]),
])
def test_brute_force(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items)


def test_the_bitmap_grows_with_the_fingerprints():
    assert [bits_for(n) for n in (0, 1, 32_768, 32_769, 10**6, 10**9)] == [20, 20, 20, 21, 25, 26]


def test_no_python_in_plan(spark):
    d = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    b = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow(?!To)", contamination(d, b)._jdf.queryExecution().toString().replace("ArrowToRow", ""))
