import math
import random
from collections import Counter

import pytest

from symgrain.llm import quality as q


def tuples(text):
    units = [q._START] * 3 + q.units_of(text).tolist()
    return [tuple(units[i : i + 4]) for i in range(len(units) - 3)]


def brute(texts, left_out=None):
    """Perplexity by dictionaries; the text left out is taken off the counts of four units only."""
    levels = {4: Counter(g for t in texts for g in tuples(t))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {k: (0.0, *q.discounts(*(sum(n == i for n in level.values()) for i in (1, 2, 3, 4)))) for k, level in levels.items()}
    levels[4] = levels[4] - Counter(tuples(left_out or ""))
    following = {k: {} for k in levels}
    for k, level in levels.items():
        for h, n in level.items():
            following[k].setdefault(h[:-1], []).append(n)

    def p(g):
        if not g:
            return 2.0**-16
        k = len(g)
        seen = following[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda n: d[k][min(n, 3)]
        return (max(levels[k][g] - cut(levels[k][g]), 0) + sum(map(cut, seen)) * p(g[1:])) / sum(seen)

    return lambda text: -sum(math.log10(p(g)) for g in tuples(text)) / len(tuples(text))


@pytest.mark.parametrize("chunk_bytes", [q.CHUNK_BYTES, 1500])
def test_perplexities_equal_brute_force(spark, chunk_bytes):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd e.", weights=[9, 5, 4, 2, 6, 1, 1], k=rng.randint(5, 300))) for _ in range(30)]
    texts += ["привет мир, как дела", "你好世界天地玄黄", "Ünï 12 \U0001f642 ABC\r\n\tx", texts[0], None, "", "abcd " * 5000]
    trusted = [i for i in range(len(texts)) if i % 3 == 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as g", "2 as chunk", "3 as n").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(0, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in q.score(docs, labels, ["doc_id", "g", "text"], chunk_bytes).collect()}
    assert len(got) == len(texts) and got[1]["g"] == 1 and got[1]["text"] == texts[1]
    known = [texts[i] or "" for i in trusted]
    whole = brute(known)
    for i, text in enumerate(texts):
        assert got[i]["_q_units"] == len(tuples(text or "")) and got[i]["_q_trusted"] == (i in trusted)
        if text:
            assert got[i]["_q_log"] == pytest.approx((brute(known, text) if i in trusted else whole)(text), rel=1e-4)
        else:
            assert got[i]["_q_log"] is None


def test_scripts_are_not_folded(spark):
    rng = random.Random(3)
    tongues = {"ru": ["привет", "мир", "дорога", "вода", "камень", "дом"], "zh": ["你好", "世界", "天地", "玄黄", "宇宙", "洪荒"]}
    prose = lambda lang, n=60: ("" if lang == "zh" else " ").join(rng.choices(tongues[lang], k=n))
    junk = {lang: "".join(rng.sample(list("".join(words)) * 12, 60)) for lang, words in tongues.items()}
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["ru", "zh"] * 80)] + [(900 + k, junk[lang], lang) for k, lang in enumerate(tongues)] + [(910, prose("ru"), "zh"), (911, prose("zh"), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    assert {r["doc_id"] for r in q.classify(docs, labels).collect() if not r["keep"]} >= {900, 901}
    assert len({r["doc_id"] for r in q.keep_good(docs, labels).collect()} & set(range(160))) >= 158
    assert len(set(q.units_of("привет你好αβ").tolist())) == 10


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "and", "reading", "thing", "water", "stone", "house", "small"]
    good = [" ".join(rng.choices(words, k=60)) + "." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!$$%%" for w in rng.choices(words, k=60)) for _ in range(20)]
    return good, bad


def test_keeps_good_and_rejects_junk(spark):
    good, bad = corpus()
    rows = [(i, t, "en" if i % 2 else "xx", "s") for i, t in enumerate(good + bad)] + [(900, None, "en", None), (901, "", None, None), (None, good[0], None, "s"), (0, good[0], "xx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as bound", "2 as keep")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(5, 1), (None, 1), (3000, 1)] + [(i, 0) for i in range(120, 130)], "doc_id long, quality int").selectExpr("*", "'z' as text", "'en' as lang")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not set(ids) & set(range(120, 140))
    assert sorted(map(str, ids)) == sorted(map(str, [*range(120), 900, 901, None, 0]))
    out = {r["doc_id"]: r for r in q.classify(docs, labels).collect()}
    assert {i for i, r in out.items() if not r["keep"]} == set(range(120, 140))
    assert out[900]["perplexity"] is None and out[900]["n_units"] == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["keep"] for r in q.classify(docs, labels).collect()] == [True]
    assert q.keep_good(docs, labels).count() == 1
    assert q.keep_good(docs.limit(0), labels).count() == 0


def test_rejects_repeated_words_and_allows_for_short_texts(spark):
    good, _ = corpus()
    rows = [*enumerate(good), (500, "the " * 80), (501, "water " * 30 + "stone " * 30), (502, "the of"), (503, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert {r["doc_id"] for r in q.classify(docs, labels).collect() if not r["keep"]} == {500, 501}
    assert {r["doc_id"] for r in q.keep_good(docs, labels).collect()} == {*range(120), 502, 503}
    assert q.repeated("a a b b c") == 0.5 and q.repeated("a a a") == q.repeated("") == 0
