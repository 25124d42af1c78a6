import random

import numpy as np
import pytest

from symgrain.llm import licenses as li


def brute(text, templates, least=li.LEAST_COVERAGE):
    """Every template against the whole text, no index and no band: best coverage and span."""
    words, out = li.words_of(text), {}
    ids = {w: i + 1 for i, w in enumerate(sorted(set(words) | {w for t in templates.values() for w in li.words_of(t)}))}
    text_ids = np.array([ids[w] for w in words], np.int64)
    for name, t in templates.items():
        template = np.array([ids[w] for w in li.words_of(t)], np.int64)
        _, matched, first, last = li.align(template, text_ids, -len(template), len(words))
        if matched >= least * len(template):
            out[name] = (matched, first, last)
    return out


def edited(rng, text):
    words = text.split()
    for _ in range(len(words) // 12):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + 1] = [] if kind == 0 else ["changed"] if kind == 1 else [words[at], "added"]
    return " ".join(words)


def test_index_and_band_lose_nothing():
    rng, index = random.Random(1), li.LicenseIndex(li.TEMPLATES)
    filler = ["alpha", "beta", "the", "software", "of", "license", "gamma"]
    for trial in range(40):
        parts = [" ".join(rng.choices(filler, k=rng.randint(0, 60)))]
        for name in rng.sample(list(li.TEMPLATES), 2):
            parts += [edited(rng, li.TEMPLATES[name]) if trial % 2 else li.TEMPLATES[name].upper(), " ".join(rng.choices(filler, k=rng.randint(0, 60)))]
        text = "\n".join(parts)
        best = {}
        for name, _, matched, first, last in index.matches(text):
            if name not in best or matched > best[name][0]:
                best[name] = (matched, first, last)
        want = brute(text, li.TEMPLATES)
        assert best.keys() == want.keys()
        assert all(best[n][0] == want[n][0] for n in want)
        if trial % 2 == 0:
            assert best == want


def test_query(spark):
    notice = li.TEMPLATES["mit/notice"]
    rows = [(1, f"x y {notice} z"), (2, None), (3, ""), (4, "nothing here"), (5, f"{notice} {notice}"), (5, f"{notice} {notice}"), (None, notice), (6, "w " * 20000 + notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'t' as template", "1 as coverage")
    got = sorted(((r["doc_id"] or 0, r["license"], r["coverage"], r["first_word"], r["end_word"]) for r in li.scan(docs).collect()))
    assert got == [(0, "mit", 1.0, 0, 5), (1, "mit", 1.0, 2, 7), *[(5, "mit", 1.0, a, a + 5) for a in (0, 0, 5, 5)], (6, "mit", 1.0, 20000, 20005)]
    assert li.scan(docs.limit(0)).count() == 0
    assert li.scan(docs, {}).count() == 0
    with pytest.raises(ValueError, match="three|3 words: b"):
        li.scan(docs, {"a": "one two three", "b": "one two"})


def test_whole_texts_are_found_reflowed_and_beside_their_grants():
    index = li.LicenseIndex(li.TEMPLATES)
    text = "Copyright (c) 2020 A\n\n" + li.TEMPLATES["mit/text"].replace(". ", ".\n * ").replace("AUTHORS", "X CONSORTIUM")
    found = {name: coverage for name, coverage, *_ in index.matches(text)}
    assert found["mit/grant"] == 1.0 and found["mit/text"] > 0.95 and "bsd-2-clause/text" not in found
    three = {name for name, *_ in index.matches(li.TEMPLATES["bsd-3-clause/text"])}
    assert "bsd-3-clause/text" in three
