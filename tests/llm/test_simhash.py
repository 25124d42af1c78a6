import random
import re

import numpy as np
import pytest
import xxhash

from symgrain.llm import simhash as s
from symgrain.llm.buckets import starts_of


def components(ids, linked):
    at = {i: i for i in ids}
    while True:
        new = dict(at)
        for a, b in linked:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius, words", [(3, 1), (20, 2)])
def test_trees_find_every_link(radius, words):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (6, words), dtype=np.uint64)
    prints = np.concatenate([base[rng.integers(0, 6, 300)]])
    for row in prints:
        for b in rng.integers(0, 64 * words, rng.integers(0, 7)):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    cells = np.sort(rng.integers(0, 4, 300))
    got, a, b, d = s.bk_links(prints, starts_of(cells), radius)
    away = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = components(range(300), [(a, b) for a in range(300) for b in range(a) if cells[a] == cells[b] and away[a, b] <= radius])
    assert got.tolist() == [want[i] for i in range(300)]
    assert (away[a, b] == d).all() and (d <= radius).all() and (cells[a] == cells[b]).all()
    assert len(a) == 300 - len(set(got.tolist())) and components(range(300), list(zip(a.tolist(), b.tolist()))) == want


@pytest.mark.parametrize("cap", [4096, 2])
def test_query_against_brute_force(spark, cap):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 200))) for _ in range(12)]
    for t in texts[:8]:
        for _ in range(5):
            w = t.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    texts += [None, "", " \n ", "One", "one", "one two", "Ünder ünder x", texts[0], texts[0], "a b c " * 6000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as node", "1 as print")
    prints = {i: brute_print(t) for i, t in rows}
    want = components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = sorted(map(tuple, s.simhash_components(docs, cap=cap).collect()))
    assert got == sorted((i, f"{prints[i]:016x}", want[i]) for i, _ in rows)
    assert len({c for _, _, c in got}) < len(set(texts))


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in s.simhash_components(docs).collect()} == {(None, 4), (4, 4), (None, None)}
    assert s.simhash_components(docs.limit(0)).count() == 0


def sets_of(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_equal_exact_similarity_but_for_few(spark):
    rng, texts = random.Random(9), []
    for g in range(220):  # pairs from far below to far above the bound, most of them close to it
        n = rng.choice([7, 9, 14, 40, 150, 600])
        w = [f"w{rng.randrange(3000)}" for _ in range(n)]
        v = list(w)
        for at in rng.sample(range(n), round((n - 4) * rng.uniform(0.0, 0.18) / 5)):
            v[at] = f"changed{g}"
        v += [f"more{g}"] * (n < 20)
        texts += [" ".join(w), " ".join(v).upper()]
    texts += ["", None, "one two", "One  two", texts[0], "z y x w v u " * 9000]
    sets = [sets_of(t) for t in texts]
    pairs = [(2 * k, 2 * k + 1) for k in range(220)]
    similar = [jaccard(sets[a], sets[b]) for a, b in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'p' as print", "1 as place", "2 as node", "3 as k1")
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs).collect()}
    wanted = [got[a] == got[b] for (a, b), j in zip(pairs, similar, strict=True) if j >= 0.8]
    near = [got[a] == got[b] for (a, b), j in zip(pairs, similar, strict=True) if 0.8 <= j < 0.85]
    assert len(wanted) > 60 and len(near) > 10 and sum(wanted) >= 0.98 * len(wanted) and sum(near) >= 0.9 * len(near)
    assert not any(got[a] == got[b] for (a, b), j in zip(pairs, similar, strict=True) if j < 0.8)
    assert got[441] == got[440] == 440 and got[442] == got[443] == 442 and got[444] == 0 and got[445] == 445


def test_bands_grow_with_the_documents():
    agree = s._agreement(0.8)
    for n in (0, 1000, 10**6, 10**8, 10**10):
        bits, bands = s.band_plan(n, agree)
        assert n / 2**bits <= s.OCCUPANCY and 1 - (1 - agree**bits) ** bands >= 0.997
    assert s.band_plan(10**6, agree)[0] == s.BAND_BITS < s.band_plan(10**8, agree)[0]


def test_near_duplicates_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("cap", [4096, 30])
def test_chains_and_hot_groups(spark, cap):
    rng = random.Random(4)
    w = [f"c{i}" for i in range(400)]
    chain = []
    for k in range(40):  # each similar to the next, the ends not to each other
        chain.append(" ".join(w))
        at = rng.sample(range(400), 4)
        for i in at:
            w[i] = f"k{k}x{i}"
    hot = [f"d{i}" for i in range(200)]
    copies = [" ".join(hot)] * 50 + [" ".join([*hot[:i], "other", *hot[i + 1 :]]) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(chain + copies)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs, cap=cap).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 240)} == {40}


@pytest.mark.parametrize("block", [2048, 25])
def test_template_groups_lose_no_similar_pair(spark, monkeypatch, block):
    monkeypatch.setattr(s, "SET_CAP", block)
    rng, texts, group = random.Random(12), [], []
    for g in range(6):  # pages of one template: half of the pairs are similar enough, the other half nearly
        base = [f"g{g}w{i}" for i in range(300)]
        for _ in range(70):
            w = list(base)
            for at in rng.sample(range(300), rng.choice([3, 4])):
                w[at] = f"own{rng.randrange(10**9)}"
            texts.append(" ".join(w))
            group.append(g)
    sets = [sets_of(t) for t in texts]
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if group[a] == group[b] and jaccard(sets[a], sets[b]) >= 0.8]
    want = components(range(len(texts)), similar)
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(similar) > 2000 and sum(got[a] == got[b] for a, b in similar) >= 0.98 * len(similar)
    assert all(want[i] == want[got[i]] for i in got)  # none joined that is not linked


def test_true_links_equal_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        sets = [np.array(sorted(rng.sample(range(40), rng.randint(0, 30))), np.uint32) for _ in range(40)]
        starts = np.where(np.arange(40) < 7, 0, np.where(np.arange(40) < 20, 7, 20))
        plain = [set(x.tolist()) for x in sets]
        links = [(a, b) for a in range(40) for b in range(a) if starts[a] == starts[b] and plain[a] and plain[b] and jaccard(plain[a], plain[b]) >= 0.6]
        a, b = s.true_links(sets, starts, 0.6)
        assert components(range(40), links) == components(range(40), list(zip(a.tolist(), b.tolist())))


def test_a_group_of_near_copies_gives_few_links(spark, monkeypatch):
    rng, made = random.Random(6), []
    base, texts = [f"w{i}" for i in range(300)], []
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(300), 2):
            w[at] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    plain = s.materialize
    monkeypatch.setattr(s, "materialize", lambda df, name: (lambda out: made.append((name, out.count())) or out)(plain(df, name)))
    got = s.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(n for name, n in made if name == "simhash-found") <= 6 * 200  # and not one for each band that a text shares
