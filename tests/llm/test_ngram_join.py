"""The Jaccard join against all pairs, with rings and several rounds."""

import random
from collections import Counter

import numpy as np
import pytest
from llm.conftest import words

from telluria.llm import ngram_join as J
from telluria.llm import ngram_links as L


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def by_pairs(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if met and 100 * met >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def test_awkward_rows(docs, corpus):
    got = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(by_pairs(corpus))
    assert J.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [256, 8])
def test_groups_without_a_middle(spark, monkeypatch, small):
    """Near copies of texts that are not there themselves: some link, many just
    miss, so stars leave regions open, and rings and blocks have to be joined."""
    rng = random.Random(3)
    rows = []
    for group in range(3):
        base = words(rng, 130)
        for _ in range(40):
            copy = list(base)
            for at in rng.sample(range(130), rng.choice([1, 2, 3, 4, 5])):
                copy[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(J, "SMALL", small)
    more = []
    real = J.pairs_between
    monkeypatch.setattr(J, "pairs_between", lambda *a: more.append(1) or real(*a))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(by_pairs(rows))
    assert more


def test_large_regions_around_foreign_pivots(spark):
    """Mutually linked texts share two regions, and each has a pivot that shares
    too little with them to be compared: a text that quotes one shingle only, the
    rarest it has, as all others stand in one much repeated text."""
    base = [f"b{i}" for i in range(16)]
    tails = [[f"t{i}x{j}" for j in range(13)] for i in range(13)]
    repeated = " ".join(" ".join(base[i + 1:i + 4] + tails[i]) for i in range(13))
    texts = [" ".join([*base, f"own{i}"]) for i in range(300)]
    texts += [" ".join(base[i:i + 4] + tails[i]) for i in range(13)] + [repeated] * 320
    rows = list(enumerate(texts))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 300} == {0}
    assert sorted(map(tuple, got)) == sorted(by_pairs(rows))


def test_all_links(spark, monkeypatch):
    """Copies, near copies in one component and rows without words or ids."""
    monkeypatch.setattr(J, "SMALL", 8)
    rng = random.Random(4)
    base = words(rng, 130)
    texts = [" ".join(base[:i] + [f"e{i}"] + base[i + 1:]) for i in range(0, 60, 2)]
    texts += [texts[0].upper(), texts[0], None, "", "alone here", " ".join(words(rng, 60))]
    rows = [*enumerate(texts), (None, texts[1])]
    links, members = L.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = [shingles(r[1]) for r in rows]
    close = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    want = [(*by, sum(close(s, o) for o in sets) - bool(s)) for by, s in zip(by_pairs(rows), sets)]
    got = [tuple(r) for r in members.select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert Counter(got) == Counter(want)
    alone = set(map(frozenset, sets)) - {frozenset()}
    assert links.count() == sum(close(a, b) for a in alone for b in alone if a != b) // 2 > 50


def test_overlap_bound_never_drops_a_link():
    rng = random.Random(1)
    for _ in range(300):
        a = set(rng.sample(range(60), rng.randrange(5, 50)))
        b = set(x for x in a if rng.random() > 0.08) | set(rng.sample(range(60), 2))
        first = sorted(a & b)[:1]
        if first and 20 * len(a & b) >= 17 * len(a | b):
            at = [sorted(s).index(first[0]) for s in (a, b)]
            assert J.overlap_possible(len(a), len(b), *at, (17, 20))
            assert at[0] <= len(a) - -(-17 * len(a) // 20)


def test_linked_sets_meet_often_enough():
    rng = random.Random(2)
    seen = 0
    for _ in range(2000):
        a = set(rng.sample(range(400), rng.randrange(1, 120)))
        b = {x for x in a if rng.random() > 0.05} | set(rng.sample(range(400), rng.randrange(4)))
        if b and 20 * len(a & b) >= 17 * len(a | b):
            first = [set(sorted(s)[:len(s) + 17 * len(s) // -20 + 1]) for s in (a, b)]
            least = -(-17 * (len(a) + len(b)) // 37)
            need = least - max(-(-17 * len(a) // 20), -(-17 * len(b) // 20)) + 1
            assert len(first[0] & first[1]) >= need
            seen += need > 1
    assert seen > 50


def test_bitmaps_keep_every_link(spark):
    """Sets of sizes on both sides of a power of two, from equal to unlike."""
    random = np.random.default_rng(5)
    sets, pairs = [], []
    for n in (1, 2, 7, 31, 32, 33, 127, 128, 130, 500, 1023, 1025):
        one = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.02, 0.08, 0.1, 0.2, 0.3, 1.0):
            drop = int(len(one) * share)
            other = np.unique(np.concatenate([one[drop:], random.integers(0, 1 << 63, int(drop * random.random()), dtype=np.uint64)]))
            if len(other):
                at = len(sets)
                sets += [one, other]
                pairs.append((at, at + 1, len(np.intersect1d(one, other))))
    node = lambda i: i.to_bytes(4, "big")
    names = spark.createDataFrame([(node(i), [int(v) for v in J.parity(s)]) for i, s in enumerate(sets)],
                                  "node binary, bits array<bigint>")
    asked = spark.createDataFrame([(node(a), node(b), len(sets[a]), len(sets[b])) for a, b, _ in pairs],
                                  "a binary, b binary, na long, nb long")
    got = {bytes(r["a"]) for r in J.near_enough(asked, names, (17, 20)).collect()}
    linked = {node(a) for a, b, met in pairs if 100 * met >= 85 * (len(sets[a]) + len(sets[b]) - met)}
    assert linked <= got
    unlike = {node(a) for a, b, met in pairs if len(sets[a]) > 100 and 2 * met < len(sets[a])}
    assert unlike and not unlike & got
