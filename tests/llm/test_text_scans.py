"""Decontamination, licences and quality against direct search."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telluria.llm import decontaminate as D
from telluria.llm import quality as Q
from telluria.llm.licenses import PHRASES, scan_licenses
from telluria.llm.text import ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def alnum(text):
    return WORD.findall(lower(text))


def test_ascii_lower(spark):
    texts = ["ABCxyz", "ÉCOLE École", "straße ẞ", "ΑΣ Σ", "İI", "ｗＩＤＥ", "", "Ⅷ Ⓐ a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == [lower(t) for t in texts]


@pytest.fixture(scope="module")
def items(corpus):
    text = corpus[9][1].split()
    return [(1, " ".join(text[5:30]), "x"), (2, "A b", "x"), (3, None, "x"), (4, "", "x"), (5, "É é", "x"), (5, "a b", "x"),
            (6, " ".join(text[10:22]), "x"), (7, "not in there at all " * 4, "x"), (8, "aaaa" * 40, "x"), (10, "a b " * 20, "x")]


def by_search(rows, items, window=13):
    phrases = {}
    for item, text, *_ in items:
        w = alnum(text)
        for p in range(max(1, len(w) - window + 1)):
            if w:
                phrases.setdefault(tuple(w[p:p + window]), set()).add(str(item))
    for row in rows:
        w, hit, found = alnum(row[1]), set(), set()
        for n in {len(p) for p in phrases}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in phrases:
                    hit.update(range(p, p + n))
                    found |= phrases[tuple(w[p:p + n])]
        yield row[0], len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string, phrase string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in D.decontaminate(docs, bench).collect()]
    assert Counter(got) == Counter(by_search(corpus, items))
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    none = D.decontaminate(docs, bench.limit(0))
    assert none.count() == len(corpus) and none.where("n_hit > 0 or contaminated").count() == 0


def test_shuffled_joins_agree(spark, docs, corpus, items, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(items, "item_id long, text string, phrase string")
    got = [(r.doc_id, r.n_hit) for r in D.decontaminate(docs, bench).collect()]
    assert Counter(got) == Counter((r[0], r[2]) for r in by_search(corpus, items))


def test_proximity(spark):
    texts = [(1, "zero alpha x beta gamma delta"), (2, "alpha beta gamma delta"), (3, "gamma delta only alpha"),
             (4, "beta alpha delta gamma one two"), (5, "alpha " + "far " * 9 + "beta gamma delta")]
    words = spark.createDataFrame(texts, "doc_id long, text string").select(
        "doc_id", F.col("doc_id").alias("row_no"), F.split("text", " ").alias("w"))
    phrases = spark.createDataFrame([("i", "alpha beta gamma delta", 4)], "item string, phrase string, size int")
    terms = D.rarest_terms(words, phrases, 2)
    index = D.positional_index(words, terms, 13)
    assert {r.row_no for r in D.phrase_matches(index, terms).collect()} == {2}
    assert {r.row_no for r in D.proximity_matches(index, terms, 2).collect()} == {1, 2, 4}


def test_licences(spark, corpus):
    rows = [(1, "Under THE MIT-License! the mit license"), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "apache license version 2"), (4, None), (5, ""), (6, "cc by nc"), (7, "cc by"),
            (8, "Some words first. This work is licensed under the GNU General Public License, version 3. And more."),
            (9, "This work here is licensed under the GNU General Public License version 3"), (10, "the mit"),
            (None, "the mit license"), (1, "plain words")] + [(r[0], r[1]) for r in corpus]
    rows = [(i if i is None else i + 1000 * (n < 12), t) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, template string, label string")
    got = scan_licenses(df)
    want = []
    for i, t in rows:
        w = alnum(t)
        places = [(p, lab) for phrase, lab in PHRASES for p in range(len(w))
                  if w[p:p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None),
                     ",".join(sorted({lab for _, lab in places}))))
    found = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter(want)
    labels = {r.doc_id: r["labels"] for r in found if r.doc_id in (1002, 1007, 1008, 1009, 1010)}
    assert labels == {1002: "apache-2", 1007: "", 1008: "gpl-3", 1009: "gpl-3", 1010: ""}
    assert all(0 <= r.score <= 1 for r in found)
    assert scan_licenses(df.limit(0)).count() == 0


def test_base_phrases_are_those_of_the_contract(spark):
    rows = [(1, "Released under the MIT License."), (2, "see the MIT License"), (3, "under the MIT-license, Under the mit license"),
            (4, "Apache License, Version 2.0"), (5, "CC BY-NC")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {
        1: (5, 1, 1, 1, "mit"), 2: (4, 0, None, None, ""), 3: (8, 2, 0, 4, "mit"), 4: (5, 1, 0, 0, "apache-2"),
        5: (3, 1, 0, 0, "cc-by-nc")}


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality(docs, corpus):
    one = Q.quality(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in one)
    assert got == Counter((r[0], *counted(r[1])) for r in corpus)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in one)
    assert all(not (r.kept and r.base_failed) for r in one)
    two = Q.quality(docs, model_bytes=0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, r.kept, round(r.log_perplexity or 0, 4))
    assert sorted(map(key, one)) == sorted(map(key, two))
    assert Q.quality(docs.limit(0)).count() == 0


@pytest.mark.parametrize("model_bytes", [Q.MODEL_BYTES, 0])
def test_languages_without_characters(spark, model_bytes):
    rows = [(1, "some text here " * 20, "en"), (2, None, "xx"), (3, "", "yy"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r for r in Q.quality(df, model_bytes=model_bytes).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].log_perplexity is not None
    assert all(got[i].log_perplexity is None and got[i].n_words == 0 and not got[i].kept for i in (2, 3, 4))


def direct_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition, on dictionaries."""
    table, counts = Q.fold_table(), Counter()
    for t in texts:
        codes = [0] * (order - 1) + [int(table[ord(c)]) for c in t]
        counts.update(tuple(codes[i - order + 1:i + 1]) for i in range(order - 1, len(codes)))
    p = {(): 1 / 64}
    for size in range(1, order + 1):
        level = counts
        for drop in range(order, size, -1):
            level = Counter(g[1:] for g in level)
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else None
        d = [i / 2 if y is None else min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        total, saved = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            saved[g[:-1]] += d[min(c, 3) - 1]
        for g, c in level.items():
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + saved[g[:-1]] / total[g[:-1]] * p[g[1:]]
    return p


def test_model_is_modified_kneser_ney(spark):
    texts = ["the cat sat on the mat, the cat ran.", "a dog ran at the cat", "the dog sat", "cat and dog and cat"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.gram: r.p for r in Q.kneser_ney(Q.count_grams(df, 3, 4), 3).collect()}
    want = {sum(c << (6 * (2 - i)) for i, c in enumerate(g)): v for g, v in direct_model(texts, 3).items() if len(g) == 3}
    assert got.keys() == want.keys()
    assert all(abs(got[g] - want[g]) < 1e-12 for g in want)
    by_context = Counter()
    for g, v in got.items():
        by_context[g >> 6] += v
    assert all(v <= 1 + 1e-9 for v in by_context.values())


def test_a_chunk_of_the_language_model_takes_little_memory():
    import tracemalloc

    from telluria.llm import quality as Q
    text, table = "some plain words " * (Q.CHUNK // 17), Q.fold_table()
    tracemalloc.start()
    Q.folded([text], 5, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
