"""Packing, chat, web pages, archives and the pipeline: round trips."""

import gzip
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from telluria.llm import packing, warc
from telluria.llm.chat import conversation_digests, prefix_examples
from telluria.llm.html_text import render, visible_text

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size,windows,keep", [(2048, 64, True), (64, 2, False)])
def test_packing(docs, corpus, size, windows, keep):
    tok = tokenizers.Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs.repartition(3, "doc_id"), PATH, size=size, windows=windows, keep_ids=keep).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in got:
        assert (r.ids is not None) == keep and (not keep or zlib.crc32(r.ids) == r.ids_crc32)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = defaultdict(list)
    for i, t, *_ in corpus:
        want[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for i, texts in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            for r in pieces[i]:
                assert zlib.crc32(texts[0][r.start:r.start + r.length].tobytes()) == r.ids_crc32
                assert r.doc_tokens == len(texts[0])
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    tok, enc = tokenizers.Tokenizer.from_file(PATH), packing.encoder(PATH)
    for t in ("Hello  world", " lead", "tail ", "a\nb \n c\n\n d", "it's we'll 'tis", "x\u00a0y\x85z", "<|endoftext|> a", "日本 語",
              "tab\tx \t y", "é ñ ß Ÿ", "1 22 333", "a" * 300, " ", "\n", "", "\x1c \x1f", "emoji 🙂 ok"):
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_fullest_window_leaves_when_none_fits():
    box = packing.Windows(10, 2)
    assert box.place("a", 7) is None and box.place("b", 6) is None
    assert box.place("c", 4) == ["b", "c"]  # the best fit, now full
    assert box.place("d", 8) is None and box.place("e", 5) == ["d"]


def test_chat(spark):
    rows = [(1, 0, "system", "s<s>"), (1, 1, "user", "q\\1</s>"), (1, 2, "assistant", "r\\"), (1, 3, "user", None),
            (1, 4, "assistant", "\\0\n<s>"), (2, 0, "user", "only"), (2, 1, None, "x"), (3, 0, "assistant", ""),
            (None, 5, "user", "n"), (None, None, "assistant", "first"), (4, 1, "user", "b"), (4, 1, "user", "a"),
            (4, 1, "user", "a"), (5, 0, "a\nb</s>", "t")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows],
                               "conv_id long, turn long, role string, text string, turns string, upto string")
    examples = prefix_examples(df)
    got = {r.conv_id: r for r in conversation_digests(examples).collect()}
    grouped = defaultdict(list)
    for c, n, role, text in rows:
        grouped[c].append((-1 if n is None else n, role or "", text or ""))
    assert got.keys() == grouped.keys()
    for c, turns in grouped.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(said), len(loss), digest(loss))
    one = examples.where("conv_id = 1").orderBy("example_no").collect()
    assert [e.target_turn for e in one] == [2, 4] and one[1].text.startswith(one[0].text)
    assert conversation_digests(prefix_examples(df.limit(0))).count() == 0


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("a&amp;b", "a&b"), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<li><p>b</ol>", "3. a\n4. b"), ("x<br>y <b>z\n  w", "x\ny z w"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<style>.h{display:none}</style><p class='q h'>no</p><p>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>", "yes"),
    ("<script>if (a<b) '</p>'</script>t<!-- c -->u<template>v</template>", "tu"),
    ("<pre> a\n  b</pre>", " a\n  b"), ("<a title='x>y'>z</a><p", "z<p"), ("</p>x</div>", "x"),
    ("<td>1<td>2", "1 2"), ("<details><summary>s</summary>no</details>", "s"), ("<select><option>a<option selected>b", "b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("a<hr>b", "a\n\n---\n\nb"),
    ("<div>" * 3000 + "deep", "deep"), ("<blockquote>q</blockquote>", "    q")])
def test_pages(page, text):
    assert render(page) == text


def test_visible_text(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (None, None, "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, visible_text(df).collect()), key=str) == sorted([(1, "a"), (None, ""), (1, "a")], key=str)
    assert visible_text(df.limit(0)).count() == 0


PAGES = [(i, f"http://h{i % 7}.example.com/p/{i % 40}?q=é {i}", f"<p>{i // 3}") for i in range(120)] + [
    (200, None, None), (201, "http://h1.example.com/p/1", ""), (202, "not a url", "<p>x"), (203, "http://[bad/", "<p>x"),
    (204, "http://h1.example.com/p/1", "x" * 300_000), (205, "http://h1.example.com/p/1", "y\r\n\r\nWARC/1.1")]


def test_archives_and_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    archives, index = warc.archive_and_index(df, str(tmp_path), parts=4)
    got = {r.page_id: r for r in warc.read_records(spark, archives, warc.find_captures(spark, index, warc.keys_of(df))).collect()}
    assert len(got) == len(PAGES)
    leader = {}
    for i, _, h in PAGES:
        leader[h or ""] = max(leader.get(h or "", -1), i)
    for i, _, h in PAGES:
        r, raw = got[i], (h or "").encode()
        again = leader[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", leader[h or ""]) if again else ("response", None))
        assert r.payload_bytes == len(raw) and bytes(r.payload) == (b"" if again else raw)
    some = df.where("page_id in (201, 202)")
    few = warc.find_captures(spark, index, warc.keys_of(some)).collect()
    assert {r.page_id for r in few} == {201, 202, 204, 205}
    # The files are ordinary archives.
    whole = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "archives").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives, index = warc.archive_and_index(df, str(tmp_path))
    assert warc.find_captures(spark, index, warc.keys_of(df)).count() == 0


def test_pipeline(spark, docs, corpus, tmp_path):
    import corpus_pipeline as P
    from llm.test_spans import word_rule

    from telluria.llm.ngram_join import jaccard_components
    from telluria.llm.quality import quality

    spark.createDataFrame([(1, " ".join(corpus[5][1].split()[:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    plain = docs.select(*P.COLUMNS)
    good = stages["quality_rules"](spark, plain, str(tmp_path))
    gone = {r.doc_id for r in quality(plain).where("not kept").collect()}
    assert sorted(r.doc_id for r in good.where("doc_id is not null").collect()) == sorted(
        r[0] for r in corpus if r[0] is not None and r[0] not in gone)
    single = stages["ngram_jaccard_join"](spark, plain, str(tmp_path))
    heads = {r.component_id for r in jaccard_components(plain).collect()} - {None}
    assert {r.doc_id for r in single.where("doc_id is not null").collect()} == heads
    rows = [tuple(r) for r in single.select("doc_id", "text").collect()]
    cut = stages["substring_dedup"](spark, single, str(tmp_path)).collect()
    kept = [(i, t) for i, n, gone_, t in word_rule(rows, 20) if not gone_ or gone_ < n]
    squeeze = lambda t: " ".join(t.encode().split() and [x.decode() for x in t.encode().split()])
    assert sorted(((r.doc_id, squeeze(r.text)) for r in cut), key=str) == sorted(kept, key=str)
    clean = stages["benchmark_decontamination"](spark, plain, str(tmp_path))
    assert clean.columns == list(P.COLUMNS) and 5 not in {r.doc_id for r in clean.collect()}
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() > 0 and out.where(F.col("ids").isNull()).count() == 0


def test_pipeline_drops_copies_of_four_fifths(spark, tmp_path):
    """81 % of the five-word shingles are shared, and of the four-word ones too."""
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(100)]
    texts = [base, base[:90] + [f"x{i}" for i in range(10)], base[:85] + [f"y{i}" for i in range(15)]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 2}
