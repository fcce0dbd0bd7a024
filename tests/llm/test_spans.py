"""Removal of repeated windows against direct search, on awkward rows."""

from collections import Counter

from telluria.llm import spans, suffix_dedup, superkmer
from telluria.llm.suffix_dedup import remove_earlier_text
from telluria.llm.superkmer import remove_repeated_windows

LAST = 2**63 - 1


def order(row):
    return LAST if row[0] is None else row[0]


def word_rule(rows, k):
    """n_words, n_removed, kept text of each row by the rule itself."""
    first = {}
    for row in rows:
        w = (row[1] or "").encode().split()
        for p in range(len(w) - k + 1):
            s = tuple(w[p:p + k])
            first[s] = min(first.get(s, (LAST, LAST)), (order(row), p))
    for row in rows:
        w = (row[1] or "").encode().split()
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < (order(row), p):
                gone.update(range(p, p + k))
        yield row[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def byte_rule(rows, k):
    first = {}
    for row in rows:
        t = (row[1] or "").encode()
        for p in range(len(t) - k + 1):
            first[t[p:p + k]] = min(first.get(t[p:p + k], LAST), order(row))
    for row in rows:
        t = (row[1] or "").encode()
        gone = set()
        for p in range(len(t) - k + 1):
            if first[t[p:p + k]] < order(row):
                gone.update(range(p, p + k))
        runs = sum(i - 1 not in gone for i in gone)
        yield row[0], len(t), len(gone), runs, bytes(x for i, x in enumerate(t) if i not in gone)


def test_words(docs, corpus):
    got = remove_repeated_windows(docs, carry=("lang", "node"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "spans", "carried"]
    rows = got.select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, rows)) == Counter(word_rule(corpus, 20))
    assert {r[0].node for r in got.select("carried").collect()} == {"x"}


def test_bytes(docs, corpus):
    rows = remove_earlier_text(docs).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    assert got == Counter(byte_rule(corpus, 50))


def test_many_small_tasks_give_the_same(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(superkmer, "BUCKET", 5000)
    monkeypatch.setattr(superkmer, "BLOCK", 5000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 5000)
    rows = remove_repeated_windows(docs.repartition(7), k=5, m=2).select("doc_id", "n_words", "n_removed", "kept_text")
    assert Counter(map(tuple, rows.collect())) == Counter(word_rule(corpus, 5))
    got = Counter((r.doc_id, r.n_removed) for r in remove_earlier_text(docs.repartition(7)).collect())
    assert got == Counter((r[0], r[2]) for r in byte_rule(corpus, 50))


def test_layout_is_kept(spark):
    a = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (2, f"one\n\ntwo {a}\nthree  four")], "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in remove_repeated_windows(df, layout=True).collect()}
    assert got[2] == ("one\n\ntwo three  four", 24, 20) and got[1] == (a, 20, 0)


def test_no_rows(docs):
    assert remove_repeated_windows(docs.limit(0)).count() == 0
    assert remove_earlier_text(docs.limit(0)).count() == 0


def test_two_windows_with_one_hash_stay_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(superkmer, "window_keys", lambda letters, start, stop: np.zeros(len(start), np.uint64))
    raw = b"one two three\none two three\none two thres"
    starts, stops = np.array([0, 14, 28]), np.array([13, 27, 41])
    assert superkmer.repeated_windows(raw, starts, stops, np.arange(3)).tolist() == [False, True, False]


def test_covered():
    import numpy as np

    got = spans.covered(np.array([[0, 5], [2, 4], [5, 7], [9, 12], [10, 11]]))
    assert got.tolist() == [[0, 7], [9, 12]]


def test_a_task_holds_one_part_at_a_time():
    import pyarrow as pa

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    text = " ".join(f"w{i % 500}x{i % 7}" for i in range(60_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text + " end"]), pa.array([3, 4])],
                                       names=["doc_id", "text", "print"])
    run = superkmer.superkmer_parcels(Docs(), 20, 4, [0, 1], [0])
    parts = run(iter([batch, batch]))
    next(parts)
    held = parts.gi_frame.f_locals
    assert not any(isinstance(v, bytes) or len(v) > 1000 for k, v in held.items() if hasattr(v, "__len__") and k != "hashes")
    assert superkmer.CHUNK <= 1 << 21


def test_a_bucket_takes_a_few_times_its_text():
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(1200)]
    texts += [texts[0], "x " + texts[1]]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts, "print": list(range(len(texts)))})

    class Rows:
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            return Rows(list(run(iter(self.batches))))

        def repartition(self, *how):
            return self

    sent = superkmer.superkmer_parcels(Rows([batch]), 20, 4, [0], [0])
    size = sum(len(spans.unpack(b)) for s in sent.batches for k, b in zip(*map(pa.Array.to_pylist, (s["kind"], s["body"]))) if k == 2)
    tracemalloc.start()
    found = superkmer.bucket_spans(sent, 1, 20, [0]).batches
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 4 << 20 and found
    assert peak < 7 * size + (8 << 20)
