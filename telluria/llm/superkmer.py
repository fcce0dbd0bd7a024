"""Substring dedup by super-k-mers: repeated windows of words are found exactly
and all but their first occurrence is removed.

The minimiser of a window is its group of ``m`` words with the least hash.
Consecutive windows with one minimiser travel as a single packed string to the
minimiser's bucket, so equal windows meet in one bucket although each word is
sent about three times and not ``k`` times.  There the strings are cut into
windows, which are sorted; equal neighbours are compared word by word.

A task sends a string that it has met before only once, from its first place; the
later places are removed on the spot.  So a passage that a third of all documents
share costs its bucket one string a task, not one a document.

* Words are runs of anything but blanks and ``\\t\\n\\v\\f\\r``, unchanged; null
  texts have none.  Documents below ``k`` words lose nothing.
* First means: smaller id, or the same id and an earlier start; null ids come
  last.  Rows with one id are one document for that rule; rows that are equal in
  id and text both keep what their first place keeps.
* Columns named in ``carry`` come back in a struct, so no name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from telluria.llm import spans as S

CHUNK = 1 << 21  # text bytes that a task handles at once
BUCKET = 6 << 20  # text bytes that a bucket gets, each word counted once
BLOCK = 1 << 24
PAIRS = 1 << 16  # windows compared at once


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each ``m`` consecutive word hashes."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(m):
        total = (total + words[j:j + n]) * np.uint64(0x9FB21C651E98DF25)
    return S.mix(total)


def _cut(part: pa.RecordBatch, k: int, m: int, hashes: WordHashes):
    """Words of a batch, its super-k-mers and where they go."""
    lists = [x.split() for x in part.column("text").cast(pa.binary()).to_pylist()]
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    words = [w for x in lists for w in x]
    begin = np.cumsum(count) - count
    value = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = gram_hashes(value, m)
    place = S.minimisers(grams, k - m + 1)
    first, last, owner = S.window_runs(place, begin, np.maximum(count - k + 1, 0))
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return text, starts[first] if len(first) else first, ends[last + k - 1] if len(first) else first, \
        grams[place[first]] if len(first) else first, owner, first - begin[owner] if len(first) else first, last - first


def superkmer_parcels(docs: DataFrame, k: int, m: int, buckets: list[int], blocks: list[int]) -> DataFrame:
    """Strings for the buckets (kind 2) and spans removed on the spot (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in S.slices(batch, CHUNK):
                # A function of its own: nothing of a part outlives it.
                rows = _part_parcels(part, k, m, hashes, buckets, blocks)
                if rows:
                    yield S.parcels(rows)

    return docs.mapInArrow(run, S.PARCEL)


def _part_parcels(part: pa.RecordBatch, k: int, m: int, hashes: WordHashes, buckets: list[int],
                  blocks: list[int]) -> list[tuple]:
    ids, marks = S.order_ids(part.column("doc_id")), S.prints(part.column("print"))
    text, a, b, key, owner, start, more = _cut(part, k, m, hashes)
    if not len(a):
        return []
    order = np.lexsort((start, ids[owner]))  # the first place of a string comes first
    firsts, sent, gone = {}, [], []
    who, at = ids[owner].tolist(), start.tolist()
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        j = firsts.setdefault(text[x:y], i)
        # An equal row has the same place once more, which is no repeat.
        (sent if i == j or (who[i], at[i]) == (who[j], at[j]) else gone).append(i)
    del firsts, who, at, order
    gone = np.array(gone, np.int64)
    rows = S.span_parcels(ids[owner[gone]], marks[owner[gone]], start[gone], start[gone] + more[gone] + k, blocks)
    sent = np.array(sent, np.int64)
    to = ((key[sent] >> np.uint64(7)) % np.uint64(len(buckets))).astype(np.int64)
    by = np.argsort(to, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        i = sent[group]
        docs_here, local = np.unique(owner[i], return_inverse=True)
        head = np.concatenate([[len(docs_here), len(i)], np.diff(ids[docs_here], prepend=0), marks[docs_here],
                               np.diff(local, prepend=0), np.diff(start[i], prepend=0)])
        body = b"\n".join([text[x:y] for x, y in zip(a[i].tolist(), b[i].tolist())])
        rows.append((buckets[to[group[0]]], 2, S.pack(head.astype(np.int64).tobytes()), S.pack(body)))
    return rows


def window_keys(letters: np.ndarray, start: np.ndarray, stop: np.ndarray, stretch: int = 1 << 17) -> np.ndarray:
    """A hash of the bytes from each start to its stop, by running sums over a
    stretch of the text at a time; starts are in order."""
    base = np.uint64(0x9E3779B97F4A7C15)
    longest = stretch + int((stop - start).max(initial=0)) + 1
    power = np.cumprod(np.full(longest, base))
    back = np.cumprod(np.full(longest, np.uint64(pow(int(base), -1, 1 << 64))))
    code, keys, at = mixed_bytes(), np.empty(len(start), np.uint64), 0
    while at < len(start):
        begin = int(start[at])
        upto = int(np.searchsorted(start, begin + stretch))
        here = slice(at, upto)
        value = code[letters[begin:int(stop[here].max())]]
        value *= power[:len(value)]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        keys[here] = S.mix((run[stop[here] - begin] - run[start[here] - begin]) * back[start[here] - begin])
        at = upto
    return keys


def mixed_bytes() -> np.ndarray:
    return S.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def same_text(raw: bytes, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes at the places of ``one`` and ``two`` equal?"""
    if int(size.min(initial=8)) < 8:
        return np.array([raw[a:a + n] == raw[b:b + n] for a, b, n in zip(one.tolist(), two.tolist(), size.tolist())], bool)
    at = S.words_at(raw)
    equal = np.ones(len(one), bool)
    for off in range(0, int(size.max(initial=0)), 8):
        i = np.flatnonzero(size > off)
        step = np.minimum(off, size[i] - 8)  # the last 8 bytes may overlap those before
        equal[i] &= at[one[i] + step] == at[two[i] + step]
    return equal


def repeated_windows(raw: bytes, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows of a text are also there with a lower rank?  Equal
    neighbours in hash order are compared byte by byte."""
    if not len(start):
        return np.zeros(0, bool)
    key = window_keys(np.frombuffer(raw, np.uint8), start, stop)
    by = np.argsort(key)
    same = np.diff(key[by]) == 0
    del key
    i, sure = np.flatnonzero(same), True
    for a in range(0, len(i), PAIRS):
        one, two = by[i[a:a + PAIRS]], by[i[a:a + PAIRS] + 1]
        size, other = stop[one] - start[one], stop[two] - start[two]
        sure = sure and bool(((size == other) & same_text(raw, start[one], start[two], np.minimum(size, other))).all())
    del i
    if not sure:  # two windows with one hash: order these by their bytes
        texts = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        by = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        same = np.array([texts[x] == texts[y] for x, y in zip(by[1:], by[:-1])], bool)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(rank[by], first)
    out = np.zeros(len(start), bool)
    out[by] = rank[by] > np.repeat(least, np.diff(np.append(first, len(by))))
    return out


def string_windows(raw: bytearray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, string and place in it of each window of ``k`` words;
    strings end at line ends, words at blanks."""
    letters = np.frombuffer(raw, np.uint8)
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    gaps = np.concatenate([a + np.flatnonzero((part == 32) | (part == 10)).astype(kind)
                           for a in range(0, len(raw), 1 << 20) for part in [letters[a:a + (1 << 20)]]])
    last = np.append(np.flatnonzero(letters[gaps] == 10), len(gaps))  # last word of each string
    begin = np.concatenate([[0], last[:-1] + 1])
    count = last - begin + 2 - k
    piece = np.repeat(np.arange(len(count), dtype=kind), count)
    step = np.arange(len(piece), dtype=kind)
    step -= np.repeat((np.cumsum(count) - count).astype(kind), count)
    word = begin.astype(kind)[piece]
    word += step
    bounds = np.concatenate([np.full(1, -1, kind), gaps, np.full(1, len(raw), kind)])
    return bounds[word] + kind(1), bounds[word + kind(k)], piece, step


def bucket_spans(parcels: DataFrame, n: int, k: int, blocks: list[int]) -> DataFrame:
    """Sort the windows of each bucket; spans of all but first occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, doc, mark, at, passed = bytearray(), [], [], [], []
        for batch in batches:
            for slot, kind, head, body in zip(*[batch.column(c).to_pylist() for c in ("slot", "kind", "head", "body")]):
                if kind == 1:
                    passed.append((slot, kind, head, body))
                    continue
                h = np.frombuffer(S.unpack(head), np.int64)
                d, s = int(h[0]), int(h[1])
                local = np.cumsum(h[2 + 2 * d:2 + 2 * d + s])
                doc.append(np.cumsum(h[2:2 + d])[local])
                mark.append(h[2 + d:2 + 2 * d][local])
                at.append(np.cumsum(h[2 + 2 * d + s:]))
                if raw:
                    raw += b"\n"
                raw += S.unpack(body)
        if passed:
            yield S.parcels(passed)
        if not raw:
            return
        doc, mark, at = map(np.concatenate, (doc, mark, at))
        start, stop, piece, step = string_windows(raw, k)
        _, docrank = np.unique(doc, return_inverse=True)
        rank = (docrank.astype(np.int64) << 36)[piece]
        rank += at[piece]
        rank += step
        i = np.flatnonzero(repeated_windows(raw, start, stop, rank))
        if len(i):
            new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(piece[i]) != 0)])
            f = np.flatnonzero(new)
            a, b = i[f], i[np.append(f[1:], len(i)) - 1]
            yield S.parcels(S.span_parcels(doc[piece[a]], mark[piece[a]], at[piece[a]] + step[a],
                                           at[piece[a]] + step[b] + k, blocks))

    return parcels.repartition(n, "slot").mapInArrow(run, S.PARCEL)


WORD = re.compile(rb"[^ \t-\r]+")


def _finish(text: bytes, spans: np.ndarray):
    words = text.split()
    runs = S.covered(spans)
    kept, last = [], 0
    for a, b in runs.tolist():
        kept += words[last:a]
        last = b
    kept += words[last:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode(), [x for r in runs.tolist() for x in r]


def _finish_laid_out(text: bytes, spans: np.ndarray):
    """As above, but what is left keeps its blanks and line ends."""
    runs = S.covered(spans).tolist()
    places = [m.span() for m in WORD.finditer(text)] if runs else []
    kept, last, gone = [], 0, 0
    for a, b in runs:
        kept.append(text[last:places[a][0]])
        last = places[b][0] if b < len(places) else len(text)
        gone += b - a
    kept.append(text[last:])
    return len(places) if runs else len(text.split()), gone, b"".join(kept).decode(), [x for r in runs for x in r]


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4,
                            carry: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_text, spans, carried``.

    ``kept_text`` joins the remaining words by one blank, or with ``layout``
    keeps what stood between them; ``spans`` lists the removed word ranges as
    start, stop, start, stop.
    """
    spark = df.sparkSession
    docs = S.keyed(df, id_col, text_col, carry)
    total = S.text_bytes(docs)
    buckets, blocks = S.slots(spark, total // BUCKET + 1), S.slots(spark, total // BLOCK + 1)
    sent = superkmer_parcels(docs, k, m, buckets, blocks)
    spans = bucket_spans(sent, len(buckets), k, blocks)
    carried = docs.schema["carried"].dataType.simpleString()
    return S.meet(S.document_parcels(docs, blocks).unionByName(spans), len(blocks),
                  _finish_laid_out if layout else _finish,
                  "n_words bigint, n_removed bigint, kept_text string, spans array<bigint>", carried)
