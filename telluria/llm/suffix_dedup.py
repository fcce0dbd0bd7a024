"""Suffix-array dedup of bytes: text that repeats from an earlier document goes.

Blockwise construction over a cover sample.  Each ``k``-byte window holds at
least one sample, the first ``m`` bytes group with the least hash among those in
it (its minimiser), and equal windows hold theirs at the same offset: the two
properties that a difference cover guarantees for positions modulo v, here kept
across documents, whose positions have nothing in common.  A suffix belongs to
the block of its sample, so equal windows meet, and one task sorts one block.

In a block only the samples are sorted, once by the text that follows and once
by the text that precedes them, and get ranks and common-prefix lengths.  No two
long suffixes are compared again: a window at ``o`` bytes before its sample
equals another one exactly if both samples share a class of depth ``o`` to the
left and of depth ``k - o`` to the right, which the ranks tell.

* Texts are their UTF-8 bytes, null is empty; matches never cross documents.
  Texts below ``k`` bytes lose nothing.
* A byte goes if a ``k``-byte string over it also starts in a document with a
  smaller id (null ids come last).  Rows with the same id never remove each
  other's bytes, so repeated rows keep the same ones.
* A task sends a string that it holds several times once, with its places in the
  earliest of its documents; the other documents' places go on the spot.
* Columns named in ``carry`` come back in a struct, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from telluria.llm import spans as S

CHUNK = 3 << 20
BUCKET = 10 << 20
BLOCK = 1 << 24


def byte_hashes(text: bytes, m: int) -> np.ndarray:
    """A hash of each ``m`` consecutive bytes, ``m`` a multiple of 8."""
    n = len(text) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = S.words_at(text)
    total = np.zeros(n, np.uint64)
    for j in range(0, m, 8):
        total = (total + x[j:j + n]) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    return S.mix(total)


def _steps(x: np.ndarray) -> np.ndarray:
    """First differences, which pack better than the numbers."""
    return np.diff(x, prepend=0)


def segment_parcels(docs: DataFrame, k: int, m: int, buckets: list[int], blocks: list[int]) -> DataFrame:
    """Stretches of text around samples for the blocks of suffixes (kind 2), and
    spans removed on the spot (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, CHUNK):
                ids, marks = S.order_ids(part.column("doc_id")), S.prints(part.column("print"))
                texts = part.column("text").cast(pa.binary()).to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                begin = np.cumsum(size) - size
                text = b"".join(texts)
                grams = byte_hashes(text, m)
                place = S.minimisers(grams, k - m + 1)
                first, last, owner = S.window_runs(place, begin, np.maximum(size - k + 1, 0))
                if not len(first):
                    continue
                start, more, sample = first - begin[owner], last - first, place[first] - first
                order = np.lexsort((start, ids[owner]))
                who = ids[owner].tolist()
                firsts: dict[bytes, int] = {}
                entry, sent, gone = [], [], []
                for i, x, y in zip(order.tolist(), first[order].tolist(), (last[order] + k).tolist()):
                    j = firsts.setdefault(text[x:y], i)
                    if who[i] == who[j]:
                        entry.append(j)
                        sent.append(i)
                    else:
                        gone.append(i)
                gone, entry, sent = (np.array(v, np.int64) for v in (gone, entry, sent))
                rows = S.span_parcels(ids[owner[gone]], marks[owner[gone]], start[gone], start[gone] + more[gone] + k,
                                      blocks)
                to = ((grams[place[first[entry]]] >> np.uint64(7)) % np.uint64(len(buckets))).astype(np.int64)
                by = np.lexsort((entry, to))
                for group in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                    i, e = sent[group], entry[group]
                    docs_here, local = np.unique(owner[i], return_inverse=True)
                    each, piece = np.unique(e, return_inverse=True)
                    sizes = np.array([len(docs_here), len(i), len(each)], np.int64)
                    head = np.concatenate([sizes, _steps(ids[docs_here]), marks[docs_here]]).astype(np.int64).tobytes()
                    refs = np.concatenate([_steps(local), _steps(piece), _steps(start[i])]).astype(np.int32).tobytes()
                    shape = np.concatenate([sample[each], more[each]]).astype(np.uint8).tobytes()
                    body = b"".join([text[x:y] for x, y in zip(first[each].tolist(), (last[each] + k).tolist())])
                    rows.append((buckets[to[group[0]]], 2, S.pack(head + refs + shape), S.pack(body)))
                yield S.parcels(rows)

    return docs.mapInArrow(run, S.PARCEL)


def ranked(around: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the bytes that each shares with
    the row before it in that order; a row ends after its ``length``."""
    n, width = around.shape
    wide = np.zeros((n, (width + 7) // 8 * 8), np.uint8)
    wide[:, :width] = around
    columns = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    order = np.lexsort((length, *columns.T[::-1]))
    a, b = around[order[1:]], around[order[:-1]]
    differ = a != b
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(length[order[1:]], length[order[:-1]]))
    return order, np.concatenate([[-1], shared])


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's class of rows with the same first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def _shared(text: bytes, at: np.ndarray, size: int, doc: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes at a place also there in another document?  Hashes
    decide: a needless yes costs a comparison, nothing else."""
    if not len(at):
        return np.zeros(0, bool)
    words, key = S.words_at(text), np.zeros(len(at), np.uint64)
    for off in (*range(0, size - 8, 8), size - 8):
        key = (key ^ words[at + off]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(32)
    by = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
    low, high = np.minimum.reduceat(doc[by], first), np.maximum.reduceat(doc[by], first)
    out = np.empty(len(at), bool)
    out[by] = np.repeat(low != high, np.diff(np.append(first, len(by))))
    return out


def earlier_windows(raw: bytes, begin: np.ndarray, sample: np.ndarray, more: np.ndarray, ref_piece: np.ndarray,
                    ref_doc: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (piece, offset in the piece) that also start in a piece of an
    earlier document.  All places of a piece are in one document, ``ref_doc``."""
    text = np.frombuffer(raw, np.uint8)
    doc = np.empty(len(begin), np.int64)
    doc[ref_piece] = ref_doc
    anchor = begin + sample
    right = more + k - sample
    # A window holds at least half of its bytes on one side of the sample: only
    # samples that share such a half with another document can tell anything.
    half = k // 2
    live = np.zeros(len(begin), bool)
    for back, size, has in ((0, half, right >= half), (k - half + 1, k - half + 1 + m, sample > k - half)):
        who = np.flatnonzero(has)
        live[who] |= _shared(raw, anchor[who] - back, size, doc[who])
    live = np.flatnonzero(live)
    if not len(live):
        return live, live
    anchor, left, right, doc, more = anchor[live], sample[live], right[live], doc[live], more[live]
    padded = np.concatenate([np.zeros(k, np.uint8), text, np.zeros(k, np.uint8)])
    after = np.stack([np.where(c < right, padded[k + anchor + c], 0) for c in range(k)], axis=1).astype(np.uint8)
    before = np.stack([np.where(c < left, padded[k + anchor - 1 - c], 0) for c in range(k - m)], axis=1).astype(np.uint8)
    forward, backward = ranked(after, right), ranked(before, left)
    pieces, offsets = [], []
    for o in range(k - m + 1):
        has = np.flatnonzero((left >= o) & (left - o <= more))
        if len(has) < 2:
            continue
        l, r = classes(*backward, o)[has], classes(*forward, k - o)[has]
        busy = (np.bincount(l)[l] > 1) & (np.bincount(r)[r] > 1)
        has, both = has[busy], (l[busy] << 32) | r[busy]
        if not len(has):
            continue
        by = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(both[by]) != 0]))
        least = np.repeat(np.minimum.reduceat(doc[has[by]], first), np.diff(np.append(first, len(by))))
        gone = has[by][doc[has[by]] > least]
        pieces.append(live[gone])
        offsets.append(left[gone] - o)
    if not pieces:
        return live[:0], live[:0]
    return np.concatenate(pieces), np.concatenate(offsets)


def block_spans(parcels: DataFrame, n: int, k: int, m: int, blocks: list[int]) -> DataFrame:
    """Sort the suffixes of one block at a time; spans of earlier text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        bodies, passed, have = [], [], 0
        for batch in batches:
            for slot, kind, head, body in zip(*[batch.column(c).to_pylist() for c in ("slot", "kind", "head", "body")]):
                if kind == 1:
                    passed.append((slot, kind, head, body))
                    continue
                raw = S.unpack(head)
                d, r, e = np.frombuffer(raw, np.int64, 3).tolist()
                ids = np.frombuffer(raw, np.int64, 2 * d, 24)
                refs = np.cumsum(np.frombuffer(raw, np.int32, 3 * r, 24 + 16 * d).reshape(3, r).astype(np.int64), axis=1)
                shape = np.frombuffer(raw, np.uint8, 2 * e, 24 + 16 * d + 12 * r).astype(np.int64)
                local = refs[0]
                for box, x in zip(got, (np.cumsum(ids[:d])[local], ids[d:][local], refs[1] + have, refs[2],
                                        shape[:e], shape[e:])):
                    box.append(x)
                bodies.append(S.unpack(body))
                have += e
        if passed:
            yield S.parcels(passed)
        if not have:
            return
        doc, mark, piece, at, sample, more = map(np.concatenate, got)
        text = b"".join(bodies)
        got.clear()
        bodies.clear()
        size = more + k
        begin = np.cumsum(size) - size
        _, rank = np.unique(doc, return_inverse=True)
        p, o = earlier_windows(text, begin, sample, more, piece, rank.astype(np.int64), k, m)
        if not len(p):
            return
        by = np.lexsort((o, p))
        p, o = p[by], o[by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(o) != 1)]))
        runs = p[new], o[new], o[np.append(new[1:], len(p)) - 1] + k  # piece, from, to
        # Every place of a piece has its runs.
        where = np.argsort(piece, kind="stable")
        lo, hi = np.searchsorted(piece[where], runs[0]), np.searchsorted(piece[where], runs[0], side="right")
        each = np.repeat(np.arange(len(new)), hi - lo)
        ref = where[np.repeat(lo, hi - lo) + np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        yield S.parcels(S.span_parcels(doc[ref], mark[ref], at[ref] + runs[1][each], at[ref] + runs[2][each], blocks))

    return parcels.repartition(n, "slot").mapInArrow(run, S.PARCEL)


def _finish(text: bytes, spans: np.ndarray):
    runs = S.covered(spans).tolist()
    kept, last = [], 0
    for a, b in runs:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    left = b"".join(kept)
    return len(text), len(text) - len(left), len(runs), left, [x for r in runs for x in r]


def remove_earlier_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 8,
                        carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept, spans, carried``.

    ``kept`` is binary, for a cut may fall inside a character; ``spans`` lists
    the removed byte ranges as start, stop, start, stop.
    """
    spark = df.sparkSession
    docs = S.keyed(df, id_col, text_col, carry)
    total = S.text_bytes(docs)
    buckets, blocks = S.slots(spark, total // BUCKET + 1), S.slots(spark, total // BLOCK + 1)
    sent = segment_parcels(docs, k, m, buckets, blocks)
    spans = block_spans(sent, len(buckets), k, m, blocks)
    carried = docs.schema["carried"].dataType.simpleString()
    return S.meet(S.document_parcels(docs, blocks).unionByName(spans), len(blocks), _finish,
                  "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<bigint>", carried)
