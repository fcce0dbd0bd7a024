"""Bounded-space online packing of token documents into fixed sequences.

Each task packs its documents in scan order with at most ``windows`` open
sequences: a document's whole sequences leave at once, its rest goes where it
fits best; where it fits nowhere and no window may be opened, the fullest window
leaves.  Windows still open at the end of a task are the leftovers, which are
merged: groups of them are laid end to end and cut at full sequences.

* Token ids are those of the given tokenizer file, followed by ``end_id``.  Null
  or empty texts are their ``end_id`` alone; nothing is dropped, every id lies in
  exactly one piece, so repeated rows are packed once each.
* A text's ids come from a cache of its blank-separated parts, which byte-level
  BPE never merges across; texts in which that would not hold (runs of blanks,
  characters outside Latin script, special tokens) are encoded whole.
* ``sequence_id`` is made of the task's partition (or the leftover group) and a
  running number: unique, and the same if a task runs again.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria.session import materialize

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")
OPEN = ", origin long, no long"
MERGED = 1 << 62
GROUP = 512  # leftover windows merged by one task
# Texts made of these characters alone are cut at blanks: the blank classes of
# all pattern engines agree on them.
ODD = re.compile("[^\t\n\r -~¡-ɏ]|  ")


class Encoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.parts: dict[bytes, bytes] = {}
        self.most = most
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = self._ranks(path)

    def _ranks(self, path: str):
        """The same merges in a quicker library, where the file is plain byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") \
                or spec.get("normalizer"):
            return None
        import public_tokenizers
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = self.quick.encode_ordinary(text) if self.quick else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.quick is None or ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.parts
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for part in set(rest):
                if part not in known:
                    known[part] = self._ids(" " + part)
            tail = b"".join(map(known.__getitem__, rest))
        return (self._ids(first) if first else b"") + tail


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """At most ``most`` open sequences, ordered by what is free in them."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free = size, most, []  # free: (room, number of the window)
        self.content: dict[int, list] = {}
        self.count = 0

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece into the window it fits best; the content of a window
        that had to leave, or that is now full."""
        left = None
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, n = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                left = self.content.pop(self.free.pop(0)[1])
            room, n = self.size, self.count
            self.count += 1
            self.content[n] = []
        self.content[n].append(piece)
        if room > length:
            bisect.insort(self.free, (room - length, n))
            return left
        return self.content.pop(n)  # full: then it was open, or one full piece, and nothing else left


def _rows(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    """Rows (doc, start, ids, tokens, sequence, offset, origin, no) as a batch."""
    doc, start, ids, tokens, sequence, offset, origin, no = zip(*rows) if rows else ((),) * 8
    kept = [x if keep_ids or s is None else None for x, s in zip(ids, sequence)]
    n = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, n), pa.array(start, n), pa.array([len(x) // 4 for x in ids], n),
         pa.array([zlib.crc32(x) for x in ids], n), pa.array(tokens, n), pa.array(sequence, n), pa.array(offset, n),
         pa.array(kept, pa.binary()), pa.array(origin, n), pa.array(no, n)],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "origin", "no"])


def pack_partitions(docs: DataFrame, path: str, size: int, windows: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of each task's sequences; those of windows left open have no sequence."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        origin = TaskContext.get().partitionId()
        box, sequence = Windows(size, windows), origin << 32

        def close(content: list) -> list[tuple]:
            nonlocal sequence
            rows, offset = [], 0
            for doc, start, ids, tokens in content:
                rows.append((doc, start, ids, tokens, sequence, offset, origin, None))
                offset += len(ids) // 4
            sequence += 1
            return rows

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                tokens = len(ids) // 4
                full = tokens // size * size
                for at in range(0, full, size):
                    rows += close([(doc, at, ids[4 * at:4 * (at + size)], tokens)])
                if tokens > full:
                    left = box.place((doc, full, ids[4 * full:], tokens), tokens - full)
                    if left:
                        rows += close(left)
                held += len(ids)
                if held > 1 << 22:
                    yield _rows(rows, keep_ids)
                    rows, held = [], 0
        no = 0
        for n in sorted(box.content):
            for doc, start, ids, tokens in box.content[n]:
                rows.append((doc, start, ids, tokens, None, None, origin, no))
                no += 1
        yield _rows(rows, keep_ids)

    return docs.mapInArrow(run, PIECES + OPEN)


def merge_leftovers(left: DataFrame, groups: int, size: int, keep_ids: bool) -> DataFrame:
    """Lay the open windows of each group end to end and cut at full sequences."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("origin", "ascending"), ("no", "ascending")])
        group = int(key[0].as_py())
        sequence, offset, rows = MERGED | (group << 32), 0, []
        for doc, start, ids, tokens in zip(*[table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]):
            at = 0
            while at < len(ids):
                take = min(len(ids) - at, 4 * (size - offset))
                rows.append((doc, start + at // 4, ids[at:at + take], tokens, sequence, offset, None, None))
                at += take
                offset += take // 4
                if offset == size:
                    sequence, offset = sequence + 1, 0
        return pa.Table.from_batches([_rows(rows, keep_ids).select(
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])])

    return left.withColumn("team", F.pmod("origin", F.lit(groups))).groupBy("team").applyInArrow(run, PIECES)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                   windows: int = 64, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (little-endian 32-bit; null unless ``keep_ids``)."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = materialize(pack_partitions(docs, path, size, windows, end_id, keep_ids))
    left = packed.where("sequence_id is null")
    open_windows = left.agg(F.count_distinct("origin")).first()[0]
    groups = max(1, open_windows * windows // GROUP)
    done = packed.where("sequence_id is not null").drop("origin", "no")
    return done.unionByName(merge_leftovers(left, groups, size, keep_ids))
