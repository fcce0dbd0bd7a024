"""Plumbing for removal by repeated windows: pieces of documents travel to
buckets, removed spans travel back, and the documents meet their spans.

Documents are packed by the task that scans them, as compressed Arrow batches
per block; a block is named by a hash of id and text.  So is a document inside
its block: rows with the same id and text have the same spans, whichever way the
scan is split, and nothing depends on row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARCEL = "slot long, kind int, head binary, body binary"
LAST = np.iinfo(np.int64).max  # stands for a null id in orders
MEETING = 1 << 21  # text bytes that meet their spans at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def slots(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that ``repartition(n, slot)`` sends there."""
    found = (spark.range(40 * n + 400).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p"))
             .agg(F.min("id").alias("slot")).orderBy("p").collect())
    return [r["slot"] for r in found]


def keyed(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """``doc_id, text, print`` and the carried columns as one struct."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                     F.xxhash64(text).alias("print"), kept.alias("carried"))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` text bytes, longer for a longer document."""
    sizes = pc.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def order_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def prints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def block_of(ids: np.ndarray, marks: np.ndarray, blocks: int) -> np.ndarray:
    mixed = (ids.view(np.uint64) ^ (marks.view(np.uint64) >> np.uint64(1))) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def parcels(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    slot, kind, head, body = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int64()), pa.array(kind, pa.int32()), pa.array(head, pa.binary()), pa.array(body, pa.binary())],
        names=["slot", "kind", "head", "body"])


def document_parcels(docs: DataFrame, names: list[int]) -> DataFrame:
    """The documents of each block, as compressed batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 24):
                at = block_of(order_ids(part.column("doc_id")), prints(part.column("print")), len(names))
                rows = []
                for b in np.unique(at):
                    sink = pa.BufferOutputStream()
                    chosen = part.take(pa.array(np.flatnonzero(at == b)))
                    with pa.ipc.new_stream(sink, chosen.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(chosen)
                    rows.append((names[b], 0, b"", sink.getvalue().to_pybytes()))
                yield parcels(rows)

    return docs.mapInArrow(run, PARCEL)


def span_parcels(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, stop: np.ndarray,
                 names: list[int]) -> list[tuple[int, int, bytes, bytes]]:
    """Removed spans as parcels for the blocks of their documents."""
    if not len(ids):
        return []
    at = block_of(ids, marks, len(names))
    by = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[by])) + 1
    return [(names[at[part[0]]], 1, b"", pack(np.stack(
        [ids[part], marks[part], start[part].astype(np.int64), stop[part].astype(np.int64)]).tobytes()))
        for part in np.split(by, cuts)]


def meet(parts: DataFrame, n: int, finish: Callable, fields: str, carried: str) -> DataFrame:
    """Bring documents and spans of a block together.

    ``finish(text, spans)`` gets a text as bytes and an int array of (start,
    stop) rows in order, and returns one value for each of ``fields``.
    """
    schema = f"doc_id long, {fields}, carried {carried}"
    plain = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    names, kinds = zip(*[(f.split()[0], plain[f.split()[1]]) for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        papers, spans = [], []
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
                if kind:
                    spans.append(np.frombuffer(unpack(body), np.int64).reshape(4, -1))
                else:
                    papers.append(body)
        all_spans = np.concatenate(spans, axis=1) if spans else np.zeros((4, 0), np.int64)
        by = np.lexsort((all_spans[3], all_spans[2], all_spans[1], all_spans[0]))
        ids, marks, start, stop = (row[by] for row in all_spans)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(marks) != 0)])) if len(ids) else []
        ends = np.append(new[1:], len(ids)) if len(ids) else []
        place = {(int(ids[i]), int(marks[i])): (int(i), int(j)) for i, j in zip(new, ends)}
        both = np.stack([start, stop], axis=1)
        for body in papers:
            for batch in (part for whole in pa.ipc.open_stream(body) for part in slices(whole, MEETING)):
                keys = zip(order_ids(batch.column("doc_id")).tolist(), prints(batch.column("print")).tolist())
                out = []
                for key, text in zip(keys, batch.column("text").cast(pa.binary()).to_pylist()):
                    i, j = place.get(key, (0, 0))
                    out.append(finish(text, both[i:j]))
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("carried")],
                                                 names=["doc_id", *names, "carried"])

    return parts.repartition(n, "slot").mapInArrow(run, schema)


def covered(spans: np.ndarray) -> np.ndarray:
    """Disjoint (start, stop) rows of ordered spans; touching ones are joined."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])], axis=1)


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash among ``width`` consecutive ones, the first of equal ones."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    # The upper half of a hash decides, wherever its window stands in the input.
    low = np.uint64((1 << 32) - 1)
    x = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have:])
    return (x & low).astype(np.int64)


def window_runs(place: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document with one minimiser: first window, last
    window and number of the document.  ``first``/``count``: the windows of each."""
    has = count > 0
    owner = np.repeat(np.flatnonzero(has), count[has])
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    begin = np.repeat(first[has], count[has])
    base = np.repeat(np.cumsum(count[has]) - count[has], count[has])
    at = begin + np.arange(len(owner)) - base
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(place[at]) != 0)])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(at)) - 1
    return at[i], at[j], owner[i]


def words_at(raw: bytes) -> np.ndarray:
    """The 8 bytes that start at each place of a buffer, as overlapping numbers."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
