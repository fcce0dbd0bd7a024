"""Hard negatives by rotated one-bit codes.

Every vector, scaled to whole numbers, is turned by one random rotation and kept
as the signs of its components: a code ``s`` of unit length.  Stored with it is
the alignment ``a``, its inner product with ``s``.  What the code misses stands
at right angles to it, so for a query ``q``

    <o, q> = a <s, q> + <r, q>,   |<r, q>| <= |r| |q - <s, q> s|   (Cauchy-Schwarz).

``levels`` codes follow each other, each of what the codes before it miss, which
narrows the interval by four tenths at first and by less later.  <s, q> is a
popcount of the code against the bit planes of the query, which is kept in
``BITS`` bits a component; the rounding of the query is added to the interval.
Only rows whose interval reaches what is still sought get an integer score, so
the result is exact, not approximate.

Rows are packed into blocks of at most ``rows``, queries into blocks of at most
``anchors``; each block of queries meets each block of rows in a task of its own,
which keeps the best of its rows, and the bests are merged.  No task holds more
than two blocks, whatever share of the rows one label or one vector has.

* Rows with a null label or vector, or with a null, NaN or infinite component
  take no part.  Vectors of unequal length are filled up with zeros.  A component
  too large for whole scores of 64 bits is an error.
* Each row counts on its own, repeated ones too; a row with the id of the anchor
  is not one of its "other rows".  Anchors equal in id, label and vector count
  once.  Rows without an id are never anchors and come after all others of the
  same score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telluria.session import materialize

LEVELS = 6
BITS = 8
ROWS = 8192
ANCHORS = 1024
LAST = np.iinfo(np.int64).max  # a missing id, in order
SLACK = 1e-9  # for rounding in doubles, of the product of the lengths


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of the rows of a block: ``bits`` (level, row, word), ``align``
    (level, row) and ``rest`` (level + 1, row), the length of what is missed
    before and after each level."""

    def __init__(self, bits: np.ndarray, align: np.ndarray, rest: np.ndarray):
        self.bits, self.align, self.rest = bits, align, rest

    @classmethod
    def of(cls, whole: np.ndarray, levels: int) -> Codes:
        dims = whole.shape[1]
        rest = whole.astype(float) @ rotation(dims)
        self = cls.empty(len(rest), dims, levels)
        self.rest[0] = np.linalg.norm(rest, axis=1)
        for level in range(levels):
            up = rest >= 0
            packed = np.packbits(np.pad(up, ((0, 0), (0, -dims % 64))), axis=1, bitorder="little")
            self.bits[level] = np.ascontiguousarray(packed).view(np.uint64)
            self.align[level] = np.abs(rest).sum(axis=1) / math.sqrt(dims)
            rest = rest - np.where(up, 1.0, -1.0) * (self.align[level] / math.sqrt(dims))[:, None]
            self.rest[level + 1] = np.linalg.norm(rest, axis=1)
        return self

    @classmethod
    def empty(cls, n: int, dims: int, levels: int) -> Codes:
        return cls(np.zeros((levels, n, -(-dims // 64)), np.uint64), np.zeros((levels, n)), np.zeros((levels + 1, n)))

    def stored(self) -> bytes:
        return self.bits.tobytes() + self.align.tobytes() + self.rest.tobytes()

    @classmethod
    def read(cls, raw: bytes, n: int, dims: int, levels: int) -> Codes:
        like, at, parts = cls.empty(n, dims, levels), 0, []
        for x in (like.bits, like.align, like.rest):
            parts.append(np.frombuffer(raw, x.dtype, x.size, at).reshape(x.shape))
            at += x.nbytes
        return cls(*parts)


class Query:
    """A rotated anchor as bit planes."""

    def __init__(self, turned: np.ndarray):
        self.size, self.length = len(turned), float(np.linalg.norm(turned))
        self.low = float(turned.min())
        self.step = (float(turned.max()) - self.low) / ((1 << BITS) - 1) or 1.0
        coded = np.rint((turned - self.low) / self.step).astype(np.uint16)
        padded = np.pad(coded, (0, -self.size % 64))
        planes = [np.packbits(padded >> b & 1, bitorder="little").view(np.uint64) for b in range(BITS)]
        kept = self.low + self.step * coded
        self.planes, self.total = np.stack(planes), float(kept.sum())
        self.lost = float(np.abs(turned - kept).sum()) / math.sqrt(self.size)  # most that <s, q> may be wrong

    def along(self, bits: np.ndarray) -> np.ndarray:
        """<s, q> of each code, up to ``lost``."""
        ones = np.bitwise_count(bits).sum(axis=1).astype(float)
        dot = np.zeros(len(bits))
        for b, plane in enumerate(self.planes):
            dot += (1 << b) * np.bitwise_count(bits & plane).sum(axis=1).astype(float)
        return (2 * (self.low * ones + self.step * dot) - self.total) / math.sqrt(self.size)


class Block:
    """Rows to score: ids, labels, whole components and their codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, codes: Codes):
        self.ids, self.labels, self.whole, self.codes = ids, labels, whole, codes
        self.doubles = whole.astype(float)
        self.most = int(np.abs(whole).max(initial=0))

    def narrowed(self, query: Query, chosen: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]
                 ) -> np.ndarray:
        """Those of the chosen rows that ``wanted(low, high)`` still keeps when
        their intervals have been narrowed by all levels."""
        middle = np.zeros(len(chosen))
        blur = np.zeros(len(chosen))
        for level in range(len(self.codes.align)):
            if not len(chosen):
                break
            along = query.along(self.codes.bits[level][chosen])
            align = self.codes.align[level][chosen]
            middle = middle + align * along
            blur = blur + align * query.lost
            across = np.sqrt(np.maximum(query.length ** 2 - np.maximum(np.abs(along) - query.lost, 0.0) ** 2, 0.0))
            half = blur + self.codes.rest[level + 1][chosen] * across \
                + SLACK * (1.0 + self.codes.rest[0][chosen] * query.length)
            kept = wanted(middle - half, middle + half)
            chosen, middle, blur = chosen[kept], middle[kept], blur[kept]
        return chosen

    def scores(self, chosen: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole inner products; doubles hold them while they are below 2^53."""
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return np.rint(self.doubles[chosen] @ anchor.astype(float)).astype(np.int64)
        return self.whole[chosen] @ anchor


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, equal ones by smaller id."""
    return np.lexsort((ids, -scores))[:count]


def at_least(low: np.ndarray, count: int, default: float) -> float:
    """What the ``count``-th best is at least, given lower bounds."""
    return float(np.partition(low, len(low) - count)[len(low) - count]) if len(low) >= count else default


def vectors(df: DataFrame, id_col: str, label_col: str, vector_col: str, relabel: tuple[int, int, int],
            scale: int) -> DataFrame:
    """``vec_id, label, whole``: the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    every, step, labels = relabel
    ident, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (df.select(ident.alias("vec_id"), label.alias("label"), x.alias("x"))
            .where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
            .withColumn("label", F.when(F.col("vec_id") % every == 0, F.pmod(F.col("label") + step, F.lit(labels)))
                        .otherwise(F.col("label")))
            .withColumn("whole", F.transform("x", lambda v: F.floor(v * scale).cast("long"))).drop("x"))


def packed(rows: DataFrame, dims: int, most: int, levels: int = 0, extra: str | None = None) -> DataFrame:
    """Rows in blocks of at most ``most``: ids, labels, components, and either
    the codes of ``levels`` levels or, for anchors, what ``extra`` says of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                whole = np.zeros((part.num_rows, dims), np.int64)
                lists = part.column("whole")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                ids = part.column("vec_id").fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
                labels = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                small = np.abs(whole).max(initial=0) < 1 << 15
                told = part.column(extra).to_pylist() if extra else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bool(extra)]), pa.array([bool(small)]), pa.array([ids.tobytes()]), pa.array([labels.tobytes()]),
                     pa.array([whole.astype(np.int16 if small else np.int64).tobytes()]),
                     pa.array([Codes.of(whole, levels).stored() if levels else b""]),
                     pa.array([[np.array(m, np.int64).tobytes() for m in told]], pa.list_(pa.binary()))],
                    names=["asks", "small", "ids", "labels", "whole", "codes", "marks"])

    columns = ["vec_id", "label", "whole", *([extra] if extra else [])]
    return rows.select(*columns).mapInArrow(
        run, "asks boolean, small boolean, ids binary, labels binary, whole binary, codes binary, marks array<binary>")


def opened(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer(row["whole"], np.int16 if row["small"] else np.int64).reshape(-1, dims).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), whole


def pair_blocks(blocks: DataFrame, asking: DataFrame, dims: int, levels: int, find: Callable, fields: str) -> DataFrame:
    """``find(block, anchor id, label, components, query, marks)`` for each anchor
    on each block of rows; it yields tuples for ``fields``.

    ``blocks`` and ``asking`` hold one row a block, numbered by ``block``; the
    anchors' rows are copied once for each block of rows, and the other way round.
    """
    n_rows, n_asking = blocks.count(), asking.count()
    left = blocks.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_asking - 1)))))
    right = asking.withColumnRenamed("block", "ask").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_rows - 1)))))
    met = left.unionByName(right.select(*left.columns))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows, parts = [], table.to_pylist()
        held, asks = [[p for p in parts if p["asks"] is kind] for kind in (False, True)]
        if held and asks:
            ids, labels, whole = opened(held[0], dims)
            block = Block(ids, labels, whole, Codes.read(held[0]["codes"], len(ids), dims, levels))
            ids, labels, whole = opened(asks[0], dims)
            turned = whole.astype(float) @ rotation(dims)
            for i, marks in enumerate(asks[0]["marks"]):
                rows += find(block, int(ids[i]), int(labels[i]), whole[i], Query(turned[i]), np.frombuffer(marks, np.int64))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return met.groupBy("block", "ask").applyInArrow(run, fields)


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with numbers from 0, by a sort over the cluster of the few rows that they are."""
    laid = materialize(blocks.withColumn("_id", F.monotonically_increasing_id()))
    order = Window.orderBy("_id")
    numbers = laid.select("_id").withColumn("block", (F.row_number().over(order) - 1).cast("int"))
    return laid.join(numbers, "_id").drop("_id")


def find_positives(count: int) -> Callable:
    def find(block: Block, ident: int, label: int, anchor: np.ndarray, query: Query, marks: np.ndarray) -> Iterator[tuple]:
        chosen = np.flatnonzero((block.labels == label) & (block.ids != ident))
        kept = block.narrowed(query, chosen, lambda low, high: high >= at_least(low, count, -np.inf))
        scores = block.scores(kept, anchor)
        for i in best(scores, block.ids[kept], count):
            yield ident, label, int(marks[0]), int(block.ids[kept[i]]), int(scores[i])

    return find


def find_negatives(count: int, shares: tuple[int, int]) -> Callable:
    """``marks``: the number of the anchor, then the scores of its positives."""
    def find(block: Block, ident: int, label: int, anchor: np.ndarray, query: Query, marks: np.ndarray) -> Iterator[tuple]:
        sought = [(-(-shares[0] * p // 100), shares[1] * p // 100) for p in sorted(set(marks[1:].tolist())) if p >= 0]
        if not sought:
            return

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(low), bool)
            for least, most in sought:
                sure = low[(low >= least) & (high <= most)]
                kept |= (low <= most) & (high >= max(least, at_least(sure, count, -np.inf)))
            return kept

        chosen = np.flatnonzero((block.labels != label) & (block.ids != ident))
        kept = block.narrowed(query, chosen, wanted)
        scores = block.scores(kept, anchor)
        for least, most in sought:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for i in best(scores[inside], block.ids[kept[inside]], count):
                yield int(marks[0]), least, most, int(block.ids[kept[inside[i]]]), int(scores[inside[i]])

    return find


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   every: int = 50, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95),
                   relabel: tuple[int, int, int] = (7, 1, 10), scale: int = 256, levels: int = LEVELS,
                   rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows with an id divisible by ``every``; labels of rows with
    an id divisible by ``relabel[0]`` move on by ``relabel[1]`` modulo
    ``relabel[2]``.  Of the rows with another label whose score is between
    ``shares`` hundredths of the positive's, the ``negatives`` highest are given.
    """
    spark = df.sparkSession
    held = vectors(df, id_col, label_col, vector_col, relabel, scale)
    shape = held.agg(F.max(F.size("whole")).alias("dims"), F.max(F.array_max(F.transform("whole", F.abs))).alias("most"),
                     F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asking")).first()
    dims, most = max(1, shape["dims"] or 1), shape["most"] or 0
    if dims * most * most * max(100, *shares) >= 1 << 63:
        raise ValueError(f"components of {most} in {dims} dimensions: a score does not fit 64 bits")
    blocks = numbered(packed(held, dims, rows, levels))
    cores = spark.sparkContext.defaultParallelism
    size = min(anchors, max(64, -(-shape["asking"] // (2 * cores))))

    asking = materialize(held.where(F.col("vec_id") % every == 0).distinct().withColumn(
        "anchor", F.monotonically_increasing_id()))
    one = numbered(packed(asking.withColumn("mark", F.array("anchor")).repartition(
        max(1, -(-shape["asking"] // size))), dims, size, extra="mark"))
    close = pair_blocks(blocks, one, dims, levels, find_positives(positives),
                        "anchor_id long, label long, anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = materialize(close.withColumn("no", F.row_number().over(order)).where(F.col("no") <= positives))

    told = near.groupBy("anchor").agg(F.collect_list("positive_score").alias("scores"))
    two = asking.join(told, "anchor").withColumn("mark", F.concat(F.array("anchor"), "scores"))
    two = numbered(packed(two.repartition(max(1, -(-shape["asking"] // size))), dims, size, extra="mark"))
    far = pair_blocks(blocks, two, dims, levels, find_negatives(negatives, shares),
                      "anchor long, least long, most long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "least", "most").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    mine = near.withColumns({"least": F.expr(f"({shares[0]} * positive_score + 99) div 100"),
                             "most": F.expr(f"({shares[1]} * positive_score) div 100")}).where("positive_score >= 0")

    def shown(c: str) -> Column:
        return F.when(F.col(c) != int(LAST), F.col(c)).alias(c)

    return mine.join(far, ["anchor", "least", "most"]).select(
        "anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")
