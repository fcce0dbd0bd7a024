"""Running medians over windows of any width.

A window that no task can hold is answered by counts.  Rows are ranked by value
over the cluster; positions are cut into tiles and ranks into blocks of the same
bounded size.  The number of rows of each block in all earlier tiles is kept with
every tile, so the counts by block of the first window of a tile come from two
tiles and sliding on costs one row in and one row out.  That names, for every
row, the block its median lies in and its place there.  Then each pair of a tile
and a block that holds medians of it is one small task, in which the same sliding
over the rows of the block finds the value.  No task holds more than a few tiles,
however wide the window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telluria.operators.series import ARRAY_ROWS, RN, SIZE, number_rows
from telluria.session import attach, stored

TILES = 2000  # most tiles of a group; beyond that tiles grow
_BITS = 9


class Order:
    """Counts of things in order, with the place of the k-th."""

    def __init__(self, counts: np.ndarray):
        self.fine = counts.tolist() or [0]
        pad = -len(self.fine) % (1 << _BITS)
        self.coarse = np.pad(np.array(self.fine), (0, pad)).reshape(-1, 1 << _BITS).sum(axis=1).tolist()

    def add(self, at: int, n: int = 1) -> None:
        self.fine[at] += n
        self.coarse[at >> _BITS] += n

    def find(self, k: int) -> tuple[int, int]:
        """The place that holds the ``k``-th (from 1), and its number there."""
        at = 0
        for at, n in enumerate(self.coarse):
            if k <= n:
                break
            k -= n
        at <<= _BITS
        while k > self.fine[at]:
            k -= self.fine[at]
            at += 1
        return at, k


def _edges(i: int, half: int, size: int) -> tuple[int, int]:
    """How often the first and the last row stand in beyond the ends."""
    return max(0, half - i + 1), max(0, i + half - size)


def _numbers(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(raw, kind)


def wide_medians(rows: DataFrame, by: Sequence[str], value: str, half: Column, out: str,
                 tile_rows: int = ARRAY_ROWS) -> DataFrame:
    """``by``, row number and the median of the ``half`` rows to either side of
    each row with it; the end values stand in beyond the ends.  Missing values
    come after all others.  ``rows`` are numbered; ``half`` is the same for all
    rows of a group."""
    by = list(by)
    by_fields = [rows.schema[c] for c in by]
    n, long, raw = F.col("_n"), T.LongType(), T.BinaryType()

    def typed(**fields: T.DataType) -> T.StructType:
        return T.StructType([*by_fields, *[T.StructField(k, v) for k, v in fields.items()]])

    def one(table: pa.Table, **fields) -> pa.Table:
        """The group's key with one value for each field."""
        out = table.select(by).slice(0, 1)
        for name, x in fields.items():
            out = out.append_column(name, pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()))
        return out

    points = rows.select(*by, F.col(RN).alias("_pos"), half.cast("long").alias("_h"),
                         F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("_y"))
    ranked = number_rows(points, by, ["_y", "_pos"], stored).withColumnRenamed(SIZE, "_n").withColumn(
        "_t", F.greatest(F.lit(tile_rows), F.ceil(n / TILES)).cast("long"))
    ranked = stored(ranked.withColumns({
        "_p": F.floor((F.col("_pos") - 1) / F.col("_t")), "_b": F.floor((F.col(RN) - 1) / F.col("_t"))}))

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        blocks = table.column("_b").to_numpy()
        size, width, h, p = (table.column(c)[0].as_py() for c in ("_n", "_t", "_h", "_p"))
        hist = np.bincount(blocks, minlength=-(-size // width))
        return one(table, _p=p, _n=size, _t=width, _h=h, blocks=blocks.astype("<i4").tobytes(),
                   hist=hist.astype("<i8").tobytes())

    def before(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        hist = np.stack([_numbers(x, "<i8") for x in table.column("hist").to_pylist()])
        sums = np.cumsum(hist, axis=0) - hist
        return table.select([*by, "_p"]).append_column("before", pa.array([s.tobytes() for s in sums], pa.binary()))

    tiles = stored(ranked.groupBy(*by, "_p").applyInArrow(
        tile, typed(_p=long, _n=long, _t=long, _h=long, blocks=raw, hist=raw)))
    earlier = tiles.select(*by, "_p", "hist").groupBy(*by).applyInArrow(before, typed(_p=long, before=raw))
    ends = ranked.groupBy(*by).agg(F.min_by("_b", "_pos").alias("_b1"), F.max_by("_b", "_pos").alias("_bn"))
    tiles = attach(attach(tiles.drop("hist"), earlier, [*by, "_p"], how="inner"), ends, by, how="inner")

    # A tile goes to the tiles whose windows begin or end in it.
    p, t, h = F.col("_p"), F.col("_t"), F.col("_h")
    last = F.floor((n - 1) / t)

    def reached(a: Column, b: Column) -> Column:
        lo, hi = F.greatest(F.floor(a / t), F.lit(0)), F.least(F.floor(b / t), last)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    asked = tiles.withColumn("_q", F.explode(F.array_union(
        reached(p * t + h, (p + 1) * t + h), reached(p * t - h - 1, (p + 1) * t - h))))

    def place(table: pa.Table) -> pa.Table:
        parts = {r["_p"]: (_numbers(r["blocks"], "<i4"), _numbers(r["before"], "<i8"))
                 for r in table.select(["_p", "blocks", "before"]).to_pylist()}
        q, size, width, half, first, end = (table.column(c)[0].as_py() for c in ("_q", "_n", "_t", "_h", "_b1", "_bn"))
        n_blocks = -(-size // width)

        def upto(pos: int) -> np.ndarray:
            """Rows of each block among the first ``pos`` rows."""
            if pos <= 0:
                return np.zeros(n_blocks, np.int64)
            if pos >= size:
                return np.minimum(width, size - width * np.arange(n_blocks))
            blocks, counts = parts[(pos - 1) // width]
            return counts + np.bincount(blocks[:pos - (pos - 1) // width * width], minlength=n_blocks)

        def block(pos: int) -> int:
            if pos < 1:
                return first
            if pos > size:
                return end
            return int(parts[(pos - 1) // width][0][(pos - 1) % width])

        begin, stop = q * width + 1, min(size, (q + 1) * width)
        counts = Order(upto(begin + half) - upto(begin - half - 1))
        ahead, behind = _edges(begin, half, size)
        counts.add(first, ahead)
        counts.add(end, behind)
        found = np.empty((stop - begin + 1, 2), np.int64)
        for i in range(begin, stop + 1):
            if i > begin:
                counts.add(block(i + half))
                counts.add(block(i - half - 1), -1)
            found[i - begin] = counts.find(half + 1)
        at = np.arange(begin, stop + 1)
        return pa.concat_tables([
            one(table, _b=int(b), _q=q, _n=size, _h=half, at=at[found[:, 0] == b].tobytes(),
                k=found[found[:, 0] == b, 1].tobytes()) for b in np.unique(found[:, 0])])

    def block_rows(table: pa.Table) -> pa.Table:
        table = table.sort_by(RN)
        return one(table, _b=table.column("_b")[0].as_py(), pos=table.column("_pos").to_numpy().astype("<i8").tobytes(),
                   y=table.column("_y").to_numpy().astype("<f8").tobytes())

    places = stored(asked.groupBy(*by, "_q").applyInArrow(
        place, typed(_b=long, _q=long, _n=long, _h=long, at=raw, k=raw)))
    blocks = ranked.groupBy(*by, "_b").applyInArrow(block_rows, typed(_b=long, pos=raw, y=raw))
    wanted = places.groupBy(*by, "_b").agg(F.collect_list("_q").alias("_q"))
    copies = attach(blocks, wanted, [*by, "_b"], how="inner").withColumn("_q", F.explode("_q"))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        ask, held = left.slice(0, 1).to_pylist()[0], right.slice(0, 1).to_pylist()[0]
        size, half = ask["_n"], ask["_h"]
        at, k = _numbers(ask["at"], "<i8"), _numbers(ask["k"], "<i8")
        pos, y = _numbers(held["pos"], "<i8"), _numbers(held["y"], "<f8")
        order = np.argsort(pos)
        order = order[(pos[order] >= at[0] - half) & (pos[order] <= at[-1] + half)]
        line = pos[order].tolist()
        rank = order.tolist()
        counts = Order(np.zeros(len(pos), np.int64))
        entered = left_at = 0
        ends = [int(np.flatnonzero(pos == e)[0]) if (pos == e).any() else None for e in (1, size)]
        standing = [0, 0]
        out_y = np.empty(len(at))
        for j, (i, number) in enumerate(zip(at.tolist(), k.tolist())):
            while entered < len(line) and line[entered] <= i + half:
                counts.add(rank[entered])
                entered += 1
            while left_at < entered and line[left_at] < i - half:
                counts.add(rank[left_at], -1)
                left_at += 1
            for e, copies_now in enumerate(_edges(i, half, size)):
                if ends[e] is not None and copies_now != standing[e]:
                    counts.add(ends[e], copies_now - standing[e])
                    standing[e] = copies_now
            out_y[j] = y[counts.find(number)[0]]
        keys = left.select(by).take(pa.array(np.zeros(len(at), np.int64)))
        return keys.append_column(RN, pa.array(at)).append_column(out, pa.array(out_y, pa.float64(), mask=np.isnan(out_y)))

    pair = [*by, "_b", "_q"]
    return places.groupBy(*pair).cogroup(copies.groupBy(*pair)).applyInArrow(
        settle, typed(**{RN: long, out: T.DoubleType()}))
