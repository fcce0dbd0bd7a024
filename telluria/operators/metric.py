"""Exact nearest neighbours of whole vectors by a metric tree.

Boxes serve three axes; for vectors of any length places are parted by distance
alone.  Each node that holds too many places draws pivots from them by hash, its
places go to the nearest pivot, and the children become nodes of the next level,
until every leaf is small.  A node knows, for each child, the pivot, the least
and greatest distance of its places from the pivot, and how many rows they carry.

A query starts with the k-th distance inside its own leaf.  On its way down from
the root every node may lower that bound, since a child that carries enough rows
holds all of them within ``d(query, pivot) + greatest``; and a child is entered
only if the triangle inequality lets it hold something nearer:
``least - bound <= d(query, pivot) <= greatest + bound``, and, as its places lie
at their nearest pivot, ``d(query, pivot) - d(query, nearest pivot) <= 2 bound``.
A far outlier, alone in its leaf, goes down to one leaf near to it first, so that
it does not visit everything.

Where vectors lie about equally far from each other no bound parts them.  That
shows in the balls around the leaves: if queries would enter more than a few
leaves, shares of neighbouring leaves ask instead, and meet parts of many leaves
whole.  A vector is then copied once for each share that its leaf's ball reaches, not
for each leaf that it asks, and every part answers a query with one short list.

All steps are joins of rows with their node.  A crowded node is shared out: its
rows by hash, what they meet by copying.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telluria.operators.models import unit_hash
from telluria.session import BROADCAST_ROWS, attach, stored

FAN = 64  # most children of a node
TASK_ROWS = 16_384  # rows of a node that one task takes
DEEPEST = 32  # levels; places too close for doubles to part stay in one leaf
_BLOCK = 1 << 21  # distances held at once in a task
SLACK = 1e-12  # rounding must not hide a neighbour at equal distance
FEW_LEAVES = 8  # leaves a query may enter on its own
ASKING, HOLDING = 32_768, 131_072  # rows of a share, and of what it meets in one task
NODE, SHARE, LEAF = "_node", "_share", "_leaf"


def matrix(column: pa.ChunkedArray | pa.ListArray) -> np.ndarray:
    """Lists of equal length as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From each row of ``a`` to each row of ``b``, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, _BLOCK // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def meet(rows: DataFrame, nodes: DataFrame, by: Sequence[str], fn: Callable[[pa.Table, pa.Table], pa.Table],
         schema: T.StructType, task_rows: int = TASK_ROWS) -> DataFrame:
    """``fn(rows of a node, what the node holds)``, crowded nodes in shares."""
    keys = [*by, NODE]
    shares = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / task_rows).alias("_s"))
    asked = attach(rows, shares, keys, how="inner").withColumn(
        SHARE, F.pmod(F.xxhash64("pid"), F.col("_s"))).drop("_s")
    told = attach(nodes, shares, keys, how="inner").withColumn(
        SHARE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))).drop("_s")
    told = told.toDF(*told.columns)  # columns of its own, where both sides come from one frame
    cell = [*keys, SHARE]
    empty = pa.Table.from_pylist([], schema=_arrow(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right) if left.num_rows and right.num_rows else empty

    return asked.groupBy(*cell).cogroup(told.groupBy(*cell)).applyInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class MetricTree:
    """``leaves``: places with their leaf in ``_node``; ``levels``: for each
    level its inner nodes with their children."""

    def __init__(self, leaves: DataFrame, levels: list[DataFrame], by: list[str]):
        self.leaves, self.levels, self.by = leaves, levels, by

    @classmethod
    def build(cls, places: DataFrame, by: Sequence[str], leaf_rows: int, fan: int = FAN,
              task_rows: int = TASK_ROWS) -> MetricTree:
        """``places``: ``by``, ``pid``, ``ids``, ``v`` (array of doubles)."""
        by = list(by)
        keys = [*by, NODE]
        rows = stored(places.select(*by, "pid", "ids", "v").withColumn(NODE, F.lit("")))
        kept = rows.schema
        done, levels = [], []
        assigned_type = T.StructType([*kept.fields, T.StructField("_child", T.IntegerType()),
                                      T.StructField("_at", T.DoubleType())])

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            pivots = matrix(right.column("_pivots").combine_chunks().flatten())
            d = distances(matrix(left.column("v")), pivots)
            child = d.argmin(axis=1)
            out = left.select(kept.names)
            return out.append_column("_child", pa.array(child, pa.int32())).append_column(
                "_at", pa.array(d[np.arange(len(d)), child]))

        for level in range(DEEPEST):
            crowded = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > leaf_rows))
            if crowded.isEmpty():
                break
            marked = attach(rows, crowded, keys)
            done.append(marked.where("_c is null").drop("_c"))
            inner = marked.where("_c is not null")
            order = Window.partitionBy(*keys).orderBy(unit_hash("pid", seed=level + 11), "pid")
            drawn = inner.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fan)
            drawn = drawn.where(F.col("_r") <= F.greatest(F.lit(2), F.ceil(2 * F.col("_c") / leaf_rows)))
            pivots = stored(drawn.groupBy(*keys).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda p: p["v"]).alias("_pivots")))
            rows = stored(meet(inner.drop("_c"), pivots, by, _flat(assign), assigned_type, task_rows))
            children = rows.groupBy(*keys, "_child").agg(
                F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.sum(F.size("ids")).alias("n"),
                (F.count(F.lit(1)) > leaf_rows).alias("inner"))
            children = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
                "_child", "lo", "hi", "n", "inner"))).alias("_children"))
            levels.append(stored(attach(pivots, children, keys, how="inner")))
            rows = rows.withColumn(NODE, F.concat(NODE, F.lit("."), F.col("_child"))).drop("_child", "_at")
        out = rows
        for part in done:
            out = out.unionByName(part)
        return cls(stored(out), levels, by)

    def radii(self, count: int) -> DataFrame:
        """``by``, ``pid``, ``v``, the root as ``_node``, the own leaf as ``_leaf``, and ``r``: the distance within
        which that leaf has ``count`` rows, infinite where it has fewer."""
        wanted = [f for f in self.leaves.schema.fields if f.name in (*self.by, "pid", "v")]
        schema = T.StructType([*wanted, T.StructField("r", T.DoubleType()), T.StructField(NODE, T.StringType()),
                               T.StructField(LEAF, T.StringType())])
        names = [f.name for f in wanted]

        def run(table: pa.Table) -> pa.Table:
            r = np.full(table.num_rows, np.inf)
            for at, d, _, _ in closest(table, np.inf * np.ones(table.num_rows), table, count):
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else at
                full = np.diff(last, prepend=-1) == count
                r[at[last[full]]] = d[last[full]]
            return table.select(names).append_column("r", pa.array(r)).append_column(
                NODE, pa.array([""] * len(r))).append_column(LEAF, table.column(NODE))

        return self.leaves.groupBy(*self.by, NODE).applyInArrow(run, schema)

    def route(self, queries: DataFrame, count: int, task_rows: int = TASK_ROWS) -> DataFrame:
        """A copy of each query for every leaf that may hold one of its ``count``
        nearest rows, with the bound ``r`` it arrives with.  Queries whose own
        leaf gave no bound first go down to one leaf near to them for one."""
        if self.levels:
            queries = self._descend(queries, count, task_rows, alone=True)
        return self._descend(queries, count, task_rows, alone=False)

    def _descend(self, queries: DataFrame, count: int, task_rows: int, alone: bool) -> DataFrame:
        """The queries in leaves; ``alone``: those without a bound in one leaf
        only, the others no further than the root, and all are told to be at the root again."""
        names = [*self.by, "pid", "v"]
        rows = queries.select(*names, "r", NODE)
        schema = T.StructType([*rows.schema.fields, T.StructField("_inner", T.BooleanType())])

        depth = len(self.levels)

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            node = right.to_pylist()[0]
            child = [c["_child"] for c in node["_children"]]
            lo, hi, n = (np.array([c[k] for c in node["_children"]], float) for k in ("lo", "hi", "n"))
            inner = np.array([c["inner"] for c in node["_children"]])
            d = distances(matrix(left.column("v")), np.array(node["_pivots"], float))
            nearest = d.min(axis=1)
            d = d[:, child]
            # The least reach within which the children carry enough rows.
            far = np.argsort(d + hi, axis=1)
            enough = np.cumsum(n[far], axis=1) >= count
            reach = np.where(enough.any(axis=1), np.take_along_axis(
                d + hi, np.take_along_axis(far, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0], np.inf)
            r = np.minimum(left.column("r").to_numpy(), reach)
            if alone:  # the nearest child that is not too small, if there is one
                which = np.where(n >= count, d, d + d.max()).argmin(axis=1)
                at = np.arange(len(d))
                deeper = inner[which] & (np.isinf(left.column("r").to_numpy()) | (node[NODE] != "")) & (
                    node[NODE].count(".") + 1 < depth)
            else:
                bound = (r * (1 + SLACK) + SLACK * (1 + d.max(axis=1)))[:, None]
                at, which = np.nonzero((d <= hi + bound) & (d >= lo - bound) & (d - nearest[:, None] <= 2 * bound))
                deeper = inner[which]
            out = left.select(names).take(pa.array(at)).append_column("r", pa.array(r[at]))
            path = [f"{node[NODE]}.{child[i]}" if down or not alone else "" for i, down in zip(which, deeper)]
            return out.append_column(NODE, pa.array(path, pa.string())).append_column("_inner", pa.array(deeper))

        found = []
        for level in self.levels:
            moved = stored(meet(rows, level, self.by, _flat(step), schema, task_rows))
            found.append(moved.where("not _inner").drop("_inner"))
            rows = moved.where("_inner").drop("_inner")
        if not alone:
            found.append(rows)
        return reduce(DataFrame.unionByName, found)

    def nearest(self, k: int, task_rows: int = TASK_ROWS) -> DataFrame:
        """``by``, ``pid``, ``near``: for each place its ``k + 1`` nearest (d, id,
        place), its own copies among them, equal distances by id."""
        count = k + 1
        kind = self.leaves.schema["pid"].dataType
        by_fields = [self.leaves.schema[c] for c in self.by]
        schema = T.StructType([*by_fields, T.StructField("pid", kind), T.StructField("d", T.DoubleType()),
                               T.StructField("id", kind), T.StructField("place", kind)])
        own = [*self.by, "pid"]

        radii = stored(self.radii(count))
        balls = stored(self._balls(radii))
        reached = stored(self._reached(balls, count, task_rows))
        asks, rows = reached.agg(F.sum("asks")).first()[0] or 0, balls.agg(F.sum("n")).first()[0] or 0
        if asks > FEW_LEAVES * rows:
            return self._by_shares(radii, balls, reached, count)

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = []
            for at, d, ids, places in closest(left, left.column("r").to_numpy(), right, count):
                out = left.select(own).take(pa.array(at))
                parts.append(out.append_column("d", pa.array(d)).append_column("id", ids).append_column("place", places))
            return pa.concat_tables(parts)

        asked = stored(self.route(radii, count, task_rows))
        found = meet(asked, self.leaves, self.by, _flat(search), schema, task_rows)
        order = Window.partitionBy(*own).orderBy("d", "id")
        best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count)
        return best.groupBy(*own).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "d", "id", "place"))),
            lambda n: F.struct(n["d"], n["id"], n["place"])).alias("near"))

    def _balls(self, radii: DataFrame) -> DataFrame:
        """For each leaf, as ``pid``: its ball (``v``, ``rho``), its rows ``n``, their
        greatest ``r`` as ``reach``, and the share and the part it belongs to."""
        by, by_fields = self.by, [self.leaves.schema[c] for c in self.by]
        schema = T.StructType([*by_fields, T.StructField("pid", T.StringType()),
                               T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("rho", T.DoubleType()),
                               T.StructField("reach", T.DoubleType()), T.StructField("n", T.LongType())])

        def run(table: pa.Table) -> pa.Table:
            x = matrix(table.column("v"))
            centre = x.mean(axis=0)
            rho = float(distances(x, centre[None, :]).max())
            out = table.select([*by, LEAF]).slice(0, 1).rename_columns([*by, "pid"])
            for name, value, kind in (("v", centre.tolist(), pa.list_(pa.float64())), ("rho", rho, pa.float64()),
                                      ("reach", pc.max(table.column("r")).as_py(), pa.float64()),
                                      ("n", table.num_rows, pa.int64())):
                out = out.append_column(name, pa.array([value], kind))
            return out

        balls = radii.groupBy(*self.by, LEAF).applyInArrow(run, schema)
        # One row for some thousand places: neighbouring leaves are neighbours by their paths.
        before = F.sum("n").over(Window.partitionBy(*self.by).orderBy("pid").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        return balls.withColumns({SHARE: F.floor(before / ASKING), "_part": F.floor(before / HOLDING)})

    def _reached(self, balls: DataFrame, count: int, task_rows: int) -> DataFrame:
        """Leaves in which rows of a share may have one of their ``count`` nearest
        rows: ``_share``, ``_leaf``, and the rows that ask there as ``asks``."""
        by, by_fields = self.by, [self.leaves.schema[c] for c in self.by]
        schema = T.StructType([*by_fields, T.StructField(SHARE, T.LongType()), T.StructField(LEAF, T.StringType()),
                               T.StructField("_part", T.LongType()), T.StructField("asks", T.LongType())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            centres, rho = matrix(right.column("v")), right.column("rho").to_numpy()
            held = right.column("n").to_numpy()
            share, numbers = np.unique(left.column("_asking").to_numpy(), return_inverse=True)
            asks = np.zeros((len(share), len(centres)), np.int64)
            step = max(1, _BLOCK // len(centres))
            for a in range(0, left.num_rows, step):
                part = left.slice(a, step)
                d = distances(matrix(part.column("v")), centres)
                mine = part.column("rho").to_numpy()[:, None]
                # Leaves that carry enough rows lie whole within this distance of each row.
                whole = d + mine + rho
                far = np.argsort(whole, axis=1)
                enough = np.cumsum(held[far], axis=1) >= count
                limit = np.where(enough.any(axis=1), np.take_along_axis(
                    whole, np.take_along_axis(far, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0], np.inf)
                reach = np.minimum(part.column("reach").to_numpy(), limit)[:, None]
                i, j = np.nonzero(d - mine - rho <= reach * (1 + SLACK) + SLACK * (1 + d.max()))
                np.add.at(asks, (numbers[a + i], j), part.column("n").to_numpy()[i])
            i, j = np.nonzero(asks)
            picked = right.take(pa.array(j))
            return picked.select(by).append_column(SHARE, pa.array(share[i])).append_column(LEAF, picked.column("pid")).append_column(
                "_part", picked.column("_part")).append_column("asks", pa.array(asks[i, j]))

        told = balls.withColumn(NODE, F.lit("")).drop(SHARE, "reach")
        asking = balls.withColumn(NODE, F.lit("")).withColumnRenamed(SHARE, "_asking").drop("_part")
        found = meet(asking, told, self.by, _flat(run), schema, task_rows)
        return found.groupBy(*self.by, SHARE, LEAF, "_part").agg(F.sum("asks").alias("asks"))

    def _by_shares(self, radii: DataFrame, balls: DataFrame, reached: DataFrame, count: int) -> DataFrame:
        """Nearest rows where no bound parts the leaves: every share meets what
        its rows may reach, a part at a time."""
        kind = self.leaves.schema["pid"].dataType
        near = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", kind),
                                         T.StructField("place", kind)]))
        schema = T.StructType([*[self.leaves.schema[c] for c in self.by], T.StructField("pid", kind),
                               T.StructField("near", near)])
        own, at_leaf = [*self.by, "pid"], [*self.by, LEAF]
        plain = _arrow(schema).field("near").type.value_type

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = [left.select(own).slice(0, 0).append_column("near", pa.array([], pa.list_(plain)))]
            for at, d, ids, places in nearest_of_many(left, left.column("r").to_numpy(), right, count):
                first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                found = pa.StructArray.from_arrays([pa.array(d), ids, places], fields=list(plain))
                parts.append(left.select(own).take(pa.array(at[first])).append_column(
                    "near", pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), found)))
            return pa.concat_tables(parts)

        few = lambda df: n if (n := df.limit(BROADCAST_ROWS + 1).count()) <= BROADCAST_ROWS else None
        homes = balls.select(*self.by, F.col("pid").alias(LEAF), F.col(SHARE))
        asked = attach(radii.drop(NODE), homes, at_leaf, groups=few(homes), how="inner").drop(LEAF)
        wanted = reached.groupBy(*self.by, SHARE).agg(F.collect_set("_part").alias("_part"))
        asked = attach(asked, wanted, [*self.by, SHARE], groups=few(wanted), how="inner").withColumn(
            "_part", F.explode("_part"))
        askers = reached.groupBy(*at_leaf, "_part").agg(F.collect_list(SHARE).alias(SHARE))
        told = attach(self.leaves.withColumnRenamed(NODE, LEAF), askers, at_leaf, groups=few(askers), how="inner")
        told = told.withColumn(SHARE, F.explode(SHARE)).drop(LEAF)
        cell = [*self.by, SHARE, "_part"]
        found = asked.groupBy(*cell).cogroup(told.groupBy(*cell)).applyInArrow(
            lambda left, right: search(left.combine_chunks(), right.combine_chunks()), schema)
        return found.groupBy(*own).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, count).alias("near"))


def _flat(fn: Callable) -> Callable:
    return lambda left, right: fn(left.combine_chunks(), right.combine_chunks())


def closest(asking: pa.Table, reach: np.ndarray, held: pa.Table, count: int):
    """For each asking row the ``count`` nearest ids of ``held`` within its reach,
    by distance and id: yields arrays row, distance, id, place."""
    q, x = matrix(asking.column("v")), matrix(held.column("v"))
    lists = held.column("ids").combine_chunks()
    flat, pid = lists.flatten(), held.column("pid").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    middle = x.mean(axis=0)
    qm, xm = q - middle, x - middle
    q2, x2 = np.einsum("ij,ij->i", qm, qm), np.einsum("ij,ij->i", xm, xm)
    take, step = min(count, len(x)), max(1, _BLOCK // len(x))
    for a in range(0, len(q), step):
        b = min(a + step, len(q))
        # Squares by products choose generously; the distances are by differences.
        about = q2[a:b, None] + x2[None, :] - 2 * qm[a:b] @ xm.T
        err = 1e-12 * (q2[a:b] + x2.max())
        edge = np.partition(about, take - 1, axis=1)[:, take - 1] + 2 * err
        limit = np.minimum(edge, (reach[a:b] * (1 + SLACK)) ** 2 + err + SLACK)
        qi, xi = np.nonzero(about <= limit[:, None])
        d = np.empty(len(qi))
        for i in range(0, len(qi), max(1, _BLOCK // q.shape[1])):
            part = slice(i, i + max(1, _BLOCK // q.shape[1]))
            gap = q[a + qi[part]] - x[xi[part]]
            d[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        copies = sizes[xi]
        row, place, d = np.repeat(qi, copies), np.repeat(xi, copies), np.repeat(d, copies)
        within = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        ids = flat.take(pa.array(starts[place] + within))
        rank = pc.rank(ids, tiebreaker="dense").to_numpy()
        by = np.lexsort((rank, d, row))
        row = row[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < count
        by = by[kept]
        yield row[kept] + a, d[by], ids.take(pa.array(by)), pid.take(pa.array(place[by]))


def nearest_of_many(asking: pa.Table, reach: np.ndarray, held: pa.Table, count: int, rows: int = 1024, block: int = 2048):
    """As ``closest``, over so many held rows that each row's reach shrinks on the
    way: blocks are compared by products, and few of their rows pass."""
    if not asking.num_rows or not held.num_rows:
        return
    x, q = matrix(held.column("v")), matrix(asking.column("v"))
    middle = x.mean(axis=0)
    xm, qm = x - middle, q - middle
    x2, q2 = np.einsum("ij,ij->i", xm, xm), np.einsum("ij,ij->i", qm, qm)
    for a in range(0, len(q), rows):
        part = slice(a, min(a + rows, len(q)))
        err = 1e-12 * (q2[part] + x2.max()) + SLACK
        limit = reach[part].astype(float)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        fresh, held_back = [], 0
        for b in range(0, len(x), block):
            about = q2[part, None] + x2[None, b:b + block] - 2 * qm[part] @ xm[b:b + block].T
            qi, xi = np.nonzero(about <= ((limit * (1 + SLACK)) ** 2 + err)[:, None])
            if len(qi) > 4 * count * len(about) and about.shape[1] > count:
                edge = np.partition(about, count - 1, axis=1)[:, count - 1] + 2 * err
                qi, xi = np.nonzero(about <= np.minimum(edge, (limit * (1 + SLACK)) ** 2 + err)[:, None])
            d = np.empty(len(qi))
            for i in range(0, len(qi), max(1, _BLOCK // q.shape[1])):
                some = slice(i, i + max(1, _BLOCK // q.shape[1]))
                gap = q[a + qi[some]] - x[b + xi[some]]
                d[some] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            fresh.append((qi, b + xi, d))
            held_back += len(qi)
            if held_back > 2 * count * len(about) or b + block >= len(x):
                kept = tuple(map(np.concatenate, zip(kept, *fresh)))
                fresh, held_back = [], 0
                row, place, d = kept
                by = np.lexsort((d, row))
                row, place, d = row[by], place[by], d[by]
                # A place has one id at least, so no row needs more than ``count`` places and their equals.
                start = np.searchsorted(row, np.arange(len(limit)))
                full = np.flatnonzero(np.diff(np.append(start, len(row))) >= count)
                limit[full] = np.minimum(limit[full], d[start[full] + count - 1])
                stay = d <= limit[row]
                kept = row[stay], place[stay], d[stay]
        if len(kept[0]):
            yield from _by_ids(held, a, *kept, count)


def _by_ids(held: pa.Table, first: int, row: np.ndarray, place: np.ndarray, d: np.ndarray, count: int):
    """The ``count`` first ids of each row among places, each of which may carry several."""
    lists = held.column("ids").combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat, pid = lists.values, held.column("pid").combine_chunks()
    copies = np.diff(offsets)[place]
    row, d = np.repeat(row, copies), np.repeat(d, copies)
    within = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    ids = flat.take(pa.array(offsets[:-1][np.repeat(place, copies)] + within))
    place = np.repeat(place, copies)
    by = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), d, row))
    row = row[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < count
    by = by[kept]
    yield row[kept] + first, d[by], ids.take(pa.array(by)), pid.take(pa.array(place[by]))
