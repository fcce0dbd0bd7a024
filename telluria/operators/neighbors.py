"""Exact nearest neighbours and local outlier factor at scale (survey J3, D2).

Copies of a point collapse to one point that carries its lowest ids.  Points are
packed into leaves of bounded size by sorting along one axis after the other, so
dense regions simply get more leaves.  Each point first looks into its own leaf,
which bounds its k-th distance, and then only into the leaves whose box that
radius reaches.  Nothing is paired across the data, nothing is dropped.  That is for up
to three axes; longer vectors, also those in one array column, are parted by a
metric tree (:mod:`telluria.operators.metric`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from telluria import params
from telluria.operators.metric import MetricTree
from telluria.operators.models import unit_hash
from telluria.operators.series import RN, SIZE, Series
from telluria.schema import AXES, KEYS
from telluria.session import BROADCAST_ROWS, SLICE_ROWS, Profile, attach, materialize, profile, stored

LEAF_ROWS = 2048
LEAF_QUERIES = 16_384
_BLOCK = 1 << 21  # distances held at once in a task
LEAF = ["_l1", "_l2", "_l3"]
BOX = "_box"
BOX_ROWS = 32_768  # places whose factors one task finds
SEARCH_ROWS = 256  # places that are looked for together


def _columns(axes: Sequence[str] | str) -> list[str]:
    """The names of the axes, or of the one column that holds whole vectors."""
    return [axes] if isinstance(axes, str) else list(axes)


def _is_vector(df: DataFrame, axes: Sequence[str]) -> bool:
    return len(axes) == 1 and isinstance(df.schema[axes[0]].dataType, T.ArrayType)


def distinct_points(df: DataFrame, key: str, k: int, axes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per place: ``pid`` (its lowest id) and its ``k + 1`` lowest ids.
    The limit is cut in the map tasks, before a crowded place is shuffled."""
    w = Window.partitionBy(*by, *axes).orderBy(key)
    whole = df.select(*by, key, *axes).dropna(subset=list(axes))
    if _is_vector(df, axes):
        whole = whole.where(F.forall(axes[0], lambda x: x.isNotNull() & ~F.isnan(x)))
    low = whole.withColumn(
        "_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    return low.groupBy(*by, *axes).agg(F.sort_array(F.collect_list(key)).alias("ids")).withColumn(
        "pid", F.col("ids")[0])


def _pack(points: DataFrame, axes: Sequence[str], by: Sequence[str], leaf_rows: int, slice_rows: int) -> DataFrame:
    """Leaf address ``_l1, _l2, _l3`` of every point, equal counts per leaf."""
    if profile(points, by).largest <= leaf_rows:
        return points.withColumns({c: F.lit(0).cast("long") for c in LEAF})
    keys = list(by)
    for level, name in enumerate(LEAF):
        order = [axes[(level + i) % len(axes)] for i in range(len(axes))]
        s = Series.of(points, keys, order, numbered=True, slice_rows=slice_rows)
        cuts = F.ceil(F.pow(F.col(SIZE) / F.lit(float(leaf_rows)), F.lit(1.0 / (len(LEAF) - level))))
        points = s.rows.withColumn(name, F.floor((F.col(RN) - 1) * cuts / F.col(SIZE))).drop(RN, SIZE)
        points = materialize(points)
        keys.append(name)
    return points


def _closest(q: pd.DataFrame, p: pd.DataFrame, axes, count: int, reach: np.ndarray | None = None):
    """For each query row the ``count`` nearest ids of ``p``, within its reach if
    it has one, by distance and id: yields arrays query index, distance, id, place."""
    order = np.argsort(p["pid"].to_numpy(), kind="stable")
    p = p.iloc[order]
    px, qx = p[axes].to_numpy(float), q[axes].to_numpy(float)
    pid = p["pid"].to_numpy()
    ids = p["ids"].to_numpy()
    sizes = np.array([len(i) for i in ids])
    flat = np.concatenate([np.asarray(i) for i in ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else np.zeros(0, dtype=np.int64)
    take = min(count, len(p))
    step = max(1, _BLOCK // max(len(p), 1))
    for a in range(0, len(q), step):
        diff = [qx[a:a + step, None, i] - px[None, :, i] for i in range(len(axes))]
        d2 = diff[0] * diff[0]
        for x in diff[1:]:
            d2 = d2 + x * x
        dist = np.sqrt(d2)
        edge = np.partition(dist, take - 1, axis=1)[:, take - 1]
        if reach is not None:
            edge = np.minimum(edge, reach[a:a + step])
        qi, ci = np.nonzero(dist <= edge[:, None])
        # Copies share their place's distance, each id counts on its own.
        rep = sizes[ci]
        qi2, ci2 = np.repeat(qi, rep), np.repeat(ci, rep)
        within = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        nid = flat[starts[ci2] + within]
        d = dist[qi2, ci2]
        o = np.lexsort((nid, d, qi2))
        qi2, ci2, nid, d = qi2[o], ci2[o], nid[o], d[o]
        first = np.searchsorted(qi2, qi2, side="left")
        keep = np.arange(len(qi2)) - first < count
        yield qi2[keep] + a, d[keep], nid[keep], pid[ci2[keep]]


def _lists(qi: np.ndarray, d: np.ndarray, ids, places, id_type: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """Rows that found something, and their sorted (d, id, place) lists."""
    first = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])) if len(qi) else np.zeros(0, np.int64)
    near = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(ids, id_type), pa.array(places, id_type)],
                                      names=["d", "id", "place"])
    return qi[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(qi)), pa.int32()), near)


def nearest_places(points: DataFrame, k: int, axes: Sequence[str], by: Sequence[str],
                   leaf_rows: int = LEAF_ROWS, leaf_queries: int = LEAF_QUERIES,
                   slice_rows: int = SLICE_ROWS, known: Profile | None = None) -> DataFrame:
    """For every place the ``k + 1`` nearest (distance, id, place) triples, the
    place's own copies included, as the sorted array ``near``."""
    by, axes, count = list(by), list(axes), k + 1
    if _is_vector(points, axes) or len(axes) > len(LEAF):
        v = F.col(axes[0]) if _is_vector(points, axes) else F.array(*[F.col(a).cast("double") for a in axes])
        if not _is_vector(points, axes) or points.schema[axes[0]].dataType.elementType != T.FloatType():
            v = v.cast("array<double>")  # floats travel as they are
        places = points.select(*by, "pid", "ids", v.alias("v"))
        return MetricTree.build(places, by, max(leaf_rows, 2 * count), task_rows=leaf_queries).nearest(k, leaf_queries)
    id_type = points.schema["pid"].dataType
    near_type = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", id_type),
                                          T.StructField("place", id_type)]))
    by_fields = [points.schema[c] for c in by]
    out_type = T.StructType([*by_fields, T.StructField("pid", id_type), T.StructField("near", near_type)])
    plain = to_arrow_type(id_type)

    def found_in(q: pa.Table, p: pa.Table) -> pa.Table:
        own = q.select([*by, "pid"])
        parts = []
        if q.num_rows and p.num_rows:
            reach = q.column("r").to_numpy() if "r" in q.column_names else None
            for qi, d, nid, place in _closest(q.to_pandas(), p.to_pandas(), axes, count, reach):
                at, near = _lists(qi, d, nid, place, plain)
                parts.append(own.take(pa.array(at)).append_column("near", near))
        empty = own.slice(0, 0).append_column("near", pa.array([], to_arrow_type(near_type)))
        return pa.concat_tables(parts) if parts else empty

    if (known or profile(points, by)).largest <= max(leaf_rows, 2 * count):  # each group is one leaf
        return points.groupBy(*by).applyInArrow(lambda table: found_in(table, table), out_type)
    packed, routed = _packed_and_routed(points, count, axes, by, leaf_rows, slice_rows)
    found = _meet_leaves(routed, packed, by, leaf_queries, found_in, out_type)
    # A place meets the few leaves its radius touches, each with up to k + 1 entries.
    return found.groupBy(*by, "pid").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, count).alias("near"))


def _packed_and_routed(points: DataFrame, count: int, axes, by, leaf_rows: int, slice_rows: int):
    """The points in their leaves, and each point in every leaf that may hold one
    of its ``count`` nearest ids, with the distance ``r`` within which its own leaf has so many."""
    packed = materialize(_pack(points, axes, by, max(leaf_rows, 2 * count), slice_rows))

    def radius(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.full(len(pdf), np.inf)
        for qi, d, _, _ in _closest(pdf, pdf, axes, count):
            last = np.flatnonzero(np.append(qi[1:] != qi[:-1], True))
            full = np.diff(np.concatenate([[-1], last])) == count
            r[qi[last[full]]] = d[last[full]]
        return pdf[[*by, *LEAF, "pid", *axes]].assign(r=r)

    radius_type = T.StructType([*[points.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in LEAF],
                                points.schema["pid"], *[packed.schema[a] for a in axes],
                                T.StructField("r", T.DoubleType())])
    reach = packed.groupBy(*by, *LEAF).applyInPandas(radius, radius_type).drop(*LEAF)
    return packed, materialize(_route(reach, packed, axes, by))


def _meet_leaves(routed: DataFrame, packed: DataFrame, by, leaf_queries: int, fn, out_type: T.StructType) -> DataFrame:
    """``fn(queries of a leaf, its points)``.  Popular leaves are shared out:
    queries by hash, points by copying."""
    shares = routed.groupBy(*by, *LEAF).agg(F.ceil(F.count(F.lit(1)) / leaf_queries).alias("_s"))
    n_leaves = packed.select(*by, *LEAF).distinct().count()
    small = n_leaves if n_leaves <= BROADCAST_ROWS else None
    asked = attach(routed, shares, [*by, *LEAF], groups=small).withColumn(
        "_share", F.floor(unit_hash("pid", seed=5) * F.col("_s"))).drop("_s")
    told = attach(packed, shares, [*by, *LEAF], groups=small, how="inner").withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))).drop("_s")
    told = told.toDF(*told.columns)  # columns of its own, where both sides come from one frame
    cell = [*by, *LEAF, "_share"]
    return asked.groupBy(*cell).cogroup(told.groupBy(*cell)).applyInArrow(fn, out_type)


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    diff = [q[:, None, i] - p[None, :, i] for i in range(q.shape[1])]
    d2 = diff[0] * diff[0]
    for x in diff[1:]:
        d2 += x * x
    return np.sqrt(d2, out=d2)


def _near_blocks(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """The rows of ``x`` in blocks of at most ``rows``, halved along the widest axis."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            done.append(at)
            continue
        p = x[at]
        half = len(at) // 2
        o = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], half)
        todo += [at[o[:half]], at[o[half:]]]
    return done


def _batches(x: np.ndarray, reach: np.ndarray):
    """Rows that lie near each other and reach about equally far."""
    for b in _near_blocks(x, SEARCH_ROWS):
        while len(b):
            far = reach[b] > 2 * np.median(reach[b])
            yield b[~far]
            b = b[far]


class Places:
    """The places of one task, with the ids at each, to be searched by box."""

    def __init__(self, x: np.ndarray, ids: pa.Array | None = None):
        blocks = _near_blocks(x, SEARCH_ROWS)
        self.order = np.concatenate(blocks)
        self.x = x[self.order]
        self.stops = np.cumsum([len(b) for b in blocks])
        self.starts = self.stops - [len(b) for b in blocks]
        self.lo = np.minimum.reduceat(self.x, self.starts)
        self.hi = np.maximum.reduceat(self.x, self.starts)
        if ids is not None:
            self.sizes = ids.value_lengths().to_numpy()
            self.first = np.cumsum(self.sizes) - self.sizes
            self.ids = ids.flatten().to_numpy(zero_copy_only=False)

    def around(self, q: np.ndarray, reach: float) -> np.ndarray:
        """All places within ``reach`` of any row of ``q``, and some more."""
        lo, hi = q.min(0), q.max(0)
        pad = reach * (1 + 1e-9) + 1e-300
        lo, hi = lo - pad - 1e-12 * np.abs(lo), hi + pad + 1e-12 * np.abs(hi)
        hit = np.flatnonzero(((self.lo <= hi) & (self.hi >= lo)).all(axis=1))
        if not len(hit):
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(self.starts[i], self.stops[i]) for i in hit])
        p = self.x[at]
        return self.order[at[((p >= lo) & (p <= hi)).all(axis=1)]]

    def listed(self, qi: np.ndarray, ci: np.ndarray, d: np.ndarray):
        """The same with one entry for each id of a place: query, place, distance, index of the id."""
        rep = self.sizes[ci]
        within = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        return np.repeat(qi, rep), np.repeat(ci, rep), np.repeat(d, rep), np.repeat(self.first[ci], rep) + within


def _last_neighbors(x: np.ndarray, ids: pa.Array, n_own: int, count: int):
    """For each of the first ``n_own`` places of ``x``: the distance of the last
    of its ``count`` nearest ids by distance and id, its own first, which id that
    is, and how many there are."""
    places = Places(x, ids)
    rank = np.unique(places.ids, return_inverse=True)[1]
    own = x[:n_own]
    kd, last, number = np.full(n_own, np.inf), np.zeros(n_own, np.int64), np.zeros(n_own, np.int64)

    def ask(at: np.ndarray, reach: float) -> None:
        near = places.around(own[at], reach)
        take = min(count, len(near)) - 1
        step = max(1, _BLOCK // max(len(near), 1))
        for part in (at[i:i + step] for i in range(0, len(at), step)):
            dist = _distances(own[part], x[near])
            edge = np.partition(dist, take, axis=1)[:, take]
            qi, ci = np.nonzero(dist <= edge[:, None])
            qi, _, d, which = places.listed(qi, near[ci], dist[qi, ci])
            o = np.lexsort((rank[which], d, qi))
            begin = np.searchsorted(qi, np.arange(len(part)))
            found = np.minimum(np.diff(np.append(begin, len(qi))), count)
            end = o[begin + found - 1]
            kd[part], last[part], number[part] = d[end], which[end], found

    guess = np.full(n_own, np.inf)
    for b in _near_blocks(own, SEARCH_ROWS):
        p = own[b]
        middle = np.argmin(((p - (p.min(0) + p.max(0)) / 2) ** 2).sum(axis=1))
        if len(b) > count:
            guess[b] = 1.2 * np.partition(_distances(p[middle:middle + 1], p)[0], count - 1)[count - 1]
        ask(b, guess[b[0]])
    # What lies beyond the place looked at is looked for up to the distance found.
    open_ = np.flatnonzero((number < count) & np.isfinite(guess) | (number >= count) & (kd > guess))
    bound = np.where(number[open_] < count, np.inf, kd[open_])
    for b in _batches(own[open_], bound):
        ask(open_[b], bound[b].max())
    return kd, places.ids[last], number


def _neighbor_means(x: np.ndarray, ids: pa.Array, own: np.ndarray, kd: np.ndarray, kid: np.ndarray, pid: np.ndarray,
                    weight: np.ndarray, floor: bool) -> np.ndarray:
    """For each place ``own`` of ``x``, over its neighbours (ids up to its last
    neighbour's distance ``kd`` and id ``kid``, without itself): the mean of
    their places' ``weight``, with ``floor`` of at least the distance."""
    places = Places(x, ids)
    total, number = np.zeros(len(own)), np.zeros(len(own), np.int64)
    for at in _batches(x[own], kd):
        near = places.around(x[own[at]], kd[at].max())
        step = max(1, _BLOCK // max(len(near), 1))
        for part in (at[i:i + step] for i in range(0, len(at), step)):
            dist = _distances(x[own[part]], x[near])
            qi, ci = np.nonzero(dist <= kd[part, None])
            qi, ci, d, which = places.listed(part[qi], near[ci], dist[qi, ci])
            nid = places.ids[which]
            keep = ((d < kd[qi]) | (nid <= kid[qi])) & (nid != pid[qi])
            qi, ci, d = qi[keep], ci[keep], d[keep]
            total += np.bincount(qi, np.maximum(weight[ci], d) if floor else weight[ci], len(own))
            number += np.bincount(qi, minlength=len(own))
    return total / number


def _boxed(points: DataFrame, axes: Sequence[str], by: Sequence[str], leaf_rows: int) -> DataFrame:
    """Every point with its box: groups are cut along their widest axis at
    quantiles until no box has many more than ``leaf_rows`` points.  Only counts and
    sketches are exchanged.  A value of many points becomes a box of its own."""
    keys, before = [*by, BOX], None
    rows = points.withColumn(BOX, F.lit(0).cast("long"))
    eighths = F.array(*[F.lit(i / 8) for i in range(1, 8)])
    while True:
        spread = [F.struct(F.coalesce(F.nanvl(F.stddev_pop(a), F.lit(0.0)), F.lit(0.0)).alias("s"),
                           (F.max(a) - F.min(a)).cast("double").alias("w"), F.lit(i).alias("i")) for i, a in enumerate(axes)]
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.array_max(F.array(*spread))["i"].alias("_axis"))
        large = materialize(sizes.where(F.col("_c") > 1.25 * leaf_rows))
        n, total, most = large.agg(F.count(F.lit(1)), F.sum("_c"), F.max("_c")).first()
        if not n or (n, total, most) == before:
            return rows
        before = (n, total, most)
        x = F.lit(None).cast("double")
        for i, a in enumerate(axes):
            x = F.when(F.col("_axis") == i, F.col(a).cast("double")).otherwise(x)
        q, c = F.col("_q"), F.col("_c")
        cuts = attach(rows, large, keys, groups=n, how="inner").groupBy(*keys, "_axis", "_c").agg(
            F.percentile_approx(x, eighths, 10_000).alias("_q"))
        many = F.array_distinct(F.filter(q, lambda v, i: (i > 0) & (v == F.get(q, i - 1))))
        some = F.when(c > 2 * leaf_rows, F.array(q[1], q[3], q[5])).otherwise(F.array(q[3]))
        cuts = materialize(cuts.select(*keys, "_axis", many.alias("_many"), F.array_union(some, many).alias("_cuts")))
        child = 2 * F.size(F.filter("_cuts", lambda v: v < x)) + F.array_contains("_many", x).cast("int")
        rows = attach(rows, cuts, keys, groups=n).withColumn(
            BOX, F.when(F.col("_axis").isNotNull(), F.xxhash64(BOX, child)).otherwise(F.col(BOX))).drop(
            "_axis", "_many", "_cuts")


def _box_factors(points: DataFrame, k: int, axes: Sequence[str], by: Sequence[str], leaf_rows: int,
                 slice_rows: int = SLICE_ROWS, leaf_queries: int = LEAF_QUERIES) -> DataFrame:
    """``lof`` of every place with a neighbour, without lists of neighbours in a
    shuffle.  A box learns once which places of other boxes may be neighbours of its own
    and is told these, a border of few rows.  From then on boxes find
    neighbours by themselves: first the distance and id of the last one, then the
    density, then the factor, and what a place has learnt goes to the boxes that
    know it.  Visitors from other boxes are met ``leaf_queries`` at a time."""
    by, axes, count = list(by), list(axes), k + 1
    keys, named = [*by, BOX], [*by, "pid", *axes]
    rows = _boxed(points.select(*by, "pid", "ids", *axes), axes, by, max(leaf_rows, 2 * count)).select(
        *keys, "pid", "ids", *axes)
    fields = {f.name: f.dataType for f in rows.schema.fields}
    kind, long, double = fields["pid"], T.LongType(), T.DoubleType()

    def typed(*names: str, **more: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(c, t) for c, t in [*[(c, fields[c]) for c in names], *more.items()]])

    def place(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(a).to_numpy() for a in axes]).astype(float)

    def ids_of(table: pa.Table) -> pa.Array:
        return table.column("ids").combine_chunks()

    def put(table: pa.Table, name: str, values) -> pa.Table:
        return table.set_column(table.column_names.index(name), name, values)

    # The boxes of groups that have more than one: some thousands of points stand for one row.
    boxes = rows.groupBy(*keys).agg(*[f(a).cast("double").alias(f"{p}{i}") for i, a in enumerate(axes)
                                      for f, p in ((F.min, "lo"), (F.max, "hi"))])
    several = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    by_group: dict[tuple, list] = {}
    for r in attach(boxes, several, by, how="inner").toArrow().to_pylist() if by else boxes.toArrow().to_pylist():
        by_group.setdefault(tuple(r[c] for c in by), []).append(r)
    sides = {g: (np.array([r[BOX] for r in rs]), *[np.array([[r[f"{p}{i}"] for i in range(len(axes))] for r in rs])
                                                   for p in ("lo", "hi")]) for g, rs in by_group.items() if len(rs) > 1}
    shared = rows.sparkSession.sparkContext.broadcast(sides)

    def visits(key: tuple, table: pa.Table) -> pa.Table:
        """The places whose last neighbour may lie in another box, for that box."""
        own = table.select([*by, BOX, *axes])
        parts = [own.slice(0, 0).append_column("_from", pa.array([], pa.int64())).append_column("_r", pa.array([], pa.float64()))]
        group = tuple(v.as_py() for v in key[:-1])
        if group in shared.value:
            here = key[-1].as_py()
            names, lo, hi = shared.value[group]
            x = place(table)
            r, _, number = _last_neighbors(x, ids_of(table), len(x), count)
            r[number < count] = np.inf
            reach = r * (1 + 1e-12) + 1e-300
            gap = np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0.0)
            for j in np.flatnonzero((np.sqrt((gap * gap).sum(axis=1)) <= reach.max()) & (names != here)):
                gap = np.maximum(np.maximum(lo[j] - x, x - hi[j]), 0.0)
                at = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= reach)
                there = put(own.take(pa.array(at)), BOX, pa.array(np.full(len(at), names[j])))
                parts.append(there.append_column("_from", pa.array(np.full(len(at), here))).append_column("_r", pa.array(r[at])))
        return pa.concat_tables(parts)

    def border(asked: pa.Table, told: pa.Table) -> pa.Table:
        """Places that visitors of a box may have as neighbours, once for the
        box they come from, and for the own box where else they are known."""
        whole = told.append_column("_to", pa.nulls(told.num_rows, pa.int64()))
        parts = [whole.slice(0, 0)]
        if asked.num_rows and told.num_rows:
            x, q, r = place(told), place(asked), asked.column("_r").to_numpy()
            home, places = asked.column("_from").to_numpy(), Places(x)
            for name in np.unique(home):
                mine, known = np.flatnonzero(home == name), np.zeros(len(x), bool)
                for some in (mine[i:i + leaf_queries] for i in range(0, len(mine), leaf_queries)):
                    for b in _batches(q[some], r[some]):
                        at = some[b]
                        near = places.around(q[at], r[at].max())
                        step = max(1, _BLOCK // max(len(near), 1))
                        for part in (at[i:i + step] for i in range(0, len(at), step)):
                            dist, edge = _distances(q[part], x[near]), r[part]
                            if len(near) > count:
                                edge = np.minimum(edge, np.partition(dist, count - 1, axis=1)[:, count - 1])
                            known[near[(dist <= edge[:, None]).any(axis=0)]] = True
                at = pa.array(np.flatnonzero(known))
                there = whole.take(at)
                parts.append(put(there, BOX, pa.array(np.full(len(at), name))))
                for c in ("ids", *axes):
                    there = put(there, c, pa.nulls(len(at), there.schema.field(c).type))
                parts.append(put(there, "_to", pa.array(np.full(len(at), name))))
        return pa.concat_tables(parts)

    def passed_on(own: pa.Table, **learnt: np.ndarray) -> pa.Table:
        """The rows of a box for itself, and their weight for the boxes that know them."""
        for c, v in learnt.items():
            own = put(own, c, pa.array(v, own.schema.field(c).type))
        boxes = own.column("_to").combine_chunks()
        there = own.take(pa.array(np.repeat(np.arange(len(own)), boxes.value_lengths().to_numpy())))
        there = put(there, BOX, boxes.flatten())
        for c in ("kd", "kid", "_to"):
            there = put(there, c, pa.nulls(len(there), there.schema.field(c).type))
        return pa.concat_tables([own, there])

    def last_neighbors(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in learnt_type.fields})
        other = told.filter(pc.is_null(told.column("_to")))
        known = told.filter(pc.is_valid(told.column("_to")))
        both = pa.concat_tables([own.select(["ids", *axes]), other.select(["ids", *axes])])
        kd, kid, number = _last_neighbors(place(both), ids_of(both), len(own), count)
        pid = own.column("pid").to_numpy()
        order = np.argsort(pid, kind="stable")
        at = order[np.searchsorted(pid[order], known.column("pid").to_numpy())] if len(known) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(own)))).astype(np.int32)
        to = pa.ListArray.from_arrays(pa.array(ends), known.column("_to").take(pa.array(np.argsort(at, kind="stable"))).combine_chunks())
        own = own.append_column("kd", pa.array(kd)).append_column("kid", pa.array(kid, own.schema.field("pid").type))
        own = own.append_column("_to", to).append_column("weight", pa.array(kd))
        return passed_on(own.filter(pa.array(number > 1)))

    def means(table: pa.Table, floor: bool) -> tuple[pa.Table, np.ndarray]:
        own = pc.is_valid(table.column("_to"))
        mine = table.filter(own)
        kd, kid, pid = (mine.column(c).to_numpy() for c in ("kd", "kid", "pid"))
        return mine, _neighbor_means(place(table), ids_of(table), np.flatnonzero(own.to_numpy()), kd, kid, pid,
                                     table.column("weight").to_numpy(), floor)

    def densities(table: pa.Table) -> pa.Table:
        mine, reach = means(table, True)
        return passed_on(mine, weight=1.0 / (reach + 1e-10))

    def factors(table: pa.Table) -> pa.Table:
        mine, theirs = means(table, False)
        return mine.select(named).append_column("lof", pa.array(theirs / mine.column("weight").to_numpy()))

    border_type = typed(*keys, "pid", "ids", *axes, _to=long)
    learnt_type = typed(*keys, "pid", "ids", *axes, kd=double, kid=kind, _to=T.ArrayType(long), weight=double)
    own = rows.groupBy(*keys)
    if sides:
        visitors = own.applyInArrow(visits, typed(*keys, *axes, _from=long, _r=double))
        told = visitors.groupBy(*keys).cogroup(own).applyInArrow(border, border_type)
    else:
        told = rows.sparkSession.createDataFrame([], border_type)
    learnt = own.cogroup(told.groupBy(*keys)).applyInArrow(last_neighbors, learnt_type)
    dense = learnt.groupBy(*keys).applyInArrow(densities, learnt_type)
    return dense.groupBy(*keys).applyInArrow(factors, typed(*named, lof=double))


def _route(reach: DataFrame, packed: DataFrame, axes, by) -> DataFrame:
    """Copies of each query for the leaves whose box lies within its radius,
    going down level by level so that no table of all leaves is needed."""
    rows = reach
    for level, name in enumerate(LEAF):
        keys = [*by, *LEAF[:level]]
        boxes = packed.groupBy(*keys, name).agg(
            *[f(a).alias(f"{p}{i}") for i, a in enumerate(axes) for f, p in ((F.min, "lo"), (F.max, "hi"))])
        # Children per node: the cube root of the leaf count.
        nodes = boxes.groupBy(*keys).agg(F.collect_list(F.struct(
            name, *[f"{p}{i}" for i in range(len(axes)) for p in ("lo", "hi")])).alias("_boxes"))
        nodes = materialize(nodes)
        rows = attach(rows, nodes, keys, groups=nodes.count() if level < 2 else None, how="inner") if keys else \
            rows.crossJoin(F.broadcast(nodes))

        def touched(box):
            d2 = F.lit(0.0)
            for i, a in enumerate(axes):
                gap = F.greatest(box[f"lo{i}"] - F.col(a), F.col(a) - box[f"hi{i}"], F.lit(0.0))
                d2 = d2 + gap * gap
            # A hair of slack: rounding must not hide a neighbour at equal distance.
            return F.sqrt(d2) <= F.col("r") * F.lit(1.0 + 1e-12) + F.lit(1e-300)

        rows = rows.withColumn(name, F.explode(F.transform(
            F.filter("_boxes", touched), lambda box: box[name]))).drop("_boxes")
    return rows


def _with_place(df: DataFrame, points: DataFrame, axes: Sequence[str], by: Sequence[str]) -> DataFrame:
    places = points.select(*by, *axes, "pid")
    return attach(df, places, [*by, *axes], how="inner")


def knn_self_join(df: DataFrame, key: str, k: int = params.LOF_NEIGHBORS, axes: Sequence[str] | str = AXES,
                  by: Sequence[str] = KEYS, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The ``k`` nearest other rows of each row; equal distances go by id.
    ``axes`` names number columns, or the one array column of whole vectors
    (of one length); rows with a missing component take no part."""
    axes = _columns(axes)
    points = materialize(distinct_points(df, key, k, axes, by))
    near = nearest_places(points, k, axes, by, leaf_rows, slice_rows=slice_rows)
    rows = _with_place(df.select(*by, key, *axes), points, axes, by)
    rows = attach(rows, near, [*by, "pid"], how="inner")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col(key)), 1, k)
    return rows.select(*by, key, F.posexplode(others).alias("_p", "_n")).select(
        *by, key, (F.col("_p") + 1).alias("neighbor_rank"), F.col("_n.id").alias("neighbor"),
        F.col("_n.d").alias("distance"))


def _pair_factors(near: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """``lof`` of every place with a neighbour, from its nearest places."""
    mine = near.select(*by, "pid", F.slice(F.filter("near", lambda n: n["id"] != F.col("pid")), 1, k).alias("near"))
    mine = materialize(mine.withColumn("k_distance", F.try_element_at("near", F.lit(-1))["d"]))
    pairs = mine.select(*by, "pid", F.explode("near").alias("n")).select(
        *by, "pid", F.col("n.place").alias("place"), F.col("n.d").alias("d"))
    far = mine.select(*by, F.col("pid").alias("place"), "k_distance")
    reach = attach(pairs, far, [*by, "place"], how="inner").withColumn(
        "reach", F.greatest("k_distance", "d"))
    lrd = materialize(reach.groupBy(*by, "pid").agg((F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd")))
    theirs = lrd.select(*by, F.col("pid").alias("place"), F.col("lrd").alias("_their"))
    ratio = attach(pairs, theirs, [*by, "place"], how="inner").groupBy(*by, "pid").agg(F.avg("_their").alias("_avg"))
    return attach(lrd, ratio, [*by, "pid"], how="inner").select(*by, "pid", (F.col("_avg") / F.col("lrd")).alias("lof"))


def outlier_factors(df: DataFrame, key: str, k: int = params.LOF_NEIGHBORS, axes: Sequence[str] | str = AXES,
                    by: Sequence[str] = KEYS, leaf_rows: int | None = None, slice_rows: int = SLICE_ROWS,
                    known: Profile | None = None) -> DataFrame:
    """``lof`` of every place: one row for each group and point of the axes.
    Copies of a place have equal factors, so the work is done once per place."""
    by, axes = list(by), _columns(axes)
    points = stored(distinct_points(df, key, k, axes, by))
    if _is_vector(points, axes) or len(axes) > len(LEAF):
        near = nearest_places(points, k, axes, by, leaf_rows or LEAF_ROWS, slice_rows=slice_rows, known=known)
        places = attach(points.select(*by, *axes, "pid"), _pair_factors(near, k, by), [*by, "pid"], how="left")
    else:
        places = _box_factors(points, k, axes, by, leaf_rows or BOX_ROWS, slice_rows)
    return places.drop("pid")


def local_outlier_factor(df: DataFrame, key: str, k: int = params.LOF_NEIGHBORS,
                         contamination: float = params.LOF_CONTAMINATION, axes: Sequence[str] | str = AXES,
                         by: Sequence[str] = KEYS, leaf_rows: int | None = None,
                         slice_rows: int = SLICE_ROWS, known: Profile | None = None) -> DataFrame:
    """Density of the neighbours relative to the row's own, and the flag of the
    most isolated share.  A row without any neighbour, alone in its group, has a
    NULL factor and flag."""
    from telluria.operators.forest import flag_lowest

    by, axes = list(by), _columns(axes)
    known = known or profile(df, by)
    places = outlier_factors(df, key, k, axes, by, leaf_rows, slice_rows, known)
    rows = stored(attach(df, places, [*by, *axes]).withColumn("_neg", -F.col("lof")))
    return flag_lowest(rows, "_neg", contamination, "is_lof", by, slice_rows, known).drop("_neg")
