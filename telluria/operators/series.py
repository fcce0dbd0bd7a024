"""Ordered rows of many groups, split so that no task holds a whole hot group.

A plain ``Window.partitionBy(group)`` sends all rows of a group to one task.
:class:`Series` measures the groups first.  While the largest group fits in a
task it uses that plain window.  Beyond ``slice_rows`` it sorts the rows over
the whole cluster, numbers them exactly, cuts each group into slices of
``slice_rows`` consecutive rows and lets each slice borrow the few neighbouring
rows its frames reach into.  Both forms give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telluria.schema import KEYS, ORDER
from telluria.session import SLICE_ROWS, Profile, attach, materialize, profile

RN, SIZE, SLICE, BORROWED = "_rn", "_n", "_slice", "_borrowed"
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position below
ARRAY_ROWS = 20_000  # rows per task of array computations


@dataclass(frozen=True)
class ArrayFrame:
    """Consecutive rows of one group: own rows ``start:stop`` of ``values``,
    borrowed ones around them; ``number`` is the row number of the first own row
    and ``size`` the row count of the group."""

    values: dict[str, np.ndarray]
    start: int
    stop: int
    number: int
    size: int

    def split(self, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.values[column]
        return v[:self.start], v[self.start:self.stop], v[self.stop:]


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str],
                cut: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Exact 1-based row number and size of each group, without a window over
    the group: one distributed sort, then per-partition counts shift the
    positions inside the partitions.

    ``order`` must be total inside a group.  The sorted rows are kept by ``cut``:
    a checkpoint, after which columns taken from ``df`` still work, or a smaller
    table (``session.stored``), after which only names do.
    """
    by = list(by)
    mid = F.col("_mid")
    laid = cut(
        df.orderBy(*by, *order).withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(mid, _POSITION_BITS)))
    runs = laid.groupBy(*by, "_part").agg(F.min("_mid").alias("_m0"),
                                          F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(
        *by, "_part", "_m0",
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_off"),
        F.sum("_c").over(group).alias(SIZE)))
    joined = attach(laid, runs, [*by, "_part"], groups=runs.count(), how="inner")
    return (joined.withColumn(RN, F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
            .drop("_mid", "_part", "_m0", "_off"))


class Series:
    """Rows grouped by ``by`` and totally ordered by ``order`` in each group."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str],
                 slice_rows: int, sliced: bool, groups: int | None, largest: int | None = None):
        self._df, self.by, self.order = df, list(by), list(order)
        self.slice_rows, self.sliced, self.groups, self.largest = slice_rows, sliced, groups, largest

    @classmethod
    def of(cls, df: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
           numbered: bool = False, slice_rows: int = SLICE_ROWS, known: Profile | None = None,
           cut: Callable[[DataFrame], DataFrame] = materialize) -> Series:
        """``numbered`` adds the row number and the group size as columns; a
        ``known`` profile of the groups is not measured again."""
        groups, largest = known or profile(df, by)
        if largest > slice_rows:
            return cls(number_rows(df, by, order, cut), by, order, slice_rows, True, groups, largest)
        series = cls(df, by, order, slice_rows, False, groups, largest)
        if numbered:
            series = series.mutate(lambda d, w: d.withColumns({
                RN: F.row_number().over(w).cast("long"),
                SIZE: F.count(F.lit(1)).over(series._group())}))
        return series

    @property
    def profile(self) -> Profile:
        return Profile(self.groups or 0, self.largest or 0)

    @property
    def df(self) -> DataFrame:
        """The rows without helper columns."""
        return self._df.drop(RN, SIZE)

    @property
    def rows(self) -> DataFrame:
        """The rows with whatever helper columns they carry."""
        return self._df

    def _with(self, df: DataFrame) -> Series:
        return Series(df, self.by, self.order, self.slice_rows, self.sliced, self.groups, self.largest)

    def _group(self, *more: str) -> WindowSpec:
        keys = [*self.by, *more]
        return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Series:
        """Row-wise step: ``fn`` may add columns but must keep all rows."""
        return self._with(fn(self._df))

    def mutate(self, fn: Callable[[DataFrame, WindowSpec], DataFrame],
               before: int = 0, after: int = 0) -> Series:
        """Add columns from frames that reach at most ``before`` rows back and
        ``after`` rows ahead.  When ``fn`` stacks frames the reaches add up."""
        if not self.sliced:
            return self._with(fn(self._df, self._group().orderBy(*self.order)))
        placed = self._place(max(self.slice_rows, before, after), before, after)
        done = fn(placed, self._group(SLICE).orderBy(RN))
        return self._with(done.where(~F.col(BORROWED)).drop(SLICE, BORROWED))

    def _place(self, size: int, before: int, after: int) -> DataFrame:
        """Rows with their slice, and borrowed copies for the slices beside it."""
        zero = F.col(RN) - 1
        home, at = F.floor(zero / size), zero % size
        parts = [F.when(F.lit(True), F.struct(home.alias("s"), F.lit(False).alias("b")))]
        if before:
            parts.append(F.when((at >= size - before) & ((home + 1) * size < F.col(SIZE)),
                                F.struct((home + 1).alias("s"), F.lit(True).alias("b"))))
        if after:
            parts.append(F.when((at < after) & (home > 0),
                                F.struct((home - 1).alias("s"), F.lit(True).alias("b"))))
        return (self._df.withColumn("_p", F.explode(F.array_compact(F.array(*parts))))
                .withColumns({SLICE: F.col("_p.s"), BORROWED: F.col("_p.b")}).drop("_p"))

    def compute(self, fn: Callable[[ArrayFrame], Mapping[str, np.ndarray]], inputs: Sequence[str],
                outputs: Sequence[str], before: int = 0, after: int = 0,
                rows: int = ARRAY_ROWS) -> Series:
        """Add double columns that ``fn`` makes from arrays of consecutive rows.

        For frames of hundreds of rows this beats a window that builds a list
        per row.  Tasks get ``rows`` rows each, in Arrow form, plus what their
        frames borrow.  The series must be ``numbered``.
        """
        size = max(min(rows, self.slice_rows), before, after)
        placed = self._place(size, before, after)
        kept = [f for f in placed.schema.fields if f.name not in (SLICE, BORROWED)]
        schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in outputs]])
        names, wanted = [f.name for f in kept], list(inputs)

        def run(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, [(RN, "ascending")]))
            own = np.flatnonzero(~table.column(BORROWED).to_numpy())
            values = {c: table.column(c).cast(pa.float64()).to_numpy() for c in wanted}
            number = table.column(RN).to_numpy()
            frame = ArrayFrame(values, int(own[0]), int(own[-1]) + 1, int(number[own[0]]),
                               int(table.column(SIZE)[0].as_py()))
            made = fn(frame)
            out = table.select(names).slice(frame.start, frame.stop - frame.start)
            for c in outputs:
                out = out.append_column(c, pa.array(made[c], pa.float64(), mask=np.isnan(made[c])))
            return out

        return self._with(placed.groupBy(*self.by, SLICE).applyInArrow(run, schema))

    def running_sum(self, columns: Mapping[str, Column]) -> Series:
        """Add inclusive running sums.  Slices sum on their own and are shifted
        by the totals of the slices before them."""
        if not self.sliced:
            w = (self._group().orderBy(*self.order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
            return self._with(self._df.withColumns(
                {name: F.sum(c).over(w) for name, c in columns.items()}))
        cut = self._df.withColumn(SLICE, F.floor((F.col(RN) - 1) / self.slice_rows))
        totals = cut.groupBy(*self.by, SLICE).agg(
            *[F.sum(c).alias(f"_t_{name}") for name, c in columns.items()])
        ahead = (self._group().orderBy(SLICE)
                 .rowsBetween(Window.unboundedPreceding, -1))
        shifts = totals.select(*self.by, SLICE, *[
            F.coalesce(F.sum(f"_t_{name}").over(ahead), F.lit(0)).alias(f"_t_{name}")
            for name in columns])
        w = (self._group(SLICE).orderBy(RN)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        local = cut.withColumns({name: F.sum(c).over(w) for name, c in columns.items()})
        out = attach(local, shifts, [*self.by, SLICE], how="inner").withColumns(
            {name: F.col(name) + F.col(f"_t_{name}") for name in columns})
        return self._with(out.drop(SLICE, *[f"_t_{name}" for name in columns]))
