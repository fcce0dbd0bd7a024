"""Stateful detection per group (survey T2-T4).

State per group: the last ``rows`` values, and counters.  See
:mod:`telluria.streaming.ordered` for how rows come in order and in blocks.
``ttl_ms`` forgets groups that have been silent for so long; such a stream looks
at the clock again and again, so it does not end by itself with ``availableNow``.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from telluria import params
from telluria.functions.frames import trailing_distances, trailing_moments, trailing_scores
from telluria.operators.forest import BROADCAST_GROUPS, _as_forest, _group_key, forests_of
from telluria.operators.models import score_batch
from telluria.schema import AXES, KEYS, ORDER
from telluria.session import materialize
from telluria.streaming.ordered import HELD_ROWS, OrderedProcessor, keep_state


class Detector(OrderedProcessor):
    ring = ("magnitude",)

    def __init__(self, columns: Sequence[str], min_rows: int, z_threshold: float, roc_threshold: float, **options):
        super().__init__(**options)
        self.columns, self.min_rows = list(columns), min_rows
        self.z_threshold, self.roc_threshold = z_threshold, roc_threshold

    def block(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        history, y = self.past[:, 0], pdf["magnitude"].to_numpy(float)
        z = trailing_scores(history, y, self.rows, self.min_rows)
        roc = np.abs(y - np.concatenate([history[-1:] if len(history) else y[:1], y[:-1]]))
        is_z, is_roc = z > self.z_threshold, roc > self.roc_threshold
        votes = is_z.astype("int32") + is_roc.astype("int32")
        anomaly = votes >= params.MIN_VOTES
        out = pdf.assign(roc=roc, z=z, is_z=is_z, is_roc=is_roc, votes=votes, is_anomaly=anomaly,
                         reading_seq=self.seen + np.arange(1, len(pdf) + 1), anomaly_no=self.flagged + anomaly.cumsum())
        self.flagged += int(anomaly.sum())
        return out[self.columns]


def stream_detect(df: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                  rows: int = params.HISTORY_ROWS, min_rows: int = params.HISTORY_MIN,
                  z_threshold: float = params.Z_THRESHOLD, roc_threshold: float = params.ROC_THRESHOLD,
                  ttl_ms: int | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """Streaming twin of ``detect_flight``."""
    extra = T.StructType([
        T.StructField("roc", T.DoubleType()), T.StructField("z", T.DoubleType()), T.StructField("is_z", T.BooleanType()),
        T.StructField("is_roc", T.BooleanType()), T.StructField("votes", T.IntegerType()),
        T.StructField("is_anomaly", T.BooleanType()), T.StructField("reading_seq", T.LongType()),
        T.StructField("anomaly_no", T.LongType())])
    schema = T.StructType([*df.schema.fields, *extra.fields])
    detector = Detector(schema.names, min_rows, z_threshold, roc_threshold, order=order, rows=rows, ttl_ms=ttl_ms,
                        held_rows=held_rows)
    return keep_state(df, by, detector, schema, ttl_ms)


def stream_score(df: DataFrame, models: Sequence[PipelineModel | None], absent: Sequence[str] = ()) -> DataFrame:
    """Predictions and cluster of each reading; NULL for absent models."""
    return score_batch(df, models, absent)


def online_flags(points: np.ndarray, fresh: np.ndarray, rows: int, min_rows: int, z_threshold: float):
    """Classic z and mean distance of each fresh point (x, y, z, magnitude)
    against the trailing points with it, and whether each rule fires."""
    n, average, std = trailing_moments(points[:, 3], fresh[:, 3], rows)
    ok = (n >= min_rows) & (std > 0)
    z = np.full(len(fresh), np.nan)
    z[ok] = np.abs(fresh[ok, 3] - average[ok]) / std[ok]
    mean, p95 = trailing_distances(points[:, :3], fresh[:, :3], rows, min_rows)
    return z, np.nan_to_num(z) > z_threshold, np.nan_to_num(mean) > np.nan_to_num(p95)


FRAMED_ROWS = 8192
FRAME = T.StructType([T.StructField("_g", T.StringType()), T.StructField("past", T.BinaryType()), T.StructField("rows", T.BinaryType())])


def whole_scores(forest, points: np.ndarray) -> np.ndarray:
    """Scores of points without a missing number, ``NaN`` for others."""
    return np.where(np.isnan(points).any(axis=1), np.nan, forest.score(points))


class Framer(OrderedProcessor):
    """Puts the rows of a group in order and sends them on in blocks, each with
    the rows before it that its scores look back to."""

    ring = (*AXES, "magnitude")

    def __init__(self, columns: Sequence[str], **options):
        super().__init__(**options)
        self.columns, self.model = list(columns), None

    def init(self, handle) -> None:
        super().init(handle)
        self._forest = handle.getValueState("forest", T.StructType([T.StructField("trees", T.BinaryType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = sorted(initialState.to_dict("records"), key=lambda r: r["tree"])
        self._forest.update((pickle.dumps(_as_forest(rows)),))

    def handleInputRows(self, key, rows, timerValues):
        self.model = pickle.loads(bytes(self._forest.get()[0])) if self._forest.exists() else None
        yield from super().handleInputRows(key, rows, timerValues)

    def block(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if self.model is not None:
            pdf = pdf.assign(iso_score=whole_scores(self.model, pdf[list(AXES)].to_numpy(float)))
        bodies, line = [], np.concatenate([self.past, pdf[list(self.ring)].to_numpy(float)])
        for a in range(0, len(pdf), FRAMED_ROWS):
            part = pa.RecordBatch.from_pandas(pdf[self.columns].iloc[a:a + FRAMED_ROWS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            at = len(self.past) + a
            bodies.append((key[0], line[max(0, at - self.rows):at].tobytes(), sink.getvalue().to_pybytes()))
        return pd.DataFrame(bodies, columns=["_g", "past", "rows"])


def stream_online_check(df: DataFrame, forest: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                        rows: int = params.HISTORY_ROWS, min_rows: int = params.HISTORY_MIN,
                        z_threshold: float = 3.0, iso_limit: float = -0.5, ttl_ms: int | None = None,
                        held_rows: int = HELD_ROWS) -> DataFrame:
    """Streaming twin of ``online_check`` with a frozen forest.  Only the order
    of a group's rows needs its state; blocks are scored on every core after it.
    Trees of more groups than may be broadcast are dealt to them as initial state."""
    fields = [T.StructField("z_classic", T.DoubleType()), T.StructField("iso_score", T.DoubleType()),
              *[T.StructField(c, T.BooleanType()) for c in ("is_z_classic", "is_iso_online", "is_far")],
              T.StructField("votes", T.IntegerType()), T.StructField("is_anomaly", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *fields])
    forest, shared = materialize(forest), None
    few = forest.select("_g").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    if few:
        shared = df.sparkSession.sparkContext.broadcast(forests_of(forest))
    scored = df.withColumn("iso_score", F.lit(None).cast("double"))
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    scored = scored.withColumns({c: F.unix_micros(c) for c in times})  # no time zone on the way
    framer = Framer(scored.columns, order=order, rows=rows, ttl_ms=ttl_ms, held_rows=held_rows)
    frames = keep_state(scored.withColumn("_g", _group_key(by)), ["_g"], framer, FRAME, ttl_ms, None if few else forest)
    kept = {f.name: f.dataType for f in [*scored.drop("iso_score").schema.fields, *fields]}
    passed = T.StructType([T.StructField(n, kept[n]) for n in schema.names])
    ring, names, plain = list(Framer.ring), schema.names, to_arrow_schema(passed)

    def check(batches):
        for batch in batches:
            for group, past, body in zip(*(batch.column(c).to_pylist() for c in ("_g", "past", "rows"))):
                part = pa.ipc.open_stream(body).read_all()
                history = np.frombuffer(past, float).reshape(-1, len(ring))
                fresh = np.column_stack([part.column(c).to_numpy() for c in ring]).astype(float)
                z, is_z, far = online_flags(history, fresh, rows, min_rows, z_threshold)
                known = np.arange(len(history) + 1, len(history) + len(fresh) + 1) >= min_rows
                score = part.column("iso_score").to_numpy().astype(float)
                if shared is not None and group in shared.value:
                    score = whole_scores(shared.value[group], fresh[:, :3])
                score = np.where(known, score, np.nan)
                iso = np.nan_to_num(score) < iso_limit
                votes = is_z.astype("int32") + iso.astype("int32") + far.astype("int32")
                found = {"z_classic": z, "iso_score": score, "is_z_classic": is_z, "is_iso_online": iso, "is_far": far,
                         "votes": votes, "is_anomaly": votes >= params.MIN_VOTES}
                columns = [pa.array(found[n], from_pandas=True) if n in found else part.column(n) for n in names]
                yield from pa.Table.from_arrays(columns, names=names).cast(plain).to_batches()

    found = frames.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(check, passed)
    return found.withColumns({c: F.timestamp_micros(c) for c in times})
