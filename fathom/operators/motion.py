"""Steps between fixes, gap segments, and a constant-velocity Kalman filter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathom.functions.geo import KM_PER_NM, haversine_km


def track() -> WindowSpec:
    return Window.partitionBy("mmsi").orderBy("t", "i")


def steps(fixes: DataFrame) -> DataFrame:
    """fixes with dt_s, km and knots from the vessel's fix before; null for its first, knots also where no time has passed."""
    lag = {c: F.lag(c).over(track()) for c in ("t", "lat", "lon")}
    out = fixes.withColumns({f"_{c}": x for c, x in lag.items()})
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    out = out.withColumn("dt_s", F.col("t") - F.col("_t")).withColumn("km", km)
    return out.withColumn("knots", F.when(F.col("dt_s") > 0, F.col("km") / (F.col("dt_s") / 3600.0) / KM_PER_NM)).drop("_t", "_lat", "_lon")


def segments(fixes: DataFrame, gap_s: int) -> DataFrame:
    """fixes with seg: the number of longer gaps, or steps back in time, before it. A segment is a unit of its own below, so one vessel isn't one task."""
    dt = F.col("t") - F.lag("t").over(track())
    return fixes.withColumn("seg", F.sum(F.when((dt > gap_s) | (dt <= 0), 1).otherwise(0)).over(track()))


@dataclass(frozen=True)
class Kalman:
    """Variances, in square degrees and hours, of the process (on position and velocity), the measurement, and the state at the start of a segment."""

    process: float
    measurement: float
    initial: float


class _Filter:
    """The filter over batches of fixes that are sorted by segment, all segments of a batch a step at a time; the last one's state is carried to the next batch."""

    def __init__(self, config: Kalman):
        self.config, self.key, self.held = config, None, None

    def predict(self, key: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predicted latitudes and longitudes, NaN for a segment's first fix. key: (2, n), vessel and segment."""
        c, n = self.config, len(t)
        plat, plon = np.full(n, np.nan), np.full(n, np.nan)
        new = np.ones(n, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        state = np.zeros((8, len(start)))  # t, y, x, vy, vx, and the covariance a, b; b, c
        goes_on = self.key is not None and tuple(key[:, 0]) == self.key
        state[:, 0] = self.held if goes_on else 0
        by = np.argsort(-size, kind="stable")
        for k in range(int(size.max())):
            own = by[: np.searchsorted(-size[by], -k, side="left")]
            at = start[own] + k
            if k == 0:
                fresh = own[1:] if goes_on and own[0] == 0 else own[own != 0] if goes_on else own
                first = start[fresh]
                state[:, fresh] = 0
                state[:3, fresh] = t[first], lat[first], lon[first]
                state[5, fresh] = state[7, fresh] = c.initial
                if not goes_on:
                    continue
                own, at = np.array([0]), start[:1]
            before, y, x, vy, vx, va, vb, vc = state[:, own]
            d = (t[at] - before) / 3600.0
            va, vb, vc = va + 2 * d * vb + d * d * vc + c.process, vb + d * vc, vc + c.process
            y, x = y + d * vy, x + d * vx
            plat[at], plon[at] = y, x
            k1, k2 = va / (va + c.measurement), vb / (va + c.measurement)
            ey, ex = lat[at] - y, lon[at] - x
            ex -= 360 * np.round(ex / 360)
            state[:, own] = t[at], y + k1 * ey, x + k1 * ex, vy + k2 * ey, vx + k2 * ex, (1 - k1) * va, (1 - k1) * vb, vc - k2 * vb
        self.key, self.held = tuple(key[:, -1]), state[:, -1].copy()
        return plat, plon


def kalman(fixes: DataFrame, config: Kalman) -> DataFrame:
    """mmsi, i, seg, t, lat, lon, pred_lat, pred_lon, resid_km: each fix against its prediction; a segment's first has none.

    Latitude and longitude share one covariance (a, b; b, c), as noise is the
    same for both. Longitudes are unwrapped against the prediction. The filter
    is a recurrence: segments are dealt out and sorted by Spark, and numpy steps
    through all segments of an Arrow batch at once. Rows without a vessel, time
    or position are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Filter(config)
        for batch in batches:
            if batch.num_rows:
                mmsi, seg, t, lat, lon = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mmsi", "seg", "t", "lat", "lon"))
                found = state.predict(np.stack([mmsi, seg]), t, lat, lon)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, from_pandas=True) for x in found)], names=[*batch.schema.names, "pred_lat", "pred_lon"])

    cols = ["mmsi", "i", "seg", "t", "lat", "lon"]
    schema = "mmsi long, i long, seg long, t long, lat double, lon double, pred_lat double, pred_lon double"
    dealt = fixes.select(*[F.col(c).cast("double" if c in ("lat", "lon") else "long").alias(c) for c in cols]).dropna().repartition("mmsi", "seg").sortWithinPartitions("mmsi", "seg", "t", "i")
    out = dealt.mapInArrow(run, schema)
    return out.withColumn("resid_km", haversine_km(F.col("pred_lat"), F.col("pred_lon"), F.col("lat"), F.col("lon")))
