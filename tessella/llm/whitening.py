"""Embedding whitening: exactly centred rows, a distributed Gramian, components by local eigh."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free, with_workers

#: Steps of the grid that entries are rounded down to: a whole number x stands for x / GRID.
GRID = 256
COMPONENTS = 4
#: Products and sums of whole numbers beyond this are taken with Python's own integers.
SAFE = 1 << 61
LONG = (1 << 63) - 1


@dataclass
class Fit:
    """Sums and components of the distinct vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column each
    trace: float
    error: float = 0.0

    @property
    def scale(self) -> np.ndarray:
        """One over the root of each eigenvalue; 0 where there is no spread, so that no noise is blown up."""
        spread = self.values > self.trace * len(self.sums) * np.finfo(float).eps
        return np.divide(1.0, np.sqrt(np.where(spread, self.values, 1.0))) * spread

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Rows of x less the mean, rounded once, and the exact squared length of n x - S."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * most < SAFE and max(map(abs, self.sums), default=0) < SAFE:
            y = x * self.n - np.array(self.sums, np.int64)
            about = (y.astype(float) ** 2).sum(axis=1)
            squares: list[int | None] = (y * y).sum(axis=1).tolist()
            for k in np.flatnonzero(about > LONG / 2):  # these may have run over
                squares[k] = sum(v * v for v in y[k].tolist())
            centred = y / self.n
        else:
            exact = [[v * self.n - s for v, s in zip(row, self.sums, strict=True)] for row in x.tolist()]
            squares = [sum(v * v for v in row) for row in exact]
            centred = np.array([[v / self.n for v in row] for row in exact], float).reshape(x.shape)
        return centred, [q if q <= LONG else None for q in squares]

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors * self.scale


def whole(vector: Column) -> Column:
    """Entries as whole numbers: floor(256 c), null where a vector or an entry is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce((c.cast("double") > float("-inf")) & (c.cast("double") < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long")))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of rows of one array column, by Spark's own row matrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _rows_of(column: pd.Series, length: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, length))


def _means(rows: DataFrame, column: str) -> list[float]:
    sums = rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    return [r["m"] for r in sums.orderBy("k").collect()]


def fit(distinct: DataFrame, length: int, components: int = COMPONENTS) -> Fit:
    """Means and leading components of ``x``, a column of distinct arrays of one length.

    Brought to the driver are sums (one for each dimension) and the Gramian, whose size is
    that of the dimensions squared whatever the number of rows. Rows are centred exactly
    before they are multiplied: n x - S in whole numbers, then one division.
    """
    # decimals of 38 digits hold sums of up to 10^18 longs
    sums = distinct.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    found = sums.orderBy("k").collect()
    out = Fit(found[0]["n"], [int(r["s"]) for r in found], np.zeros(0), np.zeros((length, 0)), 0.0)

    def centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"y": list(out.centred(_rows_of(f["x"], length))[0])})

    def white(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"w": list(out.whiten(out.centred(_rows_of(f["x"], length))[0]))})

    with_workers(distinct)
    covariance = gramian(distinct.mapInPandas(centre, "y array<double>"), "y") / out.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    top = np.argsort(-values, kind="stable")[:components]
    out.values, out.vectors, out.trace = np.maximum(values[top], 0.0), vectors[:, top], float(np.trace(covariance))
    # what whitening made of the rows, measured: its covariance about its own mean
    made = distinct.mapInPandas(white, "w array<double>")
    middle = _means(made, "w")
    measured = gramian(made.select(F.transform("w", lambda v, k: v - F.get(F.lit(middle), k)).alias("w")), "w") / out.n
    spread = out.scale > 0
    out.error = float(np.abs(measured - np.eye(len(top)))[np.ix_(spread, spread)].max(initial=0.0))
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error`` for each row and leading component.

    Rows whose vector is null or holds a null or a value that is not finite are left out.
    Entries are rounded down to whole steps of 1/256 (beyond 64 bits: the largest step). Each
    distinct vector counts once in the fit; rows that repeat, ids that repeat and null ids
    are all returned. Vectors of another length are a space of their own, fitted by
    themselves; an empty vector has no component and gives no row. A component without
    spread (one vector, constant entries) is whitened to 0 and not part of
    ``identity_error``; ``explained`` is 0 where nothing spreads. ``deviation`` is exact,
    null if it passes 64 bits. An empty table gives an empty result.

    A distinct copy of all vectors, in whole numbers, is shuffled once and written to the
    checkpoint folder; later passes read it.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    id_type = df.schema[id_col].dataType
    (x,) = free([id_col], "x")
    # an id travels as text: pandas would make floats of numbers among which there are nulls
    coded = df.select(F.col(id_col).cast("string").alias(id_col), whole(F.col(vector_col)).alias(x)).where(F.size(x) > 0)
    distinct = checkpoint(coded.select(F.col(x).alias("x")).distinct())
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().collect()]
    fits = {d: fit(distinct.where(F.size("x") == d), d, components) for d in sorted(lengths)}
    held = df.sparkSession.sparkContext.broadcast(fits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for length, part in f.groupby(f[x].map(len), sort=False):
                one = held.value[length]
                centred, deviation = one.centred(_rows_of(part[x], length))
                k, rows = len(one.values), len(part)
                share = one.values / one.trace if one.trace else np.zeros(k)
                yield pd.DataFrame(
                    {
                        id_col: part[id_col].repeat(k).to_numpy(),
                        "component": np.tile(np.arange(1, k + 1), rows),
                        "n": one.n,
                        "deviation": pd.array(deviation, "Int64").repeat(k),
                        "whitened": one.whiten(centred).ravel(),
                        "explained": np.tile(share, rows),
                        "identity_error": one.error,
                    }
                )

    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(id_col, T.StringType()), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return with_workers(coded).mapInPandas(run, schema).withColumn(id_col, F.col(id_col).cast(id_type))
