"""Whitening of embeddings by principal components, with statistics merged as Chan, Golub and LeVeque (1979) do.

Each partition works out its count, sums and scatter around its own mean; two such states merge by the pairwise formula
M = Ma + Mb + d d' na nb / (na + nb), d the difference of the means, in a tree of tasks, so the driver gets a few states
of a fixed size. Entries are whole numbers and sums are exact; a mean is held as a whole number and a remainder, so
nothing is lost to large offsets. The eigenvectors are found on the driver; a second pass over the vectors merges the
covariance of the whitened ones, which has to be the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import in_slices, prepare

#: Entries of a larger size have no whole number that doubles and sums hold exactly.
MOST = 2.0**46
#: States that one task of the tree merges.
FAN = 8


@dataclass
class State:
    """Of some vectors: their number, the exact sum of each dimension, and the scatter around their mean."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and remainders under 1."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def merged(self, other: State) -> State:
        (wa, ra), (wb, rb) = self.mean(), other.mean()
        d = (wb - wa) + (rb - ra)
        n = self.n + other.n
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


def state(x: np.ndarray) -> State:
    """Of the rows of x, whole numbers."""
    out = State(len(x), [int(s) for s in x.sum(0)], np.zeros((x.shape[1],) * 2))
    whole, rest = out.mean()
    y = (x - whole) - rest
    return State(out.n, out.sums, y.T @ y)


def merge(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by the length of the vectors, merged."""
    out = dict(a)
    for d, s in b.items():
        out[d] = out[d].merged(s) if d in out else s
    return out


def whole_numbers(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places of the vectors of that length that can be used, and their entries as whole numbers."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        c = values[starts[at][:, None] + np.arange(d)]
        fine = (np.abs(c) * scale < MOST).all(1)
        yield at[fine], np.floor(scale * c[fine]).astype(np.int64) + shift


def _states(scale: int, shift: int, models=None):
    """Rows (vec_id, embedding) of a partition to its states: of the whole numbers, or of the whitened vectors where models are given."""

    def run(rows: Iterator[tuple]) -> Iterator[dict[int, State]]:
        own: dict[int, State] = {}
        for batch in rows:
            for _, x in whole_numbers(batch.column(1), scale, shift):
                if len(x):
                    own = merge(own, {x.shape[1]: state(x) if models is None else real_state(models.value[x.shape[1]].project(x))})
        yield own

    return run


def real_state(y: np.ndarray) -> State:
    """As state, of rows of real numbers near 0, whose mean is held as a remainder."""
    mean = y.mean(0)
    return RealState(len(y), mean, (y - mean).T @ (y - mean))


@dataclass
class RealState:
    n: int
    at: np.ndarray
    scatter: np.ndarray

    def merged(self, other: RealState) -> RealState:
        d, n = other.at - self.at, self.n + other.n
        return RealState(n, self.at + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


def gathered(vectors: DataFrame, run) -> dict[int, State | RealState]:
    """States of all partitions, merged in a tree whose last step leaves the driver a few."""
    import pickle

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(s)], pa.binary())], names=["state"])

    rows = vectors.transform(in_slices, pack, "state binary").rdd.map(lambda r: pickle.loads(r[0]))
    n = rows.getNumPartitions()
    depth = max(2, -(-max(n - 1, 1).bit_length() // (FAN.bit_length() - 1)))
    return rows.treeReduce(merge, depth) if n else {}


@dataclass
class Model:
    """The principal components of the vectors of one length."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance is no number."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (((x - self.whole) - self.rest) @ self.vectors) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exactly; none where no long holds it."""
        y = x - self.whole
        rest = np.array([s - int(w) * self.n for s, w in zip(self.sums, self.whole, strict=True)], object)
        if (float(self.n) * (float(np.abs(y).max(initial=0)) + 1)) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * y.astype(object) - rest) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact.tolist()]


def model(s: State, most: int) -> Model:
    """At most `most` components, by falling variance. The largest entry of each is positive."""
    whole, rest = s.mean()
    v = s.scatter / s.n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    values = np.where(values > trace * len(v) * 1e-15, values, 0.0)
    return Model(s.n, s.sums, whole, rest, values, vectors, trace)


def _rows(scale: int, shift: int, models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(1), scale, shift):
                m, k = models.value[x.shape[1]] if len(x) else None, len(x)
                if not k:
                    continue
                z = m.project(x)
                c = z.shape[1]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained"]
                of = np.repeat(np.arange(k), c)
                own = pa.array(m.deviations(x), pa.int64())
                share = m.values / m.trace if m.trace else np.zeros(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)).take(pa.array(of)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), k)), pa.array(np.full(k * c, m.n)), own.take(pa.array(of)), pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(share, k))],
                    names=names,
                )

    return run


def whiten(spark: SparkSession, vectors: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of vectors (vec_id, embedding).

    An entry c is taken as the whole number floor(scale * c) + shift. A row for each vector and component, at most
    `most` of these. Vectors that are null or empty, hold null or non-finite entries, or entries over 2^46 / scale, which
    no sum could hold exactly, give no rows. A null vec_id stays null and repeated rows count and come back as often as
    they came. Vectors of each length are whitened among themselves. A component without variance (fewer rows than
    dimensions, copies only) has null as whitened, 0 as explained and no part in identity_error; a deviation that no
    long holds is null. No rows give no rows; other columns are ignored.
    """
    prepare(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    models = spark.sparkContext.broadcast({d: model(s, most) for d, s in gathered(vectors, _states(scale, shift)).items()})
    error = 0.0
    for d, s in gathered(vectors, _states(scale, shift, models)).items():
        on = models.value[d].values > 0
        found = (s.scatter / s.n)[np.ix_(on, on)]
        error = max(error, float(np.abs(found - np.eye(len(found))).max(initial=0)))
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    return vectors.transform(in_slices, _rows(scale, shift, models), kinds).withColumn("identity_error", F.lit(error))
