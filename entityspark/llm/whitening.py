"""Whitening of vectors by a covariance from polarisation.

Of every dimension and of the sum of every two, the exact squared centred values are added up;
the covariance of two dimensions is half of what the variance of their sum exceeds their own
variances by. Entries are whole numbers, so all of this is exact: tasks add 64-bit numbers, or
longer ones where these could overflow, and the driver gets one number for each dimension and
pair, however many rows there are. Only the finished covariance becomes a matrix of doubles,
whose eigenvectors whiten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, quoted

#: An entry c becomes floor(SCALE * c) + SHIFT; entries of LARGEST or more in size are an error.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**42
#: Variances of less than this share of the largest one are rounding in double precision: such components count as without variance.
LEAST_SHARE = 1e-11
#: Rows that one numpy step works on.
STEP_ROWS = 1024
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """What the vectors' distribution gives: exact sums, and the components of positive variance, by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray  # one column each
    variances: np.ndarray
    explained: np.ndarray

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole number nearest to each mean, and how much the sum exceeds n of them by."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near)], object)


def usable(vector: Column) -> Column:
    """True for vectors that are there and have finite entries only."""
    whole = F.aggregate(vector, F.lit(True), lambda ok, c: ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def whole_numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    column = batch.column(batch.schema.get_field_index("v"))
    if len(column) and not (np.diff(np.asarray(column.offsets)) == dims).all():
        raise ValueError(f"all vectors must have {dims} entries, as one of them has")
    flat = np.asarray(column.flatten(), np.float64)
    if (np.abs(flat) >= LARGEST).any():
        raise ValueError(f"entries must be smaller than {LARGEST:.0f} in size")
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims) + SHIFT


def exact_sums(values: np.ndarray) -> list[int]:
    """The columns' sums of squares, exact whatever their size."""
    if values.size and len(values) * float(np.abs(values).max()) ** 2 >= 2.0**62:
        values = values.astype(object)
        return [int(x) for x in (values * values).sum(axis=0)]
    return np.einsum("ij,ij->j", values, values).tolist()


def _steps(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield whole_numbers(batch.slice(start, STEP_ROWS), dims)


def _totals(vectors: DataFrame, dims: int, count: int, add) -> list[int]:  # noqa: ANN001
    """``count`` numbers that ``add(rows)`` gives for each step, added over all rows; each task sends its own totals once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * count
        for rows in _steps(batches, dims):
            totals = [a + b for a, b in zip(totals, add(rows))]
        if any(totals):
            numbers = pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), numbers], names=["k", "total"])

    found = vectors.mapInArrow(run, f"k long, total {WIDE}").groupBy("k").agg(F.sum("total").alias("total")).collect()
    by_place = {r["k"]: int(r["total"]) for r in found}
    return [by_place.get(k, 0) for k in range(count)]


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of all rows of ``(v)``; None where there is no row or no entry.

    Two passes: sums, then the squares of what is left of each dimension, and of each sum of two,
    after the whole number nearest to its mean is taken off. The rest of the mean is taken off
    the totals, again exactly. Components without variance are left out.
    """
    head = vectors.select(F.size("v").alias("dims")).first()
    dims = head["dims"] if head else 0
    if not dims:
        return None
    n_and_sums = _totals(vectors, dims, dims + 1, lambda rows: [len(rows), *rows.sum(axis=0, dtype=object)])
    n, sums = n_and_sums[0], n_and_sums[1:]
    start = Whitening(n, sums, np.empty((dims, 0)), np.empty(0), np.empty(0))
    near, rest = start.centre()
    pairs = dims * (dims - 1) // 2

    def squares(rows: np.ndarray) -> list[int]:
        centred = rows - near
        out = exact_sums(centred)
        for i in range(dims - 1):
            out += exact_sums(centred[:, i : i + 1] + centred[:, i + 1 :])
        return out

    totals = _totals(vectors, dims, dims + pairs, squares)
    single = [n * n * t - n * int(r) ** 2 for t, r in zip(totals, rest)]  # of (n x - S) squared
    covariance = np.empty((dims, dims))
    k = dims
    for i in range(dims):
        covariance[i, i] = single[i] / n**3
        for j in range(i + 1, dims):
            both = n * n * totals[k] - n * int(rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - single[i] - single[j]) // 2 / n**3
            k += 1
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, columns = values[order], columns[:, order]
    positive = values > LEAST_SHARE * max(values[0], 0.0)
    signs = np.where(columns[np.abs(columns).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    return Whitening(n, sums, (columns * signs)[:, positive], values[positive], values[positive] / float(np.trace(covariance)))


def whiten(rows: DataFrame, found: Whitening, components: int = 8) -> DataFrame:
    """``rows`` of ``(.., v)`` with ``deviation`` and ``whitened``, an array of the first components, in place of v."""
    near, rest = found.centre()
    n, dims = found.n, len(found.sums)
    shift = np.array([int(r) / n for r in rest])
    project = found.components[:, :components] / np.sqrt(found.variances[:components])
    width = project.shape[1]
    others = [c for c in rows.columns if c != "v"]
    names = [*others, "deviation", "whitened"]
    largest = max((abs(int(r)) for r in rest), default=0)

    def deviations(centred: np.ndarray) -> list[int]:
        bound = n * float(np.abs(centred).max(initial=0)) + largest
        if dims * bound**2 < 2.0**62:
            own = n * centred - rest.astype(np.int64)
            return np.einsum("ij,ij->i", own, own).tolist()
        own = n * centred.astype(object) - rest
        return (own * own).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                centred = whole_numbers(part, dims) - near
                out = (centred - shift) @ project
                offsets = pa.array(np.arange(len(out) + 1) * width, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1), pa.float64()))
                numbers = pa.array([Decimal(d) for d in deviations(centred)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), numbers, lists], names=names)

    kinds = "".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, f"{kinds}deviation {WIDE}, whitened array<double>")


def identity_error(whitened: DataFrame, width: int) -> float:
    """The largest entry, in size, of the whitened vectors' covariance minus the identity."""
    w = [F.get("whitened", k) for k in range(width)]
    found = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(width) for j in range(i, width))


RESULT = f"component int, n long, deviation {WIDE}, whitened double, explained double, identity_error double"


def whitened_components(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of every row and component.

    Rows whose vector is null, or holds null or entries that are not finite, are dropped; all
    others are fitted and returned, also where they repeat an id or have none. Entries become
    whole numbers (SCALE, SHIFT). ``deviation`` is the sum over dimensions of (n x - S) squared,
    exact. Components have unit length and numbers from 1 by falling variance, their largest
    entry is positive; those without variance (LEAST_SHARE) are left out, so equal vectors, a single vector,
    empty vectors and an empty table give no rows. Vectors of different lengths, and entries of
    LARGEST or more in size, are errors. Other columns are not read.
    """
    rows = embeddings.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v")).where(usable(F.col("v")))
    kind = rows.schema["id"].dataType.simpleString()
    found = fit(rows.select("v"))
    width = 0 if found is None else min(components, len(found.variances))
    if not width:
        return embeddings.sparkSession.createDataFrame([], f"{quoted(id_col)} {kind}, {RESULT}")
    stored = keep(whiten(rows, found, components))
    error = identity_error(stored, width)
    explained = F.array(*[F.lit(float(x)) for x in found.explained[:width]])
    return stored.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
