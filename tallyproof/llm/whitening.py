"""Whitening of embeddings by weighted multiplicity covariance.

Every entry of a vector becomes a whole number. Rows with the same numbers are one vector: an aggregate,
which combines in each task before its shuffle, groups them and counts how often each occurs. All work
after that is done once for each different vector, its count (or one) being its weight in the fit: exact
sums of the dimensions, a weighted product of the centred numbers in blocks, eigenvectors of the d x d
covariance on the driver, and the whitened vector. The rows then get their vector's values by a join of
rows, which Spark can split where one vector is very frequent.

What moves: the numbers of the vectors, a byte each while they are small, and the whitened values of the
different vectors. The driver gets sums and products over the dimensions, whatever the number of rows; the
number of dimensions is bounded by ``most_dimensions``, beyond which `fit` raises.

Defined cases: a null vector, an empty one, and one with a null, infinite or undefined entry takes no part
and is not returned; so are vectors of another length than that of most rows (ties: the longer). Numbers
beyond 2**62 are cut to it. A null id and repeated rows are rows as any. Components of no variance (less than the rounding
error of the largest) are left out, so equal vectors have no components at all; an empty table gives an
empty table. Only the id and the vector are read from the table, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.session import delete_paths, stored

COMPONENTS = 32
SCALE = 64
MOST_DIMENSIONS = 4096
#: Numbers that are handled at a time.
BLOCK = 1 << 20
_LIMIT = 2.0**62
_LIMB = 21  # bits of the three parts in which numbers are summed without overflow
_WIDTHS = ((127, "<i1"), (32_767, "<i2"), (2**31 - 1, "<i4"), (None, "<i8"))
_OF_SIZE = {np.dtype(kind).itemsize: kind for _, kind in _WIDTHS}


def whole_numbers(vectors: pa.Array, scale: float = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors without nulls, by their length, in blocks: the places of those that are finite and not
    empty, and their entries as ``floor(scale * entry)``."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().to_numpy(zero_copy_only=False)  # a null entry is not a number
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == size)
        most = max(1, BLOCK // size)
        for at in range(0, len(places), most):
            some = places[at : at + most]
            block = entries[starts[some][:, None] + np.arange(size)]
            usable = np.isfinite(block).all(axis=1)
            with np.errstate(over="ignore"):
                numbers = np.clip(np.floor(scale * block[usable]), -_LIMIT, _LIMIT).astype(np.int64)
            if len(numbers):
                yield some[usable], numbers


def pack(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The bytes that stand for each vector, in the least width that holds it."""
    largest = np.abs(numbers).max(axis=1)
    done = np.zeros(len(numbers), dtype=bool)
    for limit, kind in _WIDTHS:
        some = np.flatnonzero(~done & (largest <= limit if limit else True))
        if len(some):
            done[some] = True
            raw = numbers[some].astype(kind)
            ends = np.arange(len(some) + 1, dtype=np.int32) * (raw.itemsize * raw.shape[1])
            yield some, pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def unpack(keys: pa.Array, dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and numbers of packed vectors, in blocks."""
    raw = keys.to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        most = max(1, BLOCK // dimensions)
        for at in range(0, len(places), most):
            some = places[at : at + most]
            joined = b"".join([raw[i] for i in some.tolist()])
            yield some, np.frombuffer(joined, _OF_SIZE[size // dimensions]).reshape(-1, dimensions).astype(np.int64)


def _packed(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``_id``, ``_size`` and ``_key`` of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, numbers in whole_numbers(batch.column(1), scale):
                for some, keys in pack(numbers):
                    ids = batch.column(0).take(pa.array(places[some]))
                    sizes = pa.array(np.full(len(some), numbers.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([ids, sizes, keys], ["_id", "_size", "_key"])

    vector = F.col(f"`{vector_col}`")
    wanted = rows.filter(vector.isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), vector.cast("array<double>").alias("_v"))
    return wanted.mapInArrow(run, f"_id {wanted.schema[0].dataType.simpleString()}, _size int, _key binary")


@dataclass
class Whitening:
    """A fit: ``vectors(_key, _n)`` are the different vectors with their counts."""

    vectors: DataFrame | None
    dimensions: int
    n: int  # of the fit
    sums: list[int]
    eigenvalues: np.ndarray  # falling, of the components kept
    explained: np.ndarray
    projection: np.ndarray  # a column for each component, divided by the root of its eigenvalue
    weights: str = "count"
    identity_error: float = 0.0
    _made: list[str] = field(default_factory=list)

    def release(self) -> None:
        delete_paths(self._made)

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean: its whole part, and n times the rest."""
        whole = [s // self.n for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole)]
        return np.array(whole, dtype=np.int64), np.array(rest, dtype=np.int64)


def _weights(counts: np.ndarray, kind: str) -> np.ndarray:
    return counts if kind == "count" else np.ones_like(counts)


def _centred(numbers: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (numbers - whole).astype(np.float64) - rest / n


def _cells(vectors: DataFrame, size: int, make) -> np.ndarray:
    """The sum over tasks of ``size`` numbers that ``make`` gives for keys and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += make(batch.column(0), batch.column(1).to_numpy())
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "value"])

    sums = vectors.select("_key", "_n").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros(size)
    found[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    return found


def _sums(vectors: DataFrame, dimensions: int, kind: str) -> tuple[int, list[int]]:
    """The number of vectors in the fit and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mask = np.zeros((3, dimensions + 1), dtype=np.int64), (1 << _LIMB) - 1
        for batch in batches:
            counts = _weights(batch.column(1).to_numpy(), kind)
            total[0, dimensions] += counts.sum()
            for places, numbers in unpack(batch.column(0), dimensions):
                own = counts[places]
                for limb in range(3):
                    part = numbers >> (_LIMB * limb)
                    total[limb, :dimensions] += own @ (part & mask if limb < 2 else part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), *map(pa.array, total)], ["axis", "a", "b", "c"])

    rows = (
        vectors.select("_key", "_n").mapInArrow(run, "axis long, a long, b long, c long")
        .groupBy("axis").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()
    )
    sums = {r.axis: r.a + (r.b << _LIMB) + (r.c << 2 * _LIMB) for r in rows}
    return sums.get(dimensions, 0), [sums.get(axis, 0) for axis in range(dimensions)]


def fit(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "count",
    scale: float = SCALE,
    most_dimensions: int = MOST_DIMENSIONS,
) -> Whitening:
    """The whitening of all usable rows. ``weights`` is ``count``, so that every row has a say, or
    ``one``, so that every different vector has."""
    if weights not in ("count", "one"):
        raise ValueError(f"weights are 'count' or 'one', not {weights!r}")
    made: list[str] = []
    packed = _packed(rows, id_col, vector_col, scale)
    vectors = stored(packed.groupBy("_size", "_key").agg(F.count("*").alias("_n")), "vectors", made)
    sizes = vectors.groupBy("_size").agg(F.sum("_n").alias("n")).orderBy(F.desc("n"), F.desc("_size")).first()
    if sizes is None:
        return Whitening(None, 0, 0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), weights, 0.0, made)
    dimensions = sizes[0]
    if dimensions > most_dimensions:
        raise ValueError(f"vectors of {dimensions} dimensions; raise most_dimensions ({most_dimensions}) to hold their covariance")
    vectors = vectors.filter(F.col("_size") == dimensions).select("_key", "_n")
    n, sums = _sums(vectors, dimensions, weights)
    fitted = Whitening(vectors, dimensions, n, sums, np.zeros(0), np.zeros(0), np.zeros((dimensions, 0)), weights, 0.0, made)
    whole, rest = fitted.centre

    def products(keys: pa.Array, counts: np.ndarray) -> np.ndarray:
        total = np.zeros((dimensions, dimensions))
        for places, numbers in unpack(keys, dimensions):
            centred = _centred(numbers, whole, rest, n)
            total += (centred * _weights(counts[places], weights)[:, None]).T @ centred
        return total.ravel()

    covariance = _cells(vectors, dimensions**2, products).reshape(dimensions, dimensions) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * dimensions * np.finfo(float).eps).sum())
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dimensions)])[:kept]
    fitted.eigenvalues, fitted.explained = values[:kept], values[:kept] / max(covariance.trace(), np.finfo(float).tiny)
    fitted.projection = axes / np.sqrt(values[:kept])
    fitted.identity_error = _identity_error(fitted)
    return fitted


def _identity_error(fitted: Whitening) -> float:
    """How far the covariance of the whitened vectors is from the identity, at most."""
    kept, whole, rest = fitted.projection.shape[1], *fitted.centre
    dimensions, n, projection, kind = fitted.dimensions, fitted.n, fitted.projection, fitted.weights

    def products(keys: pa.Array, counts: np.ndarray) -> np.ndarray:
        total = np.zeros((kept + 1, kept))
        for places, numbers in unpack(keys, dimensions):
            white = _centred(numbers, whole, rest, n) @ projection
            weighted = white * _weights(counts[places], kind)[:, None]
            total[0] += weighted.sum(axis=0)
            total[1:] += weighted.T @ white
        return total.ravel()

    if not kept:
        return 0.0
    total = _cells(fitted.vectors, (kept + 1) * kept, products).reshape(kept + 1, kept) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(kept)).max())


def deviations(numbers: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """The exact sum over the dimensions of ``(n * x - S) ** 2``, for each vector."""
    apart = numbers - whole
    if np.abs(apart).max(initial=0) >= 1 << 20 or len(whole) >= 1 << 20:  # beyond what sums below hold
        wide, rests = apart.astype(object), rest.astype(object)
        return [int(x) for x in ((n * wide - rests) ** 2).sum(axis=1)]
    squares = (apart * apart).sum(axis=1).tolist()
    low = (apart @ (rest & ((1 << _LIMB) - 1))).tolist()
    high = (apart @ (rest >> _LIMB)).tolist()
    own = sum(int(r) ** 2 for r in rest)
    return [n * n * s - 2 * n * ((h << _LIMB) + x) + own for s, x, h in zip(squares, low, high)]


def whiten(rows: DataFrame, fitted: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Id, ``component`` (from 1), ``deviation`` (decimal, null beyond 38 digits), ``whitened`` and
    ``explained`` of every usable row that was fitted."""
    packed = _packed(rows, id_col, vector_col, scale)
    columns = [F.col("_id").alias(id_col), "component", "deviation", "whitened", "explained"]
    kept = fitted.projection.shape[1]
    if not kept:
        nothing = packed.select("_id", *[F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"))])
        return nothing.filter(F.lit(False)).select(*columns)
    (whole, rest), n, dimensions, projection = fitted.centre, fitted.n, fitted.dimensions, fitted.projection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, numbers in unpack(batch.column(0), dimensions):
                white = _centred(numbers, whole, rest, n) @ projection
                ends = pa.array(np.arange(len(places) + 1, dtype=np.int32) * kept)
                far = pa.array(list(map(str, deviations(numbers, whole, rest, n))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places)), far, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["_key", "_far", "_white"]
                )

    white = fitted.vectors.select("_key").mapInArrow(run, "_key binary, _far string, _white array<double>")
    white = white.select("_key", F.expr("try_cast(_far as decimal(38,0))").alias("deviation"), "_white")
    joined = packed.filter(F.col("_size") == dimensions).drop("_size").join(white, "_key")
    each = joined.select("_id", "deviation", F.posexplode("_white").alias("_at", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained])
    return each.withColumns({"component": F.col("_at") + 1, "explained": F.get(explained, F.col("_at"))}).select(*columns)
