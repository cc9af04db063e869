"""Whitening of embeddings by an incremental eigendecomposition.

The spectrum of the scatter about the exact mean is kept as eigenvalues and vectors and grows by rank-one updates: in the
basis of the old vectors an update is a diagonal matrix plus one outer product, whose eigenvalues are the roots of the
secular equation and whose vectors follow from them (Loewner's formula keeps them orthogonal). Entries of the outer product that are
negligible, and equal eigenvalues, are deflated: their pairs stay. Tasks update a spectrum with their centred vectors, a
block being condensed by QR to as many rows as there are dimensions first, which leaves the scatter as it is. Spectra
join as rank-one updates by each scaled vector of the other, in groups of bounded size, level by level. A distributed
Rayleigh-Ritz step over all rows ends it: the covariance in the basis found is summed exactly over tasks and solved
once more, so that what the updates rounded is mended. Tasks hold a block of rows and matrices of the dimension only.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; vectors shorter than the
longest are filled with zeros; entries are clipped to +-2^40 before they become integers; a null id is an ordinary row; repeated rows
count each time; ``deviation`` is exact, and null where it does not fit a long; a component without variance (a
single row, equal rows, dependent dimensions) whitens to 0; the sign of a component makes its largest entry positive; an empty
table, or none but empty vectors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
#: Vectors that are condensed and added at once.
BLOCK = 4096
#: Spectra that one task joins.
FAN_IN = 16
#: Eigenvalues below this part of the trace are no variance.
NO_VARIANCE = 1e-13
SCALE, OFFSET, CLIP = 1024.0, 100_000, float(1 << 40)
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of diag(d) + rho z z' (d rising and distinct, z without zeros, rho > 0), each as (nearest pole, distance from it)."""
    n = len(d)
    zz = rho * z * z
    right = np.append(d[1:], d[-1] + zz.sum())
    width = right - d
    gap = d[None, :] - d[:, None]  # gap[i, j] = d_j - d_i
    middle = 1 + (zz / (gap - width[:, None] / 2)).sum(axis=1)
    left_pole = middle > 0  # the root is in the left half
    left_pole[-1] = True
    base = np.arange(n) + ~left_pole
    delta = d[None, :] - d[base][:, None]
    lo = np.where(left_pole, 0.0, -width / 2)
    hi = np.where(left_pole, width / 2, 0.0)
    hi[-1] = width[-1]
    x = (lo + hi) / 2
    rows = np.arange(n)
    for _ in range(100):
        part = zz / (delta - x[:, None])
        slope_part = part / (delta - x[:, None])
        f = 1 + part.sum(axis=1)
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        # a model with the pole at hand exact, the rest a line (Newton for the rest)
        rest, rest_slope = f - part[rows, base], slope_part.sum(axis=1) - slope_part[rows, base]
        # rest + rest_slope (y - x) - zz / y = 0
        a, b, c = rest_slope, rest - rest_slope * x, -zz[base]
        root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
        s = np.where(left_pole, 1.0, -1.0)
        q = -(b + np.where(b >= 0, 1.0, -1.0) * root) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            y1, y2 = q / a, c / q
        y = np.where((y1 * s > 0) & ~(y2 * s > 0), y1, y2)
        y = np.where((y > lo) & (y < hi), y, (lo + hi) / 2)
        done = (np.abs(y - x) <= 2 * EPS * np.abs(x)) | (np.abs(f) <= EPS * (1 + np.abs(part).sum(axis=1)))
        if done.all():
            break
        x = np.where(done, x, y)
    return base, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors diag(values) vectors' + v v'; values rising."""
    z = vectors.T @ v
    rho = float(z @ z)
    if rho == 0:
        return values, vectors
    z = z / np.sqrt(rho)
    small = 8 * EPS * max(np.abs(values).max(), rho)
    d, u = values, vectors
    live = np.abs(rho * z) > small
    # equal eigenvalues: turn their vectors so that only one meets the update
    at = np.flatnonzero(live)
    near = np.flatnonzero(np.diff(d[at]) <= small)
    if len(near):
        u = u.copy()
        for k in near:
            i, j = at[k], at[k + 1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
            z[i], z[j], live[i] = 0.0, r, False
        at = np.flatnonzero(live)
    if not len(at):
        return d, u
    poles, x, new = d[at], None, None
    base, x = secular_roots(poles, z[at], rho)
    # differences root - pole without cancellation, then the z for which these roots are exact
    apart = (poles[base][None, :] - poles[:, None]) + x[None, :]
    own = poles[None, :] - poles[:, None]
    np.fill_diagonal(own, 1.0)
    ratio = apart / np.where(np.eye(len(at), dtype=bool), 1.0, own)
    zz = np.abs(np.prod(ratio, axis=1))
    weights = (np.sign(z[at]) * np.sqrt(zz))[:, None] / -apart
    weights /= np.sqrt((weights * weights).sum(axis=0))
    new = u[:, at] @ weights
    roots = poles[base] + x
    values, vectors = d.copy(), u.copy()
    values[at], vectors[:, at] = roots, new
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def absorb(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum with the outer products of ``rows`` added, condensed first if there are more than dimensions."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for v in rows:
        values, vectors = rank_one(values, vectors, v)
    return values, vectors


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("vector"))
    return v.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _matrix(column, dim: int) -> np.ndarray:
    """x = floor(1024 c) + 100000 of an Arrow column of lists."""
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    if (sizes == dim).all():
        full = flat.reshape(-1, dim)
    else:
        full = np.zeros((len(sizes), dim))
        full[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return np.floor(SCALE * np.clip(full, -CLIP, CLIP)).astype(np.int64) + OFFSET


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension)."""
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    if not dim:
        return 0, []

    def run(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            high += (x >> 20).sum(axis=0)
            low += (x & 0xFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])

    parts = vectors.select("vector").mapInArrow(run, "n long, high array<long>, low array<long>")
    split = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"), "n").groupBy("i")
    found = split.agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low")).collect()
    sums = {r.i: (int(r.high) << 20) + int(r.low) for r in found}
    return found[0].n, [sums[i] for i in range(dim)]


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact mean as whole part and rest."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _table(values, vectors):
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["values", "vectors"])


def spectrum(vectors: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues rising, vectors) of the scatter of all rows about their mean, by rank-one updates."""
    dim = len(sums)
    whole, rest = _centre(sums, n)

    def local(batches):
        values, basis, held, size = np.zeros(dim), np.eye(dim), [], 0
        for b in batches:
            held.append((_matrix(b.column(0), dim) - whole) - rest)
            size += len(held[-1])
            if size >= BLOCK:
                values, basis = absorb(values, basis, np.concatenate(held))
                held, size = [], 0
        if held:
            values, basis = absorb(values, basis, np.concatenate(held))
        yield _table(values, basis)

    def join(batches):
        values, basis = np.zeros(dim), np.eye(dim)
        first = True
        for b in batches:
            for e, u in zip(*(b.column(i).to_pylist() for i in range(1, 3))):
                e, u = np.frombuffer(e), np.frombuffer(u).reshape(dim, dim)
                if first:
                    values, basis, first = e, u, False
                else:
                    some = e > 0
                    values, basis = absorb(values, basis, (u[:, some] * np.sqrt(e[some])).T)
        if not first:
            yield _table(values, basis)

    kind = "values binary, vectors binary"
    parts = common.materialize(vectors.select("vector").mapInArrow(local, kind), "spectra")
    while (count := parts.count()) > FAN_IN:
        dealt = parts.select((F.monotonically_increasing_id() % -(-count // FAN_IN)).alias("g"), "values", "vectors")
        joined = common.materialize(dealt.repartition(-(-count // FAN_IN), "g").mapInArrow(join, kind), "spectra")
        common.discard(parts)
        parts = joined
    last = parts.select(F.lit(0).alias("g"), "values", "vectors").coalesce(1).mapInArrow(join, kind).first()
    common.discard(parts)
    return np.maximum(np.frombuffer(last["values"]), 0), np.frombuffer(last["vectors"]).reshape(dim, dim)


def _in_basis(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance of all rows in a basis, summed over tasks."""
    whole, rest = _centre(sums, n)
    k = basis.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            y = ((_matrix(b.column(0), len(whole)) - whole) - rest) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["t"])

    parts = vectors.select("vector").mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("i", "v"))
    found = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * k)
    for r in found:
        out[r.i] = r.v
    return (out.reshape(k, k) + out.reshape(k, k).T) / (2 * n)


class Model:
    """Counts, sums, eigenvalues (falling) and unit vectors (columns) of the fit list."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, identity_error: float):
        self.n, self.sums, self.values, self.vectors, self.trace, self.identity_error = n, sums, values, vectors, trace, identity_error

    def scaled(self) -> np.ndarray:
        """Vectors over the root of their eigenvalue; 0 for components without variance."""
        live = self.values > NO_VARIANCE * self.trace
        return self.vectors * np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), 0.0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of all rows of ``integers``'s table; None without rows."""
    n, sums = _sums(vectors)
    if not n:
        return None
    _, basis = spectrum(vectors, n, sums)
    basis = np.linalg.qr(basis)[0]
    ritz, turn = np.linalg.eigh(_in_basis(vectors, n, sums, basis))
    falling = np.argsort(-ritz, kind="stable")
    trace = float(np.maximum(ritz, 0).sum())
    falling = falling[:components]
    u = basis @ turn[:, falling]
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    model = Model(n, sums, np.maximum(ritz[falling], 0), u, trace, 0.0)
    model.identity_error = float(np.abs(_in_basis(vectors, n, sums, model.scaled()) - np.eye(u.shape[1])).max())
    return model


def transform(vectors: DataFrame, model: Model) -> DataFrame:
    """``vec_id, deviation, whitened`` (one double a component) of every row of ``integers``'s table."""
    whole, rest = _centre(model.sums, model.n)
    remainder = np.array([s % model.n for s in model.sums], np.int64)
    n, dim, scaled = model.n, len(model.sums), model.scaled()
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dim) - whole
            far = float(np.abs(x).max(initial=0) + 1) * n
            if far < 3e9 and far * far * dim < 9e18:  # n x - S = n (x - whole) - remainder, in longs
                d = n * x - remainder
                deviation = (d * d).sum(axis=1).tolist()
            else:
                exact = (sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, remainder)) for row in x)
                deviation = [e if e < 1 << 63 else None for e in exact]
            white = (x - rest) @ scaled
            k = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k or 1)[: len(x) + 1].astype(np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of ``table`` (``vec_id, embedding``) and component; see ``RESULT``."""
    vectors = integers(table)
    model = fit(vectors, components)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT.format(dict(table.dtypes)["vec_id"]))
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values))
    rows = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all embeddings on their 8 leading components."""
    return whiten(common.read(spark, sf_dir, "embeddings"))
