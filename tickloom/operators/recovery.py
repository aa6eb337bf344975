"""How well one set of vectors recovers the geometry of another, from cross moments.

Correlations between the off-diagonal entries of two Gram matrices are sums over
all pairs of rows, but each sum is a function of d x d moment matrices:
sum_ij (a_i.a_j)(b_i.b_j) = ||A'B||^2. So no pair of rows is ever formed; rows are
read once and each task sends its d x d sums.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.vectors import unit


def _moments(columns: int):
    """Rows of ``columns`` float arrays to one row of sums: counts, column sums, diagonal products, cross products."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) for i in range(columns)]
            norms = [np.einsum("ij,ij->i", a, a) for a in x]
            parts = [np.array([float(batch.num_rows)]), *(a.sum(axis=0) for a in x), *norms_sums(norms), *((a.T @ b).ravel() for i, a in enumerate(x) for b in x[i:])]
            flat = np.concatenate(parts)
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "x"])

    return run


def norms_sums(norms: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of squared norms, and of the products of every two columns' squared norms."""
    return [np.array([n.sum() for n in norms]), np.array([(a * b).sum() for i, a in enumerate(norms) for b in norms[i:]])]


def gram_correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Correlation of the off-diagonal Gram entries of every two array columns.

    Rows with a null array or part take no part; rows of one column have one
    width. Fewer than two rows, or a column whose entries do not vary, give nan.
    """
    ready = df
    for c in columns:
        ready = ready.where(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()))
    widths = ready.select(*(F.size(c).alias(f"c{i}") for i, c in enumerate(columns))).limit(1).collect()
    if not widths:
        return {(a, b): float("nan") for i, a in enumerate(columns) for b in columns[i + 1 :]}
    d = list(widths[0])
    rows = ready.select(*(F.col(c).cast("array<double>").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(_moments(len(columns)), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(len(rows))  # 1 + sums + d x d products: as large as the vectors are wide
    for r in rows:
        flat[r["at"]] = r["x"]
    at = 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return flat[at - n : at]

    k = len(columns)
    n = float(take(1)[0])
    sums = [take(w) for w in d]
    norms = take(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    diagonal = dict(zip(pairs, take(len(pairs))))
    product = {(i, j): float((take(d[i] * d[j]) ** 2).sum()) - diagonal[i, j] for i, j in pairs}
    mean = [(float(s @ s) - norms[i]) / max(n * (n - 1), 1) for i, s in enumerate(sums)]
    var = {(i, j): product[i, j] / max(n * (n - 1), 1) - mean[i] * mean[j] for i, j in pairs}

    def corr(i: int, j: int) -> float:
        scale = np.sqrt(max(var[i, i], 0) * max(var[j, j], 0))
        return float(var[i, j] / scale) if scale > 0 else float("nan")

    return {(columns[i], columns[j]): corr(i, j) for i, j in pairs if i != j}


def partial_correlation(xy: float, xz: float, yz: float) -> float:
    """Correlation of x and y with z held fixed; 0 where z leaves nothing to vary."""
    left = (1 - xz * xz) * (1 - yz * yz)
    return (xy - xz * yz) / np.sqrt(left) if left > 1e-24 else 0.0


def second_moments(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The d x d matrix of the mean product of the (concatenated) array columns, from one pass."""
    joined = df.select(F.concat(*(F.col(c).cast("array<double>") for c in columns)).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total, n = (x.T @ x) + (0 if total is None else total), n + batch.num_rows
        if total is not None:
            flat = np.r_[float(n), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "x"])

    rows = joined.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["at"]] = r["x"]
    if not len(flat):
        return np.zeros((0, 0))
    d = int(np.sqrt(len(flat) - 1))
    return flat[1:].reshape(d, d) / flat[0]


def top_axes_alignment(df: DataFrame, a: str, b: str, k: int) -> float:
    """Mean squared cosine between the k leading axes of two array columns of one width; nan without rows."""
    ma, mb = second_moments(df, [a]), second_moments(df, [b])
    if not len(ma):
        return float("nan")
    ua, ub = (np.linalg.eigh(m)[1][:, ::-1][:, :k] for m in (ma, mb))
    return float(((ua.T @ ub) ** 2).sum() / k)


def subspace_share(df: DataFrame, part: str, full: str, k: int) -> float:
    """Of the variance of ``full``, the share within the k directions in which ``part`` varies most; nan without rows or variance."""
    one = df.select(F.concat(F.array(F.lit(1.0)), F.col(part).cast("array<double>")).alias("p"), F.concat(F.array(F.lit(1.0)), F.col(full).cast("array<double>")).alias("f"))
    covariances = []
    for m in (second_moments(one, ["p"]), second_moments(one, ["f"])):
        if not len(m):
            return float("nan")
        covariances.append(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]))
    basis = np.linalg.eigh(covariances[0])[1][:, ::-1][:, :k]
    whole = np.trace(covariances[1])
    return float(np.trace(basis.T @ covariances[1] @ basis) / whole) if whole > 1e-12 else float("nan")


def checked_parts(df: DataFrame, attribute: str, residual: str, full: str, within: float = 1e-4) -> DataFrame:
    """``df``, in which every row's two parts must add up to the direction of ``full``; one that does not fails the query."""
    apart = lambda x, y: F.abs(x - y)
    away = F.array_max(F.zip_with(unit(F.zip_with(attribute, residual, lambda x, y: x + y)), unit(F.col(full)), apart))
    kept = F.when(F.col(full).isNull() | (away <= within), F.col(full)).otherwise(F.raise_error(F.lit("the parts do not add up to the whole")).cast(df.schema[full].dataType))
    return df.withColumn(full, kept)


def canonical_correlations(df: DataFrame, a: str, b: str) -> list[float]:
    """Canonical correlations (uncentred) of two array columns, greatest first."""
    m = second_moments(df, [a, b])
    if not len(m):
        return []
    d = len(df.select(a).where(F.col(a).isNotNull()).first()[0])
    la, lb = (np.linalg.cholesky(x + 1e-9 * np.eye(len(x))) for x in (m[:d, :d], m[d:, d:]))
    cross = np.linalg.solve(la, m[:d, d:]) @ np.linalg.inv(lb).T
    return [float(x) for x in np.clip(np.linalg.svd(cross, compute_uv=False), 0, 1)]


def mean_vectors(df: DataFrame, key: str, v: str) -> DataFrame:
    """``key, v``: the mean of each key's vectors that have no null or NaN part.

    Vectors are unpivoted to (key, position, part) and averaged with a partial
    sum before the shuffle, so a key with most rows costs no more than others.
    """
    parts = df.where(F.col(key).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))).select(key, F.posexplode(v).alias("at", "x"))
    by = parts.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).select(key, F.expr("transform(p, x -> x.x)").alias(v))
