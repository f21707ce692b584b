"""What is fitted to residuals: factor spreads, mixtures, skewed t noise. Sums are made by Spark; the driver solves small systems only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored

CELL = ["group_id", "t", "h"]
#: Columns of the block whose products are summed at once.
BLOCK = 32


def factor_spread(residuals: DataFrame, k: int, eps: float = 1e-3, rounds: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """series_id, sigma, loadings by the first k principal components of residual rows (STEP, r): sigma^2 + sum of squares is each variance.

    A randomised block power iteration over long rows: with C the centred residuals, cells by series (a missing residual is 0), Q
    goes to C'C Q by two joins with sums, and is made orthonormal through its Gram matrix. Only matrices of about BLOCK x BLOCK reach
    the driver, whatever the number of series. It ends when the k variances change by less than tolerance; a
    hierarchy of at most BLOCK series takes one round.
    """
    rows = residuals.select(*CELL, "series_id", F.col("r").cast("double").alias("r")).persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.select(*CELL).distinct().count()
    series = stored(rows.groupBy("series_id").agg((F.sum("r") / n).alias("mean"), F.sum(F.col("r") * F.col("r")).alias("squares")), "series")
    wide = series.count()
    if n < 2 or not wide:
        raise ValueError("factors need two steps of residuals and a series")
    p = min(wide, max(BLOCK, k + 8))
    cell = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in CELL)

    def gram(df: DataFrame, other: Column) -> tuple[np.ndarray, np.ndarray]:
        """The sums of q q' and of q times another column: a product a batch in the tasks, then sums of its cells."""
        wider = df.select(F.concat("q", F.array(other)).alias("q"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
                yield pa.RecordBatch.from_arrays([pa.array(range((p + 1) ** 2), pa.int32()), pa.array((q.T @ q).ravel())], names=["at", "g"])

        out = np.zeros((p + 1) ** 2)
        for r in wider.mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect():  # (p + 1)^2 rows
            out[r["at"]] = r["g"]
        out = out.reshape(p + 1, p + 1)
        return out[:p, :p], out[p, :p]

    def summed(df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, q: the sums of r times q."""
        sums = df.groupBy(*keys).agg(*(F.sum(F.col("r") * F.col("q")[i]).alias(f"s{i}") for i in range(p)))
        return sums.select(*keys, F.array(*(F.col(f"s{i}") for i in range(p))).alias("q"))

    def moved(df: DataFrame, keys: str, other: str, by: np.ndarray, matrix: np.ndarray) -> DataFrame:
        """keys, and q less a vector times another column, times a small matrix: a product a batch in the tasks."""
        names = [c.split()[0] for c in keys.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                q = (q - batch.column("other").to_numpy(zero_copy_only=False)[:, None] * by[None, :]) @ matrix
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "q"])

        return df.select(*names, "q", F.expr(other).cast("double").alias("other")).mapInArrow(run, f"{keys}, q array<double>")

    start = F.array(*(F.xxhash64("series_id", F.lit(j)) / float(1 << 63) for j in range(p)))
    basis, seen = stored(series.select("series_id", "mean", start.alias("q")), "basis"), np.zeros(min(k, p))
    for last in range(rounds - 1, -1, -1):
        own, means = gram(basis, F.col("mean"))
        values, vectors = np.linalg.eigh(own)
        white = vectors * np.where(values > values.max() * 1e-13, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)  # q times this is orthonormal
        scores = stored(moved(summed(rows.join(basis, "series_id"), CELL), cell, "1", means, white), "scores")
        own, totals = gram(scores, F.lit(1.0))
        values, vectors = np.linalg.eigh(own / (n - 1))  # variances of the centred residuals within the block's space
        values, vectors = np.maximum(values[::-1][: min(k, p)], 0), vectors[:, ::-1][:, : min(k, p)]
        if p == wide or not last or np.abs(values - seen).max() <= tolerance * max(values.max(), 1e-300):
            break
        seen = values
        image = summed(rows.join(scores, CELL), ["series_id"]).join(series.select("series_id", "mean"), "series_id")
        basis = stored(moved(image, "series_id string, mean double", "mean", totals, np.eye(p)), "basis")
    rows.unpersist()
    loads = white @ vectors * np.sqrt(values)
    made = moved(basis, "series_id string, mean double", "0", np.zeros(p), np.pad(loads, ((0, 0), (0, k - loads.shape[1])))).select("series_id", F.col("q").alias("loadings")).join(series, "series_id")
    variance = (F.col("squares") - n * F.col("mean") * F.col("mean")) / (n - 1)
    kept = F.aggregate("loadings", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("series_id", F.sqrt(F.greatest(variance - kept, F.lit(eps * eps))).alias("sigma"), "loadings")


def mixture_of(residuals: DataFrame, components: int, seed: int = 0) -> tuple[list[float], list[float], list[float]]:
    """(mu_k, sigma_k, logits) of residuals r."""
    if components < 2:
        raise ValueError("a mixture has two components or more")
    model = GaussianMixture(k=components, seed=seed).fit(residuals.select(array_to_vector(F.array("r")).alias("features")))
    parts = sorted(zip([g.mean[0] for g in model.gaussians], [math.sqrt(g.cov.toArray()[0, 0]) for g in model.gaussians], model.weights, strict=True))
    return [float(m) for m, _, _ in parts], [float(s) for _, s, _ in parts], [math.log(max(w, 1e-12)) for _, _, w in parts]


def skew_t_of(residuals: DataFrame) -> DataFrame:
    """nu, lam of pooled residuals r, by moments: nu from the excess kurtosis (above 2), lam from the skewness (a skew normal's)."""
    moments = residuals.agg(F.skewness("r").alias("s"), F.kurtosis("r").alias("e"))
    nu = F.when(F.col("e") > 0, F.least(4 + 6 / F.col("e"), F.lit(200.0))).otherwise(F.lit(200.0))
    size = F.pow(F.least(F.abs("s"), F.lit(0.99)), F.lit(2 / 3))
    d = F.sqrt(math.pi / 2 * size / (size + ((4 - math.pi) / 2) ** (2 / 3)))
    return moments.select(nu.alias("nu"), (F.signum("s") * d / F.sqrt(1 - d * d)).alias("lam"))


def _log_t_density(x: np.ndarray, df: float) -> np.ndarray:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)


def _log_t_below(x: np.ndarray, df: float) -> np.ndarray:
    """Logarithm of the t distribution function, from a table of its integral over evenly spaced asinh(x)."""
    at = np.linspace(-14.0, 14.0, 8001)
    points = np.sinh(at)
    density = np.exp(_log_t_density(points, df)) * np.cosh(at)
    parts = (density[1:] + density[:-1]) / 2 * (at[1] - at[0])
    first = math.exp(_log_t_density(points[:1], df)[0]) * -points[0] / df
    return np.interp(np.arcsinh(x), at, np.log(np.clip(first + np.r_[0.0, np.cumsum(parts)], 1e-300, 1.0)))


def log_skew_t(z: np.ndarray, xi: float, omega: float, lam: float, nu: float) -> np.ndarray:
    """Logarithm of the density of xi + omega W / sqrt(C / nu): W skew normal with lam, C chi-square with nu."""
    u = (z - xi) / omega
    return math.log(2) - math.log(omega) + _log_t_density(u, nu) + _log_t_below(lam * u * np.sqrt((nu + 1) / (nu + u * u)), nu + 1)


def _likelihoods(residuals: DataFrame, points: list[np.ndarray]) -> np.ndarray:
    """Sums of log densities of r at each of some points (xi, log omega, lam, log(nu - 2)), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("r").drop_null().to_numpy(zero_copy_only=False)
            sums = [float(log_skew_t(z, a, math.exp(b), c, 2 + math.exp(d)).sum()) for a, b, c, d in points]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(sums)], names=["k", "ll"])

    found = residuals.select("r").mapInArrow(run, "k int, ll double").groupBy("k").agg(F.sum("ll").alias("ll")).collect()  # a row a point
    out = np.full(len(points), -np.inf)
    for r in found:
        out[r["k"]] = r["ll"]
    return out


def skew_t_fit(residuals: DataFrame, rounds: int = 15, tolerance: float = 1e-7) -> tuple[float, float, float, float]:
    """(xi, omega, nu, lam) of residuals r by maximum likelihood, from the moments' start.

    Newton steps: the score and the Hessian are differences of log likelihood sums that one pass over the rows gives
    for all points of a stencil; a second pass tries shorter steps. nu stays above 2.
    """
    rows = residuals.select(F.col("r").cast("double").alias("r")).persist(StorageLevel.MEMORY_AND_DISK)
    n, mean, deviation = rows.agg(F.count("r"), F.avg("r"), F.stddev_pop("r")).first()
    if not n or not deviation:
        raise ValueError("skewed t noise needs residuals that differ")
    nu, lam = skew_t_of(rows).first()
    nu, lam = min(max(nu, 3.0), 60.0), min(max(lam, -5.0), 5.0)
    delta = lam / math.sqrt(1 + lam * lam)
    shift = math.sqrt(nu / math.pi) * math.exp(math.lgamma((nu - 1) / 2) - math.lgamma(nu / 2)) * delta
    omega = deviation / math.sqrt(nu / (nu - 2) - shift * shift)
    at = np.array([mean - omega * shift, math.log(omega), lam, math.log(nu - 2)])
    low, high = np.array([-np.inf, -np.inf, -50.0, -6.0]), np.array([np.inf, np.inf, 50.0, 6.0])
    step = np.array([1e-3 * deviation, 1e-3, 1e-3, 1e-3])
    pairs = [(i, j) for i in range(4) for j in range(i)]
    for _ in range(rounds):
        unit = np.diag(step)
        stencil = [at, *(at + s * unit[i] for i in range(4) for s in (1, -1)), *(at + a * unit[i] + b * unit[j] for i, j in pairs for a in (1, -1) for b in (1, -1))]
        v = _likelihoods(rows, stencil) / n
        up, down = v[1:9:2], v[2:9:2]
        score, hessian = (up - down) / (2 * step), np.diag((up - 2 * v[0] + down) / step**2)
        for at_pair, (i, j) in enumerate(pairs):
            a, b, c, d = v[9 + 4 * at_pair : 13 + 4 * at_pair]
            hessian[i, j] = hessian[j, i] = (a - b - c + d) / (4 * step[i] * step[j])
        values, vectors = np.linalg.eigh(-hessian)
        way = vectors @ ((vectors.T @ score) / np.maximum(np.abs(values), 1e-4))  # uphill also where it isn't concave
        tries = [np.clip(at + 0.5**s * way, low, high) for s in range(7)]
        gains = _likelihoods(rows, tries) / n - v[0]
        best = int(np.argmax(gains))
        if gains[best] <= tolerance:
            break
        at = tries[best]
    rows.unpersist()
    return float(at[0]), math.exp(at[1]), 2 + math.exp(at[3]), float(at[2])
