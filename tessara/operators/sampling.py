"""Draws from parameter rows (group_no, series_no, group_id, t, h, series_id, mu, sigma, loadings, ...).

A shock that series share is drawn from keys without the series, so it is equal wherever it is computed
and needs no join. group_no and series_no are the integers that key the draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hashed, uniform, with_normal
from .hierarchy import coherent_aggregate

OUT = ["group_id", "t", "h", "series_id", "i", "y"]


def _out(seed: int | str) -> list[str]:
    """A seed given as a column is a key of the draws: several seeds in one job."""
    return [seed, *OUT] if isinstance(seed, str) else OUT


def need(params: DataFrame, columns: list[str]) -> None:
    """Raises if params lack one of the columns or of the keys of draws."""
    if missing := {"group_no", "series_no", "group_id", "t", "h", "series_id", *columns} - set(params.columns):
        raise ValueError(f"parameters lack {sorted(missing)}")


def _keyed(params: DataFrame, n: int, seed: int | str) -> DataFrame:
    """A row for each draw i, with _shared (keys without the series) and _own."""
    rows = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = hashed(rows, "_shared", [F.col(seed) if isinstance(seed, str) else seed, "group_no", "t", "h", "i"])
    return hashed(rows, "_own", ["series_no"], "_shared")


def _with_factors(rows: DataFrame, k: int) -> DataFrame:
    """_f: the factor part, sum of loading times a shared normal, streams 100 and up."""
    total = F.lit(0.0)
    for j in range(k):
        rows = with_normal(rows, f"_e{j}", "_shared", 100 + j)
        total = total + F.coalesce(F.get("loadings", F.lit(j)), F.lit(0.0)) * F.col(f"_e{j}")
    return rows.withColumn("_f", total)


def sample_factor(params: DataFrame, n: int, seed: int | str, k: int) -> DataFrame:
    """mu + sigma z + loadings . eps for n draws; k: how many factors there are."""
    need(params, ["mu", "sigma", "loadings"])
    rows = with_normal(_with_factors(_keyed(params, n, seed), k), "_z", "_own", 0)
    return rows.withColumn("y", F.col("mu") + F.col("sigma") * F.col("_z") + F.col("_f")).select(*_out(seed))


def sample_skew_t(params: DataFrame, n: int, seed: int | str, k: int) -> DataFrame:
    """Skewed t noise with nu and lam: a chi-square by its cube-root normal."""
    need(params, ["mu", "sigma", "loadings", "nu", "lam"])
    rows = _with_factors(_keyed(params, n, seed), k)
    for stream in range(3):
        rows = with_normal(rows, f"_n{stream}", "_own", stream)
    rows = rows.withColumn("_d", F.col("lam") / F.sqrt(1 + F.col("lam") * F.col("lam")))
    rows = rows.withColumn("_w", F.col("_d") * F.abs("_n0") + F.sqrt(1 - F.col("_d") * F.col("_d")) * F.col("_n1"))
    rows = rows.withColumn("_c", F.greatest(1 - 2 / (9 * F.col("nu")) + F.col("_n2") * F.sqrt(2 / (9 * F.col("nu"))), F.lit(1e-3)))
    rows = rows.withColumn("_c", F.greatest(F.col("nu") * F.col("_c") * F.col("_c") * F.col("_c"), F.lit(1e-6)))
    return rows.withColumn("y", F.col("mu") + F.col("sigma") * F.col("_w") / F.sqrt(F.col("_c") / F.col("nu")) + F.col("_f")).select(*_out(seed))


def sample_mixture(params: DataFrame, n: int, seed: int | str, k: int, components: int) -> DataFrame:
    """One component a draw by the largest logit plus Gumbel noise, then the factor model with its mu_k and sigma_k."""
    need(params, ["mu_k", "sigma_k", "logits", "loadings"])
    rows = _with_factors(_keyed(params, n, seed), k)
    best = []
    for c in range(components):
        rows = hashed(rows, "_g", [50 + c], "_own").withColumn(f"_g{c}", F.get("logits", F.lit(c)) - F.log(-F.log(uniform("_g")))).drop("_g")
        best.append(F.struct(F.col(f"_g{c}").alias("g"), F.get("mu_k", F.lit(c)).alias("mu"), F.get("sigma_k", F.lit(c)).alias("sigma")))
    rows = with_normal(rows.withColumn("_best", F.array_max(F.array(*best))), "_z", "_own", 0)
    return rows.withColumn("y", F.col("_best.mu") + F.col("_best.sigma") * F.col("_z") + F.col("_f")).select(*_out(seed))


def sample_mixed(params: DataFrame, n: int, seed: int | str, k: int, components: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of several kinds in one pass: with logits a mixture, else with nu skewed t noise, else the factor model. keep: further keys of the result.

    A row is drawn as its own kind alone would be: shocks are keyed without keep, so candidates meet the same ones.
    """
    need(params, ["mu", "sigma", "loadings"])
    rows = with_normal(_with_factors(_keyed(params, n, seed), k), "_n0", "_own", 0)
    noise = F.col("_n0")
    if "nu" in params.columns:
        for stream in (1, 2):
            rows = with_normal(rows, f"_n{stream}", "_own", stream)
        nu, lam = F.col("nu"), F.col("lam")
        d = lam / F.sqrt(1 + lam * lam)
        cube = F.greatest(1 - 2 / (9 * nu) + F.col("_n2") * F.sqrt(2 / (9 * nu)), F.lit(1e-3))
        skewed = (d * F.abs("_n0") + F.sqrt(1 - d * d) * F.col("_n1")) / F.sqrt(F.greatest(nu * cube * cube * cube, F.lit(1e-6)) / nu)
        noise = F.when(nu.isNotNull(), skewed).otherwise(noise)
    own = F.col("mu") + F.col("sigma") * noise
    if "logits" in params.columns:
        best = []
        for c in range(components):
            rows = hashed(rows, "_g", [50 + c], "_own").withColumn(f"_g{c}", F.get("logits", F.lit(c)) - F.log(-F.log(uniform("_g")))).drop("_g")
            best.append(F.struct(F.col(f"_g{c}").alias("g"), F.get("mu_k", F.lit(c)).alias("mu"), F.get("sigma_k", F.lit(c)).alias("sigma")))
        rows = rows.withColumn("_best", F.array_max(F.array(*best)))
        own = F.when(F.col("logits").isNotNull(), F.col("_best.mu") + F.col("_best.sigma") * F.col("_n0")).otherwise(own)
    return rows.withColumn("y", own + F.col("_f")).select(*keep, *_out(seed))


def sample(params: DataFrame, n: int, seed: int | str, k: int, components: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Draws by the columns that params have."""
    if keep or {"logits", "nu"} <= set(params.columns):
        return sample_mixed(params, n, seed, k, components, keep)
    if "logits" in params.columns:
        return sample_mixture(params, n, seed, k, components)
    return (sample_skew_t if "nu" in params.columns else sample_factor)(params, n, seed, k)


def sample_coherent(params: DataFrame, edges: DataFrame, n: int, seed: int | str, k: int, clip: bool = True, components: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, seed,) group_id, t, h, i, node_id, y: draws of all nodes that add up."""
    keys = (*keep, *(c for c in _out(seed) if c not in ("series_id", "y")))
    return coherent_aggregate(sample(params, n, seed, k, components, keep), edges, clip, keys)
