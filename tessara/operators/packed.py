"""Draws as arrays: a row of parameters gives one array of n draws, and nodes get element-wise sums of arrays.

The draws are those of ``sampling`` (one row a draw), number for number but for rounding; a shuffle carries a row a cell and not a row a draw.
Shocks come from the same counter hash, computed for the draws of many rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import BITS, HALF, PRIME, SECOND
from .sampling import need

#: Draws that a task holds at once, whatever n is (one row's draws are always together).
AT_ONCE = 1 << 18


def _mixed(start: np.ndarray, *keys: np.ndarray | int) -> np.ndarray:
    """functions.draws.hashed over arrays of long numbers."""
    x, y = start >> 31, start & (HALF - 1)
    for key in keys:
        x = _fifth(x * 48271 + y * 40692 + key % PRIME * 69621 + 12345, PRIME)
        y = _fifth(y * 48271 + x * 40692 + key % SECOND * 69621 + 12345, SECOND)
    return x * HALF + y


def _fifth(value: np.ndarray, p: int) -> np.ndarray:
    value = value % p
    power = value * value % p
    return power * power % p * value % p


def _uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> (62 - BITS)) + 0.5) / float(1 << BITS)


def _normal(state: np.ndarray, stream: int) -> np.ndarray:
    u, v = (_uniform(_mixed(state, 2 * stream + j)) for j in (0, 1))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers as doubles; null is not a number."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _wide(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of arrays as a matrix of width columns; what an array lacks is not a number."""
    out = np.full((batch.num_rows, width), np.nan)
    for row, values in enumerate(batch.column(name).to_pylist()):
        for j, x in enumerate((values or ())[:width]):
            out[row, j] = np.nan if x is None else x
    return out


def _drawn(batch: pa.RecordBatch, n: int, seed: int | str, k: int, components: int) -> np.ndarray:
    """Rows x n draws; a row with a null where its kind has a parameter has draws that are no numbers."""
    names, rows = set(batch.schema.names), batch.num_rows

    def key(name: str) -> np.ndarray:
        return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]

    shared = _mixed(np.zeros((rows, 1), np.int64), key(seed) if isinstance(seed, str) else seed, key("group_no"), key("t"), key("h"), np.arange(n, dtype=np.int64)[None, :])
    own = _mixed(shared, key("series_no"))
    factors = np.zeros((rows, n))
    loadings = np.nan_to_num(_wide(batch, "loadings", k))
    for j in range(k):
        if loadings[:, j].any():
            factors += loadings[:, j : j + 1] * _normal(shared, 100 + j)
    first = _normal(own, 0)
    noise, mu, sigma = first, _numbers(batch, "mu")[:, None] if "mu" in names else np.nan, _numbers(batch, "sigma")[:, None] if "sigma" in names else np.nan
    if "nu" in names:
        nu, lam = _numbers(batch, "nu")[:, None], _numbers(batch, "lam")[:, None]
        skewed = ~np.isnan(nu[:, 0])
        if skewed.any():
            nu, lam, of = nu[skewed], lam[skewed], own[skewed]
            d = lam / np.sqrt(1 + lam * lam)
            cube = np.maximum(1 - 2 / (9 * nu) + _normal(of, 2) * np.sqrt(2 / (9 * nu)), 1e-3)
            noise = first.copy()
            noise[skewed] = (d * np.abs(first[skewed]) + np.sqrt(1 - d * d) * _normal(of, 1)) / np.sqrt(np.maximum(nu * cube**3, 1e-6) / nu)
    out = np.broadcast_to(mu + sigma * noise, (rows, n))
    if "logits" in names:
        mixed = batch.column("logits").is_valid().to_numpy(zero_copy_only=False)
        if mixed.any():
            logits, mus, sigmas = (_wide(batch, c, components)[mixed] for c in ("logits", "mu_k", "sigma_k"))
            gumbel = np.stack([logits[:, c : c + 1] - np.log(-np.log(_uniform(_mixed(own[mixed], 50 + c)))) for c in range(components)], 2)
            best = np.where(np.isnan(gumbel), -np.inf, gumbel).argmax(2)
            out = out.copy()
            out[mixed] = np.take_along_axis(mus, best, 1) + np.take_along_axis(sigmas, best, 1) * first[mixed]
    return out + factors


def sample_packed(params: DataFrame, n: int, seed: int | str, k: int, components: int = 0, keep: tuple[str, ...] = (), clip: bool = False) -> DataFrame:
    """(keep, seed,) group_id, t, h, series_id, ys: n draws of each row of params as an array, in the order of i; clip cuts them at 0.

    Kinds go by the columns as in ``sampling.sample``: with logits a mixture, else with nu skewed t noise, else the factor model. A null
    number among a row's parameters makes ys null; params without rows give none. A null key raises.
    """
    need(params, ["loadings"] + (["mu_k", "sigma_k"] if "logits" in params.columns else ["mu", "sigma"]) + (["lam"] if "nu" in params.columns else []))
    keys = [*keep, *([seed] if isinstance(seed, str) else []), "group_id", "t", "h", "series_id"]
    numbers = [c for c in ("mu", "sigma", "nu", "lam", "logits", "mu_k", "sigma_k", "loadings") if c in params.columns]
    whole = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a null {c}")).cast("long")).otherwise(F.col(c).cast("long")).alias(f"_{c}") for c in ("group_no", "series_no")]
    rows = params.select(*keys, *whole, *numbers)
    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, AT_ONCE // n)):
                piece = batch.slice(at, max(1, AT_ONCE // n))
                named = piece.rename_columns([c.removeprefix("_") if c in ("_group_no", "_series_no") else c for c in piece.schema.names])
                ys = _drawn(named, n, seed, k, components)
                if clip:
                    ys = np.maximum(ys, 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(ys).ravel()), mask=pa.array(np.isnan(ys).any(1)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keys), lists], names=[*keys, "ys"])

    return rows.mapInArrow(draw, f"{kind}, ys array<double>")


def aggregate_packed(packed: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("group_id", "t", "h")) -> DataFrame:
    """keys, node_id, ys: element-wise sums of the arrays of the series below each node, added up in each task before they are shuffled.

    A series without an array adds nothing, and a node without any series that has one gets no row. Arrays of one node differ in no length.
    """
    weighted = F.when(F.col("weight") == 1, F.col("ys")).otherwise(F.transform("ys", lambda y: y * F.col("weight")))
    rows = packed.where("ys IS NOT NULL").join(edges, "series_id").select(*keys, "node_id", array_to_vector(weighted).alias("_v"))
    return rows.groupBy(*keys, "node_id").agg(Summarizer.sum(F.col("_v")).alias("_v")).select(*keys, "node_id", vector_to_array("_v").alias("ys"))


def coherent_packed(params: DataFrame, edges: DataFrame, n: int, seed: int | str, k: int, clip: bool = True, components: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, seed,) group_id, t, h, node_id, ys: draws of all nodes that add up, each node's n draws as one array."""
    keys = (*keep, *([seed] if isinstance(seed, str) else []), "group_id", "t", "h")
    return aggregate_packed(sample_packed(params, n, seed, k, components, keep, clip), edges, keys)


def unpacked(packed: DataFrame) -> DataFrame:
    """A row a draw: packed with i and y instead of ys."""
    return packed.select(*(c for c in packed.columns if c != "ys"), F.posexplode("ys").alias("i", "y"))
