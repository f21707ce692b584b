"""Scores of samples against truth, and their tables by level, dataset and seed.

Samples have a row a draw (keys, i, y), or a row a cell with its draws as an array (keys, ys): the scores take both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.links import normal_cdf, normal_pdf

NODE = ["group_id", "t", "h", "node_id"]


def quantile_grid(step: float = 0.01) -> list[float]:
    """step, 2 step, ... below 1."""
    return [round(step * k, 10) for k in range(1, int(1 / step + 1)) if round(step * k, 10) < 1]


def array_quantiles(ys: Column, grid: list[float]) -> Column:
    """The linear-interpolated quantiles of an array, which is sorted once."""

    def cut(values: Column) -> Column:
        def one(p: Column) -> Column:
            at = p * (F.size(values) - 1)
            low = F.floor(at).cast("int")
            a = F.get(values, low)
            return a + (at - low) * (F.coalesce(F.get(values, low + 1), a) - a)

        return F.transform(F.array(*map(F.lit, grid)), one)

    return F.transform(F.array(F.array_sort(ys)), cut)[0]


def array_spread(ys: Column) -> Column:
    """The mean absolute difference of two different numbers of an array, from one sort; fewer than two raise."""
    n = F.size(ys)
    ranked = F.transform(F.array_sort(ys), lambda y, k: y * (2 * k + 1 - n))
    total = F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 2, F.raise_error(F.lit("two samples or more are needed")).cast("double")).otherwise(2 * total / (n.cast("double") * (n - 1)))


def crps_quantile(samples: DataFrame, truth: DataFrame, keys: list[str] = NODE, quantiles: list[float] | None = None) -> DataFrame:
    """keys, truth, crps: twice the mean pinball loss over linear-interpolated quantiles. Truth meets samples on the keys that it has."""
    grid = quantiles or quantile_grid()
    if "ys" in samples.columns:
        made = samples.select(*keys, array_quantiles(F.col("ys"), grid).alias("q"))
    else:
        made = samples.groupBy(*keys).agg(F.percentile("y", F.array(*map(F.lit, grid))).alias("q"))
    rows = made.join(truth, [c for c in keys if c in truth.columns])
    loss = F.zip_with("q", F.array(*map(F.lit, grid)), lambda q, p: F.greatest(p * (F.col("truth") - q), (p - 1) * (F.col("truth") - q)))
    return rows.select(*keys, "truth", (2 * F.aggregate(loss, F.lit(0.0), lambda a, x: a + x) / len(grid)).alias("crps"))


def pairwise_abs_mean(samples: DataFrame, keys: list[str] = NODE) -> DataFrame:
    """keys, n, spread: the mean absolute difference of two different samples, from one sort instead of all pairs."""
    if "ys" in samples.columns:
        return samples.select(*keys, F.size("ys").cast("long").alias("n"), array_spread(F.col("ys")).alias("spread"))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("y"))
    size = F.count("*").over(Window.partitionBy(*keys))
    ranked = samples.select(*keys, "y", row.alias("k"), size.alias("n"))
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), (2 * F.sum(F.col("y") * (2 * F.col("k") - F.col("n") - 1)) / F.first(F.col("n") * (F.col("n") - 1).cast("double"))).alias("spread"))


def crps_mc(samples: DataFrame, truth: DataFrame, keys: list[str] = NODE) -> DataFrame:
    """keys, truth, crps: the unbiased estimate mean |x - y| - spread / 2. A single sample raises."""
    if "ys" in samples.columns:
        rows = samples.join(truth, [c for c in keys if c in truth.columns])
        near = F.aggregate("ys", F.lit(0.0), lambda a, y: a + F.abs(y - F.col("truth"))) / F.size("ys")
        return rows.select(*keys, "truth", (near - array_spread(F.col("ys")) / 2).alias("crps"))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("y"))
    size = F.count("*").over(Window.partitionBy(*keys))
    ranked = samples.join(truth, [c for c in keys if c in truth.columns]).select(*keys, "y", "truth", row.alias("k"), size.alias("n"))
    n = F.first("n").cast("double")
    checked = F.when(F.first("n") < 2, F.raise_error(F.lit("two samples or more are needed")).cast("double")).otherwise(n)
    spread = 2 * F.sum(F.col("y") * (2 * F.col("k") - F.col("n") - 1)) / (checked * (n - 1))
    return ranked.groupBy(*keys).agg(F.first("truth").alias("truth"), (F.avg(F.abs(F.col("y") - F.col("truth"))) - spread / 2).alias("crps"))


def crps_objective(samples: DataFrame, truth: DataFrame, reduction: str = "sum", keys: list[str] = NODE) -> DataFrame:
    """crps_mc, or its sum or mean as column crps."""
    if reduction not in ("none", "sum", "mean"):
        raise ValueError(f"unknown reduction {reduction!r}")
    rows = crps_mc(samples, truth, keys)
    return rows if reduction == "none" else rows.agg((F.sum if reduction == "sum" else F.avg)("crps").alias("crps"))


#: Samples of a block in the energy score, and cells of a window that one task takes.
BLOCK, CELLS = 128, 4096


def packed_samples(samples: DataFrame, keys: list[str] = NODE) -> DataFrame:
    """keys, ys: the samples of each cell as one array in the order of i."""
    if "ys" in samples.columns:
        return samples.select(*keys, "ys")
    rows = F.array_sort(F.collect_list(F.struct("i", "y")))
    return samples.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.col("_rows").getField("y").alias("ys"))


def pairwise_distances(packed: DataFrame, window: tuple[str, ...], parts: int, beta: float) -> DataFrame:
    """window, n, apart: the sum over pairs i < j of samples of their distance to the power beta over all cells (window, h, node_id, ys).

    Samples go by blocks: a row carries a cell's values of two blocks, and a task adds up the squared distances of their samples by
    matrix products as cells come in. Parts of a window's cells are added up afterwards, and only then are roots taken.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.transform(F.sequence(i, blocks - 1), lambda j: F.struct(i.alias("bi"), j.alias("bj")))))
    rows = packed.withColumn("n", F.size("ys")).select(*window, "n", F.pmod(F.xxhash64("h", "node_id"), F.lit(parts)).cast("int").alias("part"), "ys", F.inline(pairs))
    rows = rows.select(*window, "n", "bi", "bj", "part", F.slice("ys", F.col("bi") * BLOCK + 1, BLOCK).alias("a"), F.slice("ys", F.col("bj") * BLOCK + 1, BLOCK).alias("b"))
    keys = [*window, "n", "bi", "bj"]
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Pieces of batches with one key each."""
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            starts = [k for k in range(len(key)) if k == 0 or key[k] != key[k - 1]]
            for at, end in zip(starts, [*starts[1:], len(key)], strict=True):
                yield key[at], batch.slice(at, end - at)

    def record(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        fields = [pa.array([x], t) for x, t in zip(key[: len(keys)], types, strict=True)]
        return pa.RecordBatch.from_arrays([*fields, pa.array([total.ravel()], pa.list_(pa.float64()))], names=[*keys, "squares"])

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for key, piece in runs(batches, [*keys, "part"]):
            a, b = matrix(piece, "a"), matrix(piece, "b")
            first = a[:, :1]  # near values cancel less around one of them
            a, b = a - first, b - first
            own = np.maximum((a * a).sum(0)[:, None] + (b * b).sum(0)[None, :] - 2 * a.T @ b, 0)
            if key != last and total is not None:
                yield record(last, total)
                total = None
            last, total = key, own if total is None else total + own
        if total is not None:
            yield record(last, total)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            n, i, j = last[-3:]
            m = total.reshape(min(BLOCK, n - i * BLOCK), -1) ** (beta / 2)
            apart = float(np.triu(m, 1).sum() if i == j else m.sum())
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(last, types, strict=True)), pa.array([apart])], names=[*keys, "apart"])

        last, total = None, None
        for key, piece in runs(batches, keys):
            own = matrix(piece, "squares").sum(0)
            if key != last and total is not None:
                yield done()
                total = None
            last, total = key, own if total is None else total + own
        if total is not None:
            yield done()

    types = [to_arrow_type(rows.schema[c].dataType) for c in keys]
    made = rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInArrow(squares, f"{kind}, squares array<double>")
    summed = made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(roots, f"{kind}, apart double")
    return summed.groupBy(*window, "n").agg(F.sum("apart").alias("apart"))


def energy_score(samples: DataFrame, truth: DataFrame, beta: float = 1.0, reduction: str = "none", window: tuple[str, ...] = ("group_id", "t")) -> DataFrame:
    """window, score over the joint block of horizons and nodes, from all samples. Every cell of a window needs the same number of samples."""
    if reduction not in ("none", "sum", "mean"):
        raise ValueError(f"unknown reduction {reduction!r}")
    cell = [*window, "h", "node_id"]
    packed = packed_samples(samples, cell).join(truth.select(*cell, "truth"), cell)
    gaps = packed.select(*window, F.posexplode("ys").alias("i", "y"), "truth").groupBy(*window, "i").agg(F.pow(F.sqrt(F.sum((F.col("y") - F.col("truth")) * (F.col("y") - F.col("truth")))), F.lit(beta)).alias("d"))
    to_truth = gaps.groupBy(*window).agg(F.avg("d").alias("near"), F.count("*").alias("m"))
    most = truth.groupBy(*window).count().agg(F.max("count")).first()[0] or 0  # a number: cells of the largest window
    apart = pairwise_distances(packed.drop("truth"), window, max(1, -(-most // CELLS)), beta)
    n = F.when(F.col("n") != F.col("m"), F.raise_error(F.lit("cells differ in their number of samples")).cast("double")).otherwise(F.col("n").cast("double"))
    rows = to_truth.join(apart, list(window)).select(*window, (F.col("near") - F.col("apart") / (n * (F.col("n") - 1))).alias("score"))
    return rows if reduction == "none" else rows.agg((F.sum if reduction == "sum" else F.avg)("score").alias("score"))


def gaussian_crps(mu: Column, sigma: Column, y: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 0.5641895835477563)


def scrps(crps_rows: DataFrame, floor: float | None = None) -> DataFrame:
    """crps_sum, abs_sum, scrps. Zero mass raises, or is floored."""
    sums = crps_rows.agg(F.sum("crps").alias("crps_sum"), F.sum(F.abs("truth")).alias("abs_sum"))
    return sums.withColumn("scrps", _ratio(floor))


def _ratio(floor: float | None) -> Column:
    if floor is not None:
        return F.col("crps_sum") / F.greatest("abs_sum", F.lit(floor))
    return F.when(F.col("abs_sum") == 0, F.raise_error(F.lit("the targets have no mass")).cast("double")).otherwise(F.col("crps_sum") / F.col("abs_sum"))


def scrps_by_level(crps_rows: DataFrame, nodes: DataFrame, floor: float | None = None) -> DataFrame:
    """level, crps_sum, abs_sum, scrps; level Overall is over all nodes. One pass by grouping sets."""
    rows = crps_rows.join(nodes.select("node_id", "level"), "node_id")
    sums = rows.groupingSets([["level"], []], "level").agg(F.sum("crps").alias("crps_sum"), F.sum(F.abs("truth")).alias("abs_sum"))
    return sums.withColumn("level", F.coalesce("level", F.lit("Overall"))).withColumn("scrps", _ratio(floor))


def validation_scrps(samples: DataFrame, truth: DataFrame, objective: str = "crps") -> DataFrame:
    """scrps of validation windows under the training objective, mass floored at 1e-8."""
    mass = truth.agg(F.greatest(F.sum(F.abs("truth")), F.lit(1e-8)).alias("abs_sum"))
    rows = crps_objective(samples, truth).withColumnRenamed("crps", "v") if objective == "crps" else energy_score(samples, truth, reduction="sum").withColumnRenamed("score", "v")
    return rows.crossJoin(mass).select((F.col("v") / F.col("abs_sum")).alias("scrps"))  # one row each


def scaled_objective(crps_rows: DataFrame, weighting: str = "total") -> DataFrame:
    """loss: the sum of crps as it is (none), by the total mass (total), or by each node's own (series); masses floored at 1e-8."""
    if weighting == "none":
        return crps_rows.agg(F.sum("crps").alias("loss"))
    keys = [] if weighting == "total" else ["group_id", "node_id"] if weighting == "series" else None
    if keys is None:
        raise ValueError(f"unknown weighting {weighting!r}")
    parts = crps_rows.groupBy(*keys).agg((F.sum("crps") / F.greatest(F.sum(F.abs("truth")), F.lit(1e-8))).alias("part"))
    return parts.agg(F.sum("part").alias("loss"))


def results_table(scores: DataFrame) -> DataFrame:
    """level, mean, std (population) and n over seeds."""
    return scores.groupBy("level").agg(F.avg("scrps").alias("mean"), F.stddev_pop("scrps").alias("std"), F.count("*").alias("n"))


def combined_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Results of several datasets under dataset, level."""
    return reduce(DataFrame.unionByName, (t.withColumn("dataset", F.lit(name)) for name, t in tables.items()))
