"""Hard negatives of anchors: rows of other labels that score just below the anchor's nearest rows of its own label.

Vectors become integers floor(256 x), and a row's score is its integer inner product with the anchor; higher scores
come first, ties by the smaller id. All rows are scored against all anchors, in cells of an anchor block (ANCHORS rows, held as one
matrix) and a row block (streamed some at a time), twice:

1. Positives: the first PER_ANCHOR rows of the anchor's label. Cells keep that many for each anchor.
2. Their scores u1 >= u2 >= ... are the upper limits of all windows asked for, [LOW % of u, u], which overlap. They split the scores into
   disjoint slots (u2, u1], (u3, u2], ..., (-inf, uk]. A cell keeps the first PER_POSITIVE rows of each slot that lie in its widest window,
   and partial results are combined by slot. The slots at and below a positive hold all rows up to its
   score, so its answer is the first PER_POSITIVE rows of these slots in descending order, cut at its own lower limit:
   all windows are answered from one merged list of at most PER_ANCHOR * PER_POSITIVE rows an anchor.

A task holds one anchor block, its best rows and one batch of scores (SCORES numbers). The rows are moved once for each anchor
block and anchors once for each row block; what leaves a cell is a bounded list an anchor, whatever the rows.

Rows without an id, a label or a vector, and those with a null or non-finite component take no part. Rows that share an id count as one, the
smallest by label and components. Vectors of different lengths don't score against each other; an empty vector scores 0.
Equal vectors tie and go by id. No rows or no anchors give no rows; other columns are ignored, whatever their names. Inner products
that don't fit into 64 bits raise. Ids are whole numbers of any type, which the result keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PER_ANCHOR, PER_POSITIVE, LOW = 5, 5, 80
#: Anchors and rows of a block, and scores that a task computes at once.
ANCHORS, ROWS, SCORES = 4096, 65_536, 2_000_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows (vec_id, label, embedding) that take part, one an id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q")
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by floating point where all sums are below 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ArithmeticError("inner products don't fit into 64 bits")
    return a @ b.T


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group by score (descending) and id, sorted so."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


class Best:
    """The first k rows of each of so many groups, as rows come in; a group's k-th score so far bars worse rows."""

    def __init__(self, groups: int, k: int) -> None:
        self.k, self.bar = k, np.full(groups, np.iinfo(np.int64).min)
        self.group = self.score = self.ids = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        well = score >= self.bar[group]
        group, score, ids = (np.concatenate(x) for x in ((self.group, group[well]), (self.score, score[well]), (self.ids, ids[well])))
        at = _first(group, score, ids, self.k)
        self.group, self.score, self.ids = group[at], score[at], ids[at]
        n = np.bincount(self.group, minlength=len(self.bar))
        full = np.flatnonzero(n >= self.k)
        self.bar[full] = self.score[np.cumsum(n)[full] - 1]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch, bool]]:
    """(anchors of a cell, rows of it, whether these are its first), some rows at a time; they come sorted by cell with anchors first."""
    cell, held, anchors = None, [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_dims", "i", "j")], 1)
        is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
        new = np.r_[True, (key[1:] != key[:-1]).any(1) | (is_row[1:] != is_row[:-1])]
        starts = np.flatnonzero(new)
        for at, end in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            part = batch.slice(int(at), int(end - at))
            if tuple(key[at]) != cell:
                cell, held, anchors = tuple(key[at]), [], None
            if not is_row[at]:
                held.append(part)
            elif held or anchors is not None:
                first, anchors = bool(held), pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else anchors
                held = []
                yield anchors, part, first


def _scored(anchors: DataFrame, rows: DataFrame, blocks: int, limits: bool) -> DataFrame:
    """anchor_id, slot, score, vec_id: what each cell keeps. limits: rows of other labels by the slots between anchors' upper limits; else rows of the anchor's label."""
    slots = PER_ANCHOR if limits else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        ids = labels = q = upper = lower = np.zeros(0, np.int64)

        def kept() -> pa.RecordBatch:
            anchor, slot = np.divmod(best.group, slots)
            return pa.RecordBatch.from_arrays([pa.array(ids[anchor]), pa.array(slot.astype(np.int32)), pa.array(best.score), pa.array(best.ids)], names=["anchor_id", "slot", "score", "vec_id"])

        for held, part, first in _cells(batches):
            if first:
                if best is not None:
                    yield kept()
                ids, labels, q = held.column("vec_id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("q"))
                upper = _matrix(held.column("upper")) if limits else upper
                lower = upper // 100 * LOW - upper % 100 * -LOW // 100  # LOW % rounded up, without products over 64 bits
                best = Best(len(ids) * slots, PER_POSITIVE if limits else PER_ANCHOR)
            step = max(1, SCORES // len(ids))
            for at in range(0, part.num_rows, step):
                own = part.slice(at, step)
                row_ids, row_labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                scores, same = products(q, _matrix(own.column("q"))), labels[:, None] == row_labels[None, :]
                if limits:
                    # A score's slot is the last upper limit that it reaches; above the first it is in none.
                    slot = np.full(scores.shape, -1, np.int8)
                    for k in range(slots):
                        slot += scores <= upper[:, k, None]
                    a, r = np.nonzero(~same & (slot >= 0) & (scores >= np.take_along_axis(lower, np.maximum(slot, 0), 1)))
                    best.add(a * slots + slot[a, r], scores[a, r], row_ids[r])
                else:
                    a, r = np.nonzero(same & (ids[:, None] != row_ids[None, :]) & (scores >= best.bar[:, None]))
                    best.add(a, scores[a, r], row_ids[r])
        if best is not None:
            yield kept()

    facts = ["vec_id", "label", "q"]
    n_dims = F.size("q").alias("n_dims")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = F.array().cast("array<bigint>").alias("upper")
    a_blocks = anchors.select(F.greatest(F.lit(1), F.ceil(F.count("*") / ANCHORS)).cast("int")).first()[0]  # a number
    left = anchors.select(*facts, "upper" if limits else none, F.lit(False).alias("is_row"), n_dims, F.pmod(F.xxhash64("vec_id"), F.lit(a_blocks)).cast("int").alias("i"), spread(F.lit(blocks)).alias("j"))
    right = rows.select(*facts, none, F.lit(True).alias("is_row"), n_dims, spread(F.lit(a_blocks)).alias("i"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("j"))
    cells = left.unionByName(right).repartitionById(min(10_000, a_blocks * blocks), F.pmod(F.col("i") * blocks + F.col("j"), F.lit(min(10_000, a_blocks * blocks))).cast("int")).sortWithinPartitions("n_dims", "i", "j", "is_row", "vec_id")
    return cells.mapInArrow(run, "anchor_id long, slot int, score long, vec_id long")


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group of by, with place from 0. Spark keeps k a group in the tasks before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding) where is_anchor (of vec_id) holds."""
    spark = rows.sparkSession
    every = stored(usable(rows), "vectors")
    anchors = every.where(is_anchor)
    blocks = max(-(-every.count() // ROWS), spark.sparkContext.defaultParallelism)
    positives = stored(_ranked(_scored(anchors, every, blocks, False), ["anchor_id"], PER_ANCHOR), "positives")
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("found"))
    # Of fewer positives the last limit stands for the missing ones: their slots are empty.
    upper = F.transform(F.sequence(F.lit(0), F.lit(PER_ANCHOR - 1)), lambda k: F.get("found", F.least(k, F.size("found") - 1))["score"])
    limited = stored(anchors.join(limits.select("vec_id", upper.alias("upper")), "vec_id"), "limits")
    best = _ranked(_scored(limited, every, blocks, True), ["anchor_id", "slot"], PER_POSITIVE)
    # With equal limits a row's slot is the last of them, so the slots at or below any of these positives hold it.
    merged = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("id"), "slot"))).alias("down"))
    answer = F.slice(F.filter("down", lambda x: x["slot"] >= F.col("place")), 1, PER_POSITIVE)
    inside = F.filter(answer, lambda x: -x["less"] >= F.col("lower"))
    lower = F.expr(f"(score - pmod(score, 100)) div 100 * {LOW} + (pmod(score, 100) * {LOW} + 99) div 100").alias("lower")
    asked = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lower, "place")
    found = asked.join(merged, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "row"))
    out = found.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("negative_id"), "positive_score", (-F.col("row.less")).alias("negative_score"))
    kind = rows.schema["vec_id"].dataType
    return out.withColumns({c: F.col(c).cast(kind) for c in ("anchor_id", "positive_id", "negative_id")})
