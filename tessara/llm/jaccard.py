"""Join of documents whose sets of word n-grams have a Jaccard similarity of THRESHOLD or more.

1. Each text becomes a set of 64-bit n-gram hashes, a digest of that set and PERMS MinHash values. Texts
   of equal sets are one class from here on, so copies cost nothing more.
2. Bands of ROWS MinHash values put classes into buckets; only buckets of two or more go on. In a bucket
   pairs are compared STEP values at a time and dropped as soon as the posterior probability (uniform
   prior) of reaching THRESHOLD is below TOLERANCE. Of what is left a bucket returns a spanning forest, not pairs.
3. The connected components of these forests are candidate groups. Within one, all sets are intersected
   exactly, and each class gets its number of links; verified links give the final groups.

Buckets and groups larger than CELL are dealt into cells of two blocks each, so that no task holds more
than two blocks, and results are counts and forests: at most two rows for each member of a cell, whatever
the number of pairs. Band collisions miss a pair at THRESHOLD with probability (1 - 0.8 ** 4) ** 24 < 3.3e-6, the
pruning loses one with about TOLERANCE for each step. Signatures are dropped after buckets, texts are read again
for candidate classes alone, and loops end their lineage with tables in the shared folder.

Words are runs of letters, digits and non-ASCII characters with A-Z in lower case; a text of fewer than N words is one
n-gram. Null texts and texts without words are alone: they link to nothing. Repeated rows are copies;
documents without an id take part, and a group whose documents all lack one has a null class_id. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, fits, named, no_gc, stored, text_key, typed, without
from .licences import words_of

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
PERMS, ROWS, STEP, CELL = 96, 4, 16, 512
#: Hashes of n-grams that a cell's block may hold in all, and words whose hashes a task keeps.
BLOCK_GRAMS, KEPT_WORDS = 4_000_000, 1_000_000
#: Rows of one key that a task of a join by groups gets, and how many keys with more of them are known to all tasks.
HUB, HUBS = 256, 1000

_draw = np.random.RandomState(20240607)
_FACTORS = (_draw.randint(0, 1 << 31, PERMS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _draw.randint(0, 1 << 31, PERMS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Grams:
    """Sets of n-gram hashes of texts."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.table: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        table = self.table
        if len(table) > KEPT_WORDS:
            table.clear()
        for w in set(words).difference(table):
            table[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        hashes = np.array([table[w] for w in words], np.uint64)
        if not words:
            return hashes
        size = min(self.n, len(words))
        rolled = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k]
        return np.unique(_mixed(rolled))


def signature(grams: np.ndarray) -> np.ndarray:
    low = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 8192):
        best = np.minimum(best, (low[None, at : at + 8192] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1))
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of signatures."""
    bands = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key.astype(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n MinHash values that leave P(similarity >= threshold) at tolerance or more.

    With a uniform prior that probability after m matches is P(Binomial(n + 1, threshold) <= m).
    """
    total, m = 0.0, -1
    while total < tolerance and m < n:
        m += 1
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def likely_pairs(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which of the pairs (left[a], right[b]) stay, comparing STEP values at a time."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for at in range(0, left.shape[1], STEP):
        x, y = a[alive], b[alive]
        matches = matches + (left[x, at : at + STEP] == right[y, at : at + STEP]).sum(axis=1)
        stay = matches >= least_matches(min(at + STEP, left.shape[1]), threshold, tolerance)
        alive, matches = alive[stay], matches[stay]
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member of its component) for the members of components of two or more."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def _pairs(n: int, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a cell, some at a time: all of one block, or those between its two blocks (first: whether in the first)."""
    if first.all() or not first.any():
        for at in range(0, n, 256):
            i, j = np.meshgrid(np.arange(at, min(n, at + 256)), np.arange(n), indexing="ij")
            keep = i < j
            yield i[keep], j[keep]
    else:
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        for at in range(0, len(left), 256):
            i, j = np.meshgrid(left[at : at + 256], right, indexing="ij")
            yield i.ravel(), j.ravel()


def _cells(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Rows sorted by key as lists of whole cells."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        new = (frame[key] != frame[key].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield [frame.iloc[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield [rest]


def _dealt(df: DataFrame, group: str, blocks: str, spread: str) -> DataFrame:
    """Each row once for each cell (group, i, j) that its block belongs to; first: whether its block is i."""
    own = df.withColumn("block", F.pmod(F.xxhash64(spread), F.col(blocks)).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return own.select("*", F.inline(other)).withColumn("first", F.col("block") == F.col("i")).drop("block", blocks).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "cls")


def by_group(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts (one row a key; n: how many of rows have it, dropped), the rows of a large key dealt over tasks.

    The HUBS keys with most rows are told to all tasks; each of the others has less than one row in HUBS.
    """
    large = facts.where(F.col("n") > HUB).orderBy(F.desc("n"), key).limit(HUBS).select(key, F.ceil(F.col("n") / HUB).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    others = [c for c in rows.columns if c != key]
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("_part", F.pmod(F.xxhash64(*others), parts)).drop("_parts")
    copied = facts.drop("n").join(F.broadcast(large), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def sets_of(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_key, cls (digest of the n-gram set; null without words), n_grams, sig."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_gc():
            grams = Grams(n)
            for frame in frames:
                rows = []
                for doc_id, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"], strict=True):
                    own = grams.of(text)
                    rows.append((doc_id, key, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), signature(own).tobytes()) if len(own) else (doc_id, key, None, 0, None))
                yield pd.DataFrame(rows, columns=["doc_id", "text_key", "cls", "n_grams", "sig"], dtype=object)

    return typed(by_text(docs, text_key(), "text").mapInPandas(run, "doc_id string, text_key binary, cls binary, n_grams long, sig binary"), docs)


def candidates(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """a, b: forests of class pairs that bands and pruning leave."""

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                keys = band_keys(np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), PERMS))
                yield pd.DataFrame({"band": keys.ravel(), "cls": np.repeat(frame["cls"].to_numpy(), keys.shape[1])})

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _cells(frames, ["band", "i", "j"]):
            out: list[tuple[bytes, bytes]] = []
            twos = [c for c in cells if len(c) == 2]
            if twos:
                both = pd.concat(twos)
                own = np.frombuffer(b"".join(both["sig"]), np.uint32).reshape(-1, PERMS)
                names = both["cls"].to_numpy()
                at = np.arange(0, len(own), 2)
                out += [(names[k + 1], names[k]) for k in at[likely_pairs(own, own, at, at + 1, threshold, tolerance)]]
            for cell in cells:
                if len(cell) > 2:
                    own = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(-1, PERMS)
                    names = cell["cls"].to_numpy()
                    found = [(i[k], j[k]) for i, j in _pairs(len(cell), cell["first"].to_numpy()) for k in [likely_pairs(own, own, i, j, threshold, tolerance)]]
                    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
                    out += [(names[i], names[r]) for i, r in forest(len(cell), a, b)]
            yield pd.DataFrame(out, columns=["a", "b"])

    rows = classes.select("cls", "sig").mapInPandas(bands, "band long, cls binary")
    sizes = stored(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = rows.join(sizes, "band").withColumn("blocks", F.ceil(F.col("size") / CELL)).drop("size")
    signed = met.join(classes.select("cls", "sig"), "cls")
    return stored(_dealt(signed, "band", "blocks", "cls").mapInPandas(prune, "a binary, b binary").distinct(), "candidates")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for the ends of edges (a, b): large-star and small-star by turns."""

    def star(pairs: DataFrame, lower: bool) -> DataFrame:
        """pairs: (u, v), every neighbour v of u. Neighbours are hung on the smallest one."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        hung = by_group(pairs, least, "u")
        if lower:
            made = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            made = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return made.where(F.col("a") != F.col("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, lower=False)
        now = stored(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), lower=True), "stars")
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def links_of(sets: list[np.ndarray], first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs of a cell with similarity of threshold or more, from exact intersections."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    whole = first.all() or not first.any()
    rows = np.arange(len(sets)) if whole else np.flatnonzero(first)
    columns = rows if whole else np.flatnonzero(~first)
    row_of, column_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
    _, gram, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[gram] > 1  # a gram of one set adds to no intersection
    kept, owner = np.unique(gram[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(kept, kind="stable")
    kept, owner = kept[order], owner[order]
    common = np.zeros((len(rows), len(columns)), np.float32)
    step = max(64, (1 << 22) // max(1, len(sets)))  # grams of one product, for a bounded matrix
    for at in range(0, int(kept[-1]) + 1 if len(kept) else 0, step):
        lo, hi = np.searchsorted(kept, [at, at + step])
        own, g = owner[lo:hi], kept[lo:hi] - at
        have = np.zeros((len(sets), min(step, int(kept[-1]) + 1 - at)), np.float32)
        have[own, g] = 1
        common += have[rows] @ have[columns].T
    wide = sizes[rows][:, None] + sizes[columns][None, :]
    i, j = np.nonzero(common >= threshold * (wide - common) - 1e-9 * wide)
    i, j = rows[i], columns[j]
    keep = i < j if whole else np.ones(len(i), bool)
    return i[keep], j[keep]


def verified(docs: DataFrame, members: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, classes, documents: for each class of a cell its links in it and their documents (b null), and a forest of links (a, b).

    members: cls, rep (a document of the class), copies, group, n_grams.
    """

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grams(n)
        for frame in frames:
            sets = [own.of(t) for t in frame["text"]]
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(c) for s, c in zip(sets, frame["cls"], strict=True)]
            yield frame.drop(columns="text").assign(grams=[s.tobytes() for s in sets])[right]

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _cells(frames, ["group", "i", "j"]):
            out: list[tuple] = []
            for cell in cells:
                cell = cell[~cell["cls"].duplicated()]  # documents of one id and one text
                names, copies = cell["cls"].to_numpy(), cell["copies"].to_numpy(np.int64)
                a, b = links_of([np.frombuffer(g, np.uint64) for g in cell["grams"]], cell["first"].to_numpy(), threshold)
                classes = np.bincount(a, minlength=len(cell)) + np.bincount(b, minlength=len(cell))
                documents = np.bincount(a, copies[b], len(cell)) + np.bincount(b, copies[a], len(cell))
                out += [(names[k], None, int(classes[k]), int(documents[k])) for k in np.flatnonzero(classes)]
                out += [(names[k], names[r], None, None) for k, r in forest(len(cell), a, b)]
            yield pd.DataFrame(out, columns=["a", "b", "classes", "documents"], dtype=object)

    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("blocks"), F.count("*").alias("n"))
    own = stored(by_group(members, sizes, "group").select("cls", "rep", "copies", "group", "blocks"), "members")
    texts = docs.select("doc_id", "text").join(fits(own), F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "copies", "group", "blocks", "text")
    with_grams = texts.mapInPandas(grams, "cls binary, copies long, group binary, blocks long, grams binary")
    return stored(_dealt(with_grams, "group", "blocks", "cls").mapInPandas(check, "a binary, b binary, classes long, documents long"), "links")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """For each document: doc_id, class_id (smallest doc_id of its group of linked texts), copy_id (smallest
    doc_id of equal n-gram sets), n_links (other documents at threshold or more), n_classes (of how many
    different n-gram sets, its own left out), n_grams, text_key, and group (null: no other row is linked).
    """
    sets = stored(sets_of(docs, n), "sets")
    alone = sets.where(F.col("cls").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_classes"), "n_grams", "text_key", F.lit(None).cast("binary").alias("group"))
    known = sets.where(F.col("cls").isNotNull())
    classes = stored(known.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("n_grams").alias("n_grams"), F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "classes")
    groups = components(candidates(classes, threshold, tolerance))
    members = classes.drop("sig").join(groups, F.col("cls") == F.col("node")).select("cls", "rep", "copies", "n_grams", F.col("root").alias("group"))
    links = verified(docs, members, n, threshold)
    counted = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("classes").alias("n_classes"), F.sum("documents").alias("linked"))
    roots = components(links.where(F.col("b").isNotNull()).select("a", "b")).select(F.col("node").alias("cls"), "root")
    linked = stored(classes.select("cls", "rep", "copies").join(roots, "cls").join(counted, "cls"), "linked")
    named = linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    found = by_group(linked, named, "root").select("cls", F.col("root").alias("group"), "class_id", F.col("rep").alias("copy_id"), (F.col("linked") + F.col("copies") - 1).alias("n_links"), "n_classes")
    copied = classes.where("copies > 1").join(found.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("group"), F.col("rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.col("copies") - 1).alias("n_links"), F.lit(0).cast("long").alias("n_classes"))
    known_rows = known.select("doc_id", "text_key", "cls", "n_grams").join(fits(stored(found.unionByName(copied), "found"), 100_000), "cls", "left")
    own = lambda c: F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    rows = known_rows.select("doc_id", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), "n_grams", "text_key", "group")
    return rows.unionByName(alone)


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs of each group in rows (of join()): the first by doc_id, null last, and text_key; rows without a group stay.

    Rows of one id and one text are aggregated in the tasks before they meet. Columns of any name and type pass through.
    """
    keys = rows.where(F.col("group").isNotNull()).groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("times"))
    keys = stored(keys.withColumn("order", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")), "keys")
    first = keys.groupBy("group").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    judged = by_group(keys, first, "group").select("doc_id", "text_key", "times", (F.col("order") == F.col("first")).alias("stays"))
    gone = stored(judged.where("NOT stays OR times > 1").select("doc_id", "text_key", "stays"), "gone")
    kept, repeated = without(docs, gone), gone.where("stays")
    if not repeated.limit(1).count():
        return kept
    known = repeated.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"))
    equal = docs.select(text_key(), F.struct(*named(*docs.columns)).alias("row")).join(known, F.col("row.doc_id").eqNullSafe(F.col("its_id")) & F.col("text_key").eqNullSafe(F.col("its_key")), "left_semi")
    # Rows of one id and text may differ elsewhere: the first as JSON stays, for maps have no order of their own.
    return kept.union(equal.groupBy("row.doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
