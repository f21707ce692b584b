"""Language-model scores of texts by a probabilistic suffix tree (PST) over words.

Contexts are sequences of up to DEPTH words. Level by level Spark counts the n-grams of all training texts; one
that occurs LEAST times or more is a candidate, as a context and as a context's next word, and a level's
candidates grow from the last one's. A divergence test retains a context as a state: the log likelihood that its
own next-word distribution gains over that of its longest retained suffix must pay for its parameters
(KEEP * words * ln(count) / 2). A state's distribution is smoothed with its suffix's by absolute discounting:
each listed next word gives DISCOUNT away, and this share and that of unlisted words go to the suffix. The root's words
have their frequencies, and one symbol stands for all words that were never seen; its share is that of
words seen once (Good-Turing). Every word is scored by its longest suffix state, and all
distributions sum to 1. The base is the add-one score of single words, over the same symbols.

The number of states is bounded by LEAST alone, so the tree grows with the corpus; it is a table and never meets in one
place. Texts are read once and become chunks of word numbers with their words' 64-bit hashes (n-grams are
known by hashes of hashes; a collision among 2 ** 32 of them is expected once). Broadcast are only bit tables of 2 ** BITS
bits, which tell keys that cannot be in the tree and spare their shuffle; results don't depend on them. For scoring, the tree lies
in buckets of about BUCKET rows by key range; the distinct keys of a chunk of about CHUNK_BYTES are sent to their buckets as
arrays, come back as values in the same order, and each chunk is scored by itself.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end for each text. Null texts count as
empty, repeated rows give repeated rows, an empty table gives an empty result, without training texts
all counts are 0 and each word is the unseen symbol, whose probability is 1; a text longer than a chunk is a chunk of its
own; no order of rows, ties or partitions changes counts or states, and further columns are ignored. doc_id may be any type that
Spark casts to text and back.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, distinct, no_gc, runs_of, sliced, stored, typed

DEPTH, LEAST, KEEP, DISCOUNT, CHUNK_BYTES, BITS, BUCKET = 3, 16, 1.0, 0.75, 6_000_000, 26, 100_000
#: Kinds of the tree's rows: a word's count, a state's log of the share that goes to its suffix, the log probability of a state's next word.
WORD, STATE, NEXT = 0, 1, 2

_GOLD, _ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, then its end, the empty word."""
    return [*(text or b"").lower().split(), b""]


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def longer(ctx: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first and last n - 1 words (as signed numbers)."""
    with np.errstate(over="ignore"):
        x = ctx.view(np.uint64) * _GOLD + suf.view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _ONE + ctx.view(np.uint64)
        x = (x ^ (x >> np.uint64(27))) * _TWO
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _packed(ids: np.ndarray) -> bytes:
    """Word numbers, compressed with their first bytes side by side, then their second ones, and so on."""
    return zstandard.compress(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Chunk:
    """Texts as word numbers. keys: of the chunk's distinct words; ids: of all words, one text after another; room: words of the text up to each one."""

    def __init__(self, sizes: bytes, ids: bytes, keys: bytes) -> None:
        self.sizes, self.ids, self.keys = np.frombuffer(sizes, np.int32).astype(np.int64), _unpacked(ids), np.frombuffer(keys, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.room = np.arange(1, len(self.ids) + 1, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)

    def levels(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """n, places, ctx, suf for n = 2 .. most: where n-grams end, and the keys of their first and last n - 1 words."""
        at, key = np.arange(len(self.ids)), self.keys[self.ids]
        for n in range(2, most + 1):
            stays = self.room[at] >= n  # the word before is in the text too, and so at[k - 1] is its place
            own = np.flatnonzero(stays)
            ctx, suf, at = key[own - 1], key[own], at[own]
            yield n, at, ctx, suf
            key = longer(ctx, suf)


_CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.string())), ("train", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary())])


def encoded(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, docs, train, sizes, ids, keys: the texts of docs, read once. train: whether a row's text is learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            made = itertools.count(TaskContext.get().partitionId() << 32)
            doc_ids, learned, ids, size = [], [], [], 0
            number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)

            def row() -> pa.RecordBatch:
                keys = np.fromiter(map(key_of, number), np.uint64, len(number))
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                parts = [next(made)], [doc_ids], [bytes(learned)], [sizes.tobytes()], [_packed(np.concatenate(ids))], [keys.tobytes()]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, _CHUNK.types, strict=True)], schema=_CHUNK)

            for part in sliced(batches):
                for doc, own, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = tokens_of(text)
                    doc_ids.append(doc)
                    learned.append(own)
                    ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    size += len(text or b"")
                    if size >= chunk_bytes:
                        yield row()
                        doc_ids, learned, ids, size = [], [], [], 0
                        number = defaultdict(itertools.count().__next__)
            if doc_ids:
                yield row()

    rows = by_text(docs, F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "chunk long, docs array<string>, train binary, sizes binary, ids binary, keys binary"), "chunks")


def word_counts(chunks: DataFrame) -> DataFrame:
    """key, n of each token of the training texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for train, sizes, ids, keys in frame.itertuples(index=False, name=None):
                own = Chunk(sizes, ids, keys)
                n = np.bincount(own.ids[np.repeat(np.frombuffer(train, bool), own.sizes)], minlength=len(own.keys))
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"key": own.keys[seen], "n": n[seen].astype(np.int32)})

    # Chunks are counted already: tasks need not count their rows again before the shuffle.
    counted = chunks.select("train", "sizes", "ids", "keys").mapInPandas(run, "key long, n int").repartition("key")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def bit_table(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table of 2 ** bits bits in which those of the rows' keys are set; at most 2 ** (bits - 6) rows come to the driver."""
    low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    cells = rows.select(F.shiftright(low, 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[cells["cell"].to_numpy()] = cells["bit"].to_numpy()
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    low = keys & (len(table) * 64 - 1)
    return (table[low >> 6] >> (keys & 63)) & 1 == 1


def gram_counts(chunks: DataFrame, n: int, known: Broadcast, least: int = LEAST) -> DataFrame:
    """key, ctx, suf, n of the n-grams of the training texts that occur least times or more. known: bit table of the last level's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for train, sizes, ids, keys in frame.itertuples(index=False, name=None):
                ctx, suf, count = _counted(Chunk(sizes, ids, keys), np.frombuffer(train, bool), n, known.value)
                yield pd.DataFrame({"ctx": ctx, "suf": suf, "n": count})

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame.insert(0, "key", longer(frame["ctx"].to_numpy(), frame["suf"].to_numpy()))
            yield frame

    counted = chunks.select("train", "sizes", "ids", "keys").mapInPandas(run, "ctx long, suf long, n int").repartition("ctx", "suf")
    frequent = counted.groupBy("ctx", "suf").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return frequent.mapInPandas(keyed, "key long, ctx long, suf long, n long")


def _counted(own: Chunk, train: np.ndarray, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ctx, suf and count of the n-grams of a chunk's training texts whose parts may be known."""
    *_, (_, at, ctx, suf) = own.levels(n)
    stays = np.repeat(train, own.sizes)[at]
    del at
    stays[stays] = may_hold(known, suf[stays])
    stays[stays] = may_hold(known, ctx[stays])
    ctx, suf = ctx[stays], suf[stays]
    order, new = runs_of(longer(ctx, suf))
    starts = np.flatnonzero(new)
    first = order[starts]
    return ctx[first], suf[first], np.diff(starts, append=len(order)).astype(np.int32)


def retained(grams: DataFrame, last: DataFrame, keep: float = KEEP, discount: float = DISCOUNT) -> DataFrame:
    """key, n, ctx, had (ctx's count), p (of the last word after the longest retained context), said (whether ctx itself is retained) and share (what its suffix gets) of each n-gram.

    last: the same of the n-grams of one word less: each n-gram's first words are one, and so are its last ones.
    """
    low = grams.join(last.select(F.col("key").alias("suf"), F.col("p").alias("low")), "suf").join(last.select(F.col("key").alias("ctx"), F.col("n").alias("had")), "ctx")
    sums = grams.groupBy("ctx").agg(F.sum("n").alias("listed"), F.count("*").alias("words"))
    each = low.join(sums, "ctx").withColumn("share", 1 - (F.col("listed") - discount * F.col("words")) / F.col("had"))
    each = each.withColumn("own", (F.col("n") - discount) / F.col("had") + F.col("share") * F.col("low"))
    gain = F.sum(F.col("n") * F.log(F.col("own") / F.col("low"))) + F.first((F.col("had") - F.col("listed")) * F.log("share"))
    test = each.groupBy("ctx").agg((gain >= F.first(keep * F.col("words") * F.log("had")) / 2).alias("said"))
    return each.join(test, "ctx").select("key", "n", "ctx", "had", F.when(F.col("said"), F.col("own")).otherwise(F.col("low")).alias("p"), "said", "share")


@dataclass
class Tree:
    """rows: key, kind and value of all words, states and states' next words, n_rows of them; totals of the words; bits: tables of the states and of the next words."""

    rows: DataFrame
    n_rows: int
    n_total: int
    n_distinct: int
    n_once: int
    bits: Broadcast


def fit(chunks: DataFrame, depth: int = DEPTH, least: int = LEAST, keep: float = KEEP) -> Tree:
    """The tree of the training texts of chunks."""
    context = chunks.sparkSession.sparkContext
    words = stored(word_counts(chunks), "words")
    n_total, n_distinct, n_once = (x or 0 for x in words.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).first())
    seen = 1 - (n_once + 1) / (n_total + 1)
    last = words.where(F.col("n") >= least).select("key", "n", (F.lit(seen) * F.col("n") / F.lit(max(1, n_total))).alias("p"))
    rows = words.select("key", F.lit(WORD).alias("kind"), F.col("n").cast("double").alias("value"))
    bits = np.zeros((2, 1 << (BITS - 6)), np.int64)
    for n in range(2, depth + 2):
        known = context.broadcast(bit_table(last))
        grams = stored(gram_counts(chunks, n, known, least), "grams")
        last = stored(retained(grams, last, keep), "states")
        known.destroy()
        said = last.where("said")
        states = said.groupBy(F.col("ctx").alias("key")).agg(F.log(F.first("share")).alias("value")).select("key", F.lit(STATE).alias("kind"), "value")
        following = said.select("key", F.lit(NEXT).alias("kind"), F.log("p").alias("value"))
        bits |= np.stack([bit_table(states), bit_table(following)])
        rows = rows.union(states).union(following)
        if said.limit(1).count() == 0:
            break
    rows = stored(rows, "tree")
    return Tree(rows, rows.count(), n_total, n_distinct, n_once, context.broadcast(bits))


def _asked(own: Chunk, bits: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """n, places, their n-grams' keys and the use of each (1: a state's next word, 2: a state, 3: both), for n = 2 .. depth + 1, of n-grams that may be in the tree."""
    for n, at, ctx, suf in own.levels(depth + 1):
        key = longer(ctx, suf)
        use = (may_hold(bits[0], ctx) & may_hold(bits[1], key)).astype(np.int8)
        if n <= depth:
            use += 2 * may_hold(bits[0], key)
        here = np.flatnonzero(use)
        yield n, at[here], key[here], use[here]


def score(chunks: DataFrame, tree: Tree, depth: int = DEPTH) -> DataFrame:
    """doc_id (as text), n_tokens, n_known, train_tokens, base_score, score of each text of the chunks."""
    bits, n_total, n_distinct = tree.bits, tree.n_total, tree.n_distinct
    unseen = (tree.n_once + 1) / (n_total + 1)
    buckets = max(1, -(-tree.n_rows // BUCKET), chunks.count() // 2)

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, sizes, ids, keys in frame.itertuples(index=False, name=None):
                own = Chunk(sizes, ids, keys)
                yield parted(chunk, 1, np.sort(own.keys))
                for n, _, key, _ in _asked(own, bits.value, depth):
                    yield parted(chunk, n, distinct(key))

    def parted(chunk: int, n: int, keys: np.ndarray) -> pd.DataFrame:
        """A row for each bucket of the sorted keys."""
        bucket = ((((keys.view(np.uint64) >> np.uint64(32)) ^ np.uint64(1 << 31)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return pd.DataFrame({"asked_bucket": bucket[starts], "own_chunk": chunk, "level": n, "keys": [k.tobytes() for k in np.split(keys, starts[1:])] if len(keys) else []})

    def answered(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, sizes = rows.sort_values("key"), [len(k) // 8 for k in asked["keys"]]
        keys, word = np.frombuffer(b"".join(asked["keys"]), np.int64), np.repeat(asked["level"].to_numpy() == 1, sizes)
        value = np.where(word, _looked_up(rows, WORD, keys, 0.0), _looked_up(rows, NEXT, keys, np.nan))
        share = _looked_up(rows, STATE, keys, np.nan).astype(np.float32)
        ends = np.cumsum(sizes)
        values = [zstandard.compress(value[a:b].astype("<f8" if n == 1 else "<f4").tobytes() + share[a:b].tobytes(), 1) for n, a, b in zip(asked["level"], ends - sizes, ends, strict=True)]
        return asked[["own_chunk", "level", "asked_bucket"]].assign(values=values)

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        _, docs, sizes, ids, keys = own.iloc[0]
        texts, order = Chunk(sizes, ids, keys), answers.sort_values(["level", "asked_bucket"])

        def said_of(n: int) -> tuple[np.ndarray, np.ndarray]:
            """The values and shares of the sorted keys asked for."""
            size = 8 if n == 1 else 4
            raw = [zstandard.decompress(x) for x in order["values"][order["level"] == n]]
            cut = [len(x) // (size + 4) * size for x in raw]
            return tuple(np.frombuffer(b"".join(x), f"<f{k}").astype(np.float64) for x, k in (([x[:c] for x, c in zip(raw, cut, strict=True)], size), ([x[c:] for x, c in zip(raw, cut, strict=True)], 4)))

        rank = np.empty(len(texts.keys), np.int64)
        rank[np.argsort(texts.keys)] = np.arange(len(rank))
        n, share = (x[rank] for x in said_of(1))
        base, root = np.log10((n + 1) / (n_total + n_distinct + 1)), np.log(np.where(n > 0, (1 - unseen) * n / max(1, n_total), unseen))
        said = root[texts.ids]
        shares = share[texts.ids]  # of each word's longest context so far of one level's length, for the word after it
        for level, at, key, use in _asked(texts, bits.value, depth):
            value, state = said_of(level)
            order_of, new = runs_of(key)
            back = np.empty(len(key), np.int64)
            back[order_of] = np.cumsum(new) - 1  # each key's place among the distinct ones
            own_word = np.full(len(said), np.nan)
            own_word[at] = np.where(use & 1, value[back], np.nan) if len(at) else 0
            before = np.r_[np.nan, shares[:-1]]
            before[texts.room < level] = np.nan
            # From short contexts to long ones: a state's own word overrides, or its share adds to what its suffix says.
            said = np.where(np.isnan(before), said, np.where(np.isnan(own_word), before + said, own_word))
            shares = np.full(len(said), np.nan)
            shares[at] = np.where(use & 2, state[back], np.nan) if len(at) else 0
        known = np.add.reduceat((n > 0)[texts.ids].astype(np.int64), texts.starts)
        return pd.DataFrame({"doc_id": docs, "n_tokens": texts.sizes, "n_known": known, "train_tokens": n_total, "base_score": np.add.reduceat(base[texts.ids], texts.starts), "score": np.add.reduceat(said, texts.starts) / np.log(10)})

    asked = chunks.select("chunk", "sizes", "ids", "keys").mapInPandas(wanted, "asked_bucket long, own_chunk long, level int, keys binary")
    high = (F.shiftrightunsigned("key", 32) + (1 << 31)).bitwiseAND(F.lit((1 << 32) - 1))  # as in parted(): in the order of signed keys
    bucketed = tree.rows.withColumn("bucket", F.shiftright(high * buckets, 32))
    answers = asked.groupBy("asked_bucket").cogroup(bucketed.groupBy("bucket")).applyInPandas(answered, "own_chunk long, level int, asked_bucket long, values binary")
    by = chunks.select("chunk", "docs", "sizes", "ids", "keys").groupBy("chunk").cogroup(answers.groupBy("own_chunk"))
    return by.applyInPandas(run, "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _looked_up(rows: pd.DataFrame, kind: int, wanted: np.ndarray, none: float) -> np.ndarray:
    """The values of the wanted keys in rows of a kind, which are sorted by key; none where there is no such key."""
    own = (rows["kind"] == kind).to_numpy()
    keys, values = rows["key"].to_numpy(np.int64)[own], rows["value"].to_numpy(np.float64)[own]
    if not len(keys):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], none)


def scored(docs: DataFrame, train: Column, depth: int = DEPTH, least: int = LEAST, keep: float = KEEP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of all texts under a tree fitted to those where train holds."""
    chunks = encoded(docs, train, chunk_bytes)
    return typed(score(chunks, fit(chunks, depth, least, keep), depth), docs)
