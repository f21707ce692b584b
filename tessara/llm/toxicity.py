"""Toxicity of texts from their nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows: at most SAMPLE_ROWS and SAMPLE_BYTES of each label, by a hash of doc_id, and
no text over LONGEST_EXAMPLE bytes (such texts are scored whole all the same), which bounds everything that is broadcast. Features are all words of the examples and their GRAM-letter
pieces. A feature's weight is its IDF, raised by the square of its log lift where document frequencies differ between
the labels (in full where the chi-square is far above CHI): none is without weight. fit(chi=None) leaves that factor out and so
takes plain TF-IDF. The examples lie in an
inverted index of two parts. Features of few examples have sparse postings, which a query adds up whole. The
others have block postings: each block holds those of BLOCK examples and each feature's largest weight in it, and
a query visits only blocks whose bound reaches the K-th best sum of the first part, so its neighbours are exact. Their
votes, weighted by the cosine and by the label's share of all labelled rows, are calibrated by a logistic curve
fitted to leave-one-out votes of the examples.

Every text is scored whole. A null text counts as empty; a text without features has no neighbours and
gets the calibrated share of label 1; without labelled rows of both kinds every score is that share
(0 without any). Null labels are not learned, repeated rows give repeated rows, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begins, by_text, no_gc, runs_of, stored, typed
from .licences import words_of

SAMPLE_ROWS, CHI, GRAM, BLOCK, K, KEPT_WORDS = 3000, 12.0, 5, 64, 15, 1_000_000
#: Most bytes of the examples of a label together, and of one.
SAMPLE_BYTES, LONGEST_EXAMPLE = 48 << 20, 1 << 20
#: Share of the examples from which a feature's postings lie in blocks.
COMMON = 0.05
#: Features of kept words, with KEPT_WORDS the bound of what a task remembers.
KEPT_FEATURES = 8_000_000
#: Texts whose cosines are held at once.
STEP = 256


def features_of(word: bytes) -> list[bytes]:
    """The word, marked, and its pieces of GRAM bytes."""
    return [b"=" + word] + [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


@dataclass
class Index:
    """Examples in blocks. postings: block x feature x slot, and bounds: feature x block, of the first features; calibration: slope and offset;
    rare: where each further feature's postings start, and their examples and weights."""

    features: dict[bytes, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    postings: np.ndarray
    bounds: np.ndarray
    share: float
    calibration: tuple[float, float] = (1.0, 0.0)
    rare: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "terms"} | {"features": b" ".join(self.features)}  # no feature has a space, and one string is sent faster than many

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"features": _numbered(state["features"])}

    def weigh(self, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and weights of a text, of length 1."""
        w = (1 + np.log(n)) * self.idf[f]
        return f, (w / np.sqrt((w * w).sum())).astype(np.float32)

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
        """Query x example: the cosine, or less where it is none of the k + 1 largest."""
        blocks, common, _ = self.postings.shape
        near = np.zeros((len(queries), blocks * BLOCK), np.float32)
        heads = np.zeros((len(queries), common), np.float32)
        for i, (f, w) in enumerate(queries):
            head = f < common
            heads[i, f[head]] = w[head]
            if self.rare is not None and not head.all():
                starts, examples_of, weights = self.rare
                at = starts[f[~head] - common]
                n = starts[f[~head] - common + 1] - at
                place = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                near[i] = np.bincount(examples_of[place], weights[place] * np.repeat(w[~head], n), near.shape[1])
        floor = np.partition(near, -k - 1, axis=1)[:, -k - 1] if near.shape[1] > k else np.zeros(len(near))
        bound = near.reshape(-1, blocks, BLOCK).max(axis=2) + heads @ self.bounds
        for b in range(blocks):
            live = np.flatnonzero(bound[:, b] >= floor - 1e-6)
            near[live, b * BLOCK : (b + 1) * BLOCK] += (heads if len(live) == len(heads) else heads[live]) @ self.postings[b]
        return near

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties: first), and the cosines."""
        return self.best(self.cosines([(f, w)], k)[0], k, skip)

    def best(self, near: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The same from a row of cosines()."""
        if skip >= 0:
            near[skip] = 0
        least = np.partition(near, -k)[-k] if len(near) > k else 0.0
        own = np.flatnonzero((near > 0) & (near >= least))
        own = own[np.lexsort((own, -near[own]))[:k]]
        return own, near[own]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """The log odds of label 1: weighted votes with the label's share as one faint vote more."""
        weight = cosine.astype(np.float64) ** 2 * self.votes[best]
        one = float(weight[self.labels[best] == 1].sum())
        p = (one + 0.05 * self.share) / (float(weight.sum()) + 0.05)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.calibration[0] * vote + self.calibration[1]))))


def _numbered(joined: bytes) -> dict[bytes, int]:
    return {f: k for k, f in enumerate(joined.split())}


class Terms:
    """Features of texts by number; those of words seen before are kept, and all words of some texts are counted together."""

    def __init__(self, features: dict[bytes, int]) -> None:
        self.features = features
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def counts(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The features that occur in each text, ascending, and how often."""
        if len(self.place) > KEPT_WORDS or len(self.flat) > KEPT_FEATURES:
            self.forget()
        fresh = list(set().union(*texts).difference(self.place))
        if fresh:
            get = self.features.get
            own = [[k for k in map(get, features_of(w)) if k is not None] for w in fresh]
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.sizes = np.r_[self.sizes, np.fromiter(map(len, own), np.int64, len(own))]
            self.flat = np.r_[self.flat, np.fromiter(itertools.chain.from_iterable(own), np.int32)]
        starts = np.cumsum(self.sizes) - self.sizes
        lengths = [len(t) for t in texts]
        word = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(lengths))
        key = np.sort(np.repeat(np.arange(len(texts)), lengths) * max(1, len(self.place)) + word)
        first = np.flatnonzero(begins(key))
        times, key = np.diff(first, append=len(key)), key[first]
        text, word = np.divmod(key, max(1, len(self.place)))
        n = self.sizes[word]
        place = np.repeat(starts[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.repeat(text, n) * max(1, len(self.features)) + self.flat[place]
        order, new = runs_of(key)
        first = np.flatnonzero(new)
        key = key[order[first]]
        total = np.add.reduceat(np.repeat(times, n)[order], first) if len(key) else np.zeros(0, np.int64)
        text, feature = np.divmod(key, max(1, len(self.features)))
        cuts = np.searchsorted(text, np.arange(1, len(texts)))
        return list(zip(np.split(feature.astype(np.int32), cuts), np.split(total, cuts), strict=True)) if texts else []


def examples(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, y of the sampled examples, and how many labelled rows have each label. The sample is stored: it is read several times."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # one row a label
    drawn = known.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, 2 * n / counts.get(1, 1)))).otherwise(F.lit(min(1.0, 2 * n / max(1, sum(v for k, v in counts.items() if k != 1)))))
    ranked = drawn.where(F.col("u") < share).withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("u", "doc_id")))
    chosen = F.broadcast(ranked.where(F.col("rank") <= n).select("doc_id", F.col("y").cast("int").alias("y"), "rank"))  # at most n rows a label
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").where(F.octet_length("text") <= LONGEST_EXAMPLE)
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, 0))
    return stored(rows.withColumn("bytes", so_far).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id", "text", "y"), "examples"), counts


def _weighed_features(rows: DataFrame, n_of: dict[int, int], chi_of_half: float | None) -> pa.Table:
    """feature, df, telling of all features: 1, and more where document frequencies differ between the labels; those of many rows first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[tuple[bytes, int], int] = {}
            for text, y in zip(frame["text"], frame["y"], strict=True):
                for f in set().union(*map(features_of, set(words_of(text)))):
                    seen[f, y] = seen.get((f, y), 0) + 1
            yield pd.DataFrame([(f, y, n) for (f, y), n in seen.items()], columns=["feature", "y", "n"])

    by = rows.select("text", "y").mapInPandas(run, "feature binary, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("b"))
    ones, zeros = n_of.get(1, 0), sum(v for k, v in n_of.items() if k != 1)
    total, df = ones + zeros, F.col("a") + F.col("b")
    chi = total * F.pow(F.col("a") * zeros - F.col("b") * ones, 2.0) / (F.lit(float(ones) * zeros) * df * F.greatest(total - df, F.lit(1)))
    lift = (F.col("a") + 0.5) / (ones + 1) / ((F.col("b") + 0.5) / (zeros + 1))
    telling = F.lit(1.0) if chi_of_half is None else 1 + F.pow(F.log(lift), 2.0) * F.col("chi") / (F.col("chi") + chi_of_half)
    return by.withColumn("chi", chi).select("feature", df.alias("df"), telling.alias("telling")).orderBy(F.desc("df"), "feature").toArrow()


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_ROWS, chi: float | None = CHI) -> Index:
    """An index of examples of docs (doc_id, text) with labels (doc_id, toxic). chi: the chi-square at which half the label factor counts; None: plain TF-IDF."""
    rows, counts = examples(docs, labels, n)
    n_of = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    found = _weighed_features(rows, n_of, chi) if len(n_of) > 1 else pa.table({"feature": [], "df": [], "telling": []})
    joined = b" ".join(found["feature"].to_pylist())
    features = _numbered(joined)
    df = np.asarray(found["df"], np.float64)
    idf = (np.log((1 + sum(n_of.values())) / (1 + df)) + 1) * np.asarray(found["telling"], np.float64)
    sent = docs.sparkSession.sparkContext.broadcast(joined)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(_numbered(sent.value))
        for frame in frames:
            own = [x for at in range(0, len(frame), STEP) for x in terms.counts([words_of(t) for t in frame["text"].iloc[at : at + STEP]])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "f": [f.tobytes() for f, _ in own], "n": [n.astype(np.int32).tobytes() for _, n in own]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInPandas(run, f"doc_id {kind}, y int, f binary, n binary").where(F.length("f") > 0).toArrow().to_pandas() if features else pd.DataFrame({"doc_id": [], "y": [], "f": [], "n": []})
    sent.unpersist()
    made["f"], made["n"] = ([np.frombuffer(x, np.int32) for x in made[c]] for c in ("f", "n"))
    # Alike examples lie in the same blocks: in order of label, most telling feature and id.
    made["lead"] = [int(f[idf[f].argmax()]) for f in made["f"]]
    made = made.sort_values(["y", "lead", "doc_id"]).reset_index(drop=True)
    blocks, common = max(1, -(-len(made) // BLOCK)), int((df >= COMMON * sum(n_of.values())).sum())
    index = Index(features, idf, made["doc_id"].to_numpy(), (made["y"].to_numpy() == 1).astype(np.int8), np.ones(len(made)), np.zeros((blocks, common, BLOCK), np.float32), np.zeros((common, blocks), np.float32), share)
    weighed = [index.weigh(f, n) for f, n in zip(made["f"], made["n"], strict=True)]
    for i, (f, w) in enumerate(weighed):
        index.postings[i // BLOCK][f[f < common], i % BLOCK] = w[f < common]
    index.bounds = index.postings.max(axis=2).T.copy()
    if weighed:
        of, weight = (np.concatenate(x) for x in zip(*weighed, strict=True))
        example = np.repeat(np.arange(len(weighed), dtype=np.int32), [len(f) for f, _ in weighed])
        order = np.argsort(of, kind="stable")
        order = order[np.searchsorted(of[order], common) :]
        index.rare = np.searchsorted(of[order], np.arange(common, len(features) + 1)), example[order], weight[order]
    del made, found
    ones, zeros = n_of.get(1, 0), sum(v for k, v in n_of.items() if k != 1)
    if ones and zeros:  # a sample's votes count as all labelled rows would
        index.votes = np.where(index.labels == 1, share / ones, (1 - share) / zeros) * (ones + zeros)
        near = (row for at in range(0, len(weighed), STEP) for row in index.cosines(weighed[at : at + STEP]))
        votes = np.array([index.vote(*index.best(row, skip=i)) for i, row in enumerate(near)])
        silent = index.vote(np.zeros(0, np.int64), np.zeros(0, np.float32))
        rest = [ones - int(index.labels.sum()), zeros - int((1 - index.labels).sum())]
        index.calibration = _calibrated(np.r_[votes, silent, silent], np.r_[index.labels, 1, 0], np.r_[index.votes, rest[0] * share / ones * (ones + zeros), rest[1] * (1 - share) / zeros * (ones + zeros)])
    return index


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, drawn lightly to the identity."""
    theta, pull = np.array([1.0, 0.0]), 1.0
    design = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + pull * (theta - [1, 0])
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + pull * np.eye(2), slope)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.05), float(theta[1])


def score(docs: DataFrame, index: Index, step: int = STEP) -> DataFrame:
    """doc_id, score, evidence (the three nearest examples: doc_id, toxic, cosine) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_gc():
            own = sent.value
            silent = own.score(own.vote(np.zeros(0, np.int64), np.zeros(0, np.float32))), []
            terms = own.__dict__.setdefault("terms", Terms(own.features))  # a worker's tasks share the broadcast index, and so the words seen before
            known: dict[bytes, tuple[float, list[dict]]] = {}
            for frame in frames:
                for at in range(0, len(frame), step):
                    part = frame.iloc[at : at + step]
                    texts = [words_of(t) for t in part["text"].fillna("")]
                    keys = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() for t in texts]
                    known = known if len(known) < 20_000 else {k: known[k] for k in set(keys) & known.keys()}
                    new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
                    queries = {}
                    for k, (f, n) in zip(new, terms.counts(list(new.values())), strict=True):
                        if len(f):
                            queries[k] = own.weigh(f, n)
                        else:
                            known[k] = silent
                    for k, row in zip(queries, own.cosines(list(queries.values())) if queries else [], strict=True):
                        best, cosine = own.best(row)
                        known[k] = own.score(own.vote(best, cosine)), [{"doc_id": own.ids[i], "toxic": int(own.labels[i]), "cosine": float(c)} for i, c in zip(best[:3], cosine[:3], strict=True)]
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": [known[k][0] for k in keys], "evidence": [known[k][1] for k in keys]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return typed(by_text(docs, "text").mapInPandas(run, f"doc_id string, score double, evidence array<struct<doc_id: {kind}, toxic: int, cosine: double>>"), docs)
