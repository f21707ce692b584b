"""Language of texts by prediction by partial matching (PPM).

For each language there is a context tree over the bytes of words: counts of each byte after up to
ORDER bytes, reaching back to the word's start at most. A byte that a context has not seen costs an
escape (method C: distinct / (total + distinct)) and is coded one order lower, at last as one of 256.
The trees are frozen, so a word's exact code length under every language is a fixed vector: each
distinct word is coded once by binary searches for all languages together, and a text's length is the sum
over its words. What lies between words (spaces, marks, ASCII capitals) is no part of the code: the length is that of the
text's words, each with its end. The shortest code names the language; ties go to the first by name.

Training texts are a bounded sample: SAMPLE_DOCS documents and SAMPLE_CHARS characters a language
(chosen by a hash of doc_id), which bounds the model that is broadcast. Predictions cover every row and
whole texts. A null text or one without a letter is ``und`` with score 0, as is every text when nothing
can be learned; null languages are not learned; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, no_gc, typed
from .licences import words_of

ORDER, SAMPLE_DOCS, SAMPLE_CHARS, KEPT_WORDS = 4, 1000, 4_000_000, 800_000


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of " w1 w2 .. ", and how many bytes before each one belong to its word (its start mark included)."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    place = np.arange(len(flat))
    marks = np.maximum.accumulate(np.where(flat == 32, place, 0))
    return flat, place - np.r_[0, marks[:-1]]


def _keys(flat: np.ndarray, order: int) -> np.ndarray:
    """For each byte: it and the order bytes before it, in one number."""
    key = np.zeros(len(flat), np.int64)
    for back in range(order, -1, -1):
        key = (key << 8) | np.r_[np.zeros(min(back, len(flat)), np.int64), flat[: max(0, len(flat) - back)]]
    return key


def count(words: list[bytes], order: int) -> pd.DataFrame:
    """depth, key, n: how often each byte follows each context."""
    flat, room = _symbols(words)
    made = []
    for depth in range(order + 1):
        keys, n = np.unique(_keys(flat, depth)[(room >= depth) & (np.arange(len(flat)) > 0)], return_counts=True)
        made.append(pd.DataFrame({"depth": np.int32(depth), "key": keys, "n": n}))
    return pd.concat(made)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """langs; for each depth: keys and their code lengths in bits, contexts and their escapes, a column a language."""

    langs: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """The code length of each word (a word, then its end) under each language."""
        flat, room = _symbols(words)
        flat_bits = np.zeros((len(flat), len(self.langs)), np.float32)
        left = np.arange(1, len(flat))
        for depth in range(len(self.keys) - 1, -1, -1):
            fits = room[left] >= depth
            own = left[fits]
            key = _keys(flat, depth)[own]
            at, found = _find(self.keys[depth], key)
            flat_bits[own[found]] += self.bits[depth][at[found]]
            missed = own[~found]
            at, known = _find(self.contexts[depth], key[~found] >> 8)
            flat_bits[missed[known]] += self.escapes[depth][at[known]]
            left = np.r_[left[~fits], missed]
        flat_bits[left] += 8
        firsts = np.flatnonzero(flat == 32)[:-1] + 1
        return np.add.reduceat(flat_bits, firsts, axis=0) if len(words) else np.zeros((0, len(self.langs)), np.float32)


def build(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """A model from rows of lang, depth, key, n."""
    langs = sorted(counts["lang"].unique())
    model = Model(langs, [], [], [], [])
    for depth in range(order + 1):
        rows = counts[counts["depth"] == depth]
        keys = np.unique(rows["key"].to_numpy(np.int64))
        contexts = np.unique(keys >> 8)
        bits = np.zeros((len(keys), len(langs)), np.float32)
        escapes = np.zeros((len(contexts), len(langs)), np.float32)
        of = np.searchsorted(contexts, keys >> 8)
        if depth:
            lower = model.bits[-1][np.searchsorted(model.keys[-1], keys & ((1 << (8 * depth)) - 1))]
        else:
            lower = np.full((len(keys), len(langs)), 8, np.float32)
        for k, lang in enumerate(langs):
            own = rows[rows["lang"] == lang]
            n = np.zeros(len(keys))
            n[np.searchsorted(keys, own["key"].to_numpy(np.int64))] = own["n"]
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, n > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes[:, k] = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
                bits[:, k] = np.where(n > 0, np.log2((total + distinct)[of] / n), lower[:, k] + escapes[of, k])
        for have, new in zip((model.keys, model.bits, model.contexts, model.escapes), (keys, bits, contexts, escapes), strict=True):
            have.append(new)
    return model


def sample(docs: DataFrame, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, text of at most n documents a language in the order of a hash of doc_id, up to the one with which they reach chars characters."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().collect()  # one row a language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * n / r["count"]))).otherwise(share)
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    near = known.select("lang", "text", drawn, "doc_id").where(F.col("u") < share)
    by = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)  # a bounded number of rows a language
    before = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")
    return ranked.withColumn("before", before).where(F.col("before") < chars).select("lang", "text")


def fit(docs: DataFrame, order: int = ORDER, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of the languages of docs (doc_id, lang, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                words = [w for t in part["text"] for w in words_of(t)]
                yield count(words, order).assign(lang=lang)[["lang", "depth", "key", "n"]]

    counted = sample(docs, n, chars).mapInPandas(run, "lang string, depth int, key long, n long")
    return build(counted.groupBy("lang", "depth", "key").agg(F.sum("n").alias("n")).toPandas(), order)


class Predictor:
    """Predictions of a frozen model, with the code lengths of words seen before (at most about KEPT_WORDS)."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.table: dict[bytes, int] = {}
        self.bits = np.zeros((0, len(model.langs)), np.float32)

    def of(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and code length of each text."""
        cut = [words_of(t) for t in texts]
        if len(self.table) > KEPT_WORDS:
            self.table, self.bits = {}, self.bits[:0]
        fresh = list(set().union(*cut).difference(self.table))
        if fresh:
            self.table.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
            self.bits = np.concatenate([self.bits, self.model.lengths(fresh)])
        return [self._one(t, w) for t, w in zip(texts, cut, strict=True)]

    def _one(self, text: str, words: list[bytes]) -> tuple[str, float, float]:
        if not self.model.langs or not words or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        total = self.bits[[self.table[w] for w in words]].sum(0, dtype=np.float64)
        best = int(total.argmin())
        return self.model.langs[best], float(1 / np.exp2((total[best] - total) / len(words) ** 0.5).sum()), float(total[best])


def predict(docs: DataFrame, model: Model, step: int = 1024) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and bits (code length under the prediction) of each text.

    score: the prediction's share of 2 ** -(length / sqrt(words)) over all languages. A text's words are not
    independent, so their bits are not all taken as evidence: undivided lengths would give nearly every text 0 or 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_gc():
            own = Predictor(sent.value)
            for frame in frames:
                for at in range(0, len(frame), step):
                    part = frame.iloc[at : at + step]
                    made = pd.DataFrame(own.of(part["text"].fillna("").tolist()), columns=["lang_pred", "score", "bits"])
                    made.insert(0, "doc_id", part["doc_id"].to_numpy())
                    yield made

    return typed(by_text(docs, "text").mapInPandas(run, "doc_id string, lang_pred string, score double, bits double"), docs)


def keep(docs: DataFrame, model: Model, least: float = 0.5, step: int = 1024) -> DataFrame:
    """The rows of docs whose language is told with a score of least or more. Only texts go to Python, and verdicts come back: columns of any name and type stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with no_gc():
            own = Predictor(sent.value)
            for batch in texts:
                said = batch.fillna("").tolist()
                told = [x for at in range(0, len(said), step) for x in own.of(said[at : at + step])]
                yield pd.Series([lang != "und" and score >= least for lang, score, _ in told], dtype=bool)

    return docs.where(F.pandas_udf(run, "boolean")("text"))
