"""Byte-pair encoding and decoding with a word tokenizer's vocabulary file.

The file is the JSON of a public tokenizer: NFC, white space to one space, lower case, a split
pattern, then BPE over bytes with a word-end mark. A text is cut at white space into pieces, which the
split pattern never joins. Each task encodes the distinct pieces of a batch together: the symbols of
all their words lie in one flat array, and each round finds the lowest-rank pair of every word by a
binary search of its adjacent pairs in the sorted pair keys, then merges all places of that pair from
left to right. Encoded pieces are kept in a table of bounded size, so a task's memory does not grow
with its input. Nothing is shuffled; a lost task is simply run again.

A null text counts as empty and encodes to no ids; an empty text decodes to an empty one; repeated
rows give repeated rows; an empty table gives no rows; further columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_gc

#: Pieces that a worker keeps encoded from batch to batch; a batch of BATCH_CHARS characters comes on top.
KEPT_PIECES, BATCH_CHARS = 250_000, 2_000_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, texts: bool = True) -> None:
        """texts: whether decoded texts are kept with the ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        size = max(vocab.values()) + 1
        self.base = max(size, max(x["id"] for x in spec["added_tokens"]) + 1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, at = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, at.astype(np.int64), made[at]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(map(regex.escape, self.added)))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # The vocabulary's own strings are what a decoder without settings joins by spaces.
        self.text_of = {i: " " + t for t, i in vocab.items()} | {i: " " + t for t, i in self.added.items()}
        self.id_text = {i: f" {i}" for i in self.text_of}
        self.with_texts = texts
        self.forget()

    def forget(self) -> None:
        # A piece holds no space, so a key that starts with one is an added token.
        self.ids: dict[str, str] = {" " + t: f" {i}" for t, i in self.added.items()}
        self.texts: dict[str, str] = {" " + t: " " + t for t in self.added}

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Batched rounds. symbols: of all words, one after another; word: each symbol's word, ascending."""
        none = len(self.rank)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(found, self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(word)])
            live = lowest < none
            if not live.any():
                break
            if not live.all():  # finished words leave
                stays = np.repeat(live, sizes)
                done.append((symbols[~stays], word[~stays]))
                pair_stays = stays[:-1]
                rank, at = rank[pair_stays], at[pair_stays]
                symbols, word, sizes, lowest = symbols[stays], word[stays], sizes[live], lowest[live]
                if len(rank) == len(symbols):
                    rank, at = rank[:-1], at[:-1]
            hit = rank == np.repeat(lowest, sizes)[:-1]
            # In a run of touching hits every second one counts, from the left.
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run_start) % 2 == 0
            left = np.flatnonzero(hit)
            symbols[left] = self.made[at[left]]
            stay = np.ones(len(symbols), bool)
            stay[left + 1] = False
            symbols, word = symbols[stay], word[stay]
        done.append((symbols, word))
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def learn(self, pieces: set[str]) -> None:
        """Adds the pieces to the tables: their ids as text and their decoded text, each id led by a space."""
        words: set[str] = set()
        joint: list[tuple[str, list[str]]] = []
        for p in pieces:
            if p.isalpha():
                words.add(p)
            else:
                joint.append((p, self.words.findall(p)))
        for _, own in joint:
            words.update(own)
        self.learn_words([w for w in words if w not in self.ids])
        ids, texts = self.ids, self.texts
        for p, own in joint:
            if own != [p]:
                ids[p] = "".join([ids[w] for w in own])
                if self.with_texts:
                    texts[p] = "".join([texts[w] for w in own])

    def learn_words(self, words: list[str]) -> None:
        """Adds words (matches of the split pattern) to the tables."""
        if not words:
            return
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        ids, word = self.merge(symbols, np.repeat(np.arange(len(raw)), sizes))
        flat = ids.tolist()
        said = [self.id_text[i] for i in flat]
        at = 0
        for w, end in zip(words, np.cumsum(np.bincount(word, minlength=len(raw))).tolist(), strict=True):
            if end - at == 1:
                self.ids[w] = said[at]
            else:
                self.ids[w] = "".join(said[at:end])
            if self.with_texts:
                self.texts[w] = "".join([self.text_of[i] for i in flat[at:end]])
            at = end

    def parts(self, text: str) -> list[str]:
        """text's pieces in lower case; an added token stands alone, led by a space."""
        if "<|" in text and self.added_pattern.search(text):
            out: list[str] = []
            at = 0
            for m in self.added_pattern.finditer(text):
                out += [*pieces_of(text[at : m.start()]), " " + m[0]]
                at = m.end()
            return out + pieces_of(text[at:])
        return pieces_of(text)

    def batch(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them in the tables ids and texts until the next batch."""
        cut = [self.parts(t) for t in texts]
        fresh = set().union(*cut)
        if len(self.ids) > KEPT_PIECES:
            self.forget()
        self.learn(fresh.difference(self.ids))
        return cut

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.batch([text])[0] for i in self.ids[p].split()]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text_of[i] for i in ids)[1:]


def pieces_of(text: str) -> list[str]:
    """Lower-cased pieces between white space, as a vocabulary's \\s has it (four ASCII separators are not white space there)."""
    text = lowered(text)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in regex.split(r"[^\S\x1c-\x1f]+", text) if x]
    return text.split()


def lowered(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is not special)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


@lru_cache(1)
def coder(path: str, texts: bool) -> WordBpe:
    """One coder for all tasks of a worker."""
    return WordBpe(path, texts)


def _batches(batches: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same rows in batches of about so many characters, with their texts."""
    for batch in batches:
        at, size, texts = 0, 0, []
        for k, text in enumerate(batch.column("text")):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars or k == batch.num_rows - 1:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = k + 1, 0, []


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and each text's ids (array<int>)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            bpe = coder(path, False)
            for part, texts in _batches(batches):
                ids = [np.array("".join(map(bpe.ids.__getitem__, c)).split(), np.int32) for c in bpe.batch(texts)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, "ids"])

    return docs.select(*keep, F.col("text").alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            bpe = coder(path, True)
            for part, texts in _batches(batches):
                rows = []
                for pieces in bpe.batch(texts):
                    ids, text = "".join(map(bpe.ids.__getitem__, pieces)), "".join(map(bpe.texts.__getitem__, pieces))
                    rows.append((ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(text[1:].encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
