"""Token ids of whole texts, written as rANS files in document order and read back.

Documents are range-partitioned by doc_id and sorted; each partition becomes one file. A task encodes
each distinct piece between single spaces once (a worker keeps a bounded table of them), with the tokenizer library, for the tokenizer splits a
text there anyhow; pieces of white space or beside it stay together with their neighbours. File names
carry the partition's number, so a task that runs again replaces its file. Offsets over all files come
from sums of their counts. Reading takes one row for each file's run of blocks.

Null texts count as empty; each document ends with ``end``. Documents without an id come first, as
Spark sorts them; equal ids are ordered by their texts. Empty tables give no files and no rows, further columns are ignored,
and a file of more than 2 ** 20 different ids, more than its frequency table can tell apart, raises. Document ids are whole numbers: the files hold them
as such, and an id that is none raises. Very long texts are whole in one record; rows of one id and one text tie and follow each other.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, rans
from .common import no_gc, shared_dir, stored

#: Pieces that a worker keeps encoded, and characters of text that it takes in one step.
KEPT_PIECES, STEP_CHARS, JOINED_CHARS = 900_000, 4_000_000, 200_000
MARKS = ".,!?;:"


class Pieces:
    """Encoder of texts by distinct pieces, for tokenizers whose splits never cross a single space after a word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # In a byte-level vocabulary each character stands for one byte; added tokens are plain text.
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.bytes_of[i] = len(added.get(t) is not None and t.encode() or t)
        self.marks = dict(zip(MARKS, self._ids(list(MARKS)), strict=True))
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.loose: set[str] = set()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        """Encodes pieces, each led by a space: many as one text, cut where the bytes of its ids reach a piece's end."""
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        starts = np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED_CHARS, prepend=-1)).tolist()
        for first, last in itertools.pairwise([*starts, len(fresh)]):
            part = fresh[first:last]
            text = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            places = (4 * (np.searchsorted(ends, cuts) + 1)).tolist()
            self.known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *places[:-1]], places)), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.loose) > KEPT_PIECES // 10:
            self.loose = set()
        cut = [t.split(" ") for t in texts]
        fresh = set().union(*cut).difference(self.known)
        fresh -= self.loose
        self.loose |= {p for p in fresh if not p or p.strip() != p}  # is_loose() of many
        fresh -= self.loose
        alone: list[str] = []
        late: set[str] = set()
        for k, c in enumerate(cut):
            if is_loose(c[0]) or self.loose and not self.loose.isdisjoint(c):
                cut[k] = c = joined(c)
                late.update(c[1:])
        if late:
            late.difference_update(self.known)
            alone = [p for p in late if is_loose(p)]
            fresh.update(late.difference(alone))
        # A mark after letters is always a token's start: such a piece is its word's ids and the mark's.
        marked = [p for p in fresh if p[-1] in MARKS and p[:-1].isalpha()]
        fresh.difference_update(marked)
        fresh.update({p[:-1] for p in marked}.difference(self.known))
        self.learn(list(fresh))
        for p in marked:
            self.known[p] = self.known[p[:-1]] + self.marks[p[-1]]
        for p, ids in zip(alone, self._ids([" " + p for p in alone]), strict=True):
            self.known[p] = ids
        heads = list({c[0] for c in cut}.difference(self.first))
        self.first.update(zip(heads, self._ids(heads), strict=True))
        out = [self.first[c[0]] + b"".join(map(self.known.__getitem__, c[1:])) for c in cut]
        for p in alone:  # texts' ends and the like: not worth keeping
            del self.known[p]
        if len(self.known) > KEPT_PIECES:  # a full table keeps what it has: the early pieces are the frequent ones
            for p in fresh.union(marked):
                del self.known[p]
        if len(self.first) > KEPT_PIECES // 10:
            self.first = {}
        return out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """One encoder for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pieces(path)


def is_loose(piece: str) -> bool:
    """A piece beside white space: its splits depend on its neighbours."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def joined(pieces: list[str]) -> list[str]:
    """The pieces, joined again over spaces that have white space beside them."""
    out = [pieces[0]]
    for p in pieces[1:]:
        last = out[-1]
        if not last or not p or last[-1].isspace() or p[0].isspace():
            out[-1] = f"{last} {p}"
        else:
            out.append(p)
    return out


def write(docs: DataFrame, path: str, end: int, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes files of coded ids and returns the manifest: part, uri, n_docs, n_ids, n_blocks, start (ids of all files before it)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "ids")
    numeric = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("valid"), "text"  # whole numbers beside nulls would go through Python as floats
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), numeric.rdd.getNumPartitions())
    dealt = numeric.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").select(*plain)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_gc():
            coder, tail = pieces(path), np.array([end], np.uint32).tobytes()
            doc_ids, valid, lengths, ids = [], [], [], []
            for frame in frames:
                size = frame["text"].str.len().cumsum() // STEP_CHARS
                for _, part in frame.groupby(size, sort=False):
                    valid.append(part["valid"].to_numpy())
                    doc_ids.append(part["doc_id"].to_numpy())
                    coded = coder.batch(part["text"].tolist())
                    lengths.append(np.fromiter((len(x) // 4 + 1 for x in coded), np.int64, len(coded)))
                    ids.append(np.frombuffer(tail.join(coded) + tail, np.uint32))
            if not doc_ids:
                return
            k = TaskContext.get().partitionId()
            uri, all_ids = f"{folder}/ids-{k:06d}.rans", np.concatenate(ids)
            files.put(uri, rans.pack(np.concatenate(doc_ids), np.concatenate(valid), np.concatenate(lengths), all_ids))
            yield pd.DataFrame({"part": [k], "uri": uri, "n_docs": [sum(map(len, doc_ids))], "n_ids": [len(all_ids)], "n_blocks": [-(-len(all_ids) // rans.BLOCK)]})

    made = stored(dealt.mapInPandas(run, "part int, uri string, n_docs long, n_ids long, n_blocks int"), "manifest")
    # Sums in two levels: over spans of files, then over the files of a span.
    spanned = made.withColumn("span", F.floor(F.col("part") / 1000).cast("int"))
    spans = spanned.groupBy("span").agg(F.sum("n_ids").alias("n")).select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("span").orderBy("part")) - F.col("n_ids")
    return spanned.withColumn("own", own).join(spans, "span").select("part", "uri", "n_docs", "n_ids", "n_blocks", (F.col("own") + F.col("before")).alias("start"))


def read(manifest: DataFrame, crc: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit) of every document, from the files. crc: ids_crc32 instead of ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, start in zip(frame["uri"], frame["start"], strict=True):
                for part in _documents(uri, int(start)):
                    yield part.assign(ids_crc32=[zlib.crc32(x) for x in part["ids"]]).drop(columns="ids") if crc else part

    n = max(1, min(manifest.count(), 100_000))
    last = "ids_crc32 long" if crc else "ids binary"
    return manifest.select("uri", "start").repartition(n, "uri").mapInPandas(run, f"doc_id long, start long, n_tokens long, {last}")


def _documents(uri: str, start: int) -> Iterator[pd.DataFrame]:
    """A file's documents, a few blocks at a time."""
    file = rans.Reader(lambda at, size: files.get(uri, at, size))
    ends = np.cumsum(file.lengths)
    firsts = ends - file.lengths
    held, at, doc = b"", 0, 0
    for k in range(len(file.directory)):
        held += file.block(k).tobytes()
        have = at + len(held) // 4
        to = bisect.bisect_right(ends, have)
        if to > doc:
            spans = [(4 * (int(firsts[i]) - at), 4 * (int(ends[i]) - at)) for i in range(doc, to)]
            ids = pd.Series(file.doc_ids[doc:to]).astype("Int64").where(file.valid[doc:to])
            yield pd.DataFrame({"doc_id": ids, "start": firsts[doc:to] + start, "n_tokens": file.lengths[doc:to], "ids": [held[a:b] for a, b in spans]})
            held, at, doc = held[spans[-1][1] :], int(ends[to - 1]), to
