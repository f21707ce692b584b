"""Groups of spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

A word's rotations are those of the word and a terminator: "cat$" gives "cat$", "at$c", "t$ca", "$cat". The rotation that ends in
the edited character is the word with that character last, so every word that differs in it alone
shares the rest of the rotation as a prefix, and the word that lacks it is that prefix as a whole rotation. All rotations are
therefore sorted by their prefix without the last character and, as whole ones, beside them; a group is a scan of
equal prefixes. A group holds at most one word a character of the alphabet and one without it, so it is bounded by the
alphabet (91 here), however common a word is.

A group's members get how many near words they have in it, and the best one, from the group's first two by frequency: pairs are
never written. Replacements meet in one group only. A deletion within a run of equal characters ("aab", "ab") meets in a group
for each of them and counts at the run's first. Counts and best words of all groups add up to each word's.

Forms lead to words at least RATIO times as common, so chains of forms are shorter than the digits of the largest count
and have no cycles; they are followed by joining them with the forms until none goes on.

A null text has no words. Repeated rows count as often as they occur; equal counts go by code-point order; a null id counts as an empty
one where ids matter; very long texts are taken whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Shortest word, fewest occurrences, and how many times as common a word's form is.
LENGTH, LEAST, RATIO = 7, 2, 10
END = "$"


def runs(text: Column, least: int = LENGTH) -> Column:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ of at least so many letters, with A-Z in lower case, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"([a-z\\u00C0-\\u00FF]{{{least},}})"), 1)


def dropped(run: Column, doc_id: Column, every: int = 31) -> Column:
    """run without one code point where the CRC-32 of "<doc_id>:<run>" is divisible by every."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (crc % F.char_length(run)).cast("int")
    return F.when(crc % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(occurrences: DataFrame, least: int = LEAST, length: int = LENGTH) -> DataFrame:
    """word, n of the words with at least so many code points and occurrences (rows)."""
    return occurrences.where(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(counted: DataFrame) -> DataFrame:
    """prefix, last, first_of_run, word, n: each rotation without its last character, and (last null) each as a whole."""
    size = F.char_length("word")
    at = F.explode(F.sequence(F.lit(0), size)).alias("at")
    turned = counted.select("word", "n", at).withColumn("turned", F.concat(F.expr("substring(word, at + 1)"), F.lit(END), F.expr("substring(word, 1, at)")))
    last, before = F.expr("substring(word, at, 1)"), F.expr("CASE WHEN at > 1 THEN substring(word, at - 1, 1) END")
    whole = F.struct(F.col("turned").alias("prefix"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("first_of_run"))
    cut = F.struct(F.expr("left(turned, char_length(turned) - 1)").alias("prefix"), last.alias("last"), (before.isNull() | (before != last)).alias("first_of_run"))
    both = F.when(F.col("at") == 0, F.array(whole)).otherwise(F.array(whole, cut))  # nothing but the terminator ends the rotation at 0
    return turned.select("word", "n", F.inline(both))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best_n, best of the members of each group of equal prefixes; rows come sorted by prefix."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        # The last group may go on in the next batch.
        prefix = rows.column("prefix").combine_chunks()
        new = np.r_[True, pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)]
        starts = np.flatnonzero(new)
        rest = rows.slice(int(starts[-1]))
        yield _near(rows.slice(0, int(starts[-1])), starts)
    if rest is not None:
        yield _near(rest, np.array([0, rest.num_rows]))


def _near(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """What the members of whole groups get. starts: where groups begin, and the end."""
    sizes = np.diff(starts)
    places = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    out: list[tuple[str, int, int, str]] = []
    kept = rows.take(pa.array(places)).select(["word", "n", "last", "first_of_run"]).to_pydict()
    at = 0
    for size in sizes[sizes > 1].tolist():
        group = sorted(zip((-n for n in kept["n"][at : at + size]), kept["word"][at : at + size], kept["last"][at : at + size], kept["first_of_run"][at : at + size], strict=True))
        at += size
        replaced = [g for g in group if g[2] is not None]
        longer = [g for g in replaced if g[3]]
        for less, word, last, first in group:
            if last is None:  # this word is the prefix: near those that have one character more
                near, best = len(longer), longer[0] if longer else None
            else:
                lacks = len(group) - len(replaced) if first else 0
                near = len(replaced) - 1 + lacks
                best = next((g for g in group if g[1] != word and (g[2] is not None or first)), None)
            if near:
                out.append((word, near, -best[0], best[1]))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(counted: DataFrame) -> DataFrame:
    """word, n_near, best_n, best (the most frequent near word, the smallest of equals) of the words (word, n) that have near words."""
    found = rotations(counted).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead to in the end."""
    now = forms.select("word", F.col("form").alias("root"))
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while now.join(step, "root", "left_semi").limit(1).count():
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def groups(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words (word, n).

    form: the near word of largest n, the smallest of equals, if it occurs at least ratio times as often; root: the last
    word that forms lead to, the word itself without one.
    """
    counted = stored(counted, "words")
    near = stored(near_words(counted), "near")
    common = F.col("best_n") >= ratio * F.col("n")
    judged = counted.join(near, "word", "left").select("word", F.when(common, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best_n")).alias("form_n"))
    judged = stored(judged, "forms")
    last = roots(judged.where(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
