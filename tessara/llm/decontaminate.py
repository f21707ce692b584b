"""Benchmark passages in documents, found with a positional inverted index.

The index holds postings (term, doc_id, position) of the documents' words. A window is ``size``
consecutive words of a benchmark item (a shorter item is one window). For each window the two rarest
of its terms are looked up: their posting lists, moved by the terms' places in the window, are
intersected on (doc_id, start), and what is left is compared word by word with the document. Only
terms that are rarest or second rarest in some window get postings, so the index is a small share of
the text and common words never meet in a join; their counts come from one aggregation over all
documents. Window tables are as large as the benchmark; they are broadcast only after their rows
are counted, and joined by a shuffle beyond that.

Null texts have no words and hit nothing, items without words have no windows, repeated documents
and items give the result of each, empty tables give empty or unhit results, and further columns are
ignored. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, let, named, plain_words, stored

SIZE, SLACK = 10, 3


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """phrase (words joined by a space), length, items (its item_ids as sorted strings): one row for each distinct window."""

    def cut(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        return F.transform(places, lambda i: F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.size(w), F.lit(size)) - 1), lambda k: F.get(w, i + k)), " "))

    words = items.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    phrases = words.select("item", F.explode(let(F.col("w"), cut)).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("length", F.size(F.split("phrase", " ")))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, position, term: where the documents have one of the terms (a table with a column term)."""
    words = docs.select("doc_id", F.posexplode(plain_words(F.col("text"))).alias("position", "term"))
    return words.join(fits(terms.select("term").distinct()), "term", "left_semi").select("term", "doc_id", "position")


def anchors(docs: DataFrame, windows: DataFrame, n: int = 2) -> DataFrame:
    """phrase, items, length, nth, term, place: the n rarest terms of each window, by their counts over docs.

    A window with a term that no document has is left out. A window of one distinct term has it as
    first and second.
    """
    placed = windows.select("phrase", "items", "length", F.posexplode(F.split("phrase", " ")).alias("place", "term"))
    first = placed.groupBy("phrase", "term").agg(F.min("place").alias("place"), F.first("items").alias("items"), F.first("length").alias("length"))
    counts = occurrences(docs, placed).groupBy("term").agg(F.count("*").alias("n"))
    known = stored(first.join(counts, "term", "left"), "anchor-terms")
    each = Window.partitionBy("phrase")
    ranked = known.withColumn("rarest", F.min(F.coalesce("n", F.lit(0))).over(each)).withColumn("terms", F.count("*").over(each)).withColumn("nth", F.row_number().over(each.orderBy("n", "term")))
    ranked = ranked.where((F.col("rarest") > 0) & (F.col("nth") <= n))
    alone = ranked.where((F.col("terms") == 1) & (F.col("nth") == 1)).withColumn("nth", F.lit(2))
    return ranked.unionByName(alone).select("phrase", "items", "length", "nth", "term", "place")


def candidates(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id and found, array of (start, length, phrase, items): places where both rare terms of a window stand as in it."""
    lead, second = (rare.where(F.col("nth") == k) for k in (1, 2))
    starts = postings.join(fits(lead), "term").select("doc_id", (F.col("position") - F.col("place")).alias("start"), "phrase", "length", "items")
    others = postings.join(fits(second.select("phrase", "term", "place")), "term").select("doc_id", (F.col("position") - F.col("place")).alias("start"), "phrase")
    both = starts.where("start >= 0").distinct().join(others.distinct(), on=[starts.start == others.start, starts.phrase == others.phrase, starts.doc_id.eqNullSafe(others.doc_id)], how="left_semi")
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "phrase", "items")).alias("found"))


def _verified(words: Column, found: Column) -> Column:
    said = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), c["length"] - 1), lambda k: F.get(words, c["start"] + k)), " ")
    return F.array_sort(F.filter(found, lambda c: said(c) == c["phrase"]))


def _covered(matches: Column) -> Column:
    """Words that lie in any match; matches are in order of their starts."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, m: Column) -> Column:
        end = m["start"] + m["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(m["start"], a["end"]), F.lit(0))).cast("long").alias("n"))

    return F.aggregate(matches, start, add, lambda a: a["n"])


def row_key() -> Column:
    """A number for a row's id and text, by which postings go: rows without an id, or of one id, don't share their candidates. Rows that happen to
    share a number do, and are checked word by word as all are."""
    return F.xxhash64("doc_id", "text")


def _kept(keep: tuple[str, ...], results: tuple[str, ...]) -> tuple[Column, list[Column]]:
    """The kept columns as one column _kept, and out of it: one with a result's name is led by "kept_"."""
    held = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(named(*keep)))) if keep else F.lit(None)
    taken = {"doc_id", *results}
    return held.alias("_kept"), [F.col("_kept").getField(f"c{i}").alias(f"kept_{c}" if c in taken else c) for i, c in enumerate(keep)]


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """For every document: doc_id, the columns of keep, n_words, matches (array of start, length, phrase, items), n_hit and item_ids (sorted strings).

    Columns of keep that are named like one of these get "kept_" before their names.
    """
    windows = stored(item_windows(items, size), "windows")
    keyed = docs.select(row_key().alias("doc_id"), "text")
    rare = stored(anchors(keyed, windows), "anchors")
    postings = stored(occurrences(keyed, rare), "postings")
    found = stored(candidates(postings, rare), "candidates")
    held, kept = _kept(keep, ("n_words", "matches", "n_hit", "item_ids"))
    own = docs.select("doc_id", held, row_key().alias("_row"), plain_words(F.col("text")).alias("words"))
    none = F.array().cast(found.schema["found"].dataType)
    joined = own.join(fits(found.withColumnRenamed("doc_id", "found_id"), 50_000), F.col("_row") == F.col("found_id"), "left")
    checked = let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _verified(w, F.coalesce("found", none)).alias("matches")))
    rows = joined.select("doc_id", "_kept", checked.alias("c")).select("doc_id", "_kept", "c.*")
    items_of = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return rows.select("doc_id", *kept, "n_words", "matches", _covered(F.col("matches")).alias("n_hit"), items_of.alias("item_ids"))


def neighbours(postings: DataFrame, rare: DataFrame, slack: int) -> DataFrame:
    """doc_id and found, array of (start, length, phrase, items): places of a window's rarest term with its second rarest at most 2 * slack words off its distance.

    Places are cut into cells of that width; the second terms' lie in their own and both next ones, so cells meet by equality.
    """
    width = 2 * slack + 1
    place = F.col("position") - F.col("place")
    lead = postings.join(fits(rare.where("nth = 1")), "term").select("doc_id", place.alias("start"), "phrase", "length", "items").withColumn("cell", F.floor(F.col("start") / width))
    second = postings.join(fits(rare.where("nth = 2").select("phrase", "term", "place")), "term").select(F.col("doc_id").alias("other_id"), place.alias("other"), F.col("phrase").alias("other_phrase"))
    second = second.withColumn("other_cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("other") / width) + k)))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("phrase") == F.col("other_phrase")) & (F.col("cell") == F.col("other_cell"))
    both = lead.join(second, same & (F.abs(F.col("start") - F.col("other")) <= 2 * slack), "left_semi").distinct()
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "phrase", "items")).alias("found"))


def _near(words: Column, found: Column, slack: int) -> Column:
    """The places at most slack words from those found at which all words of the window stand near."""
    shifts = F.array(*[F.lit(d) for d in range(-slack, slack + 1)])

    def starts(c: Column) -> Column:
        stands = lambda terms, s: F.forall(F.sequence(F.lit(0), c["length"] - 1), lambda k: F.exists(shifts, lambda d: F.coalesce(F.get(words, s + k + d) == F.get(terms, k), F.lit(False))))
        tried = F.filter(F.transform(shifts, lambda d: c["start"] + d), lambda s: s >= 0)
        own = let(F.split(c["phrase"], " "), lambda terms: F.filter(tried, lambda s: stands(terms, s)))
        return F.transform(own, lambda s: F.struct(s.alias("start"), c["length"].alias("length"), c["phrase"].alias("phrase"), c["items"].alias("items")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, starts))))


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int = SLACK, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """For every document: doc_id, the columns of keep, near (array of start, length, phrase, items) and near_ids (item_ids as sorted strings).

    A window is near a start (from 0) if each of its words stands in the document at most slack words off its place from
    there, so words may be put in, swapped or, where they stand nearby anyway, left out. Exact passages are near as well.
    """
    windows = stored(item_windows(items, size), "windows")
    keyed = docs.select(row_key().alias("doc_id"), "text")
    rare = stored(anchors(keyed, windows), "anchors")
    postings = stored(occurrences(keyed, rare), "postings")
    found = stored(neighbours(postings, rare, slack), "neighbours")
    held, kept = _kept(keep, ("near", "near_ids"))
    own = docs.select("doc_id", held, row_key().alias("_row"), plain_words(F.col("text")).alias("words"))
    none = F.array().cast(found.schema["found"].dataType)
    joined = own.join(fits(found.withColumnRenamed("doc_id", "found_id"), 50_000), F.col("_row") == F.col("found_id"), "left")
    rows = joined.select("doc_id", "_kept", let(F.col("words"), lambda w: _near(w, F.coalesce("found", none), slack)).alias("near"))
    return rows.select("doc_id", *kept, "near", F.array_sort(F.array_distinct(F.flatten(F.transform("near", lambda m: m["items"])))).alias("near_ids"))
