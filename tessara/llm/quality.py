"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for
each rule that failed; a policy is a named mask over those bits, so changing a policy or measuring
what a rule is worth never reads a text again. Everything here is built-in column functions: a
document's words and windows are handled inside its own row and nothing is shuffled. Windows are told apart by a 64-bit hash of
64-bit hashes of their words: of n windows of one text, two different ones count as equal with a chance of n * n / 2 ** 64.

Null texts count as having no words (they fail ``few_words``), very long texts are measured whole, repeated rows give repeated rows, an
empty table gives an empty ledger, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, text_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: (rule, failing condition over the measurements); a rule's bit is its place in this list, and places never change.
RULES = [
    ("few_words", lambda m: m("n_words") < 20),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    ("symbols", lambda m: 4 * m("n_symbols") > m("n_words")),
    ("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}


def _repeated(hashes: Column) -> Column:
    """Words that lie in windows found twice or more. hashes: one for each window, in order."""

    def covered(h: Column) -> Column:
        # Sorted by hash and then by place, equal windows lie together.
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(placed, lambda s: let(twice(s), lengths))

    def twice(s: Column) -> Column:
        alike = lambda v, k: F.coalesce(F.get(s, k)["x"] == v["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda v, k: alike(v, k - 1) | alike(v, k + 1)), lambda v: v["i"]))

    def lengths(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _windows(words: Column) -> Column:
    """A 64-bit hash for each window of WINDOW words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    rolled = let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))))
    return F.slice(rolled, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _measured() -> Column:
    """All measurements of a row's text as one struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    count = lambda c: c.cast("long")

    def by_words(w: Column, x: Column) -> Column:
        repeated = F.when(F.size(w) >= WINDOW, _repeated(_windows(w))).otherwise(F.lit(0).cast("long"))
        return F.struct(
            count(F.size(w)).alias("n_words"),
            count(F.length(F.translate(text, SPACE_CHARS, ""))).alias("word_chars"),
            count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
            count(F.size(x)).alias("n_lines"),
            count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
        )

    return let(text_words(F.col("text")), lambda w: let(lines, lambda x: by_words(w, x)))


def _failed(m: Callable[[str], Column]) -> Column:
    """The bits of the rules that fail. m gives a measurement by name."""
    bits = [F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return failed.cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that rules read."""
    return docs.select("doc_id", _measured().alias("m")).select("doc_id", "m.*")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and fail_bits: bit i is set where rule i fails."""
    return measure(docs).withColumn("fail_bits", _failed(F.col))


def kept(policy: str = "v1") -> Column:
    """Whether no rule of the policy fails for a row's text, as a column of that row."""
    return let(_measured(), lambda m: _failed(lambda name: m[name]).bitwiseAND(F.lit(POLICIES[policy])) == 0)


def verdict(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return ledger_rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that are kept without it.

    Documents are first counted by bit pattern (at most 2 ** len(RULES) of them), so the texts and the
    ledger's rows are read once for all rules.
    """
    mask = POLICIES[policy]
    patterns = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask))
    by = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return by.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum("n").alias("n_documents"),
    )
