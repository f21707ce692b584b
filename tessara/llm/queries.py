"""Queries over the tables of a corpus folder, one for each operator, and SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, decontaminate, jaccard, langid, licences, lm, negatives, quality, spelling, tokens, toxicity, warc
from .common import remainder, shared_dir, stored, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("text_key", "group")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.scored(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return rows.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which all words of a benchmark window stand near their places."""
    rows = decontaminate.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("near_ids", ",").cast("binary"), 256)
    starts = F.array_distinct(F.transform("near", lambda m: m["start"]))
    return rows.select("doc_id", F.size("near_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), F.size(starts).cast("long").alias("n_starts"), F.array_min(starts).cast("long").alias("first_start"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score", F.size("spans").cast("long").alias("n_spans"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=0)
    return tokens.read(manifest, crc=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdict(stored(quality.ledger(table(spark, sf_dir, "documents")), "ledger"), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "fail_bits")


def op6_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 is worth, from the stored ledger's bit patterns."""
    return quality.ablations(stored(quality.ledger(table(spark, sf_dir, "documents")), "ledger"), "v1")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    rows = toxicity.score(docs, index)
    nearest = F.transform("evidence", lambda x: x["doc_id"]).alias("nearest")
    return rows.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), nearest)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(4) != 2))
    rows = langid.predict(docs, model)
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "bits")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = warc.read(warc.lookup(warc.build_index(warc.write(pages)), pages))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), shared_dir(spark, "token-counts"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    occurrences = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run")).select(spelling.dropped(F.col("run"), F.col("doc_id")).alias("word"))
    return spelling.groups(spelling.words(occurrences))


OP3_SQL = r"""
WITH words_of AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[i:i + 9] AS win, len(w[i:i + 9]) AS n FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM words_of, sizes),
hits AS (SELECT s.doc_id, s.i, s.n, v.item_id FROM starts s JOIN windows v ON s.n = v.n AND s.w[s.i:s.i + s.n - 1] = v.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.said, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words_of d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""

OP3_PROXIMITY_SQL = r"""
WITH words_of AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
owned AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM item_starts),
windows AS (SELECT DISTINCT win FROM owned),
placed AS (SELECT win, unnest(win) AS term, unnest(range(len(win))) AS k FROM windows),
spots AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words_of),
counts AS (SELECT term, count(*) AS n FROM spots GROUP BY term),
leads AS (SELECT win, term, k FROM placed LEFT JOIN counts USING (term) QUALIFY row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), k) = 1),
tried AS (SELECT doc_id, win, unnest(range(pos - k - 3, pos - k + 4)) AS s FROM spots JOIN leads USING (term)),
near AS (SELECT t.doc_id, t.win, t.s FROM (SELECT DISTINCT * FROM tried WHERE s >= 0) t JOIN words_of d ON t.doc_id = d.doc_id
         WHERE len(list_filter(range(len(t.win)), lambda k: list_contains(d.w[greatest(t.s + k - 2, 1):t.s + k + 4], t.win[k + 1]))) = len(t.win)),
said AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM near JOIN owned USING (win)) GROUP BY doc_id),
starts AS (SELECT doc_id, count(DISTINCT s) AS n, min(s) AS first_start FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, CAST(coalesce(n, 0) AS BIGINT) AS n_starts, CAST(first_start AS BIGINT) AS first_start
FROM documents d LEFT JOIN said ON d.doc_id = said.doc_id LEFT JOIN starts ON d.doc_id = starts.doc_id
"""

OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i])), 0) AS BIGINT) AS score
      FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

#: CRC-32 goes byte by byte through a table made bit by bit; words that differ in one place share the rest of it.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT *, flatten(list_transform(range(1, length(said) + 1), lambda i: CASE WHEN ord(substr(said, i, 1)) < 128 THEN [ord(substr(said, i, 1))::BIGINT] ELSE [192 + (ord(substr(said, i, 1)) >> 6)::BIGINT, 128 + (ord(substr(said, i, 1)) & 63)::BIGINT] END)) AS b FROM own),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) AS h FROM coded, crc_table),
dropped AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM dropped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
indels AS (SELECT DISTINCT cuts.word AS a, words.word AS b FROM cuts JOIN words ON cut = words.word),
near AS (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word UNION SELECT a, b FROM indels UNION SELECT b, a FROM indels),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {'less': -n, 'word': b}) AS b, max(n) AS best_n FROM near JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN b END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
led AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, led.root FROM forms f JOIN led ON f.form = led.word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN led ON f.word = led.word
"""

#: Five hexadecimal digits of the digest are four digits of base 32.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""

_OP6_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w),
keyed AS (SELECT doc_id, i, words[i:i + 7] AS win FROM starts),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM keyed GROUP BY doc_id, win HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
      FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN 4 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
"""
OP6_SQL = _OP6_LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b"
OP6_ABLATIONS_SQL = (
    _OP6_LEDGER
    + """SELECT rule, bit, CAST(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN fail_bits = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only,
       CAST(sum(CASE WHEN fail_bits & ~bit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without, count(*) AS n_documents
FROM b CROSS JOIN (SELECT * FROM (VALUES ('few_words', CAST(1 AS BIGINT)), ('repeated_windows', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16), ('repeated_lines', 32)) AS r(rule, bit)) GROUP BY rule, bit"""
)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op3_proximity": OP3_PROXIMITY_SQL, "op10_warc": OP10_SQL, "op6_quality_rules": OP6_SQL, "op6_rule_ablations": OP6_ABLATIONS_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_groups": OP13_SQL}
