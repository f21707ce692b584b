import re

from tessara.llm import licences
from tessara.llm.licences import MIN_MATCH, TEMPLATES, Automaton, words_of


def longest(templates, words, i):
    """The longest template run that ends at word i, by trying all."""
    for size in range(i + 1, 0, -1):
        run = words[i - size + 1 : i + 1]
        if any(t[k : k + size] == run for t in templates for k in range(len(t) - size + 1)):
            return size
    return 0


def test_matching_statistics_equal_a_search_of_all_runs():
    templates = [list(t) for t in ("abcabdab", "bdabca", "cc", "abcabdab")]
    machine = Automaton(templates)
    text = list("abcabdabcabxabcccabdabdabca".replace("x", "d"))
    found = list(machine.statistics([machine.words[w] for w in text]))
    assert [size for size, _ in found] == [longest(templates, text, i) for i in range(len(text))]
    for i, (size, state) in enumerate(found):
        places = {(k, e) for k, t in enumerate(templates) for e in range(len(t)) if t[max(0, e - size + 1) : e + 1] == text[i - size + 1 : i + 1]}
        assert set(machine.ends[state]) == places


def test_words_equal_the_pattern():
    text = "A-b_C1 éÉ ß\x7f 'tis 10% ÀB\nc"
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert [w.decode() for w in words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    assert words_of(None) == []


def test_templates_with_changes_are_covered_and_prose_is_not(spark):
    mit = TEMPLATES[0][1]
    changed = mit.replace("free of charge", "at no cost").replace("sublicense", "relicense")
    texts = [mit, "intro words here " + changed + " and more", " ".join(mit.split()[:40]), "the rights to use copy of the software", None, "", "CC-BY all rights reserved. All Rights Reserved", mit + " " + TEMPLATES[2][1]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, mit, 0)], "doc_id long, text string, score int").repartition(3)
    rows = sorted(licences.scan(docs).collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and rows[0] == rows[1]
    assert got[0].labels == ["mit"] and got[0].score == 1.0 and (got[0].spans[0].first_word, got[0].spans[0].last_word) == (0, got[0].n_words - 1)
    assert got[1].labels == ["mit"] and 0.8 < got[1].score < 1 and got[1].spans[0].first_word == 10
    assert got[2].labels == [] and got[3].labels == [] and got[3].score == 0
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[5].labels) == (0, 0, None, [])
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].base_labels) == (3, 0, 5, ["cc-by", "reserved"])
    assert got[7].labels == ["apache-2.0", "mit"]
    assert licences.scan(docs.limit(0)).collect() == []


def test_base_phrases_equal_a_plain_search():
    own = licences.Scanner(TEMPLATES)
    text = "cc by cc by general public license x all rights reserved all rights"
    n_words, n_base, first, last, base, *_ = own.scan([text])[0]
    assert (n_words, n_base, first, last, base) == (13, 4, 0, 8, ["cc-by", "gpl", "reserved"])
    assert MIN_MATCH > 3


def test_chains_of_many_spans_and_many_chains_of_a_template():
    halves = [(0, 100, 0, 30), (0, 131, 30, 30)]
    strays = [(0, 101 + k // 10, 200 + 7 * k, 5) for k in range(90)]
    best = licences.chains(halves + strays)[0][0]
    assert best == (60, 100, 160)
    template = dict(licences.TEMPLATES)["unlicense"]
    row = licences.scanner(tuple(licences.TEMPLATES)).scan([" filler ".join([template] * 3)])[0]
    assert [x[0] for x in row[7]].count("unlicense") == 3
