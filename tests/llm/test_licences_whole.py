"""The whole licence query against a plain search of all runs of all templates."""

import random
import re

import __spark_entry__ as driver
from tessara.llm import licences
from tessara.llm.licences import COVERAGE, MAX_GAP, MIN_MATCH, TEMPLATES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def matches(text, templates):
    """(template, first word in text, first word in template, size) of runs that no template continues on either side."""
    joined = [f" {' '.join(t)} " for t in templates]
    known = {w for t in templates for w in t}
    sizes = []
    for i, word in enumerate(text):
        size = 0
        while word in known and size <= i and any(f" {' '.join(text[i - size : i + 1])} " in t for t in joined):
            size += 1
        sizes.append(size)
    for i, size in enumerate(sizes):
        if size >= MIN_MATCH and (i + 1 == len(text) or sizes[i + 1] <= size):
            run = text[i - size + 1 : i + 1]
            for k, t in enumerate(templates):
                yield from ((k, i - size + 1, at, size) for at in range(len(t) - size + 1) if t[at : at + size] == run)


def chain(spans):
    """Of one template's spans: for each span the best chain that it ends, as (words, first word, last word)."""
    found = []
    for at, place, size in sorted(spans):
        best = (size, at)
        for (a, p, n), (had, start, _) in zip(sorted(spans), found, strict=False):
            twice = max(0, a + n - at, p + n - place)
            follows = at + size > a + n and place + size > p + n and twice < size
            if follows and at - a - n <= MAX_GAP and place - p - n <= MAX_GAP and had + size - twice > best[0]:
                best = (had + size - twice, start)
        found.append((*best, at + size - 1))
    return found


def brute(text, templates=TEMPLATES):
    own, cut = words(text), [words(t) for _, t in templates]
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    by, kept = {}, []
    for k, *span in matches(own, cut):
        by.setdefault(k, set()).add(tuple(span))
    for k, spans in by.items():
        free = set(range(len(own)))
        for n, a, b in sorted(chain(spans), reverse=True):
            if free >= set(range(a, b + 1)):
                free -= set(range(a, b + 1))
                if n / len(cut[k]) >= COVERAGE:
                    kept.append((templates[k][0], a, b, min(1.0, n / len(cut[k]))))
    starts = [i for i, _ in places]
    score = max([1.0] * bool(base) + [x[3] for x in kept], default=0.0)
    return len(own), len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | {x[0] for x in kept}), score, sorted(kept)


def test_the_query_over_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), r.n_spans) for r in driver.queries()["op4_licence_scan"](spark, d).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        n, places, first, last, base, labels, score, spans = brute(text)
        assert got[doc_id] == (n, places, first, last, ",".join(base), ",".join(labels), round(score, 9), len(spans)), doc_id


def test_spans_of_cut_and_mixed_templates():
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        out = []
        for _ in range(draw.randrange(1, 5)):
            own = words(draw.choice(TEMPLATES)[1])
            for _ in range(draw.randrange(4)):  # words are lost, changed and added
                at = draw.randrange(len(own))
                own[at : at + draw.randrange(3)] = draw.sample(["software", "the", "novel", "license"], draw.randrange(3))
            a = draw.randrange(len(own) // 3 + 1)
            out += own[a : len(own) - draw.randrange(len(own) // 3 + 1)] + ["filler"] * draw.randrange(8)
        texts.append(" ".join(out))
    texts.append(" novel ".join([TEMPLATES[0][1]] * 40))  # a long text
    rows = licences.Scanner(TEMPLATES).scan([*texts, None, ""])
    for text, row in zip([*texts, None, ""], rows, strict=True):
        assert (*row[:7], sorted(row[7])) == brute(text), text
    assert any(len(r[7]) > 1 for r in rows) and any(0 < r[6] < 1 for r in rows)
