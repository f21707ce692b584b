import random
import re

from tessara.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def case(seed=4):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß2"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([12, 25, 10, 3])))) for i in range(20)]
    items += [(100, "the the the"), (101, "Lone"), (102, None), (103, " ,. "), (104, items[0][1]), (105, items[1][1].upper())]
    docs = []
    for i in range(60):
        own = draw.choices(vocabulary, k=draw.randrange(60))
        for _ in range(draw.randrange(3)):
            passage = words(draw.choice(items)[1])
            at = draw.randrange(len(own) + 1)
            own[at:at] = passage[draw.randrange(3) :]
        docs.append((i, " ".join(own)))
    return [*docs, (90, None), (91, ""), (92, "the THE the the-the"), (93, "lone"), (94, " ".join(vocabulary) * 400 + " " + items[0][1]), (95, items[0][1] * 2)], items


def test_matches_equal_a_search_of_every_place(spark):
    docs, items = case()
    left = spark.createDataFrame([(*d, 1) for d in docs] + [(90, None, 2)], "doc_id long, text string, items int").repartition(4)
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    want = plain(docs, items)
    rows = decontaminate.phrase_matches(left, right).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == want[r.doc_id], r.doc_id
        said = words(dict(docs)[r.doc_id])
        assert all(" ".join(said[m.start : m.start + m.length]) == m.phrase for m in r.matches)


def test_rows_without_an_id_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "alpha beta"), (None, "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha beta")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.phrase_matches(docs, items).collect()) == [0, 2]
    assert decontaminate.phrase_matches(docs.limit(0), items).collect() == []
    assert [r.n_hit for r in decontaminate.phrase_matches(docs, items.limit(0)).collect()] == [0, 0]


def near_plain(docs, items, slack, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        found = {(s, " ".join(x)) for x in windows for s in range(len(w) + slack) if all(t in w[max(0, s + k - slack) : s + k + slack + 1] for k, t in enumerate(x))}
        out.append((doc, sorted(found), sorted(set().union(*[windows[tuple(x.split())] for _, x in found]))))
    return out


def test_proximity_finds_passages_with_words_put_in(spark):
    item = "zero one two three four five six seven eight nine"
    broken, gap = item.split(), item.split()
    broken[5:5] = ["extra", "words"]
    gap[5:5] = ["far"] * 9
    docs = spark.createDataFrame([(1, item), (2, " ".join(broken)), (3, "zero of other text and nine"), (4, " ".join(gap)), (5, "one zero")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    near = {r.doc_id for r in decontaminate.proximity_matches(docs, items, slack=2).where("size(near_ids) > 0").collect()}
    assert near == {1, 2}
    assert {r.doc_id for r in decontaminate.phrase_matches(docs, items).where("n_hit > 0").collect()} == {1}


def test_proximity_equals_a_search_of_every_start(spark):
    docs, items = case(9)
    draw = random.Random(3)
    docs = docs[:50] + [(i, t) for i, t in docs[60:] if i != 94]
    for i in range(200, 230):  # passages with words put in or swapped
        own = words(draw.choice(items[:20])[1])
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(own))
            own[at:at] = draw.choices(["w1", "x"], k=1) if draw.random() < 0.5 else [own.pop(draw.randrange(len(own)))]
        docs.append((i, " ".join(draw.choices(["w3", "y"], k=draw.randrange(5)) + own)))
    docs += [(None, items[0][1]), (None, "clean"), (None, None), docs[-1]]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, near int").repartition(4)
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    rows = decontaminate.proximity_matches(left, right, slack=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, sorted({(m.start, m.phrase) for m in r.near}), list(r.near_ids)) for r in rows), key=key)
    assert got == sorted(near_plain(docs, items, 2), key=key)
    assert sum(bool(r.near_ids) for r in rows) > 20
    assert decontaminate.proximity_matches(left.limit(0), right).collect() == []
    assert not any(r.near_ids for r in decontaminate.proximity_matches(left, right.limit(0)).collect())
