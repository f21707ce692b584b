import random
import re

from tessara.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(repeated))


def texts():
    draw = random.Random(2)
    made = [None, "", " \n\t ", "a b c", "x " * 8, "x " * 9, "one\ntwo\none\n\none \n", "# $ 50% <b>&|*", "é ß " * 15, "\n".join(["same line here"] * 30)]
    for _ in range(30):
        made.append(draw.choice([" ", "  ", "\n"]).join(draw.choices("abc", k=draw.randrange(60))))
    long = [f"w{i}" for i in range(30_000)]
    return [*made, " ".join(long), " ".join(long[:500] * 3), made[-1]]


def test_measurements_and_bits_equal_plain_counting(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(rows)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for i, t in enumerate(rows):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, t
        n_words, chars, symbols, lines, dups, repeats = want
        fails = [n_words < 20, 100 * repeats > 30 * n_words, chars < 2 * n_words, chars > 15 * n_words, 4 * symbols > n_words, 2 * dups > lines]
        assert r.fail_bits == sum(1 << k for k, f in enumerate(fails) if f)
    kept = {r.doc_id for r in docs.where(quality.kept("v1")).collect()}
    assert kept == {i for i, r in got.items() if r.fail_bits == 0} == {r.doc_id for r in quality.verdict(quality.ledger(docs)).where("kept").collect()}


def test_ablations_equal_counting_of_rows(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = quality.ledger(docs)
    bits = [r.fail_bits for r in rows.collect()]
    for policy, mask in quality.POLICIES.items():
        for r in quality.ablations(rows, policy).collect():
            own = [b & mask for b in bits]
            assert (r.n_failed, r.n_only) == (sum(bool(b & r.bit) for b in own), sum(b == r.bit for b in own))
            assert (r.n_kept_without, r.n_documents) == (sum(not b & ~r.bit for b in own), len(own))


def test_an_empty_table_and_a_plan_without_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.ledger(docs).collect() == [] and quality.ablations(quality.ledger(docs)).collect() == []
    plan = quality.ledger(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
