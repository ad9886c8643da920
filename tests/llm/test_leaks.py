from __future__ import annotations

import random

import numpy as np
import pytest

leaks = pytest.importorskip("siftwork.llm.leaks")
from siftwork.llm.words import word_hashes, words  # noqa: E402

WORDS = [f"w{k}" for k in range(60)]


@pytest.mark.parametrize(
    "text",
    [
        "One TWO, three; four", "<p>one <b>t</b>wo</p>three\nfour", "one two thr-\nee four", "> one two thr-\n> ee\n> four", "one two three four", "o​ne two **three** four",
        "ｏｎｅ ｔｗｏ three four", "one two three &nbsp;four", "[one](http://x.y/z) two three four", "one two thr­\nee four", "one; two — three… four!", "o­ne two three four",
    ],
)
def test_spellings_make_no_difference(text):
    assert words(text) == ["one", "two", "three", "four"]


def test_null_and_odd_texts():
    assert words(None) == [] and words("") == [] and words(" \n\t ***") == []
    assert words("naïve Ⅳ ﬁn") == words("NAÏVE IV fin")


def test_shared_run_means_shared_signature():
    random.seed(3)
    for _ in range(200):
        run = [random.choice(WORDS) for _ in range(12)]
        a = [random.choice(WORDS) for _ in range(random.randint(0, 9))] + run + [random.choice(WORDS) for _ in range(5)]
        b = [random.choice(WORDS) for _ in range(random.randint(0, 9))] + run
        assert set(leaks.signatures(word_hashes(a)).tolist()) & set(leaks.signatures(word_hashes(b)).tolist())
    assert len(leaks.signatures(word_hashes(WORDS[:11]))) == 0 and len(leaks.signatures(word_hashes(WORDS[:12]))) == 1


def _brute(docs, items, run=12):
    grams = lambda ws: {tuple(ws[k : k + run]) for k in range(len(ws) - run + 1)}
    own = {i: grams(words(t)) for i, t in items}
    return {(d, i) for d, t in docs for i, g in own.items() if grams(words(t)) & g}


def test_against_brute_force(spark):
    random.seed(4)
    text = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    items = [(k, text(random.choice([5, 11, 12, 30, 60]))) for k in range(25)] + [(90, None), (91, ""), (92, "same"), (3, "again")]
    docs = []
    for k in range(120):
        t = text(random.randint(0, 200))
        if k % 3 == 0:
            ws = (items[random.randrange(25)][1]).split()
            a = random.randrange(max(1, len(ws) - 10))
            piece = ws[a : a + random.choice([10, 11, 12, 13, 40])]
            if k % 2:
                piece = [w.upper() + "," for w in piece]
            t = t + "\n" + " ".join(piece) + " zz " + text(9)
        docs.append((k, t))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (0, docs[0][1]), (503, items[3][1] * 200)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in leaks.found(d, i).collect()}
    assert got == _brute([x for x in docs if x[1]], items)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(WORDS)), (2, " ".join(WORDS[::-1]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS[5:30]))], "item_id long, text string")
    monkeypatch.setattr(leaks, "bitmap", lambda own: np.full(64, 2**64 - 1, dtype=np.uint64))
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(1, 7)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks.found(none, items).collect() == []
