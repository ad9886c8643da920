from __future__ import annotations

import os
import random

import pytest

tok = pytest.importorskip("siftwork.llm.tokenizer")
PATH = f"{tok.TOKENIZERS}/{tok.NAME}.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def _texts():
    random.seed(5)
    letters = "abcdeehiinnorsttABC éüß漢字🙂 \n\t01.,'\"-_<|>​"
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["", " ", "\n\n", "<|endoftext|>", "a" * 4000, " " * 2000, "ab" * 3000, "don't we'll I'VE", "é" * 500]


def test_same_ids_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = _texts()
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = tok.encoder(PATH)
    assert [enc(x) for x in texts] == want


def test_small_automaton_against_merging():
    merges = [(b"a", b"a"), (b"b", b"a"), (b"aa", b"b"), (b"a", b"b"), (b"aa", b"aa"), (b"ba", b"ba"), (b"ab", b"ab")]
    words = [bytes([c]) for c in b"abc"] + [x + y for x, y in merges]
    auto = tok.Automaton({w: i for i, w in enumerate(words)}, merges)

    def brute(word):
        parts = [bytes([c]) for c in word]
        for a, b in merges:
            k, out = 0, []
            while k < len(parts):
                if parts[k : k + 2] == [a, b]:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [words.index(p) for p in parts]

    random.seed(2)
    for _ in range(5000):
        w = bytes(random.choice(b"aabbc") for _ in range(random.randint(1, 14)))
        assert auto.encode(w) == brute(w), w


def test_round_trip_nulls_and_repeats(spark):
    rows = [(1, "Hello, wörld! 漢字"), (2, ""), (3, None), (1, "Hello, wörld! 漢字"), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = tok.document_ids(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert len(got) == 4 and got[2] == [] and got[3] == []
    back = {r.doc_id: r.text for r in tok.decode(ids, "doc_id").collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", 4: "x" * 50_000}


def test_empty_table(spark):
    assert tok.document_ids(spark.createDataFrame([], "doc_id long, text string, ids int")).collect() == []
